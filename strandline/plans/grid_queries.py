"""Queries of statistics with their tails. The SQL integrates the densities by Simpson's rule,
so it shares nothing with the continued fractions of strandline.functions.tails."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from strandline.functions import tails
from strandline.operators import paired as P, preservation, ranks as R, resample, trees, vectors as V
from strandline.operators.lineage import cut, dealt
from strandline.plans import derived as D
from strandline.plans.everyday_queries import _events, _r
from strandline.plans.paired_queries import _GAIN, _M, _RANKED, _deltas, _hits

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _simpson(f: str, a: str, b: str, n: int = 1000) -> str:
    """The integral of f(x) from a to b."""
    at = f"({a} + i * ({b} - {a}) / {n}.0)"
    return f"(list_sum(list_transform(range(0, {n + 1}), lambda i: (CASE WHEN i IN (0, {n}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {f.replace('{x}', at)})) * ({b} - {a}) / {3 * n}.0)"


def t_p(t: str, df: str) -> str:
    """Two-sided tail of Student's t: the angle atan(t / sqrt(df)) has density cos^(df - 1)."""
    density = f"pow(greatest(0, cos({{x}})), {df} - 1)"
    return f"({_simpson(density, f'atan(abs({t}) / sqrt({df}))', '(pi() / 2)')} / {_simpson(density, '0.0', '(pi() / 2)')})"


def normal_p(z: str) -> str:
    return f"greatest(0, 1 - sqrt(2 / pi()) * {_simpson('exp(-0.5 * pow({x}, 2))', '0.0', f'least(12.0, abs({z}))')})"


def chi2_p(x: str, df: str) -> str:
    """Upper tail of chi-square, by the square root of half of it."""
    return f"greatest(0, 1 - {_simpson(f'2 * pow({{x}}, {df} - 1) * exp(-pow({{x}}, 2))', '0.0', f'sqrt(least(700.0, {x}) / 2)')} / gamma({df} / 2.0))"


_RHO_P = lambda r, n, lost: t_p(f"({r} * sqrt(({n} - {lost}) / greatest(1e-300, 1 - {r} * {r})))", f"({n} - {lost})")


@query(_M + f", g AS (SELECT condition, {_RANKED('base', 'condition')} AS rx, {_RANKED('delta', 'condition')} AS ry FROM d), s AS (SELECT condition, count(*) AS n, corr(rx, ry) AS rho FROM g GROUP BY 1) SELECT condition, n, round(rho, 6) AS rho, round({_RHO_P('rho', 'n', 2)}, 6) AS p FROM s")
def spearman_p(spark, sf_dir):
    """K2: rank correlations with their t tails."""
    return R.spearman_p(_deltas(spark, sf_dir), ["condition"], "base", "delta").select("condition", "n", *_r("rho", "p"))


_PART = f", g AS (SELECT condition, {_RANKED('gene % 23', 'condition')} AS rx, {_RANKED('delta', 'condition')} AS ry, {_RANKED('level', 'condition')} AS rz FROM d), c AS (SELECT condition, count(*) AS n, corr(rx, ry) AS a, corr(rx, rz) AS b, corr(ry, rz) AS c FROM g GROUP BY 1), s AS (SELECT condition, n, (a - b * c) / sqrt((1 - b * b) * (1 - c * c)) AS rho FROM c)"


@query(_M + _PART + f" SELECT condition, n, round(rho, 6) AS rho, round({_RHO_P('rho', 'n', 3)}, 6) AS p FROM s")
def partial_correlation(spark, sf_dir):
    """Rank correlation with a ranked covariate taken out."""
    d = _deltas(spark, sf_dir).withColumn("x", F.col("gene") % 23)
    return R.partial_spearman(d, ["condition"], "x", "delta", "level").select("condition", "n", *_r("rho", "p"))


_MOMENTS = """, mm AS (SELECT condition, avg(x) AS m, stddev_pop(x) AS s, avg(y) AS my, count(*) AS n FROM o GROUP BY 1), z AS (SELECT condition, n, (x - m) / s AS z, y - my AS e FROM o JOIN mm USING (condition)),
 k AS (SELECT condition, any_value(n) AS n, sum(z * z) AS zz, sum(z * (z * z - 1)) AS zq, sum((z * z - 1) * (z * z - 1)) AS qq, sum(z * e) AS ze, sum((z * z - 1) * e) AS qe, sum(e * e) AS ee FROM z GROUP BY 1),
 b AS (SELECT *, (ze * qq - zq * qe) / (zz * qq - zq * zq) AS b1, (zz * qe - zq * ze) / (zz * qq - zq * zq) AS b2 FROM k),
 t AS (SELECT *, b1 / sqrt((ee - b1 * ze - b2 * qe) / (n - 3) * qq / (zz * qq - zq * zq)) AS t1, b2 / sqrt((ee - b1 * ze - b2 * qe) / (n - 3) * zz / (zz * qq - zq * zq)) AS t2 FROM b)"""


@query(_M + ", o AS (SELECT condition, base AS x, delta AS y FROM d)" + _MOMENTS + f" SELECT condition, n, round(b1, 5) AS b1, round({t_p('t1', '(n - 3)')}, 5) AS p1, round(b2, 5) AS b2, round({t_p('t2', '(n - 3)')}, 5) AS p2 FROM t WHERE n >= 20")
def shape_fit(spark, sf_dir):
    """Y on z and z squared, from moments."""
    return R.shape_fit(_deltas(spark, sf_dir), ["condition"], "base", "delta").select("condition", "n", *_r("b1", "p1", "b2", "p2", digits=5))


@query(_M + f", s AS (SELECT condition, gene % 5 AS stratum, delta FROM d), g AS (SELECT condition, count(*) FILTER (stratum IN (2, 3)) AS n1, count(*) FILTER (stratum IN (0, 4)) AS n2, avg(delta) FILTER (stratum IN (2, 3)) AS m1, avg(delta) FILTER (stratum IN (0, 4)) AS m2, (var_samp(delta) FILTER (stratum IN (2, 3))) AS v1, (var_samp(delta) FILTER (stratum IN (0, 4))) AS v2 FROM s GROUP BY 1), t AS (SELECT condition, m1 - m2 AS difference, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t, pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS nu FROM g WHERE n1 >= 5 AND n2 >= 5) SELECT condition, round(difference, 6) AS difference, round({t_p('t', 'nu')}, 6) AS p FROM t")
def mid_against_extreme(spark, sf_dir):
    """Middle strata against the outer ones by Welch's test."""
    d = _deltas(spark, sf_dir).withColumn("stratum", F.col("gene") % 5)
    return R.welch(d, ["condition"], "delta", "stratum IN (2, 3)", "stratum IN (0, 4)").select("condition", *_r("difference", "p"))


_W = ", o AS (SELECT condition, gene % 29 AS x, gain AS y, 1 / var AS w FROM g), m AS (SELECT condition, avg(x) AS m, stddev_pop(x) AS s, count(*) AS n FROM o GROUP BY 1), z AS (SELECT condition, n, (x - m) / s AS z, y, w FROM o JOIN m USING (condition)), a AS (SELECT condition, sum(w * z) / sum(w) AS az, sum(w * z * z) / sum(w) AS aq, sum(w * y) / sum(w) AS ay FROM z GROUP BY 1), c AS (SELECT condition, n, w, z - az AS z, z * z - aq AS q, y - ay AS e FROM z JOIN a USING (condition)), k AS (SELECT condition, any_value(n) AS n, sum(w * z * z) AS zz, sum(w * z * q) AS zq, sum(w * q * q) AS qq, sum(w * z * e) AS ze, sum(w * q * e) AS qe, sum(w * e * e) AS ee FROM c GROUP BY 1), b AS (SELECT *, (ze * qq - zq * qe) / (zz * qq - zq * zq) AS b1, (zz * qe - zq * ze) / (zz * qq - zq * zq) AS b2 FROM k), t AS (SELECT *, greatest(1, (ee - b1 * ze - b2 * qe) / (n - 3)) AS k FROM b)"


@query(_GAIN + _W + f" SELECT condition, n, round(b1, 5) AS b1, round({normal_p('(b1 / sqrt(k * qq / (zz * qq - zq * zq)))')}, 5) AS p1, round(b2, 5) AS b2, round({normal_p('(b2 / sqrt(k * zz / (zz * qq - zq * zq)))')}, 5) AS p2 FROM t WHERE n >= 15")
def weighted_shape_fit(spark, sf_dir):
    """The same with inverse-variance weights."""
    g = P.logit_gain(_hits(spark, sf_dir), "gene", "condition", "view", "k", "t").withColumn("x", F.col("gene") % 29)
    return R.weighted_shape_fit(g, ["condition"], "x", "gain", "var").select("condition", "n", *_r("b1", "p1", "b2", "p2", digits=5))


@query(_GAIN + f""", sx AS (SELECT condition, gene % 5 IN (2, 3) AS mid, round(gain, 9) AS gain, var FROM g), r AS (SELECT condition, mid, gain, var, {_RANKED('gain', 'condition')} AS r FROM sx),
 u AS (SELECT condition, count(*) FILTER (mid) AS n1, count(*) FILTER (NOT mid) AS n2, sum(r) FILTER (mid) - count(*) FILTER (mid) * (count(*) FILTER (mid) + 1) / 2.0 AS u, sum(gain / var) FILTER (mid) / sum(1 / var) FILTER (mid) AS wm, sum(gain / var) FILTER (NOT mid) / sum(1 / var) FILTER (NOT mid) AS we FROM r GROUP BY 1),
 t AS (SELECT condition, sum(c * c * c - c) AS ties FROM (SELECT condition, gain, CAST(count(*) AS DOUBLE) AS c FROM sx GROUP BY 1, 2) GROUP BY 1),
 z AS (SELECT *, greatest(0, abs(u - n1 * n2 / 2.0) - 0.5) / sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1.0)))) AS z FROM u JOIN t USING (condition))
 SELECT condition, n1, n2, CAST(u AS DOUBLE) AS u, round(least(1, {normal_p('z')}), 6) AS p, round(wm - we, 6) AS difference FROM z""")
def mid_against_extreme_ranks(spark, sf_dir):
    """Middle against outer strata by rank sums, and their weighted means."""
    g = P.logit_gain(_hits(spark, sf_dir), "gene", "condition", "view", "k", "t").withColumn("gain", F.round("gain", 9)).withColumn("mid", (F.col("gene") % 5).isin(2, 3))
    w = P.weighted_mean(g, ["condition", "mid"], "gain", "var").groupBy("condition").agg((F.max(F.when(F.col("mid"), F.col("mean"))) - F.max(F.when(~F.col("mid"), F.col("mean")))).alias("difference"))
    return R.mann_whitney_p(g, ["condition"], "mid", True, "gain").join(w, "condition").select("condition", "n1", "n2", "u", *_r("p", "difference"))


@query(_M + f""", x AS (SELECT condition, delta, rank() OVER (ORDER BY delta) + (count(*) OVER (PARTITION BY delta) - 1) / 2.0 AS r FROM d), s AS (SELECT condition, count(*) AS n, sum(r) AS r FROM x GROUP BY 1), t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*) AS c FROM x GROUP BY delta)),
 a AS (SELECT count(*) AS k, sum(n) AS n, sum(r * r / n) AS s FROM s), h AS (SELECT k, CAST(n AS BIGINT) AS n, (12.0 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / CAST(n * n * n - n AS DOUBLE)) AS h FROM a, t) SELECT k, n, round(h, 6) AS h, round({chi2_p('h', '(k - 1)')}, 6) AS p FROM h""")
def kruskal_tail(spark, sf_dir):
    """The statistic over conditions with its chi-square tail."""
    x = R.kruskal(_deltas(spark, sf_dir), "condition", "delta")
    return x.withColumn("p", R.tail(lambda h, k: tails.chi2_upper(h, k - 1), "h", "k")).select("k", "n", *_r("h", "p"))


@query(f"WITH f AS (SELECT l_partkey AS gene, sum(l_quantity) AS a, sum(l_quantity) + avg(l_discount) * 40 - 1 AS b, max(l_linenumber) < 7 AS converged, max(l_tax) > 0.079 AS saturated FROM lineitem GROUP BY 1), l AS (SELECT *, greatest(0, 2 * (b - a)) AS lr FROM f) SELECT gene, round(lr, 6) AS lr, converged, saturated, CASE WHEN converged THEN round({normal_p('sqrt(lr)')}, 6) END AS p FROM l")
def likelihood_ratios(spark, sf_dir):
    """One degree of freedom; no p where a fit did not converge; saturated ones flagged."""
    f = D.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").alias("a"), (F.sum("l_quantity") + F.avg("l_discount") * 40 - 1).alias("b"), (F.max("l_linenumber") < 7).alias("converged"), (F.max("l_tax") > 0.079).alias("saturated"))
    x = f.withColumn("lr", F.greatest(F.lit(0.0), 2 * (F.col("b") - F.col("a"))))
    return x.select("gene", F.round("lr", 6).alias("lr"), "converged", "saturated", F.when(F.col("converged"), F.round(R.tail(tails.likelihood_ratio, "lr"), 6)).alias("p"))


_GRID = _M.replace("SELECT c.gene, c.condition, c.mean AS level", "SELECT c.gene, c.condition, c.n, c.mean AS level") + ", o AS (SELECT condition, gene, gene % 23 AS rate, n AS depth, level, delta, base FROM d), u AS (UNPIVOT o ON rate, depth INTO NAME predictor VALUE x), v AS (UNPIVOT u ON delta, level INTO NAME outcome VALUE y)"


@query(_GRID + f""", g AS (SELECT condition, predictor, outcome, {_RANKED('x', 'condition, predictor, outcome')} AS rx, {_RANKED('y', 'condition, predictor, outcome')} AS ry, {_RANKED('base', 'condition, predictor, outcome')} AS rz FROM v),
 c AS (SELECT condition, predictor, outcome, count(*) AS n, corr(rx, ry) AS a, corr(rx, rz) AS b, corr(ry, rz) AS c FROM g GROUP BY 1, 2, 3), s AS (SELECT *, (a - b * c) / sqrt((1 - b * b) * (1 - c * c)) AS q FROM c)
 SELECT condition, predictor, CASE predictor WHEN 'rate' THEN 'primary' ELSE 'frame' END AS role, outcome, n, round(a, 6) AS rho, round({_RHO_P('a', 'n', 2)}, 6) AS p, round(q, 6) AS rho_partial, round({_RHO_P('q', 'n', 3)}, 6) AS p_partial FROM s""")
def rate_direction_grid(spark, sf_dir):
    """Every predictor against every outcome, plain and with a covariate taken out."""
    m = P.gene_means(D.records(spark, sf_dir), "gene", "condition", order="sample")
    d = P.deltas(m, "gene", "condition", "view").join(m.select("gene", "condition", F.col("n").alias("depth")), ["gene", "condition"]).withColumn("rate", F.col("gene") % 23)
    d = cut(d)  # read by both correlations
    keys = ["condition", "gene", "base"]
    u = d.select(*keys, "delta", "level", *[F.col(c).cast("double").alias(c) for c in ("rate", "depth")]).unpivot([*keys, "delta", "level"], ["rate", "depth"], "predictor", "x").unpivot([*keys, "predictor", "x"], ["delta", "level"], "outcome", "y")
    by = ["condition", "predictor", "outcome"]
    part = R.partial_spearman(u, by, "x", "y", "base").select(*by, F.col("rho").alias("rho_partial"), F.col("p").alias("p_partial"))
    role = F.when(F.col("predictor") == "rate", "primary").otherwise("frame")
    return R.spearman_p(u, by, "x", "y").join(part, by).select("condition", "predictor", role.alias("role"), "outcome", "n", *_r("rho", "p", "rho_partial", "p_partial"))


@query(_GAIN + f", o AS (SELECT condition, gene, gene % 29 AS rate, gene % 13 AS width, round(gain, 9) AS gain, var FROM g), u AS (UNPIVOT o ON rate, width INTO NAME predictor VALUE x), r AS (SELECT condition, predictor, var, gain, {_RANKED('x', 'condition, predictor')} AS rx, {_RANKED('gain', 'condition, predictor')} AS ry FROM u), sx AS (SELECT condition, predictor, count(*) AS n, corr(rx, ry) AS rho, sum(gain / var) / sum(1 / var) AS mean FROM r GROUP BY 1, 2) SELECT condition, predictor, n, round(rho, 6) AS rho, round({_RHO_P('rho', 'n', 2)}, 6) AS p, round(mean, 6) AS mean FROM sx")
def rate_gain_grid(spark, sf_dir):
    """Predictors against gains, with the weighted mean gain."""
    g = P.logit_gain(_hits(spark, sf_dir), "gene", "condition", "view", "k", "t")
    u = g.withColumn("gain", F.round("gain", 9)).withColumn("rate", F.col("gene") % 29).withColumn("width", F.col("gene") % 13).unpivot(["condition", "gene", "gain", "var"], ["rate", "width"], "predictor", "x")
    by = ["condition", "predictor"]
    return R.spearman_p(u, by, "x", "gain").join(P.weighted_mean(u, by, "gain", "var").select(*by, "mean"), by).select(*by, "n", *_r("rho", "p", "mean"))


#: Rungs of a ladder by layer: an identity and a score each.
_LADDER = "WITH l AS (SELECT event_id % 4 AS layer, user_id % 7 AS rung, avg(value) / 100 AS ident, stddev_pop(value) / 100 AS rho FROM events GROUP BY 1, 2)"


@query(_LADDER + f""", r AS (SELECT layer, ident, rho, {_RANKED('ident', 'layer')} AS ri, {_RANKED('rho', 'layer')} AS rr FROM l), a AS (SELECT layer, count(*) AS n_all, corr(ri, rr) AS rho_all FROM r GROUP BY 1),
 k AS (SELECT layer, ident, rho, {_RANKED('ident', 'layer')} AS ri, {_RANKED('rho', 'layer')} AS rr FROM l WHERE rung < 5), b AS (SELECT layer, count(*) AS n_plain, corr(ri, rr) AS rho_plain, regr_slope(rho, ident) AS s, regr_intercept(rho, ident) AS i, max(ident) AS hi, min(ident) AS lo FROM k GROUP BY 1), e AS (SELECT layer, ident AS x, rho AS y FROM l WHERE rung = 5)
 SELECT layer, n_all, round(rho_all, 6) AS rho_all, n_plain, round(rho_plain, 6) AS rho_plain, round({_RHO_P('rho_all', 'n_all', 2)}, 6) AS p_all, round(i + s * x, 6) AS predicted, round(y - (i + s * x), 6) AS residual, round((x - hi) / (hi - lo), 6) AS extrapolation FROM a JOIN b USING (layer) JOIN e USING (layer)""")
def monotone_rungs(spark, sf_dir):
    """Whether scores follow identity over rungs, all of them and the plain ones,
    and what the plain ones' line predicts for a rung beyond."""
    x = _events(spark, sf_dir).groupBy((F.col("event_id") % 4).alias("layer"), (F.col("user_id") % 7).alias("rung")).agg((F.avg("value") / 100).alias("ident"), (F.stddev_pop("value") / 100).alias("rho_"))
    every = R.spearman_p(x, ["layer"], "ident", "rho_", least=3).select("layer", F.col("n").alias("n_all"), F.col("rho").alias("rho_all"), F.col("p").alias("p_all"))
    plain = x.where("rung < 5")
    own = R.spearman(plain, ["layer"], "ident", "rho_", least=3).select("layer", F.col("n").alias("n_plain"), F.col("rho").alias("rho_plain"))
    line = plain.groupBy("layer").agg(F.regr_slope("rho_", "ident").alias("s"), F.regr_intercept("rho_", "ident").alias("i"), F.max("ident").alias("hi"), F.min("ident").alias("lo"))
    at = x.where("rung = 5").select("layer", F.col("ident").alias("x"), F.col("rho_").alias("y"))
    j = every.join(own, "layer").join(line, "layer").join(at, "layer").withColumn("predicted", F.expr("i + s * x")).withColumn("residual", F.expr("y - (i + s * x)")).withColumn("extrapolation", F.expr("try_divide(x - hi, hi - lo)"))
    return j.select("layer", "n_all", "n_plain", *_r("rho_all", "rho_plain", "p_all", "predicted", "residual", "extrapolation"))


@query(f"WITH i AS (SELECT event_type AS condition, user_id % 15 AS family, avg(value) AS ident FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), s AS (SELECT event_type AS condition, user_id % 15 AS family, stddev_pop(value) AS rho FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2), j AS (SELECT condition, ident, rho FROM i JOIN s USING (condition, family)), r AS (SELECT condition, {_RANKED('ident', 'condition')} AS ri, {_RANKED('rho', 'condition')} AS rr FROM j), c AS (SELECT condition, count(*) AS n, corr(ri, rr) AS rho FROM r GROUP BY 1 HAVING count(*) >= 5) SELECT condition, n, round(rho, 6) AS rho, round({_RHO_P('rho', 'n', 2)}, 6) AS p FROM c")
def within_rung(spark, sf_dir):
    """Inside one rung, whether families that kept more identity score higher."""
    e = _events(spark, sf_dir).withColumnRenamed("event_type", "condition").withColumn("family", F.col("user_id") % 15)
    i = e.where("event_id % 2 = 0").groupBy("condition", "family").agg(F.avg("value").alias("ident"))
    s = e.where("event_id % 2 = 1").groupBy("condition", "family").agg(F.stddev_pop("value").alias("score"))
    return R.spearman_p(i.join(s, ["condition", "family"]), ["condition"], "ident", "score", least=5).select("condition", "n", *_r("rho", "p"))


@query(f"WITH c AS (SELECT event_type AS condition, user_id % 20 AS grp, event_id % 50 AS a, avg(value) AS d FROM events WHERE event_type <> 'view' GROUP BY 1, 2, 3), n AS (SELECT user_id % 20 AS grp, event_id % 50 AS a, avg(value) AS nat FROM events WHERE event_type = 'view' GROUP BY 1, 2), j AS (SELECT condition, grp, d, nat FROM c JOIN n USING (grp, a)), r AS (SELECT condition, grp, {_RANKED('d', 'condition, grp')} AS rd, {_RANKED('nat', 'condition, grp')} AS rn FROM j), g AS (SELECT condition, grp, corr(rd, rn) AS rho FROM r GROUP BY 1, 2 HAVING count(*) >= 6), f AS (SELECT condition, grp % 4 AS family, avg(rho) AS rho FROM g GROUP BY 1, 2) SELECT condition, family, round(rho, 6) AS rho, round(avg(rho) OVER (PARTITION BY condition), 6) AS mean_rho FROM f")
def control_preservation(spark, sf_dir):
    """How well controls keep the natural distances of each group, by family and overall."""
    from pyspark.sql import Window

    e = _events(spark, sf_dir).select(F.col("event_type").alias("condition"), (F.col("user_id") % 20).alias("grp"), (F.col("event_id") % 50).alias("a"), "value")
    c = e.where("condition <> 'view'").groupBy("condition", "grp", "a").agg(F.avg("value").alias("d"))
    n = e.where("condition = 'view'").groupBy("grp", "a").agg(F.avg("value").alias("nat"))
    g = R.spearman(c.join(n, ["grp", "a"]), ["condition", "grp"], "d", "nat").where("rho IS NOT NULL")
    f = g.groupBy("condition", (F.col("grp") % 4).alias("family")).agg(F.avg("rho").alias("rho"))
    return f.withColumn("mean_rho", F.round(F.avg("rho").over(Window.partitionBy("condition")), 6)).withColumn("rho", F.round("rho", 6))


#: Embeddings of three conditions: as they are, and with a random direction of the vector's
#: norm added a little and much. Species are nations; their tree has regions as inner nodes.
_CONDITIONS = {"natural": 0.0, "light": 0.4, "heavy": 1.5}
_KEPT = f"""WITH e AS ({D.EMBEDDED_SQL}), z AS (SELECT key, family, v, list_transform(range(0, len(v)), lambda i: list_sum(list_transform(range(0, 4), lambda k: CAST('0x' || substr(md5('1:' || CAST(key AS VARCHAR) || ':' || CAST(i AS VARCHAR)), CAST(1 + 8 * k AS BIGINT), 8) AS BIGINT) / 4294967296.0 - 0.5))) AS z FROM e),
 r AS (SELECT key, family, v, list_transform(z, lambda x: CAST(x AS DOUBLE) * sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(z, z))) AS r FROM z),
 c AS (SELECT key, family, key % 2 AS grp, CAST(key % 25 AS INT) AS species, condition, list_transform(list_zip(v, r), lambda x: x[1] + w * x[2]) AS v FROM r, (VALUES {", ".join(f"('{n}', CAST({w} AS DOUBLE))" for n, w in _CONDITIONS.items())}) t(condition, w)),
 u AS (SELECT key, family, grp, species, condition, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM c),
 p AS (SELECT x.condition, x.family, x.grp, x.key AS a, y.key AS b, round(acos(least(1, greatest(-1, list_dot_product(x.u, y.u)))) / pi(), 9) AS d, least(x.species, y.species) AS lo, greatest(x.species, y.species) AS hi FROM u x JOIN u y ON x.condition = y.condition AND x.family = y.family AND x.grp = y.grp AND x.key < y.key),
 t AS (SELECT x.n_nationkey AS lo, y.n_nationkey AS hi, CASE WHEN x.n_regionkey = y.n_regionkey THEN 2.0 + (x.n_nationkey + y.n_nationkey) / 10.0 ELSE 8.0 + (x.n_nationkey + y.n_nationkey) / 10.0 END AS t FROM nation x JOIN nation y ON x.n_nationkey < y.n_nationkey),
 j AS (SELECT p.condition, p.family, p.grp, p.d, n.d AS nat, round(coalesce(t.t, 0), 6) AS tree FROM p JOIN p n ON n.condition = 'natural' AND n.a = p.a AND n.b = p.b LEFT JOIN t ON t.lo = p.lo AND t.hi = p.hi),
 k AS (SELECT *, {_RANKED('d', 'condition, family, grp')} AS rd, {_RANKED('nat', 'condition, family, grp')} AS rn, {_RANKED('tree', 'condition, family, grp')} AS rt FROM j),
 g AS (SELECT condition, family, grp, CASE WHEN count(*) >= 6 THEN corr(rd, rn) END AS kept, CASE WHEN count(*) >= 6 THEN corr(rd, rt) END AS found FROM k GROUP BY 1, 2, 3),
 w AS (SELECT condition, family, count(kept) AS n_groups, round(avg(kept), 6) AS rho_natural, round(avg(found), 6) AS rho_tree FROM g GROUP BY 1, 2),
 x AS (SELECT condition, family, unnest(u) AS x, unnest(range(len(u))) AS i FROM u), m AS (SELECT condition, family, list(x ORDER BY i) AS m FROM (SELECT condition, family, i, avg(x) AS x FROM x GROUP BY 1, 2, 3) GROUP BY 1, 2),
 b AS (SELECT x.condition, x.family AS a, y.family AS b, round(acos(list_dot_product(x.m, y.m) / sqrt(list_dot_product(x.m, x.m)) / sqrt(list_dot_product(y.m, y.m))) / pi(), 9) AS d FROM m x JOIN m y ON x.condition = y.condition AND x.family < y.family),
 bn AS (SELECT b.condition, b.d, n.d AS nat FROM b JOIN b n ON n.condition = 'natural' AND n.a = b.a AND n.b = b.b), br AS (SELECT condition, {_RANKED('d', 'condition')} AS rd, {_RANKED('nat', 'condition')} AS rn FROM bn), bt AS (SELECT condition, round(corr(rd, rn), 6) AS rho_between FROM br GROUP BY 1)
 SELECT w.*, rho_between FROM w JOIN bt USING (condition)"""


def _conditions(spark, sf_dir):
    e = cut(dealt(D.embedded(spark, sf_dir), "key").withColumn("r", V.matched_random("v", "key")))  # else drawn for each condition
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("condition"), F.lit(w).alias("w")) for n, w in _CONDITIONS.items()])).alias("c")
    x = e.select("key", "family", "v", "r", names).select("key", "family", "c.condition", F.zip_with("v", F.zip_with("r", F.array_repeat("c.w", F.size("r")), lambda r, w: r * w), lambda v, r: v + r).alias("v"))
    return cut(x.withColumn("grp", F.col("key") % 2))


def _species_tree(spark, sf_dir):
    """(a, b, d): path lengths between nations, by their regions and one root."""
    n = D.table(spark, sf_dir, "nation")
    leaves = n.select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("up"), (1 + F.col("n_nationkey") / 10.0).alias("len"))
    inner = n.select(F.concat(F.lit("r"), "n_regionkey").alias("node"), F.lit("root").alias("up"), F.lit(3.0).alias("len")).distinct()
    root = inner.limit(1).select(F.lit("root").alias("node"), F.lit(None).cast("string").alias("up"), F.lit(0.0).alias("len"))
    paths = trees.ancestors(leaves.unionByName(inner).unionByName(root), "node", "up", "len")
    d = trees.patristic(paths, leaves.select("node"), "node")
    number = lambda c: F.substring(c, 2, 9).cast("int")
    return d.select(F.least(number("a"), number("b")).alias("a"), F.greatest(number("a"), number("b")).alias("b"), F.round("d", 6).alias("d"))


@query(_KEPT)
def controls_against_tree(spark, sf_dir):
    """Controls against natural distances and the species tree by family, and between
    families by their centroids."""
    x = _conditions(spark, sf_dir)
    tree = {(r["a"], r["b"]): r["d"] for r in _species_tree(spark, sf_dir).collect()}  # a row for each pair of nations
    w = preservation.within_vectors(x.withColumn("species", (F.col("key") % 25).cast("int")), "natural", tree)
    c = V.centroids(x.withColumn("cell", F.concat_ws("|", "condition", "family")), "cell", "v")
    c = c.select(F.split("cell", "[|]")[0].alias("condition"), F.split("cell", "[|]")[1].cast("int").alias("family"), "centroid")
    between = V.pair_distances(c, "family", "condition", "centroid").select("condition", "a", "b", F.round("angular", 9).alias("d"))
    b = preservation.between(between, "natural").select("condition", F.round("rho_between", 6).alias("rho_between"))
    return w.join(b, "condition").select("condition", "family", "n_groups", *_r("rho_natural", "rho_tree"), "rho_between")


@query(f"WITH s AS (SELECT median(value) AS m, quantile_cont(value, 0.9) - quantile_cont(value, 0.1) AS w FROM events WHERE event_type = 'click'), g AS (SELECT CAST(unnest(range(0, 21)) * 5.0 AS DOUBLE) AS x), e AS (SELECT event_id % 100 AS x, value AS y FROM events WHERE event_type = 'click') SELECT g.x, round(sum(y * exp(-0.5 * pow((e.x - g.x) / 8.0, 2))) / sum(exp(-0.5 * pow((e.x - g.x) / 8.0, 2))), 6) AS mean FROM g, e GROUP BY 1")
def local_mean(spark, sf_dir):
    """A Gaussian-weighted local mean on a grid of 21 points."""
    e = _events(spark, sf_dir).where("event_type = 'click'").select((F.col("event_id") % 100).alias("at"), F.col("value").alias("y"))
    grid = F.explode(F.array(*[F.lit(5.0 * i) for i in range(21)]))
    w = F.exp(-0.5 * F.pow((F.col("at") - F.col("x")) / 8.0, F.lit(2.0)))
    return e.withColumn("x", grid).groupBy("x").agg(F.round(F.sum(F.col("y") * w) / F.sum(w), 6).alias("mean"))


# -- not in SQL: seeded draws ----------------------------------------------------------------


@query()
def family_uncertainty(spark, sf_dir):
    """K6: mean, deviation, interval of 10,000 draws and signed-rank p by family, with whether
    a second run from the rows gives the same figures exactly."""
    d = _deltas(spark, sf_dir).withColumn("family", F.col("gene") % 12)
    run = lambda: resample.by_group(d, ["family"], "delta", lambda v, r: resample.family_uncertainty(v, r), "n long, mean double, sd double, low double, high double, p double, apart boolean")
    # the whole of it once more from the rows: every figure must come out to the last bit
    again = run().select("family", F.struct("n", "mean", "sd", "low", "high", "p", "apart").alias("again"))
    one = run()
    same = F.struct("n", "mean", "sd", "low", "high", "p", "apart").eqNullSafe(F.col("again"))
    return one.join(again, "family").withColumn("reproduced", same).drop("again")


@query()
def shuffled_agreement(spark, sf_dir):
    """1,000 shuffles within strata against their closed form, an error where they disagree."""
    from strandline.plans.paired_queries import _sites

    s = _sites(spark, sf_dir).withColumn("stratum", F.ascii("h") * 3 + F.col("phase")).withColumn("grp", F.col("key") % 6)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grp = int(pdf["grp"].iloc[0])
        pdf = pdf.sort_values(list(pdf.columns))
        found = resample.shuffled_agreement(*(pdf[c].to_numpy() for c in ("p", "y", "stratum")), resample.rng_for("shuffle", grp), n=pdf["n"].to_numpy())
        return pd.DataFrame([(grp, *found)], columns=["grp", "expected", "mean", "sd", "z"])

    cells = s.groupBy("grp", "p", "y", "stratum").agg(F.count("*").alias("n"))  # a few rows a group
    return cells.groupBy("grp").applyInPandas(run, "grp long, expected double, mean double, sd double, z double")


@query()
def trend_levels(spark, sf_dir):
    """Levels by stratum with bootstrap intervals of their medians."""
    d = _deltas(spark, sf_dir).withColumn("stratum", F.col("gene") % 4)
    return resample.by_group(d, ["condition", "stratum"], "level", lambda v, r: (len(v), float(np.median(v)), *resample.bootstrap(v, r, 1000, np.median)), "n long, median double, low double, high double")
