"""Queries over steering records, ranks and paired statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.operators import paired as P, ranks as R
from strandline.operators.lineage import dealt
from strandline.plans import derived as D

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


BASE = "view"
_M = f"WITH r AS ({D.RECORDS_SQL}), m AS (SELECT gene, condition, avg(value) AS mean, count(value) AS n FROM r GROUP BY 1, 2), d AS (SELECT c.gene, c.condition, c.mean AS level, b.mean AS base, c.mean - b.mean AS delta FROM m c JOIN m b ON b.gene = c.gene AND b.condition = '{BASE}' WHERE c.condition <> '{BASE}')"


def _deltas(spark, sf_dir):
    return P.deltas(P.gene_means(D.records(spark, sf_dir), "gene", "condition", order="sample"), "gene", "condition", BASE)


@query(_M + " SELECT gene, condition, round(level, 7) AS level, round(base, 7) AS base, round(delta, 7) AS delta FROM d")
def paired_delta(spark, sf_dir):
    """D4, G1."""
    return _deltas(spark, sf_dir).select("gene", "condition", *[F.round(c, 7).alias(c) for c in ("level", "base", "delta")])


_DESC = "count(*) AS n, round(avg(delta), 7) AS mean, round(stddev_samp(delta), 7) AS sd, round(quantile_cont(delta, 0.25), 7) AS q25, round(quantile_cont(delta, 0.5), 7) AS median, round(quantile_cont(delta, 0.75), 7) AS q75, round(avg(CASE WHEN delta > 0 THEN 1.0 ELSE 0.0 END), 7) AS frac_improved"


@query(_M + f" SELECT condition, {_DESC} FROM d GROUP BY 1")
def describe_delta(spark, sf_dir):
    """G4, G5."""
    x = P.describe(_deltas(spark, sf_dir), ["condition"], "delta")
    return x.select("condition", "n", *[F.round(c, 7).alias(c) for c in ("mean", "sd", "q25", "median", "q75", "frac_improved")])


@query(_M + " SELECT condition, count(*) AS n, round(avg(mean), 7) AS mean, round(stddev_samp(mean), 7) AS sd, round(median(mean), 7) AS median FROM m GROUP BY 1")
def levels(spark, sf_dir):
    """G3, R7."""
    m = P.gene_means(D.records(spark, sf_dir), "gene", "condition")
    return m.groupBy("condition").agg(F.count("*").alias("n"), F.round(F.avg("mean"), 7).alias("mean"), F.round(F.stddev_samp("mean"), 7).alias("sd"), F.round(F.median("mean"), 7).alias("median"))


_HITS = "SELECT gene, condition, CASE WHEN value > 50 THEN 1 ELSE 0 END AS k, 1 AS t FROM (" + D.RECORDS_SQL + ")"


def _hits(spark, sf_dir):
    return D.records(spark, sf_dir).select("gene", "condition", "sample", F.when(F.col("value") > 50, 1).otherwise(0).alias("k"), F.lit(1).alias("t"))


_GAIN = f"WITH s AS (SELECT gene, condition, sum(k) AS k, sum(t) AS t FROM ({_HITS}) GROUP BY 1, 2), l AS (SELECT *, ln((k + 0.5) / (t - k + 0.5)) AS l, 1 / (k + 0.5) + 1 / (t - k + 0.5) AS v FROM s), g AS (SELECT c.gene, c.condition, c.l - b.l AS gain, c.v + b.v AS var FROM l c JOIN l b ON b.gene = c.gene AND b.condition = '{BASE}' WHERE c.condition <> '{BASE}')"


@query(_GAIN + " SELECT gene, condition, round(gain, 7) AS gain, round(var, 7) AS var FROM g")
def gain_logit(spark, sf_dir):
    """G19."""
    g = P.logit_gain(_hits(spark, sf_dir), "gene", "condition", BASE, "k", "t")
    return g.select("gene", "condition", F.round("gain", 7).alias("gain"), F.round("var", 7).alias("var"))


@query(_GAIN + " SELECT condition, round(sum(gain / var) / sum(1 / var), 7) AS mean, round(sqrt(1 / sum(1 / var)), 7) AS se FROM g GROUP BY 1")
def weighted_gain(spark, sf_dir):
    """G17."""
    g = P.logit_gain(_hits(spark, sf_dir), "gene", "condition", BASE, "k", "t")
    return P.weighted_mean(g, ["condition"], "gain", "var").select("condition", F.round("mean", 7).alias("mean"), F.round("se", 7).alias("se"))


@query(f"""WITH s AS (SELECT gene, condition, sample % 5 AS batch, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS k, count(*) AS t FROM ({D.RECORDS_SQL}) GROUP BY 1, 2, 3),
 g AS (SELECT gene, condition, count(*) AS n, avg(k / CAST(t AS DOUBLE)) AS p, var_samp(k / CAST(t AS DOUBLE)) AS v, avg(t) AS t FROM s GROUP BY 1, 2)
 SELECT round(greatest(1, sum(v) / sum(p * (1 - p) / t)), 7) AS phi FROM g WHERE n >= 3 AND p > 0 AND p < 1""")
def overdispersion(spark, sf_dir):
    """G18."""
    s = _hits(spark, sf_dir).groupBy("gene", "condition", (F.col("sample") % 5).alias("batch")).agg(F.sum("k").alias("k"), F.sum("t").alias("t"))
    return P.overdispersion(s, ["gene", "condition"], "k", "t").select(F.round("phi", 7).alias("phi"))


@query(_M + """, s AS (SELECT *, 's' || CAST(gene % 3 AS VARCHAR) AS stratum FROM d)
 SELECT condition, CASE WHEN grouping(stratum) = 1 THEN 'all' ELSE stratum END AS stratum, count(*) AS n, round(avg(delta / nullif(100 - base, 0)), 7) AS mean FROM s GROUP BY GROUPING SETS ((condition), (condition, stratum))""")
def headroom_grouping_sets(spark, sf_dir):
    """Share of the headroom gained, by stratum and overall."""
    d = _deltas(spark, sf_dir).withColumn("stratum", F.concat(F.lit("s"), (F.col("gene") % 3).cast("string"))).withColumn("h", F.try_divide("delta", 100 - F.col("base")))
    return P.with_all(d, ["condition"], "stratum", F.count("*").alias("n"), F.round(F.avg("h"), 7).alias("mean"))


@query(f"SELECT gene, gene % 7 AS block, round(avg(value), 7) AS value FROM ({D.RECORDS_SQL}) GROUP BY 1, 2")
def adaptive_collapse(spark, sf_dir):
    """Constant columns keep their value, others average."""
    r = D.records(spark, sf_dir).withColumn("block", F.col("gene") % 7)
    return P.adaptive_collapse(r, ["gene"], ["block", "value"]).withColumn("value", F.round("value", 7))


_LEVELS = ["click", "error", "purchase", "signup", "view"]


@query(f"SELECT gene % 10 AS layer, {', '.join(f'round(avg(CASE WHEN condition = {chr(39)}{c}{chr(39)} THEN value END), 7) AS {chr(34)}{c}{chr(34)}' for c in _LEVELS)} FROM ({D.RECORDS_SQL}) GROUP BY 1")
def pivot_layer_condition(spark, sf_dir):
    """G14."""
    r = D.records(spark, sf_dir).withColumn("layer", F.col("gene") % 10)
    return r.groupBy("layer").pivot("condition", _LEVELS).agg(F.round(F.avg("value"), 7))


@query(f"SELECT gene, {', '.join(f'max(CASE WHEN condition = {chr(39)}{c}{chr(39)} THEN 1 ELSE 0 END) AS {chr(34)}{c}{chr(34)}' for c in _LEVELS)} FROM ({D.RECORDS_SQL}) WHERE value > 90 GROUP BY 1")
def presence_matrix(spark, sf_dir):
    """Presence of conditions by gene."""
    return P.presence_matrix(D.records(spark, sf_dir).where("value > 90"), "gene", "condition", _LEVELS)


@query(f"""WITH p AS (SELECT DISTINCT gene, condition FROM ({D.RECORDS_SQL}) WHERE value > 90), r AS (SELECT condition, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, condition) AS k FROM p GROUP BY 1),
 g AS (SELECT p.gene, r.k, row_number() OVER (PARTITION BY p.gene ORDER BY r.k) AS i FROM p JOIN r USING (condition))
 SELECT k AS taxa, count(*) AS genes, k * count(*) AS score FROM g WHERE k = i GROUP BY k""")
def core_candidates(spark, sf_dir):
    """Genes that have all of the k best-covered conditions."""
    p = D.records(spark, sf_dir).where("value > 90").select("gene", "condition").distinct()
    r = p.groupBy("condition").agg(F.count("*").alias("n")).withColumn("k", F.row_number().over(Window.orderBy(F.desc("n"), "condition")))  # a row for each condition
    g = p.join(r, "condition").withColumn("i", F.row_number().over(Window.partitionBy("gene").orderBy("k")))
    return g.where("k = i").groupBy(F.col("k").cast("long").alias("taxa")).agg(F.count("*").alias("genes")).withColumn("score", F.col("taxa") * F.col("genes"))


@query(f"WITH n AS (SELECT condition, count(DISTINCT gene) AS n FROM ({D.RECORDS_SQL}) WHERE value > 80 GROUP BY 1) SELECT condition, n FROM n WHERE n >= 0.95 * (SELECT max(n) FROM n)")
def complete_conditions(spark, sf_dir):
    """C10, A18."""
    return P.complete_conditions(D.records(spark, sf_dir).where("value > 80"), "condition", "gene")


_SITES = f"WITH p AS (SELECT key, family, unnest(range(1, length(a) + 1)) AS i, a, b FROM ({D.PAIRS_SQL})), s AS (SELECT key, family, i % 3 AS phase, substr(a, i, 1) AS h, substr(b, i, 1) AS p, substr(translate(a, 'ACGT', 'CGTA'), i, 1) AS y FROM p)"


def _sites(spark, sf_dir):
    # letters as arrays: a lambda would take both sequences apart for each place
    letters = F.expr("zip_with(split(a, ''), split(b, ''), (h, p) -> struct(h, p))")
    x = dealt(D.pairs(spark, sf_dir).select("key", "a", "b"), "key").select("key", F.posexplode(letters).alias("i", "s")).select("key", "i", "s.h", "s.p").where("h <> ''")
    return x.select("key", F.expr("(i + 1) % 3").alias("phase"), "h", "p", F.expr("translate(h, 'ACGT', 'CGTA')").alias("y"))


@query(_SITES + """, n AS (SELECT key, h, phase, count(*) AS n FROM s GROUP BY 1, 2, 3), a AS (SELECT key, h, phase, p AS v, count(*) AS na FROM s GROUP BY 1, 2, 3, 4), b AS (SELECT key, h, phase, y AS v, count(*) AS nb FROM s GROUP BY 1, 2, 3, 4)
 SELECT a.key, round(sum(na * nb / CAST(n AS DOUBLE)), 7) AS expected FROM a JOIN b ON a.key = b.key AND a.h = b.h AND a.phase = b.phase AND a.v = b.v JOIN n ON n.key = a.key AND n.h = a.h AND n.phase = a.phase GROUP BY 1""")
def analytic_null(spark, sf_dir):
    """K9: expected agreement under shuffling within (base, codon position)."""
    return P.shuffle_null(_sites(spark, sf_dir), ["key"], ["h", "phase"], "p", "y").withColumn("expected", F.round("expected", 7))


@query(_SITES + " SELECT key, count(*) AS n_sites, count(*) FILTER (p <> h) AS n_ne_h, count(*) FILTER (p = y) AS n_eq_p, round(count(*) FILTER (p = y) / CAST(nullif(count(*) FILTER (p <> h), 0) AS DOUBLE), 7) AS a_cov, round(count(*) FILTER (p = y) / CAST(count(*) AS DOUBLE), 7) AS a_all FROM s GROUP BY 1")
def record_metrics(spark, sf_dir):
    """G26."""
    s = _sites(spark, sf_dir)
    n = lambda c: F.count_if(F.expr(c))
    g = s.groupBy("key").agg(F.count("*").alias("n_sites"), n("p <> h").alias("n_ne_h"), n("p = y").alias("n_eq_p"))
    return g.withColumn("a_cov", F.round(F.try_divide("n_eq_p", "n_ne_h"), 7)).withColumn("a_all", F.round(F.try_divide("n_eq_p", "n_sites"), 7))


_RANKED = lambda x, by: f"rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0"


@query(_M + f", x AS (SELECT condition, delta, {_RANKED('abs(delta)', 'condition')} AS r FROM d WHERE delta <> 0) SELECT condition, count(*) AS n, CAST(sum(CASE WHEN delta > 0 THEN r ELSE 0 END) AS DOUBLE) AS w_plus, CAST(sum(CASE WHEN delta < 0 THEN r ELSE 0 END) AS DOUBLE) AS w_minus FROM x GROUP BY 1")
def wilcoxon_statistic(spark, sf_dir):
    """K4: signed-rank sums."""
    return R.signed_ranks(_deltas(spark, sf_dir), ["condition"], "delta")


@query(_M + f", x AS (SELECT condition, gene % 2 = 0 AS g, {_RANKED('delta', 'condition')} AS r FROM d) SELECT condition, count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n2, CAST(sum(r) FILTER (g) - count(*) FILTER (g) * (count(*) FILTER (g) + 1) / 2.0 AS DOUBLE) AS u FROM x GROUP BY 1")
def mann_whitney_statistic(spark, sf_dir):
    """U of even genes against odd ones."""
    return R.mann_whitney(_deltas(spark, sf_dir).withColumn("even", F.col("gene") % 2 == 0), ["condition"], "even", True, "delta")


@query(_M + f""", x AS (SELECT condition, delta, rank() OVER (ORDER BY delta) + (count(*) OVER (PARTITION BY delta) - 1) / 2.0 AS r FROM d), s AS (SELECT condition, count(*) AS n, sum(r) AS r FROM x GROUP BY 1), t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*) AS c FROM x GROUP BY delta)),
 a AS (SELECT count(*) AS k, sum(n) AS n, sum(r * r / n) AS s FROM s) SELECT k, CAST(n AS BIGINT) AS n, round((12.0 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / CAST(n * n * n - n AS DOUBLE)), 6) AS h FROM a, t""")
def kruskal_statistic(spark, sf_dir):
    """K19."""
    return R.kruskal(_deltas(spark, sf_dir), "condition", "delta").withColumn("h", F.round("h", 6))


@query(_M + ", w AS (SELECT *, avg(base) OVER c AS mx, avg(delta) OVER c AS my FROM d WINDOW c AS (PARTITION BY condition)), z AS (SELECT *, sum((base - mx) * (delta - my)) OVER c / nullif(sum((base - mx) * (base - mx)) OVER c, 0) AS b FROM w WINDOW c AS (PARTITION BY condition)) SELECT gene, condition, round(delta - my - b * (base - mx), 6) AS resid FROM z")
def residual(spark, sf_dir):
    """K14."""
    return R.residuals(_deltas(spark, sf_dir), ["condition"], "base", "delta").select("gene", "condition", F.round("resid", 6).alias("resid"))


_PV = f"SELECT condition, gene, avg(value) / 500 AS p FROM ({D.RECORDS_SQL}) GROUP BY 1, 2"


@query(f"WITH p AS ({_PV}), s AS (SELECT *, (count(*) OVER (PARTITION BY condition) - row_number() OVER (PARTITION BY condition ORDER BY p, gene) + 1) * p AS s FROM p) SELECT condition, gene, round(least(1, max(s) OVER (PARTITION BY condition ORDER BY p, gene ROWS UNBOUNDED PRECEDING)), 7) AS p_holm FROM s")
def holm(spark, sf_dir):
    """K20, H14."""
    p = D.records(spark, sf_dir).groupBy("condition", "gene").agg((F.avg("value") / 500).alias("p"))
    return R.holm(p, ["condition"], "p", "gene").select("condition", "gene", F.round("p_holm", 7).alias("p_holm"))


@query(f"WITH p AS ({_PV}), n AS (SELECT condition, 0.05 / count(*) AS threshold FROM p GROUP BY 1) SELECT condition, count(*) FILTER (p < threshold) AS n_significant, round(max(threshold), 9) AS threshold FROM p JOIN n USING (condition) GROUP BY 1")
def bonferroni(spark, sf_dir):
    """K20, R13."""
    p = D.records(spark, sf_dir).groupBy("condition", "gene").agg((F.avg("value") / 500).alias("p"))
    n = p.groupBy("condition").agg((0.05 / F.count("*")).alias("threshold"))
    return p.join(n, "condition").groupBy("condition").agg(F.count_if(F.col("p") < F.col("threshold")).alias("n_significant"), F.round(F.max("threshold"), 9).alias("threshold"))
