"""Queries over aligned sites, doses, bands and cross tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.operators import sites as S
from strandline.operators.lineage import dealt
from strandline.plans import derived as D
from strandline.plans.paired_queries import _M, _deltas

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Every key is a target; its voters are the other keys of its group of ten.
_V = f"""WITH q AS ({D.PAIRS_SQL}), g AS (SELECT key, key // 10 AS grp, a, b FROM q),
 x AS (SELECT grp, b, unnest(range(0, length(b))) AS i FROM g), v AS (SELECT grp, CAST(i AS INT) AS i, substr(b, i + 1, 1) AS base, count(*) AS n FROM x WHERE substr(b, i + 1, 1) IN ('A', 'C', 'G', 'T') GROUP BY 1, 2, 3),
 s AS (SELECT key, CAST(i AS INT) AS i, substr(a, i + 1, 1) AS h, substr(b, i + 1, 1) AS p FROM (SELECT key, a, b, unnest(range(0, least(length(a), length(b)))) AS i FROM q) WHERE substr(a, i + 1, 1) <> substr(b, i + 1, 1))"""


def _grouped(spark, sf_dir):
    return D.pairs(spark, sf_dir).withColumn("grp", F.expr("key DIV 10"))


@query(_V + " SELECT grp, i, CASE WHEN count(*) = 1 THEN min(base) ELSE '-' END AS base FROM v JOIN (SELECT grp, i, max(n) AS n FROM v GROUP BY 1, 2) USING (grp, i, n) GROUP BY 1, 2")
def consensus(spark, sf_dir):
    """The unique mode of a group's votes, '-' on ties."""
    return S.consensus(S.votes(dealt(_grouped(spark, sf_dir).select("grp", "b"), "grp"), "grp", "b"), "grp")


@query(_V + ", o AS (SELECT DISTINCT x.key, y.key AS voter, y.b FROM g x JOIN g y ON x.grp = y.grp AND x.key <> y.key) SELECT key, i, h, p FROM s WHERE key IN (SELECT key FROM o) AND NOT EXISTS (SELECT 1 FROM o WHERE o.key = s.key AND substr(o.b, s.i + 1, 1) = s.p)")
def private_sites(spark, sf_dir):
    """Sites whose base no other key of the group shows."""
    g = dealt(_grouped(spark, sf_dir).select("key", "grp", "a", "b"), "grp")
    voted = g.groupBy("grp").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("grp")
    sites = S.differing(g.join(voted.hint("merge"), "grp", "left_semi"), "key", "a", "b", "grp")
    return S.with_others(sites, S.shown(g, "b", "key", "grp"), "key", "grp").where("NOT shared").select("key", "i", "h", "p")


@query(_V + " SELECT key, i, h, p FROM s")
def diagnostic_sites(spark, sf_dir):
    """E22-E24 without gaps."""
    return S.differing(D.pairs(spark, sf_dir), "key", "a", "b")


@query(_M + " SELECT gene % 8 AS layer, count(*) AS n, round(avg(delta), 7) AS mean, round(avg(delta) - stddev_samp(delta), 7) AS low, round(avg(delta) + stddev_samp(delta), 7) AS high FROM d GROUP BY 1")
def band_by_layer(spark, sf_dir):
    """G31."""
    d = _deltas(spark, sf_dir).groupBy((F.col("gene") % 8).alias("layer"))
    m, s = F.avg("delta"), F.stddev_samp("delta")
    return d.agg(F.count("*").alias("n"), F.round(m, 7).alias("mean"), F.round(m - s, 7).alias("low"), F.round(m + s, 7).alias("high"))


_DOSE = ["click", "error", "purchase", "signup"]


@query(_M + ", x AS (SELECT gene % 3 AS stratum, CASE condition WHEN 'click' THEN 0.5 WHEN 'error' THEN 1.0 WHEN 'purchase' THEN 2.0 ELSE 4.0 END::DOUBLE AS dose, delta FROM d), w AS (SELECT stratum, dose, avg(delta) AS mean, count(*) AS n FROM x GROUP BY 1, 2) SELECT stratum, arg_max(dose, mean) AS peak_dose, round(max(mean), 7) AS peak, CAST(sum(n) AS BIGINT) AS n FROM w GROUP BY 1")
def dose_response(spark, sf_dir):
    """The dose of the greatest mean delta in each stratum."""
    dose = F.element_at(F.create_map(*[F.lit(x) for p in zip(_DOSE, (0.5, 1.0, 2.0, 4.0)) for x in p]), F.col("condition"))
    x = _deltas(spark, sf_dir).select((F.col("gene") % 3).alias("stratum"), dose.alias("dose"), "delta")
    m = x.groupBy("stratum", "dose").agg(F.avg("delta").alias("mean"), F.count("*").alias("n"))
    return m.groupBy("stratum").agg(F.max_by("dose", "mean").alias("peak_dose"), F.round(F.max("mean"), 7).alias("peak"), F.sum("n").alias("n"))


@query("SELECT c_mktsegment AS stratum, " + ", ".join(f"count(*) FILTER (o_orderstatus = '{s}') AS {s.lower()}" for s in "FOP") + " FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def crosstab(spark, sf_dir):
    """Missing cells are 0."""
    o = D.table(spark, sf_dir, "orders").select("o_custkey", F.lower("o_orderstatus").alias("s"))
    c = D.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("stratum"))
    return o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy("stratum").pivot("s", ["f", "o", "p"]).count().na.fill(0)


@query("WITH b AS (SELECT event_id % 6 AS layer, event_type AS baseline, avg(value) AS rho FROM events WHERE event_id % 17 <> 0 AND NOT (event_id % 6 = 2 AND event_type = 'click') GROUP BY 1, 2) SELECT layer, round(avg(rho), 7) AS mean FROM b GROUP BY 1 HAVING count(DISTINCT baseline) = 5")
def axis_mean(spark, sf_dir):
    """A mean only where every baseline is there."""
    e = D.table(spark, sf_dir, "events").where("event_id % 17 <> 0 AND NOT (event_id % 6 = 2 AND event_type = 'click')")
    b = e.groupBy((F.col("event_id") % 6).alias("layer"), "event_type").agg(F.avg("value").alias("rho"))
    g = b.groupBy("layer").agg(F.round(F.avg("rho"), 7).alias("mean"), F.count_distinct("event_type").alias("k"))
    return g.where("k = 5").drop("k")


@query("SELECT event_id, round(asinh((value - 50) / 10), 9) AS shown, round(sinh(asinh((value - 50) / 10)) * 10 + 50, 6) AS back FROM events")
def symlog(spark, sf_dir):
    """The display transform and its inverse."""
    u = F.asinh((F.col("value") - 50) / 10)
    return D.table(spark, sf_dir, "events").select("event_id", F.round(u, 9).alias("shown"), F.round(F.sinh(u) * 10 + 50, 6).alias("back"))


@query("WITH t AS (SELECT s_nationkey AS a, s_suppkey % 5 AS b, s_acctbal AS d FROM supplier) SELECT a, b, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS sd FROM t GROUP BY 1, 2")
def posterior_mean(spark, sf_dir):
    """L1: distances averaged over trees."""
    t = D.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("a"), (F.col("s_suppkey") % 5).alias("b"), F.col("s_acctbal").alias("d"))
    return S.mean_distances(t).select("a", "b", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query("WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) SELECT user_id, event_id FROM e WHERE (r - 1) % 7 = 0")
def stride_thinned(spark, sf_dir):
    """H11."""
    r = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return D.table(spark, sf_dir, "events").select("user_id", "event_id", r.alias("r")).where("r % 7 = 0").drop("r")


@query(_M + ", x AS (SELECT condition, gene % 3 AS stratum, base, delta FROM d) SELECT condition, stratum, count(*) AS n, round(avg(delta), 7) AS mean, round(stddev_samp(delta) / sqrt(count(*)), 7) AS sem, round(regr_slope(delta, base), 6) AS slope, round(regr_intercept(delta, base), 5) AS intercept FROM x GROUP BY 1, 2")
def gain_by_baseline(spark, sf_dir):
    """Mean and standard error, and the line of delta on baseline."""
    x = _deltas(spark, sf_dir).withColumn("stratum", F.col("gene") % 3)
    return x.groupBy("condition", "stratum").agg(F.count("*").alias("n"), F.round(F.avg("delta"), 7).alias("mean"), F.round(F.stddev_samp("delta") / F.sqrt(F.count("*")), 7).alias("sem"), F.round(F.regr_slope("delta", "base"), 6).alias("slope"), F.round(F.regr_intercept("delta", "base"), 5).alias("intercept"))
