"""Queries of filters, joins, aggregates, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.operators import paired as P, panel, ranks as R, tables as T
from strandline.operators.ordering import grouped_quantiles
from strandline.plans import derived as D
from strandline.plans.paired_queries import _M, _RANKED, BASE, _deltas

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _events(spark, sf_dir):
    return D.table(spark, sf_dir, "events")


def _r(*names: str, digits: int = 6):
    return [F.round(n, digits).alias(n) for n in names]


# -- C: filters and projections ----------------------------------------------------------


@query("WITH n AS (SELECT event_type, count(DISTINCT user_id) AS n FROM events WHERE value > 80 GROUP BY 1), c AS (SELECT event_type FROM n WHERE n >= 0.9 * (SELECT max(n) FROM n)), e AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 80 AND event_type IN (SELECT event_type FROM c)) SELECT user_id FROM e GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM c)")
def shared_genes(spark, sf_dir):
    """Genes that every complete condition has."""
    e = _events(spark, sf_dir).where("value > 80")
    c = P.complete_conditions(e, "event_type", "user_id", 0.9).select("event_type")
    return T.in_every(e.join(c, "event_type", "left_semi"), "user_id", "event_type")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def allowed_conditions(spark, sf_dir):
    """C11: an allow and a deny list; other values are an error."""
    e = T.allowed(_events(spark, sf_dir), "event_type", ["click", "view"], ["error", "purchase", "signup"])
    return e.groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority IN (SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'P')")
def stale_conditions(spark, sf_dir):
    """Rows of conditions that a newer table still has."""
    o = D.table(spark, sf_dir, "orders")
    return o.join(o.where("o_orderstatus = 'P'").select("o_orderpriority"), "o_orderpriority", "left_semi").select("o_orderkey", "o_custkey")


_ARM = "CASE event_id % 4 WHEN 0 THEN 'add_a' || (event_id % 7) WHEN 1 THEN 'add_a0.' || (event_id % 9) WHEN 2 THEN 'add_ax' ELSE 'sub_a1' END"


@query(f"SELECT event_id, CAST(regexp_extract({_ARM}, '^add_a([0-9]+([.][0-9]+)?)$', 1) AS DOUBLE) AS dose FROM events WHERE regexp_full_match({_ARM}, 'add_a[0-9]+([.][0-9]+)?')")
def dose_match(spark, sf_dir):
    """Doses by the exact pattern of the condition's name."""
    e = _events(spark, sf_dir).select("event_id", F.expr(_ARM).alias("arm"))
    return e.where(F.col("arm").rlike(r"^add_a(\d+(\.\d+)?)$")).select("event_id", F.regexp_extract("arm", r"^add_a(\d+(\.\d+)?)$", 1).cast("double").alias("dose"))


@query(f"WITH v AS (SELECT user_id, event_type, count(*) AS voters, avg(value) AS m FROM events GROUP BY 1, 2) SELECT user_id, event_type, voters, CASE WHEN voters >= 3 THEN round(m, 6) END AS metric FROM v")
def voter_blanking(spark, sf_dir):
    """C14: a metric of too few voters is null, not low."""
    v = _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("voters"), F.avg("value").alias("m"))
    return v.select("user_id", "event_type", "voters", F.when(F.col("voters") >= 3, F.round("m", 6)).alias("metric"))


@query("SELECT o_orderkey, o_totalprice AS price FROM orders")
def column_by_prefix(spark, sf_dir):
    """The first of several column names that a table has."""
    o = D.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.col(T.first_column(o, ["rho_", "o_"], "totalprice")).alias("price"))


@query("WITH x AS (SELECT event_type || CASE WHEN event_id % 3 = 0 THEN '_post' ELSE '' END AS condition, event_id % 4 AS layer FROM events), y AS (SELECT regexp_replace(condition, '_post$', '') AS arm, condition LIKE '%_post' AS post, layer FROM x) SELECT layer, arm, post, count(*) AS n, count(*) < 400 AS thin FROM y GROUP BY 1, 2, 3")
def arms_present(spark, sf_dir):
    """Arms and suffixes by layer, thin ones flagged."""
    x = _events(spark, sf_dir).select(F.concat("event_type", F.when(F.col("event_id") % 3 == 0, "_post").otherwise("")).alias("condition"), (F.col("event_id") % 4).alias("layer"))
    y = x.select("layer", F.regexp_replace("condition", "_post$", "").alias("arm"), F.col("condition").endswith("_post").alias("post"))
    return y.groupBy("layer", "arm", "post").agg(F.count("*").alias("n")).withColumn("thin", F.col("n") < 400)


@query("SELECT * FROM (VALUES ('l_tax', CAST(0 AS INT)), ('l_discount', CAST(1 AS INT))) t(metric, place)")
def metrics_listed(spark, sf_dir):
    """C17: metrics that exist, hold values and are not excluded, in their order."""
    li = D.table(spark, sf_dir, "lineitem").withColumn("empty", F.lit(None).cast("double"))
    found = T.metrics_present(li, ["l_tax", "missing", "empty", "l_quantity", "l_discount"], ["l_quantity"])
    return spark.createDataFrame(list(zip(found, range(len(found)))), "metric string, place int")


@query("SELECT o_orderkey, round(log10(o_totalprice), 6) AS log_price, round((o_totalprice - 100) / nullif(500000 - o_totalprice, 0), 6) AS headroom, round(100 * o_totalprice / 500000, 6) AS pct, round(least(300000, greatest(1000, o_totalprice)), 6) AS clipped FROM orders")
def projections(spark, sf_dir):
    """C18."""
    p = F.col("o_totalprice")
    return D.table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.log10(p), 6).alias("log_price"), F.round(F.try_divide(p - 100, F.lit(500000) - p), 6).alias("headroom"), F.round(100 * p / 500000, 6).alias("pct"), F.round(F.least(F.lit(300000.0), F.greatest(F.lit(1000.0), p)), 6).alias("clipped"))


# -- D: joins ----------------------------------------------------------------------------


@query("SELECT c_custkey, c_mktsegment, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000")
def left_covariates(spark, sf_dir):
    """Covariates joined where there are any."""
    o = D.table(spark, sf_dir, "orders").where("o_totalprice > 300000").select("o_custkey", "o_orderkey", "o_totalprice")
    c = D.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").drop("o_custkey")


@query("WITH a AS (SELECT user_id, avg(value) FILTER (event_type = 'click') AS click, avg(value) FILTER (event_type = 'view') AS viewed FROM events WHERE value > 60 AND event_type IN ('click', 'view') GROUP BY 1), b AS (SELECT user_id, max(value) FILTER (event_type = 'error') AS error, max(value) FILTER (event_type = 'signup') AS signup FROM events WHERE value < 20 AND event_type IN ('error', 'signup') GROUP BY 1) SELECT coalesce(a.user_id, b.user_id) AS user_id, round(click, 6) AS click, round(viewed, 6) AS viewed, round(error, 6) AS error, round(signup, 6) AS signup FROM a FULL JOIN b ON a.user_id = b.user_id")
def full_join_pivots(spark, sf_dir):
    """D3."""
    e = _events(spark, sf_dir)
    a = e.where("value > 60 AND event_type IN ('click', 'view')").groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.round(F.avg("value"), 6)).withColumnRenamed("view", "viewed")
    b = e.where("value < 20 AND event_type IN ('error', 'signup')").groupBy("user_id").pivot("event_type", ["error", "signup"]).agg(F.round(F.max("value"), 6))
    return a.join(b, "user_id", "full")


@query("SELECT l_orderkey, l_linenumber, l_partkey, p_brand, s_nationkey FROM lineitem JOIN (SELECT l_partkey AS k, l_suppkey AS s, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) ON k = l_partkey AND s = l_suppkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey")
def composite_key_join(spark, sf_dir):
    """D5."""
    li = D.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    n = li.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    p = D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    s = D.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return li.join(n, ["l_partkey", "l_suppkey"]).join(p, "l_partkey").join(s, "l_suppkey").select("l_orderkey", "l_linenumber", "l_partkey", "p_brand", "s_nationkey")


@query("WITH a AS (SELECT event_id % 6 AS layer, event_type AS condition, avg(value) AS x FROM events WHERE event_id % 5 <> 0 GROUP BY 1, 2 HAVING avg(value) > 49), b AS (SELECT event_id % 6 AS layer, event_type AS condition, avg(value) AS y FROM events WHERE event_id % 5 = 0 GROUP BY 1, 2 HAVING avg(value) < 51) SELECT coalesce(a.layer, b.layer) AS layer, coalesce(a.condition, b.condition) AS condition, round(x, 6) AS x, round(y, 6) AS y FROM a FULL JOIN b ON a.layer = b.layer AND a.condition = b.condition")
def aligned_series(spark, sf_dir):
    """Two indexed series side by side."""
    e = _events(spark, sf_dir).withColumn("layer", F.col("event_id") % 6).withColumnRenamed("event_type", "condition")
    a = e.where("event_id % 5 <> 0").groupBy("layer", "condition").agg(F.avg("value").alias("x")).where("x > 49")
    b = e.where("event_id % 5 = 0").groupBy("layer", "condition").agg(F.avg("value").alias("y")).where("y < 51")
    return a.join(b, ["layer", "condition"], "full").select("layer", "condition", *_r("x", "y"))


@query("WITH r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 11 <> 0 THEN c_nationkey END AS found FROM customer WHERE c_custkey % 3 <> 0) SELECT o_orderkey, CASE WHEN r.k IS NULL THEN 'no_match' WHEN found IS NULL THEN 'missing_record' WHEN o_orderkey % 25 <> found THEN 'id_mismatch' END AS reason FROM orders LEFT JOIN r ON r.k = o_custkey")
def lookup_reasons(spark, sf_dir):
    """A lookup that says why it failed."""
    records = D.table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 11 != 0, F.col("c_nationkey")).alias("found"))
    o = D.table(spark, sf_dir, "orders").withColumn("expected", F.col("o_orderkey") % 25)
    return T.lookup(o, "o_custkey", records, "k", "expected", "found").select("o_orderkey", "reason")


@query("SELECT gene, species, match FROM (SELECT l_partkey AS gene, l_suppkey % 5 AS species, l_orderkey AS match, row_number() OVER (PARTITION BY l_partkey, l_suppkey % 5 ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem WHERE l_discount < 0.05) WHERE r = 1")
def first_match(spark, sf_dir):
    """The first match of each gene and species."""
    li = D.table(spark, sf_dir, "lineitem").where("l_discount < 0.05").select(F.col("l_partkey").alias("gene"), (F.col("l_suppkey") % 5).alias("species"), F.col("l_orderkey").alias("match"), "l_linenumber")
    return panel.pick(li, ["gene", "species"], F.col("match"), F.col("l_linenumber")).select("gene", "species", "match")


@query("WITH a AS (SELECT row_number() OVER (ORDER BY n_name) AS place, n_name AS key FROM nation), b AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS place, n_name AS key FROM nation) SELECT CAST(place AS INT) AS place, a.key AS a, b.key AS b FROM a FULL JOIN b USING (place) WHERE a.key IS DISTINCT FROM b.key")
def order_mismatches(spark, sf_dir):
    """Places where two listings of one panel differ."""
    n = D.table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("key"))
    ranked = lambda by: n.withColumn("place", F.row_number().over(Window.orderBy(by)))  # noqa: E731  (a panel's listing)
    return T.same_order(ranked("key"), ranked("n_nationkey"), "place", "key")


# -- G: aggregates -----------------------------------------------------------------------


@query("WITH e AS (SELECT user_id AS gene, event_type AS condition, avg(value) AS m1, avg(ln(1 + value)) AS m2, avg(value * value) AS m3 FROM events GROUP BY 1, 2), u AS (UNPIVOT e ON m1, m2, m3 INTO NAME metric VALUE x), d AS (SELECT c.gene, c.condition, c.metric, c.x - b.x AS delta FROM u c JOIN u b ON b.gene = c.gene AND b.metric = c.metric AND b.condition = 'view' WHERE c.condition <> 'view') SELECT condition, metric, count(*) AS n, round(avg(delta), 6) AS mean, round(quantile_cont(delta, 0.5), 6) AS median FROM d GROUP BY 1, 2")
def paired_by_metric(spark, sf_dir):
    """Paired summaries of several metrics, unpivoted."""
    v = F.col("value")
    e = _events(spark, sf_dir).groupBy(F.col("user_id").alias("gene"), F.col("event_type").alias("condition")).agg(F.avg(v).alias("m1"), F.avg(F.log(1 + v)).alias("m2"), F.avg(v * v).alias("m3"))
    u = e.unpivot(["gene", "condition"], ["m1", "m2", "m3"], "metric", "x")
    base = u.where(F.col("condition") == BASE).select("gene", "metric", F.col("x").alias("x0"))
    d = u.where(F.col("condition") != BASE).join(base, ["gene", "metric"]).withColumn("delta", F.col("x") - F.col("x0"))
    return d.groupBy("condition", "metric").agg(F.count("*").alias("n"), F.round(F.avg("delta"), 6).alias("mean"), F.round(F.median("delta"), 6).alias("median"))


@query(_M + f", s AS (SELECT *, gene % 3 AS stratum FROM d), g AS (SELECT condition, {_RANKED('base', 'condition')} AS rx, {_RANKED('delta', 'condition')} AS ry FROM d), rho AS (SELECT condition, round(corr(rx, ry), 6) AS gradient FROM g GROUP BY 1) SELECT condition, stratum, count(*) AS n, round(avg(delta), 6) AS mean, round(stddev_samp(delta), 6) AS sd, gradient FROM s JOIN rho USING (condition) GROUP BY 1, 2, gradient")
def stage_summary(spark, sf_dir):
    """Paired deltas by stratum with the gradient over the baseline."""
    d = _deltas(spark, sf_dir)
    rho = R.spearman(d, ["condition"], "base", "delta").select("condition", F.round("rho", 6).alias("gradient"))
    s = d.groupBy("condition", (F.col("gene") % 3).alias("stratum")).agg(F.count("*").alias("n"), F.round(F.avg("delta"), 6).alias("mean"), F.round(F.stddev_samp("delta"), 6).alias("sd"))
    return s.join(rho, "condition")


@query(f"WITH e AS (SELECT user_id % 12 AS family, user_id % 60 AS grp, value AS x, event_id % 1000 AS y FROM events), r AS (SELECT family, grp, {_RANKED('x', 'grp')} AS rx, {_RANKED('y', 'grp')} AS ry FROM e), g AS (SELECT family, grp, corr(rx, ry) AS rho FROM r GROUP BY 1, 2 HAVING count(*) >= 6) SELECT family, count(*) AS n_groups, round(avg(rho), 6) AS mean_rho FROM g GROUP BY 1")
def family_mean_rho(spark, sf_dir):
    """Mean over a family's groups of their rank correlations."""
    e = _events(spark, sf_dir).select((F.col("user_id") % 12).alias("family"), (F.col("user_id") % 60).alias("grp"), F.col("value").alias("x"), (F.col("event_id") % 1000).alias("y"))
    g = R.spearman(e, ["family", "grp"], "x", "y").where("rho IS NOT NULL")
    return g.groupBy("family").agg(F.count("*").alias("n_groups"), F.round(F.avg("rho"), 6).alias("mean_rho"))


@query("WITH c AS (SELECT event_id % 5 AS layer, event_type AS control, avg(value) / 100 AS rho FROM events GROUP BY 1, 2), a AS (SELECT layer, control, rho FROM c UNION ALL SELECT DISTINCT layer, 'natural', 1.0 FROM c) SELECT layer, control, round(rho, 6) AS rho, round(1 - rho, 6) AS loss FROM a")
def control_layers(spark, sf_dir):
    """Controls by layer with the natural sequence's own row made up."""
    c = _events(spark, sf_dir).groupBy((F.col("event_id") % 5).alias("layer"), F.col("event_type").alias("control")).agg((F.avg("value") / 100).alias("rho"))
    natural = c.select("layer").distinct().select("layer", F.lit("natural").alias("control"), F.lit(1.0).alias("rho"))
    return c.unionByName(natural).select("layer", "control", F.round("rho", 6).alias("rho"), F.round(1 - F.col("rho"), 6).alias("loss"))


_RUNG = f"""WITH p AS (SELECT key, family, a, b, key % 4 AS rung FROM ({D.PAIRS_SQL})),
 i AS (SELECT rung, family, key, 1 - len(list_filter(range(1, length(a) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))) / CAST(length(a) AS DOUBLE) AS ident, (length(a) - length(replace(a, 'A', ''))) * (length(b) - length(replace(b, 'A', ''))) / CAST(length(a) * length(b) AS DOUBLE) + (length(a) - length(replace(a, 'C', ''))) * (length(b) - length(replace(b, 'C', ''))) / CAST(length(a) * length(b) AS DOUBLE) + (length(a) - length(replace(a, 'G', ''))) * (length(b) - length(replace(b, 'G', ''))) / CAST(length(a) * length(b) AS DOUBLE) + (length(a) - length(replace(a, 'T', ''))) * (length(b) - length(replace(b, 'T', ''))) / CAST(length(a) * length(b) AS DOUBLE) AS chance FROM p)"""


def _rungs(spark, sf_dir):
    from strandline.functions import sequences as S

    p = D.pairs(spark, sf_dir).withColumn("rung", F.col("key") % 4)
    return p.select("rung", "family", "key", F.expr(S.positional_identity("a", "b")).alias("ident"), F.expr(S.chance_identity("a", "b")).alias("chance"))


@query(_RUNG + " SELECT rung, count(*) AS n, round(avg(ident), 6) AS mean, round(stddev_samp(ident), 6) AS sd, round(avg(ident - chance), 6) AS excess, round(stddev_samp(ident - chance) / sqrt(count(*)), 6) AS paired_se FROM i GROUP BY 1")
def rung_identity(spark, sf_dir):
    """Identity by rung, its excess over chance and the paired error."""
    d = F.col("ident") - F.col("chance")
    return _rungs(spark, sf_dir).groupBy("rung").agg(F.count("*").alias("n"), F.round(F.avg("ident"), 6).alias("mean"), F.round(F.stddev_samp("ident"), 6).alias("sd"), F.round(F.avg(d), 6).alias("excess"), F.round(F.stddev_samp(d) / F.sqrt(F.count("*")), 6).alias("paired_se"))


@query(_RUNG + " SELECT rung, family, count(*) AS n, round(avg(ident), 6) AS mean FROM i GROUP BY 1, 2")
def rung_family_identity(spark, sf_dir):
    """G13."""
    return _rungs(spark, sf_dir).groupBy("rung", "family").agg(F.count("*").alias("n"), F.round(F.avg("ident"), 6).alias("mean"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1")
def argmax_row(spark, sf_dir):
    """The row of the greatest value of each group, ties by id."""
    e = _events(spark, sf_dir).select("user_id", "event_type", "event_id", "value")
    top = F.max_by(F.struct("event_id", "value"), F.struct("value", -F.col("event_id")))
    return e.groupBy("user_id", "event_type").agg(top.alias("t")).select("user_id", "event_type", "t.event_id", "t.value")


@query(f"WITH m AS (SELECT user_id AS gene, event_type AS condition, avg(value / 100) AS p, count(*) / 2.16 AS t FROM events GROUP BY 1, 2), l AS (SELECT *, ln(least(0.99, greatest(0.01, p)) / (1 - least(0.99, greatest(0.01, p)))) AS l FROM m) SELECT c.gene, c.condition, round(c.l - b.l, 6) AS gain, round(c.t, 6) AS trials FROM l c JOIN l b ON b.gene = c.gene AND b.condition = 'view' WHERE c.condition <> 'view'")
def clipped_gain(spark, sf_dir):
    """Gains of clipped log odds, with trials thinned for dependence."""
    m = _events(spark, sf_dir).groupBy(F.col("user_id").alias("gene"), F.col("event_type").alias("condition")).agg(F.avg(F.col("value") / 100).alias("p"), (F.count("*") / 2.16).alias("t"))
    q = F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("p")))
    x = m.withColumn("l", F.log(q / (1 - q)))
    base = x.where(F.col("condition") == BASE).select("gene", F.col("l").alias("l0"))
    return x.where(F.col("condition") != BASE).join(base, "gene").select("gene", "condition", F.round(F.col("l") - F.col("l0"), 6).alias("gain"), F.round("t", 6).alias("trials"))


@query("SELECT user_id AS gene, count(*) AS n_sites, count(*) FILTER (event_type = 'view') AS n_base, round(avg(value) FILTER (event_type = 'view'), 6) AS baseline, count(DISTINCT event_type) AS n_voters, round(count(*) FILTER (value > 75) / CAST(count(*) AS DOUBLE), 6) AS strict FROM events GROUP BY 1")
def readout_by_gene(spark, sf_dir):
    """G21."""
    base = F.col("event_type") == BASE
    return _events(spark, sf_dir).groupBy(F.col("user_id").alias("gene")).agg(F.count("*").alias("n_sites"), F.count_if(base).alias("n_base"), F.round(F.avg(F.when(base, F.col("value"))), 6).alias("baseline"), F.count_distinct("event_type").alias("n_voters"), F.round(F.count_if(F.col("value") > 75) / F.count("*"), 6).alias("strict"))


@query(_M + ", x AS (SELECT gene % 4 AS stratum, condition, base, delta FROM d) SELECT stratum, condition, round(quantile_cont(base, 0.5), 6) AS median, round(avg(base), 6) AS mean, round(quantile_cont(base, 0.9), 6) AS p90, round(max(base), 6) AS most, round(avg(delta), 6) AS mean_delta, round(quantile_cont(delta, 0.5), 6) AS median_delta FROM x GROUP BY 1, 2")
def baseline_levels(spark, sf_dir):
    """Baseline levels by stratum and what conditions add."""
    x = _deltas(spark, sf_dir).withColumn("stratum", F.col("gene") % 4)
    by = ["stratum", "condition"]
    means = x.groupBy(*by).agg(F.round(F.avg("base"), 6).alias("mean"), F.round(F.max("base"), 6).alias("most"), F.round(F.avg("delta"), 6).alias("mean_delta"))
    base = grouped_quantiles(x, by, "base", [0.5, 0.9]).groupBy(*by).pivot("share", [0.5, 0.9]).agg(F.round(F.first("value"), 6)).withColumnsRenamed({"0.5": "median", "0.9": "p90"})
    delta = grouped_quantiles(x, by, "delta", [0.5]).select(*by, F.round("value", 6).alias("median_delta"))
    return means.join(base, by).join(delta, by).select(*by, "median", "mean", "p90", "most", "mean_delta", "median_delta")


@query(_M + " SELECT condition, round(avg(level), 6) AS mean, round(quantile_cont(level, 0.25), 6) AS q25, round(quantile_cont(level, 0.5), 6) AS median, round(quantile_cont(level, 0.75), 6) AS q75, round(stddev_samp(level), 6) AS sd, round(avg(delta), 6) AS delta, round(100 * avg(CASE WHEN delta > 0 THEN 1.0 ELSE 0.0 END), 6) AS pct_above FROM d GROUP BY 1")
def composition_numbers(spark, sf_dir):
    """G23."""
    d = _deltas(spark, sf_dir)
    x = P.describe(d, ["condition"], "level").join(d.groupBy("condition").agg(F.avg("delta").alias("delta"), (100 * F.avg((F.col("delta") > 0).cast("double"))).alias("pct_above")), "condition")
    return x.select("condition", *_r("mean", "q25", "median", "q75", "sd", "delta", "pct_above"))


@query(f"WITH s AS (SELECT family, species, key, length(cds) AS len, (length(cds) - length(translate(cds, 'GC', ''))) / CAST(length(cds) AS DOUBLE) AS gc FROM ({D.LOCI_SQL})), g AS (SELECT family, species, avg(gc) AS gc, avg(len) AS len FROM s GROUP BY 1, 2) SELECT family, count(*) AS n_genes, round(avg(gc), 6) AS gc, round(avg(len), 6) AS len FROM g GROUP BY 1")
def composition_table(spark, sf_dir):
    """Means of gene means."""
    from strandline.functions import sequences as S

    g = D.loci(spark, sf_dir).groupBy("family", "species").agg(F.avg(F.expr(S.gc_length("cds"))).alias("gc"), F.avg(F.length("cds")).alias("len"))
    return g.groupBy("family").agg(F.count("*").alias("n_genes"), F.round(F.avg("gc"), 6).alias("gc"), F.round(F.avg("len"), 6).alias("len"))


@query("SELECT p_size % 8 AS stratum, round(min(p_retailprice), 6) AS least, round(median(p_retailprice), 6) AS median, round(max(p_retailprice), 6) AS most FROM part GROUP BY 1")
def stratum_range(spark, sf_dir):
    """G28."""
    x = F.col("p_retailprice")
    return D.table(spark, sf_dir, "part").groupBy((F.col("p_size") % 8).alias("stratum")).agg(F.round(F.min(x), 6).alias("least"), F.round(F.median(x), 6).alias("median"), F.round(F.max(x), 6).alias("most"))


@query("WITH b AS (SELECT s_nationkey AS gene, s_suppkey % 6 AS tip, abs(s_acctbal) / 1e4 AS dn, 1 + abs(s_acctbal) / 2e4 AS ds FROM supplier) SELECT gene, round(sum(dn) FILTER (tip = 0), 6) AS focal_dn, round(sum(ds) FILTER (tip = 0), 6) AS focal_ds, round(sum(dn) FILTER (tip <> 0), 6) AS rest_dn, round(sum(ds) FILTER (tip <> 0), 6) AS rest_ds, round((sum(dn) FILTER (tip <> 0)) / nullif(sum(ds) FILTER (tip <> 0), 0), 6) AS rest_omega FROM b GROUP BY 1")
def branch_summary(spark, sf_dir):
    """Focal tips against the sums of the rest."""
    b = D.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("gene"), (F.col("s_suppkey") % 6).alias("tip"), (F.abs("s_acctbal") / 1e4).alias("dn"), (1 + F.abs("s_acctbal") / 2e4).alias("ds"))
    s = lambda c, focal: F.sum(F.when((F.col("tip") == 0) == F.lit(focal), F.col(c)))
    g = b.groupBy("gene").agg(s("dn", True).alias("focal_dn"), s("ds", True).alias("focal_ds"), s("dn", False).alias("rest_dn"), s("ds", False).alias("rest_ds"))
    return g.withColumn("rest_omega", F.try_divide("rest_dn", "rest_ds")).select("gene", *_r("focal_dn", "focal_ds", "rest_dn", "rest_ds", "rest_omega"))


@query("WITH p AS (SELECT l_partkey AS gene, l_linenumber = 1 AS focal, l_quantity / 4 AS omega FROM lineitem) SELECT gene, round(avg(omega) FILTER (focal), 6) AS focal, round(avg(omega) FILTER (NOT focal AND omega >= 0 AND omega < 10), 6) AS mean, round(median(omega) FILTER (NOT focal AND omega >= 0 AND omega < 10), 6) AS median, count(*) FILTER (NOT focal AND omega >= 0 AND omega < 10) AS n FROM p GROUP BY 1")
def pairwise_rates(spark, sf_dir):
    """A focal pair against the plausible background pairs."""
    p = D.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("gene"), (F.col("l_linenumber") == 1).alias("focal"), (F.col("l_quantity") / 4).alias("omega"))
    fine = F.when(~F.col("focal") & (F.col("omega") >= 0) & (F.col("omega") < 10), F.col("omega"))
    return p.groupBy("gene").agg(F.round(F.avg(F.when(F.col("focal"), F.col("omega"))), 6).alias("focal"), F.round(F.avg(fine), 6).alias("mean"), F.round(F.median(fine), 6).alias("median"), F.count(fine).alias("n"))


# -- H: ordering -------------------------------------------------------------------------


@query("SELECT event_type, event_id, CAST(rank() OVER (PARTITION BY event_type ORDER BY floor(value)) + (count(*) OVER (PARTITION BY event_type, floor(value)) - 1) / 2.0 AS DOUBLE) AS r FROM events")
def mid_ranks(spark, sf_dir):
    """H1: ranks of rounded-down values, many of them tied."""
    e = _events(spark, sf_dir).select("event_type", "event_id", F.floor("value").alias("x"))
    return R.mid_rank(e, ["event_type"], "x", "r").select("event_type", "event_id", "r")


@query("SELECT layer, event_id, value FROM (SELECT event_id % 8 AS layer, event_id, value, row_number() OVER (PARTITION BY event_id % 8 ORDER BY value, event_id) AS r FROM events) WHERE r <= 5")
def bottom_k(spark, sf_dir):
    """The five least of each layer."""
    e = _events(spark, sf_dir).select((F.col("event_id") % 8).alias("layer"), "event_id", "value")
    return panel.extreme_rows(e, ["layer"], 5, F.col("value"), F.col("event_id"))


@query("SELECT user_id, n, CAST(greatest(5, least(16, ceil(400 / CAST(n AS DOUBLE)))) AS INT) AS samples FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)")
def adaptive_samples(spark, sf_dir):
    """Samples a record needs."""
    n = _events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", "n", panel.adaptive_count("n").alias("samples"))


@query("WITH s AS (SELECT user_id AS key, event_id % 3000 AS place FROM events), c AS (SELECT key, w FROM (SELECT DISTINCT key FROM s), (SELECT unnest([250, 500, 750, 1000, 1250, 1500, 1750, 2000]) AS w)), n AS (SELECT c.key, w, count(s.place) AS n FROM c LEFT JOIN s ON s.key = c.key AND s.place < w GROUP BY 1, 2) SELECT key, CAST(w AS INT) AS window, n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n >= 20 DESC, CASE WHEN n >= 20 THEN w ELSE -w END) AS r FROM n) WHERE r = 1")
def window_extension(spark, sf_dir):
    """Windows grown by 250 until they hold twenty sites."""
    s = _events(spark, sf_dir).select(F.col("user_id").alias("key"), (F.col("event_id") % 3000).alias("place"))
    return panel.extended_window(s, "key", "place", 250, 250, 20, 2000)


@query("WITH s AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_brand, p_size, n, CAST(coalesce(sum(n) OVER (PARTITION BY p_brand ORDER BY p_size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM s")
def cumulative_offsets(spark, sf_dir):
    """H15."""
    return panel.offsets(D.table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n")), "p_size", "n", ["p_brand"])


@query("SELECT event_type, min(event_id) AS first_place FROM events GROUP BY 1")
def first_seen(spark, sf_dir):
    """Distinct values by where they first stand."""
    return panel.first_seen(_events(spark, sf_dir), "event_type", "event_id")


@query("SELECT c_mktsegment, CAST(list_position(['MACHINERY', 'BUILDING', 'HOUSEHOLD', 'FURNITURE', 'AUTOMOBILE'], c_mktsegment) - 1 AS INT) AS place, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) >= 8")
def curated_order(spark, sf_dir):
    """Labels of enough members in a curated order."""
    return T.in_curated_order(D.table(spark, sf_dir, "customer"), "c_mktsegment", ["MACHINERY", "BUILDING", "HOUSEHOLD", "FURNITURE", "AUTOMOBILE"], 8)


# -- I, M: set operations and contracts ----------------------------------------------------


@query("WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 100000), b AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) SELECT k, 'a' AS only_in FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'b' FROM b WHERE k NOT IN (SELECT k FROM a)")
def derivations_differ(spark, sf_dir):
    """I4, M7: what only one of two derivations has."""
    a = D.table(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("k"))
    b = D.table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return T.disagreements(a, b, ["k"])


@query("SELECT CAST(count(*) AS BIGINT) AS n_all, CAST(count(*) FILTER (value > 50) AS BIGINT) AS n_private, CAST(count(*) FILTER (value <= 50) AS BIGINT) AS n_shared, CAST(0 AS BIGINT) AS n_both, CAST(0 AS BIGINT) AS n_neither FROM events")
def disjoint_partition(spark, sf_dir):
    """Private and shared sites make up all sites, without overlap."""
    e = _events(spark, sf_dir).select("event_id", "value")
    private = e.where("value > 50").select("event_id", F.lit(1).alias("p"))
    shared = e.join(private, "event_id", "left_anti").select("event_id", F.lit(1).alias("s"))
    j = e.select("event_id").join(private, "event_id", "left").join(shared, "event_id", "left")
    return j.agg(F.count("*").alias("n_all"), F.count("p").alias("n_private"), F.count("s").alias("n_shared"), F.count_if(F.col("p").isNotNull() & F.col("s").isNotNull()).alias("n_both"), F.count_if(F.col("p").isNull() & F.col("s").isNull()).alias("n_neither"))


@query("""WITH a AS (SELECT n_name, 'A' || CAST(n_nationkey % 23 AS VARCHAR) AS accession, n_nationkey FROM nation)
 SELECT n_name AS name, 'empty' AS problem FROM a WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier) UNION ALL SELECT 'n99', 'unregistered'
 UNION ALL SELECT n_name, 'accession repeated' FROM a WHERE accession IN (SELECT accession FROM a GROUP BY 1 HAVING count(*) > 1)""")
def registry_integrity(spark, sf_dir):
    """Members of no registered name, names without members, accessions of several
    names."""
    n = D.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.concat(F.lit("A"), (F.col("n_nationkey") % 23).cast("string")).alias("accession"))
    c = D.table(spark, sf_dir, "supplier").select("s_nationkey")
    members = c.join(n, c["s_nationkey"] == n["n_nationkey"]).select(F.col("n_name").alias("m")).unionByName(spark.createDataFrame([("n99",)], "m string"))
    return T.broken_references(members, "m", n, "n_name").unionByName(T.repeated(n, "n_name", "accession"))


@query(f"WITH p AS (SELECT key, unnest(range(1, length(a) + 1)) AS i, a, b FROM ({D.PAIRS_SQL})), s AS (SELECT key, substr(a, i, 1) AS h, substr(b, i, 1) AS t FROM p WHERE substr(a, i, 1) <> substr(b, i, 1)) SELECT 'source' AS window, 0.0::DOUBLE AS score, count(*) AS n FROM s UNION ALL SELECT 'target', 100.0::DOUBLE, count(*) FROM s")
def structural_controls(spark, sf_dir):
    """M3: on the differing sites the source itself scores 0 and the target 100."""
    from strandline.operators import sites as S

    s = S.differing(D.pairs(spark, sf_dir), "key", "a", "b")
    score = lambda who, base: s.agg(F.lit(who).alias("window"), (100 * F.avg((F.col(base) == F.col("p")).cast("double"))).alias("score"), F.count("*").alias("n"))
    return score("source", "h").unionByName(score("target", "p"))


@query("WITH t AS (SELECT c_mktsegment AS predictor, o_orderpriority AS outcome, avg(o_totalprice) / 4e6 AS p FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2), n AS (SELECT predictor LIKE 'B%' AS grid, 0.05 * 20 / count(*) AS threshold FROM t GROUP BY 1) SELECT predictor, outcome, p < threshold AS significant FROM t JOIN n ON n.grid = (predictor LIKE 'B%')")
def significance_mask(spark, sf_dir):
    """A mask by each grid's own Bonferroni threshold; predictors of no grid are kept."""
    o, c = D.table(spark, sf_dir, "orders"), D.table(spark, sf_dir, "customer")
    t = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("c_mktsegment").alias("predictor"), F.col("o_orderpriority").alias("outcome")).agg((F.avg("o_totalprice") / 4e6).alias("p")).withColumn("grid", F.col("predictor").startswith("B"))
    n = t.groupBy("grid").agg((F.lit(0.05) * 20 / F.count("*")).alias("threshold"))
    return t.join(n, "grid", "left").select("predictor", "outcome", (F.col("p") < F.col("threshold")).alias("significant"))


@query("WITH o AS (SELECT event_type AS condition, user_id AS gene, round(avg(value), 5) AS x FROM events GROUP BY 1, 2) SELECT condition, gene, CASE WHEN condition = 'click' THEN 'run 2' ELSE 'run 1' END AS source, condition = 'click' AS replaced FROM o UNION ALL SELECT condition, gene, 'backup', false FROM o WHERE condition = 'click'")
def upsert_with_lineage(spark, sf_dir):
    """An upsert that says where rows come from and keeps those it replaces."""
    old = _events(spark, sf_dir).groupBy(F.col("event_type").alias("condition"), F.col("user_id").alias("gene")).agg(F.round(F.avg("value"), 5).alias("x"))
    merged, backup = T.upsert_with_backup(old, old.where("condition = 'click'"), "condition", "run 1", "run 2")
    return merged.unionByName(backup).select("condition", "gene", "source", "replaced")


@query("SELECT 'orders' AS name, 'second' AS place UNION ALL SELECT 'nation', 'first'")
def table_lookup(spark, sf_dir):
    """A10: a table by name in two folders; a name in neither is an error that says where it
    was looked for."""
    from strandline.sources import files
    from strandline.plans.source_queries import _folder

    n, o = D.table(spark, sf_dir, "nation"), D.table(spark, sf_dir, "orders")
    a, b = _folder(n), _folder(n)
    n.write.parquet(f"{a}/nation")
    for name, t in (("nation", o), ("orders", o)):
        t.write.parquet(f"{b}/{name}")
    try:
        files.tidy_table(spark, "missing", [a, b])
        raise AssertionError("a missing table was found")
    except FileNotFoundError:
        pass
    width = {len(n.columns) if "n_name" in n.columns else 0: "first"}
    rows = [(name, width.get(len(files.tidy_table(spark, name, [a, b]).columns), "second")) for name in ("orders", "nation")]
    return spark.createDataFrame(rows, "name string, place string")
