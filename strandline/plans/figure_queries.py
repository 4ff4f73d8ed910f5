"""Queries of table builders and figure tables, sequence edits and trees."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import sequences as S
from strandline.operators import panel, ranks as R, trees
from strandline.plans import derived as D
from strandline.plans.everyday_queries import _events, _r
from strandline.plans.paired_queries import _LEVELS, _M, _RANKED, BASE, _deltas
from strandline.plans.panel_queries import _FLAGS
from strandline.plans.sequence_queries import _amino, _codons

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_LAYERS = "SELECT event_id % 6 AS layer, event_type AS baseline, CASE user_id % 2 WHEN 0 THEN 'between' ELSE 'within' END AS axis, value / 100 AS rho, event_id % 3 AS approach FROM events"


def _layers(spark, sf_dir):
    return _events(spark, sf_dir).select((F.col("event_id") % 6).alias("layer"), F.col("event_type").alias("baseline"), F.when(F.col("user_id") % 2 == 0, "between").otherwise("within").alias("axis"), (F.col("value") / 100).alias("rho"), (F.col("event_id") % 3).alias("approach"))


@query(f"SELECT axis, layer, baseline, count(*) AS n, round(avg(rho), 6) AS rho FROM ({_LAYERS}) WHERE approach = 1 GROUP BY 1, 2, 3")
def layer_rollup(spark, sf_dir):
    """Per-layer tables of one approach, tagged by axis and put together."""
    x = _layers(spark, sf_dir).where("approach = 1")
    part = lambda axis: x.where(F.col("axis") == axis).groupBy("layer", "baseline").agg(F.count("*").alias("n"), F.round(F.avg("rho"), 6).alias("rho")).withColumn("axis", F.lit(axis))
    return part("between").unionByName(part("within")).select("axis", "layer", "baseline", "n", "rho")


@query("SELECT 'main' AS panel, n_nationkey, n_name FROM nation")
def tagged_table(spark, sf_dir):
    """R2: a table passed on with a constant first column."""
    return D.table(spark, sf_dir, "nation").select(F.lit("main").alias("panel"), "n_nationkey", "n_name")


@query("SELECT l_orderkey, l_linenumber, round(100 * l_tax / nullif(l_quantity, 0), 6) AS indel_pct, round(100 * l_discount / nullif(floor(l_quantity / 3), 0), 6) AS stops_per_100 FROM lineitem")
def readout_rates(spark, sf_dir):
    """Rates of what was made; nothing made gives null."""
    q = F.col("l_quantity")
    return D.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.try_divide(100 * F.col("l_tax"), q), 6).alias("indel_pct"), F.round(F.try_divide(100 * F.col("l_discount"), F.floor(q / 3)), 6).alias("stops_per_100"))


@query(f"WITH n AS (SELECT axis, layer, count(DISTINCT baseline) AS n FROM ({_LAYERS}) WHERE rho > 0.985 GROUP BY 1, 2) SELECT axis, min(n) AS least, max(n) AS most, min(n) <> max(n) AS varies FROM n GROUP BY 1")
def baseline_counts(spark, sf_dir):
    """Whether layers have the same number of baselines."""
    n = _layers(spark, sf_dir).where("rho > 0.985").groupBy("axis", "layer").agg(F.count_distinct("baseline").alias("n"))
    return n.groupBy("axis").agg(F.min("n").alias("least"), F.max("n").alias("most"), (F.min("n") != F.max("n")).alias("varies"))


@query("WITH a AS (SELECT user_id AS gene, CAST(event_id % 4 AS VARCHAR) AS layer, max(value) / 100 AS alpha FROM events GROUP BY 1, 2), m AS (SELECT gene, avg(alpha) AS alpha FROM a GROUP BY 1), f AS (SELECT user_id AS gene, avg(value) AS fixed FROM events WHERE event_type = 'click' GROUP BY 1), o AS (SELECT user_id AS gene, avg(value) AS own FROM events WHERE event_type = 'view' GROUP BY 1), j AS (SELECT gene, alpha, own - fixed AS diff FROM m JOIN f USING (gene) JOIN o USING (gene)), r AS (SELECT *, rank() OVER (ORDER BY alpha) + (count(*) OVER (PARTITION BY alpha) - 1) / 2.0 AS ra, rank() OVER (ORDER BY diff) + (count(*) OVER (PARTITION BY diff) - 1) / 2.0 AS rd FROM j) SELECT count(*) AS n, round(avg(diff), 6) AS mean, round(100 * avg(CASE WHEN diff > 0 THEN 1.0 ELSE 0.0 END), 6) AS pct_wins, round(quantile_cont(diff, 0.25), 6) AS q25, round(quantile_cont(diff, 0.75), 6) AS q75, round(corr(ra, rd), 6) AS rho FROM r")
def own_scaled_dose(spark, sf_dir):
    """Fixed against own-scaled doses; doses are read from JSON maps by layer."""
    e = _events(spark, sf_dir).withColumnRenamed("user_id", "gene")
    a = e.groupBy("gene", (F.col("event_id") % 4).cast("string").alias("layer")).agg((F.max("value") / 100).alias("alpha"))
    text = a.groupBy("gene").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("layer", "alpha")))).alias("alpha_own"))
    values = F.map_values(F.from_json("alpha_own", "map<string,double>"))
    m = text.select("gene", (F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)).alias("alpha"))
    mean = lambda c, name: e.where(F.col("event_type") == c).groupBy("gene").agg(F.avg("value").alias(name))
    j = m.join(mean("click", "fixed"), "gene").join(mean("view", "own"), "gene").select(F.lit(1).alias("all_"), "alpha", (F.col("own") - F.col("fixed")).alias("diff"))
    rho = R.spearman(j, ["all_"], "alpha", "diff").select("all_", "rho")
    g = j.groupBy("all_").agg(F.count("*").alias("n"), F.avg("diff").alias("mean"), (100 * F.avg((F.col("diff") > 0).cast("double"))).alias("pct_wins"), F.percentile("diff", F.lit(0.25)).alias("q25"), F.percentile("diff", F.lit(0.75)).alias("q75"))
    return g.join(rho, "all_").select("n", *_r("mean", "pct_wins", "q25", "q75", "rho"))


@query("SELECT event_id, round(value - 1, 3) AS low, round(value + 1.5, 3) AS high FROM events")
def ci_parsed(spark, sf_dir):
    """Intervals written as text and read back."""
    e = _events(spark, sf_dir).select("event_id", F.concat(F.lit("["), F.round(F.col("value") - 1, 3).cast("string"), F.lit(", "), F.round(F.col("value") + 1.5, 3).cast("string"), F.lit("]")).alias("ci"))
    part = lambda k: F.regexp_extract("ci", r"\[\s*([^,\]]+),\s*([^\]]+)\]", k).cast("double")
    return e.select("event_id", part(1).alias("low"), part(2).alias("high"))


@query("WITH r AS (SELECT c_nationkey AS k, avg(c_acctbal) AS rate FROM customer WHERE c_acctbal > 5000 GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS n_sites FROM supplier GROUP BY 1) SELECT n_nationkey, n_regionkey AS stratum, round(rate, 6) AS rate, n_sites, round(ln(length(n_name)), 6) AS log_len FROM nation LEFT JOIN r ON r.k = n_nationkey LEFT JOIN s ON s.k = n_nationkey")
def covariate_table(spark, sf_dir):
    """A panel with rates and read-outs joined to it, no column twice."""
    n = D.table(spark, sf_dir, "nation")
    r = D.table(spark, sf_dir, "customer").where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.round(F.avg("c_acctbal"), 6).alias("rate"))
    s = D.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n_sites"))
    return n.join(r, "n_nationkey", "left").join(s, "n_nationkey", "left").select("n_nationkey", F.col("n_regionkey").alias("stratum"), "rate", "n_sites", F.round(F.log(F.length("n_name")), 6).alias("log_len"))


@query(_M + f", c AS (SELECT gene, condition, delta, base, gene % 17 AS conservation FROM d), x AS (SELECT condition, {_RANKED('conservation', 'condition')} AS rc, {_RANKED('delta', 'condition')} AS rd FROM c) SELECT condition, count(*) AS n, round(corr(rc, rd), 6) AS rho FROM x GROUP BY 1")
def against_conservation(spark, sf_dir):
    """Every read-out, pivoted and unpivoted again, against conservation."""
    d = _deltas(spark, sf_dir)
    wide = d.groupBy("gene").pivot("condition", [c for c in _LEVELS if c != BASE]).agg(F.first("delta")).withColumn("conservation", F.col("gene") % 17)
    long = wide.unpivot(["gene", "conservation"], [c for c in _LEVELS if c != BASE], "condition", "delta").where("delta IS NOT NULL")
    return R.spearman(long, ["condition"], "conservation", "delta").select("condition", "n", F.round("rho", 6).alias("rho"))


@query(_M + f", c AS (SELECT *, gene % 3 AS stratum, gene % 17 AS conservation FROM d), e AS (SELECT stratum, min(conservation) AS low, max(conservation) AS high, count(DISTINCT conservation) AS kinds FROM c GROUP BY 1), x AS (SELECT stratum, {_RANKED('conservation', 'stratum')} AS rc, {_RANKED('base', 'stratum')} AS rb, {_RANKED('delta', 'stratum')} AS rd FROM c), rho AS (SELECT stratum, round(corr(rc, rd), 6) AS rho_conservation, round(corr(rb, rd), 6) AS rho_baseline FROM x GROUP BY 1) SELECT stratum, low, high, kinds, rho_conservation, rho_baseline FROM e JOIN rho USING (stratum)")
def conservation_bands(spark, sf_dir):
    """The edges of bands, and deltas against conservation and against baseline."""
    c = _deltas(spark, sf_dir).withColumn("stratum", F.col("gene") % 3).withColumn("conservation", F.col("gene") % 17)
    e = c.groupBy("stratum").agg(F.min("conservation").alias("low"), F.max("conservation").alias("high"), F.count_distinct("conservation").alias("kinds"))
    rho = lambda x, name: R.spearman(c, ["stratum"], x, "delta").select("stratum", F.round("rho", 6).alias(name))
    return e.join(rho("conservation", "rho_conservation"), "stratum").join(rho("base", "rho_baseline"), "stratum")


_CLASS = f"WITH p AS (SELECT key % 3 AS condition, unnest(range(1, length(a) + 1)) AS i, a, b FROM ({D.PAIRS_SQL})), s AS (SELECT condition, substr(a, i, 1) AS h, substr(b, i, 1) AS p FROM p WHERE substr(a, i, 1) <> substr(b, i, 1)), c AS (SELECT condition, CASE WHEN p IN ('G','C') AND h NOT IN ('G','C') THEN 'up' WHEN h IN ('G','C') AND p NOT IN ('G','C') THEN 'down' ELSE 'neutral' END AS cls, (p = 'A')::INT AS hit FROM s)"


@query(_CLASS + " SELECT condition, CAST(condition AS INT) AS place, " + ", ".join(f"count(*) FILTER (cls = '{c}') AS n_{c}, coalesce(sum(hit) FILTER (cls = '{c}'), 0)::BIGINT AS hits_{c}, round(avg(hit) FILTER (cls = '{c}'), 6) AS rate_{c}" for c in ("up", "down", "neutral")) + " FROM c GROUP BY 1")
def gc_class_pivot(spark, sf_dir):
    """Three values for each GC class side by side, rows in a fixed order."""
    from strandline.operators import sites

    s = sites.differing(D.pairs(spark, sf_dir), "key", "a", "b").select((F.col("key") % 3).alias("condition"), F.expr(S.gc_class("h", "p")).alias("cls"), (F.col("p") == "A").cast("int").alias("hit"))
    g = s.groupBy("condition").pivot("cls", ["up", "down", "neutral"]).agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"), F.round(F.avg("hit"), 6).alias("rate"))
    named = [F.coalesce(f"{c}_{x}", F.lit(0)).alias(f"{x}_{c}") if x != "rate" else F.col(f"{c}_{x}").alias(f"{x}_{c}") for c in ("up", "down", "neutral") for x in ("n", "hits", "rate")]
    return g.select("condition", F.col("condition").cast("int").alias("place"), *named)


@query(f"WITH s AS (SELECT layer, baseline, avg(rho) AS rho FROM ({_LAYERS}) WHERE axis = 'within' AND baseline <> 'error' GROUP BY 1, 2) SELECT layer, baseline, round(rho, 6) AS rho, 'scored' AS status FROM s UNION ALL SELECT NULL, 'error', NULL, 'not scored'")
def rung_means(spark, sf_dir):
    """Means by rung and layer, and the registered rungs that have none yet."""
    s = _layers(spark, sf_dir).where("axis = 'within' AND baseline <> 'error'").groupBy("layer", "baseline").agg(F.round(F.avg("rho"), 6).alias("rho")).withColumn("status", F.lit("scored"))
    registry = spark.createDataFrame([(x,) for x in _LEVELS], "baseline string")
    return s.unionByName(registry.join(s, "baseline", "left_anti").withColumn("status", F.lit("not scored")), allowMissingColumns=True)


@query("WITH g AS (SELECT user_id AS gene, user_id % 7 AS family, event_id % 4 AS layer, avg(value) AS x FROM events GROUP BY 1, 2, 3), m AS (SELECT layer, median(x) AS median_gene FROM g GROUP BY 1), f AS (SELECT layer, family, avg(x) AS x FROM g GROUP BY 1, 2) SELECT layer, round(any_value(median_gene), 6) AS median_gene, round(median(x), 6) AS median, round(min(x), 6) AS least, round(max(x), 6) AS most, round(greatest(0, (avg(x) / 100 - 1 / sqrt(count(*))) / (1 - 1 / sqrt(count(*)))), 6) AS corrected FROM f JOIN m USING (layer) GROUP BY layer")
def layer_matrices(spark, sf_dir):
    """Layers over genes and families: medians, spread, coherence less its floor."""
    g = _events(spark, sf_dir).groupBy(F.col("user_id").alias("gene"), (F.col("user_id") % 7).alias("family"), (F.col("event_id") % 4).alias("layer")).agg(F.avg("value").alias("x"))
    m = g.groupBy("layer").agg(F.round(F.median("x"), 6).alias("median_gene"))
    floor = 1 / F.sqrt(F.count("*"))
    f = g.groupBy("layer", "family").agg(F.avg("x").alias("x")).groupBy("layer").agg(F.round(F.median("x"), 6).alias("median"), F.round(F.min("x"), 6).alias("least"), F.round(F.max("x"), 6).alias("most"), F.round(F.greatest(F.lit(0.0), (F.avg("x") / 100 - floor) / (1 - floor)), 6).alias("corrected"))
    return f.join(m, "layer")


@query(f"WITH x AS (SELECT user_id % 40 AS family, value AS d, event_id % 500 AS e FROM events), n AS (SELECT family, count(*) AS n FROM x GROUP BY 1), r AS (SELECT family, {_RANKED('d', 'family')} AS rd, {_RANKED('e', 'family')} AS re FROM x), c AS (SELECT family, corr(rd, re) AS rho FROM r GROUP BY 1) SELECT family, n, CASE WHEN n >= 27 THEN 'ok' ELSE 'too_few' END AS status, CASE WHEN n >= 27 THEN round(rho, 6) END AS rho FROM n JOIN c USING (family)")
def family_status(spark, sf_dir):
    """Families scored from a cached matrix, those with too few members said so."""
    x = _events(spark, sf_dir).select((F.col("user_id") % 40).alias("family"), F.col("value").alias("d"), (F.col("event_id") % 500).alias("e"))
    s = R.spearman(x, ["family"], "d", "e")
    fine = F.col("n") >= 27
    return s.select("family", F.col("n").cast("long").alias("n"), F.when(fine, "ok").otherwise("too_few").alias("status"), F.when(fine, F.round("rho", 6)).alias("rho"))


@query("SELECT CAST(list_position(['view', 'hover', 'click', 'error'], event_type) - 1 AS INT) AS place, event_type AS rung FROM (SELECT DISTINCT event_type FROM events) WHERE event_type IN ('view', 'hover', 'click', 'error')")
def rungs_present(spark, sf_dir):
    """The rungs that a score table has, in their order."""
    order = spark.createDataFrame(list(enumerate(["view", "hover", "click", "error"])), "place int, rung string")
    return order.join(_events(spark, sf_dir).select(F.col("event_type").alias("rung")), "rung", "left_semi").select("place", "rung")


@query(_FLAGS + " SELECT family, count(*) FILTER (len(flags) = 0) AS retained, count(*) FILTER (len(flags) > 0) AS excluded, any_value(first_reason) AS first_reason FROM f JOIN (SELECT family AS fam, min(flags[1]) AS first_reason FROM f GROUP BY 1) ON fam = family GROUP BY 1")
def paired_dataset(spark, sf_dir):
    """A labelled table split in what is retained and excluded, by family."""
    q = panel.qc_flags(D.loci(spark, sf_dir), "cds").withColumn("reason", panel.first_reason("qc_flags"))
    return q.groupBy("family").agg(F.count_if("qc_pass").alias("retained"), F.count_if(~F.col("qc_pass")).alias("excluded"), F.min("reason").alias("first_reason"))


@query(_M + ", h AS (SELECT gene, condition, delta / nullif(100 - base, 0) AS h, gene % 3 AS stratum FROM d), c AS (SELECT gene FROM h GROUP BY 1 HAVING count(DISTINCT condition) = 4), k AS (SELECT h.* FROM h JOIN c USING (gene)) SELECT condition, CASE WHEN grouping(stratum) = 1 THEN 'all' ELSE CAST(stratum AS VARCHAR) END AS stratum, count(*) AS n, round(avg(h), 6) AS mean, round(median(h), 6) AS median FROM k GROUP BY GROUPING SETS ((condition), (condition, stratum))")
def headroom_driver(spark, sf_dir):
    """Headroom of genes that every condition has, by stratum and overall."""
    from strandline.operators import paired as P, tables as T

    h = _deltas(spark, sf_dir).select("gene", "condition", F.try_divide("delta", 100 - F.col("base")).alias("h"), (F.col("gene") % 3).alias("stratum"))
    k = h.join(T.in_every(h, "gene", "condition"), "gene")
    return P.with_all(k, ["condition"], "stratum", F.count("*").alias("n"), F.round(F.avg("h"), 6).alias("mean"), F.round(F.median("h"), 6).alias("median"))


@query("WITH a AS (SELECT condition, delta / nullif(base, 0) AS rel, delta AS abs_ FROM (" + _M.replace("WITH r AS", "WITH r AS", 1) + " SELECT * FROM d)), u AS (SELECT condition, 'relative' AS kind, rel AS x FROM a UNION ALL SELECT condition, 'absolute', abs_ FROM a) SELECT condition, kind, count(x) AS n, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median FROM u GROUP BY 1, 2")
def delta_kinds(spark, sf_dir):
    """Relative and absolute deltas as one long table."""
    d = _deltas(spark, sf_dir).select("condition", F.try_divide("delta", "base").alias("relative"), F.col("delta").alias("absolute"))
    u = d.unpivot(["condition"], ["relative", "absolute"], "kind", "x")
    return u.groupBy("condition", "kind").agg(F.count("x").alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.median("x"), 6).alias("median"))


@query("SELECT event_id % 8 AS layer, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.5), 6) AS middle, round(quantile_cont(value, 0.975), 6) AS high FROM events GROUP BY 1")
def null_bands(spark, sf_dir):
    """The 2.5, 50 and 97.5 percentiles of draws by layer."""
    p = F.percentile("value", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    g = _events(spark, sf_dir).groupBy((F.col("event_id") % 8).alias("layer")).agg(p.alias("p"))
    return g.select("layer", *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("low", "middle", "high"))])


# -- sequences and windows -----------------------------------------------------------------


@query(f"WITH l AS (SELECT key, length(cds) * (1 + key % 40) AS len FROM ({D.LOCI_SQL})), n AS (SELECT key, len, CAST(ceil(len / 256.0) AS INT) AS n FROM l), w AS (SELECT key, len, n, unnest(range(0, least(24, CASE WHEN len <= 256 THEN 1 ELSE n END))) AS i FROM n) SELECT key, CAST(i AS INT) AS i, CAST(CASE WHEN len <= 256 THEN 0 WHEN n <= 24 THEN round_even(i * len / CAST(n AS DOUBLE), 0) ELSE trunc(128 + i * (len - 256) / 23.0) - 128 END AS INT) AS start, CAST(CASE WHEN len <= 256 THEN len WHEN n <= 24 THEN round_even((i + 1) * len / CAST(n AS DOUBLE), 0) ELSE trunc(128 + i * (len - 256) / 23.0) + 128 END AS INT) AS stop FROM w")
def window_bounds(spark, sf_dir):
    """Contiguous windows, or 24 evenly spaced ones of a long span."""
    w = D.loci(spark, sf_dir).select("key", (F.length("cds") * (1 + F.col("key") % 40)).cast("int").alias("len"))
    return w.select("key", F.explode(F.expr(S.window_bounds("len", 256, 24))).alias("w")).select("key", "w.*")


@query(f"WITH p AS (SELECT key, cds, list_transform(range(0, length(cds) // 5), lambda i: 5 * i) AS at FROM ({D.LOCI_SQL})) SELECT key, array_to_string(list_transform(range(1, length(cds) + 1), lambda i: CASE WHEN (i - 1) % 5 = 0 AND i - 1 < 5 * (length(cds) // 5) THEN translate(substr(cds, i, 1), 'ACGT', 'TGCA') ELSE substr(cds, i, 1) END), '') AS edited FROM p")
def replaced_places(spark, sf_dir):
    """Given bases put at given places of a span."""
    p = D.loci(spark, sf_dir).select("key", "cds", F.expr("transform(sequence(0, length(cds) DIV 5 - 1), i -> CAST(5 * i AS INT))").alias("at"))
    p = p.withColumn("new", F.expr("array_join(transform(at, i -> translate(substr(cds, i + 1, 1), 'ACGT', 'TGCA')), '')"))
    return p.select("key", F.expr(S.replaced("cds", "at", "new")).alias("edited"))


_ALT = "substr(codon, 1, 2) || b"


@query(f"WITH c AS (SELECT DISTINCT codon FROM (SELECT unnest({_codons('cds')}) AS codon FROM ({D.LOCI_SQL})) WHERE length(codon) = 3 AND translate(codon, 'ACGT', '') = ''), x AS (SELECT codon, {_amino('codon')} AS aa FROM c), o AS (SELECT codon, aa, {_ALT} AS other, {_amino('(' + _ALT + ')')} AS ab FROM x, (SELECT unnest(['A','C','G','T']) AS b) WHERE b <> substr(codon, 3, 1)) SELECT codon, aa, coalesce(string_agg(other, ',' ORDER BY other) FILTER (ab = aa AND ab <> '*'), '') AS synonymous, coalesce(string_agg(other, ',' ORDER BY other) FILTER (ab <> aa AND ab <> '*'), '') AS missense FROM o WHERE aa <> '*' GROUP BY 1, 2")
def third_base_options(spark, sf_dir):
    """For each sense codon in use the third-base changes that keep or change the amino
    acid."""
    used = D.loci(spark, sf_dir).select(F.explode(F.expr("transform(sequence(1, length(cds) - 2, 3), i -> substr(cds, i, 3))")).alias("codon")).distinct()
    codons = used.where(F.col("codon").isin(*S.SENSE))
    o = codons.select("codon", F.expr(S.amino("codon")).alias("aa"), F.explode(F.expr("transform(filter(array('A','C','G','T'), b -> b <> substr(codon, 3, 1)), b -> substr(codon, 1, 2) || b)")).alias("other")).withColumn("ab", F.expr(S.amino("other")))
    kept = lambda same: F.array_join(F.array_sort(F.collect_list(F.when((F.col("ab") == F.col("aa")) == F.lit(same), F.when(F.col("ab") != "*", F.col("other"))))), ",")
    return o.groupBy("codon", "aa").agg(kept(True).alias("synonymous"), kept(False).alias("missense"))


@query("WITH p AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE power(10, -(event_id % 6)) * value / 97.31 END AS p FROM events) SELECT event_id, CASE WHEN p IS NULL THEN 'n/a' WHEN p < 0.001 THEN 'p < 0.001' ELSE 'p = ' || printf('%.3f', p) END AS label FROM p")
def p_labels(spark, sf_dir):
    """P values as labels."""
    p = _events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 9 != 0, F.pow(F.lit(10.0), -(F.col("event_id") % 6)) * F.col("value") / 97.31).alias("p"))
    return p.select("event_id", F.expr(S.p_label("p")).alias("label"))


# -- trees -------------------------------------------------------------------------------


@query("WITH t AS (SELECT s_suppkey AS tip, s_suppkey % 5 AS tree, s_nationkey AS grp, abs(s_acctbal) / 1e4 AS len FROM supplier), d AS (SELECT x.tree, x.grp, x.tip AS a, y.tip AS b, x.len + y.len AS d FROM t x JOIN t y ON x.tree = y.tree AND x.grp = y.grp AND x.tip < y.tip) SELECT grp, count(*) AS n, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS sd FROM d GROUP BY 1")
def posterior_trees(spark, sf_dir):
    """L1: distances inside each tree, then their mean and deviation over trees."""
    t = D.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tip"), (F.col("s_suppkey") % 5).alias("tree"), F.col("s_nationkey").alias("grp"), (F.abs("s_acctbal") / 1e4).alias("len"))
    tips = t.select(F.concat_ws(":", "tree", "grp", "tip").alias("node"), F.concat_ws(":", "tree", "grp").alias("parent"), "len")
    roots = tips.select(F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0.0).alias("len")).distinct()
    d = trees.patristic(trees.ancestors(tips.unionByName(roots), "node", "parent", "len"), tips, "node")
    return d.groupBy(F.split("a", ":")[1].cast("int").alias("grp")).agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("mean"), F.round(F.stddev_pop("d"), 6).alias("sd"))


@query("SELECT 's' || s_suppkey AS node, 'n' || s_nationkey AS parent, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 's' || s_suppkey END AS label FROM supplier")
def relabelled_tips(spark, sf_dir):
    """L2."""
    s = D.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("parent"), "s_name", "s_suppkey")
    return trees.relabelled(s.select("node", "parent"), "node", s.where("s_suppkey % 3 = 0"), "node", "s_name").select("node", "parent", "label")


_TREE = "WITH n AS (SELECT 'root' AS node, CAST(NULL AS VARCHAR) AS parent UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer), k AS (SELECT 'c' || c_custkey AS tip, 'n' || c_nationkey AS n, 'r' || n_regionkey AS r FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')), cn AS (SELECT n, r, count(*) AS c FROM k GROUP BY 1, 2), cr AS (SELECT r, count(*) AS c FROM cn GROUP BY 1)"


@query(_TREE + ", kn AS (SELECT n, r FROM cn WHERE c > 1), kr AS (SELECT r FROM cr WHERE c > 1), root AS (SELECT count(*) > 1 AS ok FROM cr) SELECT tip AS node, CASE WHEN n IN (SELECT n FROM kn) THEN n WHEN r IN (SELECT r FROM kr) THEN r WHEN (SELECT ok FROM root) THEN 'root' END AS parent FROM k UNION ALL SELECT n, CASE WHEN r IN (SELECT r FROM kr) THEN r WHEN (SELECT ok FROM root) THEN 'root' END FROM kn UNION ALL SELECT r, CASE WHEN (SELECT ok FROM root) THEN 'root' END FROM kr UNION ALL SELECT 'root', NULL FROM root WHERE ok")
def pruned_tree(spark, sf_dir):
    """L4: the topology of the customers with an open order, single-child nodes taken out."""
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    c = D.table(spark, sf_dir, "customer")
    none = spark.createDataFrame([("root", None)], "node string, parent string")
    r = D.table(spark, sf_dir, "region").select(text("r", "r_regionkey").alias("node"), F.lit("root").alias("parent"))
    n = D.table(spark, sf_dir, "nation").select(text("n", "n_nationkey").alias("node"), text("r", "n_regionkey").alias("parent"))
    tips = c.select(text("c", "c_custkey").alias("node"), text("n", "c_nationkey").alias("parent"), "c_custkey")
    nodes = none.unionByName(r).unionByName(n).unionByName(tips.drop("c_custkey"))
    wanted = D.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(text("c", "o_custkey").alias("node")).distinct()
    return trees.pruned(nodes, "node", "parent", tips.select("node").join(wanted, "node", "left_semi")).select("node", "parent")


@query("SELECT n_regionkey AS tree, n_name AS name FROM nation")
def newick_species(spark, sf_dir):
    """Species names read off Newick texts."""
    t = D.table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("tree")).agg(F.concat(F.lit("("), F.array_join(F.transform(F.sort_array(F.collect_list("n_name")), lambda x: F.concat(x, F.lit(":0.1"))), ","), F.lit(");")).alias("newick"))
    return t.select("tree", F.explode(trees.newick_names("newick")).alias("name"))
