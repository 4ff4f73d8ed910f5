"""Queries over panels, table contracts, trees and the plain relational core."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import panel as P, tables as T, trees
from strandline.plans import derived as D
from strandline.plans.sequence_queries import _STOPS, _n

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_RUN = "coalesce(list_max(list_transform(regexp_extract_all(cds, '(N+)', 1), lambda r: length(r))), 0)"
_FLAGS = f"""WITH f AS (SELECT key, family, species, cds, list_filter([
 CASE WHEN cds IS NULL OR length(cds) = 0 THEN 'missing' END, CASE WHEN length(cds) % 3 <> 0 THEN 'not_whole_codons' END, CASE WHEN NOT starts_with(cds, 'ATG') THEN 'no_start' END,
 CASE WHEN NOT {_STOPS} LIKE '%*' THEN 'no_stop' END, CASE WHEN instr(regexp_replace({_STOPS}, '[*]$', ''), '*') > 0 THEN 'inner_stop' END,
 CASE WHEN {_n('cds', 'N')} > 0.05 * length(cds) THEN 'n_share' END, CASE WHEN {_RUN} >= 5 THEN 'n_run' END, CASE WHEN length(cds) < 100 THEN 'short' END], lambda x: x IS NOT NULL) AS flags FROM ({D.LOCI_SQL}))"""


@query(_FLAGS + " SELECT key, array_to_string(flags, ';') AS qc_flags, len(flags) = 0 AS qc_pass FROM f")
def qc_flags(spark, sf_dir):
    """C1, C5."""
    return P.qc_flags(D.loci(spark, sf_dir), "cds").select("key", F.array_join("qc_flags", ";").alias("qc_flags"), "qc_pass")


@query(_FLAGS + " SELECT coalesce(flags[1], 'passed') AS reason, count(*) AS n FROM f GROUP BY 1")
def qc_reasons(spark, sf_dir):
    """Documents by the first rule they fail."""
    q = P.qc_flags(D.loci(spark, sf_dir), "cds")
    return q.groupBy(F.coalesce(P.first_reason("qc_flags"), F.lit("passed")).alias("reason")).agg(F.count("*").alias("n"))


@query("WITH m AS (SELECT p_brand, median(p_retailprice * p_size) AS m FROM part GROUP BY 1) SELECT p_partkey, (p_retailprice * p_size < 0.2 * m) OR (p_retailprice * p_size > 1.8 * m) AS length_outlier FROM part JOIN m USING (p_brand)")
def length_outlier(spark, sf_dir):
    """C2."""
    p = D.table(spark, sf_dir, "part")
    return P.length_outliers(p, "p_brand", F.col("p_retailprice") * F.col("p_size"), high=1.8).select("p_partkey", "length_outlier")


@query(f"WITH l AS ({D.LOCI_SQL}), n AS (SELECT family, count(DISTINCT species) AS n_levels FROM l GROUP BY 1) SELECT key, family, n_levels FROM l JOIN n USING (family) WHERE n_levels >= 12")
def analyzable(spark, sf_dir):
    """C3, H2."""
    return P.analyzable(D.loci(spark, sf_dir), "family", "species", 12).select("key", "family", "n_levels")


@query("WITH o AS (SELECT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_linenumber = 1 AND l_quantity = 50), n AS (SELECT *, count(*) OVER (PARTITION BY a) AS na, count(*) OVER (PARTITION BY b) AS nb FROM o) SELECT a, b FROM n WHERE na = 1 AND nb = 1")
def one2one(spark, sf_dir):
    """C6, D10."""
    o = D.table(spark, sf_dir, "lineitem").where("l_linenumber = 1 AND l_quantity = 50").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return P.one_to_one(o, "a", "b")


@query("SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size = 1 DESC, length(p_name) DESC, p_partkey DESC) AS r FROM part) WHERE r = 1")
def transcript_pick(spark, sf_dir):
    """Canonical first, then longest, then last id."""
    p = D.table(spark, sf_dir, "part")
    return P.pick(p, ["p_brand"], F.desc(F.col("p_size") == 1), F.desc(F.length("p_name")), F.desc("p_partkey")).select("p_brand", "p_partkey")


@query(f"SELECT family, species, key, length(cds) AS len FROM (SELECT *, row_number() OVER (PARTITION BY family, species ORDER BY length(cds) DESC, key) AS r FROM ({D.LOCI_SQL})) WHERE r = 1")
def longest_per_gene(spark, sf_dir):
    """A4."""
    return P.pick(D.loci(spark, sf_dir), ["family", "species"], F.desc(F.length("cds")), F.col("key")).select("family", "species", "key", F.length("cds").cast("long").alias("len"))


@query("WITH g AS (SELECT p_brand AS chrom, p_partkey AS key, p_partkey * 10 AS s, p_partkey * 10 + p_size * 10 AS e FROM part) SELECT x.key, count(y.key) AS n_overlap FROM g x LEFT JOIN g y ON x.chrom = y.chrom AND x.key <> y.key AND y.s <= x.e AND y.e >= x.s GROUP BY 1")
def overlap_count(spark, sf_dir):
    """D11."""
    g = D.table(spark, sf_dir, "part").select(F.col("p_brand").alias("chrom"), F.col("p_partkey").alias("key"), (F.col("p_partkey") * 10).alias("s"), (F.col("p_partkey") * 10 + F.col("p_size") * 10).alias("e"))
    return P.overlap_counts(g, "chrom", "key", "s", "e")


@query("WITH e AS (SELECT quantile_cont(p_retailprice, [0.2, 0.4, 0.6, 0.8]) AS e FROM part) SELECT p_partkey, CAST(len(list_filter(e, lambda x: x < p_retailprice)) AS INT) AS stratum FROM part, e")
def strata_quantile(spark, sf_dir):
    """H3."""
    return P.quantile_strata(D.table(spark, sf_dir, "part"), "p_retailprice", 5).select("p_partkey", "stratum")


@query("WITH m AS (SELECT p_brand, median(p_retailprice) AS m FROM part GROUP BY 1) SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY abs(p_retailprice - m), p_partkey) AS r FROM part JOIN m USING (p_brand)) WHERE r = 1")
def block_representative(spark, sf_dir):
    """G9."""
    return P.nearest_to_median(D.table(spark, sf_dir, "part"), "p_brand", "p_retailprice", "p_partkey").select("p_brand", "p_partkey")


@query(f"""WITH p AS ({_FLAGS} SELECT key, family, md5('1:' || CAST(key AS VARCHAR)) AS o, len(flags) = 0 AS ok FROM f),
 n AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY family ORDER BY o ROWS UNBOUNDED PRECEDING) AS n FROM p) SELECT key, family, ok AND n <= 20 AS selected, n - CAST(ok AS INT) < 20 AS examined FROM n""")
def quota_walk(spark, sf_dir):
    """H4, H5."""
    p = P.qc_flags(D.loci(spark, sf_dir), "cds").withColumn("o", P.seeded("key", 1))
    return P.quota_walk(p, "family", "o", "qc_pass", 20).select("key", "family", "selected", "examined")


_ALLOC = """WITH s AS (SELECT p_brand AS fam, p_size % 12 AS grp, count(*) AS size FROM part WHERE p_size > 3 GROUP BY 1, 2),
 x AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY fam) AS k, coalesce(sum(size) OVER (PARTITION BY fam ORDER BY size, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s WINDOW w AS (PARTITION BY fam ORDER BY size, grp)),
 y AS (SELECT *, 40 - before AS lft, k - i + 1 AS opn, size * (k - i + 1) > 40 - before AS short FROM x),
 z AS (SELECT *, arg_min(lft // opn, i) FILTER (short) OVER (PARTITION BY fam) AS lvl, arg_min(lft % opn, i) FILTER (short) OVER (PARTITION BY fam) AS extra FROM y),
 t AS (SELECT *, lvl IS NOT NULL AND size > lvl AS capped FROM z),
 q AS (SELECT *, row_number() OVER (PARTITION BY fam, capped ORDER BY md5('1:' || CAST(grp AS VARCHAR)), grp) AS turn FROM t),
 a AS (SELECT fam, grp, size, CAST(CASE WHEN capped THEN lvl + CASE WHEN turn <= extra THEN 1 ELSE 0 END ELSE size END AS BIGINT) AS quota FROM q)"""


def _alloc(spark, sf_dir):
    s = D.table(spark, sf_dir, "part").where("p_size > 3").groupBy(F.col("p_brand").alias("fam"), (F.col("p_size") % 12).alias("grp")).agg(F.count("*").alias("size"))
    return s, P.even_allocation(s, ["fam"], "grp", "size", 40)


@query(_ALLOC + " SELECT fam, grp, size, quota FROM a")
def even_alloc(spark, sf_dir):
    """H7."""
    return _alloc(spark, sf_dir)[1]


@query(_ALLOC + ", r AS (SELECT p_partkey, p_brand AS fam, p_size % 12 AS grp, row_number() OVER (PARTITION BY p_brand, p_size % 12 ORDER BY md5('1:' || CAST(p_partkey AS VARCHAR)), p_partkey) AS n FROM part WHERE p_size > 3) SELECT p_partkey, fam, grp FROM r JOIN a USING (fam, grp) WHERE n <= quota")
def stratified_cap(spark, sf_dir):
    """H8."""
    p = D.table(spark, sf_dir, "part").where("p_size > 3").select("p_partkey", F.col("p_brand").alias("fam"), (F.col("p_size") % 12).alias("grp"))
    return P.stratified_sample(p, _alloc(spark, sf_dir)[1].drop("size"), ["fam", "grp"], "p_partkey").select("p_partkey", "fam", "grp")


@query("WITH s AS (SELECT p_brand AS fam, p_size % 12 AS grp, count(*) AS size FROM part WHERE p_size > 3 GROUP BY 1, 2), t AS (SELECT *, sum(size) OVER (PARTITION BY fam ORDER BY size DESC, md5('1:' || CAST(grp AS VARCHAR)), grp ROWS UNBOUNDED PRECEDING) AS t FROM s) SELECT fam, grp, size FROM t WHERE t - size < 40")
def cap_by_groups(spark, sf_dir):
    """H6."""
    return P.cap_by_groups(_alloc(spark, sf_dir)[0], ["fam"], "grp", "size", 40)


@query("WITH t AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS turn FROM part) SELECT p_partkey, CAST(turn AS INT) AS turn, row_number() OVER (ORDER BY turn, p_brand) AS seat FROM t")
def interleave(spark, sf_dir):
    """H9."""
    return P.interleaved(D.table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey").select("p_partkey", "turn", "seat")


@query("WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN value END AS x FROM events) SELECT event_id, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), first_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS x_filled FROM e")
def fill(spark, sf_dir):
    """H13."""
    e = D.table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("x"))
    return P.filled(e, "user_id", "event_id", "x").select("event_id", "x_filled")


_OLD_NEW = "WITH o AS (SELECT event_type AS condition, user_id AS gene, round(avg(value), 6) AS x FROM events GROUP BY 1, 2), n AS (SELECT condition, gene, x + 1 AS x FROM o WHERE condition = 'click')"


def _old(spark, sf_dir):
    return D.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("condition"), F.col("user_id").alias("gene")).agg(F.round(F.avg("value"), 6).alias("x"))


@query(_OLD_NEW + " SELECT condition, gene, round(x, 5) AS x FROM o WHERE condition NOT IN (SELECT condition FROM n) UNION ALL SELECT condition, gene, round(x, 5) FROM n")
def upsert(spark, sf_dir):
    """B4, D8, I1."""
    o = _old(spark, sf_dir)
    return T.upsert(o, o.where("condition = 'click'").withColumn("x", F.col("x") + 1), "condition").withColumn("x", F.round("x", 5))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def resume_antijoin(spark, sf_dir):
    """B9."""
    done = D.table(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return T.remaining(D.table(spark, sf_dir, "customer").select("c_custkey"), done, ["c_custkey"])


@query("WITH p AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 90) SELECT k.user_id, l.event_type FROM (SELECT DISTINCT user_id FROM p) k CROSS JOIN (SELECT DISTINCT event_type FROM p) l LEFT JOIN p ON p.user_id = k.user_id AND p.event_type = l.event_type WHERE p.user_id IS NULL")
def completeness_gap(spark, sf_dir):
    """I3, I6."""
    return T.completeness_gaps(D.table(spark, sf_dir, "events").where("value > 90").select("user_id", "event_type"), ["user_id"], "event_type")


@query("SELECT 'orders: 3 distinct o_orderstatus, not 4' AS problem UNION ALL SELECT 'orders: key [''o_custkey''] is not unique'")
def validate_spec(spark, sf_dir):
    """M1, M2: problems of a table that breaks two rules."""
    spec = T.Spec("orders", ["o_orderkey", "o_custkey"], key=["o_custkey"], distinct={"o_orderstatus": 4})
    return spark.createDataFrame([(x,) for x in T.validate(D.table(spark, sf_dir, "orders"), spec)], "problem string")


@query("SELECT n_name AS name, n_regionkey AS owner, 'old' AS state FROM nation WHERE n_regionkey <> 1 AND n_nationkey % 4 <> 0 UNION ALL SELECT n_name, n_regionkey, 'new' FROM nation WHERE n_regionkey = 1 AND n_nationkey % 4 <> 0")
def manifest_merge(spark, sf_dir):
    """B2."""
    n = D.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("owner"), "n_nationkey")
    rows = n.select("name", "owner")
    return T.merged_manifest(rows.withColumn("state", F.lit("old")), rows.where("owner = 1").withColumn("state", F.lit("new")), n.where("n_nationkey % 4 <> 0"), "name", "owner").select("name", "owner", "state")


@query("SELECT count(*) AS n, round(max(abs(a.s - b.s)), 6) AS max_abs FROM (SELECT l_orderkey AS k, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) a JOIN (SELECT o_orderkey AS k, o_totalprice AS s FROM orders) b USING (k)")
def cross_run_difference(spark, sf_dir):
    """D17, M4."""
    a = D.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("s"))
    b = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("s"))
    return T.largest_difference(a, b, ["k"], "s").select("n", F.round("max_abs", 6).alias("max_abs"))


_TREE = """WITH t AS (SELECT 'root' AS node, CAST(NULL AS VARCHAR) AS parent, 0.0 AS len UNION ALL SELECT 'r' || r_regionkey, 'root', 1.0 FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 0.5 + n_nationkey / 100.0 FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, abs(s_acctbal) / 1e4 FROM supplier),
 a AS (SELECT x.node, u.anc, u.d FROM t x, LATERAL (SELECT x.node AS anc, 0.0 AS d UNION ALL SELECT x.parent, x.len UNION ALL SELECT y.parent, x.len + y.len FROM t y WHERE y.node = x.parent UNION ALL SELECT z.parent, x.len + y.len + z.len FROM t y JOIN t z ON z.node = y.parent WHERE y.node = x.parent) u WHERE u.anc IS NOT NULL),
 d AS (SELECT p.node AS a, q.node AS b, min(p.d + q.d) AS d FROM a p JOIN a q ON p.anc = q.anc AND p.node < q.node WHERE p.node LIKE 's%' AND q.node LIKE 's%' GROUP BY 1, 2)"""


def _tree(spark, sf_dir):
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    root = spark.createDataFrame([("root", None, 0.0)], "node string, parent string, len double")
    r = D.table(spark, sf_dir, "region").select(text("r", "r_regionkey").alias("node"), F.lit("root").alias("parent"), F.lit(1.0).alias("len"))
    n = D.table(spark, sf_dir, "nation").select(text("n", "n_nationkey").alias("node"), text("r", "n_regionkey").alias("parent"), (0.5 + F.col("n_nationkey") / 100.0).alias("len"))
    s = D.table(spark, sf_dir, "supplier").select(text("s", "s_suppkey").alias("node"), text("n", "s_nationkey").alias("parent"), (F.abs("s_acctbal") / 1e4).alias("len"))
    nodes = root.unionByName(r).unionByName(n).unionByName(s)
    return nodes, trees.ancestors(nodes, "node", "parent", "len"), s.select("node")


@query(_TREE + " SELECT a, b, round(d, 7) AS d FROM d")
def tree_patristic(spark, sf_dir):
    """L3."""
    _, paths, tips = _tree(spark, sf_dir)
    return trees.patristic(paths, tips, "node").select("a", "b", F.round("d", 7).alias("d"))


@query(_TREE + ", i AS (SELECT t.*, node NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL) AS tip FROM t) SELECT round(sum(len), 6) AS length, count(*) FILTER (tip) AS n_tips, round(avg(len) FILTER (tip), 6) AS mean_terminal, round(sum(len) FILTER (NOT tip) / sum(len), 6) AS treeness, round((SELECT max(d) FROM d), 6) AS diameter FROM i")
def tree_stats(spark, sf_dir):
    """L5. No length is below 0, so two sweeps find the diameter."""
    nodes, paths, tips = _tree(spark, sf_dir)
    return trees.statistics(nodes, "node", "parent", "len", trees.diameter(paths, tips, "node")).select("n_tips", *[F.round(c, 6).alias(c) for c in ("length", "mean_terminal", "treeness", "diameter")])


@query("WITH g AS (SELECT CAST(unnest(range(0, 41)) * 5.0 AS DOUBLE) AS x), s AS (SELECT stddev_samp(value) * pow(count(*), -0.2) AS h, count(*) AS n FROM events WHERE event_type = 'click') SELECT g.x, round(sum(exp(-0.5 * pow((g.x - e.value) / h, 2))) / (max(n) * max(h) * sqrt(2 * pi())), 8) AS density FROM g, s, events e WHERE e.event_type = 'click' GROUP BY g.x")
def kde_grid(spark, sf_dir):
    """A grid of 41 points, broadcast, over all values."""
    e = D.table(spark, sf_dir, "events").where("event_type = 'click'").select("value")
    s = e.agg((F.stddev_samp("value") * F.pow(F.count("*"), F.lit(-0.2))).alias("h"), F.count("*").alias("n"))
    g = spark.range(41).select((F.col("id") * 5.0).alias("x"))
    k = F.exp(-0.5 * F.pow((F.col("x") - F.col("value")) / F.col("h"), 2))
    x = e.crossJoin(F.broadcast(g.crossJoin(s)))
    return x.groupBy("x").agg(F.round(F.sum(k) / (F.max("n") * F.max("h") * F.sqrt(2 * F.pi())), 8).alias("density"))


@query("WITH b AS (SELECT event_id, least(87, CAST(floor(value / 10) AS INT)) AS bin FROM events WHERE event_type = 'click'), r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY event_id) - 1 AS i FROM b) SELECT event_id, bin, CAST(CASE WHEN i % 2 = 0 THEN i // 2 ELSE -((i + 1) // 2) END AS BIGINT) AS place FROM r")
def beeswarm(spark, sf_dir):
    """Places fan out from the middle of each of 88 bins."""
    from pyspark.sql import Window

    b = D.table(spark, sf_dir, "events").where("event_type = 'click'").select("event_id", F.least(F.lit(87), F.floor(F.col("value") / 10).cast("int")).alias("bin"))
    i = F.row_number().over(Window.partitionBy("bin").orderBy("event_id")) - 1
    return b.withColumn("i", i).select("event_id", "bin", F.expr("CAST(CASE WHEN i % 2 = 0 THEN i DIV 2 ELSE -((i + 1) DIV 2) END AS BIGINT)").alias("place"))


@query("SELECT c_mktsegment, o_orderpriority, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY 1, 2")
def tpch_smoke(spark, sf_dir):
    """Joins pruned to the columns they use, the filter in the scan."""
    li = D.table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp")).select("l_orderkey", "l_extendedprice", "l_discount")
    o = D.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = D.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"])
    return j.groupBy("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n_lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
