"""Queries of alignments. On sequences with isolated differences the best alignment has no
gaps, so plain SQL over places says what they must give."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import align as A, sites as S
from strandline.operators.lineage import dealt
from strandline.plans import derived as D
from strandline.plans.sequence_queries import _amino, _protein

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_trim = lambda s: f"regexp_replace({_protein(s, 'coalesce(' + _amino('c') + chr(44) + chr(39) + 'X' + chr(39) + ')')}, '[*]$', '')"
_PAIR = f"WITH c AS (SELECT key, family, a, b, {_trim('a')} AS pa, {_trim('b')} AS pb FROM ({D.CLOSE_SQL}))"
_SITES = _PAIR + """, p AS (SELECT key, a, b, pa, pb, unnest(range(0, 3 * length(pa))) AS i FROM c),
 s AS (SELECT key, CAST(i AS INT) AS h_idx, CAST(i AS INT) AS t_idx, substr(a, i + 1, 1) AS h_base, substr(b, i + 1, 1) AS t_base, substr(pa, i // 3 + 1, 1) <> substr(pb, i // 3 + 1, 1) AS aa_change FROM p WHERE substr(a, i + 1, 1) IN ('A','C','G','T') AND substr(b, i + 1, 1) IN ('A','C','G','T'))"""


def _aligned(spark, sf_dir):
    return A.codon_blocks(D.close_pairs(spark, sf_dir), "key", "a", "b")


@query(_PAIR + " SELECT key, pa, pb, CAST(1 AS INT) AS n_blocks, CAST(0 AS INT) AS hs, CAST(length(pa) AS INT) AS he, CAST(0 AS INT) AS ts, CAST(length(pb) AS INT) AS te FROM c")
def codon_blocks(spark, sf_dir):
    """Blocks of the codon-aware alignment."""
    b = _aligned(spark, sf_dir)
    return b.select("key", "pa", "pb", F.size("blocks").alias("n_blocks"), *[F.col("blocks")[0][x].alias(x) for x in ("hs", "he", "ts", "te")])


@query(_SITES + " SELECT key, h_idx, h_base, t_base, aa_change FROM s WHERE h_base <> t_base")
def codon_diagnostic_sites(spark, sf_dir):
    """Differing places of aligned codons."""
    return A.codon_sites(_aligned(spark, sf_dir), "key").where("differs").select("key", "h_idx", "h_base", "t_base", "aa_change")


@query(_SITES + " SELECT key, count(*) FILTER (h_base = t_base) AS n_conserved, count(*) FILTER (h_base <> t_base) AS n_differing FROM s GROUP BY 1")
def conserved_sites(spark, sf_dir):
    """How many places are conserved."""
    return A.codon_sites(_aligned(spark, sf_dir), "key").groupBy("key").agg(F.count_if(~F.col("differs")).alias("n_conserved"), F.count_if("differs").alias("n_differing"))


@query(_SITES + " SELECT key, t_idx - 30 AS i, t_base AS base FROM s WHERE h_base <> t_base AND t_idx >= 30")
def continuation_sites(spark, sf_dir):
    """Differing places behind a prefix of 30 bases."""
    return A.continuation_sites(A.codon_sites(_aligned(spark, sf_dir), "key"), "key", 30)


@query(_PAIR + ", p AS (SELECT key, pa, unnest(range(30, 3 * length(pa))) AS i FROM c) SELECT key, CAST(i AS INT) AS h_idx, CAST(i AS INT) AS t_idx FROM p")
def context_places(spark, sf_dir):
    """Places with 30 bases of the same block before them."""
    return A.context_places(_aligned(spark, sf_dir), "key", 30)


_SAME = "len(list_filter(range(1, length(pa) + 1), lambda i: substr(pa, i, 1) = substr(pb, i, 1)))"


@query(_PAIR + f" SELECT key, CAST(1 AS INT) AS n_blocks, CAST(length(pa) AS INT) AS matched, 0.0::DOUBLE AS indel_frac, round({_SAME} / CAST(greatest(length(pa), 1) AS DOUBLE), 6) AS aa_identity FROM c")
def block_facts(spark, sf_dir):
    """E35."""
    return A.block_facts(_aligned(spark, sf_dir)).select("key", "n_blocks", "matched", "indel_frac", "aa_identity")


@query(_PAIR + " SELECT key, CASE WHEN length(pa) < 12 THEN 'indel_in_prefix' WHEN instr(substr(pa, 1, 12), '*') > 0 THEN 'stop_in_prefix_a' WHEN instr(substr(pb, 1, 12), '*') > 0 THEN 'stop_in_prefix_b' END AS reason FROM c")
def prefix_gate(spark, sf_dir):
    """Whether the first twelve codons can be a common prefix."""
    return A.prefix_gate(_aligned(spark, sf_dir), 12).select("key", "reason")


@query(_PAIR + ", w AS (SELECT key, length(pa) >= 12 AND instr(substr(pa, 1, 12), '*') = 0 AND instr(substr(pb, 1, 12), '*') = 0 AS ok FROM c) SELECT key, CASE WHEN ok THEN CAST(0 AS INT) END AS start_h, CASE WHEN ok THEN CAST(0 AS INT) END AS start_t, CASE WHEN NOT ok THEN 'window_starts_too_late' END AS reason FROM w")
def window_gate(spark, sf_dir):
    """The first block that can hold the prefix."""
    return A.window_gate(_aligned(spark, sf_dir), 12, 20).select("key", "start_h", "start_t", "reason")


_NT = f"WITH c AS (SELECT key, family, a, b FROM ({D.CLOSE_SQL})), p AS (SELECT key, a, b, unnest(range(0, length(a))) AS i FROM c), s AS (SELECT key, CAST(i AS INT) AS i, substr(a, i + 1, 1) AS h, substr(b, i + 1, 1) AS t FROM p)"


@query(_NT + " SELECT key, CAST(count(*) FILTER (h = t) AS DOUBLE) AS score, round(count(*) FILTER (h = t) / CAST(count(*) AS DOUBLE), 9) AS identity, CAST(0 AS INT) AS gap_places, coalesce(string_agg(CASE WHEN h <> t AND t IN ('A','C','G','T') THEN CAST(i AS VARCHAR) END, ',' ORDER BY i), '') AS sites FROM s GROUP BY 1")
def align_sites(spark, sf_dir):
    """One alignment a pair: score, identity and the places that differ."""
    x = A.sites(D.close_pairs(spark, sf_dir), "key", "a", "b")
    return x.select("key", "score", F.round("identity", 9).alias("identity"), "gap_places", F.array_join(F.col("sites").cast("array<string>"), ",").alias("sites"))


@query(_NT + " SELECT key, string_agg(CASE WHEN t IN ('A','C','G','T') THEN CAST(instr('ACGT', t) - 1 AS VARCHAR) ELSE '-1' END, ',' ORDER BY i) AS calls FROM s GROUP BY 1")
def called_bases(spark, sf_dir):
    """The base called at each place of the target."""
    return A.called_bases(D.close_pairs(spark, sf_dir), "key", "a", "b").select("key", F.array_join(F.col("calls").cast("array<string>"), ",").alias("calls"))


_MADE = _NT + f", f AS (SELECT key, {_protein('b', 'coalesce(' + _amino('c') + chr(44) + chr(39) + 'X' + chr(39) + ')')} AS qb, {_protein('a', 'coalesce(' + _amino('c') + chr(44) + chr(39) + 'X' + chr(39) + ')')} AS qa, length(a) AS n FROM c)"


@query(_MADE + """, m AS (SELECT key, count(*) FILTER (h = t) AS matches, count(*) AS n FROM s GROUP BY 1)
 SELECT f.key, CAST(f.n AS INT) AS columns, CAST(matches AS INT) AS matches, CAST(0 AS INT) AS indel_bp, round(100 * matches / CAST(m.n AS DOUBLE), 6) AS nt_identity,
 round(100 * len(list_filter(range(1, length(qa) + 1), lambda i: substr(qa, i, 1) = substr(qb, i, 1))) / CAST(length(qa) AS DOUBLE), 6) AS aa_identity,
 CAST(length(qb) - length(replace(qb, '*', '')) AS INT) AS n_stops, instr(substr(qb, 1, length(qb) - 1), '*') > 0 AS premature_stop FROM f JOIN m USING (key)""")
def generation_scores(spark, sf_dir):
    """A made sequence against its target."""
    x = A.generation_scores(D.close_pairs(spark, sf_dir), "key", "b", "a")
    return x.select("key", "columns", "matches", "indel_bp", F.round("nt_identity", 6).alias("nt_identity"), F.round("aa_identity", 6).alias("aa_identity"), "n_stops", "premature_stop")


_VOTE = ", g AS (SELECT key, key // 10 AS grp FROM c), o AS (SELECT DISTINCT x.key, s.i, s.t FROM g x JOIN g y ON x.grp = y.grp AND x.key <> y.key JOIN s ON s.key = y.key)"


@query(_NT + _VOTE + """, d AS (SELECT key, i, h AS base, (key, i, h) IN (SELECT (key, i, t) FROM o) AS shared FROM s WHERE h <> t AND h IN ('A','C','G','T')),
 made AS (SELECT key, i, CASE WHEN i % 2 = 0 THEN h ELSE t END AS m FROM s)
 SELECT c.key, count(d.i) AS n_diagnostic, round(100 * avg((m = base)::INT), 6) AS pct_diagnostic, count(d.i) FILTER (NOT shared) AS n_private, round(100 * avg((m = base)::INT) FILTER (NOT shared), 6) AS pct_private FROM c LEFT JOIN d ON d.key = c.key LEFT JOIN made ON made.key = d.key AND made.i = d.i GROUP BY 1""")
def two_site_sets(spark, sf_dir):
    """Recovery of two sets of sites from one alignment: all differing places, and those
    whose target base no other key of the group shows."""
    p = dealt(D.close_pairs(spark, sf_dir).select("key", "a", "b", F.expr("key DIV 10").alias("grp")), "grp")
    made = p.withColumn("m", F.expr("array_join(transform(zip_with(split(a, ''), split(b, ''), (x, y) -> struct(x, y)), (s, i) -> CASE WHEN i % 2 = 0 THEN s.x ELSE s.y END), '')"))
    diagnostic = S.differing(p, "key", "b", "a", "grp").where("p IN ('A', 'C', 'G', 'T')")  # the target's base is p
    alone = S.with_others(diagnostic, S.shown(p, "b", "key", "grp"), "key", "grp")
    calls = A.called_bases(made, "key", "a", "m")
    out = A.site_set_hits(calls, alone.withColumnRenamed("p", "base"), "key", {"diagnostic": F.lit(True), "private": ~F.col("shared")})
    return out.select("key", "n_diagnostic", F.round("pct_diagnostic", 6).alias("pct_diagnostic"), "n_private", F.round("pct_private", 6).alias("pct_private"))


@query(f"WITH l AS (SELECT key, cds FROM ({D.LOCI_SQL})) SELECT key, CAST(3 AS INT) AS first, CAST(3 + length(cds) + 20 - 1 AS INT) AS last, CAST(length(cds) AS INT) AS n, CASE WHEN key % 13 = 0 THEN 'MISMATCH' ELSE 'ok' END AS status FROM l")
def coding_masks(spark, sf_dir):
    """Places of a spliced sequence in its span, with their status."""
    x = D.loci(spark, sf_dir)
    span = F.expr("concat('NNN', substr(cds, 1, 48), repeat('N', 20), substr(cds, 49), 'NN')")
    x = x.select("key", "cds", span.alias("span"), F.when(F.col("key") % 13 == 0, 1).otherwise(F.length("cds")).alias("expected"), F.length(span).alias("span_length"))
    found = A.masks(x, "key", "span", "cds").join(x.select("key", "expected", "span_length"), "key")
    return found.select("key", F.col("places")[0].alias("first"), F.element_at("places", -1).alias("last"), F.size("places").alias("n"), S.place_status("span_length", "places", "expected").alias("status"))


@query(f"""WITH p AS (SELECT key, unnest(range(1, length(a) + 1)) AS i, a, b FROM ({D.CLOSE_SQL})), s AS (SELECT key, substr(a, i, 1) AS h, substr(b, i, 1) AS y, substr(CASE WHEN i % 3 = 0 THEN a ELSE b END, i, 1) AS p, i % 3 = 1 AS votes FROM p),
 c AS (SELECT *, CASE WHEN y IN ('G','C') AND h NOT IN ('G','C') THEN 'up' WHEN h IN ('G','C') AND y NOT IN ('G','C') THEN 'down' ELSE 'neutral' END AS cls FROM s)
 SELECT key, count(*) FILTER (h <> y) AS n_sites, count(*) FILTER (h <> y AND votes) AS n_consensus, round((count(*) FILTER (h <> y AND p = y)) / nullif(CAST(count(*) FILTER (h <> y) AS DOUBLE), 0), 6) AS a_all, round((count(*) FILTER (h <> y AND votes AND p = y)) / nullif(CAST(count(*) FILTER (h <> y AND votes) AS DOUBLE), 0), 6) AS a_consensus,
 round((count(*) FILTER (h <> y AND cls = 'up' AND p = y)) / nullif(CAST(count(*) FILTER (h <> y AND cls = 'up') AS DOUBLE), 0), 6) AS rate_up, round((count(*) FILTER (h <> y AND cls = 'down' AND p = y)) / nullif(CAST(count(*) FILTER (h <> y AND cls = 'down') AS DOUBLE), 0), 6) AS rate_down FROM c GROUP BY 1""")
def site_rates(spark, sf_dir):
    """Rates on differing sites, on those with a consensus, and by GC class."""
    from strandline.functions import sequences as Seq

    x = D.close_pairs(spark, sf_dir).select("key", F.explode(F.expr("transform(sequence(1, length(a)), i -> struct(substr(a, i, 1) AS h, substr(b, i, 1) AS y, substr(CASE WHEN i % 3 = 0 THEN a ELSE b END, i, 1) AS p, i % 3 = 1 AS votes))")).alias("s")).select("key", "s.*")
    x = x.withColumn("cls", F.expr(Seq.gc_class("h", "y"))).withColumn("hit", F.col("p") == F.col("y"))
    n = lambda c: F.count_if(F.expr(f"h <> y AND {c}"))
    rate = lambda c: F.round(F.try_divide(n(f"{c} AND hit"), n(c)), 6)
    return x.groupBy("key").agg(n("true").alias("n_sites"), n("votes").alias("n_consensus"), rate("true").alias("a_all"), rate("votes").alias("a_consensus"), rate("cls = 'up'").alias("rate_up"), rate("cls = 'down'").alias("rate_down"))
