"""Queries of alignments with gaps, over pairs whose best alignment is known by construction
(derived.GAPPED): SQL states blocks, sites, calls and gates from the planted lengths."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import align as A
from strandline.plans import derived as D
from strandline.plans.codon_queries import _trim
from strandline.plans.sequence_queries import _amino, _protein

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Blocks in codons of a (hs, he) and b (ts, te); none where b is empty.
_B = f"""WITH g AS (SELECT *, {_trim('a')} AS pa, {_trim('b')} AS pb FROM ({D.GAPPED_SQL})),
 b AS (SELECT key, 1 AS n, lead AS hs, lead + n1 + 2 AS he, 0 AS ts, n1 + 2 AS te FROM g WHERE c <> 7
   UNION ALL SELECT key, 2, lead + n1 + 2 + l1, lead + n1 + 2 + l1 + n2 + 2, n1 + 2, n1 + 2 + n2 + 2 FROM g WHERE c <> 7
   UNION ALL SELECT key, 3, lead + n1 + 2 + l1 + n2 + 2, lead + n1 + 2 + l1 + n2 + 2 + 1 + n3, n1 + 2 + n2 + 2 + l2, n1 + 2 + n2 + 2 + l2 + 1 + n3 FROM g WHERE c <> 7),
 k AS (SELECT key, hs + i AS h, ts + i AS t, i AS k FROM (SELECT key, hs, ts, unnest(range(0, he - hs)) AS i FROM b)),
 s AS (SELECT key, k, CAST(3 * h + o AS INT) AS h_idx, CAST(3 * t + o AS INT) AS t_idx, substr(a, CAST(3 * h + o + 1 AS BIGINT), 1) AS h_base, substr(b, CAST(3 * t + o + 1 AS BIGINT), 1) AS t_base, substr(pa, h + 1, 1) <> substr(pb, t + 1, 1) AS aa_change FROM k JOIN g USING (key), (SELECT unnest([0, 1, 2]) AS o)),
 d AS (SELECT * FROM s WHERE h_base IN ('A','C','G','T') AND t_base IN ('A','C','G','T'))"""


def _aligned(spark, sf_dir):
    return A.codon_blocks(D.gapped_pairs(spark, sf_dir), "key", "a", "b")


@query(_B + " SELECT g.key, coalesce(string_agg(hs || '-' || he || ':' || ts || '-' || te, ' ' ORDER BY n), '') AS blocks FROM g LEFT JOIN b USING (key) GROUP BY 1")
def gapped_codon_blocks(spark, sf_dir):
    """All blocks of codon-aware alignments with gaps."""
    text = F.expr("array_join(transform(blocks, b -> concat(b.hs, '-', b.he, ':', b.ts, '-', b.te)), ' ')")
    return _aligned(spark, sf_dir).select("key", text.alias("blocks"))


@query(_B + " SELECT key, h_idx, t_idx, h_base, t_base, aa_change, h_base <> t_base AS differs FROM d")
def gapped_codon_sites(spark, sf_dir):
    """Places of aligned codons on both sides of gaps."""
    return A.codon_sites(_aligned(spark, sf_dir), "key")


@query(_B + " SELECT key, t_idx - 36 AS i, t_base AS base FROM d WHERE h_base <> t_base AND t_idx >= 36")
def gapped_continuation_sites(spark, sf_dir):
    """Differing places behind a prefix of 36 bases."""
    return A.continuation_sites(A.codon_sites(_aligned(spark, sf_dir), "key"), "key", 36)


@query(_B + " SELECT key, h_idx, t_idx FROM s WHERE k >= 10")
def gapped_context_places(spark, sf_dir):
    """Places with 30 bases of their own block before them, in every block."""
    return A.context_places(_aligned(spark, sf_dir), "key", 30)


@query(_B + """ SELECT g.key, CAST(count(b.n) AS INT) AS n_blocks, CAST(coalesce(sum(he - hs), 0) AS INT) AS matched, round(1 - coalesce(sum(he - hs), 0) / CAST(greatest(length(any_value(pa)), length(any_value(pb))) AS DOUBLE), 6) AS indel_frac,
 (SELECT round(count(*) FILTER (substr(x.pa, h + 1, 1) = substr(x.pb, t + 1, 1)) / CAST(greatest(count(h), 1) AS DOUBLE), 6) FROM g x LEFT JOIN k USING (key) WHERE x.key = g.key) AS aa_identity FROM g LEFT JOIN b USING (key) GROUP BY 1""")
def gapped_block_facts(spark, sf_dir):
    """Numbers of blocks and matched codons, share of gaps, identity."""
    return A.block_facts(_aligned(spark, sf_dir)).select("key", "n_blocks", "matched", "indel_frac", "aa_identity")


@query(_B + """ SELECT key, CASE WHEN c = 7 THEN 'no_alignment' WHEN lead > 0 THEN 'prefix_not_homologous' WHEN n1 + 2 < 12 THEN 'indel_in_prefix'
 WHEN instr(substr(pa, 1, 12), '*') > 0 THEN 'stop_in_prefix_a' WHEN instr(substr(pb, 1, 12), '*') > 0 THEN 'stop_in_prefix_b' END AS reason FROM g""")
def gapped_prefix_gate(spark, sf_dir):
    """Every reason against a common prefix of twelve codons."""
    return A.prefix_gate(_aligned(spark, sf_dir), 12).select("key", "reason")


@query(_B + """, fit AS (SELECT key, hs, ts, he - hs >= 12 AS long, he - hs >= 12 AND hs <= 20 AND instr(substr(pa, hs + 1, 12), '*') = 0 AND instr(substr(pb, ts + 1, 12), '*') = 0 AS ok FROM b JOIN g USING (key))
 SELECT g.key, CAST(min(hs) FILTER (ok) AS INT) AS start_h, CAST(min(ts) FILTER (ok) AS INT) AS start_t, CASE WHEN c = 7 THEN 'no_alignment' WHEN NOT bool_or(long) THEN 'no_indel_free_window' WHEN NOT bool_or(ok) THEN 'window_starts_too_late' END AS reason FROM g LEFT JOIN fit USING (key) GROUP BY g.key, c""")
def gapped_window_gate(spark, sf_dir):
    """The first block, by codon 20, that can hold the prefix; it may be the second one."""
    return A.window_gate(_aligned(spark, sf_dir), 12, 20).select("key", "start_h", "start_t", "reason")


#: Columns of the alignment of bases: the blocks with the stop, and the gaps between.
_N = _B + """, m AS (SELECT key, h_idx AS h, t_idx AS t FROM s UNION ALL SELECT key, 3 * (lead + n1 + l1 + n2 + n3 + 5) + o, 3 * (n1 + n2 + l2 + n3 + 5) + o FROM g, (SELECT unnest([0, 1, 2]) AS o) WHERE c <> 7),
 p AS (SELECT key, h, t, substr(a, CAST(h + 1 AS BIGINT), 1) AS x, substr(b, CAST(t + 1 AS BIGINT), 1) AS y FROM m JOIN g USING (key)),
 r AS (SELECT key, count(*) AS paired, count(*) FILTER (x = y) AS same FROM p GROUP BY 1),
 w AS (SELECT key, length(a) + length(b) - 2 * coalesce(paired, 0) AS gap_places, CASE WHEN c = 7 THEN 1 ELSE 2 + (lead > 0)::INT + (key % 13 = 0)::INT END AS gap_runs, coalesce(same, 0) AS same, coalesce(paired, 0) AS paired FROM g LEFT JOIN r USING (key))"""


@query(_N + """ SELECT key, CAST(same - 1.5 * gap_runs - 0.5 * gap_places AS DOUBLE) AS score, round(same / nullif(CAST(paired AS DOUBLE), 0), 9) AS identity, CAST(gap_places AS INT) AS gap_places, CAST(gap_runs AS INT) AS gap_runs,
 (SELECT coalesce(string_agg(CAST(h AS VARCHAR), ',' ORDER BY h), '') FROM p WHERE p.key = w.key AND x <> y AND y IN ('A','C','G','T')) AS sites FROM w""")
def gapped_sites(spark, sf_dir):
    """Scores, gap places and runs, and differing places of nucleotide alignments."""
    x = A.sites(D.gapped_pairs(spark, sf_dir), "key", "a", "b")
    return x.select("key", "score", F.round("identity", 9).alias("identity"), "gap_places", "gap_runs", F.array_join(F.col("sites").cast("array<string>"), ",").alias("sites"))


@query(_N + ", q AS (SELECT key, unnest(range(0, length(a))) AS i FROM g) SELECT q.key, string_agg(CASE WHEN y IN ('A','C','G','T') THEN CAST(instr('ACGT', y) - 1 AS VARCHAR) ELSE '-1' END, ',' ORDER BY i) AS calls FROM q LEFT JOIN p ON p.key = q.key AND p.h = q.i GROUP BY 1")
def gapped_calls(spark, sf_dir):
    """The base called at each place of the target, -1 in its gaps and at N."""
    return A.called_bases(D.gapped_pairs(spark, sf_dir), "key", "a", "b").select("key", F.array_join(F.col("calls").cast("array<string>"), ",").alias("calls"))


_STOP_AA = lambda s: _protein(s, "coalesce(" + _amino("c") + ", 'X')")


@query(_N + f""", f AS (SELECT key, {_STOP_AA('b')} AS qb FROM g)
 SELECT key, CASE WHEN c <> 7 THEN CAST(paired + gap_places AS INT) END AS columns, CASE WHEN c <> 7 THEN CAST(same AS INT) END AS matches, CASE WHEN c <> 7 THEN CAST(gap_places AS INT) END AS indel_bp, CASE WHEN c <> 7 THEN CAST(gap_runs AS INT) END AS indel_events,
 CASE WHEN c <> 7 THEN round(100 * same / CAST(paired + gap_places AS DOUBLE), 6) END AS nt_identity, CASE WHEN c <> 7 THEN CAST(length(qb) - length(replace(qb, '*', '')) AS INT) END AS n_stops, CASE WHEN c <> 7 THEN instr(substr(qb, 1, length(qb) - 1), '*') > 0 END AS premature_stop FROM w JOIN g USING (key) JOIN f USING (key)""")
def gapped_generation_scores(spark, sf_dir):
    """Made sequences with insertions and deletions against their target."""
    x = A.generation_scores(D.gapped_pairs(spark, sf_dir), "key", "b", "a")
    return x.select("key", "columns", "matches", "indel_bp", "indel_events", F.round("nt_identity", 6).alias("nt_identity"), "n_stops", "premature_stop")


@query(_N + """, f AS (SELECT key, h AS i, x AS base, h % 2 = 0 AS first FROM p WHERE x <> y AND x IN ('A','C','G','T')), gone AS (SELECT key, n1 * 3 + 6 + lead * 3 + j AS i, 'TGG' AS t, j % 3 AS o FROM (SELECT key, n1, lead, unnest(range(0, 3 * l1)) AS j FROM g WHERE c <> 7)),
 want AS (SELECT key, i, base, first FROM f UNION ALL SELECT key, i, substr('TGG', CAST(o + 1 AS BIGINT), 1), true FROM gone)
 SELECT g.key, count(w.i) AS n_all, round(100 * avg(CASE WHEN w.i IS NOT NULL THEN CASE WHEN p.y = w.base THEN 1 ELSE 0 END END), 6) AS pct_all, count(w.i) FILTER (first) AS n_first, round(100 * avg(CASE WHEN p.y = w.base THEN 1 ELSE 0 END) FILTER (first), 6) AS pct_first FROM g LEFT JOIN want w USING (key) LEFT JOIN p ON p.key = w.key AND p.h = w.i GROUP BY 1""")
def gapped_site_sets(spark, sf_dir):
    """Recovery of two sets of sites read off one alignment with gaps; sites that the
    made sequence lacks are missed, not left out."""
    p = D.gapped_pairs(spark, sf_dir)
    differing = A.sites(p, "key", "a", "b").select("key", F.explode("sites").alias("i")).join(p.select("key", "a").hint("merge"), "key").select("key", "i", F.expr("substr(a, i + 1, 1)").alias("base")).where("base IN ('A', 'C', 'G', 'T')")
    lacking = p.where("c <> 7").select("key", F.explode(F.expr("transform(sequence(0, 3 * l1 - 1), j -> struct(3 * (lead + n1 + 2) + j AS i, substr('TGG', CAST(j % 3 + 1 AS INT), 1) AS base))")).alias("s")).select("key", F.col("s.i").cast("int").alias("i"), "s.base")
    calls = A.called_bases(p, "key", "a", "b")
    wanted = differing.withColumn("first", F.col("i") % 2 == 0).unionByName(lacking.withColumn("first", F.lit(True)))
    out = A.site_set_hits(calls, wanted, "key", {"all": F.lit(True), "first": F.col("first")})
    return out.select("key", "n_all", F.round("pct_all", 6).alias("pct_all"), "n_first", F.round("pct_first", 6).alias("pct_first"))
