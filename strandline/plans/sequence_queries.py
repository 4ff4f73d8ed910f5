"""Queries over sequences (functions of strandline.functions.sequences)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import sequences as S
from strandline.operators import kmers
from strandline.plans import derived as D

E = F.expr
Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_AT = "(instr('TCAG', substr({c}, {n}, 1)) - 1)"


def _amino(c: str) -> str:
    at = lambda n: _AT.format(c=c, n=n)
    return f"(CASE WHEN length({c}) = 3 AND translate({c}, 'ACGT', '') = '' THEN substr('{S.CODE}', CAST(16 * {at(1)} + 4 * {at(2)} + {at(3)} + 1 AS BIGINT), 1) END)"


def _codons(s: str) -> str:
    return f"list_transform(range(1, length({s}) - 1, 3), lambda i: substr({s}, i, 3))"


def _protein(s: str, each: str) -> str:
    return f"array_to_string(list_transform({_codons(s)}, lambda c: {each}), '')"


_STOPS = _protein("cds", f"coalesce({_amino('c')}, 'X')")
_n = lambda s, x: f"(length({s}) - length(translate({s}, '{x}', '')))"
_third = lambda s, k: f"array_to_string(list_transform(range({k}, length({s}) + 1, 3), lambda i: substr({s}, i, 1)), '')"
_valid = lambda s: f"(CAST({_n(s, 'GC')} AS DOUBLE) / nullif({_n(s, 'ACGT')}, 0))"


@query(f"""SELECT key, {_protein('cds', f"coalesce(nullif({_amino('c')}, '*'), 'X')")} AS plain, {_STOPS} AS stops,
  {_STOPS} AS masked, regexp_replace({_STOPS}, '[*]$', '') AS trimmed FROM ({D.LOCI_SQL})""")
def translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four translations."""
    return D.loci(spark, sf_dir).select("key", E(S.translate_plain("cds")).alias("plain"), E(S.translate_stops("cds")).alias("stops"), E(S.translate_masked("cds")).alias("masked"), E(S.translate_trimmed("cds")).alias("trimmed"))


@query(f"SELECT key, reverse(translate(cds, 'ACGT', 'TGCA')) AS rc FROM ({D.LOCI_SQL})")
def revcomp(spark, sf_dir):
    """E2."""
    return D.loci(spark, sf_dir).select("key", E(S.reverse_complement("cds")).alias("rc"))


@query(f"""SELECT key, round({_valid('cds')}, 9) AS gc, round({_n('cds', 'GC')} / CAST(greatest(1, length(cds)) AS DOUBLE), 9) AS gc_full,
  round({_n(_third('cds', 3), 'GC')} / CAST(greatest(1, length({_third('cds', 3)})) AS DOUBLE), 9) AS gc3,
  round(100 * {_valid(_third('cds', 3))}, 9) AS gc3_percent FROM ({D.LOCI_SQL})""")
def gc_variants(spark, sf_dir):
    """E3-E6."""
    return D.loci(spark, sf_dir).select("key", *[F.round(E(x), 9).alias(n) for n, x in (("gc", S.gc_valid("cds")), ("gc_full", S.gc_length("cds")), ("gc3", S.gc3_fraction("cds")), ("gc3_percent", S.gc3_percent("cds")))])


_WHOLE = "substr(cds, 1, CAST(floor(length(cds) / 3) * 3 AS BIGINT))"


@query(f"SELECT key, {', '.join(f'round(100 * {_valid(_third(_WHOLE, k))}, 9) AS gc{k}' for k in (1, 2, 3))} FROM ({D.LOCI_SQL})")
def gc_by_position(spark, sf_dir):
    """E7."""
    return D.loci(spark, sf_dir).select("key", *[F.round(E(S.gc_position_percent("cds", k)), 9).alias(f"gc{k}") for k in (1, 2, 3)])


@query(f"""WITH p AS (SELECT key, unnest(range(1, length(a) + 1)) AS i, a, b FROM ({D.PAIRS_SQL})),
 x AS (SELECT substr(a, i, 1) AS h, substr(b, i, 1) AS p FROM p WHERE substr(a, i, 1) <> substr(b, i, 1))
 SELECT CASE WHEN p IN ('G','C') AND h NOT IN ('G','C') THEN 'up' WHEN h IN ('G','C') AND p NOT IN ('G','C') THEN 'down' ELSE 'neutral' END AS gc_class, count(*) AS n FROM x GROUP BY 1""")
def gc_class(spark, sf_dir):
    """E8 over all differing sites."""
    sites = D.pairs(spark, sf_dir).select(F.explode(E("transform(sequence(1, length(a)), i -> struct(substr(a, i, 1) AS h, substr(b, i, 1) AS p))")).alias("s")).select("s.*").where("h <> p")
    return sites.groupBy(E(S.gc_class("h", "p")).alias("gc_class")).agg(F.count("*").alias("n"))


@query(f"""SELECT key, round({_n('cds', 'N')} / CAST(length(cds) AS DOUBLE), 9) AS n_frac,
  coalesce(list_max(list_transform(regexp_extract_all(cds, '(N+)', 1), lambda r: length(r))), 0) AS max_n_run FROM ({D.LOCI_SQL})""")
def n_run(spark, sf_dir):
    """E13."""
    return D.loci(spark, sf_dir).select("key", F.round(E(f"{S.count_of('cds', 'N')} / CAST(length(cds) AS DOUBLE)"), 9).alias("n_frac"), E(S.longest_run("cds")).cast("long").alias("max_n_run"))


_HAM = "len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1)))"


@query(f"""SELECT key, {_HAM} AS hamming, round(1 - {_HAM} / CAST(least(length(a), length(b)) AS DOUBLE), 9) AS pos_identity,
  round(1 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE), 9) AS edit_identity,
  round({' + '.join(f"({_n('a', x)} / CAST(length(a) AS DOUBLE)) * ({_n('b', x)} / CAST(length(b) AS DOUBLE))" for x in 'ACGT')}, 9) AS chance_identity,
  round(1 - len(list_filter(range(1, length(a) // 3 + 1), lambda i: substr({_protein('a', f"coalesce({_amino('c')}, 'X')")}, i, 1) <> substr({_protein('b', f"coalesce({_amino('c')}, 'X')")}, i, 1))) / CAST(length(a) // 3 AS DOUBLE), 9) AS aa_identity
  FROM ({D.PAIRS_SQL})""")
def pair_identity(spark, sf_dir):
    """E14, E15."""
    p = D.pairs(spark, sf_dir).withColumn("pa", E(S.translate_stops("a"))).withColumn("pb", E(S.translate_stops("b")))
    return p.select("key", E(S.hamming("a", "b")).cast("long").alias("hamming"), *[F.round(E(x), 9).alias(n) for n, x in (("pos_identity", S.positional_identity("a", "b")), ("edit_identity", S.edit_identity("a", "b")), ("chance_identity", S.chance_identity("a", "b")), ("aa_identity", S.positional_identity("pa", "pb")))])


_KMERS = f"""WITH s AS (SELECT key, family, substr(cds, i, 4) AS kmer FROM (SELECT key, family, cds, unnest(range(1, length(cds) - 2)) AS i FROM ({D.LOCI_SQL}))),
 c AS (SELECT key, family, kmer, count(*) AS n FROM s WHERE regexp_full_match(kmer, '[ACGT]{{4}}') GROUP BY 1, 2, 3),
 f AS (SELECT key, family, kmer, n, n / CAST(sum(n) OVER (PARTITION BY key) AS DOUBLE) AS freq FROM c)"""


@query(_KMERS + " SELECT key, kmer, round(freq, 9) AS freq FROM f")
def kmer_freq(spark, sf_dir):
    """Relative frequencies of k-mers without gaps or N."""
    return kmers.frequencies(D.loci(spark, sf_dir), "key", "cds", 4).select("key", "kmer", F.round("freq", 9).alias("freq"))


@query(_KMERS + """, n AS (SELECT family, key, sqrt(sum(freq * freq)) AS norm FROM f GROUP BY 1, 2)
 SELECT x.family, x.key AS a, y.key AS b, round(1 - least(1, greatest(-1, coalesce(d.dot, 0) / (x.norm * y.norm))), 7) AS distance
 FROM n x JOIN n y ON x.family = y.family AND x.key < y.key LEFT JOIN (SELECT p.key AS a, q.key AS b, sum(p.freq * q.freq) AS dot FROM f p JOIN f q ON p.family = q.family AND p.kmer = q.kmer AND p.key < q.key GROUP BY 1, 2) d ON d.a = x.key AND d.b = y.key""")
def kmer_distance(spark, sf_dir):
    """Cosine distances within each family."""
    return kmers.sequence_distances(D.loci(spark, sf_dir), "key", "family", "cds", 4).select("family", "a", "b", F.round("distance", 7).alias("distance"))


_CODON = f"WITH c AS (SELECT key, family, unnest({_codons('cds')}) AS codon FROM ({D.LOCI_SQL})), s AS (SELECT *, {_amino('codon')} AS aa FROM c)"


@query(_CODON + " SELECT family, aa, codon, count(*) AS n FROM s WHERE aa IS NOT NULL AND aa <> '*' GROUP BY 1, 2, 3")
def codon_usage(spark, sf_dir):
    """Codon counts of families by amino acid."""
    return kmers.codon_usage(D.loci(spark, sf_dir), "family", "cds")


@query(_CODON + ", k AS (SELECT key, codon, count(*) AS n FROM s WHERE aa <> '*' GROUP BY 1, 2) SELECT key, codon, round(n / CAST(sum(n) OVER (PARTITION BY key) AS DOUBLE), 9) AS freq FROM k")
def codon_freq(spark, sf_dir):
    """Relative frequencies of the sense codons."""
    return kmers.codon_frequencies(D.loci(spark, sf_dir), "key", "cds").select("key", "codon", F.round("freq", 9).alias("freq"))


@query(_CODON + """, k AS (SELECT family, codon, count(*) AS n FROM s WHERE aa <> '*' GROUP BY 1, 2), f AS (SELECT family, codon, n / CAST(sum(n) OVER (PARTITION BY family) AS DOUBLE) AS p FROM k),
 m AS (SELECT x.family AS a, y.family AS b, sum(CASE WHEN x.codon = y.codon THEN 0 END) FROM f x JOIN f y ON x.family < y.family GROUP BY 1, 2),
 g AS (SELECT m.a, m.b, c.codon, coalesce(x.p, 0) AS p, coalesce(y.p, 0) AS q FROM m CROSS JOIN (SELECT DISTINCT codon FROM f) c LEFT JOIN f x ON x.family = m.a AND x.codon = c.codon LEFT JOIN f y ON y.family = m.b AND y.codon = c.codon)
 SELECT a, b, round(sum(CASE WHEN p > 0 THEN 0.5 * p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(2 * q / (p + q)) ELSE 0 END), 7) AS jsd FROM g GROUP BY 1, 2""")
def jsd_codon(spark, sf_dir):
    """Divergence of families' codon frequencies in bits."""
    return kmers.codon_divergence(D.loci(spark, sf_dir), "family", "cds").select("a", "b", F.round("jsd", 7).alias("jsd"))


_SYN = "(" + " + ".join(f"CASE WHEN substr(codon, {p}, 1) <> '{b}' AND " + _amino(f"(substr(codon, 1, {p - 1}) || '{b}' || substr(codon, {p + 1}))") + " = aa THEN 1 ELSE 0 END" for p in (1, 2, 3) for b in "ACGT") + ") / CAST(3 AS DOUBLE)"


@query(_CODON + f" SELECT DISTINCT codon, aa, round({_SYN}, 9) AS syn_sites FROM s WHERE aa <> '*'")
def syn_sites(spark, sf_dir):
    """Synonymous sites of the codons in use."""
    seen = D.loci(spark, sf_dir).select(F.explode(E(S.codons("cds"))).alias("codon")).distinct().withColumn("aa", E(S.amino("codon"))).where("aa <> '*'")
    return seen.select("codon", "aa", F.round(E(S.synonymous_sites("codon")), 9).alias("syn_sites"))


@query(f"""WITH c AS (SELECT key, unnest({_codons('a')}) AS codon, unnest({_codons('b')}) AS other FROM ({D.PAIRS_SQL})),
 s AS (SELECT *, {_amino('codon')} AS aa, {_amino('other')} AS ab, (substr(codon,1,1) <> substr(other,1,1))::INT + (substr(codon,2,1) <> substr(other,2,1))::INT + (substr(codon,3,1) <> substr(other,3,1))::INT AS d FROM c),
 t AS (SELECT *, {_SYN} AS sites FROM s WHERE aa <> '*' AND ab <> '*'),
 u AS (SELECT key, count(*) AS n_codons, sum(sites) AS s_sites, 3.0 * count(*) - sum(sites) AS n_sites, sum(CASE WHEN d = 1 AND aa = ab THEN 1 ELSE 0 END) AS sd, sum(CASE WHEN d = 1 AND aa <> ab THEN 1 ELSE 0 END) AS nd FROM t GROUP BY key HAVING count(*) >= 15)
 SELECT key, n_codons, CAST(sd AS BIGINT) AS sd, CAST(nd AS BIGINT) AS nd, round(sd / s_sites, 7) AS ps, round(nd / n_sites, 7) AS pn, round((nd / n_sites) / nullif(sd / s_sites, 0), 7) AS pn_ps FROM u""")
def codon_diff(spark, sf_dir):
    """Synonymous and other single-base differences of ungapped pairs."""
    return kmers.codon_differences(D.pairs(spark, sf_dir), "key", "a", "b").select("key", "n_codons", "sd", "nd", *[F.round(c, 7).alias(c) for c in ("ps", "pn", "pn_ps")])
