"""Inputs of the registered queries, derived from the driver's tables (no genomes here).

Each derivation exists as a DataFrame and as DuckDB SQL with the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dna(key: str, chunks: int) -> str:
    """32 bases a chunk from an md5; the same text in both engines."""
    return " || ".join(f"translate(md5(CAST({key} AS {{text}}) || ':{i}'), '0123456789abcdef', 'ACGTACGTACGTACGT')" for i in range(chunks))


LOCI = f"""
SELECT p_partkey AS key, p_brand AS family, 'sp' || CAST(p_size % 12 AS {{text}}) AS species, p_size, p_retailprice,
  CASE WHEN p_partkey % 7 = 0 THEN 'ATG' || 'NNNNNN' || substr(x, 7) || 'TAA'
       WHEN p_partkey % 11 = 0 THEN 'ATG' || substr(x, 1, 60) || 'TAAC'
       WHEN p_partkey % 13 = 0 THEN 'CTG' || x || 'TAA' ELSE 'ATG' || x || 'TAA' END AS cds
FROM (SELECT *, {_dna('p_partkey', 3)} AS x FROM part) d
"""

#: A second sequence for each key that differs at about a quarter of the places.
PAIRS = f"""
SELECT key, family, cds AS a,
  'ATG' || array_join_chars AS b FROM (
  SELECT key, family, cds, {{pick}} AS array_join_chars FROM ({LOCI}) l) q
"""

#: A copy that differs at isolated places only (no two within twelve): any alignment that
#: opens gaps scores less than the one without.
CLOSE = f"""
SELECT key, family, cds AS a, {{close}} AS b FROM ({LOCI}) l
"""
_SPARK_CLOSE = "array_join(transform(sequence(1, length(cds)), i -> CASE WHEN i % 13 = 5 AND ascii(substr(md5(CAST(key AS STRING) || 'c' || CAST(i AS STRING)), 1, 1)) < 54 THEN translate(substr(cds, i, 1), 'ACGT', 'CGTA') ELSE substr(cds, i, 1) END), '')"
_DUCK_CLOSE = "array_to_string(list_transform(range(1, length(cds) + 1), lambda i: CASE WHEN i % 13 = 5 AND ascii(substr(md5(CAST(key AS VARCHAR) || 'c' || CAST(i AS VARCHAR)), 1, 1)) < 54 THEN translate(substr(cds, i, 1), 'ACGT', 'CGTA') ELSE substr(cds, i, 1) END), '')"

_SPARK_PICK = "array_join(transform(sequence(4, length(cds)), i -> CASE WHEN ascii(substr(md5(CAST(key AS STRING) || 'm' || CAST(i AS STRING)), 1, 1)) < 52 THEN substr('ACGT', 1 + CAST(i % 4 AS INT), 1) ELSE substr(cds, i, 1) END), '')"
_DUCK_PICK = "array_to_string(list_transform(range(4, length(cds) + 1), lambda i: CASE WHEN ascii(substr(md5(CAST(key AS VARCHAR) || 'm' || CAST(i AS VARCHAR)), 1, 1)) < 52 THEN substr('ACGT', CAST(1 + i % 4 AS INT), 1) ELSE substr(cds, i, 1) END), '')"

#: Pairs with planted gaps of whole codons: TGG runs in one sequence only, between GCT and AAA
#: in both, so that a gap can't be moved without losing matches, and stretches of shared
#: codons long enough that one gap can't pay for two. Eight kinds (c): three blocks; a short
#: first block; short blocks only; a late second block; codons before the start; a stop early
#: in a or in b; an empty b. Lengths are in codons: shared n1, n2, n3, only in a l1, only in b
#: l2, before a lead. Some hold N, some end in a part of a codon.
GAPPED = f"""
SELECT key, family, c, n1, l1, n2, l2, n3, lead,
  repeat('TGG', lead) || 'ATG' || CASE WHEN c = 5 THEN substr(s1, 1, 24) || 'TAA' || substr(s1, 28) ELSE s1 END || 'GCT' || repeat('TGG', l1) || 'AAA' || s2 || 'GCT' || 'AAA' || s3 || 'TAA' || CASE WHEN key % 13 = 0 THEN 'C' ELSE '' END AS a,
  CASE WHEN c = 7 THEN '' ELSE 'ATG' || CASE WHEN c = 6 THEN substr(s1, 1, 24) || 'TAA' || substr(s1, 28) WHEN c = 5 THEN s1 ELSE {{differ_s1}} END || 'GCT' || 'AAA' || {{differ_s2}} || 'GCT' || repeat('TGG', l2) || 'AAA' || {{differ_s3}} || 'TAA' END AS b
FROM (SELECT *, substr(x, 1, 3 * n1) AS s1, substr(x, 61, 3 * n2) AS s2, CASE WHEN key % 11 = 0 THEN 'NNN' || substr(x, 124, 3 * n3 - 3) ELSE substr(x, 121, 3 * n3) END AS s3
  FROM (SELECT *, CASE c WHEN 1 THEN 5 WHEN 2 THEN 5 WHEN 3 THEN 8 ELSE 14 END AS n1, CASE c WHEN 2 THEN 1 WHEN 3 THEN 15 ELSE 3 END AS l1, CASE c WHEN 2 THEN 9 ELSE 20 END AS n2, CASE c WHEN 2 THEN 1 ELSE 2 END AS l2, CASE c WHEN 2 THEN 5 ELSE 15 END AS n3, CASE c WHEN 4 THEN 5 ELSE 0 END AS lead
    FROM (SELECT p_partkey AS key, p_brand AS family, CAST(p_partkey % 8 AS INT) AS c, {_dna('p_partkey', 8)} AS x FROM part) d) e) f
"""
_SPARK_DIFFER = "array_join(transform(sequence(1, length({s})), i -> CASE WHEN i % 13 = 5 AND ascii(substr(md5(CAST(key AS STRING) || '{s}' || CAST(i AS STRING)), 1, 1)) < 54 THEN translate(substr({s}, i, 1), 'ACGT', 'CGTA') ELSE substr({s}, i, 1) END), '')"
_DUCK_DIFFER = "array_to_string(list_transform(range(1, length({s}) + 1), lambda i: CASE WHEN i % 13 = 5 AND ascii(substr(md5(CAST(key AS VARCHAR) || '{s}' || CAST(i AS VARCHAR)), 1, 1)) < 54 THEN translate(substr({s}, i, 1), 'ACGT', 'CGTA') ELSE substr({s}, i, 1) END), '')"


def _gapped(text: str, differ: str) -> str:
    return GAPPED.format(text=text, **{f"differ_{s}": differ.format(s=s) for s in ("s1", "s2", "s3")})


GAPPED_SQL = _gapped("VARCHAR", _DUCK_DIFFER)
LOCI_SQL = LOCI.format(text="VARCHAR")
CLOSE_SQL = CLOSE.format(text="VARCHAR", close=_DUCK_CLOSE)
PAIRS_SQL = PAIRS.format(text="VARCHAR", pick=_DUCK_PICK)


def loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, family, species, p_size, p_retailprice, cds) with defects in some."""
    return spark.sql(LOCI.format(text="STRING").replace("FROM part)", "FROM {part})"), part=table(spark, sf_dir, "part"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, family, a, b): aligned sequences without gaps."""
    text = PAIRS.format(text="STRING", pick=_SPARK_PICK).replace("FROM part)", "FROM {part})")
    return spark.sql(text, part=table(spark, sf_dir, "part"))


def close_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, family, a, b): sequences and copies with isolated differences."""
    text = CLOSE.format(text="STRING", close=_SPARK_CLOSE).replace("FROM part)", "FROM {part})")
    return spark.sql(text, part=table(spark, sf_dir, "part"))


def gapped_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, family, c, n1, l1, n2, l2, n3, lead, a, b): pairs whose gaps are known."""
    return spark.sql(_gapped("STRING", _SPARK_DIFFER).replace("FROM part)", "FROM {part})"), part=table(spark, sf_dir, "part"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gene, condition, sample, value): steering records from events."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("gene"), F.col("event_type").alias("condition"), F.col("event_id").alias("sample"), "value")


RECORDS_SQL = "SELECT user_id AS gene, event_type AS condition, event_id AS sample, value FROM events"


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, family, v): locus embeddings as arrays of doubles."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("label").alias("family"), F.col("embedding").cast("array<double>").alias("v"))


EMBEDDED_SQL = "SELECT vec_id AS key, label AS family, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
