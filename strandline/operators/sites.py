"""Aligned sites: votes, consensus, private and shared sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differing(df: DataFrame, key: str, a: str, b: str, *keep: str) -> DataFrame:
    """(key, keep, i, h, p): places (from 0) where equally long sequences differ."""
    # letters as arrays: a sequence that is itself an expression would, inside a lambda, be
    # worked out again for each place
    at = F.zip_with(F.split(a, ""), F.split(b, ""), lambda h, p: F.struct(h.alias("h"), p.alias("p")))
    each = df.select(key, *keep, F.posexplode(at).alias("i", "s")).select(key, *keep, "i", "s.h", "s.p")
    return each.where("h <> p AND h <> '' AND p <> ''")


def shown(df: DataFrame, seq: str, *keep: str) -> DataFrame:
    """(keep, i, base): each place of a sequence that shows one of ACGT."""
    return df.select(*keep, F.posexplode(F.split(seq, "")).alias("i", "base")).where("base IN ('A', 'C', 'G', 'T')")


def votes(df: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, i, base, n): how many sequences of a key show a base at a place."""
    return shown(df, seq, key).groupBy(key, "i", "base").agg(F.count("*").alias("n"))


def consensus(v: DataFrame, key: str) -> DataFrame:
    """(key, i, base): the most voted base; '-' where several have as many. One aggregate of
    the votes: a place's four counts are never joined back to them."""
    counts = {b: F.coalesce(F.sum(F.when(F.col("base") == b, F.col("n"))), F.lit(0)).alias(b) for b in "ACGT"}
    at = v.groupBy(key, "i").agg(*counts.values()).withColumn("most", F.greatest(*counts))
    tops = F.filter(F.array(*[F.when(F.col(b) == F.col("most"), F.lit(b)) for b in counts]), lambda b: b.isNotNull())
    return at.select(key, "i", F.when(F.size(tops) == 1, tops[0]).otherwise(F.lit("-")).alias("base"))


def private(sites: DataFrame, v: DataFrame, key: str) -> DataFrame:
    """Sites whose second base no voter shows; keys without voters have none at all."""
    voted = sites.join(v.select(key).distinct(), key, "left_semi")
    return voted.join(v.select(key, "i", F.col("base").alias("p")), [key, "i", "p"], "left_anti")


def with_others(sites: DataFrame, voters: DataFrame, key: str, group: str) -> DataFrame:
    """Sites (key, group, i, p, ...) with ``shared``: whether a voter (key, group, i, base) of
    the group with another key shows the base p there. A base at a place of a group is one row
    with its least and greatest key, so a group's members are never paired; those rows may be
    far more than their plan's estimate, so they are sorted, never broadcast."""
    seen = voters.groupBy(group, "i", F.col("base").alias("p")).agg(F.min(key).alias("lo_"), F.max(key).alias("hi_"))
    shared = F.coalesce((F.col("lo_") != F.col(key)) | (F.col("hi_") != F.col(key)), F.lit(False))
    return sites.join(seen.hint("merge"), [group, "i", "p"], "left").withColumn("shared", shared).drop("lo_", "hi_")


def mean_distances(distances: DataFrame, a: str = "a", b: str = "b", d: str = "d") -> DataFrame:
    """(a, b, mean, sd): over trees, with the population deviation."""
    return distances.groupBy(a, b).agg(F.avg(d).alias("mean"), F.stddev_pop(d).alias("sd"))


def place_status(span_length: str, places: str, expected: str):
    """ok, no_seq, unmappable or MISMATCH, for an array of places."""
    n = F.size(places)
    return F.when(F.coalesce(F.col(expected), F.lit(0)) == 0, "no_seq").when(F.col(places).isNull(), "unmappable").when((n != F.col(expected)) | (F.size(F.array_distinct(places)) != n) | (F.array_max(places) >= F.col(span_length)), "MISMATCH").otherwise("ok")
