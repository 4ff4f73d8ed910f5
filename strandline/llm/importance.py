"""Importance resampling towards a target distribution, by hashed features.

1. Every text becomes its array of feature buckets: runs of words, hashed by crc32. Higher-
   order functions do this in the JVM; no row is made of a word.
2. Buckets are counted over all documents and over all target texts. Counts combine in the
   tasks, so that at most ``buckets`` totals a task are shuffled.
3. The log ratio of both smoothed shares is a bucket's gain. The gains, ``buckets`` longs
   whatever the corpus holds, stand as one literal array in the plan that sums them.
4. A document's score is its weight plus Gumbel noise, drawn from a hash of its id: taking
   the highest scores draws without replacement in proportion to exp(weight / 1000).
   Places come from range partitions and their sizes, never from one task.

Making the frame runs jobs: the arrays are stored, buckets and documents are counted.

Defined cases: a null or empty text has no features and weight 0; very long texts count
whole; ties go to the smaller id; repeated rows are rows of their own, in counts and draws;
a row without id counts and has a weight, but neither score nor rank, and is not among the
documents to draw from; with no target text every count of it is 0; an empty table gives an
empty one; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.text import stored
from strandline.operators.ordering import numbered

WIDTH, BUCKETS, PERCENT, LEAST_WORDS, SEED = 1, 10_000, 10, 20, "2024"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words once A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), lambda w: w != "")


def buckets_of(words: Column, width: int, buckets: int) -> Column:
    """The bucket of each run of 1 to ``width`` words, repeats included."""
    hashed = lambda run: (F.crc32(run.cast("binary")) % buckets).cast("int")

    def runs(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: hashed(F.array_join(F.slice(words, at, n), " ")))

    return F.concat(F.transform(words, hashed), *map(runs, range(2, width + 1)))


def bucketed(docs: DataFrame, id: str, text: str, width: int, buckets: int) -> DataFrame:
    """(doc_id, n_words, at): each row's buckets."""
    words = docs.select(F.col(id).cast("long").alias("doc_id"), words_of(F.col(text)).alias("words"))
    return words.select("doc_id", F.size("words").alias("n_words"), buckets_of(F.col("words"), width, buckets).alias("at"))


def bucket_counts(rows: DataFrame, into: str) -> DataFrame:
    return rows.select(F.explode("at").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(into))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """The gain of each bucket, in order; of buckets that nothing fills too."""
    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(bucket_counts(source, "s"), "bucket", "left").join(bucket_counts(target, "t"), "bucket", "left").fillna(0)
    row = both.agg(F.array_sort(F.collect_list(F.struct("bucket", "s", "t"))).alias("of"), F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    real = lambda c: c.cast("double")
    ratio = lambda x: (real(x["t"]) + 1) * (real(F.col("all_s")) + buckets) / ((real(x["s"]) + 1) * (real(F.col("all_t")) + buckets))
    return row.select(F.transform("of", lambda x: F.floor(1000 * F.ln(ratio(x)))).alias("gains")).first()["gains"]


def noise(id: Column, seed: str) -> Column:
    """Gumbel noise in thousandths, from the hash of ``seed:id``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, *, id: str = "doc_id", text: str = "text", target_text: str = "text", width: int = WIDTH, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of docs; rank is null for rows
    that were not drawn. ``percent`` of the documents of ``least_words`` words are drawn."""
    rows = stored(bucketed(docs, id, text, width, buckets))
    goal = target.select(F.lit(0).alias("_"), F.col(target_text).alias("_text"))
    values = gains(rows, bucketed(goal, "_", "_text", width, buckets), buckets)
    literal = F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    weight = F.aggregate("at", F.lit(0).cast("long"), lambda total, b: total + F.element_at(literal, b + 1))
    fit = F.col("doc_id").isNotNull() & (F.col("n_words") >= least_words)
    scored = rows.select("doc_id", F.size("at").cast("long").alias("n_features"), weight.alias("weight"), fit.alias("fit")).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    placed = numbered(scored.select("*", (~F.col("fit")).alias("last"), (-F.col("score")).alias("down")), ["last", "down", "doc_id"], "place")
    draws = rows.where(fit).count() * percent // 100
    rank = F.when(F.col("fit") & (F.col("place") < draws), F.col("place") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
