"""Global order without a single task: range partitions, their sizes, and offsets.

A window without PARTITION BY puts a whole table in one task. Here rows are dealt to range
partitions, numbered inside each, and lifted by what the partitions before hold, which is
one row for each partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.lineage import cut


def _ranged(df: DataFrame, order: list[str], size: str | None) -> tuple[DataFrame, DataFrame]:
    """(df by range with part_, (part_, before_): rows, or the sum of size, before a part)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # cut, so that both uses see the same parts
    x = cut(df.repartitionByRange(n, *order).withColumn("part_", F.spark_partition_id()))
    total = x.groupBy("part_").agg((F.sum(size) if size else F.count("*")).alias("s_"))
    before = F.coalesce(F.sum("s_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return x, total.select("part_", before.alias("before_"))


def numbered(df: DataFrame, order: list[str], into: str) -> DataFrame:
    """df with the place (from 0) of each row in a total order."""
    x, before = _ranged(df, order, None)
    own = F.row_number().over(Window.partitionBy("part_").orderBy(*order)) - 1
    return x.withColumn("own_", own).join(before, "part_").withColumn(into, (F.col("own_") + F.col("before_")).cast("long")).drop("own_", "before_", "part_")


def value_counts(df: DataFrame, x: str) -> DataFrame:
    """(x, n, before): how often each value occurs and how many rows have lesser ones. Counts
    combine before the shuffle; equal values are one row, so ties can't fill a task."""
    v = df.where(F.col(x).isNotNull()).groupBy(x).agg(F.count("*").alias("n"))
    y, before = _ranged(v, [x], "n")
    own = F.coalesce(F.sum("n").over(Window.partitionBy("part_").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return y.withColumn("own_", own).join(before, "part_").select(x, "n", (F.col("own_") + F.col("before_")).cast("long").alias("before"))


def grouped_value_counts(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """(by, x, n, before): how often each value occurs in its group and how many rows of the
    group have lesser ones. Ranges are over (group, value): a group of the whole table lies in
    all of them, and what it has in the ranges before is one row for each range and group."""
    v = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    y = cut(v.repartitionByRange(parts, *by, x).withColumn("part_", F.spark_partition_id()))
    total = y.groupBy("part_", *by).agg(F.sum("n").alias("s_"))
    earlier = F.coalesce(F.sum("s_").over(Window.partitionBy(*by).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lifted = total.select(F.col("part_").alias("at_"), *[F.col(c).alias(f"{c}_of_") for c in by], earlier.alias("before_"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("part_", *by).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = F.col("part_") == F.col("at_")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_of_"))
    return y.withColumn("own_", own).join(lifted, same).select(*by, x, "n", (F.col("own_") + F.col("before_")).cast("long").alias("before"))


def grouped_mid_rank(df: DataFrame, by: list[str], x: str, into: str) -> DataFrame:
    """df with average ranks inside groups, whatever their size; null values have none."""
    v = grouped_value_counts(df, by, x).select(*[F.col(c).alias(f"{c}_of_") for c in by], F.col(x).alias("x_of_"), (F.col("before") + (F.col("n") + 1) / 2.0).alias(into))
    same = F.col(x) == F.col("x_of_")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_of_"))
    return df.join(v, same, "left").drop(*[f"{c}_of_" for c in by], "x_of_")


def grouped_quantiles(df: DataFrame, by: list[str], x: str, shares: list[float]) -> DataFrame:
    """(by, share, value): linear quantiles of each group, from counted values; no task holds
    a group."""
    v = grouped_value_counts(df, by, x)
    n = v.groupBy(*by).agg(F.sum("n").alias("total_"))
    want = n.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn("place_", F.col("share") * (F.col("total_") - 1))
    named = want.select(*[F.col(c).alias(f"{c}_of_") for c in by], "share", "place_")
    low, high = F.floor("place_"), F.ceil("place_")
    same = (F.col("before") <= high) & (F.col("before") + F.col("n") > low)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_of_"))
    covers = lambda p: (F.col("before") <= p) & (F.col("before") + F.col("n") > p)
    g = v.join(named, same).groupBy(*by, "share").agg(F.max(F.when(covers(low), F.col(x))).alias("a_"), F.max(F.when(covers(high), F.col(x))).alias("b_"), F.first("place_").alias("p_"))
    return g.select(*by, "share", (F.col("a_") + (F.col("b_") - F.col("a_")) * (F.col("p_") - F.floor("p_"))).alias("value"))


def grouped_median(df: DataFrame, by: list[str], x: str, into: str) -> DataFrame:
    """(by, into)."""
    return grouped_quantiles(df, by, x, [0.5]).select(*by, F.col("value").alias(into))


def global_mid_rank(df: DataFrame, x: str, into: str) -> DataFrame:
    """df with average ranks over the whole table; null values have none."""
    v = value_counts(df, x).select(x, (F.col("before") + (F.col("n") + 1) / 2.0).alias(into))
    return df.join(v, x, "left")


def quantiles(df: DataFrame, x: str, shares: list[float]) -> DataFrame:
    """(share, value): linear quantiles. The order statistics around each are looked up among
    counted values; no task holds them all."""
    v = value_counts(df, x)
    n = v.agg(F.sum("n").alias("total"))
    want = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    at = n.select(want, "total").withColumn("place", F.col("share") * (F.col("total") - 1))
    low, high = F.floor("place"), F.ceil("place")
    j = v.join(F.broadcast(at), (F.col("before") <= high) & (F.col("before") + F.col("n") > low))  # a row for each share
    covers = lambda p: (F.col("before") <= p) & (F.col("before") + F.col("n") > p)
    g = j.groupBy("share").agg(F.max(F.when(covers(low), F.col(x))).alias("a"), F.max(F.when(covers(high), F.col(x))).alias("b"), F.first("place").alias("place"))
    return g.select("share", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.floor("place"))).alias("value"))
