"""Paired deltas against a baseline condition and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.ordering import grouped_quantiles


def gene_means(records: DataFrame, *by: str, value: str = "value", order: str | None = None) -> DataFrame:
    """(by, mean, n): means over samples. With ``order`` a group's values are added one after
    another in its order: partial sums of tasks differ in their last bits by how rows are
    dealt out, and ranks of means hang on those bits. Rows are sorted by task, so no group is
    held in memory."""
    if order:
        records = records.repartition(*by).sortWithinPartitions(*by, order, value)
    return records.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def deltas(means: DataFrame, gene: str, condition: str, baseline: str, value: str = "mean") -> DataFrame:
    """(gene, condition, level, base, delta): each condition against the same gene's
    baseline; genes without one fall out."""
    base = means.where(F.col(condition) == baseline).select(gene, F.col(value).alias("base"))
    other = means.where(F.col(condition) != baseline).select(gene, condition, F.col(value).alias("level"))
    return other.join(base, gene).withColumn("delta", F.col("level") - F.col("base"))


def describe(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """n, mean, median, sd, quartiles (linear) and the share above zero. Quartiles come from
    counted values by ranges, so that no task holds a group."""
    d = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.avg((F.col(x) > 0).cast("double")).alias("frac_improved"))
    q = grouped_quantiles(df, by, x, [0.25, 0.5, 0.75]).groupBy(*by).pivot("share", [0.25, 0.5, 0.75]).agg(F.first("value"))
    return d.join(q, by, "left").select(*by, "n", "mean", "sd", F.col("`0.25`").alias("q25"), F.col("`0.5`").alias("median"), F.col("`0.75`").alias("q75"), "frac_improved")


def adaptive_collapse(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """One row a group: columns constant in every group keep their value, others average."""
    distinct = df.groupBy(*by).agg(*[(F.countDistinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in columns])
    most = distinct.agg(*[F.max(c).alias(c) for c in columns]).first()
    return df.groupBy(*by).agg(*[(F.first(c, ignorenulls=True) if (most[c] or 0) <= 1 else F.avg(c)).alias(c) for c in columns])


def overdispersion(df: DataFrame, by: list[str], hits: str, trials: str, least: int = 3) -> DataFrame:
    """(phi): observed over binomial variance of rates, pooled over groups; at least 1."""
    g = df.withColumn("p_", F.try_divide(hits, trials)).groupBy(*by).agg(F.count("p_").alias("n"), F.avg("p_").alias("p"), F.var_samp("p_").alias("v"), F.avg(trials).alias("t"))
    g = g.where((F.col("n") >= least) & (F.col("p") > 0) & (F.col("p") < 1))
    return g.agg(F.greatest(F.lit(1.0), F.try_divide(F.sum("v"), F.sum(F.col("p") * (1 - F.col("p")) / F.col("t")))).alias("phi"))


def logit_gain(df: DataFrame, gene: str, condition: str, baseline: str, hits: str, trials: str) -> DataFrame:
    """(gene, condition, gain, var): log odds against the baseline, half a count added to
    each side, with the variance of the difference."""
    s = df.groupBy(gene, condition).agg(F.sum(hits).alias("k"), F.sum(trials).alias("t"))
    s = s.withColumn("l", F.log((F.col("k") + 0.5) / (F.col("t") - F.col("k") + 0.5))).withColumn("v", 1 / (F.col("k") + 0.5) + 1 / (F.col("t") - F.col("k") + 0.5))
    base = s.where(F.col(condition) == baseline).select(gene, F.col("l").alias("l0"), F.col("v").alias("v0"))
    return s.where(F.col(condition) != baseline).join(base, gene).select(gene, condition, (F.col("l") - F.col("l0")).alias("gain"), (F.col("v") + F.col("v0")).alias("var"))


def weighted_mean(df: DataFrame, by: list[str], y: str, var: str) -> DataFrame:
    """(by, mean, se) with inverse-variance weights."""
    w = 1 / F.col(var)
    return df.groupBy(*by).agg((F.sum(w * F.col(y)) / F.sum(w)).alias("mean"), F.sqrt(1 / F.sum(w)).alias("se"))


def with_all(df: DataFrame, by: list[str], extra: str, *aggregates: Column, label: str = "all") -> DataFrame:
    """Aggregates by (by, extra) and over all of extra, in one pass of grouping sets."""
    sets = [[F.col(c) for c in by], [F.col(c) for c in [*by, extra]]]
    out = df.groupingSets(sets, *[F.col(c) for c in [*by, extra]]).agg(*aggregates, F.grouping(extra).alias("g_"))
    return out.withColumn(extra, F.when(F.col("g_") == 1, F.lit(label)).otherwise(F.col(extra).cast("string"))).drop("g_")


def complete_conditions(df: DataFrame, condition: str, gene: str, share: float = 0.95) -> DataFrame:
    """(condition, n): conditions that cover the share of the best-covered one's genes."""
    n = df.groupBy(condition).agg(F.countDistinct(gene).alias("n"))
    return n.crossJoin(n.agg(F.max("n").alias("most"))).where(F.col("n") >= share * F.col("most")).drop("most")


def presence_matrix(df: DataFrame, gene: str, condition: str, levels: list[str]) -> DataFrame:
    """A row for each gene, 1 or 0 for each level."""
    return df.groupBy(gene).pivot(condition, levels).agg(F.lit(1)).na.fill(0)


def shuffle_null(sites: DataFrame, by: list[str], stratum: list[str], hit: str, wanted: str) -> DataFrame:
    """(by, expected): expected agreements if ``hit`` were shuffled within strata:
    sum over values of n(hit = v) n(wanted = v) / n. Both counts of a value come from one
    aggregate, so nothing is joined."""
    keys = [*by, *stratum]
    sides = F.explode(F.array(F.struct(F.col(hit).alias("v_"), F.lit(1).alias("h_"), F.lit(0).alias("w_")), F.struct(F.col(wanted).alias("v_"), F.lit(0).alias("h_"), F.lit(1).alias("w_")))).alias("s_")
    each = sites.na.drop(subset=keys).select(*keys, sides).select(*keys, "s_.*").groupBy(*keys, "v_").agg(F.sum("h_").alias("nh"), F.sum("w_").alias("nw"))
    both = F.when((F.col("nh") > 0) & (F.col("nw") > 0) & F.col("v_").isNotNull(), F.col("nh") * F.col("nw"))
    strata = each.groupBy(*keys).agg(F.sum("nh").alias("n"), F.sum(both).alias("met")).where("met IS NOT NULL")
    return strata.groupBy(*by).agg(F.sum(F.col("met") / F.col("n")).alias("expected"))
