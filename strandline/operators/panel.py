"""Panel construction: quality flags, picks, strata, quotas and allocations.

Every selection has a total order (a key breaks ties), so results do not depend on how
rows are dealt out. Seeded order is a hash of seed and key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import sequences as S
from strandline.operators.ordering import grouped_median, numbered, quantiles


def qc_flags(df: DataFrame, seq: str, short: int = 100, n_share: float = 0.05, n_run: int = 5) -> DataFrame:
    """df with qc_flags (failed rules in order) and qc_pass."""
    s = F.col(seq)
    rules = [
        ("missing", s.isNull() | (F.length(s) == 0)),
        ("not_whole_codons", F.length(s) % 3 != 0),
        ("no_start", ~s.startswith("ATG")),
        ("no_stop", ~F.expr(S.translate_stops(seq)).endswith("*")),
        ("inner_stop", F.expr(f"instr({S.translate_trimmed(seq)}, '*') > 0")),
        ("n_share", F.expr(S.count_of(seq, "N")) > n_share * F.length(s)),
        ("n_run", F.expr(S.longest_run(seq)) >= n_run),
        ("short", F.length(s) < short),
    ]
    flags = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))
    return df.withColumn("qc_flags", flags).withColumn("qc_pass", F.size("qc_flags") == 0)


def first_reason(flags: str) -> Column:
    """The first failed rule, or null."""
    return F.try_element_at(flags, F.lit(1))


def length_outliers(df: DataFrame, by: str, x: Column, low: float = 0.2, high: float = 5.0) -> DataFrame:
    """df with length_outlier: outside low to high times the group's median."""
    y = df.withColumn("x_", x)
    m = grouped_median(y, [by], "x_", "m_")
    return y.join(m, by).withColumn("length_outlier", (F.col("x_") < low * F.col("m_")) | (F.col("x_") > high * F.col("m_"))).drop("x_", "m_")


def analyzable(df: DataFrame, group: str, level: str, least: int) -> DataFrame:
    """Rows of groups that have enough distinct levels."""
    n = df.groupBy(group).agg(F.countDistinct(level).alias("n_levels")).where(F.col("n_levels") >= least)
    return df.join(n, group)


def one_to_one(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose a and b each occur once."""
    once = lambda c: F.count("*").over(Window.partitionBy(c)) == 1
    return df.withColumn("a_", once(a)).withColumn("b_", once(b)).where("a_ AND b_").drop("a_", "b_")


def pick(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group in the given total order."""
    return df.withColumn("r_", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("r_ = 1").drop("r_")


def overlap_counts(genes: DataFrame, chrom: str, key: str, start: str, end: str, width: int = 200) -> DataFrame:
    """(key, n_overlap): other intervals of the chromosome that share a place.

    Intervals are dealt to bins of a width, so the join is on equality of (chromosome,
    bin); a pair counts in the bin of its later start only."""
    bins = genes.select(chrom, key, start, end, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))).alias("bin"))
    x, y = bins.alias("x"), bins.alias("y")
    meet = (F.col(f"x.{chrom}") == F.col(f"y.{chrom}")) & (F.col("x.bin") == F.col("y.bin")) & (F.col(f"x.{key}") != F.col(f"y.{key}")) & (F.col(f"y.{start}") <= F.col(f"x.{end}")) & (F.col(f"y.{end}") >= F.col(f"x.{start}"))
    once = F.floor(F.greatest(F.col(f"x.{start}"), F.col(f"y.{start}")) / width) == F.col("x.bin")
    n = x.join(y, meet & once).groupBy(F.col(f"x.{key}").alias(key)).agg(F.count("*").alias("n_overlap"))
    return genes.select(key).join(n, key, "left").select(key, F.coalesce("n_overlap", F.lit(0)).alias("n_overlap"))


def quantile_strata(df: DataFrame, x: str, n: int, into: str = "stratum") -> DataFrame:
    """df with the right-closed quantile bin (0 to n - 1) of x by linear quantiles."""
    edges = quantiles(df, x, [i / n for i in range(1, n)]).agg(F.array_sort(F.collect_list("value")).alias("e_"))
    return df.crossJoin(F.broadcast(edges)).withColumn(into, F.size(F.filter("e_", lambda e: e < F.col(x)))).drop("e_")  # one row of n - 1 edges


def nearest_to_median(df: DataFrame, by: str, x: str, key: str) -> DataFrame:
    """Of each group the row nearest its median, ties by key."""
    m = grouped_median(df, [by], x, "m_")
    return pick(df.join(m, by).withColumn("d_", F.abs(F.col(x) - F.col("m_"))), [by], F.col("d_"), F.col(key)).drop("m_", "d_")


def seeded(key: str, seed: int) -> Column:
    """A seeded order that both engines share."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def quota_walk(df: DataFrame, stratum: str, priority: str, passes: str, quota: int) -> DataFrame:
    """df with selected (among the first ``quota`` that pass) and examined (up to the last
    selected one, or all where the quota is not met)."""
    w = Window.partitionBy(stratum).orderBy(priority).rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum(F.col(passes).cast("int")).over(w)
    x = df.withColumn("n_", n)
    return x.withColumn("selected", F.col(passes) & (F.col("n_") <= quota)).withColumn("examined", F.col("n_") - F.col(passes).cast("int") < quota).drop("n_")


def even_allocation(sizes: DataFrame, by: list[str], group: str, size: str, cap: int, seed: int = 1) -> DataFrame:
    """(by, group, size, quota): cap filled like water over the groups, each up to its
    size; units short of a full round go one each in seeded order."""
    w = Window.partitionBy(*by).orderBy(size, group)
    x = sizes.withColumn("i_", F.row_number().over(w)).withColumn("k_", F.count("*").over(Window.partitionBy(*by)))
    before = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # groups in rising order: the first whose even share of what is left it can't take sets the level
    x = x.withColumn("left_", F.lit(cap) - before).withColumn("open_", F.col("k_") - F.col("i_") + 1)
    whole = Window.partitionBy(*by)
    x = x.withColumn("short_", F.col(size) * F.col("open_") > F.col("left_"))
    first = F.min(F.when(F.col("short_"), F.struct("i_", F.floor(F.col("left_") / F.col("open_")).alias("level"), (F.col("left_") % F.col("open_")).alias("extra")))).over(whole)
    x = x.withColumn("first_", first).withColumn("level_", F.col("first_")["level"]).withColumn("extra_", F.col("first_")["extra"])
    capped = F.col("level_").isNotNull() & (F.col(size) > F.col("level_"))
    x = x.withColumn("turn_", F.when(capped, F.row_number().over(Window.partitionBy(*by, capped).orderBy(seeded(group, seed), group))))
    quota = F.when(capped, F.col("level_") + F.when(F.col("turn_") <= F.col("extra_"), 1).otherwise(0)).otherwise(F.col(size))
    return x.select(*by, group, size, quota.cast("long").alias("quota"))


def stratified_sample(df: DataFrame, quotas: DataFrame, by: list[str], key: str, seed: int = 1) -> DataFrame:
    """As many rows of each group as its quota, in seeded order."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(seeded(key, seed), key))
    return df.withColumn("n_", n).join(quotas, by).where(F.col("n_") <= F.col("quota")).drop("n_")


def cap_by_groups(sizes: DataFrame, by: list[str], group: str, size: str, cap: int, seed: int = 1) -> DataFrame:
    """Whole groups, largest first, while those before hold less than the cap."""
    w = Window.partitionBy(*by).orderBy(F.desc(size), seeded(group, seed), group).rowsBetween(Window.unboundedPreceding, 0)
    return sizes.withColumn("t_", F.sum(size).over(w)).where(F.col("t_") - F.col(size) < cap).drop("t_")


def interleaved(df: DataFrame, stratum: str, order: str) -> DataFrame:
    """df with turn (place in its stratum) and seat: rows go round the strata."""
    x = df.withColumn("turn", F.row_number().over(Window.partitionBy(stratum).orderBy(order)))
    return numbered(x, ["turn", stratum], "seat").withColumn("seat", F.col("seat") + 1)


def thinned(df: DataFrame, order: str, most: int) -> DataFrame:
    """Every step-th row in order, with the least step that leaves at most ``most``."""
    n = df.count()
    step = max(1, -(-n // most))
    return numbered(df, [order], "i_").where(F.col("i_") % step == 0).drop("i_")


def filled(df: DataFrame, by: str, order: str, x: str) -> DataFrame:
    """df with x filled forward, then backward."""
    w = Window.partitionBy(by).orderBy(order)
    forward = F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    back = F.first(x, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(x + "_filled", F.coalesce(forward, back))


def extreme_rows(df: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each group in a total order."""
    return df.withColumn("r_", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("r_") <= k).drop("r_")


def first_seen(df: DataFrame, x: str, place: str) -> DataFrame:
    """(x, first_place): distinct values by where they first stand."""
    return df.groupBy(x).agg(F.min(place).alias("first_place"))


def adaptive_count(n: str, target: int = 400, low: int = 5, high: int = 16) -> Column:
    """How many samples a record of n sites needs for the target."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.ceil(target / F.col(n)))).cast("int")


def extended_window(sites: DataFrame, key: str, place: str, start: int, step: int, least: int, most: int) -> DataFrame:
    """(key, window, n): the smallest of start, start + step, ... up to most that holds
    ``least`` sites, or most. The window follows from the place of the least-th site."""
    nth = sites.withColumn("r_", F.row_number().over(Window.partitionBy(key).orderBy(place)))
    g = nth.groupBy(key).agg(F.max(F.when(F.col("r_") == least, F.col(place))).alias("at_"))
    need = F.greatest(F.lit(start), F.lit(start) + F.ceil((F.col("at_") + 1 - start) / step) * step)
    w = g.withColumn("window", F.least(F.lit(most), F.coalesce(need, F.lit(most))).cast("int"))
    inside = sites.join(w.select(key, "window"), key).where(F.col(place) < F.col("window")).groupBy(key).agg(F.count("*").alias("n"))
    return w.select(key, "window").join(inside, key, "left").select(key, "window", F.coalesce("n", F.lit(0)).alias("n"))


def offsets(sizes: DataFrame, order: str, size: str, by: list[str] = ()) -> DataFrame:
    """sizes with ``offset``: what comes before, in order, within each group."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)))
