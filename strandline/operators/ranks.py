"""Rank statistics: mid-ranks, guarded Spearman, rank-sum and signed-rank statistics, Holm.

Degenerate groups are taken out before corr() sees them (an aggregate inside CASE is
evaluated anyway) and come back with null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.lineage import cut
from strandline.operators.ordering import grouped_mid_rank, value_counts


def mid_rank(df: DataFrame, by: list[str], x: str, into: str) -> DataFrame:
    """Average ranks within groups: ties share the mean of their places. A group of any size
    spreads over range partitions."""
    return grouped_mid_rank(df, by, x, into)


def spearman(df: DataFrame, by: list[str], x: str, y: str, least: int = 6) -> DataFrame:
    """(by, n, rho): rank correlation where at least ``least`` finite pairs exist and
    neither side is constant; null otherwise."""
    whole = df.select(*by, F.nanvl(F.col(x).cast("double"), F.lit(None)).alias("x"), F.nanvl(F.col(y).cast("double"), F.lit(None)).alias("y"))
    whole = cut(whole)  # read four times
    fine = whole.where("x IS NOT NULL AND y IS NOT NULL")
    sizes = whole.groupBy(*by).agg(F.sum(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1).otherwise(0)).alias("n"))
    spread = fine.groupBy(*by).agg(F.count("*").alias("n_"), (F.max("x") > F.min("x")).alias("vx"), (F.max("y") > F.min("y")).alias("vy"))
    live = fine.join(spread.where((F.col("n_") >= least) & F.col("vx") & F.col("vy")).select(*by), by, "left_semi")
    ranked = mid_rank(mid_rank(live, by, "x", "rx"), by, "y", "ry")
    rho = ranked.groupBy(*by).agg((F.corr("rx", "ry") + F.lit(0.0)).alias("rho"))  # no negative zero
    return sizes.join(rho, by, "left")


def rank_sums(df: DataFrame, by: list[str], group: str, x: str) -> DataFrame:
    """(by, group, n, rank_sum) over mid-ranks of x within by."""
    return mid_rank(df, by, x, "r_").groupBy(*by, group).agg(F.count("*").alias("n"), F.sum("r_").alias("rank_sum"))


def mann_whitney(df: DataFrame, by: list[str], group: str, first, x: str) -> DataFrame:
    """(by, n1, n2, u): U of the rows whose group is ``first`` against the others."""
    s = rank_sums(df.withColumn("g_", F.col(group) == F.lit(first)), by, "g_", x)
    one, two = F.col("g_"), ~F.col("g_")
    t = s.groupBy(*by).agg(F.sum(F.when(one, F.col("n"))).alias("n1"), F.sum(F.when(two, F.col("n"))).alias("n2"), F.sum(F.when(one, F.col("rank_sum"))).alias("r1"))
    return t.select(*by, "n1", "n2", (F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0).alias("u"))


def kruskal(df: DataFrame, group: str, x: str, least: int = 3) -> DataFrame:
    """(k, n, h): the tie-corrected Kruskal-Wallis statistic of groups with enough rows."""
    big = df.groupBy(group).agg(F.count("*").alias("c")).where(F.col("c") >= least).select(group)
    kept = df.select(group, x).join(big, group, "left_semi")
    # ranks over the whole table, by range partitions
    v = value_counts(kept, x).withColumn("r_", F.col("before") + (F.col("n") + 1) / 2.0)
    cells = kept.groupBy(group, x).agg(F.count("*").alias("c")).join(v.select(x, "r_"), x)
    sums = cells.groupBy(group).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("r_")).alias("rank_sum"))
    t = F.col("n").cast("double")
    ties = v.agg(F.sum(t * t * t - t).alias("ties"))
    a = sums.agg(F.count("*").alias("k"), F.sum("n").cast("double").alias("n"), F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("s")).crossJoin(ties)
    h = F.lit(12.0) / (F.col("n") * (F.col("n") + 1)) * F.col("s") - 3 * (F.col("n") + 1)
    return a.select("k", F.col("n").cast("long").alias("n"), F.try_divide(h, 1 - F.col("ties") / (F.col("n") * F.col("n") * F.col("n") - F.col("n"))).alias("h"))


def signed_ranks(df: DataFrame, by: list[str], d: str) -> DataFrame:
    """(by, n, w_plus, w_minus): Wilcoxon signed-rank sums without zero differences."""
    x = mid_rank(df.where(F.col(d) != 0).withColumn("abs_", F.abs(d)), by, "abs_", "r_")
    return x.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.when(F.col(d) > 0, F.col("r_")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col(d) < 0, F.col("r_")).otherwise(0.0)).alias("w_minus"))


def holm(df: DataFrame, by: list[str], p: str, key: str) -> DataFrame:
    """df with p_holm: running maximum of (m - rank + 1) p, at most 1."""
    w = Window.partitionBy(*by).orderBy(p, key)
    m = F.count("*").over(Window.partitionBy(*by))
    step = df.withColumn("s_", (m - F.row_number().over(w) + 1) * F.col(p))
    return step.withColumn("p_holm", F.least(F.lit(1.0), F.max("s_").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("s_")


def residuals(df: DataFrame, by: list[str], x: str, y: str, least: int = 5) -> DataFrame:
    """df with resid: y less its least-squares line on x, in groups of enough rows."""
    w = Window.partitionBy(*by)
    line = df.withColumn("n_", F.count("*").over(w)).withColumn("mx_", F.avg(x).over(w)).withColumn("my_", F.avg(y).over(w))
    line = line.withColumn("sxy_", F.sum((F.col(x) - F.col("mx_")) * (F.col(y) - F.col("my_"))).over(w)).withColumn("sxx_", F.sum((F.col(x) - F.col("mx_")) * (F.col(x) - F.col("mx_"))).over(w))
    r = F.col(y) - F.col("my_") - F.try_divide("sxy_", "sxx_") * (F.col(x) - F.col("mx_"))
    return line.withColumn("resid", F.when(F.col("n_") >= least, r)).drop("n_", "mx_", "my_", "sxy_", "sxx_")


# -- tails of a row's statistics: rows are groups, so few -----------------------------------


def tail(fn, *columns):
    """fn(float, ...) -> float over columns; null where a column is null or NaN."""
    import pandas as pd

    def run(rows):
        return pd.Series([None if any(v is None or v != v for v in r) else fn(*map(float, r)) for r in rows.itertuples(index=False)], dtype="float64")

    run.__annotations__ = {"rows": pd.DataFrame, "return": pd.Series}
    return F.pandas_udf(run, "double")(F.struct(*[F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in columns]))


def spearman_p(df: DataFrame, by: list[str], x: str, y: str, least: int = 6) -> DataFrame:
    """(by, n, rho, p): rank correlations with the t approximation of their tail."""
    from strandline.functions import tails

    s = spearman(df, by, x, y, least)
    p = tail(lambda r, n: tails.t_two_sided(r * ((n - 2) / max(1e-300, 1 - r * r)) ** 0.5, n - 2) if abs(r) < 1 else 0.0, "rho", "n")
    return s.withColumn("p", p)


def partial_spearman(df: DataFrame, by: list[str], x: str, y: str, z: str, least: int = 10) -> DataFrame:
    """(by, n, rho, p): rank correlation of x and y with the ranks of z taken out; t on n - 3."""
    from strandline.functions import tails

    fine = df.select(*by, *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(n) for c, n in ((x, "x"), (y, "y"), (z, "z"))]).where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    w = Window.partitionBy(*by)
    ranked = fine
    for c in "xyz":
        ranked = mid_rank(ranked, by, c, f"r{c}").withColumn(f"v{c}", F.max(c).over(w) > F.min(c).over(w))
    live = ranked.withColumn("n_", F.count("*").over(w)).where((F.col("n_") >= least) & F.col("vx") & F.col("vy") & F.col("vz"))
    g = live.groupBy(*by).agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("a"), F.corr("rx", "rz").alias("b"), F.corr("ry", "rz").alias("c"))
    rho = F.try_divide(F.col("a") - F.col("b") * F.col("c"), F.sqrt((1 - F.col("b") * F.col("b")) * (1 - F.col("c") * F.col("c"))))
    p = tail(lambda r, n: tails.t_two_sided(r * ((n - 3) / max(1e-300, 1 - r * r)) ** 0.5, n - 3) if abs(r) < 1 else 0.0, "rho", "n")
    return g.withColumn("rho", rho).select(*by, "n", "rho").withColumn("p", p)


def shape_fit(df: DataFrame, by: list[str], x: str, y: str, least: int = 20) -> DataFrame:
    """(by, n, b1, p1, b2, p2): least squares of y on z and z squared, z standardised by the
    population deviation; t tails on n - 3. From moments: groups are never gathered."""
    from strandline.functions import tails

    w = Window.partitionBy(*by)
    f = df.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    f = f.withColumn("m", F.avg("x").over(w)).withColumn("s", F.stddev_pop("x").over(w)).withColumn("my", F.avg("y").over(w)).where("s > 0")
    z = f.withColumn("z", (F.col("x") - F.col("m")) / F.col("s")).withColumn("q", F.col("z") * F.col("z") - 1).withColumn("e", F.col("y") - F.col("my"))
    g = z.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("z") * F.col("z")).alias("zz"), F.sum(F.col("z") * F.col("q")).alias("zq"), F.sum(F.col("q") * F.col("q")).alias("qq"), F.sum(F.col("z") * F.col("e")).alias("ze"), F.sum(F.col("q") * F.col("e")).alias("qe"), F.sum(F.col("e") * F.col("e")).alias("ee")).where(F.col("n") >= least)
    det = F.col("zz") * F.col("qq") - F.col("zq") * F.col("zq")
    g = g.withColumn("det", det).withColumn("b1", F.expr("try_divide(ze * qq - zq * qe, det)")).withColumn("b2", F.expr("try_divide(zz * qe - zq * ze, det)"))
    g = g.withColumn("s2", F.expr("(ee - b1 * ze - b2 * qe) / (n - 3)")).withColumn("t1", F.expr("try_divide(b1, sqrt(s2 * qq / det))")).withColumn("t2", F.expr("try_divide(b2, sqrt(s2 * zz / det))"))
    p = lambda t: tail(lambda v, n: tails.t_two_sided(v, n - 3), t, "n")
    return g.select(*by, "n", "b1", p("t1").alias("p1"), "b2", p("t2").alias("p2"))


def weighted_shape_fit(df: DataFrame, by: list[str], x: str, y: str, var: str, least: int = 15) -> DataFrame:
    """(by, n, b1, p1, b2, p2): as shape_fit with inverse-variance weights; errors scaled by
    chi-square over its degrees of freedom where that is above 1, normal tails."""
    from strandline.functions import tails

    w = Window.partitionBy(*by)
    f = df.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), (1 / F.col(var)).alias("w"))
    f = f.withColumn("m", F.avg("x").over(w)).withColumn("s", F.stddev_pop("x").over(w)).where("s > 0").withColumn("z", (F.col("x") - F.col("m")) / F.col("s"))
    # centred by weighted means, so that two unknowns are left
    f = f.withColumn("q", F.col("z") * F.col("z"))
    mean = lambda c: F.sum(F.col("w") * F.col(c)).over(w) / F.sum("w").over(w)
    f = f.withColumn("cz", F.col("z") - mean("z")).withColumn("cq", F.col("q") - mean("q")).withColumn("cy", F.col("y") - mean("y"))
    s = lambda a, b: F.sum(F.col("w") * F.col(a) * F.col(b))
    g = f.groupBy(*by).agg(F.count("*").alias("n"), s("cz", "cz").alias("zz"), s("cz", "cq").alias("zq"), s("cq", "cq").alias("qq"), s("cz", "cy").alias("ze"), s("cq", "cy").alias("qe"), s("cy", "cy").alias("ee")).where(F.col("n") >= least)
    g = g.withColumn("det", F.expr("zz * qq - zq * zq")).withColumn("b1", F.expr("try_divide(ze * qq - zq * qe, det)")).withColumn("b2", F.expr("try_divide(zz * qe - zq * ze, det)"))
    g = g.withColumn("k", F.expr("greatest(1D, (ee - b1 * ze - b2 * qe) / (n - 3))")).withColumn("t1", F.expr("try_divide(b1, sqrt(k * qq / det))")).withColumn("t2", F.expr("try_divide(b2, sqrt(k * zz / det))"))
    p = lambda t: tail(tails.normal_two_sided, t)
    return g.select(*by, "n", "b1", p("t1").alias("p1"), "b2", p("t2").alias("p2"))


def welch(df: DataFrame, by: list[str], y: str, first: str, second: str, least: int = 5) -> DataFrame:
    """(by, difference, p): means of the rows where one condition holds less those where the
    other does, Welch's t; null below ``least`` rows on a side."""
    from strandline.functions import tails

    side = lambda c, i: [F.count_if(F.expr(c)).alias(f"n{i}"), F.avg(F.when(F.expr(c), F.col(y))).alias(f"m{i}"), F.var_samp(F.when(F.expr(c), F.col(y))).alias(f"v{i}")]
    g = df.groupBy(*by).agg(*side(first, 1), *side(second, 2))
    ok = (F.col("n1") >= least) & (F.col("n2") >= least)
    g = g.withColumn("e1", F.expr("try_divide(v1, n1)")).withColumn("e2", F.expr("try_divide(v2, n2)")).withColumn("t", F.when(ok, F.expr("try_divide(m1 - m2, sqrt(e1 + e2))")))
    g = g.withColumn("nu", F.expr("try_divide((e1 + e2) * (e1 + e2), e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1))"))
    return g.select(*by, F.when(ok, F.col("m1") - F.col("m2")).alias("difference"), tail(tails.t_two_sided, "t", "nu").alias("p"))


def mann_whitney_p(df: DataFrame, by: list[str], group: str, first, x: str) -> DataFrame:
    """(by, n1, n2, u, p): with the normal tail, ties and continuity corrected."""
    from strandline.functions import tails

    u = mann_whitney(df, by, group, first, x)
    t = df.groupBy(*by, x).agg(F.count("*").cast("double").alias("t")).groupBy(*by).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    return u.join(t, by).withColumn("p", tail(lambda s, a, b, t_: tails.mann_whitney_two_sided(s, int(a), int(b), t_), "u", "n1", "n2", "ties")).drop("ties")
