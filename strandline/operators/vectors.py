"""Geometry of embeddings: arrays of doubles, pairs only inside groups.

Dot products of rows stay in the JVM (higher-order functions); pairs inside a group are
products of blocks (tiles.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators import tiles


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: str) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: str, least: float = 1e-12) -> Column:
    """v over its norm, which counts as ``least`` at least."""
    return divided(v, F.greatest(norm(v), F.lit(least)))


def divided(v: str | Column, by: Column) -> Column:
    """Each element over a number, which is worked out once a row (inside a lambda it would
    be once an element)."""
    return F.zip_with(v, F.array_repeat(by, F.size(v)), lambda x, n: x / n)


def clipped(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c))


def pair_distances(df: DataFrame, key: str, group: str, v: str) -> DataFrame:
    """(group, a, b, cosine, angular): pairs a < b of each group, by tiles; angular is the
    angle over pi. Vectors move as they are, floats in half the bytes of doubles."""
    c = tiles.pair_cosines(df, group, key, v, unit=False)
    return c.select(group, "a", "b", (1 - F.col("c")).alias("cosine"), (F.acos("c") / F.pi()).alias("angular"))


def exploded(df: DataFrame, v: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.posexplode(v).alias("pos", "x"))


def mean_vector(df: DataFrame, group: str, v: str, into: str = "centroid") -> DataFrame:
    """(group, into): elementwise mean, combined before the shuffle."""
    m = exploded(df, v, group).groupBy(group, "pos").agg(F.avg("x").alias("x"))
    return m.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias(into))


def sum_vector(df: DataFrame, group: str, v: str, into: str = "total") -> DataFrame:
    m = exploded(df, v, group).groupBy(group, "pos").agg(F.sum("x").alias("x"))
    return m.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias(into))


def centroids(df: DataFrame, group: str, v: str) -> DataFrame:
    """Means of unit vectors, not normalised again."""
    return mean_vector(df.select(group, unit(v).alias("u")), group, "u")


def standardised(df: DataFrame, key: str, v: str) -> DataFrame:
    """Coordinates less their mean over their population deviation (1e-12 at least)."""
    x = exploded(df, v, key)
    s = x.groupBy("pos").agg(F.avg("x").alias("m"), F.greatest(F.stddev_pop("x"), F.lit(1e-12)).alias("sd"))
    z = x.join(F.broadcast(s), "pos")  # a row for each coordinate
    return z.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", ((F.col("x") - F.col("m")) / F.col("sd")).alias("z")))), lambda e: e["z"]).alias(v))


def knn_edges(df: DataFrame, key: str, group: str, v: str, k: int) -> DataFrame:
    """(group, a, b, w): symmetric nearest-neighbour edges by cosine distance, ties by key;
    an edge found from both ends keeps the larger weight. By tiles: no row is made of a pair
    that is not near."""
    near = tiles.nearest(df.select(group, key, unit(v).alias("u")), group, key, "u", k)
    return near.groupBy(group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("cosine").alias("w"))


def leave_one_out(df: DataFrame, key: str, group: str, v: str) -> DataFrame:
    """(group, key, loo_cos, influence): cosine of a vector with the sum of the group's
    others, and 1 - cosine of the group's sum with and without it; by sums, not pairs."""
    t = sum_vector(df, group, v)
    x = df.join(t, group).select(group, key, dot(v, "total").alias("g"), dot(v, v).alias("d"), dot("total", "total").alias("ss"))
    rest = F.col("ss") - 2 * F.col("g") + F.col("d")
    root = lambda c: F.sqrt(F.greatest(c, F.lit(0.0)))
    return x.select(group, key, F.try_divide(F.col("g") - F.col("d"), root(F.col("d")) * root(rest)).alias("loo_cos"), (1 - F.try_divide(F.col("ss") - F.col("g"), root(F.col("ss")) * root(rest))).alias("influence"))


def coherence(df: DataFrame, group: str, v: str) -> DataFrame:
    """(group, n, coherence): the norm of the mean unit vector."""
    c = centroids(df, group, v).select(group, norm("centroid").alias("coherence"))
    return df.groupBy(group).agg(F.count("*").alias("n")).join(c, group)


def silhouette(df: DataFrame, key: str, cluster: str, v: str) -> DataFrame:
    """(cluster, n, silhouette): mean silhouette on cosine distance; a singleton scores 0.

    Mean distances to clusters come from sums of unit vectors, so no pairs are made."""
    u = df.select(key, cluster, unit(v).alias("u"))
    sums = sum_vector(u, cluster, "u").join(u.groupBy(cluster).agg(F.count("*").alias("n")), cluster)
    x = u.crossJoin(F.broadcast(sums.select(F.col(cluster).alias("other"), "total", "n")))  # a row for each cluster
    own = F.col("other") == F.col(cluster)
    d = F.when(own, F.try_divide((F.col("n") - 1) - (dot("u", "total") - dot("u", "u")), F.col("n") - 1)).otherwise(1 - dot("u", "total") / F.col("n"))
    per = x.withColumn("d", d).groupBy(key, cluster).agg(F.max(F.when(own, F.col("d"))).alias("a"), F.min(F.when(~own, F.col("d"))).alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return per.groupBy(cluster).agg(F.count("*").alias("n"), F.avg(s).alias("silhouette"))


def dispersion(df: DataFrame, cluster: str, v: str) -> DataFrame:
    """(w): log of the within-cluster sums of pair distances over cluster sizes. The sum of
    1 - cosine over pairs is (n^2 - |sum of unit vectors|^2) / 2, so no pairs are made."""
    u = df.select(cluster, unit(v).alias("u"))
    s = sum_vector(u, cluster, "u").join(u.groupBy(cluster).agg(F.count("*").alias("n")), cluster)
    return s.agg(F.log(F.sum((F.col("n") * F.col("n") - dot("total", "total")) / 2 / F.col("n"))).alias("w"))


def rand_index(df: DataFrame, a: str, b: str) -> DataFrame:
    """(ari): adjusted Rand index from the contingency table; 1 where it is undefined."""
    two = lambda c: c * (c - 1) / 2.0
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    s = lambda by: cells.groupBy(by).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias(f"s_{by}"))
    x = cells.agg(F.sum(two(F.col("n"))).alias("s"), two(F.sum("n")).alias("t")).crossJoin(s(a)).crossJoin(s(b))
    expected = F.try_divide(F.col(f"s_{a}") * F.col(f"s_{b}"), F.col("t"))
    most = (F.col(f"s_{a}") + F.col(f"s_{b}")) / 2
    return x.select(F.coalesce(F.try_divide(F.col("s") - expected, most - expected), F.lit(1.0)).alias("ari"))


# -- directions of paired vectors ----------------------------------------------------------


def deltas(pairs: DataFrame, h: str, p: str, into: str = "delta") -> DataFrame:
    """pairs with the elementwise difference p - h."""
    return pairs.withColumn(into, F.zip_with(p, h, lambda x, y: x - y))


def direction_facts(df: DataFrame, key: str, layer: str, delta: str) -> DataFrame:
    """(layer, n, v_norm, v_over_mean, dnorm_median, dnorm_cv, loo_mean, loo_median, loo_sd,
    loo_min, loo_max, loo_pos, loo_over_quarter, coherence, floor): how alike the deltas of a
    layer point, from sums over coordinates, without pairs."""
    d = df.select(key, layer, delta)
    loo = leave_one_out(d, key, layer, delta).select(layer, key, "loo_cos")
    g = d.select(key, layer, norm(delta).alias("dn")).join(loo, [key, layer]).groupBy(layer).agg(
        F.count("*").alias("n"), F.avg("dn").alias("dn_mean"), F.median("dn").alias("dnorm_median"), F.try_divide(F.stddev_pop("dn"), F.avg("dn")).alias("dnorm_cv"),
        F.avg("loo_cos").alias("loo_mean"), F.median("loo_cos").alias("loo_median"), F.stddev_pop("loo_cos").alias("loo_sd"), F.min("loo_cos").alias("loo_min"), F.max("loo_cos").alias("loo_max"),
        F.avg((F.col("loo_cos") > 0).cast("double")).alias("loo_pos"), F.avg((F.col("loo_cos") > 0.25).cast("double")).alias("loo_over_quarter"),
    )
    v = mean_vector(d, layer, delta, "v").select(layer, norm("v").alias("v_norm"))
    # a delta of no length has no direction, but counts in n
    c = coherence(d, layer, delta).select(layer, "coherence")
    out = g.join(v, layer).join(c, layer)
    return out.withColumn("v_over_mean", F.try_divide("v_norm", "dn_mean")).withColumn("floor", 1 / F.sqrt("n")).drop("dn_mean")


def steering(df: DataFrame, key: str, layer: str, h: str, p: str, covariate: str) -> DataFrame:
    """(layer, key, loo_cos, q_loo, v_loo_norm, alpha, cone, abs_covariate): each key against
    the mean delta of the others: projection on its unit vector, the multiple of that mean
    that gives the key's own shift, the share on the mean activation, and the cosine with the
    deltas' slope on a covariate. All from sums of vectors."""
    d = deltas(df.select(key, layer, h, p, covariate), h, p)
    n = d.groupBy(layer).agg(F.count("*").alias("n"), F.avg(covariate).alias("cm"))
    s = sum_vector(d, layer, "delta", "s")
    both = F.zip_with(h, p, lambda x, y: (x + y) / 2)
    mu = mean_vector(d.select(layer, both.alias("m")), layer, "m", "mu")
    # the slope of the deltas on the covariate, up to a factor: sum of (x - mean) times delta
    away = F.array_repeat(F.col(covariate) - F.col("cm"), F.size("delta"))
    w = d.join(n, layer).select(layer, F.zip_with("delta", away, lambda x, y: x * y).alias("w"))
    beta = sum_vector(w, layer, "w", "beta")
    x = d.join(n.select(layer, "n"), layer).join(s, layer).join(mu, layer).join(beta, layer)
    x = x.withColumn("v", F.zip_with("s", "delta", lambda a, b: (a - b) / (F.col("n") - 1)))
    x = x.withColumn("vn", norm("v")).withColumn("q_loo", F.try_divide(dot("delta", "v"), "vn"))
    cosine = lambda a, b: F.try_divide(dot(a, b), norm(a) * norm(b))
    return x.select(layer, key, F.try_divide(F.col("q_loo"), norm("delta")).alias("loo_cos"), "q_loo", F.col("vn").alias("v_loo_norm"), F.try_divide("q_loo", "vn").alias("alpha"), F.pow(cosine("v", "mu"), F.lit(2.0)).alias("cone"), F.abs(cosine("v", "beta")).alias("abs_covariate"))


def without_axis(v: str, axis: str) -> Column:
    """v less its projection on an axis, at its old norm; null where nothing is left."""
    inverse = F.try_divide(dot(axis, axis), dot(v, axis))  # null where v has nothing to lose
    rest = F.coalesce(F.zip_with(v, divided(axis, inverse), lambda x, y: x - y), F.col(v))
    return F.when(norm_of(rest) > 0, divided(rest, norm_of(rest) / norm(v)))


def norm_of(c: Column) -> Column:
    return F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))


def matched_random(v: str, key: str, seed: int = 1) -> Column:
    """A vector of v's norm in a direction drawn from the key: sums of four uniform numbers
    of a hash, which are close to normal."""
    words = F.transform(F.sequence(F.lit(0), F.size(v) - 1), lambda i: F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"), F.lit(":"), i.cast("string"))))
    part = lambda h, k: F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("double") / 4294967296.0 - 0.5
    draws = F.transform(words, lambda h: part(h, 0) + part(h, 1) + part(h, 2) + part(h, 3))
    # inside a lambda, so that the draws are made once, not once more for their norm
    scaled = F.transform(F.array(draws), lambda d: divided(d, norm_of(d) / norm(v)))[0]
    return F.when(norm(v) > 0, scaled).otherwise(F.col(v))


def participation_ratio(df: DataFrame, group: str, v: str) -> DataFrame:
    """(group, ratio): the squared trace over the squared Frobenius norm of the second moments
    of unit vectors; tasks add up moment matrices, so no pairs of rows are made."""
    import numpy as np
    import pandas as pd

    kind = dict(df.dtypes)[group]

    def partial(it):
        held: dict = {}
        for pdf in it:
            for g, rows in pdf.groupby(group)["v"]:
                x = np.stack(rows)
                held[g] = held.get(g, 0) + x.T @ x
        if held:  # a part without rows has no types to go by
            yield pd.DataFrame({group: list(held), "m": [m.ravel() for m in held.values()]})

    def whole(pdf):
        m = np.sum(np.stack(pdf["m"]), axis=0)
        side = int(round(len(m) ** 0.5))
        return pd.DataFrame({group: [pdf[group].iloc[0]], "ratio": [float(np.trace(m.reshape(side, side)) ** 2 / (m**2).sum())]})

    u = df.select(group, unit(v).alias("v"))
    return u.mapInPandas(partial, f"{group} {kind}, m array<double>").groupBy(group).applyInPandas(whole, f"{group} {kind}, ratio double")


def group_means_between(unit_means: DataFrame, group: str, mean: str) -> DataFrame:
    """(a, b, distance): the mean cosine distance of all member pairs of two groups, which is
    one less the product of their mean unit vectors."""
    x, y = unit_means.alias("x"), unit_means.alias("y")
    return x.join(y, F.col(f"x.{group}") < F.col(f"y.{group}")).select(F.col(f"x.{group}").alias("a"), F.col(f"y.{group}").alias("b"), (1 - dot(F.col(f"x.{mean}"), F.col(f"y.{mean}"))).alias("distance"))


def second_half_mean(df: DataFrame, key: str, place: str, v: str) -> DataFrame:
    """(key, pooled): the mean vector over the second half of each key's places in order."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key)
    r = df.withColumn("r_", F.row_number().over(w.orderBy(place))).withColumn("n_", F.count("*").over(w))
    return mean_vector(r.where(F.col("r_") > F.floor(F.col("n_") / 2)), key, v, "pooled")
