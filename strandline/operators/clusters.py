"""Evidence for clusters: silhouettes against nulls, stability under resampling, panels.

The unit of work is a chunk of replicates of a group, so that the replicates of one group
spread over tasks; each replicate draws from a generator keyed by group, kind and number, and
what tasks return are a few numbers a replicate, which Spark aggregates. A chunk holds its
group's vectors: groups above ``cap`` members are an error.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import transport as T
from strandline.operators.lineage import cut
from strandline.operators.resample import rng_for

NULLS, ISOTROPIC, RESAMPLES, CHUNK, CAP = 500, 100, 500, 20, 2000
KS = range(2, 9)


def spectral_rotation(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A cloud with the singular values of x and no clusters: a random orthonormal frame of
    its rows' space, scaled by them."""
    scale = np.linalg.svd(x, compute_uv=False)
    frame, corner = np.linalg.qr(rng.normal(size=(len(x), len(scale))))
    return frame * np.sign(np.diag(corner)) * scale[: frame.shape[1]]


def turned_rows(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rows of x's lengths in independent directions."""
    away = rng.normal(size=x.shape)
    return away * np.sqrt((x * x).sum(axis=1) / (away * away).sum(axis=1))[:, None]


def agreement(a: np.ndarray, b: np.ndarray) -> float:
    """Adjusted Rand index, from the table of both labels; 1 where it is undefined."""
    cells = np.unique(np.stack([a, b]), axis=1, return_counts=True)[1]
    two = lambda n: float((n * (n - 1.0)).sum()) / 2
    rows, columns = (two(np.unique(x, return_counts=True)[1]) for x in (a, b))
    chance = rows * columns / two(np.array([len(a)])) if len(a) > 1 else 0.0
    most = (rows + columns) / 2
    return (two(cells) - chance) / (most - chance) if most != chance else 1.0


def facts_of(x: np.ndarray, ks: range) -> np.ndarray:
    """(silhouette, log dispersion) of the cut at each k."""
    return np.array([(T.cosine_silhouette(x, c), T.log_dispersion(x, c)) for c in T.cuts(x, ks)])


def in_chunks(df: DataFrame, group: str, key: str, v: str, replicates: int, fn: Callable, ddl: str, extra: list[str] = [], cap: int = CAP) -> DataFrame:
    """fn(vectors, keys, the group's frame, numbers of replicates) -> columns after the group,
    for each chunk of replicates of each group."""
    kind = dict(df.dtypes)[group]
    large = df.groupBy(group).count().where(F.col("count") > cap).limit(1).collect()
    if large:
        raise ValueError(f"group {large[0][0]} has {large[0][1]} members; cap it at {cap} first")
    chunks = F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // CHUNK)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        chunk = int(pdf["chunk_"].iloc[0])
        out = fn(np.stack(pdf[v]), pdf[group].iloc[0], pdf, range(chunk * CHUNK, min(replicates, (chunk + 1) * CHUNK)))
        out.insert(0, group, pdf[group].iloc[0])
        return out

    return df.select(group, key, v, *extra).withColumn("chunk_", chunks).groupBy(group, "chunk_").applyInPandas(run, f"{group} {kind}, {ddl}")


def replicate_facts(df: DataFrame, group: str, key: str, v: str, kind: str, replicates: int, ks: range = KS) -> DataFrame:
    """(group, replicate, k, silhouette, dispersion) of a kind: "own" (one replicate, the
    vectors themselves), "spectrum" or "isotropic"."""
    draw = {"own": lambda x, rng: x, "spectrum": spectral_rotation, "isotropic": turned_rows}[kind]

    def fn(x, name, pdf, numbers):
        out = []
        for r in numbers:
            for k, (s, d) in zip(ks, facts_of(draw(x, rng_for(kind, name, r)), ks)):
                out.append((r, k, float(s), float(d)))
        return pd.DataFrame(out, columns=["replicate", "k", "silhouette", "dispersion"])

    return in_chunks(df, group, key, v, replicates, fn, "replicate int, k int, silhouette double, dispersion double")


def residuals(df: DataFrame, group: str, key: str, v: str) -> DataFrame:
    """Vectors less their group's mean."""
    from strandline.operators import vectors as V

    return df.join(V.mean_vector(df, group, v, "mean_"), group).select(group, key, F.zip_with(v, "mean_", lambda x, m: x - m).alias(v))


def existence(x: DataFrame, group: str, key: str, v: str, *, ks: range = KS, nulls: int = NULLS, isotropic: int = ISOTROPIC) -> DataFrame:
    """(group, k, silhouette, null_mean, null_sd, excess, p_at_k, isotropic_mean, gap, gap_se,
    p, best): excess of the silhouette over spectrum-matched nulls; p compares the greatest
    excess over k with that of every null, each centred on the same means."""
    own = replicate_facts(x, group, key, v, "own", 1, ks).select(group, "k", F.col("silhouette").alias("own_s"), F.col("dispersion").alias("own_d"))
    null = cut(replicate_facts(x, group, key, v, "spectrum", nulls, ks))
    turned = replicate_facts(x, group, key, v, "isotropic", isotropic, ks).groupBy(group, "k").agg(F.avg("silhouette").alias("isotropic_mean"))
    means = null.groupBy(group, "k").agg(F.avg("silhouette").alias("null_mean"), F.stddev("silhouette").alias("null_sd"), F.avg("dispersion").alias("d_mean"), F.stddev("dispersion").alias("d_sd"))
    base = cut(own.join(means, [group, "k"]).withColumn("excess", F.col("own_s") - F.col("null_mean")))
    at = null.join(base.select(group, "k", "own_s", "null_mean"), [group, "k"])
    per_k = at.groupBy(group, "k").agg(((F.count_if(F.col("silhouette") >= F.col("own_s")) + 1) / (nulls + 1)).alias("p_at_k"))
    top = base.groupBy(group).agg(F.max("excess").alias("top"), F.max_by("k", F.struct("excess", -F.col("k"))).alias("best_k"))
    most = at.groupBy(group, "replicate").agg(F.max(F.col("silhouette") - F.col("null_mean")).alias("most")).join(top, group)
    overall = most.groupBy(group).agg(((F.count_if(F.col("most") >= F.col("top")) + 1) / (nulls + 1)).alias("p"))
    out = base.join(per_k, [group, "k"]).join(turned, [group, "k"]).join(overall, group).join(top, group)
    return out.select(group, "k", F.col("own_s").alias("silhouette"), "null_mean", "null_sd", "excess", "p_at_k", "isotropic_mean", (F.col("d_mean") - F.col("own_d")).alias("gap"), (F.col("d_sd") * (1 + 1 / nulls) ** 0.5).alias("gap_se"), "p", (F.col("k") == F.col("best_k")).alias("best"))


def stability(x: DataFrame, best: DataFrame, group: str, key: str, v: str, *, resamples: int = RESAMPLES) -> DataFrame:
    """(group, k, sizes, bootstrap_median, bootstrap_q05, half_median): agreement of the cut at
    the best k with cuts of bootstrap samples (each member once) and of halves. best: (group,
    best_k)."""

    def fn(z, name, pdf, numbers):
        k, out = int(pdf["best_k"].iloc[0]), []
        whole = T.average_linkage(z, k)
        sizes = ",".join(map(str, np.bincount(whole)))
        for r in numbers:
            rng = rng_for("stability", name, r)
            drawn = np.unique(rng.integers(0, len(z), len(z)))
            order = rng.permutation(len(z))
            fitted, scored = order[: len(z) // 2], order[len(z) // 2 :]
            half = agreement(T.average_linkage(z[scored], k), whole[scored]) if len(np.unique(whole[fitted])) > 1 else None
            out.append((r, sizes, agreement(T.average_linkage(z[drawn], k), whole[drawn]), half))
        return pd.DataFrame(out, columns=["replicate", "sizes", "bootstrap", "half"])

    each = in_chunks(x.join(best, group), group, key, v, resamples, fn, "replicate int, sizes string, bootstrap double, half double", ["best_k"])
    at = lambda c, q: F.percentile(c, F.lit(q))
    out = each.groupBy(group).agg(F.first("sizes").alias("sizes"), at("bootstrap", 0.5).alias("bootstrap_median"), at("bootstrap", 0.05).alias("bootstrap_q05"), at("half", 0.5).alias("half_median"))
    return best.join(out, group).select(group, F.col("best_k").alias("k"), "sizes", "bootstrap_median", "bootstrap_q05", "half_median")


# -- panels ---------------------------------------------------------------------------------


def panel_cosines(d: np.ndarray, cluster: np.ndarray, k: int, rng: np.random.Generator, draws: int) -> np.ndarray:
    """(same against other, random against random) of each usable draw. A draw picks a row;
    its panels are the k of a mask with the least random marks. All draws' panels are one
    selection matrix, whose product with d has their sums."""
    n = len(d)
    row = rng.integers(0, n, draws)
    alone = np.arange(n)[None, :] == row[:, None]
    own = (cluster[None, :] == cluster[row][:, None]) & ~alone
    other = cluster[None, :] != cluster[row][:, None]
    usable = (own.sum(axis=1) >= k) & (other.sum(axis=1) >= k)
    own, other, alone = own[usable], other[usable], alone[usable]

    def panels(allowed: np.ndarray, size: int) -> np.ndarray:
        marks = np.where(allowed, rng.random(allowed.shape), 2.0)
        return np.argsort(marks, axis=1)[:, :size]

    def sums(picked: np.ndarray) -> np.ndarray:
        choice = np.zeros((len(picked), n))
        np.put_along_axis(choice, picked, 1.0, axis=1)
        return choice @ d

    free = panels(~alone, 2 * k)
    pairs = ((sums(panels(own, k)), sums(panels(other, k))), (sums(free[:, :k]), sums(free[:, k:])))
    return np.stack([(T.unit_rows(a) * T.unit_rows(b)).sum(axis=1) for a, b in pairs], axis=1)


def panel_contrast(df: DataFrame, group: str, key: str, v: str, *, clusters: int = 3, ks: tuple[int, ...] = (3, 4, 5, 6, 8, 12, 16), draws: int = 2000, least: int = 50) -> DataFrame:
    """(group, k, draws, same, random, contrast): whether panels of k of one cluster point
    away from panels of the others more than two random panels do; means over usable draws,
    null where fewer than ``least`` are."""

    def fn(x, name, pdf, numbers):
        label = T.average_linkage(x, min(clusters, len(x)))
        out = []
        for k in ks:
            found = panel_cosines(x, label, k, rng_for("panel", name, k, numbers[0]), len(numbers)) if len(x) > 2 * k else np.zeros((0, 2))
            out.append((k, len(found), *map(float, found.sum(axis=0))))
        return pd.DataFrame(out, columns=["k", "n", "same", "random"])

    each = in_chunks(df, group, key, v, draws, fn, "k int, n long, same double, random double")
    sums = each.groupBy(group, "k").agg(F.sum("n").alias("draws"), F.sum("same").alias("s"), F.sum("random").alias("r"))
    mean = lambda c: F.when(F.col("draws") >= least, F.col(c) / F.col("draws"))
    return sums.select(group, "k", "draws", mean("s").alias("same"), mean("r").alias("random")).withColumn("contrast", F.col("random") - F.col("same"))
