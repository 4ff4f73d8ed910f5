"""Resampling by group: bootstrap intervals, permutation and sign-flip nulls, Mantel.

Draws are made inside the task of a group, seeded by crc32 of its key, never exploded to
rows. Groups are cells of a summary (a condition, a layer, a family).
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import tails


#: Signs drawn together, 8 bytes each.
FLIPS = 1 << 21


def rng_for(*key) -> np.random.Generator:
    return np.random.default_rng(zlib.crc32("|".join(map(str, key)).encode()))


def seed_of(keys: list, separator: str, plus: int = 0) -> Column:
    """A seed from keys: the crc32 of their joined text, and a constant."""
    return F.crc32(F.concat_ws(separator, *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]).cast("binary")) + F.lit(plus)


def bootstrap(x: np.ndarray, rng: np.random.Generator, draws: int = 2000, stat=np.mean, least: int = 3) -> tuple[float, float]:
    """The 2.5 and 97.5 percentiles of a statistic; NaN below ``least`` values."""
    x = x[np.isfinite(x)]
    if len(x) < least:
        return float("nan"), float("nan")
    out = np.concatenate([stat(x[rng.integers(0, len(x), (min(200, draws - a), len(x)))], axis=1) for a in range(0, draws, 200)])
    return tuple(float(v) for v in np.percentile(out, [2.5, 97.5]))


def by_group(df: DataFrame, by: list[str], x: str, fn, ddl: str) -> DataFrame:
    """fn(values, rng) -> tuple for each group; ddl: its columns."""
    names = [c.split()[0] for c in ddl.split(", ")]
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key = [pdf[c].iloc[0] for c in by]
        values = np.sort(pdf[x].to_numpy(float))
        return pd.DataFrame([[*key, *fn(values, rng_for(*key))]], columns=[*by, *names])

    return df.select(*by, x).groupBy(*by).applyInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in by), ddl]))


def bootstrap_ci(df: DataFrame, by: list[str], x: str, draws: int = 2000, median: bool = False) -> DataFrame:
    stat = np.median if median else np.mean
    return by_group(df, by, x, lambda v, r: (len(v), float(stat(v)), *bootstrap(v, r, draws, stat)), "n long, estimate double, low double, high double")


def signed_rank_test(df: DataFrame, by: list[str], x: str) -> DataFrame:
    return by_group(df, by, x, lambda v, r: (len(v), tails.signed_rank_two_sided(v)), "n long, p double")


def sign_flip(v: np.ndarray, rng: np.random.Generator, draws: int = 2000) -> tuple[float, float]:
    """(mean, p): two-sided, (c + 1) / (n + 1). Some draws at a time, the same ones as all at
    once: memory follows the values, not values times draws."""
    some = max(1, FLIPS // max(1, len(v)))
    null = np.concatenate([np.abs(((rng.integers(0, 2, (min(some, draws - at), len(v))) * 2 - 1) * v).mean(axis=1)) for at in range(0, draws, some)])
    return float(v.mean()), float(((null >= abs(v.mean()) - 1e-15).sum() + 1) / (draws + 1))


def sign_flip_test(df: DataFrame, by: list[str], x: str, draws: int = 2000) -> DataFrame:
    return by_group(df, by, x, lambda v, r: sign_flip(v, r, draws), "mean double, p double")


def mid_ranks(x: np.ndarray) -> np.ndarray:
    _, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - (counts - 1) / 2)[inverse]


def mantel(a: np.ndarray, b: np.ndarray, rng: np.random.Generator, draws: int = 999) -> tuple[float, float]:
    """(rho, one-sided p) of two distance matrices: ranks are taken once and permuted."""
    i, j = np.triu_indices(len(a), 1)
    ra, rb = mid_ranks(a[i, j]), np.zeros_like(b)
    rb[i, j] = mid_ranks(b[i, j])
    rb += rb.T
    ra = ra - ra.mean()

    rb -= rb[i, j].mean()  # permuting rows and columns moves places, not values
    scale = np.sqrt((ra**2).sum() * (rb[i, j] ** 2).sum())

    def rho(order: np.ndarray) -> float:
        return float(ra @ rb[order[i], order[j]] / scale)

    own = rho(np.arange(len(a)))
    hits = sum(rho(rng.permutation(len(a))) >= own - 1e-12 for _ in range(draws))
    return own, (hits + 1) / (draws + 1)


def one_component_removed(x: np.ndarray) -> np.ndarray:
    """Leave-one-out cosine with the others' sum after their first component is taken out."""
    out = np.empty(len(x))
    tall, gram, total = len(x) > 2 * x.shape[1], x.T @ x, x.sum(axis=0)
    for i in range(len(x)):
        if tall:  # the first component is the top eigenvector of the others' second moments
            first, others = np.linalg.eigh(gram - np.outer(x[i], x[i]))[1][:, -1], total - x[i]
        else:
            rest = np.delete(x, i, axis=0)
            first, others = np.linalg.svd(rest, full_matrices=False)[2][0], rest.sum(axis=0)
        clean = lambda v: v - (v @ first) * first
        a, b = clean(x[i]), clean(others)
        scale = np.linalg.norm(a) * np.linalg.norm(b)
        out[i] = a @ b / scale if scale > 0 else np.nan
    return out


def split_half(x: np.ndarray, rng: np.random.Generator, draws: int = 1000) -> float:
    """Mean cosine of the sums of random halves."""
    n, total, out = len(x), x.sum(axis=0), np.empty(draws)
    for d in range(draws):
        a = x[rng.permutation(n)[: n // 2]].sum(axis=0)
        b = total - a
        out[d] = a @ b / np.sqrt((a @ a) * (b @ b))
    return float(out.mean())


def grouped_vectors(df: DataFrame, group: str, key: str, v: str, fn, ddl: str) -> DataFrame:
    """fn(array, keys, rng) -> DataFrame columns after the group; one group (a layer or a
    family of bounded size) a task."""
    kind = dict(df.dtypes)[group]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        out = fn(np.stack(pdf[v]), pdf[key].to_numpy(), rng_for(pdf[group].iloc[0]))
        out.insert(0, group, pdf[group].iloc[0])
        return out

    return df.select(group, key, v).groupBy(group).applyInPandas(run, f"{group} {kind}, {ddl}")


def family_uncertainty(v: np.ndarray, rng: np.random.Generator, draws: int = 10_000) -> tuple[int, float, float, float, float, float, bool]:
    """(n, mean, sd, low, high, p, whether the interval leaves out zero)."""
    v = v[np.isfinite(v)]
    low, high = bootstrap(v, rng, draws)
    sd = float(v.std(ddof=1)) if len(v) > 1 else float("nan")
    return len(v), float(v.mean()) if len(v) else float("nan"), sd, low, high, tails.signed_rank_two_sided(v), bool(low > 0 or high < 0)


def shuffled_agreement(hit: np.ndarray, wanted: np.ndarray, stratum: np.ndarray, rng: np.random.Generator, draws: int = 1000, n: np.ndarray | None = None) -> tuple[float, float, float, float]:
    """(closed-form expectation, mean and sd of shuffles within strata, z between them). An
    error where they differ by more than eight standard errors.

    Rows are cells of n sites (one without n). A shuffle of a stratum deals its hits to its
    wanted values, so a draw is a table with fixed margins: its cells are hypergeometric one
    after the other, and no site has to be moved."""
    n = np.ones(len(hit), np.int64) if n is None else n.astype(np.int64)
    values, place = np.unique(np.concatenate([hit, wanted]), return_inverse=True)
    hit, wanted = place[: len(hit)], place[len(hit) :]
    expected, found = 0.0, np.zeros(draws)
    for s in np.unique(stratum):
        own = stratum == s
        held, asked = (np.bincount(x[own], weights=n[own], minlength=len(values)).astype(np.int64) for x in (hit, wanted))
        expected += float(held @ asked) / held.sum()
        left = np.repeat(held[None, :], draws, axis=0)
        for v, size in enumerate(asked):
            rest, take = left.sum(axis=1), np.full(draws, size)
            for c in range(len(values)):
                got = rng.hypergeometric(left[:, c], rest - left[:, c], take)
                rest, take = rest - left[:, c], take - got
                left[:, c] -= got
                if c == v:
                    found += got
    error = found.std(ddof=1) / np.sqrt(draws)
    z = (found.mean() - expected) / error if error > 0 else 0.0
    if abs(z) > 8:
        raise ValueError(f"shuffles and their expectation disagree: z = {z:.1f}")
    return float(expected), float(found.mean()), float(found.std(ddof=1)), float(z)
