"""Pairs, neighbours and ranks of groups that spread over tasks, against plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.operators import ordering, ranks, tiles, vectors as V

RNG = np.random.default_rng(41)


def frame(spark, groups):
    rows = [(g, k, x.tolist() if x is not None else None) for g, members in groups.items() for k, x in members]
    return spark.createDataFrame(rows, "family string, key long, v array<double>")


@pytest.fixture(scope="module")
def groups():
    x = RNG.normal(size=(70, 5))
    x[40:50] = x[30:40]  # equal distances
    return {"large": [(int(3 * i), x[i]) for i in range(70)], "pair": [(1, x[0]), (2, x[1])], "one": [(5, x[2])], "none": [(9, None), (8, x[3])]}


def unit(x):
    return x / np.linalg.norm(x)


@pytest.mark.parametrize("block", [7, 512])
def test_pairs_by_loops(spark, groups, block):
    df = frame(spark, groups).select("family", "key", V.unit("v").alias("u"))
    got = {(r["family"], r["a"], r["b"]): r["c"] for r in tiles.pair_cosines(df, "family", "key", "u", block).collect()}
    want = {}
    for g, members in groups.items():
        members = [m for m in members if m[1] is not None]
        for i, (a, x) in enumerate(members):
            for b, y in members[i + 1 :]:
                want[g, min(a, b), max(a, b)] = unit(x) @ unit(y)
    assert got.keys() == want.keys() and len(got) == 70 * 69 // 2 + 1
    assert all(got[p] == pytest.approx(want[p], abs=1e-12) for p in want)


@pytest.mark.parametrize("block", [9, 4096])
def test_neighbours_by_loops(spark, groups, block):
    df = frame(spark, groups).select("family", "key", V.unit("v").alias("u"))
    got = {}
    for r in tiles.nearest(df, "family", "key", "u", 4, block).collect():
        got.setdefault((r["family"], r["a"]), set()).add(r["b"])
    for g, members in groups.items():
        members = [m for m in members if m[1] is not None]
        for a, x in members:
            others = sorted((round(1 - min(1, unit(x) @ unit(y)), 9), b) for b, y in members if b != a)[:4]
            assert got.get((g, a), set()) == {b for _, b in others}


def test_no_task_holds_a_large_group(spark):
    """One group of 3,000: every tile has two blocks at most."""
    rows = spark.range(3000).select(F.lit(1).alias("family"), F.col("id").alias("key"), F.array(*[F.rand(i) for i in range(3)]).alias("u"))
    sizes = tiles.tiles(rows, "family", "key", "u", 250, lambda a, x, b, y, same: pd.DataFrame({"n": [len(a) + (0 if same else len(b))], "m": [len(a) * (len(a) - 1) // 2 if same else len(a) * len(b)]}), "n long, m long").collect()
    assert max(r["n"] for r in sizes) < 2 * 250 * 1.4 and sum(r["m"] for r in sizes) == 3000 * 2999 // 2


def test_grouped_ranks(spark):
    values = RNG.integers(0, 9, 300).tolist() + [None] * 5
    rows = [(i % 3 if i % 50 else None, i, float(v) if v is not None else None) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g int, key long, x double")
    got = {r["key"]: r["r"] for r in ranks.mid_rank(df, ["g"], "x", "r").collect()}
    assert len(got) == len(rows)
    for g, i, x in rows:
        own = [y for h, _, y in rows if h == g and y is not None]
        assert got[i] == (None if x is None else sum(y < x for y in own) + (sum(y == x for y in own) + 1) / 2)
    counts = {(r["g"], r["x"]): (r["n"], r["before"]) for r in ordering.grouped_value_counts(df, ["g"], "x").collect()}
    assert counts[1, 4.0] == (sum(g == 1 and x == 4 for g, _, x in rows), sum(g == 1 and x is not None and x < 4 for g, _, x in rows))


def test_grouped_quantiles(spark):
    rows = [(i % 4, float(x)) for i, x in enumerate(RNG.normal(size=203).round(1))] + [(7, 1.5), (8, None)]
    got = {(r["g"], r["share"]): r["value"] for r in ordering.grouped_quantiles(spark.createDataFrame(rows, "g int, x double"), ["g"], "x", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    for g in (0, 1, 2, 3, 7):
        own = [x for h, x in rows if h == g]
        for q in (0.0, 0.25, 0.5, 0.9, 1.0):
            assert got[g, q] == pytest.approx(np.quantile(own, q))
    assert (8, 0.5) not in got
