"""Results and plans that hold at any size: nothing grown out of arrays is broadcast, no group's
members are paired, sums don't overflow, memory doesn't follow the number of draws."""

import hashlib
import itertools
import tracemalloc

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.operators import align, kmers, pair_ranks, paired, preservation, ranks, resample, sites, tiles, transport, trees, vectors
from strandline.plans import paired_queries, registry
from strandline.sources import publish

DIR = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_consensus_is_one_aggregate_of_the_votes(spark):
    v = spark.createDataFrame([(1, 0, "A", 2), (1, 0, "C", 2), (1, 1, "G", 3), (1, 1, "T", 1), (2, 0, "T", 1)], "k int, i int, base string, n long")
    got = sites.consensus(v, "k")
    assert sorted(map(tuple, got.collect())) == [(1, 0, "-"), (1, 1, "G"), (2, 0, "T")]
    assert "Join" not in plan_of(got)


def test_shared_bases_without_pairs_of_members(spark):
    rng = np.random.default_rng(3)
    rows = [(k, k // 4, "".join(rng.choice(list("ACGTN"), 6)), "".join(rng.choice(list("ACGT"), 6))) for k in range(17)]
    df = spark.createDataFrame(rows, "key long, grp long, a string, b string")
    got = sites.with_others(sites.differing(df, "key", "a", "b", "grp"), sites.shown(df, "b", "key", "grp"), "key", "grp")
    want = sorted((k, i, b[i], any(g == h and k != l and i < len(c) and c[i] == b[i] for l, h, _, c in rows)) for k, g, a, b in rows for i in range(6) if a[i] != b[i])
    assert sorted((r["key"], r["i"], r["p"], r["shared"]) for r in got.collect()) == want


def test_private_sites_pair_no_members(spark):
    assert "(key#" not in "".join(x for x in plan_of(registry.QUERIES["private_sites"](spark, DIR)).splitlines() if "Join Inner" in x)


def test_two_site_sets_make_one_alignment(spark):
    assert plan_of(registry.QUERIES["two_site_sets"](spark, DIR)).count("MapInPandas") == 1


def test_gapped_site_sets_make_each_alignment_once(spark):
    plan = plan_of(registry.QUERIES["gapped_site_sets"](spark, DIR))
    assert plan.count("MapInPandas") == 2 and plan.count("strategy=merge") == 2


def test_hits_of_several_sets(spark):
    calls = spark.createDataFrame([(1, [0, 1, -1]), (2, [3]), (3, None)], "key int, calls array<int>")
    wanted = spark.createDataFrame([(1, 0, "A", True), (1, 1, "G", False), (1, 2, "T", True), (1, 9, "A", True), (3, 0, "A", True)], "key int, i int, base string, f boolean")
    got = align.site_set_hits(calls, wanted, "key", {"all": F.lit(True), "f": F.col("f")})
    assert sorted(map(tuple, got.collect())) == [(1, 3, pytest.approx(100 / 3), 2, 50.0), (2, 0, None, 0, None), (3, 0, None, 0, None)]


def test_shuffle_null_joins_nothing(spark):
    rows = [(1, "A", "C", "C"), (1, "A", "G", "C"), (1, "A", "C", "T"), (1, "T", "A", "A"), (2, "A", "C", "G")]
    got = paired.shuffle_null(spark.createDataFrame(rows, "key int, h string, p string, y string"), ["key"], ["h"], "p", "y")
    assert sorted(map(tuple, got.collect())) == [(1, pytest.approx(2 * 2 / 3 + 1))]
    assert "Join" not in plan_of(got)


def test_checksums_of_many_rows(spark):
    df = spark.range(140_000).select(F.lit("x").alias("name"), F.lit(0).alias("layer"), "id", F.lit(1.0).alias("v"))
    n, first, second, third = publish.invariant_copies(df, "name", "layer", ["id"], "v").first()["checksum"].split(":")
    assert int(n) == 140_000 and int(first) > 2**63 and int(second) > 2**63
    assert int(third) == sum(int(hashlib.md5(f"{i}|1.000000".encode()).hexdigest()[24:], 16) for i in range(140_000))


def test_participation_ratio_with_a_part_without_rows(spark):
    x = np.random.default_rng(5).normal(size=(6, 3))
    df = spark.createDataFrame([(0, v.tolist()) for v in x], "g int, v array<double>").repartition(1).union(spark.createDataFrame([], "g int, v array<double>"))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert vectors.participation_ratio(df, "g", "v").first()["ratio"] == pytest.approx(36 / ((u @ u.T) ** 2).sum())


@pytest.mark.parametrize("lengths", [(0.5, 3.0), (-2.0, 1.0)])
def test_tip_distances_by_blocks(spark, lengths):
    rng = np.random.default_rng(7)
    up = {0: None} | {n: int(rng.integers(0, n)) for n in range(1, 30)}
    length = {n: float(rng.uniform(*lengths)) for n in up}
    nodes = spark.createDataFrame([(f"n{n:02d}", None if p is None else f"n{p:02d}", length[n]) for n, p in up.items()], "node string, up string, len double")
    tips = [n for n in range(10, 30)]

    def above(n):
        out, d = {}, 0.0
        while n is not None:
            out[n] = d
            d, n = d + length[n], up[n]
        return out

    want = {}
    for a, b in itertools.combinations(tips, 2):
        x, y = above(a), above(b)
        want[f"n{a:02d}", f"n{b:02d}"] = min(x[c] + y[c] for c in x.keys() & y.keys())
    got = trees.patristic(trees.ancestors(nodes, "node", "up", "len"), spark.createDataFrame([(f"n{t:02d}",) for t in tips], "node string"), "node", block=3)
    assert "Aggregate" not in plan_of(got).split("Join")[0]
    found = [(r["a"], r["b"], r["d"]) for r in got.collect()]
    assert len(found) == len(want) and {(a, b): pytest.approx(d) for a, b, d in found} == want


def test_tree_statistics_need_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(trees, "patristic", None)
    assert registry.QUERIES["tree_stats"](spark, DIR).first()["diameter"] > 0


def test_kmer_distances_by_tiles(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(k, "fg"[k % 2], "".join(rng.choice(list("ACGT"), 12 + k))) for k in range(9)]
    freq = kmers.frequencies(spark.createDataFrame(rows, "key int, family string, s string"), "key", "s", 3, group="family")
    got = {(r["a"], r["b"]): r["distance"] for r in kmers.distances(freq, "key", "family").collect()}
    count = lambda s: pd.Series([s[i : i + 3] for i in range(len(s) - 2)]).value_counts(normalize=True)
    for (a, f, s), (b, g, t) in itertools.combinations(rows, 2):
        x, y = count(s).align(count(t), fill_value=0.0)
        assert (f == g) == ((a, b) in got)
        if f == g:
            assert got[a, b] == pytest.approx(1 - x @ y / np.sqrt((x @ x) * (y @ y)), abs=1e-12)
    assert "Join Inner, (((" not in plan_of(kmers.distances(freq, "key", "family")) and "FlatMapGroupsInPandas" in plan_of(kmers.distances(freq, "key", "family"))


def test_sparse_tiles_in_slabs(spark, monkeypatch):
    monkeypatch.setattr(tiles, "SLAB", 2)
    x = np.array([[1.0, 0, 2, 0, 3], [0, 4, 0, 0, 1], [2, 2, 2, 2, 2]])
    df = spark.createDataFrame([(k, 0, [*map(float, np.flatnonzero(v)), *v[v > 0].tolist()]) for k, v in enumerate(x)], "k int, g int, u array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for block in (1, 512):
        got = tiles.sparse_pair_cosines(df, "g", "k", "u", block).collect()
        assert {(r["a"], r["b"]): pytest.approx(r["c"]) for r in got} == {(a, b): float(u[a] @ u[b]) for a, b in itertools.combinations(range(3), 2)}


def test_sign_flips_in_bounded_memory(monkeypatch):
    v = np.random.default_rng(1).normal(0.1, 1, 40_001)
    tracemalloc.start()
    some = resample.sign_flip(v, np.random.default_rng(2), 300)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    flips = np.random.default_rng(2).integers(0, 2, (300, len(v))) * 2 - 1
    null = np.abs((flips * v).mean(axis=1))
    assert peak < 80e6 and some == (float(v.mean()), float(((null >= abs(v.mean()) - 1e-15).sum() + 1) / 301))


def test_matrix_gather_moves_no_pairs(spark):
    assert "strategy=broadcast" in plan_of(registry.QUERIES["matrix_gather"](spark, DIR))


def test_pairs_of_large_groups_by_few_blocks_in_strips(spark, monkeypatch):
    monkeypatch.setattr(tiles, "BLOCKS", 2)
    monkeypatch.setattr(tiles, "WIDE_BLOCK", 8)
    monkeypatch.setattr(tiles, "PAIR_STRIP", 3)
    x = np.random.default_rng(4).normal(size=(30, 4))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(k, k // 25, v.tolist()) for k, v in enumerate(u)], "k int, g int, u array<double>")
    got = tiles.pair_cosines(df, "g", "k", "u", block=2).collect()
    want = {(a, b): pytest.approx(float(u[a] @ u[b])) for a, b in itertools.combinations(range(30), 2) if a // 25 == b // 25}
    assert len(got) == len(want) and {(r["a"], r["b"]): r["c"] for r in got} == want
    sent = tiles._dealt(df, "g", "k", "u", tiles.pair_blocks(2))
    assert sent.groupBy("g_").count().sort("g_").collect() == [(0, 25 * 4), (1, 5 * 2)]


@pytest.mark.parametrize("strip", [7, 10**6])
def test_pair_ranks_need_no_rows_of_pairs(spark, strip):
    rng = np.random.default_rng(11)
    rows = [(g, k, float(rng.integers(0, 5)), float(rng.normal()) if k % 6 else float("nan")) for g, n in enumerate((1, 3, 14, 15)) for k in range(n)]
    rows += [(4, k, 1.0, float(k)) for k in range(9)]  # one side constant
    df = spark.createDataFrame(rows, "g int, k int, x double, y double")
    fn = lambda a, b: tuple(np.abs(a[c][:, None] - b[c]) for c in "xy")
    got = {r["g"]: (r["n"], r["rho"]) for r in pair_ranks.spearman(df, ["g"], "k", ["x", "y"], fn, strip=strip).collect()}
    pairs = [(g, abs(x - z), abs(y - w)) for (g, k, x, y), (h, j, z, w) in itertools.combinations(rows, 2) if g == h]
    want = {r["g"]: (r["n"], r["rho"]) for r in ranks.spearman(spark.createDataFrame(pairs, "g int, x double, y double"), ["g"], "x", "y").collect()}
    assert set(got) == set(want) == {1, 2, 3, 4} and want[2][1] is not None and want[4][1] is None
    assert all(got[g][0] == n and (got[g][1] is None) == (rho is None) and (rho is None or got[g][1] == pytest.approx(rho, abs=1e-12)) for g, (n, rho) in want.items())


def test_spearman_of_families_puts_out_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "pair_distances", None)
    assert registry.QUERIES["within_family_spearman"](spark, DIR).count() == 10


def test_average_linkage_without_a_matrix():
    rng = np.random.default_rng(17)
    for m in (1, 2, 30):
        x = rng.normal(size=(m, 4))
        u = x / np.linalg.norm(x, axis=1)[:, None]
        groups = [[i] for i in range(m)]
        while len(groups) > min(3, m):
            a, b = min(itertools.combinations(range(len(groups)), 2), key=lambda p: 1 - (u[groups[p[0]]] @ u[groups[p[1]]].T).mean())
            groups[a] += groups.pop(b)
        label = transport.average_linkage(x, min(3, m))
        assert sorted(sorted(np.flatnonzero(label == c).tolist()) for c in set(label)) == sorted(map(sorted, groups))
        copies = transport.average_linkage(np.tile(x, (5, 1)), min(3, m))
        assert (copies.reshape(5, m) == label).all()
    x = rng.normal(size=(2000, 8))
    tracemalloc.start()
    transport.average_linkage(x, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4e6  # a matrix of the distances has 32 MB


def test_controls_put_out_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(13)
    names = ("natural", "light")
    rows = [(c, f, p, k, int(k % 4), rng.normal(size=5).tolist()) for c in names for f in (0, 1) for p in (0, 1) for k in range(9) if (c, k) != ("natural", 8)]
    tree = {(0, 1): 1.0, (0, 2): 2.5, (1, 2): 2.0}  # species 3 has no place in it
    got = preservation.within_vectors(spark.createDataFrame(rows, "condition string, family int, grp int, key int, species int, v array<double>"), "natural", tree)
    angle = lambda x, y: round(float(np.arccos(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)) / np.pi), 9)
    pairs = [(x[0], x[1], x[2], x[3], y[3], x[4], y[4], angle(x[5], y[5])) for x, y in itertools.combinations(rows, 2) if x[:3] == y[:3]]
    want = preservation.within(spark.createDataFrame(pairs, "condition string, family int, grp int, a int, b int, species_a int, species_b int, d double"), "natural", spark.createDataFrame([(a, b, d) for (a, b), d in tree.items()], "a int, b int, d double"))
    both = [sorted(map(tuple, x.collect())) for x in (got, want)]
    assert len(both[0]) == len(both[1]) == 4 and all(a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], abs=1e-9) for a, b in zip(*both))
    monkeypatch.setattr(preservation, "within", None)
    assert registry.QUERIES["controls_against_tree"](spark, DIR).count() == 30


def test_sweeps_shuffle_nothing_by_ancestor(spark):
    nodes = spark.createDataFrame([("r", None, 0.0), ("i", "r", 1.0), ("a", "i", 2.0), ("b", "i", 5.0), ("c", "r", 0.5)], "node string, up string, len double")
    tips = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    got = trees.diameter(trees.ancestors(nodes, "node", "up", "len"), tips, "node")
    assert {got.first()["a"], got.first()["b"]} == {"a", "b"} and got.first()["d"] == 7.0
    assert plan_of(got).count("strategy=broadcast") == 2


def copied_events(spark, folder) -> tuple[pd.DataFrame, int, pd.DataFrame]:
    """(events, genes, eight copies of the events), which are written in six files."""
    e = pd.read_parquet(f"{DIR}/events.parquet")
    genes, rows = int(e["user_id"].max()) + 1, int(e["event_id"].max()) + 1
    copies = pd.concat([e.assign(user_id=e["user_id"] + i * genes, event_id=e["event_id"] + i * rows) for i in range(8)])[["event_id", "user_id", "event_type", "value"]]
    spark.createDataFrame(copies).repartition(6).write.parquet(f"{folder}/events.parquet")
    return e, genes, copies


def test_means_hang_on_no_partial_sums(spark, tmp_path):
    e, genes, _ = copied_events(spark, tmp_path)
    total = {}
    for r in e.sort_values("event_id").itertuples():
        s, n = total.get((r.user_id, r.event_type), (0.0, 0))
        total[r.user_id, r.event_type] = (s + r.value, n + 1)
    mean = {k: s / n for k, (s, n) in total.items()}
    want = {(g + i * genes, c): m - mean[g, "view"] for (g, c), m in mean.items() for i in range(8) if c != "view" and (g, "view") in mean}
    assert {(r["gene"], r["condition"]): r["delta"] for r in paired_queries._deltas(spark, str(tmp_path)).collect()} == want


@pytest.mark.parametrize("name", ["partial_correlation", "rate_direction_grid"])
def test_ranks_of_copies_tie(spark, tmp_path, name):
    _, _, events = copied_events(spark, tmp_path)
    con = duckdb.connect()
    con.sql("SET threads = 1")
    con.register("events", events)
    want = con.sql(registry.ORACLE_SQL[name])
    got = registry.QUERIES[name](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_kmer_distances_of_sequences(spark, monkeypatch):
    rng = np.random.default_rng(21)
    rows = [(k, "fg"[k % 2], "".join(rng.choice(list("ACGTNa"), 30, p=[0.23, 0.23, 0.23, 0.23, 0.04, 0.04]))) for k in range(23)]
    rows += [(4, "f", "ACGTACGT"), (50, "f", None), (51, "g", ""), (52, "g", "AC"), (53, "f", "ACNGTé"), (54, "f", "éACGéT")]
    df = spark.createDataFrame(rows, "key int, family string, s string")
    want = {(r["a"], r["b"]): pytest.approx(r["distance"], abs=1e-12) for r in kmers.distances(kmers.frequencies(df, "key", "s", 3, group="family"), "key", "family").collect()}
    for strip, slab, numbers in ((3, 2, 100), (32, 4096, 1 << 20)):
        monkeypatch.setattr(tiles, "PAIR_STRIP", strip)
        monkeypatch.setattr(tiles, "SLAB", slab)
        monkeypatch.setattr(tiles, "STRIP", 2 * strip)
        texts = kmers.sequence_distances(df, "key", "family", "s", 3)
        got = texts.collect()
        assert len(got) == len(want) and {(r["a"], r["b"]): r["distance"] for r in got} == want
        small = tiles.sparse_pair_cosines(df.where("length(s) > 20"), "family", "key", "s", 4, kmers.counted(3), F.length, numbers).collect()
        assert all(1 - r["c"] == want[r["a"], r["b"]] for r in small if 4 not in (r["a"], r["b"])) and len(small) == 66 + 55
    assert "kmer" not in plan_of(registry.QUERIES["kmer_distance"](spark, DIR))


def test_sparse_rows_go_to_few_blocks(spark):
    df = spark.range(4000).selectExpr("id AS k", "id DIV 3900 AS g", "'ACGT' AS u")
    count = lambda most: {r["g_"]: r["count"] for r in tiles._dealt(df, "g", "k", "u", tiles.pair_blocks(100, F.length("u_"), most)).groupBy("g_").count().collect()}
    assert count(1 << 20) == {0: 3900 * 8, 1: 100} and count(1000) == {0: 3900 * 16, 1: 100}


def test_vectors_move_as_floats(spark, monkeypatch):
    x = np.random.default_rng(6).normal(size=(40, 5)).astype(np.float32)
    x[7] = 0
    df = spark.createDataFrame([(k, k // 30, v.tolist()) for k, v in enumerate(x)], "key int, family int, v array<float>")
    moved, real = [], tiles._dealt
    monkeypatch.setattr(tiles, "_dealt", lambda *a: moved.append(real(*a)) or moved[-1])
    monkeypatch.setattr(tiles, "PAIR_BLOCK", 8)
    got = {(r["a"], r["b"]): r["cosine"] for r in vectors.pair_distances(df, "key", "family", "v").collect()}
    u = x.astype(float) / np.maximum(np.linalg.norm(x.astype(float), axis=1), 1e-12)[:, None]
    assert got == {(a, b): pytest.approx(1 - float(u[a] @ u[b]), abs=1e-12) for a, b in itertools.combinations(range(40), 2) if a // 30 == b // 30}
    registry.QUERIES["angular_pairs"](spark, DIR)
    registry.QUERIES["cosine_pairs"](spark, DIR)
    assert [dict(m.dtypes)["u_"] for m in moved] == ["array<float>"] * 3


def test_blocks_by_numbers(spark, monkeypatch):
    monkeypatch.setattr(tiles, "WIDE_NUMBERS", 100)
    df = spark.range(60).selectExpr("id AS k", "0 AS g", "array_repeat(1D, 10) AS u")
    moved, real = [], tiles._dealt
    monkeypatch.setattr(tiles, "_dealt", lambda *a: moved.append(real(*a)) or moved[-1])
    assert tiles.pair_cosines(df, "g", "k", "u", 30).count() == 60 * 59 // 2
    assert moved[0].count() == 60 * 6


def test_member_pairs_by_tiles(spark, monkeypatch):
    monkeypatch.setattr(tiles, "BLOCKS", 3)
    rows = [(k, k // 25, k % 4) for k in range(45)]
    df = spark.createDataFrame([*rows, (99, None, 1)], "key int, family int, species int")
    got = tiles.member_pairs(df, "family", "key", "species", block=4)
    want = sorted((f, a, b, s, t) for (a, f, s), (b, g, t) in itertools.combinations(rows, 2) if f == g)
    assert sorted(map(tuple, got.collect())) == want
    assert "i_#" in "".join(x for x in plan_of(registry.QUERIES["matrix_gather"](spark, DIR)).splitlines() if "Join Inner" in x)
