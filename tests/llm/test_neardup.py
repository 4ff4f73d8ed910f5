import numpy as np
import xxhash

from strandline.llm import similar as G, simhash as S
from strandline.llm.components import components

from .conftest import ODD


def naive(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
    ones = [sum(xxhash.xxh64_intdigest(x, 42) >> b & 1 for x in sh) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(sh))


def classes(fps, ids, k=4):
    """The least id reachable, by comparing all pairs."""
    a = np.array(fps, np.uint64)
    near = [np.flatnonzero(np.bitwise_count(a ^ x) <= k) for x in a]
    label = np.array(ids)
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return label.tolist()
        label = new


def test_against_all_pairs(spark, make, sample):
    rows = sample + [(10_000 + i, t + " extra") for i, t in sample[:40]] + [(20_000 + i, t) for i, t in sample[:30]]
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in S.near_duplicates(make(rows)).collect()}
    fps = [naive(t) for _, t in rows]
    want = classes(fps, [i for i, _ in rows])
    assert got == {i: (f, c) for (i, _), f, c in zip(rows, fps, want)}


def test_small_tries_and_hot_ones_agree(spark, make):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 6, dtype=np.int64)
    fps = sorted({int(b ^ (1 << int(x)) ^ (1 << int(y))) for b in base for x, y in rng.integers(0, 62, (60, 2))} | {int(x) for x in rng.integers(0, 2**63, 300)})
    reps = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, rep long")
    want = classes(fps, list(range(len(fps))))
    for target, most in ((512, 20_000), (1, 20_000), (512, 8)):
        edges = S.links(reps, 4, target=target, most=most)
        found = {r["node"]: r["component"] for r in components(edges).collect()}
        assert [found.get(i, i) for i in range(len(fps))] == want


def test_trie_walk_finds_every_link():
    rng = np.random.default_rng(2)
    a = np.unique(np.concatenate([rng.integers(0, 2**64, 200, dtype=np.uint64), np.uint64(5) ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64))]))
    found = {(int(i), int(j)) for x, y in S.trie_links(a, tuple(np.array([x]) for x in (0, len(a), 0, len(a))), 4) for i, j in zip(x, y)}
    assert found == {(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if bin(int(a[i] ^ a[j])).count("1") <= 4}


def test_odd_rows(odd, make):
    rows = S.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["fp"], r["component_id"]))
    assert by[1] == [(0, 1)] and by[2] == by[3] == [(0, 1)]
    assert by[5][0] == by[5][1] and by[6][0][1] == 5
    assert all(c is None for _, c in by[None])
    assert S.near_duplicates(make([])).collect() == []


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def similar_classes(rows, least=0.8):
    """The least doc_id reachable over pairs of a Jaccard similarity, comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    near = [[j for j, b in enumerate(sets) if a == b or len(a & b) >= least * len(a | b)] for a in sets]
    label = [i for i, _ in rows]
    while True:
        new = [min(label[j] for j in n) for n in near]
        if new == label:
            return label
        label = new


def edited(text, n, seed):
    rng = np.random.default_rng(seed)
    w = text.split(" ")
    for k in rng.integers(0, len(w), n):
        w[k] = f"edit{seed}x{k}"
    return " ".join(w)


def test_groups_of_similar_texts(make, sample):
    base = [(i, t) for i, t in sample if 60 < len(t.split()) < 600][:60]
    rows = list(sample)
    for n, (i, t) in enumerate(base):
        words = len(t.split())
        rows += [(10_000 + 100 * n + c, edited(t, max(1, words * (1 + c % 3) // 100), 7 * n + c)) for c in range(4)]
    want = similar_classes(rows)
    for most in (4096, 6):
        got = {r["doc_id"]: r["component_id"] for r in G.groups(make(rows), most=most).collect()}
        wrong = [i for (i, _), c in zip(rows, want) if got[i] != c]
        assert len(wrong) <= 0.005 * len(rows), (most, len(wrong))
    assert sum(i != c for (i, _), c in zip(rows, want)) > 150


def test_a_family_of_near_copies(make, sample):
    """Hundreds of near copies and texts that share one long passage with each other only."""
    text = next(t for _, t in sample if 150 < len(t.split()) < 400)
    passage = " ".join(f"common{i}" for i in range(40))
    rows = [(i, edited(text, 1, i)) for i in range(150)] + [(1000 + i, f"{passage} " + " ".join(f"own{i}w{k}" for k in range(60))) for i in range(100)]
    want = similar_classes(rows)
    assert want[:150] == [0] * 150 and len(set(want)) == 101
    for most in (4096, 20):
        got = {r["doc_id"]: r["component_id"] for r in G.groups(make(rows), most=most).collect()}
        assert [got[i] for i, _ in rows] == want, most


def test_similar_odd_rows(odd, make):
    kept = G.keep_one_each(odd)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == odd.columns
    assert ids.count(5) == 1 and 6 not in ids and ids.count(None) == 2 and 2 not in ids and {1, 4, 7, 8, 9} <= set(ids)
    assert G.keep_one_each(make([])).collect() == []


def test_spanning_links_are_the_closest():
    rng = np.random.default_rng(3)
    i, j = np.triu_indices(30, 1)
    d = rng.integers(1, 200, len(i))
    picked = G.spanning(30, i, j, d)
    label, total = list(range(30)), 0
    for e in np.argsort(d, kind="stable"):
        a, b = label[i[e]], label[j[e]]
        if a != b:
            label, total = [a if x == b else x for x in label], total + d[e]
    assert len(picked) == 29 and d[picked].sum() == total


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160))


def test_tasks_are_regathered_whole():
    import pandas as pd

    rng = np.random.default_rng(8)
    rows = pd.DataFrame({"task": np.sort(rng.integers(0, 40, 500)), "x": np.arange(500)})
    for size in (1, 7, 60, 500):
        parts = [rows.iloc[i : i + size] for i in range(0, 500, size)]
        for block in (1, 50, 10_000):
            got = list(S.whole_tasks(iter([*parts, rows.iloc[:0]]), ["task"], block))
            assert [x for g in got for x in g["x"]] == list(range(500))
            assert sum(g["task"].nunique() for g in got) == rows["task"].nunique()


def test_links_beyond_the_forests(make, sample, monkeypatch):
    """Without spare forests, and with few leaves a task: links left out are checked as well."""
    base = [(i, t) for i, t in sample if 60 < len(t.split()) < 600][:25]
    rows = list(base)
    for n, (i, t) in enumerate(base):
        rows += [(10_000 + 100 * n + c, edited(t, max(1, len(t.split()) * (2 + c % 3) // 100), 5 * n + c)) for c in range(8)]
    want = similar_classes(rows)
    monkeypatch.setattr(G, "FORESTS", 0)
    monkeypatch.setattr(G, "spanning", lambda n, i, j, d: np.zeros(0, np.int64))
    for most in (4096, 6):
        got = {r["doc_id"]: r["component_id"] for r in G.groups(make(rows), most=most).collect()}
        assert sum(got[i] != c for (i, _), c in zip(rows, want)) <= 0.005 * len(rows), most
