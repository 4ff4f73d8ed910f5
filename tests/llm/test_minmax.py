import numpy as np

from strandline.llm import minmax as M
from strandline.llm.similar import shingle_set

from .conftest import ODD
from .test_neardup import edited, shingles


def naive(rows):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs."""
    sets = [shingles(t, 4) for _, t in rows]
    near = [[j for j, b in enumerate(sets) if i == j or a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= 80 * len(a | b)] for i, a in enumerate(sets)]
    near = [[j for j in n if j == i or rows[j][0] is not None] + [j for j, r in enumerate(rows) if rows[i][0] is not None and r[0] == rows[i][0]] for i, n in enumerate(near)]
    label = [i for i, _ in rows]
    while True:
        new = [None if label[i] is None else min(label[j] for j in n if label[j] is not None) for i, n in enumerate(near)]
        if new == label:
            break
        label = new
    return sorted((repr((i, len(s), c, i == c)) for (i, _), s, c in zip(rows, sets, label)))


def got(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_against_all_pairs(make, sample):
    base = [(i, t) for i, t in sample if 60 < len(t.split()) < 600][:50]
    rows = list(sample)
    for n, (i, t) in enumerate(base):
        words = len(t.split())
        rows += [(10_000 + 100 * n + c, edited(t, max(1, words * (1 + 2 * c) // 100), 7 * n + c)) for c in range(4)]
    want = naive(rows)
    for options in ({}, {"chunk": 3}, {"most": 2, "chunk": 2}, {"square": 2}):
        assert got(M.near_duplicates(make(rows), **options)) == want, options


def test_a_family_around_the_threshold(make, sample):
    """Near copies of one text, many of them too far from its leader and from each other,
    and texts that share one passage with each other only."""
    text = next(t for _, t in sample if 150 < len(t.split()) < 400)
    passage = " ".join(f"common{i}" for i in range(40))
    words = len(text.split())
    rows = [(i, edited(text, max(1, words * (i % 7) // 100), i)) for i in range(120)] + [(1000 + i, f"{passage} " + " ".join(f"own{i}w{k}" for k in range(60))) for i in range(60)]
    want = naive(rows)
    for options in ({}, {"chunk": 10}, {"chunk": 64, "square": 8}):
        assert got(M.near_duplicates(make(rows), **options)) == want, options


def test_odd_rows(make, odd):
    found = {}
    for r in M.near_duplicates(odd).collect():
        found.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    assert sum(map(len, found.values())) == len(ODD)
    assert found[1] == [(0, 1, True)] and found[2] == [(0, 2, True)] and found[3] == [(0, 3, True)]
    assert found[5] == [(2, 5, True)] * 2 and found[6] == [(2, 5, False)]
    assert sorted(found[None]) == [(0, None, True), (2, None, True)]
    assert found[4] == [(1, 4, True)] and found[9] == [(1, 9, True)]
    assert M.near_duplicates(make([])).collect() == []


def test_values_estimate_the_similarity():
    rng = np.random.default_rng(5)
    errors = []
    for shared in (50, 80, 95):
        for _ in range(60):
            every = rng.integers(0, 1 << 64, 200 - shared, np.uint64)
            a, b = every[:100], np.concatenate([every[:shared], every[100:]])
            errors.append((M.signature(np.unique(a)) == M.signature(np.unique(b))).mean() - shared / (200 - shared))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.07


def test_bands_meet_where_values_do():
    s = M.signature(shingle_set(b"one two three four five six seven", 4))
    other = s.copy()
    other[M.ROWS] += 1
    same = M.band_keys(np.stack([s, other]))
    assert (same[0] == same[1]).tolist() == [b != 1 for b in range(M.BANDS)]
