"""Control preservation, tip pairs and diameters against plain loops."""

import itertools

import numpy as np
import pytest

from strandline.operators import preservation, resample, trees

RNG = np.random.default_rng(51)


def rho(x, y):
    rank = lambda v: np.array([np.mean([i + 1 for i, w in enumerate(sorted(v)) if w == z]) for z in v])
    if len(x) < 6 or len(set(x)) < 2 or len(set(y)) < 2:
        return None
    return np.corrcoef(rank(x), rank(y))[0, 1]


def test_within_and_between(spark):
    species = {k: int(RNG.integers(0, 5)) for k in range(20)}
    tree = {(a, b): float(RNG.integers(1, 9)) for a, b in itertools.combinations(range(5), 2)}
    rows = []
    for c, family, grp in itertools.product(("natural", "c1", "c2"), (0, 1), (0, 1)):
        members = range(10 * family + 5 * grp, 10 * family + 5 * grp + (5 if (family, grp) != (1, 1) else 3))
        for a, b in itertools.combinations(members, 2):
            rows.append((c, family, grp, a, b, species[a], species[b], 1.0 if c == "c2" and grp == 0 else float(RNG.integers(0, 12))))
    names = "condition string, family int, grp int, a int, b int, species_a int, species_b int, d double"
    got = {(r["condition"], r["family"]): r for r in preservation.within(spark.createDataFrame(rows, names), "natural", spark.createDataFrame([(a, b, d) for (a, b), d in tree.items()], "a int, b int, d double")).collect()}
    path = lambda s, t: 0.0 if s == t else tree[min(s, t), max(s, t)]
    for c, family in itertools.product(("natural", "c1", "c2"), (0, 1)):
        kept, found = [], []
        for grp in (0, 1):
            own = [r for r in rows if r[:3] == (c, family, grp)]
            nat = {r[3:5]: r[7] for r in rows if r[:3] == ("natural", family, grp)}
            kept.append(rho([r[7] for r in own], [nat[r[3:5]] for r in own]))
            found.append(rho([r[7] for r in own], [path(r[5], r[6]) for r in own]))
        r = got[c, family]
        for value, each in ((r["rho_natural"], kept), (r["rho_tree"], found)):
            each = [x for x in each if x is not None]
            assert value == (pytest.approx(np.mean(each), abs=1e-9) if each else None)
    assert got["natural", 0]["rho_natural"] == pytest.approx(1.0) and got["c2", 1]["n_groups"] == 0
    between = [(c, a, b, float(RNG.random())) for c in ("natural", "c1") for a, b in itertools.combinations(range(4), 2)]
    b = {r["condition"]: r for r in preservation.between(spark.createDataFrame(between, "condition string, a int, b int, d double"), "natural").collect()}
    one, two = ([r[3] for r in between if r[0] == c] for c in ("natural", "c1"))
    assert b["c1"]["rho_between"] == pytest.approx(rho(two, one)) and b["natural"]["rho_between"] == pytest.approx(1.0)


def test_pairs_of_tips_and_diameters(spark):
    parent = {i: int(RNG.integers(max(0, i - 6), i)) for i in range(1, 60)}
    length = {i: float(RNG.integers(0, 9)) for i in parent}
    rows = [("n0", None, 0.0), *[(f"n{i}", f"n{p}", length[i]) for i, p in parent.items()]]
    paths = trees.ancestors(spark.createDataFrame(rows, "node string, parent string, len double"), "node", "parent", "len").cache()
    tips = sorted(set(range(60)) - set(parent.values()))

    def up(i):
        out = {i: 0.0}
        while i:
            out[parent[i]] = out[i] + length[i]
            i = parent[i]
        return out

    far = lambda a, b: min(d + up(b)[n] for n, d in up(a).items() if n in up(b))
    pairs = [(a, b) for a, b in itertools.combinations(tips, 2) if (a + b) % 3]
    got = {(r["a"], r["b"]): r["d"] for r in trees.patristic_of(paths, spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "a string, b string")).collect()}
    assert got == {(f"n{a}", f"n{b}"): far(a, b) for a, b in pairs}
    d = trees.diameter(paths, spark.createDataFrame([(f"n{t}",) for t in tips], "node string"), "node").first()
    assert d["d"] == max(far(a, b) for a, b in itertools.combinations(tips, 2)) == far(int(d["a"][1:]), int(d["b"][1:]))


def test_shuffles_of_cells_are_those_of_sites():
    hit, wanted, stratum = RNG.integers(0, 4, 400), RNG.integers(0, 3, 400), RNG.integers(0, 3, 400)
    cells, n = np.unique(np.stack([hit, wanted, stratum]), axis=1, return_counts=True)
    a = resample.shuffled_agreement(hit, wanted, stratum, np.random.default_rng(1), 3000)
    b = resample.shuffled_agreement(*cells, np.random.default_rng(1), 3000, n)
    assert a == b
    own, order = [], np.argsort(stratum, kind="stable")
    rng = np.random.default_rng(2)
    for _ in range(3000):
        mixed = np.lexsort((rng.random(400), stratum))
        own.append((hit[mixed] == wanted[order]).sum())
    assert a[1] == pytest.approx(np.mean(own), abs=0.6) and a[2] == pytest.approx(np.std(own), rel=0.08)
