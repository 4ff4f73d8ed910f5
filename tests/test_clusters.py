"""Evidence for clusters and panels against plain loops."""

import itertools

import numpy as np
import pytest

from strandline.operators import clusters as C, transport as T
from strandline.operators.resample import rng_for

RNG = np.random.default_rng(31)


def frame(spark, groups):
    rows = [(g, i, x[i].tolist()) for g, x in groups.items() for i in range(len(x))]
    return spark.createDataFrame(rows, "family int, key long, v array<double>")


@pytest.fixture(scope="module")
def groups():
    clear = np.vstack([RNG.normal(size=(9, 8)) * 0.1 + 3 * np.eye(8)[k] for k in (0, 1, 2)])
    return {1: clear - clear.mean(axis=0), 2: (lambda x: x - x.mean(axis=0))(RNG.normal(size=(15, 8)))}


def test_existence_by_loops(spark, groups):
    ks, nulls = range(2, 6), 45
    got = {(r["family"], r["k"]): r for r in C.existence(frame(spark, groups), "family", "key", "v", ks=ks, nulls=nulls, isotropic=21).collect()}
    assert len(got) == 8
    for g, x in groups.items():
        both = lambda z: np.array([(T.cosine_silhouette(z, c), T.log_dispersion(z, c)) for c in T.cuts(z, ks)])
        own = both(x)
        null = np.stack([both(C.spectral_rotation(x, rng_for("spectrum", g, r))) for r in range(nulls)])
        turned = np.mean([both(C.turned_rows(x, rng_for("isotropic", g, r)))[:, 0] for r in range(21)], axis=0)
        mean = null.mean(axis=0)
        excess = own[:, 0] - mean[:, 0]
        most = (null[:, :, 0] - mean[:, 0]).max(axis=1)
        for i, k in enumerate(ks):
            r = got[g, k]
            want = {"silhouette": own[i, 0], "null_mean": mean[i, 0], "null_sd": null[:, i, 0].std(ddof=1), "excess": excess[i], "p_at_k": ((null[:, i, 0] >= own[i, 0]).sum() + 1) / (nulls + 1), "isotropic_mean": turned[i], "gap": mean[i, 1] - own[i, 1], "gap_se": null[:, i, 1].std(ddof=1) * np.sqrt(1 + 1 / nulls), "p": ((most >= excess.max()).sum() + 1) / (nulls + 1)}
            assert {c: r[c] for c in want} == pytest.approx(want, rel=1e-9, abs=1e-12)
            assert r["best"] == (i == excess.argmax())
    assert got[1, 3]["best"] and got[1, 3]["p"] == pytest.approx(1 / 46) and got[2, 3]["p"] > 0.05


def test_stability_by_loops(spark, groups):
    x = frame(spark, groups)
    best = spark.createDataFrame([(1, 3), (2, 2)], "family int, best_k int")
    got = {r["family"]: r for r in C.stability(x, best, "family", "key", "v", resamples=50).collect()}
    for g, k in ((1, 3), (2, 2)):
        z, boots, halves = groups[g], [], []
        whole = T.average_linkage(z, k)
        for r in range(50):
            rng = rng_for("stability", g, r)
            drawn = sorted(set(rng.integers(0, len(z), len(z)).tolist()))
            order = rng.permutation(len(z))
            a, b = order[: len(z) // 2], order[len(z) // 2 :]
            boots.append(naive_rand(T.average_linkage(z[drawn], k), whole[drawn]))
            if len(set(whole[a])) > 1:
                halves.append(naive_rand(T.average_linkage(z[b], k), whole[b]))
        assert got[g]["bootstrap_median"] == pytest.approx(np.median(boots)) and got[g]["bootstrap_q05"] == pytest.approx(np.quantile(boots, 0.05))
        assert got[g]["half_median"] == pytest.approx(np.median(halves)) and sum(map(int, got[g]["sizes"].split(","))) == len(z)
    assert got[1]["bootstrap_median"] == 1.0


def naive_rand(a, b):
    """Adjusted Rand index over all pairs."""
    pairs = list(itertools.combinations(range(len(a)), 2))
    both = sum(a[i] == a[j] and b[i] == b[j] for i, j in pairs)
    one, two = sum(a[i] == a[j] for i, j in pairs), sum(b[i] == b[j] for i, j in pairs)
    chance, most = one * two / len(pairs), (one + two) / 2
    return 1.0 if most == chance else (both - chance) / (most - chance)


def test_agreement():
    for _ in range(30):
        a, b = RNG.integers(0, 4, 12), RNG.integers(0, 3, 12)
        assert C.agreement(a, b) == pytest.approx(naive_rand(a, b))
    assert C.agreement(np.zeros(5), np.zeros(5)) == 1.0


def test_nulls_keep_what_they_should():
    for shape in ((30, 8), (6, 10)):
        x = RNG.normal(size=shape)
        null = C.spectral_rotation(x, np.random.default_rng(2))
        assert np.linalg.svd(null, compute_uv=False) == pytest.approx(np.linalg.svd(x, compute_uv=False))
        assert np.linalg.norm(C.turned_rows(x, np.random.default_rng(2)), axis=1) == pytest.approx(np.linalg.norm(x, axis=1))


def test_panels(spark):
    x = np.vstack([RNG.normal(size=(20, 6)) * 0.3 + np.eye(6)[k] for k in (0, 1)])
    got = {r["k"]: r for r in C.panel_contrast(frame(spark, {1: x}), "family", "key", "v", clusters=2, ks=(4, 25), draws=200).collect()}
    assert got[4]["draws"] == 200 and got[4]["contrast"] == pytest.approx(got[4]["random"] - got[4]["same"]) and got[4]["contrast"] > 0.2
    assert got[25]["draws"] == 0 and got[25]["same"] is None
    label = np.repeat([0, 1], 20)
    found = C.panel_cosines(x, label, 4, np.random.default_rng(1), 4000)
    # the mean over draws against panels drawn one by one
    rng, own = np.random.default_rng(2), []
    for _ in range(4000):
        i = rng.integers(0, 40)
        a = rng.choice([j for j in range(40) if label[j] == label[i] and j != i], 4, replace=False)
        b = rng.choice([j for j in range(40) if label[j] != label[i]], 4, replace=False)
        u, w = x[a].mean(axis=0), x[b].mean(axis=0)
        own.append(u @ w / np.linalg.norm(u) / np.linalg.norm(w))
    assert found[:, 0].mean() == pytest.approx(np.mean(own), abs=0.02)


def test_large_groups_are_refused(spark, groups):
    with pytest.raises(ValueError, match="cap it"):
        C.in_chunks(frame(spark, groups), "family", "key", "v", 1, lambda *a: None, "x int", cap=5)
