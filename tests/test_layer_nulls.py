"""Layer nulls by sums against dense inner products, whole and in blocks."""

import numpy as np
import pytest

from strandline.operators import layer_nulls as L


def cosines(d, total):
    rest = total - d
    size = np.linalg.norm(d, axis=1) * np.linalg.norm(rest, axis=1)
    return np.divide((d * rest).sum(axis=1), size, out=np.full(len(d), np.nan), where=size > 0)


def coherence(d):
    size = np.linalg.norm(d, axis=1)
    u = np.divide(d, size[:, None], out=np.zeros_like(d), where=size[:, None] > 0)
    return np.linalg.norm(u.sum(axis=0)) / len(d)


def dealt(kind, draw, number, groups, block, epochs):
    """Partners (places) of each row, and the halves, by the stated rule."""
    partner, a, b = np.arange(len(number)), [], []
    for g in set(groups):
        own = np.array([i for i in range(len(number)) if groups[i] == g])
        blocks = -(-len(own) // block)
        at = L.hashed((draw % epochs if blocks > 1 else 0) + L.KINDS["deal"], number[own]) % blocks
        for k in range(blocks):
            inside = own[at == k]
            inside = inside[np.argsort(number[inside])]
            order = np.argsort(L.hashed(draw + L.KINDS[kind], number[inside]), kind="stable")
            partner[inside] = inside[order]
            half = len(inside) // 2
            a += list(inside[order[:half]])
            b += list(inside[order[half : 2 * half]])
    return partner, a, b


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    rows = []
    for layer, n in ((0, 23), (1, 14), (2, 3)):
        shift = rng.normal(size=6)
        for i in range(n):
            h = rng.normal(size=6)
            p = h if i == 5 else h + shift + rng.normal(size=6)
            rows.append((layer, 1000 * layer + 7 * i, i % 3, h.tolist(), p.tolist()))
    return rows


@pytest.mark.parametrize("block, epochs", [(1024, 20), (6, 3)])
def test_against_dense_products(spark, data, block, epochs):
    df = spark.createDataFrame(data, "layer int, gene long, family int, h array<double>, p array<double>")
    got = {}
    for r in L.drawn_facts(df, "gene", "layer", "family", "h", "p", draws=300, splits=260, block=block, epochs=epochs).collect():
        got[r["layer"], r["kind"], r["draw"]] = (r["loo"], r["value"])
    for layer in (0, 1, 2):
        own = [r for r in data if r[0] == layer]
        number, family = np.array([r[1] for r in own]), [r[2] for r in own]
        h, p = np.array([r[3] for r in own]), np.array([r[4] for r in own])
        d = p - h
        for draw in range(0, 300, 13):
            e = L.signs("signs", np.array([draw]), number)[0][:, None]
            np.testing.assert_allclose(got[layer, "signs", draw], (np.nanmean(cosines(e * d, (e * d).sum(axis=0))), coherence(e * d)), rtol=1e-9, atol=1e-12)
            for kind, groups in (("pooled", [0] * len(own)), ("family", family)):
                partner, _, _ = dealt(kind, draw, number, groups, block, epochs)
                assert sorted(partner) == list(range(len(own)))
                new = p[partner] - h
                np.testing.assert_allclose(got[layer, kind, draw], (np.nanmean(cosines(new, d.sum(axis=0))), coherence(new)), rtol=1e-9, atol=1e-12)
            if draw < 260:
                _, a, b = dealt("split", draw, number, [0] * len(own), block, epochs)
                x, y = d[a].sum(axis=0), d[b].sum(axis=0)
                np.testing.assert_allclose(got[layer, "split", draw][1], x @ y / np.sqrt((x @ x) * (y @ y)), rtol=1e-9)


def test_statistics_of_a_layer(spark, data):
    df = spark.createDataFrame(data, "layer int, gene long, family int, h array<double>, p array<double>")
    options = dict(draws=200, splits=50, block=8, epochs=2)
    drawn = L.drawn_facts(df, "gene", "layer", "family", "h", "p", **options).toPandas()
    rows = {r["layer"]: r for r in L.layer_statistics(df, "gene", "layer", "family", "h", "p", **options).collect()}
    assert len(rows[0]) == 2 + 28
    for layer, r in rows.items():
        d = np.array([np.array(x[4]) - np.array(x[3]) for x in data if x[0] == layer])
        real = {"loo": np.nanmean(cosines(d, d.sum(axis=0))), "coherence": coherence(d)}
        assert r["loo_mean"] == pytest.approx(real["loo"]) and r["coherence"] == pytest.approx(real["coherence"])
        for kind, name in L.NULLS.items():
            own = drawn[(drawn.layer == layer) & (drawn.kind == kind)]
            for c, label in (("loo", "loo"), ("value", "coherence")):
                null = own[c].dropna().to_numpy()
                assert r[f"null_{name}_{label}"] == pytest.approx(np.median(null))
                assert r[f"p_{name}_{label}"] == pytest.approx((np.sum(null >= real[label] - 1e-13) + 1) / (len(null) + 1), abs=2 / 201)
        halves = drawn[(drawn.layer == layer) & (drawn.kind == "split")]["value"].dropna()
        assert [r["split_low"], r["split_median"], r["split_high"]] == pytest.approx(list(np.percentile(halves, [2.5, 50, 97.5])))
    assert rows[0]["p_signflip_loo"] < 0.05


def test_hashed_signs_and_orders_look_random():
    number = np.arange(0, 4000, 2)
    s = L.signs("signs", np.arange(400), number)
    assert abs(s.mean()) < 0.01 and np.abs(s.mean(axis=0)).max() < 0.3 and np.abs(s.mean(axis=1)).max() < 0.12
    pair = (s[:, :-1] * s[:, 1:]).mean()
    assert abs(pair) < 0.01 and abs((s[:-1] * s[1:]).mean()) < 0.01
    place = L.orders("pooled", np.arange(600), number[:20])
    counts = np.array([np.bincount(place[:, k], minlength=20) for k in range(20)])
    assert ((counts - 30) ** 2 / 30).sum() < 450
