"""NumPy operators against invariants and small brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import tails
from strandline.operators import align, resample, transport as T

RNG = np.random.default_rng(0)


def test_exact_plan_is_optimal():
    for n in (1, 2, 4, 5):
        c = RNG.random((n, n))
        p = np.full(n, 1 / n)
        best = min(sum(c[i, s[i]] for i in range(n)) / n for s in itertools.permutations(range(n)))
        t = T.plan(c, p, p)
        assert (t * c).sum() == pytest.approx(best, abs=1e-12)
        assert np.allclose(t.sum(0), p) and np.allclose(t.sum(1), p)


def test_plan_with_ties_and_parts():
    """Integer costs tie; masses in sixths make the best plan one of permutations."""
    for _ in range(60):
        n, m = RNG.integers(1, 7, 2)
        cost = RNG.integers(0, 4, (n, m)).astype(float)
        rows, columns = (np.sort(np.concatenate([np.arange(k), RNG.integers(0, k, 6 - k)])) for k in (n, m))
        p, q = np.bincount(rows, minlength=n) / 6, np.bincount(columns, minlength=m) / 6
        best = min(sum(cost[rows[i], columns[s[i]]] for i in range(6)) / 6 for s in itertools.permutations(range(6)))
        t = T.plan(cost, p, q)
        assert (t * cost).sum() == pytest.approx(best, abs=1e-12) and np.allclose(t.sum(1), p) and np.allclose(t.sum(0), q) and t.min() >= 0


def test_plan_of_larger_groups():
    """No cycle of two or three used cells can be improved, and potentials exist."""
    x, y = RNG.normal(size=(90, 6)), RNG.normal(size=(70, 6))
    c = T.angular(x, y) ** 2
    t = T.plan(c, np.full(90, 1 / 90), np.full(70, 1 / 70))
    assert np.allclose(t.sum(1), 1 / 90) and np.allclose(t.sum(0), 1 / 70)
    i, j = np.nonzero(t > 1e-12)
    # Bellman-Ford over the residual graph: without a negative cycle distances settle
    d = np.zeros(70)
    for _ in range(170):
        u = np.full(90, np.inf)
        np.minimum.at(u, i, d[j] - c[i, j])
        new = np.minimum(d, (u[:, None] + c).min(axis=0))
        if np.allclose(new, d, atol=1e-12):
            break
        d = new
    else:
        raise AssertionError("a cycle of the plan can be improved")


def test_plan_with_other_marginals():
    c, p, q = RNG.random((3, 5)), np.array([0.2, 0.5, 0.3]), np.array([0.1, 0.3, 0.2, 0.25, 0.15])
    t = T.plan(c, p, q)
    assert np.allclose(t.sum(1), p) and np.allclose(t.sum(0), q) and t.min() >= 0
    # complementary slackness: no cycle of two cells can be improved
    for (i, j), (k, m) in itertools.combinations(zip(*np.nonzero(t > 1e-12)), 2):
        assert c[i, j] + c[k, m] <= c[i, m] + c[k, j] + 1e-9


def test_wasserstein_invariants():
    x, y = RNG.normal(size=(20, 8)), RNG.normal(size=(12, 8)) + 0.5
    w = T.wasserstein(x, y)[0]
    assert w == pytest.approx(T.wasserstein(y, x)[0], abs=1e-9)
    # the angle of a vector with itself is 0 up to rounding in arccos
    assert T.wasserstein(x, x)[0] == pytest.approx(0, abs=1e-6)
    assert T.wasserstein(np.vstack([x, x]), y)[0] == pytest.approx(w, abs=1e-6)
    e, residual = T.wasserstein(x, y, 0.01)
    assert abs(e - w) < 0.05 and residual < 1e-3
    assert T.fused_gromov(x, y, 0.0) == pytest.approx(w * w, abs=1e-9)
    assert T.fused_gromov(x, x, 0.5) == pytest.approx(0, abs=1e-6)


def test_clusters_and_paths():
    x = np.vstack([RNG.normal(size=(5, 6)) * 0.05 + np.eye(6)[k] for k in (0, 1, 2)])
    assert len(set(map(tuple, np.split(T.average_linkage(x, 3), 3)))) == 3
    assert sorted(np.bincount(T.average_linkage(x, 3))) == [5, 5, 5]
    k, w = T.geodesic(x)
    assert np.isfinite(w).all() and np.allclose(w, w.T) and 1 <= k < len(x)


def _best(a, b):
    """Score by plain recursion over states."""
    from functools import cache

    @cache
    def go(i, j, s):
        if i == 0 and j == 0:
            return 0.0 if s == 0 else -1e9
        if s == 0:
            return -1e9 if not (i and j) else (a[i - 1] == b[j - 1]) + max(go(i - 1, j - 1, t) for t in range(3))
        di, dj = (1, 0) if s == 1 else (0, 1)
        if i < di or j < dj:
            return -1e9
        return max(go(i - di, j - dj, t) - (0.5 if t == s else 2.0) for t in range(3))

    return max(go(len(a), len(b), s) for s in range(3))


def test_alignment_score():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = ("".join(rng.choice(list("ACGT"), rng.integers(1, 9))) for _ in range(2))
        x, y, s = align.nucleotide(a, b)
        assert s == pytest.approx(_best(a, b)) and x.replace("-", "") == a and y.replace("-", "") == b
        own, state = 0.0, 0
        for p, q in zip(x, y):
            now = 1 if q == "-" else 2 if p == "-" else 0
            own += (p == q) if not now else -(0.5 if now == state else 2.0)
            state = now
        assert own == pytest.approx(s)


def test_coding_places():
    exons = ["ATG" + "ACGTTGCA" * 6, "GGATCCAAGT" * 5]
    span = "TTTT" + exons[0] + "C" * 30 + exons[1] + "AA"
    got = align.coding_places(span, "".join(exons))
    assert "".join(span[i] for i in got) == "".join(exons)
    assert align.coding_places("ACGT", "T" * 40) is None


def test_tails():
    assert tails.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-9)
    assert tails.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert tails.chi2_upper(3.841458821, 1) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi2_upper(18.30703805, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi2_upper(2.0, 2) == pytest.approx(math.exp(-1), abs=1e-12)
    d = np.array([1.0, 2, 3, 4, 5, 6, -7])
    both = [sum(r for r, s in zip(range(1, 8), signs) if s) for signs in itertools.product((0, 1), repeat=7)]
    assert tails.signed_rank_two_sided(d) == pytest.approx(min(1, 2 * sum(w <= 7 for w in both) / 128))
    assert math.isnan(tails.signed_rank_two_sided(np.ones(8)))


def test_resampling():
    x = RNG.normal(1, 1, 200)
    low, high = resample.bootstrap(x, np.random.default_rng(1))
    assert low < x.mean() < high and abs((high - low) - 3.92 / math.sqrt(200)) < 0.06
    m = np.abs(x[:20, None] - x[None, :20])
    rho, p = resample.mantel(m, m, np.random.default_rng(1), 99)
    assert rho == pytest.approx(1) and p == pytest.approx(0.01)


def test_fits_by_least_squares(spark):
    """Partial rank correlations and quadratic fits from moments against dense algebra."""
    from strandline.operators import ranks

    n = 60
    x, z = RNG.normal(size=n), RNG.normal(size=n)
    y, var = 3 * x + 0.5 * x * x + 0.4 * z + RNG.normal(0, 0.3, n), RNG.uniform(0.5, 2, n)
    df = spark.createDataFrame([("c", *map(float, r)) for r in zip(x, y, z, var)] + [("few", 1.0, 2.0, 3.0, 1.0)], "g string, x double, y double, z double, var double")
    s = (x - x.mean()) / x.std()
    a = np.column_stack([np.ones(n), s, s * s])
    got = {r["g"]: r for r in ranks.shape_fit(df, ["g"], "x", "y").collect()}
    beta = np.linalg.lstsq(a, y, rcond=None)[0]
    assert set(got) == {"c"} and (got["c"]["b1"], got["c"]["b2"]) == pytest.approx((beta[1], beta[2]))
    se = np.sqrt(np.diag(np.linalg.inv(a.T @ a)) * ((y - a @ beta) ** 2).sum() / (n - 3))
    assert got["c"]["p2"] == pytest.approx(tails.t_two_sided(beta[2] / se[2], n - 3), rel=1e-6)
    w = np.sqrt(1 / var)
    beta = np.linalg.lstsq(a * w[:, None], y * w, rcond=None)[0]
    r = ranks.weighted_shape_fit(df, ["g"], "x", "y", "var").first()
    assert (r["b1"], r["b2"]) == pytest.approx((beta[1], beta[2]))
    rank = lambda v: np.argsort(np.argsort(v)).astype(float)
    c = np.column_stack([np.ones(n), rank(z)])
    rest = lambda v: rank(v) - c @ np.linalg.lstsq(c, rank(v), rcond=None)[0]
    r = ranks.partial_spearman(df, ["g"], "x", "y", "z").first()
    assert r["rho"] == pytest.approx(np.corrcoef(rest(x), rest(y))[0, 1])


def test_seeds_of_keys(spark):
    import zlib

    row = spark.createDataFrame([("g", "c", 3)], "gene string, condition string, sample int").select(resample.seed_of(["gene", "condition"], ":", 42).alias("a"), resample.seed_of([F.lit(42), "gene", "condition", "sample"], "|").alias("b")).first()
    assert (row["a"], row["b"]) == (42 + zlib.crc32(b"g:c"), zlib.crc32(b"42|g|c|3"))


def test_transport_invariants(spark):
    rows = [(g, [float(v) for v in RNG.normal(size=5) + g]) for g in (1, 2, 3) for _ in range(6 + g)]
    got = T.group_pairs(spark.createDataFrame(rows, "family int, v array<double>"), "family", "v", "invariants").collect()
    assert len(got) == 3 and all(r["value"] < 1e-6 for r in got)


def test_rewrites_count_letters_as_capitals(spark):
    from strandline.operators import rewrites

    seq = "ATG" + "GCTGAAAAACGT" * 6 + "TAA"
    one, two = (rewrites.rewrites(spark.createDataFrame([("k", "f", s)], "key string, family string, seq string"), "key", "family", "seq").orderBy("tag").collect() for s in (seq, seq.lower()))
    assert one == two and len(one) == 2


def test_paths_and_tools(spark, tmp_path):
    from strandline.sources import files

    assert files.required(spark, f"file://{tmp_path}", "make it") == f"file://{tmp_path}"
    with pytest.raises(FileNotFoundError, match="run the embedding step"):
        files.required(spark, f"file://{tmp_path}/none", "run the embedding step")
    assert files.missing_tools({"python3": "everything", "no-such-program": "alignment"}) == {"no-such-program": "alignment"}
    records = spark.createDataFrame([("z", "z gene:E1.1", "AAA", 5), ("a", "a gene:E1.1", "CCC", 9)], "key string, header string, seq string, at long")
    assert files.longest_per_gene(records).first()["seq"] == "AAA" and files.longest_per_gene(records.drop("at")).first()["seq"] == "CCC"


def test_queries_take_whole_families(spark, monkeypatch):
    from strandline.operators import transport
    from strandline.plans import derived, numeric_queries as N

    sf_dir, seen = "/root/testdata/sf0.001", []
    rows = derived.embedded(spark, sf_dir).count()
    monkeypatch.setattr(transport, "group_pairs", lambda df, *a, **k: seen.append(df.count()))
    monkeypatch.setattr(resample, "grouped_vectors", lambda df, *a: seen.append(df.count()))
    names = ("w2_exact", "w2_entropic", "fgw", "cluster_avg_linkage", "geodesic", "mantel", "split_half", "loo_pc1")
    for name in names:
        N.Q[name](spark, sf_dir)
    assert dict(zip(names, seen)) == dict.fromkeys(names, rows)
    # above the cap: an even share of each family, not its first keys
    capped = {r["family"]: r["keys"] for r in N._members(spark, sf_dir, 10).groupBy("family").agg({"key": "collect_list"}).toDF("family", "keys").collect()}
    assert len(capped) == 10 and {len(k) for k in capped.values()} == {10}
    first = sorted(r["key"] for r in derived.embedded(spark, sf_dir).where("family = 0").collect())[:10]
    assert sorted(capped[0]) != first


def test_one_component_and_halves_of_tall_arrays():
    x = RNG.normal(size=(40, 6)) + 1
    for i, got in enumerate(resample.one_component_removed(x)):
        rest = np.delete(x, i, axis=0)
        first = np.linalg.svd(rest)[2][0]
        a, b = (v - (v @ first) * first for v in (x[i], rest.sum(axis=0)))
        assert got == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-9)
    rng, order = np.random.default_rng(5), np.random.default_rng(5)
    halves = [order.permutation(40) for _ in range(30)]
    cosines = [(x[h[:20]].sum(0) @ x[h[20:]].sum(0)) / np.linalg.norm(x[h[:20]].sum(0)) / np.linalg.norm(x[h[20:]].sum(0)) for h in halves]
    assert resample.split_half(x, rng, 30) == pytest.approx(np.mean(cosines), abs=1e-12)
