"""Queries whose operators SQL cannot express; tests hold them against NumPy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from strandline.functions import tails
from strandline.operators import align, paired, panel, ranks, resample, rewrites, transport
from strandline.plans import derived as D

Q, SQL = {}, {}


def query(f):
    Q[f.__name__] = f
    return f


def _members(spark, sf_dir, cap: int = 400):
    """All members of each family; above ``cap``, where the reference caps its manifest
    too, its seeded even allocation. Embeddings have one group a family."""
    e = D.embedded(spark, sf_dir).withColumn("grp", F.lit(0))
    sizes = e.groupBy("family", "grp").agg(F.count("*").alias("size"))
    quotas = panel.even_allocation(sizes, ["family"], "grp", "size", cap).drop("size")
    return panel.stratified_sample(e, quotas, ["family", "grp"], "key").drop("grp", "quota")


@query
def w2_exact(spark, sf_dir):
    """J10, J15."""
    return transport.group_pairs(_members(spark, sf_dir), "family", "v")


@query
def w2_entropic(spark, sf_dir):
    """J11."""
    return transport.group_pairs(_members(spark, sf_dir), "family", "v", "entropic", reg=0.01)


@query
def fgw(spark, sf_dir):
    """J12."""
    return transport.group_pairs(_members(spark, sf_dir), "family", "v", "fused", alpha=0.5)


@query
def cluster_avg_linkage(spark, sf_dir):
    """J31 with three clusters a family."""
    fn = lambda x, keys, rng: pd.DataFrame({"key": keys, "cluster": transport.average_linkage(x, min(3, len(x))).astype("int32")})
    return resample.grouped_vectors(D.embedded(spark, sf_dir), "family", "key", "v", fn, "key long, cluster int")


@query
def geodesic(spark, sf_dir):
    """Path lengths inside each family."""

    def fn(x, keys, rng):
        k, w = transport.geodesic(x)
        i, j = np.triu_indices(len(x), 1)
        return pd.DataFrame({"k": k, "a": keys[i], "b": keys[j], "d": w[i, j]})

    return resample.grouped_vectors(_members(spark, sf_dir), "family", "key", "v", fn, "k int, a long, b long, d double")


@query
def mantel(spark, sf_dir):
    """K7: angular distance against distance of first coordinates, 9,999 permutations."""

    def fn(x, keys, rng):
        rho, p = resample.mantel(transport.angular(x, x), np.abs(x[:, :1] - x[:, :1].T), rng, 9999)
        return pd.DataFrame({"rho": [rho], "p": [p]})

    return resample.grouped_vectors(_members(spark, sf_dir), "family", "key", "v", fn, "rho double, p double")


@query
def split_half(spark, sf_dir):
    """J24."""
    return resample.grouped_vectors(D.embedded(spark, sf_dir), "family", "key", "v", lambda x, keys, rng: pd.DataFrame({"cosine": [resample.split_half(x, rng)]}), "cosine double")


@query
def loo_pc1(spark, sf_dir):
    """J28."""
    return resample.grouped_vectors(D.embedded(spark, sf_dir), "family", "key", "v", lambda x, keys, rng: pd.DataFrame({"key": keys, "cosine": resample.one_component_removed(x)}), "key long, cosine double")


@query
def rewrites_all(spark, sf_dir):
    """F1-F10 over all loci, two draws each, with the codon usage of the family."""
    return rewrites.rewrites(D.loci(spark, sf_dir), "key", "family", "cds")


@query
def align_nt(spark, sf_dir):
    """Sequences against a copy that lost some bases."""
    p = D.pairs(spark, sf_dir).withColumn("b", F.expr("concat(substr(b, 1, 40), substr(b, 41 + key % 5))"))
    return align.sites(p, "key", "a", "b")


def _deltas(spark, sf_dir):
    return paired.deltas(paired.gene_means(D.records(spark, sf_dir), "gene", "condition"), "gene", "condition", "view")


@query
def bootstrap_ci(spark, sf_dir):
    """K5, K6."""
    return resample.bootstrap_ci(_deltas(spark, sf_dir), ["condition"], "delta")


@query
def wilcoxon_p(spark, sf_dir):
    """K4."""
    return resample.signed_rank_test(_deltas(spark, sf_dir), ["condition"], "delta")


@query
def sign_flip_p(spark, sf_dir):
    """J25, K8."""
    return resample.sign_flip_test(_deltas(spark, sf_dir), ["condition"], "delta")


@query
def regressions(spark, sf_dir):
    """K2, K3, K11, K12 from moments: partial rank correlations and both quadratic fits."""
    d = _deltas(spark, sf_dir).select("condition", "gene", "base", "delta", "level").withColumn("var", 1 + F.abs("level"))
    by = ["condition"]
    plain = ranks.shape_fit(d, by, "base", "delta").select("condition", "b1", "p1", "b2", "p2")
    weighted = ranks.weighted_shape_fit(d, by, "base", "delta", "var").select("condition", F.col("b1").alias("w1"), F.col("p1").alias("pw1"), F.col("b2").alias("w2"), F.col("p2").alias("pw2"))
    return ranks.partial_spearman(d, by, "base", "delta", "level").select("condition", "rho", "p").join(plain, by, "left").join(weighted, by, "left")


@query
def draw_seeds(spark, sf_dir):
    """a seed for each cell and one for each record, from their keys alone, so that
    neither resuming nor the number of workers changes a draw."""
    r = D.records(spark, sf_dir).select("gene", "condition", "sample")
    return r.select("gene", "condition", "sample", resample.seed_of(["gene", "condition"], ":", 42).alias("cell_seed"), resample.seed_of([F.lit(42), "gene", "condition", "sample"], "|").alias("record_seed"))


@query
def transport_invariants(spark, sf_dir):
    """Of each pair of families how far the distance is from being symmetric, from 0 to
    itself, from the same for rows in another order, and FGW at 0 from its square."""
    return transport.group_pairs(_members(spark, sf_dir), "family", "v", "invariants")


@query
def kruskal_p(spark, sf_dir):
    """K19 with its tail."""
    def tail(k, h):
        return pd.Series([tails.chi2_upper(x, n - 1) for n, x in zip(k, h)])

    tail.__annotations__ = {"k": pd.Series, "h": pd.Series, "return": pd.Series}
    return ranks.kruskal(_deltas(spark, sf_dir), "condition", "delta").withColumn("p", F.pandas_udf(tail, "double")("k", "h"))
