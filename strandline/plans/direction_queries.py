"""Queries over paired vectors, clusters and distances between groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from strandline.operators import clusters as C, kmers, layer_nulls as L, ranks as R, resample, tiles, transport, vectors as V
from strandline.plans import derived as D
from strandline.plans.numeric_queries import _members
from strandline.plans.sequence_queries import _KMERS

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Pairs of vectors: an even one and the odd one after it, in four layers.
_P = f"""WITH e AS ({D.EMBEDDED_SQL}), p AS (SELECT x.key // 2 AS gene, (x.key // 2) % 4 AS layer, x.family, x.v AS h, y.v AS p FROM e x JOIN e y ON x.key % 2 = 0 AND y.key = x.key + 1),
 d AS (SELECT gene, layer, family, h, p, list_transform(list_zip(h, p), lambda z: z[2] - z[1]) AS d FROM p)"""


def _paired(spark, sf_dir):
    e = D.embedded(spark, sf_dir)
    x = e.where("key % 2 = 0").select(F.expr("key DIV 2").alias("gene"), "family", F.col("v").alias("h"))
    y = e.where("key % 2 = 1").select(F.expr("key DIV 2").alias("gene"), F.col("v").alias("p"))
    return x.join(y, "gene").withColumn("layer", F.col("gene") % 4)


_S = _P + """, x AS (SELECT layer, unnest(d) AS x, unnest(range(len(d))) AS i FROM d), s AS (SELECT layer, list(x ORDER BY i) AS s FROM (SELECT layer, i, sum(x) AS x FROM x GROUP BY 1, 2) GROUP BY 1)"""


@query(_S + """, u AS (SELECT layer, unnest(list_transform(d, lambda z: z / sqrt(list_dot_product(d, d)))) AS x, unnest(range(len(d))) AS i FROM d), c AS (SELECT layer, sqrt(sum(m * m)) AS coherence FROM (SELECT layer, i, avg(x) AS m FROM u GROUP BY 1, 2) GROUP BY 1),
 l AS (SELECT layer, sqrt(list_dot_product(d, d)) AS dn, (list_dot_product(d, s) - list_dot_product(d, d)) / (sqrt(list_dot_product(d, d)) * sqrt(list_dot_product(s, s) - 2 * list_dot_product(d, s) + list_dot_product(d, d))) AS loo, s FROM d JOIN s USING (layer))
 SELECT layer, count(*) AS n, round(sqrt(list_dot_product(any_value(s), any_value(s))) / count(*), 6) AS v_norm, round(sqrt(list_dot_product(any_value(s), any_value(s))) / count(*) / avg(dn), 6) AS v_over_mean, round(median(dn), 6) AS dnorm_median, round(stddev_pop(dn) / avg(dn), 6) AS dnorm_cv,
 round(avg(loo), 6) AS loo_mean, round(median(loo), 6) AS loo_median, round(stddev_pop(loo), 6) AS loo_sd, round(min(loo), 6) AS loo_min, round(max(loo), 6) AS loo_max, round(avg((loo > 0)::INT), 6) AS loo_pos, round(avg((loo > 0.25)::INT), 6) AS loo_over_quarter, round(any_value(coherence), 6) AS coherence, round(1 / sqrt(count(*)), 6) AS floor
 FROM l JOIN c USING (layer) GROUP BY layer""")
def direction_facts(spark, sf_dir):
    """Statistics of the deltas of each layer."""
    x = V.direction_facts(V.deltas(_paired(spark, sf_dir), "h", "p"), "gene", "layer", "delta")
    names = ["v_norm", "v_over_mean", "dnorm_median", "dnorm_cv", "loo_mean", "loo_median", "loo_sd", "loo_min", "loo_max", "loo_pos", "loo_over_quarter", "coherence", "floor"]
    return x.select("layer", "n", *[F.round(c, 6).alias(c) for c in names])


def _dealt_sql(name: str, kind: str, group: str) -> str:
    """CTEs of partners dealt anew: (layer, draw, loo, coherence) as ``name``."""
    own = group.replace("layer", "y.layer = o.layer").replace(", family", " AND y.family = o.family")
    return f""", {name}_o AS (SELECT layer, family, draw, gene, row_number() OVER (PARTITION BY {group}, draw ORDER BY {L.hashed_sql(f"draw + {L.KINDS[kind]}", "number")}, number) AS place FROM n, draws),
 {name}_b AS (SELECT layer, family, gene, row_number() OVER (PARTITION BY {group} ORDER BY number) AS place FROM n),
 {name}_d AS MATERIALIZED (SELECT o.layer, o.draw, list_transform(list_zip(a.h, b.p), lambda z: z[2] - z[1]) AS d, list_dot_product(b.p, s.s) - list_dot_product(a.h, s.s) AS g, list_dot_product(s.s, s.s) AS ss FROM {name}_o o JOIN {name}_b y ON y.place = o.place AND {own} JOIN n a ON a.gene = y.gene JOIN n b ON b.gene = o.gene JOIN s ON s.layer = o.layer),
 {name}_u AS (SELECT layer, draw, unnest(list_transform(d, lambda z: z / sqrt(list_dot_product(d, d)))) AS u, unnest(range(len(d))) AS i FROM {name}_d),
 {name}_c AS (SELECT layer, draw, sqrt(sum(u * u)) AS c FROM (SELECT layer, draw, i, sum(u) AS u FROM {name}_u GROUP BY ALL) GROUP BY ALL),
 {name} AS (SELECT layer, draw, avg((g - list_dot_product(d, d)) / sqrt(list_dot_product(d, d) * (ss - 2 * g + list_dot_product(d, d)))) AS loo, any_value(c) / count(*) AS coherence FROM {name}_d JOIN {name}_c USING (layer, draw) GROUP BY ALL)"""


_LAYERS_SQL = _S + f""", n AS MATERIALIZED (SELECT layer, gene, family, gene % {L.PRIME} AS number, h, p, d, list_dot_product(d, d) AS dd FROM d), draws AS (SELECT unnest(range({L.DRAWS})) AS draw), splits AS (SELECT unnest(range({L.SPLITS})) AS draw),
 xu AS MATERIALIZED (SELECT layer, gene, unnest(d) AS x, unnest(list_transform(d, lambda z: z / sqrt(dd))) AS u, unnest(range(len(d))) AS i FROM n),
 real_c AS (SELECT layer, sqrt(sum(m * m)) AS coherence FROM (SELECT layer, i, avg(u) AS m FROM xu GROUP BY ALL) GROUP BY ALL),
 lo AS (SELECT layer, sqrt(dd) AS dn, (list_dot_product(d, s) - dd) / sqrt(dd * (list_dot_product(s, s) - 2 * list_dot_product(d, s) + dd)) AS loo, s FROM n JOIN s USING (layer)),
 facts AS (SELECT layer, count(*) AS n, sqrt(list_dot_product(any_value(s), any_value(s))) / count(*) AS v_norm, sqrt(list_dot_product(any_value(s), any_value(s))) / count(*) / avg(dn) AS v_over_mean, median(dn) AS dnorm_median, stddev_pop(dn) / avg(dn) AS dnorm_cv, avg(loo) AS loo_mean, median(loo) AS loo_median, stddev_pop(loo) AS loo_sd, min(loo) AS loo_min, max(loo) AS loo_max, avg((loo > 0)::INT) AS loo_pos, avg((loo > 0.25)::INT) AS loo_over_quarter, any_value(coherence) AS coherence, 1 / sqrt(count(*)) AS floor FROM lo JOIN real_c USING (layer) GROUP BY layer),
 flip AS MATERIALIZED (SELECT layer, gene, draw, CASE WHEN ({L.hashed_sql("draw", "number")} >> 16) & 1 = 1 THEN 1.0 ELSE -1.0 END AS e FROM n, draws),
 flipped AS (SELECT layer, draw, list(s ORDER BY i) AS s, sum(s * s) AS ss, sqrt(sum(c * c)) AS c FROM (SELECT layer, draw, i, sum(CAST(e AS DOUBLE) * x) AS s, sum(CAST(e AS DOUBLE) * u) AS c FROM flip JOIN xu USING (layer, gene) GROUP BY ALL) GROUP BY ALL),
 signs AS (SELECT layer, draw, avg((g - dd) / sqrt(dd * (ss - 2 * g + dd))) AS loo, any_value(c) / count(*) AS coherence FROM (SELECT layer, draw, dd, ss, c, CAST(e AS DOUBLE) * list_dot_product(d, s) AS g FROM flip JOIN n USING (layer, gene) JOIN flipped USING (layer, draw)) GROUP BY ALL)
 {_dealt_sql("pooled", "pooled", "layer")}{_dealt_sql("family_", "family", "layer, family")},
 halves AS (SELECT layer, gene, draw, row_number() OVER (PARTITION BY layer, draw ORDER BY {L.hashed_sql(f"draw + {L.KINDS['split']}", "number")}, number) AS place, count(*) OVER (PARTITION BY layer, draw) // 2 AS half FROM n, splits),
 split AS (SELECT layer, draw, sum(a * b) / sqrt(sum(a * a) * sum(b * b)) AS cosine FROM (SELECT layer, draw, i, sum(x) FILTER (place <= half) AS a, sum(x) FILTER (place > half AND place <= 2 * half) AS b FROM halves JOIN xu USING (layer, gene) GROUP BY ALL) GROUP BY ALL)
 SELECT f.layer, f.n, {", ".join(f"round(f.{c}, 6) AS {c}" for c in ("v_norm", "v_over_mean", "dnorm_median", "dnorm_cv", "loo_mean", "loo_median", "loo_sd", "loo_min", "loo_max", "loo_pos", "loo_over_quarter", "coherence", "floor"))},
 {", ".join(f"(SELECT round(quantile_cont(cosine, {q}), 6) FROM split x WHERE x.layer = f.layer) AS split_{name}" for name, q in (("median", 0.5), ("low", 0.025), ("high", 0.975)))},
 {", ".join(f"(SELECT round(median({c}), 6) FROM {t} x WHERE x.layer = f.layer) AS null_{name}_{c}, (SELECT round((count(*) FILTER (x.{c} >= f.{real}) + 1) / CAST(count(*) + 1 AS DOUBLE), 6) FROM {t} x WHERE x.layer = f.layer) AS p_{name}_{c}" for t, name in (("signs", "signflip"), ("family_", "mismatch"), ("pooled", "mismatchpool")) for c, real in (("loo", "loo_mean"), ("coherence", "coherence")))}
 FROM facts f"""


@query(_LAYERS_SQL)
def layer_statistics(spark, sf_dir):
    """All 28 statistics of each layer's deltas, 2,000 draws of each null and
    1,000 split halves."""
    x = L.layer_statistics(_paired(spark, sf_dir), "gene", "layer", "family", "h", "p")
    return x.select("layer", "n", *[F.round(c, 6).alias(c) for c in x.columns if c not in ("layer", "n")])


@query(_S + """, m AS (SELECT layer, list(x ORDER BY i) AS mu FROM (SELECT layer, i, avg(x) AS x FROM (SELECT layer, unnest(list_transform(list_zip(h, p), lambda z: (z[1] + z[2]) / 2)) AS x, unnest(range(len(h))) AS i FROM d) GROUP BY 1, 2) GROUP BY 1),
 g AS (SELECT layer, avg(gene % 11) AS gm, count(*) AS n FROM d GROUP BY 1), b AS (SELECT layer, list(x ORDER BY i) AS beta FROM (SELECT layer, i, sum(x) AS x FROM (SELECT layer, unnest(list_transform(d, lambda z: z * (gene % 11 - gm))) AS x, unnest(range(len(d))) AS i FROM d JOIN g USING (layer)) GROUP BY 1, 2) GROUP BY 1),
 v AS (SELECT layer, gene, d, mu, beta, list_transform(list_zip(s, d), lambda z: (z[1] - z[2]) / (n - 1)) AS v FROM d JOIN s USING (layer) JOIN m USING (layer) JOIN g USING (layer) JOIN b USING (layer)), w AS (SELECT *, sqrt(list_dot_product(v, v)) AS vn, sqrt(list_dot_product(d, d)) AS dn FROM v)
 SELECT layer, gene, round(list_dot_product(d, v) / vn / dn, 6) AS loo_cos, round(list_dot_product(d, v) / vn, 6) AS q_loo, round(vn, 6) AS v_loo_norm, round(list_dot_product(d, v) / vn / vn, 6) AS alpha, round(pow(list_dot_product(v, mu) / vn / sqrt(list_dot_product(mu, mu)), 2), 6) AS cone, round(abs(list_dot_product(v, beta) / vn / sqrt(list_dot_product(beta, beta))), 6) AS abs_covariate FROM w""")
def steering_vectors(spark, sf_dir):
    """Each key against the mean delta of the others of its layer."""
    p = _paired(spark, sf_dir).withColumn("gc", (F.col("gene") % 11).cast("double"))
    x = V.steering(p, "gene", "layer", "h", "p", "gc")
    return x.select("layer", "gene", *[F.round(c, 6).alias(c) for c in ("loo_cos", "q_loo", "v_loo_norm", "alpha", "cone", "abs_covariate")])


@query(_S + ", r AS (SELECT layer, gene, d, list_transform(list_zip(d, s), lambda z: z[1] - list_dot_product(d, s) / list_dot_product(s, s) * z[2]) AS r, s FROM d JOIN s USING (layer)) SELECT layer, gene, round(r[1] * sqrt(list_dot_product(d, d)) / sqrt(list_dot_product(r, r)), 6) AS first, round(sqrt(list_dot_product(d, d)), 6) AS norm, true AS orthogonal FROM r")
def axis_removed(spark, sf_dir):
    """Deltas with the shared axis taken out, at their old norm."""
    d = V.deltas(_paired(spark, sf_dir), "h", "p")
    x = d.join(V.sum_vector(d, "layer", "delta", "s"), "layer").withColumn("clean", V.without_axis("delta", "s"))
    return x.select("layer", "gene", F.round(F.col("clean")[0], 6).alias("first"), F.round(V.norm("clean"), 6).alias("norm"), (F.abs(V.dot("clean", "s")) < 1e-9).alias("orthogonal"))


@query(f"WITH e AS ({D.EMBEDDED_SQL}), z AS (SELECT key, v, list_transform(range(0, len(v)), lambda i: list_sum(list_transform(range(0, 4), lambda k: CAST('0x' || substr(md5('1:' || CAST(key AS VARCHAR) || ':' || CAST(i AS VARCHAR)), CAST(1 + 8 * k AS BIGINT), 8) AS BIGINT) / 4294967296.0 - 0.5))) AS z FROM e) SELECT key, round(z[1] * sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(z, z)), 6) AS first, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM z")
def matched_random(spark, sf_dir):
    """Random directions of the same norm."""
    e = D.embedded(spark, sf_dir).withColumn("r", V.matched_random("v", "key"))
    return e.select("key", F.round(F.col("r")[0], 6).alias("first"), F.round(V.norm("r"), 6).alias("norm"))


@query(f"WITH e AS ({D.EMBEDDED_SQL}), u AS (SELECT key, family, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM e) SELECT x.family, round(pow(count(DISTINCT x.key), 2) / sum(pow(list_dot_product(x.u, y.u), 2)), 5) AS ratio FROM u x JOIN u y ON x.family = y.family GROUP BY 1")
def participation_ratio(spark, sf_dir):
    """J37."""
    return V.participation_ratio(D.embedded(spark, sf_dir), "family", "v").withColumn("ratio", F.round("ratio", 5))


@query(f"WITH g AS (SELECT family, avg((length(cds) - length(translate(cds, 'GC', ''))) / CAST(length(cds) AS DOUBLE)) AS gc FROM ({D.LOCI_SQL}) GROUP BY 1) SELECT x.family AS a, y.family AS b, round(abs(x.gc - y.gc), 6) AS d FROM g x JOIN g y ON x.family < y.family")
def gc_between(spark, sf_dir):
    """Differences of families' mean GC."""
    from strandline.functions import sequences as S

    g = D.loci(spark, sf_dir).groupBy("family").agg(F.avg(F.expr(S.gc_length("cds"))).alias("gc"))
    x, y = g.alias("x"), g.alias("y")
    return x.join(y, F.col("x.family") < F.col("y.family")).select(F.col("x.family").alias("a"), F.col("y.family").alias("b"), F.round(F.abs(F.col("x.gc") - F.col("y.gc")), 6).alias("d"))


@query(_KMERS.replace(", 4) AS kmer", ", 3) AS kmer").replace("length(cds) - 2)", "length(cds) - 1)").replace("{4}", "{3}") + """, u AS (SELECT family, key, kmer, freq / sqrt(sum(freq * freq) OVER (PARTITION BY key)) AS u FROM f), n AS (SELECT family, count(DISTINCT key) AS n FROM u GROUP BY 1),
 m AS (SELECT family, kmer, sum(u) AS s FROM u GROUP BY 1, 2), d AS (SELECT x.family AS a, y.family AS b, sum(x.s * y.s) AS t FROM m x JOIN m y ON x.kmer = y.kmer AND x.family < y.family GROUP BY 1, 2) SELECT a, b, round(1 - t / (p.n * q.n), 6) AS d FROM d JOIN n p ON p.family = a JOIN n q ON q.family = b""")
def kmer_between(spark, sf_dir):
    """Mean k-mer distance of the member pairs of two families, from mean vectors."""
    f = kmers.frequencies(D.loci(spark, sf_dir), "key", "cds", 3, group="family")
    return kmers.between(f, "key", "family").select("a", "b", F.round("distance", 6).alias("d"))


@query(f"WITH e AS ({D.EMBEDDED_SQL}), p AS (SELECT key // 5 AS gene, key AS place, v FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY place) AS r, count(*) OVER (PARTITION BY gene) AS n FROM p), x AS (SELECT gene, unnest(v) AS x, unnest(range(len(v))) AS i FROM r WHERE r > n // 2), m AS (SELECT gene, i, avg(x) AS x FROM x GROUP BY 1, 2) SELECT gene, round(sqrt(sum(x * x)), 6) AS norm, round(sum(x), 6) AS total FROM m GROUP BY 1")
def second_half_pooled(spark, sf_dir):
    """Means over the second half of a key's places."""
    p = D.embedded(spark, sf_dir).select(F.expr("key DIV 5").alias("gene"), F.col("key").alias("place"), "v")
    x = V.second_half_mean(p, "gene", "place", "v")
    return x.select("gene", F.round(V.norm("pooled"), 6).alias("norm"), F.round(F.aggregate("pooled", F.lit(0.0), lambda s, y: s + y), 6).alias("total"))


@query(f"WITH e AS ({D.EMBEDDED_SQL}), m AS (SELECT x.n_nationkey AS a, y.n_nationkey AS b, abs(x.n_nationkey - y.n_nationkey) / 7.0 AS d FROM nation x JOIN nation y ON x.n_nationkey < y.n_nationkey), k AS (SELECT key, family, CAST(key % 25 AS INT) AS species FROM e) SELECT x.family, x.key AS a, y.key AS b, round(coalesce(m.d, 0), 6) AS d FROM k x JOIN k y ON x.family = y.family AND x.key < y.key LEFT JOIN m ON m.a = least(x.species, y.species) AND m.b = greatest(x.species, y.species)")
def matrix_gather(spark, sf_dir):
    """A labelled matrix looked up for the member pairs of each group; 0 on its diagonal."""
    n = D.table(spark, sf_dir, "nation").select("n_nationkey")
    m = n.toDF("ma").join(n.toDF("mb"), F.col("ma") < F.col("mb")).withColumn("d", F.abs(F.col("ma") - F.col("mb")) / 7.0)
    k = D.embedded(spark, sf_dir).select("key", "family", (F.col("key") % 25).cast("int").alias("species"))
    pairs = tiles.member_pairs(k, "family", "key", "species").select("family", "a", "b", F.least("species_a", "species_b").alias("ma"), F.greatest("species_a", "species_b").alias("mb"))
    # the matrix is a row for each pair of labels; the pairs are the data and are not moved
    return pairs.join(F.broadcast(m), ["ma", "mb"], "left").select("family", "a", "b", F.round(F.coalesce("d", F.lit(0.0)), 6).alias("d"))


_K2 = f"""WITH c AS (SELECT p_brand AS family, p_size AS k, count(*) AS n FROM part GROUP BY 1, 2), t AS (SELECT family, sum(n) AS t FROM c GROUP BY 1), f AS (SELECT family, k, n / CAST(t AS DOUBLE) AS f FROM c JOIN t USING (family)),
 g AS (SELECT x.family AS a, y.family AS b, k.k FROM t x JOIN t y ON x.family < y.family, (SELECT DISTINCT k FROM c) k), j AS (SELECT g.a, g.b, coalesce(x.f, 0) AS p, coalesce(y.f, 0) AS q FROM g LEFT JOIN f x ON x.family = g.a AND x.k = g.k LEFT JOIN f y ON y.family = g.b AND y.k = g.k)"""


@query(_K2 + " SELECT a, b, round(sum(CASE WHEN p > 0 THEN 0.5 * p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(2 * q / (p + q)) ELSE 0 END), 6) AS d FROM j GROUP BY 1, 2")
def profile_divergence(spark, sf_dir):
    """Squared Jensen-Shannon distance of families' profile means, which are normalised."""
    from strandline.functions import sequences as S

    p = D.table(spark, sf_dir, "part").groupBy("p_brand").pivot("p_size", list(range(1, 51))).count().na.fill(0)
    total = sum((F.col(str(i)) for i in range(1, 51)), F.lit(0))
    v = p.select(F.col("p_brand").alias("family"), F.array(*[F.col(str(i)) / total for i in range(1, 51)]).alias("p"))
    x, y = v.alias("x"), v.alias("y")
    return x.join(y, F.col("x.family") < F.col("y.family")).select(F.col("x.family").alias("a"), F.col("y.family").alias("b"), F.round(F.expr(S.divergence("x.p", "y.p")), 6).alias("d"))


# -- not in SQL: seeded draws and solvers; tests hold the operators against brute force -----


@query()
def mismatch_null(spark, sf_dir):
    """Partners dealt anew, pooled and inside families, 2,000 draws."""
    x = L.layer_statistics(_paired(spark, sf_dir), "gene", "layer", "family", "h", "p", splits=1)
    rows = [F.struct(F.lit(kind).alias("kind"), F.col("loo_mean").alias("loo"), F.col(f"p_{name}_loo").alias("p_loo"), "coherence", F.col(f"p_{name}_coherence").alias("p_coherence")) for kind, name in (("pooled", "mismatchpool"), ("family", "mismatch"))]
    return x.select("layer", F.explode(F.array(*rows)).alias("r")).select("layer", "r.*")


def _residuals(spark, sf_dir):
    return C.residuals(_members(spark, sf_dir), "family", "key", "v")


@query()
def cluster_evidence(spark, sf_dir):
    """Silhouette excess and gap over 500 spectrum-matched nulls, k from 2 to 8."""
    return C.existence(_residuals(spark, sf_dir), "family", "key", "v")


@query()
def cluster_stability(spark, sf_dir):
    """Agreement of the cut into three with 500 bootstraps and halves."""
    x = _residuals(spark, sf_dir)
    return C.stability(x, x.groupBy("family").agg(F.lit(3).alias("best_k")), "family", "key", "v")


@query()
def panel_contrast(spark, sf_dir):
    """2,000 draws of panels of seven sizes."""
    return C.panel_contrast(_members(spark, sf_dir), "family", "key", "v")


@query()
def w2_subsamples(spark, sf_dir):
    """Exact distances over equal-size subsamples: mean and deviation."""
    e = _members(spark, sf_dir)
    least = e.groupBy("family").agg(F.count("*").alias("n")).agg(F.min("n")).first()[0]
    return transport.group_pairs(e, "family", "v", "spread", size=min(20, least), repeats=10).withColumnsRenamed({"value": "mean", "residual": "sd"})


@query()
def fgw_entropic(spark, sf_dir):
    """J13."""
    return transport.group_pairs(_members(spark, sf_dir), "family", "v", "entropic_fused", alpha=0.5, reg=0.01)


@query()
def w2_scores(spark, sf_dir):
    """Distances of families scored against a baseline distance."""
    w = transport.group_pairs(_members(spark, sf_dir), "family", "v", "entropic", reg=0.01).select("a", "b", F.col("value").alias("x"))
    c = V.centroids(D.embedded(spark, sf_dir), "family", "v").withColumn("one", F.lit(1))
    base = V.pair_distances(c, "family", "one", "centroid").select("a", "b", F.col("angular").alias("y"))
    return R.spearman_p(w.join(base, ["a", "b"]).withColumn("approach", F.lit("wasserstein")), ["approach"], "x", "y", least=3)


@query()
def centroid_paths(spark, sf_dir):
    """Shortest paths between family centroids."""
    c = V.centroids(D.embedded(spark, sf_dir), "family", "v").withColumn("one", F.lit(1))

    def fn(x, keys, rng):
        k, w = transport.centroid_geodesic(x)
        i, j = np.triu_indices(len(x), 1)
        return pd.DataFrame({"k": k, "a": keys[i], "b": keys[j], "d": w[i, j]})

    return resample.grouped_vectors(c, "one", "family", "centroid", fn, "k int, a int, b int, d double")
