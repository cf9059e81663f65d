"""Clustering queries over ``embeddings`` (CL*, VS4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import clusters as C
from ..operators.density import density_levels
from .registry import query
from .retrieval import asked, items

UNIT = "list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))"


def seeds(spark, d, n=8):
    """The first vectors as the given seeds of clusters."""
    rows = items(spark, d).orderBy("id").limit(n).collect()
    return [(i, list(r["vector"])) for i, r in enumerate(rows)]


def own(spark, d):
    return items(spark, d).select("id", "vector")


@query("cl1_first_step", f"WITH e AS (SELECT vec_id AS id, {UNIT} AS u FROM embeddings), s AS (SELECT row_number() OVER (ORDER BY id) - 1 AS cluster, u FROM e ORDER BY id LIMIT 8), a AS (SELECT e.id, e.u, arg_max(s.cluster, (round(list_dot_product(e.u, s.u), 9), -s.cluster)) AS cluster FROM e, s GROUP BY ALL), m AS (SELECT cluster, i, sum(x) AS v FROM (SELECT cluster, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM a) GROUP BY ALL), n AS (SELECT cluster, sqrt(sum(v * v)) AS norm FROM m GROUP BY cluster) SELECT CAST(cluster AS INT) AS cluster, CAST(i AS INT) AS i, round(v / norm, 6) AS x FROM m JOIN n USING (cluster)")
def _(spark, d):
    """Centroids after one step from given seeds."""
    _, centroids = C.k_means(own(spark, d), seeds(spark, d), rounds=1)
    rows = [(k, i + 1, v) for k, x in centroids for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "cluster int, i int, x double").select("cluster", "i", V.rounded(F.col("x"), 6).alias("x"))


@query("cl1_spherical_k_means")
def _(spark, d):
    members, _ = C.k_means(own(spark, d), seeds(spark, d), rounds=10)
    return members.select("id", "cluster")


MEMBERSHIP = f"WITH e AS (SELECT vec_id AS id, {UNIT} AS u FROM embeddings), s AS (SELECT row_number() OVER (ORDER BY id) - 1 AS cluster, u FROM e ORDER BY id LIMIT 4), w AS (SELECT e.id, s.cluster, pow(greatest(1 - least(1, greatest(-1, list_dot_product(e.u, s.u))), 1e-9), -2.0) AS w FROM e, s), u AS (SELECT id, CAST(cluster AS INT) AS cluster, w / sum(w) OVER (PARTITION BY id) AS u FROM w)"


@query("cl3_memberships", MEMBERSHIP + " SELECT id, cluster, round(u, 6) AS u FROM u")
def _(spark, d):
    fixed = [(k, C._unit(x)) for k, x in seeds(spark, d, 4)]
    return C.memberships(own(spark, d), fixed).select("id", "cluster", F.round("u", 6).alias("u"))


@query("cl3_entropy", MEMBERSHIP + " SELECT id, round(-sum(CASE WHEN u > 0 THEN u * ln(u) ELSE 0 END), 5) AS entropy FROM u GROUP BY id")
def _(spark, d):
    fixed = [(k, C._unit(x)) for k, x in seeds(spark, d, 4)]
    return C.entropy(C.memberships(own(spark, d), fixed)).select("id", F.round("entropy", 5).alias("entropy"))


@query("cl3_fuzzy_c_means")
def _(spark, d):
    shares, _ = C.fuzzy_c_means(own(spark, d), seeds(spark, d, 4), rounds=5)
    return shares.select("id", "cluster", "u")


@query("cl4_spread_seeds")
def _(spark, d):
    rows = [(k, x) for k, x in C.spread_seeds(own(spark, d), 8)]
    return spark.createDataFrame(rows, "cluster int, centroid array<double>")


@query("cl5_density")
def _(spark, d):
    return C.density(items(spark, d), "label", 5, 0.7)


@query("cl6_agglomerative")
def _(spark, d):
    return C.agglomerative(items(spark, d), "label")


@query("cl8_quality", f"WITH e AS (SELECT vec_id AS id, label, {UNIT} AS u FROM embeddings WHERE label <> 9), p AS (SELECT a.id, a.label, b.label AS other, sum(1 - list_dot_product(a.u, b.u)) AS s, count(*) AS n FROM e a JOIN e b ON a.id <> b.id GROUP BY ALL), f AS (SELECT id, max(s / n) FILTER (WHERE label = other) AS a, min(s / n) FILTER (WHERE label <> other) AS b FROM p GROUP BY id), m AS (SELECT label, i, avg(x) AS c FROM (SELECT label, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM e) GROUP BY ALL), c AS (SELECT label, list(c ORDER BY i) AS c FROM m GROUP BY label), t AS (SELECT e.label, avg(list_distance(e.u, c.c)) AS s FROM e JOIN c USING (label) GROUP BY e.label), r AS (SELECT a.label, max((ta.s + tb.s) / list_distance(a.c, b.c)) AS r FROM c a JOIN c b ON a.label <> b.label JOIN t ta ON ta.label = a.label JOIN t tb ON tb.label = b.label GROUP BY a.label) SELECT (SELECT round(avg((b - a) / greatest(a, b)), 6) FROM f) AS silhouette, (SELECT round(avg(r), 6) FROM r) AS davies_bouldin, (SELECT CAST(count(*) AS BIGINT) FROM c) AS n_clusters, (SELECT round(avg(CASE WHEN label = 9 THEN 1.0 ELSE 0 END), 6) FROM embeddings) AS noise_ratio")
def _(spark, d):
    """Labels as clusters, 9 as noise; the SQL makes all pairs, the operator none."""
    rows = items(spark, d).select("id", "vector", F.when(F.col("label") == 9, -1).otherwise(F.col("label")).alias("cluster"))
    return C.quality(rows).select(F.round("silhouette", 6).alias("silhouette"), F.round("davies_bouldin", 6).alias("davies_bouldin"), "n_clusters", F.round("noise_ratio", 6).alias("noise_ratio"))


@query("vs4_ivf_search")
def _(spark, d):
    """Half of the cells probed; tests hold its recall against exact search."""
    members, centroids = C.k_means(own(spark, d), C.spread_seeds(own(spark, d), 16), rounds=3)
    return C.probe(asked(spark, d), members.select("id", "vector", "cluster"), centroids, 10, 8)


@query("cl5_density_levels")
def _(spark, d):
    """Labels as groups."""
    return density_levels(items(spark, d), "label")
