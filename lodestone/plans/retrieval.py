"""Retrieval queries over ``embeddings``, ``documents`` and ``benchmark``."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import vectors as V
from ..operators import retrieval as R
from ..operators import search as S
from .registry import query, table
from .text import TOK

COS = "round(list_dot_product({0}::DOUBLE[], {1}::DOUBLE[]) / (sqrt(list_dot_product({0}::DOUBLE[], {0}::DOUBLE[])) * sqrt(list_dot_product({1}::DOUBLE[], {1}::DOUBLE[]))), 6)"
DENSE = f"SELECT q.vec_id AS query_id, e.vec_id AS id, {COS.format('q.embedding', 'e.embedding')} AS score FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q, embeddings e"
SPARSE = f"SELECT query_id, id, CAST(count(*) AS DOUBLE) AS score FROM (SELECT item_id AS query_id, unnest({TOK.format('text')}) AS term FROM benchmark WHERE item_id % 100 = 0) q JOIN (SELECT doc_id AS id, unnest({TOK.format('text')}) AS term FROM documents) p USING (term) GROUP BY ALL"
RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1"


def items(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def asked(spark, d):
    """The stated query set: every vector whose id is divisible by 100."""
    return items(spark, d).filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))


def best(spark, d, k, itself=True):
    """The first ``k`` of every vector of the query set against all."""
    return S.best(asked(spark, d), items(spark, d), k, itself=itself)


def sparse(spark, d):
    questions = table(spark, d, "benchmark").filter("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "text")
    return R.sparse(questions, table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


@query("vs1_dense_topk", f"SELECT query_id, id, score, CAST(rank AS INT) AS rank FROM (SELECT *, {RANK} AS rank FROM ({DENSE})) WHERE rank < 10")
def _(spark, d):
    return best(spark, d, 10)


@query("ft1_sparse_topk", f"SELECT query_id, id, score, CAST(rank AS INT) AS rank FROM (SELECT *, {RANK} AS rank FROM ({SPARSE})) WHERE rank < 10")
def _(spark, d):
    return R.ranked(sparse(spark, d), "score", 10)


HYBRID = f"""WITH a AS (SELECT query_id, id, rank AS r1 FROM (SELECT *, {RANK} AS rank FROM ({DENSE})) WHERE rank < 200),
b AS (SELECT query_id, id, rank AS r2 FROM (SELECT *, {RANK} AS rank FROM ({SPARSE})) WHERE rank < 200),
m AS (SELECT query_id, id, r1, r2, count(r1) OVER (PARTITION BY query_id) AS n1, count(r2) OVER (PARTITION BY query_id) AS n2 FROM a FULL JOIN b USING (query_id, id)),
s AS (SELECT query_id, id, round(1.0 / (60 + coalesce(r1, n1)) + 1.0 / (60 + coalesce(r2, n2)), 9) AS score FROM m)"""


@query("fu0_hybrid_rrf", HYBRID + f" SELECT query_id, id, score FROM (SELECT *, {RANK} AS rank FROM s) WHERE rank < 10")
def _(spark, d):
    return R.rrf(best(spark, d, 200), R.ranked(sparse(spark, d), "score", 200), 10).select("query_id", "id", "score")


def _mm(x):
    return f"CASE WHEN {x} IS NULL THEN 0 WHEN max({x}) OVER w = min({x}) OVER w THEN 0.5 ELSE ({x} - min({x}) OVER w) / (max({x}) OVER w - min({x}) OVER w) END"


def moved(spark, d, step, k):
    """The queries asked anew with another vector, as a HyDE document or an expansion would be."""
    other = items(spark, d).select((F.col("id") - step).alias("query_id"), F.col("vector").alias("query"))
    return S.best(asked(spark, d).select("query_id").join(other, "query_id"), items(spark, d), k)


def _moved(step):
    return f"SELECT q.vec_id - {step} AS query_id, e.vec_id AS id, {COS.format('q.embedding', 'e.embedding')} AS score FROM (SELECT * FROM embeddings WHERE (vec_id - {step}) % 100 = 0) q, embeddings e"


def _first(sql, k):
    return f"SELECT query_id, id, score FROM (SELECT *, {RANK} AS rank FROM ({sql})) WHERE rank < {k}"


def signals(spark, d):
    """Original (hybrid), HyDE and two expansions (dense), 40 candidates each."""
    hybrid = R.rrf(best(spark, d, 200), R.ranked(sparse(spark, d), "score", 200), 40)
    return {"orig": hybrid} | {name: moved(spark, d, step, 40) for step, name in enumerate(("hyde", "exp0", "exp1"), 1)}


SIGNALS = HYBRID + f""", orig AS ({_first('SELECT * FROM s', 40)}), hyde AS ({_first(_moved(1), 40)}), exp0 AS ({_first(_moved(2), 40)}), exp1 AS ({_first(_moved(3), 40)}),
ids AS (SELECT query_id, id FROM orig UNION SELECT query_id, id FROM hyde UNION SELECT query_id, id FROM exp0 UNION SELECT query_id, id FROM exp1),
merged AS (SELECT i.query_id, i.id, o.score AS orig, h.score AS hyde, a.score AS exp0, b.score AS exp1 FROM ids i LEFT JOIN orig o USING (query_id, id) LEFT JOIN hyde h USING (query_id, id) LEFT JOIN exp0 a USING (query_id, id) LEFT JOIN exp1 b USING (query_id, id))"""


@query("j9_merge_signals", SIGNALS + " SELECT *, CASE WHEN orig IS NOT NULL THEN 'orig' WHEN hyde IS NOT NULL THEN 'hyde' WHEN exp0 IS NOT NULL THEN 'exp0' ELSE 'exp1' END AS source FROM merged")
def _(spark, d):
    return R.merge_lists(signals(spark, d))


@query("fu1_four_signals", SIGNALS + f", f AS (SELECT query_id, id, round(0.5 * {_mm('orig')} + 0.25 * {_mm('hyde')} + 0.25 * ({_mm('exp0')} + {_mm('exp1')}) / 2, 6) AS score FROM merged WINDOW w AS (PARTITION BY query_id)) SELECT query_id, id, score AS fused FROM (SELECT *, {RANK} AS rank FROM f) WHERE rank < 10")
def _(spark, d):
    return R.fuse(signals(spark, d), R.FOUR_SIGNALS, 10).select("query_id", "id", "fused")


@query("fu2_three_signals", SIGNALS + f", m2 AS (SELECT * FROM merged WHERE hyde IS NOT NULL OR exp0 IS NOT NULL OR exp1 IS NOT NULL), f AS (SELECT query_id, id, round(0.5 * {_mm('hyde')} + 0.5 * ({_mm('exp0')} + {_mm('exp1')}) / 2, 6) AS score FROM m2 WINDOW w AS (PARTITION BY query_id)) SELECT query_id, id, score AS fused FROM (SELECT *, {RANK} AS rank FROM f) WHERE rank < 10")
def _(spark, d):
    """Layer 2: no original signal, and the weights of the others sum to 1."""
    lists = signals(spark, d)
    return R.fuse({k: lists[k] for k in R.THREE_SIGNALS}, R.THREE_SIGNALS, 10).select("query_id", "id", "fused")


@query("fu3_failed_signal", SIGNALS + f", m2 AS (SELECT query_id, id, orig, hyde, exp1 FROM merged WHERE orig IS NOT NULL OR hyde IS NOT NULL OR exp1 IS NOT NULL), f AS (SELECT query_id, id, round(0.5 * {_mm('orig')} + 0.25 * {_mm('hyde')} + 0.125 * {_mm('exp1')}, 6) AS score FROM m2 WINDOW w AS (PARTITION BY query_id)) SELECT query_id, id, score AS fused FROM (SELECT *, {RANK} AS rank FROM f) WHERE rank < 10")
def _(spark, d):
    """One signal failed and counts as an empty list."""
    return R.fuse(signals(spark, d) | {"exp0": None}, R.FOUR_SIGNALS, 10).select("query_id", "id", "fused")


@query("j10_ranked_refetch", f"SELECT query_id, id, CAST(rank AS INT) AS rank, e.label AS label FROM (SELECT *, {RANK} AS rank FROM ({DENSE})) r JOIN embeddings e ON e.vec_id = r.id WHERE rank < 10")
def _(spark, d):
    return R.with_rank(best(spark, d, 10), items(spark, d).select("id", "label")).select("query_id", "id", "rank", "label")


@query("tk1_nearest", f"SELECT query_id, id, round(1 - score, 6) AS distance, CAST(rank AS INT) AS rank FROM (SELECT *, {RANK} AS rank FROM (SELECT s.* FROM ({DENSE}) s JOIN embeddings e ON e.vec_id = s.id WHERE e.label <> 3)) WHERE rank < 5")
def _(spark, d):
    return R.nearest(asked(spark, d), items(spark, d).filter("label <> 3"), 5)


@query("vs2_by_layer", f"SELECT query_id, layer, id, score, CAST(rank AS INT) AS rank FROM (SELECT s.*, e.label % 3 + 1 AS layer, row_number() OVER (PARTITION BY query_id, e.label % 3 ORDER BY score DESC, s.id) - 1 AS rank FROM ({DENSE}) s JOIN embeddings e ON e.vec_id = s.id) WHERE rank < CASE layer WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 6 END")
def _(spark, d):
    return R.by_layer(asked(spark, d), items(spark, d).withColumn("layer", F.col("label") % 3 + 1))


@query("ft2_token_index", f"SELECT doc_id AS id, array_to_string(list_sort({TOK.format('text')}), ' ') AS tokens FROM documents")
def _(spark, d):
    return R.token_index(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")).select("id", F.array_join("tokens", " ").alias("tokens"))


@query("cx4_expand_hybrid", f"WITH sec AS (SELECT a.vec_id AS query_id, b.vec_id AS id, 0 AS list, row_number() OVER (PARTITION BY a.vec_id ORDER BY b.vec_id) - 1 AS rank FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0), sim AS (SELECT query_id, id, 1 AS list, {RANK} AS rank FROM ({DENSE}) WHERE id <> query_id), u AS (SELECT query_id, id, min(list * 1000 + rank) AS spot FROM (SELECT * FROM sec WHERE rank < 3 UNION ALL SELECT * FROM sim WHERE rank < 3) GROUP BY ALL) SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY spot, id) - 1 AS INT) AS rank FROM u")
def _(spark, d):
    label = items(spark, d).select("id", "label")
    own = asked(spark, d).join(label.withColumnRenamed("id", "query_id"), "query_id").select("query_id", "label")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("id")) - 1
    section = label.join(F.broadcast(own), "label").filter("id <> query_id").select("query_id", "id", place.alias("rank"))
    return R.expand_hybrid(section, best(spark, d, 3, itself=False), 6)


@query("pf4_relative_threshold", f"SELECT query_id, id, score FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM ({DENSE}) WHERE query_id <> id) WHERE score >= round(top - 0.25, 6)")
def _(spark, d):
    top = best(spark, d, 1, itself=False).select("query_id", F.col("score").alias("top"))
    return S.above(asked(spark, d).join(top, "query_id"), items(spark, d), F.round(F.col("top") - 0.25, 6), itself=False)


@query("pf5_absolute_threshold", f"SELECT query_id, id, score FROM ({DENSE}) WHERE score >= 0.3")
def _(spark, d):
    return S.above(asked(spark, d), items(spark, d), F.lit(0.3))


@query("pf2_document_filter", "SELECT vec_id, label FROM embeddings WHERE label = 3")
def _(spark, d):
    return table(spark, d, "embeddings").filter("label = 3").select("vec_id", "label")


@query("pf3_bibliography", "SELECT doc_id FROM documents WHERE source IS NULL OR NOT starts_with(source, 'src1')")
def _(spark, d):
    return table(spark, d, "documents").filter(F.col("source").isNull() | ~F.col("source").startswith("src1")).select("doc_id")


@query("ma1_unit_vectors", "SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6)) AS unit FROM embeddings")
def _(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform(V.unit(F.col("embedding")), lambda x: V.rounded(x, 6)).alias("unit"))


@query("ma4_embedding_stats", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(max(len(embedding)) AS INT) AS dim, round(avg(v), 6) AS mean_norm, round(stddev_pop(v), 6) AS std_norm FROM (SELECT embedding, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS v FROM embeddings)")
def _(spark, d):
    v = V.norm(F.col("embedding"))
    return table(spark, d, "embeddings").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim"), F.round(F.avg(v), 6).alias("mean_norm"), F.round(F.stddev_pop(v), 6).alias("std_norm"))


@query("tk3_cluster_diversity", f"WITH x AS (SELECT s.query_id, s.id, score, CASE WHEN label = 9 THEN -1 ELSE label END AS cluster FROM ({DENSE}) s JOIN embeddings ON vec_id = s.id), y AS (SELECT *, row_number() OVER (PARTITION BY query_id, cluster ORDER BY score DESC, id) AS rn FROM x) SELECT query_id, id, cluster FROM (SELECT *, {RANK} AS rank FROM y WHERE rn = 1 OR cluster = -1) WHERE rank < 12")
def _(spark, d):
    """The best of each cluster; label 9 stands for noise, which has no limit of its own."""
    cluster = F.when(F.col("label") == 9, -1).otherwise(F.col("label")).alias("cluster")
    return R.pick_diverse(S.best(asked(spark, d), items(spark, d).select("id", "vector", cluster), 12, "cluster").drop("rank"), 12).select("query_id", "id", "cluster")


@query("cx3_expand_similar", f"SELECT query_id, id FROM (SELECT *, {RANK} AS rank FROM ({DENSE}) WHERE id <> query_id) WHERE rank < 3")
def _(spark, d):
    return best(spark, d, 3, itself=False).select("query_id", "id")


@query("vs3_hierarchical", f"WITH x AS (SELECT s.query_id, s.id, score, e.label AS doc, CASE s.id % 10 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 3 END AS layer FROM ({DENSE}) s JOIN embeddings e ON e.vec_id = s.id), l1 AS (SELECT query_id, doc FROM (SELECT *, {RANK} AS rank FROM x WHERE layer = 1) WHERE rank = 0), y AS (SELECT x.*, row_number() OVER (PARTITION BY query_id, layer ORDER BY score DESC, id) AS rn, max(score) OVER (PARTITION BY query_id, layer) AS top FROM x JOIN l1 USING (query_id, doc) WHERE layer <> 1) SELECT query_id, layer, id, score FROM y WHERE (layer = 3 AND rn <= 6 AND score >= round(top - 0.25, 6)) OR (layer = 2 AND rn <= 3)")
def _(spark, d):
    """One vector in ten stands for its document, two for sections, the others for chunks."""
    layer = F.when(F.col("id") % 10 == 0, 1).when(F.col("id") % 10 <= 2, 2).otherwise(3)
    return R.hierarchical(asked(spark, d), items(spark, d).select("id", "vector", layer.alias("layer"), F.col("label").alias("doc")))


CONF = f"SELECT query_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM ({DENSE}) WHERE id <> query_id"


@query("wn7_rc4_confidence_terms", f"SELECT query_id, max(score) AS top, round(max(score) - max(score) FILTER (WHERE rn = 2), 6) AS gap, round(stddev_pop(score), 6) AS std, CAST(count(*) FILTER (WHERE score >= 0.2) AS BIGINT) AS consensus, CASE WHEN max(score) >= 0.85 THEN 'HIGH' WHEN max(score) >= 0.7 THEN 'MEDIUM' WHEN max(score) >= 0.5 THEN 'LOW' ELSE 'VERY_LOW' END AS band FROM ({CONF}) WHERE rn <= 10 GROUP BY query_id")
def _(spark, d):
    top = best(spark, d, 10, itself=False)
    most = F.max("score")
    band = F.when(most >= 0.85, "HIGH").when(most >= 0.7, "MEDIUM").when(most >= 0.5, "LOW").otherwise("VERY_LOW")
    return top.groupBy("query_id").agg(most.alias("top"), F.round(most - F.max(F.when(F.col("rank") == 1, F.col("score"))), 6).alias("gap"), F.round(F.stddev_pop("score"), 6).alias("std"), F.count_if(F.col("score") >= 0.2).alias("consensus"), band.alias("band"))


TWINS = "(SELECT * FROM embeddings UNION ALL SELECT vec_id + 1000000, embedding, label FROM embeddings WHERE vec_id % 200 = 0)"


@query("du1_near_duplicates", f"WITH e AS {TWINS}, r AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {COS.format('q.embedding', 'e.embedding')} AS score FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q, e) SELECT query_id AS id, arg_max(id, (score, -id)) AS twin, max(score) AS score FROM (SELECT *, {RANK} AS rank FROM r) WHERE rank < 5 AND id <> query_id GROUP BY query_id HAVING max(score) >= 0.98")
def _(spark, d):
    """The best of a query's first five neighbours, itself left out, if it is as good as the same; every 200th vector is there twice."""
    own = items(spark, d).select("id", "vector")
    twins = own.unionByName(own.filter("id % 200 = 0").withColumn("id", F.col("id") + 1000000))
    near = S.best(asked(spark, d), twins, 5).filter("id <> query_id")
    best = near.groupBy(F.col("query_id").alias("id")).agg(F.max_by(F.col("id"), F.struct("score", -F.col("id"))).alias("twin"), F.max("score").alias("score"))
    return best.filter("score >= 0.98")


CENTROIDS = "SELECT label, i, avg(x::DOUBLE) AS c FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL"


@query("cl7_centroids", f"SELECT label, CAST(i AS INT) AS i, round(c, 6) AS c FROM ({CENTROIDS})")
def _(spark, d):
    each = items(spark, d).select("label", F.posexplode("vector").alias("p", "x"))
    return each.groupBy("label", (F.col("p") + 1).alias("i")).agg(V.rounded(F.avg(F.col("x").cast("double")), 6).alias("c"))


@query("cl2_nearest_seed", f"SELECT id, arg_max(seed, (score, -seed)) AS seed FROM (SELECT e.vec_id AS id, s.vec_id AS seed, {COS.format('e.embedding', 's.embedding')} AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id < 8) s) GROUP BY id")
def _(spark, d):
    seeds = items(spark, d).filter("id < 8").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    return R.dense(seeds, items(spark, d)).groupBy("id").agg(F.max_by("query_id", F.struct("score", -F.col("query_id"))).alias("seed"))


@query("cl9_centroid_distance", f"SELECT vec_id AS id, round(1 - list_dot_product(embedding::DOUBLE[], c) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(c, c))), 5) AS distance FROM embeddings JOIN (SELECT label, list(c ORDER BY i) AS c FROM ({CENTROIDS}) GROUP BY label) USING (label)")
def _(spark, d):
    each = items(spark, d).select("label", F.posexplode("vector").alias("p", "x")).groupBy("label", "p").agg(F.avg(F.col("x").cast("double")).alias("c"))
    centroid = each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "c"))), lambda s: s["c"]).alias("c"))
    near = F.try_divide(V.dot(F.col("vector"), F.col("c")), V.norm(F.col("vector")) * V.norm(F.col("c")))
    return items(spark, d).join(centroid, "label").select("id", F.round(1 - near, 5).alias("distance"))
