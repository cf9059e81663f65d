"""Knowledge-graph queries over entities and edges made of the star schema (KG*, ED*, J*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .registry import query, table

KINDS = {"region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name"), "customer": ("c_custkey", "c_name"), "supplier": ("s_suppkey", "s_name"), "part": ("p_partkey", "p_name")}
LINKS = {"in_region": ("nation", "n_nationkey", "nation", "n_regionkey", "region"), "lives_in": ("customer", "c_custkey", "customer", "c_nationkey", "nation"), "based_in": ("supplier", "s_suppkey", "supplier", "s_nationkey", "nation")}
ENTITIES = " UNION ALL ".join(f"SELECT '{t}:' || CAST({k} AS VARCHAR) AS id, '{t}' AS type, {v} AS value, lower(trim({v})) AS norm, round(0.5 + ({k} % 50) / 100, 2) AS confidence FROM {t}" for t, (k, v) in KINDS.items())
EDGES = " UNION ALL ".join(f"SELECT '{n}' AS rel, '{a}:' || CAST({ka} AS VARCHAR) AS src, '{b}:' || CAST({kb} AS VARCHAR) AS tgt FROM {t}" for n, (t, ka, a, kb, b) in LINKS.items())


def entities(spark, d):
    one = lambda t, k, v: table(spark, d, t).select(F.concat(F.lit(f"{t}:"), F.col(k).cast("string")).alias("id"), F.lit(t).alias("type"), F.col(v).alias("value"), F.lower(F.trim(v)).alias("norm"), F.round(0.5 + F.col(k) % 50 / 100, 2).alias("confidence"))
    return reduce(lambda a, b: a.unionByName(b), (one(t, k, v) for t, (k, v) in KINDS.items()))


def edges(spark, d):
    node = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
    one = lambda n, t, ka, a, kb, b: table(spark, d, t).select(F.lit(n).alias("rel"), node(a, ka).alias("src"), node(b, kb).alias("tgt"))
    return reduce(lambda a, b: a.unionByName(b), (one(n, *x) for n, x in LINKS.items()))


def ends(e):
    """Each edge at both its ends, a self-loop once."""
    return e.select(F.col("src").alias("id"), F.struct("rel", "src", "tgt").alias("edge")).union(e.filter("src <> tgt").select("tgt", F.struct("rel", "src", "tgt")))


ENDS = f"SELECT src AS id FROM ({EDGES}) UNION ALL SELECT tgt FROM ({EDGES}) WHERE src <> tgt"


@query("kg2_find_entities", f"SELECT id, value FROM ({ENTITIES}) WHERE type = 'part' AND contains(lower(value), 'a') AND confidence >= 0.7")
def _(spark, d):
    return entities(spark, d).filter((F.col("type") == "part") & F.lower("value").contains("a") & (F.col("confidence") >= 0.7)).select("id", "value")


@query("kg3_degree_centrality", f"WITH g AS (SELECT id, count(*) AS n FROM ({ENDS}) GROUP BY id) SELECT id, round(n / (SELECT max(n) FROM g), 6) AS centrality FROM g")
def _(spark, d):
    degree = ends(edges(spark, d)).groupBy("id").agg(F.count("*").alias("n"))
    most = degree.agg(F.max("n").alias("most"))
    return degree.join(F.broadcast(most)).select("id", F.round(F.col("n") / F.col("most"), 6).alias("centrality"))


@query("kg5_graph_stats", f"SELECT type, CAST(count(*) AS BIGINT) AS n, round(avg(confidence), 6) AS mean_confidence FROM ({ENTITIES}) GROUP BY type")
def _(spark, d):
    return entities(spark, d).groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query("kg1_kg11_neighbours", f"SELECT id, CAST(count(*) FILTER (WHERE side = 'out') AS BIGINT) AS n_out, CAST(count(*) FILTER (WHERE side = 'in') AS BIGINT) AS n_in FROM (SELECT src AS id, 'out' AS side FROM ({EDGES}) UNION ALL SELECT tgt, 'in' FROM ({EDGES})) GROUP BY id")
def _(spark, d):
    e = edges(spark, d)
    both = e.select(F.col("src").alias("id"), F.lit("out").alias("side")).union(e.select("tgt", F.lit("in")))
    return both.groupBy("id").agg(F.count_if(F.col("side") == "out").alias("n_out"), F.count_if(F.col("side") == "in").alias("n_in"))


@query("kg15_constraints", f"SELECT id, trim(value) <> '' AND confidence BETWEEN 0 AND 1 AND (type <> 'part' OR length(value) >= 10) AS valid FROM ({ENTITIES})")
def _(spark, d):
    valid = (F.trim("value") != "") & F.col("confidence").between(0, 1) & ((F.col("type") != "part") | (F.length("value") >= 10))
    return entities(spark, d).select("id", valid.alias("valid"))


@query("ed1_exact_dedup", f"SELECT type, norm, min(id) AS canonical, CAST(count(*) AS BIGINT) AS n FROM ({ENTITIES}) GROUP BY ALL")
def _(spark, d):
    return entities(spark, d).groupBy("type", "norm").agg(F.min("id").alias("canonical"), F.count("*").alias("n"))


@query("ed7_j12_edge_remap", f"WITH m AS (SELECT id, min(id) OVER (PARTITION BY type, norm) AS c FROM ({ENTITIES})) SELECT rel, a.c AS src, b.c AS tgt FROM ({EDGES}) e JOIN m a ON a.id = e.src JOIN m b ON b.id = e.tgt")
def _(spark, d):
    m = entities(spark, d).select("id", F.min("id").over(W.partitionBy("type", "norm")).alias("c"))
    a, b = m.select(F.col("id").alias("src"), F.col("c").alias("s")), m.select(F.col("id").alias("tgt"), F.col("c").alias("t"))
    return edges(spark, d).join(a, "src").join(b, "tgt").select("rel", F.col("s").alias("src"), F.col("t").alias("tgt"))


@query("ed12_layer_stats", f"SELECT CASE WHEN n > 1 THEN 'exact' ELSE 'new' END AS layer, CAST(count(*) AS BIGINT) AS n FROM (SELECT type, norm, count(*) AS n FROM ({ENTITIES}) GROUP BY ALL) GROUP BY 1")
def _(spark, d):
    each = entities(spark, d).groupBy("type", "norm").agg(F.count("*").alias("n"))
    return each.groupBy(F.when(F.col("n") > 1, "exact").otherwise("new").alias("layer")).agg(F.count("*").alias("n"))


@query("ed11_document_subgraph", f"SELECT e.rel, e.src, e.tgt FROM ({EDGES}) e WHERE e.tgt = 'nation:3'")
def _(spark, d):
    return edges(spark, d).filter("tgt = 'nation:3'").select("rel", "src", "tgt")


@query("tk10_top_entities", f"SELECT id, confidence FROM ({ENTITIES}) ORDER BY confidence DESC, id LIMIT 10")
def _(spark, d):
    return entities(spark, d).select("id", "confidence").orderBy(F.col("confidence").desc(), "id").limit(10)


@query("ag3_entity_summary", f"SELECT type, CAST(count(DISTINCT norm) AS BIGINT) AS n, array_to_string(list_sort(list(DISTINCT norm))[1:5], ',') AS examples FROM ({ENTITIES}) GROUP BY type")
def _(spark, d):
    """Examples by five first names per type, without gathering all of them."""
    each = entities(spark, d).select("type", "norm").distinct()
    first = F.row_number().over(W.partitionBy("type").orderBy("norm"))
    counted = each.groupBy("type").agg(F.count("*").alias("n"))
    shown = each.withColumn("rn", first).filter("rn <= 5").groupBy("type").agg(F.array_join(F.array_sort(F.collect_list("norm")), ",").alias("examples"))
    return counted.join(shown, "type")
