"""Queries of sources, sinks, hierarchy, retrieval confidence and definitions over stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .registry import query, table
from .text import CHUNKS, SECTIONS, chunks, docs, sections


def clamp(x):
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def r6(x):
    return F.round(x, 6)


# Sources and sinks


@query("sc5_layer_scan", f"SELECT chunk_id, doc_id, 3 AS layer, source, lang FROM ({CHUNKS}) c JOIN documents USING (doc_id)")
def _(spark, d):
    return chunks(spark, d).join(docs(spark, d).select("doc_id", "source", "lang"), "doc_id").select("chunk_id", "doc_id", F.lit(3).alias("layer"), "source", "lang")


@query("sc8_upsert_mentions", "SELECT l_orderkey, l_suppkey, confidence FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber DESC, confidence DESC) AS rn FROM (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN 1.0 ELSE l_quantity END AS confidence FROM lineitem)) WHERE rn = 1")
def _(spark, d):
    """The latest mention of a key stays; one without a confidence has 1."""
    given = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", F.coalesce(given, F.lit(1.0)).alias("confidence"))
    return rows.groupBy("l_orderkey", "l_suppkey").agg(F.max_by("confidence", F.struct("l_linenumber", "confidence")).alias("confidence"))


@query("sc14_qa_rows", "SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS number FROM documents WHERE trim(text) <> '' AND n_chars >= 100")
def _(spark, d):
    valid = docs(spark, d).filter("trim(text) <> '' AND n_chars >= 100")
    return valid.select("doc_id", F.row_number().over(W.partitionBy("source").orderBy("doc_id")).cast("long").alias("number"))


@query("sc15_exchange_rates", "SELECT n_nationkey, CAST(n_nationkey + 1 AS DOUBLE) * 2 / 100 AS rate FROM nation WHERE (n_nationkey + 1) * 2 / 100.0 BETWEEN 0.1 AND 0.4")
def _(spark, d):
    """Country|Currency|Amount|Code|Rate lines; the rate of one unit, within bounds."""
    line = F.concat(F.col("n_name"), F.lit("|unit|100|XXX|"), ((F.col("n_nationkey") + 1) * 2).cast("string"))
    fields = table(spark, d, "nation").select("n_nationkey", F.split(line, r"\|").alias("f"))
    rate = fields.select("n_nationkey", (F.col("f")[4].cast("double") / F.col("f")[2].cast("double")).alias("rate"))
    return rate.filter("rate BETWEEN 0.1 AND 0.4")


# Text


@query("tx21_tsquery_sanitiser", r"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '[&|!():*<>''\\]', ' ', 'g'), ' +', ' ', 'g')) AS q FROM conversations")
def _(spark, d):
    plain = F.regexp_replace(F.regexp_replace("text", r"[&|!():*<>'\\]", " "), " +", " ")
    return table(spark, d, "conversations").select("conv_id", "turn", F.trim(plain).alias("q"))


@query("pf6_section_filter", "SELECT o_orderkey FROM orders WHERE starts_with(o_orderpriority, '1') AND coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderkey % 5 END, 0) BETWEEN 0 AND 2")
def _(spark, d):
    level = F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey") % 5)
    return table(spark, d, "orders").filter(F.col("o_orderpriority").startswith("1") & F.coalesce(level, F.lit(0)).between(0, 2)).select("o_orderkey")


@query("pf7_cluster_members", "SELECT vec_id FROM embeddings WHERE label IN (1, 4, 7)")
def _(spark, d):
    return table(spark, d, "embeddings").filter(F.col("label").isin(1, 4, 7)).select("vec_id")


@query("pf11_find_entity", "SELECT s_suppkey FROM supplier WHERE contains(lower(s_name), 'supplier') AND s_acctbal >= 1000")
def _(spark, d):
    return table(spark, d, "supplier").filter(F.lower("s_name").contains("supplier") & (F.col("s_acctbal") >= 1000)).select("s_suppkey")


@query("pf12_prefix_probe", "SELECT c_custkey FROM customer WHERE starts_with(c_name, 'Customer#0000000') OR c_name = 'Customer#1'")
def _(spark, d):
    """A prefix is taken literally, whatever LIKE would read into it."""
    return table(spark, d, "customer").filter(F.col("c_name").startswith("Customer#0000000") | (F.col("c_name") == "Customer#1")).select("c_custkey")


# Aggregates and windows


@query("ag22_dataset_stats", f"SELECT round(avg(n), 6) AS mean_snippets, CAST(count(*) AS BIGINT) AS n_docs FROM (SELECT doc_id, count(*) AS n FROM ({CHUNKS}) GROUP BY doc_id)")
def _(spark, d):
    each = chunks(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"))
    return each.agg(r6(F.avg("n")).alias("mean_snippets"), F.count("*").alias("n_docs"))


@query("ag4_entity_count_in_chunk", "SELECT l_orderkey, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS INT) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (WHERE l_returnflag = 'R') > 0")
def _(spark, d):
    return table(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n"))


@query("ag2_document_entities", "SELECT l_orderkey % 100 AS doc, l_suppkey, CAST(count(*) AS BIGINT) AS n, round(avg(l_quantity), 6) AS confidence FROM lineitem GROUP BY ALL")
def _(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") % 100).alias("doc"), "l_suppkey", "l_quantity")
    return rows.groupBy("doc", "l_suppkey").agg(F.count("*").alias("n"), r6(F.avg("l_quantity")).alias("confidence"))


@query("ag23_metric_means", "SELECT round(avg(l_discount), 6) AS precision, round(avg(l_tax), 6) AS recall, round(avg(l_quantity), 6) AS f1 FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").agg(*[r6(F.avg(c)).alias(a) for c, a in (("l_discount", "precision"), ("l_tax", "recall"), ("l_quantity", "f1"))])


@query("wn3_neighbours", "SELECT a.conv_id, a.turn AS target, b.turn AS neighbour, b.turn - a.turn AS distance FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 2 AND a.turn + 2 AND a.turn <> b.turn")
def _(spark, d):
    """Turns up to two apart: each row is dealt to the places that it is near, so the join is an equi-join."""
    rows = table(spark, d, "conversations").select("conv_id", "turn")
    dealt = rows.select("conv_id", F.col("turn").alias("neighbour"), F.explode(F.array(*[F.col("turn") + k for k in (-2, -1, 1, 2)])).alias("target"))
    found = rows.withColumnRenamed("turn", "target").join(dealt, ["conv_id", "target"])
    return found.select("conv_id", "target", "neighbour", (F.col("neighbour") - F.col("target")).alias("distance"))


# Top-k


@query("tk6_merge_lists", "SELECT id, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY list) AS rn FROM (SELECT p_partkey AS id, p_retailprice AS score, 0 AS list FROM part WHERE p_size < 10 UNION ALL SELECT p_partkey, p_retailprice * 2, 1 FROM part WHERE p_size BETWEEN 5 AND 15)) WHERE rn = 1 ORDER BY score, id LIMIT 25")
def _(spark, d):
    part = table(spark, d, "part")
    one = part.filter("p_size < 10").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"), F.lit(0).alias("list"))
    two = part.filter("p_size BETWEEN 5 AND 15").select("p_partkey", F.col("p_retailprice") * 2, F.lit(1))
    return one.union(two).groupBy("id").agg(F.min_by("score", "list").alias("score")).orderBy("score", "id").limit(25)


@query("tk7_section_sort", "SELECT CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, l_quantity DESC, l_linenumber) AS INT) AS place, l_orderkey, l_linenumber FROM lineitem")
def _(spark, d):
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_returnflag", F.col("l_quantity").desc(), "l_linenumber"))
    return table(spark, d, "lineitem").select(place.alias("place"), "l_orderkey", "l_linenumber")


@query("tk9_detail_downgrade", "SELECT doc_id, CASE WHEN n_chars // 4 <= 500 THEN 'full' WHEN n_chars // 8 <= 500 THEN 'medium' ELSE 'summary' END AS detail FROM documents")
def _(spark, d):
    n = F.col("n_chars")
    return docs(spark, d).select("doc_id", F.when(F.floor(n / 4) <= 500, "full").when(F.floor(n / 8) <= 500, "medium").otherwise("summary").alias("detail"))


# Joins


@query("j8_merge_ranked", "SELECT query_id, coalesce(a.id, b.id) AS id, coalesce(a.r, (SELECT count(*) FROM part WHERE p_size < 10 AND p_partkey % 20 = query_id)) AS dense, coalesce(b.r, (SELECT count(*) FROM part WHERE p_size > 7 AND p_size < 20 AND p_partkey % 20 = query_id)) AS sparse FROM (SELECT p_partkey % 20 AS query_id, p_partkey AS id, row_number() OVER (PARTITION BY p_partkey % 20 ORDER BY p_retailprice DESC, p_partkey) - 1 AS r FROM part WHERE p_size < 10) a FULL JOIN (SELECT p_partkey % 20 AS query_id, p_partkey AS id, row_number() OVER (PARTITION BY p_partkey % 20 ORDER BY p_name, p_partkey) - 1 AS r FROM part WHERE p_size > 7 AND p_size < 20) b USING (query_id, id)")
def _(spark, d):
    """Two ranked lists of each query; a missing rank is the length of its list."""
    part = table(spark, d, "part").withColumn("query_id", F.col("p_partkey") % 20)
    place = lambda *order: (F.row_number().over(W.partitionBy("query_id").orderBy(*order)) - 1).cast("long")
    a = part.filter("p_size < 10").select("query_id", F.col("p_partkey").alias("id"), place(F.col("p_retailprice").desc(), "p_partkey").alias("r1"))
    b = part.filter("p_size > 7 AND p_size < 20").select("query_id", F.col("p_partkey").alias("id"), place("p_name", "p_partkey").alias("r2"))
    none = F.lit(None).cast("long")
    both = a.withColumn("r2", none).unionByName(b.withColumn("r1", none)).groupBy("query_id", "id").agg(F.max("r1").alias("r1"), F.max("r2").alias("r2"))
    by = W.partitionBy("query_id")
    return both.select("query_id", "id", F.coalesce("r1", F.count("r1").over(by)).alias("dense"), F.coalesce("r2", F.count("r2").over(by)).alias("sparse"))


@query("j11_merge_by_name", "SELECT c.c_custkey, s.s_suppkey FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey AND right(c.c_name, 3) = right(s.s_name, 3)")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("kind"), F.right("c_name", F.lit(3)).alias("norm"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("kind"), F.right("s_name", F.lit(3)).alias("norm"))
    return c.join(s, ["kind", "norm"]).select("c_custkey", "s_suppkey")


@query("j14_kg6_entity_in_query", "SELECT conv_id, turn, n_name AS entity, round(length(n_name) / length(text), 6) AS confidence FROM conversations JOIN nation ON contains(lower(text), lower(n_name))")
def _(spark, d):
    """Names of a fixed table of 25 rows within each text."""
    names = F.broadcast(table(spark, d, "nation").select("n_name"))
    found = table(spark, d, "conversations").join(names, F.contains(F.lower("text"), F.lower("n_name")))
    return found.select("conv_id", "turn", F.col("n_name").alias("entity"), r6(F.length("n_name") / F.length("text")).alias("confidence"))


@query("j18_array_membership", "SELECT o_custkey, l_partkey, CAST(count(*) AS BIGINT) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def _(spark, d):
    """Chunks that an entity lists, by exploding the list."""
    members = table(spark, d, "orders").select("o_custkey", F.explode(F.array("o_orderkey")).alias("l_orderkey"))
    return members.join(table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey").groupBy("o_custkey", "l_partkey").agg(F.count("*").alias("n"))


# Retrieval confidence


@query("rc2_agreement", "SELECT l_orderkey, round(CASE WHEN count(*) < 2 THEN 0.5 WHEN stddev_pop(l_quantity) = 0 OR stddev_pop(l_extendedprice) = 0 THEN 1.0 ELSE (corr(l_quantity, l_extendedprice) + 1) / 2 END, 5) AS agreement FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    constant = (F.stddev_pop("l_quantity") == 0) | (F.stddev_pop("l_extendedprice") == 0)
    value = F.when(F.count("*") < 2, 0.5).when(constant, 1.0).otherwise((F.try_divide(F.covar_pop("l_quantity", "l_extendedprice"), F.stddev_pop("l_quantity") * F.stddev_pop("l_extendedprice")) + 1) / 2)
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(value, 5).alias("agreement"))


@query("fm2_citation", "SELECT doc_id, '[' || source || ']' AS inline, source || ', ' || lang || ', p. ' || CAST(doc_id % 9 AS VARCHAR) AS detailed, '[' || CAST(doc_id AS VARCHAR) || '] ' || source AS footnote FROM documents")
def _(spark, d):
    page = (F.col("doc_id") % 9).cast("string")
    return docs(spark, d).select("doc_id", F.concat(F.lit("["), "source", F.lit("]")).alias("inline"), F.concat("source", F.lit(", "), "lang", F.lit(", p. "), page).alias("detailed"), F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("] "), "source").alias("footnote"))


# Hierarchy


TREE = "SELECT 'region:' || CAST(r_regionkey AS VARCHAR) AS id, NULL AS parent FROM region UNION ALL SELECT 'nation:' || CAST(n_nationkey AS VARCHAR), 'region:' || CAST(n_regionkey AS VARCHAR) FROM nation UNION ALL SELECT 'customer:' || CAST(c_custkey AS VARCHAR), 'nation:' || CAST(c_nationkey AS VARCHAR) FROM customer"


def tree(spark, d):
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    one = lambda t, kind, own, above, up: table(spark, d, t).select(key(kind, own).alias("id"), (key(above, up) if above else F.lit(None).cast("string")).alias("parent"))
    return one("region", "region", "r_regionkey", None, None).union(one("nation", "nation", "n_nationkey", "region", "n_regionkey")).union(one("customer", "customer", "c_custkey", "nation", "c_nationkey"))


@query("tr1_children", f"SELECT id FROM ({TREE}) WHERE parent = 'region:1'")
def _(spark, d):
    return tree(spark, d).filter("parent = 'region:1'").select("id")


@query("tr2_tree_counts", f"SELECT t.id, CAST(count(c.id) AS BIGINT) AS children_count, count(c.id) > 0 AS has_children FROM ({TREE}) t LEFT JOIN ({TREE}) c ON c.parent = t.id GROUP BY t.id")
def _(spark, d):
    counted = tree(spark, d).filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("children_count"))
    rows = tree(spark, d).select("id").join(counted, "id", "left").fillna(0, ["children_count"])
    return rows.select("id", "children_count", (F.col("children_count") > 0).alias("has_children"))


@query("tr3_chunk_counts", f"SELECT d.doc_id % 50 AS section, CAST(count(chunk_id) AS BIGINT) AS n FROM documents d LEFT JOIN ({CHUNKS}) c USING (doc_id) GROUP BY 1")
def _(spark, d):
    n = chunks(spark, d).groupBy((F.col("doc_id") % 50).alias("section")).agg(F.count("*").alias("n"))
    return docs(spark, d).select((F.col("doc_id") % 50).alias("section")).distinct().join(n, "section", "left").fillna(0, ["n"])


# Graph, definitions, labels


@query("kg8_centrality_boost", "WITH g AS (SELECT l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_suppkey), c AS (SELECT l_suppkey, n / (SELECT max(n) FROM g) AS c FROM g) SELECT l_orderkey, round(max(l_discount) + 0.15 * max(c), 6) AS score FROM lineitem JOIN c USING (l_suppkey) GROUP BY l_orderkey")
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_discount")
    degree = rows.select("l_orderkey", "l_suppkey").distinct().groupBy("l_suppkey").agg(F.count("*").alias("n"))
    central = degree.join(F.broadcast(degree.agg(F.max("n").alias("most")))).select("l_suppkey", (F.col("n") / F.col("most")).alias("c"))
    return rows.join(central, "l_suppkey").groupBy("l_orderkey").agg(r6(F.max("l_discount") + 0.15 * F.max("c")).alias("score"))


@query("kg10_entity_lookup", "SELECT l_suppkey, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS n_chunks, max(l_quantity) AS confidence FROM lineitem GROUP BY l_suppkey")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("n_chunks"), F.max("l_quantity").alias("confidence"))


@query("ed10_coverage", "SELECT round(avg(n), 6) AS per_entity, round(100.0 * count(*) FILTER (WHERE n > 1) / count(*), 6) AS cross_document FROM (SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_partkey)")
def _(spark, d):
    each = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("n"))
    return each.agg(r6(F.avg("n")).alias("per_entity"), r6(100.0 * F.count_if(F.col("n") > 1) / F.count("*")).alias("cross_document"))


@query("ed9_merge_counts", "SELECT lower(c_mktsegment) AS norm, CAST(count(*) AS BIGINT) AS n, CAST(count(*) - 1 AS BIGINT) AS merged, max(c_acctbal) AS confidence FROM customer GROUP BY 1")
def _(spark, d):
    n = F.count("*")
    return table(spark, d, "customer").groupBy(F.lower("c_mktsegment").alias("norm")).agg(n.alias("n"), (n - 1).alias("merged"), F.max("c_acctbal").alias("confidence"))


@query("tg6_episodes", "SELECT event_type, user_id FROM (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY min(event_id)) AS rn FROM events GROUP BY event_type, user_id) WHERE rn <= 5")
def _(spark, d):
    """Distinct ids in the order of their first appearance, five each."""
    first = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.min("event_id").alias("first"))
    place = F.row_number().over(W.partitionBy("event_type").orderBy("first"))
    return first.withColumn("rn", place).filter("rn <= 5").select("event_type", "user_id")


@query("lb5_all_labels", f"SELECT chunk_id, quality, toxic, source || ' ' || lang AS keywords, content || chr(10) || 'Q: ' || source AS embedding_text FROM ({CHUNKS}) c JOIN documents d USING (doc_id) LEFT JOIN labels l ON l.doc_id = c.doc_id")
def _(spark, d):
    named = chunks(spark, d).join(docs(spark, d).select("doc_id", "source", "lang"), "doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return named.select("chunk_id", "quality", "toxic", F.concat_ws(" ", "source", "lang").alias("keywords"), F.concat("content", F.lit("\nQ: "), "source").alias("embedding_text"))
