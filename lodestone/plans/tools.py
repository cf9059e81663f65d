"""Queries of the tools over vectors, documents and their lines, a shop's sales and the star schema's graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tools
from ..operators import hierarchy
from .documents import TREE, tree
from .graphs import EDGES, ENTITIES, edges, entities
from .registry import query, table
from .retrieval import COS, DENSE, RANK, SIGNALS, _first, _mm, asked, items
from .text import CHUNKS, chunks, docs

SOURCES = "SELECT coalesce(d.doc_id, e.vec_id) AS id, coalesce(d.source, 'none') AS document_id, d.lang AS section_path, CASE WHEN coalesce(d.doc_id, e.vec_id) % 2 = 1 THEN coalesce(d.source, 'none') || ' > Untitled' END AS path, coalesce(d.doc_id, e.vec_id) % 9 AS page, e.label FROM documents d FULL JOIN embeddings e ON e.vec_id = d.doc_id"
CRUMB = "CASE WHEN path IS NOT NULL THEN replace(path, ' > Untitled', CASE WHEN page <> 0 THEN ' (page ' || page || ')' ELSE '' END) WHEN section_path IS NOT NULL THEN document_id || ' > ' || section_path ELSE document_id END"


def library(spark, d):
    """Documents and vectors of one id as a chunk; every second one has a path to an untitled part."""
    both = docs(spark, d).withColumnRenamed("doc_id", "id").join(items(spark, d), "id", "full")
    source = F.coalesce("source", F.lit("none"))
    path = F.when(F.col("id") % 2 == 1, F.concat(source, F.lit(" > Untitled")))
    return both.select("id", "vector", "text", "label", source.alias("document_id"), path.alias("hierarchical_path"), F.col("lang").alias("section_path"), F.lit(None).cast("string").alias("section_title"), (F.col("id") % 9).alias("page_number"))


def questions(spark, d):
    """Every vector whose id is divisible by 100 as a question, the three after it as its other signals, a benchmark text as its words."""
    own = items(spark, d)
    shifted = lambda k, name: own.select((F.col("id") - k).alias("query_id"), F.col("vector").alias(name))
    words = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    out = own.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("orig"))
    for k, name in enumerate(("hyde", "exp0", "exp1"), 1):
        out = out.join(shifted(k, name), "query_id", "left")
    return out.join(words, "query_id", "left")


#: The questions' first signal has ten times 40 candidates of each list.
DEEP = SIGNALS.replace("rank < 200", "rank < 400")


@query("tool_search", DEEP + f", f AS (SELECT query_id, id, round(0.5 * {_mm('orig')} + 0.25 * {_mm('hyde')} + 0.25 * ({_mm('exp0')} + {_mm('exp1')}) / 2, 6) AS score FROM merged WINDOW w AS (PARTITION BY query_id)), t AS (SELECT *, {RANK} AS rank FROM f), l AS ({SOURCES}) SELECT query_id, id, score AS fused, CAST(rank AS INT) AS rank, document_id, {CRUMB} AS breadcrumb, '[' || (rank + 1) || '] ' || {CRUMB} AS citation FROM t JOIN l USING (id) WHERE rank < 10")
def _(spark, d):
    return tools.search(questions(spark, d), library(spark, d))


def _near(step, k):
    return _first(f"SELECT q.vec_id - {step} AS query_id, e.vec_id AS id, {COS.format('q.embedding', 'e.embedding')} AS score FROM (SELECT * FROM embeddings WHERE (vec_id - {step}) % 100 = 0) q, embeddings e WHERE e.label % 4 >= 2", k)


@query(
    "tool_section_search",
    f"""WITH hyde AS ({_near(1, 20)}), exp0 AS ({_near(2, 20)}), exp1 AS ({_near(3, 20)}), ids AS (SELECT query_id, id FROM hyde UNION SELECT query_id, id FROM exp0 UNION SELECT query_id, id FROM exp1),
merged AS (SELECT i.query_id, i.id, h.score AS hyde, a.score AS exp0, b.score AS exp1 FROM ids i LEFT JOIN hyde h USING (query_id, id) LEFT JOIN exp0 a USING (query_id, id) LEFT JOIN exp1 b USING (query_id, id) WHERE i.query_id IN (SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0)),
f AS (SELECT query_id, id, round(0.5 * {_mm('hyde')} + 0.25 * {_mm('exp0')} + 0.25 * {_mm('exp1')}, 6) AS score FROM merged WINDOW w AS (PARTITION BY query_id)), t AS (SELECT *, {RANK} AS rank FROM f), l AS ({SOURCES}),
c AS (SELECT doc_id, count(*) AS n FROM ({CHUNKS}) GROUP BY 1)
SELECT query_id, id, score AS fused, CAST(rank AS INT) AS rank, label % 4 AS section_level, '[' || (rank + 1) || '] ' || {CRUMB} AS citation, CAST(coalesce(n, 0) AS BIGINT) AS chunk_count FROM t JOIN l USING (id) LEFT JOIN c ON c.doc_id = t.id WHERE rank < 5""",
)
def _(spark, d):
    """Vectors as sections of level 2 and 3, with the long lines of the document of their id as chunks."""
    own = library(spark, d)
    sections = own.filter("vector IS NOT NULL").withColumns({"section_id": F.col("id"), "section_level": F.col("label") % 4})
    lines = chunks(spark, d).join(own.select(F.col("id").alias("doc_id"), "document_id"), "doc_id").select("document_id", F.col("doc_id").alias("section_id"))
    return tools.section_search(questions(spark, d), sections, lines, least=2).select("query_id", "id", "fused", "rank", "section_level", "citation", "chunk_count")


def lines(spark, d):
    return chunks(spark, d).select(F.col("chunk_id").alias("id"), F.col("doc_id").alias("document_id"), F.floor(F.col("pos") / 20).alias("section_id"))


def targets(spark, d):
    return chunks(spark, d).filter("doc_id % 100 = 0").select(F.col("chunk_id").alias("id"))


@query("tool_context_adjacent", f"WITH c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place FROM ({CHUNKS})) SELECT t.chunk_id AS target, c.chunk_id AS id, CAST(abs(c.place - t.place) - 1 AS INT) AS rank, CASE WHEN c.place < t.place THEN 'before' ELSE 'after' END AS side FROM c t JOIN c ON c.doc_id = t.doc_id AND abs(c.place - t.place) BETWEEN 1 AND 3 WHERE t.doc_id % 100 = 0")
def _(spark, d):
    """Three lines before and after every line of every hundredth document."""
    return tools.expand_context(targets(spark, d), lines(spark, d), "adjacent")


@query("tool_context_section", f"SELECT target, id, CAST(rank AS INT) AS rank, NULL AS side FROM (SELECT t.chunk_id AS target, c.chunk_id AS id, row_number() OVER (PARTITION BY t.chunk_id ORDER BY c.chunk_id) - 1 AS rank FROM ({CHUNKS}) t JOIN ({CHUNKS}) c ON c.doc_id = t.doc_id AND c.pos // 20 = t.pos // 20 AND c.chunk_id <> t.chunk_id WHERE t.doc_id % 100 = 0) WHERE rank < 3")
def _(spark, d):
    return tools.expand_context(targets(spark, d), lines(spark, d), "section")


@query(
    "tool_context_hybrid",
    f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY e.vec_id) - 1 AS rank FROM embeddings q JOIN embeddings e ON e.label = q.label AND e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
n AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM ({DENSE}) WHERE id <> query_id),
b AS (SELECT query_id, id, min((list, rank)) AS at FROM (SELECT query_id, id, 0 AS list, rank FROM s WHERE rank < 3 UNION ALL SELECT query_id, id, 1, rank FROM n WHERE rank < 3) GROUP BY ALL)
SELECT query_id AS target, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY b.at, id) - 1 AS INT) AS rank, NULL AS side FROM b""".replace("AS at,", "AS place,").replace("min((list, rank)) AS at FROM", "min((list, rank)) AS place FROM").replace("b.at", "place"),
)
def _(spark, d):
    """Three vectors of the same label and the three nearest, each once."""
    own = items(spark, d).select("id", "vector", F.lit("all").alias("document_id"), F.col("label").alias("section_id"))
    return tools.expand_context(own.filter("id % 100 = 0"), own, "hybrid", 6)


PLACED = f"RECURSIVE t AS ({TREE}), p(id, path, depth) AS (SELECT id, id, 1 FROM t WHERE parent IS NULL UNION ALL SELECT t.id, p.path || ' > ' || t.id, p.depth + 1 FROM t JOIN p ON t.parent = p.id), s AS (SELECT id, path, depth AS level, CAST(split_part(id, ':', 2) AS INT) % 7 AS page FROM p)"


@query(
    "tool_browse_sections",
    f"""WITH {PLACED}, k AS (SELECT s.id, count(c.id) AS n FROM s LEFT JOIN s c ON starts_with(c.path, s.path || ' > ') AND c.level = s.level + 1 GROUP BY s.id),
m AS (SELECT 'customer:' || CAST(o_custkey AS VARCHAR) AS id, count(*) AS n FROM orders GROUP BY 1),
one AS (SELECT CAST(NULL AS VARCHAR) AS root, CAST(NULL AS VARCHAR) AS above, 1 AS depth, s.* FROM s WHERE level = 1 UNION ALL SELECT a.path, a.path, 1, s.* FROM s a JOIN s ON starts_with(s.path, a.path || ' > ') AND s.level = a.level + 1 WHERE a.level = 2),
every AS (SELECT * FROM one UNION ALL SELECT o.root, o.path, 2, s.* FROM one o JOIN s ON starts_with(s.path, o.path || ' > ') AND s.level = o.level + 1)
SELECT root, above, depth, e.id AS section_id, path, level, page, CAST(k.n AS BIGINT) AS children_count, k.n > 0 AS has_children, CAST(coalesce(m.n, 0) AS BIGINT) AS chunk_count, CAST(row_number() OVER (PARTITION BY root, above, depth ORDER BY coalesce(m.n, 0) DESC, e.id) AS INT) AS place FROM every e JOIN k ON k.id = e.id LEFT JOIN m ON m.id = e.id""",
)
def _(spark, d):
    """Two levels below the top and below every nation, by size; orders are their customers' chunks."""
    page = F.split_part("id", F.lit(":"), F.lit(2)).cast("int") % 7
    sections = hierarchy.paths(tree(spark, d)).select(F.lit("all").alias("doc_id"), F.col("id").alias("section_id"), "path", (F.col("depth") + 1).alias("level"), page.alias("page"))
    orders = table(spark, d, "orders").select(F.lit("all").alias("doc_id"), F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("section_id"))
    asked_ = sections.filter("level = 2").select("doc_id", F.col("path").alias("parent"))
    asked_ = asked_.union(asked_.limit(1).select("doc_id", F.lit(None).cast("string")))
    return tools.browse_sections(sections, orders, asked_, 2, "size").drop("doc_id")


@query("tool_browse_entities", f"SELECT CAST(row_number() OVER (ORDER BY confidence DESC, id) AS INT) AS place, id, type, value, round(confidence, 3) AS confidence, CAST((SELECT count(*) FROM lineitem WHERE 'part:' || l_partkey = id) AS BIGINT) AS mentions FROM (SELECT * FROM ({ENTITIES}) WHERE type = 'part' AND contains(lower(value), 'e') AND confidence >= 0.6 ORDER BY confidence DESC, id LIMIT 20)")
def _(spark, d):
    """The twenty surest parts with an e in their name."""
    mentions = table(spark, d, "lineitem").select(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("id"))
    return tools.browse_entities(entities(spark, d), mentions, "part", "E", 0.6)


INSIDE = f"SELECT s.*, e.label AS cluster FROM ({DENSE}) s JOIN embeddings e ON e.vec_id = s.id"


@query("tool_cluster_search", f"SELECT query_id, id, cluster, score, CAST(rank AS INT) AS rank FROM (SELECT *, {RANK} AS rank FROM ({INSIDE}) WHERE cluster IN (1, 3, 5)) WHERE rank < 10")
def _(spark, d):
    return tools.cluster_search(asked(spark, d), items(spark, d).withColumnRenamed("label", "cluster"), 10, [1, 3, 5])


@query("tool_cluster_distribution", f"SELECT query_id, cluster, count(*) AS n FROM (SELECT *, {RANK} AS rank FROM ({INSIDE})) WHERE rank < 10 GROUP BY ALL")
def _(spark, d):
    return tools.cluster_distribution(tools.cluster_search(asked(spark, d), items(spark, d).withColumnRenamed("label", "cluster")))


ASKED = "SELECT vec_id AS query_id, CAST(unnest(range(1, 2 + vec_id // 100)) AS INT) AS document_id FROM embeddings WHERE vec_id % 100 = 0"


@query(
    "tool_across_documents",
    f"""WITH a AS ({ASKED}), n AS (SELECT vec_id AS query_id, (SELECT count(*) FROM a WHERE a.query_id = vec_id) AS n FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT x.*, row_number() OVER (PARTITION BY x.query_id, cluster ORDER BY score DESC, id) - 1 AS rank FROM ({INSIDE}) x JOIN a ON a.query_id = x.query_id AND a.document_id = x.cluster JOIN n ON n.query_id = x.query_id WHERE n BETWEEN 2 AND 10)
SELECT query_id, cluster AS document_id, id, score, CAST(rank AS INT) AS rank, NULL AS error FROM s WHERE rank < 5 UNION ALL SELECT query_id, NULL, NULL, NULL, NULL, CASE WHEN n < 2 THEN 'fewer than 2 documents' ELSE 'more than 10 documents' END FROM n WHERE n NOT BETWEEN 2 AND 10""",
)
def _(spark, d):
    """Labels as documents; the first query names one, each next one more."""
    own = asked(spark, d)
    named = own.select("query_id", F.explode(F.sequence(F.lit(1), F.floor(F.col("query_id") / 100).cast("int") + 1)).alias("document_id"))
    return tools.across_documents(own, items(spark, d).withColumnRenamed("label", "document_id"), named)


@query("tool_corpus_stats", f"""SELECT 'documents' AS scope, 'all' AS name, CAST(count(DISTINCT doc_id) AS BIGINT) AS n FROM documents UNION ALL SELECT 'chunks', 'layer 1', count(*) FROM documents UNION ALL SELECT 'chunks', 'layer 3', count(*) FROM ({CHUNKS})
UNION ALL SELECT 'entities', 'all', count(*) FROM ({ENTITIES}) UNION ALL SELECT 'entity types', type, count(*) FROM ({ENTITIES}) GROUP BY type UNION ALL SELECT 'edges', 'all', count(*) FROM ({EDGES}) UNION ALL SELECT 'edge types', rel, count(*) FROM ({EDGES}) GROUP BY rel""")
def _(spark, d):
    layers = {1: docs(spark, d).select(F.col("doc_id").alias("document_id")), 3: chunks(spark, d).select(F.col("doc_id").alias("document_id"))}
    return tools.corpus_stats(layers, entities(spark, d), edges(spark, d))


@query("fm2_citation_styles", f"SELECT id, '[' || (id % 10 + 1) || '] ' || crumb AS inline, '[' || (id % 10 + 1) || '] ' || crumb || CASE WHEN page <> 0 THEN ' (Page ' || page || ')' ELSE '' END AS detailed, '[' || (id % 10 + 1) || '] ' || crumb || CASE WHEN page <> 0 THEN ', p. ' || page ELSE '' END AS footnote FROM (SELECT *, {CRUMB} AS crumb FROM ({SOURCES}))")
def _(spark, d):
    rows = library(spark, d).withColumn("crumb", tools.where_from(*[F.col(c) for c in tools.SOURCE]))
    cite = [tools.citation(F.col("id") % 10 + 1, F.col("crumb"), F.col("page_number"), style).alias(style) for style in tools.STYLES]
    return rows.select("id", *cite)
