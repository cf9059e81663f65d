"""Queries of the graph store over the star schema's graph and a shop's sales (KG1, KG10, KG11, ED9, ED11, ED12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entities as E
from ..operators import graph_store as G
from ..operators import rules as X
from .graphs import EDGES, ENTITIES, edges, entities
from .registry import query, table


@query("kg11_incident_edges", f"SELECT src AS id, 'out' AS side, rel, src, tgt FROM ({EDGES}) WHERE rel <> 'lives_in' UNION ALL SELECT tgt, 'in', rel, src, tgt FROM ({EDGES}) WHERE src <> tgt AND rel <> 'lives_in'")
def _(spark, d):
    """All edges at all nodes, but for those of customers."""
    kept = edges(spark, d).filter("rel <> 'lives_in'")
    return G.incident(kept, entities(spark, d))


@query("kg1_neighbours_of_type", f"SELECT e.id, x.rel, 'in' AS side, x.src AS other FROM ({ENTITIES}) e JOIN ({EDGES}) x ON x.tgt = e.id WHERE e.type = 'nation' AND x.rel = 'based_in' UNION ALL SELECT e.id, x.rel, 'out', x.tgt FROM ({ENTITIES}) e JOIN ({EDGES}) x ON x.src = e.id WHERE e.type = 'nation' AND x.rel = 'based_in'")
def _(spark, d):
    """Suppliers of all nations."""
    all_ = entities(spark, d)
    return G.neighbours(all_, edges(spark, d), G.by_type(all_, "nation"), "based_in")


MENTIONS = "SELECT sale_id AS chunk, vendor_id AS id, round(max(discount), 4) AS confidence FROM sale_lines WHERE vendor_id IS NOT NULL AND sale_id IS NOT NULL GROUP BY ALL"


def mentions(spark, d):
    rows = table(spark, d, "sale_lines").filter("vendor_id IS NOT NULL AND sale_id IS NOT NULL")
    return rows.groupBy(F.col("sale_id").alias("chunk"), F.col("vendor_id").alias("id")).agg(F.round(F.max("discount"), 4).alias("confidence"))


@query("kg10_chunk_entities", f"SELECT chunk, id, confidence, CAST(row_number() OVER (PARTITION BY chunk ORDER BY confidence DESC NULLS LAST, id) AS INT) AS place FROM ({MENTIONS}) WHERE chunk IN (SELECT sale_id FROM sales WHERE status = 'open')")
def _(spark, d):
    """Vendors that open sales name, the surest first."""
    asked = table(spark, d, "sales").filter("status = 'open'").select(F.col("sale_id").alias("chunk"))
    return G.chunk_entities(mentions(spark, d), asked)


SALES = "SELECT sale_id AS chunk, min(status) AS status FROM sales WHERE sale_id IS NOT NULL GROUP BY 1"


@query("kg10_entity_chunks", f"SELECT m.chunk, m.id, confidence, CAST(place AS INT) AS place, status FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY confidence DESC NULLS LAST, chunk) AS place FROM ({MENTIONS}) WHERE chunk IN (SELECT chunk FROM ({SALES})) AND id IN (SELECT vendor_id FROM vendors)) m JOIN ({SALES}) s ON s.chunk = m.chunk WHERE place <= 20")
def _(spark, d):
    """The twenty surest sales of every vendor."""
    chunks = table(spark, d, "sales").filter("sale_id IS NOT NULL").groupBy(F.col("sale_id").alias("chunk")).agg(F.min("status").alias("status"))
    return G.entity_chunks(mentions(spark, d), chunks, table(spark, d, "vendors").select(F.col("vendor_id").alias("id")))


CITY = "SELECT segment AS type, lower(city) AS norm, client_id AS id, city AS value, round(balance, 2) AS confidence, change_id AS moment, valid_at < TIMESTAMP '2024-03-01' AS old FROM client_changes WHERE valid_at IS NOT NULL"


def cities(spark, d):
    """Cities of clients by segment as entities; those of January and February are stored."""
    old = F.col("valid_at") < F.lit("2024-03-01").cast("timestamp_ntz")
    rows = table(spark, d, "client_changes").filter("valid_at IS NOT NULL")
    rows = rows.select(F.col("segment").alias("type"), F.lower("city").alias("norm"), F.col("client_id").alias("id"), F.col("city").alias("value"), F.round("balance", 2).alias("confidence"), F.col("change_id").alias("at"), old.alias("old"))
    return rows.filter("old"), rows.filter("NOT old")


MERGED = f"SELECT type, norm, arg_min(id, (NOT old, moment, id)) AS id, arg_min(value, (NOT old, moment, id)) AS value, max(confidence) AS confidence, arg_max(id, (moment, id)) FILTER (WHERE NOT old) AS last_id, CAST(count(DISTINCT id) - 1 AS BIGINT) AS n_merged, count(*) FILTER (WHERE NOT old) AS rows, bool_and(NOT old) AS added FROM ({CITY}) WHERE type IS NOT NULL AND norm IS NOT NULL GROUP BY ALL"


@query("ed9_nodes_after_batch", f"SELECT type, norm, id, value, confidence, last_id, n_merged FROM ({MERGED})")
def _(spark, d):
    return G.merged_into(*cities(spark, d))[0]


@query("ed9_batch_counts", f"SELECT CAST(count(*) FILTER (WHERE added) AS BIGINT) AS added, CAST(coalesce(sum(rows - CAST(added AS INT)), 0) AS BIGINT) AS merged FROM ({MERGED})")
def _(spark, d):
    return G.merged_into(*cities(spark, d))[1]


@query("ed9_chunk_links", f"SELECT DISTINCT type, norm, moment AS chunk FROM ({CITY}) WHERE moment IS NOT NULL")
def _(spark, d):
    return G.chunk_links(*[x.withColumnRenamed("at", "chunk") for x in cities(spark, d)])


PARTS = "SELECT DISTINCT l_orderkey AS doc_id, 'supplier:' || CAST(l_suppkey AS VARCHAR) AS id FROM lineitem"


@query("ed11_document_edges", f"SELECT DISTINCT doc_id, rel, src, tgt FROM ({PARTS}) p JOIN ({EDGES}) e ON e.src = p.id OR e.tgt = p.id")
def _(spark, d):
    """Each order's suppliers with their edges."""
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("id"))
    return G.document_subgraphs(links, edges(spark, d))[1]


RESOLVED = """SELECT client_id AS id, CASE WHEN email IN (SELECT email FROM clients GROUP BY 1 HAVING count(*) > 1) THEN 'exact' WHEN lower(name) IN (SELECT lower(name) FROM clients GROUP BY 1 HAVING count(*) > 1) THEN 'alias' ELSE 'new' END AS layer FROM clients"""


@query("ed12_dedup_stats", f"""WITH r AS ({RESOLVED}), l AS (SELECT * FROM (VALUES ('exact', 1.0), ('alias', 1.0), ('semantic', 0.9), ('acronym', 0.85)) t(layer, precision)),
n AS (SELECT count(*) AS n, count(*) FILTER (WHERE layer <> 'new') AS m FROM r)
SELECT layer, CAST((SELECT count(*) FROM r WHERE r.layer = l.layer) AS BIGINT) AS matches, coalesce((SELECT count(*) FROM r WHERE r.layer = l.layer) / nullif(n, 0), 0) AS share, CAST(precision AS DOUBLE) AS precision FROM l, n
UNION ALL SELECT 'all', m, coalesce(m / nullif(n, 0), 0), NULL FROM n UNION ALL SELECT 'new', n - m, coalesce((n - m) / nullif(n, 0), 0), NULL FROM n""")
def _(spark, d):
    """Clients that share an address or else a name, by the layer that finds them."""
    rows = table(spark, d, "clients").select(F.col("client_id").alias("id"), "email", F.lower("name").alias("name"))
    twice = lambda key: rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("match"), F.count("*").alias("n")).filter("n > 1")
    found = {layer: rows.join(twice(key), key).select("id", "match") for layer, key in (("exact", "email"), ("alias", "name"))}
    return G.dedup_stats(E.cascade(rows, **found), {"semantic": E.SEMANTIC, "acronym": E.FUZZY})


@query("kg12_orphan_episodes", "SELECT sale_id AS episode, status FROM sales WHERE sale_id IS NULL OR sale_id NOT IN (SELECT sale_id FROM sale_lines WHERE sale_id IS NOT NULL AND quantity > 40)")
def _(spark, d):
    """Sales without a line of more than forty pieces."""
    episodes = table(spark, d, "sales").select(F.col("sale_id").alias("episode"), "status")
    mentions = table(spark, d, "sale_lines").filter("quantity > 40").select(F.col("sale_id").alias("episode"))
    return X.orphan_episodes(episodes, mentions)[1]
