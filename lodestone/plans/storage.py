"""Queries of the chunk store over sections of documents and over a shop's changes (SC5 to SC7, SC9, SC10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import store
from .registry import query, table
from .text import CHUNKS, SECTIONS, chunks, docs, sections

FIELDS = "lang string, source string, n_chars bigint, section_path string"
LAYERED = f"""SELECT CAST(doc_id AS VARCHAR) || '_L1' AS chunk_id, doc_id, 1 AS layer, lang, source, n_chars, NULL AS section_path, NULL AS pos FROM documents
UNION ALL SELECT CAST(doc_id AS VARCHAR) || '_L2_sec_' || CAST(pos + 1 AS VARCHAR), doc_id, 2, NULL, NULL, length(content), 'line ' || CAST(pos AS VARCHAR), pos FROM ({SECTIONS}) WHERE trim(content) <> ''
UNION ALL SELECT chunk_id, doc_id, 3, NULL, NULL, length(content), 'line ' || CAST(pos AS VARCHAR), pos FROM ({CHUNKS})"""


def layers(spark, d):
    """Documents, their lines that are not blank, and their long lines, each with metadata as JSON."""
    path = F.concat(F.lit("line "), F.col("pos").cast("string"))
    own = F.to_json(F.struct(F.length("content").alias("n_chars"), path.alias("section_path")))
    first = docs(spark, d).select(F.concat(F.col("doc_id").cast("string"), F.lit("_L1")).alias("chunk_id"), "doc_id", F.to_json(F.struct("lang", "source", "n_chars")).alias("metadata"))
    second = sections(spark, d).filter("trim(content) <> ''").select(F.concat(F.col("doc_id").cast("string"), F.lit("_L2_sec_"), (F.col("pos") + 1).cast("string")).alias("chunk_id"), "doc_id", "pos", own.alias("metadata"))
    third = chunks(spark, d).select("chunk_id", "doc_id", "pos", own.alias("metadata"))
    return {1: first, 2: second, 3: third}


@query("sc5_flattened_layers", LAYERED)
def _(spark, d):
    return store.layer_scan(layers(spark, d), FIELDS)


SEEN = "SELECT client_id AS key, max(change_id) AS change_id FROM client_changes WHERE valid_at < TIMESTAMP '2024-02-01' GROUP BY 1"


@query(
    "sc6_insert_or_nothing",
    f"""WITH seen AS ({SEEN}), new AS (SELECT client_id AS key, change_id, source, seq FROM client_changes WHERE valid_at >= TIMESTAMP '2024-02-01'),
fresh AS (SELECT DISTINCT key, change_id, source FROM new WHERE key NOT IN (SELECT key FROM seen WHERE key IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq, change_id, source NULLS FIRST) = 1)
SELECT key, change_id, 'stored' AS origin FROM seen UNION ALL SELECT key, change_id, 'added' FROM fresh""",
)
def _(spark, d):
    """Clients with a change in January are stored; of the others the first later change is added."""
    rows = table(spark, d, "client_changes").withColumnRenamed("client_id", "key")
    since = F.lit("2024-02-01").cast("timestamp_ntz")
    seen = rows.filter(F.col("valid_at") < since).groupBy("key").agg(F.max("change_id").alias("change_id"))
    new = rows.filter(F.col("valid_at") >= since).select("key", "change_id", "source", "seq")
    added = store.unseen(seen, new, "key", "seq", "change_id", "source")
    mark = lambda x, name: x.select("key", "change_id", F.lit(name).alias("origin"))
    return mark(seen, "stored").union(mark(added, "added"))


@query(
    "sc7_registry_after_changes",
    """WITH last AS (SELECT * FROM client_changes QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY seq DESC, change_id DESC) = 1)
SELECT coalesce(c.client_id, l.client_id) AS client_id, c.name, c.nation_id,
       CASE WHEN l.client_id IS NULL THEN c.source ELSE l.source END AS source, CASE WHEN l.client_id IS NULL THEN c.segment ELSE l.segment END AS segment,
       CASE WHEN l.client_id IS NULL THEN c.city ELSE l.city END AS city, CASE WHEN l.client_id IS NULL THEN c.balance ELSE l.balance END AS balance, l.client_id IS NOT NULL AS changed
FROM clients c FULL JOIN last l ON l.client_id = c.client_id WHERE l.op IS NULL OR l.op <> 'D'""",
)
def _(spark, d):
    """Clients after all changes in the order of their sequence numbers; a last change that deletes takes the client away."""
    registry = table(spark, d, "clients").select("client_id", "name", "nation_id", "source", "segment", "city", "balance")
    return store.upserted(registry, table(spark, d, "client_changes"), "client_id", "seq", "change_id", deleted=F.col("op") == "D", touched="changed")


TOXIC = "SELECT doc_id FROM labels WHERE toxic = 1"


@query("sc9_deletion_report", " UNION ALL ".join(f"SELECT '{n}' AS table_name, CAST(count(*) FILTER (WHERE g) AS BIGINT) AS deleted, CAST(count(*) FILTER (WHERE NOT g) AS BIGINT) AS kept, CAST(count(DISTINCT doc_id) FILTER (WHERE NOT g) AS BIGINT) AS documents FROM (SELECT doc_id, doc_id IN ({TOXIC}) AS g FROM {s})" for n, s in (("layer1", "documents"), ("layer2", f"({SECTIONS}) WHERE trim(content) <> ''"), ("layer3", f"({CHUNKS})"), ("registry", "documents"), ("labels", "labels"))))
def _(spark, d):
    """Documents that are labelled toxic go from all layers, the registry and the labels."""
    labels = table(spark, d, "labels")
    tables = {f"layer{k}": x.select("doc_id") for k, x in layers(spark, d).items()} | {"registry": docs(spark, d).select("doc_id"), "labels": labels.select("doc_id")}
    return store.deletion_report(tables, labels.filter("toxic = 1"))


@query("sc9_chunks_left", f"SELECT chunk_id, doc_id FROM ({CHUNKS}) WHERE doc_id NOT IN ({TOXIC})")
def _(spark, d):
    left = store.without_documents({"layer3": chunks(spark, d)}, table(spark, d, "labels").filter("toxic = 1"))
    return left["layer3"].select("chunk_id", "doc_id")


@query(
    "sc10_index_issues",
    f"""WITH e AS (SELECT doc_id, count(*) AS n, max(pos // 20 + 1) AS page FROM ({SECTIONS}) WHERE trim(content) <> '' GROUP BY 1),
s AS (SELECT doc_id, count(*) AS n, max(CASE WHEN length(content) % 11 > 0 THEN pos // 20 + 1 END) AS page, count(*) FILTER (WHERE length(content) % 11 = 0) AS none FROM ({CHUNKS}) GROUP BY 1),
b AS (SELECT coalesce(e.doc_id, s.doc_id) AS doc_id, coalesce(e.n, 0) AS expected, coalesce(s.n, 0) AS stored, coalesce(none, 0) AS null_pages, e.page AS page, coalesce(s.page, 0) AS stored_page FROM e FULL JOIN s ON s.doc_id = e.doc_id)
SELECT doc_id, CAST(expected AS BIGINT) AS expected, CAST(stored AS BIGINT) AS stored, CAST(null_pages AS BIGINT) AS null_pages,
       list_filter([CASE WHEN expected <> stored THEN 'count: expected ' || expected || ', got ' || stored END, CASE WHEN page IS NOT NULL AND page <> stored_page THEN 'last page: expected ' || page || ', got ' || stored_page END,
                    CASE WHEN null_pages > 0 THEN 'without a page: ' || null_pages END], lambda x: x IS NOT NULL) AS issues, expected = stored AS passed FROM b""",
)
def _(spark, d):
    """Lines that are not blank are expected; stored are the long ones, some without a page."""
    page = (F.floor(F.col("pos") / 20) + 1).alias("page")
    expected = sections(spark, d).filter("trim(content) <> ''").select("doc_id", page)
    stored = chunks(spark, d).select("doc_id", F.when(F.length("content") % 11 > 0, F.floor(F.col("pos") / 20) + 1).alias("page"))
    return store.index_issues(expected, stored)
