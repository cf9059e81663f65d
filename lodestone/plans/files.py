"""Sources, sinks and stateful operators over the driver's tables (SC*, SS*, CV2)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources import graph_files, markup, stages
from ..streaming import limits, tables
from .graphs import EDGES, ENTITIES, edges, entities
from .registry import query, table
from .text import SECTIONS, docs, sections


@query("sc2_html_elements")
def _(spark, d):
    return markup.elements(table(spark, d, "pages").withColumnRenamed("page_id", "doc_id"), markup.html_elements(F.col("html")))


@query("sc2_text_elements", r"WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n+'), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents), e AS (SELECT doc_id, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS pos FROM s) SELECT doc_id, CAST(pos AS INT) AS pos, CASE WHEN regexp_matches(text, '^([-*•]|\d+[.)])\s') THEN 'ListItem' WHEN length(text) <= 60 AND NOT regexp_matches(text, '[.!?:;,]$') THEN 'Title' ELSE 'NarrativeText' END AS category, text FROM e")
def _(spark, d):
    return markup.elements(docs(spark, d), markup.plain_elements(F.col("text")))


LATEX = f"SELECT doc_id, pos, content, CASE WHEN pos % 5 = 0 THEN pos % 4 END AS level FROM ({SECTIONS})"


@query("sc3_latex_sections", rf"WITH l AS ({LATEX}), b AS (SELECT *, CASE WHEN level IS NULL THEN content ELSE '\' || ['chapter', 'section', 'subsection', 'subsubsection'][level + 1] || '{{T' || pos || '}}' END AS body, max(pos) FILTER (WHERE level IS NOT NULL) OVER (PARTITION BY doc_id ORDER BY pos) AS head FROM l), o AS (SELECT *, coalesce(sum(length(body) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM b) SELECT doc_id, head AS line, max(level) AS level, ['chapter', 'section', 'subsection', 'subsubsection'][max(level) + 1] AS type, 'T' || head AS title, coalesce(trim(regexp_replace(replace(string_agg(content, chr(10) ORDER BY pos) FILTER (WHERE pos > head), '~', ' '), '\s+', ' ', 'g')), '') AS content, CAST(max(start) FILTER (WHERE pos = head) AS BIGINT) AS char_start FROM o GROUP BY doc_id, head")
def _(spark, d):
    """Lines of documents with a LaTeX heading in place of every fifth."""
    name = F.element_at(F.array(*[F.lit(x) for x in markup.SECTIONS]), (F.col("pos") % 4 + 1).cast("int"))
    body = F.when(F.col("pos") % 5 == 0, F.concat(F.lit("\\"), name, F.lit("{T"), F.col("pos").cast("string"), F.lit("}"))).otherwise(F.col("content"))
    lines = sections(spark, d).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", body.alias("b")))), lambda x: x["b"]), "\n").alias("text"))
    return markup.latex_sections(lines)


@query("sc4_completed_stages", "WITH f AS (SELECT o_orderkey AS folder, unnest([1, 2, 3]) AS stage, o_orderkey % 5 AS k, o_orderkey % 7 AS b FROM orders), g AS (SELECT folder, stage, NOT (b = stage) AS ok FROM f WHERE NOT (k = stage)), h AS (SELECT folder, min(stage) FILTER (WHERE NOT ok) AS bad, list_sort(list(stage) FILTER (WHERE ok)) AS good FROM g GROUP BY folder), w AS (SELECT *, CASE WHEN good IS NULL OR good[1] <> 1 THEN 0 WHEN len(good) < 2 OR good[2] <> 2 THEN 1 WHEN len(good) < 3 THEN 2 ELSE 3 END AS whole FROM h) SELECT CAST(folder AS VARCHAR) AS folder, CASE WHEN bad IS NULL THEN whole ELSE least(bad - 1, whole) END AS completed, bad IS NULL AND coalesce(list_max(good), 0) <= whole AS is_valid, CASE WHEN bad IS NOT NULL THEN 'stage ' || bad || ' file corrupted' WHEN coalesce(list_max(good), 0) > whole THEN 'incomplete sequence' END AS error FROM w")
def _(spark, d):
    """Three files an order, of which one may be missing and one lack a field."""
    files = table(spark, d, "orders").select("o_orderkey", F.explode(F.array(*[F.lit(k) for k in stages.STAGES])).alias("stage"))
    fields = F.coalesce(*[F.when(F.col("stage") == k, F.lit("{" + ", ".join(f'"{x}": null' for x in names) + "}")) for k, names in stages.FIELDS.items()])
    files = files.filter("o_orderkey % 5 <> stage")
    body = F.when(F.col("o_orderkey") % 7 == F.col("stage"), F.lit('{"document_id": 1}')).otherwise(fields)
    return stages.completed(files.select(F.col("o_orderkey").cast("string").alias("folder"), "stage", body.alias("body")))


@query("sc11_gexf", f"SELECT line FROM (SELECT '<node id=\"' || id || '\" label=\"' || replace(value, '&', '&amp;') || '\" type=\"' || type || '\"/>' AS line FROM ({ENTITIES}) UNION ALL SELECT '<edge source=\"' || src || '\" target=\"' || tgt || '\" label=\"' || rel || '\"/>' FROM ({EDGES}))")
def _(spark, d):
    return graph_files.xml_lines(entities(spark, d), edges(spark, d), "gexf").filter("part IN (1, 3)").select("line")


@query("sc13_import_edges", f"SELECT DISTINCT src, tgt, rel FROM ({EDGES})")
def _(spark, d):
    e = edges(spark, d)
    return graph_files.to_import(e.unionByName(e.filter("rel = 'lives_in'"))).select("src", "tgt", "rel")


@query("sc16_repaired_json")
def _(spark, d):
    whole = F.to_json(F.struct("doc_id", "lang", "text"))
    broken = F.when(F.col("doc_id") % 4 == 0, whole).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("Here: "), F.substring(whole, F.lit(1), F.length(whole) - 1), F.lit(",}"))).otherwise(F.concat(F.lit("["), whole, F.lit(", "), F.substring(whole, 1, 20)))
    return docs(spark, d).select("doc_id", markup.repaired_json(broken).alias("json"))


@query("sc17_report", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(avg(value), 4) AS value_mean, round(stddev_pop(value), 4) AS value_std FROM events GROUP BY event_type")
def _(spark, d):
    return stages.report(table(spark, d, "events"), ["value"], "event_type").drop("json", "markdown")


STORED = "SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey AS chunk_id, CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE l_suppkey % 5 END AS page, l_suppkey % 7 AS given FROM lineitem"


def stored(spark, d):
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")])
    return table(spark, d, "lineitem").select(key.alias("chunk_id"), F.when(F.col("l_suppkey") % 9 != 0, F.col("l_suppkey") % 5).alias("page"), (F.col("l_suppkey") % 7).alias("given")).groupBy("chunk_id").agg(F.min("page").alias("page"), F.min("given").alias("given"))


@query("sc18_page_updates", f"SELECT chunk_id, page AS old_page, given AS new_page FROM (SELECT chunk_id, min(page) AS page, min(given) AS given FROM ({STORED}) GROUP BY chunk_id) WHERE given <> 6 AND (page IS NULL OR page <> given)")
def _(spark, d):
    rows = stored(spark, d)
    return stages.reconciled(rows.select("chunk_id", "page"), rows.filter("given <> 6").select("chunk_id", F.col("given").alias("page")))[1]


@query("sc18_page_counts", f"SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE page = 0) AS BIGINT) AS zero_pages, CAST(count(*) FILTER (WHERE page IS NULL) AS BIGINT) AS null_pages FROM (SELECT chunk_id, min(page) AS page FROM ({STORED}) GROUP BY chunk_id)")
def _(spark, d):
    rows = stored(spark, d)
    return stages.reconciled(rows.select("chunk_id", "page"), rows.select("chunk_id", F.col("given").alias("page")))[0]


@query("sc20_model_documents", "SELECT conv_id AS doc_id, CAST(turn - first AS INT) AS pos, CASE WHEN turn % 3 = 0 THEN '' ELSE role END AS title, CASE WHEN turn % 4 = 0 THEN 1 ELSE CAST(turn % 4 AS INT) END AS level, text AS content FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, turn - (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS first FROM conversations)")
def _(spark, d):
    """Answers of a model: a section a turn, some without title, level or page."""
    one = F.struct("turn", F.when(F.col("turn") % 3 != 0, F.col("role")).alias("title"), F.when(F.col("turn") % 4 != 0, F.col("turn") % 4).alias("level"), F.when(F.col("turn") % 2 == 0, F.col("turn")).alias("page"), F.col("text").alias("content"))
    answers = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(one)).alias("sections"))).alias("answer"))
    return stages.from_model(answers).select("doc_id", "pos", "title", "level", "content")


@query("sc21_merged_index", "SELECT event_type AS document, event_id AS at FROM events UNION ALL SELECT event_type, event_id + (SELECT count(*) FROM events) FROM events WHERE event_id % 10 = 0")
def _(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("document"), F.col("event_id").alias("at"))
    return stages.merged_index(rows, rows.filter("at % 10 = 0"))


def log(spark, d, value="value"):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").cast("double").alias("at"), F.expr(value).cast("double").alias("value"))


EVENTS = "SELECT user_id AS key, event_id AS id, epoch_us(ts) / 1e6 AS moment, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events"


@query("ss2_token_bucket", f"WITH RECURSIVE e AS MATERIALIZED ({EVENTS}), b(key, id, n, moment, tokens, passed) AS (SELECT key, id, n, moment, 1.0::DOUBLE, true FROM e WHERE n = 1 UNION ALL SELECT e.key, e.id, e.n, e.moment, least(2.0, b.tokens + (e.moment - b.moment) / 3600) - CASE WHEN least(2.0, b.tokens + (e.moment - b.moment) / 3600) >= 1 THEN 1 ELSE 0 END, least(2.0, b.tokens + (e.moment - b.moment) / 3600) >= 1 FROM b JOIN e ON e.key = b.key AND e.n = b.n + 1) SELECT key, id, passed FROM b")
def _(spark, d):
    """Two requests at once, then one an hour, for each user."""
    return limits.replay(log(spark, d), lambda: limits.TokenBucket(2.0, 1 / 3600)).select("key", "id", "passed")


@query("cv2_ss6_spending", f"WITH RECURSIVE e AS MATERIALIZED ({EVENTS}), b(key, id, n, spent, passed) AS (SELECT key, id, n, CASE WHEN value <= 500 THEN value ELSE 0 END, value <= 500 FROM e WHERE n = 1 UNION ALL SELECT e.key, e.id, e.n, b.spent + CASE WHEN b.spent + e.value <= 500 THEN e.value ELSE 0 END, b.spent + e.value <= 500 FROM b JOIN e ON e.key = b.key AND e.n = b.n + 1) SELECT key, id, passed FROM b")
def _(spark, d):
    return limits.replay(log(spark, d), lambda: limits.Spending(500.0)).select("key", "id", "passed")


@query("ss3_ttl_cache")
def _(spark, d):
    return limits.replay(log(spark, d, "event_id % 13"), lambda: limits.TtlCache(6 * 3600.0, 5)).select("key", "id", "passed")


@query("ss4_lru_cache")
def _(spark, d):
    return limits.replay(log(spark, d, "event_id % 13"), lambda: limits.LruCache(5)).groupBy("key").agg(F.round(F.avg(F.col("passed").cast("double")), 6).alias("hit_rate"))


@query("ss1_bounded_queue", "SELECT event_id AS id, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY event_id) <= 5 AS accepted FROM events")
def _(spark, d):
    """Events of an hour come at once; five fit."""
    hour = F.date_trunc("hour", "ts")
    return tables.drained(table(spark, d, "events").select(F.col("event_id").alias("id"), hour.alias("at")), 5).select("id", "accepted")


@query("ss5_latest_and_purge", "SELECT user_id AS thread, arg_max(event_id, (ts, event_id)) AS id FROM events GROUP BY user_id HAVING max(ts) >= TIMESTAMP '2024-01-25'")
def _(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("thread"), F.col("event_id").alias("id"), "ts")
    return tables.latest(rows, F.col("ts"), F.lit("2024-01-25").cast("timestamp")).select("thread", "id")


@query("ss7_unseen_rows", "SELECT event_id FROM events WHERE event_id % 3 <> 0")
def _(spark, d):
    """The rows that a table of every third one lacks."""
    rows = table(spark, d, "events").select("event_id")
    order = W.partitionBy("event_id").orderBy("event_id")
    new = rows.unionByName(rows).withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")
    return new.join(rows.filter("event_id % 3 = 0"), "event_id", "left_anti")
