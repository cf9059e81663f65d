"""Queries of filters, reducers and graph rules (PF*, JS1, RD1, RT1, FM1, AG5, KG*, ED*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import entities as E
from ..operators import rules as X
from .graphs import EDGES, ENTITIES, edges, entities
from .registry import query, table
from .text import CHUNKS, SECTIONS, chunks, docs, sections

META = "SELECT doc_id, lang AS category, [source, 'k' || (doc_id % 5), 'k' || (doc_id % 7)] AS keywords, ['e' || (doc_id % 3)] AS entities, ['ORG', CASE WHEN doc_id % 2 = 0 THEN 'LAW' ELSE 'TOPIC' END] AS entity_types, round(n_chars % 100 / 100, 2) AS conf FROM documents"


def described(spark, d):
    """Documents with their labels as JSON."""
    k = F.col("doc_id")
    name = lambda p, n: F.concat(F.lit(p), (k % n).cast("string"))
    meta = F.struct(F.col("lang").alias("category"), F.array("source", name("k", 5), name("k", 7)).alias("keywords"), F.array(name("e", 3)).alias("entities"), F.array(F.lit("ORG"), F.when(k % 2 == 0, "LAW").otherwise("TOPIC")).alias("entity_types"), F.round(F.col("n_chars") % 100 / 100, 2).alias("category_confidence"))
    return docs(spark, d).select("doc_id", F.to_json(meta).alias("metadata"))


@query("pf1_metadata_filter", f"SELECT doc_id FROM ({META}) WHERE category IN ('en', 'fr', 'de') AND list_has_all(keywords, ['k1']) AND list_has_any(keywords, ['k2', 'k3', 'k4']) AND list_has_any(entities, ['e0', 'e1']) AND list_has_any(entity_types, ['LAW', 'X']) AND conf >= 0.2")
def _(spark, d):
    keep = X.metadata_filter(F.col("metadata"), categories=["en", "fr", "de"], keywords=["k1"], keywords_any=["k2", "k3", "k4"], entities=["e0", "e1"], entity_types=["LAW", "X"], min_confidence=0.2)
    return described(spark, d).filter(keep).select("doc_id")


@query("pf1_one_category", f"SELECT doc_id FROM ({META}) WHERE category = 'es'")
def _(spark, d):
    return described(spark, d).filter(X.metadata_filter(F.col("metadata"), category="es")).select("doc_id")


@query("js1_json_operators", f"SELECT doc_id, category, list_has_any(keywords, ['k1', 'k2']) AS any_of, list_has_all(keywords, ['k1', 'k2']) AS all_of FROM ({META})")
def _(spark, d):
    keywords = F.from_json(F.get_json_object("metadata", "$.keywords"), "array<string>")
    return described(spark, d).select("doc_id", F.get_json_object("metadata", "$.category").alias("category"), X.has_any(keywords, ["k1", "k2"]).alias("any_of"), X.has_all(keywords, ["k1", "k2"]).alias("all_of"))


@query("tx4_heading_signature", rf"SELECT doc_id, pos, CASE WHEN t = '' THEN '' WHEN pos % 4 = 0 THEN 'article' WHEN pos % 4 = 1 THEN 'numbered_item' WHEN pos % 4 = 2 THEN 'lettered_item' WHEN regexp_matches(t, '^(section|part|chapter|article|§)[^\p{{L}}\p{{N}}_\s]*(\s|$)') THEN regexp_extract(t, '^(section|part|chapter|article)', 1) ELSE left(t, 20) END AS signature FROM (SELECT doc_id, pos, lower(regexp_replace(CASE pos % 4 WHEN 0 THEN 'Čl. ' WHEN 1 THEN '1.2. ' WHEN 2 THEN 'b) ' ELSE '' END || content, '^\s+|\s+$', '', 'g')) AS t FROM ({SECTIONS}))")
def _(spark, d):
    marked = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("Čl. ", "1.2. ", "b) ", "")]), (F.col("pos") % 4 + 1).cast("int")), "content")
    return sections(spark, d).select("doc_id", "pos", T.heading_signature(marked).alias("signature"))


@query("tx6_list_style", "SELECT doc_id, pos, CASE pos % 6 WHEN 0 THEN 'decimal_dot' WHEN 1 THEN 'alpha_paren' WHEN 2 THEN 'paren_alpha_paren' WHEN 3 THEN 'paren_decimal_paren' WHEN 4 THEN 'upper_alpha_dot' ELSE 'unknown' END AS style FROM (" + SECTIONS + ")")
def _(spark, d):
    mark = F.element_at(F.array(*[F.lit(x) for x in (" 12. ", "a) ", "(b) ", "(3) ", "C. ", "- ")]), (F.col("pos") % 6 + 1).cast("int"))
    return sections(spark, d).select("doc_id", "pos", T.list_style(F.concat(mark, "content")).alias("style"))


@query("tx16_references_in_text", "SELECT doc_id, [CAST(doc_id % 90 AS VARCHAR), (doc_id % 40) || '/2016', 'iso ' || (doc_id % 30), '2.' || (doc_id % 9)] AS refs, ['státní úřad'] AS organisations FROM documents")
def _(spark, d):
    """What whole texts name, of which each also has the same passage."""
    k = lambda n: (F.col("doc_id") % n).cast("string")
    passage = F.concat(F.lit(" Podle § "), k(90), F.lit(" a zákona č. "), k(40), F.lit("/2016, norma ISO "), k(30), F.lit(", verze 2."), k(9), F.lit(". Vydal Státní úřad: "))
    text = F.concat("text", passage)
    return docs(spark, d).select("doc_id", E.named_in(text, E.REFERENCES).alias("refs"), E.named_in(text, E.ORGANISATIONS).alias("organisations"))


@query("pf9_kg_worthy", rf"SELECT chunk_id FROM (SELECT chunk_id, t, row_number() OVER (PARTITION BY md5(t) ORDER BY doc_id, pos) AS rn FROM (SELECT *, regexp_replace(content, '^\s+|\s+$', '', 'g') AS t FROM ({CHUNKS})) WHERE length(t) >= 100 AND NOT regexp_matches(t, '^[\d.\s\-–—]+$')) WHERE rn = 1")
def _(spark, d):
    return X.worthy(chunks(spark, d), "content", ["doc_id", "pos"]).select("chunk_id")


@query("pf14_citation_check", r"WITH a AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text || ' \cite{c' || (turn % 5) || '}' ELSE text END AS answer, turn % 2 = 0 AS cites, turn % 5 AS c FROM conversations) SELECT conv_id, turn, CASE WHEN cites AND c > 2 THEN ['c' || c] ELSE [] END AS unknown, length(answer) > 200 AND NOT cites AS missing, NOT (cites AND c > 2) AND NOT (length(answer) > 200 AND NOT cites) AS valid FROM a")
def _(spark, d):
    answer = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit(" \\cite{c"), (F.col("turn") % 5).cast("string"), F.lit("}"))).otherwise(F.col("text"))
    check = X.citation_check(answer, F.array(F.lit("c0"), F.lit("c1"), F.lit("c2")))
    return table(spark, d, "conversations").select("conv_id", "turn", check.alias("c")).select("conv_id", "turn", "c.*")


@query("pf15_early_stop", "WITH c AS (SELECT user_id AS key, event_id AS id, CASE event_type WHEN 'click' THEN 'expand_context' WHEN 'view' THEN 'search' WHEN 'error' THEN 'section_search' ELSE 'other' END AS tool, CASE WHEN value < 30 THEN 0 ELSE 1 END AS found FROM events), s AS (SELECT *, CASE WHEN tool IN ('search', 'section_search') THEN 1 - found END AS e FROM c), l AS (SELECT *, lag(e) OVER w AS e1, lag(e, 2) OVER w AS e2 FROM s WINDOW w AS (PARTITION BY key ORDER BY id)) SELECT key, id, (tool = 'expand_context' AND found = 0) OR CASE WHEN e = 0 THEN 0 WHEN e1 = 0 THEN coalesce(e, 0) ELSE coalesce(e, 0) + coalesce(e1, 0) + coalesce(e2, 0) END >= 2 AS stop FROM l")
def _(spark, d):
    tool = F.when(F.col("event_type") == "click", "expand_context").when(F.col("event_type") == "view", "search").when(F.col("event_type") == "error", "section_search").otherwise("other")
    calls = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), tool.alias("tool"), F.when(F.col("value") < 30, 0).otherwise(1).alias("found"))
    return X.early_stop(calls).select("key", "id", "stop")


def _topic(words, points):
    return f"CASE WHEN regexp_matches(lower(q), '{'|'.join(words)}') THEN {points} ELSE 0 END"


@query("rt1_complexity", r"WITH c AS (SELECT conv_id, turn, text || CASE turn % 5 WHEN 0 THEN ' GDPR risk?' WHEN 1 THEN ' what gap? where?' WHEN 2 THEN ' show' ELSE '' END AS q FROM conversations), s AS (SELECT *, greatest(0, least(100, least(30, length(q) // 10) + least(20, 5 * len(string_split_regex(q, '[.?!;]|\band\b|\bor\b'))) + " + " + ".join(_topic(w, p) for w, p in X.TOPICS) + " + CASE WHEN length(q) - length(replace(q, '?', '')) > 1 THEN 10 ELSE 0 END)) AS score FROM c) SELECT conv_id, turn, CAST(score AS INT) AS score, CASE WHEN score < 30 THEN 'simple' WHEN score < 70 THEN 'standard' ELSE 'complex' END AS band FROM s")
def _(spark, d):
    more = F.coalesce(*[F.when(F.col("turn") % 5 == i, F.lit(x)) for i, x in enumerate((" GDPR risk?", " what gap? where?", " show"))], F.lit(""))
    return table(spark, d, "conversations").select("conv_id", "turn", X.complexity(F.concat("text", more)).alias("c")).select("conv_id", "turn", "c.*")


@query("rd1_reducers", "SELECT user_id, coalesce(arg_min(event_type, event_id) FILTER (WHERE event_type NOT IN ('', 'unknown', 'routing', 'click')), arg_max(event_type, event_id)) AS keep_first, round(max(value), 6) AS take_max, bool_or(event_type = 'purchase') AS any_purchase, round(sum(value), 4) AS total, CAST(count(*) AS BIGINT) AS appended, (SELECT list(event_type ORDER BY f) FROM (SELECT event_type, min(event_id) AS f FROM events x WHERE x.user_id = e.user_id GROUP BY event_type)) AS unique_in_order, arg_max(event_id, event_id) FILTER (WHERE event_type = 'view') AS last_view FROM events e GROUP BY user_id")
def _(spark, d):
    at = F.col("event_id")
    first = X.keep_first(F.col("event_type"), at, ("", "unknown", "routing", "click"))
    merged = X.merge_maps(F.create_map(F.col("event_type"), at.cast("string")), at)
    return table(spark, d, "events").groupBy("user_id").agg(first.alias("keep_first"), F.round(F.max("value"), 6).alias("take_max"), F.bool_or(F.col("event_type") == "purchase").alias("any_purchase"), F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("appended"), X.union_in_order(F.col("event_type"), at).alias("unique_in_order"), F.try_element_at(merged, F.lit("view")).cast("long").alias("last_view"))


@query("ag5_dashboard", "SELECT (SELECT CAST(count(*) AS BIGINT) FROM customer) AS n_users, (SELECT CAST(count(*) AS BIGINT) FROM customer WHERE c_acctbal > 0) AS n_active, (SELECT CAST(count(*) AS BIGINT) FROM customer WHERE c_acctbal > 9000) AS n_admins, CAST(count(DISTINCT conv_id) AS BIGINT) AS n_conversations, CAST(count(*) AS BIGINT) AS n_messages, (SELECT CAST(count(DISTINCT user_id) AS BIGINT) FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR) AS seen_last_day, (SELECT round(sum(o_totalprice), 2) FROM orders) AS spent, round((SELECT sum(o_totalprice) FROM orders) / count(*), 4) AS per_message, round((SELECT sum(o_totalprice) FROM orders) / count(DISTINCT conv_id), 4) AS per_conversation FROM conversations")
def _(spark, d):
    """Nine figures of one-row aggregates; a count of 0 divides as 1."""
    balance = F.col("c_acctbal")
    users = table(spark, d, "customer").agg(F.count("*").alias("n_users"), F.count_if(balance > 0).alias("n_active"), F.count_if(balance > 9000).alias("n_admins"))
    talks = table(spark, d, "conversations").agg(F.countDistinct("conv_id").alias("n_conversations"), F.count("*").alias("n_messages"))
    events = table(spark, d, "events")
    newest = events.agg(F.max("ts").alias("newest"))
    seen = events.join(F.broadcast(newest)).filter("ts > newest - INTERVAL 24 HOURS").agg(F.countDistinct("user_id").alias("seen_last_day"))
    spent = table(spark, d, "orders").agg(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)).alias("s"))
    per = lambda n: F.round(F.col("s") / F.greatest(F.col(n), F.lit(1)), 4)
    return users.join(talks).join(seen).join(spent).withColumns({"spent": F.round("s", 2), "per_message": per("n_messages"), "per_conversation": per("n_conversations")}).drop("s")


FORMS = "SELECT event_id, 'd' || user_id AS doc, CASE event_id % 5 WHEN 0 THEN 'd' || user_id || ' > Untitled' WHEN 1 THEN 'd' || user_id || ' > ' || event_type END AS path, CASE event_id % 5 WHEN 2 THEN 'Part ' || event_type END AS section, CASE event_id % 5 WHEN 3 THEN event_type END AS title, CASE WHEN event_id % 2 = 0 THEN event_id % 9 END AS page, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE value END AS rerank, event_id % 2 AS rrf FROM events"


@query("fm1_results", f"SELECT event_id, CASE WHEN path IS NOT NULL AND contains(path, ' > Untitled') THEN doc || CASE WHEN coalesce(page, 0) <> 0 THEN ' (page ' || page || ')' ELSE '' END WHEN path IS NOT NULL THEN path WHEN section IS NOT NULL THEN doc || ' > ' || section WHEN title IS NOT NULL THEN doc || ' > ' || title WHEN coalesce(page, 0) <> 0 THEN doc || ' (page ' || page || ')' END AS breadcrumb, round(CASE WHEN rerank <> 0 THEN rerank WHEN rrf <> 0 THEN rrf ELSE 0.5 END, 4) AS score FROM ({FORMS})")
def _(spark, d):
    from ..operators.confidence import first_score

    e, doc = F.col("event_id"), F.concat(F.lit("d"), F.col("user_id").cast("string"))
    rows = table(spark, d, "events").select("event_id", doc.alias("doc"), F.when(e % 5 == 0, F.concat(doc, F.lit(" > Untitled"))).when(e % 5 == 1, F.concat(doc, F.lit(" > "), "event_type")).alias("path"), F.when(e % 5 == 2, F.concat(F.lit("Part "), "event_type")).alias("section"), F.when(e % 5 == 3, F.col("event_type")).alias("title"), F.when(e % 2 == 0, e % 9).alias("page"), F.when(e % 3 == 0, 0.0).otherwise(F.col("value")).alias("rerank"), (e % 2).alias("rrf"), F.lit(0.5).alias("score"))
    crumb = X.breadcrumb(*[F.col(c) for c in ("doc", "path", "section", "title", "page")])
    return rows.select("event_id", crumb.alias("breadcrumb"), F.round(first_score("rerank", "rrf", "score"), 4).alias("score"))


@query("kg4_within_two_hops", f"WITH e AS ({EDGES}) SELECT src, tgt, min(hops) AS hops FROM (SELECT src, tgt, 1 AS hops FROM e UNION ALL SELECT a.src, b.tgt, 2 FROM e a JOIN e b ON a.tgt = b.src) GROUP BY ALL")
def _(spark, d):
    return X.within_hops(edges(spark, d))


@query("kg7_mention_boost", "SELECT l_orderkey AS chunk, round(max(l_discount) + CASE WHEN bool_or(l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 9000)) THEN 0.3 ELSE 0 END, 6) AS boosted FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    """Asked are the suppliers of the largest balances."""
    line = table(spark, d, "lineitem")
    scores = line.groupBy(F.col("l_orderkey").alias("chunk")).agg(F.max("l_discount").alias("score"))
    named = table(spark, d, "supplier").filter("s_acctbal > 9000").select(F.col("s_suppkey").alias("id"))
    out = X.mention_boost(scores, line.select(F.col("l_orderkey").alias("chunk"), F.col("l_suppkey").alias("id")), named)
    return out.select("chunk", F.round("boosted", 6).alias("boosted"))


@query("kg12_cleaned_entities", f"SELECT id, CASE n WHEN 0 THEN 'Dokument' WHEN 1 THEN 'Datum' WHEN 2 THEN 'Organizace' WHEN 3 THEN 'Osoba' WHEN 4 THEN 'Entity' ELSE 'Kept' END AS type, CASE WHEN n < 3 THEN 'legacy_' || left(md5(id), 8) ELSE 'g' END AS group_id FROM (SELECT id, length(id) % 6 AS n FROM ({ENTITIES}))")
def _(spark, d):
    n = F.length("id") % 6
    name = F.element_at(F.array(*[F.lit(x) for x in ("Zákon 5", "dne 1.2.2020", "Státní úřad", "Jan Novák", "x", "y")]), n + 1)
    rows = entities(spark, d).select("id", name.alias("name"), F.when(n == 5, "Kept").when(n % 2 == 0, "Entity").alias("type"), F.when(n == 0, "Neznm").when(n == 1, "").when(n > 2, "g").alias("group_id"))
    return X.cleaned(rows, edges(spark, d).withColumn("confidence", F.lit(None).cast("double")))[0].select("id", "type", "group_id")


@query("kg12_cleaned_edges", f"SELECT rel, src, tgt, CAST(CASE WHEN length(src) % 2 = 0 THEN 0.7 ELSE 0.9 END AS DOUBLE) AS confidence FROM (SELECT rel, src, tgt FROM ({EDGES}) UNION ALL SELECT 'self', src, src FROM ({EDGES})) WHERE src <> tgt")
def _(spark, d):
    e = edges(spark, d)
    rows = e.unionByName(e.select(F.lit("self").alias("rel"), "src", F.col("src").alias("tgt"))).withColumn("confidence", F.when(F.length("src") % 2 == 1, 0.9))
    return X.cleaned(entities(spark, d).withColumnRenamed("value", "name").withColumn("group_id", F.lit("g")), rows)[1].select("rel", "src", "tgt", "confidence")


@query("kg14_last_edge", "SELECT 'c' || o_custkey AS src, 'p' || left(o_orderpriority, 1) AS tgt, arg_max('r' || o_orderkey, o_orderkey) AS rel FROM orders GROUP BY ALL")
def _(spark, d):
    rows = table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)).alias("tgt"), F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("rel"), F.col("o_orderkey").alias("at"))
    return X.last_edge(rows, "at")


@query("ed2_alias_dedup", "SELECT c_custkey, CASE WHEN lower(c_mktsegment) IN ('building', 'bld') THEN 'Construction' WHEN lower(c_mktsegment) IN ('automobile', 'cars') THEN 'Vehicles' ELSE c_mktsegment END AS canonical FROM customer")
def _(spark, d):
    named = spark.createDataFrame([("Construction", ["Building", "BLD"]), ("Vehicles", ["AUTOMOBILE", "cars"]), ("_note", ["machinery"])], "canonical string, aliases array<string>")
    joined = table(spark, d, "customer").join(F.broadcast(E.alias_pairs(named)), F.lower("c_mktsegment") == F.col("alias"), "left")
    return joined.select("c_custkey", F.coalesce("canonical", "c_mktsegment").alias("canonical"))


@query("ed6_merged_entities", f"WITH e AS (SELECT *, ['ch' || length(id), 'ch' || (length(value) % 3)] AS chunks, [left(id, 1)] AS tags FROM ({ENTITIES}) UNION ALL SELECT 'z' || id, type, value, norm, round(confidence + 0.01, 2), ['ch9'], ['z'] FROM ({ENTITIES}) WHERE type <> 'customer') SELECT type, norm, min(id) AS id, max(confidence) AS confidence, list_sort(list_distinct(flatten(list(chunks)))) AS chunks, list_sort(list_distinct(flatten(list(tags)))) AS tags, list_sort(list(DISTINCT id))[2:] AS merged_from FROM e GROUP BY type, norm")
def _(spark, d):
    base = entities(spark, d)
    one = base.select("id", "type", "norm", "confidence", F.array(F.concat(F.lit("ch"), F.length("id").cast("string")), F.concat(F.lit("ch"), (F.length("value") % 3).cast("string"))).alias("chunks"), F.array(F.substring("id", 1, 1)).alias("tags"))
    two = base.filter("type <> 'customer'").select(F.concat(F.lit("z"), "id").alias("id"), "type", "norm", F.round(F.col("confidence") + 0.01, 2).alias("confidence"), F.array(F.lit("ch9")).alias("chunks"), F.array(F.lit("z")).alias("tags"))
    return X.merged_entities(one.unionByName(two))


@query("ed8_merged_edges", "SELECT 'c' || o_custkey AS src, o_orderstatus AS tgt, o_orderpriority AS rel, max(round(o_totalprice / 1000000, 6)) AS confidence, list_sort(list(DISTINCT 'd' || o_orderkey % 10)) AS documents, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL")
def _(spark, d):
    rows = table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.col("o_orderstatus").alias("tgt"), F.col("o_orderpriority").alias("rel"), F.round(F.col("o_totalprice") / 1000000, 6).alias("confidence"), F.concat(F.lit("d"), (F.col("o_orderkey") % 10).cast("string")).alias("document"))
    return X.merged_edges(rows)
