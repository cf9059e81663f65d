"""Queries of feeds, labels, documents' information, operations, conversations and titles (SC14, SC15, MA5, LB5, CH2, TR1, ST3, AG24, AG28, CV1, CL7, TX*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clusters, conversations, hierarchy, labels, library, operations
from ..sources import feeds
from .documents import TREE, tree
from .registry import query, table
from .retrieval import items
from .text import CHUNKS, SECTIONS, chunks, docs, sections


@query(
    "sc14_question_set",
    r"""WITH t AS (SELECT doc_id, left(text, 80) AS query, source AS file_path, doc_id % 5 AS span_start, n_chars % 7 AS span_end, lang AS answer, doc_id % 4 AS n FROM documents)
SELECT row_number() OVER (ORDER BY doc_id) AS query_id, query, n AS n_snippets, file_path, span_end FROM t WHERE regexp_matches(query, '\S') AND n BETWEEN 1 AND 2 AND span_end > span_start AND file_path IS NOT NULL AND regexp_matches(answer, '\S')""",
)
def _(spark, d):
    """A test a document as JSON: none to two snippets, or one whose span has three places."""
    start, end, n = F.col("doc_id") % 5, F.col("n_chars") % 7, F.col("doc_id") % 4
    snippet = lambda span: F.struct(F.col("source").alias("file_path"), span.alias("span"), F.col("lang").alias("answer"))
    good, long = snippet(F.array(start, end)), snippet(F.array(start, end, end))
    held = F.when(n == 3, F.array(long)).otherwise(F.array_repeat(good, n.cast("int")))
    tests = docs(spark, d).select(F.col("doc_id").alias("place"), F.to_json(F.struct(F.substring("text", 1, 80).alias("query"), held.alias("snippets"))).alias("test"))
    found = feeds.questions(tests, "place")
    first = F.col("snippets")[0]
    return found.select(F.col("query_id").cast("long").alias("query_id"), "query", F.size("snippets").cast("long").alias("n_snippets"), first["file_path"].alias("file_path"), first["span"][1].alias("span_end"))


FEED = "SELECT 'N' || n_nationkey AS code, CASE WHEN n_nationkey % 6 < 2 THEN NULL ELSE (n_nationkey * 2 + 2.5) / 100 END AS rate, n_nationkey % 7 = 3 AS missing FROM nation"
RATES = f"SELECT code, CASE WHEN missing THEN 'missing' WHEN rate IS NULL THEN 'broken' WHEN rate NOT BETWEEN 0.08 AND 0.4 THEN 'out of bounds' ELSE 'feed' END AS status, CASE WHEN NOT missing AND rate BETWEEN 0.08 AND 0.4 THEN rate ELSE 0.25 END AS rate FROM ({FEED})"


def rates(spark, d):
    """A line a nation, of which some have no whole amount, some no line, and some a second one, which does not count."""
    nation = table(spark, d, "nation")
    key = F.col("n_nationkey")
    amount = F.when(key % 6 == 0, "0").when(key % 6 == 1, "x").otherwise("100")
    line = lambda rate: F.concat_ws("|", F.col("n_name"), F.lit("unit"), amount, F.concat(F.lit("N"), key.cast("string")), rate)
    first = nation.filter("n_nationkey % 7 <> 3").select(key.alias("place"), line(F.concat((key * 2 + 2).cast("string"), F.lit(",5"))).alias("line"))
    second = nation.filter("n_nationkey % 7 <> 3").select((key + 1000).alias("place"), line(F.lit("999")).alias("line"))
    wanted = nation.select(F.concat(F.lit("N"), key.cast("string")).alias("code"), F.lit(0.08).alias("low"), F.lit(0.4).alias("high"), F.lit(0.25).alias("fallback"))
    return feeds.rates(first.union(second), wanted)


@query("sc15_rate_feed", f"SELECT code, CAST(rate AS DOUBLE) AS rate, status FROM ({RATES})")
def _(spark, d):
    return rates(spark, d)


@query("ma5_sales_converted", f"SELECT sale_id, total, CAST(round(CAST(total AS DECIMAL(18,4)) * CAST(rate AS DECIMAL(14,6)), 2) AS DOUBLE) AS amount FROM sales LEFT JOIN clients USING (client_id) LEFT JOIN ({RATES}) ON code = 'N' || nation_id")
def _(spark, d):
    """All sales in the money of their clients' nations."""
    nation = table(spark, d, "clients").select("client_id", F.concat(F.lit("N"), F.col("nation_id").cast("string")).alias("code"))
    joined = table(spark, d, "sales").join(nation, "client_id", "left").join(rates(spark, d), "code", "left")
    return joined.select("sale_id", "total", feeds.converted(F.col("total"), F.col("rate")).cast("double").alias("amount"))


WORDS = "list_filter(string_split(content, ' '), lambda w: w <> '')"


@query(
    "lb5_labelled_chunks",
    f"""WITH c AS (SELECT *, CASE WHEN pos % 2 = 0 THEN list_slice({WORDS}, 1, 9) ELSE ['qq1', 'qq2', 'qq3', 'qq4', 'qq5', 'qq6'] END AS kw, ['zz9 q', 'zz8 q', 'zz7 q'] AS ph FROM ({CHUNKS})),
h AS (SELECT *, list_filter(kw, lambda w: contains(lower(content), lower(w))) AS hit FROM c)
SELECT chunk_id, d.source AS category, d.lang AS subcategory, round(d.n_chars % 100 / 100, 2) AS category_confidence, array_to_string(CASE WHEN pos % 5 = 4 THEN NULL WHEN len(hit) > 0 THEN hit ELSE kw[1:5] END, ',') AS keywords,
       CASE WHEN pos % 5 < 4 THEN 'zz9 q,zz8 q' END AS key_phrases, CASE WHEN pos % 3 = 0 AND d.source IS NOT NULL THEN content || chr(10) || chr(10) || '[Otázky: ' || 'what of ' || d.source || ']' ELSE content END AS embedding_text, 'generated' AS labels_source
FROM h JOIN documents d USING (doc_id)""",
)
def _(spark, d):
    """Four sections in five have keywords, own words or foreign ones; one chunk in three has a question."""
    section = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("pos").cast("string"))
    rows = chunks(spark, d).withColumn("section_id", section)
    own = F.slice(F.filter(F.split("content", " "), lambda w: w != ""), 1, 9)
    foreign = F.array(*[F.lit(f"qq{i}") for i in range(1, 7)])
    words = rows.filter("pos % 5 <> 4").select("section_id", F.when(F.col("pos") % 2 == 0, own).otherwise(foreign).alias("keywords"), F.array(F.lit("zz9 q"), F.lit("zz8 q"), F.lit("zz7 q")).alias("key_phrases"))
    source = docs(spark, d)
    taxonomy = source.select("doc_id", F.col("source").alias("category"), F.col("lang").alias("subcategory"), F.round(F.col("n_chars") % 100 / 100, 2).alias("category_confidence"))
    asked = rows.filter("pos % 3 = 0").join(source.select("doc_id", "source"), "doc_id").select("chunk_id", F.array("source").alias("questions"), F.concat(F.lit("what of "), "source").alias("hyde_text"))
    out = labels.labelled(rows.withColumn("embedding_text", F.col("content")), taxonomy, words, asked)
    return out.select("chunk_id", "category", "subcategory", "category_confidence", F.array_join("keywords", ",").alias("keywords"), F.array_join("key_phrases", ",").alias("key_phrases"), "embedding_text", "labels_source")


SUMMED = f"SELECT doc_id, pos, CASE pos % 3 WHEN 0 THEN NULL WHEN 1 THEN content ELSE content || '  ' END AS summary FROM ({SECTIONS})"


@query("ch2_summary_chunks", rf"SELECT CAST(doc_id AS VARCHAR) || '_L2_' || CAST(pos AS VARCHAR) AS chunk_id, CAST(doc_id AS VARCHAR) || '_L1' AS parent_chunk_id, doc_id, 2 AS layer, summary AS content, pos // 20 + 1 AS page_number FROM ({SUMMED}) WHERE regexp_matches(summary, '\S')")
def _(spark, d):
    """Lines as summaries, whole; one in three is missing."""
    summary = F.when(F.col("pos") % 3 == 1, F.col("content")).when(F.col("pos") % 3 == 2, F.concat("content", F.lit("  ")))
    rows = sections(spark, d).select("doc_id", F.col("pos").alias("section_id"), F.lit("line").alias("title"), F.lit("all > line").alias("path"), F.lit(1).alias("level"), (F.floor(F.col("pos") / 20) + 1).alias("page"), summary.alias("summary"))
    return library.summary_chunks(rows).select("chunk_id", "parent_chunk_id", "doc_id", "layer", "content", "page_number")


PLACED = f"WITH RECURSIVE t AS ({TREE}), p(id, path, depth) AS (SELECT id, id, 0 FROM t WHERE parent IS NULL UNION ALL SELECT t.id, p.path || ' > ' || t.id, p.depth + 1 FROM t JOIN p ON t.parent = p.id), s AS (SELECT id, path, depth + CAST(length(id) % 5 = 2 AS INT) AS level FROM p)"


@query("tr1_children_of_all", f"{PLACED} SELECT a.path AS parent, s.id, s.level FROM s a JOIN s ON starts_with(s.path, a.path || ' > ') AND s.level = a.level + 1")
def _(spark, d):
    """Sections one level below each section, where some levels are off by one."""
    placed = hierarchy.paths(tree(spark, d)).select("id", "path", (F.col("depth") + (F.length("id") % 5 == 2).cast("int")).alias("level"))
    return library.children(placed, placed.select(F.col("path").alias("parent"))).select("parent", "id", "level")


def layers(spark, d):
    """Documents by language and source, lines that are not blank, and long lines in sections of twenty."""
    one = docs(spark, d).select("doc_id", F.lit("L1").alias("chunk_id"), F.concat_ws(" from ", "lang", "source").alias("content"))
    place = lambda c: F.lpad(c.cast("string"), 6, "0")
    part = place(F.floor(F.col("pos") / 20))
    two = sections(spark, d).filter("trim(content) <> ''").select("doc_id", place(F.col("pos")).alias("chunk_id"), part.alias("section_id"), F.concat(F.lit("part "), part).alias("section_title"), F.lit("all").alias("section_path"), "content", (F.floor(F.col("pos") / 20) + 1).alias("page_number"))
    three = chunks(spark, d).select("doc_id", "chunk_id", part.alias("section_id"), "content")
    return one, two, three


SPACED = f"SELECT * FROM ({SECTIONS}) WHERE trim(content) <> ''"


@query("st3_documents", "SELECT doc_id, concat_ws(' from ', lang, source) AS summary FROM documents")
def _(spark, d):
    one, _, three = layers(spark, d)
    return library.document_list(one, three.withColumn("title", F.lit("none")))


@query("st3_metadata", f"""WITH s AS (SELECT doc_id, count(*) AS n FROM ({SPACED}) GROUP BY 1), c AS (SELECT doc_id, count(*) AS n, sum(length(content)) AS chars FROM ({CHUNKS}) GROUP BY 1)
SELECT d.doc_id, concat_ws(' from ', lang, source) AS summary, CAST(coalesce(s.n, 0) AS BIGINT) AS section_count, CAST(coalesce(c.n, 0) AS BIGINT) AS chunk_count, CAST(coalesce(chars, 0) AS BIGINT) AS chars, CAST(coalesce(chars, 0) // 5 AS BIGINT) AS words, concat_ws(' from ', lang, source) <> '' OR s.n > 0 AS found
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id""")
def _(spark, d):
    return library.document_metadata(*layers(spark, d))


@query("st3_sections", f"SELECT doc_id, section_id, 'part ' || section_id AS section_title, CAST(place AS INT) AS place, total, total > 50 AS truncated FROM (SELECT doc_id, lpad(CAST(pos // 20 AS VARCHAR), 6, '0') AS section_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos // 20, pos) AS place, count(*) OVER (PARTITION BY doc_id) AS total FROM ({SPACED})) WHERE place <= 50")
def _(spark, d):
    return library.document_sections(layers(spark, d)[1])


@query("st3_section_details", f"""WITH c AS (SELECT doc_id, pos // 20 AS part, count(*) AS n FROM ({CHUNKS}) GROUP BY ALL), s AS (SELECT doc_id, pos // 20 AS part, arg_min(content, pos) AS summary FROM ({SPACED}) GROUP BY ALL)
SELECT s.doc_id, lpad(CAST(s.part AS VARCHAR), 6, '0') AS section_id, 'part ' || lpad(CAST(s.part AS VARCHAR), 6, '0') AS section_title, 'all' AS section_path, summary, s.part + 1 AS page_number, CAST(coalesce(n, 0) AS BIGINT) AS chunk_count FROM s LEFT JOIN c ON c.doc_id = s.doc_id AND c.part = s.part""")
def _(spark, d):
    _, two, three = layers(spark, d)
    return library.section_details(two, three)


CALLS = "SELECT client_id, kind <> 'error' AS ok, value AS ms, CASE kind WHEN 'view' THEN true WHEN 'click' THEN false END AS hit FROM clicks"


@query("ag24_client_operations", f"""WITH a AS (SELECT client_id, count(*) AS total_calls, coalesce(sum(ms), 0) AS t, count(*) FILTER (WHERE ok) AS success_count, count(*) FILTER (WHERE NOT ok) AS error_count, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses FROM ({CALLS}) GROUP BY 1)
SELECT client_id, total_calls, round(t, 4) AS total_time_ms, success_count, error_count, hits, misses, round(t / total_calls, 6) AS avg_time_ms, round(success_count / total_calls, 6) AS success_rate, round(100 * (success_count / total_calls), 6) AS success_percent,
       round(error_count / total_calls, 6) AS error_rate, round(100 * (error_count / total_calls), 6) AS error_percent, round(coalesce(hits / nullif(hits + misses, 0), 0), 6) AS hit_rate, round(1 - coalesce(hits / nullif(hits + misses, 0), 0), 6) AS miss_rate FROM a""")
def _(spark, d):
    """Clicks as calls: errors fail, views hit, clicks miss."""
    hit = F.when(F.col("kind") == "view", True).when(F.col("kind") == "click", False)
    calls = table(spark, d, "clicks").select("client_id", (F.col("kind") != "error").alias("ok"), F.col("value").alias("ms"), hit.alias("hit"))
    found = operations.operation_stats(calls, "client_id")
    return found.select(*[F.round(c, 4 if c == "total_time_ms" else 6).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])


@query("ag28_extraction_rollup", """WITH c AS (SELECT sale_id AS doc_id, count(*) AS total_chunks, count(*) FILTER (WHERE flag IS DISTINCT FROM 'swapped') AS successful_chunks, count(*) FILTER (WHERE flag = 'swapped') AS failed_chunks, CAST(coalesce(sum(quantity), 0) AS BIGINT) AS total_relationships FROM sale_lines GROUP BY 1),
e AS (SELECT sale_id AS doc_id, count(*) AS total_entities, count(DISTINCT item_id) AS unique_entities FROM sale_lines WHERE sale_id IS NOT NULL GROUP BY 1)
SELECT c.doc_id, total_chunks, successful_chunks, failed_chunks, total_relationships, coalesce(total_entities, 0) AS total_entities, coalesce(unique_entities, 0) AS unique_entities FROM c LEFT JOIN e ON e.doc_id = c.doc_id""")
def _(spark, d):
    """Lines of sales as chunks, of which swapped ones failed; their items as entities."""
    line = table(spark, d, "sale_lines").withColumnRenamed("sale_id", "doc_id")
    error = F.when(F.col("flag") == "swapped", "swapped")
    return operations.extraction_rollup(line.select("doc_id", error.alias("error"), F.col("quantity").alias("n_relationships")), line.select("doc_id", F.col("item_id").alias("uuid")))


@query("ag28_labels_of_sales", "SELECT sale_id AS doc_id, label, count(*) AS n FROM sale_lines JOIN (SELECT item_id, unnest(['Entity', kind, brand]) AS label FROM items) USING (item_id) WHERE label <> 'Entity' GROUP BY ALL")
def _(spark, d):
    item = table(spark, d, "items").select("item_id", F.array(F.lit("Entity"), "kind", "brand").alias("labels"))
    line = table(spark, d, "sale_lines").select(F.col("sale_id").alias("doc_id"), "item_id").join(item, "item_id")
    return operations.label_counts(line)


MOMENT = "TIMESTAMP '2024-01-01' + to_minutes(CAST(turn * 7 + conv_id % 13 AS BIGINT))"
TALKS = f"SELECT conv_id, conv_id % 20 AS user_id, CAST(conv_id AS VARCHAR) AS title, min({MOMENT}) AS created_at, max({MOMENT}) AS updated_at FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id"


def talks(spark, d):
    minutes = F.col("turn") * 7 + F.col("conv_id") % 13
    moment = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=minutes.cast("int"))
    messages = table(spark, d, "conversations").filter("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text", moment.alias("created_at"))
    each = messages.groupBy("conv_id", (F.col("conv_id") % 20).alias("user_id"), F.col("conv_id").cast("string").alias("title")).agg(F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"))
    return each, messages


@query("cv1_user_conversations", f"SELECT conv_id, user_id, CAST(place AS INT) AS place, message_count FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC NULLS LAST, conv_id) AS place FROM ({TALKS})) JOIN (SELECT conv_id, count(*) AS message_count FROM conversations GROUP BY 1) USING (conv_id) WHERE place <= 50")
def _(spark, d):
    """The fifty conversations that each user touched last."""
    return conversations.of_users(*talks(spark, d)).select("conv_id", "user_id", "place", "message_count")


ADDED = "SELECT item_id % 25 AS conv_id, 'user' AS role, text, item_id FROM benchmark"


@query("cv1_after_append", f"""WITH l AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1)
SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL UNION ALL SELECT a.conv_id, CAST(last + row_number() OVER (PARTITION BY a.conv_id ORDER BY item_id) AS BIGINT), role, text FROM ({ADDED}) a JOIN l ON l.conv_id = a.conv_id""")
def _(spark, d):
    """Benchmark texts as new messages of the first conversations, a second apart."""
    later = F.lit("2024-06-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("item_id").cast("decimal(18,6)"))
    new = table(spark, d, "benchmark").select((F.col("item_id") % 25).alias("conv_id"), F.lit("user").alias("role"), "text", later.alias("created_at"))
    return conversations.appended(*talks(spark, d), new)[1].select("conv_id", "turn", "role", "text")


@query("cv1_after_delete", "SELECT conv_id, turn FROM conversations WHERE conv_id IS NOT NULL AND NOT (conv_id % 20 = 3 AND conv_id IN (SELECT item_id FROM benchmark))")
def _(spark, d):
    """User 3 asks for all conversations that a benchmark item numbers; only the own ones go."""
    gone = table(spark, d, "benchmark").select(F.col("item_id").alias("conv_id"), F.lit(3).cast("long").alias("user_id"))
    return conversations.deleted(*talks(spark, d), gone)[1].select("conv_id", "turn")


UNIT = "list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))))"


@query(
    "cl7_cluster_summary",
    f"""WITH u AS (SELECT vec_id AS id, label, {UNIT} AS v FROM embeddings), e AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u), m AS (SELECT label, i, avg(x) AS c FROM e GROUP BY ALL),
n AS (SELECT label, sqrt(sum(c * c)) AS n FROM m GROUP BY 1), k AS (SELECT label, list(c / n ORDER BY i) AS c FROM m JOIN n USING (label) GROUP BY 1),
r AS (SELECT u.label, id, row_number() OVER (PARTITION BY u.label ORDER BY round(list_inner_product(v, c), 9) DESC, id) AS place FROM u JOIN k ON k.label = u.label)
SELECT k.label AS cluster, (SELECT count(*) FROM u WHERE u.label = k.label) AS size, list_transform(c, lambda x: round(x, 6)) AS centroid, (SELECT list(id ORDER BY place) FROM r WHERE r.label = k.label AND place <= 5) AS closest FROM k WHERE k.label <> -1""",
)
def _(spark, d):
    found = clusters.summaries(items(spark, d).withColumnRenamed("label", "cluster"))
    return found.withColumn("centroid", F.transform("centroid", lambda x: F.round(x, 6)))


SAID = "coalesce(text, '')"
FIRST = "split_part(text, ' ', 1)"


@query("tx28_titles", f"""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN regexp_replace(regexp_replace(trim({FIRST}), '^["'']+|["'']+$', '', 'g'), '[.!?:]+$', '') WHEN 1 THEN 'Title: ''Plan' ELSE
       (SELECT CASE WHEN length(w) > 50 THEN left(w, 47) || '...' ELSE w END FROM (SELECT trim(regexp_replace({SAID}, '\\s+', ' ', 'g')) AS w)) END AS title FROM conversations WHERE turn % 4 <> 0 OR regexp_matches({FIRST}, '[\\p{{L}}\\p{{N}}]')""".replace("\\\\", "\\"))
def _(spark, d):
    """Titles that a model gave with a prefix and quotes, with two prefixes of which the first is tried too early, empty, or not at all."""
    word = F.split_part("text", F.lit(" "), F.lit(1))
    given = F.when(F.col("turn") % 4 == 0, F.concat(F.lit('Title: "'), word, F.lit('"'))).when(F.col("turn") % 4 == 1, "Here is Title: 'Plan'").when(F.col("turn") % 4 == 2, "")
    rows = table(spark, d, "conversations").filter((F.col("turn") % 4 != 0) | word.rlike(r"[\p{L}\p{N}]"))
    return rows.select("conv_id", "turn", T.title_of(given, F.col("text")).alias("title"))


@query("tx23_final_answers", rf"SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN '' WHEN turn % 2 = 0 THEN regexp_replace({SAID}, '^\s+|\s+$', '', 'g') ELSE 'no tag <answer>' || {SAID} END AS answer FROM conversations WHERE turn IS NOT NULL")
def _(spark, d):
    """Even turns have their text in tags, every fifth run failed."""
    said = F.coalesce("text", F.lit(""))
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("so <ANSWER> "), said, F.lit(" </ANSWER> end <ANSWER>x</ANSWER>"))).otherwise(F.concat(F.lit("no tag <answer>"), said))
    return table(spark, d, "conversations").filter("turn IS NOT NULL").select("conv_id", "turn", T.final_answer(F.col("turn") % 5 != 0, text).alias("answer"))


@query("tx22_cited_sources", r"SELECT doc_id, list_distinct(regexp_extract_all('see \cite{' || source || '} and \cite{' || lang || '_' || doc_id % 3 || '} or \cite{' || source || '}', '\\cite\{([^}]+)\}', 1)) AS cited FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL".replace("list_distinct(", "list_sort(list_distinct(").replace(", 1)) AS cited", ", 1))) AS cited"))
def _(spark, d):
    """Answers that cite a document's source twice and its language once."""
    cite = lambda *x: F.concat(F.lit(r"\cite{"), *x, F.lit("}"))
    said = F.concat(F.lit("see "), cite("source"), F.lit(" and "), cite("lang", F.lit("_"), (F.col("doc_id") % 3).cast("string")), F.lit(" or "), cite("source"))
    return docs(spark, d).filter("source IS NOT NULL AND lang IS NOT NULL").select("doc_id", F.array_sort(T.citations(said)).alias("cited"))


@query("tx14_file_names", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id || '/' || (1990 + doc_id % 30) || ' Sb.' ELSE replace(coalesce(source, ''), '_', ' ') || ' ' || coalesce(lang, '') END AS name FROM documents")
def _(spark, d):
    key = F.col("doc_id").cast("string")
    law = F.concat_ws("_", F.lit("Sb"), (1990 + F.col("doc_id") % 30).cast("string"), key, F.coalesce("lang", F.lit("")))
    plain = F.concat(F.coalesce("source", F.lit("")), F.lit("_"), F.coalesce("lang", F.lit("")))
    return docs(spark, d).select("doc_id", T.display_name(F.when(F.col("doc_id") % 2 == 0, law).otherwise(plain)).alias("name"))


@query("tx17_expanded_forms", "SELECT s_suppkey, list_sort([lower('GRI report of ' || s_name || ' for EU'), lower('global reporting initiative report of ' || s_name || ' for EU'), lower('GRI report of ' || replace(lower(s_name), 'eu', 'european union') || ' for european union')]) AS forms FROM supplier")
def _(spark, d):
    """Names of suppliers in a phrase with two known acronyms and one that is not."""
    known = F.create_map(F.lit("GRI"), F.lit("global reporting initiative"), F.lit("EU"), F.lit("european union"))
    phrase = F.concat(F.lit("GRI report of "), "s_name", F.lit(" for EU"))
    return table(spark, d, "supplier").select("s_suppkey", F.array_sort(T.expanded_forms(phrase, known)).alias("forms"))


@query("tx3_composed", "SELECT doc_id, nfc_normalize(regexp_replace(coalesce(text, ''), '([eaouciEA])', '\\1' || chr(769), 'g')) AS text FROM documents")
def _(spark, d):
    """Texts with an acute behind some letters, composed."""
    marked = F.regexp_replace(F.coalesce("text", F.lit("")), "([eaouciEA])", "$1\u0301")
    return docs(spark, d).select("doc_id", T.composed(marked).alias("text"))


@query("tx10_bpe_tokens")
def _(spark, d):
    """Byte-pair tokens of every document, beside the estimate by length."""
    import public_tokenizers

    count = T.bpe_tokens(F.col("text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return docs(spark, d).select("doc_id", count.alias("n_tokens"), T.token_estimate(F.col("text")).alias("estimate"))
