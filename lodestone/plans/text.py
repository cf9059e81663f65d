"""Queries of text functions and sections over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from .registry import query, table

NORM = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
TOK = "list_distinct(list_filter(string_split(" + NORM + ", ' '), lambda x: x <> ''))"
SECTIONS = "SELECT doc_id, CAST(pos AS INT) AS pos, part AS content FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"


def docs(spark, d):
    return table(spark, d, "documents")


def sections(spark, d):
    """Lines of each document with their place."""
    return docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "content"))


def chunks(spark, d):
    """Sections of 50 characters and more as layer-3 chunks; numbers count all sections (PF8)."""
    kept = sections(spark, d).filter(F.length(F.trim("content")) >= 50)
    return kept.withColumn("chunk_id", F.concat(F.col("doc_id").cast("string"), F.lit("_L3_"), (F.col("pos") + 1).cast("string")))


CHUNKS = f"SELECT doc_id, pos, content, CAST(doc_id AS VARCHAR) || '_L3_' || CAST(pos + 1 AS VARCHAR) AS chunk_id FROM ({SECTIONS}) WHERE length(trim(content)) >= 50"


def _over_docs(key, sql, columns):
    """A query of columns that ``columns`` makes of the text."""

    def run(spark, d):
        return docs(spark, d).select("doc_id", *[x.alias(k) for k, x in columns(F.col("text")).items()])

    query(key, f"SELECT doc_id, {sql} FROM documents")(run)


_over_docs("tx1_normalize", NORM.format("text") + " AS norm", lambda c: dict(norm=T.normalize(c)))
_over_docs("tx2_tokenize", f"CAST(len({TOK.format('text')}) AS INT) AS n_tokens", lambda c: dict(n_tokens=F.size(T.tokenize(c))))
_over_docs("tx5_numbering_depth", r"CAST(len(regexp_extract_all(regexp_extract(text, '^\s*((?:[A-Za-z0-9]+\.)+[A-Za-z0-9]*)(?:\s|\z)', 1), '[A-Za-z0-9]+')) AS INT) AS depth", lambda c: dict(depth=T.numbering_depth(c)))
_over_docs("tx10_token_estimate", "CAST(length(text) // 4 AS BIGINT) AS est", lambda c: dict(est=T.token_estimate(c)))
_over_docs("tx14_display_name", "replace('doc_' || source || '_' || lang, '_', ' ') AS name, '18/1997 Sb.' AS law", lambda c: dict(name=T.display_name(F.concat_ws("_", F.lit("doc"), "source", "lang")), law=T.display_name(F.lit("Sb_1997_18_2017-01-01_IZ"))))
_over_docs("tx15_group_id", r"regexp_replace(regexp_replace(regexp_replace(source || ' / ' || lang || '!', '[^A-Za-z0-9_-]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS gid", lambda c: dict(gid=T.group_id(F.concat("source", F.lit(" / "), "lang", F.lit("!")))))
_over_docs("tx17_acronyms", r"CAST(len(list_distinct(list_filter(string_split_regex(text, '[^\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Z]{2,}')))) AS INT) AS n_acronyms", lambda c: dict(n_acronyms=F.size(T.acronyms(c))))
_over_docs("tx20_fts_query", r"array_to_string(list_filter(string_split_regex(lower(text), '\s+'), lambda w: length(w) > 2 AND regexp_full_match(w, '[\p{L}\p{N}]+')), ' | ') AS q", lambda c: dict(q=T.fts_query(c)))
_over_docs("tx25_hashes", "sha256(text) AS sha, md5(text) AS md5", lambda c: dict(sha=F.sha2(c, 256), md5=F.md5(c)))
_over_docs("tx28_fallback_title", "CASE WHEN length(trim(text)) > 50 THEN left(trim(text), 47) || '...' ELSE trim(text) END AS title", lambda c: dict(title=T.fallback_title(c)))
_over_docs("tx30_json_tokens", "greatest(1, CAST(ceil(length(text) / 4) AS BIGINT)) AS est", lambda c: dict(est=T.json_token_estimate(c)))
_over_docs("tx8_breadcrumb", "'[' || source || ' > ' || lang || ']' || chr(10) || chr(10) || text AS embedding_text", lambda c: dict(embedding_text=F.concat(F.lit("["), T.breadcrumb(F.col("source"), F.col("lang"), F.col("lang")), F.lit("]\n\n"), c)))
_over_docs("tx22_citations", r"CAST(len(list_distinct(regexp_extract_all('see \cite{' || source || '} and \cite{' || lang || '} \cite{' || lang || '}', '\\cite\{([^}]+)\}', 1))) AS INT) AS n", lambda c: dict(n=F.size(T.citations(F.concat(F.lit("see \\cite{"), "source", F.lit("} and \\cite{"), "lang", F.lit("} \\cite{"), "lang", F.lit("}"))))))
_over_docs("tx23_answer", r"CASE WHEN doc_id % 2 = 0 THEN trim(source) ELSE trim(lang || ' none') END AS answer", lambda c: dict(answer=T.answer(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("x <ANSWER> "), "source", F.lit(" </ANSWER> y"))).otherwise(F.concat("lang", F.lit(" none "))))))


@query("sc1_source_gate", "SELECT page_id, CASE WHEN regexp_matches(lower(url), '\\.(html?|txt|pdf|docx|pptx|xlsx)([?#].*)?$') THEN regexp_extract(lower(url), '\\.(html?|txt|pdf|docx|pptx|xlsx)([?#].*)?$', 1) ELSE 'unsupported' END AS kind FROM pages")
def _(spark, d):
    pattern = r"\.(html?|txt|pdf|docx|pptx|xlsx)([?#].*)?$"
    kind = F.regexp_extract(F.lower("url"), pattern, 1)
    return table(spark, d, "pages").select("page_id", F.when(kind == "", "unsupported").otherwise(kind).alias("kind"))


@query("pf8_ch3_chunks", f"SELECT chunk_id, doc_id, pos, content FROM ({CHUNKS})")
def _(spark, d):
    return chunks(spark, d).select("chunk_id", "doc_id", "pos", "content")


@query("wn6_char_offsets", f"SELECT doc_id, pos, CAST(coalesce(sum(length(content) + 2) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM ({SECTIONS})")
def _(spark, d):
    before = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    return sections(spark, d).select("doc_id", "pos", F.coalesce(F.sum(F.length("content") + 2).over(before), F.lit(0)).alias("char_start"))


@query("ch1_document_chunk", "SELECT CAST(doc_id AS VARCHAR) || '_L1' AS chunk_id, left(text, 500) AS content FROM documents")
def _(spark, d):
    return docs(spark, d).select(F.concat(F.col("doc_id").cast("string"), F.lit("_L1")).alias("chunk_id"), F.substring("text", 1, 500).alias("content"))


@query("ch2_section_chunks", f"SELECT CAST(doc_id AS VARCHAR) || '_L2_sec_' || CAST(pos + 1 AS VARCHAR) AS chunk_id, left(trim(content), 200) AS summary FROM ({SECTIONS}) WHERE trim(content) <> ''")
def _(spark, d):
    kept = sections(spark, d).filter(F.trim("content") != "")
    return kept.select(F.concat(F.col("doc_id").cast("string"), F.lit("_L2_sec_"), (F.col("pos") + 1).cast("string")).alias("chunk_id"), F.substring(F.trim("content"), 1, 200).alias("summary"))


@query("ch4_flat_documents", f"SELECT doc_id, CAST(count(*) AS BIGINT) AS n_sections, max(pos) = 0 AS flat FROM ({SECTIONS}) GROUP BY doc_id")
def _(spark, d):
    return sections(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_sections"), (F.max("pos") == 0).alias("flat"))


@query("ch5_summary_input", f"SELECT doc_id, string_agg('- ' || content, chr(10) ORDER BY pos) AS bullets FROM ({CHUNKS}) GROUP BY doc_id")
def _(spark, d):
    lines = F.array_sort(F.collect_list(F.struct("pos", F.concat(F.lit("- "), "content").alias("line"))))
    return chunks(spark, d).groupBy("doc_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("bullets"))


@query("ch6_summary_validation", f"SELECT doc_id, CAST(count(*) FILTER (WHERE length(trim(content)) >= 50) AS BIGINT) AS n_valid, CAST(count(*) AS BIGINT) AS n, count(*) FILTER (WHERE length(trim(content)) >= 50) >= 0.9 * count(*) AS passes FROM ({SECTIONS}) GROUP BY doc_id")
def _(spark, d):
    valid = F.count_if(F.length(F.trim("content")) >= 50)
    return sections(spark, d).groupBy("doc_id").agg(valid.alias("n_valid"), F.count("*").alias("n"), (valid >= 0.9 * F.count("*")).alias("passes"))


@query("ag21_chunking_stats", f"SELECT CAST(count(*) AS BIGINT) AS n, round(avg(length(content)), 6) AS mean_size, CAST(min(length(content)) AS INT) AS min_size, CAST(max(length(content)) AS INT) AS max_size FROM ({CHUNKS})")
def _(spark, d):
    size = F.length("content")
    return chunks(spark, d).agg(F.count("*").alias("n"), F.round(F.avg(size), 6).alias("mean_size"), F.min(size).alias("min_size"), F.max(size).alias("max_size"))


@query("pf13_null_audit", "SELECT CAST(count(*) FILTER (WHERE text IS NULL) AS BIGINT) AS null_text, CAST(count(*) FILTER (WHERE length(text) < 50) AS BIGINT) AS short_text, CAST(count(*) FILTER (WHERE n_chars IS NULL) AS BIGINT) AS null_chars FROM documents")
def _(spark, d):
    return docs(spark, d).agg(F.count_if(F.col("text").isNull()).alias("null_text"), F.count_if(F.length("text") < 50).alias("short_text"), F.count_if(F.col("n_chars").isNull()).alias("null_chars"))


@query("du2_exact_duplicates", "SELECT sha256(text) AS sha, min(doc_id) AS first_doc, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    return docs(spark, d).groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).filter("n > 1")


PATHS = f"SELECT *, CASE WHEN trim(content) = '' THEN '' ELSE CAST(length(content) % 7 AS VARCHAR) || '.' || CAST(pos % 12 AS VARCHAR) END AS path FROM ({SECTIONS})"


@query("so4_dedup_sections", f"WITH g AS (SELECT *, max(pos) OVER (PARTITION BY doc_id, path) AS last_page, row_number() OVER (PARTITION BY doc_id, path ORDER BY length(content) DESC, pos) AS rn FROM ({PATHS})) SELECT doc_id, path, content, last_page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN path = '' THEN -1 ELSE CAST(string_split(path, '.')[1] AS INT) END, CASE WHEN path = '' THEN -1 ELSE CAST(string_split(path, '.')[2] AS INT) END) AS INT) AS number FROM g WHERE rn = 1")
def _(spark, d):
    """One section a path: the longest content with the last page, in the natural order of paths, numbered anew; those without a path are one."""
    path = F.when(F.trim("content") == "", "").otherwise(F.concat_ws(".", (F.length("content") % 7).cast("string"), (F.col("pos") % 12).cast("string")))
    group = W.partitionBy("doc_id", "path")
    kept = sections(spark, d).withColumn("path", path).withColumns({"last_page": F.max("pos").over(group), "rn": F.row_number().over(group.orderBy(F.length("content").desc(), "pos"))}).filter("rn = 1")
    natural = F.transform(F.filter(F.split("path", r"\."), lambda x: x != ""), lambda x: x.cast("int"))
    return kept.select("doc_id", "path", "content", "last_page", F.row_number().over(W.partitionBy("doc_id").orderBy(natural)).alias("number"))


@query("lb1_label_propagation", f"SELECT chunk_id, l.quality AS quality, l.toxic AS toxic FROM ({CHUNKS}) c JOIN labels l ON l.doc_id = c.doc_id")
def _(spark, d):
    return chunks(spark, d).join(table(spark, d, "labels"), "doc_id").select("chunk_id", "quality", "toxic")


@query("lb2_keyword_propagation", f"SELECT chunk_id, array_to_string(CASE WHEN len(hit) > 0 THEN hit ELSE kw[1:2] END, ',') AS keywords FROM (SELECT chunk_id, kw, list_filter(kw, lambda k: contains(lower(content), k)) AS hit FROM (SELECT *, ['the', 'und', 'que', 'les', 'ing'] AS kw FROM ({CHUNKS})))")
def _(spark, d):
    keywords = F.array(*[F.lit(x) for x in ("the", "und", "que", "les", "ing")])
    hit = F.filter(keywords, lambda k: F.contains(F.lower("content"), k))
    return chunks(spark, d).select("chunk_id", F.array_join(F.when(F.size(hit) > 0, hit).otherwise(F.slice(keywords, 1, 2)), ",").alias("keywords"))


@query("lb3_question_augmentation", f"SELECT chunk_id, content || chr(10) || chr(10) || 'Questions:' || chr(10) || '- about ' || source AS embedding_text FROM ({CHUNKS}) c JOIN documents d USING (doc_id)")
def _(spark, d):
    joined = chunks(spark, d).join(docs(spark, d).select("doc_id", "source"), "doc_id")
    return joined.select("chunk_id", F.concat("content", F.lit("\n\nQuestions:\n- about "), "source").alias("embedding_text"))


@query("lb4_even_sampling", f"SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id) AS n FROM ({SECTIONS})) WHERE pos % greatest(1, n // 5) = 0 AND pos // greatest(1, n // 5) < 5")
def _(spark, d):
    step = F.greatest(F.lit(1), F.floor(F.count("*").over(W.partitionBy("doc_id")) / 5))
    return sections(spark, d).withColumn("step", step).filter("pos % step = 0 AND floor(pos / step) < 5").select("doc_id", "pos")


@query("sc6_append_new", "SELECT doc_id, source FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, source FROM documents n WHERE doc_id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM documents o WHERE o.doc_id % 2 = 0 AND o.doc_id = n.doc_id)")
def _(spark, d):
    old, new = (docs(spark, d).filter(x).select("doc_id", "source") for x in ("doc_id % 2 = 0", "doc_id % 3 = 0"))
    return old.union(new.join(old, "doc_id", "left_anti"))


@query("sc7_upsert_registry", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS state FROM documents")
def _(spark, d):
    both = docs(spark, d).select("doc_id", F.lit("old").alias("state"), F.lit(1).alias("at")).union(docs(spark, d).filter("doc_id % 3 = 0").select("doc_id", F.lit("new"), F.lit(2)))
    last = F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("at").desc()))
    return both.withColumn("rn", last).filter("rn = 1").select("doc_id", "state")


@query("sc9_delete_document", f"SELECT chunk_id FROM ({CHUNKS}) WHERE doc_id <> 7")
def _(spark, d):
    return chunks(spark, d).filter("doc_id <> 7").select("chunk_id")


@query("sc10_validate_index", f"SELECT d.doc_id, d.n_chars = sum(length(content) + 1) - 1 AS complete FROM documents d JOIN ({SECTIONS}) s USING (doc_id) GROUP BY d.doc_id, d.n_chars")
def _(spark, d):
    actual = sections(spark, d).groupBy("doc_id").agg((F.sum(F.length("content") + 1) - 1).alias("chars"))
    return docs(spark, d).join(actual, "doc_id").select("doc_id", (F.col("n_chars") == F.col("chars")).alias("complete"))


@query("sc19_page_ranges", f"SELECT doc_id, CAST(pos // 10 AS INT) AS part, min(pos) AS first_page, max(pos) AS last_page FROM ({SECTIONS}) GROUP BY ALL")
def _(spark, d):
    return sections(spark, d).groupBy("doc_id", F.floor(F.col("pos") / 10).cast("int").alias("part")).agg(F.min("pos").alias("first_page"), F.max("pos").alias("last_page"))


@query("st1_document_list", "SELECT DISTINCT doc_id, lang, source FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", "lang", "source").distinct()


@query("st2_corpus_stats", "SELECT lang, CAST(count(*) AS BIGINT) AS n_docs, CAST(count(DISTINCT source) AS BIGINT) AS n_sources, CAST(sum(n_chars) AS BIGINT) AS chars, round(avg(n_chars), 6) AS mean_chars FROM documents GROUP BY lang")
def _(spark, d):
    return docs(spark, d).groupBy("lang").agg(F.count("*").alias("n_docs"), F.countDistinct("source").alias("n_sources"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


@query("st3_document_info", f"SELECT doc_id, CAST(length(text) AS INT) AS chars, CAST(length(text) // 5 AS BIGINT) AS words, n_sections FROM documents JOIN (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_sections FROM ({SECTIONS}) GROUP BY doc_id) USING (doc_id)")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.length("text").alias("chars"), F.floor(F.length("text") / 5).alias("words"), F.size(F.split("text", "\n")).cast("long").alias("n_sections"))


@query("j19_layer_fallback", f"SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM ({CHUNKS}) c WHERE c.doc_id = d.doc_id) THEN 3 ELSE 1 END AS layer FROM documents d")
def _(spark, d):
    layers = chunks(spark, d).select("doc_id", F.lit(3).alias("layer")).distinct().union(docs(spark, d).select("doc_id", F.lit(1)))
    return layers.groupBy("doc_id").agg(F.max("layer").alias("layer"))


@query("j4_chunk_counts", f"SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_chunks FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({CHUNKS}) GROUP BY doc_id) USING (doc_id)")
def _(spark, d):
    n = chunks(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    return docs(spark, d).select("doc_id").join(n, "doc_id", "left").fillna(0, ["n_chunks"])


@query("cx1_expand_adjacent", f"SELECT t.chunk_id AS target, c.chunk_id AS neighbour, CASE WHEN c.pos < t.pos THEN 'before' ELSE 'after' END AS side FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM ({CHUNKS})) t JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM ({CHUNKS})) c ON t.doc_id = c.doc_id AND abs(t.rn - c.rn) BETWEEN 1 AND 2")
def _(spark, d):
    order = W.partitionBy("doc_id").orderBy("pos")
    near = F.array(*[F.struct(f(F.col("chunk_id"), k).over(order).alias("neighbour"), F.lit(side).alias("side")) for f, side in ((F.lag, "before"), (F.lead, "after")) for k in (1, 2)])
    out = chunks(spark, d).select(F.col("chunk_id").alias("target"), near.alias("near"))
    return out.select("target", F.explode("near").alias("n")).select("target", "n.neighbour", "n.side").filter("neighbour IS NOT NULL")


@query("cx2_expand_section", f"SELECT chunk_id, CAST(rn AS INT) AS rank FROM (SELECT chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) AS rn FROM ({CHUNKS})) WHERE rn <= 3")
def _(spark, d):
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy("chunk_id"))
    return chunks(spark, d).select("chunk_id", rank.alias("rank")).filter("rank <= 3")
