"""Text functions whose meaning needs more than one expression of SQL (TX*, MA3, PF10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fuzzy, geometry
from ..functions import text as T
from .registry import query, table
from .text import docs, sections


@query("tx3_diacritics", "SELECT doc_id, 'mimořádná zařízení ěš ' || lang AS repaired FROM documents")
def _(spark, d):
    broken = F.concat(F.lit("mimiřádná zaˇrízení eˇsˇ"), F.lit("ˇ "), "lang")
    return docs(spark, d).select("doc_id", T.repair_diacritics(broken).alias("repaired"))


LATEX_IN = r"\section{Intro \cite{a1}} \textbf{Bold} of \uv{quoted}~text \label{x}\begin{itemize}\item one \item two\end{itemize} \emph "


@query("tx7_clean_latex", "SELECT doc_id, '{Intro } Bold of \"quoted\" text • one • two ' || source AS plain FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", T.clean_latex(F.concat(F.lit(LATEX_IN), "source")).alias("plain"))


MARKED = r"regexp_replace(text, '([.!?])\s+([A-ZÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ])', '\1' || chr(1) || '\2', 'g')"


@query("tx9_sentences", f"SELECT doc_id, CAST(len(s) AS INT) AS n, s[1] AS first, s[-1] AS last FROM (SELECT doc_id, list_filter(list_transform(string_split({MARKED}, chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents)")
def _(spark, d):
    s = T.sentences(F.col("text"))
    return docs(spark, d).select("doc_id", s.alias("s")).select("doc_id", F.size("s").alias("n"), F.get("s", F.lit(0)).alias("first"), F.try_element_at("s", F.lit(-1)).alias("last"))


@query("tx11_truncate_sentence", r"""
WITH p AS (SELECT doc_id, text, string_split(regexp_replace(text, '([.!?]\s)', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents),
c AS (SELECT doc_id, text, parts, unnest(range(1, len(parts) + 1)) AS i FROM p),
f AS (SELECT doc_id, max(i) FILTER (WHERE length(array_to_string(parts[1:i], '')) // 4 <= 100) AS n FROM c GROUP BY doc_id)
SELECT doc_id, CASE WHEN length(text) // 4 <= 100 THEN text WHEN length(parts[1]) // 4 > 100 THEN left(text, 400) || '...' ELSE regexp_replace(array_to_string(parts[1:n], ''), '^\s+|\s+$', '', 'g') END AS short FROM p LEFT JOIN f USING (doc_id)""")
def _(spark, d):
    return docs(spark, d).select("doc_id", T.truncate_at_sentence(F.col("text"), 100).alias("short"))


@query("tx12_truncate_word", r"""
WITH p AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')[1:200] AS w FROM documents),
c AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM p),
f AS (SELECT doc_id, max(i) FILTER (WHERE length(array_to_string(w[1:i], ' ')) // 4 <= 30) AS n FROM c GROUP BY doc_id)
SELECT doc_id, CASE WHEN length(text) // 4 <= 30 THEN text ELSE array_to_string(w[1:coalesce(n, 0)], ' ') || '...' END AS short FROM p LEFT JOIN f USING (doc_id)""")
def _(spark, d):
    """The SQL looks at 200 words, which always exceed the budget of 30 tokens."""
    return docs(spark, d).select("doc_id", T.truncate_at_word(F.col("text"), 30).alias("short"))


@query("tx13_head_tail", r"""
WITH a AS (SELECT doc_id, text, left(text, 900) AS h, right(text, 525) AS t FROM documents),
b AS (SELECT *, greatest(CASE WHEN contains(h, chr(10)) THEN length(h) - instr(reverse(h), chr(10)) ELSE -1 END, CASE WHEN contains(h, '. ') THEN length(h) - instr(reverse(h), ' .') - 1 ELSE -1 END) AS hb,
             least(CASE WHEN contains(t, chr(10)) THEN instr(t, chr(10)) - 1 ELSE length(t) END, CASE WHEN contains(t, '. ') THEN instr(t, '. ') - 1 ELSE length(t) END) AS tb FROM a),
c AS (SELECT *, CASE WHEN hb > 720 THEN left(h, hb + 1) ELSE h END AS head, CASE WHEN tb > 0 AND tb < 0.2 * length(t) THEN regexp_replace(substr(t, tb + 2), '^\s+', '') ELSE t END AS tail FROM b)
SELECT doc_id, CASE WHEN length(text) <= 1500 THEN text ELSE head || chr(10) || chr(10) || '[...' || CAST(length(text) - length(head) - length(tail) AS VARCHAR) || ' chars truncated...]' || chr(10) || chr(10) || tail END AS summary FROM c""")
def _(spark, d):
    return docs(spark, d).select("doc_id", T.head_tail(F.col("text"), 1500).alias("summary"))


@query("tx18_fuzzy_ratio")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.round(fuzzy.fuzzy_ratio(F.substring("text", 1, 40), F.concat(F.upper("source"), F.substring("text", 5, 40))), 6).alias("ratio"))


@query("tx19_title_match")
def _(spark, d):
    rows = table(spark, d, "part")
    title = F.concat(F.col("p_name"), F.lit(" "), "p_brand")
    match = fuzzy.title_match(F.col("p_name"), title, F.when(F.col("p_size") % 2 == 0, "Title").otherwise("Text"), F.col("p_size").cast("double"), F.lit(25.0))
    return rows.select("p_partkey", match.alias("match"))


@query("tx24_parse_expansions", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text WHEN turn % 3 = 1 THEN 'doc ' || role || chr(10) || 'EXP2: second' || chr(10) || 'line' ELSE 'doc ' || role END AS hyde, CASE WHEN turn % 3 = 1 THEN text ELSE 'first' END AS exp1, CASE WHEN turn % 3 = 2 THEN text ELSE 'second' || chr(10) || 'line' END AS exp2 FROM conversations")
def _(spark, d):
    """Answers with labelled parts, of which one is missing by turn; a part goes on to the label that should follow it."""
    part = lambda k, label, body: F.when(F.col("turn") % 3 != k, F.concat(F.lit(f"{label}: "), body))
    answer = F.concat_ws("\n", F.lit("<think>HYDE: no\n</think>"), part(0, "HYDE", F.concat(F.lit("doc "), "role")), part(1, "EXP1", F.lit("first")), part(2, "EXP2", F.lit("second\nline")))
    rows = table(spark, d, "conversations").withColumn("answer", answer)
    parse = lambda label, until: T.expansion(F.col("answer"), F.col("text"), label, until)
    return rows.select("conv_id", "turn", parse("HYDE", "EXP1").alias("hyde"), parse("EXP1", "EXP2").alias("exp1"), parse("EXP2", None).alias("exp2"))


@query("tx26_formats", "SELECT o_orderkey, printf('%.1f%%', round(o_totalprice / 1000000 * 100, 1)) AS share, CASE WHEN s < 1 THEN printf('%.1fms', s * 1000) WHEN s < 60 THEN printf('%.2fs', s) WHEN s < 3600 THEN printf('%.1fm', s / 60) ELSE printf('%.1fh', s / 3600) END AS took FROM (SELECT *, o_orderkey % 7001 * 0.77013 AS s FROM orders)")
def _(spark, d):
    rows = table(spark, d, "orders")
    return rows.select("o_orderkey", T.percent(F.col("o_totalprice") / 1000000).alias("share"), T.duration(F.col("o_orderkey") % 7001 * 0.77013).alias("took"))


@query("tx27_compressed_output", r"SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'error' WHEN doc_id % 7 = 0 THEN 'needs_clarification' WHEN n_chars % 20 >= 10 THEN 'partial' ELSE 'success' END AS status, list_filter(list_transform(string_split_regex(text, '[.\n•\-*]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 20)[1:5] AS findings FROM documents")
def _(spark, d):
    error = F.when(F.col("doc_id") % 11 == 0, F.lit("boom")).otherwise("")
    answer = F.when(F.col("doc_id") % 7 == 0, F.lit("NEEDS_CLARIFICATION please")).otherwise("done")
    return docs(spark, d).select("doc_id", T.output_status(error, answer, F.col("n_chars") % 20).alias("status"), T.key_findings(F.col("text")).alias("findings"))


@query("tx29_markdown", "SELECT doc_id, string_agg(CASE WHEN title <> '' THEN repeat('#', least(level + 1, 6)) || ' ' || title || chr(10) ELSE '' END || CASE WHEN content <> '' AND content <> title THEN content || chr(10) ELSE '' END, chr(10) ORDER BY pos) AS md, arg_min(title, pos) FILTER (WHERE level = 0 AND title <> '') AS title FROM (SELECT doc_id, pos, content, left(content, 30) AS title, CAST(pos % 8 AS INT) AS level FROM (SELECT doc_id, CAST(pos AS INT) AS pos, part AS content FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents))) GROUP BY doc_id")
def _(spark, d):
    rows = sections(spark, d).select("doc_id", "pos", "content", F.substring("content", 1, 30).alias("title"), (F.col("pos") % 8).alias("level"))
    parts = F.array_sort(F.collect_list(F.struct("pos", T.markdown(F.col("title"), F.col("level"), F.col("content")).alias("md"))))
    title = F.min_by(F.when((F.col("level") == 0) & (F.col("title") != ""), F.col("title")), F.when((F.col("level") == 0) & (F.col("title") != ""), F.col("pos")))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["md"]), "\n").alias("md"), title.alias("title"))


@query("tx31_field_fallbacks", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN nullif('', '') ELSE event_type END, 'u' || user_id) AS document, CASE WHEN event_id % 5 = 0 THEN CAST(user_id AS INT) WHEN event_id % 5 = 1 THEN NULL ELSE CAST(event_id % 5 AS INT) END AS page FROM events")
def _(spark, d):
    e = F.col("event_id")
    document = T.first_field(F.when(e % 3 == 2, F.col("event_type")).when(e % 3 == 1, ""), F.concat(F.lit("u"), F.col("user_id").cast("string")))
    page = T.page_number(F.when(e % 5 == 1, F.lit("x1")).otherwise((e % 5).cast("string")), F.col("user_id"))
    return table(spark, d, "events").select("event_id", document.alias("document"), page.alias("page"))


BOX = "SELECT p_partkey, CAST(p_size % 9 - 4 AS DOUBLE) AS dx, CAST(p_partkey % 7 - 3 AS DOUBLE) AS dy FROM part"
ANGLE = f"SELECT p_partkey, dx, dy, CASE WHEN dx = 0 AND dy = 0 THEN 0.0 ELSE CASE WHEN atan2(dy, dx) < 0 THEN degrees(atan2(dy, dx)) + 360 ELSE degrees(atan2(dy, dx)) END END AS a FROM ({BOX})"
UPRIGHT = "a <= 25 OR a >= 335 OR a BETWEEN 65 AND 115 OR a BETWEEN 155 AND 205 OR a BETWEEN 245 AND 295"


def boxes(spark, d):
    x, y = F.col("p_size") % 9 - 4, F.col("p_partkey") % 7 - 3
    point = lambda a, b: F.array(a.cast("double"), b.cast("double"))
    return table(spark, d, "part").select("p_partkey", F.array(point(F.lit(10), F.lit(20)), point(x + 10, y + 20)).alias("points"))


@query("ma3_box_angle", f"SELECT p_partkey, round(a, 6) AS angle, NOT ({UPRIGHT}) AS rotated FROM ({ANGLE})")
def _(spark, d):
    a = geometry.angle(F.col("points"))
    return boxes(spark, d).select("p_partkey", F.round(a, 6).alias("angle"), geometry.rotated(a).alias("rotated"))


@query("pf10_rotated_drop", f"SELECT p_partkey FROM ({ANGLE}) WHERE {UPRIGHT} OR NOT (a BETWEEN 25 AND 65 OR 360 - a BETWEEN 25 AND 65)")
def _(spark, d):
    return boxes(spark, d).filter(~geometry.watermark(F.col("points"))).select("p_partkey")
