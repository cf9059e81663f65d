"""Chunking and hierarchy over lines of documents and the star schema (WN4, WN5, WN9, CH3, CH4, HY*)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import chunking, hierarchy, outline
from .documents import TREE, tree
from .registry import query, table
from .text import SECTIONS, docs, sections


def starts(spark, d):
    before = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    return sections(spark, d).withColumn("char_start", F.coalesce(F.sum(F.length("content") + 2).over(before), F.lit(0)))


@query("wn9_pack_sentences")
def _(spark, d):
    from ..functions.text import sentences

    return docs(spark, d).select("doc_id", chunking.pack(sentences(F.col("text")), 64).alias("chunks"))


@query("ch3_layer3_chunks")
def _(spark, d):
    return chunking.layer3(starts(spark, d))


@query("ch4_layers", f"WITH l AS (SELECT doc_id, pos, 1 + pos % 4 AS depth, CASE WHEN pos % 3 = 0 THEN 3 ELSE 1 + pos % 2 END AS layer FROM ({SECTIONS})), m AS (SELECT doc_id, max(depth) AS deepest FROM l GROUP BY doc_id) SELECT l.doc_id, pos, layer FROM l JOIN m USING (doc_id) WHERE layer = 3 OR deepest > 1")
def _(spark, d):
    layer = F.when(F.col("pos") % 3 == 0, 3).otherwise(1 + F.col("pos") % 2)
    return chunking.layers_of(sections(spark, d).select("doc_id", "pos", (1 + F.col("pos") % 4).alias("depth"), layer.alias("layer"))).select("doc_id", "pos", "layer")


PLACE = "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT)"
LEVELS = f"SELECT l_orderkey, {PLACE} AS l_linenumber, l_partkey % 9 AS level FROM lineitem"


def placed(spark, d):
    """Lines of an order with their place in it."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, d, "lineitem").withColumn("place", F.row_number().over(order))


@query("wn5_hy8_parent", f"SELECT c.l_orderkey AS doc_id, c.l_linenumber AS pos, (SELECT max(p.l_linenumber) FROM ({LEVELS}) p WHERE p.l_orderkey = c.l_orderkey AND p.l_linenumber < c.l_linenumber AND p.level < c.level) AS parent FROM ({LEVELS}) c")
def _(spark, d):
    rows = placed(spark, d).select(F.col("l_orderkey").alias("doc_id"), F.col("place").alias("pos"), (F.col("l_partkey") % 9).alias("level"))
    return hierarchy.parents(rows).select("doc_id", "pos", "parent")


PAGES = f"SELECT l_orderkey AS doc_id, {PLACE} AS pos, CASE WHEN l_partkey % 3 = 0 THEN l_linenumber * 3 ELSE NULL END AS page FROM lineitem"


@query("wn4_fill_pages", f"WITH RECURSIVE p AS MATERIALIZED (SELECT *, (SELECT arg_min(q.page, q.pos) FROM ({PAGES}) q WHERE q.doc_id = t.doc_id AND q.pos > t.pos AND q.page IS NOT NULL) AS nxt FROM ({PAGES}) t), f(doc_id, pos, page) AS (SELECT doc_id, pos, coalesce(page, least(15, coalesce(greatest(1, nxt), 1))) FROM p WHERE pos = 1 UNION ALL SELECT p.doc_id, p.pos, coalesce(p.page, least(15, CASE WHEN p.nxt IS NULL THEN f.page ELSE (f.page + p.nxt) // 2 END)) FROM f JOIN p ON p.doc_id = f.doc_id AND p.pos = f.pos + 1) SELECT doc_id, pos, CAST(page AS INT) AS page FROM f")
def _(spark, d):
    """Pages that one line in three has; a page that is filled in is the neighbour of the next."""
    rows = placed(spark, d).select(F.col("l_orderkey").alias("doc_id"), F.col("place").alias("pos"), F.when(F.col("l_partkey") % 3 == 0, F.col("l_linenumber") * 3).alias("page"))
    return hierarchy.fill_pages(rows, F.lit(15))


@query("hy4_ancestors", f"WITH RECURSIVE t AS ({TREE}), p(id, path, depth) AS (SELECT id, id, 0 FROM t WHERE parent IS NULL UNION ALL SELECT t.id, p.path || ' > ' || t.id, p.depth + 1 FROM t JOIN p ON t.parent = p.id) SELECT id, path, depth FROM p")
def _(spark, d):
    return hierarchy.paths(tree(spark, d)).select("id", "path", "depth")


PAGED = f"SELECT id, parent, CASE split_part(id, ':', 1) WHEN 'region' THEN 0 WHEN 'nation' THEN 1 ELSE 2 END AS level, CAST(split_part(id, ':', 2) AS INT) % 7 AS page FROM ({TREE}) WHERE id <> 'nation:4'"


def paged(spark, d):
    kind, number = (F.split("id", ":")[i] for i in (0, 1))
    level = F.when(kind == "region", 0).when(kind == "nation", 1).otherwise(2)
    return tree(spark, d).filter("id <> 'nation:4'").select("id", "parent", level.alias("level"), (number.cast("int") % 7).alias("page"))


@query("hy5_page_gaps", f"WITH s AS ({PAGED}) SELECT c.id, c.parent, CASE WHEN p.id IS NULL THEN 'missing parent' ELSE 'page gap' END AS fault, abs(c.page - p.page) AS gap FROM s c LEFT JOIN s p ON p.id = c.parent WHERE c.parent IS NOT NULL AND (p.id IS NULL OR (abs(c.page - p.page) > 1 AND c.level - p.level < 2))")
def _(spark, d):
    return hierarchy.page_gaps(paged(spark, d))


@query("hy7_flattened", f"WITH RECURSIVE s AS (SELECT id, parent, CAST(split_part(id, ':', 2) AS INT) % 7 AS page FROM ({TREE})), p(id, root, path, depth, page) AS (SELECT id, id, lpad(id, 20, '0'), 0, page FROM s WHERE parent IS NULL UNION ALL SELECT s.id, p.root, p.path || '/' || lpad(s.id, 20, '0'), p.depth + 1, s.page FROM s JOIN p ON s.parent = p.id) SELECT id, root, depth, page, CAST(row_number() OVER (PARTITION BY root ORDER BY page, path) AS INT) AS number FROM p")
def _(spark, d):
    number = F.split("id", ":")[1].cast("int")
    return hierarchy.flattened(tree(spark, d).select("id", "parent", (number % 7).alias("page")))


@query("hy9_contents_page", "SELECT conv_id AS doc_id, min(turn) AS page FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN 'Obsah: ' || text ELSE left(text, 490) || ' table OF contents' END AS text FROM conversations) WHERE regexp_matches(left(text, 500), '(?i)(table of contents|contents|obsah|seznam|content)') GROUP BY conv_id")
def _(spark, d):
    text = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("Obsah: "), "text")).otherwise(F.concat(F.substring("text", 1, 490), F.lit(" table OF contents")))
    return hierarchy.contents_page(table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), text.alias("text")))


ELEMENTS = f"""SELECT l_orderkey AS doc_id, {PLACE} AS pos, CASE l_partkey % 8 WHEN 0 THEN 'Title' WHEN 1 THEN 'Header' WHEN 2 THEN 'Footer' ELSE 'UncategorizedText' END AS category,
CASE l_partkey % 5 WHEN 0 THEN '1.2 Scope' WHEN 1 THEN 'page ' || l_suppkey ELSE 'some words ' || l_partkey END AS text,
8.0 + l_suppkey % 7 AS font_size, l_partkey % 5 * 30.0 AS x, l_partkey % 83 * 10.0 AS y_min, l_partkey % 83 * 10.0 + 10 AS y_max, 842.0 AS page_height FROM lineitem"""


@query(
    "hy1_reclassified",
    f"""WITH e AS ({ELEMENTS}),
m AS (SELECT doc_id, avg(font_size) FILTER (category = 'Title') AS t, avg(x) FILTER (category = 'Title') AS l, avg(font_size) FILTER (category IN ('Header', 'Footer')) AS h FROM e GROUP BY doc_id),
near AS (SELECT e.doc_id, e.pos, bool_or(z.text = e.text) AS same, bool_or(z.category = 'Header' AND (e.y_min + e.y_max) / 2 BETWEEN z.y_min - 5 AND z.y_max + 5) AS head,
         bool_or(z.category = 'Footer' AND (e.y_min + e.y_max) / 2 BETWEEN z.y_min - 5 AND z.y_max + 5) AS foot FROM e JOIN e z ON z.doc_id = e.doc_id AND z.category IN ('Header', 'Footer') GROUP BY e.doc_id, e.pos),
s AS (SELECT e.*, m.t, m.h, coalesce(same, false) AS same, coalesce(head, false) AS head, coalesce(foot, false) AS foot,
         CASE WHEN abs(font_size - t) < 1.5 OR font_size > t THEN 0.5 ELSE 0 END + CASE WHEN text = '1.2 Scope' THEN 0.3 ELSE 0 END + CASE WHEN l > 0 AND abs(x - l) < 50 THEN 0.2 ELSE 0 END AS score
      FROM e JOIN m USING (doc_id) LEFT JOIN near USING (doc_id, pos))
SELECT doc_id, pos, CASE WHEN category <> 'UncategorizedText' THEN category WHEN same THEN CASE WHEN y_min < 421 THEN 'Header' ELSE 'Footer' END WHEN head THEN 'Header' WHEN foot THEN 'Footer' WHEN score >= 0.5 THEN 'Title'
       WHEN (y_min < 84.2 OR y_min > 757.8) AND (coalesce(abs(font_size - h) < 1.5, false) OR coalesce(font_size < 0.8 * t, false)) THEN CASE WHEN y_min < 84.2 THEN 'Header' ELSE 'Footer' END ELSE category END AS category FROM s""",
)
def _(spark, d):
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    category = F.when(part % 8 == 0, "Title").when(part % 8 == 1, "Header").when(part % 8 == 2, "Footer").otherwise("UncategorizedText")
    text = F.when(part % 5 == 0, "1.2 Scope").when(part % 5 == 1, F.concat(F.lit("page "), supplier)).otherwise(F.concat(F.lit("some words "), part))
    y = part % 83 * 10.0
    rows = placed(spark, d).select(F.col("l_orderkey").alias("doc_id"), F.col("place").alias("pos"), category.alias("category"), text.alias("text"), (8.0 + supplier % 7).alias("font_size"), (part % 5 * 30.0).alias("x"), y.alias("y_min"), (y + 10).alias("y_max"), F.lit(842.0).alias("page_height"))
    return hierarchy.reclassified(rows).select("doc_id", "pos", "category")


@query("hy6_mapped_sections")
def _(spark, d):
    """Lines of an order, two a page, under an outline that names every third part, up to two pages early."""
    rows = placed(spark, d).select(F.col("l_orderkey").alias("doc_id"), (F.col("place") - 1).alias("pos"), F.floor((F.col("place") + 1) / 2).cast("int").alias("page"), F.lit("Title").alias("category"), F.concat(F.lit("Line "), F.col("l_partkey")).alias("text"), F.lit(10.0).alias("font_size"), "l_partkey", "l_suppkey")
    outline = rows.filter("l_partkey % 3 = 0").select("doc_id", F.col("pos").alias("place"), F.lower("text").alias("title"), F.greatest(F.lit(1), F.col("page") - (F.col("l_suppkey") % 3).cast("int")).alias("page"))
    return hierarchy.mapped(outline, rows)


@query("hy2_hy3_outline")
def _(spark, d):
    """Lines of documents as elements: numbered, bulleted and short ones as titles and items, their given parents one to three lines up."""
    line = F.regexp_replace("content", r"^\s+|\s+$", "")
    size = F.length(line)
    category = (
        F.when(F.col("pos") % 17 == 16, "Header")
        .when(line.rlike(r"^([a-z]\)|[-*•])\s") | (size % 7 == 3), "ListItem")
        .when(line.rlike(r"^[\d.]+\s") | ((size > 0) & (size < 60)) | (size % 5 == 0), "Title")
        .otherwise("NarrativeText")
    )
    key = lambda pos: F.concat(F.col("doc_id").cast("string"), F.lit(":"), pos.cast("string"))
    given = F.when(size % 4 > 0, key(F.col("pos") - size % 4))
    rows = sections(spark, d).select("doc_id", "pos", key(F.col("pos")).alias("id"), given.alias("parent"), (F.floor(F.col("pos") / 20) + 1).cast("int").alias("page"), category.alias("category"), line.alias("text"), (9.0 + size % 6).alias("font_size"))
    return outline.outlined(rows)
