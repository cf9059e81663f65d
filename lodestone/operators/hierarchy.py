"""Section trees (HY*, TR*, WN4, WN5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..checkpoints import settled
from ..functions.fuzzy import title_match
from ..functions.text import heading_signature, numbering_depth, repair_diacritics


def paths(nodes: DataFrame, label: str = "id", glue: str = " > ") -> DataFrame:
    """HY4, TR2: ``id, path, ancestors, depth`` of every node that hangs from a root (``id, parent``; roots have no parent).

    A level a step, as deep as the tree is, each in a checkpoint; nodes on a cycle hang from none.
    """
    level = settled(nodes.filter("parent IS NULL").select("id", F.col(label).cast("string").alias("path"), F.array().cast("array<string>").alias("ancestors"), F.lit(0).alias("depth")))
    out = level
    while not level.isEmpty():
        up = level.select(F.col("id").alias("parent"), F.col("path").alias("__path"), F.col("ancestors").alias("__above"), F.col("depth").alias("__depth"))
        down = nodes.join(up, "parent")
        level = settled(down.select("id", F.concat("__path", F.lit(glue), F.col(label).cast("string")).alias("path"), F.concat("__above", F.array(F.col("parent").cast("string"))).alias("ancestors"), (F.col("__depth") + 1).alias("depth")))
        out = out.unionByName(level)
    return out


def parents(sections: DataFrame) -> DataFrame:
    """WN5, HY8: ``parent``, the place of the nearest section before of a lower level (``doc_id, pos, level``).

    Of each level that occurs the last place so far; levels are few, whatever the number of sections.
    """
    levels = sorted(r["level"] for r in sections.select("level").distinct().collect() if r["level"] is not None)
    before = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    last = {k: F.max(F.when(F.col("level") == k, F.col("pos"))).over(before) for k in levels}
    rows = sections.withColumns({f"__last{i}": x for i, x in enumerate(last.values())})
    lower = [F.when(F.col("level") > k, F.col(f"__last{i}")) for i, k in enumerate(levels)] + [F.lit(None).cast("int")] * 2
    return rows.withColumn("parent", F.greatest(*lower)).drop(*[f"__last{i}" for i in range(len(levels))])


def fill_pages(sections: DataFrame, total: Column | None = None) -> DataFrame:
    """WN4: ``doc_id, pos, page``: a missing page lies halfway between the one before, filled in or given, and the next given one.

    With one neighbour only it has that one's page (at least 1), with none page 1; none exceeds ``total``.
    """
    after = W.partitionBy("doc_id").orderBy("pos").rowsBetween(1, W.unboundedFollowing)
    rows = sections.select("doc_id", "pos", "page", F.first("page", True).over(after).alias("next"), (F.lit(None).cast("int") if total is None else total.cast("int")).alias("total"))
    held = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "page", "next", "total"))).alias("rows"))
    zero = F.struct(F.lit(None).cast("int").alias("last"), F.array().cast("array<int>").alias("out"))

    def add(acc: Column, r: Column) -> Column:
        both = F.floor((acc["last"] + r["next"]) / 2).cast("int")
        guess = F.coalesce(both, acc["last"], F.greatest(F.lit(1), F.when(r["next"].isNotNull(), r["next"])), F.lit(1)).cast("int")
        page = F.coalesce(r["page"], F.when((r["total"] > 0) & (guess > r["total"]), r["total"]).otherwise(guess)).cast("int")
        return F.struct(page.alias("last"), F.concat(acc["out"], F.array(page)).alias("out"))

    filled = held.select("doc_id", F.explode(F.arrays_zip(F.col("rows.pos").alias("pos"), F.aggregate("rows", zero, add, lambda acc: acc["out"]).alias("page"))).alias("r"))
    return filled.select("doc_id", "r.pos", "r.page")


def page_gaps(sections: DataFrame, most: int = 1) -> DataFrame:
    """HY5: sections (``id, parent, level, page``) whose parent is missing, or far off without being two levels up."""
    up = sections.select(F.col("id").alias("parent"), F.col("level").alias("__level"), F.col("page").alias("__page"))
    joined = sections.filter("parent IS NOT NULL").join(up, "parent", "left")
    gap, step = F.abs(F.col("page") - F.col("__page")), F.col("level") - F.col("__level")
    fault = F.when(F.col("__level").isNull(), "missing parent").when((gap > most) & (step < 2), "page gap")
    return joined.select("id", "parent", fault.alias("fault"), gap.alias("gap")).filter("fault IS NOT NULL")


def flattened(nodes: DataFrame) -> DataFrame:
    """HY7: nodes (``id, parent, page``) in pre-order, children by id, then by page without changing that order; numbered from 1 a tree."""
    found = paths(nodes.select("id", "parent", F.lpad(F.col("id").cast("string"), 20, "0").alias("key")), "key", "/")
    joined = found.join(nodes.select("id", "page"), "id")
    root = F.coalesce(F.get("ancestors", F.lit(0)), F.col("id").cast("string"))
    number = F.row_number().over(W.partitionBy("root").orderBy("page", "path"))
    return joined.withColumn("root", root).select("id", "root", "depth", "page", number.alias("number"))


#: Headings of a table of contents.
CONTENTS = r"(?i)(table of contents|contents|obsah|seznam|content)"


def contents_page(pages: DataFrame) -> DataFrame:
    """HY9: of each document the first page (``doc_id, page, text``) that names a table of contents in its first 500 characters."""
    return pages.filter(F.substring("text", 1, 500).rlike(CONTENTS)).groupBy("doc_id").agg(F.min("page").alias("page"))


def _bands(zones: DataFrame) -> DataFrame:
    """``doc_id, __heads, __feet``: disjoint intervals that the zones (``doc_id, category, lo, hi``) of a document cover.

    Zones are ten pixels high at least, so a document has no more intervals than its page has room for.
    """
    order = W.partitionBy("doc_id", "category").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = zones.distinct().withColumn("opens", F.when(reach >= F.col("lo"), 0).otherwise(1))
    rows = rows.withColumn("band", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    bands = rows.groupBy("doc_id", "category", "band").agg(F.struct(F.min("lo").alias("lo"), F.max("hi").alias("hi")).alias("at"))
    return bands.groupBy("doc_id").agg(*[F.collect_list(F.when(F.col("category") == c, F.col("at"))).alias(n) for c, n in (("Header", "__heads"), ("Footer", "__feet"))])


def reclassified(elements: DataFrame) -> DataFrame:
    """HY1: ``elements`` (``doc_id, category, text, font_size, x, y_min, y_max, page_height``) with uncategorised texts judged anew.

    In this order: a header or footer by a text that one of its document has, by lying within five pixels
    of one's zone, a title by its size, marks and left edge, a header or footer by a margin and its size.
    Missing numbers count as 0; elements of other categories, or without a document, stay as they are.
    """
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    rows = elements.withColumns({"__size": number("font_size"), "__x": number("x"), "__top": number("y_min"), "__low": number("y_max"), "__high": number("page_height"), "__text": strip(F.coalesce("text", F.lit("")))})
    rows = rows.withColumn("__same", F.lower(strip(repair_diacritics(F.col("__text")))))
    size, top, high, text = F.col("__size"), F.col("__top"), F.col("__high"), F.col("__text")
    edge = F.col("category").isin("Header", "Footer")
    sized = (F.col("category") == "Title") & (size > 0)
    means = rows.groupBy("doc_id").agg(F.avg(F.when(sized, size)).alias("__title"), F.avg(F.when(sized, F.col("__x"))).alias("__left"), F.avg(F.when(edge & (size > 0), size)).alias("__edge"))
    known = rows.filter(edge & (F.col("__same") != "")).select("doc_id", "__same").distinct().withColumn("__known", F.lit(True))
    bands = _bands(rows.filter(edge & (F.col("__low") > 0)).select("doc_id", "category", (top - 5).alias("lo"), (F.col("__low") + 5).alias("hi")))
    rows = rows.join(means, "doc_id", "left").join(bands, "doc_id", "left").join(known, ["doc_id", "__same"], "left")

    middle = (top + F.col("__low")) / 2
    within = lambda c: F.exists(c, lambda b: middle.between(b["lo"], b["hi"]))
    title, left = F.col("__title"), F.col("__left")
    # Tenths: size 5, marks 3, left edge 2.
    large = F.when(size > title - 1.5, 5).otherwise(0)
    marked = F.when((heading_signature(text) != F.substring(text, 1, 20)) | (numbering_depth(text) > 0), 3).otherwise(0)
    aligned = F.when((left > 0) & (F.abs(F.col("__x") - left) < 50), 2).otherwise(0)
    small = F.coalesce(F.abs(size - F.col("__edge")) < 1.5, F.lit(False)) | F.coalesce(size < title * 0.8, F.lit(False))
    kind = (
        F.when(F.col("__known"), F.when((high > 0) & (top < high / 2), "Header").otherwise("Footer"))
        .when(within("__heads"), "Header")
        .when(within("__feet"), "Footer")
        .when(large + marked + aligned >= 5, "Title")
        .when((high > 0) & small & (top < high * 0.1), "Header")
        .when((high > 0) & small & (top > high * 0.9), "Footer")
        .otherwise(F.col("category"))
    )
    rows = rows.withColumn("category", F.when(F.col("category") == "UncategorizedText", kind).otherwise(F.col("category")))
    return rows.select(*elements.columns)


def mapped(sections: DataFrame, elements: DataFrame, ahead: int = 2) -> DataFrame:
    """HY6: ``doc_id, place, start, until, content``: the elements that belong to each section of an outline.

    ``sections`` have ``doc_id, place, title, page`` in outline order, ``elements`` ``doc_id, pos, page,
    category, text, font_size`` with ``pos`` from 0 without gaps and pages in order (null: page 1). A section
    starts at the first element from the section's before on that has its title, on its page or up to
    ``ahead`` later; else at the first such element of its page; else where the section before starts. It
    ends where the next starts. Titles are compared within those pages only, and the fold over a document
    sees positions, not texts. Sections of documents without elements are empty.
    """
    strip = lambda c: F.regexp_replace(repair_diacritics(F.coalesce(c, F.lit(""))), r"^\s+|\s+$", "")
    rows = elements.select("doc_id", "pos", F.coalesce("page", F.lit(1)).alias("page"), "category", strip(F.col("text")).alias("text"), "font_size")
    print_size = F.median(F.when(F.col("font_size") != 0, F.col("font_size")))
    pages = rows.groupBy("doc_id", "page").agg(print_size.alias("median"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    outline = sections.select("doc_id", "place", "page", strip(F.col("title")).alias("title"))

    reach = outline.filter("title <> ''").select("doc_id", "place", "title", F.explode(F.sequence("page", F.col("page") + ahead)).alias("page"))
    near = reach.join(rows.filter("text <> ''"), ["doc_id", "page"]).join(pages.select("doc_id", "page", "median"), ["doc_id", "page"])
    same = title_match(F.col("text"), F.col("title"), F.coalesce("category", F.lit("")), F.col("font_size"), F.col("median"))
    hits = near.filter(same).groupBy("doc_id", "place").agg(F.collect_set("pos").alias("hits"))

    known = outline.join(hits, ["doc_id", "place"], "left").join(pages.drop("median"), ["doc_id", "page"], "left")
    held = known.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "hits", "first", "last"))).alias("held"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))

    def step(acc: Column, s: Column) -> Column:
        titled = F.array_min(F.filter(s["hits"], lambda p: p >= acc["at"]))
        paged = F.when(s["last"] >= acc["at"], F.greatest(s["first"], acc["at"]))
        at = F.coalesce(titled, paged, acc["at"]).cast("long")
        return F.struct(at.alias("at"), F.concat(acc["starts"], F.array(at)).alias("starts"))

    starts = held.select("doc_id", F.explode(F.arrays_zip(F.col("held.place").alias("place"), F.aggregate("held", zero, step, lambda acc: acc["starts"]).alias("start"))).alias("s")).select("doc_id", "s.place", "s.start")
    total = pages.groupBy("doc_id").agg((F.max("last") + 1).alias("total"))
    following = F.lead("start").over(W.partitionBy("doc_id").orderBy("place"))
    starts = starts.join(total, "doc_id", "left").select("doc_id", "place", "start", F.coalesce(following, F.col("total").cast("long"), F.col("start")).alias("until"))

    # Of sections that start together the last one holds the elements.
    marks = starts.filter("start < until").select("doc_id", F.col("start").alias("pos"), "place", F.lit(None).cast("string").alias("text"))
    both = marks.unionByName(rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.lit(None).cast(dict(marks.dtypes)["place"]).alias("place"), "text"))
    order = W.partitionBy("doc_id").orderBy("pos", F.col("text").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    owned = both.withColumn("place", F.last("place", True).over(order)).filter("place IS NOT NULL AND text <> ''")
    texts = owned.groupBy("doc_id", "place").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "text")))["text"], "\n\n").alias("content"))
    return starts.join(texts, ["doc_id", "place"], "left").withColumn("content", F.coalesce("content", F.lit("")))
