"""Outlines of documents from their elements: who is whose parent, and who adopts the orphans (HY2, HY3)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import heading_signature, numbering_depth

TITLE, ITEM, TEXT, EDGE, OTHER = 0, 1, 2, 3, 4
KINDS = {"Title": TITLE, "ListItem": ITEM, "NarrativeText": TEXT, "UncategorizedText": TEXT, "Header": EDGE, "Footer": EDGE}
REACH = 20  #: ancestors that are looked at for one of the same mark
SIZE = 0.5  #: font sizes closer than this are one


class _Document:
    """One document's elements as arrays by place; ``parent`` is filled in from the first element to the last."""

    def __init__(self, kind: list[int], up: list[int], mark: list[int], depth: list[int], size: list[float], page: list[int | None]) -> None:
        self.kind, self.up, self.mark, self.depth, self.size, self.page = kind, up, mark, depth, size, page
        self.parent = [-1] * len(kind)

    def same_mark(self, a: int, b: int) -> bool:
        return self.mark[a] != 0 and self.mark[a] == self.mark[b]

    def outranks(self, child: int, other: int) -> bool:
        """Both have a numbering, and the child's is no deeper."""
        return 0 < self.depth[child] <= self.depth[other]

    def cousin(self, child: int, start: int, step: list[int]) -> int:
        """The nearest of the ancestors from ``start`` on that is of the child's kind and mark; -1 if none is near."""
        at = start
        for _ in range(REACH):
            if at < 0:
                break
            if self.kind[at] == self.kind[child] and self.same_mark(child, at):
                return at
            at = step[at]
        return -1

    def climb(self, child: int) -> int:
        """HY2: the nearest given ancestor that may be the child's parent."""
        at = self.up[child]
        for _ in range(len(self.kind)):  # given parents may form a circle
            if at < 0:
                return -1
            if self.kind[at] in (TITLE, ITEM):
                if self.kind[at] != self.kind[child]:
                    return at
                beside = self.outranks(child, at) or self.same_mark(child, at) or (self.size[at] > 0 and self.size[child] >= self.size[at] - SIZE)
                if not beside:
                    start = self.parent[at] if self.parent[at] >= 0 else self.up[at]
                    kin = self.cousin(child, start, self.up) if self.mark[child] else -1
                    if kin < 0:
                        return at
                    at = kin
            at = self.up[at]
        return -1

    def adopter(self, child: int, title: int) -> int:
        """HY3: whether the last title takes the orphan, its own parent does, or none."""
        if self.kind[child] != TITLE:
            return title
        if self.depth[child] > 0 and self.depth[title] > 0:
            return self.parent[title] if self.outranks(child, title) else title
        if self.same_mark(child, title):
            return self.parent[title]
        if self.size[child] > self.size[title] + SIZE:
            return -1
        kin = self.cousin(child, self.parent[title], self.parent) if self.mark[child] else -1
        return title if kin < 0 else self.parent[kin]

    def level(self, at: int) -> int:
        seen: set[int] = set()
        at = self.parent[at]
        while at >= 0 and at not in seen:
            seen.add(at)
            at = self.parent[at]
        return len(seen)

    def resolve(self) -> list[int]:
        """All parents, then orphans in reading order; the levels."""
        for i, kind in enumerate(self.kind):
            if kind != EDGE:
                self.parent[i] = self.climb(i)
        levels = [-1] * len(self.kind)
        titles: dict[int, int] = {}
        items: dict[int, int] = {}
        page = None
        for i, kind in enumerate(self.kind):
            if kind == EDGE:
                continue
            page = page if self.page[i] is None else self.page[i]
            if self.parent[i] < 0 and page is not None:
                if kind == TEXT and i:
                    before = self.kind[i - 1]
                    self.parent[i] = i - 1 if before == TITLE else self.parent[i - 1] if before == ITEM else -1
                elif kind == ITEM and page - 1 in items:
                    self.parent[i] = self.parent[items[page - 1]]
                title = titles.get(page, titles.get(page - 1, -1))
                if self.parent[i] < 0 <= title:
                    self.parent[i] = self.adopter(i, title)
            if page is not None and kind in (TITLE, ITEM):
                (titles if kind == TITLE else items)[page] = i
            levels[i] = self.level(i)
        return levels


def _resolved(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("pos")
    pos = rows.column("pos").to_numpy()
    up = rows.column("up").fill_null(-1).to_numpy()
    at = np.searchsorted(pos, up)
    at = np.where((up >= 0) & (at < len(pos)) & (pos[np.minimum(at, len(pos) - 1)] == up), at, -1)
    column = lambda name: rows.column(name).to_pylist()
    document = _Document(column("kind"), at.tolist(), column("mark"), column("depth"), column("size"), column("page"))
    levels = document.resolve()
    keep = np.flatnonzero(np.array(document.kind) != EDGE)
    parent = np.array(document.parent)[keep]
    above = pa.array(pos[np.maximum(parent, 0)], mask=parent < 0)
    return pa.table({"doc_id": rows.column("doc_id").take(pa.array(keep)), "pos": pos[keep], "parent_pos": above, "level": np.array(levels)[keep]})


def outlined(elements: DataFrame) -> DataFrame:
    """HY2, HY3: ``doc_id, pos, id, parent, level`` of all elements but headers and footers.

    ``elements`` have ``doc_id, pos, id, parent, page, category, text, font_size``; ``parent`` is the id that
    layout analysis gave. A parent is the nearest given ancestor that is a title or list item and, for an
    element of its own kind, ranks above it: by numbering, mark and font size, and by having no ancestor of
    the child's mark. An orphan goes to the item or title before it, to the list of the page before, or
    to the last title of its page or the one before, whichever its kind and rank allow.

    Spark derives each element's features and finds its given parent's place; a document's features, some
    ten bytes each and no texts, are then walked in order by one task, as each step needs those before
    it. Of equal ids in a document the last place counts. A missing page is the last one given before;
    null texts have no mark; an unknown given parent is none; circles of given parents have none;
    elements without a document are left out; an empty table gives no rows.
    """
    category = F.coalesce("category", F.lit(""))
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    marked = category.isin("Title", "ListItem")
    text = F.coalesce("text", F.lit(""))
    signature = F.when(marked, heading_signature(text)).otherwise("")
    rows = elements.select(
        "doc_id",
        F.col("pos").cast("long").alias("pos"),
        "id",
        F.col("parent").alias("given"),
        F.coalesce(F.element_at(kinds, category), F.lit(OTHER)).alias("kind"),
        F.when(signature == "", 0).otherwise(F.xxhash64(signature)).cast("long").alias("mark"),
        F.when(marked, numbering_depth(text)).otherwise(0).alias("depth"),
        F.coalesce(F.col("font_size").cast("double"), F.lit(0.0)).alias("size"),
        F.col("page").cast("int").alias("page"),
    )
    places = rows.groupBy("doc_id", F.col("id").alias("given")).agg(F.max("pos").alias("up"))
    features = rows.join(places, ["doc_id", "given"], "left").select("doc_id", "pos", "up", "kind", "mark", "depth", "size", "page")
    schema = T.StructType([features.schema["doc_id"], *[T.StructField(x, T.LongType()) for x in ("pos", "parent_pos", "level")]])
    found = features.groupBy("doc_id").applyInArrow(_resolved, schema)
    names = rows.select("doc_id", "pos", "id")
    above = names.select("doc_id", F.col("pos").alias("parent_pos"), F.col("id").alias("parent"))
    return found.join(names, ["doc_id", "pos"]).join(above, ["doc_id", "parent_pos"], "left").select("doc_id", "pos", "id", "parent", "level")
