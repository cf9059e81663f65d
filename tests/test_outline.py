"""Outlines against a recursive walk over random elements, and hand-made pages."""

import random

import pytest

from lodestone.functions import text as T
from lodestone.operators import outline

SCHEMA = "doc_id string, pos int, id string, parent string, page int, category string, text string, font_size double, level string"


def marks(spark, texts):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", T.heading_signature(F.col("t")).alias("s"), T.numbering_depth(F.col("t")).alias("d")).collect()
    return {r.t: (r.s, r.d) for r in rows}


def brute(elements, known):
    """Places and levels by recursion over the rules, one after the other."""
    at = {e["id"]: i for i, e in enumerate(elements)}
    edge = lambda e: e["category"] in ("Header", "Footer")
    listed = lambda e: e["category"] in ("Title", "ListItem")
    sign = lambda e: known[e["text"] or ""][0] if listed(e) else ""
    depth = lambda e: known[e["text"] or ""][1] if listed(e) else 0
    size = lambda e: e["font_size"] or 0.0
    parent = [None] * len(elements)

    def valid(pid, child):
        if pid not in at:
            return None
        p = elements[at[pid]]
        if edge(p) or not listed(p):
            return valid(p["parent"], child)
        if p["category"] == child["category"]:
            if depth(child) and depth(p) and depth(child) <= depth(p):
                return valid(p["parent"], child)
            if sign(child) and sign(child) == sign(p):
                return valid(p["parent"], child)
            if size(p) > 0 and size(child) >= size(p) - 0.5:
                return valid(p["parent"], child)
            up, left = parent[at[pid]] or p["parent"], 20
            while sign(child) and up in at and left:
                a = elements[at[up]]
                if a["category"] == child["category"] and sign(a) == sign(child):
                    return valid(a["parent"], child)
                up, left = a["parent"], left - 1
        return pid

    for i, e in enumerate(elements):
        if not edge(e):
            parent[i] = valid(e["parent"], e)
    titles, items, page, out = {}, {}, None, []

    def level(pid, seen):
        if pid is None or pid in seen:
            return 0
        return level(parent[at[pid]], seen | {pid}) + 1

    for i, e in enumerate(elements):
        if edge(e):
            continue
        page = e["page"] if e["page"] is not None else page
        if parent[i] is None and page is not None:
            before = elements[i - 1] if i else None
            if e["category"] in ("NarrativeText", "UncategorizedText") and before:
                if before["category"] == "ListItem":
                    parent[i] = parent[i - 1]
                elif before["category"] == "Title":
                    parent[i] = before["id"]
            if e["category"] == "ListItem" and page - 1 in items:
                parent[i] = parent[at[items[page - 1]]]
            title = titles.get(page) or titles.get(page - 1)
            if parent[i] is None and title:
                t = elements[at[title]]
                if e["category"] != "Title":
                    parent[i] = title
                elif depth(e) and depth(t):
                    parent[i] = parent[at[title]] if depth(e) <= depth(t) else title
                elif sign(e) and sign(e) == sign(t):
                    parent[i] = parent[at[title]]
                elif size(e) <= size(t) + 0.5:
                    up, left, found = parent[at[title]], 20, False
                    while sign(e) and up in at and left and not found:
                        a = elements[at[up]]
                        found = a["category"] == "Title" and sign(a) == sign(e)
                        up, left = parent[at[up]], left - 1
                    parent[i] = up if found else title
        if page is not None and e["category"] == "Title":
            titles[page] = e["id"]
        elif page is not None and e["category"] == "ListItem":
            items[page] = e["id"]
        out.append((e["pos"], e["id"], parent[i], level(parent[i], frozenset())))
    return out


WORDS = ["1. Scope", "1.1 Terms", "1.1.1 More", "2. Use", "Article 1", "Article 2", "Part A", "Chapter 3", "a) first", "b) second", "(1) x", "plain words", "other words", "", None]


@pytest.mark.parametrize("seed", range(3))
def test_against_a_recursive_walk(spark, seed):
    pick = random.Random(seed)
    rows, wanted = [], set()
    known = marks(spark, [x or "" for x in WORDS])
    for d in range(25):
        n, elements, page = pick.randrange(1, 60), [], 1
        for pos in range(n):
            page += pick.random() < 0.15
            category = pick.choice(["Title", "Title", "Title", "ListItem", "ListItem", "NarrativeText", "UncategorizedText", "Header", "Footer", "Table", None])
            up = None if pick.random() < 0.35 or not pos else f"e{pick.randrange(max(0, pos - 6), pos)}" if pick.random() < 0.95 else "gone"
            elements.append({"doc_id": f"d{d}", "pos": pos, "id": f"e{pos}", "parent": up, "page": None if pick.random() < 0.1 else page, "category": category, "text": pick.choice(WORDS), "font_size": pick.choice([None, 9.0, 10.0, 12.0, 14.0])})
        rows += [(*e.values(), "clash") for e in elements]
        wanted |= {(f"d{d}", *x) for x in brute(elements, known)}
    pick.shuffle(rows)
    found = outline.outlined(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {tuple(r) for r in found} == wanted and len(found) == len(wanted)


def test_a_list_that_goes_on_over_the_page(spark):
    rows = [("d", 0, "t", None, 1, "Title", "1. Scope", 12.0), ("d", 1, "a", "t", 1, "ListItem", "a) first", 10.0), ("d", 2, "h", None, 2, "Header", "head", 8.0), ("d", 3, "b", None, 2, "ListItem", "b) second", 10.0), ("d", 4, "n", None, 2, "NarrativeText", "text", 10.0), ("d", 5, "u", None, 2, "Title", "2. Use", 12.0)]
    found = outline.outlined(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    assert {r.id: (r.parent, r.level) for r in found} == {"t": (None, 0), "a": ("t", 1), "b": ("t", 1), "n": ("t", 1), "u": (None, 0)}


def test_circles_nulls_and_nothing(spark):
    rows = [("d", 0, "a", "b", 1, "NarrativeText", "x", 1.0, "x"), ("d", 1, "b", "a", 1, "NarrativeText", "x", 1.0, "x"), (None, 0, "a", None, None, None, None, None, None)]
    assert sorted((r.id, r.parent, r.level) for r in outline.outlined(spark.createDataFrame(rows, SCHEMA)).collect()) == [("a", None, 0), ("b", None, 0)]
    assert outline.outlined(spark.createDataFrame([], SCHEMA)).count() == 0
