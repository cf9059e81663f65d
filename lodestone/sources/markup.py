"""Documents as typed elements and sections (SC2, SC3, SC16)."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.text import clean_latex

# What an HTML block is called as an element.
CATEGORY = {"h1": "Title", "h2": "Title", "h3": "Title", "h4": "Title", "h5": "Title", "h6": "Title", "li": "ListItem", "p": "NarrativeText", "table": "Table", "header": "Header", "footer": "Footer"}
BLOCK = re.compile(r"<(h[1-6]|li|p|table|header|footer)\b[^>]*>(.*?)(?=</\1\s*>|<(?:h[1-6]|li|p|table|header|footer)\b|\Z)", re.S | re.I)


ELEMENTS = ArrayType(StructType([StructField("category", StringType()), StructField("text", StringType())]))


@F.pandas_udf(ELEMENTS)
def html_elements(pages: pd.Series) -> pd.Series:
    """SC2: blocks of a page in order, each with its category; blocks without text are left out."""
    import html

    def one(page: str | None) -> list[dict]:
        page = re.sub(r"(?is)<(script|style)\b.*?(</\1\s*>|\Z)|<!--.*?(-->|\Z)", " ", page or "")
        found = ((m[1].lower(), " ".join(html.unescape(re.sub(r"<[^>]*>", " ", m[2])).split())) for m in BLOCK.finditer(page))
        return [{"category": CATEGORY[k], "text": t} for k, t in found if t]

    return pages.map(one)


def plain_elements(text: Column) -> Column:
    """SC2: paragraphs of plain text as ``category, text``: list items by their mark, titles by being short and without a full stop."""
    parts = F.filter(F.transform(F.split(text, r"\n+"), lambda x: F.trim(x)), lambda x: x != "")
    kind = lambda x: F.when(x.rlike(r"^([-*•]|\d+[.)])\s"), "ListItem").when((F.length(x) <= 60) & ~x.rlike(r"[.!?:;,]$"), "Title").otherwise("NarrativeText")
    return F.transform(parts, lambda x: F.struct(kind(x).alias("category"), x.alias("text")))


def elements(rows: DataFrame, found: Column) -> DataFrame:
    """SC2: ``doc_id, pos, category, text``, one row an element."""
    return rows.select("doc_id", F.posexplode(found).alias("pos", "e")).select("doc_id", "pos", "e.category", "e.text")


# Commands that open a section, from the highest.
SECTIONS = ("chapter", "section", "subsection", "subsubsection", "paragraph")
LINES = 20


def latex_sections(rows: DataFrame) -> DataFrame:
    """SC3: ``doc_id, line, level, type, title, content, char_start`` of LaTeX (``doc_id, text``).

    A section's content is the first 20 lines up to the next section.
    """
    each = rows.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    opened = [F.regexp_extract("body", rf"\\{name}\*?\{{([^}}]+)\}}", 1) for name in SECTIONS]
    level = F.coalesce(*[F.when(x != "", F.lit(i)) for i, x in enumerate(opened)])
    title = F.coalesce(*[F.nullif(x, F.lit("")) for x in opened])
    by = W.partitionBy("doc_id").orderBy("line")
    marked = each.withColumns({"level": level, "title": title, "char_start": F.coalesce(F.sum(F.length("body") + 1).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    marked = marked.withColumn("head", F.last(F.when(F.col("level").isNotNull(), F.col("line")), True).over(by)).filter("head IS NOT NULL")
    body = F.transform(F.array_sort(F.collect_list(F.when((F.col("line") > F.col("head")) & (F.col("line") <= F.col("head") + LINES), F.struct("line", "body")))), lambda x: x["body"])
    first = lambda c: F.max(F.when(F.col("line") == F.col("head"), F.col(c))).alias(c)
    found = marked.groupBy("doc_id", F.col("head").alias("line")).agg(first("level"), first("title"), first("char_start"), F.array_join(body, "\n").alias("content"))
    kind = F.element_at(F.array(*[F.lit(x) for x in SECTIONS]), F.col("level") + 1)
    return found.select("doc_id", "line", "level", kind.alias("type"), clean_latex(F.col("title")).alias("title"), clean_latex(F.col("content")).alias("content"), "char_start")


def _closed(text: str) -> str | None:
    """Truncated JSON cut after its last whole value, its open brackets closed."""
    stack, in_string, escape, ends = [], False, False, []
    for i, c in enumerate(text):
        if in_string:
            escape = c == "\\" and not escape
            if c == '"' and not escape:
                in_string = False
            if c != "\\":
                escape = False
        elif c == '"':
            in_string = True
        elif c in "[{":
            stack.append(c)
        elif c in "]}":
            if not stack:
                return None
            stack.pop()
            ends.append((i + 1, "".join(stack)))
        elif c == ",":
            ends.append((i, "".join(stack)))
    for end, left in reversed(ends):
        whole = text[:end] + "".join("]" if c == "[" else "}" for c in reversed(left))
        try:
            json.loads(whole)
        except ValueError:
            continue
        return whole
    return None


@F.pandas_udf(StringType())
def repaired_json(answers: pd.Series) -> pd.Series:
    """SC16: JSON as it stands, else the fenced or the outermost object in it, else that without trailing commas, else cut at its last whole value; null if nothing helps."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        fenced = re.search(r"```(?:json)?\s*(.*?)(?:```|\Z)", text, re.S)
        start = re.search(r"[\[{]", text)
        tries = [text, fenced[1] if fenced else None, text[start.start() : max(text.rfind("}"), text.rfind("]")) + 1] if start else None]
        tries += [re.sub(r",\s*([\]}])", r"\1", x) for x in tries if x]
        tries.append(_closed((fenced[1] if fenced else text)[start.start() if start and not fenced else 0 :]))
        for x in tries:
            try:
                if x and isinstance(json.loads(x), (dict, list)):
                    return x
            except ValueError:
                continue
        return None

    return answers.map(one)
