"""Facts with validity, and the paths between entities (TG*, J17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import settled
from . import retrieval as R
from .search import best


def valid_at(start: Column, end: Column, at: Column) -> Column:
    """J17: half-open: from ``start`` on and before ``end``, if that is known."""
    return (start <= at) & (end.isNull() | (end > at))


def search_facts(queries: DataFrame, facts: DataFrame, at: Column, k: int, types: list[str] | None = None) -> DataFrame:
    """TG1: facts (``id, type, vector, text, valid_at, invalid_at``) that hold at a time, by rank fusion of vectors and words (``query_id, query, text``)."""
    now = facts.filter(valid_at(F.col("valid_at"), F.col("invalid_at"), at))
    now = now if types is None else now.filter(F.col("type").isin(types))
    near = best(queries, now.select("id", "vector"), 10 * k)
    words = R.ranked(R.sparse(queries.select("query_id", "text"), now.select("id", "text")), "score", 10 * k)
    return R.rrf(near, words, k).select("query_id", "id", "score", "rank")


def entity_facts(entities: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """TG2: every edge (``rel, src, tgt``) at an entity of this name, from its side."""
    own = entities.filter(F.lower("value") == name.lower()).select("id")
    out = edges.join(own, F.col("src") == F.col("id")).select("id", "rel", F.col("tgt").alias("other"), F.lit("out").alias("side"))
    back = edges.filter("src <> tgt").join(own, F.col("tgt") == F.col("id")).select("id", "rel", F.col("src").alias("other"), F.lit("in").alias("side"))
    return out.unionByName(back)


def hops(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """TG5: ``start, node, hops``: fewest edges from each start (``start``) to what it reaches, up to ``most`` if given, else until nothing is new."""
    links = edges.select("src", "tgt").distinct()
    step = settled(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hops")).distinct())
    seen = step
    n = 0
    while not step.isEmpty() and (most is None or n < most):
        n += 1
        step = step.join(links, F.col("node") == F.col("src")).select("start", F.col("tgt").alias("node"), F.lit(n).alias("hops")).distinct()
        step = settled(step.join(seen.select("start", "node"), ["start", "node"], "left_anti"))
        seen = seen.unionByName(step)
    return seen
