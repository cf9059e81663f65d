"""Dense and sparse retrieval, fusion and context over frames of queries (VS*, FT*, FU*, TK*, CX*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import vectors as V
from ..functions.text import tokenize, words
from .search import best

QUERY_BYTES = 8 << 20  #: vectors or words of queries that are sent out at a time
LAYER_K = {1: 1, 2: 3, 3: 6}  #: results of each layer


def blocks(queries: DataFrame, row_bytes: int) -> list[DataFrame]:
    """A stated query set as broadcast blocks of about ``QUERY_BYTES``, by its counted rows; every query is in one."""
    n = -(-queries.count() * row_bytes // QUERY_BYTES) or 1
    if n == 1:
        return [F.broadcast(queries)]
    return [F.broadcast(queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i)) for i in range(n)]


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def ranked(scored: DataFrame, score: str, k: int | None = None, name: str = "rank", *by: str) -> DataFrame:
    """WN2: 0-based ranks per query (and ``by``), ties by id; the first ``k`` only if given.

    The limit is on the row number itself, so that each task keeps ``k`` rows a query before the shuffle.
    """
    out = scored.withColumn(name, F.row_number().over(W.partitionBy("query_id", *by).orderBy(F.col(score).desc(), "id")))
    return (out if k is None else out.filter(F.col(name) <= k)).withColumn(name, F.col(name) - 1)


def dense(queries: DataFrame, items: DataFrame) -> DataFrame:
    """VS1: cosine of every query (``query_id, query``) with every item (``id, vector``); zero vectors are left out.

    A stated query set against all rows: each item meets each query once, where it lies, a block of
    queries at a time.
    """
    asked = queries.select("query_id", "query", V.norm(F.col("query")).alias("__q"))
    own = items.select("id", "vector", V.norm(F.col("vector")).alias("__v"))
    score = F.round(F.try_divide(V.dot(F.col("query"), F.col("vector")), F.col("__q") * F.col("__v")), 6)
    return union([own.join(b).select("query_id", "id", score.alias("score")) for b in blocks(asked, 600)]).filter("score IS NOT NULL")


def nearest(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """TK1: the ``k`` items of smallest cosine distance; filters on ``items`` come before the top k."""
    return best(queries, items, k).select("query_id", "id", F.round(1 - F.col("score"), 6).alias("distance"), "rank")


def by_layer(queries: DataFrame, items: DataFrame, k: dict[int, int] = LAYER_K) -> DataFrame:
    """VS2: the first results of each layer (``id, vector, layer``), as many as ``k`` says."""
    most = F.element_at(F.create_map(*[F.lit(x) for kv in k.items() for x in kv]), F.col("layer").cast("int"))
    return best(queries, items, max(k.values()), "layer").filter(F.col("rank") < most).select("query_id", "layer", "id", "score", "rank")


def sparse(queries: DataFrame, items: DataFrame) -> DataFrame:
    """FT1: terms shared by query (``query_id, text``) and item (``id, text``), through an inverted index.

    Items keep the queries' terms only, before these become postings; their other words are never made distinct.
    """
    out = []
    for block in blocks(queries, 400):
        terms = block.select("query_id", F.explode(tokenize(F.col("text"))).alias("term"))
        asked = terms.agg(F.collect_set("term").alias("asked"))
        hits = items.select("id", words(F.col("text")).alias("own")).join(F.broadcast(asked))
        postings = hits.select("id", F.explode(F.array_intersect("own", "asked")).alias("term"))
        out.append(postings.join(F.broadcast(terms), "term").groupBy("query_id", "id").agg(F.count("*").cast("double").alias("score")))
    return union(out)


def token_index(items: DataFrame) -> DataFrame:
    """FT2: ``id, tokens``, derived once by the analyser that queries use, too."""
    return items.select("id", F.array_sort(tokenize(F.col("text"))).alias("tokens"))


def rrf(first: DataFrame, second: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """FU0: 1/(60 + rank) summed over two ranked lists (``query_id, id, rank``); a missing rank is the list's length."""
    tagged = first.select("query_id", "id", F.col("rank").alias("r1"), F.lit(None).cast("int").alias("r2")).unionByName(second.select("query_id", "id", F.lit(None).cast("int").alias("r1"), F.col("rank").alias("r2")))
    both = tagged.groupBy("query_id", "id").agg(F.max("r1").alias("r1"), F.max("r2").alias("r2"))
    query = W.partitionBy("query_id")
    both = both.withColumns({"n1": F.count("r1").over(query), "n2": F.count("r2").over(query)})
    part = lambda r, n: F.lit(1.0) / (constant + F.coalesce(F.col(r), F.col(n)))
    scored = both.withColumn("score", F.round(part("r1", "n1") + part("r2", "n2"), 9))
    return ranked(scored, "score", k)


def min_max(score: Column, query: W) -> Column:
    """FU1: to 0..1 over the present scores; 0.5 if all are equal, 0 if missing."""
    low, high = F.min(score).over(query), F.max(score).over(query)
    return F.when(score.isNull(), 0.0).when(high == low, 0.5).otherwise((score - low) / (high - low))


def merge_lists(lists: dict[str, DataFrame | None]) -> DataFrame:
    """J9, FU3: ``query_id, id``, a score column for each list and ``source``, the first list that has the item; in one shuffle.

    A list that failed is None and counts as empty; if all failed, that is an error.
    """
    present = {k: x for k, x in lists.items() if x is not None}
    if not present:
        raise RuntimeError("every signal failed")
    column = lambda mine, name: (F.col("score") if mine == name else F.lit(None)).cast("double").alias(name)
    tagged = [x.select("query_id", "id", *[column(k, name) for name in lists]) for k, x in present.items()]
    out = union(tagged).groupBy("query_id", "id").agg(*[F.max(x).alias(x) for x in lists])
    return out.withColumn("source", F.coalesce(*[F.when(F.col(x).isNotNull(), F.lit(x)) for x in lists]))


def fuse(lists: dict[str, DataFrame | None], weights: dict[str, float], k: int) -> DataFrame:
    """FU1, FU2: weighted sum of min-max scores of several lists (``query_id, id, score``)."""
    out = merge_lists(lists)
    query = W.partitionBy("query_id")
    total = sum((weights[x] * min_max(F.col(x), query) for x in lists), F.lit(0.0))
    return ranked(out.withColumn("fused", F.round(total, 6)), "fused", k)


#: FU1: original, HyDE document, and the mean of two expansions; FU2 has no original and its weights sum to 1.
FOUR_SIGNALS = {"orig": 0.5, "hyde": 0.25, "exp0": 0.125, "exp1": 0.125}
THREE_SIGNALS = {"hyde": 0.5, "exp0": 0.25, "exp1": 0.25}


def with_rank(results: DataFrame, payload: DataFrame) -> DataFrame:
    """J10: what ``payload`` has of the ids in ``results``, with their ranks."""
    return payload.join(results.select("query_id", "id", "rank"), "id")


def expand_hybrid(sections: DataFrame, similar: DataFrame, k: int) -> DataFrame:
    """CX4: of ``query_id, id, rank`` the first k // 2 of the section, then the first k // 2 similar ones, each id once."""
    half = k // 2
    tagged = sections.filter(F.col("rank") < half).select("query_id", "id", F.lit(0).alias("list"), "rank")
    tagged = tagged.unionByName(similar.filter(F.col("rank") < half).select("query_id", "id", F.lit(1).alias("list"), "rank"))
    first = tagged.groupBy("query_id", "id").agg(F.min(F.struct("list", "rank")).alias("at"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("at", "id")) - 1
    return first.select("query_id", "id", place.alias("rank"))


def pick_diverse(scored: DataFrame, k: int) -> DataFrame:
    """TK3: the best of each cluster, noise (-1 or null) without a limit, the first ``k`` of them."""
    noise = F.col("cluster").isNull() | (F.col("cluster") == -1)
    best = F.row_number().over(W.partitionBy("query_id", "cluster").orderBy(F.col("score").desc(), "id"))
    return ranked(scored.withColumn("__best", best).filter(noise | (F.col("__best") == 1)).drop("__best"), "score", k)


def hierarchical(queries: DataFrame, items: DataFrame, k: int = 6, slack: float = 0.25, sections: int = 3) -> DataFrame:
    """VS3: the document (``doc``) of the best layer-1 item, its best layer-3 items within ``slack`` of the top score, its best layer-2 items."""
    first = best(queries, items.filter("layer = 1"), 1, "doc").groupBy("query_id").agg(F.max_by("doc", F.struct("score", -F.col("id"))).alias("doc"))
    kept = best(queries.join(first, "query_id"), items.filter("layer <> 1"), max(k, sections), "layer", match=("doc",))
    kept = kept.withColumn("__top", F.max("score").over(W.partitionBy("query_id", "layer")))
    most = F.when(F.col("layer") == 3, k).otherwise(sections)
    near = (F.col("layer") != 3) | (F.col("score") >= F.round(F.col("__top") - slack, 6))
    return kept.filter(near & (F.col("rank") < most)).select("query_id", "layer", "id", "score")
