"""Retrieval and answer metrics (EV*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normalize, tokenize
from .registry import query, table
from .retrieval import DENSE, RANK, best, items
from .text import NORM, TOK

K = 10
HITS = f"SELECT r.query_id, r.rank + 1 AS pos, CASE WHEN a.label = b.label THEN 1 ELSE 0 END AS rel FROM (SELECT *, {RANK} AS rank FROM ({DENSE}) WHERE id <> query_id) r JOIN embeddings a ON a.vec_id = r.query_id JOIN embeddings b ON b.vec_id = r.id WHERE rank < {K}"
RELEVANT = "SELECT a.vec_id AS query_id, count(*) - 1 AS n FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 100 = 0 GROUP BY 1"


def judged(spark, d):
    """The first K results of each query with their relevance (same label), and how many items are relevant."""
    label = items(spark, d).select("id", "label")
    top = best(spark, d, K, itself=False).join(label, "id")
    own = label.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("label").alias("wanted"))
    n = label.groupBy(F.col("label").alias("wanted")).agg((F.count("*") - 1).alias("n"))
    return top.join(F.broadcast(own.join(n, "wanted")), "query_id").select("query_id", (F.col("rank") + 1).alias("pos"), (F.col("label") == F.col("wanted")).cast("int").alias("rel"), "n")


@query("ev1_dcg", f"SELECT query_id, round(sum(rel / log2(pos + 1)), 6) AS dcg FROM ({HITS}) GROUP BY query_id")
def _(spark, d):
    return judged(spark, d).groupBy("query_id").agg(F.round(F.sum(F.col("rel") / F.log2(F.col("pos") + 1)), 6).alias("dcg"))


@query("ev2_ndcg", f"WITH i AS (SELECT query_id, sum(1 / log2(p + 1)) AS ideal FROM ({RELEVANT}), range(1, {K} + 1) t(p) WHERE p <= n GROUP BY query_id) SELECT query_id, round(coalesce(sum(rel / log2(pos + 1)) / any_value(ideal), 0), 6) AS ndcg FROM ({HITS}) LEFT JOIN i USING (query_id) GROUP BY query_id")
def _(spark, d):
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.max("n"), F.lit(K)).cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    gain = F.sum(F.col("rel") / F.log2(F.col("pos") + 1))
    return judged(spark, d).groupBy("query_id").agg(F.round(F.when(F.max("n") > 0, gain / ideal).otherwise(0.0), 6).alias("ndcg"))


@query("ev3_reciprocal_rank", f"SELECT query_id, round(coalesce(1 / min(pos) FILTER (WHERE rel = 1), 0), 6) AS rr FROM ({HITS}) GROUP BY query_id")
def _(spark, d):
    first = F.min(F.when(F.col("rel") == 1, F.col("pos")))
    return judged(spark, d).groupBy("query_id").agg(F.round(F.coalesce(1 / first, F.lit(0.0)), 6).alias("rr"))


@query("ev4_ev6_precision_recall_f1", f"WITH m AS (SELECT query_id, sum(rel) / {K} AS p, coalesce(sum(rel) / nullif(any_value(n), 0), 0) AS r FROM ({HITS}) JOIN ({RELEVANT}) USING (query_id) GROUP BY query_id) SELECT query_id, round(p, 6) AS p, round(r, 6) AS r, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM m")
def _(spark, d):
    m = judged(spark, d).groupBy("query_id").agg((F.sum("rel") / K).alias("p"), F.coalesce(F.try_divide(F.sum("rel"), F.max("n")), F.lit(0.0)).alias("r"))
    f1 = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    return m.select("query_id", F.round("p", 6).alias("p"), F.round("r", 6).alias("r"), F.round(f1, 6).alias("f1"))


@query("ag17_mrr", f"SELECT round(avg(rr), 6) AS mrr, round(stddev_pop(rr), 6) AS std, round(min(rr), 6) AS low, round(max(rr), 6) AS high FROM (SELECT query_id, coalesce(1 / min(pos) FILTER (WHERE rel = 1), 0) AS rr FROM ({HITS}) GROUP BY query_id)")
def _(spark, d):
    rr = judged(spark, d).groupBy("query_id").agg(F.coalesce(1 / F.min(F.when(F.col("rel") == 1, F.col("pos"))), F.lit(0.0)).alias("rr"))
    return rr.agg(*[F.round(f("rr"), 6).alias(n) for f, n in ((F.avg, "mrr"), (F.stddev_pop, "std"), (F.min, "low"), (F.max, "high"))])


ANSWERS = f"SELECT conv_id, turn, {TOK.format('text')} AS a, {TOK.format('ref')} AS r, {NORM.format('text')} = {NORM.format('ref')} AS exact FROM (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ref FROM conversations) WHERE ref IS NOT NULL"


def answers(spark, d):
    """Each message as an answer to be held against the one before."""
    from pyspark.sql import Window as W

    rows = table(spark, d, "conversations").withColumn("ref", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))).filter("ref IS NOT NULL")
    return rows.select("conv_id", "turn", tokenize(F.col("text")).alias("a"), tokenize(F.col("ref")).alias("r"), (normalize(F.col("text")) == normalize(F.col("ref"))).alias("exact"))


@query("ev7_token_f1", f"WITH m AS (SELECT conv_id, turn, coalesce(len(list_intersect(a, r)) / nullif(len(a), 0), 0) AS p, coalesce(len(list_intersect(a, r)) / nullif(len(r), 0), 0) AS c FROM ({ANSWERS})) SELECT conv_id, turn, round(p, 6) AS p, round(c, 6) AS r, round(coalesce(2 * p * c / nullif(p + c, 0), 0), 6) AS f1 FROM m")
def _(spark, d):
    shared = F.size(F.array_intersect("a", "r"))
    m = answers(spark, d).select("conv_id", "turn", *[F.coalesce(F.try_divide(shared, F.size(x)), F.lit(0.0)).alias(y) for x, y in (("a", "p"), ("r", "r"))])
    f1 = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    return m.select("conv_id", "turn", F.round("p", 6).alias("p"), F.round("r", 6).alias("r"), F.round(f1, 6).alias("f1"))


@query("ev8_exact_match", f"SELECT conv_id, turn, exact FROM ({ANSWERS})")
def _(spark, d):
    return answers(spark, d).select("conv_id", "turn", "exact")


@query("so3_set_difference", f"SELECT conv_id, turn, CAST(len(list_filter(a, lambda x: NOT list_contains(r, x))) AS INT) AS missing, CAST(len(list_intersect(a, r)) AS INT) AS shared FROM ({ANSWERS})")
def _(spark, d):
    return answers(spark, d).select("conv_id", "turn", F.size(F.array_except("a", "r")).alias("missing"), F.size(F.array_intersect("a", "r")).alias("shared"))
