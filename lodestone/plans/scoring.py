"""Confidence of results, and metrics of answers with several references (RC*, EV9 to EV12, AG30)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import vectors as V
from ..functions.text import normalize, tokenize
from ..operators import confidence as C
from .evaluation import RELEVANT
from .registry import query, table
from .retrieval import COS, DENSE, RANK, best, items
from .text import NORM, TOK
from .trees import PLACE, placed

RESULTS = f"SELECT l_orderkey AS query_id, {PLACE} AS position, l_suppkey AS document_id, CASE WHEN l_linenumber % 4 = 3 THEN NULL ELSE round(l_quantity / 50, 6) END AS rerank_score, CASE WHEN l_linenumber % 2 = 0 THEN 0.0 END AS boosted_score, round(l_extendedprice / 110000, 6) AS rrf_score, 0.5 AS score, CASE WHEN l_returnflag <> 'A' THEN l_discount END AS bm25_score, CASE WHEN l_linestatus = 'O' THEN l_tax END AS dense_score, CASE WHEN l_returnflag = 'R' THEN 0.3 ELSE 0.0 END AS graph_boost FROM lineitem"


def results(spark, d):
    """Each order as a query, its lines as results with scores of which some are missing."""
    c = F.col
    return placed(spark, d).select(
        c("l_orderkey").alias("query_id"), c("place").alias("position"), c("l_suppkey").alias("document_id"),
        F.when(c("l_linenumber") % 4 != 3, F.round(c("l_quantity") / 50, 6)).alias("rerank_score"), F.when(c("l_linenumber") % 2 == 0, 0.0).alias("boosted_score"),
        F.round(c("l_extendedprice") / 110000, 6).alias("rrf_score"), F.lit(0.5).alias("score"), F.when(c("l_returnflag") != "A", c("l_discount")).alias("bm25_score"),
        F.when(c("l_linestatus") == "O", c("l_tax")).alias("dense_score"), F.when(c("l_returnflag") == "R", 0.3).otherwise(0.0).alias("graph_boost"),
    )


FACTS = f"""WITH r AS (SELECT *, CASE WHEN rerank_score <> 0 THEN rerank_score WHEN boosted_score <> 0 THEN boosted_score WHEN rrf_score <> 0 THEN rrf_score ELSE coalesce(score, 0) END AS s FROM ({RESULTS})),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS rn FROM r),
g AS (SELECT query_id, count(*) AS n, max(s) FILTER (WHERE rn = 1) AS top, max(s) FILTER (WHERE rn = 1) - coalesce(max(s) FILTER (WHERE position = 2), max(s) FILTER (WHERE rn = 1)) AS gap, stddev_pop(s) AS std, count(*) FILTER (WHERE s >= 0.75) AS consensus,
      count(*) FILTER (WHERE bm25_score IS NOT NULL AND dense_score IS NOT NULL) AS pairs, stddev_pop(bm25_score) FILTER (WHERE dense_score IS NOT NULL) AS sb, stddev_pop(dense_score) FILTER (WHERE bm25_score IS NOT NULL) AS sd, covar_pop(bm25_score, dense_score) AS cov,
      bool_or(graph_boost > 0) AS boost, count(DISTINCT document_id) / count(*) AS diversity, bool_or(rrf_score IS NOT NULL) AS hybrid, bool_or(rerank_score IS NOT NULL) AS reranking,
      bool_and(bm25_score IS NOT NULL AND dense_score IS NULL) AS bm25_only, bool_and(dense_score IS NOT NULL AND bm25_score IS NULL) AS dense_only FROM o GROUP BY query_id),
k AS (SELECT query_id, rerank_score, rrf_score, rank() OVER (PARTITION BY query_id ORDER BY rerank_score) + (count(*) OVER (PARTITION BY query_id, rerank_score) - 1) / 2 AS a, rank() OVER (PARTITION BY query_id ORDER BY rrf_score) + (count(*) OVER (PARTITION BY query_id, rrf_score) - 1) / 2 AS b FROM r WHERE rerank_score IS NOT NULL AND rrf_score IS NOT NULL),
i AS (SELECT query_id, CASE WHEN count(*) < 2 OR stddev_pop(a) * stddev_pop(b) <= 1e-12 THEN 0 ELSE greatest(0, least(1, 1 - abs(covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b))))) END AS impact FROM k GROUP BY query_id),
t AS (SELECT g.*, coalesce(i.impact, 0) AS impact, CASE WHEN pairs < 2 THEN 0.5 WHEN sb * sd <= 1e-12 THEN 1.0 ELSE (cov / (sb * sd) + 1) / 2 END AS agreement FROM g LEFT JOIN i USING (query_id)),
c AS (SELECT *, round(0.3 * greatest(0, least(1, top)) + 0.2 * greatest(0, least(1, gap / 0.3)) + 0.15 * (consensus / n) + 0.15 * greatest(0, least(1, agreement)) + 0.1 * greatest(0, least(1, 1 - std / 0.2)) + 0.05 * CASE WHEN boost THEN 1 ELSE 0.5 END + 0.05 * (1 - diversity), 8) AS confidence FROM t)"""


@query("rc1_confidence", FACTS + " SELECT query_id, confidence, CASE WHEN confidence >= 0.85 THEN 'HIGH' WHEN confidence >= 0.7 THEN 'MEDIUM' WHEN confidence >= 0.5 THEN 'LOW' ELSE 'VERY LOW' END AS band, confidence < 0.85 AS review, round(gap, 6) AS gap, round(agreement, 5) AS agreement FROM c")
def _(spark, d):
    return C.confidence(results(spark, d)).select("query_id", "confidence", "band", "review", F.round("gap", 6).alias("gap"), F.round("agreement", 5).alias("agreement"))


@query("rc3_reranker_impact", FACTS + " SELECT query_id, round(impact, 5) AS impact FROM c")
def _(spark, d):
    return C.reranker_impact(results(spark, d)).select("query_id", F.round("impact", 5).alias("impact"))


@query("rc5_retrieval_methods", FACTS + " SELECT query_id, hybrid AS hybrid_search, reranking, boost AS graph_boost, bm25_only, dense_only FROM c")
def _(spark, d):
    return C.confidence(results(spark, d)).select("query_id", "hybrid_search", "reranking", "graph_boost", "bm25_only", "dense_only")


REFS = "SELECT conv_id, turn, text, lag(text) OVER w AS r1, lag(text, 2) OVER w AS r2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"


def referenced(spark, d):
    """Each message as an answer to be held against the one or two before."""
    order = W.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").withColumns({"r1": F.lag("text").over(order), "r2": F.lag("text", 2).over(order)})
    return rows.filter("r1 IS NOT NULL").select("conv_id", "turn", "text", F.array_compact(F.array("r1", "r2")).alias("refs"))


def token_scores(answer, reference):
    """Precision, recall and F1 of token sets, 0 where a set is empty."""
    a, r = tokenize(answer), tokenize(reference)
    shared = F.size(F.array_intersect(a, r))
    p, c = (F.coalesce(F.try_divide(shared, F.size(x)), F.lit(0.0)) for x in (a, r))
    return F.struct(F.coalesce(F.try_divide(2 * p * c, p + c), F.lit(0.0)).alias("f1"), p.alias("p"), c.alias("r"))


def best_of(answer, references):
    """EV7: the scores against the reference of the best F1, the first of ties."""
    each = F.transform(references, lambda r: token_scores(answer, r))
    top = F.array_max(F.transform(each, lambda x: x["f1"]))
    return F.filter(each, lambda x: x["f1"] == top)[0]


def _scores(a, r):
    return f"len(list_intersect({a}, {r})) / nullif(len({a}), 0) AS p, len(list_intersect({a}, {r})) / nullif(len({r}), 0) AS c"


@query("ev7_best_reference", f"WITH x AS ({REFS}), y AS (SELECT conv_id, turn, text, unnest([r1, r2]) AS ref, unnest([1, 2]) AS k FROM x WHERE r1 IS NOT NULL), z AS (SELECT conv_id, turn, k, {_scores(TOK.format('text'), TOK.format('ref'))} FROM y WHERE ref IS NOT NULL), f AS (SELECT conv_id, turn, k, coalesce(p, 0) AS p, coalesce(c, 0) AS r, coalesce(2 * p * c / nullif(p + c, 0), 0) AS f1 FROM z) SELECT conv_id, turn, round(arg_max(p, (f1, -k)), 6) AS p, round(arg_max(r, (f1, -k)), 6) AS r, round(max(f1), 6) AS f1 FROM f GROUP BY conv_id, turn")
def _(spark, d):
    best = referenced(spark, d).select("conv_id", "turn", best_of(F.col("text"), F.col("refs")).alias("b"))
    return best.select("conv_id", "turn", *[F.round(F.col(f"b.{c}"), 6).alias(c) for c in ("p", "r", "f1")])


@query("ev8_any_reference", f"SELECT conv_id, turn, ({NORM.format('text')} = {NORM.format('r1')}) OR coalesce({NORM.format('text')} = {NORM.format('r2')}, false) AS exact FROM ({REFS}) WHERE r1 IS NOT NULL")
def _(spark, d):
    return referenced(spark, d).select("conv_id", "turn", F.exists("refs", lambda r: normalize(r) == normalize(F.col("text"))).alias("exact"))


@query("ev9_combined_f1", f"WITH x AS (SELECT conv_id, turn, text, r1 || coalesce(' ' || r2, '') AS ref FROM ({REFS}) WHERE r1 IS NOT NULL), z AS (SELECT conv_id, turn, {_scores(TOK.format('text'), TOK.format('ref'))} FROM x) SELECT conv_id, turn, round(coalesce(2 * p * c / nullif(p + c, 0), 0), 6) AS f1 FROM z")
def _(spark, d):
    return referenced(spark, d).select("conv_id", "turn", F.round(token_scores(F.col("text"), F.array_join("refs", " "))["f1"], 6).alias("f1"))


@query("ev10_embedding_similarity", f"SELECT a.vec_id AS id, greatest(0, max({COS.format('a.embedding', 'b.embedding')})) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id IN (a.vec_id + 1, a.vec_id + 2, a.vec_id + 3) GROUP BY a.vec_id")
def _(spark, d):
    """The best of up to three references' vectors, at least 0."""
    own = items(spark, d)
    refs = own.select(F.explode(F.array(*[F.col("id") - k for k in (1, 2, 3)])).alias("id"), F.col("vector").alias("reference"))
    return own.join(refs, "id").groupBy("id").agg(F.greatest(F.lit(0.0), F.max(V.cosine(F.col("vector"), F.col("reference")))).alias("similarity"))


@query("ev11_all_metrics", f"WITH x AS ({REFS}), b AS (SELECT conv_id, turn, text, r1, r2 FROM x WHERE r1 IS NOT NULL), y AS (SELECT conv_id, turn, text, unnest([r1, r2]) AS ref FROM b), z AS (SELECT conv_id, turn, {_scores(TOK.format('text'), TOK.format('ref'))} FROM y WHERE ref IS NOT NULL), f AS (SELECT conv_id, turn, max(coalesce(2 * p * c / nullif(p + c, 0), 0)) AS f1 FROM z GROUP BY conv_id, turn), e AS (SELECT conv_id, turn, CASE WHEN {NORM.format('text')} = {NORM.format('r1')} OR {NORM.format('text')} = {NORM.format('r2')} THEN 1 ELSE 0 END AS em, {_scores(TOK.format('text'), TOK.format("r1 || coalesce(' ' || r2, '')"))} FROM b) SELECT round(avg(f1), 6) AS f1, round(avg(em), 6) AS exact, round(avg(coalesce(2 * p * c / nullif(p + c, 0), 0)), 6) AS combined, CAST(count(*) AS BIGINT) AS n FROM f JOIN e USING (conv_id, turn)")
def _(spark, d):
    exact = F.exists("refs", lambda r: normalize(r) == normalize(F.col("text"))).cast("int")
    each = referenced(spark, d).select(best_of(F.col("text"), F.col("refs"))["f1"].alias("f1"), exact.alias("exact"), token_scores(F.col("text"), F.array_join("refs", " "))["f1"].alias("combined"))
    return each.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("f1", "exact", "combined")], F.count("*").alias("n"))


WIDE = 100


@query("ev12_training_rows", f"WITH t AS (SELECT *, {RANK} AS rank FROM ({DENSE}) WHERE id <> query_id), h AS (SELECT t.query_id, count(*) FILTER (WHERE a.label = b.label) AS hits, list(round(score, 6) ORDER BY rank) AS scores FROM t JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = id WHERE rank < 100 GROUP BY query_id) SELECT query_id, round(coalesce(hits / nullif(n, 0), 0), 6) AS recall, list_resize(scores, 100, 0.0) AS scores FROM h JOIN ({RELEVANT}) USING (query_id)")
def _(spark, d):
    """One row a query: recall and the first hundred scores, padded with 0."""
    label = items(spark, d).select("id", "label")
    top = best(spark, d, WIDE, itself=False).join(label, "id")
    own = label.select(F.col("id").alias("query_id"), F.col("label").alias("wanted"))
    n = label.groupBy(F.col("label").alias("wanted")).agg((F.count("*") - 1).alias("n"))
    rows = top.join(own.join(n, "wanted"), "query_id").groupBy("query_id").agg(F.coalesce(F.try_divide(F.count_if(F.col("label") == F.col("wanted")), F.max("n")), F.lit(0.0)).alias("recall"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"))
    padded = F.concat("scores", F.array_repeat(F.lit(0.0), F.lit(WIDE) - F.size("scores")))
    return rows.select("query_id", F.round("recall", 6).alias("recall"), padded.alias("scores"))


@query("ag30_compare_experiments", "SELECT event_type AS experiment, round(coalesce(avg(value) FILTER (WHERE user_id % 3 = 0), 0), 6) AS mean, round(coalesce(stddev_pop(value) FILTER (WHERE user_id % 3 = 0), 0), 6) AS std, CAST(count(*) AS BIGINT) AS num_queries FROM (SELECT * FROM events UNION ALL SELECT event_id, ts, 1, 'none', value, props FROM events WHERE event_id < 5) GROUP BY event_type")
def _(spark, d):
    """A metric that an experiment lacks is 0."""
    events = table(spark, d, "events")
    none = events.filter("event_id < 5").withColumns({"user_id": F.lit(1).cast("long"), "event_type": F.lit("none")})
    value = F.when(F.col("user_id") % 3 == 0, F.col("value"))
    return events.unionByName(none).groupBy(F.col("event_type").alias("experiment")).agg(F.round(F.coalesce(F.avg(value), F.lit(0.0)), 6).alias("mean"), F.round(F.coalesce(F.stddev_pop(value), F.lit(0.0)), 6).alias("std"), F.count("*").alias("num_queries"))
