"""Confidence of retrieval results (WN7, RC*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Weights of the terms, and the bands with whether they ask for a review.
WEIGHTS = {"top": 0.30, "gap": 0.20, "consensus": 0.15, "agreement": 0.15, "spread": 0.10, "graph": 0.05, "diversity": 0.05}
BANDS = ((0.85, "HIGH"), (0.70, "MEDIUM"), (0.50, "LOW"))
CONSENSUS = 0.75


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def first_score(*scores: str) -> Column:
    """FM1: the first score that is neither missing nor 0, else 0."""
    return F.coalesce(*[F.nullif(F.col(x).cast("double"), F.lit(0.0)) for x in scores], F.lit(0.0))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's, null where one side is constant."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.try_divide(F.covar_pop(x, y), F.when(spread > 1e-12, spread))


def mean_rank(value: str, *by: str) -> Column:
    """Rank among the rows of a query, ties sharing their mean."""
    place = F.rank().over(W.partitionBy(*by).orderBy(value))
    return place + (F.count("*").over(W.partitionBy(*by, value)) - 1) / 2


def reranker_impact(results: DataFrame) -> DataFrame:
    """RC3: ``query_id, impact``: 1 - |Spearman| of ``rerank_score`` and ``rrf_score``; 0 for fewer than two pairs or constant scores."""
    both = results.filter("rerank_score IS NOT NULL AND rrf_score IS NOT NULL")
    both = both.select("query_id", mean_rank("rerank_score", "query_id").alias("a"), mean_rank("rrf_score", "query_id").alias("b"))
    rho = correlation(F.col("a"), F.col("b"))
    impact = F.when(F.count("*") < 2, 0.0).otherwise(clamp(F.coalesce(1 - F.abs(rho), F.lit(0.0))))
    return results.select("query_id").distinct().join(both.groupBy("query_id").agg(impact.alias("impact")), "query_id", "left").fillna(0.0, ["impact"])


def confidence(results: DataFrame) -> DataFrame:
    """RC1, RC2, RC4, RC5: one row a query over its results in order (``position``).

    ``results`` has ``query_id, position, document_id`` and the scores ``rerank_score, boosted_score,
    rrf_score, score, bm25_score, dense_score, graph_boost``, any of them null.
    """
    scored = results.withColumn("s", first_score("rerank_score", "boosted_score", "rrf_score", "score"))
    n = F.count("*")
    paired = F.col("bm25_score").isNotNull() & F.col("dense_score").isNotNull()
    bm25, near = F.when(paired, F.col("bm25_score")), F.when(paired, F.col("dense_score"))
    agreement = F.when(F.count_if(paired) < 2, 0.5).otherwise(F.coalesce((correlation(bm25, near) + 1) / 2, F.lit(1.0)))
    has = lambda c: F.bool_or(F.col(c).isNotNull())
    only = lambda a, b: F.bool_and(F.col(a).isNotNull() & F.col(b).isNull())
    boosted = F.coalesce(F.bool_or(F.col("graph_boost") > 0), F.lit(False))
    facts = scored.groupBy("query_id").agg(
        n.alias("n"), F.min_by("s", "position").alias("top"), F.max(F.when(F.col("position") == 2, F.col("s"))).alias("second"),
        F.stddev_pop("s").alias("std"), F.count_if(F.col("s") >= CONSENSUS).alias("consensus"), agreement.alias("agreement"), boosted.alias("graph_boost"),
        (F.countDistinct(F.coalesce(F.col("document_id").cast("string"), F.lit("(none)"))) / n).alias("diversity"),
        has("rrf_score").alias("hybrid_search"), has("rerank_score").alias("reranking"), only("bm25_score", "dense_score").alias("bm25_only"), only("dense_score", "bm25_score").alias("dense_only"),
    )
    gap = F.when(F.col("second").isNotNull(), F.col("top") - F.col("second")).otherwise(0.0)
    terms = {"top": F.col("top"), "gap": gap / 0.3, "consensus": F.col("consensus") / F.col("n"), "agreement": F.col("agreement"), "spread": 1 - F.col("std") / 0.2, "graph": F.when(F.col("graph_boost"), 1.0).otherwise(0.5), "diversity": 1 - F.col("diversity")}
    total = sum((WEIGHTS[k] * clamp(x) for k, x in terms.items()), F.lit(0.0))
    out = facts.withColumn("gap", gap).withColumn("confidence", F.round(clamp(total), 8))
    band = F.lit("VERY LOW")
    for least, name in reversed(BANDS):
        band = F.when(F.col("confidence") >= least, name).otherwise(band)
    out = out.withColumn("band", band).withColumn("review", F.col("band") != "HIGH").drop("second")
    return out.join(reranker_impact(results), "query_id")
