"""Statistics of operations and of extraction runs (AG24, AG28)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    """A quotient that is 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def operation_stats(calls: DataFrame, *by: str) -> DataFrame:
    """AG24: of calls (``ok, ms, hit``) by ``by``: counts, time in all and on average, shares of success and error, as fractions and per cent, and of cache hits and misses.

    A call whose ``ok`` is null is neither a success nor an error; one whose ``hit`` is null asked no cache. The
    share of misses is what hits leave, so it is 1 without any question.
    """
    total = F.col("total_calls")
    rows = calls.groupBy(*by).agg(F.count("*").alias("total_calls"), F.coalesce(F.sum("ms"), F.lit(0.0)).alias("total_time_ms"), F.count_if(F.col("ok")).alias("success_count"), F.count_if(~F.col("ok")).alias("error_count"), F.count_if(F.col("hit")).alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    success, error, hits = share(F.col("success_count"), total), share(F.col("error_count"), total), share(F.col("hits"), F.col("hits") + F.col("misses"))
    return rows.select("*", share(F.col("total_time_ms"), total).alias("avg_time_ms"), success.alias("success_rate"), (success * 100).alias("success_percent"), error.alias("error_rate"), (error * 100).alias("error_percent"), hits.alias("hit_rate"), (1 - hits).alias("miss_rate"))


def extraction_rollup(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """AG28: of each document of ``chunks`` (``doc_id, error, n_relationships``): chunks in all, done and failed, entities in all and different ones (``doc_id, uuid``), relationships."""
    one = chunks.groupBy("doc_id").agg(F.count("*").alias("total_chunks"), F.count_if(F.col("error").isNull()).alias("successful_chunks"), F.count_if(F.col("error").isNotNull()).alias("failed_chunks"), F.coalesce(F.sum("n_relationships"), F.lit(0)).alias("total_relationships"))
    two = entities.groupBy("doc_id").agg(F.count("*").alias("total_entities"), F.count_distinct("uuid").alias("unique_entities"))
    return one.join(two, "doc_id", "left").na.fill(0, ["total_entities", "unique_entities"])


def label_counts(entities: DataFrame, generic: str = "Entity") -> DataFrame:
    """AG28: ``doc_id, label, n``: how many entities (with ``labels``) of a document have a label, the generic one left out."""
    return entities.select("doc_id", F.explode("labels").alias("label")).filter(F.col("label") != generic).groupBy("doc_id", "label").agg(F.count("*").alias("n"))
