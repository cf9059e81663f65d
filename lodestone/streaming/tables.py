"""Streams into tables: new rows only, latest snapshots, event subscribers (SS1, SS5, SS7)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_unseen(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """SS7: a ``foreachBatch`` step that appends the rows whose key the table at ``path`` has not yet, each key once."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        try:
            known = spark.read.schema(batch.schema).parquet(path).select(key)
            new = new.join(known, key, "left_anti").select(batch.columns)
        except Exception as error:  # the table is not there yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
        new.write.mode("append").parquet(path)

    return step


def index_new(stream: DataFrame, path: str, key: str, checkpoint: str) -> StreamingQuery:
    """SS7: keep the table at ``path`` up with a stream, in what is there now."""
    return stream.writeStream.foreachBatch(append_unseen(path, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(snapshots: DataFrame, at: Column, keep_from: Column) -> DataFrame:
    """SS5: of each ``thread`` the last snapshot by time and id; threads whose last one is older than ``keep_from`` are purged."""
    last = snapshots.groupBy("thread").agg(F.max(F.struct(at.alias("at"), "id")).alias("s"))
    return last.select("thread", "s.id", "s.at").filter(F.col("at") >= keep_from)


def drained(events: DataFrame, size: int) -> DataFrame:
    """SS1: events (``id, at``) that a queue of ``size`` takes between two drains, a second each; what comes to a full one is dropped.

    A stream has back-pressure instead of drops; this is the queue's own law over a log.
    """
    from pyspark.sql import Window as W

    second = F.date_trunc("second", "at")
    place = F.row_number().over(W.partitionBy(second).orderBy("at", "id"))
    return events.withColumn("accepted", place <= size).select("id", second.alias("drain"), "accepted")


def publish(stream: DataFrame, subscribers: dict[str, Callable[[DataFrame], None]], checkpoint: str) -> StreamingQuery:
    """SS1: each micro-batch goes to the subscribers of its event types (``type``); ``*`` gets all."""

    def step(batch: DataFrame, number: int) -> None:
        batch.persist()
        for kind, take in subscribers.items():
            take(batch if kind == "*" else batch.filter(F.col("type") == kind))
        batch.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
