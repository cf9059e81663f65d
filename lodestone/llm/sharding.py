"""Operator 5: two-pass external shuffle into shards, in built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .components import checkpoint_dir

SHARDS, SEED = 16, 20
BUCKET_BYTES = 4 << 20  #: text bytes that one bucket holds in memory, about
MOST_TASKS = 1 << 14


def rendezvous(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard with the largest hash for the key; one more shard only takes rows, into itself."""
    draws = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(key, s, F.lit(seed)).alias("h"), s.alias("s")))
    return F.array_max(draws)["s"]


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row, by the law ``key``.

    ``doc_id`` and the number of shards decide the shard. The first pass scatters records by a
    seeded hash of id, text checksum and place in the input over memory-sized buckets, so neither
    a hot key nor a group of copies fills one; the second shuffles each bucket (Fisher-Yates, as
    ``shuffle`` does it) and numbers it from the records in the shard's earlier buckets.

    Size is the UTF-8 length plus 1, null texts count as empty. Repeated rows all get a slot; rows
    without a ``doc_id`` share one shard. An empty table gives no rows; extra columns are ignored.
    """
    checkpoint_dir(docs.sparkSession)
    return _dealt(docs.withColumn("__place", F.monotonically_increasing_id()), shards, seed, doc_id, text)


def _dealt(placed: DataFrame, shards: int, seed: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``shard_documents`` of rows that have their number in ``__place``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    records = placed.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(whole) + 1).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.col("__place").alias("place"),
        rendezvous(F.col(doc_id), shards, seed).alias("shard"),
        rendezvous(F.col(doc_id), shards + 1, seed).alias("grown_shard"),
    ).checkpoint()
    total = records.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, math.ceil(total / shards / BUCKET_BYTES))
    scattered = records.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "place", F.lit(seed + 1)), F.lit(buckets)).cast("int"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = scattered.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    # The seeded shuffle goes by partition, so their number follows from the data alone; one that is
    # named here is kept by adaptive execution.
    dealt = scattered.repartition(min(shards * buckets, MOST_TASKS), "shard", "bucket")
    record = F.struct("place", "doc_id", "size", "text_crc32", "grown_shard")
    held = dealt.groupBy("shard", "bucket").agg(F.array_sort(F.collect_list(record)).alias("held")).sortWithinPartitions("shard", "bucket")
    mixed = held.select("shard", "bucket", F.shuffle("held", seed).alias("held"))
    slots = mixed.join(starts, ["shard", "bucket"]).select("shard", "start", F.posexplode("held").alias("at", "r"))
    return slots.select(
        "r.doc_id", "r.size", "r.text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("start") + F.col("at")).cast("long").alias("slot"), "r.grown_shard", F.col("r.place").alias("place"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Write every row under ``shard=N``, its slot in the column ``slot`` and files in slot order."""
    rows = with_shards(docs, shards, seed)
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def with_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``, every row matched by its place in a written copy.

    The rows are numbered once and checkpointed whole; places and slots come from that copy alone,
    so a scan that is planned or run again can't number them otherwise.
    """
    checkpoint_dir(docs.sparkSession)
    fixed = docs.drop("shard", "slot").withColumn("__place", F.monotonically_increasing_id()).checkpoint()
    slots = _dealt(fixed, shards, seed).select(F.col("place").alias("__place"), "shard", "slot")
    return fixed.join(slots, "__place").drop("__place")
