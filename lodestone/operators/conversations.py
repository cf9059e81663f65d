"""Conversations and their messages (CV1).

Conversations: ``conv_id, user_id, title, created_at, updated_at``; messages: ``conv_id, turn, role, text, created_at``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def of_users(conversations: DataFrame, messages: DataFrame, most: int = 50) -> DataFrame:
    """Of each user the ``most`` conversations that were touched last, with their ``place`` and ``message_count``; ties by id, unknown times last."""
    order = W.partitionBy("user_id").orderBy(F.col("updated_at").desc_nulls_last(), "conv_id")
    kept = conversations.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    counts = messages.groupBy("conv_id").agg(F.count("*").alias("message_count"))
    return kept.join(counts, "conv_id", "left").withColumn("message_count", F.coalesce("message_count", F.lit(0)))


def history(messages: DataFrame, most: int = 100) -> DataFrame:
    """The first ``most`` messages of each conversation by time and turn, with their ``place``."""
    order = W.partitionBy("conv_id").orderBy(F.col("created_at").asc_nulls_last(), "turn")
    return messages.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def appended(conversations: DataFrame, messages: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after new messages (``conv_id, role, text, created_at``): turns go on from the last one by time and text, and conversations are touched.

    A new message of a conversation that does not exist is refused, as its key has no row to refer to.
    """
    known = new.join(conversations.select("conv_id").distinct(), "conv_id", "left_semi")
    last = messages.groupBy("conv_id").agg(F.max("turn").alias("__last"))
    number = F.row_number().over(W.partitionBy("conv_id").orderBy("created_at", "text", "role"))
    turn = (F.coalesce("__last", F.lit(-1)) + number).cast(dict(messages.dtypes)["turn"])
    added = known.join(last, "conv_id", "left").withColumn("turn", turn).select(*messages.columns)
    touched = known.groupBy("conv_id").agg(F.max("created_at").alias("__at"))
    columns = [F.greatest("updated_at", "__at").alias(c) if c == "updated_at" else F.col(c) for c in conversations.columns]
    return conversations.join(touched, "conv_id", "left").select(*columns), messages.unionByName(added)


def deleted(conversations: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the conversations in ``gone`` (``conv_id, user_id``) that belong to the user who asks, and without their messages."""
    own = conversations.join(gone.select("conv_id", "user_id").distinct(), ["conv_id", "user_id"], "left_semi").select("conv_id")
    return conversations.join(own, "conv_id", "left_anti"), messages.join(own, "conv_id", "left_anti")


def owned(conversations: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (``conv_id, user_id``) with ``is_owner``; false for a conversation that does not exist."""
    owner = conversations.select("conv_id", F.col("user_id").alias("__owner"))
    return asked.join(owner, "conv_id", "left").withColumn("is_owner", F.coalesce(F.col("__owner") == F.col("user_id"), F.lit(False))).drop("__owner")
