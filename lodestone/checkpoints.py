"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame


def settled(rows: DataFrame) -> DataFrame:
    """``rows`` written to the session's checkpoint folder, so that no later loss of an executor changes them.

    The folder is ``spark.checkpoint.dir``; one of this machine is set only where none is named and all runs here.
    """
    spark = rows.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or "/tmp/lodestone-checkpoints")
    return rows.checkpoint()
