"""Numbers without gaps over a whole table, without a window over all its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..checkpoints import settled


def numbered(rows: DataFrame, *order: str, name: str = "number", first: int = 1, parts: int | None = None) -> DataFrame:
    """``rows`` with a ``name`` from ``first`` on without gaps, in ``order`` (nulls first; equal rows in any order).

    Rows are sorted by range, counted in each range, and numbered from the counts of the ranges before; the
    only window over everything has a row for each range.
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = settled(rows.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__part", before.alias("__before"))
    own = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return placed.withColumn("__own", own).join(F.broadcast(starts), "__part").select(*rows.columns, (F.col("__before") + F.col("__own") + (first - 1)).alias(name))
