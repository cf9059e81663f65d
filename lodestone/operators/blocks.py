"""Groups of points cut into blocks, so that all pairs of a group are made block by block and no task holds all of them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import numbered

BLOCK = 2048  #: points of a block; a task holds the distances between two blocks


def placed(items: DataFrame, by: str) -> DataFrame:
    """``by, id, vector`` with ``place``, from 0 in each group by id, and ``blocks``, how many blocks the group has; null vectors are left out."""
    rows = numbered(items.filter("vector IS NOT NULL").select(by, "id", "vector"), by, "id", "vector", name="place", first=0)
    groups = rows.groupBy(F.col(by).alias("__by")).agg(F.min("place").alias("__first"), F.count("*").alias("__n"))
    out = rows.join(groups, F.col(by).eqNullSafe(F.col("__by")))
    return out.select(by, "id", "vector", (F.col("place") - F.col("__first")).alias("place"), F.ceil(F.col("__n") / BLOCK).cast("long").alias("blocks"))


def unit_rows(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), float)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def met(points: DataFrame, by: str, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What ``run`` makes of each two blocks of a group, and of each block with itself (both are the same frame then), by place."""
    own = F.floor(F.col("place") / BLOCK)
    both = points.withColumn("__own", own).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = both.withColumns({"__low": F.least("__own", "__other"), "__high": F.greatest("__own", "__other")}).drop("__other")

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        low = rows[rows["__own"] == rows["__low"].iloc[0]]
        high = rows[rows["__own"] == rows["__high"].iloc[0]]
        return run(low, low if rows["__low"].iloc[0] == rows["__high"].iloc[0] else high)

    return both.groupBy(by, "__low", "__high").applyInPandas(each, schema)


def distances(low: pd.DataFrame, high: pd.DataFrame) -> np.ndarray:
    """Cosine distances of two blocks; 0 of a point to itself."""
    a = unit_rows(low["vector"])
    far = np.maximum(1 - a @ (a if high is low else unit_rows(high["vector"])).T, 0)
    if high is low:
        np.fill_diagonal(far, 0)
    return far


def with_core(points: DataFrame, by: str, nth: int) -> DataFrame:
    """``points`` with ``core``: the distance to the ``nth`` nearest point of the group, itself the first, or to the last if there are fewer."""
    kind = points.schema[by].dataType.simpleString()

    def run(low: pd.DataFrame, high: pd.DataFrame) -> pd.DataFrame:
        far = distances(low, high)
        sides = [(low, far)] if high is low else [(low, far), (high, far.T)]
        first = lambda x: np.sort(np.partition(x, nth - 1, axis=1)[:, :nth] if x.shape[1] > nth else x, axis=1)
        return pd.concat([pd.DataFrame({by: side[by], "place": side["place"], "near": list(first(x))}) for side, x in sides])

    near = met(points, by, run, f"{by} {kind}, place long, near array<double>")
    both = points.unionByName(near, allowMissingColumns=True).groupBy(by, "place")
    all_ = F.array_sort(F.flatten(F.collect_list("near")))
    held = both.agg(*[F.first(c, True).alias(c) for c in ("id", "vector", "blocks")], all_.alias("near"))
    return held.select(by, "id", "vector", "place", "blocks", F.element_at("near", F.least(F.lit(nth), F.size("near"))).alias("core"))
