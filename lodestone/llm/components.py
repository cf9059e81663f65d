"""Connected components of an edge table: by one task if it is counted to be small, else by alternating star contraction in SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 1 << 18  #: edges in a partition


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one is set only where none is named and all runs on one machine, as in tests."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or "/tmp/lodestone-checkpoints")
        known = sc._jsc.sc().getCheckpointDir()
    return known.get()


def _parts(rows: int) -> int:
    return -(-rows // ROWS) or 1


def _fingerprint(edges: DataFrame) -> tuple[int, tuple]:
    """Number of edges, and sums that tell two sets of them apart."""
    n, *sums = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
    return n, tuple(sums)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges of the partition: each root hangs itself under its smallest neighbour's, then paths are cut short."""
    ends = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if len(b)]
    if not ends:
        return
    nodes, index = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
    a, b = index.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        low, new = np.minimum(root[a], root[b]), root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Up to ``ROWS`` edges, as counted, are one task's arrays. Beyond that rounds of star contraction
    spread over the cluster, with the same result: each round links every node's larger neighbours
    to its smallest one (large star), then its smaller neighbours to the smallest (small star). Both
    are one aggregate and one join on the node that explodes nothing, so a hub with many neighbours
    is a skewed join side and never one row.
    Self-loops, repeated edges and either direction are allowed; no edges give no rows. Edges are
    kept in as many partitions as their counted rows need, not in one for each shuffle partition.
    """
    spark = edges.sparkSession
    checkpoint_dir(spark)
    given = edges.select(F.least(a, b).cast("long").alias("u"), F.greatest(a, b).cast("long").alias("v")).filter("u <= v").checkpoint()
    if given.count() <= ROWS:
        return given.coalesce(1).mapInArrow(_roots, "node long, component long").checkpoint()
    alone = given.filter("u = v").select(F.col("u").alias("node"))
    now = given.filter("u < v").distinct().checkpoint()
    rows, names = _fingerprint(now)
    now = now.coalesce(_parts(rows))
    nodes = now.select(F.col("u").alias("node")).union(now.select("v")).union(alone).distinct()

    def star(pairs: DataFrame) -> DataFrame:
        """Pairs (x, y) say that y is a neighbour of x; y and x then point to x's smallest."""
        least = pairs.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        linked = pairs.join(least, "x")
        return linked.select("x", "y", "m")

    for _ in range(most_rounds):
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select("v", "u"))
        large = star(both).filter("y > x").select(F.col("m").alias("u"), F.col("y").alias("v")).filter("u < v").distinct()
        down = large.select(F.col("v").alias("x"), F.col("u").alias("y"))
        linked = star(down)
        small = linked.select(F.col("m").alias("u"), F.col("y").alias("v")).union(linked.select("m", "x"))
        now = small.filter("u < v").distinct().coalesce(_parts(rows)).checkpoint()
        before, (rows, names) = (rows, names), _fingerprint(now)
        if before == (rows, names):
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component")).coalesce(_parts(rows)).checkpoint()


def merged(components: DataFrame | None, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``components`` after more ``links``: few rows are joined anew, of more only links between different components are contracted."""
    if components is None:
        return connected_components(links, a, b)
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).checkpoint()
    if links.isEmpty():
        return components
    if components.count() + links.count() <= ROWS:
        return connected_components(components.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))
    a, b = "a", "b"
    of = lambda x: components.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    lifted = links.join(of(a), a, "left").join(of(b), b, "left").select(F.coalesce(f"c_{a}", a).alias("a"), F.coalesce(f"c_{b}", b).alias("b"))
    lifted = lifted.filter("a <> b").distinct().checkpoint()
    if lifted.isEmpty():
        return components
    top = connected_components(lifted)
    old = components.join(top.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
    new = top.join(components, "node", "left_anti").select("node", "component")
    return old.select("node", F.coalesce("top", "component").alias("component")).union(new).checkpoint()
