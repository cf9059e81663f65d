"""Clustering of unit vectors by cosine (CL*, VS4)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..checkpoints import settled
from ..functions import vectors as V
from . import blocks
from .search import best

MOST_CENTROIDS = 4096  #: centroids that are sent out whole
HELD = 2000  #: points of one group whose distances are all held; more are merged by their clusters' means


def _mean(member: Column, by: str, rows: DataFrame, name: str = "vector") -> DataFrame:
    """Unit vectors of weighted sums, by element: ``by, centroid``."""
    each = rows.select(by, member.alias("__w"), F.posexplode(name).alias("i", "x"))
    sums = each.groupBy(by, "i").agg(F.sum(F.col("x").cast("double") * F.col("__w")).alias("s"))
    held = sums.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda p: p["s"]).alias("centroid"))
    return held.select(by, V.unit(F.col("centroid")).alias("centroid"))


def _unit(x: list[float]) -> list[float]:
    return [float(v) for v in np.array(x, float) / (np.linalg.norm(x) or 1.0)]


def _sent(spark, centroids: list[tuple[int, list[float]]]) -> DataFrame:
    if len(centroids) > MOST_CENTROIDS:
        raise ValueError(f"more than {MOST_CENTROIDS} centroids")
    return F.broadcast(spark.createDataFrame(centroids, "cluster int, centroid array<double>"))


def assigned(items: DataFrame, centroids: list[tuple[int, list[float]]]) -> DataFrame:
    """CL2: the centroid of the largest cosine (the lowest of ties) beside every item (``id, vector``): ``cluster, score``; nothing is shuffled."""
    if len(centroids) > MOST_CENTROIDS:
        raise ValueError(f"more than {MOST_CENTROIDS} centroids")
    held = F.broadcast(items.sparkSession.createDataFrame([(centroids,)], "__held array<struct<cluster:int,centroid:array<double>>>"))
    each = items.withColumn("__unit", V.unit(F.col("vector"))).join(held)
    scores = F.transform("__held", lambda c: F.struct(F.round(V.dot(F.col("__unit"), c["centroid"]), 9).alias("s"), (-c["cluster"]).alias("k")))
    best = each.withColumn("__best", F.array_max(scores))
    return best.select(*items.columns, (-F.col("__best.k")).alias("cluster"), F.col("__best.s").alias("score"))


def _moved(old: list[tuple[int, list[float]]], new: dict[int, list[float]]) -> tuple[list[tuple[int, list[float]]], float]:
    """Centroids after a step (one without members stays), and how far they went in all."""
    out = [(k, new.get(k) or x) for k, x in old]
    return out, float(np.linalg.norm(np.array([x for _, x in out]) - np.array([x for _, x in old])))


def k_means(items: DataFrame, seeds: list[tuple[int, list[float]]], rounds: int = 30, close: float = 1e-4) -> tuple[DataFrame, list[tuple[int, list[float]]]]:
    """CL1: spherical k-means from given seeds; members with ``cluster``, and the centroids.

    The driver holds centroids only, and each round is one pass over the items.
    """
    centroids = [(k, _unit(x)) for k, x in seeds]
    for _ in range(rounds):
        members = assigned(items, centroids)
        new = {r["cluster"]: list(r["centroid"]) for r in _mean(F.lit(1.0), "cluster", members.select("cluster", V.unit(F.col("vector")).alias("vector"))).collect()}
        centroids, moved = _moved(centroids, new)
        if moved < close:
            break
    return members, centroids


def memberships(items: DataFrame, centroids: list[tuple[int, list[float]]], m: float = 2.0) -> DataFrame:
    """CL3: ``id, vector, cluster, u``: shares that sum to 1, as distance to the power -2 / (m - 1)."""
    held = F.broadcast(items.sparkSession.createDataFrame([(centroids,)], "__held array<struct<cluster:int,centroid:array<double>>>"))

    def weight(c: Column) -> Column:
        cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), V.dot(F.col("__unit"), c["centroid"])))
        return F.struct(c["cluster"].alias("cluster"), F.pow(F.greatest(1 - cosine, F.lit(1e-9)), -2.0 / (m - 1)).alias("w"))

    each = items.select("id", "vector", V.unit(F.col("vector")).alias("__unit")).join(held).select("id", "vector", F.transform("__held", weight).alias("__w"))
    total = F.aggregate("__w", F.lit(0.0), lambda s, x: s + x["w"])
    return each.select("id", "vector", total.alias("__t"), F.explode("__w").alias("w")).select("id", "vector", "w.cluster", (F.col("w.w") / F.col("__t")).alias("u"))


def fuzzy_c_means(items: DataFrame, seeds: list[tuple[int, list[float]]], m: float = 2.0, rounds: int = 50, close: float = 1e-4) -> tuple[DataFrame, list[tuple[int, list[float]]]]:
    """CL3: memberships from given seeds until the centroids stand still."""
    centroids = [(k, _unit(x)) for k, x in seeds]
    for _ in range(rounds):
        shares = memberships(items, centroids, m).select("cluster", F.pow("u", F.lit(m)).alias("um"), V.unit(F.col("vector")).alias("vector"))
        new = {r["cluster"]: list(r["centroid"]) for r in _mean(F.col("um"), "cluster", shares).collect()}
        centroids, moved = _moved(centroids, new)
        if moved < close:
            break
    return memberships(items, centroids, m), centroids


def entropy(shares: DataFrame) -> DataFrame:
    """CL3: how undecided each item is: ``id, entropy``."""
    return shares.groupBy("id").agg((-F.sum(F.when(F.col("u") > 0, F.col("u") * F.log("u")).otherwise(0.0))).alias("entropy"))


def spread_seeds(items: DataFrame, k: int, sample: int = 2000, seed: int = 42) -> list[tuple[int, list[float]]]:
    """CL4: k-means++ seeds of a sample of about ``sample`` items, chosen by hash."""
    n = items.count()
    drawn = items if n <= sample else items.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < int((1 << 20) * sample / n))
    x = np.array([r["vector"] for r in drawn.select("id", "vector").orderBy("id").collect()], float)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    while len(chosen) < min(k, len(x)):
        apart = np.maximum(1 - (x @ x[chosen].T).max(axis=1), 0) ** 2
        chosen.append(int(rng.choice(len(x), p=apart / apart.sum())) if apart.sum() > 0 else len(chosen))
    return [(i, x[j].tolist()) for i, j in enumerate(chosen)]


def _linkage(x: np.ndarray, sizes: range) -> dict[int, np.ndarray]:
    """Labels of average linkage by cosine distance, for each number of clusters in ``sizes``; labels by first member."""
    n = len(x)
    far = 1 - x @ x.T
    np.fill_diagonal(far, np.inf)
    weight, alive, owner = np.ones(n), np.ones(n, bool), np.arange(n)
    out = {}
    for left in range(n, 0, -1):
        if left in sizes:
            out[left] = np.unique(owner, return_inverse=True)[1]
        if left == 1:
            break
        i, j = divmod(int(np.argmin(far)), n)
        i, j = min(i, j), max(i, j)
        far[i] = (far[i] * weight[i] + far[j] * weight[j]) / (weight[i] + weight[j])
        far[:, i] = far[i]
        far[i, i] = far[j, :] = far[:, j] = np.inf
        weight[i] += weight[j]
        alive[j] = False
        owner[owner == j] = i
    return out


def _chained(x: np.ndarray, sizes: range) -> dict[int, np.ndarray]:
    """``_linkage`` by chains of nearest neighbours, which holds the means of clusters in place of distances.

    The mean distance of two clusters of unit vectors follows from their means, so n means and one row of
    distances are held. Average linkage never brings a merged cluster nearer to a third than both parts were,
    so the pairs found, in the order of their distances, are those of ``_linkage`` but for ties.
    """
    n = len(x)
    mean, weight, head, off = x.copy(), np.ones(n), np.arange(n), np.zeros(n)
    left, chain, merges = n, [], []
    while left > 1:
        if left < len(mean) // 2:
            kept = np.flatnonzero(off == 0)
            spot = dict(zip(kept.tolist(), range(len(kept)), strict=True))
            mean, weight, head, off, chain = mean[kept], weight[kept], head[kept], off[kept], [spot[c] for c in chain]
        if not chain:
            chain = [int(np.argmax(off))]
        own = chain[-1]
        near = mean @ mean[own] + off
        near[own] = -np.inf
        best = int(np.argmax(near))
        if len(chain) < 2 or near[best] > near[chain[-2]]:
            chain.append(best)
            continue
        i, j = sorted((own, chain[-2]), key=lambda c: head[c])
        merges.append((1 - near[chain[-2]], head[i], head[j]))
        mean[i] = (mean[i] * weight[i] + mean[j] * weight[j]) / (weight[i] + weight[j])
        weight[i] += weight[j]
        off[j] = -np.inf
        left -= 1
        del chain[-2:]
    out, owner = {}, np.arange(n)
    if n in sizes:
        out[n] = owner
    for left, (_, i, j) in zip(range(n - 1, 0, -1), sorted(merges, key=lambda m: m[0]), strict=True):
        i, j = sorted((i, j))
        while owner[i] != i:
            owner[i] = i = owner[owner[i]]
        while owner[j] != j:
            owner[j] = j = owner[owner[j]]
        owner[max(i, j)] = min(i, j)
        if left in sizes:
            label = owner
            while not np.array_equal(label, label[label]):
                label = label[label]
            out[left] = np.unique(label, return_inverse=True)[1]
    return out


def _silhouette(x: np.ndarray, label: np.ndarray) -> float:
    sums = np.stack([x[label == k].sum(axis=0) for k in range(label.max() + 1)])
    n = np.bincount(label)
    each = x @ sums.T
    own = n[label]
    a = np.where(own > 1, (own - 1 - (each[np.arange(len(x)), label] - (x * x).sum(axis=1))) / np.maximum(own - 1, 1), 0)
    rest = 1 - each / n
    rest[np.arange(len(x)), label] = np.inf
    b = rest.min(axis=1)
    return float(np.where(own > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0).mean())


def agglomerative(items: DataFrame, by: str, n_clusters: int | None = None, least: int = 2, most: int = 20) -> DataFrame:
    """CL6: ``by, id, cluster``: average linkage by cosine within each group.

    Without ``n_clusters`` the number with the best silhouette of every (most - least) // 10th one is
    taken. Each merge needs those before, so a group is one task; it holds the group's vectors, and its
    time grows with the square of the group.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        x = np.array(group["vector"].tolist(), float)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        high = min(most, len(x) - 1)
        tried = sorted({min(n_clusters, len(x))} if n_clusters else {*range(least, high + 1, max(1, (high - least) // 10)), high} if high >= least else {min(2, len(x))})
        found = (_linkage if len(x) <= HELD else _chained)(x, tried)
        best = max(tried, key=lambda k: (_silhouette(x, found[k]) if 1 < k < len(x) else -1.0, -k))
        return pd.DataFrame({by: group[by], "id": group["id"], "cluster": found[best].astype("int32")})

    kinds = {c: items.schema[c].dataType.simpleString() for c in (by, "id")}
    return items.select(by, "id", "vector").groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, id {kinds['id']}, cluster int")


def density(items: DataFrame, by: str, least: int = 5, near: float = 0.5) -> DataFrame:
    """CL5: ``by, id, cluster`` by density within each group of any number of items; -1 is noise, null vectors are left out.

    Points with ``least`` neighbours within their mutual reach are linked by single linkage of mutual
    reachability distances up to ``near``; components of fewer than ``least`` points are noise. Two blocks
    of a group at a time hand on the components that their links make, a row for each point, and these
    are all that the group's own task joins.
    """
    kinds = {c: items.schema[c].dataType.simpleString() for c in (by, "id")}
    points = blocks.with_core(blocks.placed(items, by), by, least)

    def links(low: pd.DataFrame, high: pd.DataFrame) -> pd.DataFrame:
        one = high is low
        linked = np.maximum(blocks.distances(low, high), np.maximum(low["core"].to_numpy()[:, None], high["core"].to_numpy()[None])) <= near
        m, k = linked.shape
        x = np.arange(m) if one else np.arange(m + k)
        while True:  # the least point of those linked; the second set follows the first
            old, y = x, x if one else x[m:]
            new = np.where(linked, y[None], len(x)).min(axis=1)
            new = new if one else np.concatenate([new, np.where(linked, x[:m, None], len(x)).min(axis=0)])
            x = np.minimum(new, old)[np.minimum(new, old)]
            if np.array_equal(x, old):
                break
        place = low["place"].to_numpy() if one else np.concatenate([low["place"], high["place"]])
        ids = low["id"] if one else pd.concat([low["id"], high["id"]])
        keep = slice(None) if one else x != np.arange(len(x))
        return pd.DataFrame({by: low[by].iloc[0], "id": ids[keep], "place": place[keep], "other": place[x][keep]})

    def label(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows["place"].to_numpy(), rows["other"].to_numpy()
        own = rows.drop_duplicates("place").sort_values("place")
        label = np.arange(len(own))
        while True:
            new = label.copy()
            np.minimum.at(new, a, label[b])
            np.minimum.at(new, label[a], label[b])
            np.minimum.at(new, b, new[a])
            np.minimum.at(new, label[b], new[a])
            new = new[new]
            if np.array_equal(new, label):
                break
            label = new
        _, index, n = np.unique(label, return_inverse=True, return_counts=True)
        names = np.cumsum(n >= least) - 1
        return pd.DataFrame({by: own[by], "id": own["id"], "cluster": np.where(n[index] >= least, names[index], -1).astype("int32")})

    found = blocks.met(points, by, links, f"{by} {kinds[by]}, id {kinds['id']}, place long, other long")
    return found.groupBy(by).applyInPandas(label, f"{by} {kinds[by]}, id {kinds['id']}, cluster int")


def _sums(members: DataFrame) -> DataFrame:
    """Of each cluster its size and the sum of its unit vectors."""
    each = members.select("cluster", F.posexplode("unit").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    return each.groupBy("cluster").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda p: p["s"]).alias("sum"))


def quality(members: DataFrame) -> DataFrame:
    """CL8: one row with ``silhouette`` (cosine), ``davies_bouldin`` (Euclidean), ``n_clusters`` and ``noise_ratio`` of ``id, vector, cluster``.

    The mean cosine distance of a unit vector to a cluster follows from the cluster's sum, so no pairs
    of points are made: items meet clusters, and clusters each other.
    """
    noise = members.agg(F.avg((F.coalesce(F.col("cluster"), F.lit(-1)) == -1).cast("double")).alias("noise_ratio"))
    own = members.filter("cluster IS NOT NULL AND cluster <> -1").select("id", "cluster", V.unit(F.col("vector")).alias("unit"))
    sums = _sums(own)
    if sums.count() > MOST_CENTROIDS:
        raise ValueError(f"more than {MOST_CENTROIDS} clusters")
    sides = sums.select(F.col("cluster").alias("other"), "n", "sum")
    dots = own.join(F.broadcast(sides)).select("id", "cluster", "other", "n", V.dot(F.col("unit"), F.col("sum")).alias("dot"), V.dot(F.col("unit"), F.col("unit")).alias("self"))
    same = F.col("cluster") == F.col("other")
    inner = F.max(F.when(same & (F.col("n") > 1), (F.col("n") - F.col("self") - (F.col("dot") - F.col("self"))) / (F.col("n") - 1)))
    outer = F.min(F.when(~same, 1 - F.col("dot") / F.col("n")))
    each = dots.groupBy("id").agg(inner.alias("a"), outer.alias("b"))
    width = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    shape = each.agg(F.avg(width).alias("silhouette"))
    centres = sums.select("cluster", F.transform("sum", lambda s: s / F.col("n")).alias("centre"))
    apart = lambda x, y: F.sqrt(F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    scatter = own.join(F.broadcast(centres), "cluster").groupBy("cluster").agg(F.avg(apart(F.col("unit"), F.col("centre"))).alias("s"))
    one = centres.join(scatter, "cluster")
    two = one.select(F.col("cluster").alias("c2"), F.col("centre").alias("centre2"), F.col("s").alias("s2"))
    worst = one.join(F.broadcast(two), F.col("cluster") != F.col("c2")).groupBy("cluster").agg(F.max(F.try_divide(F.col("s") + F.col("s2"), apart(F.col("centre"), F.col("centre2")))).alias("r"))
    index = worst.agg(F.avg("r").alias("davies_bouldin"), F.count("*").alias("n_clusters"))
    return shape.join(index).join(noise)


def probe(queries: DataFrame, members: DataFrame, centroids: list[tuple[int, list[float]]], k: int, probes: int) -> DataFrame:
    """VS4: the first ``k`` items (``id, vector, cluster``) of the ``probes`` clusters nearest to each query; exact if all are probed.

    Members are written once, and queries meet those of their clusters in matrices.
    """
    cells = queries.join(_sent(queries.sparkSession, centroids)).withColumn("s", V.dot(V.unit(F.col("query")), F.col("centroid")))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("s").desc(), "cluster"))
    chosen = cells.withColumn("p", place).filter(F.col("p") <= probes).select("query_id", "query", "cluster")
    return best(chosen, settled(members.select("id", "vector", "cluster")), k, match=("cluster",))


def summaries(members: DataFrame, most: int = 5) -> DataFrame:
    """CL7: ``cluster, size, centroid, closest`` of members (``id, vector, cluster``): the unit mean of unit vectors, and the ids nearest to it by cosine (ties by id).

    Noise (-1) and members without a cluster or vector are in no summary. Sums are added up in each
    partition first; of a cluster the ``most`` best of each partition alone are sorted together.
    """
    rows = members.filter("cluster <> -1 AND vector IS NOT NULL").select("id", "cluster", V.unit(F.col("vector")).alias("unit"))
    means = _mean(F.lit(1.0), "cluster", rows, "unit")
    order = W.partitionBy("cluster").orderBy(F.col("near").desc(), "id")
    near = rows.join(means, "cluster").select("cluster", "id", F.round(V.dot(F.col("unit"), F.col("centroid")), 9).alias("near"))
    best = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    closest = best.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda p: p["id"]).alias("closest"))
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("size"))
    return sizes.join(means, "cluster").join(closest, "cluster").select("cluster", "size", "centroid", "closest")
