"""Clusters of densities at all levels, within groups of any number of points (CL5)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import blocks

CLOSEST = 1e-12  #: distances below this are one


def _spanning_tree(reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs and lengths of a shortest tree over all points, shortest edges first."""
    n = len(reach)
    near, by = reach[0].copy(), np.zeros(n, dtype=int)
    open_ = np.ones(n, dtype=bool)
    open_[0] = False
    pairs, lengths = np.empty((n - 1, 2), dtype=int), np.empty(n - 1)
    for i in range(n - 1):
        at = int(np.argmin(np.where(open_, near, np.inf)))
        pairs[i], lengths[i] = (by[at], at), near[at]
        open_[at] = False
        closer = open_ & (reach[at] < near)
        near[closer], by[closer] = reach[at][closer], at
    order = np.argsort(lengths, kind="stable")
    return pairs[order], lengths[order]


def _merges(pairs: np.ndarray, n: int) -> tuple[list[tuple[int, int]], list[int]]:
    """The two parts that each edge joins, and the sizes of all parts; points are parts 0 to n - 1, merges follow."""
    above, parts, sizes = list(range(2 * n - 1)), [], [1] * n

    def part(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    for i, (a, b) in enumerate(pairs):
        x, y = part(int(a)), part(int(b))
        above[x] = above[y] = n + i
        parts.append((x, y))
        sizes.append(sizes[x] + sizes[y])
    return parts, sizes


def _across(reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_spanning_tree`` of two sets of points, with the reachabilities from one to the other alone; points of the second follow the first."""
    m, k = reach.shape
    near, by = np.concatenate([np.full(m, np.inf), reach[0]]), np.zeros(m + k, dtype=int)
    open_ = np.ones(m + k, dtype=bool)
    open_[0] = False
    pairs, lengths = np.empty((m + k - 1, 2), dtype=int), np.empty(m + k - 1)
    for i in range(m + k - 1):
        at = int(np.argmin(near))
        pairs[i], lengths[i] = (by[at], at), near[at]
        open_[at], near[at] = False, np.inf
        side, row = (slice(m, m + k), reach[at]) if at < m else (slice(0, m), reach[:, at - m])
        closer = open_[side] & (row < near[side])
        near[side][closer], by[side][closer] = row[closer], at
    return pairs, lengths


def _shortest(pairs: np.ndarray, n: int) -> np.ndarray:
    """Which of all pairs, shortest first, join two parts."""
    above, kept = list(range(n)), []
    for i, (a, b) in enumerate(pairs.tolist()):
        while above[a] != a:
            above[a] = a = above[above[a]]
        while above[b] != b:
            above[b] = b = above[above[b]]
        if a != b:
            above[a] = b
            kept.append(i)
    return np.array(kept, dtype=int)


def labels_by_stability(reach: np.ndarray, least: int) -> np.ndarray:
    """``labels_of_tree`` of a matrix of reachabilities."""
    if len(reach) < 2 * least:
        return np.full(len(reach), -1)
    return labels_of_tree(*_spanning_tree(reach), len(reach), least)


def labels_of_tree(pairs: np.ndarray, lengths: np.ndarray, n: int, least: int) -> np.ndarray:
    """The most stable clusters of at least ``least`` of ``n`` points over all levels of a shortest tree, shortest edges first; -1 is noise.

    Going up in density a cluster lives until it falls apart into two of that size, points may leave it;
    its stability is how long its points stay, in density. A cluster is taken if it is more stable than
    those within it together. All points together are no cluster. Numbers go by the first point.
    """
    label = np.full(n, -1)
    if n < 2 * least:
        return label
    parts, sizes = _merges(pairs, n)
    density = 1 / np.maximum(lengths, CLOSEST)

    def points(at: int) -> list[int]:
        out, todo = [], [at]
        while todo:
            x = todo.pop()
            if x < n:
                out.append(x)
            else:
                todo += parts[x - n]
        return out

    def apart(at: int) -> list[int]:
        """The parts that a merge joins, with all merges of the same level below it, so that the order of equal edges is of no account."""
        out, todo = [], [at]
        while todo:
            for x in parts[todo.pop() - n]:
                (todo if x >= n and density[x - n] == density[at - n] else out).append(x)
        return out

    born, stability, inside, within = [0.0], [0.0], [[]], [[]]  # of each cluster: when, how stable, points that left it, clusters in it
    todo = [(2 * n - 2, 0)]
    while todo:
        at, own = todo.pop()
        while at >= n:
            level, below = density[at - n], apart(at)
            large = [x for x in below if sizes[x] >= least]
            for x in below:
                if sizes[x] < least:
                    left = points(x)
                    inside[own] += left
                    stability[own] += len(left) * (level - born[own])
            if len(large) > 1:
                for x in large:
                    stability[own] += sizes[x] * (level - born[own])
                    born.append(level), stability.append(0.0), inside.append([]), within.append([])
                    within[own].append(len(born) - 1)
                    todo.append((x, len(born) - 1))
            if len(large) != 1:
                break
            at = large[0]
        else:
            inside[own].append(at)
    taken = [False] * len(born)
    best = stability[:]
    for c in range(len(born) - 1, 0, -1):  # what is within a cluster has a higher number
        below = sum(best[x] for x in within[c])
        taken[c] = not within[c] or stability[c] >= below
        best[c] = max(stability[c], below)
    todo = [(x, -1) for x in within[0]]
    while todo:
        c, outer = todo.pop()
        own = outer if outer >= 0 else c if taken[c] else -1
        if own >= 0:
            label[inside[c]] = own
        todo += [(x, own) for x in within[c]]
    first = {c: i for i, c in enumerate(dict.fromkeys(label[label >= 0].tolist()))}
    return np.array([first.get(x, -1) for x in label.tolist()])


def density_levels(items: DataFrame, by: str, least: int = 5, samples: int | None = None) -> DataFrame:
    """CL5: ``by, id, cluster`` of items (``id, vector``) by the density of cosine distances at all levels, within each group; -1 is noise.

    A point's own reach is the distance to its ``samples``-th neighbour (``least`` if not given); two points
    reach each other at the largest of both reaches and their distance. All distances count: they are made
    for two blocks of a group at a time, which hand on their shortest trees; a shortest tree of all these
    edges is one of the group, and is all that the group's own task holds. Groups of fewer than twice
    ``least`` items are noise; null vectors are left out; ties go by id.
    """
    kinds = {c: items.schema[c].dataType.simpleString() for c in (by, "id")}
    points = blocks.with_core(blocks.placed(items, by), by, (samples or least) + 1)

    def trees(low: pd.DataFrame, high: pd.DataFrame) -> pd.DataFrame:
        one = high is low
        reach = np.maximum(blocks.distances(low, high), np.maximum(low["core"].to_numpy()[:, None], high["core"].to_numpy()[None]))
        pairs, lengths = _spanning_tree(reach) if one else _across(reach)
        place = low["place"].to_numpy() if one else np.concatenate([low["place"], high["place"]])
        edges = pd.DataFrame({"id": low["id"].iloc[0], "place": -1, "a": place[pairs[:, 0]], "b": place[pairs[:, 1]], "length": lengths})
        itself = pd.DataFrame({"id": low["id"], "place": low["place"], "a": -1, "b": -1, "length": -1.0})
        return (pd.concat([itself, edges]) if one else edges).assign(**{by: low[by].iloc[0]})

    def label(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["place"] >= 0].sort_values("place")
        edges = rows[rows["place"] < 0]
        edges = edges.sort_values(["length", "a", "b"])
        pairs = edges[["a", "b"]].to_numpy()
        kept = _shortest(pairs, len(own))
        found = labels_of_tree(pairs[kept], edges["length"].to_numpy()[kept], len(own), least)
        return pd.DataFrame({by: own[by], "id": own["id"], "cluster": found.astype("int32")})

    edges = blocks.met(points, by, trees, f"{by} {kinds[by]}, id {kinds['id']}, place long, a long, b long, length double")
    return edges.groupBy(by).applyInPandas(label, f"{by} {kinds[by]}, id {kinds['id']}, cluster int")
