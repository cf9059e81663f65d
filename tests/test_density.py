"""Density clusters against a walk down all thresholds, and shapes that one threshold can't tell apart."""

import numpy as np
import pytest

from lodestone.operators import blocks, clusters, density


def components(reach, points, limit):
    """Connected sets of ``points`` by distances below ``limit``."""
    left, out = set(points), []
    while left:
        todo, own = [left.pop()], []
        while todo:
            p = todo.pop()
            own.append(p)
            near = {q for q in left if reach[p, q] < limit}
            left -= near
            todo += near
        out.append(sorted(own))
    return out


def brute(reach, least):
    """Clusters by lowering the threshold distance by distance; distances are all different."""
    levels = sorted({reach[i, j] for i in range(len(reach)) for j in range(i)}, reverse=True)

    def grow(points, born, root):
        """(stability, clusters chosen within) of a cluster that begins with these points."""
        stability, now = 0.0, list(points)
        for limit in levels:
            parts = components(reach, now, limit)
            if len(parts) == 1:
                continue
            large = [p for p in parts if len(p) >= least]
            gone = sum(len(p) for p in parts if len(p) < least)
            stability += gone * (1 / limit - born)
            if len(large) > 1:
                stability += sum(map(len, large)) * (1 / limit - born)
                found = [grow(p, 1 / limit, False) for p in large]
                below = sum(s for s, _ in found)
                if not root and stability >= below:
                    return stability, [points]
                return below, [c for _, chosen in found for c in chosen]
            if not large:
                break
            now = large[0]
        return stability, [] if root else [points]

    label = np.full(len(reach), -1)
    for i, c in enumerate(sorted(grow(range(len(reach)), 0.0, True)[1], key=min)):
        label[list(c)] = i
    return label


def same(a, b):
    """Equal up to the numbers of clusters."""
    pairs = set(zip(a.tolist(), b.tolist(), strict=True))
    return len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs}) and all((x == -1) == (y == -1) for x, y in pairs)


@pytest.mark.parametrize("seed", range(12))
def test_against_all_thresholds(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(10, 45))
    centres = rng.normal(size=(4, 2)) * 3
    x = centres[rng.integers(4, size=n)] + rng.normal(size=(n, 2)) * rng.choice([0.2, 0.5, 1.5], size=(n, 1))
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    least = int(rng.integers(2, 6))
    # A tiny tilt keeps mutual reaches apart, as equal ones may be merged in any order.
    core = np.sort(far, axis=1)[:, least]
    tilt = rng.random((n, n)) * 1e-9
    reach = np.maximum(far, np.maximum(core[:, None], core[None])) + tilt + tilt.T
    np.fill_diagonal(reach, 0)
    assert same(density.labels_by_stability(reach, least), brute(reach, least))


def test_dense_and_loose_groups(spark):
    """Two tight bunches beside a loose one: no one distance makes three clusters of them and leaves the far point alone."""
    rng = np.random.default_rng(5)
    angle = np.concatenate([rng.normal(0.0, 0.01, 20), rng.normal(0.25, 0.01, 20), rng.normal(2.0, 0.15, 20), [4.5]])
    rows = [("g", i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angle)] + [("few", 0, [1.0, 0.0]), ("few", 1, None)]
    found = density.density_levels(spark.createDataFrame(rows, "grp string, id int, vector array<double>"), "grp", 5).collect()
    own = {r.id: r.cluster for r in found if r.grp == "g"}
    kinds = [{own[i] for i in range(a, a + 20)} - {-1} for a in (0, 20, 40)]
    assert all(len(k) == 1 for k in kinds) and len(set.union(*kinds)) == 3 and own[60] == -1
    assert [(r.id, r.cluster) for r in found if r.grp == "few"] == [(0, -1)]


def test_equal_points_and_limits(spark, monkeypatch):
    rows = spark.createDataFrame([(0, i, [1.0, 0.0] if i < 10 else [0.0, 1.0]) for i in range(20)], "grp int, id int, vector array<double>")
    found = {r.id: r.cluster for r in density.density_levels(rows, "grp", 5).collect()}
    assert found == {i: int(i >= 10) for i in range(20)}
    assert density.density_levels(rows.limit(0), "grp").count() == 0


def test_groups_of_many_blocks(spark, monkeypatch):
    """Groups beyond what one task held before, here in blocks of 16 points: equal to the whole matrix, ties, copies and a null group with them."""
    rng = np.random.default_rng(3)
    sizes = {1: 90, 2: 33, None: 16, 4: 1}
    vectors = {g: rng.normal(size=(n, 3)).round(1) + rng.integers(-1, 2, size=(n, 1)) for g, n in sizes.items()}
    vectors[1][40:50] = vectors[1][0]
    rows = [(g, i + (1 << 60), v.tolist()) for g, x in vectors.items() for i, v in enumerate(x)]
    items = spark.createDataFrame(rows, "g int, id long, vector array<double>")
    found = []
    for size in (16, 2048):
        monkeypatch.setattr(blocks, "BLOCK", size)
        found.append([sorted(map(repr, f.collect())) for f in (clusters.density(items, "g", 4, 0.05), density.density_levels(items, "g", 4))])
    assert found[0] == found[1]
    assert len(found[0][0]) == len(found[0][1]) == len(rows)
    labels = {r.id - (1 << 60): r.cluster for r in density.density_levels(items, "g", 4).collect() if r.g == 1}
    x = vectors[1] / np.maximum(np.linalg.norm(vectors[1], axis=1, keepdims=True), 1e-12)
    far = np.maximum(1 - x @ x.T, 0)
    np.fill_diagonal(far, 0)
    core = np.sort(far, axis=1)[:, 4]
    assert [labels[i] for i in range(90)] == density.labels_by_stability(np.maximum(far, np.maximum(core[:, None], core[None])), 4).tolist()


def test_more_points_than_one_matrix(spark):
    """5,001 points of a group were an error."""
    rng = np.random.default_rng(4)
    items = spark.createDataFrame([(0, i, x.tolist()) for i, x in enumerate(np.eye(3)[np.arange(5001) % 3] + rng.normal(scale=0.05, size=(5001, 3)))], "g int, id int, vector array<double>")
    for f in (lambda: clusters.density(items, "g", 5, 0.01), lambda: density.density_levels(items, "g", 1000), lambda: clusters.agglomerative(items, "g")):
        of = {}
        for r in f().collect():
            of.setdefault(r.id % 3, set()).add(r.cluster)
        assert len(of) == 3 and len(set.union(*of.values()) - {-1}) == 3


@pytest.mark.parametrize("seed", range(4))
def test_chains_of_neighbours(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(int(rng.integers(2, 200)), 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    whole, chained = clusters._linkage(x, range(1, 21)), clusters._chained(x, range(1, 21))
    assert whole.keys() == chained.keys() and all(np.array_equal(whole[k], chained[k]) for k in whole)
