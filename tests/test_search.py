"""Exact search by matrices against every cosine by itself, with copies, near ties, odd vectors and many blocks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestone.functions import text as T
from lodestone.functions import vectors as V
from lodestone.operators import clusters as C
from lodestone.operators import retrieval as R
from lodestone.operators import search as S


def tables(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 6)).round(2)
    x[50:90] = x[0]  # copies
    x[90:130] = x[1] * rng.integers(1, 5, size=(40, 1))  # one direction, other lengths
    x[130:140] = x[2] + rng.normal(scale=1e-7, size=(10, 6))  # apart by less than a score shows
    x[140] = 0
    rows = [(f"d{i:03}", v.tolist(), i % 4 if i % 9 else None) for i, v in enumerate(x)]
    rows += [("e", None, 1), ("f", [1.0, None, 2.0, 1.0, 1.0, 1.0], 1), ("g", [1.0, 2.0], 1), ("h", [], 1), ("d007", x[0].tolist(), 3), (None, x[0].tolist(), 0)]
    items = spark.createDataFrame(rows, "id string, vector array<double>, part int")
    queries = items.filter("id IN ('d000', 'd001', 'd002', 'd003', 'd060', 'd135', 'd140', 'd200', 'f', 'g', 'h', 'e')").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    return queries, items


def plain(frame):
    return sorted(map(repr, frame.collect()))


@pytest.mark.parametrize("queries_, chunk", [(4096, 32768), (3, 40)])
def test_against_every_cosine(spark, monkeypatch, queries_, chunk):
    monkeypatch.setattr(S, "QUERIES", queries_)
    monkeypatch.setattr(S, "CHUNK", chunk)
    queries, items = tables(spark)
    pairs = R.dense(queries, items)
    columns = ("query_id", "id", "score", "rank")
    for k in (1, 5, 60):
        assert plain(S.best(queries, items, k).select(*columns)) == plain(R.ranked(pairs, "score", k).select(*columns))
        other = pairs.filter("query_id <> id OR id IS NULL")
        assert plain(S.best(queries, items, k, itself=False).select(*columns)) == plain(R.ranked(other, "score", k).select(*columns))
    unique = items.filter("id IS NOT NULL AND id <> 'd007'")
    joined = R.dense(queries, unique).join(unique.select("id", "part"), "id")
    for k in (1, 4):
        assert plain(S.best(queries, unique, k, "part").select(*columns, "part")) == plain(R.ranked(joined, "score", k, "rank", "part").select(*columns, "part"))
    wanted = queries.withColumn("part", F.length("query_id") % 2 + 1)
    matched = joined.join(wanted.select("query_id", "part"), ["query_id", "part"])
    assert plain(S.best(wanted, unique, 3, match=("part",)).select(*columns)) == plain(R.ranked(matched, "score", 3).select(*columns))
    assert plain(S.above(queries, items, F.lit(0.4))) == plain(pairs.filter("score >= 0.4"))


def test_empty_and_no_pairs(spark):
    queries, items = tables(spark)
    assert S.best(queries.limit(0), items, 3).count() == S.best(queries, items.limit(0), 3).count() == 0


def test_no_join_of_all_pairs(spark):
    """The pairs were made by a join, row by row."""
    queries, items = tables(spark)
    plan = S.best(queries, items, 3)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_probes_by_matrices(spark, monkeypatch):
    """each query met every member of its clusters in a join, row by row."""
    monkeypatch.setattr(S, "QUERIES", 5)
    monkeypatch.setattr(S, "CHUNK", 40)
    queries, items = tables(spark)
    members = items.withColumn("cluster", F.col("part"))
    centroids = [(c, [float(c == i) for i in range(6)]) for c in range(4)]
    cells = queries.join(spark.createDataFrame(centroids, "cluster int, centroid array<double>"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(V.dot(V.unit(F.col("query")), F.col("centroid")).desc(), "cluster"))
    chosen = cells.withColumn("p", place).filter("p <= 2").drop("p")
    scored = chosen.join(members, "cluster").select("query_id", "id", V.cosine(F.col("query"), F.col("vector")).alias("score")).filter("score IS NOT NULL")
    found = C.probe(queries, members, centroids, 7, 2)
    assert plain(found) == plain(R.ranked(scored, "score", 7))
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_matches_go_to_their_own_bucket(spark, monkeypatch):
    """items went to every block of queries, also to those that match nothing of theirs."""
    rows = spark.range(1200).select("id", F.array(F.lit(1.0), F.col("id") + 1.0).alias("vector"), F.col("id") % 300)
    monkeypatch.setattr(S, "QUERIES", 100)
    items = rows.toDF("id", "vector", "part")
    queries = items.select(F.col("id").alias("query_id"), F.col("vector").alias("query"), F.col("part").cast("int").alias("part"))
    assert S._parts(S._bucketed(queries, ["part"], items), 100) == 1 and S._parts(S._bucketed(queries, [], items), 100) == 12
    pairs = R.dense(queries, items).join(items.select("id", F.col("part").alias("own")), "id").filter("query_id % 300 = own")
    assert plain(S.best(queries, items, 2, match=("part",)).select("query_id", "id", "score")) == plain(R.ranked(pairs, "score", 2).select("query_id", "id", "score"))


def test_rounding_is_sparks(spark):
    x = np.concatenate([np.random.default_rng(1).uniform(-1, 1, 2000), [0.1234565, -0.1234565, 0.0000005, -0.0000004, 1.0, 0.9999995, 0.1234564999999999, math.nan, 2.5e-7]])
    frame = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").select("i", F.round("x", 6).alias("r"))
    theirs = np.array([r.r for r in frame.orderBy("i").collect()])
    assert np.array_equal(S.rounded(x), theirs, equal_nan=True)


def test_words_in_one_pass(spark):
    """each text was rewritten twice and all of its words made distinct, for the few that queries ask for."""
    texts = [None, "", "  ", "!?", "Žluť_2 žluť-2 ŽLUŤ", "a b c a", "\tA\nb\x0bc\x1cd", "\U00010400x İ ǅ ² ½ é e", "x, x; y", "-a-"]
    items = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    queries = items.select(F.col("id").alias("query_id"), "text")
    tokens = {r.id: set(r.tokens or ()) for r in items.select("id", T.tokenize(F.col("text")).alias("tokens")).collect()}
    wanted = sorted((q, i, float(len(a & b))) for q, a in tokens.items() for i, b in tokens.items() if a & b)
    found = R.sparse(queries, items)
    assert sorted(map(tuple, found.select("query_id", "id", "score").collect())) == wanted
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct") == 2  # of queries, for what is asked and by whom
