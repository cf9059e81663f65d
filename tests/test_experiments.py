"""Experiments and logs by hand: percentiles of large and small groups, ties, nulls, no baseline, broken reports, empty logs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import experiments as X


def test_percentiles_against_numpy(spark):
    rng = np.random.default_rng(1)
    values = {"a": rng.normal(size=501).tolist(), "b": [3.0] * 40 + [7.0], "c": [2.5], None: rng.integers(0, 9, 60).astype(float).tolist(), "none": []}
    rows = spark.createDataFrame([(k, v) for k, x in values.items() for v in x] + [("none", None), ("a", None)], "g string, v double")
    found = {r.g: (r.p0, r.p50, r.p99, r.p100) for r in X.percentiles(rows, "v", {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}, "g").collect()}
    assert set(found) == {"a", "b", "c", None}
    for k in set(found):
        assert found[k] == pytest.approx(np.percentile(values[k], [0, 50, 99, 100]))
    whole = X.percentiles(rows, "v", {"p50": 0.5}).collect()
    assert [r.p50 for r in whole] == [pytest.approx(np.percentile([v for x in values.values() for v in x], 50))]
    assert [tuple(r) for r in X.percentiles(rows.limit(0), "v", {"p50": 0.5}).collect()] == [(None,)]
    assert X.percentiles(rows.limit(0), "v", {"p50": 0.5}, "g").count() == 0


def test_summaries(spark):
    rows = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, None), ("b", 5.0, 2.0), (None, 8.0, None)], "g string, x double, y double")
    found = {(r.metric, r.g): (r.mean, r.std, r.p50) for r in X.summaries(rows, ["x", "y"], "g").collect()}
    assert found == {("x", "a"): (2.0, 1.0, 2.0), ("x", "b"): (5.0, 0.0, 5.0), ("x", None): (8.0, 0.0, 8.0), ("y", None): (0.0, 0.0, 0.0), ("y", "a"): (0.0, 0.0, 0.0), ("y", "b"): (2.0, 0.0, 2.0)}
    assert [tuple(r) for r in X.summaries(rows.limit(0), ["x"]).collect()] == [("x", 0.0, 0.0, 0.0, 0.0)]


def test_configurations(spark):
    rows = spark.createDataFrame([(1, "m", 2.0), (2, "m", 4.0), (3, "m", 4.0), (4, "n", None), (5, None, 1.0), (6, "z", 0.0)], "id int, method string, score double")
    assert {r.method: r.id for r in X.best_by_method(rows, "method", "score", "id").collect()} == {"m": 2, None: 5, "z": 6}
    found = {r.method: (r["mean"], r["std"], r["count"]) for r in X.by_parameter(rows, "method", "score").collect()}
    assert found == {"m": (3.3333, 1.1547, 3), "n": (None, None, 0), "z": (0.0, None, 1)}
    more = {r.id: (r.improvement_percent, r.improvement) for r in X.improvements(rows, "score", F.col("method") == "m", "id").collect()}
    assert more == {1: (0.0, 0.0), 2: (100.0, 2.0), 3: (100.0, 2.0), 4: (None, None), 5: (-50.0, -1.0), 6: (-100.0, -2.0)}
    assert {r.improvement_percent for r in X.improvements(rows, "score", F.col("method") == "z", "id").collect()} == {None}
    with pytest.raises(Exception, match="no baseline row"):
        X.improvements(rows, "score", F.col("method") == "gone", "id").collect()


def test_reports(spark):
    rows = spark.createDataFrame([("a", '{"aggregate_metrics": {"ndcg@100": {"mean": 0.5, "std": 0.1}}, "success_rate": 1, "num_queries": 7}'), ("b", '{"aggregate_metrics": {"ndcg@100": 0.25}}'), ("c", '{"aggregate_metrics": {}}'), ("d", "{broken"), ("e", None)], "experiment string, report string")
    found = {r.experiment: tuple(r)[1:] for r in X.comparison(rows, "ndcg@100").collect()}
    assert found == {"a": (0.5, 0.1, 1.0, 7), "b": (0.25, 0.0, 0.0, 0), "c": (0.0,) * 3 + (0,), "d": (0.0,) * 3 + (0,), "e": (0.0,) * 3 + (0,)}


def test_logs(spark):
    log = spark.createDataFrame([("x", "t", True, 1.0, 5, True, "bad"), ("x", None, False, None, None, None, None), (None, "t", None, 3.0, 1, False, "")], "agent string, tool string, success boolean, duration_ms double, tokens long, was_hallucinated boolean, validation_error string")
    found = {(r.scope, r.name): r for r in X.execution_stats(log).collect()}
    assert set(found) == {("all", None), ("agent", "x"), ("agent", "(none)"), ("tool", "t"), ("tool", "(none)")}
    total = found["all", None]
    assert (total.executions, total.failed, total.tokens, total.avg_duration_ms) == (3, 2, 6, 4 / 3)
    assert (found["agent", "x"].success_percent, found["agent", "x"].hallucination_rate, found["tool", "t"].validation_error_rate) == (50.0, 0.5, 0.5)
    assert [(r.scope, r.executions, r.avg_duration_ms) for r in X.execution_stats(log.limit(0)).collect()] == [("all", 0, 0.0)]
    errors = spark.createDataFrame([("high", "io", "a", None), ("high", None, "", "t"), (None, "io", None, "t")], "severity string, type string, agent string, tool string")
    assert {tuple(r) for r in X.error_stats(errors).collect()} == {("all", "all", 3), ("severity", "high", 2), ("severity", "(none)", 1), ("type", "io", 2), ("type", "(none)", 1), ("agent", "a", 1), ("tool", "t", 2)}
    assert X.error_stats(errors.limit(0)).count() == 0
