"""Costs, tools, workflows and runs by hand: no prices, nulls, ties, empty logs."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import usage as U

ENTRY = "provider string, model string, operation string, input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long, response_time_ms double, cost_of string"


@pytest.fixture(scope="module")
def entries(spark):
    rows = [("a", "m", "agent_x", 1_000_000, 1_000_000, 1_000_000, 5, 10.0, ""), ("a", "m", "agent_x", None, None, 15, None, None, ""), ("a", "none", "agent_agent_y", 10, 10, 10, 0, 1.0, ""), (None, None, "summary", 10, 0, 0, 0, 0.0, ""), ("a", "m", "agents", 0, 0, 0, 0, 0.0, "")]
    prices = spark.createDataFrame([("a", "m", 2.0, 8.0)], "provider string, model string, input double, output double")
    return U.priced(spark.createDataFrame(rows, ENTRY), prices)


def test_costs(entries):
    rows = entries.orderBy(F.col("cost").desc()).collect()
    assert [round(r.cost, 9) for r in rows] == [10.2, 0.000003, 0.0, 0.0, 0.0] and round(rows[0].saved, 9) == 1.8
    total = U.usage(entries).first()
    assert (total.calls, total.input_tokens, total.total_tokens, total.billed_tokens) == (5, 1_000_020, 3_000_055, 2_000_030 + 100_002)
    assert {r.operation: r.calls for r in U.usage(entries, "operation").collect()} == {"agent_x": 2, "agent_agent_y": 1, "summary": 1, "agents": 1}
    assert {r.agent: (r.call_count, r.cache_creation_tokens, r.response_time_ms) for r in U.agent_usage(entries).collect()} == {"x": (2, 5, 10.0), "agent_y": (1, 0, 1.0)}
    none = U.usage(entries.limit(0)).first()
    assert (none.calls, none.cost, none.billed_tokens) == (0, 0.0, 0)


def test_tools(spark):
    rows = spark.createDataFrame([("t", True, "bad", True, 1.0), ("t", False, "bad", True, 2.0), ("t", None, "", True, None), ("u", False, None, False, 4.0), ("u", None, None, None, 5.0)], "tool string, was_hallucinated boolean, validation_error string, success boolean, duration_ms double")
    found = {r.tool: r for r in U.tool_metrics(rows, "tool").collect()}
    t, u = found["t"], found["u"]
    assert (t.hallucinated, t.invalid, t.successful, t.failed, t.avg_duration_ms) == (1, 1, 1, 0, 1.0)
    assert (u.failed, u.success_rate, u.error_rate, u.hallucination_rate) == (2, 0.0, 1.0, 0.0)
    empty = U.tool_metrics(rows.limit(0)).first()
    assert (empty.total_calls, empty.success_rate, empty.error_rate, empty.avg_duration_ms) == (0, 1.0, 0.0, 0.0)


def test_workflows(spark):
    rows = [("w", "a", 1, True, 10.0, 5, 2, 1), ("w", "a", 2, False, None, None, None, None), ("w", "b", 0, True, 5.0, 1, 0, 0), ("v", "c", 1, True, 0.0, 0, 0, 0), ("x", "late", 2, True, 7.0, 0, 0, 0), ("x", "early", 1, None, 7.0, 0, 0, 0)]
    log = spark.createDataFrame(rows, "workflow string, agent string, at int, success boolean, duration_ms double, tokens long, tool_calls long, good_tool_calls long")
    found = {r.workflow: r for r in U.workflow_stats(log).collect()}
    w = found["w"]
    assert (w.agents, w.executions, w.successes, w.bottleneck, w.tokens) == (2, 3, 2, "b", 6)
    assert w.efficiency == pytest.approx(0.7 * 2 / 3 + 0.3 * 2 / 3)
    assert found["v"].bottleneck is None and found["x"].bottleneck == "early" and found["x"].success_rate == 0.5
    agents = {(r.workflow, r.agent): r for r in U.agent_stats(log).collect()}
    assert (agents["w", "a"].tool_success_rate, agents["w", "b"].tool_success_rate, agents["w", "a"].avg_duration_ms, agents["w", "a"].failures) == (0.5, 1.0, 5.0, 1)
    assert U.workflow_stats(log.limit(0)).count() == 0


def test_runs(spark):
    steps = spark.createDataFrame([("r", "action", "s", None), ("r", "action", "s", None), ("r", "action", "", None), ("r", "observation", None, 10.0), ("r", "observation", None, None), ("r", "thought", None, 99.0), ("gone", "action", "s", None)], "run string, step_type string, tool_name string, duration_ms double")
    runs = spark.createDataFrame([("r", 1, 1, 3), ("empty", 0, None, None), ("e2", 5, 2, 1)], "run string, iterations int, failed_tool_calls int, recoveries int").withColumn("started_at", F.lit("2024-03-30 23:59:59.5").cast("timestamp_ntz")).withColumn("ended_at", F.when(F.col("run") == "r", F.lit("2024-04-01 00:00:01").cast("timestamp_ntz")))
    found = {r.run: r for r in U.trajectory_metrics(steps, runs).collect()}
    r = found["r"]
    assert (r.total_steps, r.actions, r.observations, r.thoughts) == (6, 3, 2, 1)
    assert (r.tool_success_rate, r.avg_step_ms, r.total_ms, r.efficiency, r.recovery_rate) == (0.5, 5.0, 86_401_500.0, 0.5, 3.0) and r.tool_repetition_rate == pytest.approx(1 / 3)
    assert (found["empty"].total_steps, found["empty"].efficiency, found["empty"].recovery_rate, found["empty"].total_ms) == (0, 1.0, 0.0, 0.0)
    assert found["e2"].tool_success_rate == -2.0 and found["e2"].recovery_rate == 0.5
    rolled = U.workflow_rollup(U.trajectory_metrics(steps, runs)).first()
    assert (rolled.runs, rolled.total_steps) == (3, 6)
