"""Queries of usage logs over a shop's clicks and sales (AG6 to AG10, AG13 to AG15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import usage as U
from .registry import query, table


def rounded(rows, places=9):
    """Columns of floating-point numbers rounded, as sums depend on their order; to so many places that halves are rare."""
    return rows.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


ENTRY = """SELECT flag AS provider, 'm' || (item_id % 4) AS model, CAST(quantity AS BIGINT) * 100 AS input_tokens, CAST(line_no AS BIGINT) * 50 AS output_tokens, vendor_id * 10 AS cache_read_tokens, item_id % 7 AS cache_creation_tokens, CAST(line_no AS DOUBLE) AS response_time_ms,
CASE WHEN item_id % 3 = 0 THEN 'agent_' || flag WHEN item_id % 3 = 1 THEN 'summary' ELSE 'agent' END AS operation FROM sale_lines"""
PRICE = "SELECT flag AS provider, m.model, m.i, m.o FROM (SELECT DISTINCT flag FROM sale_lines) , (VALUES ('m0', 1.0, 5.0), ('m1', 0.5, 2.0), ('m2', 3.0, 15.0)) m(model, i, o)"
COSTED = f"SELECT e.*, coalesce(coalesce(input_tokens, 0) / 1e6 * i + coalesce(output_tokens, 0) / 1e6 * o + coalesce(cache_read_tokens, 0) / 1e6 * i * 0.1, 0) AS cost, coalesce(CASE WHEN cache_read_tokens > 0 THEN cache_read_tokens / 1e6 * i * 0.9 END, 0) AS saved FROM ({ENTRY}) e LEFT JOIN ({PRICE}) p ON p.provider = e.provider AND p.model = e.model"


def entries(spark, d):
    """Lines of sales as calls of models; one model in four has no price."""
    line = table(spark, d, "sale_lines")
    item = F.col("item_id")
    operation = F.when(item % 3 == 0, F.concat(F.lit("agent_"), "flag")).when(item % 3 == 1, "summary").when(item % 3 == 2, "agent").otherwise("agent")
    rows = line.select(
        F.col("flag").alias("provider"), F.concat(F.lit("m"), (item % 4).cast("string")).alias("model"), (F.col("quantity").cast("long") * 100).alias("input_tokens"), (F.col("line_no").cast("long") * 50).alias("output_tokens"),
        (F.col("vendor_id") * 10).alias("cache_read_tokens"), (item % 7).alias("cache_creation_tokens"), F.col("line_no").cast("double").alias("response_time_ms"), operation.alias("operation"),
    )
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(i).alias("input"), F.lit(o).alias("output")) for m, i, o in (("m0", 1.0, 5.0), ("m1", 0.5, 2.0), ("m2", 3.0, 15.0))])
    prices = line.select(F.col("flag").alias("provider")).distinct().select("provider", F.explode(models).alias("m")).select("provider", "m.*")
    return U.priced(rows, prices)


SUMS = "count(*) AS calls, round(coalesce(sum(cost), 0), 9) AS cost, round(coalesce(sum(saved), 0), 9) AS saved, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens, CAST(coalesce(sum(cache_read_tokens), 0) AS BIGINT) AS cache_read_tokens"
BILLED = f"SELECT *, input_tokens + output_tokens + cache_read_tokens AS total_tokens, input_tokens + output_tokens + CAST(floor(CAST(cache_read_tokens AS DOUBLE) * 0.1) AS BIGINT) AS billed_tokens FROM (SELECT {{0}}, {SUMS} FROM ({COSTED}) GROUP BY ALL)"


@query("ag6_usage_by_operation", BILLED.format("operation"))
def _(spark, d):
    return rounded(U.usage(entries(spark, d), "operation"))


@query("ag9_usage_by_model", BILLED.format("provider, model"))
def _(spark, d):
    return rounded(U.usage(entries(spark, d), "provider", "model"))


@query("ag7_agent_usage", f"SELECT operation[7:] AS agent, round(sum(cost), 9) AS cost, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens, CAST(coalesce(sum(cache_read_tokens), 0) AS BIGINT) AS cache_read_tokens, CAST(coalesce(sum(cache_creation_tokens), 0) AS BIGINT) AS cache_creation_tokens, round(coalesce(sum(response_time_ms), 0), 9) AS response_time_ms, count(*) AS call_count FROM ({COSTED}) WHERE starts_with(operation, 'agent_') GROUP BY 1")
def _(spark, d):
    return rounded(U.agent_usage(entries(spark, d)))


CALL = "SELECT coalesce(kind, 'none') AS tool, kind IS NULL AS h, CASE WHEN value < 0 THEN 'bad' WHEN value < 1 THEN '' END AS v, value < 100 AS s, value AS ms FROM clicks"
WHAT = f"SELECT *, CASE WHEN h THEN 'h' WHEN coalesce(v, '') <> '' THEN 'v' WHEN s THEN 's' ELSE 'f' END AS w FROM ({CALL})"


@query("ag10_tools_of_clicks", f"SELECT tool, total_calls, successful, failed, hallucinated, invalid, round(ms, 9) AS total_duration_ms, round(ms / total_calls, 9) AS avg_duration_ms, round(successful / total_calls, 9) AS success_rate, round(hallucinated / total_calls, 9) AS hallucination_rate, round((total_calls - successful) / total_calls, 9) AS error_rate FROM (SELECT tool, count(*) AS total_calls, count(*) FILTER (WHERE w = 's') AS successful, count(*) FILTER (WHERE w = 'f') AS failed, count(*) FILTER (WHERE w = 'h') AS hallucinated, count(*) FILTER (WHERE w = 'v') AS invalid, coalesce(sum(ms), 0) AS ms FROM ({WHAT}) GROUP BY 1)")
def _(spark, d):
    """Kinds of clicks as tools: none does not exist, values below 0 are not valid, those below 100 succeed."""
    value = F.col("value")
    rows = table(spark, d, "clicks").select(F.coalesce("kind", F.lit("none")).alias("tool"), F.col("kind").isNull().alias("was_hallucinated"), F.when(value < 0, "bad").when(value < 1, "").alias("validation_error"), (value < 100).alias("success"), value.alias("duration_ms"))
    return rounded(U.tool_metrics(rows, "tool"))


RUN = "SELECT client_id AS workflow, coalesce(status, 'none') AS agent, sold_at AS at_, total > 50 AS success, coalesce(total, 0) AS ms, coalesce(priority, 0) * 10 AS tokens, coalesce(priority, 0) AS calls, greatest(coalesce(priority, 0) - 1, 0) AS good FROM sales"


def executions(spark, d):
    """Sales as executions: the client's workflow, the status as agent."""
    priority = F.coalesce("priority", F.lit(0))
    return table(spark, d, "sales").select(F.col("client_id").alias("workflow"), F.coalesce("status", F.lit("none")).alias("agent"), F.col("sold_at").alias("at"), (F.col("total") > 50).alias("success"), F.col("total").alias("duration_ms"), (priority * 10).alias("tokens"), priority.alias("tool_calls"), F.greatest(priority - 1, F.lit(0)).alias("good_tool_calls"))


AGENTS = f"SELECT workflow, agent, count(*) AS executions, count(*) FILTER (WHERE success) AS successes, sum(ms) AS ms, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(calls) AS BIGINT) AS tool_calls, CAST(sum(good) AS BIGINT) AS good_tool_calls, min(at_) AS first_at FROM ({RUN}) GROUP BY ALL"


@query("ag13_agents_of_workflows", f"SELECT workflow, agent, executions, successes, executions - successes AS failures, round(ms, 9) AS duration_ms, tokens, tool_calls, good_tool_calls, round(successes / executions, 9) AS success_rate, round(ms / executions, 9) AS avg_duration_ms, round(tokens / executions, 9) AS avg_tokens, round(CASE WHEN tool_calls = 0 THEN 1 ELSE good_tool_calls / tool_calls END, 9) AS tool_success_rate FROM ({AGENTS})")
def _(spark, d):
    return rounded(U.agent_stats(executions(spark, d)).drop("first_at"))


@query("ag13_workflows", f"SELECT workflow, count(*) AS agents, CAST(sum(executions) AS BIGINT) AS executions, CAST(sum(successes) AS BIGINT) AS successes, round(sum(ms), 9) AS duration_ms, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tool_calls) AS BIGINT) AS tool_calls, round(sum(successes) / sum(executions), 9) AS success_rate, round(0.7::DOUBLE * (sum(successes) / sum(executions)) + 0.3::DOUBLE * least(1, count(*) / sum(executions)), 9) AS efficiency, arg_min(agent, (-round(ms / executions, 9), first_at, agent)) FILTER (WHERE ms / executions > 0) AS bottleneck FROM ({AGENTS}) GROUP BY 1")
def _(spark, d):
    return rounded(U.workflow_stats(executions(spark, d)))


STEP = "SELECT client_id AS run, CASE kind WHEN 'click' THEN 'action' WHEN 'view' THEN 'observation' WHEN 'error' THEN 'thought' ELSE 'other' END AS step, CASE WHEN kind = 'click' AND click_id % 5 > 0 THEN 't' || (click_id % 5) END AS tool, value AS ms FROM clicks"
METRICS = f"""SELECT client_id AS run, segment, coalesce(n, 0) AS total_steps, coalesce(a, 0) AS actions, coalesce(o, 0) AS observations, coalesce(t, 0) AS thoughts, (coalesce(o, 0) - client_id % 3) / greatest(coalesce(o, 0), 1) AS tool_success_rate, coalesce(again, 0) / greatest(coalesce(a, 0), 1) AS tool_repetition_rate, coalesce(ms, 0) / greatest(coalesce(o, 0), 1) AS avg_step_ms,
CASE WHEN updated_at IS NULL THEN 0 ELSE client_id % 5000 * 60000.0::DOUBLE END AS total_ms, least(1, CASE WHEN client_id % 50 > 0 THEN client_id % 50 * 3 ELSE 3 END / greatest(coalesce(n, 0), 1)) AS efficiency, client_id % 2 / greatest(client_id % 3, 1) AS recovery_rate
FROM clients LEFT JOIN (SELECT run, count(*) AS n, count(*) FILTER (WHERE step = 'action') AS a, count(*) FILTER (WHERE step = 'observation') AS o, count(*) FILTER (WHERE step = 'thought') AS t, sum(ms) FILTER (WHERE step = 'observation') AS ms FROM ({STEP}) GROUP BY 1) s ON s.run = client_id
LEFT JOIN (SELECT run, sum(c - 1) AS again FROM (SELECT run, tool, count(*) AS c FROM ({STEP}) WHERE step = 'action' AND tool IS NOT NULL GROUP BY ALL) GROUP BY 1) r ON r.run = client_id"""


def runs(spark, d):
    """Clients as runs, clicks as their steps, one call in five without a tool."""
    key = F.col("client_id")
    step = F.when(F.col("kind") == "click", "action").when(F.col("kind") == "view", "observation").when(F.col("kind") == "error", "thought").otherwise("other")
    tool = F.when((F.col("kind") == "click") & (F.col("click_id") % 5 > 0), F.concat(F.lit("t"), (F.col("click_id") % 5).cast("string")))
    steps = table(spark, d, "clicks").select(key.alias("run"), step.alias("step_type"), tool.alias("tool_name"), F.col("value").alias("duration_ms"))
    ended = F.col("updated_at") + F.make_dt_interval(mins=(key % 5000).cast("int"))
    own = table(spark, d, "clients").select(key.alias("run"), "segment", (key % 50).alias("iterations"), (key % 3).alias("failed_tool_calls"), (key % 2).alias("recoveries"), F.col("updated_at").alias("started_at"), ended.alias("ended_at"))
    return U.trajectory_metrics(steps, own), own


@query("ag14_runs", "SELECT run, total_steps, actions, observations, thoughts, " + ", ".join(f"round({c}, 9) AS {c}" for c in ("tool_success_rate", "tool_repetition_rate", "avg_step_ms", "total_ms", "efficiency", "recovery_rate")) + f" FROM ({METRICS})")
def _(spark, d):
    return rounded(runs(spark, d)[0])


@query("ag15_runs_by_segment", f"SELECT segment, count(*) AS runs, CAST(sum(total_steps) AS BIGINT) AS total_steps, round(sum(total_ms), 9) AS total_ms, round(avg(tool_success_rate), 9) AS tool_success_rate, round(avg(efficiency), 9) AS efficiency FROM ({METRICS}) GROUP BY 1")
def _(spark, d):
    metrics, own = runs(spark, d)
    return rounded(U.workflow_rollup(metrics.join(own.select("run", "segment"), "run"), "segment"))
