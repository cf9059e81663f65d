"""What models and tools cost and how runs went, from logs (AG6 to AG10, AG13 to AG15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operations import share

CACHED = 0.1  #: of the input price, for tokens read from a cache


def _number(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def priced(entries: DataFrame, prices: DataFrame) -> DataFrame:
    """AG8, AG9: ``entries`` (``provider, model, input_tokens, output_tokens, cache_read_tokens``) with ``cost`` and ``saved``.

    ``prices`` has one row a provider and model: ``input, output`` for a million tokens. Tokens from a cache
    cost a tenth of the input; what that saves is ``saved``. Without a price both are 0; missing counts are 0.
    """
    price = prices.select("provider", "model", F.col("input").alias("__in"), F.col("output").alias("__out"))
    cached = _number("cache_read_tokens") / 1e6 * F.col("__in")
    cost = _number("input_tokens") / 1e6 * F.col("__in") + _number("output_tokens") / 1e6 * F.col("__out") + cached * CACHED
    joined = entries.join(price, ["provider", "model"], "left")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return joined.withColumns({"cost": zero(cost), "saved": zero(F.when(_number("cache_read_tokens") > 0, cached * (1 - CACHED)))}).drop("__in", "__out")


def usage(entries: DataFrame, *by: str) -> DataFrame:
    """AG6, AG9: of priced entries by ``by`` (or all): calls, cost, saved, tokens in all, and billed ones, where those from a cache are a tenth, rounded down over all."""
    sums = {x: F.coalesce(F.sum(x), F.lit(0)) for x in ("input_tokens", "output_tokens", "cache_read_tokens")}
    rows = entries.groupBy(*by).agg(F.count("*").alias("calls"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), F.coalesce(F.sum("saved"), F.lit(0.0)).alias("saved"), *[v.alias(k) for k, v in sums.items()])
    plain = F.col("input_tokens") + F.col("output_tokens")
    total, billed = plain + F.col("cache_read_tokens"), plain + F.floor(F.col("cache_read_tokens") * CACHED)
    return rows.select("*", F.greatest(total, F.lit(0)).alias("total_tokens"), F.greatest(billed, F.lit(0)).alias("billed_tokens"))


def agent_usage(entries: DataFrame) -> DataFrame:
    """AG7: of the priced entries whose operation is ``agent_<name>``: cost, tokens of all kinds, calls and response time of each agent."""
    own = entries.filter(F.startswith("operation", F.lit("agent_")))
    sums = [F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("cost", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "response_time_ms")]
    return own.groupBy(F.substring("operation", F.lit(7), F.length("operation")).alias("agent")).agg(*sums, F.count("*").alias("call_count"))


def outcome(hallucinated: Column, validation_error: Column, success: Column) -> Column:
    """AG10: what a call came to, the first of: a tool that does not exist, input that is not valid, success, failure."""
    return F.when(hallucinated, "hallucinated").when(F.coalesce(validation_error, F.lit("")) != "", "invalid").when(success, "successful").otherwise("failed")


def tool_metrics(executions: DataFrame, *by: str) -> DataFrame:
    """AG10: of executions (``was_hallucinated, validation_error, success, duration_ms``) by ``by`` (or all): calls of each outcome, their shares, and time.

    Without ``by`` there is a row even for no calls, of which all succeeded.
    """
    kinds = ("successful", "failed", "hallucinated", "invalid")
    what = outcome(F.col("was_hallucinated"), F.col("validation_error"), F.col("success"))
    rows = executions.withColumn("__what", what).groupBy(*by).agg(F.count("*").alias("total_calls"), *[F.count_if(F.col("__what") == k).alias(k) for k in kinds], F.coalesce(F.sum("duration_ms"), F.lit(0.0)).alias("total_duration_ms"))
    total = F.col("total_calls")
    success = F.when(total == 0, 1.0).otherwise(share(F.col("successful"), total))
    return rows.select("*", share(F.col("total_duration_ms"), total).alias("avg_duration_ms"), success.alias("success_rate"), share(F.col("hallucinated"), total).alias("hallucination_rate"), share(total - F.col("successful"), total).alias("error_rate"))


def agent_stats(executions: DataFrame) -> DataFrame:
    """AG13: of executions (``workflow, agent, at, success, duration_ms, tokens, tool_calls, good_tool_calls``) the figures of each agent in a workflow; no tool calls count as success."""
    rows = executions.groupBy("workflow", "agent").agg(
        F.count("*").alias("executions"), F.count_if("success").alias("successes"), F.sum(_number("duration_ms")).alias("duration_ms"), F.sum(_number("tokens")).alias("tokens"),
        F.sum(_number("tool_calls")).alias("tool_calls"), F.sum(_number("good_tool_calls")).alias("good_tool_calls"), F.min("at").alias("first_at"),
    )
    n = F.col("executions")
    tools = F.when(F.col("tool_calls") == 0, 1.0).otherwise(share(F.col("good_tool_calls"), F.col("tool_calls")))
    return rows.select("*", (n - F.col("successes")).alias("failures"), share(F.col("successes"), n).alias("success_rate"), share(F.col("duration_ms"), n).alias("avg_duration_ms"), share(F.col("tokens"), n).alias("avg_tokens"), tools.alias("tool_success_rate"))


def workflow_stats(executions: DataFrame) -> DataFrame:
    """AG13: each workflow: agents, executions, success rate, time, tokens, tool calls, efficiency, and the slowest agent on average.

    Efficiency is 0.7 of the success rate and 0.3 of the share of executions that were not another one of an
    agent. Of equally slow agents the one that ran first is the bottleneck; none if no agent took time.
    """
    each = agent_stats(executions)
    slow = F.when(F.col("avg_duration_ms") > 0, F.struct((-F.round("avg_duration_ms", 9)).alias("slow"), "first_at", "agent"))
    rows = each.groupBy("workflow").agg(F.count("*").alias("agents"), F.sum("executions").alias("executions"), F.sum("successes").alias("successes"), F.sum("duration_ms").alias("duration_ms"), F.sum("tokens").alias("tokens"), F.sum("tool_calls").alias("tool_calls"), F.min(slow).alias("__slow"))
    rate, reuse = share(F.col("successes"), F.col("executions")), F.least(F.lit(1.0), share(F.col("agents"), F.col("executions")))
    return rows.select(*[c for c in rows.columns if c != "__slow"], rate.alias("success_rate"), (0.7 * rate + 0.3 * reuse).alias("efficiency"), F.col("__slow.agent").alias("bottleneck"))


def milliseconds(span: Column) -> Column:
    """A time span in milliseconds."""
    part = lambda unit: F.extract(F.lit(unit), span).cast("double")
    return ((part("DAY") * 24 + part("HOUR")) * 60 + part("MINUTE")) * 60000 + part("SECOND") * 1000


def trajectory_metrics(steps: DataFrame, runs: DataFrame) -> DataFrame:
    """AG14: of each run (``run, iterations, failed_tool_calls, recoveries, started_at, ended_at``) with its ``steps`` (``run, step_type, tool_name, duration_ms``).

    Counts of steps by type; the share of observations that are no failed call; repeated calls of a tool
    as a share of actions; mean time of observations; time in all, 0 unless begun and ended; three steps
    an iteration (at least one) as a share of all steps; recoveries as a share of failed calls. A share of
    nothing has 1 below the line. A run without steps has counts of 0 and an efficiency of 1.
    """
    kind = lambda x: F.col("step_type") == x
    tools = steps.filter(kind("action") & (F.coalesce("tool_name", F.lit("")) != "")).groupBy("run", "tool_name").agg((F.count("*") - 1).alias("again"))
    repeated = tools.groupBy("run").agg(F.sum("again").alias("repeated"))
    counts = steps.groupBy("run").agg(F.count("*").alias("total_steps"), *[F.count_if(kind(x)).alias(f"{x}s") for x in ("action", "observation", "thought")], F.sum(F.when(kind("observation"), F.col("duration_ms"))).alias("__ms"))
    rows = runs.join(counts, "run", "left").join(repeated, "run", "left").na.fill(0, ["total_steps", "actions", "observations", "thoughts", "repeated"])
    at_least_one = lambda c: F.greatest(c, F.lit(1)).cast("double")
    expected = F.when(_number("iterations") > 0, F.col("iterations") * 3).otherwise(3)
    return rows.select(
        "run", "total_steps", "actions", "observations", "thoughts",
        ((F.col("observations") - _number("failed_tool_calls")) / at_least_one(F.col("observations"))).alias("tool_success_rate"),
        (F.col("repeated") / at_least_one(F.col("actions"))).alias("tool_repetition_rate"),
        (F.coalesce("__ms", F.lit(0.0)) / at_least_one(F.col("observations"))).alias("avg_step_ms"),
        F.coalesce(milliseconds(F.col("ended_at") - F.col("started_at")), F.lit(0.0)).alias("total_ms"),
        F.least(F.lit(1.0), expected / at_least_one(F.col("total_steps"))).alias("efficiency"),
        (_number("recoveries") / at_least_one(_number("failed_tool_calls"))).alias("recovery_rate"),
    )


def workflow_rollup(metrics: DataFrame, *by: str) -> DataFrame:
    """AG15: runs by ``by``: their number, steps and time in all, and means of success and efficiency."""
    return metrics.groupBy(*by).agg(F.count("*").alias("runs"), F.sum("total_steps").alias("total_steps"), F.sum("total_ms").alias("total_ms"), F.avg("tool_success_rate").alias("tool_success_rate"), F.avg("efficiency").alias("efficiency"))
