"""Results of experiments and logs of executions and errors, compared (AG11, AG12, AG16, AG18 to AG20, AG30)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import numbered
from .operations import share


def percentiles(rows: DataFrame, value: str, points: dict[str, float], *by: str) -> DataFrame:
    """AG16: exact percentiles of ``value`` by ``by`` (or of all), a column for each of ``points``, between two values by linear interpolation.

    Values are sorted by range over the whole cluster and the two that a point lies between are looked up
    by their place, so a group that holds a third of all rows, or all of them, is in no one task. Nulls are
    left out; groups without values have no row, and all rows without values one of nulls.
    """
    rows = rows.select(*by, F.col(value).cast("double").alias("__v")).filter("__v IS NOT NULL")
    placed = numbered(rows, *by, "__v", name="__n", first=0)
    groups = placed.groupBy(*by).agg(F.min("__n").alias("__first"), F.count("*").alias("__count")).filter("__count > 0")
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), (F.lit(p) * (F.col("__count") - 1)).alias("at")) for k, p in points.items()]))
    wanted = groups.select(*by, "__first", wanted.alias("__p")).select(*by, "__first", "__p.*")
    low = F.floor("at")
    ends = F.explode(F.array(F.struct(low.alias("k"), (1 - (F.col("at") - low)).alias("w")), F.struct(F.ceil("at").alias("k"), F.when(F.ceil("at") == low, 0.0).otherwise(F.col("at") - low).alias("w"))))
    ends = wanted.select(*by, "name", "__first", ends.alias("e")).select(*by, "name", (F.col("__first") + F.col("e.k")).alias("__n"), "e.w")
    found = ends.join(placed.select("__n", "__v"), "__n")
    return found.groupBy(*by).agg(*[F.sum(F.when(F.col("name") == k, F.col("__v") * F.col("w"))).alias(k) for k in points])


def summaries(rows: DataFrame, metrics: list[str], *by: str) -> DataFrame:
    """AG16: ``metric``, ``by``, and mean, deviation (of a population), median and 99th percentile of each metric's values; a metric without values has zeros."""
    out = []
    for metric in metrics:
        plain = rows.groupBy(*by).agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"))
        exact = percentiles(rows, metric, {"p50": 0.5, "p99": 0.99}, *by)
        # Each group has one row on each side; a null group is one, too, which a join would lose.
        both = plain.unionByName(exact, allowMissingColumns=True).groupBy(*by).agg(*[F.max(c).alias(c) for c in ("mean", "std", "p50", "p99")])
        out.append(both.select(F.lit(metric).alias("metric"), *by, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("mean", "std", "p50", "p99")]))
    return reduce(DataFrame.union, out)


def by_parameter(rows: DataFrame, parameter: str, metric: str) -> DataFrame:
    """AG18: mean, deviation (of a sample), least, most and number of a metric's values for each value of a parameter, to four places; rows without the parameter or any value of the metric have none."""
    x = F.col(metric)
    found = rows.filter(F.col(parameter).isNotNull()).groupBy(parameter).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.count(x).alias("count"))
    return found.select(parameter, *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max")], "count")


def best_by_method(rows: DataFrame, method: str, metric: str, order: str) -> DataFrame:
    """AG19: of each method the whole row of its largest metric, the first of ties in ``order``; by a partial aggregate."""
    top = F.max_by(F.struct(*rows.columns), F.struct(F.col(metric).alias("m"), (-F.col(order)).alias("o")))
    return rows.filter(F.col(metric).isNotNull()).groupBy(method).agg(top.alias("__row")).select("__row.*")


def improvements(rows: DataFrame, metric: str, baseline: Column, order: str) -> DataFrame:
    """AG20: ``rows`` with ``improvement_percent`` (two places; null over a baseline of 0) and ``improvement`` (four) over the first row in ``order`` for which ``baseline`` holds; an error if none does."""
    base = rows.filter(baseline).agg(F.min_by(metric, order).alias("__base"), F.count("*").alias("__found"))
    base = base.select(F.when(F.col("__found") == 0, F.raise_error(F.lit("no baseline row"))).otherwise(F.col("__base")).alias("__base"))
    more = F.col(metric) - F.col("__base")
    # One row on the other side.
    return rows.crossJoin(F.broadcast(base)).select(*rows.columns, F.round(F.try_divide(more, "__base") * 100, 2).alias("improvement_percent"), F.round(more, 4).alias("improvement"))


def comparison(reports: DataFrame, metric: str) -> DataFrame:
    """AG30: ``experiment, mean, std, success_rate, num_queries`` of reports (``experiment, report`` as JSON).

    The metric is a number or has ``mean`` and ``std``; what is missing is 0, and so is all of a broken report.
    """
    path = f"$.aggregate_metrics['{metric}']"
    number = lambda p: F.coalesce(F.get_json_object("report", p).try_cast("double"), F.lit(0.0))
    held = F.get_json_object("report", path)
    inner = lambda key: F.get_json_object(held, f"$.{key}").try_cast("double")
    mean = F.coalesce(held.try_cast("double"), inner("mean"), F.lit(0.0))
    return reports.select("experiment", mean.alias("mean"), F.coalesce(inner("std"), F.lit(0.0)).alias("std"), number("$.success_rate").alias("success_rate"), number("$.num_queries").cast("long").alias("num_queries"))


def execution_stats(executions: DataFrame) -> DataFrame:
    """AG11: ``scope, name`` and figures of executions (``agent, tool, success, duration_ms, tokens, was_hallucinated, validation_error``) in all (a row even of none), by agent and by tool.

    Unlike the outcomes of tool metrics these flags are counted each for itself. Rates are fractions but for ``success_percent``.
    """
    sums = [
        F.count("*").alias("executions"), F.count_if("success").alias("successful"), F.coalesce(F.sum("duration_ms"), F.lit(0.0)).alias("duration_ms"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.count_if("was_hallucinated").alias("hallucinated"), F.count_if(F.coalesce("validation_error", F.lit("")) != "").alias("invalid"),
    ]
    each = executions.groupingSets([["agent"], ["tool"]], "agent", "tool").agg(F.grouping("agent").alias("__a"), *sums)
    scope = F.when(F.col("__a") == 0, "agent").otherwise("tool")
    key = F.when(F.col("__a") == 0, F.col("agent")).otherwise(F.col("tool"))
    each = each.withColumns({"scope": scope, "name": F.coalesce(key, F.lit("(none)"))}).drop("agent", "tool", "__a")
    rows = executions.agg(*sums).withColumns({"scope": F.lit("all"), "name": F.lit(None).cast("string")}).unionByName(each)
    n = F.col("executions")
    return rows.select(
        "scope", "name", "executions", "successful", (n - F.col("successful")).alias("failed"), "duration_ms", "tokens",
        (share(F.col("successful"), n) * 100).alias("success_percent"), share(F.col("duration_ms"), n).alias("avg_duration_ms"), share(F.col("hallucinated"), n).alias("hallucination_rate"), share(F.col("invalid"), n).alias("validation_error_rate"),
    )


def error_stats(errors: DataFrame) -> DataFrame:
    """AG12: ``kind, key, n``: errors (``severity, type, agent, tool``) in all and by each of the four; missing and empty agents and tools count in no key."""
    required = [F.struct(F.lit(c).alias("kind"), F.coalesce(c, F.lit("(none)")).alias("key")) for c in ("severity", "type")]
    others = [F.struct(F.lit(c).alias("kind"), F.nullif(F.col(c), F.lit("")).alias("key")) for c in ("agent", "tool")]
    total = F.struct(F.lit("all").alias("kind"), F.lit("all").alias("key"))
    return errors.select(F.explode(F.array(total, *required, *others)).alias("k")).select("k.*").filter("key IS NOT NULL").groupBy("kind", "key").agg(F.count("*").alias("n"))
