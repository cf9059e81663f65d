"""Queries of experiments and logs over a shop's clicks, sales and items (AG11, AG12, AG16, AG18 to AG20, AG30)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import experiments as X
from .registry import query, table
from .usage import rounded

SPREAD = "round(avg({0}), 9) AS mean, round(stddev_pop({0}), 9) AS std, round(quantile_cont({0}, 0.5), 9) AS p50, round(quantile_cont({0}, 0.99), 9) AS p99"


@query("ag16_summary_of_sales", " UNION ALL ".join(f"SELECT '{c}' AS metric, status, {SPREAD.format(f'CAST({c} AS DOUBLE)')} FROM sales GROUP BY status" for c in ("total", "priority")))
def _(spark, d):
    return rounded(X.summaries(table(spark, d, "sales"), ["total", "priority"], "status"))


@query("ag16_summary_of_clicks", f"SELECT 'value' AS metric, {SPREAD.format('value')} FROM clicks")
def _(spark, d):
    """All clicks as one group."""
    return rounded(X.summaries(table(spark, d, "clicks"), ["value"]))


@query("ag18_prices_by_kind", "SELECT kind, round(avg(price), 4) AS mean, round(stddev_samp(price), 4) AS std, round(min(price), 4) AS min, round(max(price), 4) AS max, count(price) AS count FROM items WHERE kind IS NOT NULL GROUP BY kind")
def _(spark, d):
    return X.by_parameter(table(spark, d, "items"), "kind", "price")


@query("ag19_dearest_of_brands", "SELECT item_id, name, brand, price FROM items WHERE price IS NOT NULL QUALIFY row_number() OVER (PARTITION BY brand ORDER BY price DESC, item_id) = 1")
def _(spark, d):
    return X.best_by_method(table(spark, d, "items").select("item_id", "name", "brand", "price"), "brand", "price", "item_id")


@query("ag20_prices_over_baseline", "WITH b AS (SELECT arg_min(price, item_id) AS b FROM items WHERE kind = 'tools') SELECT item_id, round((price - b) / nullif(b, 0) * 100, 2) AS improvement_percent, round(price - b, 4) AS improvement FROM items, b")
def _(spark, d):
    """All prices over that of the first tool."""
    found = X.improvements(table(spark, d, "items").select("item_id", "kind", "price"), "price", F.col("kind") == "tools", "item_id")
    return found.select("item_id", "improvement_percent", "improvement")


@query("ag30_reports", "SELECT vendor_id AS experiment, CASE vendor_id % 3 WHEN 0 THEN coalesce(balance, 0) WHEN 1 THEN nation_id / 4 ELSE 0 END AS mean, CAST(CASE vendor_id % 3 WHEN 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS std, CAST(CASE vendor_id % 3 WHEN 2 THEN 0 ELSE 0.25 END AS DOUBLE) AS success_rate, CASE vendor_id % 3 WHEN 2 THEN 0 ELSE vendor_id END AS num_queries FROM vendors")
def _(spark, d):
    """Reports whose metric has a mean and a deviation, or is a number, or that are broken."""
    whole = F.to_json(F.struct(F.create_map(F.lit("ndcg@100"), F.struct(F.col("balance").alias("mean"), F.lit(0.5).alias("std"))).alias("aggregate_metrics"), F.lit(0.25).alias("success_rate"), F.col("vendor_id").alias("num_queries")))
    plain = F.to_json(F.struct(F.create_map(F.lit("ndcg@100"), F.col("nation_id") / 4).alias("aggregate_metrics"), F.lit(0.25).alias("success_rate"), F.col("vendor_id").alias("num_queries")))
    report = F.when(F.col("vendor_id") % 3 == 0, whole).when(F.col("vendor_id") % 3 == 1, plain).otherwise("{broken")
    return X.comparison(table(spark, d, "vendors").select(F.col("vendor_id").alias("experiment"), report.alias("report")), "ndcg@100")


EXECUTED = "SELECT 'c' || (client_id % 10) AS agent, kind AS tool, value < 100 AS success, value AS ms, click_id % 100 AS tokens, kind IS NULL AS h, CASE WHEN value < 0 THEN 'bad' ELSE '' END AS v FROM clicks"
FIGURES = "count(*) AS executions, count(*) FILTER (WHERE success) AS successful, count(*) - count(*) FILTER (WHERE success) AS failed, round(coalesce(sum(ms), 0), 6) AS duration_ms, CAST(sum(tokens) AS BIGINT) AS tokens, round(100 * (count(*) FILTER (WHERE success) / count(*)), 9) AS success_percent, round(coalesce(sum(ms), 0) / count(*), 6) AS avg_duration_ms, round(count(*) FILTER (WHERE h) / count(*), 9) AS hallucination_rate, round(count(*) FILTER (WHERE v <> '') / count(*), 9) AS validation_error_rate"


def clicks(spark, d):
    value = F.col("value")
    return table(spark, d, "clicks").select(F.concat(F.lit("c"), (F.col("client_id") % 10).cast("string")).alias("agent"), F.col("kind").alias("tool"), (value < 100).alias("success"), value.alias("duration_ms"), (F.col("click_id") % 100).alias("tokens"), F.col("kind").isNull().alias("was_hallucinated"), F.when(value < 0, "bad").otherwise("").alias("validation_error"))


@query("ag11_executions_of_clicks", f"SELECT 'all' AS scope, NULL AS name, {FIGURES} FROM ({EXECUTED}) UNION ALL SELECT 'agent', coalesce(agent, '(none)'), {FIGURES} FROM ({EXECUTED}) GROUP BY agent UNION ALL SELECT 'tool', coalesce(tool, '(none)'), {FIGURES} FROM ({EXECUTED}) GROUP BY tool")
def _(spark, d):
    found = rounded(X.execution_stats(clicks(spark, d)))
    return found.withColumns({c: F.round(c, 6) for c in ("duration_ms", "avg_duration_ms")})


@query("ag12_errors_of_clicks", "WITH e AS (SELECT CASE WHEN value < 100 THEN 'low' WHEN value >= 100 THEN 'high' END AS severity, 'k' || coalesce(kind, '') AS type, CASE WHEN client_id % 3 > 0 THEN 'c' || (client_id % 10) WHEN client_id % 2 = 0 THEN '' END AS agent, kind AS tool FROM clicks), k AS (SELECT unnest(['all', 'severity', 'type', 'agent', 'tool']) AS kind, unnest(['all', coalesce(severity, '(none)'), type, nullif(agent, ''), nullif(tool, '')]) AS key FROM e) SELECT kind, key, count(*) AS n FROM k WHERE key IS NOT NULL GROUP BY ALL")
def _(spark, d):
    client = F.col("client_id")
    agent = F.when(client % 3 > 0, F.concat(F.lit("c"), (client % 10).cast("string"))).when(client % 2 == 0, "")
    rows = table(spark, d, "clicks").select(F.when(F.col("value") < 100, "low").when(F.col("value") >= 100, "high").alias("severity"), F.concat(F.lit("k"), F.coalesce("kind", F.lit(""))).alias("type"), agent.alias("agent"), F.col("kind").alias("tool"))
    return X.error_stats(rows)
