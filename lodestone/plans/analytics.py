"""Cost, execution, conversation and statistics queries (AG*, CV*, WN*, TK*, J*, RD1)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .registry import query, table


def _t(name):
    return lambda spark, d: table(spark, d, name)


events, conversations, orders, customer, lineitem, part, nation, supplier = (_t(x) for x in "events conversations orders customer lineitem part nation supplier".split())
r6 = lambda x: F.round(x, 6)
n = lambda: F.count("*").alias("n")


@query("ag1_store_stats", "SELECT label AS layer, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT vec_id % 50) AS BIGINT) AS n_docs FROM embeddings GROUP BY label")
def _(spark, d):
    return table(spark, d, "embeddings").groupBy(F.col("label").alias("layer")).agg(n(), F.countDistinct(F.col("vec_id") % 50).alias("n_docs"))


@query("ag6_cost_by_operation", "SELECT event_type AS operation, round(sum(value), 4) AS cost, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def _(spark, d):
    return events(spark, d).groupBy(F.col("event_type").alias("operation")).agg(F.round(F.sum("value"), 4).alias("cost"), n())


@query("ag7_agent_breakdown", "SELECT 'agent_' || CAST(user_id % 7 AS VARCHAR) AS agent, CAST(count(*) AS BIGINT) AS calls, round(sum(value), 4) AS cost, round(avg(value), 6) AS latency FROM events WHERE event_type <> 'error' GROUP BY 1")
def _(spark, d):
    agent = F.concat(F.lit("agent_"), (F.col("user_id") % 7).cast("string"))
    return events(spark, d).filter("event_type <> 'error'").withColumn("agent", agent).filter(F.col("agent").startswith("agent_")).groupBy("agent").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("cost"), r6(F.avg("value")).alias("latency"))


@query("ag8_cost_formula", "WITH p AS (SELECT * FROM (VALUES ('click', 1.0, 5.0), ('view', 0.5, 2.0), ('purchase', 3.0, 15.0)) v(model, i, o)) SELECT event_id, round(coalesce(((user_id * 1000) * i + (event_id % 500) * o + (event_id % 100) * i * 0.1) / 1e6, 0), 9) AS cost FROM events LEFT JOIN p ON event_type = model")
def _(spark, d):
    prices = spark.createDataFrame([("click", 1.0, 5.0), ("view", 0.5, 2.0), ("purchase", 3.0, 15.0)], "model string, i double, o double")
    joined = events(spark, d).join(F.broadcast(prices), F.col("event_type") == F.col("model"), "left")
    cost = (F.col("user_id") * 1000 * F.col("i") + F.col("event_id") % 500 * F.col("o") + F.col("event_id") % 100 * F.col("i") * 0.1) / 1e6
    return joined.select("event_id", F.round(F.coalesce(cost, F.lit(0.0)), 9).alias("cost"))


@query("ag9_billed_tokens", "SELECT user_id, CAST(sum(event_id % 500 + event_id % 100 + CAST(floor(0.1::DOUBLE * (event_id % 1000)) AS BIGINT)) AS BIGINT) AS billed, round(sum((event_id % 1000) * 0.9::DOUBLE), 4) AS saved FROM events GROUP BY user_id")
def _(spark, d):
    e = F.col("event_id")
    return events(spark, d).groupBy("user_id").agg(F.sum(e % 500 + e % 100 + F.floor(e % 1000 * 0.1)).alias("billed"), F.round(F.sum(e % 1000 * 0.9), 4).alias("saved"))


@query("ag10_tool_metrics", "SELECT o.event_type, CAST(count(*) FILTER (WHERE c = 'hallucinated') AS BIGINT) AS hallucinated, CAST(count(*) FILTER (WHERE c = 'validation') AS BIGINT) AS validation, CAST(count(*) FILTER (WHERE c = 'success') AS BIGINT) AS success, round(count(*) FILTER (WHERE c = 'success') / count(*), 6) AS success_rate FROM (SELECT event_type, CASE WHEN event_id % 11 = 0 THEN 'hallucinated' WHEN event_id % 7 = 0 THEN 'validation' WHEN value > 10 THEN 'success' ELSE 'failed' END AS c FROM events) o GROUP BY 1")
def _(spark, d):
    outcome = F.when(F.col("event_id") % 11 == 0, "hallucinated").when(F.col("event_id") % 7 == 0, "validation").when(F.col("value") > 10, "success").otherwise("failed")
    count = lambda x: F.count_if(F.col("c") == x)
    return events(spark, d).withColumn("c", outcome).groupBy("event_type").agg(*[count(x).alias(x) for x in ("hallucinated", "validation", "success")], r6(count("success") / F.count("*")).alias("success_rate"))


@query("ag11_execution_stats", "SELECT user_id % 5 AS agent, event_type AS tool, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean FROM events GROUP BY GROUPING SETS ((user_id % 5), (event_type))")
def _(spark, d):
    rows = events(spark, d).select((F.col("user_id") % 5).alias("agent"), F.col("event_type").alias("tool"), "value")
    return rows.groupingSets([["agent"], ["tool"]], "agent", "tool").agg(n(), r6(F.avg("value")).alias("mean"))


@query("ag12_error_stats", "SELECT kind, key, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(['type', 'user', 'prop']) AS kind, unnest([event_type, CAST(user_id AS VARCHAR), json_extract_string(props, '$.k')]) AS key FROM events WHERE value < 20) WHERE key IS NOT NULL GROUP BY ALL")
def _(spark, d):
    keys = F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"), F.lit("prop"), F.get_json_object("props", "$.k"))
    return events(spark, d).filter("value < 20").select(F.explode(keys).alias("kind", "key")).filter("key IS NOT NULL").groupBy("kind", "key").agg(n())


@query("ag13_agent_efficiency", "WITH s AS (SELECT user_id, count(*) AS n, avg(value) AS lat, count(*) FILTER (WHERE value > 10) / count(*) AS ok, least(1, count(DISTINCT event_type) / count(*)) AS uniq FROM events GROUP BY user_id) SELECT user_id, CAST(n AS BIGINT) AS n, round(0.7 * ok + 0.3 * uniq, 6) AS efficiency, (SELECT max_by(user_id, (round(lat, 6), -user_id)) FROM s) AS bottleneck FROM s")
def _(spark, d):
    s = events(spark, d).groupBy("user_id").agg(n(), F.avg("value").alias("lat"), (F.count_if(F.col("value") > 10) / F.count("*")).alias("ok"), F.least(F.lit(1.0), F.countDistinct("event_type") / F.count("*")).alias("uniq"))
    slow = s.agg(F.max_by("user_id", F.struct(r6("lat"), -F.col("user_id"))).alias("bottleneck"))
    return s.select("user_id", "n", r6(0.7 * F.col("ok") + 0.3 * F.col("uniq")).alias("efficiency")).join(F.broadcast(slow))


@query("ag14_trajectory", "SELECT user_id, CAST(sum(c) AS BIGINT) AS steps, round(sum(c - 1) / sum(c), 6) AS repetition, round(least(1, 3.0 * count(*) / sum(c)), 6) AS efficiency FROM (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL) GROUP BY user_id")
def _(spark, d):
    each = events(spark, d).groupBy("user_id", "event_type").agg(F.count("*").alias("c"))
    return each.groupBy("user_id").agg(F.sum("c").alias("steps"), r6(F.sum(F.col("c") - 1) / F.sum("c")).alias("repetition"), r6(F.least(F.lit(1.0), 3.0 * F.count("*") / F.sum("c"))).alias("efficiency"))


@query("ag15_workflow_rollup", "SELECT round(avg(c), 6) AS mean_steps, CAST(max(c) AS BIGINT) AS most, CAST(count(*) AS BIGINT) AS n FROM (SELECT user_id, count(*) AS c FROM events GROUP BY user_id)")
def _(spark, d):
    each = events(spark, d).groupBy("user_id").agg(F.count("*").alias("c"))
    return each.agg(r6(F.avg("c")).alias("mean_steps"), F.max("c").alias("most"), n())


@query("ag16_eval_summary", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def _(spark, d):
    return events(spark, d).groupBy("event_type").agg(r6(F.avg("value")).alias("mean"), r6(F.stddev_pop("value")).alias("std"), r6(F.percentile("value", 0.5)).alias("p50"), r6(F.percentile("value", 0.99)).alias("p99"))


@query("ag18_group_by_parameter", "SELECT p_size, round(avg(p_retailprice), 4) AS mean, round(stddev_samp(p_retailprice), 4) AS std, round(min(p_retailprice), 4) AS low, round(max(p_retailprice), 4) AS high, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY p_size")
def _(spark, d):
    p = F.col("p_retailprice")
    return part(spark, d).groupBy("p_size").agg(F.round(F.avg(p), 4).alias("mean"), F.round(F.stddev_samp(p), 4).alias("std"), F.round(F.min(p), 4).alias("low"), F.round(F.max(p), 4).alias("high"), n())


@query("ag19_best_configuration", "SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn = 1")
def _(spark, d):
    best = F.row_number().over(W.partitionBy("p_brand").orderBy(F.col("p_retailprice").desc(), "p_partkey"))
    return part(spark, d).withColumn("rn", best).filter("rn = 1").select("p_brand", "p_partkey", "p_retailprice")


@query("ag20_improvement", "SELECT p_partkey, round(p_retailprice - b, 6) AS absolute, round((p_retailprice - b) / nullif(b, 0) * 100, 6) AS percent FROM part, (SELECT p_retailprice AS b FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part))")
def _(spark, d):
    base = part(spark, d).agg(F.min_by("p_retailprice", "p_partkey").alias("b"))
    more = F.col("p_retailprice") - F.col("b")
    return part(spark, d).join(F.broadcast(base)).select("p_partkey", r6(more).alias("absolute"), r6(F.try_divide(more, "b") * 100).alias("percent"))


@query("ag24_operation_stats", "SELECT user_id, round(avg(value), 6) AS mean, round(coalesce(count(*) FILTER (WHERE value > 50) / nullif(count(*), 0), 0), 6) AS hit_rate FROM events GROUP BY user_id")
def _(spark, d):
    return events(spark, d).groupBy("user_id").agg(r6(F.avg("value")).alias("mean"), r6(F.coalesce(F.try_divide(F.count_if(F.col("value") > 50), F.count("*")), F.lit(0.0))).alias("hit_rate"))


@query("ag25_median_by_group", "SELECT p_type, round(median(p_retailprice), 6) AS median FROM part GROUP BY p_type")
def _(spark, d):
    return part(spark, d).groupBy("p_type").agg(r6(F.median("p_retailprice")).alias("median"))


@query("ag26_page_range", "SELECT l_orderkey, min(l_linenumber) AS low, max(l_linenumber) AS high FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    return lineitem(spark, d).groupBy("l_orderkey").agg(F.min("l_linenumber").alias("low"), F.max("l_linenumber").alias("high"))


@query("ag27_distinct_documents", "SELECT DISTINCT source FROM documents ORDER BY source")
def _(spark, d):
    return table(spark, d, "documents").select("source").distinct().orderBy("source")


@query("ag28_label_rollup", "SELECT label, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS label FROM part) WHERE label <> 'STANDARD' GROUP BY label")
def _(spark, d):
    return part(spark, d).select(F.explode(F.split("p_type", " ")).alias("label")).filter("label <> 'STANDARD'").groupBy("label").agg(n())


@query("ag29_wide_metrics", "SELECT user_id, round(coalesce(sum(value) FILTER (WHERE event_type = 'click'), 0), 4) AS click, round(coalesce(sum(value) FILTER (WHERE event_type = 'view'), 0), 4) AS view FROM events GROUP BY user_id")
def _(spark, d):
    wide = events(spark, d).groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.sum("value"))
    return wide.select("user_id", *[F.round(F.coalesce(x, F.lit(0.0)), 4).alias(x) for x in ("click", "view")])


@query("ag31_last_admin", "SELECT c_nationkey, CAST(count(*) FILTER (WHERE c_acctbal > 9000) AS BIGINT) AS admins, count(*) FILTER (WHERE c_acctbal > 9000) = 1 AS last_admin FROM customer GROUP BY c_nationkey")
def _(spark, d):
    admins = F.count_if(F.col("c_acctbal") > 9000)
    return customer(spark, d).groupBy("c_nationkey").agg(admins.alias("admins"), (admins == 1).alias("last_admin"))


@query("ag32_token_totals", "SELECT CAST(sum(event_id % 500) AS BIGINT) AS input_tokens, CAST(sum(event_id % 100) AS BIGINT) AS output_tokens, CAST(sum(event_id % 1000) FILTER (WHERE event_type = 'view') AS BIGINT) AS cache_tokens FROM events")
def _(spark, d):
    e = F.col("event_id")
    return events(spark, d).agg(F.sum(e % 500).alias("input_tokens"), F.sum(e % 100).alias("output_tokens"), F.sum(F.when(F.col("event_type") == "view", e % 1000)).alias("cache_tokens"))


@query("ma5_currency", "SELECT o_orderkey, CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * 23.5, 2) AS DOUBLE) AS czk FROM orders")
def _(spark, d):
    return orders(spark, d).select("o_orderkey", F.round(F.col("o_totalprice").cast("decimal(18,2)") * F.lit("23.5").cast("decimal(4,1)"), 2).cast("double").alias("czk"))


@query("wn1_keep_first_messages", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn <= 3")
def _(spark, d):
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    return conversations(spark, d).withColumn("rn", place).filter("rn <= 3").select("conv_id", "turn")


@query("wn8_deltas", "SELECT event_id, user_id, round(total - coalesce(lag(total) OVER (PARTITION BY user_id ORDER BY event_id), 0), 4) AS delta FROM (SELECT *, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 4) AS total FROM events)")
def _(spark, d):
    by = W.partitionBy("user_id").orderBy("event_id")
    total = events(spark, d).withColumn("total", F.round(F.sum("value").over(by.rowsBetween(W.unboundedPreceding, 0)), 4))
    return total.select("event_id", "user_id", F.round(F.col("total") - F.lag("total", 1, 0.0).over(by), 4).alias("delta"))


@query("tk2_top_per_document", "SELECT l_orderkey, l_partkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rn FROM lineitem) WHERE rn <= 2")
def _(spark, d):
    rank = F.row_number().over(W.partitionBy("l_orderkey").orderBy(F.col("l_extendedprice").desc(), "l_linenumber"))
    return lineitem(spark, d).withColumn("rn", rank).filter("rn <= 2").select("l_orderkey", "l_partkey", "l_linenumber")


@query("tk4_top_configurations", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5")
def _(spark, d):
    return part(spark, d).select("p_partkey", "p_retailprice").orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(5)


@query("tk5_pages", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 40")
def _(spark, d):
    return customer(spark, d).select("c_custkey", "c_name").orderBy("c_custkey").offset(40).limit(20)


@query("tk8_adaptive_k", "SELECT p_partkey, CAST(least(50, greatest(3, least(p_size, 7000 // greatest(1, p_size * 10)))) AS BIGINT) AS k FROM part")
def _(spark, d):
    fits = F.floor(F.lit(7000) / F.greatest(F.lit(1), F.col("p_size") * 10))
    return part(spark, d).select("p_partkey", F.least(F.lit(50), F.greatest(F.lit(3), F.least("p_size", fits))).cast("long").alias("k"))


@query("j1_entity_chunks", "SELECT l_orderkey AS chunk_id, l_linenumber, l_quantity AS confidence FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey = (SELECT min(l_partkey) FROM lineitem) ORDER BY l_quantity DESC, l_orderkey, l_linenumber LIMIT 20")
def _(spark, d):
    first = lineitem(spark, d).agg(F.min("l_partkey").alias("l_partkey"))
    found = lineitem(spark, d).join(F.broadcast(first), "l_partkey").join(orders(spark, d), F.col("o_orderkey") == F.col("l_orderkey"))
    return found.select(F.col("l_orderkey").alias("chunk_id"), "l_linenumber", F.col("l_quantity").alias("confidence")).orderBy(F.col("confidence").desc(), "chunk_id", "l_linenumber").limit(20)


@query("j2_cooccurrence", "SELECT a.l_suppkey AS entity, b.l_suppkey AS co_entity, CAST(count(DISTINCT a.l_orderkey) AS BIGINT) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey GROUP BY ALL")
def _(spark, d):
    mentions = lineitem(spark, d).select("l_orderkey", "l_suppkey").distinct()
    a, b = (mentions.withColumnRenamed("l_suppkey", x) for x in ("entity", "co_entity"))
    return a.join(b, "l_orderkey").filter("entity <> co_entity").groupBy("entity", "co_entity").agg(n())


@query("j3_left_count", "SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def _(spark, d):
    counted = orders(spark, d).groupBy(F.col("o_custkey").alias("c_custkey")).agg(n())
    return customer(spark, d).select("c_custkey").join(counted, "c_custkey", "left").fillna(0, ["n"])


@query("j5_scalar_count", "SELECT n_nationkey, coalesce((SELECT CAST(count(*) AS BIGINT) FROM customer WHERE c_nationkey = n_nationkey), 0) AS n FROM nation")
def _(spark, d):
    counted = customer(spark, d).groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(n())
    return nation(spark, d).select("n_nationkey").join(counted, "n_nationkey", "left").fillna(0, ["n"])


@query("j6_semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def _(spark, d):
    return customer(spark, d).join(orders(spark, d).filter("o_totalprice > 100000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("j7_fanout_safe", "SELECT n_nationkey, CAST(count(DISTINCT c_custkey) AS BIGINT) AS customers, CAST(count(DISTINCT s_suppkey) AS BIGINT) AS suppliers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey")
def _(spark, d):
    c = customer(spark, d).groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    s = supplier(spark, d).groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    return nation(spark, d).select("n_nationkey").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").fillna(0)


@query("j13_dangling_edges", "SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS kept FROM orders")
def _(spark, d):
    known = customer(spark, d).filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    kept = orders(spark, d).join(known, "o_custkey", "left_semi").select("o_orderkey", F.lit(True).alias("kept"))
    return kept.union(orders(spark, d).join(known, "o_custkey", "left_anti").select("o_orderkey", F.lit(False)))


@query("so1_union_distinct", "SELECT user_id, CAST(len(list_distinct(list(event_type))) AS INT) AS n FROM events GROUP BY user_id")
def _(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.size(F.collect_set("event_type")).alias("n"))


@query("so2_bag_union", "SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def _(spark, d):
    return nation(spark, d).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).unionByName(table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")))


@query("so5_keep_first", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def _(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("cv1_history", "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 100")
def _(spark, d):
    last = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    return conversations(spark, d).withColumn("rn", last).filter("rn <= 100").select("conv_id", "turn", "role", "text")


@query("cv3_remaining_budget", "SELECT c_custkey, round(greatest(0, 500 - coalesce(sum(o_totalprice) / 1000, 0)), 4) AS remaining FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def _(spark, d):
    spent = orders(spark, d).groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.sum("o_totalprice") / 1000).alias("spent"))
    return customer(spark, d).select("c_custkey").join(spent, "c_custkey", "left").select("c_custkey", F.round(F.greatest(F.lit(0.0), 500 - F.coalesce("spent", F.lit(0.0))), 4).alias("remaining"))


@query("cv4_first_feedback", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def _(spark, d):
    return events(spark, d).groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("cv5_spending_check", "SELECT o_orderkey, coalesce(c_acctbal >= o_totalprice / 100, false) AS allowed FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(spark, d):
    joined = orders(spark, d).join(customer(spark, d), F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("o_orderkey", F.coalesce(F.col("c_acctbal") >= F.col("o_totalprice") / 100, F.lit(False)).alias("allowed"))


@query("cv6_partial_update", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'VIP' ELSE c_mktsegment END AS segment FROM customer")
def _(spark, d):
    new = customer(spark, d).filter("c_custkey % 4 = 0").select("c_custkey", F.lit("VIP").alias("new"))
    return customer(spark, d).join(new, "c_custkey", "left").select("c_custkey", F.coalesce("new", "c_mktsegment").alias("segment"))


@query("tg3_as_of_facts", "SELECT o_orderkey FROM (SELECT o_orderkey, o_orderdate AS valid_at, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS invalid_at FROM orders) WHERE valid_at <= TIMESTAMP '1996-01-01' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '1996-01-01')")
def _(spark, d):
    at = F.lit("1996-01-01").cast("timestamp")
    after = F.lead("o_orderdate").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return orders(spark, d).withColumn("invalid_at", after).filter((F.col("o_orderdate") <= at) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > at))).select("o_orderkey")


@query("tg4_timeline", "SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) IS NULL AS is_current FROM orders WHERE o_orderdate IS NOT NULL")
def _(spark, d):
    after = F.lead("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return orders(spark, d).filter("o_orderdate IS NOT NULL").select("o_custkey", "o_orderkey", after.isNull().alias("is_current"))
