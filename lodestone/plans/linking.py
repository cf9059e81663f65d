"""Entity resolution, cross-document links, definitions and temporal facts (ED*, J15 to J17, XD*, KG9, KG13, TG*, DA*)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import entities as E
from ..operators import temporal as T
from .graphs import EDGES, ENTITIES, edges, entities
from .registry import query, table
from .retrieval import COS, DENSE, asked, items
from .text import TOK, docs

KNOWN = "SELECT vec_id AS id, label % 4 AS type, embedding FROM embeddings"


@query("j15_ed3_semantic_match", f"WITH e AS ({KNOWN}), p AS (SELECT a.id, b.id AS match, {COS.format('a.embedding', 'b.embedding')} AS score FROM e a JOIN e b ON a.type = b.type AND a.id <> b.id WHERE a.id % 100 = 0) SELECT id, arg_min(match, (-score, match)) AS match, max(score) AS score FROM p WHERE score >= 0.3 GROUP BY id")
def _(spark, d):
    """Every hundredth vector as a new entity, all as known ones of its type; the corpus has no pair of .90, so .30 is asked."""
    own = items(spark, d).select("id", (F.col("label") % 4).alias("type"), "vector")
    return E.similar(own.filter("id % 100 = 0"), own, 0.3)


DICTIONARY = [("GRI", "global reporting initiative"), ("ISO", "international standards organisation"), ("EU", "european union")]


@query("j16_ed4_acronym_match")
def _(spark, d):
    """Parts under names with an acronym against the same ones spelled out."""
    dictionary = spark.createDataFrame(DICTIONARY, "acronym string, expansion string")
    part = table(spark, d, "part")
    short = F.element_at(F.array(*[F.lit(a) for a, _ in DICTIONARY]), (F.col("p_size") % 3 + 1).cast("int"))
    long = F.element_at(F.array(*[F.lit(x) for _, x in DICTIONARY]), (F.col("p_size") % 3 + 1).cast("int"))
    new = part.filter("p_partkey % 100 = 0").select(F.concat(F.lit("new:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("type"), F.concat(short, F.lit(" "), F.col("p_partkey").cast("string")).alias("value"))
    known = part.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("type"), F.concat(long, F.lit(" "), F.col("p_partkey").cast("string")).alias("value"))
    return E.acronym_matches(new, known, dictionary)


@query("j17_valid_at_many", "WITH f AS (SELECT o_orderkey, o_custkey, o_orderdate AS a, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders), t AS (SELECT n_nationkey AS k, TIMESTAMP '1994-01-01' + INTERVAL (n_nationkey * 60) DAY AS moment FROM nation) SELECT k, CAST(count(*) AS BIGINT) AS n FROM f JOIN t ON a <= moment AND (b IS NULL OR b > moment) GROUP BY k")
def _(spark, d):
    """Many points in time against all facts: the points are a table of 25 rows."""
    end = F.lead("o_orderdate").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    facts = table(spark, d, "orders").select(F.col("o_orderdate").alias("a"), end.alias("b"))
    at = F.lit("1994-01-01").cast("timestamp") + F.make_dt_interval(F.col("n_nationkey") * 60)
    points = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), at.alias("at"))
    return facts.join(F.broadcast(points), T.valid_at(F.col("a"), F.col("b"), F.col("at"))).groupBy("k").agg(F.count("*").alias("n"))


@query("ed13_alias_map", "SELECT lower(alias) AS alias, max(canonical) AS canonical FROM (SELECT unnest([canonical, a1, a2]) AS alias, canonical FROM (SELECT r_name AS canonical, r_name || ' region' AS a1, left(r_name, 3) AS a2 FROM region)) GROUP BY 1")
def _(spark, d):
    names = table(spark, d, "region").select(F.col("r_name").alias("canonical"), F.array(F.concat("r_name", F.lit(" region")), F.substring("r_name", 1, 3)).alias("aliases"))
    notes = spark.createDataFrame([("_comment", ["x"])], "canonical string, aliases array<string>")
    return E.alias_pairs(names.unionByName(notes))


@query("ed5_cascade", "WITH p AS (SELECT 'part:' || p_partkey AS id, lower(p_name) AS norm, p_brand AS type, p_partkey FROM part), x AS (SELECT id, min(id) OVER (PARTITION BY type, norm) AS match FROM p), b AS (SELECT 'part:' || p_partkey AS id, 'brand:' || CASE WHEN p_size < 10 THEN p_brand END AS match FROM part) SELECT x.id, CASE WHEN x.match <> x.id THEN x.match ELSE b.match END AS match, CASE WHEN x.match <> x.id THEN 'exact' WHEN b.match IS NOT NULL THEN 'alias' ELSE 'new' END AS layer FROM x JOIN b USING (id)")
def _(spark, d):
    """Exact names first, then an alias table; the first layer that offers a match wins."""
    part = table(spark, d, "part").withColumn("id", F.concat(F.lit("part:"), F.col("p_partkey").cast("string")))
    first = F.min("id").over(W.partitionBy("p_brand", F.lower("p_name")))
    exact = part.select("id", first.alias("match")).filter("id <> match")
    alias = part.filter("p_size < 10").select("id", F.concat(F.lit("brand:"), "p_brand").alias("match"))
    return E.cascade(part, exact=exact, alias=alias)


VALUES = "SELECT 'd' || doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'podle § ' || (doc_id % 50) || ' a zákona č. ' || (doc_id % 40) || '/1997' WHEN 1 THEN 'schválil Ministerstvo ' || source ELSE 'norma ISO ' || (doc_id % 30) END AS value, source AS document FROM documents"
NORMS = "SELECT 'k' || doc_id AS id, CASE doc_id % 4 WHEN 0 THEN CAST(doc_id % 60 AS VARCHAR) WHEN 1 THEN (doc_id % 40) || '/1997' WHEN 2 THEN 'ISO ' || (doc_id % 30) ELSE NULL END AS norm, source AS document FROM documents"


def values(spark, d):
    k, text = F.col("doc_id"), lambda x: x.cast("string")
    value = F.when(k % 3 == 0, F.concat(F.lit("podle § "), text(k % 50), F.lit(" a zákona č. "), text(k % 40), F.lit("/1997"))).when(k % 3 == 1, F.concat(F.lit("schválil Ministerstvo "), "source")).otherwise(F.concat(F.lit("norma ISO "), text(k % 30)))
    norm = F.when(k % 4 == 0, text(k % 60)).when(k % 4 == 1, F.concat(text(k % 40), F.lit("/1997"))).when(k % 4 == 2, F.concat(F.lit("ISO "), text(k % 30)))
    rows = docs(spark, d)
    return rows.select(F.concat(F.lit("d"), text(k)).alias("id"), value.alias("value"), F.col("source").alias("document")), rows.select(F.concat(F.lit("k"), text(k)).alias("id"), norm.alias("norm"), F.col("source").alias("document"))


@query("xd1_references", rf"WITH v AS ({VALUES}), k AS ({NORMS}), r AS (SELECT id, document, unnest(list_distinct(list_concat(list_concat(regexp_extract_all(lower(value), '§ (\d+)', 1), regexp_extract_all(lower(value), 'č\. (\d+/\d+)', 1)), regexp_extract_all(lower(value), 'norma (iso \d+)', 1)))) AS norm FROM v) SELECT DISTINCT r.id AS src, k.id AS tgt, 'REFERENCES' AS type, CAST(0.8 AS DOUBLE) AS confidence FROM r JOIN k ON lower(k.norm) = r.norm AND k.document <> r.document")
def _(spark, d):
    new, known = values(spark, d)
    return E.cross_links(new, known, E.REFERENCES, "REFERENCES", 0.8)


@query("xd3_issued_by", f"WITH v AS ({VALUES}), k AS (SELECT 'o' || r_regionkey AS id, 'ministerstvo src' AS norm, 'src' || r_regionkey AS document FROM region) SELECT v.id AS src, k.id AS tgt, 'ISSUED_BY' AS type, CAST(0.7 AS DOUBLE) AS confidence FROM v JOIN k ON v.document <> k.document WHERE starts_with(value, 'schválil')")
def _(spark, d):
    """An organisation\'s name has letters and white space only, so it ends before the digits of a source."""
    new, _ = values(spark, d)
    known = table(spark, d, "region").select(F.concat(F.lit("o"), F.col("r_regionkey").cast("string")).alias("id"), F.lit("Ministerstvo src").alias("norm"), F.concat(F.lit("src"), F.col("r_regionkey").cast("string")).alias("document"))
    return E.cross_links(new, known, E.ORGANISATIONS, "ISSUED_BY", 0.7)


@query("xd2_supersedes", "WITH n AS (SELECT p_partkey AS id, 'iso ' || p_partkey % 700 AS base, 1990 + p_size AS v FROM part) SELECT a.id AS newer, b.id AS older FROM n a JOIN n b ON a.base = b.base AND a.v > b.v")
def _(spark, d):
    name = F.concat(F.lit("ISO "), (F.col("p_partkey") % 700).cast("string"), F.lit(":"), (F.col("p_size") + 1990).cast("string"))
    return E.supersedes(table(spark, d, "part").select(F.col("p_partkey").alias("id"), name.alias("value")))


MENTIONS = "SELECT DISTINCT 's' || l_suppkey AS id, l_orderkey AS chunk FROM lineitem"
LINKED = "SELECT 's' || s_suppkey AS src, 's' || (s_suppkey * 7 % 100 + 1) AS tgt FROM supplier WHERE s_suppkey <= 100"
CANDIDATES = "SELECT l_suppkey % 10 AS query_id, l_orderkey AS chunk, round(max(l_discount) + max(l_quantity) / 1000, 6) AS score FROM lineitem WHERE l_orderkey % 50 = 0 GROUP BY ALL"
NAMED = "SELECT k AS query_id, 's' || (k * 3 + 1) AS id FROM range(0, 8) t(k)"


@query("kg9_graph_search", f"""WITH m AS ({MENTIONS}), g AS ({LINKED}), c AS ({CANDIDATES}), a AS ({NAMED}),
deg AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM g UNION ALL SELECT tgt FROM g WHERE src <> tgt) GROUP BY id), cen AS (SELECT id, n / (SELECT max(n) FROM deg) AS c FROM deg),
s AS (SELECT c.query_id, c.chunk, round(c.score + CASE WHEN c.query_id IN (SELECT query_id FROM a) THEN CASE WHEN EXISTS (SELECT 1 FROM a JOIN m USING (id) WHERE a.query_id = c.query_id AND m.chunk = c.chunk) THEN 0.3 ELSE 0 END + 0.15 * coalesce((SELECT max(cen.c) FROM m JOIN cen USING (id) WHERE m.chunk = c.chunk), 0) ELSE 0 END, 6) AS score FROM c),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk) AS rn FROM s) WHERE rn <= 10),
n1 AS (SELECT a.query_id, g.tgt AS id FROM a JOIN g ON g.src = a.id), nn AS (SELECT * FROM n1 UNION SELECT n1.query_id, g.tgt FROM n1 JOIN g ON g.src = n1.id),
l AS (SELECT f.query_id, f.chunk, round(f.score + CASE WHEN EXISTS (SELECT 1 FROM nn JOIN m USING (id) WHERE nn.query_id = f.query_id AND m.chunk = f.chunk) THEN 0.1 ELSE 0 END, 6) AS score FROM f)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk) AS INT) AS rank FROM l""")
def _(spark, d):
    name = lambda c: F.concat(F.lit("s"), c.cast("string"))
    line = table(spark, d, "lineitem")
    mentions = line.select(name(F.col("l_suppkey")).alias("id"), F.col("l_orderkey").alias("chunk")).distinct()
    linked = table(spark, d, "supplier").filter("s_suppkey <= 100").select(name(F.col("s_suppkey")).alias("src"), name(F.col("s_suppkey") * 7 % 100 + 1).alias("tgt"))
    found = line.filter("l_orderkey % 50 = 0").groupBy((F.col("l_suppkey") % 10).alias("query_id"), F.col("l_orderkey").alias("chunk")).agg(F.round(F.max("l_discount") + F.max("l_quantity") / 1000, 6).alias("score"))
    wanted = spark.range(8).select(F.col("id").alias("query_id"), name(F.col("id") * 3 + 1).alias("id"))
    return E.boosted(found, mentions, linked, wanted, 10)


# What kinds of entities are shown as.
KINDS = (("region", "place", "#4e79a7"), ("nation", "place", "#59a14f"), ("customer", "party", "#f28e2b"), ("supplier", "party", "#e15759"), ("part", "thing", "#76b7b2"))


@query("kg13_type_display", f"SELECT id, CASE WHEN type IN ('region', 'nation') THEN 'place' WHEN type = 'part' THEN 'thing' ELSE 'party' END AS category, CASE type WHEN 'region' THEN '#4e79a7' WHEN 'nation' THEN '#59a14f' WHEN 'customer' THEN '#f28e2b' WHEN 'supplier' THEN '#e15759' ELSE '#76b7b2' END AS colour FROM ({ENTITIES})")
def _(spark, d):
    kinds = spark.createDataFrame(KINDS, "type string, category string, colour string")
    return entities(spark, d).join(F.broadcast(kinds), "type", "left").select("id", F.coalesce("category", F.lit("other")).alias("category"), F.coalesce("colour", F.lit("#999999")).alias("colour"))


@query("tg2_entity_facts", f"SELECT e.id, x.rel, x.tgt AS other, 'out' AS side FROM ({ENTITIES}) e JOIN ({EDGES}) x ON x.src = e.id WHERE lower(e.value) = 'nation_3' UNION ALL SELECT e.id, x.rel, x.src, 'in' FROM ({ENTITIES}) e JOIN ({EDGES}) x ON x.tgt = e.id WHERE lower(e.value) = 'nation_3' AND x.src <> x.tgt")
def _(spark, d):
    return T.entity_facts(entities(spark, d), edges(spark, d), "NATION_3")


@query("tg5_paths", f"WITH RECURSIVE p(start, node, hops) AS (SELECT 'customer:' || c_custkey, 'customer:' || c_custkey, 0 FROM customer WHERE c_custkey % 100 = 0 UNION SELECT p.start, e.tgt, p.hops + 1 FROM p JOIN ({EDGES}) e ON e.src = p.node WHERE p.hops < 20) SELECT start, node, min(hops) AS hops FROM p GROUP BY ALL")
def _(spark, d):
    """From every hundredth customer to all that can be reached."""
    starts = table(spark, d, "customer").filter("c_custkey % 100 = 0").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("start"))
    return T.hops(edges(spark, d), starts)


FACTS = f"SELECT e.vec_id AS id, e.embedding, d.text, e.label % 3 AS type FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE e.label % 3 <> 2 AND (e.vec_id % 7 <> 0 OR e.vec_id % 5 = 0)"


@query("tg1_fact_search", f"""WITH f AS ({FACTS}), q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 100 = 0), w AS (SELECT item_id AS query_id, unnest({TOK.format('text')}) AS term FROM benchmark WHERE item_id % 100 = 0),
a AS (SELECT q.query_id, f.id, row_number() OVER (PARTITION BY q.query_id ORDER BY {COS.format('q.embedding', 'f.embedding')} DESC, f.id) - 1 AS r1 FROM q, f),
b AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, id) - 1 AS r2 FROM (SELECT w.query_id, p.id, count(*) AS n FROM w JOIN (SELECT id, unnest({TOK.format('text')}) AS term FROM f) p USING (term) GROUP BY ALL)),
m AS (SELECT query_id, id, r1, r2, count(r1) OVER w1 AS n1, count(r2) OVER w1 AS n2 FROM (SELECT * FROM a WHERE r1 < 50) a FULL JOIN (SELECT * FROM b WHERE r2 < 50) b USING (query_id, id) WINDOW w1 AS (PARTITION BY query_id)),
s AS (SELECT query_id, id, round(1.0 / (60 + coalesce(r1, n1)) + 1.0 / (60 + coalesce(r2, n2)), 9) AS score FROM m)
SELECT query_id, id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM s) WHERE rank < 5""")
def _(spark, d):
    """Facts of two types; those whose id 7 divides ended before the asked time, unless 5 does, too."""
    k = F.col("id")
    day = lambda x: F.lit(x).cast("timestamp")
    ended = F.when((k % 7 == 0) & (k % 5 != 0), day("2020-01-01"))
    facts = items(spark, d).join(docs(spark, d).select(F.col("doc_id").alias("id"), "text"), "id").select("id", (F.col("label") % 3).alias("type"), "vector", "text", day("2019-01-01").alias("valid_at"), ended.alias("invalid_at"))
    words = table(spark, d, "benchmark").filter("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "text")
    return T.search_facts(asked(spark, d).join(words, "query_id", "left"), facts, day("2021-01-01"), 5, [0, 1])


@query("da1_known_definitions", "SELECT p_name AS term, p_type || ' of ' || p_brand AS definition, round(0.5 + p_size / 100, 2) AS confidence FROM part WHERE p_partkey % 5 = 0")
def _(spark, d):
    part = table(spark, d, "part")
    key = F.col("p_partkey").cast("string")
    nodes = part.select(F.concat(F.lit("t"), key).alias("id"), F.col("p_name").alias("value")).unionByName(part.select(F.concat(F.lit("d"), key).alias("id"), F.concat("p_type", F.lit(" of "), "p_brand").alias("value")))
    links = part.select(F.concat(F.lit("d"), key).alias("src"), F.concat(F.lit("t"), key).alias("tgt"), F.when(F.col("p_partkey") % 5 == 0, "definition_of").otherwise("near").alias("type"), F.round(0.5 + F.col("p_size") / 100, 2).alias("confidence"))
    return E.known_definitions(nodes, links)


@query("da2_text_definitions", r"""WITH c AS (SELECT p_partkey AS chunk_id, CASE p_size % 3 WHEN 0 THEN '"Waste ' || p_brand || '" means ' || p_type || '. More' WHEN 1 THEN 'Solid waste: ' || p_name || '. Rest' ELSE 'Other thing (none)' END AS text, round(p_retailprice / 2000, 6) AS score, p_brand, p_type, p_name, p_size FROM part)
SELECT chunk_id, CASE WHEN p_size % 3 = 0 THEN 'Waste ' || p_brand ELSE 'Solid waste' END AS term, CASE WHEN p_size % 3 = 0 THEN trim(p_type) ELSE trim(split_part(p_name || '. Rest', '.', 1)) END AS definition, score FROM c WHERE score >= 0.1 AND p_size % 3 < 2""")
def _(spark, d):
    text = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit('"Waste '), "p_brand", F.lit('" means '), "p_type", F.lit(". More"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("Solid waste: "), "p_name", F.lit(". Rest"))).otherwise("Other thing (none)")
    found = table(spark, d, "part").select(F.col("p_partkey").alias("chunk_id"), text.alias("text"), F.round(F.col("p_retailprice") / 2000, 6).alias("score"))
    return E.definitions(found, "waste", 0.1)


@query("da3_aligned_definitions", "WITH g AS (SELECT p_brand AS term, p_name AS definition, round(0.5 + p_size / 100, 2) AS confidence FROM part WHERE p_partkey % 3 = 0), t AS (SELECT p_brand AS term, upper(p_name) AS definition, round(p_size / 50, 2) AS confidence FROM part WHERE p_partkey % 2 = 0), b AS (SELECT * FROM g UNION ALL SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.term = t.term AND lower(trim(g.definition)) = lower(trim(t.definition)))) SELECT term, definition, confidence, count(*) FILTER (WHERE confidence > 0.85) OVER (PARTITION BY term) > 1 AS conflict FROM b")
def _(spark, d):
    part = table(spark, d, "part")
    graph = part.filter("p_partkey % 3 = 0").select(F.col("p_brand").alias("term"), F.col("p_name").alias("definition"), F.round(0.5 + F.col("p_size") / 100, 2).alias("confidence"))
    text = part.filter("p_partkey % 2 = 0").select(F.col("p_brand").alias("term"), F.upper("p_name").alias("definition"), F.round(F.col("p_size") / 50, 2).alias("confidence"))
    return E.aligned(graph, text).select("term", "definition", "confidence", "conflict")
