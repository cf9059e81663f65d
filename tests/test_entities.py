"""Acronym matches in rounds against all pairs, and versions of one name."""

import math
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from lodestone.operators import entities as E
from lodestone.operators import search as S


def test_matches_in_rounds(spark, monkeypatch):
    """The first match by id may come in any round, and none is left out; the rounds were one join of all pairs."""
    monkeypatch.setattr(E, "FIRST", 2)
    monkeypatch.setattr(E, "WIDER", 2)
    dictionary = spark.createDataFrame([("EU", "european union")], "acronym string, expansion string")
    new = [(f"n{i}", "ab"[i % 2], f"EU {i * 7919 % 10000}") for i in range(12)] + [("n90", "a", "nothing like it"), ("n91", None, "EU 1"), ("k003", "b", "european union 3")]
    known = [(f"k{i:03}", "ab"[i // 2 % 2], f"european union {i * 104729 % 10000}" if i % 3 else f"union {i}") for i in range(120)]
    schema = "id string, type string, value string"
    got = {r.id: r.match for r in E.acronym_matches(spark.createDataFrame(new, schema), spark.createDataFrame(known, schema), dictionary).collect()}
    want = {}
    for i, t, v in new:
        forms = {v.lower(), v.lower().replace("eu ", "european union ") if v.startswith("EU ") else v.lower()}
        like = [k for k, u, w in known if u == t and k != i and any(SequenceMatcher(None, f, w).ratio() >= 0.85 for f in forms)]
        want |= {i: min(like)} if like else {}
    assert got == want and len(want) > 8
    assert E.acronym_matches(spark.createDataFrame([], schema), spark.createDataFrame(known, schema), dictionary).count() == 0


def test_semantic_matches_by_matrices(spark, monkeypatch):
    """each entity met all of its type in a join, row by row, in one task a type."""
    monkeypatch.setattr(S, "QUERIES", 5)
    monkeypatch.setattr(S, "CHUNK", 20)
    rng = random.Random(2)
    known = [(i, rng.choice([0, 1, 2, None]), [float(rng.randrange(-2, 3)) for _ in range(4)]) for i in range(120)]
    known += [(5, 1, [1.0, 2.0, 0.0, 1.0]), (None, 1, [1.0, 2.0, 0.0, 1.0]), (121, 0, [math.nan, 1.0, 1.0, 1.0]), (122, 0, None), (123, 0, [1.0, 1.0]), (124, 0, [1.0, None, 1.0, 1.0])]
    new = [x for x in known if x[0] is None or x[0] % 3 == 0 or x[0] > 119] + [(5, 0, [0.0, 1.0, 1.0, 1.0]), (200, 1, [0.0, 1.0, 1.0, -1.0]), (201, 9, [1.0, 1.0, 1.0, 1.0])]

    def cosine(a, b):
        usable = all(v and None not in v and any(v) and not any(map(math.isnan, v)) for v in (a, b)) and len(a) == len(b)
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)), 6) if usable else None

    want = {}
    for i, t, v in new:
        offers = [(-c, j) for j, u, w in known if t is not None and t == u and None not in (i, j) and i != j and (c := cosine(v, w)) is not None and c >= 0.7]
        want |= {i: min(offers + ([want[i]] if i in want else []))} if offers else {}
    schema = "id long, type int, vector array<float>"
    found = E.similar(spark.createDataFrame(new, schema.replace("long", "int")), spark.createDataFrame(known, schema), 0.7)
    assert {r.id: (-r.score, r.match) for r in found.collect()} == want and len(want) > 20 and found.count() == len(want)
    assert found.schema["id"].dataType.simpleString() == "int"
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan


def test_versions_meet_by_key_alone(spark):
    """Every pair of a name was made and then looked at; now each join is by equal keys, after which nothing is dropped."""
    rows = [(i, f"ISO {i % 2}:{1990 + i % 3}") for i in range(12)] + [(20, "Act v2"), (21, "act v10"), (22, "no version")]
    found = E.supersedes(spark.createDataFrame(rows, "id int, value string"))
    got = sorted(map(tuple, found.collect()))
    assert got == sorted([(a, b) for a in range(12) for b in range(12) if a % 2 == b % 2 and a % 3 > b % 3] + [(21, 20)])
    top = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in top.split("\n")[1] and ">" not in top.split("\n")[1]


def test_links_are_not_shuffled(spark):
    """every pair was shuffled to be made distinct; here are repeated ids, several norms, nulls and one norm that many name."""
    new = [(f"n{i}", "norma ISO 7 podle 3" if i % 2 else "norma ISO 7", ["a", "b", None][i % 3]) for i in range(150)]
    new += [("n0", "norma ISO 7", "b"), ("n1", "podle 3", "a"), (None, "podle 3", "a"), ("x", None, "a"), ("y", "nothing", "a")]
    known = [(f"k{i}", "iso 7", ["a", "b", None][i % 3]) for i in range(150)]
    known += [("k0", "3", "a"), ("k0", "ISO 7", "b"), ("k1", "3", None), (None, "ISO 7", "a"), ("z", None, "b"), ("w", "3", "a"), ("w", "3", "a")]
    left, right = spark.createDataFrame(new, "id string, value string, document string"), spark.createDataFrame(known, "id string, norm string, document string")
    context = spark.sparkContext._jsc.sc()

    def shuffled():
        context.listenerBus().waitUntilEmpty()
        stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = shuffled()
    got = [(r.src, r.tgt) for r in E.cross_links(left, right, E.REFERENCES, "REFERENCES", 0.8).collect()]
    assert shuffled() - before < 8000
    found = lambda v: {n for n, p in (("iso 7", "ISO 7"), ("3", "podle 3")) if v and p in v}
    want = {(s, t) for s, v, a in new for t, n, b in known if n and n.lower() in found(v) and a != b}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 14000


def test_lists_of_links_are_bounded(spark):
    """lists grew with the known entities, and few tasks wrote all links, as they were merged by what they read."""
    new = spark.range(4000).select(F.concat(F.lit("n"), "id").alias("id"), F.concat(F.lit("norma ISO "), F.col("id") % 3).alias("value"), (F.col("id") % 2).cast("string").alias("document"))
    known = spark.range(6000).select(F.concat(F.lit("k"), "id").alias("id"), F.concat(F.lit("ISO "), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 3)).alias("norm"), (F.col("id") % 4 % 3).cast("string").alias("document"))
    targets = E._by_norm(known.select(F.col("id").alias("tgt"), F.lower("norm").alias("norm"), "document"), "tgt").withColumn("__once", F.lit(True))
    sizes = [r.n for r in E._listed(targets).select(F.size("tgt").alias("n")).collect()]
    assert sum(sizes) == 6000 and max(sizes) <= 2 * E.LIST
    got = E.cross_links(new, known, E.REFERENCES, "REFERENCES", 0.8)
    want = new.select(F.col("id").alias("src"), F.substring("value", 7, 9).alias("norm"), "document").join(known.select(F.col("id").alias("tgt"), "norm", F.col("document").alias("other")), "norm").filter("document <> other")
    sums = lambda rows: rows.agg(F.count("*"), F.sum(F.xxhash64("src", "tgt") % 1000003)).first()
    assert sums(got) == sums(want) and sums(got)[0] > 3_000_000
    assert len({r.p for r in got.select(F.spark_partition_id().alias("p")).distinct().collect()}) > 8
