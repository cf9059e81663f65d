"""The chunk store on disk and its edge cases: nulls, repeated keys, empty tables, columns of clashing names."""

from pyspark.sql import functions as F

from lodestone.operators import store

SCHEMA = "chunk_id string, doc_id long, text string, layer string"


def rows(spark, *values):
    return spark.createDataFrame([(*v, "x") for v in values], SCHEMA)


def test_store_on_disk(spark, tmp_path):
    path = str(tmp_path / "store")
    store.write_store(rows(spark, ("a", 1, "one"), ("b", 1, "two"), ("c", 2, "three"), ("d", 3, None)), path, buckets=4)
    store.append_to_store(spark, rows(spark, ("a", 1, "changed"), ("e", 4, "new"), ("e", 4, "again")), path, "chunk_id", "text", buckets=4)
    held = lambda: {(r.chunk_id, r.doc_id, r.text) for r in spark.read.parquet(path).collect()}
    assert held() == {("a", 1, "one"), ("b", 1, "two"), ("c", 2, "three"), ("d", 3, None), ("e", 4, "again")}
    gone = spark.createDataFrame([(1,), (3,), (99,)], "doc_id long")
    assert store.rewrite_without(spark, path, gone, buckets=4) <= 3
    assert held() == {("c", 2, "three"), ("e", 4, "again")}
    assert store.rewrite_without(spark, path, gone.limit(0), buckets=4) == 0
    assert store.rewrite_without(spark, path, spark.createDataFrame([(2,), (4,)], "doc_id long"), buckets=4) > 0
    assert not [p for p in tmp_path.iterdir() if p.name != "store"] and not list((tmp_path / "store").rglob("*.parquet"))


def test_unseen(spark):
    stored = rows(spark, ("a", 1, "one"), (None, 1, "no key"))
    new = rows(spark, ("a", 1, "x"), ("b", 2, "second"), ("b", 2, "first"), (None, 3, "x"), (None, 3, "x"))
    found = store.unseen(stored, new, "chunk_id", "text").collect()
    assert sorted((r.chunk_id or "", r.doc_id, r.text) for r in found) == [("", 3, "x"), ("", 3, "x"), ("b", 2, "first")]
    assert store.unseen(stored, new.limit(0), "chunk_id", "text").count() == 0
    assert store.unseen(stored.limit(0), new, "chunk_id", "text").count() == 4


def test_upserted(spark):
    registry = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, "c", 3.0)], "doc_id long, title string, size double")
    changes = spark.createDataFrame([(1, "old", 1, "U"), (1, None, 2, "U"), (3, "x", 1, "D"), (4, "new", 1, "I"), (5, "in", 1, "I"), (5, "out", 2, "D"), (None, "no key", 1, "I")], "doc_id long, title string, seq int, op string")
    found = store.upserted(registry, changes, "doc_id", "seq", deleted=F.col("op") == "D", touched="changed")
    assert found.columns == ["doc_id", "title", "size", "changed"]
    assert {tuple(r) for r in found.collect()} == {(1, None, 1.0, True), (2, "b", None, False), (4, "new", None, True)}
    assert store.upserted(registry, changes.limit(0), "doc_id", "seq").count() == 3


def test_flattened_metadata(spark):
    given = spark.createDataFrame([("a", '{"page": 3, "title": "in"}', "own"), ("b", "{broken", "own"), ("c", None, None), ("d", '{"title": null}', "own")], "id string, metadata string, title string")
    found = store.flattened_metadata(given, "page int, title string").collect()
    assert {tuple(r) for r in found} == {("a", "in", 3), ("b", "own", None), ("c", None, None), ("d", "own", None)}


def test_deletion_and_issues(spark):
    tables = {"chunks": rows(spark, ("a", 1, "x"), ("b", 2, "y"), ("c", None, "z"))}
    gone = spark.createDataFrame([(1,), (1,), (None,)], "doc_id long")
    assert tuple(store.deletion_report(tables, gone).first()) == ("chunks", 1, 2, 1)
    assert {r.chunk_id for r in store.without_documents(tables, gone)["chunks"].collect()} == {"b", "c"}
    pages = lambda *x: spark.createDataFrame(x, "doc_id long, page int")
    found = store.index_issues(pages((1, 1), (1, 2), (2, None)), pages((1, 1), (1, None), (3, 1))).collect()
    assert {r.doc_id: (r.passed, r.issues) for r in found} == {
        1: (True, ["last page: expected 2, got 1", "without a page: 1"]),
        2: (False, ["count: expected 1, got 0"]),
        3: (False, ["count: expected 0, got 1"]),
    }


def test_hierarchical_path(spark):
    given = spark.createDataFrame([("d", "a > b"), ("d", ""), ("d", None)], "d string, p string")
    assert [r[0] for r in given.select(store.hierarchical_path(F.col("d"), F.col("p"))).collect()] == ["d > a > b", "d", "d"]
