"""The graph store by hand: loops, unknown ends, ties, repeated and null rows, empty tables."""

import pytest

from lodestone.operators import graph_store as G

EDGES = "rel string, src string, tgt string, id string"


@pytest.fixture(scope="module")
def graph(spark):
    edges = spark.createDataFrame([("a", "1", "2", "x"), ("b", "2", "1", "x"), ("a", "1", "1", "x"), ("a", "1", "gone", "x"), ("a", "3", "1", "x"), ("a", None, "1", "x")], EDGES).drop("id")
    entities = spark.createDataFrame([("1", "t"), ("2", "t"), ("3", "u"), ("3", "u")], "id string, type string")
    return entities, edges


def test_incident(spark, graph):
    entities, edges = graph
    asked = spark.createDataFrame([("1",), ("1",), ("9",), (None,)], "id string")
    both = sorted((r.side, r.rel, r.src or "", r.tgt) for r in G.incident(edges, asked).collect())
    assert both == [("in", "a", "3", "1"), ("in", "b", "2", "1"), ("out", "a", "1", "1"), ("out", "a", "1", "2"), ("out", "a", "1", "gone")]
    assert G.incident(edges, asked, "a", "in").count() == 3
    assert G.incident(edges, asked.limit(0)).count() == 0 and G.incident(edges.limit(0), asked).count() == 0
    with pytest.raises(ValueError):
        G.incident(edges, asked, side="up")


def test_neighbours(spark, graph):
    entities, edges = graph
    found = G.neighbours(entities, edges, entities.filter("id = '1'")).collect()
    assert sorted((r.side, r.rel, r.other) for r in found) == [("in", "a", "1"), ("in", "a", "3"), ("in", "b", "2"), ("out", "a", "1"), ("out", "a", "2")]
    assert G.by_type(entities, "t").count() == 2


def test_mentions(spark):
    rows = spark.createDataFrame([("c1", "e", 0.5), ("c2", "e", 0.5), ("c3", "e", None), ("c4", "e", 0.9), ("c9", "e", 1.0), ("c1", "f", 0.7)], "chunk string, id string, confidence double")
    chunks = spark.createDataFrame([(f"c{i}", f"text {i}") for i in range(1, 5)], "chunk string, content string")
    asked = spark.createDataFrame([("e",)], "id string")
    found = {r.chunk: (r.place, r.content) for r in G.entity_chunks(rows, chunks, asked, 3).collect()}
    assert found == {"c4": (1, "text 4"), "c1": (2, "text 1"), "c2": (3, "text 2")}
    assert [(r.id, r.place) for r in G.chunk_entities(rows, chunks.filter("chunk = 'c1'")).orderBy("place").collect()] == [("f", 1), ("e", 2)]


def test_merge(spark):
    schema = "type string, norm string, id string, value string, confidence double, at int"
    stored = spark.createDataFrame([("t", "a", "1", "A", 0.5, 9)], schema)
    batch = spark.createDataFrame([("t", "a", "2", "a", 0.9, 1), ("t", "a", "2", "a", 0.1, 2), ("t", "b", "4", "B2", 0.3, 2), ("t", "b", "3", "B1", None, 1), (None, "c", "5", "C", 1.0, 1), ("u", "a", "6", "A", 0.2, 1)], schema)
    nodes, done = G.merged_into(stored, batch)
    assert {tuple(r) for r in nodes.collect()} == {("t", "a", "1", "A", 0.9, "2", 1), ("t", "b", "3", "B1", 0.3, "4", 1), ("u", "a", "6", "A", 0.2, "6", 0)}
    assert tuple(done.first()) == (2, 3)
    assert tuple(G.merged_into(stored, batch.limit(0))[1].first()) == (0, 0)
    assert tuple(G.merged_into(stored.limit(0), batch.limit(0))[1].first()) == (0, 0)
    links = spark.createDataFrame([("t", "a", "c1"), ("t", "a", "c1"), ("t", "a", None)], "type string, norm string, chunk string")
    assert G.chunk_links(links, links).count() == 1


def test_document_subgraphs(spark, graph):
    _, edges = graph
    links = spark.createDataFrame([("d1", "2"), ("d1", "2"), ("d1", "1"), ("d2", "3"), (None, "1"), ("d3", None)], "doc_id string, id string")
    held, own = G.document_subgraphs(links, edges)
    assert held.count() == 3
    assert sorted((r.doc_id, r.src or "", r.tgt) for r in own.collect()) == [("d1", "", "1"), ("d1", "1", "1"), ("d1", "1", "2"), ("d1", "1", "gone"), ("d1", "2", "1"), ("d1", "3", "1"), ("d2", "3", "1")]


def test_dedup_stats(spark):
    resolved = spark.createDataFrame([("1", "exact"), ("2", "exact"), ("3", "semantic"), ("4", "new")], "id string, layer string")
    found = {r.layer: (r.matches, r.share, r.precision) for r in G.dedup_stats(resolved, {"semantic": 0.9}).collect()}
    assert found == {"exact": (2, 0.5, 1.0), "alias": (0, 0.0, 1.0), "semantic": (1, 0.25, 0.9), "acronym": (0, 0.0, 1.0), "all": (3, 0.75, None), "new": (1, 0.25, None)}
    assert {r.matches for r in G.dedup_stats(resolved.limit(0)).collect()} == {0}
