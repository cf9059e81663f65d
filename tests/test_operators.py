"""Operators that SQL can't express or only in part: brute force, hand-computed cases, round trips, streams."""

import json
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lodestone.functions import fuzzy
from lodestone.functions import text as T
from lodestone.operators import chunking, clusters, confidence, entities, hierarchy
from lodestone.operators import retrieval as R
from lodestone.sources import graph_files, markup, stages
from lodestone.streaming import limits, tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def brute_pack(parts, most):
    out, now, n = [], [], 0
    for s in parts:
        t = len(s) // 4
        if t > most:
            out += [" ".join(now)] if now else []
            now, n = [], 0
            out += [s[i : i + 4 * most] for i in range(0, len(s), 4 * most)]
        elif n + t > most:
            out += [" ".join(now)] if now else []
            now, n = [s], t
        else:
            now, n = [*now, s], n + t
    return out + ([" ".join(now)] if now else [])


def test_pack_against_a_loop(spark):
    rng = random.Random(2)
    cases = [["x" * rng.choice([3, 20, 41, 90, 300]) for _ in range(rng.randrange(0, 9))] for _ in range(60)]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, parts array<string>").select("i", chunking.pack(F.col("parts"), 16).alias("p")).collect()
    assert {r.i: r.p for r in rows} == {i: brute_pack(c, 16) for i, c in enumerate(cases)}


def test_layer3_numbers_have_gaps(spark):
    long = "This sentence is long enough to be kept as a chunk of its own."
    rows = [Row(doc_id=1, pos=0, char_start=0, content="Short."), Row(doc_id=1, pos=1, char_start=8, content=long)]
    assert [(r.chunk_id, r.char_start) for r in chunking.layer3(spark.createDataFrame(rows)).collect()] == [("1_L3_2", 8)]


def test_sentences_and_truncation(spark):
    assert one(spark, T.sentences(F.lit("One. Two! three? Čtyři. "))) == ["One.", "Two! three?", "Čtyři."]
    assert one(spark, T.truncate_at_sentence(F.lit("First one. Second one. Third."), 6)) == "First one. Second one."
    assert one(spark, T.truncate_at_sentence(F.lit("x" * 50), 5)) == "x" * 20 + "..."
    assert one(spark, T.truncate_at_word(F.lit("one  two\nthree four"), 3)) == "one two three..."
    assert one(spark, T.repair_diacritics(F.lit("zaˇrízení cˇas ˇ mimiřádný"))) == "zařízení čas  mimořádný"
    assert one(spark, T.duration(F.lit(75.0))) == "1.2m"


def test_fuzzy_ratio_is_the_librarys(spark):
    pairs = [("Kitten", "sitting"), ("", "a"), ("same", "SAME"), (None, "x")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fuzzy.fuzzy_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert [r.r for r in rows] == [None if a is None else SequenceMatcher(None, a.lower(), b.lower()).ratio() for a, b in pairs]


def test_acronyms_match_their_expansion(spark):
    dictionary = spark.createDataFrame([("GRI", "global reporting initiative")], "acronym string, expansion string")
    new = spark.createDataFrame([("n", "STANDARD", "GRI 306"), ("m", "TOPIC", "GRI 306")], "id string, type string, value string")
    known = spark.createDataFrame([("b", "STANDARD", "Global Reporting Initiative 306"), ("a", "STANDARD", "global reporting initiative 307"), ("c", "STANDARD", "waste")], "id string, type string, value string")
    assert {tuple(r) for r in entities.acronym_matches(new, known, dictionary).collect()} == {("n", "a")}  # the first by id wins


def test_failed_signals(spark):
    some = spark.createDataFrame([Row(query_id=0, id="a", score=2.0), Row(query_id=0, id="b", score=1.0)])
    rows = R.fuse({"orig": some, "hyde": None, "exp0": None, "exp1": None}, R.FOUR_SIGNALS, 5).collect()
    assert [(r["id"], r["fused"]) for r in rows] == [("a", 0.5), ("b", 0.0)]
    with pytest.raises(RuntimeError):
        R.merge_lists({"orig": None, "hyde": None})


def test_queries_in_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(0)
    items = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(40)], "id long, vector array<double>")
    queries = items.filter("id < 9").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    whole = sorted(map(tuple, R.dense(queries, items).collect()))
    monkeypatch.setattr(R, "QUERY_BYTES", 1000)
    assert len(R.blocks(queries, 600)) > 3
    assert sorted(map(tuple, R.dense(queries, items).collect())) == whole


def test_top_k_is_limited_before_the_shuffle(spark):
    scored = spark.range(1000).select((F.col("id") % 3).alias("query_id"), "id", F.rand(1).alias("score"))
    plan = R.ranked(scored, "score", 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_confidence_of_hand_made_results(spark):
    kinds = "query_id int, position int, document_id string, rerank_score double, boosted_score double, rrf_score double, score double, bm25_score double, dense_score double, graph_boost double"
    rows = [(1, 1, "d", 0.9, None, 0.03, None, 0.5, 0.5, 0.3), (1, 2, "d", 0.8, None, 0.02, None, 0.4, 0.4, None), (2, 1, None, None, None, 0.0, 0.4, None, None, None)]
    found = {r.query_id: r for r in confidence.confidence(spark.createDataFrame(rows, kinds)).collect()}
    first = 0.3 * 0.9 + 0.2 * (0.1 / 0.3) + 0.15 + 0.15 + 0.1 * (1 - 0.05 / 0.2) + 0.05 + 0.05 * 0.5
    assert found[1].confidence == pytest.approx(first, abs=1e-7) and found[1].band == "MEDIUM" and found[1].review
    assert found[1].impact == 0 and found[1].hybrid_search and not found[1].dense_only
    assert found[2].confidence == pytest.approx(0.3 * 0.4 + 0.15 * 0.5 + 0.1 + 0.05 * 0.5, abs=1e-7) and found[2].band == "VERY LOW"


def test_pages_between_neighbours(spark):
    kinds = "doc_id int, pos int, page int"
    rows = [(1, 0, 1), (1, 1, None), (1, 2, 4), (2, 0, None), (2, 1, None), (3, 0, 2), (3, 1, None), (3, 2, None), (3, 3, 9), (4, 0, None), (4, 1, 0)]
    got = {(r.doc_id, r.pos): r.page for r in hierarchy.fill_pages(spark.createDataFrame(rows, kinds)).collect()}
    assert got == {(1, 0): 1, (1, 1): 2, (1, 2): 4, (2, 0): 1, (2, 1): 1, (3, 0): 2, (3, 1): 5, (3, 2): 7, (3, 3): 9, (4, 0): 1, (4, 1): 0}


def test_deep_trees(spark):
    nodes = spark.createDataFrame([(i, i - 1 if i else None) for i in range(7)] + [(20, 21), (21, 20)], "id long, parent long")
    assert {r.id: r.depth for r in hierarchy.paths(nodes).collect()} == {i: i for i in range(7)}


def blobs(n=60, k=3, dim=8, seed=42):
    rng = np.random.default_rng(seed)
    centres = np.eye(dim)[:k] * 5
    x = np.concatenate([centres[i] + rng.normal(scale=0.4, size=(n // k, dim)) for i in range(k)])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_clusterings_find_three_blobs(spark):
    x = blobs()
    items = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "g int, id long, vector array<double>")
    truth = [i // 20 for i in range(60)]
    same = lambda labels: len(set(zip(labels, truth, strict=True))) == 3
    members, _ = clusters.k_means(items, [(0, x[0].tolist()), (1, x[25].tolist()), (2, x[50].tolist())])
    assert [r.cluster for r in members.orderBy("id").collect()] == truth
    assert same([r.cluster for r in clusters.agglomerative(items, "g").orderBy("id").collect()])
    assert same([r.cluster for r in clusters.density(items, "g", 5, 0.4).orderBy("id").collect()])
    shares, _ = clusters.fuzzy_c_means(items, [(0, x[0].tolist()), (1, x[25].tolist()), (2, x[50].tolist())], rounds=4)
    best = shares.groupBy("id").agg(F.max_by("cluster", "u").alias("c"), F.sum("u").alias("s")).orderBy("id").collect()
    assert [r.c for r in best] == truth and all(abs(r.s - 1) < 1e-9 for r in best)
    assert clusters.agglomerative(items.limit(0), "g").count() == 0


def test_cells_have_the_nearest(spark):
    """Recall of half the cells, and all of them exactly."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16)) + np.repeat(rng.normal(size=(20, 16)) * 2, 20, axis=0)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    queries = items.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    members, centroids = clusters.k_means(items, clusters.spread_seeds(items, 12), rounds=4)
    members = members.select("id", "vector", "cluster").cache()
    exact = {(r.query_id, r.id) for r in R.ranked(R.dense(queries, items), "score", 10).collect()}
    assert {(r.query_id, r.id) for r in clusters.probe(queries, members, centroids, 10, 12).collect()} == exact
    found = {(r.query_id, r.id) for r in clusters.probe(queries, members, centroids, 10, 6).collect()}
    assert len(found & exact) >= 0.9 * len(exact)


def test_repaired_json(spark):
    whole = '{"a": [1, 2], "b": "x"}'
    cases = [whole, f"```json\n{whole}\n```", f"Sure: {whole} as asked", '{"a": [1, 2,],}', '{"a": [1, 2], "b": "x', "no json", None, '[{"a": 1}, {"a"']
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string").select("i", markup.repaired_json(F.col("t")).alias("j")).collect()
    got = {r.i: r.j and json.loads(r.j) for r in rows}
    assert got == {0: json.loads(whole), 1: json.loads(whole), 2: json.loads(whole), 3: {"a": [1, 2]}, 4: {"a": [1, 2]}, 5: None, 6: None, 7: [{"a": 1}]}


def test_html_elements(spark):
    page = "<nav>x</nav><h1>A &amp; B</h1><p>one <b>two</b></p><script>p</script><ul><li>three<li>four</ul><p> </p><footer>end</footer>"
    rows = spark.createDataFrame([(1, page), (2, None)], "doc_id int, html string")
    got = [(r.pos, r.category, r.text) for r in markup.elements(rows, markup.html_elements(F.col("html"))).orderBy("pos").collect()]
    assert got == [(0, "Title", "A & B"), (1, "NarrativeText", "one two"), (2, "ListItem", "three"), (3, "ListItem", "four"), (4, "Footer", "end")]


def test_graph_files_round_trip(spark, tmp_path):
    import xml.etree.ElementTree as ET

    nodes = spark.createDataFrame([("n1", "A & <b>", "t", "a", 0.5), ("n2", 'q"q', "t", "q", 1.0)], "id string, value string, type string, norm string, confidence double")
    edges = spark.createDataFrame([("n1", "n2", "r")], "src string, tgt string, rel string")
    graph_files.write_json(nodes, edges, str(tmp_path / "g"))
    back, links = graph_files.read_json(spark, str(tmp_path / "g"))
    assert back.count() == 2 and [tuple(r) for r in links.collect()] == [("n1", "n2", "r")]
    for kind in ("gexf", "graphml"):
        graph_files.write_xml(nodes, edges, str(tmp_path / kind), kind)
        text = "".join(p.read_text() for p in sorted((tmp_path / kind).glob("part-*")))
        root = ET.fromstring(text)
        assert len(list(root.iter("node"))) == 2 and len(list(root.iter("edge"))) == 1
    graph_files.write_csv(nodes, edges, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv/nodes")).count() == 2


def test_stage_files(spark, tmp_path):
    for folder, files in {"a": {1: True, 2: True, 3: True}, "b": {1: True, 3: True}, "c": {1: True, 2: False}, "d": {1: None}}.items():
        (tmp_path / folder).mkdir()
        for k, ok in files.items():
            body = {x: 1 for x in stages.FIELDS[k]} if ok else {"document_id": 1}
            (tmp_path / folder / stages.STAGES[k]).write_text(json.dumps(body) if ok is not None else "{broken")
    got = {r.folder: (r.completed, r.is_valid) for r in stages.completed(stages.read_stage_files(spark, str(tmp_path))).collect()}
    assert got == {"a": (3, True), "b": (1, False), "c": (1, False), "d": (0, False)}


def test_caches():
    cache = limits.TtlCache(10, 2)
    assert [cache.step(t, k) for t, k in [(0, 1), (5, 1), (6, 2), (11, 1), (12, 3), (13, 2)]] == [False, True, False, False, False, False]
    lru = limits.LruCache(2)
    assert [lru.step(0, k) for k in (1, 2, 1, 3, 2, 1)] == [False, False, True, False, False, False]


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [(k, i, float(i * (k + 1)), float(10 * (i % 7))) for k in range(3) for i in range(30)]
    kinds = "key long, id long, at double, value double"
    for n in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 10 == n], kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    whole = spark.createDataFrame(rows, kinds)
    for name, stream, batch in (("bucket", lambda s: limits.limited(s, 3.0, 0.5), limits.replay(whole, lambda: limits.TokenBucket(3.0, 0.5))), ("spent", lambda s: limits.spent(s, 200.0), limits.replay(whole, lambda: limits.Spending(200.0)))):
        source = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = stream(source).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        got = {(r.key, r.id): r.passed for r in spark.read.parquet(str(tmp_path / name)).collect()}
        assert set(got) == {(r.key, r.id) for r in batch.collect()}
        if name == "spent":  # sums do not depend on time, so files in any order keep to the limit
            assert all(sum(v for k, i, _, v in rows if k == key and got[k, i]) <= 200 for key in range(3))
        passed = {(r.key, r.id): r.passed for r in batch.collect()}
        assert any(passed.values()) and not all(passed.values())


def test_unseen_rows_are_appended_once(spark, tmp_path):
    step = tables.append_unseen(str(tmp_path / "index"), "chunk_id")
    frame = lambda ids: spark.createDataFrame([(i, f"v{i}") for i in ids], "chunk_id long, v string")
    step(frame([1, 2, 2]), 0)
    step(frame([2, 3]), 1)
    step(frame([3, 1]), 2)
    assert sorted(r.chunk_id for r in spark.read.parquet(str(tmp_path / "index")).collect()) == [1, 2, 3]


def test_uncategorised_elements_are_judged_anew(spark):
    """By text, zone, score and margin in that order; nulls, repeated rows, an empty table and other columns."""
    kinds = "doc_id int, pos int, category string, text string, font_size double, x double, y_min double, y_max double, page_height double, band int"
    U = "UncategorizedText"
    rows = [
        (1, 0, "Title", "Opening", 14.0, 100.0, 100.0, 120.0, 800.0, 7),
        (1, 1, "Header", "The Gazette", 8.0, 50.0, 10.0, 20.0, 800.0, 7),
        (1, 2, "Header", "Other", 8.0, 50.0, 28.0, 40.0, 800.0, 7),
        (1, 3, "Footer", "foot", 8.0, 50.0, 780.0, 790.0, 800.0, 7),
        (1, 4, U, " the GAZETTE ", 14.0, 100.0, 500.0, 510.0, 800.0, 7),
        (1, 5, U, "in between", 14.0, 100.0, 20.0, 28.0, 800.0, 7),
        (1, 6, U, "low", 14.0, 100.0, 785.0, 795.0, 800.0, 7),
        (1, 7, U, "closing", 13.0, 400.0, 300.0, 310.0, 800.0, 7),
        (1, 8, U, "1.2 scope", 9.0, 120.0, 300.0, 310.0, 800.0, 7),
        (1, 9, U, "plain text", 9.0, 120.0, 300.0, 310.0, 800.0, 7),
        (1, 10, U, "a note", 9.0, 400.0, 60.0, 70.0, 800.0, 7),
        (1, 11, U, "a note", 9.0, 400.0, 730.0, 735.0, 800.0, 7),
        (1, 11, U, "a note", 9.0, 400.0, 730.0, 735.0, 800.0, 7),
        (1, 12, U, None, None, None, None, None, None, None),
        (2, 0, U, "The Gazette", 8.0, 50.0, 10.0, 20.0, 800.0, 7),
        (None, 0, U, "1.2 scope", 8.0, 50.0, 10.0, 20.0, 800.0, 7),
    ]
    df = spark.createDataFrame(rows, kinds)
    out = hierarchy.reclassified(df)
    assert out.columns == df.columns and out.count() == len(rows)
    got = {(r.doc_id, r.pos): r.category for r in out.collect()}
    judged = ["Footer", "Header", "Footer", "Title", "Title", U, "Header", "Footer", U]
    assert [got[1, i] for i in range(4, 13)] == judged
    assert got[2, 0] == got[None, 0] == U
    assert hierarchy.reclassified(df.limit(0)).count() == 0


def test_outline_mapped_against_a_loop(spark):
    rng = random.Random(5)
    words = ["Scope of work", "Terms", "General terms", "Payment of fees", "x", "Scope of werk", ""]
    elements, outline, want = [], [], {}
    for doc in range(40):
        pages = sorted(rng.randint(1, 6) for _ in range(rng.choice([0, 3, 12, 20])))
        body = [(doc, i, p, rng.choice(["Title", "Text"]), rng.choice(words), rng.choice([None, 8.0, 10.0, 12.0])) for i, p in enumerate(pages)]
        plan = [(doc, i, rng.choice(words), rng.randint(1, 7)) for i in range(rng.randint(1, 6))]
        elements, outline = elements + body, outline + plan

        def fits(e, title):
            a, b = e[4].lower(), title.lower()
            if not a or not b or not (SequenceMatcher(None, a, b).ratio() > 0.85 or ((a in b or b in a) and len(a) > 5)):
                return False
            sizes = [x[5] for x in body if x[2] == e[2] and x[5]]
            return e[3] == "Title" or not (e[5] and sizes and e[5] < 0.95 * float(np.median(sizes)))

        at, starts = 0, []
        for _, _, title, page in plan:
            named = [e[1] for e in body if e[1] >= at and page <= e[2] <= page + 2 and fits(e, title)]
            on_page = [e[1] for e in body if e[1] >= at and e[2] == page]
            at = (named + on_page[:1] + [at])[0]
            starts.append(at)
        for i, a in enumerate(starts):
            b = starts[i + 1] if i + 1 < len(starts) else len(body)
            want[doc, i] = (a, b, "\n\n".join(e[4] for e in body[a:b] if e[4]))
    e = spark.createDataFrame(elements, "doc_id int, pos int, page int, category string, text string, font_size double")
    o = spark.createDataFrame(outline, "doc_id int, place int, title string, page int")
    got = {(r.doc_id, r.place): (r.start, r.until, r.content) for r in hierarchy.mapped(o, e).collect()}
    assert got == want
    assert hierarchy.mapped(o.limit(0), e).count() == 0
