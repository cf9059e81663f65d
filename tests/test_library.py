"""Feeds, labels, information, operations, conversations and numbering by hand: nulls, broken input, ties, empty tables."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import clusters, conversations, labels, library, operations
from lodestone.operators.numbering import numbered
from lodestone.sources import feeds


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_documents_of_a_folder(spark, tmp_path):
    for name, text in (("a.TXT", "text"), ("b.html", "<p>"), ("c.exe", "x"), ("none", "y"), ("sub/d.pdf", "pdf")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    found = {r.path.rsplit("/", 1)[1]: (r.kind, bytes(r.content).decode() if r.content is not None else None, r.error) for r in feeds.read_documents(spark, str(tmp_path)).collect()}
    assert found == {"a.TXT": ("txt", "text", None), "b.html": ("html", "<p>", None), "d.pdf": ("pdf", "pdf", None), "c.exe": (None, None, "unsupported format: .exe"), "none": (None, None, "unsupported format: none")}
    assert [one(spark, feeds.kind_of(F.lit(x))) for x in ("http://x/a.htm?q=b.pdf#c", "a.b.docx", "pdf", "")] == ["htm", "docx", None, None]


def test_question_files(spark, tmp_path):
    good = {"file_path": "f", "span": [0, 5], "answer": "a"}
    tests = [{"query": "q1", "snippets": [good]}, {"query": " ", "snippets": [good]}, {"query": "q3", "snippets": []}, {"query": "q4"}, {"query": "q5", "snippets": [good | {"span": [1]}]}, {"query": "q6", "snippets": [good | {"span": [5, 5]}]}, {"query": "q7", "snippets": [good, good | {"answer": "\n"}]}, {"snippets": [good]}, {"query": "q9", "snippets": [{"span": [0, 5], "answer": "a"}]}, {"query": "q10", "snippets": [good, good]}]
    (tmp_path / "q.json").write_text(json.dumps({"tests": tests}))
    found = feeds.questions(feeds.question_tests(spark, str(tmp_path / "q.json")), "place", parts=3).collect()
    assert sorted((r.query_id, r.query, len(r.snippets)) for r in found) == [(1, "q1", 1), (2, "q10", 2)]
    (tmp_path / "bad.json").write_text('{"other": []}')
    with pytest.raises(Exception, match="no list of tests"):
        feeds.question_tests(spark, str(tmp_path / "bad.json")).collect()
    broken = spark.createDataFrame([(1, None), (2, "{broken"), (3, "[]")], "place int, test string")
    assert feeds.questions(broken, "place").count() == 0


def test_rates(spark):
    lines = spark.createDataFrame([(1, "USA|dollar|1|USD|23,456"), (2, "USA|dollar|1|USD|99"), (3, "Japan|yen|100|JPY|16.2"), (4, "X|x|0|AAA|1"), (5, "X|x|1|BBB|none"), (6, "X|x|1|CCC"), (7, "X|x|1|DDD|50"), (8, None), (9, "01 Jan 2024 #1")], "place int, line string")
    wanted = spark.createDataFrame([(c, 0.1, 40.0, 23.5) for c in ("USD", "JPY", "AAA", "BBB", "CCC", "DDD")], "code string, low double, high double, fallback double")
    found = {r.code: (r.rate, r.status) for r in feeds.rates(lines, wanted).collect()}
    assert found == {"USD": (23.456, "feed"), "JPY": (0.162, "feed"), "AAA": (23.5, "broken"), "BBB": (23.5, "broken"), "CCC": (23.5, "missing"), "DDD": (23.5, "out of bounds")}
    assert {r.status for r in feeds.rates(lines.limit(0), wanted).collect()} == {"missing"}
    assert [str(one(spark, feeds.converted(F.lit(x), F.lit(r)))) for x, r in ((10.0, 23.456), (0.01, 0.5), (-0.01, 0.5))] == ["234.56", "0.01", "-0.01"]


def test_numbers_without_gaps(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("number_of"))
    found = sorted((r.number, r.k) for r in numbered(rows, "k", parts=7).collect())
    assert found == [(i + 1, i) for i in range(1000)]
    ties = numbered(spark.range(50).select(F.lit(1).alias("k")), "k", first=0, parts=4).collect()
    assert sorted(r.number for r in ties) == list(range(50))
    assert numbered(rows.limit(0), "k").count() == 0


def test_labels(spark):
    words = F.array(*[F.lit(x) for x in ("Alpha", "beta", "gamma", "d", "e", "f")])
    assert one(spark, labels.kept_in(words, F.lit("an ALPHA and Beta"), 5)) == ["Alpha", "beta", "d", "e"]
    assert one(spark, labels.kept_in(words, F.lit("xyz"), 5)) == ["Alpha", "beta", "gamma", "d", "e"]
    assert one(spark, labels.kept_in(words, F.lit(None).cast("string"), 5)) == ["Alpha", "beta", "gamma", "d", "e", "f"]
    assert one(spark, labels.kept_in(F.array().cast("array<string>"), F.lit("x"), 5)) == []
    chunks = spark.createDataFrame([("c1", "d1", "s1", "an alpha", "e"), ("c2", "d2", "s9", None, "e"), ("c3", None, None, "x", None)], "chunk_id string, doc_id string, section_id string, content string, embedding_text string")
    taxonomy = spark.createDataFrame([("d1", "law", "tax", 0.9)], "doc_id string, category string, subcategory string, category_confidence double")
    keywords = spark.createDataFrame([("s1", ["alpha", "beta"], ["no", "none", "never"])], "section_id string, keywords array<string>, key_phrases array<string>")
    questions = spark.createDataFrame([("c1", ["q?"], "q?"), ("c2", [], "")], "chunk_id string, questions array<string>, hyde_text string")
    found = {r.chunk_id: r for r in labels.labelled(chunks, taxonomy, keywords, questions).collect()}
    assert (found["c1"].category, found["c1"].keywords, found["c1"].key_phrases, found["c1"].embedding_text) == ("law", ["alpha"], ["no", "none"], "e\n\n[Otázky: q?]")
    assert (found["c2"].category, found["c2"].keywords, found["c2"].embedding_text, found["c2"].labels_source) == (None, None, "e", "generated")
    assert found["c3"].embedding_text is None
    assert labels.labelled(chunks, taxonomy, keywords, questions, augment=False).filter("embedding_text LIKE '%q?%'").count() == 0


def test_children(spark):
    sections = spark.createDataFrame([("d", "A", 0), ("d", "A > B", 1), ("d", "A > B > C", 2), ("d", "A > D", 3), ("d", "AB > X", 1), ("e", "A > Z", 1), ("d", None, 1), ("d", "M > N > O", 2)], "doc_id string, path string, level int")
    asked = spark.createDataFrame([("d", "A"), ("d", "A"), ("d", "A > B"), ("d", "M > N"), ("d", "gone")], "doc_id string, parent string")
    found = {(r.parent, r.path) for r in library.children(sections, asked, "doc_id").collect()}
    assert found == {("A", "A > B"), ("A > B", "A > B > C"), ("M > N", "M > N > O")}


def test_document_information(spark):
    one_ = spark.createDataFrame([("a", "1", "first"), ("a", "2", "second"), (None, "3", "x")], "doc_id string, chunk_id string, content string")
    three = spark.createDataFrame([("b", "1", "12345678901", "s", "Terms"), ("b", "2", None, "s", None)], "doc_id string, chunk_id string, content string, section_id string, title string")
    two = spark.createDataFrame([("b", "1", "s", "T", "p", "sum", 1)], "doc_id string, chunk_id string, section_id string, section_title string, section_path string, content string, page_number int")
    assert [tuple(r) for r in library.document_list(one_, three).collect()] == [("a", "first")]
    assert [tuple(r) for r in library.document_list(one_.limit(0), three).collect()] == [("b", "Privacy policy for Terms")]
    found = {r.doc_id: tuple(r)[1:] for r in library.document_metadata(one_.filter("doc_id = 'a'"), two, three).collect()}
    assert found == {"a": ("first", 0, 0, 0, 0, True), "b": (None, 1, 2, 11, 2, True)}
    assert library.document_sections(two, 0).count() == 0
    assert [(r.place, r.total, r.truncated) for r in library.document_sections(two).collect()] == [(1, 1, False)]
    assert [(r.summary, r.chunk_count) for r in library.section_details(two, three).collect()] == [("sum", 2)]


def test_operations(spark):
    calls = spark.createDataFrame([("a", True, 10.0, True), ("a", False, 20.0, False), ("a", None, None, None), ("b", None, None, None)], "op string, ok boolean, ms double, hit boolean")
    found = {r.op: r for r in operations.operation_stats(calls, "op").collect()}
    a, b = found["a"], found["b"]
    assert (a.total_calls, a.avg_time_ms, a.success_rate, a.error_percent, a.hit_rate, a.miss_rate) == (3, 10.0, 1 / 3, 100 * (1 / 3), 0.5, 0.5)
    assert (b.total_time_ms, b.success_rate, b.hit_rate, b.miss_rate) == (0.0, 0.0, 0.0, 1.0)
    assert operations.operation_stats(calls.limit(0), "op").count() == 0


def test_conversations(spark):
    talk = spark.createDataFrame([(1, 7, "a", None, None), (2, 7, "b", None, None), (3, 8, "c", None, None)], "conv_id long, user_id long, title string, created_at timestamp_ntz, updated_at timestamp_ntz")
    said = spark.createDataFrame([(1, 0, "user", "x", None)], "conv_id long, turn long, role string, text string, created_at timestamp_ntz")
    new = spark.createDataFrame([(1, "user", "n"), (1, "user", "m"), (9, "user", "refused"), (2, "user", "first")], "conv_id long, role string, text string").withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    after, messages = conversations.appended(talk, said, new)
    assert sorted((r.conv_id, r.turn, r.text) for r in messages.collect()) == [(1, 0, "x"), (1, 1, "m"), (1, 2, "n"), (2, 0, "first")]
    assert {r.conv_id: r.updated_at is not None for r in after.collect()} == {1: True, 2: True, 3: False}
    assert [(r.conv_id, r.place, r.message_count) for r in conversations.of_users(after, messages, 1).orderBy("conv_id").collect()] == [(1, 1, 3), (3, 1, 0)]
    assert [r.place for r in conversations.history(messages, 1).filter("conv_id = 1").collect()] == [1]
    gone = spark.createDataFrame([(1, 7), (3, 7), (5, 7)], "conv_id long, user_id long")
    left, kept = conversations.deleted(after, messages, gone)
    assert {r.conv_id for r in left.collect()} == {2, 3} and {r.conv_id for r in kept.collect()} == {2}
    assert {r.conv_id: r.is_owner for r in conversations.owned(talk, gone).collect()} == {1: True, 3: False, 5: False}


def test_cluster_summaries(spark):
    members = spark.createDataFrame([(1, [2.0, 0.0], 0), (2, [1.0, 1.0], 0), (3, [0.0, 5.0], 0), (4, [1.0, 1.0], 0), (5, [1.0, 0.0], -1), (6, None, 0), (7, [1.0, 0.0], None)], "id long, vector array<double>, cluster int")
    found = clusters.summaries(members, 3).collect()
    assert [(r.cluster, r.size, r.closest) for r in found] == [(0, 4, [2, 4, 1])]
    assert [round(x, 9) for x in found[0].centroid] == [round(0.5**0.5, 9)] * 2


def test_texts(spark):
    title = lambda g, m=None: one(spark, T.title_of(F.lit(g).cast("string"), F.lit(m).cast("string")))
    assert title('Title: "A plan."') == "A plan" and title("'A plan'!?") == "A plan'" and title("Here is Název: x.") == "Název: x"
    assert title(" \n", "one\n two") == "one two" and title(None, "w" * 51) == "w" * 47 + "..." and title(None, None) == ""
    final = lambda ok, x: one(spark, T.final_answer(F.lit(ok).cast("boolean"), F.lit(x).cast("string")))
    assert final(True, "a <ANSWER>\n x \n</ANSWER> <ANSWER>y</ANSWER>") == "x" and final(True, " <answer>x</answer>") == " <answer>x</answer>"
    assert final(False, "x") == final(None, "x") == final(True, None) == ""
    known = F.create_map(F.lit("EU"), F.lit("union"))
    assert one(spark, T.expanded_forms(F.lit("EU law of EU, NATO"), known)) == ["eu law of eu, nato", "union law of union, nato"]
    assert one(spark, T.expanded_forms(F.lit("eu law"), known)) == ["eu law"]


def test_composition_and_tokens(spark):
    import unicodedata

    texts = ["e\u0301 c\u030c", "A\u0308\u0301", "\u1100\u1161", "plain", "", None, "c\u02c7 \u02c7x"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").select("i", T.composed(F.col("t")).alias("c"), T.repaired(F.col("t")).alias("r")).collect()
    assert {r.i: r.c for r in rows} == {i: None if x is None else unicodedata.normalize("NFC", x) for i, x in enumerate(texts)}
    assert rows[0].r == "é č" and rows[6].r == "č x"
    tokenizers = pytest.importorskip("tokenizers")
    files = pytest.importorskip("public_tokenizers")
    library = tokenizers.Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    said = ["one two", "<|endoftext|>", "  é\n\n漢字", "", None, "x" * 3000]
    found = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, t string").select("i", T.bpe_tokens(F.col("t"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN).alias("n")).collect()
    assert {r.i: r.n for r in found} == {i: len(library.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(said)}
