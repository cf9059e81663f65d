"""Every query against its DuckDB counterpart on the smallest tables, and hand-computed cases."""

import os

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vectors as V
from lodestone.operators import retrieval as R
from lodestone.plans import catalogue
from lodestone.sources import markup

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return float(f"{x:.9g}") + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    found = duck.execute(catalogue.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    theirs = sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in found.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text(spark):
    assert one(spark, T.normalize(F.lit("  Čeština, 2x_y!  "))) == "čeština 2x_y"
    assert one(spark, T.tokenize(F.lit(""))) == []
    assert one(spark, T.numbering_depth(F.lit("1.2.3 Scope"))) == 3
    assert [one(spark, T.numbering_depth(F.lit(x))) for x in ("1. Scope", " A.1 x", "1.2.", "5 apples", "1.2.x-y", "")] == [1, 2, 2, 0, 0, 0]
    assert one(spark, T.display_name(F.lit("Sb_1997_18_x"))) == "18/1997 Sb."
    assert one(spark, T.truncate_at_word(F.lit("one two three four"), 3)) == "one two three..."
    assert one(spark, T.acronyms(F.lit("EU a EU ČEZ UN"))) == ["EU", "UN"]
    assert one(spark, T.percent(F.lit(0.1234))) == "12.3%"


def test_sentences_of_odd_texts(spark, tmp_path):
    """a text without a sentence was an error; white space and the end of a text are those of the SQL."""
    texts = ["", " \n ", None, "One. Two! Three", "x \u0085", " \u0085 x \u2028", "a.\x0b B. \x0bC", "\x0bA. B\x0b", "End. \r\n", ". A. B", "a. \f\tÚ \n", "a.\u00a0B"]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, catalogue.queries()["tx9_sentences"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(con.execute(catalogue.oracle_sql()["tx9_sentences"]).fetchall())
    assert got[:3] == [(0, 0, None, None), (1, 0, None, None), (2, None, None, None)]


def test_vectors(spark):
    zero, a = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, V.unit(a)) == [0.6, 0.8]
    assert one(spark, V.unit(zero)) == [0.0, 0.0]
    assert one(spark, V.cosine(zero, a)) is None


def test_trimmed_elements(spark):
    """A paragraph lost the digits of its own number at its ends."""
    rows = spark.createDataFrame([(1, " 0 a 0 \n11 b 1\n\n22 c 2")], "doc_id int, text string")
    assert [r.text for r in markup.elements(rows, markup.plain_elements(F.col("text"))).orderBy("pos").collect()] == ["0 a 0", "11 b 1", "22 c 2"]


def test_halves_of_shares(spark):
    """4500 / 1000000 * 100 is a little below .45, ten times it is 4.5."""
    shares = spark.createDataFrame([(x,) for x in (4500.0, 18500.0, 71500.0, -4500.0, 123456789.0)], "x double")
    assert [r.s for r in shares.select(T.percent(F.col("x") / 1000000).alias("s")).collect()] == ["0.5%", "1.9%", "7.2%", "-0.5%", "12345.7%"]


def test_signs_of_rounded_numbers(spark):
    numbers = spark.createDataFrame([(x,) for x in (-1e-8, 1e-8, 0.0, -0.1234565)], "x double")
    assert [str(r.r) for r in numbers.select(V.rounded(F.col("x"), 6).alias("r")).collect()] == ["-0.0", "0.0", "0.0", "-0.123457"]


def test_rrf_imputes_missing_ranks(spark):
    """dense [a, b], sparse [b]: a tie that the id breaks."""
    lists = [spark.createDataFrame([Row(query_id=0, id=i, rank=r) for i, r in x]) for x in ([("a", 0), ("b", 1)], [("b", 0)])]
    rows = R.rrf(*lists, k=5).orderBy("rank").collect()
    assert [r["id"] for r in rows] == ["a", "b"]
    assert all(abs(r["score"] - (1 / 60 + 1 / 61)) < 1e-8 for r in rows)


def test_fusion_of_equal_scores_is_half(spark):
    same = spark.createDataFrame([Row(query_id=0, id=i, score=2.0) for i in "ab"])
    assert [r["fused"] for r in R.fuse({"s": same}, {"s": 0.5}, 5).collect()] == [0.25, 0.25]
