"""Files and feeds that come in: documents by their kind, question sets, exchange rates (SC1, SC14, SC15, MA5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered

#: Suffixes of documents that can be read.
READABLE = ("pdf", "docx", "pptx", "xlsx", "html", "htm", "txt")


def kind_of(path: Column) -> Column:
    """SC1: the suffix of a file's name, lower case, if it is of a document that can be read; else null."""
    suffix = F.lower(F.regexp_extract(F.regexp_replace(path, r"[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1))
    return F.when(suffix.isin(*READABLE), suffix)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """SC1: ``path, kind, length, content, error`` of all files under a folder; of a file of another kind no content is kept.

    Executors read the files; the content of a refused file is pruned before it is read into a row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = kind_of(F.col("path"))
    refused = F.concat(F.lit("unsupported format: "), F.coalesce(F.nullif(F.regexp_extract("path", r"(\.[^./]*)$", 1), F.lit("")), F.lit("none")))
    taken = files.filter(kind.isNotNull()).select("path", kind.alias("kind"), "length", "content", F.lit(None).cast("string").alias("error"))
    others = files.filter(kind.isNull()).select("path", F.lit(None).cast("string").alias("kind"), "length", F.lit(None).cast("binary").alias("content"), refused.alias("error"))
    return taken.unionByName(others)


SNIPPETS = "array<struct<file_path:string,span:array<bigint>,answer:string>>"
TEST = f"struct<query:string,snippets:{SNIPPETS}>"


def question_tests(spark: SparkSession, path: str) -> DataFrame:
    """SC14: ``place, test`` (JSON) of the ``tests`` of a question file; a file without such a list is an error."""
    whole = spark.read.text(path, wholetext=True)
    tests = F.from_json(F.get_json_object("value", "$.tests"), "array<string>")
    found = whole.select(F.when(tests.isNull(), F.raise_error(F.lit("the file has no list of tests"))).otherwise(tests).alias("tests"))
    return found.select(F.posexplode("tests").alias("place", "test"))


def questions(tests: DataFrame, *order: str, parts: int | None = None) -> DataFrame:
    """SC14: ``query_id, query, snippets`` of the valid tests, numbered from 1 without gaps in ``order``.

    A test is valid if its query is not blank and it has snippets, each with a file, an answer that is not
    blank and a span of two places that ends after it starts. Null and broken JSON is not valid.
    """
    t = F.from_json("test", TEST)
    rows = tests.select(*order, t["query"].alias("query"), t["snippets"].alias("snippets"))
    span = lambda s: (F.size(s["span"]) == 2) & (F.try_element_at(s["span"], F.lit(2)) > F.try_element_at(s["span"], F.lit(1)))
    filled = lambda c: c.rlike(r"(?U)\S")
    whole = lambda s: F.coalesce(s["file_path"].isNotNull() & span(s) & filled(s["answer"]), F.lit(False))
    valid = filled(F.col("query")) & (F.size("snippets") > 0) & F.forall("snippets", whole)
    return numbered(rows.filter(F.coalesce(valid, F.lit(False))), *order, name="query_id", parts=parts).select("query_id", "query", "snippets")


def rates(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """SC15: ``code, rate, status`` for each wanted currency (``code, low, high, fallback``) from a feed (``place, line``).

    Lines are ``Country|Currency|Amount|Code|Rate``, decimals with comma or point; the rate is that of one
    unit by the code's first whole line. Status: ``feed``; else the fallback holds, as the code is
    ``missing``, its line ``broken`` (no whole number above 0 as amount, or no rate), or its rate ``out of bounds``.
    """
    fields = F.split("line", r"\|")
    whole = lines.select("place", fields.alias("f")).filter(F.size("f") >= 5)
    text = lambda i: F.trim(F.col("f")[i])
    first = whole.groupBy(text(3).alias("code")).agg(F.min_by(F.struct(text(2).alias("amount"), text(4).alias("rate")), F.struct("place", "f")).alias("r"))
    amount = F.col("r.amount").try_cast("int")
    rate = F.replace(F.col("r.rate"), F.lit(","), F.lit(".")).try_cast("double")
    joined = wanted.join(first, "code", "left").withColumn("__rate", F.when(amount > 0, F.try_divide(rate, amount.cast("double"))))
    status = F.when(F.col("r").isNull(), "missing").when(F.col("__rate").isNull(), "broken").when(~F.col("__rate").between(F.col("low"), F.col("high")), "out of bounds").otherwise("feed")
    return joined.withColumn("status", status).select("code", F.when(F.col("status") == "feed", F.col("__rate")).otherwise(F.col("fallback")).alias("rate"), "status")


def converted(amount: Column, rate: Column) -> Column:
    """MA5: an amount at a rate, to two decimals, halves away from zero; exact, as both are taken as decimals."""
    return F.round(amount.cast("decimal(18,4)") * rate.cast("decimal(14,6)"), 2).cast("decimal(20,2)")
