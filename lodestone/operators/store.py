"""A store of chunks in layers, its registry of documents, and what keeps both right (SC5 to SC7, SC9, SC10).

Tables are DataFrames; ``write_store`` and ``rewrite_without`` keep them as Parquet in buckets of documents,
so that deleting a document rewrites its bucket and no more.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256


def flattened_metadata(rows: DataFrame, fields: str, metadata: str = "metadata") -> DataFrame:
    """SC5: ``rows`` with the named fields (a DDL list) of a JSON column in its place; where a column has a field's name, the field's value wins if there is one.

    Broken or null JSON has no fields.
    """
    parsed = rows.withColumn("__m", F.from_json(metadata, fields)).drop(metadata)
    names = [f.split()[0].strip("`") for f in fields.split(",")]
    for name in names:
        value = F.col("__m").getField(name)
        parsed = parsed.withColumn(name, F.coalesce(value, F.col(name)) if name in rows.columns else value)
    return parsed.drop("__m")


def layer_scan(layers: dict[int, DataFrame], fields: str) -> DataFrame:
    """SC5: all rows of all layers with their layer, metadata flattened; what a layer has no column for is null."""
    flat = [flattened_metadata(rows, fields).withColumn("layer", F.lit(k)) for k, rows in layers.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), flat)


def hierarchical_path(document: Column, section_path: Column) -> Column:
    """SC6: the document, and the path of the section if there is one."""
    return F.when(F.coalesce(section_path, F.lit("")) != "", F.concat(document, F.lit(" > "), section_path)).otherwise(document)


def unseen(stored: DataFrame, new: DataFrame, key: str, *order: str) -> DataFrame:
    """SC6: the rows of ``new`` that an insert that does nothing on conflict adds: of each key that ``stored`` has not, the first in ``order``.

    A null key conflicts with nothing, so all such rows are added. Firsts are found by a partial aggregate,
    so a key that very many rows share is no hot group.
    """
    first = new.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*new.columns), F.struct(*order)).alias("__row")).select("__row.*")
    return first.join(stored.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti").select(*new.columns).unionByName(new.filter(F.col(key).isNull()))


def upserted(registry: DataFrame, changes: DataFrame, key: str, *order: str, deleted: Column | None = None, touched: str | None = None) -> DataFrame:
    """SC7: ``registry`` after all ``changes``: the last one of a key, in ``order``, sets the columns that it has; other columns stay.

    A key that is new gets a row with nulls elsewhere. A last change for which ``deleted`` is true takes
    the row away. ``touched`` names a column that tells whether a change set the row. Changes without a key
    are left out.
    """
    given = [c for c in changes.columns if c in registry.columns and c != key]
    gone = F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))
    value = F.struct(*given, gone.alias("__gone"))
    last = changes.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, F.struct(*order)).alias("__new"))
    joined = registry.join(last, key, "full")
    new = F.col("__new")
    columns = [F.when(new.isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in registry.columns]
    flag = [new.isNotNull().alias(touched)] if touched else []
    return joined.filter(~F.coalesce(new["__gone"], F.lit(False))).select(*columns, *flag)


def without_documents(tables: dict[str, DataFrame], gone: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """SC9: each table without the rows of the documents in ``gone``; rows of no document stay."""
    ids = gone.select(key).filter(F.col(key).isNotNull()).distinct()
    return {name: rows.join(ids, key, "left_anti") for name, rows in tables.items()}


def deletion_report(tables: dict[str, DataFrame], gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """SC9: ``table_name, deleted, kept, documents``: rows of each table that go and stay, and documents that stay."""
    ids = gone.select(F.col(key).alias("__gone")).filter("__gone IS NOT NULL").distinct()

    def counted(name: str, rows: DataFrame) -> DataFrame:
        marked = rows.join(ids, F.col(key) == F.col("__gone"), "left")
        stays = F.col("__gone").isNull()
        return marked.agg(F.lit(name).alias("table_name"), F.count_if(~stays).alias("deleted"), F.count_if(stays).alias("kept"), F.count_distinct(F.when(stays, F.col(key))).alias("documents"))

    return reduce(DataFrame.union, [counted(*x) for x in tables.items()])


def index_issues(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """SC10: ``doc_id, expected, stored, null_pages, issues, passed`` for each document of either side.

    Both sides have a row a chunk with ``doc_id, page``. Issues are a count that differs (the one that fails
    a document), a highest page that differs where pages are expected, and stored chunks without a page.
    """
    of = lambda rows, n: rows.groupBy("doc_id").agg(F.count("*").alias(n), F.max("page").alias(f"{n}_page"), F.count_if(F.col("page").isNull()).alias(f"{n}_null"))
    both = of(expected, "expected").join(of(stored, "stored"), "doc_id", "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = both.withColumns({"expected": zero("expected"), "stored": zero("stored"), "null_pages": zero("stored_null")})
    text = lambda *x: F.concat(*[y if isinstance(y, Column) else F.lit(y) for y in x])
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    issues = F.array_compact(
        F.array(
            F.when(F.col("expected") != F.col("stored"), text("count: expected ", number("expected"), ", got ", number("stored"))),
            F.when(F.col("expected_page").isNotNull() & (F.col("expected_page") != zero("stored_page")), text("last page: expected ", number("expected_page"), ", got ", number("stored_page"))),
            F.when(F.col("null_pages") > 0, text("without a page: ", number("null_pages"))),
        )
    )
    return both.select("doc_id", "expected", "stored", "null_pages", issues.alias("issues"), (F.col("expected") == F.col("stored")).alias("passed"))


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_store(rows: DataFrame, path: str, key: str = "doc_id", buckets: int = BUCKETS, mode: str = "append") -> None:
    """SC6: ``rows`` under ``path`` in buckets of documents, one file a bucket and write."""
    rows.withColumn("bucket", _bucket(key, buckets)).repartition("bucket").write.partitionBy("bucket").mode(mode).parquet(path)


def append_to_store(spark: SparkSession, new: DataFrame, path: str, key: str, *order: str, document: str = "doc_id", buckets: int = BUCKETS) -> None:
    """SC6: what ``unseen`` finds of ``new`` is appended to the store at ``path``, whose keys alone are read."""
    stored = spark.read.parquet(path)
    write_store(unseen(stored, new.select(*[c for c in stored.columns if c != "bucket"]), key, *order), path, document, buckets)


def rewrite_without(spark: SparkSession, path: str, gone: DataFrame, key: str = "doc_id", buckets: int = BUCKETS) -> int:
    """SC9: deletes documents from the store at ``path`` by writing their buckets anew; the number of buckets written.

    ``gone`` is the request of a caller; only its buckets, at most ``buckets`` numbers, come to the driver.
    The rows that stay are written beside the store first, so a job that fails leaves the store as it was.
    """
    touched = sorted(r[0] for r in gone.select(_bucket(key, buckets)).distinct().collect())
    stored = spark.read.parquet(path).filter(F.col("bucket").isin(touched))
    if not touched:
        return 0
    aside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    stays = without_documents({"store": stored}, gone, key)["store"]
    stays.write.partitionBy("bucket").parquet(aside)
    left = spark.read.schema(stored.schema).parquet(aside)
    empty = set(touched) - {r[0] for r in left.select("bucket").distinct().collect()}
    left.write.option("partitionOverwriteMode", "dynamic").partitionBy("bucket").mode("overwrite").parquet(path)
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = files.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for bucket in empty:  # an overwrite by partition leaves partitions without new rows alone
        system.delete(files.Path(folder, f"bucket={bucket}"), True)
    system.delete(files.Path(aside), True)
    return len(touched)
