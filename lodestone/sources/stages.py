"""Stage files of a document and how far it got (SC4, SC18, SC20, SC21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import hierarchy

# The files of a document's stages, and the fields that each must have.
STAGES = {1: "phase1_extraction.json", 2: "phase2_summaries.json", 3: "phase3_chunks.json"}
FIELDS = {1: ("document_id", "sections", "source_path"), 2: ("document_id", "document_summary", "section_summaries"), 3: ("document_id", "chunking_stats", "layer1", "layer2", "layer3")}


def read_stage_files(spark: SparkSession, path: str) -> DataFrame:
    """``folder, stage, body`` of every stage file below ``path``, each read whole; a file in other folders is another document's."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("name", F.input_file_name())
    stage = F.coalesce(*[F.when(F.col("name").endswith("/" + name), F.lit(k)) for k, name in STAGES.items()])
    return files.select(F.regexp_extract("name", r"([^/]+)/[^/]+$", 1).alias("folder"), stage.alias("stage"), F.col("value").alias("body")).filter("stage IS NOT NULL")


def valid_stage(stage: Column, body: Column) -> Column:
    """Whether a file is JSON and has the fields of its stage; one whose value is null counts."""
    keys = F.coalesce(F.json_object_keys(body), F.array().cast("array<string>"))
    needed = F.coalesce(*[F.when(stage == k, F.array(*[F.lit(x) for x in names])) for k, names in FIELDS.items()])
    return F.size(F.array_except(needed, keys)) == 0


def completed(files: DataFrame) -> DataFrame:
    """SC4: ``folder, completed, is_valid, error``: the highest stage up to which all files (``folder, stage, body``) are there and valid."""
    judged = files.select("folder", "stage", valid_stage(F.col("stage"), F.col("body")).alias("ok"))
    facts = judged.groupBy("folder").agg(F.min(F.when(~F.col("ok"), F.col("stage"))).alias("bad"), F.array_sort(F.collect_set(F.when(F.col("ok"), F.col("stage")))).alias("good"))
    whole = F.aggregate("good", F.lit(0), lambda n, k: F.when(k == n + 1, k).otherwise(n))
    reached = F.when(F.col("bad").isNotNull(), F.least(F.col("bad") - 1, whole)).otherwise(whole)
    gap = F.coalesce(F.array_max("good"), F.lit(0)) > whole
    error = F.when(F.col("bad").isNotNull(), F.format_string("stage %d file corrupted", "bad")).when(gap, "incomplete sequence")
    return facts.select("folder", reached.alias("completed"), error.isNull().alias("is_valid"), error.alias("error"))


def reconciled(stored: DataFrame, given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SC18: counts of pages that are 0 or missing, and ``chunk_id, old_page, new_page`` where a given page differs."""
    counts = stored.agg(F.count("*").alias("total"), F.count_if(F.col("page") == 0).alias("zero_pages"), F.count_if(F.col("page").isNull()).alias("null_pages"))
    new = given.filter("page IS NOT NULL").select("chunk_id", F.col("page").alias("new_page"))
    both = stored.join(new, "chunk_id").filter(~F.col("page").eqNullSafe(F.col("new_page")))
    return counts, both.select("chunk_id", F.col("page").alias("old_page"), "new_page")


def merged_index(first: DataFrame, second: DataFrame) -> DataFrame:
    """SC21: ``document, at``: the second index's rows after all of the first's."""
    offset = first.agg(F.count("*").alias("__n"))
    moved = second.join(F.broadcast(offset)).select("document", (F.col("at") + F.col("__n")).alias("at"))
    return first.select("document", F.col("at").cast("long")).unionByName(moved)


SECTION = "struct<title:string,level:int,page:int,content:string>"


def from_model(answers: DataFrame) -> DataFrame:
    """SC20: ``doc_id, pos, title, level, parent, page, content`` of a model's JSON answers (``doc_id, answer``) with ``sections`` in order.

    Missing titles, levels and contents have defaults; parents follow from levels, missing pages from
    their neighbours. An answer that is no JSON gives no rows.
    """
    held = F.from_json("answer", f"sections array<{SECTION}>")["sections"]
    rows = answers.select("doc_id", F.posexplode(held).alias("pos", "s"))
    named = rows.select("doc_id", "pos", F.coalesce("s.title", F.lit("")).alias("title"), F.coalesce("s.level", F.lit(1)).alias("level"), F.col("s.page").alias("page"), F.coalesce("s.content", F.lit("")).alias("content"))
    pages = hierarchy.fill_pages(named)
    return hierarchy.parents(named.drop("page")).join(pages, ["doc_id", "pos"]).select("doc_id", "pos", "title", "level", "parent", "page", "content")


def report(rows: DataFrame, metrics: list[str], by: str | None = None) -> DataFrame:
    """SC17: mean and deviation of metric columns, of all rows or of each ``by``, as JSON and as a Markdown line."""
    each = [x for m in metrics for x in (F.round(F.avg(m), 4).alias(f"{m}_mean"), F.round(F.coalesce(F.stddev_pop(m), F.lit(0.0)), 4).alias(f"{m}_std"))]
    out = (rows.groupBy(by) if by else rows).agg(F.count("*").alias("n"), *each)
    names = [x for x in out.columns if x != by]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *([F.col(by).cast("string")] if by else []), *[F.col(x).cast("string") for x in names]), F.lit(" |"))
    return out.withColumns({"json": F.to_json(F.struct(*out.columns)), "markdown": line})


def ordered(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Rows numbered from 0 within ``by``."""
    return rows.withColumn("at", (F.row_number().over(W.partitionBy(by).orderBy(order)) - 1).cast("long"))
