"""What a library of documents tells about itself: chunks of summaries, children of sections, information by document (CH2, TR1, ST3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

GLUE = " > "


def summary_chunks(sections: DataFrame) -> DataFrame:
    """CH2: layer-2 chunks of sections (``doc_id, section_id, title, path, level, page, summary``) whose summary is not blank: the summary whole, as it is."""
    named = sections.filter(F.regexp_replace("summary", r"\s+", "") != "")
    doc = F.col("doc_id").cast("string")
    ids = F.concat(doc, F.lit("_L2_"), F.col("section_id").cast("string")).alias("chunk_id"), F.concat(doc, F.lit("_L1")).alias("parent_chunk_id")
    return named.select(*ids, "doc_id", "section_id", F.lit(2).alias("layer"), F.col("summary").alias("content"), F.col("title").alias("section_title"), F.col("path").alias("section_path"), F.col("level").alias("section_level"), F.col("page").alias("page_number"))


def children(sections: DataFrame, asked: DataFrame, *by: str) -> DataFrame:
    """TR1: ``parent`` and the section, for each section one level below an asked path (``parent``) of the same ``by`` that its own path starts with.

    A path's level is that of the first section (``path, level``) that has it, by level, else its number of
    separators. Each section meets its own path's prefixes only, by an equal join.
    """
    steps = F.split("path", GLUE)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda i: F.array_join(F.slice(steps, 1, i), GLUE))
    below = sections.filter(F.contains("path", F.lit(GLUE))).withColumn("parent", F.explode(prefixes))
    known = sections.filter("path IS NOT NULL").groupBy(*by, F.col("path").alias("parent")).agg(F.min(F.coalesce("level", F.lit(0))).alias("__level"))
    wanted = asked.select(*by, "parent").distinct().join(known, [*by, "parent"], "left")
    inferred = F.size(F.split("parent", GLUE)) - 1
    wanted = wanted.withColumn("__level", F.coalesce("__level", inferred))
    return below.join(wanted, [*by, "parent"]).filter(F.coalesce("level", F.lit(0)) == F.col("__level") + 1).drop("__level")


def document_list(layer1: DataFrame, layer3: DataFrame) -> DataFrame:
    """ST3 list: ``doc_id, summary``, one row a document of layer 1 (``doc_id, chunk_id, content``), by its first chunk; of layer 3 (with ``title``) only if layer 1 is empty."""
    first = layer1.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min_by("content", "chunk_id").alias("summary"))
    if not layer1.filter("doc_id IS NOT NULL").isEmpty():
        return first
    title = F.coalesce("title", F.col("doc_id").cast("string"))
    return layer3.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min_by(F.concat(F.lit("Privacy policy for "), title), "chunk_id").alias("summary"))


def document_metadata(layer1: DataFrame, layer2: DataFrame, layer3: DataFrame) -> DataFrame:
    """ST3 metadata, summary: ``doc_id, summary, section_count, chunk_count, chars, words, found`` of every document of any layer; words are a fifth of the characters."""
    one = layer1.groupBy("doc_id").agg(F.min_by("content", "chunk_id").alias("summary"))
    two = layer2.groupBy("doc_id").agg(F.count("*").alias("section_count"))
    three = layer3.groupBy("doc_id").agg(F.count("*").alias("chunk_count"), F.sum(F.coalesce(F.length("content"), F.lit(0))).alias("chars"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    rows = one.join(two, "doc_id", "full").join(three, "doc_id", "full").select("doc_id", "summary", zero("section_count"), zero("chunk_count"), zero("chars"))
    found = (F.coalesce("summary", F.lit("")) != "") | (F.col("section_count") > 0)
    return rows.select("*", F.floor(F.col("chars") / 5).alias("words"), found.alias("found"))


def document_sections(layer2: DataFrame, most: int = 50) -> DataFrame:
    """ST3 sections: of each document the first ``most`` sections by id, with their ``place``, the number of all and whether some are left out."""
    order = W.partitionBy("doc_id").orderBy(F.coalesce(F.col("section_id").cast("string"), F.lit("")), "chunk_id")
    kept = layer2.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    total = layer2.groupBy("doc_id").agg(F.count("*").alias("total"))
    return kept.join(total, "doc_id").select("doc_id", "section_id", "section_title", "place", "total", (F.col("total") > most).alias("truncated"))


def section_details(layer2: DataFrame, layer3: DataFrame) -> DataFrame:
    """ST3 section details: the first chunk of each section of layer 2 with the number of its chunks in layer 3."""
    first = layer2.groupBy("doc_id", "section_id").agg(F.min_by(F.struct("section_title", "section_path", F.col("content").alias("summary"), "page_number"), "chunk_id").alias("s")).select("doc_id", "section_id", "s.*")
    counts = layer3.groupBy("doc_id", "section_id").agg(F.count("*").alias("chunk_count"))
    return first.join(counts, ["doc_id", "section_id"], "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
