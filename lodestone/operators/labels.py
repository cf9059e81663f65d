"""Labels of chunks from their documents, sections and own questions (LB1 to LB3, LB5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kept_in(words: Column, text: Column, most: int) -> Column:
    """LB2: the words that the text holds, in any case; if it holds none, the first ``most``. All of them for a text that is null or empty."""
    low = F.lower(text)
    hit = F.filter(words, lambda w: F.contains(low, F.lower(w)))
    return F.when(F.coalesce(text, F.lit("")) == "", words).when(F.size(hit) > 0, hit).otherwise(F.slice(words, 1, most))


def with_questions(text: Column, questions: Column) -> Column:
    """LB3: an embedding text with its questions behind it; unchanged without any."""
    return F.when(F.coalesce(questions, F.lit("")) != "", F.concat(text, F.lit("\n\n["), F.lit("Otázky: "), questions, F.lit("]"))).otherwise(text)


def labelled(chunks: DataFrame, taxonomy: DataFrame, keywords: DataFrame, questions: DataFrame, augment: bool = True) -> DataFrame:
    """LB5: ``chunks`` (``chunk_id, doc_id, section_id, content, embedding_text``) with all labels.

    ``taxonomy`` has one row a document (``doc_id, category, subcategory, category_confidence``), ``keywords``
    one a section (``section_id, keywords, key_phrases``), ``questions`` one a chunk (``chunk_id, questions,
    hyde_text``). Keywords and phrases are those that the chunk holds, else the first five and two. What a
    chunk has no source for is null; ``labels_source`` is always ``generated``. Joins are on ids that are
    unique on the labels' side, so a document that holds a third of all chunks skews one side only.
    """
    out = chunks.join(taxonomy, "doc_id", "left").join(keywords, "section_id", "left").join(questions, "chunk_id", "left")
    text = F.col("content")
    out = out.withColumns({"keywords": kept_in(F.col("keywords"), text, 5), "key_phrases": kept_in(F.col("key_phrases"), text, 2)})
    if augment:
        out = out.withColumn("embedding_text", with_questions(F.col("embedding_text"), F.col("hyde_text")))
    return out.withColumn("labels_source", F.lit("generated"))
