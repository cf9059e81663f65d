"""Chunks of sections within a budget of tokens (WN9, CH3, CH4)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import sentences, token_estimate

MOST_TOKENS, LEAST_CHARS = 512, 50


def pack(parts: Column, most: int = MOST_TOKENS, tokens: Callable[[Column], Column] = token_estimate) -> Column:
    """WN9: sentences in order, joined by blanks as long as their tokens fit; one that alone exceeds the budget is cut into pieces of its own.

    What fits depends on what was packed before, so this is a fold and no running sum. Pieces of an
    oversized sentence have four characters a token, as the estimate has.
    """
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).cast("long").alias("tokens"))
    flushed = lambda acc: F.when(acc["now"] != "", F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])

    def add(acc: Column, s: Column) -> Column:
        n = tokens(s).cast("long")
        width = F.lit(4 * most)
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / width).cast("int")), lambda i: F.substring(s, i * width + 1, width))
        state = lambda done, now, t: F.struct(done.alias("done"), now.alias("now"), t.cast("long").alias("tokens"))
        longer = F.when(acc["now"] == "", s).otherwise(F.concat(acc["now"], F.lit(" "), s))
        return (
            F.when(n > most, state(F.concat(flushed(acc), pieces), F.lit(""), F.lit(0)))
            .when(acc["tokens"] + n > most, state(flushed(acc), s, n))
            .otherwise(state(acc["done"], longer, acc["tokens"] + n))
        )

    return F.aggregate(parts, zero, add, flushed)


def layer3(sections: DataFrame, most: int = MOST_TOKENS, least: int = LEAST_CHARS) -> DataFrame:
    """CH3: ``chunk_id, doc_id, pos, char_start, content`` of sections (``doc_id, pos, char_start, content``).

    Chunks of a document are numbered before the short ones are dropped, so numbers have gaps; each
    starts where its section does.
    """
    cut = sections.select("doc_id", "pos", "char_start", F.posexplode(pack(sentences(F.col("content")), most)).alias("part", "content"))
    number = F.row_number().over(W.partitionBy("doc_id").orderBy("pos", "part"))
    named = cut.withColumn("chunk_id", F.concat(F.col("doc_id").cast("string"), F.lit("_L3_"), number.cast("string")))
    return named.filter(F.length(F.trim("content")) >= least).select("chunk_id", "doc_id", "pos", "char_start", "content")


def layers_of(chunks: DataFrame) -> DataFrame:
    """CH4: chunks (``doc_id, layer, depth``) without layers 1 and 2 of documents no deeper than 1."""
    depth = F.max("depth").over(W.partitionBy("doc_id"))
    return chunks.withColumn("__depth", depth).filter((F.col("layer") == 3) | (F.col("__depth") > 1)).drop("__depth")
