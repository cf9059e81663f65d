"""A graph of entities as tables: what is at a node, who mentions it, merging batches in, a document's part (KG1, KG10, KG11, ED9, ED11, ED12).

What a node may have without bound (chunks, documents, merged ids) is a table of links and no array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SIDES = ("out", "in", "both")


def by_type(entities: DataFrame, kind: str) -> DataFrame:
    """KG1: entities of one type."""
    return entities.filter(F.col("type") == kind)


def incident(edges: DataFrame, asked: DataFrame, relation: str | None = None, side: str = "both") -> DataFrame:
    """KG1, KG11: ``id, side`` and the edge, for each edge (``src, tgt, rel`` and more) at each asked ``id``.

    ``side`` keeps edges that leave, that arrive, or both; among both a loop is one edge, which leaves.
    Asked ids that have no edge have no row; repeated ones count once.
    """
    if side not in SIDES:
        raise ValueError(f"side must be one of {SIDES}")
    ids = asked.select("id").distinct()
    kept = edges if relation is None else edges.filter(F.col("rel") == relation)
    leave = kept.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("src").alias("id"), F.lit("out").alias("side"), *edges.columns)
    arrive = kept.join(ids.withColumnRenamed("id", "tgt"), "tgt", "left_semi").select(F.col("tgt").alias("id"), F.lit("in").alias("side"), *edges.columns)
    if side != "both":
        return leave if side == "out" else arrive
    return leave.unionByName(arrive.filter("src <> tgt"))


def neighbours(entities: DataFrame, edges: DataFrame, asked: DataFrame, relation: str | None = None) -> DataFrame:
    """KG1: ``id, rel, side, other`` for each edge from and to an asked ``id`` whose other end is a known entity; a loop is one edge out and one in."""
    pick = lambda side, end: incident(edges, asked, relation, side).select("id", "rel", "side", F.col(end).alias("other"))
    both = pick("out", "tgt").unionByName(pick("in", "src"))
    return both.join(entities.select(F.col("id").alias("other")).distinct(), "other", "left_semi").select("id", "rel", "side", "other")


def chunk_entities(mentions: DataFrame, asked: DataFrame) -> DataFrame:
    """KG10: all mentions (``chunk, id, confidence`` and more) of the asked chunks, with their ``place`` by confidence (nulls last, ties by id)."""
    order = W.partitionBy("chunk").orderBy(F.col("confidence").desc_nulls_last(), "id")
    return mentions.join(asked.select("chunk").distinct(), "chunk", "left_semi").withColumn("place", F.row_number().over(order))


def entity_chunks(mentions: DataFrame, chunks: DataFrame, asked: DataFrame, most: int = 20) -> DataFrame:
    """KG10: of each asked entity the ``most`` surest mentions in chunks that are stored (``chunk`` and more), with their ``place``.

    Mentions are cut to the best ones in each partition before they are shuffled, so an entity that a
    third of all chunks mention is no hot group; only those that are left get the chunks' contents.
    """
    order = W.partitionBy("id").orderBy(F.col("confidence").desc_nulls_last(), "chunk")
    known = mentions.join(asked.select("id").distinct(), "id", "left_semi").join(chunks.select("chunk"), "chunk", "left_semi")
    best = known.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    return best.join(chunks, "chunk")


def merged_into(stored: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ED9: the graph's nodes after a batch, and what the batch did.

    Both have ``type, norm, id, value, confidence, at``; a node is a ``type, norm``. Nodes: ``type, norm, id,
    value, confidence, last_id, n_merged``, where id and value are the stored ones or those of the batch's
    first entity by ``at`` and ``id``, confidence is the highest, ``last_id`` the batch's last entity (whose
    metadata holds), ``n_merged`` the ids beyond the node's own. The second table is one row: ``added``
    nodes, ``merged`` entities. Entities without a type or norm are left out, as a merge on them fails.
    """
    clean = lambda x: x.filter("type IS NOT NULL AND norm IS NOT NULL")
    columns = ["type", "norm", "id", "value", "confidence", "at"]
    both = clean(stored).select(*columns, F.lit(0).alias("round")).unionByName(clean(batch).select(*columns, F.lit(1).alias("round")))
    order = F.struct("round", "at", "id")
    new = F.col("round") == 1
    nodes = both.groupBy("type", "norm").agg(
        F.min_by(F.struct("id", "value"), order).alias("own"),
        F.max("confidence").alias("confidence"),
        F.max_by("id", F.when(new, order)).alias("last_id"),
        (F.count_distinct("id") - 1).alias("n_merged"),
        F.count_if(new).alias("rows"),
        F.min("round").alias("since"),
    )
    done = nodes.agg(F.count_if(F.col("since") == 1).alias("added"), F.coalesce(F.sum(F.col("rows") - F.when(F.col("since") == 1, 1).otherwise(0)), F.lit(0)).alias("merged"))
    return nodes.select("type", "norm", "own.id", "own.value", "confidence", "last_id", "n_merged"), done


def chunk_links(*sources: DataFrame) -> DataFrame:
    """ED9: the chunks (``type, norm, chunk``) of all nodes, each once, as a merge unites them."""
    out = sources[0].select("type", "norm", "chunk")
    for x in sources[1:]:
        out = out.unionByName(x.select("type", "norm", "chunk"))
    return out.filter("chunk IS NOT NULL").distinct()


def document_subgraphs(links: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ED11: of each document its entities (``doc_id, id``) and each edge with an end among them (``doc_id`` and the edge), once."""
    held = links.select("doc_id", "id").filter("doc_id IS NOT NULL AND id IS NOT NULL").distinct()
    at = lambda end: held.withColumnRenamed("id", end).join(edges, end).select("doc_id", *edges.columns)
    return held, at("src").unionByName(at("tgt")).distinct()


def dedup_stats(resolved: DataFrame, thresholds: dict[str, float] | None = None, layers: tuple[str, ...] = ("exact", "alias", "semantic", "acronym")) -> DataFrame:
    """ED12: ``layer, matches, share, precision``: entities (``id, layer``) that each layer matched, none included, then all layers and what is new.

    Layers without a threshold are exact, so their precision is 1; a layer with one has that as its bound.
    """
    spark = resolved.sparkSession
    bounds = thresholds or {}
    names = spark.createDataFrame([(i, x, bounds.get(x, 1.0)) for i, x in enumerate(layers)], "at int, layer string, precision double")
    counts = resolved.groupBy("layer").agg(F.count("*").alias("matches"))
    total = resolved.agg(F.count("*").alias("n"), F.count_if(F.col("layer").isin(*layers)).alias("matched"))
    each = F.broadcast(names).join(counts, "layer", "left").select("at", "layer", F.coalesce("matches", F.lit(0)).alias("matches"), "precision")
    row = lambda at, layer, n: F.struct(F.lit(at).alias("at"), F.lit(layer).alias("layer"), n.alias("matches"))
    ends = total.select(F.explode(F.array(row(len(layers), "all", F.col("matched")), row(len(layers) + 1, "new", F.col("n") - F.col("matched")))).alias("r"))
    both = each.unionByName(ends.select("r.at", "r.layer", "r.matches", F.lit(None).cast("double").alias("precision")))
    # One row each of five or six layers beside the one row of totals.
    return both.crossJoin(F.broadcast(total)).select("layer", "matches", F.coalesce(F.try_divide("matches", "n"), F.lit(0.0)).alias("share"), "precision")
