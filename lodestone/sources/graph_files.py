"""Graphs as files: GEXF, GraphML, CSV and JSON (SC11 to SC13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def escaped(text: Column) -> Column:
    """Text as XML wants it within quotes."""
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def _element(pattern: str, *columns: str) -> Column:
    return F.format_string(pattern, *[escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])


def xml_lines(nodes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """SC11: ``part, key, line`` of a ``gexf`` or ``graphml`` file of nodes (``id, value, type``) and edges (``src, tgt, rel``); in order of part and key."""
    head, node, middle, edge, tail = {
        "gexf": ('<?xml version="1.0" encoding="UTF-8"?><gexf version="1.3"><graph defaultedgetype="directed"><nodes>', '<node id="%s" label="%s" type="%s"/>', "</nodes><edges>", '<edge source="%s" target="%s" label="%s"/>', "</edges></graph></gexf>"),
        "graphml": ('<?xml version="1.0" encoding="UTF-8"?><graphml><graph edgedefault="directed">', '<node id="%s"><data key="label">%s</data><data key="type">%s</data></node>', "", '<edge source="%s" target="%s"><data key="label">%s</data></edge>', "</graph></graphml>"),
    }[kind]
    fixed = nodes.sparkSession.createDataFrame([(0, "", head), (2, "", middle), (4, "", tail)], "part int, key string, line string")
    own = nodes.select(F.lit(1).alias("part"), F.col("id").alias("key"), _element(node, "id", "value", "type").alias("line"))
    links = edges.select(F.lit(3).alias("part"), F.concat_ws(" ", "src", "tgt", "rel").alias("key"), _element(edge, "src", "tgt", "rel").alias("line"))
    return fixed.unionByName(own).unionByName(links)


def write_xml(nodes: DataFrame, edges: DataFrame, path: str, kind: str) -> None:
    """SC11: one file after another in the folder ``path``, whose lines in the order of file names are the document."""
    xml_lines(nodes, edges, kind).repartitionByRange("part", "key").sortWithinPartitions("part", "key").select("line").write.mode("overwrite").text(path)


def write_csv(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """SC11: node and edge tables with headers under ``path``."""
    nodes.write.mode("overwrite").option("header", True).csv(f"{path}/nodes")
    edges.write.mode("overwrite").option("header", True).csv(f"{path}/edges")


GRAPH = "entities array<struct<id:string,type:string,value:string,confidence:double>>, relationships array<struct<src:string,tgt:string,rel:string>>"


def write_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """SC12: a line for each entity and relationship."""
    nodes.withColumn("kind", F.lit("entity")).write.mode("overwrite").json(f"{path}/entities")
    edges.withColumn("kind", F.lit("relationship")).write.mode("overwrite").json(f"{path}/relationships")


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SC12: entities and relationships that ``write_json`` wrote."""
    nodes = spark.read.schema("id string, type string, value string, norm string, confidence double").json(f"{path}/entities")
    return nodes, spark.read.schema("src string, tgt string, rel string").json(f"{path}/relationships")


def read_graph_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SC12: entities and relationships of files that hold one graph each."""
    held = spark.read.schema(GRAPH).option("multiLine", True).json(path)
    return held.select(F.explode("entities").alias("e")).select("e.*"), held.select(F.explode("relationships").alias("r")).select("r.*")


def to_import(edges: DataFrame, size: int = 500) -> DataFrame:
    """SC13: each edge once, with the batch that it is written in."""
    unique = edges.dropDuplicates(["src", "tgt", "rel"])
    n = unique.count()
    return unique.withColumn("batch", F.pmod(F.xxhash64("src", "tgt", "rel"), F.lit(-(-n // size) or 1)).cast("int"))
