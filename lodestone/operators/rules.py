"""Filters, reducers and rules over rows of results, messages and graphs (PF*, JS1, RD1, RT1, FM1, KG12, ED6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def has_any(values: Column, wanted: list[str]) -> Column:
    """JS1: any of them is in the array."""
    return F.arrays_overlap(values, F.array(*[F.lit(x) for x in wanted]))


def has_all(values: Column, wanted: list[str]) -> Column:
    """JS1: all of them are."""
    return F.size(F.array_except(F.array(*[F.lit(x) for x in wanted]), values)) == 0


def metadata_filter(metadata: Column, category: str | None = None, categories: list[str] | None = None, keywords: list[str] | None = None, keywords_any: list[str] | None = None, entities: list[str] | None = None, entity_types: list[str] | None = None, min_confidence: float | None = None) -> Column:
    """PF1: the given predicates on a JSON column, all of them; true if none is given. What a row lacks doesn't match."""
    text = lambda key: F.get_json_object(metadata, f"$.{key}")
    array = lambda key: F.from_json(text(key), "array<string>")
    parts = []
    if category:
        parts.append(text("category") == category)
    if categories:
        parts.append(text("category").isin(categories))
    if keywords:
        parts.append(has_all(array("keywords"), keywords))
    for key, wanted in (("keywords", keywords_any), ("entities", entities), ("entity_types", entity_types)):
        if wanted:
            parts.append(has_any(array(key), wanted))
    if min_confidence is not None:
        parts.append(text("category_confidence").cast("double") >= min_confidence)
    return reduce(lambda a, b: a & b, [F.coalesce(x, F.lit(False)) for x in parts], F.lit(True))


# Contents that are numbers and page marks only.
STRUCTURAL = (r"^[\d.\s\-–—]+$", r"(?i)^(Strana|Page|Str\.?)\s*\d+\s*$")


def worthy(chunks: DataFrame, content: str, order: list[str], least: int = 100) -> DataFrame:
    """PF9: chunks of enough characters, the first of equal ones, without those that are numbers only."""
    text = F.regexp_replace(content, r"^\s+|\s+$", "")
    structural = reduce(lambda a, b: a | b, [text.rlike(p) for p in STRUCTURAL])
    first = F.row_number().over(W.partitionBy(F.md5(text)).orderBy(*order))
    return chunks.filter((F.length(text) >= least) & ~structural).withColumn("__first", first).filter("__first = 1").drop("__first")


def citation_check(answer: Column, available: Column, long: int = 200) -> Column:
    """PF14: cited ids that are not available, whether a long answer lacks citations that it could have, and whether all is well."""
    used = F.regexp_extract_all(answer, F.lit(r"\\cite\{([^}]+)\}"), F.lit(1))
    unknown = F.filter(used, lambda x: ~F.array_contains(available, x))
    missing = (F.length(answer) > long) & (F.size(available) > 0) & (F.size(used) == 0)
    return F.struct(unknown.alias("unknown"), missing.alias("missing"), ((F.size(unknown) == 0) & ~missing).alias("valid"))


SEARCHES = ("search", "section_search", "similarity_search", "hierarchical_search")


def early_stop(calls: DataFrame) -> DataFrame:
    """PF15: calls (``key, id, tool, found``) with ``stop``: an expansion that found nothing, or two empty searches in the last three calls with none that found something after them."""
    by = W.partitionBy("key").orderBy("id")
    state = F.when(F.col("tool").isin(*SEARCHES), F.when(F.col("found") == 0, 1).otherwise(0))
    one, two, three = (state if k == 0 else F.lag(state, k).over(by) for k in range(3))
    # An empty search counts up to the first that found something, looking back; other tools are passed over.
    empty = F.coalesce(one, F.lit(0)) + F.when(one.eqNullSafe(0), 0).otherwise(F.coalesce(two, F.lit(0)) + F.when(two.eqNullSafe(0), 0).otherwise(F.coalesce(three, F.lit(0))))
    return calls.withColumn("stop", ((F.col("tool") == "expand_context") & (F.col("found") == 0)) | (empty >= 2))


# What a question may hold, and the points that it adds.
TOPICS = ((("gdpr", "ccpa", "hipaa", "sox", "compliance", "regulation", "legal", "regulatory"), 25), (("risk", "safety", "liability", "impact", "hazard", "danger", "assess"), 20), (("gap", "missing", "complete", "comprehensive", "coverage", "analyze"), 15), (("find", "get", "show", "what", "where", "when"), -10))


def complexity(question: Column) -> Column:
    """RT1: points for length, clauses, topics and more than one question mark, within 0 and 100, and the band."""
    low = F.lower(question)
    clauses = F.size(F.split(question, r"[.?!;]|\band\b|\bor\b", -1))
    score = F.least(F.lit(30), F.floor(F.length(question) / 10)) + F.least(F.lit(20), 5 * clauses)
    for words, points in TOPICS:
        score = score + F.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), points).otherwise(0)
    score = score + F.when(F.length(question) - F.length(F.replace(question, F.lit("?"), F.lit(""))) > 1, 10).otherwise(0)
    score = F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int")
    return F.struct(score.alias("score"), F.when(score < 30, "simple").when(score < 70, "standard").otherwise("complex").alias("band"))


def keep_first(value: Column, order: Column, placeholders: tuple[str, ...] = ("", "unknown", "routing")) -> Column:
    """RD1: the first value that is no placeholder, else the last one."""
    real = F.when(value.isNotNull() & ~value.isin(*placeholders), value)
    return F.coalesce(F.min_by(real, F.when(real.isNotNull(), order)), F.max_by(value, order))


def merge_maps(maps: Column, order: Column) -> Column:
    """RD1: all entries, the later value of a key in order."""
    held = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.map_entries(maps).alias("m"))))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))

    def add(acc: Column, x: Column) -> Column:
        new = F.map_from_entries(x["m"])
        return F.map_concat(F.map_filter(acc, lambda k, _: ~F.map_contains_key(new, k)), new)

    return F.aggregate(held, empty, add)


def union_in_order(value: Column, order: Column) -> Column:
    """RD1, SO1: each value once, where it first came."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"]))


def breadcrumb(document: Column, path: Column, section_path: Column, title: Column, page: Column) -> Column:
    """FM1: where a result is from: its hierarchical path, with the page for an untitled part; else the document with section path, title or page."""
    untitled = F.replace(path, F.lit(" > Untitled"), F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(F.lit(" (page "), page.cast("string"), F.lit(")"))).otherwise(""))
    whole = F.when(F.coalesce(path, F.lit("")) != "", F.when(path.contains(" > Untitled"), untitled).otherwise(path))
    part = F.when((F.coalesce(section_path, F.lit("")) != "") & (section_path != "Untitled"), F.concat(document, F.lit(" > "), section_path))
    named = F.when(F.coalesce(title, F.lit("")) != "", F.concat(document, F.lit(" > "), title))
    paged = F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(document, F.lit(" (page "), page.cast("string"), F.lit(")")))
    return F.coalesce(whole, part, named, paged)


# How an entity's name gives its type, in the order in which they are tried.
NAME_TYPES = ((r"(?i)zákon|vyhláška|nařízení|směrnice", "Dokument"), (r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}", "Datum"), (r"(?i)kč|eur|czk", "Částka"), (r"(?i)sújb|čez|súrao|ministerstvo|úřad", "Organizace"), (r"^\p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+$", "Osoba"))


def cleaned(entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """KG12: entities (``id, name, type, group_id``) with a group and a type inferred from the name; edges without self-loops, with a default confidence."""
    group = F.when(F.coalesce("group_id", F.lit("")).isin("", "Neznm"), F.concat(F.lit("legacy_"), F.substring(F.md5("id"), 1, 8))).otherwise(F.col("group_id"))
    inferred = F.coalesce(*[F.when(F.col("name").rlike(p), F.lit(kind)) for p, kind in NAME_TYPES], F.lit("Entity"))
    kind = F.when(F.coalesce("type", F.lit("")).isin("", "Entity"), inferred).otherwise(F.col("type"))
    return entities.withColumns({"group_id": group, "type": kind}), edges.filter("src <> tgt").withColumn("confidence", F.coalesce("confidence", F.lit(0.7)))


def orphan_episodes(episodes: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """KG12: episodes (``episode``) that mention something, and those that mention nothing and so go."""
    named = mentions.select("episode").filter("episode IS NOT NULL").distinct()
    return episodes.join(named, "episode", "left_semi"), episodes.join(named, "episode", "left_anti")


def merged_entities(entities: DataFrame) -> DataFrame:
    """ED6, ED9: one row for each ``type, norm`` of ``id, type, norm, confidence, chunks, tags``: the first id, the largest confidence, all chunks and tags, and the ids merged into it."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    ids = F.array_sort(F.collect_set("id"))
    return entities.groupBy("type", "norm").agg(F.min("id").alias("id"), F.max("confidence").alias("confidence"), union("chunks").alias("chunks"), union("tags").alias("tags"), F.slice(ids, 2, 1 << 30).alias("merged_from"))


def merged_edges(edges: DataFrame) -> DataFrame:
    """ED8: one edge for each ``src, tgt, rel``, with the largest confidence and all documents."""
    return edges.groupBy("src", "tgt", "rel").agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("document")).alias("documents"), F.count("*").alias("n"))


def last_edge(edges: DataFrame, order: str) -> DataFrame:
    """KG14: of the edges between two nodes the last one."""
    return edges.groupBy("src", "tgt").agg(F.max_by("rel", order).alias("rel"))


def within_hops(edges: DataFrame, most: int = 2) -> DataFrame:
    """KG4: ``src, tgt, hops`` of what is one to ``most`` edges out, by the fewest."""
    links = edges.select("src", "tgt").distinct()
    step = links.withColumn("hops", F.lit(1))
    out = step
    for n in range(2, most + 1):
        step = step.select("src", F.col("tgt").alias("mid")).join(links.select(F.col("src").alias("mid"), "tgt"), "mid").select("src", "tgt", F.lit(n).alias("hops"))
        out = out.unionByName(step)
    return out.groupBy("src", "tgt").agg(F.min("hops").alias("hops"))


def mention_boost(chunks: DataFrame, mentions: DataFrame, asked: DataFrame, weight: float = 0.3) -> DataFrame:
    """KG7: chunks (``chunk, score``) with ``boosted``: more by ``weight`` if the chunk mentions an asked entity (``chunk, id``; ``id``)."""
    named = mentions.join(asked, "id").select("chunk", F.lit(weight).alias("boost")).distinct()
    return chunks.join(named, "chunk", "left").withColumn("boosted", F.col("score") + F.coalesce("boost", F.lit(0.0))).drop("boost")
