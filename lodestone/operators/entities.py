"""Entities across documents: aliases, matches, links and definitions (ED*, J15, J16, XD*, DA*, KG*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..checkpoints import settled
from ..functions.fuzzy import alike
from ..functions.text import acronyms
from .search import best

SEMANTIC, FUZZY = 0.90, 0.85


def alias_pairs(aliases: DataFrame) -> DataFrame:
    """ED13: ``alias, canonical`` of ``canonical, aliases``: lower case, a canonical name is its own alias, names with ``_`` are notes.

    An alias of several names belongs to the last one by name.
    """
    named = aliases.filter(~F.col("canonical").startswith("_"))
    each = named.select(F.explode(F.array_compact(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("alias"), "canonical")
    return each.groupBy(F.lower("alias").alias("alias")).agg(F.max("canonical").alias("canonical"))


def similar(new: DataFrame, known: DataFrame, threshold: float = SEMANTIC) -> DataFrame:
    """J15, ED3: ``id, match, score`` of the known entity of the same type (``id, type, vector``) with the largest cosine, if that is enough; ties by id.

    Exact, in blocks that meet as matrices. Left out are null ids and types, and vectors without a cosine: null, zero or with NaN.
    """
    sound = lambda rows: rows.filter(F.col("id").isNotNull() & ~F.exists("vector", F.isnan))
    kind = known.schema["id"].dataType
    asked = sound(new).select(F.col("id").cast(kind).alias("query_id"), "type", F.col("vector").alias("query"))
    found = best(asked, sound(known), 1, match=("type",), itself=False).filter(F.col("score") >= threshold)
    return found.select(F.col("query_id").cast(new.schema["id"].dataType).alias("id"), F.col("id").alias("match"), "score")


def expanded(entities: DataFrame, dictionary: DataFrame) -> DataFrame:
    """TX17: every form of an entity (``id, type, value``): itself, and with each known acronym (``acronym, expansion``) spelled out."""
    rows = entities.select("id", "type", "value", F.explode_outer(acronyms(F.col("value"))).alias("acronym")).join(F.broadcast(dictionary), "acronym", "left")
    spelled = F.when(F.col("expansion").isNotNull(), F.replace(F.lower("value"), F.lower("acronym"), F.col("expansion")))
    return rows.select("id", "type", F.explode(F.array_compact(F.array(F.lower("value"), spelled))).alias("form")).distinct()


FIRST, WIDER, SENT = 8, 8, 200_000  #: known forms of a length that are compared first, how many times more next, rows that are sent out


def acronym_matches(new: DataFrame, known: DataFrame, dictionary: DataFrame, threshold: float = FUZZY) -> DataFrame:
    """J16, ED4: ``id, match`` of the first known entity of the type (by id) of which a form is alike a form of the new one.

    Forms whose lengths alone rule the ratio out are not compared. Known forms of a type and length are taken
    in order, a few at first and more in each round; a new one is settled when all that are left come after its match.
    """
    n = int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.length("form")
    order = W.partitionBy("type", "__size").orderBy("id", "form")
    right = expanded(known, dictionary).withColumn("__size", size).withColumn("place", F.row_number().over(order))
    right = settled(right.select(F.col("id").alias("match"), F.col("type").alias("__type"), F.col("form").alias("__form"), "__size", "place"))
    open_ = settled(expanded(new, dictionary).withColumn("best", F.lit(None).cast(known.schema["id"].dataType)).repartition(n, "id", "form"))
    out, start, width = [], 0, FIRST
    while not open_.isEmpty():
        band = right.filter((F.col("place") > start) & (F.col("place") <= start + width))
        small = band.count() <= SENT
        both = 2 * F.least(size, F.col("__size")) >= threshold * (size + F.col("__size"))
        earlier = F.col("best").isNull() | (F.col("match") < F.col("best"))
        pairs = open_.join(F.broadcast(band) if small else band, (F.col("type") == F.col("__type")) & (F.col("id") != F.col("match")) & both & earlier)
        pairs = pairs if small else pairs.repartition(n)
        found = pairs.filter(alike(F.col("form"), F.col("__form"), threshold)).groupBy("id").agg(F.min("match").alias("__found"))
        rest = right.filter(F.col("place") == start + width + 1).groupBy(F.col("__type").alias("type")).agg(F.min("match").alias("__rest"))
        done = open_.join(found, "id", "left").withColumn("best", F.least("best", "__found")).drop("__found")
        done = settled(done.join(rest, "type", "left"))
        left = F.col("__rest").isNotNull() & (F.col("best").isNull() | (F.col("__rest") < F.col("best")))
        out.append(done.filter("best IS NOT NULL").select("id", F.col("best").alias("match")))
        open_ = settled(done.filter(left).drop("__rest").repartition(n, "id", "form"))
        start, width = start + width, width * WIDER
    if not out:
        return new.select("id", F.lit(None).cast(known.schema["id"].dataType).alias("match")).limit(0)
    return reduce(lambda x, y: x.unionByName(y), out).groupBy("id").agg(F.min("match").alias("match"))


LAYERS = ("exact", "alias", "semantic", "acronym")


def cascade(new: DataFrame, **matches: DataFrame) -> DataFrame:
    """ED5: ``id, match, layer``: of the matches (``id, match``) that each layer offers, the first layer's; none is new."""
    offers = None
    for i, layer in enumerate(LAYERS):
        if layer in matches:
            one = matches[layer].select("id", F.struct(F.lit(i).alias("at"), F.col("match").alias("match"), F.lit(layer).alias("layer")).alias("offer"))
            offers = one if offers is None else offers.unionByName(one)
    first = offers.groupBy("id").agg(F.min("offer").alias("offer"))
    return new.select("id").join(first, "id", "left").select("id", "offer.match", F.coalesce("offer.layer", F.lit("new")).alias("layer"))


# How one text names another, and an organisation.
REFERENCES = (r"(?iu)(?:podle|dle|§|čl\.|článku?)\s+(\d+)", r"(?iu)(?:zákon[ua]?|vyhlášk[ay]?|nařízení)\s+(?:č\.?)?\s*(\d+/\d+)", r"(?iu)(?:standard|norma)\s+([A-Z]+\s*\d+)", r"(?iu)(?:verze|vydání|revision)\s+(\d+\.?\d*)")
ORGANISATIONS = (r"(?iu)(?:vydal[ao]?|schválil[ao]?|připravil[ao]?)\s+([A-ZŠČŘŽÝÁÍÉÚŮ][a-zščřžýáíéúů\s]+)", r"(?iu)(?:organizace|orgán|instituce)\s+([A-ZŠČŘŽÝÁÍÉÚŮ][a-zščřžýáíéúů\s]+)")


def named_in(text: Column, patterns: tuple[str, ...]) -> Column:
    """TX16: what the patterns' groups find, pattern by pattern, lower case and trimmed."""
    return F.transform(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns])), lambda x: F.lower(F.trim(x)))


SPREAD = 4  #: parts of each side of a norm, so that one that many name is not one task's
LIST = 64  #: known entities in a list at about the most; a join's row is as many links, which a task holds at a time
TASKS = 4  #: tasks that write links for each shuffle partition, as norms differ in how many links they have


def _by_norm(rows: DataFrame, end: str) -> DataFrame:
    """Of ``end, norm, document`` a row for each end and norm: its first document and whether it has others; null is a document, too."""
    other = F.coalesce(F.min("document") != F.max("document"), F.lit(False)) | F.count("document").between(1, F.count("*") - 1)
    return rows.groupBy(end, "norm").agg(F.min("document").alias(f"__{end}"), other.alias(f"__{end}s"))


def _listed(targets: DataFrame) -> DataFrame:
    """Known entities of one norm and documents as lists ``tgt``, with ``__column``, the part that a list belongs to; many are cut by a hash of their id."""
    alike = ["norm", "__tgt", "__tgts", "__once"]
    rows = targets.withColumn("__alike", F.xxhash64(*alike))
    many = rows.groupBy("__alike").agg(F.ceil(F.count("*") / LIST).alias("__cuts")).filter("__cuts > 1")
    cut = F.pmod(F.xxhash64("tgt"), F.coalesce("__cuts", F.lit(1))).alias("__cut")
    lists = rows.join(F.broadcast(many), "__alike", "left").groupBy(*alike, "__alike", cut).agg(F.collect_list(F.struct("tgt")).alias("__ends"))
    return lists.select(*alike, F.col("__ends.tgt").alias("tgt"), F.pmod(F.xxhash64("__alike", "__cut"), F.lit(SPREAD)).alias("__column"))


def cross_links(new: DataFrame, known: DataFrame, patterns: tuple[str, ...], relation: str, confidence: float) -> DataFrame:
    """XD1, XD3: ``src, tgt, type, confidence`` where a new entity's value names a known one of another document (``id, value, norm, document``).

    Both sides are made distinct before they meet, so links to a known entity of one norm come once and are
    not shuffled; those to one of several norms, whose id is repeated, are made distinct after. Known entities
    of one norm and document meet a new one as lists of bounded length. As links are far more than the rows
    that meet, tasks are not merged by what they read.
    """
    n = TASKS * int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = new.select(F.col("id").alias("src"), F.explode(F.array_distinct(named_in(F.col("value"), patterns))).alias("norm"), "document")
    norms = known.filter("norm IS NOT NULL").select(F.col("id").alias("tgt"), F.lower("norm").alias("norm"), "document")
    targets = _by_norm(norms, "tgt").withColumn("__once", F.count("*").over(W.partitionBy("tgt")) == 1)
    parts = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)).cast("array<long>"))
    key = ["norm", "__row", "__column"]
    left = _by_norm(values, "src").withColumns({"__row": F.pmod(F.xxhash64("src"), F.lit(SPREAD)), "__column": parts}).repartition(n, *key)
    right = _listed(targets).withColumn("__row", parts)
    apart = F.col("__srcs") | F.col("__tgts") | ~F.col("__src").eqNullSafe(F.col("__tgt"))
    met = lambda some: left.join(right.filter(some).repartition(n, *key), key).filter(apart).select("src", F.explode("tgt").alias("tgt"))
    found = met("__once").unionByName(met("NOT __once").distinct())
    return found.select("src", "tgt", F.lit(relation).alias("type"), F.lit(confidence).alias("confidence"))


def base_name(name: Column) -> Column:
    """XD2: a name without dates and versions."""
    for pattern in (r"\d{4}-\d{2}-\d{2}", r"\d{2}\.\d{2}\.\d{4}", r"(?i)v\d+\.?\d*", r"(?i)version\s+\d+\.?\d*", r":\d{4}"):
        name = F.regexp_replace(name, pattern, "")
    return F.trim(name)


def version(name: Column) -> Column:
    """XD2: the version in a name, by the first pattern that has one."""
    return F.coalesce(*[F.nullif(F.regexp_extract(name, p, 1), F.lit("")) for p in (r":\s*(\d{4})", r"/(\d{4})", r"(?i)v(\d+\.?\d*)", r"(?i)version\s+(\d+\.?\d*)")])


def supersedes(entities: DataFrame) -> DataFrame:
    """XD2: ``newer, older`` of entities (``id, value``) of one base name, each version with the one before it and all others below.

    Versions compare as numbers where both are numbers, else as text; each two versions of a name once, and
    their entities meet by name and version, so no pair is made that is not one of the result.
    """
    rows = entities.select("id", F.lower(base_name(F.col("value"))).alias("base"), version(F.col("value")).alias("version")).filter("version IS NOT NULL AND base <> ''")
    versions = rows.select("base", "version").distinct().withColumn("__n", F.col("version").try_cast("double"))
    old = versions.select("base", F.col("version").alias("__old"), F.col("__n").alias("__m"))
    later = F.when(F.col("__n").isNotNull() & F.col("__m").isNotNull(), F.col("__n") > F.col("__m")).otherwise(F.col("version") > F.col("__old"))
    steps = versions.join(old, "base").filter(later).select("base", "version", "__old")
    newer = rows.join(steps, ["base", "version"]).select(F.col("id").alias("newer"), "base", F.col("__old").alias("version"))
    return newer.join(rows.withColumnRenamed("id", "older"), ["base", "version"]).select("newer", "older")


def boosted(candidates: DataFrame, entities: DataFrame, edges: DataFrame, asked: DataFrame, k: int, weight: float = 0.3, hop: float = 0.1) -> DataFrame:
    """KG9: ``query_id, chunk, score``: candidates (``query_id, chunk, score``) with boosts for what the query names.

    ``entities`` are ``id, chunk`` mentions, ``edges`` ``src, tgt``, ``asked`` ``query_id, id``. A chunk
    that mentions an asked entity gets ``weight``; each the largest centrality of its entities times
    half of it. The first ``k`` stay; those near an asked entity's neighbours (one or two hops out) then
    get ``hop`` and are ranked anew, after the cut.
    """
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.filter("src <> tgt").select(F.col("tgt").alias("id")))
    degree = ends.groupBy("id").agg(F.count("*").alias("n"))
    central = degree.join(F.broadcast(degree.agg(F.max("n").alias("most")))).select("id", (F.col("n") / F.col("most")).alias("c"))
    by_chunk = entities.join(central, "id", "left").groupBy("chunk").agg(F.coalesce(F.max("c"), F.lit(0.0)).alias("c"))
    named = asked.join(entities, "id").select("query_id", "chunk", F.lit(weight).alias("mention")).distinct()
    has_names = asked.select("query_id").distinct().withColumn("__named", F.lit(True))
    rows = candidates.join(named, ["query_id", "chunk"], "left").join(by_chunk, "chunk", "left").join(has_names, "query_id", "left")
    total = F.col("score") + F.when(F.col("__named"), F.coalesce("mention", F.lit(0.0)) + 0.5 * weight * F.coalesce("c", F.lit(0.0))).otherwise(0.0)
    rank = lambda: F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk"))
    first = rows.select("query_id", "chunk", F.round(total, 6).alias("score")).withColumn("rank", rank()).filter(F.col("rank") <= k).drop("rank")
    one = asked.join(edges, F.col("id") == F.col("src")).select("query_id", F.col("tgt").alias("id"))
    two = one.join(edges, F.col("id") == F.col("src")).select("query_id", F.col("tgt").alias("id"))
    near = one.unionByName(two).distinct().join(entities, "id").select("query_id", "chunk", F.lit(hop).alias("hop")).distinct()
    lifted = first.join(near, ["query_id", "chunk"], "left").select("query_id", "chunk", F.round(F.col("score") + F.coalesce("hop", F.lit(0.0)), 6).alias("score"))
    return lifted.withColumn("rank", rank())


# How a text defines a term.
DEFINITIONS = (r'"([^"]+)"\s+means\s+([^.]+)', r"([A-Z][^:]+):\s+([^.]+)", r"([A-Z][^(]+)\(([^)]+)\)")


def definitions(chunks: DataFrame, term: str, threshold: float) -> DataFrame:
    """DA2: ``chunk_id, term, definition, score`` in chunks (``chunk_id, text, score``) of at least ``threshold``, where the term and the asked one share words or hold each other."""
    pair = lambda p: F.arrays_zip(F.regexp_extract_all("text", F.lit(p), F.lit(1)).alias("t"), F.regexp_extract_all("text", F.lit(p), F.lit(2)).alias("d"))
    found = chunks.filter(F.col("score") >= threshold).select("chunk_id", "score", F.explode(F.concat(*[pair(p) for p in DEFINITIONS])).alias("x"))
    rows = found.select("chunk_id", F.trim("x.t").alias("term"), F.trim("x.d").alias("definition"), "score")
    low = F.lower("term")
    words = F.array(*[F.lit(w) for w in term.lower().split()])
    related = low.contains(term.lower()) | F.contains(F.lit(term.lower()), low) | F.arrays_overlap(words, F.split(low, r"\s+"))
    return rows.filter(related)


def known_definitions(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """DA1: ``term, definition, confidence`` along ``definition_of`` edges (``src, tgt, type, confidence``) from definitions to terms."""
    of = edges.filter("type = 'definition_of'")
    meaning = entities.select(F.col("id").alias("src"), F.col("value").alias("definition"))
    return of.join(meaning, "src").join(entities.select(F.col("id").alias("tgt"), F.col("value").alias("term")), "tgt").select("term", "definition", "confidence")


def aligned(graph: DataFrame, text: DataFrame, conflict: float = 0.85) -> DataFrame:
    """DA3: definitions of both (``term, definition, confidence``), those of the text only where the graph has not the same, best first, with a flag where a term has several sure ones."""
    key = lambda x: x.withColumn("__k", F.lower(F.trim("definition")))
    extra = key(text).join(key(graph).select("term", "__k"), ["term", "__k"], "left_anti").select("term", "definition", "confidence")
    both = graph.select("term", "definition", "confidence").unionByName(extra)
    by = W.partitionBy("term")
    sure = F.count(F.when(F.col("confidence") > conflict, 1)).over(by) > 1
    place = F.row_number().over(by.orderBy(F.col("confidence").desc(), "definition"))
    return both.select("term", "definition", "confidence", place.alias("place"), sure.alias("conflict"))
