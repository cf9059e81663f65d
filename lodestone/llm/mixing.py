"""Operator 6: mixing sources to target weights by entropy balancing, in built-in functions only.

Rates r of documents are as close in entropy to 1 as these constraints on words allow:

* sum of size * r over each source is the source's target, exactly;
* sum of size * r * z over all documents is 0, up to a ridge, where z is the logarithm of a
  document's size less the corpus's mean (every word counting alike): the mix keeps the corpus's
  profile of lengths;
* r is at most 3.

So r = min(3, exp(a multiplier of the source + a multiplier of the length * z)): documents of one
source have different rates. The multipliers minimise the convex dual; each of Newton's steps sums
gradient and curvature over all documents. Sources are eliminated one by one from the step, as only
the length ties them together, so any number of sources stays distributed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .components import checkpoint_dir

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3  #: of its source's size, and of a document's
STEPS, SEED = 40, 6
RIDGE, CLOSE = 0.01, 1e-9  #: of the length's multiplier, by all words; what a step may leave of a target
PART = 1 << 16  #: documents of one source and size that one task orders
FEW = 1 << 18  #: rows of cells in a partition, and of plans that are sent out whole


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size`` and more (one row a source) with ``target``.

    Sources in code-point order, null last, weigh 5, 2, 1 and so on. Resharing what lies above a
    source's limit by weight until none is above fills all others to one level per weight, so the
    target is min(limit, weight * level). Sources are taken by the level at which they are full;
    the level is the first that leaves the next one below its limit. The table has a row for each
    source, so one ordered pass over it is small.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1)
    out = sizes.withColumn("weight", weight).withColumn("limit", (MOST_TIMES * F.col("source_size")).cast("double"))
    full = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    every = W.partitionBy()
    before = full.rowsBetween(W.unboundedPreceding, -1)
    out = out.withColumns({"full_at": F.col("limit") / F.col("weight"), "total": F.sum("source_size").over(every), "stopped": F.coalesce(F.sum("limit").over(before), F.lit(0.0)), "open": F.sum("weight").over(full.rowsBetween(0, W.unboundedFollowing))})
    out = out.withColumn("level_here", (F.col("total") - F.col("stopped")) / F.col("open"))
    out = out.withColumn("place", F.row_number().over(full))
    level = F.min(F.when(F.col("level_here") <= F.col("full_at"), F.struct("place", "level_here"))).over(every)["level_here"]
    return out.select(*sizes.columns, F.least("limit", F.col("weight") * F.coalesce(level, F.lit(0.0))).alias("target"))


def _cells(rows: DataFrame) -> DataFrame:
    """``key, source, size, n``: documents of one source and size, which all get one rate."""
    cells = rows.groupBy("__key", "__source", "__size").agg(F.count("*").alias("n")).checkpoint()
    parts = -(-cells.count() // FEW) or 1
    cells = cells.select(F.col("__key").alias("key"), F.col("__source").alias("source"), F.col("__size").alias("size"), "n")
    return (cells.coalesce(1) if parts == 1 else cells.repartition(parts, "key")).checkpoint()


def balance(cells: DataFrame) -> tuple[DataFrame, float]:
    """Rates of all cells (``key, size, n, source_size, target, rate``), and the length's multiplier.

    A driver's loop over Newton's steps; of each it sees four sums.
    """
    words = F.col("n") * F.col("size")
    sizes = cells.groupBy("key", "source").agg(F.sum(words).alias("source_size"))
    wanted = targets(sizes.select("key", "source", "source_size")).checkpoint()
    log = F.log(F.col("size") + 1.0)
    total, mean, square = cells.agg(F.sum(words), F.sum(words * log), F.sum(words * log * log)).first()
    if not total:
        return cells.join(wanted.select("key", "source_size", "target"), "key").withColumn("rate", F.lit(0.0)), 0.0
    mean /= total
    spread = math.sqrt(max(square / total - mean * mean, 0.0)) or 1.0
    z = (log - F.lit(mean)) / F.lit(spread)
    own = cells.filter("size > 0").select("key", "size", words.cast("double").alias("m"), z.alias("z")).checkpoint()
    start = F.log(F.col("target") / F.col("source_size"))
    state = wanted.filter("source_size > 0 AND target > 0").select("key", "target", start.alias("level")).checkpoint()
    tilt = 0.0
    for _ in range(STEPS):
        rate = F.least(F.lit(float(MOST_TIMES)), F.exp(F.col("level") + F.lit(tilt) * F.col("z")))
        each = own.join(state, "key").withColumn("mr", F.col("m") * rate)
        free = F.when(F.col("level") + F.lit(tilt) * F.col("z") < math.log(MOST_TIMES), F.col("mr")).otherwise(0.0)
        sums = {"taken": F.col("mr"), "long": F.col("mr") * F.col("z"), "b0": free, "b1": free * F.col("z"), "b2": free * F.col("z") * F.col("z")}
        stats = each.groupBy("key", "target", "level").agg(*[F.sum(x).alias(k) for k, x in sums.items()]).checkpoint()
        ratio = F.coalesce(F.try_divide("b1", "b0"), F.lit(0.0))
        over = F.col("taken") - F.col("target")
        slope, pull, bend, worst = stats.agg(F.sum("long"), F.sum(ratio * over), F.sum(F.col("b2") - ratio * F.col("b1")), F.max(F.abs(over) / F.col("target"))).first()
        if worst is None:
            break
        step = -(slope - pull + RIDGE * total * tilt) / (bend + RIDGE * total)
        step = max(-0.5, min(0.5, step))
        if worst < CLOSE and abs(step) < CLOSE:
            break
        move = F.coalesce(F.try_divide(-(over + F.col("b1") * F.lit(step)), F.col("b0")), F.lit(0.0))
        state = stats.select("key", "target", (F.col("level") + F.least(F.lit(1.0), F.greatest(F.lit(-1.0), move))).alias("level"))
        tilt += step
    rate = F.least(F.lit(float(MOST_TIMES)), F.exp(F.col("level") + F.lit(tilt) * z))
    out = cells.join(wanted.select("key", "source_size", "target"), "key").join(state.select("key", "level"), "key", "left")
    return out.select("key", "size", "n", "source_size", "target", F.coalesce(rate, F.lit(0.0)).alias("rate")), tilt


def _rounded(rate: Column) -> Column:
    """A multiple of 2**-30, so that the last bits of a sum, which depend on its order, change no copy."""
    return F.round(rate * float(1 << 30)) / float(1 << 30)


def settle(plan: DataFrame) -> DataFrame:
    """``plan`` with ``start``, the sum of rates of larger documents, and rates that hit targets once rounded.

    Copies are taken from large documents to small ones, so what rounding leaves of a target is up
    to a large document. Three times the rates of the smaller documents (of a half, a tenth, a
    fiftieth of the words) are scaled to what the larger ones, once rounded, left.
    """
    order = W.partitionBy("key").orderBy(F.col("size").desc(), "part")
    above, every = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy("key")
    words = F.col("rows") * F.col("size") * F.col("rate")
    start = F.coalesce(F.sum(F.col("rows") * F.col("rate")).over(above), F.lit(0.0))
    plan = plan.withColumn("rate", _rounded(F.col("rate")))
    plan = plan.withColumn("__above", F.try_divide(F.coalesce(F.sum(words).over(above), F.lit(0.0)), F.sum(words).over(every)))
    for share in (0.5, 0.1, 0.02):
        small = F.col("__above") >= 1 - share
        plan = plan.withColumn("start", start)
        taken = (F.floor(F.col("start") + F.col("rows") * F.col("rate") + 0.5) - F.floor(F.col("start") + 0.5)) * F.col("size")
        left = F.col("target") - F.sum(F.when(small, 0).otherwise(taken)).over(every)
        factor = F.greatest(F.lit(0.0), F.coalesce(F.try_divide(left, F.sum(F.when(small, words)).over(every)), F.lit(1.0)))
        plan = plan.withColumn("rate", F.when(small, F.least(F.lit(float(MOST_TIMES)), _rounded(F.col("rate") * factor))).otherwise(F.col("rate")))
    return plan.withColumn("start", start).drop("__above")


def _planned(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``__key, __source, __size, __draw``) with ``__plan``: ``source_size, target, rate, copies``.

    Copies are the rate rounded down or up. Documents of a source from the largest to the smallest,
    and then by their draw, take the next whole copy when the running sum of rates passes it, so the
    words taken differ from the target by about one small document. A document's place comes from counts of cells; cells of
    more than ``PART`` documents are split by the draw, in as many parts as their count asks for, so
    no task orders a whole source or a whole group of copies.
    """
    rates, _ = balance(_cells(rows))
    rates = rates.withColumn("parts", F.ceil(F.col("n") / PART).cast("int")).checkpoint()
    large = rates.filter("parts > 1").select(F.col("key").alias("__key"), F.col("size").alias("__size"), F.col("parts").alias("__parts")).checkpoint()
    if large.isEmpty():
        rows = rows.withColumn("__part", F.lit(0))
        plan = rates.withColumns({"part": F.lit(0), "rows": F.col("n")})
    else:
        # At most one cell in PART documents.
        rows = rows.join(F.broadcast(large), ["__key", "__size"], "left")
        rows = rows.withColumn("__part", F.pmod(F.xxhash64("__draw"), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
        split = rows.join(F.broadcast(large), ["__key", "__size"], "left_semi").groupBy(F.col("__key").alias("key"), F.col("__size").alias("size"), F.col("__part").alias("part")).agg(F.count("*").alias("rows"))
        whole = rates.filter("parts = 1").withColumns({"part": F.lit(0), "rows": F.col("n")})
        plan = whole.unionByName(rates.filter("parts > 1").join(split, ["key", "size"]).select(*whole.columns))
    plan = settle(plan).checkpoint()
    plan = plan.select(F.col("key").alias("__key"), F.col("size").alias("__size"), F.col("part").alias("__part"), F.struct("source_size", "target", "rate", "start").alias("__cell"))
    plan = F.broadcast(plan) if plan.count() <= FEW else plan.hint("merge")
    ranked = rows.withColumn("__rank", F.row_number().over(W.partitionBy("__key", "__size", "__part").orderBy("__draw")) - 1)
    cell = F.col("__cell")
    at = cell["start"] + F.col("__rank") * cell["rate"] + 0.5
    copies = F.when(cell["rate"] == F.floor(cell["rate"]), cell["rate"]).otherwise(F.floor(at + cell["rate"]) - F.floor(at)).cast("long")
    out = ranked.join(plan, ["__key", "__size", "__part"])
    return out.withColumn("__plan", F.struct(cell["source_size"].alias("source_size"), cell["target"].alias("target"), cell["rate"].alias("rate"), copies.alias("copies"))).drop("__cell", "__rank", "__part")


def _prepared(docs: DataFrame, doc_id: str, text: str, source: str, seed: int) -> dict:
    """What the mix needs of a row: a key of its source that is never null, its words and its draw."""
    own = F.col(source).cast("string")
    return {
        "__key": F.when(own.isNull(), F.lit("none")).otherwise(F.concat(F.lit("="), own)),
        "__source": own,
        "__size": F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"),
        "__draw": F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)),
    }


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies, rate`` of every row.

    ``size`` counts words (null: 0); rates solve the balance above, copies are rates rounded. Ties
    are equal ids and texts and so change no row's result; repeated rows each count. Null sources
    are one source, a source without words takes nothing, an empty table gives no rows, extra
    columns are ignored. Every rerun gives the same copies.
    """
    checkpoint_dir(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), *[x.alias(k) for k, x in _prepared(docs, doc_id, text, source, seed).items()]).checkpoint()
    size, plan = F.col("__size"), F.col("__plan")
    return _planned(rows).select("doc_id", size.alias("size"), plan["source_size"].alias("source_size"), plan["target"].alias("target"), (plan["copies"] * size).alias("taken"), plan["copies"].alias("copies"), plan["rate"].alias("rate"))


def take_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """The mixed documents: each row as often as its copies, with the columns of ``docs``.

    Copies are worked out beside the row itself, so rows that share an id, a size or a source keep
    each their own number. Rows with equal id, source and text are alike to the mix; any of them may
    get the larger number. Nulls, empty tables and clashing columns are as in ``mix_sources``.
    """
    checkpoint_dir(docs.sparkSession)
    rows = docs.withColumns(_prepared(docs, doc_id, text, source, seed))
    out = _planned(rows).withColumn("__copies", F.col("__plan.copies")).filter("__copies > 0")
    return out.withColumn("__each", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*docs.columns)
