"""Operator 11: exact rolling median and median absolute deviation over time, in equal-count chunks.

The rows of all series, in order of (series, time, id), are cut into ranges of about equal counts,
the chunks. Each chunk also gets copies of the rows that its windows reach back to (the halo, one
window long) and of rows at its last time that fell into a later chunk. A task then slides over one
chunk, sorted by Spark, with a blocked sorted list: the median is read by rank, the deviation is the
k-th distance across the two sides of the median.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import checkpoint_dir

MOST = 10**17  #: beyond this cents are no exact doubles
FORGET = 1 << 16  #: entries that have left a window before their memory is freed


class SlidingWindow:
    """Values of the last ``width`` time units with their multiplicities, sorted in blocks of about square-root size.

    Blocks hold distinct values, so equal values share one entry; what will leave is kept as three
    arrays of 8 bytes an entry.
    """

    def __init__(self, width: int) -> None:
        self.width = width
        self.clear()

    def clear(self) -> None:
        self.values: list[list[int]] = []
        self.counts: list[list[int]] = []
        self.sums: list[list[int] | None] = []  #: running counts of a block, rebuilt when asked for
        self.tops: list[int] = []
        self.totals: list[int] = []
        self.before: list[int] | None = None  #: running totals of blocks
        self.n = self.distinct = 0
        self.times, self.entered, self.copies, self.head = array("q"), array("q"), array("q"), 0

    def enter(self, time: int, value: int, copies: int) -> None:
        self.times.append(time)
        self.entered.append(value)
        self.copies.append(copies)
        self.n += copies
        self.before = None
        if not self.tops:
            self.values, self.counts, self.sums, self.tops, self.totals = [[value]], [[copies]], [None], [value], [copies]
            self.distinct = 1
            return
        b = min(bisect_left(self.tops, value), len(self.tops) - 1)
        block, counts = self.values[b], self.counts[b]
        i = bisect_left(block, value)
        self.totals[b] += copies
        self.sums[b] = None
        if i < len(block) and block[i] == value:
            counts[i] += copies
            return
        block.insert(i, value)
        counts.insert(i, copies)
        self.distinct += 1
        self.tops[b] = block[-1]
        if len(block) > 32 and len(block) > 2 * isqrt(self.distinct):
            self._split(b)

    def _split(self, b: int) -> None:
        block, counts = self.values[b], self.counts[b]
        half = len(block) // 2
        self.values[b : b + 1] = [block[:half], block[half:]]
        self.counts[b : b + 1] = [counts[:half], counts[half:]]
        self.sums[b : b + 1] = [None, None]
        self.tops[b : b + 1] = [block[half - 1], block[-1]]
        self.totals[b : b + 1] = [sum(counts[:half]), sum(counts[half:])]

    def _leave(self, value: int, copies: int) -> None:
        b = bisect_left(self.tops, value)
        block, counts = self.values[b], self.counts[b]
        i = bisect_left(block, value)
        self.totals[b] -= copies
        self.sums[b] = None
        counts[i] -= copies
        if counts[i]:
            return
        del block[i], counts[i]
        self.distinct -= 1
        if not block:
            for x in (self.values, self.counts, self.sums, self.tops, self.totals):
                del x[b]
        else:
            self.tops[b] = block[-1]
            if b and len(block) + len(self.values[b - 1]) <= isqrt(self.distinct):
                self.values[b - 1] += block
                self.counts[b - 1] += counts
                self.sums[b - 1], self.tops[b - 1] = None, block[-1]
                self.totals[b - 1] += self.totals[b]
                for x in (self.values, self.counts, self.sums, self.tops, self.totals):
                    del x[b]

    def move(self, time: int) -> None:
        """What is older than ``time`` less the width leaves."""
        times, head, least = self.times, self.head, time - self.width
        while head < len(times) and times[head] < least:
            self._leave(self.entered[head], self.copies[head])
            self.n -= self.copies[head]
            head += 1
        if head != self.head:
            self.before = None
        if head > FORGET and 2 * head > len(times):
            del self.times[:head], self.entered[:head], self.copies[:head]
            head = 0
        self.head = head

    def rank(self, k: int) -> int:
        """The k-th smallest value, from 0, copies counted."""
        if self.before is None:
            self.before = list(accumulate(self.totals, initial=0))
        b = bisect_right(self.before, k) - 1
        sums = self.sums[b]
        if sums is None:
            sums = self.sums[b] = list(accumulate(self.counts[b]))
        return self.values[b][bisect_right(sums, k - self.before[b])]

    def measures(self) -> tuple[int, int | None, int | None]:
        """Number of values, doubled median, and doubled median of the doubled distances from it."""
        n, rank = self.n, self.rank
        if n < 2:
            return n, None, None
        low = (n - 1) // 2
        below = rank(low)
        median2 = 2 * below if n % 2 else below + rank(low + 1)
        # The low + 1 values closest to the median are neighbours in rank; `start` is the first of them.
        start, end = 0, n - low - 1
        while start < end:
            middle = (start + end) // 2
            if median2 - 2 * rank(middle) > 2 * rank(middle + low + 1) - median2:
                start = middle + 1
            else:
                end = middle
        far = max(median2 - 2 * rank(start), 2 * rank(start + low) - median2)
        if n % 2:
            return n, median2, 2 * far
        beyond = []
        if start:
            beyond.append(median2 - 2 * rank(start - 1))
        if start + low + 1 < n:
            beyond.append(2 * rank(start + low + 1) - median2)
        return n, median2, far + min(beyond)


def _slide(width: int):
    """Over rows ``series, at, id, value, copies, own`` sorted by series and time: measures for the own ones."""

    def emit(rows: list[pa.RecordBatch], found: list[tuple], sizes: list[int]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(rows).combine_chunks()
        n, median2, mad4 = (pa.array(x, pa.int64()) for x in zip(*found, strict=True))
        each = pa.array(np.repeat(np.arange(len(found)), sizes))
        n, median2, mad4 = n.take(each), median2.take(each), mad4.take(each)
        value = rows.column("value").combine_chunks()
        known = value.is_valid().to_numpy(zero_copy_only=False) & median2.is_valid().to_numpy(zero_copy_only=False)
        cents, middle, spread = (x.fill_null(0).to_numpy() for x in (value, median2, mad4))
        far = pa.array(2 * np.abs(2 * cents - middle) > 3 * spread, mask=~known)
        one = lambda name: rows.column(name).combine_chunks()
        return pa.RecordBatch.from_arrays([one("id"), one("series"), n, median2, mad4, far], names=["id", "series", "n", "median2", "mad4", "far"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, last, held = SlidingWindow(width), None, 0
        waiting: list[pa.RecordBatch] = []  # own rows of the time whose rows may not all have come
        for batch in batches:
            if not len(batch):
                continue
            names = batch.column(0).dictionary_encode()
            codes, labels = names.indices.fill_null(-1).to_numpy(), [*names.dictionary.to_pylist(), None]
            at = batch.column(1).cast(pa.int64()).to_numpy()
            new = np.ones(len(batch), dtype=bool)
            new[1:] = (at[1:] != at[:-1]) | (codes[1:] != codes[:-1])
            new[0] = last != (labels[codes[0]], at[0])
            edges = np.flatnonzero(new)
            mine = batch.column(5).to_numpy(zero_copy_only=False)
            own = np.concatenate([[0], np.cumsum(mine)])
            valid = batch.column(3).is_valid().to_numpy(zero_copy_only=False).tolist()
            values, copies, times = batch.column(3).fill_null(0).to_numpy().tolist(), batch.column(4).to_numpy().tolist(), at.tolist()
            found, sizes = [], []
            starts = edges.tolist() if new[0] else [0, *edges.tolist()]
            for s, e in zip(starts, [*starts[1:], len(batch)], strict=True):
                if s or new[0]:
                    if held:
                        found.append(window.measures())
                        sizes.append(held)
                    held = 0
                    series = labels[codes[s]]
                    if last is None or series != last[0]:
                        window.clear()
                    window.move(times[s])
                    last = (series, times[s])
                held += int(own[e] - own[s])
                for i in range(s, e):
                    if valid[i]:
                        window.enter(times[i], values[i], copies[i])
            cut = int(edges[-1]) if len(edges) else 0
            keep = lambda a, b: batch.slice(a, b - a).filter(pa.array(mine[a:b]))  # noqa: B023, E731
            if found:
                yield emit([*waiting, keep(0, cut)], found, sizes)
                waiting = []
            elif len(edges):
                waiting = []
            waiting.append(keep(cut, len(batch)))
        if held:
            yield emit(waiting, [window.measures()], [held])

    return run


def cents(value: Column) -> Column:
    """``floor(100 * value + 0.5)``; none for null, NaN, infinite values and those beyond ``MOST``."""
    scaled = F.floor(F.lit(100.0) * value + F.lit(0.5))
    return F.when(~F.isnan(value) & (F.abs(F.lit(100.0) * value) < float(MOST)), scaled.cast("long"))


def rolling_median(events: DataFrame, value: Column, minutes: int = 60, chunks: int | None = None, event_id: str = "click_id", series: str = "kind", at: str = "ts") -> DataFrame:
    """``<event_id>, <series>, n, median2, mad4, far`` of every event id that has a time.

    The window of an event holds the whole-number ``value`` of its series' events from ``minutes``
    before its own time up to and including it. ``median2`` is the window's doubled median, ``mad4``
    the doubled median of the distances of doubled values from ``median2``; both, and ``far``, are
    null if fewer than two values are in the window. ``far`` is null without a value of one's own.

    Rows without a time are dropped; of an id's other rows the first by time, series and value counts
    once (nulls first). A null id is an id, a null series a series. Ties in time see each other
    whatever chunk they are in. An empty table gives no rows; extra columns are ignored.

    The driver sees a bounded sample for the borders, and the tables of chunks that are broadcast have
    rows by ``chunks`` (default: the session's shuffle partitions), not by the input. Halos are
    combined to one row for each time and value before they are copied, so a time or a value that
    holds a third of all rows is copied once for each chunk. A task holds the distinct values of one
    window, 24 bytes for each (time, value) in it, and the rows of one single time in its chunk.
    """
    spark = events.sparkSession
    checkpoint_dir(spark)
    parts = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = events.select(F.col(event_id).alias("id"), F.struct(F.col(at).alias("at"), F.col(series).alias("series"), value.cast("long").alias("value")).alias("row"))
    once = rows.filter("row.at IS NOT NULL").groupBy("id").agg(F.min("row").alias("row")).select("row.series", "row.at", "id", "row.value")
    placed = once.repartitionByRange(parts, "series", "at", "id").withColumn("chunk", F.spark_partition_id()).checkpoint()

    each = placed.groupBy("chunk", "series").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    ends = each.groupBy("chunk").agg(F.min(F.struct("series", "first")).alias("low"), F.max(F.struct("series", "last")).alias("high")).checkpoint()
    reach = F.expr(f"INTERVAL '{int(minutes)}' MINUTE")
    a, b = ends.alias("a"), ends.alias("b")
    earlier = a.join(b, F.col("a.high.series").eqNullSafe(F.col("b.low.series")) & (F.col("a.chunk") < F.col("b.chunk")) & (F.col("a.high.last") >= F.col("b.low.first") - reach))
    later = a.join(b, F.col("a.low.series").eqNullSafe(F.col("b.high.series")) & (F.col("a.chunk") > F.col("b.chunk")) & (F.col("a.low.first") <= F.col("b.high.last")))
    need = lambda x, s, lo, hi: x.select(F.col("a.chunk"), F.struct(F.col("b.chunk").alias("to"), s.alias("series"), lo.alias("since"), hi.alias("until")).alias("need"))
    needs = need(earlier, F.col("b.low.series"), F.col("b.low.first") - reach, F.col("b.low.first")).union(need(later, F.col("b.high.series"), F.col("b.high.last"), F.col("b.high.last")))
    needs = needs.groupBy("chunk").agg(F.collect_list("need").alias("needs"))
    wanted = lambda n: F.col("series").eqNullSafe(n["series"]) & F.col("at").between(n["since"], n["until"])
    lent = placed.filter("value IS NOT NULL").join(F.broadcast(needs), "chunk").filter(F.exists("needs", wanted))
    # One row for each time and value before anything is copied.
    lent = lent.groupBy("chunk", "series", "at", "value").agg(F.count("*").alias("copies")).join(F.broadcast(needs), "chunk")
    halo = lent.select(F.explode(F.transform(F.filter("needs", wanted), lambda n: n["to"])).alias("chunk"), "series", "at", "value", "copies")

    own = placed.select("chunk", "series", "at", "id", "value", F.lit(1).cast("long").alias("copies"), F.lit(True).alias("own"))
    kind = placed.schema["id"].dataType
    both = own.union(halo.select("chunk", "series", "at", F.lit(None).cast(kind).alias("id"), "value", "copies", F.lit(False).alias("own")))
    ready = both.repartitionById(parts, "chunk").select("series", "at", "id", "value", "copies", "own").sortWithinPartitions("series", "at")
    types = {x: placed.schema[x].dataType.simpleString() for x in ("id", "series")}
    out = ready.mapInArrow(_slide(int(minutes) * 60_000_000), f"id {types['id']}, series {types['series']}, n long, median2 long, mad4 long, far boolean")
    return out.withColumnsRenamed({"id": event_id, "series": series})
