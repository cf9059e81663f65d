"""Operator 7: benchmark decontamination with a distributed positional inverted index.

The index is stored: a row for each chunk of training texts holds the chunk's terms (64-bit hashes,
sorted), how often each occurs, and its postings, the positions in order. Chunks are indexed where
their texts lie, so nothing is shuffled. Test phrases then read the index alone: the postings of a
phrase's rarest term, moved back by its offset, are intersected with those of its other terms, the
rarer first. With a slop of 0 that gives exact phrases, else proximity matches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from . import textkernel as K
from .components import checkpoint_dir

WINDOW = 13
BLOCK_BYTES = 16 << 20  #: benchmark text that is sent to the executors at a time
FEW_ROWS = 1 << 18  #: rows with hits that are sent out whole
TABLE = K.byte_table(0xBE2C, lower=True)


def _hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = K.words(buf, offsets, K.NOT_ALNUM)
    return K.word_hashes(buf, starts, ends, TABLE), first


class Phrases:
    """Windows of test items: runs in one array of term numbers, and the item of each."""

    def __init__(self, items: list[tuple[str, str | None]], width: int = WINDOW) -> None:
        self.items, found, at, length, item, n = [], [], [], [], [], 0
        for name, text in items:
            data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
            hashes = _hashes(data, np.array([0, len(data)]))[0]
            windows = max(len(hashes) - width, 0) + 1 if len(hashes) else 0
            at.append(n + np.arange(windows))
            length.append(np.full(windows, min(len(hashes), width)))
            item.append(np.full(windows, len(self.items)))
            found.append(hashes)
            self.items.append(name)
            n += len(hashes)
        whole = lambda x, kind: np.concatenate([np.zeros(0, kind), *x]).astype(kind)
        self.terms, self.flat = np.unique(whole(found, np.uint64), return_inverse=True)
        self.at, self.length, self.item = whole(at, np.int64), whole(length, np.int64), whole(item, np.int64)


class PositionalIndex:
    """Terms and postings of one chunk of texts, packed in a few bytes a word."""

    def __init__(self, terms: np.ndarray, frequency: np.ndarray, postings: np.ndarray, first: np.ndarray) -> None:
        self.terms, self.frequency, self.postings, self.first = terms, frequency, postings, first
        self.begin = np.concatenate([[0], np.cumsum(frequency)])

    @classmethod
    def of(cls, hashes: np.ndarray, first: np.ndarray) -> PositionalIndex:
        postings = np.argsort(hashes, kind="stable")
        own = hashes[postings]
        begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        return cls(own[begin], np.diff(np.append(begin, len(own))), postings, first)

    def pack(self) -> bytes:
        gaps = np.diff(self.postings, prepend=0)
        gaps[self.begin[:-1]] = self.postings[self.begin[:-1]]
        sizes = np.array([len(self.terms), len(self.postings), len(self.first)], np.int64)
        parts = [sizes, self.terms.astype(np.uint64), self.frequency.astype(np.uint32), gaps.astype(np.uint32), self.first.astype(np.int64)]
        return zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in parts))

    @classmethod
    def unpack(cls, blob: bytes) -> PositionalIndex:
        data = zstandard.ZstdDecompressor().decompress(blob)
        n, m, k = np.frombuffer(data, np.int64, 3).tolist()
        frequency = np.frombuffer(data, np.uint32, n, 24 + 8 * n).astype(np.int64)
        gaps = np.frombuffer(data, np.uint32, m, 24 + 12 * n).astype(np.int64)
        out = cls(np.frombuffer(data, np.uint64, n, 24), frequency, gaps, np.frombuffer(data, np.int64, k, 24 + 12 * n + 4 * m))
        sums = np.cumsum(gaps)
        before = np.where(out.begin[:-1] > 0, sums[out.begin[:-1] - 1], 0) if m else np.zeros(0, np.int64)
        out.postings = sums - np.repeat(before, frequency)
        return out

    def find(self, phrases: Phrases, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) of every match within one text, all windows at a time.

        The window's rarest term (the first of ties) stands at its own place, and every other term
        within ``slop`` places of its own.
        """
        if not len(self.terms) or not len(phrases.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rank = np.minimum(np.searchsorted(self.terms, phrases.terms), len(self.terms) - 1)
        frequency = np.where(self.terms[rank] == phrases.terms, self.frequency[rank], 0)
        # Terms are in order and so are each one's postings: one sorted array holds all lists.
        key = np.repeat(np.arange(len(self.terms)) << 32, self.frequency) + self.postings
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for n in np.unique(phrases.length).tolist():
            own = np.flatnonzero(phrases.length == n)
            counts = np.lib.stride_tricks.sliding_window_view(frequency[phrases.flat], n)
            own = own[counts[phrases.at[own]].min(axis=1) > 0]
            if not len(own):
                continue
            order = np.argsort(counts[phrases.at[own]], axis=1, kind="stable")
            term = rank[np.lib.stride_tricks.sliding_window_view(phrases.flat, n)[phrases.at[own]]]
            rarest = np.take_along_axis(term, order[:, :1], axis=1)[:, 0]
            times = self.frequency[rarest]
            w = np.repeat(np.arange(len(own)), times)
            step = np.arange(len(w)) - np.repeat(np.cumsum(times) - times, times)
            anchor = self.postings[self.begin[rarest[w]] + step]
            start = anchor - order[w, 0]
            text = np.searchsorted(self.first, anchor, side="right") - 1
            low, high = self.first[text], self.first[text + 1]
            keep = (start >= low) & (start + n <= high) if not slop else np.ones(len(w), dtype=bool)
            w, start, low, high = w[keep], start[keep], low[keep], high[keep]
            for k in range(1, n):
                offset = order[w, k]
                place, base = start + offset, term[w, offset] << 32
                from_ = np.searchsorted(key, base + np.clip(place - slop, low, high))
                fits = (from_ < len(key)) & (key[np.minimum(from_, len(key) - 1)] <= base + np.minimum(place + slop, high - 1))
                w, start, low, high = w[fits], start[fits], low[fits], high[fits]
            found.append((own[w], np.maximum(start, low)))
        return np.concatenate([w for w, _ in found]), np.concatenate([s for _, s in found])


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunk = TaskContext.get().partitionId() << 40
    for batch in batches:
        for first_row, last_row, buf, offsets in K.chunks(batch.column(1)):
            hashes, first = _hashes(buf, offsets)
            rows = lambda c: pa.array([batch.column(c).slice(first_row, last_row - first_row).to_pylist()], pa.list_(batch.schema.field(c).type))  # noqa: B023,E731
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), rows(0), rows(2), pa.array([np.diff(first)], pa.list_(pa.int64())), pa.array([PositionalIndex.of(hashes, first).pack()])], names=["chunk", "doc_id", "key", "n_words", "postings"])
            chunk += 1


def positional_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index: ``chunk``, ``doc_id``, ``key`` (a hash of the text) and ``n_words`` of its texts, ``postings``.

    Chunks hold about a megabyte of text, or one longer text. Write it as a table to use it again;
    the other functions take either that or this frame.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("key"))
    return rows.mapInArrow(_indexed, f"chunk long, doc_id array<{rows.schema['doc_id'].dataType.simpleString()}>, key array<string>, n_words array<long>, postings binary")


def _scan(phrases: Phrases, slop: int):
    """Of every text with a match: ``chunk, at, item, start, end``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                index = PositionalIndex.unpack(blob.as_py())
                window, start = index.find(phrases, slop)
                at = np.searchsorted(index.first, start, side="right") - 1
                start = start - index.first[at]
                names = pa.array(phrases.items, pa.string()).take(pa.array(phrases.item[window]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(window), chunk)), pa.array(at.astype(np.int32)), names, pa.array(start), pa.array(start + phrases.length[window])], names=["chunk", "at", "item", "start", "end"])

    return run


def item_blocks(benchmark: DataFrame, item_id: str, text: str, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The test items in blocks of at most ``limit`` bytes of text (one item may be longer)."""
    block: list[tuple[str, str]] = []
    size = 0
    rows: Iterator[Row] = benchmark.select(F.col(item_id).cast("string"), F.col(text)).filter(F.col(text).isNotNull()).toLocalIterator()
    for name, body in rows:
        if block and size + len(body) > limit:
            yield block
            block, size = [], 0
        block.append((name if name is not None else "", body))
        size += len(body)
    if block:
        yield block


def benchmark_matches(index: DataFrame, benchmark: DataFrame, slop: int = 0, item_id: str = "item_id", item_text: str = "text", width: int = WINDOW, limit: int = BLOCK_BYTES) -> DataFrame:
    """``chunk, at, item, start, end`` (words within the text) of every match of an item's window.

    A window is ``width`` words of an item in a row, a shorter item is one window. With a ``slop`` of
    0 matches are exact phrases. Else each word may stand up to ``slop`` places off its own, counted
    from the window's rarest word, in the same text; ``start`` is where the window would begin.

    Test items go out in blocks of at most 16 MB, one at a time; each block is a pass over the index
    and its matches are kept in a checkpoint before the next block is read.
    """
    spark = index.sparkSession
    checkpoint_dir(spark)
    kinds = "chunk long, at int, item string, start long, end long"
    out = spark.createDataFrame([], kinds)
    for block in item_blocks(benchmark, item_id, item_text, limit):
        out = out.unionByName(index.select("chunk", "postings").mapInArrow(_scan(Phrases(block, width), slop), kinds).checkpoint())
    return out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words under spans, which are counted once, and the items' digest."""
    for batch in batches:
        hit = []
        for spans in batch.column(2).to_pylist():
            covered = end = 0
            for x in sorted(spans, key=lambda x: (x["start"], x["end"])):
                covered += max(0, x["end"] - max(x["start"], end))
                end = max(end, x["end"])
            hit.append(covered)
        names = [sorted(x) for x in batch.column(3).to_pylist()]
        sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array(sha)], names=["chunk", "at", "n_hit", "n_items", "items_sha256"])


def _judged(docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, width: int, limit: int) -> DataFrame:
    checkpoint_dir(docs.sparkSession)
    index = positional_index(docs, doc_id, text).checkpoint()
    found = benchmark_matches(index, benchmark, 0, item_id, item_text, width, limit).distinct()
    by_text = found.groupBy("chunk", "at").agg(F.collect_set(F.struct("start", "end")).alias("spans"), F.collect_set("item").alias("items"))
    hits = by_text.mapInArrow(_digest, "chunk long, at int, n_hit long, n_items long, items_sha256 string").checkpoint()
    hits = F.broadcast(hits) if hits.count() <= FEW_ROWS else hits.hint("merge")
    rows = index.select("chunk", F.posexplode(F.arrays_zip("doc_id", "key", "n_words")).alias("at", "row"))
    out = rows.join(hits, ["chunk", "at"], "left")
    none = hashlib.sha256(b"").hexdigest()
    n_hit, n_items = (F.coalesce(c, F.lit(0).cast("long")) for c in ("n_hit", "n_items"))
    out = out.select("row.doc_id", "row.key", "row.n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), F.coalesce("items_sha256", F.lit(none)).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW, limit: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every row of ``docs``.

    Words are runs of ASCII letters (lower-cased), digits and characters beyond ASCII. Words inside
    any occurrence of an item's window are hit; a document is contaminated if at least one word in
    twenty is. The index is stored in a checkpoint and the benchmark is held against it.

    Null or empty texts have no words, and neither do null items; repeated rows and items each count
    as they are (an item id once). An empty table gives no rows, an empty benchmark no hits. Other
    columns are ignored. A long text is a chunk of its own.
    """
    return _judged(docs, benchmark, doc_id, text, item_id, item_text, width, limit).drop("key")


def decontaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns.

    A verdict rests on the text alone, so rows go by a 128-bit hash of it: rows that share an id, or
    have none, are judged each by its own text, and copies go together. Only the hashes of
    contaminated texts are joined, sent out whole if counted to be few.
    """
    gone = _judged(docs, benchmark, doc_id, text, item_id, item_text, WINDOW, BLOCK_BYTES).filter("contaminated").select(F.col("key").alias("__key")).distinct().checkpoint()
    gone = F.broadcast(gone) if gone.count() <= FEW_ROWS else gone.hint("merge")
    own = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    return docs.withColumn("__own", own).join(gone, F.col("__own") == F.col("__key"), "left_anti").select(docs.columns)
