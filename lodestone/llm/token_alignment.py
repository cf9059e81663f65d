"""Operator 13: alignment of two tokenizers over the same bytes, by elementary intervals.

The ends of both tokenizers' tokens cut a text into elementary intervals. Each interval lies in one
token of either side, so it is one link; where an end is shared a group of tokens closes. All texts of
a chunk are one byte line, so the work on tokens is whole-array.

Counts over the corpus take two passes: the first writes every document's distinct links and counts
each pair's documents with a partial aggregate; the second looks the counts up. If the counted pairs
are few they go to every task as sorted arrays, else links and counts are joined by shuffle.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .best_fit_packing import text_chunks
from .byte_bpe import encoder
from .components import checkpoint_dir

FEW = 1 << 22  #: pairs that are sent out whole: 20 bytes each, 84 MB at most

CACHED, LONGEST = 1 << 18, 64  #: parts that a worker keeps, and characters of one of them
PART = re.compile(r"(?<=[^ ]) (?=\S)")  #: a single space before a word

_sides: dict[tuple[str, str], Sides] = {}


class Sides:
    """Both tokenizers with the bytes of their ids."""

    def __init__(self, first_name: str, first: str, second: bytes) -> None:
        import sentencepiece

        self.first = encoder(first_name, first)
        self.second = sentencepiece.SentencePieceProcessor(model_proto=second)
        self.a_bytes = self.first.bytes_of
        ids = range(self.second.get_piece_size())
        piece = [self.second.id_to_piece(i) for i in ids]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, piece, strict=True)]
        self.a_size, self.b_size = (np.array([len(x) for x in y], dtype=np.int64) for y in (self.a_bytes, self.b_bytes))
        # How an id is written: first of a document, of a group, or within one; then for the other side.
        forms = [("", len(self.a_bytes)), (";", len(self.a_bytes)), (",", len(self.a_bytes)), ("|", len(self.b_bytes)), (",", len(self.b_bytes))]
        self.written = np.array([f"{mark}{i}" for mark, n in forms for i in range(n)], dtype=object)

        # Neither side joins what is before a single space to what is after it: of the second no piece goes on
        # after a word into a space, and the first takes a space that is before a word with that word.
        self.parted = not any(re.search("[^▁]▁", p) for p in piece)
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        self.broken: set[str] = set()  #: parts that a side does not give back

    def _parts(self, parts: list[str]) -> None:
        """Adds the ids of both sides for parts that are not known, four bytes each."""
        spaced = [" " + x for x in parts]
        for known, found, bytes_of in zip(self.known, (self.first.encode(spaced, False), self.second.encode(parts, num_threads=1)), (self.a_bytes, self.b_bytes), strict=True):
            ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
            ids = np.fromiter(chain.from_iterable(found), np.int32, ends[-1] if len(ends) else 0)
            if b"".join(map(bytes_of.__getitem__, ids.tolist())) != "".join(spaced).encode():
                self.broken.update(x for x, own in zip(parts, found, strict=True) if b"".join(map(bytes_of.__getitem__, own)) != (" " + x).encode())
            held, start = ids.tobytes(), 0
            for part, end in zip(parts, (4 * ends).tolist(), strict=True):
                known[part] = held[start:end]
                start = end

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of both sides for each text, four bytes each; none where a side does not give the text's bytes back.

        A text is its parts' ids one after the other. Parts that are kept are not encoded again.
        """
        cut = [PART.split(x) if self.parted else [x] for x in texts]
        a, b = self.known
        new = list(set().union(*cut).difference(a))
        self._parts(new)
        out = [(b"".join(map(a.__getitem__, parts)), b"".join(map(b.__getitem__, parts))) if text and (not self.broken or self.broken.isdisjoint(parts)) else None for text, parts in zip(texts, cut, strict=True)]
        full = len(a) > CACHED
        for part in new:
            if full or len(part) > LONGEST:
                del a[part], b[part]
                self.broken.discard(part)
        return out


def union1d(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distinct values of two sorted arrays, sorted; a stable sort merges the two runs."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    keep = np.ones(len(both), dtype=bool)
    keep[1:] = both[1:] != both[:-1]
    return both[keep]


def aligned(a: np.ndarray, b: np.ndarray, a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, ...]:
    """For sorted ends of both sides: each interval's owners, and the group that each token is in.

    Returns (owner in a, owner in b, whether the interval closes a group, group of a's tokens, group of b's).
    """
    ends = union1d(a_end, b_end)
    of_a, of_b = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
    closes = (a_end[of_a] == ends) & (b_end[of_b] == ends)
    shared = ends[closes]
    return of_a, of_b, closes, np.searchsorted(shared, a_end), np.searchsorted(shared, b_end)


def _first_pass(sides: Sides, texts: list[str]) -> list[pa.Array]:
    """``n_a, n_b, n_groups, n_links, groups_sha256, pairs`` of each text."""
    found = sides.encode(texts)
    n = len(texts)
    counts_a = np.array([len(x[0]) // 4 if x else 0 for x in found], dtype=np.int64)
    counts_b = np.array([len(x[1]) // 4 if x else 0 for x in found], dtype=np.int64)
    a, b = (np.frombuffer(b"".join([x[side] for x in found if x]), np.int32).astype(np.int64) for side in (0, 1))
    del found
    doc_a, doc_b = np.repeat(np.arange(n), counts_a), np.repeat(np.arange(n), counts_b)
    # A document has as many bytes on both sides, so one running sum keeps the sides in step.
    of_a, of_b, closes, group_a, group_b = aligned(a, b, np.cumsum(sides.a_size[a]), np.cumsum(sides.b_size[b]))
    doc = doc_a[of_a]

    # The written groups: a's tokens of a group, then b's.
    opens_a, opens_b = np.ones(len(a), dtype=bool), np.ones(len(b), dtype=bool)
    opens_a[1:], opens_b[1:] = group_a[1:] != group_a[:-1], group_b[1:] != group_b[:-1]
    start_a = np.ones(len(a), dtype=bool)
    start_a[1:] = doc_a[1:] != doc_a[:-1]
    form_a, form_b = np.where(start_a, 0, np.where(opens_a, 1, 2)), np.where(opens_b, 0, 1)
    code = np.empty(len(a) + len(b), dtype=np.int64)
    code[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = a + form_a * len(sides.a_bytes)
    code[np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")] = b + form_b * len(sides.b_bytes) + 3 * len(sides.a_bytes)
    written = sides.written[code].tolist()
    edges = np.concatenate([[0], np.cumsum(counts_a + counts_b)]).tolist()
    digest = [hashlib.sha256("".join(written[s:e]).encode()).hexdigest() if e > s else "" for s, e in zip(edges[:-1], edges[1:], strict=True)]

    # Each document's distinct pairs with how often they are linked.
    bits_a, bits_b = len(sides.a_bytes).bit_length(), len(sides.b_bytes).bit_length()
    key = np.sort((doc << (bits_a + bits_b)) | (a[of_a] << bits_b) | b[of_b])
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    times, key = np.diff(np.append(at, len(key))), key[at]
    offsets = np.searchsorted(key, np.arange(n + 1) << (bits_a + bits_b))
    pair = [(key >> bits_b) & ((1 << bits_a) - 1), key & ((1 << bits_b) - 1), times]
    pairs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in pair], names=["a", "b", "n"]))
    per = lambda x: pa.array(np.bincount(x, minlength=n), pa.int64())
    return [pa.array(counts_a), pa.array(counts_b), per(doc[closes]), per(doc), pa.array(digest, pa.string()), pairs]


PASS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<a:int,b:int,n:int>>"


def alignments(docs: DataFrame, first: str, second: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256`` and ``pairs``, the distinct linked ids with their number of links.

    ``first`` is a byte-level file of the tokenizers library and reads a space and the text; ``second``
    is a sentencepiece file that puts the space itself. Both are read by the driver and sent out whole.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    with open(first, encoding="utf-8") as one, open(second, "rb") as two:
        held = docs.sparkSession.sparkContext.broadcast((one.read(), two.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (first, second)
        for batch in batches:
            if key not in _sides:
                _sides[key] = Sides(first, *held.value)
            texts = batch.column(1).fill_null("").to_pylist()
            for low, high in text_chunks(texts):
                columns = _first_pass(_sides[key], texts[low:high])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *columns], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {PASS}")


def pair_counts(links: DataFrame) -> DataFrame:
    """``a, b, docs, best``: in how many documents a pair is linked, and the highest such number of its ``a``."""
    docs = links.select(F.explode("pairs").alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("docs"))
    best = docs.groupBy("a").agg(F.max("docs").alias("best"))
    return docs.join(best, "a")


def _look_up(links: DataFrame, counts: DataFrame) -> DataFrame:
    """``n_best, count_sum`` by sorted arrays of all pairs in every task."""
    table = counts.toArrow()
    key = (table.column("a").to_numpy().astype(np.int64) << 32) | table.column("b").to_numpy()
    order = np.argsort(key)
    docs, best = table.column("docs").to_numpy()[order], table.column("best").to_numpy()[order]
    held = links.sparkSession.sparkContext.broadcast((key[order], docs, docs == best))
    rest = [x for x in links.columns if x not in ("pairs", "row")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, docs, highest = held.value
        for batch in batches:
            pairs = batch.column("pairs")
            sizes = np.diff(pairs.offsets.to_numpy())
            a, b, n = (x.to_numpy().astype(np.int64) for x in pairs.flatten().flatten())
            at = np.searchsorted(known, (a << 32) | b)
            edges = np.concatenate([[0], np.cumsum(sizes)])
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (np.where(highest[at], n, 0), n * docs[at])]
            found = [pa.array(x[edges[1:]] - x[edges[:-1]], pa.int64()) for x in sums]
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in rest], *found], names=[*rest, "n_best", "count_sum"])

    schema = ", ".join(f"{x} {links.schema[x].dataType.simpleString()}" for x in rest)
    return links.mapInArrow(run, f"{schema}, n_best long, count_sum long")


def _join(links: DataFrame, counts: DataFrame) -> DataFrame:
    """``n_best, count_sum`` by a join on the pairs, which adaptive execution splits where a pair is in very many documents."""
    each = links.select("row", F.explode("pairs").alias("p")).select("row", "p.a", "p.b", "p.n").join(counts.hint("merge"), ["a", "b"])
    sums = each.groupBy("row").agg(F.sum(F.when(F.col("docs") == F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum"))
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long").alias(x)
    return links.drop("pairs").join(sums.hint("merge"), "row", "left").select(*[x for x in links.columns if x not in ("pairs", "row")], zero("n_best"), zero("count_sum"))


def align_tokens(docs: DataFrame, first: str, second: str, doc_id: str = "doc_id", text: str = "text", few: int = FEW) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum`` of every row.

    A null or empty text, and one that a side does not give back byte for byte, has no tokens: zeros
    and an empty digest. Repeated rows each count as a document. An empty table gives no rows; extra
    columns are ignored. Links are written once as Parquet under the checkpoint folder, so neither
    pass depends on an executor that may be lost. Pairs of up to ``few`` rows, as counted, are looked
    up in arrays, more by a join; the results are the same. Memory follows half a million characters,
    or one text if that is longer, and a quarter of a million parts whose ids a worker keeps.
    """
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark)}/links-{uuid.uuid4().hex}"
    made = alignments(docs, first, second, doc_id, text).withColumn("row", F.monotonically_increasing_id())
    made.write.option("compression", "zstd").parquet(path)
    links = spark.read.schema(made.schema).parquet(path)
    counts = pair_counts(links).checkpoint()
    return _look_up(links, counts) if counts.count() <= few else _join(links, counts)
