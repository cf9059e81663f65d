"""Operator 12: packing documents into training sequences by vector best fit.

A sequence has three capacities: tokens, documents (pieces), and attention cost (the sum of squared
piece lengths, as attention is masked between documents). Pieces go by decreasing size into the open
sequence that all three capacities allow and whose weighted residual norm after it is least (``norm``)
or whose residual has the largest weighted dot product with the piece (``dot``).

Pieces are dealt at random into buckets of a bounded number and each bucket is packed by one task.
What a bucket leaves in sequences that are not full is dealt anew into fewer buckets, until one is left
or another round would not help; so the whole corpus has about as few open ends as one bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import encoder
from .components import checkpoint_dir

SIZE = 2048
END = 0  #: the id after every document
BUCKET = 1 << 14  #: pieces that one task packs
SEED = 12
LOOSE = 32  #: a sequence with more than a part in so many of its tokens left is packed anew
TEXTS = 1 << 19  #: characters encoded at once

def text_chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``TEXTS`` characters each."""
    first = held = 0
    for i, x in enumerate(texts):
        if held and held + len(x) > TEXTS:
            yield first, i
            first, held = i, 0
        held += len(x)
    if texts:
        yield first, len(texts)


def cut(length: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only one longer than ``size`` is cut, and the first piece takes the odd rest."""
    if length <= size:
        return [(0, length)]
    first = length % size or size
    return [(0, first)] + [(start, size) for start in range(first, length, size)]


def best_fit(demands: np.ndarray, capacities: np.ndarray, weights: np.ndarray, select: str = "norm") -> np.ndarray:
    """The bin of each row of ``demands`` (items by dimensions), each of which fits into an empty bin.

    Items go by decreasing weighted size, ties by position. Of equal scores the bin opened first wins.
    """
    scaled = demands / capacities
    order = np.argsort(-(scaled * weights).sum(axis=1), kind="stable")
    least = demands.min(axis=0, initial=np.iinfo(np.int64).max)
    bins = np.empty(len(demands), dtype=np.int64)
    left = np.empty((len(capacities), 1024), dtype=np.int64)
    label = np.empty(1024, dtype=np.int64)
    unit = (weights / capacities.astype(float) ** 2)[:, None]
    opened = used = 0
    for item in order:
        demand = demands[item][:, None]
        fits = np.flatnonzero((left[:, :used] >= demand).all(axis=0))
        if len(fits):
            room = left[:, fits]
            if select == "norm":
                chosen = fits[np.argmin((unit * (room - demand).astype(float) ** 2).sum(axis=0))]
            else:
                chosen = fits[np.argmax((unit * room * demand).sum(axis=0))]
        else:
            if used == left.shape[1]:  # forget bins that nothing fits into; grow if there are few of them
                alive = np.flatnonzero((left[:, :used] >= least[:, None]).all(axis=0))
                width = max(1024, 2 * len(alive))
                left = np.concatenate([left[:, alive], np.empty((len(capacities), width - len(alive)), dtype=np.int64)], axis=1)
                label = np.concatenate([label[alive], np.empty(width - len(alive), dtype=np.int64)])
                used = len(alive)
            chosen = used
            left[:, chosen], label[chosen] = capacities, opened
            opened, used = opened + 1, used + 1
        left[:, chosen] -= demands[item]
        bins[item] = label[chosen]
    return bins


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if kept, ``ids`` of every document's pieces.

    Ids are those of the tokenizer file, without special tokens added, then ``END``. The file is read
    by the driver and goes out whole (a vocabulary is some ten thousand entries).
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    with open(tokenizer, encoding="utf-8") as file:
        held = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, held.value).encode
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            for first, last in text_chunks(texts):
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for at, found in enumerate(encode(texts[first:last], True), first):
                    own = np.array([*found, END], dtype="<u4")
                    for k, (begin, n) in enumerate(cut(len(own), size)):
                        part = own[begin : begin + n]
                        row.append(at), piece.append(k), start.append(begin), length.append(n), crc.append(zlib.crc32(part.tobytes()))
                        if keep_ids:
                            ids.append(part.astype(np.int32))
                columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * keep_ids, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def _bucket(size: int, most: int, cost: int, weights: tuple[float, float, float], select: str):
    capacities, weight = np.array([size, most, cost], dtype=np.int64), np.array(weights, dtype=float)

    def run(rows: pa.Table) -> pa.Table:
        length = rows.column("length").to_numpy().astype(np.int64)
        bins = best_fit(np.stack([length, np.ones_like(length), length * length], axis=1), capacities, weight, select)
        order = np.lexsort((-length, bins))
        ordered, lengths = bins[order], length[order]
        before = np.cumsum(lengths) - lengths
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
        number = np.cumsum(np.r_[True, ordered[1:] != ordered[:-1]]) - 1 if len(ordered) else first
        taken = np.add.reduceat(lengths, first) if len(first) else first
        bucket = rows.column("bucket").to_numpy()
        out = rows.take(pa.array(order)).drop_columns(["bucket"])
        out = out.append_column("sequence_id", pa.array(-1 - ((bucket << 32) + ordered), pa.int64()))
        out = out.append_column("offset", pa.array(before - before[first][number], pa.int64()))
        return out.append_column("left", pa.array(size - taken[number], pa.int64()))

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    size: int = SIZE,
    most_pieces: int | None = None,
    attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1),
    select: str = "norm",
    bucket: int = BUCKET,
    doc_id: str = "doc_id",
    text: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece (and ``ids`` if kept).

    Every sequence has at most ``size`` tokens, ``most_pieces`` pieces and a sum of squared piece
    lengths of at most ``attention``; without the last two, what ``size`` tokens can reach at most.
    ``weights`` weigh tokens, pieces and attention in the choice of a sequence. Pieces of ``size``
    tokens fill sequences of their own (``attention`` must allow them) and are not shuffled.

    A null text is an empty one, and that is its end id alone. Repeated rows and ids each have their
    own pieces; rows are dealt to buckets by the number they got in a checkpoint, so equal rows spread
    evenly. An empty table gives no rows; extra columns are ignored. Sequence ids are unique, and may
    differ between runs.
    """
    spark = docs.sparkSession
    checkpoint_dir(spark)
    most, cost = most_pieces or size, attention or size * size
    if cost < size * size or most < 1:
        raise ValueError("a sequence must be able to hold a piece of its own size")
    made = pieces(docs, tokenizer, size, doc_id, text, keep_ids).withColumn("row", F.monotonically_increasing_id()).checkpoint()
    packed = [made.filter(F.col("length") == size).withColumns({"sequence_id": F.col("row"), "offset": F.lit(0).cast("long")}).drop("row")]
    todo = made.filter(F.col("length") < size)
    count, round_ = todo.count(), 0
    while count:
        buckets = -(-count // bucket)
        dealt = F.pmod(F.xxhash64(F.lit(SEED + round_), "row"), F.lit(buckets)) + F.lit(round_ << 26)
        ready = todo.withColumn("bucket", dealt)
        schema = T.StructType(list(todo.schema) + [T.StructField(x, T.LongType()) for x in ("sequence_id", "offset", "left")])
        done = ready.groupBy("bucket").applyInArrow(_bucket(size, most, cost, tuple(weights), select), schema).checkpoint()
        loose = done.filter(F.col("left") * LOOSE > size)
        rest = loose.count() if buckets > 1 else 0
        if not 0 < 2 * rest <= count:
            packed.append(done.drop("row", "left"))
            break
        packed.append(done.filter(F.col("left") * LOOSE <= size).drop("row", "left"))
        todo, count, round_ = loose.select(*todo.columns), rest, round_ + 1
    return reduce(DataFrame.unionByName, packed)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids, lengths``: the sequences themselves, from pieces with their ids; a sequence has at most its size in tokens."""
    part = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("parts")
    own = lambda field: F.transform("parts", lambda p: p[field])
    return packed.groupBy("sequence_id").agg(part).select("sequence_id", F.flatten(own("ids")).alias("ids"), own("doc_id").alias("doc_ids"), own("length").alias("lengths"))
