"""Operator 1: exact n-gram Jaccard self-join by universe partition and pigeonhole.

Size bands. Sets of sizes l to 4l/3 form a band, so a set of at most another's size that links
with it lies in the same band or the one below. Group g joins bands g-1 and g: a set is in two
groups, its own and the next one.

Signatures. In a group whose largest size is r, a linked pair differs in at most
H = 2r(1-J)/(1+J) shingles. The hash range of shingles is cut into m segments. If a set's
segments could all differ only by more than H shingles in total, some segment must agree:

* large groups index the whole content of each segment that is not empty (threshold 0): a
  difference costs 1 per segment, so H+1 such segments suffice;
* small groups index a segment's content and its one-deletion neighbourhood (threshold 1): a
  segment of two or more shingles that does not match costs 2, one of a single shingle 1;
* empty segments are skipped (threshold -1), and m is chosen for what the others cost.

A set whose segments don't reach H+1 in total is signed again with the next seed, until they do
(or no seed is left; it is then "unsure"). A pair needs the bound on one side only, and both
sides sign with every seed up to the first at which either reaches it.

Hot signatures, which more than ``SMALL`` sets share, would give all pairs of a group. They give
only pairs with the smallest member, then with the member of most hot signatures. Beyond that a set may skip (threshold -1) as many signatures
as its segments cost above H, its hottest first, since each partner shares more. For sets of
different components that share a hot signature that neither could skip, blocks of about ``BLOCK``
members are compared block by block on parity sketches, so the rest is exact, and bounded in memory.

Verification. |x xor y| is at least the number of bits in which the parity sketches differ, which
rules out most candidates; the others are verified on the whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import LongType, StructField, StructType

from . import textkernel as K
from .components import checkpoint_dir, merged

WIDTH, NUM, DEN = 5, 75, 100  #: words in a shingle; similarity NUM / DEN
SMALL, BLOCK, SEEDS = 16, 2048, 24
FEW_IDS = 1 << 20  #: ids, or rows of two or three numbers, that are sent out whole
HOT = 1 << 16  #: rows of a key that is sent out alone
SHARE = (0.355, 1.1)  #: segments of large groups, as a share of the largest size: constant, and by the root of the size
SMALL_GROUP = 48  #: largest size of the groups that index one-deletion neighbourhoods
LEAST_BITS = 256
TABLE = K.byte_table(0x5EED, lower=True)
FLUSH_DOCS, FLUSH_SIGS = 1 << 14, 1 << 20
U64 = np.uint64


@lru_cache(maxsize=1)
def bands(limit: int = 1 << 40) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest size of each band."""
    low, high, at = [], [], 1
    while at < limit:
        low.append(at)
        high.append(at * DEN // NUM)
        at = high[-1] + 1
    return np.array(low, dtype=np.int64), np.array(high, dtype=np.int64)


@lru_cache(maxsize=1)
def groups() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each group: most differing shingles of a linked pair, segments, whether it is small."""
    high = bands()[1]
    # Two sets of one size r differ least when linked with r + r = union + intersection.
    most = 2 * high * (DEN - NUM) // (DEN + NUM)
    small = high <= SMALL_GROUP
    share = SHARE[0] + SHARE[1] / np.sqrt(high)
    segments = np.where(small, np.ceil((most + 1) * 0.5 * 1.35 - 0.35), np.ceil(high * share)).astype(np.int64)
    return most, np.maximum(segments, 1), small


def _sets(batch: pa.RecordBatch, text: int = 1) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for first, last, buf, offsets in K.chunks(batch.column(text)):
        starts, ends, word = K.words(buf, offsets, K.SPACE)
        hashes = K.word_hashes(buf, starts, ends, TABLE)
        shingles, at = K.shingle_sets(hashes, word, WIDTH)
        yield first, last, shingles, at


def _identity(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 63-bit name of each set; 0 for the empty set."""
    sizes = np.diff(at)
    total = np.concatenate([[U64(0)], np.cumsum(K.mix(shingles + U64(0xC1A55)), dtype=U64)])
    name = K.mix(total[at[1:]] - total[at[:-1]] + K.mix(sizes.astype(U64))) >> U64(1)
    return np.where(sizes > 0, np.maximum(name, U64(1)), U64(0)).astype(np.int64)


def _sketch(shingles: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The parity of the shingles that fall on each bit of a power of two of bits, one bit or more a shingle."""
    sizes = np.diff(at)
    width = np.maximum(LEAST_BITS, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(width)])
    bit = K.mix(shingles + U64(0xB175)).astype(np.int64) & np.repeat(width - 1, sizes)
    odd = np.bincount(np.repeat(begin[:-1], sizes) + bit, minlength=begin[-1]).astype(np.uint8) & 1
    packed = np.packbits(odd).tobytes()
    return [packed[x // 8 : y // 8] for x, y in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


def _folded(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches as words, the wider ones folded to ``width`` bytes."""
    out = np.zeros((len(sketches), width // 8), dtype=U64)
    for i, x in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(x, U64).reshape(-1, width // 8), axis=0)
    return out


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_shingles, name of the set, sketch."""
    for batch in batches:
        for first, last, shingles, at in _sets(batch):
            sketch = _sketch(shingles, at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, last - first), pa.array(np.diff(at).astype(np.int64)), pa.array(_identity(shingles, at)), pa.array(sketch, pa.binary())],
                names=["doc_id", "n_shingles", "class", "sketch"],
            )


def signatures(shingles: np.ndarray, at: np.ndarray, upper: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures in each set's own group (``upper`` 0) or the next (1): values, owners; how far each set exceeds H.

    The last array is (cost of all segments) - H; a set reaches the bound if it is over 0.
    """
    low = bands()[0]
    sizes = np.diff(at)
    n = len(sizes)
    most, segments, small = groups()
    group = np.searchsorted(low, np.maximum(sizes, 1), side="right") - 1 + upper
    m = segments[group].astype(U64)
    owner = np.repeat(np.arange(n), sizes)
    if not len(shingles):
        return np.zeros(0, U64), owner, -most[group]
    if seed:  # another cut of the range
        shingles = K.mix(shingles ^ K.mix(np.array([seed], U64)))
        order = np.lexsort((shingles, owner))
        shingles = shingles[order]
    segment = (shingles >> U64(32)) * m[owner] >> U64(32)
    new = np.ones(len(shingles), dtype=bool)
    new[1:] = (segment[1:] != segment[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(shingles)))
    value = K.mix(shingles + U64(0x516))
    content = np.add.reduceat(value, start)
    of = owner[start]
    salt = K.mix(segment[start] * U64(0x9E3779B97F4A7C15) + group[of].astype(U64) * U64(0x1000001) + U64(seed))
    cost = np.where(small[group[of]] & (length > 1), 2, 1)
    slack = np.bincount(of, weights=cost, minlength=n).astype(np.int64) - most[group]
    out, owners = K.mix(content + salt), of
    piece = np.repeat(np.arange(len(start)), length)
    cut = small[group[owner]] & (length[piece] > 1)
    if cut.any():
        less = K.mix(content[piece[cut]] - value[cut] + salt[piece[cut]])
        out, owners = np.concatenate([out, less]), np.concatenate([owners, owner[cut]])
    return out, owners, slack


def _all_signatures(shingles: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """Values, owners, 0 or 1 for the own group or the next, and what each set has to spare at its last seed."""
    for upper in (0, 1):
        todo = np.flatnonzero(np.diff(at) > 0)
        part, ends = shingles, at
        for seed in range(SEEDS):
            value, owner, slack = signatures(part, ends, upper, seed)
            own = todo if seed else np.arange(len(at) - 1)
            spare = np.full(len(at) - 1, np.iinfo(np.int64).min)
            spare[own] = slack
            yield value, own[owner], upper, spare
            short = np.flatnonzero((slack <= 0) & (np.diff(ends) > 0))
            if not len(short):
                break
            todo = own[short]
            take = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in short])
            ends = np.concatenate([[0], np.cumsum(np.diff(ends)[short])])
            part = part[take]


def _packed(names: np.ndarray, slack: np.ndarray, value: np.ndarray, owner: np.ndarray, upper: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """One blob for each partition: names and slacks of the sets in it, then signatures as gaps and references.

    Only 40 bits of a signature beside its partition are kept: chance meetings cost a candidate and
    no result. Sorted, their gaps take four bytes each (eight where one gap needs more).
    """
    part = (value % U64(parts)).astype(np.int64)
    short = value >> U64(24)
    order = np.lexsort((short, part))
    short, ref, part = short[order], (owner[order] << 1 | upper[order]), part[order]
    edge = np.searchsorted(part, np.arange(parts + 1))
    seen = np.zeros(len(names), dtype=np.int64)
    for p in np.flatnonzero(np.diff(edge)):
        v, r = short[edge[p] : edge[p + 1]], ref[edge[p] : edge[p + 1]]
        seen[:] = 0
        seen[r >> 1] = 1
        docs = np.flatnonzero(seen)
        index = (np.cumsum(seen) - 1)[r >> 1]
        gaps = np.diff(v, prepend=U64(0))
        kind = np.uint32 if gaps.max() < 1 << 32 else np.uint64
        head = np.array([len(docs), len(v), kind().itemsize], dtype=np.uint32).tobytes()
        yield int(p), b"".join([head, names[docs].tobytes(), slack[docs].tobytes(), gaps.astype(kind).tobytes(), (index << 1 | (r & 1)).astype(np.uint16).tobytes()])


def _values(blob: bytes) -> np.ndarray:
    """The signatures of a blob."""
    docs, n, width = np.frombuffer(blob, np.uint32, 3).tolist()
    at = 12 + 12 * docs
    return np.cumsum(np.frombuffer(blob[at : at + width * n], np.uint32 if width == 4 else np.uint64), dtype=U64)


def _members(blob: bytes, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the chosen signatures: names, 0 or 1 for the own group or the next, slack there."""
    docs, n, width = np.frombuffer(blob, np.uint32, 3).tolist()
    names = np.frombuffer(blob[12 : 12 + 8 * docs], np.int64)
    slack = np.frombuffer(blob, np.int16, 2 * docs, 12 + 8 * docs).reshape(-1, 2)
    ref = np.frombuffer(blob, np.uint16, n, 12 + 12 * docs + width * n)[keep]
    upper = (ref & 1).astype(np.int8)
    return names[ref >> 1], upper, slack[ref >> 1, upper]


def index(parts: int):
    """Texts to packed signature lists, by partition of the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[np.ndarray] = []
        slacks: list[np.ndarray] = []
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        docs = sigs = 0

        def flush() -> pa.RecordBatch:
            value, owner, upper = (np.concatenate(x) for x in zip(*held, strict=True))
            blobs = list(_packed(np.concatenate(names), np.concatenate(slacks), value, owner, upper, parts))
            names.clear(), slacks.clear(), held.clear()
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in blobs], pa.int32()), pa.array([x for _, x in blobs], pa.binary())], names=["part", "blob"])

        for batch in batches:
            for _, _, shingles, at in _sets(batch):
                whole = _identity(shingles, at)
                # Copies within a chunk sign once.
                _, one = np.unique(whole, return_index=True)
                one = np.sort(one[np.diff(at)[one] > 0])
                for i in range(0, len(one), FLUSH_DOCS):
                    some = one[i : i + FLUSH_DOCS]
                    take = np.concatenate([np.arange(at[k], at[k + 1]) for k in some])
                    ends = np.concatenate([[0], np.cumsum(np.diff(at)[some])])
                    if docs + len(some) > FLUSH_DOCS:
                        yield flush()
                        docs = sigs = 0
                    most = np.full((len(some), 2), np.iinfo(np.int64).min)
                    for value, owner, upper, slack in _all_signatures(shingles[take], ends):
                        held.append((value, owner + docs, np.full(len(value), upper, np.int64)))
                        most[:, upper] = np.maximum(most[:, upper], slack)
                        sigs += len(value)
                    names.append(whole[some])
                    slacks.append(np.clip(most, -32768, 32767).astype(np.int16))
                    docs += len(some)
                    if sigs > FLUSH_SIGS:
                        yield flush()
                        docs = sigs = 0
        if held:
            yield flush()

    return run


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one partition's signatures: candidate pairs (sig null), and hot signatures' members (b null)."""
    held = [x.as_py() for batch in batches for x in batch.column(1)]
    if not held:
        return
    # Most signatures stand alone; only the others get names.
    every = np.concatenate([_values(x) for x in held])
    every.sort()
    again = np.unique(every[1:][every[1:] == every[:-1]])
    del every
    got = []
    for i, blob in enumerate(held):
        own = _values(blob)
        keep = np.flatnonzero(again[np.minimum(np.searchsorted(again, own), len(again) - 1)] == own) if len(again) else np.zeros(0, np.int64)
        got.append((own[keep], *_members(blob, keep)))
        held[i] = b""
    value, name, upper, slack = (np.concatenate(x) for x in zip(*got, strict=True))
    del got, held
    order = np.lexsort((name, value))
    value, name, upper, slack = value[order], name[order], upper[order], slack[order]
    if not len(value):
        return
    first = np.ones(len(value), dtype=bool)
    first[1:] = (value[1:] != value[:-1]) | (name[1:] != name[:-1])
    value, name, upper, slack = value[first], name[first], upper[first], slack[first]
    run = np.concatenate([[0], np.flatnonzero(value[1:] != value[:-1]) + 1, [len(value)]])
    size = np.repeat(np.diff(run), np.diff(run))
    start = np.repeat(run[:-1], np.diff(run))
    here = np.arange(len(value))
    pairs = []
    for step in range(1, SMALL):
        i = here[: len(here) - step]
        i = i[(size[i] <= SMALL) & (start[i] == start[np.minimum(i + step, len(value) - 1)])]
        pairs.append(np.stack([name[i], name[i + step]], axis=1))
    hot = here[size > SMALL]
    spoke = hot[hot != start[hot]]
    pairs.append(np.stack([name[start[spoke]], name[spoke]], axis=1))
    pairs = np.unique(np.concatenate(pairs), axis=0)
    for i in range(0, len(pairs), 1 << 16):
        part = pairs[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1]), pa.nulls(len(part), pa.int64()), pa.nulls(len(part), pa.int8()), pa.nulls(len(part), pa.int16())], names=["a", "b", "sig", "upper", "slack"])
    for i in range(0, len(hot), 1 << 16):
        part = hot[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(name[part]), pa.nulls(len(part), pa.int64()), pa.array(value[part].astype(np.int64)), pa.array(upper[part]), pa.array(slack[part])], names=["a", "b", "sig", "upper", "slack"])


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs a, b that link, by the whole texts beside them."""
    for batch in batches:
        for i in range(0, len(batch), 256):
            part = batch.slice(i, 256)
            left, right = ([own[at[k] : at[k + 1]] for _, _, own, at in _sets(part, c) for k in range(len(at) - 1)] for c in (2, 3))
            shared = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right, strict=True)]
            fits = [DEN * n >= NUM * (len(x) + len(y) - n) for n, x, y in zip(shared, left, right, strict=True)]
            yield part.select([0, 1]).filter(pa.array(fits, pa.bool_()))


def own_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows class, text whose text has the class (an id may have other texts, too)."""
    for batch in batches:
        for first, last, shingles, at in _sets(batch):
            part = batch.slice(first, last - first)
            yield part.filter(pa.array(_identity(shingles, at) == part.column(0).to_numpy()))


def near_by_sketch(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """False only where the sketches prove that the sets can't link."""
    apart = np.bitwise_count(left ^ right).sum(axis=-1, dtype=np.int64)
    return apart * (DEN + NUM) <= (n_left + n_right) * (DEN - NUM)


def _share_key(lists: pa.ChunkedArray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Whether the lists of rows ``u`` and ``v`` have a key in common; keys are taken some thousand at a time."""
    lists = lists.combine_chunks()
    owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    keys, index, times = np.unique(pc.list_flatten(lists).to_numpy(), return_inverse=True, return_counts=True)
    common = np.cumsum(times > 1) - 1
    both = times[index] > 1
    owner, index = owner[both], common[index[both]]
    out = np.zeros(len(u), dtype=bool)
    for k in range(0, int((times > 1).sum()), 4096):
        here = (index >= k) & (index < k + 4096)
        has = np.zeros((len(lists), 4096), dtype=bool)
        has[owner[here], index[here] - k] = True
        bits = np.packbits(has, axis=1).view(U64)
        for i in range(0, len(u), 1 << 14):
            out[i : i + (1 << 14)] |= (bits[u[i : i + (1 << 14)]] & bits[v[i : i + (1 << 14)]]).any(axis=1)
    return out


def blocks(table: pa.Table) -> pa.Table:
    """Pairs of different components within a pair of blocks that the sketches don't rule out.

    A pair that shares several signatures is given by the smallest of them only: ``keys`` are each
    member's signatures below this one.
    """
    held = table["sketch"].to_pylist()
    sketch = _folded(held, min(map(len, held)))
    name, size, comp, block = (table[c].to_numpy() for c in ("class", "n_shingles", "component", "block"))
    one, two = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, (1 << 20) // max(1, len(two) * sketch.shape[1]))
    for k in range(0, len(one), step):
        i = one[k : k + step]
        row, col = np.nonzero(comp[i][:, None] != comp[two][None])
        row, col = i[row], two[col]
        row, col = np.minimum(row, col), np.maximum(row, col)
        fits = near_by_sketch(sketch[row], sketch[col], size[row], size[col])
        rows.append(row[fits])
        cols.append(col[fits])
    # Within one block each pair came up twice.
    pair = np.unique(np.concatenate(rows) * len(name) + np.concatenate(cols))
    row, col = pair // len(name), pair % len(name)
    once = ~_share_key(table["keys"], row, col)
    x, y = name[row[once]], name[col[once]]
    return pa.table({"a": pa.array(np.minimum(x, y)), "b": pa.array(np.maximum(x, y))})


def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs a, b whose sketches allow a link; sketches are compared by width, a few megabytes at a time."""
    for batch in batches:
        left, right = batch.column("s_a").to_pylist(), batch.column("s_b").to_pylist()
        sizes = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
        width = np.array([min(len(x), len(y)) for x, y in zip(left, right, strict=True)], dtype=np.int64)
        fits = np.zeros(len(batch), dtype=bool)
        for w in np.unique(width).tolist():
            own = np.flatnonzero(width == w)
            step = max(1, (1 << 22) // w)
            for i in range(0, len(own), step):
                at = own[i : i + step]
                fits[at] = near_by_sketch(_folded([left[k] for k in at], w), _folded([right[k] for k in at], w), sizes[0][at], sizes[1][at])
        yield batch.select(["a", "b"]).filter(pa.array(fits))


def _not_ruled_out(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose sizes and sketches allow a link."""
    side = lambda x, *more: classes.select(F.col("class").alias(x), *[F.col(c).alias(f"{c[0]}_{x}") for c in more])
    # |x & y| is at most the smaller size, |x | y| at least the larger one.
    sized = pairs.join(side("a", "n_shingles", "sketch"), "a").join(side("b", "n_shingles", "sketch"), "b")
    sized = sized.filter(DEN * F.least("n_a", "n_b") >= NUM * F.greatest("n_a", "n_b"))
    return sized.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(near, "a long, b long")


def _texts(pairs: DataFrame, texts: DataFrame, classes: DataFrame) -> DataFrame:
    """class, text of every class in ``pairs``. Ids go out whole only if counted to be few, else both sides are dealt by id."""
    needed = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    chosen = needed.join(classes, "class").select("doc_id", "class").checkpoint()
    chosen = F.broadcast(chosen) if chosen.count() <= FEW_IDS else chosen.hint("merge")
    return texts.join(chosen, texts["doc_id"].eqNullSafe(chosen["doc_id"])).select("class", "text").mapInArrow(own_class, "class long, text string").dropDuplicates(["class"]).checkpoint()


def _verified(pairs: DataFrame, known: DataFrame) -> DataFrame:
    side = lambda x: known.select(F.col("class").alias(x), F.col("text").alias(f"t_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "t_a", "t_b").mapInArrow(linked, "a long, b long")


def _links(pairs: DataFrame, texts: DataFrame, classes: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """``components`` after the links among ``pairs``.

    First one pair of each set is verified, that with its smallest partner; then only pairs that
    are not yet in one component. Other pairs can't change the components.
    """
    if components is not None and pairs.isEmpty():
        return components
    known = _texts(pairs, texts, classes)
    forest = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").checkpoint()
    components = merged(components, _verified(forest, known))
    of = lambda x: components.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    rest = pairs.join(forest, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
    rest = rest.filter(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")
    return merged(components, _verified(rest, known))


def _looked_up(rows: DataFrame, table: DataFrame, key: str, spread: str) -> DataFrame:
    """``rows`` with ``__told``, what ``table`` (``key``, ``n``: rows that have it, and more) says of their key, or null.

    A table counted to be small is broadcast. Of a larger one the keys of ``HOT`` rows and more, which
    are at most a ``HOT``-th of the rows, are broadcast; rows of other keys are dealt by key, and hot
    ones by ``spread``.
    """
    told = F.struct(*[c for c in table.columns if c not in (key, "n")])
    if table.count() <= FEW_IDS:
        return rows.join(F.broadcast(table.select(F.col(key).alias("__key"), told.alias("__told"))), F.col(key) == F.col("__key"), "left").drop("__key")
    hot = table.filter(F.col("n") >= HOT).select(F.col(key).alias("__key"), told.alias("__hot"))
    cool = table.filter(F.col("n") < HOT).select(F.col(key).alias("__key"), F.lit(False).alias("__side"), told.alias("__cool"))
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("__key"), "left").drop("__key")
    is_hot = F.col("__hot").isNotNull()
    out = out.withColumns({"__key": F.when(is_hot, F.xxhash64(spread)).otherwise(F.col(key)), "__side": is_hot})
    out = out.join(cool.hint("merge"), ["__key", "__side"], "left")
    return out.select(*rows.columns, F.coalesce("__hot", "__cool").alias("__told"))


def _named(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Of every row ``doc_id, n_shingles, class``; of classes with several rows or a link ``class, n, component_id, first_class``."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    described = texts.mapInArrow(describe, "doc_id long, n_shingles long, class long, sketch binary").checkpoint()
    classes = described.filter("class != 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n_shingles"), F.min("sketch").alias("sketch"), F.count("*").alias("n")).checkpoint()
    met = texts.mapInArrow(index(parts), "part int, blob binary").repartition(parts, "part").mapInArrow(meet, "a long, b long, sig long, upper byte, slack short").checkpoint()
    pairs = met.filter("b is not null").select("a", "b").distinct()
    groups_ = _links(_not_ruled_out(pairs, classes).checkpoint(), texts, classes)
    hot = met.filter("sig is not null").select("sig", F.col("a").alias("class"), "upper", "slack")
    groups_ = _hub_links(hot, groups_, classes, texts)
    groups_ = _unsure_links(hot, groups_, classes, texts)
    several = classes.select("class", "doc_id", "n").join(groups_.withColumnRenamed("node", "class"), "class", "left")
    several = several.filter("component IS NOT NULL OR n > 1").withColumn("component", F.coalesce("component", "class")).checkpoint()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "class"))
    smallest = several.groupBy("component").agg(first.alias("first"), F.count("*").alias("n"))
    smallest = smallest.select("component", "n", F.col("first.doc_id").alias("component_id"), F.col("first.class").alias("first_class")).checkpoint()
    named = _looked_up(several.select("class", F.col("n").alias("rows"), "component"), smallest, "component", "class")
    return described.drop("sketch"), named.select("class", F.col("rows").alias("n"), "__told.component_id", "__told.first_class").checkpoint()


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document.

    Words are what white space separates, A-Z lower-cased; a document's set has its distinct
    shingles of five words (one of fewer words has its whole sequence as one shingle). Documents
    with 100 |x & y| >= 75 |x | y| link; ``component_id`` is the smallest ``doc_id`` reachable.

    Null and empty texts have no shingles, link with nothing and are their own component. Equal
    sets form one class, so copies are joined once, not in pairs. A ``doc_id`` on several rows
    stands for several texts, each with its own links, and returns one row for each row. An empty
    table gives no rows; other columns of ``docs`` are ignored. Rows without a ``doc_id`` return
    as they are, with a null component unless they link with one that has an id.
    """
    described, named = _named(docs, doc_id, text)
    out = _looked_up(described, named.drop("first_class"), "class", "doc_id")
    return out.select("doc_id", "n_shingles", F.coalesce("__told.component_id", "doc_id").alias("component_id"))


def first_of_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row with the smallest id.

    Rows without an id come last, and then the set with the smallest hash. Rows with the same id and
    the same set stay once; rows that share an id and no set are judged each by its text. Texts
    without words all stay. An empty table gives no rows; the columns stay as they are.

    Only ids are joined: those whose rows all go, and those on several rows, whose texts are looked
    at again. Whole rows move only where the counted ids are too many to send out.
    """
    described, named = _named(docs, doc_id, text)

    def stays(own: Column, id_: Column) -> Column:
        told = F.col("__told")
        return told.isNull() | (told["first_class"] == own) & id_.eqNullSafe(told["component_id"])

    judged = _looked_up(described, named, "class", "doc_id").select("doc_id", stays(F.col("class"), F.col("doc_id")).alias("stays"))
    ids = judged.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or("stays").alias("open"))
    ids = ids.filter("n > 1 OR NOT open").withColumnRenamed("doc_id", "__id").checkpoint()
    row_id = F.col(doc_id).cast("long")
    told = _looked_up(docs.withColumn("__id", row_id), ids, "__id", text)
    sure = told.filter("__id IS NOT NULL AND __told IS NULL").select(docs.columns)
    unsure = told.filter("__id IS NULL OR __told.open").select(docs.columns)
    kinds = StructType([*docs.schema.fields, StructField("__class", LongType())])
    at = docs.columns.index(text)

    def with_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, shingles, ends in _sets(batch, at):
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_identity(shingles, ends))], names=kinds.names)

    again = _looked_up(unsure.mapInArrow(with_class, kinds), named.withColumnRenamed("class", "__class"), "__class", text)
    again = again.filter(stays(F.col("__class"), row_id)).drop("__told")
    once = again.filter("__class <> 0").dropDuplicates([doc_id, "__class"])
    return sure.unionByName(once.drop("__class")).unionByName(again.filter("__class = 0").drop("__class"))


def _hub_links(hot: DataFrame, components: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """``components`` after the links of each hot signature's members with the one that has most hot signatures.

    Near copies of one text may link with it and not with each other; it shares most with the
    others. A pair for each member and signature at most, and none within a component.
    """
    shared = hot.groupBy("class").agg(F.count("*").alias("n"))
    placed = hot.select("sig", "class").distinct().join(shared, "class").join(components.withColumnRenamed("node", "class"), "class", "left")
    placed = placed.select("sig", "class", "n", F.coalesce("component", "class").alias("component")).checkpoint()
    hubs = placed.groupBy("sig").agg(F.max(F.struct("n", "class", "component")).alias("hub"))
    pairs = placed.join(hubs, "sig").filter(F.col("component") != F.col("hub.component"))
    pairs = pairs.select(F.least("class", "hub.class").alias("a"), F.greatest("class", "hub.class").alias("b")).distinct()
    return _links(_not_ruled_out(pairs, classes).checkpoint(), texts, classes, components)


def _unsure_links(hot: DataFrame, components: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """``components`` after the links between sets that hot signatures leave unsure."""
    hotness = hot.groupBy("sig").agg(F.count("*").alias("n"))
    sized = hot.join(hotness, "sig").join(classes.select("class", "n_shingles"), "class")
    # A partner shares signatures worth the slack. If both drop less than that, the hottest first,
    # the coolest one that they share stays with both. In small groups one may be worth 2.
    worth = F.when(F.col("n_shingles") <= SMALL_GROUP, 2).otherwise(1)
    order = W.partitionBy("class", "upper").orderBy(F.col("n").desc(), "sig")
    needed = sized.withColumn("dropped", F.row_number().over(order) * worth).filter("dropped >= slack")
    rest = needed.join(components.withColumnRenamed("node", "class"), "class", "left")
    rest = rest.select("sig", "class", F.coalesce("component", "class").alias("component")).distinct().checkpoint()
    mixed = rest.groupBy("sig").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    mixed = mixed.select("sig", F.ceil(F.col("n") / BLOCK).cast("int").alias("n_blocks")).checkpoint()
    if mixed.isEmpty():
        return components
    chosen = rest.join(mixed, "sig").groupBy("class", "component").agg(F.array_sort(F.collect_set(F.struct("sig", "n_blocks"))).alias("sigs"))
    dealt = chosen.join(classes.select("class", "n_shingles", "sketch"), "class").withColumn("one", F.explode("sigs"))
    keys = F.transform(F.filter("sigs", lambda s: s["sig"] < F.col("one.sig")), lambda s: s["sig"])
    dealt = dealt.select("one.sig", "one.n_blocks", "class", "n_shingles", "sketch", "component", keys.alias("keys"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("class"), "n_blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    dealt = dealt.select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "class", "n_shingles", "sketch", "component", F.col("own").alias("block"), "keys")
    found = dealt.groupBy("sig", "i", "j").applyInArrow(blocks, "a long, b long").distinct().checkpoint()
    return _links(found, texts, classes, components)
