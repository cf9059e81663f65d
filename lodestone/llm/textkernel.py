"""Vectorised word hashing over Arrow string batches, shared by the array operators.

A batch is cut into chunks of whole texts of about ``CHUNK`` bytes, so memory follows the
chunk (or one text, if that is longer) and never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U64 = np.uint64
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)


def byte_table(seed: int, lower: bool) -> np.ndarray:
    """A random 64-bit value for each byte; upper-case ASCII takes the lower-case one if ``lower``."""
    table = np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, 256, dtype=U64) | U64(1)
    if lower:
        table[65:91] = table[97:123]
    return table


def class_mask(ranges: list[tuple[int, int]]) -> np.ndarray:
    """True for each byte of the given inclusive ranges."""
    mask = np.zeros(256, dtype=bool)
    for low, high in ranges:
        mask[low : high + 1] = True
    return mask


#: `[\x20\x09-\x0D]`, what separates words.
SPACE = class_mask([(0x20, 0x20), (0x09, 0x0D)])
#: Everything but `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` of lower-cased text: upper-case letters count as word characters.
NOT_ALNUM = class_mask([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])

_powers = {"up": np.ones(1, dtype=U64), "down": np.ones(1, dtype=U64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd constant and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for key, base in (("up", _P), ("down", _P_INV)):
            table = np.ones(1, dtype=U64)
            while len(table) < size:
                table = np.concatenate([table, table * U64(pow(base, len(table), 1 << 64))])
            _powers[key] = table
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets into them) of each chunk; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1
        last = min(n, max(last, first + 1))
        own = offsets[first : last + 1]
        yield first, last, data[own[0] : own[-1]], own - own[0]
        first = last


def words(buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of each text's first word (one more entry than texts)."""
    inside = ~separators[buf]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < len(buf)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes (after the table's case folding) and length."""
    up, down = _power_tables(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, dtype=U64)
    np.cumsum(table[buf] * up[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of ``width`` words from each position on, without regard to where texts end."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out *= U64(0xD6E8FEB86659FD93)
        out += hashes[k : k + n]
    return mix(out + U64(width))


def shingle_sets(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of every text, and each text's first one.

    A text with fewer words than ``width``, but not none, has its whole sequence as one shingle.
    """
    counts = np.diff(first)
    sizes = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    at = np.concatenate([[0], np.cumsum(sizes)])
    full = windows(hashes, width)
    texts = np.repeat(np.arange(len(counts)), sizes)
    position = np.arange(at[-1]) - at[:-1][texts] + first[:-1][texts]
    out = np.zeros(at[-1], dtype=U64)
    long = counts[texts] >= width
    out[long] = full[position[long]]
    for t in np.flatnonzero((counts > 0) & (counts < width)):
        out[at[t]] = windows(hashes[first[t] : first[t + 1]], int(counts[t]))[0]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = out[1:] != out[:-1]
    keep[at[:-1][sizes > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], kept[at]
