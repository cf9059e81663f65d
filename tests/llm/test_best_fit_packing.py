"""Packing: whole round trips of ids, every constraint, the choice of a sequence by brute force, edge cases."""

import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lodestone.llm import best_fit_packing as packing

from .test_operators import PROSE, frame

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="needs the vocabulary file")


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(TOKENIZER)
    return lambda text: [*model.encode(text or "", add_special_tokens=False).ids, packing.END]


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(12)
    texts = [None, "", "<|endoftext|> is a token", "x" * 9000, " " * 300, PROSE * 40, "né" * 5000, *[" ".join(pick.choices(PROSE.split(), k=pick.randrange(1, 90))) for _ in range(150)], *["same text"] * 60]
    return [(i, t, "a") for i, t in enumerate(texts)] + [(8, "a repeated id", None), (8, "a repeated id", None)]


def held_to_contract(found, rows, encode, size):
    """Every id of every document is in one piece, every sequence is gapless and within its size."""
    whole = sorted(tuple(encode(t)) for _, t, _ in rows)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        assert len(r.ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    back = []
    for i, own in pieces.items():
        lengths = sorted((r.piece, r.start, r.length, tuple(r.ids)) for r in own)
        if len({x[0] for x in lengths}) == len(lengths):
            assert all(n == size for _, _, n, _ in lengths[1:]) and [x[0] for x in lengths] == list(range(len(lengths)))
            assert [x[1] for x in lengths] == [sum(n for _, _, n, _ in lengths[:k]) for k in range(len(lengths))]
            back.append(sum((x[3] for x in lengths), ()))
        else:
            back += [x[3] for x in lengths]
    assert sorted(back) == whole
    return sequences


@pytest.mark.parametrize("bucket", [8, 1 << 14])
def test_round_trip(spark, rows, encode, bucket):
    found = packing.pack_documents(frame(spark, rows), TOKENIZER, 128, bucket=bucket, keep_ids=True).collect()
    sequences = held_to_contract(found, rows, encode, 128)
    least = -(-sum(len(encode(t)) for _, t, _ in rows) // 128)
    assert len(sequences) <= least + (1 if bucket > 8 else 20)  # buckets of eight pieces leave open ends


def test_every_capacity_holds(spark, rows, encode):
    found = packing.pack_documents(frame(spark, rows), TOKENIZER, 256, most_pieces=3, attention=256 * 256, bucket=50, keep_ids=True).collect()
    sequences = held_to_contract(found, rows, encode, 256)
    assert max(map(len, sequences.values())) == 3
    with pytest.raises(ValueError):
        packing.pack_documents(frame(spark, rows), TOKENIZER, 256, attention=100)


def brute_best_fit(demands, capacities, weights, select):
    order = sorted(range(len(demands)), key=lambda i: -sum(w * d / c for w, d, c in zip(weights, demands[i], capacities, strict=True)))
    left, bins = [], {}
    for i in order:
        d = demands[i]
        open_ = [b for b in range(len(left)) if all(x >= y for x, y in zip(left[b], d, strict=True))]
        norm = lambda b: sum(w * ((x - y) / c) ** 2 for w, x, y, c in zip(weights, left[b], d, capacities, strict=True))  # noqa: B023, E731
        dot = lambda b: -sum(w * x * y / c**2 for w, x, y, c in zip(weights, left[b], d, capacities, strict=True))  # noqa: B023, E731
        if not open_:
            left.append(list(capacities))
            open_ = [len(left) - 1]
        best = min(open_, key=norm if select == "norm" else dot)
        left[best] = [x - y for x, y in zip(left[best], d, strict=True)]
        bins[i] = best
    return [bins[i] for i in range(len(demands))]


@pytest.mark.parametrize("select", ["norm", "dot"])
@pytest.mark.parametrize("n", [0, 1, 400, 3000])
def test_best_fit_against_brute_force(select, n):
    """Powers of two keep both sides' scores exact; over a thousand bins make the operator forget closed ones."""
    pick = np.random.default_rng(n)
    length = pick.integers(1, 65, n) if n < 1000 else pick.integers(24, 65, n)
    demands = np.stack([length, np.ones_like(length), length * length], axis=1)
    capacities, weights = np.array([64, 4, 4096]), np.array([1.0, 0.25, 0.5])
    found = packing.best_fit(demands, capacities, weights, select).tolist()
    assert found == brute_best_fit(demands.tolist(), capacities.tolist(), weights.tolist(), select)


def test_pieces_of_a_long_document():
    assert packing.cut(2048, 2048) == [(0, 2048)]
    assert packing.cut(2049, 2048) == [(0, 1), (1, 2048)]
    assert packing.cut(4096, 2048) == [(0, 2048), (2048, 2048)]


def test_nothing(spark):
    assert packing.pack_documents(frame(spark, []), TOKENIZER).count() == 0


def test_sequences(spark, rows, encode):
    packed = packing.pack_documents(frame(spark, rows), TOKENIZER, 128, keep_ids=True)
    found = packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in found) == sum(len(encode(t)) for _, t, _ in rows)
    assert all(len(r.ids) == sum(r.lengths) <= 128 and len(r.doc_ids) == len(r.lengths) for r in found)
