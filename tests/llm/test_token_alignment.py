"""Alignment of two tokenizers against a walk over tokens, by both ways of looking counts up."""

import hashlib
import os
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import byte_bpe
from lodestone.llm import token_alignment as alignment

from .test_operators import PROSE, frame

public_tokenizers = pytest.importorskip("public_tokenizers")
FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
pytestmark = pytest.mark.skipif(not os.path.exists(FIRST), reason="needs the vocabulary files")
TEXTS = [None, "", " ", "a", "▁ is no space", "<|endoftext|> <s> text", "naïve Žluťoučký kůň 漢字 🙂\n\ttabs", "x" * 5000, "\x00\x7f", PROSE, PROSE, PROSE.upper(), "İstanbul ﬁ ½", "  two  blanks  ", "é"]


def walk(texts):
    """Expected rows by a walk that steps from end to end; bytes come from the libraries' own decoders' rules."""
    import sentencepiece
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(FIRST), sentencepiece.SentencePieceProcessor(model_file=SECOND)
    first.encode_special_tokens = True
    out, documents = [], Counter()
    for text in texts:
        raw = (" " + (text or "")).encode()
        a, b = first.encode(raw.decode(), add_special_tokens=False).ids, second.encode(text or "")
        size_a = [len(byte_bpe.byte_level(first.id_to_token(i))) for i in a]
        piece = [bytes.fromhex(second.id_to_piece(i)[3:5]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or first.decode(a, skip_special_tokens=False).encode() != raw or b"".join(piece) != raw:
            out.append(None)
            continue
        links, groups, i, j, end_a, end_b, start = [], [], 0, 0, size_a[0], len(piece[0]), (0, 0)
        while True:
            links.append((a[i], b[j]))
            step_a, step_b = end_a <= end_b, end_b <= end_a
            i, j = i + step_a, j + step_b
            if step_a and step_b:
                groups.append((a[start[0] : i], b[start[1] : j]))
                start = (i, j)
            if i == len(a):
                break
            end_a += size_a[i] * step_a
            end_b += len(piece[j]) * step_b if j < len(b) else 0
        out.append((len(a), len(b), groups, links))
        documents.update(set(links))
    best = Counter()
    for (x, _), n in documents.items():
        best[x] = max(best[x], n)
    rows = []
    for x in out:
        if x is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        written = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in x[2])
        rows.append((x[0], x[1], len(x[2]), len(x[3]), sum(documents[y] == best[y[0]] for y in x[3]), sum(documents[y] for y in x[3]), hashlib.sha256(written.encode()).hexdigest()))
    return rows


@pytest.mark.parametrize("few", [alignment.FEW, 0])
def test_against_a_walk(spark, few):
    docs = frame(spark, [(i, t, None) for i, t in enumerate(TEXTS)] + [(3, "a", None)])
    found = alignment.align_tokens(docs, FIRST, SECOND, few=few)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    rows = sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in found.collect())
    wanted = walk([*TEXTS, "a"])
    assert rows == sorted((i, *w) for i, w in zip([*range(len(TEXTS)), 3], wanted, strict=True))
    zeros = {r[0] for r in rows if not r[1]}
    assert {0, 1, 4} <= zeros and not {3, 5, 7, 9} & zeros


@pytest.mark.parametrize("few", [alignment.FEW, 0])
def test_nothing(spark, few):
    assert alignment.align_tokens(frame(spark, []), FIRST, SECOND, few=few).count() == 0
    none = alignment.align_tokens(frame(spark, [(1, None, None)]), FIRST, SECOND, few=few).first()
    assert (none.n_a, none.n_best, none.count_sum, none.groups_sha256) == (0, 0, 0, "")


def test_intervals_by_hand():
    """Tokens of 2, 3 and 1 bytes beside 3, 2 and 1: four intervals, groups of two and two, and of one and one."""
    of_a, of_b, closes, group_a, group_b = alignment.aligned(np.zeros(3), np.zeros(3), np.array([2, 5, 6]), np.array([3, 5, 6]))
    assert (of_a.tolist(), of_b.tolist(), closes.tolist()) == ([0, 1, 1, 2], [0, 0, 1, 2], [False, False, True, True])
    assert (group_a.tolist(), group_b.tolist()) == ([0, 0, 1], [0, 0, 1])


def test_byte_level_entries():
    assert byte_bpe.byte_level("Ġa") == b" a" and byte_bpe.byte_level("Ċ") == b"\n" and byte_bpe.byte_level("Ã©") == "é".encode()


def test_ids_are_those_of_the_library(spark):
    """Texts of all kinds by the quick way, and the way back to the library where special tokens count."""
    from tokenizers import Tokenizer

    with open(FIRST, encoding="utf-8") as file:
        config = file.read()
    model, library = byte_bpe.ByteBPE(config), Tokenizer.from_file(FIRST)
    assert model.quick is not None
    texts = [x or "" for x in TEXTS] + [" " * 3000, "\n\t " * 500, "1" * 3000, "'S's 'LL\u2019s", "a\u0301\u200d\u00a0b\x85c\x1cd", "漢" * 2000]
    if os.path.isdir("/root/testdata/sf0.001"):
        texts += [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for special in (True, False):
        library.encode_special_tokens = not special
        assert model.encode(texts, special) == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    changed = config.replace('"add_prefix_space":false', '"add_prefix_space":true').replace('"add_prefix_space": false', '"add_prefix_space": true')
    assert changed != config and byte_bpe.ByteBPE(changed).quick is None
    assert byte_bpe.ByteBPE(changed).encode(["word"], False) == [Tokenizer.from_str(changed).encode("word", add_special_tokens=False).ids]


def test_parts_that_are_not_kept(spark, monkeypatch):
    """A cache that is full, and parts too long for it, change nothing."""
    docs = frame(spark, [(i, t, None) for i, t in enumerate([*TEXTS, *TEXTS])])
    wanted = sorted(map(tuple, alignment.align_tokens(docs, FIRST, SECOND).collect()))
    sides = alignment.Sides("own", open(FIRST, encoding="utf-8").read(), open(SECOND, "rb").read())  # noqa: SIM115
    assert sides.parted
    texts = [x or "" for x in TEXTS]
    whole = sides.encode(texts)
    monkeypatch.setattr(alignment, "CACHED", 3)
    assert sides.encode([*texts, "some new words"])[:-1] == whole and "some" not in sides.known[0]
    sides.parted = False
    assert sides.encode(texts) == whole
    assert wanted == sorted(map(tuple, alignment.align_tokens(docs.repartition(5), FIRST, SECOND).collect()))
