"""Ids of a byte-level BPE file of the tokenizers library, without the parts of its encodings that nobody asked for.

A file whose settings are the plain ones (its bytes' own order of merges, no normalising) has the same
ids by tiktoken, which is several times faster as it keeps no offsets and no token strings. Any other
file, and a text with a special token in it that is to count as one, goes through the tokenizers library.
"""

from __future__ import annotations

import json

#: Fixed value: how byte-level tokenizers part a text before merging.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_level(entry: str) -> bytes:
    """Bytes of a byte-level entry: printable Latin-1 characters stand for themselves, the others by code from U+0100 on."""
    if not hasattr(byte_level, "of"):
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [x for x in range(256) if x not in set(own)]
        byte_level.of = {chr(x): bytes([x]) for x in own} | {chr(0x100 + i): bytes([x]) for i, x in enumerate(rest)}
    return b"".join(byte_level.of.get(c, c.encode()) for c in entry)


class ByteBPE:
    """Encodes texts; ``size`` is one more than the largest id, ``bytes_of`` the bytes of each id."""

    def __init__(self, config: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(config)
        self.size = max(self.whole.get_vocab().values()) + 1
        entries = (self.whole.id_to_token(i) for i in range(self.size))
        self.bytes_of = [byte_level(x) if x is not None else b"" for x in entries]
        settings = json.loads(config)
        self.special = [x["content"] for x in settings["added_tokens"]]
        self.quick = self._quick(settings)

    def _quick(self, settings: dict):
        """The same vocabulary as ranks, if ids follow the order of merges and nothing else changes a text."""
        model, parted = settings["model"], settings["pre_tokenizer"] or {}
        own = {i for i in range(self.size) if len(self.bytes_of[i]) == 1}
        merged = ["".join(x) if isinstance(x, list) else x.replace(" ", "") for x in model["merges"]]
        added = {x["id"] for x in settings["added_tokens"]}
        plain = (
            model["type"] == "BPE"
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and settings["normalizer"] is None
            and settings["post_processor"] is None
            and parted.get("type") == "ByteLevel"
            and not parted["add_prefix_space"]
            and parted["use_regex"]
            and own == set(range(256))
            and [model["vocab"][x] for x in merged] == list(range(256, 256 + len(merged)))
            and added <= set(range(256 + len(merged), self.size))
        )
        if not plain:
            return None
        import tiktoken

        return tiktoken.Encoding("own", pat_str=PARTS, mergeable_ranks={x: i for i, x in enumerate(self.bytes_of) if i not in added}, special_tokens={})

    def _by_library(self, texts: list[str], special: bool) -> list[list[int]]:
        self.whole.encode_special_tokens = not special
        return [x.ids for x in self.whole.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str], special: bool) -> list[list[int]]:
        """Ids of each text; ``special`` tells whether strings of special tokens in it count as those or as plain text."""
        if self.quick is None:
            return self._by_library(texts, special)
        odd = lambda x: special and any(s in x for s in self.special)
        return [self._by_library([x], special)[0] if odd(x) else self.quick.encode_ordinary(x) for x in texts]


_models: dict[str, ByteBPE] = {}


def encoder(name: str, config: str) -> ByteBPE:
    """The worker's tokenizer, built once."""
    if name not in _models:
        _models[name] = ByteBPE(config)
    return _models[name]
