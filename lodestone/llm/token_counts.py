"""Operator 10: unigram token counts by a Viterbi pass that keeps only scores and counts.

Counts are those of a unigram model. The files at hand hold no unigram vocabulary: of
``piece_bpe_32k.model`` the pieces and scores are read as one, so the query's counts are the best
segmentation under these scores and not what that file's own merge rules give.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHED, LONGEST = 1 << 24, 64  #: characters of segments that a worker keeps, and of one of them


class Unigram:
    """Best segmentation under piece scores: for each text the number of tokens and the score.

    Rules of the tokenizer: a space becomes U+2581 and one is put before the text; among paths of
    one score the piece that starts first wins; a character that is no piece costs the lowest score
    less 10 and becomes its UTF-8 bytes if the vocabulary has those, else neighbours form one token.
    """

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.bytes = byte_fallback
        # Paths meet wherever no piece goes across: before a space mark after another character, and at line ends.
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", p) or "\n" in p for p, _ in pieces)
        self.cache: dict[str, complex] = {}
        self.held = 0

    def best(self, text: str) -> tuple[int, float]:
        """Tokens and score of one segment, as it stands."""
        n = len(text)
        score, count, ending = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        at = 0
        found: list[tuple[int, float]] = []
        matches = self.automaton.iter(text)
        upcoming = next(matches, None)
        single, unknown = self.single, self.unknown
        for at in range(1, n + 1):
            found.clear()
            while upcoming is not None and upcoming[0] == at - 1:
                found.append(upcoming[1])
                upcoming = next(matches, None)
            top, tokens, odd = None, 0, False
            for length, own in found if len(found) < 2 else sorted(found, reverse=True):
                total = score[at - length] + own
                if top is None or total > top:
                    top, tokens = total, count[at - length] + 1
            if text[at - 1] not in single:
                total = score[at - 1] + unknown
                if top is None or total > top:
                    add = len(text[at - 1].encode("utf-8", "surrogatepass")) if self.bytes else int(not ending[at - 1])
                    top, tokens, odd = total, count[at - 1] + add, True
            score[at], count[at], ending[at] = top, tokens, odd
        return count[n], score[n]

    def _segment(self, text: str) -> complex:
        """Tokens and score as one number, so that both add at once."""
        known = self.cache.get(text)
        if known is None:
            known = complex(*self.best(text))
            if len(text) <= LONGEST:
                if self.held >= CACHED:
                    self.cache.clear()
                    self.held = 0
                self.cache[text] = known
                self.held += len(text) + LONGEST
        return known

    def count(self, text: str | None) -> tuple[int, float]:
        """Tokens and score of a whole text; none for a null or empty one."""
        if not text:
            return 0, 0.0
        marked = SPACE + text.replace(" ", SPACE)
        if not self.cuts or not self.bytes:
            return self.best(marked)
        total = 0j
        get, cache = self._segment, self.cache
        for i, line in enumerate(marked.split("\n")):
            if i:
                total += complex(1, self.unknown)
            if not line:
                continue
            if SPACE + SPACE in line or line[-1] == SPACE:
                parts = re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", line)
            else:
                parts = line.split(SPACE)
                parts = [SPACE + x for x in parts[1:]] + ([parts[0]] if parts[0] else [])
            for x in parts:
                total += cache[x] if x in cache else get(x)
        return int(total.real), total.imag


def load(path: str) -> tuple[list[tuple[str, float]], bool]:
    """Normal and user-defined pieces of a sentencepiece file with their scores; whether it has byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = range(model.get_piece_size())
    plain = [i for i in size if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [(model.id_to_piece(i), model.get_score(i)) for i in plain], any(model.is_byte(i) for i in size)


_models: dict[str, Unigram] = {}


def model(name: str, vocabulary: tuple[list[tuple[str, float]], bool]) -> Unigram:
    """The worker's model, built once and kept with its cache."""
    if name not in _models:
        _models[name] = Unigram(*vocabulary)
    return _models[name]


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, score`` of every row, over whole texts.

    The pieces and scores of ``vocabulary`` are read as a unigram vocabulary, by the driver alone;
    it goes out whole (a vocabulary is some ten thousand pieces). Null and empty texts have no
    tokens; equal texts have equal counts; of paths with one score the tokenizer's wins. An empty
    table gives no rows; extra columns are ignored. A long text without spaces is one segment, in
    time and memory proportional to its length.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(load(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram = model(vocabulary, held.value)
        for batch in batches:
            found = [unigram.count(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "n_tokens", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, score double")
