"""Operator 2: quality scores learned from preference pairs (Bradley-Terry).

Of a text count its surface (lengths, marks, repetition) and what it is made of: the shares of its
words and of its runs of three bytes that fall on each of some hundred hashed places.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K

LABELLED = 20_000  #: labelled rows that a model is fitted on, at most
PAIRS = 60_000  #: preference pairs drawn from them, at most
WORDS, RUNS = 128, 256  #: places of words and of runs of three bytes
THRESHOLD, RIDGE, ROUNDS = 0.3, 1e-3, 30
TABLE, LINES = K.byte_table(0x9A11, lower=True), K.class_mask([(0x0A, 0x0A)])
FEATURES = ("log_words", "word_length", "symbols", "bars", "exclamations", "upper", "digits", "stops", "distinct", "repeated", "same_lines", "line_words", "beyond_ascii", "capitalised", "short", "empty")
WIDE = len(FEATURES) + WORDS + RUNS


def _shares(place: np.ndarray, row: np.ndarray, n: int, width: int) -> np.ndarray:
    """Roots of the shares of a text's places."""
    counts = np.bincount(row * width + place, minlength=n * width).reshape(n, width).astype(np.float64)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


def features(column: pa.Array) -> np.ndarray:
    """FEATURES and hashed places of every text, from its whole text; a null or empty one has only ``empty``."""
    out = np.zeros((len(column), WIDE))
    for begin, end, buf, offsets in K.chunks(column):
        n = end - begin
        owner = np.repeat(np.arange(n), np.diff(offsets))
        starts, ends, first = K.words(buf, offsets, K.SPACE)
        words = np.diff(first)
        some = np.maximum(words, 1)
        per = lambda mask: np.bincount(owner[mask], minlength=n) / some  # noqa: B023,E731
        size = np.bincount(owner, minlength=n)
        of = np.repeat(np.arange(n), words)
        hashes = K.word_hashes(buf, starts, ends, TABLE)
        upper, lower = (buf >= 65) & (buf <= 90), (buf >= 97) & (buf <= 122)
        letters = np.maximum(np.bincount(owner[upper | lower], minlength=n), 1)

        def again(values: np.ndarray, row: np.ndarray) -> np.ndarray:
            """How many values a text has had before."""
            order = np.lexsort((values, row))
            v, r = values[order], row[order]
            same = np.zeros(len(v), dtype=bool)
            same[1:] = (v[1:] == v[:-1]) & (r[1:] == r[:-1])
            return np.bincount(r[same], minlength=n)

        wide = K.windows(hashes, 8)
        whole = of[: len(wide)] == of[7 : 7 + len(wide)]
        a, b, line = K.words(buf, offsets, LINES)
        lines = np.diff(line)
        line_of = np.repeat(np.arange(n), lines)
        length = ends - starts
        begins = buf[starts] if len(starts) else np.zeros(0, np.uint8)
        low = np.where(upper, buf + 32, buf).astype(np.uint64)
        runs = K.mix(low[:-2] << np.uint64(16) | low[1:-1] << np.uint64(8) | low[2:]) & np.uint64(RUNS - 1) if len(buf) > 2 else np.zeros(0, np.uint64)
        within = owner[: len(runs)] == owner[2 : 2 + len(runs)]
        out[begin:end, len(FEATURES) : -RUNS] = _shares((hashes & np.uint64(WORDS - 1)).astype(np.int64), of, n, WORDS)
        out[begin:end, -RUNS:] = _shares(runs[within].astype(np.int64), owner[: len(runs)][within], n, RUNS)
        out[begin:end, : len(FEATURES)] = np.stack([
            np.log1p(words), size / some, per(np.isin(buf, np.frombuffer(b"#*$%&<>", np.uint8))), per(buf == 124), per(buf == 33),
            np.bincount(owner[upper], minlength=n) / letters, per((buf >= 48) & (buf <= 57)), per(buf == 46),
            1 - again(hashes, of) / some, again(wide[whole], of[: len(wide)][whole]) / some,
            again(K.word_hashes(buf, a, b, TABLE), line_of) / np.maximum(lines, 1), np.log1p(words / np.maximum(lines, 1)),
            per((buf >= 192)), np.bincount(of[(begins >= 65) & (begins <= 90)], minlength=n) / some, np.bincount(of[length <= 3], minlength=n) / some, words == 0,
        ], axis=1)
    return out


@dataclass
class Ranking:
    """Standardised features, weights, and the scale that puts the score quantile on the threshold."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    quantile: float
    slope: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        surface = z[:, : len(FEATURES)]
        return np.concatenate([z, np.abs(surface), np.minimum(surface * surface, 9)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        shift = np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.raw(x) - self.quantile) + shift, -30, 30)))


def pairs(label: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of preferred texts and of others, drawn as pairs."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    rng = np.random.default_rng(seed)
    n = min(PAIRS, len(good) * len(bad))
    return rng.choice(good, n), rng.choice(bad, n)


def fit(x: np.ndarray, label: np.ndarray, seed: int = 2) -> Ranking:
    """Learn from pairs of a preferred and another text: logistic loss on the difference of features.

    The threshold is the quantile of scores that leaves as many texts below it as are labelled 0;
    the slope is the likeliest one. Without both labels every text gets the threshold's score.
    """
    if not len(x):
        x = np.zeros((1, WIDE))
        label = np.zeros(1)
    model = Ranking(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6), np.zeros(x.shape[1] + 2 * len(FEATURES)), 0.0, 1.0)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return model
    z = model.expand(x)
    left, right = pairs(label, seed)
    n, width = len(left), z.shape[1]
    for _ in range(ROUNDS):  # Newton, some thousand pairs at a time
        gradient, hessian = RIDGE * model.weight, RIDGE * np.eye(width)
        for i in range(0, n, 8192):
            apart = z[left[i : i + 8192]] - z[right[i : i + 8192]]
            p = 1 / (1 + np.exp(np.clip(apart @ model.weight, -30, 30)))
            gradient = gradient - apart.T @ p / n
            hessian = hessian + (apart * (p * (1 - p))[:, None]).T @ apart / n
        step = np.linalg.solve(hessian, gradient)
        model.weight = model.weight - step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ model.weight
    model.quantile = float(np.quantile(raw, len(bad) / len(x)))
    slopes = np.geomspace(0.05, 20, 60)
    shift = np.log(THRESHOLD / (1 - THRESHOLD))
    sure = [np.logaddexp(0, np.where(label == 1, -1, 1) * (s * (raw - model.quantile) + shift)).mean() for s in slopes]
    model.slope = float(slopes[int(np.argmin(sure))])
    return model


def held_out(doc_id: str) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Ranking:
    """Fit on at most LABELLED labelled rows that aren't held out, the first by a hash of the id.

    An id that is labelled both ways is left out; of an id with several texts the one with the
    smallest hash counts. The chosen labels are at most LABELLED rows of two numbers, which is what
    gets broadcast, and their features are what the driver gets.
    """
    own = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).filter(~held_out("doc_id"))
    own = own.groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("other")).filter("label = other")
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED).select("doc_id", "label")
    rows = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(2)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "x"])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("doc_id", "label")]
    seen = rows.mapInArrow(run, f"doc_id {kinds[0]}, label {kinds[1]}, x binary").toPandas().sort_values("doc_id")
    x = np.frombuffer(b"".join(seen["x"]), np.float32).reshape(len(seen), WIDE).astype(np.float64)
    return fit(x, seen["label"].to_numpy())


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Scores come from the text alone. Null and empty texts are scored on having none; equal texts
    get equal scores. Without usable labels every score is the threshold. An empty table gives no
    rows; other columns are ignored.
    """
    model = learn(docs, labels, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.concatenate([np.zeros(0), *(model.score(features(batch.column(1).slice(i, 1024)).astype(np.float32).astype(np.float64)) for i in range(0, len(batch), 1024))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    rows = docs.select("doc_id", "text")
    scored = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
