"""Document quality by Bradley-Terry pairwise ranking.

A document's worth is a linear function of features of its whole text. It is
learned from preference pairs (a good document, a bad one) by logistic loss on
feature differences; a quantile of the labelled documents' scores is the
threshold, and the reported score is 0.5 there.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces, runtime

#: Labelled rows to learn from (a hash of their ids picks about so many) and preference pairs drawn from them.
MAX_LABELLED, MAX_PAIRS = 20_000, 200_000
FEATURES = (
    "log_words", "word_length", "upper", "digits", "bars", "bangs", "symbols", "stops", "commas", "lines", "other_punctuation", "non_ascii",
    "byte_entropy", "distinct_words", "herdan", "top_word", "echoed_words", "short_words", "long_words", "repeated_lines",
)
_SYMBOLS = list(b"#$%&*^~@=+<>{}[]\\/_`")
_OTHER = list(b"\"'()-:;?")


def text_features(text: str | None) -> list[float]:
    """The ``FEATURES`` of a whole text; all zero for null, empty and blank ones."""
    data = text.encode() if text else b""
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, hist = len(words), np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = hist / hist.sum()
    own = Counter(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in data.split(b"\n") if x]
    seen = share[share > 0]
    upper, letters = int(hist[65:91].sum()), int(hist[65:91].sum() + hist[97:123].sum() + hist[128:].sum())
    ratio = lambda x, of: float(np.log1p(100 * x / of))
    return [
        float(np.log1p(n)), float(np.log1p(sizes.mean())), ratio(upper, max(letters, 1)), ratio(hist[48:58].sum(), len(data)), ratio(hist[124], n), ratio(hist[33], n),
        ratio(hist[_SYMBOLS].sum(), n), ratio(hist[46], n), ratio(hist[44], n), ratio(hist[10], n), ratio(hist[_OTHER].sum(), n), ratio(hist[128:].sum(), len(data)),
        float(-(seen * np.log(seen)).sum()), len(own) / n, float(np.log1p(len(own)) / np.log1p(n)), ratio(max(own.values()), n),
        ratio(sum(map(operator.eq, words, words[1:])), n), ratio((sizes <= 3).sum(), n), ratio((sizes > 20).sum(), n), ratio(len(lines) - len(set(lines)), max(len(lines), 1)),
    ]


@dataclass(frozen=True)
class Ranking:
    """Worth = ((x - mean) / scale) @ weights; score = logistic(worth - threshold)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        worth = ((x - self.mean) / self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip(worth - self.threshold, -50, 50)))


def fit_ranking(x: np.ndarray, good: np.ndarray, pairs: int = MAX_PAIRS, ridge: float = 1e-3, seed: int = 3) -> Ranking:
    """Learn from rows ``x`` with marks ``good``. Without both kinds every score is 0.5.

    All pairs are used where there are at most ``pairs``, else as many drawn
    ones. Newton steps minimise the mean logistic loss of the worth differences.
    The threshold is the quantile of the rows' worths that tells the marks best.
    """
    width = x.shape[1] if x.ndim == 2 else len(FEATURES)
    above, below = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(above) or not len(below):
        return Ranking(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-12, scale, 1.0)
    z = (x - mean) / scale
    if len(above) * len(below) <= pairs:
        i, j = np.repeat(above, len(below)), np.tile(below, len(above))
    else:
        draw = np.random.Generator(np.random.Philox(seed))
        i, j = above[draw.integers(0, len(above), pairs)], below[draw.integers(0, len(below), pairs)]
    d, w = z[i] - z[j], np.zeros(width)
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -50, 50)))  # chance given to the wrong order
        gradient = -(d * p[:, None]).mean(0) + ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(width)
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    worth = z @ w
    cuts = np.quantile(worth, np.linspace(0.005, 0.995, 199))
    right = [((worth >= c) == good).mean() for c in cuts]
    best = np.flatnonzero(np.isclose(right, max(right)))
    return Ranking(mean, scale, w, float(cuts[best[len(best) // 2]]))


def _features(texts: pa.Array) -> np.ndarray:
    return np.array([text_features(t.as_py()) for t in texts], np.float64).reshape(-1, len(FEATURES))


def _fold(c: str, folds: int) -> F.Column:
    return F.crc32(F.col(c).cast("string")) % folds


def learn_quality(
    docs: DataFrame, labels: DataFrame, fold: int | None = 1, folds: int = 3, max_labelled: int = MAX_LABELLED,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> Ranking:
    """Learn from labelled documents whose ``crc32(id as text) mod folds`` is not ``fold``.

    All of them up to ``max_labelled``, beyond it about so many, drawn by a hash
    of the id; these alone, with their features, come to the driver.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter("id IS NOT NULL AND label IS NOT NULL")
    if fold is not None:
        known = known.filter(_fold("id", folds) != fold)
    n = known.count()
    if n > max_labelled:
        known = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * max_labelled / n))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = pa.array(np.arange(batch.num_rows + 1) * len(FEATURES), pa.int32())
            x = pa.ListArray.from_arrays(offsets, pa.array(_features(batch.column(1)).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x, batch.column(2)], names=["id", "x", "label"])

    kind = rows.schema["id"].dataType.simpleString()
    sample = rows.select("id", "text", F.col("label").cast("int")).mapInArrow(pieces.tidy(run), f"id {kind}, x array<double>, label int").toArrow()
    sample = sample.take(pa.array(sorted(range(sample.num_rows), key=list(zip(sample["id"].to_pylist(), sample["label"].to_pylist(), sample["x"].to_pylist(), strict=True)).__getitem__), pa.int64()))
    x = np.array(sample.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    return fit_ranking(x, sample.column("label").to_numpy() == 1)


def score_quality(
    docs: DataFrame, labels: DataFrame, fold: int = 1, folds: int = 3, max_labelled: int = MAX_LABELLED,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``score`` and ``predicted``.

    Learns as ``learn_quality`` does. Only the whole text makes the score, which is
    0 to 1; ``predicted`` is 1 from 0.5 on.

    Null, empty and blank texts have all features zero and get their score.
    Null ids are never learned from and count as not held out; null labels are
    ignored; rows that repeat an id are scored alike. Without documents
    labelled 0 and 1 to learn from, every score is 0.5. Empty tables are
    no error; further columns are ignored, whatever their names.
    """
    runtime.prepare(docs.sparkSession)
    model = learn_quality(docs, labels, fold, folds, max_labelled, id_col, text_col, label_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_features(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["id", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(pieces.tidy(run), f"id {rows.schema[0].dataType.simpleString()}, score double, predicted int")
    return scored.select(F.col("id").alias(id_col), F.coalesce(_fold("id", folds) == fold, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, text_col: str = "text", **learning) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``, with all their columns, in one pass and without a shuffle.

    Nulls, empty texts, repeated rows and empty tables: as ``score_quality``.
    """
    runtime.prepare(docs.sparkSession)
    model, place = learn_quality(docs, labels, text_col=text_col, **learning), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(_features(batch.column(place))) >= least))

    return docs.mapInArrow(pieces.tidy(run), docs.schema)
