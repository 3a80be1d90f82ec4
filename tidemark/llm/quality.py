"""Quality classifier: a generalised additive model with pairwise interactions (operator 7).

Cyclic boosting of shallow trees learns a lookup table for each feature and then for the strongest pairs of
features; a text's score is the logistic of the sum of its bins' entries, taken with array indexing.

Fit on at most SAMPLE_ROWS labelled rows (a documented bound; chosen by a hash of the id). Every text is scored
whole. Neither labels, lang, source nor the id enter a score.

Defined cases: null text counts as empty, and empty texts get the score of their bins; labels that are null are
not learnt from; with no labelled row, or one class only, every score is the smoothed share of label 1; an empty
table gives an empty result; very long texts are measured whole; values on a bin's edge are in the upper bin, and of
trees that gain the same the one that cuts first is taken; repeated rows get the same score, and each that is labelled
is learnt from; extra columns are ignored by ``score`` and kept by ``keep``.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import crc_mod, quoted, raw_texts, steps

SAMPLE_ROWS = 12_000
THRESHOLD = 0.3
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 60, 30, 0.15

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123)) + bytes(range(128, 256))
_DIGIT = b"0123456789"
_PLAIN = b".,;:'\"()-?"
_SPACE = b" \t\n\r\x0b\x0c"
_ODD = bytes(x for x in range(33, 127) if x not in _UPPER + _LOWER + _DIGIT + _PLAIN)
_ODD_END = re.compile(rb"[^\x00-\x20\w\x80-\xff.,;:'\"()?-](?=[\x00-\x20]|$)")
NAMES = ("words", "word_bytes", "upper", "digit", "plain", "odd", "odd_ends", "space", "unique_words", "unique_lines", "line_words", "short_words", "long_words", "pipes", "stops", "words_begin_upper")


def features(text: bytes) -> list[float]:
    """The features of one text, from its UTF-8 bytes."""
    words = text.split()
    n, size = len(words), max(1, len(text))
    if not n:
        return [0.0] * len(NAMES)
    lines = [x for x in text.splitlines() if x.strip()]
    share = lambda chars: (len(text) - len(text.translate(None, chars))) / size
    spaces = share(_SPACE)
    odd = share(_ODD)
    lengths = list(map(len, words))
    return [
        math.log1p(n), sum(lengths) / n, share(_UPPER), share(_DIGIT), share(_PLAIN), odd,
        len(_ODD_END.findall(text)) / n if odd else 0.0, spaces, len(set(words)) / n, len(set(lines)) / len(lines), n / len(lines),
        sum(x <= 3 for x in lengths) / n, sum(x >= 13 for x in lengths) / n, text.count(b"|") / n, text.count(b".") / n, sum(x[0] in _UPPER for x in words) / n,
    ]


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Values by bin of a shallow tree, grown best split first over ordered bins."""
    g, h = np.concatenate([[0.0], np.cumsum(grad)]), np.concatenate([[0.0], np.cumsum(hess)])
    parts = [(0, len(grad))]
    fit = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)
    while len(parts) < leaves:
        best = (1e-9, None, 0)
        for k, (a, b) in enumerate(parts):
            if b - a > 1:
                cuts = np.arange(a + 1, b)
                gain = (g[cuts] - g[a]) ** 2 / (h[cuts] - h[a] + 1.0) + (g[b] - g[cuts]) ** 2 / (h[b] - h[cuts] + 1.0) - fit(a, b)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (float(gain[i]), k, int(cuts[i]))
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(grad))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


def _plane(grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    """Values on a grid of bins of a tree that splits once by rows and then each part once by columns."""
    best, out = -1.0, np.zeros(grad.shape)
    for flip in (False, True):
        gg, hh = (grad.T, hess.T) if flip else (grad, hess)
        for cut in range(1, gg.shape[0]):
            value, gain = np.zeros(gg.shape), 0.0
            for rows in (slice(0, cut), slice(cut, None)):
                x, y = gg[rows].sum(0), hh[rows].sum(0)
                tree = _tree(x, y, 2)
                value[rows] = tree
                gain += float(np.sum(tree * x - tree * tree * (y + 0.5) / 2))
            if gain > best:
                best, out = gain, value.T if flip else value
    return out


class AdditiveModel:
    """Lookup tables by feature and by pair of features."""

    def __init__(self, bias: float) -> None:
        self.bias, self.cuts, self.tables, self.coarse, self.pairs = bias, [], [], [], []

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        p = (y.sum() + 1.0) / (len(y) + 2.0)
        model = cls(float(np.log(p / (1 - p))))
        if len(y) == 0 or y.min() == y.max():
            return model
        width = x.shape[1]
        model.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
        model.coarse = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for j in range(width)]
        model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
        fine = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.cuts)]
        wide = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.coarse)]
        raw = np.full(len(y), model.bias)

        def slopes() -> tuple[np.ndarray, np.ndarray]:
            q = 1 / (1 + np.exp(-raw))
            return y - q, q * (1 - q)

        for _ in range(ROUNDS):
            for j in range(width):
                grad, hess = slopes()
                n = len(model.tables[j])
                step = RATE * _tree(np.bincount(fine[j], grad, n), np.bincount(fine[j], hess, n))
                model.tables[j] += step
                raw += step[fine[j]]
        grad, hess = slopes()
        ranked = []
        for a in range(width):
            for b in range(a + 1, width):
                shape = (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)
                cell = wide[a] * shape[1] + wide[b]
                gg, hh = (np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (grad, hess))
                plane = _plane(gg, hh)
                ranked.append((float(np.sum(plane * gg)), a, b, shape, cell))
        for _, a, b, shape, cell in sorted(ranked, key=lambda r: -r[0])[:PAIRS]:
            model.pairs.append((a, b, np.zeros(shape), cell))
        for _ in range(PAIR_ROUNDS):
            for a, b, values, cell in model.pairs:
                grad, hess = slopes()
                step = RATE * _plane(*(np.bincount(cell, v, values.size).reshape(values.shape) for v in (grad, hess)))
                values += step
                raw += step.ravel()[cell]
        model.pairs = [(a, b, values) for a, b, values, _ in model.pairs]
        return model

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.bias)
        for j, (cuts, values) in enumerate(zip(self.cuts, self.tables)):
            raw += values[np.searchsorted(cuts, x[:, j], side="right")]
        for a, b, values in self.pairs:
            raw += values[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(raw, -500, 500)))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array([features(t) for t in raw_texts(column)], dtype=float).reshape(-1, len(NAMES))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, held_out_mod: int, held_out_rest: int, id_col: str, text_col: str, most: int) -> DataFrame:
    """At most `most` labelled texts outside the held-out part: text, y. The broadcast side has that many ids at most."""
    ids = labels.select(quoted(id_col).cast("long").alias("i"), quoted(label).cast("int").alias("y")).where("i IS NOT NULL AND y IN (0, 1)")
    ids = ids.where(crc_mod(F.col("i"), held_out_mod) != held_out_rest).orderBy(F.xxhash64("i"), "i", "y").limit(most)
    texts = docs.select(quoted(id_col).cast("long").alias("i"), quoted(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(ids), "i").select("text", "y")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> AdditiveModel:
    rows = training_rows(docs, labels, "quality", 5, 0, id_col, text_col, sample_rows)

    def measured(batches):
        for batch in batches:
            for step in steps([batch], "text"):
                yield pa.RecordBatch.from_arrays([pa.array(_matrix(step.column("text")).tolist(), pa.list_(pa.float64())), step.column("y")], ["x", "y"])

    got = sorted(tuple(r) for r in rows.mapInArrow(measured, "x array<double>, y int").collect())
    x = np.array([r[0] for r in got], dtype=float).reshape(-1, len(NAMES))
    return AdditiveModel.fit(x, np.array([r[1] for r in got], dtype=float))


def score(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, predicted of every row."""

    def scored(batches):
        for batch in batches:
            for step in steps([batch], "text"):
                p = model.score(_matrix(step.column("text")))
                yield pa.RecordBatch.from_arrays([step.column("i"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["i", "score", "predicted"])

    rows = docs.select(quoted(id_col).cast("long").alias("i"), quoted(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scored, "i long, score double, predicted int").withColumnRenamed("i", id_col)


def keep(docs: DataFrame, model: AdditiveModel, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model accepts, with all their columns."""

    def accepted(batches):
        for batch in batches:
            for step in steps([batch], "text"):
                good = model.score(_matrix(step.column("text"))) >= THRESHOLD
                yield pa.RecordBatch.from_arrays([step.filter(pa.array(good)).column("row")], ["row"])

    rows = docs.select(quoted(text_col).cast("string").alias("text"), F.struct(*[quoted(c) for c in docs.columns]).alias("row"))
    return rows.mapInArrow(accepted, T.StructType([rows.schema["row"]])).select("row.*")
