"""Toxicity by maximum-scoring segments of token log-odds (operator 2).

Tokens get the log-odds between toxic and other training texts under an informative Dirichlet prior (the counts
of both together), less a drift that makes the expected score of clean text negative. One linear-time scan
finds all disjoint maximal-scoring segments of a text; extreme-value statistics of local sums turn each into
an E-value; the segments that are significant are the toxic passages. A text's score is a logistic of the
Gumbel-normalised best segment and of the mass of significant segments, calibrated on the training texts.

Learns from at most SAMPLE_ROWS labelled rows (a documented bound). Tokens and stems of fewer than LEAST_TEXTS of them are left
out of the table: they count as unseen ones, by their stem if that is in it, else by the drift. Every text is scanned whole. Labels, lang,
source and the id never enter a score.

Defined cases: null text counts as empty; texts without tokens get the score of a text without segments; null
labels are not learnt from; with one class or no labels all scores are the smoothed share of label 1; an empty
table gives an empty result; very long texts are one scan, in the task that reads them; of stretches with the same sum
the shortest is the segment, so [1, -1, 2] has the segments [1] and [2]; repeated rows get the same score, and each
that is labelled is learnt from; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, quoted, raw_texts, steps
from .quality import training_rows

SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
PRIOR = 50.0  # mass of the prior, in texts
LEAST_TEXTS = 4
DRIFT = 0.05
SIGNIFICANT = 1.0  # E-value of a passage that is reported
STEM = 5

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


def tokens(text: bytes) -> list[str]:
    return _WORD.findall(text.decode("utf-8", "replace").lower())


def max_segments(values: list[float]) -> list[tuple[int, int, float]]:
    """All disjoint maximal-scoring segments (first, end, sum) in linear time: a stack of candidate segments
    with the running sums before and after each; a new segment swallows the candidates it improves on."""
    stack: list[tuple[int, int, float, float]] = []  # first, end, sum before, sum after
    link: list[int] = []  # for each, the nearest earlier one with a smaller sum before; -1: none
    total = 0.0
    for at, value in enumerate(values):
        before, total = total, total + value
        if value <= 0:
            continue
        first, low = at, before
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= low:
                k = link[k]
            if k < 0 or stack[k][3] >= total:
                stack.append((first, at + 1, low, total))
                link.append(k)
                break
            first, low = stack[k][0], stack[k][2]
            del stack[k:], link[k:]
    return [(a, b, after - low) for a, b, low, after in stack]


@dataclass
class ToxicModel:
    scores: dict[str, float] = field(default_factory=dict)
    unseen: float = -DRIFT
    rate: float = 1.0  # lambda of the extreme-value law
    scale: float = 1.0  # its K
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def values(self, words: list[str]) -> list[float]:
        get, unseen = self.scores.get, self.unseen
        return [s if (s := get(w)) is not None else get("^" + w[:STEM], unseen) for w in words]

    def segments(self, words: list[str]) -> list[tuple[int, int, float, float]]:
        """First token, end, sum and E-value of each maximal segment."""
        n = max(1, len(words))
        return [(a, b, s, self.scale * n * math.exp(-min(700.0, self.rate * s))) for a, b, s in max_segments(self.values(words))]

    def summary(self, words: list[str]) -> tuple[float, float, int]:
        """Gumbel-normalised best segment, log mass of the significant ones, and their number."""
        found = self.segments(words)
        n = max(1, len(words))
        best = max((s for _, _, s, _ in found), default=0.0)
        toxic = [s for _, _, s, e in found if e <= SIGNIFICANT]
        return max(-20.0, min(60.0, self.rate * best - math.log(self.scale * n))), math.log1p(sum(toxic)), len(toxic)

    def score(self, words: list[str]) -> tuple[float, int]:
        x, mass, n = self.summary(words)
        a, b, c = self.weights
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, a + b * x + c * mass)))), n


def _rate(values: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Lambda > 0 with expectation of exp(lambda * score) equal to 1, and a first-order K."""
    weights = weights / weights.sum()
    f = lambda x: float(np.sum(weights * np.exp(np.minimum(700, x * values))) - 1)
    low, high = 1e-6, 1.0
    if not (values > 0).any() or f(low) >= 0:
        return 1.0, 1.0
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    slope = float(np.sum(weights * values * np.exp(np.minimum(700, high * values))))
    drift = float(np.sum(weights * values))
    return high, min(1.0, max(1e-4, drift * drift / max(1e-9, slope)))


def _counts(rows: DataFrame) -> tuple[dict[str, list[int]], list[int]]:
    """Texts with each token (and each stem, marked ^), by label; and texts by label. Summed in each task first."""

    def local(batches):
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        texts = [0, 0]

        def out():
            names = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names + [""]), pa.array([seen[0][w] for w in names] + [texts[0]], pa.int64()), pa.array([seen[1][w] for w in names] + [texts[1]], pa.int64())], ["w", "n0", "n1"])

        for batch in batches:
            for step in steps([batch], "text"):
                for text, y in zip(raw_texts(step.column("text")), step.column("y").to_pylist()):
                    words = set(tokens(text))
                    seen[y].update(words | {"^" + w[:STEM] for w in words})
                    texts[y] += 1
                if len(seen[0]) + len(seen[1]) > 500_000:
                    yield from out()
                    seen[0].clear(), seen[1].clear()
                    texts[:] = 0, 0
        yield from out()

    summed = rows.mapInArrow(local, "w string, n0 long, n1 long").groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    got = {r[0]: [r[1], r[2]] for r in summed.where(f"w = '' OR n0 + n1 >= {LEAST_TEXTS}").collect()}
    return got, got.pop("", [0, 0])


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton's method with a small ridge."""
    design, w = np.column_stack([np.ones(len(x)), x]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.diag([1e-3, 0.1, 0.1])
        step = np.linalg.solve(hess, design.T @ (y - p) - np.array([1e-3, 0.1, 0.1]) * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> ToxicModel:
    rows = materialise(training_rows(docs, labels, "toxic", 4, 2, id_col, text_col, sample_rows), "toxic-training")  # read twice
    counts, (n0, n1) = _counts(rows)
    model = ToxicModel()
    share = (n1 + 1) / (n0 + n1 + 2)
    model.weights = (math.log(share / (1 - share)), 0.0, 0.0)
    if not n0 or not n1:
        return model
    names = sorted(counts)
    table = np.array([counts[w] for w in names], dtype=float).reshape(-1, 2)
    prior = PRIOR * table.sum(1) / (n0 + n1)
    side = lambda k, n: np.log((table[:, k] + prior) / np.maximum(1e-9, n + PRIOR - table[:, k] - prior))
    delta = side(1, n1) - side(0, n0)
    z = delta / np.sqrt(1 / (table[:, 1] + prior) + 1 / (table[:, 0] + prior))
    value = np.where(z > 3, delta, np.minimum(delta, 0.0) * (z < -3)) - DRIFT
    stem = np.array([w[0] == "^" for w in names], dtype=bool)
    clean = np.append(table[:, 0] * ~stem, 1.0)
    model.rate, model.scale = _rate(np.append(value, -DRIFT), clean + 1e-9)
    # A stem speaks for the words that the table lacks; only those with a score of their own are kept.
    model.scores = {w: float(v) for w, v, s in zip(names, value, stem) if not s or v > 0}

    def summed(batches):
        for batch in batches:
            for step in steps([batch], "text"):
                got = [model.summary(tokens(t)) for t in raw_texts(step.column("text"))]
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64()), step.column("y")], ["x", "mass", "y"])

    got = np.array(sorted(tuple(r) for r in rows.mapInArrow(summed, "x double, mass double, y int").collect()), dtype=float).reshape(-1, 3)
    model.weights = _calibrate(got[:, :2], got[:, 2])
    return model


def score(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, predicted and the number of significant passages of every row."""

    def scored(batches):
        for batch in batches:
            for step in steps([batch], "text"):
                got = [model.score(tokens(t)) for t in raw_texts(step.column("text"))]
                yield pa.RecordBatch.from_arrays([step.column("i"), pa.array([g[0] for g in got], pa.float64()), pa.array([int(g[0] >= THRESHOLD) for g in got], pa.int32()), pa.array([g[1] for g in got], pa.int32())], ["i", "score", "predicted", "n_passages"])

    rows = docs.select(quoted(id_col).cast("long").alias("i"), quoted(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scored, "i long, score double, predicted int, n_passages int").withColumnRenamed("i", id_col)


def passages(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every significant passage: id, first token, end token, the passage's tokens, its sum and E-value."""

    def found(batches):
        for batch in batches:
            for step in steps([batch], "text"):
                out = []
                for i, text in zip(step.column("i").to_pylist(), raw_texts(step.column("text"))):
                    words = tokens(text)
                    out += [(i, a, b, " ".join(words[a:b]), s, e) for a, b, s, e in model.segments(words) if e <= SIGNIFICANT]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 6, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64()))], ["i", "first", "end", "passage", "segment_score", "e_value"])

    rows = docs.select(quoted(id_col).cast("long").alias("i"), quoted(text_col).cast("string").alias("text"))
    return rows.mapInArrow(found, "i long, first int, end int, passage string, segment_score double, e_value double").withColumnRenamed("i", id_col)
