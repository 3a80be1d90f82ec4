"""Benchmark decontamination: CGK embeddings, bit sampling over item-sized windows, edit verification (operator 1).

Texts are sequences of lower-cased words; edits are counted in words. The CGK random walk copies the word under its cursor
at every step and moves on by one or stays, as a random function of step and word says. Two sequences a few edits apart
fall out of step at an edit and, the walk being random, fall into step again soon after, so edit distance becomes Hamming
distance of what was copied.

1. Windows: an item that may differ in e words is embedded in two windows, its halves (more for long items, so that none is
   longer than about WINDOW words), each walked until the cursor would leave it. Every word of a document starts a walk.
2. Repetitions: each has a walk of its own, of which BITS steps are sampled, the first among the first FIRST steps (one for
   all windows), the others from equal parts of what is left. A place that agrees with a window in all sampled steps of one
   repetition is a candidate; the words between the samples are not compared. Windows of like length form a class, and each
   class takes the fewest repetitions by which RECALL of passages planted with the most edits allowed, of the worst kind
   of edit, become candidates (``repetitions`` measures it with the very index).
3. Anchors, a second source: of e + 1 pieces of an item one holds no edit, so its walk, as long as the piece, agrees in every
   step. They add the passages that sampling has missed; column ``sampled`` tells whether the sampling had found a hit too.
4. Verification: the smallest edit distance between the item and any stretch of text around the candidates, exactly.

Walks of all starts advance together in numpy, and a start is left at the first sampled step at which no window agrees. Words
are told apart by 64-bit hashes.

The items travel with the tasks; their total size is checked against ITEM_BYTES, and beyond it they are written in
blocks of at most about that size, each of which is compared in a pass of its own, whose result is written before the
driver reads the next block.

Defined cases: null texts and items count as empty; an item without words matches nothing; items of fewer than
LEAST_WORDS words must match word for word; very long texts are one step, in which every word starts a walk; ties
between windows go to the first; repeated rows each give their hits; rows and items with null ids are matched and
keep the null; empty tables give an empty result; extra columns are ignored by ``hits`` and kept by ``clean``.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import WordHash, materialise, quoted, raw_texts, shared_path, steps

EDIT_RATE = 0.1  # words that may differ, of an item's words
BITS = 4  # sampled steps of a walk
FIRST = 4  # the first of them is one of so many
WINDOW = 30  # words of a window, about, at most
RECALL, PLANTED, MOST_REPETITIONS = 0.97, 40, 24  # passages planted for each kind of edit
WALK_SEED = 17
LEAST_WORDS = 8
ITEM_BYTES = 16 << 20


def word_hashes(text: bytes, hashes: dict) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def _moves(words: np.ndarray, seed: int) -> np.ndarray:
    """The walk's random function: bit s says whether the cursor moves on at step s (of 64) on this word."""
    with np.errstate(over="ignore"):
        x = (words ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


class Walk:
    """The walks from all places of a text, or of several one after the other and a padding, under one random function."""

    def __init__(self, words: np.ndarray, n: int, seed: int) -> None:
        self.words, self.n, self.move = words, n, _moves(words, seed)
        self.begun: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def begin(self, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Cursors of the first n places at this step, and the signatures of the words under them."""
        if first not in self.begun:
            cursor = np.arange(self.n, dtype=np.int32)
            for s in range(first):
                cursor = self.on(cursor, s)
            self.begun[first] = cursor, Index.mix(np.zeros(self.n, np.uint64), self.words[cursor])
        return self.begun[first]

    def on(self, cursor: np.ndarray, s: int) -> np.ndarray:
        return cursor + (self.move[cursor] >> np.uint64(s & 63) & np.uint64(1)).astype(np.int32)


class Index:
    """Windows (item, offset, words) by the words that the sampled steps of their walks copy."""

    def __init__(self, windows: list[tuple[int, int, np.ndarray]], seed: int, rng: np.random.Generator, first: int | None = None, exact: bool = False) -> None:
        """exact: candidates must agree in all words, and no step is sampled that a cursor could spend beyond a window."""
        self.owner = np.array([(item, offset) for item, offset, _ in windows], np.int64)
        self.exact, self.seed = exact, seed
        lengths = np.array([len(w) for _, _, w in windows])
        self.words = np.zeros((len(windows), 2 * int(lengths.max())), np.uint64)
        for k, (_, _, w) in enumerate(windows):
            self.words[k, : len(w)] = w
        move, rows, at = _moves(self.words, seed), np.arange(len(windows)), np.zeros(len(windows), np.int64)
        copied, self.walk = [], 0
        while self.walk < (lengths.min() if exact else self.words.shape[1]) and (at < lengths).all():
            copied.append(self.words[rows, at])
            at = at + (move[rows, at] >> np.uint64(self.walk & 63) & np.uint64(1)).astype(np.int64)
            self.walk += 1
        self.at = self._sampled(rng, first)
        signature, self.levels = np.zeros(len(windows), np.uint64), []  # by depth, the signatures that windows have
        for s in self.at:
            signature = self.mix(signature, copied[s])
            self.levels.append(self._filter(signature))
        self.order = np.argsort(signature, kind="stable")
        self.signatures = signature[self.order]

    def _sampled(self, rng: np.random.Generator, first: int | None) -> list[int]:
        """Sorted steps of the walk: the first one where it is given, and one from each of equal parts of the rest."""
        start = 0 if first is None else min(first, self.walk - 1) + 1
        edges = np.linspace(start, self.walk, BITS + (first is None)).round().astype(int).tolist()
        some = {min(int(rng.integers(a, max(a + 1, b))), self.walk - 1) for a, b in zip(edges[:-1], edges[1:])}
        return sorted(some if first is None else some | {start - 1})

    @staticmethod
    def mix(signature: np.ndarray, word: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (signature ^ word) * np.uint64(0xC2B2AE3D27D4EB4F)

    @staticmethod
    def _filter(signature: np.ndarray) -> np.ndarray:
        """Bits of signatures that occur: a quick test before the exact one."""
        width = max(16, int(math.log2(max(1, len(signature)))) + 7)
        table = np.zeros(1 << width, bool)
        table[(signature >> np.uint64(64 - width)).astype(np.int64)] = True
        return table

    @staticmethod
    def _passes(signature: np.ndarray, table: np.ndarray) -> np.ndarray:
        return table[(signature >> np.uint64(64 - int(math.log2(len(table))))).astype(np.int64)]

    def candidates(self, walk: Walk) -> tuple[np.ndarray, np.ndarray]:
        """Places and windows that agree in all sampled steps (and, where exact, in all words)."""
        cursor, signature = walk.begin(self.at[0])
        start = np.flatnonzero(self._passes(signature, self.levels[0])).astype(np.int32)
        cursor, signature = cursor[start], signature[start]
        for s in range(self.at[0], self.at[-1]):
            cursor = walk.on(cursor, s)
            if s + 1 in self.at:
                signature = self.mix(signature, walk.words[cursor])
                good = np.flatnonzero(self._passes(signature, self.levels[self.at.index(s + 1)]))
                start, cursor, signature = start[good], cursor[good], signature[good]
        low, high = np.searchsorted(self.signatures, signature, "left"), np.searchsorted(self.signatures, signature, "right")
        many = high - low
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        place, window = np.repeat(start, many).astype(np.int64), self.order[np.repeat(low, many) + within]
        if self.exact:
            same = np.ones(len(place), bool)
            for k in range(self.walk):
                same[same] = walk.words[place[same] + k] == self.words[window[same], k]
            place, window = place[same], window[same]
        return place, window


def best_window(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance in words of the item to any stretch of text, and that stretch (first, end)."""
    place = np.arange(len(text) + 1)
    row, origin = np.zeros(len(text) + 1, np.int64), place
    for i, w in enumerate(item.tolist(), 1):
        new, back = np.empty_like(row), np.empty_like(origin)
        new[0], back[0] = i, 0
        swap = row[:-1] + (text != np.uint64(w))
        drop = row[1:] + 1
        take = swap <= drop
        step, from_ = np.where(take, swap, drop), np.where(take, origin[:-1], origin[1:])
        new[1:], back[1:] = step, from_
        level = new - place  # an insertion costs one a place, so the least level so far is what each place is reached from
        least = np.minimum.accumulate(level)
        row, origin = least + place, back[np.maximum.accumulate(np.where(level == least, place, 0))]
    end = int(np.argmin(row))
    return int(row[end]), int(origin[end]), end


def allowed(words: int) -> int:
    return int(EDIT_RATE * words) if words >= LEAST_WORDS else 0


def _cuts(words: int, parts: int) -> list[tuple[int, int]]:
    """(first, end) of the parts of an item."""
    return [(k * words // parts, (k + 1) * words // parts) for k in range(parts)]


def _anchors(words: int) -> list[tuple[int, int]]:
    """One more part than the edits allowed, so one of them holds no edit."""
    return _cuts(words, allowed(words) + 1)


def _windows(words: int) -> list[tuple[int, int]]:
    """Halves, or more parts for a long item; none where no edit is allowed and the only anchor is the item."""
    return _cuts(words, max(2, -(-words // WINDOW))) if allowed(words) else []


def _class(length: int) -> int:
    """Windows of like length are a class: each reaches up to a quarter further than the one before."""
    return int(math.log(length) / math.log(1.25))


class Candidates:
    """The indexes of the items: their anchors by length, and the repetitions over their windows by class."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], taken: dict[int, int]) -> None:
        """taken: how many repetitions each class of windows takes."""
        anchors: dict[int, list] = {}
        windows: dict[int, list] = {}
        for k, (_, words) in enumerate(items):
            for first, end in _anchors(len(words)) if len(words) else []:
                anchors.setdefault(end - first, []).append((k, first, words[first:end]))
            for first, end in _windows(len(words)):
                windows.setdefault(_class(end - first), []).append((k, first, words[first:end]))
        self.anchors = [Index(group, WALK_SEED, np.random.default_rng(17 + length), exact=True) for length, group in sorted(anchors.items())]
        self.repetitions = []
        for r in range(max([taken[c] for c in windows], default=0)):
            rng = np.random.default_rng([WALK_SEED, r])
            first = int(rng.integers(FIRST))
            self.repetitions.append([Index(group, WALK_SEED + 1 + r, rng, first) for c, group in sorted(windows.items()) if taken[c] > r])
        self.whole = np.array([not _windows(len(words)) for _, words in items], bool)
        self.padding = max([x.walk for x in self.anchors] + [x.walk for some in self.repetitions for x in some], default=0) + 1

    def of(self, codes: np.ndarray, owner_end: np.ndarray) -> np.ndarray:
        """Rows document, item, start (of the item there; before the document where its first words are missing), and
        whether the sampling found it. Without edits the only anchor is the item itself, so that counts as sampled."""
        padded = np.concatenate([codes, np.zeros(self.padding, np.uint64)])
        found = []

        def add(index: Index, walk: Walk, sampled: bool) -> None:
            place, window = index.candidates(walk)
            item, offset = index.owner[window].T
            found.append(np.stack([np.searchsorted(owner_end, place, side="right"), item, place - offset, self.whole[item] | sampled]))

        walk = Walk(padded, len(codes), WALK_SEED)
        for index in self.anchors:
            add(index, walk, False)
        for some in self.repetitions:
            walk = Walk(padded, len(codes), some[0].seed)
            for index in some:
                add(index, walk, True)
        return np.unique(np.concatenate(found, axis=1), axis=1)


def edited(words: list, edits: int, kind: str, rng: np.random.Generator, fresh) -> list:
    """The words with so many edits of a kind; fresh() makes a word that occurs nowhere else."""
    w, n = list(words), len(words)
    if kind == "leading":
        w[:edits] = [fresh() for _ in range(edits)]
    elif kind == "missing":
        w = w[edits:]
    elif kind == "trailing":
        w[n - edits :] = [fresh() for _ in range(edits)]
    elif kind == "clustered":
        a = int(rng.integers(n - edits + 1))
        w[a : a + edits] = [fresh() for _ in range(edits)]
    elif kind == "spread":
        for j in range(edits):
            w[(2 * j + 1) * n // (2 * edits)] = fresh()
    elif kind == "added":
        for _ in range(edits):
            w.insert(int(rng.integers(len(w) + 1)), fresh())
    else:  # mixed
        for _ in range(edits):
            a = int(rng.integers(len(w)))
            w[a : a + int(rng.integers(2))] = [fresh()] if rng.random() < 0.5 else []
    return w


EDITS = ("leading", "missing", "trailing", "clustered", "spread", "added", "mixed")


@functools.lru_cache(maxsize=None)
def repetitions(window_class: int) -> int:
    """The fewest repetitions by which RECALL of planted passages are sampled, for the worst kind of edit: items of two
    windows of this class, each in a text of its own, with the most edits allowed."""
    lengths = [2 * n for n in range(4, 2 * WINDOW + 8) if _class(n) == window_class and allowed(2 * n)]
    if not lengths:
        return MOST_REPETITIONS
    rng, made = np.random.default_rng(window_class), [0]

    def fresh() -> int:
        made[0] += 1
        return int(_moves(np.array([made[0]], np.uint64), 99)[0])

    items, texts = [], []
    for k in range(PLANTED * len(EDITS)):
        words = [fresh() for _ in range(lengths[k // len(EDITS) % len(lengths)])]
        items.append((k, np.array(words, np.uint64)))
        texts.append([fresh() for _ in range(9)] + edited(words, allowed(len(words)), EDITS[k % len(EDITS)], rng, fresh) + [fresh() for _ in range(9)])
    codes, ends = np.concatenate([np.array(t, np.uint64) for t in texts]), np.cumsum([len(t) for t in texts])
    index = Candidates(items, dict.fromkeys(range(_class(4 * WINDOW) + 1), MOST_REPETITIONS))
    padded, found = np.concatenate([codes, np.zeros(index.padding, np.uint64)]), np.zeros(len(items), bool)
    for r, some in enumerate(index.repetitions):
        walk = Walk(padded, len(codes), some[0].seed)
        for x in some:
            place, window = x.candidates(walk)
            item = x.owner[window, 0]
            found[item[np.searchsorted(ends, place, side="right") == item]] = True
        if found.reshape(PLANTED, len(EDITS)).mean(0).min() >= RECALL:
            return r + 1
    return MOST_REPETITIONS


def _taken(items: list[tuple[int | None, bytes]]) -> dict[int, int]:
    """Repetitions of each class of windows that these items have."""
    lengths = {end - first for n in {len(t.split()) for _, t in items} for first, end in _windows(n)}
    return {c: repetitions(c) for c in {_class(n) for n in lengths}}


def _matches(codes: np.ndarray, owner_end: np.ndarray, items: list[tuple[int | None, np.ndarray]], index: Candidates):
    """(document, item, first, end, distance, sampled): the best window per document and item. Places count over all documents."""
    begin = np.concatenate([[0], owner_end[:-1]])
    rows = index.of(codes, owner_end)
    cuts = np.nonzero(np.any(np.diff(rows[:2]), axis=0))[0] + 1
    for group in np.split(rows, cuts, axis=1) if rows.shape[1] else []:
        doc, k = group[:2, 0].tolist()
        item, words = items[k]
        slack = allowed(len(words))
        best = None
        for a, b in _stretches(np.unique(group[2]), len(words), slack, int(begin[doc]), int(owner_end[doc])):
            window = codes[a:b]
            if slack == 0:
                hit = (0, a, b) if np.array_equal(window, words) else None
            elif len(window) + slack < len(words) or len(words) - np.isin(words, window).sum() > slack:  # words that occur nowhere near need an edit each
                continue
            else:
                distance, first, end = best_window(words, window)
                hit = (distance, a + first, a + end) if distance <= slack else None
            if hit and (best is None or hit < best):
                best = hit
            if best and best[0] == 0:
                break
        if best:
            yield doc, item, best[1] - int(begin[doc]), best[2] - int(begin[doc]), best[0], bool(group[3].any())


def _stretches(starts: np.ndarray, words: int, slack: int, low: int, high: int):
    """(first, end) of the windows around sorted starts, within [low, high); with slack, windows that overlap are one."""
    first, end = np.maximum(starts - slack, low), np.minimum(starts + words + slack, high)
    cuts = np.nonzero(first[1:] >= end[:-1])[0] + 1 if slack else np.arange(1, len(starts))
    return zip(first[np.concatenate([[0], cuts])].tolist(), end[np.concatenate([cuts - 1, [len(starts) - 1]])].tolist())


def _blocks(items: DataFrame, id_col: str, text_col: str) -> tuple[int, Iterator[list[tuple[int | None, bytes]]]]:
    """How many blocks, and the items block by block: one pass over the documents compares with one of them. The
    driver holds one block at a time; where there are several, all items are written once, by block."""
    rows = items.select(quoted(id_col).cast("long").alias("i"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = 1 if size <= ITEM_BYTES else math.ceil(2 * size / ITEM_BYTES)  # half full on average, so that none is much above
    if n > 1:
        path = shared_path(items.sparkSession, "benchmark-blocks")
        rows.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(n))).write.partitionBy("block").parquet(path)
        rows = items.sparkSession.read.schema("i long, t string, block long").parquet(path)
    one = lambda k: sorted(((r["i"], r["t"].encode()) for r in (rows.where(F.col("block") == k) if n > 1 else rows).select("i", "t").collect()), key=lambda x: (x[0] is not None, x))
    return n, map(one, range(n))


def _scanner(block: list[tuple[int | None, bytes]]):
    state: list = []
    taken = _taken(block)

    def scan(texts: list[bytes]):
        if not state:
            hashes = WordHash()
            coded = [(i, word_hashes(t, hashes)) for i, t in block]
            state.extend([hashes, coded, Candidates(coded, taken)])
        hashes, coded, index = state
        parts = [word_hashes(t, hashes) for t in texts]
        ends = np.cumsum([len(p) for p in parts])
        if index.anchors and len(ends) and ends[-1]:
            yield from _matches(np.concatenate(parts), ends, coded, index)

    return scan


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row per document and item that it holds: ids, first and end word of the window, edit distance in words, and
    whether the sampled walks had made it a candidate (the anchors have added the others)."""
    rows = docs.select(quoted(id_col).cast("long").alias("i"), quoted(text_col).cast("string").alias("text"))
    out = None
    n, blocks = _blocks(items, item_col, item_text)
    for block in blocks:
        scan = _scanner(block)

        def found(batches, scan=scan):
            for batch in batches:
                for step in steps([batch], "text", 8 << 20):
                    ids = step.column("i").to_pylist()
                    got = [(ids[d], item, a, b, e, sampled) for d, item, a, b, e, sampled in scan(raw_texts(step.column("text")))]
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*got) if got else [[]] * 6, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()))], ["i", "item", "first_word", "end_word", "distance", "sampled"])

        part = rows.mapInArrow(found, "i long, item long, first_word int, end_word int, distance int, sampled boolean")
        part = materialise(part, "benchmark-hits") if n > 1 else part  # and the block can go
        out = part if out is None else out.union(part)
    return out.select(F.col("i").alias(id_col), F.col("item").alias(item_col if item_col != id_col else "item"), "first_word", "end_word", "distance", "sampled")


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    n, blocks = _blocks(items, item_col, item_text)
    for block in blocks:
        rows = docs.select(quoted(text_col).cast("string").alias("text"), F.struct(*[quoted(c) for c in docs.columns]).alias("row"))
        scan = _scanner(block)

        def kept(batches, scan=scan):
            for batch in batches:
                for step in steps([batch], "text", 8 << 20):
                    good = np.ones(step.num_rows, bool)
                    good[[hit[0] for hit in scan(raw_texts(step.column("text")))]] = False
                    yield pa.RecordBatch.from_arrays([step.filter(pa.array(good)).column("row")], ["row"])

        docs = rows.mapInArrow(kept, T.StructType([rows.schema["row"]])).select("row.*")
        docs = materialise(docs, "benchmark-free") if n > 1 else docs
    return docs
