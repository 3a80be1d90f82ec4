"""Periodic runs of words by Crochemore's partition refinement (operator 11).

A text is a sequence of words. Level L of the refinement has one class for each factor of L words that occurs, with the
places where it starts. Level L + 1 comes from level L by the smaller-half strategy: of the parts into which a class has
split, all but a largest one are taken up, and the places just before theirs are parted from their classes. A place is thus
touched once for each halving of its class, O(n log n) times in all. Each class is a linked list of its places in order;
neighbours q apart at level q are a square of period q, and, as nothing equal lies between them, q is its smallest period.
Places wait in a bucket for the level that equals the gap to their neighbour, so no level searches for squares. Squares at
consecutive places merge into a run, which no neighbouring word extends.

A task refines all texts of a step at once, as one sequence in which equal words of different texts differ, in numpy: work
is by place, whatever the number of texts. Nothing is shuffled.

Defined cases: null and empty texts have no words and no runs; very long texts are one step, whose arrays take some 60
bytes a word; no period beyond a quarter of a text is searched, as none fits four times; of runs with the greatest length
the first counts, and of those at one place the one with the smaller period; repeated rows each give their row; a null id
stays null, and counts as the empty text where the query takes a checksum of it; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import quoted, raw_texts, steps

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
Words = list[bytes]


def _ranges(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers first[i] .. first[i] + many[i] - 1, one range after the other."""
    return np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())


class Partition:
    """Classes of equal factors over a sequence of codes, refined level by level."""

    def __init__(self, codes: np.ndarray, reach: np.ndarray) -> None:
        """reach: for each place the longest period that matters; a place is left alone beyond it."""
        n = self.n = len(codes)
        self.level, self.reach = 1, reach
        self.cls = np.append(codes, codes.max() + 1 if n else 0).astype(np.int64)  # the end has a class of its own
        self.order = np.argsort(self.cls, kind="stable")  # places by class
        self.where = np.empty(n + 1, np.int64)
        self.where[self.order] = np.arange(n + 1)
        self.classes = int(self.cls[-1]) + 1
        self.length = np.zeros(self.classes + n + 2, np.int64)
        self.length[: self.classes] = np.bincount(self.cls)
        self.start = np.zeros(self.classes + n + 2, np.int64)
        self.start[: self.classes] = np.cumsum(self.length[: self.classes]) - self.length[: self.classes]
        self.next, self.prev = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
        same = self.cls[self.order[1:]] == self.cls[self.order[:-1]]
        a, b = self.order[:-1][same], self.order[1:][same]
        self.next[a], self.prev[b] = b, a
        self.mark = np.zeros(n + 2, bool)  # the last is for the place -1
        self.small = np.arange(1, n + 1)
        self.waiting: dict[int, list[np.ndarray]] = {}
        self._wait(a, b - a)

    def _wait(self, place: np.ndarray, gap: np.ndarray) -> None:
        """Places whose neighbour is now so far away wait for the level of that number."""
        good = (gap >= self.level) & (gap <= self.reach[place])
        place, gap = place[good], gap[good]
        if not len(place):
            return
        by = np.argsort(gap, kind="stable")
        place, gap = place[by], gap[by]
        cuts = np.flatnonzero(np.diff(gap)) + 1
        for g, part in zip(gap[np.concatenate([[0], cuts])].tolist(), np.split(place, cuts)):
            self.waiting.setdefault(g, []).append(part)

    def squares(self, q: int) -> np.ndarray:
        """Places of squares of period q in order, at level q or at a later one if no class has split since."""
        place = np.concatenate(self.waiting.pop(q, [np.zeros(0, np.int64)]))
        return np.sort(place[self.next[place] == place + q])

    def refine(self) -> None:
        """To the next level."""
        touched = self.small - 1
        touched = touched[(self.length[self.cls[touched]] > 1) & (self.reach[touched] > self.level)]
        self.level += 1
        self.small = touched[:0]
        if not len(touched):
            return
        touched = np.sort(touched)
        key = self.cls[touched] * (self.classes + 1) + self.cls[touched + 1]
        by = np.argsort(key, kind="stable")
        touched, key = touched[by], key[by]
        first = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])  # of each group: one class, one class after it
        size = np.diff(np.append(first, len(key)))
        owner = self.cls[touched[first]]
        head = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])  # first group of each class
        groups = np.diff(np.append(head, len(owner)))
        old = owner[head]
        left = self.length[old] - np.add.reduceat(size, head)
        parted = np.repeat((groups + (left > 0)) > 1, groups)
        of = np.repeat(np.arange(len(head)), groups)
        rank = np.lexsort((-size, of))
        largest = np.zeros(len(owner), bool)
        largest[rank[head]] = True  # of each class the first of its largest groups
        stays = largest & (np.repeat(left, groups) == 0)  # keeps the class, where no other place does
        moves = parted & ~stays
        if not moves.any():
            return
        quiet = largest & (size >= np.repeat(left, groups))  # the largest part of its class
        member = np.repeat(moves, size)
        moved, many = touched[member], size[moves]
        self._take_out(moved, old, np.add.reduceat(np.where(moves, size, 0), head))
        fresh = np.arange(self.classes, self.classes + len(many))
        self.classes += len(many)
        at = self.where[moved]
        self.start[fresh] = at[np.cumsum(many) - many]
        self.length[fresh] = many
        self.cls[moved] = np.repeat(fresh, many)
        self._link(moved, many)
        loud = [moved[np.repeat(~quiet[moves], many)]]
        rest = np.add.reduceat(quiet, head).astype(bool) & (left > 0) & parted[head]  # what is left is the smaller part
        if rest.any():
            loud.append(self.order[_ranges(self.start[old[rest]], left[rest])])
        self.small = np.concatenate(loud)
        self.small = self.small[self.small > 0]

    def _take_out(self, moved: np.ndarray, old: np.ndarray, many: np.ndarray) -> None:
        """Puts the moved places (in the order of their old classes, so many of each) at the ends of their classes'
        segments, and takes them out of the lists."""
        old, many = old[many > 0], many[many > 0]
        end = self.start[old] + self.length[old]
        zone = _ranges(end - many, many)
        self.mark[moved] = True
        outside = self.where[moved]
        outside = outside[outside < np.repeat(end - many, many)]
        inside = self.order[zone]
        inside = inside[~self.mark[inside]]
        self.order[outside], self.where[inside] = inside, outside
        self.order[zone], self.where[moved] = moved, zone
        self.length[old] -= many
        before, after = self.prev[moved], self.next[moved]
        heads, tails = moved[~self.mark[before]], moved[~self.mark[after]]  # of stretches that leave a list together
        self.mark[moved] = False
        heads = heads[np.lexsort((heads, self.cls[heads]))]
        tails = tails[np.lexsort((tails, self.cls[tails]))]
        before, after = self.prev[heads], self.next[tails]
        some, more = before >= 0, after >= 0
        self.next[before[some]] = after[some]
        self.prev[after[more]] = before[more]
        both = some & more
        self._wait(before[both], after[both] - before[both])

    def _link(self, moved: np.ndarray, many: np.ndarray) -> None:
        """The lists of new classes: their members in order, so many of each."""
        was = self.next[moved]
        new = np.append(moved[1:], -1)
        ends = np.cumsum(many) - 1
        new[ends] = -1
        back = np.concatenate([[-1], moved[:-1]])
        back[ends - many + 1] = -1
        self.next[moved], self.prev[moved] = new, back
        changed = (new != was) & (new >= 0)
        self._wait(moved[changed], new[changed] - moved[changed])


def find(codes: np.ndarray, reach: np.ndarray, least: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """Rows (start, length, period) of all runs with at least `exponent` periods and `least` words, by start and period."""
    part, out = Partition(codes, reach), []

    def merge(q: int) -> None:
        place = part.squares(q)
        if not len(place):
            return
        cuts = np.flatnonzero(np.diff(place) != 1) + 1
        first = place[np.concatenate([[0], cuts])]
        length = np.diff(np.concatenate([[0], cuts, [len(place)]])) - 1 + 2 * q
        good = length >= max(least, exponent * q)
        if good.any():
            out.append(np.stack([first[good], length[good], np.full(good.sum(), q)], axis=1))

    while len(part.small):
        if part.level in part.waiting:
            merge(part.level)
        part.refine()
    for q in sorted(q for q in part.waiting if q >= part.level):
        merge(q)
    if not out:
        return np.zeros((0, 3), np.int64)
    rows = np.concatenate(out)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = self.base + len(self)
        return n


def runs_of(texts: list[Words], least: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> list[np.ndarray]:
    """The runs of each text: rows (start, length, period). Words of different texts have different codes."""
    counts = np.array([len(t) for t in texts], np.int64)
    codes, base = [], 0
    for text in texts:
        names = _Codes()
        names.base = base
        codes.append(np.fromiter(map(names.__getitem__, text), np.int64, len(text)))
        base += len(names)
    reach = np.append(np.repeat(np.where(counts >= least, counts // exponent, 0), counts), 0)
    found = find(np.concatenate(codes) if codes else np.zeros(0, np.int64), reach, least, exponent)
    begin = np.cumsum(counts) - counts
    doc = np.searchsorted(begin, found[:, 0], side="right") - 1  # the last text that starts there: those before it are empty
    found[:, 0] -= begin[doc] if len(doc) else 0
    return np.split(found, np.searchsorted(doc, np.arange(1, len(texts)))) if texts else []


def collapsed(words: Words, runs: np.ndarray) -> Words:
    """The words without those that a run contains after its first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def scan(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: Callable[[int | None, Words], Words] | None = None, least: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT
) -> DataFrame:
    """A row per row of df: id, n_words, runs (start, length, period; by start and period), and the text without its
    repetitions (collapsed). `words` may change the words of a text, given its id, before they are searched."""
    rows = df.select(quoted(id_col).cast("long").alias("i"), quoted(text_col).cast("string").alias("t"))
    kinds = {name: pa.int64() for name in ("start", "length", "period")}

    def searched(batches):
        for batch in batches:
            for step in steps([batch], "t"):
                texts = [t.split() for t in raw_texts(step.column("t"))]  # bytes part at the six ASCII white spaces
                if words is not None:
                    texts = [words(i, t) for i, t in zip(step.column("i").to_pylist(), texts)]
                found = runs_of(texts, least, exponent)
                kept = [b" ".join(collapsed(t, r)).decode() for t, r in zip(texts, found)]
                flat = np.concatenate(found)
                runs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=[pa.field(n, k) for n, k in kinds.items()])
                ends = np.concatenate([[0], np.cumsum([len(r) for r in found])])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs)
                yield pa.RecordBatch.from_arrays([step.column("i"), pa.array([len(t) for t in texts], pa.int64()), lists, pa.array(kept, pa.string())], ["i", "n_words", "runs", "collapsed"])

    found = rows.mapInArrow(searched, "i long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return found.withColumnRenamed("i", id_col)


def rotated(doc_id: int | None, words: Words) -> Words:
    """A tenth of the texts, told by a checksum of the id, repeat a stretch from some word on to the end."""
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def _longest() -> Column:
    """The run of greatest length; of several the one with the smallest start, then period."""
    return F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: Callable[[int | None, Words], Words] | None = rotated) -> DataFrame:
    """A row per row of df: id, n_runs, the longest run (start, length, period, exponent_milli) and digests of all runs and
    of the collapsed text."""
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = scan(df, id_col, text_col, words).withColumn("best", _longest())
    return rows.select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.p")).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
