"""Packing of documents into sequences by bin completion (operator 8).

Texts are encoded once into pieces. What is packed is the histogram of piece lengths, which has one entry per
length whatever the input's size: bins are completed around the largest length left, with undominated fillings that
are enumerated one at a time, by a branch-and-bound search whose incumbent starts as the best-fit solution and whose
branches are pruned by the waste that an improvement could still afford. A pattern found once is used as often as the
histogram allows. Pieces then take the places of their length by rank; ranks come from counts by (length, salt), so
that a length which a third of all pieces share is dealt over many tasks.

Defined cases: null text counts as empty, whose ids are the end id alone; very long texts are cut into pieces, all of
which are packed; pieces of one length take their places in the order of salt, id, piece, start and checksum, and of
rows that are equal in all of these either may come first; repeated rows are packed each for itself; null ids are
kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise, quoted, raw_texts, steps
from .tokens import encoder

CAPACITY = 2048
END_ID = 0
STEPS = 1_000_000  # of the enumeration, over the whole search
SALTS, SALT_ROWS = 256, 1 << 17

Plan = list[tuple[tuple[int, ...], int]]


def best_fit(histogram: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing on a histogram: bins with the same content are one entry with a multiplicity."""
    groups: dict[tuple[int, ...], int] = {}
    by_room: dict[int, list[tuple[int, ...]]] = {}

    def change(content: tuple[int, ...], n: int) -> None:
        room = capacity - sum(content)
        if content not in groups:
            groups[content] = 0
            by_room.setdefault(room, []).append(content)
        groups[content] += n
        if not groups[content]:
            del groups[content]
            by_room[room].remove(content)

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            room = next((r for r in range(size, capacity) if by_room.get(r)), None)
            if room is None:
                each = capacity // size
                full, rest = divmod(left, each)
                if full:
                    change((size,) * each, full)
                if rest:
                    change((size,) * rest, 1)
                break
            content = by_room[room][0]
            each, n = room // size, groups[content]
            full = min(n, left // each)
            if full:
                change(content, -full)
                change(content + (size,) * each, full)
                left -= full * each
            else:
                change(content, -1)
                change(content + (size,) * left, 1)
                left = 0
    return list(groups.items())


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the volume, or pieces over half a bin with those that fit beside none of them."""
    sizes = np.arange(len(counts))
    best = math.ceil(int((counts * sizes).sum()) / capacity)
    for k in range(0, capacity // 2 + 1, 64):
        big = int(counts[capacity - k + 1 :].sum())
        middle = counts[capacity // 2 + 1 : capacity - k + 1]
        some = int(middle.sum())
        room = some * capacity - int((middle * sizes[capacity // 2 + 1 : capacity - k + 1]).sum())
        small = int((counts[k : capacity // 2 + 1] * sizes[k : capacity // 2 + 1]).sum())
        best = max(best, big + some + max(0, math.ceil((small - room) / capacity)))
    return best


class Sums:
    """Which sums the sizes of a histogram can make, however often each is taken: a quick test that prunes the
    enumeration, built once for a search."""

    def __init__(self, sizes: list[int], room: int) -> None:
        mask = (1 << room + 1) - 1
        self.up_to: dict[int, int] = {}  # sums of sizes up to each size, as bits
        bits = 1
        for s in reversed(sizes):
            step = s
            while step <= room:
                bits |= bits << step & mask
                step *= 2
            self.up_to[s] = bits


def fillings(counts: np.ndarray, room: int, waste: int, sums: Sums, steps_left: list[int]) -> Iterator[tuple[int, ...]]:
    """Every undominated filling of `room` that wastes no more than `waste`, least waste first, made one at a time. A
    filling is dominated if a larger piece at hand could take the place of some of its pieces. Ends early, with nothing
    left in steps_left, when the search has spent its steps."""
    have = [int(s) for s in np.nonzero(counts[: room + 1])[0][::-1] if s]
    if not have:
        if waste >= room:
            yield ()
        return
    at_hand = counts > 0  # of a size, though perhaps in the filling itself

    def exact(total: int, first: int, taken: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        """Multisets of sizes from have[first:] with this sum, in descending order. Iterative: a filling can be long."""
        stack = [(total, first, taken)]
        while stack and steps_left[0] > 0:
            steps_left[0] -= 1
            left, k, own = stack.pop()
            if not left:
                yield own
                continue
            while k < len(have) and have[k] > left:
                k += 1
            if k == len(have) or not sums.up_to[have[k]] >> left & 1:
                continue
            s = have[k]
            stack.append((left, k + 1, own))
            if own.count(s) < counts[s]:
                stack.append((left - s, k, (*own, s)))

    for slack in range(min(waste, room) + 1):
        if room - slack == 0:
            yield ()  # nothing fits, or all is wasted
            return
        if sums.up_to[have[0]] >> (room - slack) & 1:
            for own in exact(room - slack, 0, ()):
                if not _dominated(own, slack, counts, at_hand):
                    yield own


def _dominated(own: tuple[int, ...], slack: int, counts: np.ndarray, at_hand: np.ndarray) -> bool:
    """Whether a piece left outside this filling could take the place of one or two of its pieces (or, without waste, of
    all of them where they are two or three): it is larger than they are by no more than what is wasted, or as large as
    two or more of them. Pairs are tried for fillings of up to 40 distinct sizes; the test only prunes, so what it does not
    try is searched."""
    n = Counter(own)
    gone = [s for s, k in n.items() if counts[s] == k]  # their only copies are in the filling
    at_hand[gone] = False
    try:
        if not slack:
            return 1 < len(own) <= 3 and bool(at_hand[sum(own)])
        distinct, top = sorted(n), len(at_hand) - 1
        pairs = {a + b for a in distinct for b in distinct if a != b or n[a] > 1} if len(distinct) <= 40 else set()
        if any(at_hand[x + 1 : min(top, x + slack) + 1].any() for x in {*distinct, *pairs}):
            return True
        return any(x <= top and at_hand[x] for x in pairs)
    finally:
        at_hand[gone] = True


class Packing(list):
    """(pattern, how often) of a plan, with its bins, the lower bound, and whether it is proven that none has fewer."""

    def __init__(self, plan: Plan, bound: int, proven: bool) -> None:
        super().__init__(plan)
        self.bins, self.bound, self.proven = sum(n for _, n in plan), bound, proven


def bin_completion(histogram: dict[int, int], capacity: int = CAPACITY, most_steps: int = STEPS) -> Packing:
    """The best plan that branch-and-bound finds: bins are completed around the largest piece left, with one
    undominated filling after the other, each as often as the histogram allows and then less often; branches whose
    waste no improvement could afford are pruned. Packing is NP-hard: after `most_steps` steps of the enumeration the
    search stops and says that its plan is not proven."""
    start = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in histogram.items():
        start[size] = n
    bound = lower_bound(start, capacity)
    best = best_fit(histogram, capacity)
    best_bins = sum(n for _, n in best)
    steps_left = [most_steps]
    sums = Sums([int(s) for s in np.nonzero(start)[0][::-1] if s], capacity)

    def branches(counts: np.ndarray, left: int, bins: int) -> Iterator[tuple[tuple[int, ...], int]]:
        """Patterns around the largest piece and how often each is used, lazily: what can be wasted shrinks with the incumbent."""
        largest = int(np.nonzero(counts)[0][-1])
        rest = counts.copy()
        rest[largest] -= 1
        afford = (best_bins - 1 - bins) * capacity - left
        for filling in fillings(rest, capacity - largest, min(afford, capacity - largest), sums, steps_left):
            need = Counter((largest, *filling))
            for times in range(min(int(counts[s]) // n for s, n in need.items()), 0, -1):
                yield (largest, *filling), times

    volume = int((start * np.arange(capacity + 1)).sum())
    stack = [(start, volume, 0, branches(start, volume, 0))] if volume and best_bins > bound else []
    path: list = []
    while stack and best_bins > bound and steps_left[0] > 0:
        counts, left, bins, some = stack[-1]
        made = next(some, None)
        if made is None:
            stack.pop()
            if path:
                path.pop()
            continue
        steps_left[0] -= 20  # a node costs as much as so many steps
        pattern, times = made
        after_left, after_bins = left - sum(pattern) * times, bins + times
        if after_bins + math.ceil(after_left / capacity) >= best_bins:  # more waste than an improvement can afford
            continue
        if not after_left:
            best, best_bins = [*path, made], after_bins
            continue
        after = counts.copy()
        for s, n in Counter(pattern).items():
            after[s] -= n * times
        if after_bins + lower_bound(after, capacity) >= best_bins:
            continue
        path.append(made)
        stack.append((after, after_left, after_bins, branches(after, after_left, after_bins)))
    return Packing(best, bound, best_bins == bound or (not stack and steps_left[0] > 0))


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece: i, piece, start, length, ids_crc32."""

    def encoded(batches):
        enc = encoder(path)
        for batch in batches:
            for step in steps([batch], "text"):
                out = []
                for i, text in zip(step.column("i").to_pylist(), step.column("text").to_pylist()):
                    data = enc.encode(text or "") + END_ID.to_bytes(4, "little")
                    n, at = len(data) // 4, 0
                    first = n if n <= capacity else n % capacity or capacity
                    for k in range(1 + (n - first) // capacity):
                        length = first if k == 0 else capacity
                        out.append((i, k, at, length, zlib.crc32(data[4 * at : 4 * (at + length)])))
                        at += length
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["i", "piece", "start", "length", "ids_crc32"])

    rows = df.select(quoted(id_col).cast("long").alias("i"), quoted(text_col).cast("string").alias("text"))
    return rows.mapInArrow(encoded, "i long, piece int, start long, length long, ids_crc32 long")


class Places:
    """Sequence and offset of the r-th piece of each length under a plan. As large as the plan, not as the input."""

    def __init__(self, plan: Plan) -> None:
        self.runs: dict[int, list] = {}
        used, sequence = Counter(), 0
        for pattern, times in plan:
            at = 0
            for size, n in sorted(Counter(pattern).items(), reverse=True):
                self.runs.setdefault(size, []).append((used[size], sequence, n, at))
                used[size] += n * times
                at += size * n
            sequence += times
        self.runs = {s: np.array(r, dtype=np.int64) for s, r in self.runs.items()}

    def of(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        order = np.argsort(lengths, kind="stable")
        for part in np.split(order, np.nonzero(np.diff(lengths[order]))[0] + 1) if len(order) else []:
            size = int(lengths[part[0]])
            runs = self.runs[size]
            run = runs[np.searchsorted(runs[:, 0], ranks[part], side="right") - 1]
            place = ranks[part] - run[:, 0]
            sequence[part] = run[:, 1] + place // run[:, 2]
            offset[part] = run[:, 3] + place % run[:, 2] * size
        return sequence, offset


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and, the same in each row, whether
    the number of sequences is proven to be the least."""
    cut = materialise(pieces(df, id_col, text_col, path, capacity), "pieces")
    salts = max(SALTS, -(-cut.count() // SALT_ROWS))  # grow with the pieces, of which one length may have a third
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("i", "piece", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = cut.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # one row per length at most
    plan = bin_completion(histogram, capacity)
    places = Places(plan)
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    local = F.row_number().over(Window.partitionBy("length", "salt").orderBy("i", "piece", "start", "ids_crc32")) - 1
    ranked = cut.withColumn("local", local).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("local"))

    def placed(batches):
        for batch in batches:
            if batch.num_rows:
                sequence, offset = places.of(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("i", "piece", "start", "length", "ids_crc32")] + [pa.array(sequence), pa.array(offset)], ["i", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    got = ranked.select("i", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(placed, "i long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return got.withColumnRenamed("i", id_col).withColumn("proven_least", F.lit(plan.proven))
