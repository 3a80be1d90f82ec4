"""Exact duplicates by distributed MSD radix partitioning (operator 10).

Texts are equal when their bytes are equal after lower-casing A-Z. Documents are split by successive bytes
until a group is a single document or its texts have ended; no digest decides equality.

1. Map side: the documents of each Arrow step are split by the radix recursion, and its groups meet those of the task's
   earlier steps in a table of SEEN_BYTES, so a text that fills a third of the table is shuffled once per task (texts that
   have come once leave the table first when it is full). The ids of a group's members are rows of their own.
2. Placement: a byte trie, cut by the same recursion over a bounded sample of prefixes, deals the texts to partitions
   of like size. The sample moves rows only, it never decides equality. Where a leaf is still heavy at the depth limit
   (near copies with long common prefixes), whole texts are dealt by a checksum.
3. Reduce side: the recursion ends in each partition. Rows are folded as they come in: whenever as many bytes have come as
   are held (FOLD_BYTES at least), the recursion leaves one text of each group, so a task holds a hot text once however
   many tasks have sent it. What it finds meets the ids by the number of the local group, so no task ever sees all ids of a
   hot text. At 100 TB in tasks of 128 MB, a text of 2 KB that every task holds is a stream of 1.6 GB for one task.

Defined cases: null text counts as empty; empty texts equal each other; very long texts are read by successive bytes
like others, wider digits after each that is shared; a null id is smaller than any id; of repeated rows with the
group's largest id exactly one stays; an empty table gives an empty result; extra columns are ignored by ``groups``
and carried through unchanged by ``survivors``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import quoted, raw_texts, steps, tasks_for

SAMPLE_ROWS = 20_000
PREFIX_BYTES = 512
FIRST_WIDTH, LAST_WIDTH = 8, 4096
SEEN_BYTES, FOLD_BYTES = 16 << 20, 32 << 20
HEAD = 32  # bytes by which the table of a task is split first


def radix_groups(texts: list[bytes]) -> Iterator[list[int]]:
    """Index lists of equal texts. The digit is `width` successive bytes, wider after each digit that is shared."""
    stack = [(list(range(len(texts))), 0, FIRST_WIDTH)] if texts else []
    while stack:
        members, offset, width = stack.pop()
        if len(members) == 1:
            yield members
            continue
        parts: dict[bytes, list[int]] = {}
        for i in members:
            parts.setdefault(texts[i][offset : offset + width], []).append(i)
        for digit, part in parts.items():
            if len(part) == 1 or len(digit) < width:  # single, or all of its texts have ended here
                yield part
            else:
                stack.append((part, offset + width, min(2 * width, LAST_WIDTH)))


class Trie:
    """Deals texts to buckets by their leading bytes; built by the radix recursion over sampled prefixes."""

    def __init__(self, prefixes: list[bytes], buckets: int) -> None:
        self.size = 0
        self.target = max(1, len(prefixes) // max(1, buckets))
        self.root = self._node(prefixes)

    def _leaf(self, weight: int, deep: bool) -> tuple[int, int]:
        ways = max(1, -(-weight // self.target)) if deep else 1
        first, self.size = self.size, self.size + ways
        return first, ways

    def _node(self, prefixes: list[bytes]) -> object:
        """A leaf (first bucket, ways) or (children by byte, leaf for other bytes), down to PREFIX_BYTES."""
        top: list = [None]
        work = [(prefixes, 0, top, 0)]
        while work:
            part, depth, at, slot = work.pop()
            if len(part) <= self.target or depth >= PREFIX_BYTES:
                at[slot] = self._leaf(len(part), depth >= PREFIX_BYTES)
                continue
            by: dict[int, list[bytes]] = {}
            for x in part:
                by.setdefault(x[depth] if len(x) > depth else -1, []).append(x)
            children: dict = {}
            at[slot] = (children, self._leaf(0, False))
            shared, weight = None, 0
            for byte, own in sorted(by.items()):
                if byte < 0:
                    children[byte] = self._leaf(len(own), False)
                elif 2 * len(own) > self.target:
                    work.append((own, depth + 1, children, byte))
                else:  # small neighbours share a leaf
                    if shared is None or weight + len(own) > self.target:
                        shared, weight = self._leaf(0, False), 0
                    weight += len(own)
                    children[byte] = shared
        return top[0]

    def bucket(self, text: bytes) -> int:
        node, depth = self.root, 0
        while isinstance(node[0], dict):
            node = node[0].get(text[depth] if len(text) > depth else -1, node[1])
            depth += 1
        first, ways = node
        return first if ways == 1 else first + zlib.crc32(text) % ways


class Seen:
    """The distinct texts of a task's recent steps, each with a value that says how often it has come."""

    def __init__(self, most: int = SEEN_BYTES) -> None:
        self.by_head: dict[bytes, list[list]] = {}  # [text, value, how many local groups]
        self.size, self.most = 0, most

    def meet(self, texts: list[bytes], values: list) -> Iterator[tuple[object, object]]:
        """(value of the text that is held, new value) for texts that are known; the others are held from now on."""
        new: dict[bytes, list[int]] = {}
        for k, text in enumerate(texts):
            new.setdefault(text[:HEAD], []).append(k)
        for head, some in new.items():
            held = self.by_head.setdefault(head, [])
            known = len(held)
            parts = radix_groups([e[0] for e in held] + [texts[k] for k in some]) if known else ([known + j] for j in range(len(some)))
            for part in parts:
                at = min(part)
                if at >= known:
                    held.append([texts[some[at - known]], values[some[at - known]], 1])
                    self.size += len(held[-1][0]) + 100
                for j in part:
                    if j >= known and j != at:
                        held[at][2] += 1
                        yield held[at][1], values[some[j - known]]

    def leave(self, all_: bool = False) -> list[tuple[bytes, object]]:
        """What is given up: nothing while there is room, else the texts that came once, and all if they are not the half."""
        if not all_ and self.size <= self.most:
            return []
        out = []
        for once in (True, False):
            for head in list(self.by_head):
                held = self.by_head[head]
                go = [e for e in held if not once or e[2] == 1]
                out += [(e[0], e[1]) for e in go]
                self.size -= sum(len(e[0]) + 100 for e in go)
                stay = [e for e in held if once and e[2] > 1]
                if stay:
                    self.by_head[head] = stay
                else:
                    del self.by_head[head]
            if not all_ and 2 * self.size <= self.most:
                break
        return out


def _trie(rows: DataFrame, buckets: int) -> Trie:
    """rows: one column, row, with the text as its field t."""
    total = rows.count()
    if not total:
        return Trie([], 1)

    def heads(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x[:PREFIX_BYTES].lower() for x in raw_texts(batch.column(0))], pa.binary())], ["head"])

    few = rows.select("t").sample(fraction=min(1.0, SAMPLE_ROWS / total), seed=7)  # about SAMPLE_ROWS; each task sends prefixes only
    return Trie([bytes(r[0]) for r in few.mapInArrow(heads, "head binary").collect()], buckets)


def _dealt(df: DataFrame, id_col: str, text_col: str, fields: list, collapse) -> tuple[DataFrame, int]:
    """The rows (bucket b first) that `collapse` makes of a task's Arrow steps, dealt by b."""
    parts = tasks_for(df)
    named = {f.name: f for f in df.schema.fields}
    columns = [quoted(id_col).cast("long").alias("i"), quoted(text_col).cast("string").alias("t")]
    if fields:  # the other columns, under names of their own; the text travels once where it is a string already
        columns.append(F.struct(*[quoted(c).alias(f"c{k}") for k, c in enumerate(df.columns) if c != text_col or named[c].dataType != T.StringType()] or [F.lit(0).alias("none")]).alias("row"))
    rows = df.select(*columns)
    trie = _trie(rows, max(256, 4 * parts))

    def local(batches):
        place, made, state = TaskContext.get().partitionId(), 0, collapse(trie)
        for batch in batches:
            for step in steps([batch], "t"):
                texts = [x.lower() for x in raw_texts(step.column("t"))]
                ids = step.column("i").to_pylist()
                found = list(radix_groups(texts))
                for group in found:
                    group.sort(key=lambda i: (ids[i] is None, -(ids[i] or 0)))
                yield from state.step(step, texts, ids, found, (place << 33) + made)
                made += len(found)
        yield from state.end()

    kinds = T.StructType([T.StructField("b", T.IntegerType()), *(fields or _GROUPS)] + ([rows.schema["row"]] if fields else []))
    return rows.mapInArrow(local, kinds).repartition(parts, "b"), parts


_GROUPS = [T.StructField("g", T.LongType()), T.StructField("t", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType()))]


class _Numbered:
    """A row for each local group with its text, size and largest id, when the table gives the text up. The ids of a group
    of several are rows of their own, dealt by the group's number: however hot a text is, its ids never meet in one task."""

    KINDS = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()))

    def __init__(self, trie: Trie) -> None:
        self.trie, self.seen = trie, Seen()

    def _batch(self, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(rows), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows[at : at + 5000]), self.KINDS)], ["b", "g", "t", "n", "ids"])

    @staticmethod
    def _dealt(number: int) -> int:
        return number * 0x9E3779B1 & 0x7FFFFFFF

    def _texts(self, gone: list) -> list[tuple]:
        return [(self.trie.bucket(text), g, text, n, [best]) for text, (g, n, best, _) in gone]

    def step(self, step, texts, ids, found, number):
        values = [[number + k, len(group), ids[group[0]], [ids[i] for i in group]] for k, group in enumerate(found)]
        rows = []
        for old, new in self.seen.meet([texts[group[0]] for group in found], values):
            if old[3] is not None:  # so far alone in its group
                rows.append((self._dealt(old[0]), old[0], None, 0, old[3]))
                old[3] = None
            rows.append((self._dealt(old[0]), old[0], None, 0, new[3]))
            new[3] = None
            old[1] += new[1]
            old[2] = new[2] if old[2] is None or (new[2] is not None and new[2] > old[2]) else old[2]
        for value in values:
            if value[3] is not None and value[1] > 1:
                rows.append((self._dealt(value[0]), value[0], None, 0, value[3]))
                value[3] = None
        yield from self._batch(rows + self._texts(self.seen.leave()))

    def end(self):
        yield from self._batch(self._texts(self.seen.leave(True)))


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, keep_id, group_size, kept, text_sha256 (of the lower-cased text)."""
    dealt, parts = _dealt(df, id_col, text_col, [], _Numbered)

    def finish(batches):
        texts: list[bytes] = []  # distinct, with the local groups that hold them: (number, size, largest id)
        members: list[list[tuple]] = []
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.bool_(), pa.string())
        row = lambda out: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 6, kinds)], ["g", "ids", "keep_id", "group_size", "first", "text_sha256"])
        come = held = 0

        def fold():
            nonlocal texts, members, come, held
            merged = list(radix_groups(texts))
            members = [[m for i in group for m in members[i]] for group in merged]
            texts = [texts[group[0]] for group in merged]
            come, held = 0, sum(map(len, texts))

        for batch in batches:
            lists = []
            for g, t, n, ids in zip(*(batch.column(c).to_pylist() for c in ("g", "t", "n", "ids"))):
                if t is None:
                    lists.append((g, ids, None, None, None, None))
                else:
                    texts.append(t)
                    members.append([(g, n, ids[0])])
                    come += len(t)
            yield row(lists)
            if come > max(FOLD_BYTES, held):
                fold()
        fold()
        out: list[tuple] = []
        for text, local in zip(texts, members):
            best = min(range(len(local)), key=lambda i: (local[i][2] is None, -(local[i][2] or 0)))
            size, sha = sum(n for _, n, _ in local), hashlib.sha256(text).hexdigest()
            out += [(g, [largest] if n == 1 else None, local[best][2], size, i == best, sha) for i, (g, n, largest) in enumerate(local)]
            if len(out) > 10_000:
                yield row(out)
                out = []
        yield row(out)

    found = dealt.select("g", "t", "n", "ids").mapInArrow(finish, "g long, ids array<long>, keep_id long, group_size long, first boolean, text_sha256 string")
    # For each local group its ids, of one task at most, meet what its text has found.
    ids = F.sort_array(F.flatten(F.collect_list("ids")), asc=False).alias("ids")
    whole = found.repartition(parts, "g").groupBy("g").agg(ids, *[F.max(c).alias(c) for c in ("keep_id", "group_size", "first", "text_sha256")])
    one = whole.select(F.posexplode("ids").alias("at", "id"), "keep_id", "group_size", "first", "text_sha256")
    return one.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("first") & (F.col("at") == 0)).alias("kept"), "text_sha256")


def _better(a: int | None, b: int | None) -> bool:
    """Whether id a stays rather than b."""
    return a is not None and (b is None or a > b)


class _Best:
    """Of each text of a task the row with the largest id, when the table gives the text up."""

    def __init__(self, trie: Trie) -> None:
        self.trie, self.seen, self.held = trie, Seen(), []

    def _rows(self, gone: list) -> Iterator[pa.RecordBatch]:
        """gone: (text, [id, number of the batch, row])."""
        for at in range(0, len(gone), 5000):
            part = sorted(gone[at : at + 5000], key=lambda x: x[1][1:])
            table = pa.Table.from_batches([self.held[b].take(pa.array([x[1][2] for x in part if x[1][1] == b], pa.int64())) for b in sorted({x[1][1] for x in part})]).combine_chunks()
            buckets = pa.array([self.trie.bucket(x[0]) for x in part], pa.int32())
            yield pa.RecordBatch.from_arrays([buckets, *(table.column(c).combine_chunks() for c in ("t", "i", "row"))], ["b", "t", "i", "row"])

    def step(self, step, texts, ids, found, number):
        kept = step.take(pa.array([group[0] for group in found], pa.int64()))
        self.held.append(kept)
        values = [[ids[group[0]], len(self.held) - 1, k] for k, group in enumerate(found)]
        for old, new in self.seen.meet([texts[group[0]] for group in found], values):
            if _better(new[0], old[0]):
                old[:] = new
        gone = self.seen.leave()
        if gone:
            yield from self._rows(gone)
            left = [e for some in self.seen.by_head.values() for e in some]  # of what stays, one batch
            parts = []
            for e in left:
                parts.append(self.held[e[1][1]].slice(e[1][2], 1))
                e[1][1:] = [0, len(parts) - 1]
            self.held = pa.Table.from_batches(parts).combine_chunks().to_batches() if parts else []
            for e in left if len(self.held) > 1 else []:  # chunks of a table that would not combine
                at = e[1][2]
                for b, some in enumerate(self.held):
                    if at < some.num_rows:
                        break
                    at -= some.num_rows
                e[1][1:] = [b, at]

    def end(self):
        yield from self._rows(self.seen.leave(True))


def survivors(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, with all their columns; the text is shuffled once and joined with nothing."""
    dealt, _ = _dealt(df, id_col, text_col, [T.StructField("t", T.StringType()), T.StructField("i", T.LongType())], _Best)

    def finish(batches):
        held: list[pa.RecordBatch] = []
        size = come = 0

        def fold():
            nonlocal held, size, come
            rows = pa.Table.from_batches(held).combine_chunks()
            texts = [x.lower() for x in raw_texts(rows.column("t"))]
            ids = rows.column("i").to_pylist()
            keep = [min(g, key=lambda i: (ids[i] is None, -(ids[i] or 0))) for g in radix_groups(texts)]
            held = rows.take(pa.array(keep, pa.int64())).to_batches(max_chunksize=1000)
            size, come = sum(b.nbytes for b in held), 0

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                come += batch.nbytes
                if come > max(FOLD_BYTES, size):
                    fold()
        if held:
            fold()
            yield from (b.select(["t", "row"]) for b in held)

    kind = T.StructType([f for f in dealt.schema.fields if f.name in ("t", "row")])
    left = dealt.select("t", "i", "row").mapInArrow(finish, T.StructType([kind["t"], kind["row"]]))
    own = set(kind["row"].dataType.names)
    return left.select(*[(F.col("row")[f"c{k}"] if f"c{k}" in own else F.col("t")).alias(c) for k, c in enumerate(df.columns)])


ORACLE_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
