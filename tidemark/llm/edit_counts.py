"""Token counts under edits (operator 9).

A document's chunks (see ``tokens``: they end at borders of the tokenizer's pre-tokens) lie in the leaves of a segment
tree that sums characters and tokens. An edit finds the chunks it touches by descending on characters, re-encodes
those and one more on either side (the boundary context), and updates the sums on the paths above; all other chunks
keep their counts. A leaf that an insertion has filled is split, and the sums above the leaves are built anew.

Defined cases: null text counts as empty (0 tokens); texts with any white space, marks or special tokens are edited
piece by piece; a run of letters without a border is one chunk however long, since its merges depend on all of it;
very long texts are one tree, held in the task that reads them; of edits that start at the same place the one that
ends later is applied first; repeated rows and null ids are counted each for itself; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import quoted, steps
from .tokens import Encoder, encoder

LEAF_CHUNKS = 32

Edit = tuple[int, int, str]  # characters [start, end) become the text

_ADDRESS = re.compile(r"(?<![^\s@])[^\s@]++@[^\s@]+")
_MASKED = re.compile(r"[0-9*#$%&!](?:(?<=[0-9])[0-9().+-]{3,}[0-9]|(?<=([*#$%&!]))\1+)")  # a set of first signs is searched for at once


def masking_edits(text: str) -> list[Edit]:
    """The edits of the registered query: e-mail addresses, numbers of five signs or more and runs of marks are masked. An
    address can start only where a run of other signs than white space and @ does, and leaves no part of its runs to the rest."""
    addresses = [m.span() for m in _ADDRESS.finditer(text)] if "@" in text else []
    found, at = [], 0
    for start, end in [*addresses, (len(text), len(text))]:
        found += [(m.start(), m.end(), "#" if m[1] else "MASK") for m in _MASKED.finditer(text, at, start)]
        if end > start:
            found.append((start, end, "MASK"))
        at = end
    return found


class TokenTree:
    """Segment tree over leaves of chunks; node k has children 2k and 2k + 1."""

    def __init__(self, text: str, enc: Encoder) -> None:
        self.enc, self.encoded = enc, 0
        chunks = enc.chunks(text)
        counts = self._counted(chunks)
        self._plant([chunks[i : i + LEAF_CHUNKS] for i in range(0, len(chunks), LEAF_CHUNKS)], [counts[i : i + LEAF_CHUNKS] for i in range(0, len(chunks), LEAF_CHUNKS)])

    def _plant(self, leaves: list[list[str]], counts: list[list[int]]) -> None:
        """The tree above these leaves."""
        self.leaves, self.counts = leaves or [[]], counts or [[]]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.leaves += [[] for _ in range(self.width - len(self.leaves))]
        self.counts += [[] for _ in range(self.width - len(self.counts))]
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for k, leaf in enumerate(self.leaves):
            self.chars[self.width + k], self.tokens[self.width + k] = sum(map(len, leaf)), sum(self.counts[k])
        for k in range(self.width - 1, 0, -1):
            self._sum(k)

    def _split(self) -> None:
        """Cuts leaves that hold too many chunks; empty ones go."""
        leaves, counts = [], []
        for leaf, count in zip(self.leaves, self.counts):
            for i in range(0, len(leaf), LEAF_CHUNKS):
                leaves.append(leaf[i : i + LEAF_CHUNKS])
                counts.append(count[i : i + LEAF_CHUNKS])
        self._plant(leaves, counts)

    def _counted(self, chunks: list[str]) -> list[int]:
        self.encoded += len(chunks)
        return list(map(self.enc.counts.__getitem__, chunks))

    def _sum(self, k: int) -> None:
        self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(c for leaf in self.leaves for c in leaf)

    def _find(self, at: int) -> tuple[int, int, int]:
        """Leaf, chunk in it and the chunk's first character, of the chunk that holds character `at` (or the last)."""
        at, k, start = min(at, max(0, self.chars[1] - 1)), 1, 0
        while k < self.width:
            k *= 2
            if at - start >= self.chars[k]:
                start, k = start + self.chars[k], k + 1
        leaf = k - self.width
        for i, chunk in enumerate(self.leaves[leaf]):
            if at < start + len(chunk):
                return leaf, i, start
            start += len(chunk)
        return leaf, len(self.leaves[leaf]), start

    def _beside(self, leaf: int, i: int, by: int) -> tuple[int, int] | None:
        i += by
        while 0 <= leaf < self.width:
            if 0 <= i < len(self.leaves[leaf]):
                return leaf, i
            leaf += by
            i = len(self.leaves[leaf]) - 1 if by < 0 and 0 <= leaf else 0
        return None

    def apply(self, start: int, end: int, new: str) -> None:
        """Characters [start, end) become new; sums are updated above the leaves that changed."""
        if not 0 <= start <= end <= self.chars[1]:
            raise ValueError("edit outside the text")
        la, ia, first = self._find(start)
        lb, ib = la, ia
        if end - 1 >= first + len(self.leaves[la][ia] if self.chars[1] and ia < len(self.leaves[la]) else ""):
            lb, ib, _ = self._find(max(start, end - 1))
        if (before := self._beside(la, ia, -1)) is not None:
            la, ia = before
            first -= len(self.leaves[la][ia])
        if (after := self._beside(lb, ib, 1)) is not None:
            lb, ib = after
        if not self.chars[1]:
            old = ""
        elif la == lb:
            old = "".join(self.leaves[la][ia : ib + 1])
        else:
            old = "".join(self.leaves[la][ia:]) + "".join(c for k in range(la + 1, lb) for c in self.leaves[k]) + "".join(self.leaves[lb][: ib + 1])
        chunks = self.enc.chunks(old[: start - first] + new + old[end - first :])
        counts = self._counted(chunks)
        if la == lb:
            more = sum(counts) - sum(self.counts[la][ia : ib + 1])
            self.leaves[la][ia : ib + 1], self.counts[la][ia : ib + 1] = chunks, counts
            if len(self.leaves[la]) > 4 * LEAF_CHUNKS:
                self._split()
                return
            node, longer = self.width + la, len(new) - (end - start)
            while node:
                self.chars[node] += longer
                self.tokens[node] += more
                node >>= 1
            return
        self.leaves[la][ia:], self.counts[la][ia:] = chunks, counts
        for k in range(la + 1, lb):
            self.leaves[k], self.counts[k] = [], []
        del self.leaves[lb][: ib + 1], self.counts[lb][: ib + 1]
        if max(len(self.leaves[la]), len(self.leaves[lb])) > 4 * LEAF_CHUNKS:
            self._split()
            return
        touched = set()
        for k in range(la, lb + 1):
            node = self.width + k
            self.chars[node], self.tokens[node] = sum(map(len, self.leaves[k])), sum(self.counts[k])
            touched.add(node // 2)
        while touched and touched != {0}:
            for k in touched:
                self._sum(k)
            touched = {k // 2 for k in touched} - {0}


def edit_aware_counts(df: DataFrame, edits: Callable[[str], list[Edit]] = masking_edits, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id, n_tokens, n_edits, n_tokens_edited, n_chunks, n_reencoded of every row. Edits are applied from the last
    to the first, each to the text that the ones before it left."""

    def counted(batches):
        enc = encoder(path)
        for batch in batches:
            for step in steps([batch], "text"):
                out = []
                for i, text in zip(step.column("i").to_pylist(), step.column("text").to_pylist()):
                    todo = edits(text or "")
                    if not todo:  # nothing to find: no tree
                        pieces = enc.chunks(text or "")
                        total = sum(map(enc.counts.__getitem__, pieces))
                        out.append((i, total, 0, total, len(pieces), 0))
                        continue
                    tree = TokenTree(text or "", enc)
                    before, chunks = tree.total, tree.encoded
                    for start, end, new in sorted(todo, reverse=True):
                        tree.apply(start, end, new)
                    out.append((i, before, len(todo), tree.total, chunks, tree.encoded - chunks))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.int64(), *[pa.int64()] * 5))], ["i", "n_tokens", "n_edits", "n_tokens_edited", "n_chunks", "n_reencoded"])

    rows = df.select(quoted(id_col).cast("long").alias("i"), quoted(text_col).cast("string").alias("text"))
    return rows.mapInArrow(counted, "i long, n_tokens long, n_edits long, n_tokens_edited long, n_chunks long, n_reencoded long").withColumnRenamed("i", id_col)
