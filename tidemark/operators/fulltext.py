"""Full-text search: analysis, postings, web-style boolean queries and cover-density rank.

Two ways to the same scores. `search` reads a stored index: one row per (term, chunk) with sorted positions, in folders
by the term's hash, so a query reads the folders of its terms and, sorted by term, few row groups of them. `rank` is a
column over the texts themselves, for a pass that reads them anyhow: no shuffle, and only the query's terms are kept.
Null texts count as empty; equal scores go by id. Stems follow the published Porter2 rules in their main steps; parity with other engines is of meaning, not of bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scans

# English stop words.
STOP_WORDS = frozenset(
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down during each few for from "
    "further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our "
    "ours ourselves out over own s same she should so some such t than that the their theirs them themselves then there these they this those through to too under until up very was we "
    "were what when where which while who whom why will with you your yours yourself yourselves".split()
)
_VOWEL = re.compile("[aeiouy]")
_TOKEN = re.compile("[a-z0-9]+")
_REGION = re.compile("[aeiouy][^aeiouy]")
_DOUBLE = re.compile(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
_SHORT = re.compile(r"(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywx])$")
_SHORT_END = re.compile(r"[^aeiouy][aeiouy][^aeiouywx]$")
STEMS, FLUSH = 1 << 18, 1 << 20  # tokens whose stem a task remembers; positions in a batch of postings
# Suffixes of Porter2's steps 2 to 4.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
_LONGEST = [(t, tuple(sorted(t, key=len, reverse=True))) for t in (_STEP2, _STEP3)]


def _regions(w: str) -> tuple[int, int]:
    """Starts of R1 and R2: after the first consonant that follows a vowel, and the same again."""
    at = []
    start = 0
    for _ in range(2):
        m = _REGION.search(w, start)
        start = m.end() if m else len(w)
        at.append(start)
    return at[0], at[1]


def stem(word: str) -> str:
    w = word
    if len(w) < 3:
        return w
    r1, r2 = _regions(w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w.endswith(("eedly", "eed")):
        cut = len(w) - (5 if w.endswith("ly") else 3)
        w = w[: cut + 2] if cut >= r1 else w
    else:
        for suffix in ("ingly", "edly", "ing", "ed"):
            if w.endswith(suffix):
                if _VOWEL.search(w[: -len(suffix)]):
                    w = w[: -len(suffix)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif _DOUBLE.search(w):
                        w = w[:-1]
                    elif r1 >= len(w) and _SHORT.search(w):
                        w += "e"
                break
    if len(w) > 2 and w[-1] == "y" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    for table, longest in _LONGEST:
        for suffix in longest if w.endswith(longest) else ():
            if w.endswith(suffix):
                if len(w) - len(suffix) >= r1:
                    w = w[: -len(suffix)] + table[suffix]
                break
    for suffix in _STEP4 if w.endswith(_STEP4) else ():
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r2 and (suffix != "ion" or w[: -len(suffix)].endswith(("s", "t"))):
                w = w[: -len(suffix)]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT_END.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w


def analyse(text: str) -> list[tuple[str, int]]:
    """(stem, position from 1) of every token that is no stop word; stop words take up positions."""
    return [(stem(t), i) for i, t in enumerate(_TOKEN.findall(text.lower()), 1) if t not in STOP_WORDS]


class _Stems(dict):
    """Stem by token, None for a stop word or, where terms are given, for a stem that is not among them."""

    def __init__(self, terms: frozenset[str] | None = None):
        super().__init__()
        self.terms = terms
        self.first = None if terms is None else {t[0] for t in terms}  # rules change suffixes only, never the first letter

    def __missing__(self, token: str) -> str | None:
        if len(self) >= STEMS:
            self.clear()
        other = self.first is not None and token[0] not in self.first
        s = None if other or token in STOP_WORDS else stem(token)
        self[token] = s = s if self.terms is None or s in self.terms else None
        return s


def places(text: str | None, stems: _Stems) -> dict[str, list[int]]:
    """Sorted positions by stem; every token takes up a position."""
    at: dict[str, list[int]] = {}
    for i, s in enumerate(map(stems.__getitem__, _TOKEN.findall((text or "").lower())), 1):
        if s is not None:
            at.setdefault(s, []).append(i)
    return at


def postings(chunks: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """term, id, positions."""

    def invert(batches):
        import pyarrow as pa

        stems = _Stems()

        def flush(ids, terms, rows, ends, values):
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), ids.take(pa.array(rows, pa.int64())), lists], ["term", id_col, "positions"])

        for batch in batches:
            terms, rows, ends, values = [], [], [0], []
            for r in range(batch.num_rows):
                for term, at in places(batch.column(1)[r].as_py(), stems).items():
                    terms.append(term)
                    rows.append(r)
                    values += at
                    ends.append(len(values))
                if len(values) >= FLUSH:
                    yield flush(batch.column(0), terms, rows, ends, values)
                    terms, rows, ends, values = [], [], [0], []
            if terms:
                yield flush(batch.column(0), terms, rows, ends, values)

    kind = chunks.schema[id_col].dataType.simpleString()
    return chunks.select(id_col, F.col(text_col).cast("string")).mapInArrow(invert, f"term string, `{id_col}` {kind}, positions array<int>")


class _Codes(dict):
    """Number of its stem by token, -1 for a stop word; `terms` has the stems in the order of their numbers."""

    def __init__(self):
        super().__init__()
        self.terms: list[str] = []
        self.known: dict[str, int] = {}

    def __missing__(self, token: str) -> int:
        code = -1
        if token not in STOP_WORDS:
            s = stem(token)
            code = self.known.setdefault(s, len(self.terms))
            if code == len(self.terms):
                self.terms.append(s)
        self[token] = code
        return code


def folded(rows: DataFrame) -> DataFrame:
    """range, term, most, ids, positions of rows (range, id, content) of which each partition has whole ranges, in the order of
    range, id and content: a row for each term of a range, with its ids in order. Of rows with one id the last counts."""

    def block(ids, texts, at, codes):
        import numpy as np
        import pyarrow as pa

        names = ids.to_pylist()
        rows = [r for r in range(len(names)) if r + 1 == len(names) or names[r] != names[r + 1]]
        found = []
        for r in rows:
            tokens = _TOKEN.findall((texts[r].as_py() or "").lower())
            found.append(np.fromiter(map(codes.__getitem__, tokens), np.int32, len(tokens)))
        sizes = np.array([len(x) for x in found])
        code, doc = np.concatenate(found), np.repeat(np.array(rows), sizes)
        place = np.arange(1, len(code) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        some = np.flatnonzero(code >= 0)
        some = some[np.argsort(code[some], kind="stable")]  # by term, then id, then place
        if not len(some):
            return
        code, doc, place = code[some], doc[some], place[some]
        other = code[1:] != code[:-1]
        entries = np.concatenate([[0], np.flatnonzero(other | (doc[1:] != doc[:-1])) + 1])  # where those of one row begin
        own = code[entries]
        heads = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])  # and those of one term
        most = np.maximum.reduceat(np.diff(np.append(entries, len(code))), heads)
        ends = pa.array(np.append(heads, len(entries)), pa.int32())
        positions = pa.ListArray.from_arrays(pa.array(np.append(entries, len(code)), pa.int32()), pa.array(place, pa.int32()))
        columns = [pa.array(np.full(len(heads), at), pa.int32()), pa.array([codes.terms[c] for c in own[heads].tolist()], pa.string()), pa.array(most, pa.int32())]
        columns += [pa.ListArray.from_arrays(ends, ids.take(pa.array(doc[entries]))), pa.ListArray.from_arrays(ends, positions)]
        yield pa.RecordBatch.from_arrays(columns, ["range", "term", "most", "ids", "positions"])

    def fold(batches):
        import numpy as np
        import pyarrow as pa

        codes, held, last = _Codes(), [], None

        def flush():
            yield from block(*(pa.concat_arrays([b.column(c) for b in held]) for c in (1, 2)), last, codes)

        for batch in batches:
            at = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                if held and at[start] != last:
                    yield from flush()
                    held = []
                    if len(codes) >= STEMS:
                        codes = _Codes()
                last = int(at[start])
                held.append(batch.slice(start, end - start))
        if held:
            yield from flush()

    return rows.select("range", "id", "content").mapInArrow(fold, "range int, term string, most int, ids array<string>, positions array<array<int>>")


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_index(index: DataFrame, path: str, buckets: int = 64, splits: int = 4, id_col: str = "id") -> None:
    """Postings in folders by the term's hash; the rows of a folder, those of a very common term too, are dealt to
    `splits` tasks by id, or to more as the table grows: a folder and split is what one task sorts."""
    splits = -(-scans.tasks(index, buckets * splits) // buckets)
    dealt = index.withColumn("bucket", _bucket(F.col("term"), buckets)).repartition(buckets * splits, "bucket", F.pmod(F.xxhash64(id_col), F.lit(splits)))
    dealt.sortWithinPartitions("bucket", "term", id_col).write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_index(spark: SparkSession, path: str, query: str, buckets: int = 64) -> DataFrame:
    """The postings of a query's terms; other folders are not opened. buckets as it was written."""
    terms = sorted({t for c in parse_query(query) for p in c.phrases for t in p})
    near = spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term"), buckets).alias("b")).distinct().collect() if terms else []
    stored = spark.read.parquet(path)
    return stored.where(F.col("bucket").isin(*[r.b for r in near]) & F.col("term").isin(*terms)).drop("bucket") if terms else stored.where("false").drop("bucket")


@dataclass(frozen=True)
class Clause:
    """Alternatives of which one must match (or, negated, none); each is a phrase of stems."""

    phrases: tuple[tuple[str, ...], ...]
    negated: bool = False


def parse_query(query: str) -> list[Clause]:
    """Web-style syntax: words are ANDed, `or` joins neighbours, quotes make phrases, a leading dash negates."""
    clauses: list[Clause] = []
    join = False
    for m in re.finditer(r'(-?)(?:"([^"]*)"|([^\s"]+))', query):
        dash, quoted, word = m.groups()
        if word and word.lower() == "or" and not dash:
            join = bool(clauses)
            continue
        phrase = tuple(s for s, _ in analyse(quoted if quoted is not None else word))
        if not phrase:
            continue
        if join and clauses and not dash and not clauses[-1].negated:
            clauses[-1] = Clause((*clauses[-1].phrases, phrase))
        else:
            clauses.append(Clause((phrase,), bool(dash)))
        join = False
    return clauses


def _occurs(phrase: tuple[str, ...], at: dict[str, list[int]]) -> bool:
    starts = set(at.get(phrase[0], ()))
    for k, t in enumerate(phrase[1:], 1):
        starts &= {p - k for p in at.get(t, ())}
    return bool(starts)


def matches(clauses: list[Clause], at: dict[str, list[int]]) -> bool:
    """A query without a positive clause matches nothing."""
    return any(not c.negated for c in clauses) and all(any(_occurs(p, at) for p in c.phrases) != c.negated for c in clauses)


def cover_density(clauses: list[Clause], at: dict[str, list[int]]) -> float:
    """Sum over minimal covers of 1 / (1 + words that the cover holds besides the terms), as r / (r + 1)."""
    groups = [{t for p in c.phrases for t in p} for c in clauses if not c.negated]
    events = sorted((p, k) for k, g in enumerate(groups) for t in g for p in at.get(t, ()))
    total, last, lowest = 0.0, {}, None
    for p, k in events:
        last[k] = p
        if len(last) == len(groups):
            start = min(last.values())
            if start != lowest:  # a shorter cover with this start ended before
                total += 1 / (1 + max(0, p - start + 1 - len(groups)))
                lowest = start
    return total / (total + 1)


def best_first(scored: DataFrame, limit: int | None, id_col: str = "id") -> DataFrame:
    """Rows with a score by score (12 places), then id."""
    found = scored.where("keyword_score IS NOT NULL").orderBy(F.desc(F.round("keyword_score", 12)), id_col)
    return found if limit is None else found.limit(limit)


def search(index: DataFrame, query: str, limit: int | None = 50, id_col: str = "id") -> DataFrame:
    """id and keyword_score of matching chunks of an index, best first; an empty query has no rows."""
    clauses = parse_query(query)
    terms = sorted({t for c in clauses for p in c.phrases for t in p})
    rows = index.where(F.col("term").isin(*terms)) if terms else index.where("false")
    grouped = rows.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))

    @F.pandas_udf(T.DoubleType())
    def score(at: pd.Series) -> pd.Series:
        def one(m: dict) -> float | None:
            d = {k: list(v) for k, v in dict(m).items()}
            return cover_density(clauses, d) if matches(clauses, d) else None

        return at.map(one)

    return best_first(grouped.select(id_col, score("at").alias("keyword_score")), limit, id_col)


def rank(content: Column, query: str) -> Column:
    """The score that `search` gives, from the text itself; null where the query does not match."""
    clauses = parse_query(query)
    terms = frozenset(t for c in clauses for p in c.phrases for t in p)
    if not any(not c.negated for c in clauses):
        return F.lit(None).cast("double")

    @F.pandas_udf(T.DoubleType())
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        stems = _Stems(terms)

        def one(text: str | None) -> float | None:
            at = places(text, stems)
            return cover_density(clauses, at) if at and matches(clauses, at) else None

        for texts in parts:
            yield pd.Series([one(t) for t in texts], dtype="float64")

    return score(content)
