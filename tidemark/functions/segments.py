"""Sequential text functions: each is a fold over one text, so it runs as a vectorised Python function per row.

Lengths count UTF-16 units as the stored chunk format does; texts without astral characters take the fast path.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import steps

# Token targets of the chunk format (version 2).
TARGET, SEGMENT_CAP, OVERLAP, HARD_CAP = 350, 420, 42, 1750
BACK_OFF = 200
PAGE_CAP = 4000
CHARS = {"prose": 4, "tool": 3}


def width(text: str) -> int:
    return len(text) if text.isascii() or max(text) < "\U00010000" else len(text.encode("utf-16-le", "surrogatepass")) // 2


def tokens(text: str, kind: str = "prose") -> int:
    return -(-width(text) // CHARS[kind])


def _fit(text: str, start: int, units: int) -> int:
    """End of the longest piece from start that has at most that many units."""
    end = min(len(text), start + units)
    while width(text[start:end]) > units:
        end -= max(1, (width(text[start:end]) - units) // 2)
    return end


def hard_split(text: str, most: int, kind: str = "prose") -> list[str]:
    """Pieces of at most `most` tokens; a cut moves back to the last line end or space nearby, which stays on the left."""
    units = most * CHARS[kind]
    pieces, at = [], 0
    while width(text[at:]) > units:
        end = _fit(text, at, units)
        near = max(text.rfind("\n", at, end), text.rfind(" ", at, end))
        if near >= max(at + 1, end - BACK_OFF):
            end = near + 1
        pieces.append(text[at:end])
        at = end
    return pieces + [text[at:]] if at < len(text) or not pieces else pieces


def overlap_tail(text: str, kind: str = "prose") -> str:
    """The last OVERLAP tokens, from a clean boundary on."""
    units = OVERLAP * CHARS[kind]
    if width(text) <= units:
        return text
    start = len(text) - units
    while start < len(text) and width(text[start:]) > units:
        start += 1
    tail = text[start:]
    for mark in ("\n", " "):
        at = tail.find(mark)
        if 0 <= at < len(tail) - 1:
            return tail[at + 1 :]
    return tail


def pack(segments: Iterable[str], kind: str = "prose") -> list[str]:
    """Greedy packing to TARGET tokens; each chunk after the first starts with the tail of the one before."""
    chunks: list[str] = []
    held: list[str] = []
    size = 0
    for segment in (p for s in segments for p in hard_split(s, SEGMENT_CAP, kind)):
        cost = tokens(segment, kind)
        if size > OVERLAP and size + cost > TARGET:
            chunks.append("\n".join(held))
            tail = overlap_tail(chunks[-1], kind)
            held, size = ([tail], tokens(tail, kind)) if tail else ([], 0)
        held.append(segment)
        size += cost
    if held:
        chunks.append("\n".join(held))
    return [p for c in chunks for p in hard_split(c, HARD_CAP, kind)]


def chunk_text(text: str | None) -> list[str]:
    return pack(p for p in (x.strip() for x in re.split(r"\n{2,}", text or "")) if p)


def chunk_trajectory(user: str, assistant: list[str], thinking: list[str], tools: list[str], images: list[str]) -> list[str]:
    """Chunks of one role class each, in the order prose, thinking, tool; the last two begin with the user's intent."""
    chunks = pack([f"USER: {user}", *(f"IMAGE: {x}" for x in images), *(f"ASSISTANT: {x}" for x in assistant)])
    one_line = " ".join(user.split())
    prefix = "USER: " + (one_line if width(one_line) <= 100 else one_line[: _fit(one_line, 0, 100)] + "…")
    for kind, parts in (("prose", [f"THINKING: {x}" for x in thinking]), ("tool", tools)):
        for chunk in pack(parts, kind) if parts else []:
            chunks += hard_split(f"{prefix}\n{chunk}", HARD_CAP, kind)
    return chunks


def page_chunks(title: str, body: str) -> list[str]:
    """A page is one chunk up to PAGE_CAP characters, else one per second-level section."""
    whole = f"{title}\n\n{body}"
    if width(whole) <= PAGE_CAP:
        return [whole]
    return [p for s in re.split(r"(?m)^(?=## )", body) if s.strip() for p in hard_split(f"{title}\n\n{s.strip()}", HARD_CAP)]


def slugify(text: str) -> str:
    bare = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not "̀" <= c <= "ͯ")
    return re.sub(r"[^a-z0-9]+", "-", bare).strip("-")[:64].rstrip("-")


def stable_json(value: object) -> str:
    """Compact JSON with object keys in order at every level."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def sanitize(value: object) -> object:
    """NUL and lone surrogates become U+FFFD, in keys and values at every level."""
    if isinstance(value, str):
        return re.sub("[\x00\ud800-\udfff]", "�", value.encode("utf-16", "surrogatepass").decode("utf-16", "replace"))
    if isinstance(value, list):
        return [sanitize(x) for x in value]
    if isinstance(value, dict):
        return {sanitize(k): sanitize(v) for k, v in value.items()}
    return value


def split_claims(answer: str, most: int) -> list[tuple[str, list[int]]]:
    """Text up to each run of [n] markers, with the run's valid numbers; text after the last run is no claim."""
    claims, at = [], 0
    for run in re.finditer(r"\[[0-9]+\](?:\s*\[[0-9]+\])*", answer):
        text = answer[at : run.start()].strip()
        numbers = list(dict.fromkeys(n for n in map(int, re.findall(r"[0-9]+", run[0])) if 1 <= n <= most))
        at = run.end()
        if text and numbers:
            claims.append((f"{text} {run[0]}", numbers))
    return claims


@F.arrow_udf(T.ArrayType(T.StringType()))
def chunks_of(text: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Texts and their chunks are objects for a step at a time, however long the texts of a batch are."""
    for step in steps(text, 0):
        yield pa.array([chunk_text(x) for x in step.to_pylist()], pa.list_(pa.string()))


@F.pandas_udf(T.ArrayType(T.StringType()))
def page_chunks_of(title: pd.Series, body: pd.Series) -> pd.Series:
    return pd.Series([page_chunks(t or "", b or "") for t, b in zip(title, body)])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("claim", T.StringType()), T.StructField("indices", T.ArrayType(T.IntegerType()))])))
def claims_of(answer: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([[{"claim": c, "indices": i} for c, i in split_claims(a or "", int(m))] for a, m in zip(answer, most)])


@F.pandas_udf(T.StringType())
def stable_json_of(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else stable_json(sanitize(json.loads(x))))


@F.pandas_udf(T.StringType())
def slug_of(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else slugify(x))
