"""Byte-level BPE with a cache by chunk: the same ids as the tokenizer file gives, several times as fast.

A chunk is a run of white space and the other characters after it. No pre-token crosses the border between a
character that is not white space and one that is, so chunks can be encoded apart. A long chunk is cut further where a
letter or number is followed by a mark, which is a border of pre-tokens too. A special token is a chunk of its own,
and ends what comes before it.
"""

from __future__ import annotations

import json
import os
import re
from array import array

CACHE_CHUNKS = 100_000
CACHE_COUNTS = 300_000
LONG = 64  # characters of a chunk that is cut further
# The characters that Unicode calls white space.
_WHITE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
_CHUNK = re.compile(rf"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
_OTHER_WHITE = re.compile(rf"(?![ \n])[{_WHITE}]")
_MARKED = re.compile(r"[\W_]*[^\W_]+|[\W_]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_symbol() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes are themselves, others follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class _Cache(dict):
    def __init__(self, encode, most: int | None = None) -> None:
        self.encode, self.most = encode, most or CACHE_CHUNKS

    def __missing__(self, key: str):
        if len(self) >= self.most:
            self.clear()
        self[key] = ids = self.encode(key)
        return ids


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        self.special = {x["content"]: array("I", [x["id"]]).tobytes() for x in described.get("added_tokens", [])}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        symbols = _byte_of_symbol()
        vocabulary = {bytes(symbols[c] for c in k): v for k, v in described["model"]["vocab"].items() if k not in self.special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value of byte-level pre-tokenizers
        fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=vocabulary, special_tokens={})
        self._after_space = _Cache(lambda w: self.special.get(w) or array("I", fast.encode_ordinary(" " + w)).tobytes())
        self.counts = _Cache(lambda w: 1 if w in self.special else len(fast.encode_ordinary(w)), CACHE_COUNTS)  # tokens by chunk
        self._chunk = _Cache(lambda w: self.special.get(w) or array("I", fast.encode_ordinary(w)).tobytes())

    def _special_in(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def chunks(self, text: str) -> list[str]:
        """The text in pieces that can be encoded apart."""
        out: list[str] = []
        for part in self._cut.split(text) if self._special_in(text) else (text,):
            if part in self.special:
                out.append(part)
                continue
            found = _CHUNK.findall(part)
            if max(map(len, found), default=0) <= LONG:
                out += found
                continue
            for chunk in found:
                if len(chunk) > LONG:
                    out += _MARKED.findall(chunk)
                else:
                    out.append(chunk)
        return out

    def chunk(self, chunk: str) -> bytes:
        return self._chunk[chunk]

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        if not first or "" in rest or "\n \n" in text or _OTHER_WHITE.search(text) or self._special_in(text):
            return b"".join(map(self._chunk.__getitem__, self.chunks(text)))
        return self._chunk[first] + b"".join(map(self._after_space.__getitem__, rest))


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    """One for each file and process. Without a path the default is looked up here, where it is used."""
    path = path or default_path()
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
