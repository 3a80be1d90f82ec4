"""Columns of numbers as binary values: what a task has for one bucket travels as one row."""

from __future__ import annotations

import struct

import numpy as np


def pack(*arrays: np.ndarray) -> bytes:
    parts = [np.ascontiguousarray(a) for a in arrays]
    return struct.pack(f"<{len(parts)}I", *map(len, parts)) + b"".join(a.tobytes() for a in parts)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    """The arrays again, given their dtypes in order."""
    lengths = struct.unpack_from(f"<{len(kinds)}I", blob)
    at, out = 4 * len(kinds), []
    for n, kind in zip(lengths, kinds):
        out.append(np.frombuffer(blob, dtype=kind, count=n, offset=at))
        at += n * out[-1].itemsize
    return out


def slices(keys: np.ndarray):
    """(key, indices) for each distinct key."""
    order = np.argsort(keys, kind="stable")
    cuts = np.nonzero(np.diff(keys[order]))[0] + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(keys[part[0]]), part
