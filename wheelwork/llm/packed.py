"""Arrays packed in binary columns, and rows of a sorted partition taken group by group."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays, each with its type and length before it."""
    return b"".join(struct.pack("<cBI", a.dtype.kind.encode(), a.dtype.itemsize, len(a)) + a.tobytes() for a in arrays)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, size, n = struct.unpack_from("<cBI", data, at)
        out.append(np.frombuffer(data, f"<{kind.decode()}{size}", n, at + 6))
        at += 6 + size * n
    return out


def small(gaps: np.ndarray) -> np.ndarray:
    """Whole numbers in 4 bytes each, if all fit, else in 8."""
    if not len(gaps) or int(gaps.max()) < 1 << 32:
        return gaps.astype("<u4")
    return gaps.astype("<u8")


def record(rows, names: list[str], kinds: list) -> pa.RecordBatch:
    """Tuples as a record batch."""
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def groups(batches, key: str):
    """Rows of a partition sorted by ``key``, group by group, as lists of dicts."""
    group, now = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if row[key] != now and group:
                yield group
                group = []
            now = row[key]
            group.append(row)
    if group:
        yield group
