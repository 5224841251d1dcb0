r"""Byte-level word splitting shared by the Python operators.

A text's words are runs of ASCII letters and digits and all non-ASCII characters,
A-Z lower-cased: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``. In UTF-8 the class is decided
byte by byte, so one 256-entry table and ``bytes.split`` do it.
"""

from __future__ import annotations

import pyarrow as pa


def _table() -> bytes:
    out = bytearray(b" " * 256)
    for b in range(256):
        c = chr(b)
        if b >= 0x80 or "0" <= c <= "9" or "a" <= c <= "z":
            out[b] = b
        elif "A" <= c <= "Z":
            out[b] = b + 32
    return bytes(out)


LOWER_WORDS = _table()


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(LOWER_WORDS).split() if text else []


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 byte strings."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def with_columns(batch: pa.RecordBatch, drop: list[str], more: dict[str, pa.Array]) -> pa.RecordBatch:
    """``batch`` without ``drop``, with the columns ``more`` after the rest."""
    names = [n for n in batch.schema.names if n not in drop]
    arrays = [batch.column(batch.schema.get_field_index(n)) for n in names]
    return pa.RecordBatch.from_arrays([*arrays, *more.values()], [*names, *more])
