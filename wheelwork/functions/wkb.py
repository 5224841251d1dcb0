"""Well-known binary: geometries to bytes and back, Arrow batch by batch.

A geometry is struct(kind, parts): ``kind`` as the format numbers it (1 point, 2 line, 3
polygon, 4 to 6 several of these, 7 a collection), ``parts`` an array of arrays of arrays of
struct(x, y): parts, rings of a part, points of a ring. A point and a line have one ring; rings
of polygons repeat their first point. Both byte orders are read, heights and measures are skipped, a
leading number of the reference system too. A collection's members are parts side by side.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

GEOMETRY = "struct<kind:int,parts:array<array<array<struct<x:double,y:double>>>>>"
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
ARROW = pa.struct([("kind", pa.int32()), ("parts", pa.list_(pa.list_(pa.list_(_POINT))))])


def geometry(kind: int, parts: Column) -> Column:
    return F.struct(F.lit(kind).cast("int").alias("kind"), parts.cast("array<array<array<struct<x:double,y:double>>>>").alias("parts"))


def point(x: Column, y: Column) -> Column:
    return geometry(1, F.array(F.array(F.array(F.struct(x.alias("x"), y.alias("y"))))))


def line(points: Column) -> Column:
    return geometry(2, F.array(F.array(points)))


def polygon(rings: Column) -> Column:
    """Of open rings (without the first point again)."""
    return geometry(3, F.array(F.transform(rings, lambda r: F.concat(r, F.slice(r, 1, 1)))))


def lines(each: Column) -> Column:
    return geometry(5, F.transform(each, lambda points: F.array(points)))


def polygons(each: Column) -> Column:
    return geometry(6, F.transform(each, lambda rings: F.transform(rings, lambda r: F.concat(r, F.slice(r, 1, 1)))))


def _points(ring, order: str) -> bytes:
    return np.array([(p["x"], p["y"]) for p in ring], f"{order}f8").tobytes()


def encoded(kind: int, parts: list, order: str) -> bytes:
    head = b"\1" if order == "<" else b"\0"
    count = lambda n: struct.pack(f"{order}I", n)
    if kind in (4, 5, 6):
        return head + count(kind) + count(len(parts)) + b"".join(encoded(kind - 3, [p], order) for p in parts)
    head += count(kind)
    rings = parts[0] if parts else []
    if kind == 1:
        return head + (_points(rings[0], order) if rings and rings[0] else np.full(2, np.nan, f"{order}f8").tobytes())
    if kind == 2:
        ring = rings[0] if rings else []
        return head + count(len(ring)) + _points(ring, order)
    if kind == 3:
        return head + count(len(rings)) + b"".join(count(len(r)) + _points(r, order) for r in rings)
    raise ValueError(f"geometries of kind {kind} are not written")


def decoded(data: bytes, at: int = 0) -> tuple[int, list, int]:
    """Kind, parts and the end of the geometry that begins at a place."""
    order = "<" if data[at] else ">"
    number = lambda place: struct.unpack_from(f"{order}I", data, place)[0]
    code = number(at + 1)
    at += 9 if code & 0x20000000 else 5
    size = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
    kind = code & 0x0FFFFFFF
    size += (0, 1, 1, 2)[kind // 1000] if kind >= 1000 else 0
    kind %= 1000

    def points(place, n):
        xy = np.frombuffer(data, f"{order}f8", n * size, place).reshape(n, size)[:, :2].tolist()
        return [{"x": x, "y": y} for x, y in xy], place + 8 * n * size

    if kind == 1:
        ring, at = points(at, 1)
        return kind, [] if ring[0]["x"] != ring[0]["x"] else [[ring]], at
    if kind == 2:
        ring, at = points(at + 4, number(at))
        return kind, [[ring]], at
    if kind == 3:
        n, at, rings = number(at), at + 4, []
        for _ in range(n):
            ring, at = points(at + 4, number(at))
            rings.append(ring)
        return kind, [rings], at
    if kind in (4, 5, 6, 7):
        n, at, parts = number(at), at + 4, []
        for _ in range(n):
            _, more, at = decoded(data, at)
            parts += more
        return kind, parts, at
    raise ValueError(f"a geometry of kind {kind} is not known")


def to_wkb(geom: Column, little: bool = True) -> Column:
    order = "<" if little else ">"

    @F.arrow_udf("binary")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if g is None or g["kind"] is None else encoded(g["kind"], g["parts"] or [], order) for g in values.to_pylist()], pa.binary())

    return run(geom)


def from_wkb(data: Column) -> Column:
    @F.arrow_udf(GEOMETRY)
    def run(values: pa.Array) -> pa.Array:
        out = []
        for b in values.to_pylist():
            kind, parts, _ = decoded(b) if b else (None, None, 0)
            out.append(None if kind is None else {"kind": kind, "parts": parts})
        return pa.array(out, ARROW)

    return run(data)
