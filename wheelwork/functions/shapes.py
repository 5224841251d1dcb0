"""Rings and polygons as column expressions: area, bounds, clipping by boxes and by half planes.

A ring is an array of struct(x, y) without its first point repeated at the end; a polygon
is an array of rings, the outer one first and then its holes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
RING = f"array<{POINT}>"


def open_ring(points: Column) -> Column:
    """Points of a line that comes back to its start, without the last one; others as they are."""
    back = (F.size(points) > 1) & (F.get(points, F.lit(0)) == F.get(points, F.size(points) - 1))
    return F.when(back, F.slice(points, 1, F.size(points) - 1)).otherwise(points)


def _followers(ring: Column) -> Column:
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def ring_area(ring: Column) -> Column:
    """Area inside a ring, whichever way it runs; null is 0."""
    twice = F.aggregate(F.zip_with(ring, _followers(ring), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, d: s + d)
    return F.coalesce(F.abs(twice) / 2, F.lit(0.0))


def inside_points(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies inside a ring of a column, by ray casting."""
    def crosses(p, q):
        # the slope is asked for only where the ends' heights differ
        at = (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"]
        return F.coalesce(((p["y"] > y) != (q["y"] > y)) & (x < at), F.lit(False))

    return F.aggregate(F.zip_with(ring, _followers(ring), crosses), F.lit(False), lambda s, c: s != c)


def side_near(ring: Column, x: Column, y: Column, half: Column) -> Column:
    """Whether a side of the ring touches the square around (x, y) that reaches ``half`` to all sides."""
    def touches(p, q):
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        beside = (F.greatest(p["x"], q["x"]) < x - half) | (F.least(p["x"], q["x"]) > x + half) | (F.greatest(p["y"], q["y"]) < y - half) | (F.least(p["y"], q["y"]) > y + half)
        return ~beside & (F.abs(dx * (y - p["y"]) - dy * (x - p["x"])) <= half * (F.abs(dx) + F.abs(dy)))

    return F.exists(F.zip_with(ring, _followers(ring), touches), lambda t: t)


def polygon_area(rings: Column) -> Column:
    """Area of the outer ring less its holes."""
    return F.aggregate(F.transform(rings, lambda r, i: F.when(i == 0, ring_area(r)).otherwise(-ring_area(r))), F.lit(0.0), lambda s, d: s + d)


def bounds(rings: Column) -> Column:
    """struct(x0, y0, x1, y1) of a polygon's outer ring."""
    of = lambda f, c: f(F.transform(F.get(rings, F.lit(0)), lambda p: p[c]))
    return F.struct(of(F.array_min, "x").alias("x0"), of(F.array_min, "y").alias("y0"), of(F.array_max, "x").alias("x1"), of(F.array_max, "y").alias("y1"))


def _cut(ring: Column, side) -> Column:
    """The ring's part where ``side`` of a point is not negative; a line's own parts along the cut have no area.

    ``side`` is linear in x and y, so a stretch crosses 0 where its ends' values say.
    """
    def stretch(p, q):
        a, b = side(p), side(q)
        t = a / F.nullif(a - b, F.lit(0.0))
        cross = F.struct((p["x"] + (q["x"] - p["x"]) * t).alias("x"), (p["y"] + (q["y"] - p["y"]) * t).alias("y"))
        end = F.struct(q["x"].alias("x"), q["y"].alias("y"))
        return F.when((a >= 0) & (b >= 0), F.array(end)).when(a >= 0, F.array(cross)).when(b >= 0, F.array(cross, end)).otherwise(F.array().cast(RING))

    return F.when(F.size(ring) < 3, F.array().cast(RING)).otherwise(F.flatten(F.zip_with(ring, _followers(ring), stretch)))


def clipped_ring(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The ring's part in a box, as a ring whose area is exact; concave rings may run along the box's sides."""
    plane = lambda a, b, c: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), c.cast("double").alias("c"))
    planes = F.array(plane(1.0, 0.0, -x0), plane(-1.0, 0.0, x1), plane(0.0, 1.0, -y0), plane(0.0, -1.0, y1))
    return F.aggregate(planes, ring, lambda r, h: _cut(r, lambda p: h["a"] * p["x"] + h["b"] * p["y"] + h["c"]))


def clipped(rings: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A polygon's part in a box, ring by ring."""
    return F.transform(rings, lambda r: clipped_ring(r, x0, y0, x1, y1))


def clipped_by_convex(ring: Column, other: Column) -> Column:
    """The part of a ring inside a convex ring that runs counterclockwise."""
    sides = F.zip_with(other, _followers(other), lambda p, q: F.struct((p["y"] - q["y"]).alias("a"), (q["x"] - p["x"]).alias("b"), (p["x"] * q["y"] - q["x"] * p["y"]).alias("c")))
    return F.aggregate(sides, ring, lambda r, h: _cut(r, lambda p: h["a"] * p["x"] + h["b"] * p["y"] + h["c"]))


def square_buffer(x1: Column, y1: Column, x2: Column, y2: Column, by: float) -> Column:
    """A stretch widened by ``by`` on all sides with square ends, as a counterclockwise ring; a point is a square."""
    length = F.sqrt(F.pow(x2 - x1, 2) + F.pow(y2 - y1, 2))
    ux, uy = F.when(length > 0, (x2 - x1) / length).otherwise(1.0) * by, F.when(length > 0, (y2 - y1) / length).otherwise(0.0) * by
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(corner(x1 - ux + uy, y1 - uy - ux), corner(x2 + ux + uy, y2 + uy - ux), corner(x2 + ux - uy, y2 + uy + ux), corner(x1 - ux - uy, y1 - uy + ux))


def _fans(ring: Column) -> Column:
    """A ring as triangles from its first point, each counterclockwise, with the sign it has in the ring."""
    def triangle(i):
        a, b, c = F.get(ring, F.lit(0)), F.get(ring, i), F.get(ring, i + 1)
        twice = (b["x"] - a["x"]) * (c["y"] - a["y"]) - (c["x"] - a["x"]) * (b["y"] - a["y"])
        return F.struct(F.signum(twice).alias("s"), F.when(twice >= 0, F.array(a, b, c)).otherwise(F.array(a, c, b)).alias("t"))

    return F.when(F.size(ring) < 3, F.array().cast(f"array<struct<s:double,t:{RING}>>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(ring) - 2), triangle))


def _ring_overlap(ring: Column, other: Column) -> Column:
    parts = F.transform(_fans(other), lambda f: f["s"] * ring_area(clipped_by_convex(ring, f["t"])))
    return F.abs(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x))


def overlap_area(rings: Column, other: Column) -> Column:
    """Area that two polygons share, exact for any simple rings and holes: one is clipped by the other's triangles, which count by sign."""
    sign = lambda i: F.when(i == 0, 1.0).otherwise(-1.0)
    parts = F.flatten(F.transform(rings, lambda r, i: F.transform(other, lambda o, j: sign(i) * sign(j) * _ring_overlap(r, o))))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
