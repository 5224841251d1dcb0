"""Geometry as column arithmetic: distances, projection, bearings, points in polygons, WKT."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6371008.8


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH * F.asin(F.sqrt(h))


def geodesic(lon1: Column, lat1: Column, lon2: Column, lat2: Column, rounds: int = 20) -> Column:
    """Metres along the shortest line on the WGS84 spheroid (inverse problem by iteration, ``rounds`` of them).

    To the millimetre but for nearly opposite points, where the iteration does not settle: those are null.
    """
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    u1, u2, apart = F.atan((1 - f) * F.tan(F.radians(lat1))), F.atan((1 - f) * F.tan(F.radians(lat2))), F.radians(F.pmod(lon2 - lon1 + 180, F.lit(360.0)) - 180)
    known = F.struct(F.sin(u1).alias("s1"), F.cos(u1).alias("c1"), F.sin(u2).alias("s2"), F.cos(u2).alias("c2"), apart.alias("l"))

    def arc(k, lam):
        """Sine and cosine of the arc, squared cosine of its azimuth at the equator, sine of it, cosine of twice the middle."""
        sin = F.sqrt(F.pow(k["c2"] * F.sin(lam), 2) + F.pow(k["c1"] * k["s2"] - k["s1"] * k["c2"] * F.cos(lam), 2))
        cos = k["s1"] * k["s2"] + k["c1"] * k["c2"] * F.cos(lam)
        side = F.coalesce(k["c1"] * k["c2"] * F.sin(lam) / F.nullif(sin, F.lit(0.0)), F.lit(0.0))
        square = 1 - side * side
        middle = F.when(square > 1e-15, cos - 2 * k["s1"] * k["s2"] / F.nullif(square, F.lit(0.0))).otherwise(0.0)
        return F.struct(sin.alias("sin"), cos.alias("cos"), side.alias("side"), square.alias("square"), middle.alias("middle"))

    def bent(k, x):
        c = f / 16 * x["square"] * (4 + f * (4 - 3 * x["square"]))
        inner = x["middle"] + c * x["cos"] * (-1 + 2 * x["middle"] * x["middle"])
        return k["l"] + (1 - c) * f * x["side"] * (F.atan2(x["sin"], x["cos"]) + c * x["sin"] * inner)

    def length(x):
        square = x["square"] * (a * a - b * b) / (b * b)
        big = 1 + square / 16384 * (4096 + square * (-768 + square * (320 - 175 * square)))
        small = square / 1024 * (256 + square * (-128 + square * (74 - 47 * square)))
        m = x["middle"]
        turn = small * x["sin"] * (m + small / 4 * (x["cos"] * (-1 + 2 * m * m) - small / 6 * m * (-3 + 4 * x["sin"] * x["sin"]) * (-3 + 4 * m * m)))
        return b * big * (F.atan2(x["sin"], x["cos"]) - turn)

    # let-bindings by one-element transforms, so that nothing is written out twice
    let = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    start = lambda k: F.struct(k["l"].alias("lam"), F.lit(1e9).alias("step"))
    step = lambda k: lambda s, _: let(arc(k, s["lam"]), lambda x: let(bent(k, x), lambda lam: F.struct(lam.alias("lam"), F.abs(lam - s["lam"]).alias("step"))))
    settled = lambda k: F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start(k), step(k))
    return let(known, lambda k: let(settled(k), lambda s: F.when(s["step"] < 1e-11, let(arc(k, s["lam"]), length))))


def utm(lon: Column, lat: Column, zone: int = 32) -> tuple[Column, Column]:
    """Easting and northing on GRS80 by the Krueger series (third order)."""
    f = 1 / 298.257222101
    n = f / (2 - f)
    big = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3, 13 / 48 * n**2 - 3 / 5 * n**3, 61 / 240 * n**3)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(alpha, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + 0.9996 * big * x, 0.9996 * big * y


def planar(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt(F.pow(x1 - x2, 2) + F.pow(y1 - y2, 2))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing in degrees, 0 to 360."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))), F.lit(360.0))


def normal_angle(degrees: Column) -> Column:
    """To [-180, 180)."""
    return F.pmod(degrees + 180, F.lit(360.0)) - 180


def turn_direction(angle: Column) -> Column:
    return F.when(angle < -60, "left").when(angle > 60, "right").when(angle.isNotNull(), "straight")


def _less(a: float, b: float) -> float:
    """a - b of coordinates as they are written: 0.8 less 0.9 is -0.1, which floats miss by a last digit."""
    return float(Decimal(str(float(a))) - Decimal(str(float(b))))


def in_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point lies inside a closed ring, by ray casting."""
    inside = F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y1 != y2:
            crosses = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < _less(x2, x1) * (y - y1) / _less(y2, y1) + x1)
            inside = inside != crosses
    return inside


def on_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point lies on a ring's boundary."""
    out = F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        line = (x - x1) * _less(y2, y1) == (y - y1) * _less(x2, x1)
        out = out | (line & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)))
    return out


def strictly_in(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Inside and not on the boundary."""
    return in_ring(x, y, ring) & ~on_ring(x, y, ring)


def crosses_ring(x1: Column, y1: Column, x2: Column, y2: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a segment crosses a side of the ring: the ends of each lie on two sides of the other."""
    side = lambda ax, ay, bx, by, x, y: (bx - ax) * (y - ay) - (by - ay) * (x - ax) > 0
    out = F.lit(False)
    for (a, b), (c, d) in zip(ring, [*ring[1:], ring[0]], strict=True):
        a, b, c, d = map(F.lit, (a, b, c, d))
        out = out | ((side(x1, y1, x2, y2, a, b) != side(x1, y1, x2, y2, c, d)) & (side(a, b, c, d, x1, y1) != side(a, b, c, d, x2, y2)))
    return out


def ring_area(ring: list[tuple[float, float]]) -> float:
    return abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True))) / 2


def point_wkt(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit("POINT ("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))


def from_wkt(text: Column) -> Column:
    part = lambda i: F.regexp_extract(text, r"^POINT ?\(([-0-9.eE]+) ([-0-9.eE]+)\)$", i).try_cast("double")
    return F.struct(part(1).alias("lon"), part(2).alias("lat"))


def line_length(points: Column) -> Column:
    """Planar length of an array of struct(x, y)."""
    pairs = F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points)), lambda a, b: planar(a["x"], a["y"], b["x"], b["y"]))
    return F.when(F.size(points) < 2, 0.0).otherwise(F.aggregate(pairs, F.lit(0.0), lambda s, d: s + d))


def segmentize(x1: Column, y1: Column, x2: Column, y2: Column, step: float) -> Column:
    """Points along a segment, at most ``step`` apart, both ends included."""
    n = F.greatest(F.ceil(planar(x1, y1, x2, y2) / step), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.struct((x1 + (x2 - x1) * i / n).alias("x"), (y1 + (y2 - y1) * i / n).alias("y")))


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("bigint")
