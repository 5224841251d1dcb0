"""Raster files met by zones and points: tiles first, cells only where they are needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wheelwork.functions.shapes import RING, bounds, clipped, polygon_area
from wheelwork.operators.lineage import written
from wheelwork.sources.rasters import cells


def _boxes(tiles: DataFrame) -> DataFrame:
    """path, tile and the box of each tile."""
    return tiles.select(
        "path", "tile", (F.col("left") + F.col("col") * F.col("dx")).alias("bx0"), (F.col("top") - (F.col("row") + F.col("height")) * F.col("dy")).alias("by0"),
        (F.col("left") + (F.col("col") + F.col("width")) * F.col("dx")).alias("bx1"), (F.col("top") - F.col("row") * F.col("dy")).alias("by1"),
    )


def _squares(df: DataFrame, x0, y0, x1, y1, size: float) -> DataFrame:
    """Each row once for every square (gx, gy) of the grid that its box touches."""
    steps = lambda a, b: F.sequence(F.floor(a / size).cast("bigint"), F.floor(b / size).cast("bigint"))
    return df.withColumn("gx", F.explode(steps(x0, x1))).withColumn("gy", F.explode(steps(y0, y1)))


def _grid(boxes: DataFrame) -> float:
    """A square that no tile is larger than."""
    return boxes.agg(F.max(F.greatest(F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0")))).first()[0] or 1.0


def zonal_sums(tiles: DataFrame, zones: DataFrame, zone: str = "zone", rings: str = "rings") -> DataFrame:
    """zone, total: the sum of the cells of raster files, each by the share of its area in the zone's polygon.

    ``tiles`` is ``sources.rasters.tiles``, ``zones`` has a key and a polygon (see
    ``functions.shapes``). Zones meet tiles by squares of the tiles' size; only tiles that a
    zone touches are read, a zone is clipped to a tile once, and to cells only within what
    that leaves. Several polygons of a key add up; zones beside all files have null.
    """
    tiles = written(tiles, "tiles")
    boxes = _boxes(tiles)
    size = _grid(boxes)
    box = bounds(F.col("_rings"))
    shapes = zones.select(zone, F.col(rings).cast(f"array<{RING}>").alias("_rings")).where("size(_rings) > 0").withColumn("_b", box)
    near = _squares(shapes, F.col("_b.x0"), F.col("_b.y0"), F.col("_b.x1"), F.col("_b.y1"), size)
    spread = _squares(boxes, F.col("bx0"), F.col("by0"), F.col("bx1"), F.col("by1"), size)
    # a pair meets in several squares; the one that holds the lower left corner of what they share counts
    here = (F.floor(F.greatest("_b.x0", "bx0") / size) == F.col("gx")) & (F.floor(F.greatest("_b.y0", "by0") / size) == F.col("gy"))
    touch = (F.col("_b.x0") < F.col("bx1")) & (F.col("bx0") < F.col("_b.x1")) & (F.col("_b.y0") < F.col("by1")) & (F.col("by0") < F.col("_b.y1"))
    part = clipped(F.col("_rings"), F.col("bx0"), F.col("by0"), F.col("bx1"), F.col("by1"))
    pairs = near.join(spread, ["gx", "gy"]).where(here & touch).select(zone, "path", "tile", part.alias("_rings")).where("size(_rings[0]) > 2")
    pairs = written(pairs, "pairs")
    read = cells(tiles.join(pairs.select("path", "tile").distinct(), ["path", "tile"], "left_semi"))
    cut = tiles.select("path", "tile", "left", "top", "dx", "dy", F.col("col").alias("_c"), F.col("row").alias("_r"), "width", "height")
    inside = pairs.join(cut, ["path", "tile"]).withColumn("_b", bounds(F.col("_rings")))
    steps = lambda a, b, first, n: F.sequence(F.greatest(F.floor(a).cast("bigint"), F.col(first)), F.least(F.floor(b).cast("bigint"), F.col(first) + F.col(n) - 1))
    across = steps((F.col("_b.x0") - F.col("left")) / F.col("dx"), (F.col("_b.x1") - F.col("left")) / F.col("dx"), "_c", "width")
    down = steps((F.col("top") - F.col("_b.y1")) / F.col("dy"), (F.col("top") - F.col("_b.y0")) / F.col("dy"), "_r", "height")
    wanted = inside.select(zone, "path", "tile", "_rings", F.explode(across).alias("col"), down.alias("_rows")).select(zone, "path", "tile", "_rings", "col", F.explode("_rows").alias("row"))
    share = polygon_area(clipped(F.col("_rings"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))) / ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    sums = wanted.join(read, ["path", "tile", "col", "row"]).groupBy(zone).agg(F.sum(F.col("value") * share).alias("total"))
    return zones.select(zone).distinct().join(sums, zone, "left")


def values_at(tiles: DataFrame, points: DataFrame) -> DataFrame:
    """``points`` (x, y and more) with ``value`` of the cell they lie in, null beside all files; of several files the greatest path's.

    Places are looked up once, however many points lie there.
    """
    tiles = written(tiles, "tiles")
    boxes = _boxes(tiles)
    size = _grid(boxes)
    places = points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)").distinct()
    near = places.withColumn("gx", F.floor(F.col("x") / size).cast("bigint")).withColumn("gy", F.floor(F.col("y") / size).cast("bigint"))
    spread = _squares(boxes, F.col("bx0"), F.col("by0"), F.col("bx1"), F.col("by1"), size)
    # a cell holds its left and lower side
    inside = (F.col("x") >= F.col("bx0")) & (F.col("x") < F.col("bx1")) & (F.col("y") >= F.col("by0")) & (F.col("y") < F.col("by1"))
    found = written(near.join(spread, ["gx", "gy"]).where(inside).select("x", "y", "path", "tile"), "found")
    read = cells(tiles.join(found.select("path", "tile").distinct(), ["path", "tile"], "left_semi"))
    how = tiles.select("path", "tile", "left", "top", "dx", "dy")
    col, row = F.floor((F.col("x") - F.col("left")) / F.col("dx")), F.ceil((F.col("top") - F.col("y")) / F.col("dy")) - 1
    placed = found.join(how, ["path", "tile"]).select("x", "y", "path", "tile", col.cast("bigint").alias("col"), row.cast("bigint").alias("row"))
    values = placed.join(read.select("path", "tile", "col", "row", "value"), ["path", "tile", "col", "row"]).groupBy("x", "y").agg(F.max_by("value", "path").alias("value"))
    return points.join(values, ["x", "y"], "left").select(*points.columns, "value")
