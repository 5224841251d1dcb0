"""Spatial joins through grid cells: points in zones, nearest node, counts in discs, raster sums."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wheelwork.functions.geo import cell, crosses_ring, in_ring, planar, segmentize, strictly_in
from wheelwork.functions.shapes import RING, inside_points, open_ring, ring_area
from wheelwork.operators.chains import stitched
from wheelwork.operators.lineage import drop_written, written


def flag_zones(points: DataFrame, x: str, y: str, zones: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """A boolean column per zone: strictly inside its ring. The rings are part of the plan; no join."""
    out = points
    for name, ring in zones.items():
        xs, ys = [p[0] for p in ring], [p[1] for p in ring]
        box = F.col(x).between(min(xs), max(xs)) & F.col(y).between(min(ys), max(ys))
        out = out.withColumn(name, F.coalesce(box & strictly_in(F.col(x), F.col(y), ring), F.lit(False)))
    return out


def with_neighbour_cells(points: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """Each point once for its own and each of the eight neighbouring cells (cx, cy)."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return points.withColumn("_s", F.explode(steps)).withColumn("cx", cell(F.col(x), size) + F.col("_s.i")).withColumn("cy", cell(F.col(y), size) + F.col("_s.j")).drop("_s")


def count_in_disc(centres: DataFrame, points: DataFrame, key: str, radius: float) -> DataFrame:
    """Per centre, the number of points within ``radius`` (equi join on cells of that size).

    Points are first counted per exact place, so a hot place is one row.
    """
    places = points.groupBy("x", "y").agg(F.count("*").alias("_n")).withColumn("cx", cell(F.col("x"), radius)).withColumn("cy", cell(F.col("y"), radius))
    near = with_neighbour_cells(centres.select(key, F.col("x").alias("_x"), F.col("y").alias("_y")), "_x", "_y", radius)
    hits = near.join(places, ["cx", "cy"]).where(planar(F.col("_x"), F.col("_y"), F.col("x"), F.col("y")) <= radius).groupBy(key).agg(F.sum("_n").alias("n"))
    return centres.select(key).join(hits, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def nearest(points: DataFrame, nodes: DataFrame, key: str, node: str, size: float) -> DataFrame:
    """The nearest node of each point, ties by node; exact.

    Nodes within one cell are searched first; a point whose best distance is beyond the
    cell size goes on with cells of twice the size, until all are settled. Without nodes,
    or where a coordinate is null or not finite, the node is null.
    """
    finite = (F.abs("x") < math.inf) & (F.abs("y") < math.inf)
    nodes = nodes.where(finite)
    left = points.select("x", "y").where(finite).distinct()
    if nodes.isEmpty():
        left = left.limit(0)
    done = None
    while True:
        near = with_neighbour_cells(left.select(F.col("x").alias("_x"), F.col("y").alias("_y")), "_x", "_y", size)
        spots = nodes.select(F.col(node).alias("_node"), F.col("x").alias("_nx"), F.col("y").alias("_ny")).withColumn("cx", cell(F.col("_nx"), size)).withColumn("cy", cell(F.col("_ny"), size))
        d = planar(F.col("_x"), F.col("_y"), F.col("_nx"), F.col("_ny"))
        best = near.join(spots, ["cx", "cy"]).groupBy("_x", "_y").agg(F.min(F.struct(d.alias("d"), F.col("_node"))).alias("_b"))
        settled = written(best.where(F.col("_b.d") <= size).select(F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("_b._node").alias(node), F.col("_b.d").alias("distance")))
        done = settled if done is None else done.unionAll(settled)
        old, left = left, written(left.join(settled.select("x", "y"), ["x", "y"], "left_anti"), "left")
        if hasattr(old, "written_to"):
            drop_written(old)
        if left.isEmpty():
            break
        size *= 2
    return points.select(key, "x", "y").join(done, ["x", "y"], "left").select(key, node, "distance")


def ways_with_node_in(ways: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """Ways of which a node (``nodes``: array of struct x, y) lies strictly inside the ring."""
    return ways.where(F.exists("nodes", lambda n: F.coalesce(strictly_in(n["x"], n["y"], ring), F.lit(False))))


def with_area(edges: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """Straight edges (x1, y1, x2, y2) with ``contained`` and ``touching``: wholly inside the ring, or partly."""
    a, b = in_ring(F.col("x1"), F.col("y1"), ring), in_ring(F.col("x2"), F.col("y2"), ring)
    crossing = crosses_ring(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), ring)
    return edges.withColumn("contained", a & b & ~crossing).withColumn("touching", a | b | crossing)


def nearest_edge_areas(edges: DataFrame, cells: DataFrame, edge: str, size: float, step: float) -> DataFrame:
    """edge, area: the area of the cells (cx, cy) whose centre is nearest to each edge.

    Edges stand for points at most ``step`` apart, so the share of an edge is exact up to
    that; ties go to the smallest edge, edges without a cell have no row.
    """
    spots = edges.select(edge, F.explode(segmentize(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), step)).alias("_p")).select(edge, "_p.x", "_p.y")
    centres = cells.select(F.struct("cx", "cy").alias("_cell"), ((F.col("cx") + 0.5) * size).alias("x"), ((F.col("cy") + 0.5) * size).alias("y"))
    return nearest(centres, spots, "_cell", edge, size).where(F.col(edge).isNotNull()).groupBy(edge).agg((F.count("*") * size * size).alias("area"))


def zonal_sum(raster: DataFrame, zones: DataFrame, zone: str, value: str, dx: float, dy: float) -> DataFrame:
    """Per rectangular zone, the sum of cell values weighted by the share of the cell inside.

    ``raster`` has col, row, value (cell [col*dx, (col+1)*dx)); zones have x0, y0, x1, y1.
    Zones are expanded to the cells they touch, then joined by cell.
    """
    touched = zones.select(
        zone, "x0", "y0", "x1", "y1",
        F.explode(F.sequence(F.floor(F.col("x0") / dx).cast("bigint"), F.floor(F.col("x1") / dx).cast("bigint"))).alias("col"),
    ).withColumn("row", F.explode(F.sequence(F.floor(F.col("y0") / dy).cast("bigint"), F.floor(F.col("y1") / dy).cast("bigint"))))
    inside = lambda lo, hi, c, d: F.greatest(F.least(F.col(hi), (F.col(c) + 1) * d) - F.greatest(F.col(lo), F.col(c) * d), F.lit(0.0)) / d
    share = inside("x0", "x1", "col", dx) * inside("y0", "y1", "row", dy)
    return touched.join(raster, ["col", "row"]).groupBy(zone).agg(F.sum(F.col(value) * share).alias("total"))


def rings(members: DataFrame) -> DataFrame:
    """relation, role, ring, nodes: closed rings of each relation's ways (relation, role, way, nodes).

    Ways are turned round where needed; what does not close is left out. A relation's outer
    rings less its inner ones are its area. A relation of any number of ways is spread over tasks
    (see ``chains.stitched``).
    """
    lines = stitched(members, ["relation", "role"]).where("closed").drop("closed")
    number = F.row_number().over(Window.partitionBy("relation", "role").orderBy("line")) - 1
    return lines.select("relation", "role", number.alias("ring"), "nodes")


def ring_points(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """relation, role, ring, points: rings with places (``nodes`` has node, x, y), the first point not again at the end; rings with a node that has no place are left out."""
    corners = found.select("relation", "role", "ring", F.size("nodes").alias("n"), F.posexplode("nodes").alias("i", "node")).join(nodes.select("node", "x", "y"), "node")
    turn = corners.groupBy("relation", "role", "ring", "n").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("p")).where("size(p) = n")
    return turn.select("relation", "role", "ring", open_ring(F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y")))).alias("points"))


def relation_areas(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """relation, area: planar area of the outer rings less that of the inner ones; ``nodes`` has node, x, y."""
    sign = F.when(F.col("role") == "inner", -1.0).otherwise(1.0)
    return ring_points(rings(members), nodes).groupBy("relation").agg(F.sum(sign * ring_area(F.col("points"))).alias("area"))


def polygons(found: DataFrame) -> DataFrame:
    """relation, ring, rings: one polygon an outer ring of ``ring_points``, with the inner rings of the relation that begin inside it as holes."""
    outer = found.where("role <> 'inner'").select("relation", F.struct("role", "ring").alias("_o"), "points")
    first = F.get("points", F.lit(0))
    holes = found.where("role = 'inner'").select("relation", F.col("ring").alias("_hole"), F.col("points").alias("_h"), first["x"].alias("_x"), first["y"].alias("_y"))
    held = outer.join(holes, "relation").where(inside_points(F.col("_x"), F.col("_y"), F.col("points"))).groupBy("relation", "_o").agg(F.transform(F.array_sort(F.collect_list(F.struct("_hole", "_h"))), lambda s: s["_h"]).alias("_holes"))
    number = F.row_number().over(Window.partitionBy("relation").orderBy("_o")) - 1
    return outer.join(held, ["relation", "_o"], "left").select("relation", number.alias("ring"), F.concat(F.array("points"), F.coalesce("_holes", F.array().cast(f"array<{RING}>"))).alias("rings"))


def areas(relations: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """relation, ring, rings: the polygons of map relations (id, members) from their ways (id, nodes) and nodes (id, lon, lat)."""
    parts = relations.select(F.col("id").alias("relation"), F.explode("members").alias("m")).where("m.kind = 'way'").select("relation", F.when(F.col("m.role") == "inner", "inner").otherwise("outer").alias("role"), F.col("m.ref").alias("way")).distinct()
    members = parts.join(ways.select(F.col("id").alias("way"), "nodes"), "way")
    return polygons(ring_points(rings(members), nodes.select(F.col("id").alias("node"), F.col("lon").alias("x"), F.col("lat").alias("y"))))


def way_areas(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """relation (the way's number), ring, rings: closed ways as polygons."""
    closed = ways.where((F.size("nodes") > 3) & (F.get("nodes", F.lit(0)) == F.get("nodes", F.size("nodes") - 1)))
    found = closed.select(F.col("id").alias("relation"), F.lit("outer").alias("role"), F.lit(0).alias("ring"), "nodes")
    return polygons(ring_points(found, nodes.select(F.col("id").alias("node"), F.col("lon").alias("x"), F.col("lat").alias("y"))))


def degrees_for(metres: float, lat: float = 49.45) -> tuple[float, float]:
    """Degrees of longitude and latitude that make up some metres near a latitude."""
    return metres / (111_320 * math.cos(math.radians(lat))), metres / 111_320
