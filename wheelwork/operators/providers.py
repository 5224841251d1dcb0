"""Sources of population, demand and elevation behind one interface, and the graph and gap evaluation built on them.

A provider answers for whole tables: polygons (``zone``, ``rings``) or points (``id``, ``x``, ``y``) in,
one row each out. ``GraphBuilder`` and ``GapEvaluator`` hold input tables and options and compose the operators.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wheelwork.functions import tags as T
from wheelwork.functions.geo import cell, geodesic
from wheelwork.functions.shapes import bounds, inside_points, overlap_area, polygon_area, side_near
from wheelwork.operators import evaluation, gaps, network
from wheelwork.operators.rasters import values_at, zonal_sums
from wheelwork.operators.spatial import count_in_disc


class Population(Protocol):
    def in_polygons(self, zones: DataFrame) -> DataFrame:
        """zone, total."""

    def at_points(self, points: DataFrame) -> DataFrame:
        """id, value."""


class Demand(Protocol):
    def demand_at(self, points: DataFrame) -> DataFrame:
        """id, starts, ends."""


def squares_of(zones: DataFrame, size: float, zone: str = "zone") -> DataFrame:
    """Each polygon once for every square (cx, cy) that its bounds touch."""
    known = zones.where(F.size(F.get("rings", F.lit(0))) > 2).withColumn("_b", bounds(F.col("rings")))
    steps = lambda a, b: F.sequence(cell(F.col(a), size), cell(F.col(b), size))
    return known.withColumn("cx", F.explode(steps("_b.x0", "_b.x1"))).withColumn("cy", F.explode(steps("_b.y0", "_b.y1")))


#: Places in a square of the finest grid, about; more make the grid finer.
PLACES = 8


def _marked(squares: DataFrame, size: float) -> DataFrame:
    """Open squares (cx, cy; ``mark`` 2) looked at: 2 if a side of the polygon comes near, 1 if all of it is inside; others go."""
    x, y, half = (F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size, F.lit(size / 2 * (1 + 1e-6))
    near = F.exists("rings", lambda r: side_near(r, x, y, half))
    inside = F.aggregate(F.transform("rings", lambda r: inside_points(x, y, r)), F.lit(False), lambda s, v: s != v)
    return squares.withColumn("mark", F.when(F.col("mark") == 1, 1).when(near, 2).when(inside, 1).otherwise(0)).where("mark > 0")


def points_in(zones: DataFrame, points: DataFrame, size: float) -> DataFrame:
    """zone, n: how many points (x, y) lie in each polygon and in none of its holes; equal places are counted before they are compared.

    Squares that no side comes near count as a whole. Those on a side are cut into 16, as often as
    leaves some ``PLACES`` places in one, and only there places are compared one by one: for a zone
    this grows with the root of the places, not with their number.
    """
    places = points.groupBy("x", "y").agg(F.count("*").alias("_n"))
    at = lambda level: [cell(F.col(c), size / 4**level).alias(f"c{c}") for c in ("x", "y")]
    held = places.select(*at(0)).groupBy("cx", "cy").agg(F.count("*").alias("n")).agg(F.avg("n").alias("n")).first()["n"] or 1
    depth = max(0, min(12, round(math.log(held / PLACES, 16))))
    counted = lambda level: places.select(*at(level), "_n").groupBy("cx", "cy").agg(F.sum("_n").alias("n"))
    # small rows that much work follows: as many tasks as a shuffle has, which are not joined again
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    squares = squares_of(zones, size).join(counted(0), ["cx", "cy"]).repartition(tasks, "zone", "cx", "cy")
    known = _marked(squares.select("zone", "rings", "cx", "cy", "n", F.lit(2).alias("mark")), size)
    for level in range(1, depth + 1):
        # whole squares go on as they are
        parts = counted(level).select(F.shiftright("cx", 2).alias("cx"), F.shiftright("cy", 2).alias("cy"), F.lit(2).alias("mark"), F.col("cx").alias("_x"), F.col("cy").alias("_y"), F.col("n").alias("_n"))
        cut = known.join(parts, ["cx", "cy", "mark"], "left")
        known = _marked(cut.select("zone", "rings", F.coalesce("_x", "cx").alias("cx"), F.coalesce("_y", "cy").alias("cy"), F.coalesce("_n", "n").alias("n"), "mark"), size / 4**level)
    inside = F.aggregate(F.transform("rings", lambda r: inside_points(F.col("x"), F.col("y"), r)), F.lit(False), lambda s, v: s != v)
    last = known.join(places.select(*at(depth), F.lit(2).alias("mark"), "x", "y", "_n"), ["cx", "cy", "mark"], "left")
    found = last.groupBy("zone").agg(F.sum(F.when(F.col("mark") == 1, F.col("n")).when(inside, F.col("_n")).otherwise(F.lit(0))).alias("n"))
    return zones.select("zone").distinct().join(found, "zone", "left").select("zone", F.coalesce("n", F.lit(0)).alias("n"))


@dataclass
class RasterPopulation:
    """Population (or elevation) of raster files: ``tiles`` is ``sources.rasters.tiles``."""

    tiles: DataFrame

    def in_polygons(self, zones: DataFrame) -> DataFrame:
        return zonal_sums(self.tiles, zones)

    def at_points(self, points: DataFrame) -> DataFrame:
        return values_at(self.tiles, points).select("id", "value")

    def demand_at(self, points: DataFrame) -> DataFrame:
        """Demand in proportion to the population: as many starts as ends."""
        return self.at_points(points).select("id", F.col("value").alias("starts"), F.col("value").alias("ends"))


@dataclass
class DistrictPopulation:
    """Population of districts (district, population, rings; a row a polygon), spread evenly over a district's polygons."""

    districts: DataFrame
    size: float

    def in_polygons(self, zones: DataFrame) -> DataFrame:
        whole = self.districts.groupBy("district").agg(F.sum(polygon_area(F.col("rings"))).alias("_area"), F.max("population").alias("_people"))
        own = squares_of(self.districts.select("district", "rings"), self.size).select("district", F.col("rings").alias("_other"), F.col("_b").alias("_o"), "cx", "cy")
        near = squares_of(zones, self.size).join(own, ["cx", "cy"])
        # a pair meets in several squares; the one that holds the lower left corner of what both bounds share counts
        here = (cell(F.greatest("_b.x0", "_o.x0"), self.size) == F.col("cx")) & (cell(F.greatest("_b.y0", "_o.y0"), self.size) == F.col("cy"))
        shared = near.where(here).select("zone", "district", overlap_area(F.col("rings"), F.col("_other")).alias("_s")).groupBy("zone", "district").agg(F.sum("_s").alias("_s"))
        total = shared.join(whole, "district").groupBy("zone").agg(F.sum(F.col("_s") / F.nullif("_area", F.lit(0.0)) * F.col("_people")).alias("total"))
        return zones.select("zone").distinct().join(total, "zone", "left").select("zone", F.coalesce("total", F.lit(0.0)).alias("total"))

    def at_points(self, points: DataFrame) -> DataFrame:
        """The population of the district that a point lies in, 0 outside all; of several the greatest."""
        placed = points.select("id", "x", "y").withColumn("cx", cell(F.col("x"), self.size)).withColumn("cy", cell(F.col("y"), self.size))
        inside = F.aggregate(F.transform("rings", lambda r: inside_points(F.col("x"), F.col("y"), r)), F.lit(False), lambda s, x: s != x)
        found = placed.join(squares_of(self.districts, self.size), ["cx", "cy"]).where(inside).groupBy("id").agg(F.max("population").alias("value"))
        return points.select("id").join(found, "id", "left").select("id", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))


@dataclass
class TripDemand:
    """Demand by trips: starts and ends (x, y) within ``radius`` of a point, or in a polygon."""

    starts: DataFrame
    ends: DataFrame
    radius: float

    def demand_at(self, points: DataFrame) -> DataFrame:
        count = lambda trips, name: count_in_disc(points.select("id", "x", "y"), trips, "id", self.radius).withColumnRenamed("n", name)
        return count(self.starts, "starts").join(count(self.ends, "ends"), "id")

    def demand_in(self, zones: DataFrame) -> DataFrame:
        count = lambda trips, name: points_in(zones, trips, self.radius).withColumnRenamed("n", name)
        return count(self.starts, "starts").join(count(self.ends, "ends"), "zone")


@dataclass
class GraphBuilder:
    """Street graphs of map tables: ways (osmid, tags, nodes), nodes (node, x, y as degrees), turn rules (osmid_in, osmid_out, restriction), elevation."""

    ways: DataFrame
    nodes: DataFrame
    restrictions: DataFrame | None = None
    elevation: RasterPopulation | None = None
    model: list = field(default_factory=lambda: T.MODEL_1)

    def edges(self) -> DataFrame:
        """Priced edges: one-way rules of bicycles applied, length on the spheroid, slope end to end (0 without elevation)."""
        pieces = network.segments(self.ways, self.nodes)
        key = F.row_number().over(Window.partitionBy("u", "v").orderBy("osmid", "reversed")) - 1
        lanes = network.close_oneways(network.open_oneways(pieces.withColumn("key", key)))
        out = lanes.withColumn("length", geodesic(F.col("ux"), F.col("uy"), F.col("vx"), F.col("vy")))
        if self.elevation is None:
            out = out.withColumn("slope_percentage", F.lit(0.0))
        else:
            height = self.elevation.at_points(self.nodes.withColumnRenamed("node", "id"))
            end = lambda c: height.select(F.col("id").alias(c), F.col("value").alias(f"_{c}"))
            rise = F.coalesce(F.col("_v") - F.col("_u"), F.lit(0.0))
            slope = network.edge_slope(F.col("tags"), F.array().cast("array<double>"), rise, F.nullif("length", F.lit(0.0)))
            out = out.join(end("u"), "u", "left").join(end("v"), "v", "left").withColumn("slope_percentage", F.coalesce(slope, F.lit(0.0))).drop("_u", "_v")
        return network.edge_weights(out, self.model)

    def turns(self, edges: DataFrame) -> DataFrame:
        found = network.turn_edges(edges)
        return network.enforce_restrictions(found, self.restrictions) if self.restrictions is not None else found


@dataclass
class GapEvaluator:
    """Measures of gaps (gap_id, u, v, key, length, betweenness) against a network of infrastructure (u, v, key, length).

    ``cells`` (gap_id, cell) are what each gap makes reachable, ``covered`` (cell) what is reachable already,
    ``people`` (cell, population). Each group of measures is there if its option is on.
    """

    network: DataFrame
    cells: DataFrame | None = None
    covered: DataFrame | None = None
    people: DataFrame | None = None
    cell_area: float = 1.0
    connectedness: bool = True
    coverage: bool = True
    population: bool = True

    def metrics(self, gap_edges: DataFrame) -> DataFrame:
        more = [evaluation.components_after(gap_edges, self.network)] if self.connectedness else []
        if self.cells is not None and (self.coverage or self.population):
            added = evaluation.added_by(self.cells, self.covered, self.people, self.cell_area)
            more.append(added.select("gap_id", *(["added_area"] if self.coverage else []), *(["added_population"] if self.population else [])))
        return gaps.metrics(gap_edges, *more)


def chosen(edges: DataFrame, attributes: list[str], geometry: str = "geometry") -> DataFrame:
    """u, v, key, the attributes and the geometry; one that the edges lack is null (NaN among numbers)."""
    have = set(edges.columns)
    return edges.select("u", "v", "key", *[F.col(f"`{a}`") if a in have else F.lit(None).cast("double").alias(a) for a in dict.fromkeys([*attributes, geometry])])


def edge_of_way(edges: DataFrame, ways: DataFrame) -> DataFrame:
    """osmid, n, edge (u, v, key): the one edge of each way asked for (osmid); null where there is none or more than one."""
    found = edges.join(ways.select("osmid").distinct(), "osmid").groupBy("osmid").agg(F.count("*").alias("n"), F.min(F.struct("u", "v", "key")).alias("_e"))
    return ways.select("osmid").distinct().join(found, "osmid", "left").select("osmid", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("_e")).alias("edge"))


def node_points(nodes: DataFrame) -> DataFrame:
    """node, osmid, x, y: the shifted place of nodes, or where one of its coordinates is missing the plain one."""
    both = F.col("x_shifted").isNotNull() & F.col("y_shifted").isNotNull()
    return nodes.select("node", "osmid", F.when(both, F.col("x_shifted")).otherwise(F.col("x")).alias("x"), F.when(both, F.col("y_shifted")).otherwise(F.col("y")).alias("y"))


def one_node_a_place(nodes: DataFrame) -> DataFrame:
    """Of nodes with one osmid (the halves of a split crossing) the smallest."""
    return nodes.groupBy("osmid").agg(F.min(F.struct("node", *[c for c in nodes.columns if c not in ("node", "osmid")])).alias("n")).select("osmid", "n.*")


def drawn(edges: DataFrame) -> DataFrame:
    """Edges with a shifted line, and the colour of their direction unless they have one: red back, blue forth, green at crossings."""
    way = F.when(F.col("reversed").isNull(), "green").when(F.col("reversed"), "red").otherwise("blue")
    colour = F.coalesce("color", way) if "color" in edges.columns else way
    return edges.where("shifted_geometry IS NOT NULL").withColumn("color", colour)
