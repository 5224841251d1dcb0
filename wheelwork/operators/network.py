"""Building the routing graph: segments, one-way fixes, slopes, turn edges, restrictions, weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wheelwork.functions import tags as T
from wheelwork.functions.geo import bearing, normal_angle, turn_direction
from wheelwork.operators.chains import simplified


def segments(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ways (osmid, tags, nodes) as edges between consecutive nodes, one per direction that is open."""
    steps = ways.select("osmid", "tags", F.posexplode("nodes").alias("i", "u")).withColumn("v", F.lead("u").over(Window.partitionBy("osmid").orderBy("i"))).where("v IS NOT NULL")
    a, b = nodes.select(F.col("node").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy")), nodes.select(F.col("node").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    placed = steps.join(a, "u").join(b, "v").withColumn("oneway", F.coalesce(T.tag(F.col("tags"), "oneway") == "yes", F.lit(False)))
    there = placed.select("u", "v", "osmid", "tags", "oneway", F.lit(False).alias("reversed"), "ux", "uy", "vx", "vy")
    back = placed.where("NOT oneway").select(F.col("v").alias("u"), F.col("u").alias("v"), "osmid", "tags", "oneway", F.lit(True).alias("reversed"), F.col("vx").alias("ux"), F.col("vy").alias("uy"), F.col("ux").alias("vx"), F.col("uy").alias("vy"))
    return there.unionAll(back)


def open_oneways(edges: DataFrame) -> DataFrame:
    """Adds the way back where a one-way street is open to bicycles both ways; it replaces an edge already there.

    Its ends (u, v; ux, uy, vx, vy) and its ``geometry`` (array of points), where given, are turned round.
    """
    t = F.col("tags")
    both = F.col("oneway") & (T.has(t, "oneway:bicycle", "no") | T.has(t, "cycleway", "opposite"))
    kept = edges.withColumn("oneway", F.col("oneway") & ~both)
    swap = {"u": "v", "v": "u", "ux": "vx", "vx": "ux", "uy": "vy", "vy": "uy"}
    way_back = lambda c: F.reverse(c) if c == "geometry" else F.col(swap.get(c, c))
    added = edges.where(both).select(*[way_back(c).alias(c) for c in edges.columns]).withColumn("oneway", F.lit(False)).withColumn("reversed", F.lit(True))
    return kept.join(added.select("u", "v", "key"), ["u", "v", "key"], "left_anti").select(*edges.columns).unionByName(added)


def close_oneways(edges: DataFrame) -> DataFrame:
    """Drops the way back where bicycles may go one way only."""
    return edges.where(~(T.has(F.col("tags"), "oneway:bicycle", "yes") & F.coalesce("reversed", F.lit(False))))


def robust_slope(slopes, rise, length):
    """Median of the segment slopes without one greatest and one least; end to end for two or fewer."""
    middle = F.slice(F.array_sort(slopes), 2, F.greatest(F.size(slopes) - 2, F.lit(1)))
    n = F.size(middle)
    median = (F.get(middle, F.floor((n - 1) / 2).cast("int")) + F.get(middle, F.floor(n / 2).cast("int"))) / 2
    return F.when(F.size(slopes) > 2, median).otherwise(rise / length * 100)


def slopes_along(elevations, length, degrees=None, step: float = 5.0):
    """Percent slopes of a line's segments from the elevations of its points.

    With ``degrees``, the line's length in degrees, a segment's rise is divided by the
    line's length over the degrees of one ``step`` metres of it, as some published figures
    do (it makes slopes of longer lines nearly 0).
    """
    n = F.size(elevations) - 1
    run = length / n if degrees is None else length / (degrees / (length / step))
    return F.when(n < 1, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: (F.get(elevations, i) - F.get(elevations, i - 1)) / run * 100))


def turn_edges(edges: DataFrame) -> DataFrame:
    """Every in-edge with every out-edge of a node, without turning back on the same geometry.

    Needs u, v, key, osmid, ux, uy, vx, vy (ends of the edge's last and first stretch).
    A node with many edges has many turns; streets have few.
    """
    a = edges.select(*[F.col(c).alias(f"a_{c}") for c in ("u", "v", "key", "osmid", "ux", "uy", "vx", "vy")])
    b = edges.select(*[F.col(c).alias(f"b_{c}") for c in ("u", "v", "key", "osmid", "ux", "uy", "vx", "vy")])
    same = (F.col("a_ux") == F.col("b_vx")) & (F.col("a_uy") == F.col("b_vy"))
    angle = normal_angle(bearing(F.col("b_ux"), F.col("b_uy"), F.col("b_vx"), F.col("b_vy")) - bearing(F.col("a_ux"), F.col("a_uy"), F.col("a_vx"), F.col("a_vy")))
    out = a.join(b, (F.col("a_v") == F.col("b_u")) & ~same).withColumn("turning_angle", angle).withColumn("turn_direction", turn_direction(F.col("turning_angle")))
    edge = lambda s: F.struct(F.col(f"{s}_u").alias("u"), F.col(f"{s}_v").alias("v"), F.col(f"{s}_key").alias("key"))
    return out.select(edge("a").alias("in_edge"), edge("b").alias("out_edge"), F.col("a_osmid").alias("osmid_in"), F.col("b_osmid").alias("osmid_out"), "turning_angle", "turn_direction", F.lit(0.0).alias("length"))


ONLY = ("only_straight_on", "only_right_turn", "only_left_turn", "only_u_turn")
NO = ("no_straight_on", "no_right_turn", "no_left_turn", "no_u_turn")


def enforce_restrictions(turns: DataFrame, restrictions: DataFrame) -> DataFrame:
    """Turns that the restrictions (osmid_in, osmid_out, restriction) leave.

    A restriction counts only if its pair of ways names exactly one turn. A no_* one
    drops that turn; an only_* one drops all other turns out of the same in-edge.
    """
    keys = ["osmid_in", "osmid_out"]
    single = turns.groupBy(*keys).agg(F.count("*").alias("_n"), F.first("in_edge").alias("_in"), F.first("out_edge").alias("_out")).where("_n = 1").drop("_n")
    rules = restrictions.where(F.col("restriction").isin(*ONLY, *NO)).select(*keys, "restriction").distinct().join(single, keys)
    no = rules.where(F.col("restriction").isin(*NO)).select(F.col("_in").alias("in_edge"), F.col("_out").alias("out_edge")).distinct()
    only = rules.where(F.col("restriction").isin(*ONLY)).select(F.col("_in").alias("in_edge"), "_out").distinct()
    left = turns.join(no, ["in_edge", "out_edge"], "left_anti")
    other = left.join(only, "in_edge").where("out_edge <> _out").select("in_edge", "out_edge").distinct()
    return left.join(other, ["in_edge", "out_edge"], "left_anti")


def edge_weights(edges: DataFrame, model=T.MODEL_1) -> DataFrame:
    """penalty, applied filters and weight = length * penalty (1 where the tags are unknown)."""
    cost = F.when(F.col("tags").isNull(), 1.0).otherwise(T.penalty(F.col("tags"), F.coalesce("reversed", F.lit(False)), F.col("slope_percentage"), model))
    return edges.withColumn("penalty", cost).withColumn("filters", T.applied(F.col("tags"), F.coalesce("reversed", F.lit(False)), model)).withColumn("weight", F.col("length") * F.col("penalty"))


def one_direction(edges: DataFrame, value: str) -> DataFrame:
    """Both directions of a street as one row: least and greatest end, summed value."""
    return edges.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum(value).alias(value))


def merge_chains(edges: DataFrame) -> DataFrame:
    """Undirected chains through nodes of degree two of one way as single edges: chain, osmid, length, u, v.

    ``edges`` has id, u, v, osmid, length. The directed form with order and geometry is
    ``chains.simplified``; here both directions are taken and the one from the smaller end stays. Rings are left out.
    """
    both = edges.select("u", "v", F.struct("id", F.lit(False).alias("back")).alias("key"), "osmid", "length").unionAll(edges.select(F.col("v"), F.col("u"), F.struct("id", F.lit(True).alias("back")), "osmid", "length"))
    found = simplified(both)
    return found.where((F.col("u") < F.col("v")) | ((F.col("u") == F.col("v")) & (F.col("nodes") <= F.reverse("nodes")))).select(F.get("osmids", F.lit(0)).alias("osmid"), "length", "u", "v")


def with_straight_geometry(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A missing geometry is the straight line between both ends; ``nodes`` has node, x, y."""
    end = lambda name: nodes.select(F.col("node").alias(name), F.struct("x", "y").alias(f"_{name}"))
    placed = edges.join(end("u"), "u", "left").join(end("v"), "v", "left")
    return placed.withColumn("geometry", F.coalesce("geometry", F.array("_u", "_v"))).select(*edges.columns)


def with_node_elevation(nodes: DataFrame, raster: DataFrame, dx: float, dy: float) -> DataFrame:
    """Nodes with the value of the raster cell (col, row, value) they lie in."""
    at = nodes.withColumn("col", F.floor(F.col("x") / dx).cast("bigint")).withColumn("row", F.floor(F.col("y") / dy).cast("bigint"))
    return at.join(raster.select("col", "row", F.col("value").alias("elevation")), ["col", "row"], "left").drop("col", "row")


def edge_slope(tags, slopes, rise, length):
    """0 in tunnels, on bridges and below ground (layer -1); else the robust slope."""
    flat = F.coalesce(T.tag(tags, "tunnel").isNotNull() | T.tag(tags, "bridge").isNotNull(), F.lit(False)) | F.coalesce(T.tag(tags, "layer") == "-1", F.lit(False))
    return F.when(flat, 0.0).otherwise(robust_slope(slopes, rise, length))


def without_isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that an edge touches."""
    ends = edges.select(F.col("u").alias("node")).unionAll(edges.select(F.col("v").alias("node"))).distinct()
    return nodes.join(ends, "node", "left_semi")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    known = nodes.select("node").distinct()
    return edges.join(known.withColumnRenamed("node", "u"), "u", "left_semi").join(known.withColumnRenamed("node", "v"), "v", "left_semi").select(*edges.columns)


def common_filters(turns: DataFrame) -> DataFrame:
    """Turns with the filter names that both of their edges have (filters_in, filters_out)."""
    return turns.withColumn("filters", F.array_intersect("filters_in", "filters_out"))


def reversed_key(edge):
    """An edge key with its ends swapped; the ends of a turn's edge are edges themselves."""
    swap = lambda e: F.struct(e["v"].alias("u"), e["u"].alias("v"), e["key"].alias("key"))
    return swap(edge)


def merged_lines(parts: DataFrame, key: str) -> DataFrame:
    """key, geometry: the lines (array of struct x, y) of each key one after the other by ``place``, joints once."""
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "geometry"))), lambda s: s["geometry"]))
    joined = parts.groupBy(key).agg(whole.alias("_g"))
    return joined.select(key, F.filter("_g", lambda p, i: (i == 0) | (p != F.get("_g", i - 1))).alias("geometry"))
