"""Queries of population and demand providers, lookups and tables for drawing."""

from __future__ import annotations

from pyspark.sql import functions as F

from wheelwork.functions import shapes as H
from wheelwork.operators import providers as V
from wheelwork.plans.files import _box
from wheelwork.plans.inputs import POINTS, STREETS, points, streets, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _boxes(spark, d):
    b = points(spark, d).groupBy("label").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return b.select("label", _box("x0", "y0", "x1", "y1").alias("rings"))


_BOXES = f"{POINTS}, b AS (SELECT label, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points GROUP BY 1), o AS (SELECT a.label AS a, b.label AS b, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS s, (b.x1 - b.x0) * (b.y1 - b.y0) AS w FROM b a, b b)"


@query(f"WITH {_BOXES} SELECT a, b, round(s, 9) AS shared, round(w - s, 9) AS rest FROM o")
def polygon_overlaps(spark, d):
    """Area that the boxes of labels share pair by pair (ten labels), and what of the second is left, by clipped polygons."""
    b = _boxes(spark, d)
    both = b.select(F.col("label").alias("a"), F.col("rings").alias("ra")).join(F.broadcast(b.select(F.col("label").alias("b"), F.col("rings").alias("rb"))))
    shared = H.overlap_area(F.col("ra"), F.col("rb"))
    return both.select("a", "b", F.round(shared, 9).alias("shared"), F.round(H.polygon_area(F.col("rb")) - shared, 9).alias("rest"))


@query(f"WITH {_BOXES} SELECT a AS zone, round(sum(s / w * (1000 + 10 * b)), 6) AS total FROM o GROUP BY 1")
def district_population(spark, d):
    """Population of zones from districts that overlap them, each spread evenly."""
    districts = _boxes(spark, d).select(F.col("label").alias("district"), (1000.0 + 10 * F.col("label")).alias("population"), "rings")
    zones = districts.select(F.col("district").alias("zone"), "rings")
    return V.DistrictPopulation(districts, 0.25).in_polygons(zones).select("zone", F.round("total", 6).alias("total"))


@query(f"WITH {POINTS}, t AS (SELECT id // 3 AS zone, array_agg(x ORDER BY id) AS xs, array_agg(y ORDER BY id) AS ys FROM points GROUP BY 1 HAVING count(*) = 3), "
       "c AS (SELECT zone, p.id, " + " + ".join(f"((ys[{i}] > p.y) <> (ys[{j}] > p.y) AND p.x < (xs[{j}] - xs[{i}]) * (p.y - ys[{i}]) / (ys[{j}] - ys[{i}]) + xs[{i}])::INT" for i, j in ((1, 2), (2, 3), (3, 1))) + " AS n FROM t, points p) SELECT zone, count(*) FILTER (n % 2 = 1) AS n FROM c GROUP BY 1")  # fmt: skip
def points_in_triangles(spark, d):
    from wheelwork.plans.files import _triangles

    return V.points_in(_triangles(spark, d).select(F.col("tri").alias("zone"), "rings"), points(spark, d).select("x", "y"), 0.1)


@query(f"WITH {STREETS}, a AS (SELECT o_orderkey AS osmid FROM orders WHERE o_orderkey % 5 = 0), g AS (SELECT osmid, count(*) AS n, min(u) AS u, min(v) AS v, min(key) AS key FROM streets GROUP BY 1) SELECT a.osmid, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN u || '>' || v || '#' || key END AS edge FROM a LEFT JOIN g USING (osmid)")
def edge_of_way(spark, d):
    ways = table(spark, d, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("osmid"))
    s = lambda c: F.col(f"edge.{c}").cast("string")
    return V.edge_of_way(streets(spark, d), ways).select("osmid", "n", F.when(F.col("edge").isNotNull(), F.concat(s("u"), F.lit(">"), s("v"), F.lit("#"), s("key"))).alias("edge"))


@query(f"WITH {STREETS} SELECT u, v, key, osmid, share, NULL::DOUBLE AS slope FROM streets")
def chosen_attributes(spark, d):
    return V.chosen(streets(spark, d), ["osmid", "share", "slope"]).drop("geometry")


@query(f"WITH {POINTS} SELECT id AS node, id // 2 AS osmid, CASE WHEN id % 3 > 0 AND id % 5 > 0 THEN x + 1 ELSE x END AS x, CASE WHEN id % 3 > 0 AND id % 5 > 0 THEN y + 1 ELSE y END AS y FROM points")
def shifted_nodes(spark, d):
    """Nodes at their shifted places, or at the plain ones where a coordinate is missing."""
    p = points(spark, d)
    nodes = p.select(F.col("id").alias("node"), F.floor(F.col("id") / 2).cast("bigint").alias("osmid"), "x", "y", F.when(F.col("id") % 3 > 0, F.col("x") + 1).alias("x_shifted"), F.when(F.col("id") % 5 > 0, F.col("y") + 1).alias("y_shifted"))
    return V.node_points(nodes)


@query(f"WITH {STREETS} SELECT CASE WHEN key = 1 THEN 'black' WHEN flag = 'N' THEN 'green' WHEN flag = 'R' THEN 'red' ELSE 'blue' END AS color, count(*) AS n FROM streets WHERE quantity > 5 GROUP BY 1")
def drawn_edges(spark, d):
    s = streets(spark, d)
    e = s.select("u", "v", "key", F.when(F.col("flag") != "N", F.col("flag") == "R").alias("reversed"), F.when(F.col("key") == 1, "black").alias("color"), F.when(F.col("quantity") > 5, F.array("quantity")).alias("shifted_geometry"))
    return V.drawn(e).groupBy("color").agg(F.count("*").alias("n"))
