"""Queries over points, zones, grids and rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from wheelwork.functions import geo as G
from wheelwork.operators import spatial as P
from wheelwork.plans.inputs import POINTS, points

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Points are moved near Nuremberg: a unit of x or y is a tenth of a degree.
LON, LAT = 11.08, 49.45
_GEO = f"{POINTS}, geo AS (SELECT id, label, {LON} + x / 10 AS lon, {LAT} + y / 10 AS lat FROM points)"


def _geo(spark, d):
    return points(spark, d).select("id", "label", (LON + F.col("x") / 10).alias("lon"), (LAT + F.col("y") / 10).alias("lat"))


@query(f"""WITH {_GEO} SELECT id, round(2 * 6371008.8 * asin(sqrt(pow(sin(radians(lat - {LAT}) / 2), 2) + cos(radians({LAT})) * cos(radians(lat)) * pow(sin(radians(lon - {LON}) / 2), 2))), 3) AS metres FROM geo""")
def haversine(spark, d):
    return _geo(spark, d).select("id", F.round(G.haversine(F.lit(LON), F.lit(LAT), F.col("lon"), F.col("lat")), 3).alias("metres"))


def _geodesic_sql() -> str:
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    return f"""WITH RECURSIVE {_GEO}, k AS (SELECT id, sin(u1) AS s1, cos(u1) AS c1, sin(u2) AS s2, cos(u2) AS c2, l FROM (SELECT id, atan({1 - f!r}::DOUBLE * tan(radians({LAT}::DOUBLE))) AS u1, atan({1 - f!r}::DOUBLE * tan(radians(lat))) AS u2, radians(lon - {LON}::DOUBLE) AS l FROM geo)),
it AS (SELECT 0 AS i, l AS lam, k.* FROM k UNION ALL SELECT i + 1, l + (1 - c) * {f!r}::DOUBLE * side * (atan2(ss, cs) + c * ss * (m + c * cs * (2 * m * m - 1))), id, s1, c1, s2, c2, l FROM (
  SELECT *, {f / 16!r}::DOUBLE * sq * (4 + {f!r}::DOUBLE * (4 - 3 * sq)) AS c FROM (SELECT *, cs - 2 * s1 * s2 / sq AS m FROM (SELECT *, 1 - side * side AS sq FROM (
  SELECT *, c1 * c2 * sin(lam) / ss AS side FROM (SELECT *, sqrt(pow(c2 * sin(lam), 2) + pow(c1 * s2 - s1 * c2 * cos(lam), 2)) AS ss, s1 * s2 + c1 * c2 * cos(lam) AS cs FROM it WHERE i < 12))))) ),
e AS (SELECT *, sq * {(a * a - b * b) / (b * b)!r}::DOUBLE AS q FROM (SELECT *, cs - 2 * s1 * s2 / sq AS m FROM (SELECT *, 1 - side * side AS sq FROM (SELECT *, c1 * c2 * sin(lam) / ss AS side FROM (
  SELECT *, sqrt(pow(c2 * sin(lam), 2) + pow(c1 * s2 - s1 * c2 * cos(lam), 2)) AS ss, s1 * s2 + c1 * c2 * cos(lam) AS cs FROM it WHERE i = 12))))),
g AS (SELECT *, 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q))) AS big, q / 1024 * (256 + q * (-128 + q * (74 - 47 * q))) AS sm FROM e)
SELECT id, round({b!r}::DOUBLE * big * (atan2(ss, cs) - sm * ss * (m + sm / 4 * (cs * (2 * m * m - 1) - sm / 6 * m * (4 * ss * ss - 3) * (4 * m * m - 3)))), 3) AS metres FROM g"""


@query(_geodesic_sql())
def spheroid_distance(spark, d):
    """Metres on the spheroid from one place to all points."""
    return _geo(spark, d).select("id", F.round(G.geodesic(F.lit(LON), F.lit(LAT), F.col("lon"), F.col("lat")), 3).alias("metres"))


def _utm_sql() -> str:
    f = 1 / 298.257222101
    n = f / (2 - f)
    big = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    a = (n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3, 13 / 48 * n**2 - 3 / 5 * n**3, 61 / 240 * n**3)
    e = 2 * n**0.5 / (1 + n)
    sh, ch = (lambda z: f"((exp({z}) - exp(-({z}))) / 2)"), (lambda z: f"((exp({z}) + exp(-({z}))) / 2)")
    at = lambda z: f"(0.5 * ln((1 + {z}) / (1 - ({z}))))"
    east = " + ".join(["eta", *[f"{x!r} * cos({2 * j} * xi) * {sh(f'{2 * j} * eta')}" for j, x in enumerate(a, 1)]])
    north = " + ".join(["xi", *[f"{x!r} * sin({2 * j} * xi) * {ch(f'{2 * j} * eta')}" for j, x in enumerate(a, 1)]])
    return f"""WITH {_GEO}, a AS (SELECT id, radians(lon - 9) AS lam, {sh(f"{at('sin(radians(lat))')} - {e!r} * {at(f'{e!r} * sin(radians(lat))')}")} AS t FROM geo),
b AS (SELECT id, atan2(t, cos(lam)) AS xi, {at("sin(lam) / sqrt(1 + t * t)")} AS eta FROM a)
SELECT id, round(500000 + 0.9996::DOUBLE * {big!r}::DOUBLE * ({east}), 3) AS easting, round(0.9996::DOUBLE * {big!r}::DOUBLE * ({north}), 3) AS northing FROM b"""


@query(_utm_sql())
def utm_projection(spark, d):
    x, y = G.utm(F.col("lon"), F.col("lat"))
    return _geo(spark, d).select("id", F.round(x, 3).alias("easting"), F.round(y, 3).alias("northing"))


RING = [(-0.2, -0.2), (0.2, -0.1), (0.1, 0.25), (-0.1, 0.1)]


def _ring_sql(x: str, y: str, ring) -> str:
    cross = [f"((({y1} > {y}) <> ({y2} > {y})) AND {x} < {x2 - x1!r} * ({y} - ({y1})) / {y2 - y1!r} + ({x1}))::INT" for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True) if y1 != y2]
    return f"(({' + '.join(cross)}) % 2 = 1)"


def _side_sql(ax, ay, bx, by, x, y) -> str:
    return f"(({bx}) - ({ax})) * (({y}) - ({ay})) - (({by}) - ({ay})) * (({x}) - ({ax})) > 0"


def crosses_sql(x1, y1, x2, y2, ring) -> str:
    """Whether the stretch between two points crosses a side of the ring."""
    sides = zip(ring, [*ring[1:], ring[0]], strict=True)
    return " OR ".join(
        f"(({_side_sql(x1, y1, x2, y2, a, b)}) <> ({_side_sql(x1, y1, x2, y2, e, f)}) AND ({_side_sql(a, b, e, f, x1, y1)}) <> ({_side_sql(a, b, e, f, x2, y2)}))" for (a, b), (e, f) in sides
    )


@query(f"WITH {POINTS} SELECT id, {_ring_sql('x', 'y', RING)} AS inside FROM points")
def point_in_polygon(spark, d):
    return P.flag_zones(points(spark, d), "x", "y", {"inside": RING}).select("id", "inside")


@query(f"WITH {POINTS}, n AS (SELECT label, avg(x) AS x, avg(y) AS y FROM points GROUP BY 1) SELECT p.id, arg_min(n.label, {{'d': sqrt(pow(p.x - n.x, 2) + pow(p.y - n.y, 2)), 'l': n.label}}) AS node, round(min(sqrt(pow(p.x - n.x, 2) + pow(p.y - n.y, 2))), 9) AS distance FROM points p, n GROUP BY 1")
def nearest_node(spark, d):
    pts = points(spark, d)
    nodes = pts.groupBy(F.col("label").alias("node")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return P.nearest(pts, nodes, "id", "node", 0.05).select("id", "node", F.round("distance", 9).alias("distance"))


@query(f"WITH {POINTS} SELECT floor(x / 0.05)::BIGINT AS cx, floor(y / 0.05)::BIGINT AS cy, count(*) AS n FROM points GROUP BY 1, 2")
def grid_demand(spark, d):
    return points(spark, d).groupBy(G.cell(F.col("x"), 0.05).alias("cx"), G.cell(F.col("y"), 0.05).alias("cy")).agg(F.count("*").alias("n"))


@query(f"WITH {POINTS}, g AS (SELECT floor(x / 0.05) AS cx, floor(y / 0.05) AS cy, count(*) AS n FROM points GROUP BY 1, 2) SELECT max(n) AS most, min(n) AS least FROM g")
def grid_extremes(spark, d):
    g = points(spark, d).groupBy(G.cell(F.col("x"), 0.05).alias("cx"), G.cell(F.col("y"), 0.05).alias("cy")).agg(F.count("*").alias("n"))
    return g.agg(F.max("n").alias("most"), F.min("n").alias("least"))


@query(f"WITH {POINTS} SELECT a.id, count(b.id) AS n FROM points a LEFT JOIN points b ON sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 0.05 GROUP BY 1")
def disc_demand(spark, d):
    return P.count_in_disc(points(spark, d), points(spark, d), "id", 0.05)


@query(f"""WITH {POINTS}, r AS (SELECT floor(x / 0.1)::BIGINT AS col, floor(y / 0.1)::BIGINT AS row, count(*) AS v FROM points GROUP BY 1, 2),
z AS (SELECT label AS zone, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points GROUP BY 1)
SELECT zone, round(sum(v * greatest(least(x1, (col + 1) * 0.1) - greatest(x0, col * 0.1), 0) / 0.1 * greatest(least(y1, (row + 1) * 0.1) - greatest(y0, row * 0.1), 0) / 0.1), 6) AS total
FROM z JOIN r ON col BETWEEN floor(x0 / 0.1) AND floor(x1 / 0.1) AND row BETWEEN floor(y0 / 0.1) AND floor(y1 / 0.1) GROUP BY 1""")
def raster_zonal(spark, d):
    pts = points(spark, d)
    raster = pts.groupBy(G.cell(F.col("x"), 0.1).alias("col"), G.cell(F.col("y"), 0.1).alias("row")).agg(F.count("*").alias("value"))
    zones = pts.groupBy(F.col("label").alias("zone")).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return P.zonal_sum(raster, zones, "zone", "value", 0.1, 0.1).select("zone", F.round("total", 6).alias("total"))


_BEARING = f"(((degrees(atan2(sin(radians(lon - {LON})) * cos(radians(lat)), cos(radians({LAT})) * sin(radians(lat)) - sin(radians({LAT})) * cos(radians(lat)) * cos(radians(lon - {LON}))))) % 360 + 360) % 360)"


@query(f"WITH {_GEO}, b AS (SELECT id, {_BEARING} AS b FROM geo), c AS (SELECT id, round(b, 6) AS bearing, b - 180 AS angle FROM b) SELECT id, bearing, CASE WHEN angle < -60 THEN 'left' WHEN angle > 60 THEN 'right' ELSE 'straight' END AS turn FROM c")
def bearing_turn(spark, d):
    b = G.bearing(F.lit(LON), F.lit(LAT), F.col("lon"), F.col("lat"))
    return _geo(spark, d).select("id", F.round(b, 6).alias("bearing"), G.turn_direction(b - 180).alias("turn"))


@query(f"WITH {POINTS} SELECT floor(degrees(atan2(y, x)) / 5)::INT AS bin, count(*) AS n FROM points GROUP BY 1")
def angle_histogram(spark, d):
    return points(spark, d).groupBy(F.floor(F.degrees(F.atan2("y", "x")) / 5).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query(f"""WITH {POINTS}, c AS (SELECT DISTINCT floor(x / 0.05) AS cx, floor(y / 0.05) AS cy, label FROM points), k AS (SELECT DISTINCT cx, cy FROM c WHERE label < 5)
SELECT count(*) AS cells, count(k.cx) AS covered, count(k.cx) / count(*) AS share FROM (SELECT DISTINCT cx, cy FROM c) a LEFT JOIN k USING (cx, cy)""")
def coverage_share(spark, d):
    c = points(spark, d).select(G.cell(F.col("x"), 0.05).alias("cx"), G.cell(F.col("y"), 0.05).alias("cy"), "label")
    cells = c.groupBy("cx", "cy").agg(F.max(F.col("label") < 5).alias("in"))
    return cells.agg(F.count("*").alias("cells"), F.count_if("in").alias("covered"), (F.count_if("in") / F.count("*")).alias("share"))


@query(f"WITH {POINTS} SELECT id, x AS lon, y AS lat FROM points")
def wkt_round_trip(spark, d):
    p = G.from_wkt(G.point_wkt(F.col("x"), F.col("y")))
    return points(spark, d).select("id", p["lon"].alias("lon"), p["lat"].alias("lat"))
