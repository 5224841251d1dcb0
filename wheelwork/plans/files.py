"""Queries that go through files: tables written in a format of maps and rasters and read back from it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wheelwork.functions import geo as G
from wheelwork.functions import shapes as H
from wheelwork.functions import wkb as W
from wheelwork.operators import chains as C
from wheelwork.operators import network
from wheelwork.operators import rasters as O
from wheelwork.operators import spatial as P
from wheelwork.operators.lineage import fresh_path
from wheelwork.plans.inputs import POINTS, STREETS, points, streets, table
from wheelwork.sources import geopackage as GP
from wheelwork.sources import graphml as GM
from wheelwork.sources import mapfiles as M
from wheelwork.sources import rasters as R

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _counts(spark, d):
    """Points counted by cells of a tenth."""
    return points(spark, d).groupBy(G.cell(F.col("x"), 0.1).alias("col"), G.cell(F.col("y"), 0.1).alias("row")).agg(F.count("*").alias("value"))


def _sheets(spark, d, side=8, tile=3):
    """The counts as raster files, opened again."""
    written = R.write_sheets(_counts(spark, d), fresh_path(spark, "sheets"), 0.1, 0.1, side, tile)
    return R.tiles(spark, [r["path"] for r in written.collect()])


_COUNTS = f"{POINTS}, r AS (SELECT floor(x / 0.1)::BIGINT AS col, floor(y / 0.1)::BIGINT AS row, count(*) AS v FROM points GROUP BY 1, 2)"


@query(f"WITH {_COUNTS} SELECT col, row, v::DOUBLE AS value FROM r")
def raster_files(spark, d):
    """Cells written as map sheets and read back tile by tile; their numbers from their boxes."""
    number = lambda a, b: F.floor((F.col(a) + F.col(b)) / 0.2).cast("bigint")
    return R.cells(_sheets(spark, d)).select(number("x0", "x1").alias("col"), number("y0", "y1").alias("row"), "value")


def _box(*of):
    """A zone's box as a polygon of one ring."""
    x0, y0, x1, y1 = map(F.col, of)
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1)))


@query(f"""WITH {_COUNTS}, z AS (SELECT label AS zone, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points GROUP BY 1)
SELECT zone, round(sum(v * greatest(least(x1, (col + 1) * 0.1) - greatest(x0, col * 0.1), 0) / 0.1 * greatest(least(y1, (row + 1) * 0.1) - greatest(y0, row * 0.1), 0) / 0.1), 6) AS total
FROM z JOIN r ON col BETWEEN floor(x0 / 0.1) AND floor(x1 / 0.1) AND row BETWEEN floor(y0 / 0.1) AND floor(y1 / 0.1) GROUP BY 1""")
def raster_file_zonal(spark, d):
    """Sums of raster files' cells in the boxes of the labels, through clipped polygons."""
    zones = points(spark, d).groupBy(F.col("label").alias("zone")).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return O.zonal_sums(_sheets(spark, d), zones.select("zone", _box("x0", "y0", "x1", "y1").alias("rings"))).select("zone", F.round("total", 6).alias("total"))


@query(f"WITH {_COUNTS} SELECT id, v::DOUBLE AS elevation FROM points JOIN r ON floor(x / 0.1)::BIGINT = col AND floor(y / 0.1)::BIGINT = row")
def raster_file_values(spark, d):
    """The value of the raster file's cell that each point lies in."""
    return O.values_at(_sheets(spark, d), points(spark, d).select("id", "x", "y")).select("id", F.col("value").alias("elevation"))


_TRIANGLES = f"{POINTS}, tri AS (SELECT id // 3 AS tri, array_agg(x ORDER BY id) AS xs, array_agg(y ORDER BY id) AS ys FROM points GROUP BY 1 HAVING count(*) = 3)"


def _triangles(spark, d):
    corners = F.array_sort(F.collect_list(F.struct("id", "x", "y")))
    t = points(spark, d).groupBy(F.floor(F.col("id") / 3).cast("bigint").alias("tri")).agg(corners.alias("c")).where("size(c) = 3")
    return t.select("tri", F.array(F.transform("c", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))).alias("rings"))


@query(f"""WITH {_TRIANGLES} SELECT tri, round(abs((xs[2] - xs[1]) * (ys[3] - ys[1]) - (xs[3] - xs[1]) * (ys[2] - ys[1])) / 2, 9) AS area,
  (floor(greatest(xs[1], xs[2], xs[3]) / 0.05) - floor(least(xs[1], xs[2], xs[3]) / 0.05) + 1)::BIGINT * (floor(greatest(ys[1], ys[2], ys[3]) / 0.05) - floor(least(ys[1], ys[2], ys[3]) / 0.05) + 1)::BIGINT AS cells FROM tri""")
def polygon_cells(spark, d):
    """Triangles clipped to the cells of a grid: the parts' areas add up to the triangle's."""
    t = _triangles(spark, d).withColumn("b", H.bounds(F.col("rings")))
    steps = lambda a, b: F.sequence(G.cell(F.col(a), 0.05), G.cell(F.col(b), 0.05))
    parts = t.withColumn("cx", F.explode(steps("b.x0", "b.x1"))).withColumn("cy", F.explode(steps("b.y0", "b.y1")))
    part = H.clipped(F.col("rings"), F.col("cx") * 0.05, F.col("cy") * 0.05, (F.col("cx") + 1) * 0.05, (F.col("cy") + 1) * 0.05)
    return parts.groupBy("tri").agg(F.round(F.sum(H.polygon_area(part)), 9).alias("area"), F.count("*").alias("cells"))


@query(f"""WITH {POINTS}, e AS (SELECT a.id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM points a JOIN points b ON b.id = a.id + 1)
SELECT id, round((sqrt(pow(x1 - x2, 2) + pow(y1 - y2, 2)) + 0.02) * 0.02, 9) AS area FROM e""")
def street_buffers(spark, d):
    """Stretches between neighbouring points widened by a hundredth with square ends, and the widened stretches' area."""
    p = points(spark, d)
    e = p.select("id", F.col("x").alias("x1"), F.col("y").alias("y1")).join(p.select((F.col("id") - 1).alias("id"), F.col("x").alias("x2"), F.col("y").alias("y2")), "id")
    return e.select("id", F.round(H.ring_area(H.square_buffer(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), 0.01)), 9).alias("area"))


def _street_ways(spark, d):
    """Ways: the parts of an order's items in line order; nodes are placed by their numbers."""
    items = F.array_sort(F.collect_list(F.struct("key", "v")))
    way = streets(spark, d).groupBy(F.col("osmid").alias("id")).agg(F.transform(items, lambda s: s["v"]).alias("nodes"), F.min("flag").alias("flag"), F.max("quantity").cast("int").alias("q"))
    tags = F.map_filter(F.create_map(F.lit("highway"), F.when(F.col("flag") != "N", F.lit("residential")), F.lit("oneway"), F.when(F.col("q") % 2 == 0, "yes"), F.lit("name"), F.when(F.col("q") % 3 == 0, F.concat(F.lit("Straße "), F.col("id").cast("string")))), lambda k, v: v.isNotNull())
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 977 / 100 - 4).alias("lon"), (F.col("p_partkey") % 31 / 10 + 49).alias("lat"))
    return way.select("id", "nodes", tags.alias("tags")), nodes


_WAYS = """ways AS (SELECT osmid AS id, list(v ORDER BY key, v) AS nodes, CASE WHEN min(flag) <> 'N' THEN 'residential' END AS highway, CASE WHEN max(quantity)::INT % 2 = 0 THEN 'yes' END AS oneway,
  CASE WHEN max(quantity)::INT % 3 = 0 THEN 'Straße ' || osmid END AS name FROM streets GROUP BY 1)"""


@query(f"WITH {STREETS}, {_WAYS} SELECT id, array_to_string(nodes, ',') AS nodes, highway, oneway, name FROM ways WHERE highway IS NOT NULL OR oneway IS NOT NULL OR name IS NOT NULL")
def map_file_ways(spark, d):
    """Ways with tags, written as a map file and scanned in small ranges."""
    folder = fresh_path(spark, "map")
    M.write(_street_ways(spark, d)[0], folder, "ways").collect()
    tag = lambda k: F.element_at("tags", k).alias(k)
    return M.ways(spark, folder, tagged=True, range_bytes=50_000).select("id", F.array_join(F.col("nodes").cast("array<string>"), ",").alias("nodes"), tag("highway"), tag("oneway"), tag("name"))


@query(f"""WITH {STREETS}, {_WAYS}, w AS (SELECT id, oneway, nodes, unnest(range(1, len(nodes))) AS i FROM ways WHERE highway IS NOT NULL), e AS (SELECT id, oneway, nodes[i] AS u, nodes[i + 1] AS v FROM w),
p AS (SELECT p_partkey AS id, round((p_partkey % 977 / 100 - 4)::DOUBLE, 7) AS lon, round((p_partkey % 31 / 10 + 49)::DOUBLE, 7) AS lat FROM part)
SELECT osmid, u, v, reversed, a.lon AS ux, b.lat AS vy FROM (SELECT id AS osmid, u, v, false AS reversed FROM e UNION ALL SELECT id, v, u, true FROM e WHERE oneway IS NULL) s JOIN p a ON a.id = u JOIN p b ON b.id = v""")
def map_file_segments(spark, d):
    """The street graph of a map file: its ways of one key and its nodes, as edges between consecutive nodes."""
    folder = fresh_path(spark, "map")
    ways, nodes = _street_ways(spark, d)
    M.write(ways, folder, "ways").unionAll(M.write(nodes, folder, "nodes")).collect()
    found = M.ways(spark, folder, keys="highway", columns="id,tags,nodes").select(F.col("id").alias("osmid"), "tags", "nodes")
    placed = M.nodes(spark, folder, columns="id,lon,lat").select(F.col("id").alias("node"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    return network.segments(found, placed).select("osmid", "u", "v", "reversed", F.round("ux", 7).alias("ux"), F.round("vy", 7).alias("vy"))


@query("""WITH r AS (SELECT o_orderkey AS id, o_orderstatus AS s, o_custkey AS a, o_orderkey % 1000 AS b FROM orders)
SELECT a AS osmid_in, b AS osmid_out, CASE s WHEN 'F' THEN 'no_left_turn' ELSE 'only_straight_on' END AS restriction, count(*) AS n FROM r WHERE s <> 'P' GROUP BY 1, 2, 3""")
def map_file_restrictions(spark, d):
    """Restrictions between ways, written as relations and found again by their type and roles."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"), F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 1000).alias("b"))
    member = lambda kind, ref, role: F.struct(F.lit(kind).alias("kind"), ref.cast("bigint").alias("ref"), F.lit(role).alias("role"))
    tags = F.create_map(F.lit("type"), F.when(F.col("s") == "P", "route").otherwise("restriction"), F.lit("restriction"), F.when(F.col("s") == "F", "no_left_turn").otherwise("only_straight_on"))
    rows = o.select("id", tags.alias("tags"), F.array(member("way", F.col("a"), "from"), member("node", F.col("id"), "via"), member("way", F.col("b"), "to")).alias("members"))
    folder = fresh_path(spark, "map")
    M.write(rows, folder, "relations").collect()
    return M.turn_rules(M.restrictions(spark, folder)).groupBy("osmid_in", "osmid_out", "restriction").agg(F.count("*").alias("n"))


@query(f"""WITH {STREETS} SELECT u, v, key, count(*) AS n, sum(osmid)::BIGINT AS osmids, round(sum(length), 2) AS length, max('Weg <' || osmid || '> & "' || flag || '"') AS name, count(*) FILTER (share > 0.05) AS wide, max(len([osmid, key]))::BIGINT AS ids FROM streets GROUP BY 1, 2, 3""")
def graphml_edges(spark, d):
    """Streets as typed edges of a GraphML document and back."""
    e = streets(spark, d)
    name = F.concat(F.lit("Weg <"), F.col("osmid").cast("string"), F.lit('> & "'), "flag", F.lit('"'))
    edges = e.select("u", "v", "key", "osmid", "length", name.alias("name"), (F.col("share") > 0.05).alias("wide"), F.array("osmid", F.col("key").cast("bigint")).alias("ids"))
    nodes = e.select(F.col("u").alias("node")).union(e.select(F.col("v").alias("node"))).distinct().withColumn("x", F.col("node") / 7)
    folder = fresh_path(spark, "graph")
    GM.write(nodes, edges, folder, compression="gzip")
    back = GM.read(spark, folder, edge_types={"ids": "array<bigint>"})[1]
    out = back.groupBy("u", "v", "key").agg(F.count("*").alias("n"), F.sum("osmid").alias("osmids"), F.round(F.sum("length"), 2).alias("length"), F.max("name").alias("name"), F.count_if("wide").alias("wide"), F.max(F.size("ids")).cast("bigint").alias("ids"))
    return out.withColumn("key", F.col("key").cast("int"))


@query(f"""WITH {STREETS}, n AS (SELECT u AS node FROM streets UNION SELECT v FROM streets) SELECT node, node / 7 AS x, CASE WHEN node % 3 > 0 THEN node::VARCHAR END AS name FROM n""")
def graphml_nodes(spark, d):
    """The ends of streets as nodes with attributes, some missing."""
    e = streets(spark, d)
    nodes = e.select(F.col("u").alias("node")).union(e.select(F.col("v").alias("node"))).distinct().select("node", (F.col("node") / 7).alias("x"), F.when(F.col("node") % 3 > 0, F.col("node").cast("string")).alias("name"))
    folder = fresh_path(spark, "graph")
    GM.write(nodes, e.select("u", "v", "key").limit(0), folder)
    return GM.read(spark, folder)[0]


def _bits(x: str) -> str:
    """The bytes of a double as hexadecimal text, from its bits."""
    return f"array_to_string(list_transform(range(16), lambda i: '0123456789ABCDEF'[(8 * (b[4 * i + 1])::INT + 4 * (b[4 * i + 2])::INT + 2 * (b[4 * i + 3])::INT + (b[4 * i + 4])::INT) + 1]), '') FROM (SELECT ({x})::BIT::VARCHAR AS b)"


@query(f"""WITH {POINTS}, e AS (SELECT a.id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM points a JOIN points b ON b.id = a.id + 1)
SELECT id, '000000000200000002' || (SELECT {_bits('x1')}) || (SELECT {_bits('y1')}) || (SELECT {_bits('x2')}) || (SELECT {_bits('y2')}) AS wkb, 'label ' || id AS name, id % 2 = 0 AS even FROM e""")
def layer_lines(spark, d):
    """Lines between neighbouring points through a GeoPackage layer, as hexadecimal well-known binary with the high byte first."""
    p = points(spark, d)
    to = p.select((F.col("id") - 1).alias("id"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    e = p.join(to, "id").select("id", F.concat(F.lit("label "), F.col("id").cast("string")).alias("name"), (F.col("id") % 2 == 0).alias("even"), W.to_wkb(W.line(F.array(corner("x", "y"), corner("x2", "y2")))).alias("geom"))
    files = GP.write(e, fresh_path(spark, "layer"), "lines", 2).collect()
    back = GP.read(spark, [r["path"] for r in files], "lines", rows=50)
    return back.select("id", F.hex(W.to_wkb(W.from_wkb(F.col("geom")), little=False)).alias("wkb"), "name", "even")


@query(f"""WITH {_TRIANGLES} SELECT tri, round(abs((xs[2] - xs[1]) * (ys[3] - ys[1]) - (xs[3] - xs[1]) * (ys[2] - ys[1])) / 2, 9) AS area, 4::BIGINT AS points FROM tri""")
def layer_polygons(spark, d):
    """Triangles through a GeoPackage layer of polygons of several parts."""
    t = _triangles(spark, d).select("tri", W.to_wkb(W.polygons(F.array("rings"))).alias("geom"))
    files = GP.write(t, fresh_path(spark, "layer"), "areas", 6).collect()
    ring = F.get(F.get(W.from_wkb(F.col("geom"))["parts"], F.lit(0)), F.lit(0))
    back = GP.read(spark, [r["path"] for r in files], "areas").select("tri", ring.alias("r"))
    return back.select("tri", F.round(H.ring_area(H.open_ring(F.col("r"))), 9).alias("area"), F.size("r").cast("bigint").alias("points"))


_AREAS = f"""{POINTS}, c AS (SELECT id // 12 AS area, id % 12 AS i, round(11 + x / 10, 7) AS x, round(49 + y / 10, 7) AS y FROM points WHERE id < 12 * (SELECT count(*) // 12 FROM points)),
s AS (SELECT area, x, y, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM c WINDOW w AS (PARTITION BY area ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


@query(f"WITH {_AREAS} SELECT area, round(abs(sum(x * y2 - x2 * y)) / 2, 12) AS size FROM s WHERE area % 2 = 0 GROUP BY 1")
def map_file_areas(spark, d):
    """Every twelve points are a ring, cut into three ways (the second one the wrong way round), written as a map file; areas of the relations with a tag."""
    p = points(spark, d)
    n = p.count() // 12 * 12
    p = p.where(F.col("id") < n)
    nodes = p.select("id", (F.lit(11) + F.col("x") / 10).alias("lon"), (F.lit(49) + F.col("y") / 10).alias("lat"))
    first = p.where("id % 12 = 0").select(F.floor(F.col("id") / 12).alias("area"), F.col("id").alias("at"))
    # the ring comes back to its first point; cuts are at 0, 4 and 9
    spans = F.array(*[F.struct(F.lit(k).alias("k"), F.array(*[F.lit(i % 12) for i in span]).alias("is")) for k, span in enumerate(([0, 1, 2, 3, 4], [9, 8, 7, 6, 5, 4], [9, 10, 11, 12]))])
    ways = first.select("area", "at", F.explode(spans).alias("s")).select((F.col("area") * 3 + F.col("s.k")).alias("id"), F.transform("s.is", lambda i: F.col("at") + i).alias("nodes"))
    member = lambda k: F.struct(F.lit("way").alias("kind"), (F.col("area") * 3 + k).alias("ref"), F.lit("outer").alias("role"))
    tags = F.create_map(F.lit("boundary"), F.when(F.col("area") % 2 == 0, "administrative").otherwise("other"))
    relations = first.select(F.col("area").alias("id"), tags.alias("tags"), F.array(*map(member, range(3))).alias("members"))
    folder = fresh_path(spark, "map")
    M.write(nodes, folder, "nodes").unionAll(M.write(ways, folder, "ways")).unionAll(M.write(relations, folder, "relations")).collect()
    found = P.areas(M.relations(spark, folder, tag="boundary=administrative"), M.ways(spark, folder), M.nodes(spark, folder))
    return found.select(F.col("relation").alias("area"), F.round(H.polygon_area(F.col("rings")), 12).alias("size"))


_CHAIN = """n AS (SELECT l_orderkey AS o, l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS node, ascii(l_returnflag) AS way, round(l_extendedprice) AS length FROM lineitem),
e AS (SELECT * FROM (SELECT o, node AS u, lead(node) OVER (PARTITION BY o ORDER BY node) AS v, way, length FROM n) WHERE v IS NOT NULL)"""


@query(f"""WITH {_CHAIN}, b AS (SELECT *, coalesce(way <> lag(way) OVER w, true)::INT AS fresh FROM e WINDOW w AS (PARTITION BY o ORDER BY u)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY o ORDER BY u) AS run FROM b),
r AS (SELECT o, run, min(u) AS u, max(v) AS v, any_value(way)::INT AS way, sum(length) AS length, count(*) AS n_edges FROM g GROUP BY 1, 2)
SELECT u, v, way, length, n_edges FROM r UNION ALL SELECT v, u, way, length, n_edges FROM r WHERE o % 2 = 0""")
def simplified_streets(spark, d):
    """The items of an order are a street of stretches, both ways in every second order; stretches of one way become one edge."""
    li = table(spark, d, "lineitem")
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    n = li.select(F.col("l_orderkey").alias("o"), (F.col("l_orderkey") * 100 + nth).alias("u"), F.ascii("l_returnflag").alias("osmid"), F.round("l_extendedprice").alias("length"))
    e = n.withColumn("v", F.lead("u").over(Window.partitionBy("o").orderBy("u"))).where("v IS NOT NULL").withColumn("key", F.lit(0))
    way = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    both = F.when(F.col("o") % 2 == 0, F.array(way("u", "v"), way("v", "u"))).otherwise(F.array(way("u", "v")))
    out = C.simplified(e.select(F.inline(both), "key", "osmid", "length"))
    return out.select("u", "v", F.get("osmids", F.lit(0)).alias("way"), "length", "n_edges")
