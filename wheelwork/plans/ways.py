"""Queries of ways and lines: ways and areas, nearest edges, route lines, tag models, restrictions, gap ways."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wheelwork.functions import geo as G
from wheelwork.functions import tags as T
from wheelwork.operators import gaps, network
from wheelwork.operators import spatial as P
from wheelwork.operators.lineage import fresh_path, written
from wheelwork.plans.inputs import POINTS, POSITIONS, STREETS, points, positions, streets, table
from wheelwork.plans.network import HIGHWAYS, MOVES, _gap_table, _moves
from wheelwork.plans.places import RING, _ring_sql, crosses_sql
from wheelwork.sources import sinks

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _ways(spark, d):
    """Ways of five points each, in order of their numbers."""
    p = points(spark, d).select(F.floor(F.col("id") / 5).cast("bigint").alias("way"), "id", "x", "y")
    nodes = F.transform(F.array_sort(F.collect_list(F.struct("id", "x", "y"))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))
    return p.groupBy("way").agg(nodes.alias("nodes"))


def _pieces(spark, d):
    """The stretches of the ways: from a point to the next one."""
    w = Window.partitionBy("way").orderBy("id")
    p = points(spark, d).select(F.floor(F.col("id") / 5).cast("bigint").alias("way"), "id", F.col("x").alias("x1"), F.col("y").alias("y1"))
    return p.withColumn("x2", F.lead("x1").over(w)).withColumn("y2", F.lead("y1").over(w)).where("x2 IS NOT NULL")


_PIECES = f"""{POINTS}, pieces AS (SELECT * FROM (SELECT id // 5 AS way, id, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM points WINDOW w AS (PARTITION BY id // 5 ORDER BY id)) WHERE x2 IS NOT NULL)"""


@query(f"WITH {POINTS} SELECT id // 5 AS way FROM points GROUP BY 1 HAVING bool_or({_ring_sql('x', 'y', RING)})")
def ways_in_area(spark, d):
    return P.ways_with_node_in(_ways(spark, d), RING).select("way")


_IN = [_ring_sql(f"x{i}", f"y{i}", RING) for i in (1, 2)]


@query(f"WITH {_PIECES} SELECT id, ({_IN[0]} AND {_IN[1]}) AND NOT ({crosses_sql('x1', 'y1', 'x2', 'y2', RING)}) AS contained, {_IN[0]} OR {_IN[1]} OR {crosses_sql('x1', 'y1', 'x2', 'y2', RING)} AS touching FROM pieces")
def edges_and_area(spark, d):
    return P.with_area(_pieces(spark, d), RING).select("id", "contained", "touching")


@query(f"""WITH {_PIECES}, n AS (SELECT *, greatest(ceil(sqrt(pow(x1 - x2, 2) + pow(y1 - y2, 2)) / 0.1), 1)::INT AS n FROM pieces),
s AS (SELECT id, x1 + (x2 - x1) * i / n AS x, y1 + (y2 - y1) * i / n AS y FROM (SELECT *, unnest(range(n + 1)) AS i FROM n)),
c AS (SELECT DISTINCT floor(x / 0.05)::BIGINT AS cx, floor(y / 0.05)::BIGINT AS cy FROM points),
b AS (SELECT cx, cy, arg_min(id, {{'d': sqrt(pow((cx + 0.5) * 0.05 - x, 2) + pow((cy + 0.5) * 0.05 - y, 2)), 'l': id}}) AS id FROM c, s GROUP BY 1, 2)
SELECT id, round(count(*) * 0.05::DOUBLE * 0.05::DOUBLE, 9) AS area FROM b GROUP BY 1""")
def nearest_edge_area(spark, d):
    cells = points(spark, d).select(G.cell(F.col("x"), 0.05).alias("cx"), G.cell(F.col("y"), 0.05).alias("cy")).distinct()
    return P.nearest_edge_areas(_pieces(spark, d), cells, "id", 0.05, 0.1).select("id", F.round("area", 9).alias("area"))


@query(f"WITH {_PIECES} SELECT way, count(*) + 1 AS n_points, round(sum(sqrt(pow(x1 - x2, 2) + pow(y1 - y2, 2))), 9) AS length FROM pieces GROUP BY 1")
def merged_lines(spark, d):
    parts = _pieces(spark, d).select("way", F.col("id").alias("place"), F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))).alias("geometry"))
    lines = network.merged_lines(parts, "way")
    return lines.select("way", F.size("geometry").cast("bigint").alias("n_points"), F.round(G.line_length(F.col("geometry")), 9).alias("length"))


# tags of many kinds, by the numbers of a street; SQL expressions that both engines know
_TAGS = {
    "highway": "CASE WHEN osmid % 9 = 8 THEN 'unclassified' " + " ".join(f"WHEN key = {i + 1} THEN '{h}'" for i, h in enumerate(HIGHWAYS)) + " END",
    "cycleway": "CASE flag WHEN 'R' THEN 'lane' WHEN 'A' THEN 'track' END",
    "cycleway:right": "CASE WHEN quantity % 5 = 0 THEN 'lane' END",
    "cycleway:left": "CASE WHEN quantity % 7 = 0 THEN 'track' END",
    "bicycle": "CASE WHEN share > 0.07 THEN 'designated' WHEN share > 0.03 THEN 'yes' WHEN share < 0.005 THEN 'dismount' END",
    "foot": "CASE WHEN tax > 0.045 THEN 'designated' END",
    "segregated": "CASE osmid % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END",
    "lanes": "CASE WHEN quantity % 4 = 0 THEN '2' WHEN quantity % 4 = 1 THEN '1' WHEN quantity % 4 = 2 THEN 'x' END",
    "lanes:forward": "CASE WHEN osmid % 2 = 0 THEN '1' END",
    "lanes:backward": "CASE WHEN osmid % 4 < 2 THEN '1' END",
    "surface": "CASE osmid % 5 WHEN 0 THEN 'gravel' WHEN 1 THEN 'sett' WHEN 2 THEN 'cobblestone' ELSE 'asphalt' END",
    "oneway": "CASE WHEN key % 2 = 0 THEN 'yes' END",
    "bicycle_road": "CASE WHEN osmid % 11 = 0 THEN 'yes' END",
    "sidewalk:both:foot": "CASE WHEN osmid % 13 = 0 THEN 'designated' END",
    "sidewalk:both:bicycle": "CASE WHEN osmid % 26 = 0 THEN 'yes' END",
    "sidewalk:left:foot": "CASE WHEN osmid % 17 = 0 THEN 'designated' END",
    "sidewalk:left:bicycle": "CASE WHEN osmid % 17 = 0 THEN 'yes' END",
}


def _kinds(spark, d):
    tags = F.create_map(*[x for k, sql in _TAGS.items() for x in (F.lit(k), F.expr(sql))])
    return streets(spark, d).select("osmid", "key", tags.alias("tags"), (F.col("quantity") > 25).alias("back"), (F.col("tax") * 100).alias("slope"))


_KINDS = f"""{STREETS}, kinds AS (SELECT osmid, key, quantity > 25 AS back, tax * 100 AS slope, {', '.join(f'coalesce({sql}, $$$$) AS "{k}"' for k, sql in _TAGS.items())} FROM streets),
known AS (SELECT *, cycleway = 'lane' OR (NOT back AND "cycleway:right" = 'lane') AS lane, cycleway = 'track' OR (back AND "cycleway:left" = 'track') AS track,
  highway IN ('primary', 'secondary', 'tertiary', 'unclassified') AS main, foot = 'designated' AND bicycle = 'yes' AS shared, lanes = '2' AS wide, lanes = '1' AND "lanes:forward" = '1' AND "lanes:backward" = '1' AS narrow FROM kinds)"""
_MODEL_1 = {
    "has_bike_lane": "lane", "has_bike_path": "bicycle = 'designated'", "has_exclusive_bike_path": "highway = 'cycleway' AND bicycle = 'designated'", "has_bike_track": "track", "is_bike_road": "bicycle_road = 'yes'",
    "is_primary_road": "highway = 'primary'", "is_secondary_road": "highway = 'secondary'", "is_tertiary_road": "highway = 'tertiary'", "is_residential_road": "highway = 'residential'",
    "is_bikeable_pedestrian_street": "highway = 'pedestrian' AND bicycle = 'yes'", "dismount_required": "bicycle = 'dismount'", "is_segregated_bike_and_footpath": "shared AND segregated = 'yes'",
    "is_not_segregated_bike_and_footpath": "shared AND segregated = 'no'",
    "is_bikeable_sidewalk": """((foot = 'designated' OR "sidewalk:both:foot" = 'designated') AND (bicycle = 'yes' OR "sidewalk:both:bicycle" = 'yes')) OR (back AND "sidewalk:left:foot" = 'designated' AND "sidewalk:left:bicycle" = 'yes')""",
}
_MODEL_2 = {
    "medium_road_with_bike_track": "main AND narrow AND track", "medium_road_with_bike_lane": "main AND narrow AND lane", "medium_road_no_bike_infra": "main AND narrow AND NOT track AND NOT lane",
    "large_road_with_bike_track": "main AND wide AND track", "large_road_with_bike_lane": "main AND wide AND lane", "large_road_no_bike_infra": "main AND wide AND NOT track AND NOT lane",
    "residential_road_with_bike_track": "highway = 'residential' AND track", "residential_road_with_bike_lane": "highway = 'residential' AND (lane OR bicycle_road = 'yes')",
    "residential_road_no_bike_infra": "highway = 'residential' AND NOT track AND NOT lane AND bicycle_road <> 'yes'", "is_shared_path": "bicycle = 'designated' AND foot = 'designated'", "is_wrong_way": "back AND oneway = 'yes'",
    "has_gravel": "surface = 'gravel'", "has_cobblestone": "surface IN ('cobblestone', 'sett')", "is_pedestrian_zone": "highway = 'pedestrian'",
    "is_cycleway": "highway = 'cycleway' OR (bicycle = 'designated' AND foot <> 'designated')", "is_footway": "highway = 'footway' OR (foot = 'designated' AND bicycle <> 'designated')",
}


def _names_sql(rules: dict[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {sql} THEN '{name}' END" for name, sql in rules.items()) + "], lambda x: x IS NOT NULL)"


@query(f"WITH {_KINDS} SELECT name, count(*) AS n FROM (SELECT unnest({_names_sql(_MODEL_1 | _MODEL_2)}) AS name FROM known) GROUP BY 1")
def all_predicates(spark, d):
    return T.counted(_kinds(spark, d), "tags", "back", T.MODEL_1 + T.MODEL_2)


def _model_sql(model, rules: dict[str, str]) -> str:
    terms = " ".join(f"+ CASE WHEN {rules[name]} THEN {coefficient!r} ELSE 0.0 END" for name, _, coefficient in model)
    return f"""WITH {_KINDS} SELECT osmid, key, round((1.0 + CASE WHEN slope < 2 THEN 0.0 WHEN slope < 4 THEN 0.371 WHEN slope < 6 THEN 1.203 ELSE 3.239 END {terms})::DOUBLE, 6) AS penalty,
array_to_string({_names_sql(rules)}, ',') AS filters FROM known"""


def _priced(spark, d, model):
    edges = _kinds(spark, d).select("osmid", "key", "tags", F.col("back").alias("reversed"), F.col("slope").alias("slope_percentage"), F.lit(1.0).alias("length"))
    return network.edge_weights(edges, model).select("osmid", "key", F.round("penalty", 6).alias("penalty"), F.array_join("filters", ",").alias("filters"))


@query(_model_sql(T.MODEL_1, _MODEL_1))
def model_1_filters(spark, d):
    return _priced(spark, d, T.MODEL_1)


@query(_model_sql(T.MODEL_2, _MODEL_2))
def model_2_filters(spark, d):
    return _priced(spark, d, T.MODEL_2)


@query(f"""WITH {MOVES}, t AS (SELECT a.u AS u, a.v AS mid, b.v AS v FROM moves a JOIN moves b ON a.v = b.u WHERE a.u <> b.v),
r AS (SELECT *, CASE WHEN v % 2 = 0 THEN 'no' ELSE 'only' END AS rule FROM t WHERE (u + 2 * mid + 3 * v) % 101 = 0)
SELECT u, mid, count(*) AS n FROM t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.rule = 'no' AND r.u = t.u AND r.mid = t.mid AND r.v = t.v)
AND NOT EXISTS (SELECT 1 FROM r WHERE r.rule = 'only' AND r.u = t.u AND r.mid = t.mid AND r.v <> t.v) GROUP BY 1, 2""")
def restricted_turns(spark, d):
    """Turns that restrictions leave, per edge in; every pair of moves is a pair of ways of its own."""
    m = written(_moves(spark, d), "moves")
    at = lambda c: F.col(c).cast("double")
    edges = m.select("u", "v", F.lit(0).alias("key"), (F.col("u") * 1000 + F.col("v")).alias("osmid"), at("u").alias("ux"), F.lit(0.0).alias("uy"), at("v").alias("vx"), F.lit(0.0).alias("vy"))
    turns = written(network.turn_edges(edges), "turns")
    place = F.col("in_edge.u") + 2 * F.col("in_edge.v") + 3 * F.col("out_edge.v")
    rules = turns.where(place % 101 == 0).select("osmid_in", "osmid_out", F.when(F.col("out_edge.v") % 2 == 0, "no_left_turn").otherwise("only_straight_on").alias("restriction"))
    left = network.enforce_restrictions(turns, rules)
    return left.groupBy(F.col("in_edge.u").alias("u"), F.col("in_edge.v").alias("mid")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT l_orderkey AS gap_id, p_size AS osmid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'),
f AS (SELECT gap_id, osmid, min(i) AS i FROM s GROUP BY 1, 2) SELECT gap_id, string_agg(osmid::VARCHAR, ',' ORDER BY i) AS ways FROM f GROUP BY 1""")
def gap_ways(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_size").alias("osmid"))
    return gaps.way_ids(_gap_table(spark, d).select("gap_id", F.col("gap").alias("path")), nodes).select("gap_id", F.array_join("gap", ",").alias("ways"))


@query("""SELECT l_orderkey AS gap_id, count(DISTINCT CASE WHEN p_size % 2 = 0 THEN p_brand END) >= 2 AS connects FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY 1""")
def gap_connects(spark, d):
    roots = table(spark, d, "part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("component"))
    return gaps.connects(_gap_table(spark, d).select("gap_id", F.explode("gap").alias("node")), roots)


@query("""WITH e AS (SELECT l_orderkey AS id, list(l_quantity::DOUBLE ORDER BY l_linenumber, l_quantity) AS e, count(*) - 1 AS n, l_orderkey % 90 + 10.0::DOUBLE AS length FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1),
s AS (SELECT id, n, (e[n + 1] - e[1]) / length * 100 AS whole, list_sort(list_transform(range(1, n + 1), lambda i: (e[i + 1] - e[i]) / (length / n) * 100)) AS s FROM e)
SELECT id, round(CASE WHEN n > 2 THEN list_aggregate(s[2:n - 1], 'median') ELSE whole END, 6) AS slope FROM s""")
def slope_along_lines(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", F.col("l_quantity").cast("double").alias("e"))
    e = li.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "e"))), lambda s: s["e"]).alias("e")).where("size(e) > 1").withColumn("length", (F.col("id") % 90 + 10).cast("double"))
    slope = network.robust_slope(network.slopes_along(F.col("e"), F.col("length")), F.get("e", F.size("e") - 1) - F.get("e", F.lit(0)), F.col("length"))
    return e.select("id", F.round(slope, 6).alias("slope"))


@query(f"WITH {POSITIONS}, old AS (SELECT kind, bike, time FROM positions), last AS (SELECT kind, bike, max(time) AS time FROM old WHERE kind = 'click' GROUP BY 1, 2) SELECT kind, count(*) AS n, max(time) AS latest FROM (SELECT * FROM old WHERE kind <> 'click' UNION ALL SELECT * FROM last) GROUP BY 1")
def replaced_partition(spark, d):
    """A table by kind whose partition of clicks is replaced by the last click of each bike."""
    path = fresh_path(spark, "by-kind")
    rows = positions(spark, d).select("kind", "bike", "time")
    sinks.replace_partitions(rows, path, ["kind"])
    sinks.replace_partitions(rows.where("kind = 'click'").groupBy("kind", "bike").agg(F.max("time").alias("time")), path, ["kind"])
    return spark.read.parquet(path).groupBy("kind").agg(F.count("*").alias("n"), F.max("time").alias("latest"))
