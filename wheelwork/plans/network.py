"""Queries over street edges: costs, turns, components, routes, betweenness, gaps, clusters."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from wheelwork.functions import tags as T
from wheelwork.operators import components as C
from wheelwork.operators import gaps, kmodes, network, relaxed, routing
from wheelwork.operators.lineage import written
from wheelwork.operators.statistics import described
from wheelwork.plans.inputs import STREETS, positions, streets, table
from wheelwork.plans.mobility import RIDES_SQL

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


HIGHWAYS = ["primary", "secondary", "tertiary", "residential", "cycleway", "footway", "pedestrian"]


def _tagged(spark, d):
    """Streets with tags: the road kind by line number, bicycle and one-way tags by flag and status."""
    s = streets(spark, d)
    tags = F.create_map(
        F.lit("highway"), F.element_at(F.array(*map(F.lit, HIGHWAYS)), (F.col("key") - 1) % 7 + 1), F.lit("cycleway"), F.when(F.col("flag") == "R", "lane").when(F.col("flag") == "A", "track").otherwise("no"),
        F.lit("bicycle"), F.when(F.col("share") > 0.05, "designated").otherwise("yes"), F.lit("oneway:bicycle"), F.when(F.col("tax") < 0.02, "no").otherwise("yes"),
    )
    return s.withColumn("tags", tags).withColumn("reversed", F.col("quantity") > 25).withColumn("slope_percentage", F.col("tax") * 100).withColumn("oneway", F.col("flag") == "N")


_KIND = "[" + ", ".join(f"'{h}'" for h in HIGHWAYS) + "][(key - 1) % 7 + 1]"
_PENALTY = f"""(1.0 + CASE WHEN tax * 100 < 2 THEN 0.0 WHEN tax * 100 < 4 THEN 0.371 WHEN tax * 100 < 6 THEN 1.203 ELSE 3.239 END
  + CASE WHEN flag = 'R' THEN -0.16 ELSE 0 END + CASE WHEN share > 0.05 THEN -0.16 ELSE 0 END + CASE WHEN {_KIND} = 'cycleway' AND share > 0.05 THEN -0.16 ELSE 0 END + CASE WHEN flag = 'A' THEN -0.16 ELSE 0 END
  + CASE {_KIND} WHEN 'primary' THEN 7.15 WHEN 'secondary' THEN 1.0 WHEN 'tertiary' THEN 0.37 WHEN 'residential' THEN 0.1 ELSE 0 END
  + CASE WHEN {_KIND} = 'pedestrian' AND share <= 0.05 THEN 0.2 ELSE 0 END)"""


@query(f"WITH {STREETS} SELECT osmid, key, round(({_PENALTY})::DOUBLE, 6) AS penalty, round(length * round(({_PENALTY})::DOUBLE, 6), 5) AS weight FROM streets")
def edge_weights(spark, d):
    return network.edge_weights(_tagged(spark, d)).select("osmid", "key", F.round("penalty", 6).alias("penalty"), F.round(F.col("length") * F.round("penalty", 6), 5).alias("weight"))


@query(f"WITH {STREETS}, p AS (SELECT {_KIND} AS highway, count(*) FILTER (flag = 'R') AS lanes, count(*) FILTER (flag = 'A') AS tracks, count(*) FILTER (share > 0.05) AS paths FROM streets GROUP BY 1) SELECT * FROM p")
def tag_predicates(spark, d):
    t, back = F.col("tags"), F.col("reversed")
    return _tagged(spark, d).groupBy(T.tag(t, "highway").alias("highway")).agg(F.count_if(T.has_bike_lane(t, back)).alias("lanes"), F.count_if(T.has_bike_track(t, back)).alias("tracks"), F.count_if(T.has_bike_path(t, back)).alias("paths"))


@query(f"WITH {STREETS}, s AS (SELECT *, {_KIND} AS highway FROM streets) SELECT count(*) AS n, count(*) FILTER (regexp_matches(highway, '^(primary|secondary)$')) AS main, count(*) FILTER (NOT regexp_matches(highway, 'way$')) AS roads FROM s")
def tag_filters(spark, d):
    t = F.col("tags")
    return _tagged(spark, d).agg(F.count("*").alias("n"), F.count_if(T.matches(t, "highway", "^(primary|secondary)$")).alias("main"), F.count_if(T.not_matches(t, "highway", "way$")).alias("roads"))


@query(f"""WITH {STREETS}, c AS (SELECT *, CASE {_KIND} WHEN 'primary' THEN 1 WHEN 'secondary' THEN 2 WHEN 'tertiary' THEN 3 WHEN 'residential' THEN 4 ELSE 5 END AS cls, CASE WHEN quantity < 17 THEN 'left' WHEN quantity > 34 THEN 'right' ELSE 'straight' END AS turn FROM streets)
SELECT osmid, key, CASE WHEN turn = 'straight' THEN CASE WHEN 3 > cls THEN 1609.34 * 0.042 ELSE 0.00001 END WHEN cls = 1 AND turn = 'left' THEN 1609.34 * 0.231 WHEN cls = 1 THEN 1609.34 * 0.322 WHEN cls = 2 AND turn = 'left' THEN 1609.34 * 0.091
WHEN cls = 2 THEN 1609.34 * 0.059 WHEN cls = 3 AND turn = 'left' THEN 1609.34 * 0.091 WHEN cls = 3 THEN 1609.34 * 0.038 ELSE 1609.34 * 0.042 END::DOUBLE AS penalty FROM c""")
def turn_penalty(spark, d):
    turn = F.when(F.col("quantity") < 17, "left").when(F.col("quantity") > 34, "right").otherwise("straight")
    return _tagged(spark, d).select("osmid", "key", T.turn_penalty(turn, T.street_class(F.col("tags")), F.lit(3)).alias("penalty"))


@query(f"""WITH {STREETS}, o AS (SELECT *, flag = 'N' AS oneway, quantity > 25 AS reversed, tax < 0.02 AS open, u % 977 / 10.0::DOUBLE AS ux, u % 31 / 10.0::DOUBLE AS uy, v % 977 / 10.0::DOUBLE AS vx, v % 31 / 10.0::DOUBLE AS vy FROM streets)
SELECT u, v, key, osmid, oneway AND NOT open AS oneway, reversed, ux, uy, vx, vy, concat_ws(';', ux, quantity, vx) AS line FROM o
UNION ALL SELECT v, u, key, osmid, false, true, vx, vy, ux, uy, concat_ws(';', vx, quantity, ux) FROM o WHERE oneway AND open""")
def oneway_fix(spark, d):
    """Streets and the ways back that bicycles may take, with ends and geometry turned round."""
    at = lambda c, m: (F.col(c) % m / 10.0).alias(c + ("x" if m == 977 else "y"))
    e = _tagged(spark, d).select("*", at("u", 977), at("u", 31), at("v", 977), at("v", 31))
    e = e.withColumn("geometry", F.array("ux", "quantity", "vx"))
    line = F.array_join(F.transform("geometry", lambda x: x.cast("string")), ";")
    return network.open_oneways(e).select("u", "v", "key", "osmid", "oneway", "reversed", "ux", "uy", "vx", "vy", line.alias("line"))


@query(f"WITH {STREETS} SELECT osmid, key FROM streets WHERE NOT (tax >= 0.02 AND quantity > 25)")
def close_oneways(spark, d):
    return network.close_oneways(_tagged(spark, d)).select("osmid", "key")


# transitions between places of bikes: a small dense graph
MOVES = """moves AS (SELECT u, v, count(*)::DOUBLE AS trips FROM (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS v, lag(CAST(json_extract_string(props, '$.k') AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, CAST(json_extract_string(props, '$.k') AS BIGINT)) AS u FROM events) WHERE u <> v GROUP BY 1, 2)"""


def _moves(spark, d):
    from wheelwork.operators.versions import rides_from_changes

    r = rides_from_changes(positions(spark, d).select("bike", "time", "place"), "bike", "time", ["place"])
    return r.groupBy(F.col("start_place").alias("u"), F.col("finish_place").alias("v")).agg(F.count("*").cast("double").alias("trips"))


def _network(spark, d):
    return _priced(_moves(spark, d))


def _priced(moves):
    return moves.select("u", "v", (100.0 / F.col("trips")).alias("length"), (100.0 / F.col("trips")).alias("weight"))


@query(f"WITH {MOVES} SELECT least(u, v) AS u, greatest(u, v) AS v, sum(trips) AS trips FROM moves GROUP BY 1, 2")
def both_directions(spark, d):
    return network.one_direction(_moves(spark, d), "trips")


@query(f"""WITH {MOVES} SELECT a.u AS u, a.v AS mid, b.v AS v, least(a.trips, b.trips) AS trips FROM moves a JOIN moves b ON a.v = b.u WHERE a.u <> b.v""")
def turn_edges(spark, d):
    """Turns between all moves."""
    return _turns(written(_moves(spark, d), "moves"))


def _turns(m):
    at = lambda c: F.col(c).cast("double")
    edges = m.select("u", "v", F.lit(0).alias("key"), (F.col("u") * 1000 + F.col("v")).alias("osmid"), (at("u") / 100).alias("ux"), F.lit(0.0).alias("uy"), (at("v") / 100).alias("vx"), F.lit(0.0).alias("vy"))
    t = network.turn_edges(edges)
    a = m.select(F.col("u").alias("_u"), F.col("v").alias("_m"), F.col("trips").alias("_a"))
    b = m.select(F.col("u").alias("_m"), F.col("v").alias("_v"), F.col("trips").alias("_b"))
    flat = t.select(F.col("in_edge.u").alias("_u"), F.col("in_edge.v").alias("_m"), F.col("out_edge.v").alias("_v"))
    return flat.join(a, ["_u", "_m"]).join(b, ["_m", "_v"]).select(F.col("_u").alias("u"), F.col("_m").alias("mid"), F.col("_v").alias("v"), F.least("_a", "_b").alias("trips"))


_ROOTS = f"""WITH RECURSIVE {STREETS}, e AS (SELECT u AS a, v AS b FROM streets UNION SELECT v, u FROM streets),
r(node, root) USING KEY (node) AS (SELECT a, least(a, min(b)) FROM e GROUP BY 1 UNION SELECT e.b, min(r.root) FROM r JOIN e ON e.a = r.node JOIN recurring.r AS k ON k.node = e.b WHERE r.root < k.root GROUP BY 1),
roots AS (SELECT node, root AS component FROM r)"""


def _all_edges(spark, d):
    return streets(spark, d).select("u", "v", "length")


@query(f"{_ROOTS} SELECT node, component FROM roots")
def components(spark, d):
    """Components of all streets."""
    return C.components(_all_edges(spark, d))


@query(f"""{_ROOTS}, l AS (SELECT component, count(*) AS n_edges, sum(length) AS length FROM streets JOIN roots ON u = node GROUP BY 1)
SELECT count(*) AS n, avg(length) AS mean, median(length) AS median, min(length) AS least, max(length) AS most, stddev_pop(length) AS std, quantile_cont(length, 0.05) AS p5, quantile_cont(length, 0.3) AS p30, sum(n_edges)::BIGINT AS n_edges, max(length) / sum(length) AS share FROM l""")
def component_stats(spark, d):
    """Lengths of components, all edges, and the largest one's share of the network."""
    lengths = written(C.component_lengths(_all_edges(spark, d)), "lengths")
    out = described(lengths, "length", [50, 5, 30], std=F.stddev_pop("length"), n_edges=F.sum("n_edges"), share=F.max("length") / F.sum("length"))
    return out.select("n", "mean", F.get("_c", F.lit(0)).alias("median"), "least", "most", "std", F.get("_c", F.lit(1)).alias("p5"), F.get("_c", F.lit(2)).alias("p30"), "n_edges", "share")


@query(f"{_ROOTS}, l AS (SELECT component, sum(length) AS s FROM streets JOIN roots ON u = node GROUP BY 1) SELECT u, v, length FROM streets JOIN roots ON u = node JOIN l USING (component) WHERE s >= 80000")
def drop_short_components(spark, d):
    return C.drop_short(_all_edges(spark, d), 80000.0)


@query(f"{_ROOTS}, l AS (SELECT component, count(*) AS n_edges, sum(length) AS length FROM streets JOIN roots ON u = node GROUP BY 1) SELECT component, n_edges, round(length, 2) AS length FROM l ORDER BY l.length DESC, component LIMIT 10")
def longest_components(spark, d):
    return C.component_lengths(_all_edges(spark, d)).orderBy(F.desc("length"), "component").limit(10).select("component", "n_edges", F.round("length", 2).alias("length"))


_COSTS = f"""WITH RECURSIVE {MOVES}, e AS (SELECT u, v, 100.0 / trips AS w FROM moves), r(s, n, c, k) AS (
  SELECT u, u, 0.0::DOUBLE, 0 FROM (SELECT u FROM e UNION SELECT v FROM e) UNION ALL
  SELECT s, v, min(c + w), any_value(k) + 1 FROM r JOIN e ON r.n = e.u WHERE k < 4 GROUP BY s, v)"""


@query(f"{_COSTS} SELECT s AS source, n AS node, round(min(c), 6) AS cost FROM r GROUP BY 1, 2")
def reach_in_steps(spark, d):
    """Reach of every place over four moves, also of those that no move leaves."""
    e = written(_network(spark, d), "network")
    sources = e.select(F.col("u").alias("node")).union(e.select(F.col("v").alias("node"))).distinct()
    return routing.reach(e, sources, "weight", 4).select("source", "node", F.round("cost", 6).alias("cost"))


def _routes(spark, d):
    m = written(_moves(spark, d), "moves")
    return routing.shortest_paths(_priced(m), m.select(F.col("u").alias("origin"), F.col("v").alias("destination")))


_DISTANCES = f"""WITH RECURSIVE {MOVES}, e AS (SELECT u, v, 100.0 / trips AS w FROM moves),
dist(s, n, c) USING KEY (s, n) AS (SELECT u, u, 0.0::DOUBLE FROM (SELECT u FROM e UNION SELECT v FROM e) UNION
  SELECT dist.s, e.v, min(dist.c + e.w) FROM dist JOIN e ON e.u = dist.n LEFT JOIN recurring.dist AS k ON k.s = dist.s AND k.n = e.v WHERE k.c IS NULL OR dist.c + e.w < k.c - 1e-12 GROUP BY 1, 2)"""
_DAG = f"{_DISTANCES}, dag AS MATERIALIZED (SELECT a.s, e.u, e.v, e.w FROM dist a JOIN e ON e.u = a.n JOIN dist b ON b.s = a.s AND b.n = e.v WHERE a.c + e.w <= b.c + 1e-9)"
_ROUTES = f"""{_DAG}, back AS MATERIALIZED (SELECT s, v, min(u) AS u FROM dag GROUP BY 1, 2),
walk(o, d, n, p) AS (SELECT u, v, v, [v] FROM moves UNION ALL SELECT o, d, back.u, list_prepend(back.u, p) FROM walk JOIN back ON back.s = o AND back.v = n WHERE n <> o),
routes AS (SELECT o AS origin, d AS destination, p AS route FROM walk WHERE n = o)"""
_EDGES_OF = "used AS (SELECT origin, destination, route[i] AS u, route[i + 1] AS v FROM (SELECT *, unnest(range(1, len(route))) AS i FROM routes))"


def _between_sql(worth: str, within: str = "true") -> str:
    """Numbers of paths forwards, worths backwards, each a round an edge."""
    return f"""{_DAG}, fwd(s, n, k, span, i) AS (SELECT s, n, 1.0::DOUBLE, 0.0::DOUBLE, 0 FROM dist WHERE s = n UNION ALL SELECT f.s, g.v, sum(k), min(span + g.w), any_value(i) + 1 FROM fwd f JOIN dag g ON g.s = f.s AND g.u = f.n GROUP BY f.s, g.v),
cnt AS MATERIALIZED (SELECT s, n, sum(k) AS k, min(span) AS span FROM fwd GROUP BY 1, 2),
part AS MATERIALIZED (SELECT g.s, g.u, g.v, a.k / b.k AS share FROM dag g JOIN cnt a ON a.s = g.s AND a.n = g.u JOIN cnt b ON b.s = g.s AND b.n = g.v),
bwd(s, n, x, i) AS (SELECT s, n, ({worth})::DOUBLE, 0 FROM cnt WHERE s <> n AND {within} UNION ALL SELECT b.s, p.u, sum(x * share), any_value(i) + 1 FROM bwd b JOIN part p ON p.s = b.s AND p.v = b.n WHERE p.u <> b.s GROUP BY b.s, p.u),
val AS (SELECT s, n, sum(x) AS x FROM bwd GROUP BY 1, 2), tot AS (SELECT p.u, p.v, sum(x * share) AS b FROM val JOIN part p ON p.s = val.s AND p.v = val.n GROUP BY 1, 2),
every AS (SELECT e.u, e.v, coalesce(b, 0) AS b FROM e LEFT JOIN tot ON tot.u = e.u AND tot.v = e.v)"""


@query(f"{_ROUTES} SELECT m.u AS origin, m.v AS destination, array_to_string(route, ',') AS route, round(c, 6) AS cost FROM moves m JOIN routes ON origin = m.u AND destination = m.v JOIN dist ON s = m.u AND n = m.v")
def shortest_paths(spark, d):
    """Of equally cheap routes, backwards the smallest node before each."""
    return _routes(spark, d).select("origin", "destination", F.array_join("route", ",").alias("route"), F.round("cost", 6).alias("cost"))


@query(f"{_DISTANCES} SELECT m.u AS origin, m.v AS destination, round(c, 6) AS cost FROM moves m LEFT JOIN dist ON s = m.u AND n = m.v")
def path_costs(spark, d):
    """The cost of the shortest path of every pair that has a move."""
    return _routes(spark, d).select("origin", "destination", F.round("cost", 6).alias("cost"))


@query(f"{_ROUTES}, {_EDGES_OF} SELECT e.u, e.v, count(used.u) AS n FROM e LEFT JOIN used ON used.u = e.u AND used.v = e.v GROUP BY 1, 2")
def edge_usage(spark, d):
    return routing.edge_usage(_network(spark, d), _routes(spark, d))


@query(f"{_ROUTES}, {_EDGES_OF} SELECT origin, destination, round(sum(w), 6) AS length, count(*) AS n_edges FROM used JOIN e USING (u, v) GROUP BY 1, 2")
def route_lengths(spark, d):
    e = _network(spark, d)
    return routing.route_edges(_routes(spark, d)).join(e, ["u", "v"]).groupBy("origin", "destination").agg(F.round(F.sum("length"), 6).alias("length"), F.count("*").alias("n_edges"))


@query(f"{_between_sql('1.0')} SELECT u, v, round(b, 6) AS betweenness FROM every")
def betweenness(spark, d):
    return routing.betweenness(_network(spark, d)).select("u", "v", F.round("betweenness", 6).alias("betweenness"))


@query(f"{_between_sql('1.0')} SELECT u, v, round(b, 6) AS betweenness FROM every")
def betweenness_by_joins(spark, d):
    """The same without any worker holding the graph."""
    e = written(_network(spark, d), "network")
    nodes = e.select(F.col("u").alias("node")).union(e.select(F.col("v").alias("node")))
    found = relaxed.betweenness(e, nodes, "weight", "length", 0.0, float("inf"), "count", {})
    return e.select("u", "v").join(found, ["u", "v"], "left").select("u", "v", F.round(F.coalesce("betweenness", F.lit(0.0)), 6).alias("betweenness"))


@query(f"{_ROUTES} SELECT origin, destination, array_to_string(route, ',') AS route FROM routes")
def routes_by_joins(spark, d):
    """Routes of all moves without any worker holding the graph."""
    m = written(_moves(spark, d), "moves")
    found = relaxed.routes(_priced(m), m.select(F.col("u").alias("origin"), F.col("v").alias("destination")))
    return found.select("origin", "destination", F.array_join("route", ",").alias("route"))


@query(f"{_between_sql('CASE WHEN span <> 0 THEN 1 / (span * span) ELSE 0 END', 'span BETWEEN 1.0 AND 200.0')} SELECT u, v, round(b / max(b) OVER (), 9) AS betweenness FROM every")
def betweenness_gravity(spark, d):
    return routing.betweenness(_network(spark, d), lower=1.0, upper=200.0, pair_weight="gravity", normalized=True).select("u", "v", F.round("betweenness", 9).alias("betweenness"))


@query(f"""{_DISTANCES}, a AS (SELECT s AS node, least(1.0, (30.0 - c) / w) AS share FROM dist JOIN e ON e.u = dist.n WHERE c <= 30.0 AND s IN (SELECT u FROM e))
SELECT node, count(*) AS n_edges, round(sum(share), 6) AS shares FROM a WHERE share > 0 GROUP BY 1""")
def service_area(spark, d):
    e = written(_network(spark, d), "network")
    return routing.service_area(e, e.select(F.col("u").alias("node")), 30.0).groupBy("node").agg(F.count("*").alias("n_edges"), F.round(F.sum("share"), 6).alias("shares"))


def _gap_table(spark, d):
    """Gaps: the streets of each order's returned items, as lists of parts in line order."""
    r = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    return r.groupBy(F.col("l_orderkey").alias("gap_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_partkey"]).alias("gap"))


@query("""WITH g AS (SELECT l_orderkey AS gap_id, l_partkey AS edge, sum(round(l_extendedprice * 100)) AS length, max(l_quantity) AS b FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT gap_id, sum(length) AS length, avg(b) AS mean_betweenness, max(b) AS max_betweenness, min(b) AS min_betweenness, sum(length) * (sum(b) / count(*)) AS benefit FROM g GROUP BY 1""")
def gap_metrics(spark, d):
    """Lengths in whole centimetres, so sums do not depend on their order."""
    e = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("gap_id"), F.col("l_partkey").alias("edge")).agg(F.sum(F.round(F.col("l_extendedprice") * 100)).alias("length"), F.max("l_quantity").alias("betweenness"))
    return gaps.metrics(e)


_GAPS = "g AS (SELECT l_orderkey AS gap_id, list(l_partkey ORDER BY l_linenumber, l_partkey) AS gap FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)"


@query(f"""WITH {_GAPS}, i AS (SELECT DISTINCT gap_id, unnest(gap) AS id FROM g), c AS (SELECT DISTINCT a.gap_id, b.gap_id AS other_id FROM i a JOIN i b USING (id) WHERE a.gap_id <> b.gap_id),
s AS (SELECT g.gap_id, g.gap, o.gap AS other, c.other_id FROM c JOIN g USING (gap_id) JOIN g o ON o.gap_id = c.other_id),
d AS (SELECT gap_id FROM s WHERE contains(',' || array_to_string(other, ',') || ',', ',' || array_to_string(gap, ',') || ',') AND (len(gap) < len(other) OR other_id < gap_id))
SELECT gap_id, array_to_string(gap, ',') AS gap FROM g WHERE gap_id NOT IN (SELECT gap_id FROM d)""")
def sublist(spark, d):
    return gaps.without_sublists(_gap_table(spark, d)).select("gap_id", F.array_join("gap", ",").alias("gap"))


@query(f"WITH {_GAPS} SELECT gap_id FROM g QUALIFY row_number() OVER (PARTITION BY least(gap, list_reverse(gap)) ORDER BY gap_id) = 1")
def reversed_gaps(spark, d):
    return gaps.without_reversed(_gap_table(spark, d)).select("gap_id")


@query("""WITH g AS (SELECT DISTINCT l_orderkey AS gap_id, l_partkey AS edge, l_partkey % 1000 + 1.0 AS length FROM lineitem WHERE l_returnflag = 'R'), t AS (SELECT gap_id, sum(length) AS l FROM g GROUP BY 1)
SELECT a.gap_id, b.gap_id AS other_id, round(sum(a.length) / least(any_value(x.l), any_value(y.l)), 9) AS overlap FROM g a JOIN g b ON a.edge = b.edge AND a.gap_id < b.gap_id JOIN t x ON x.gap_id = a.gap_id JOIN t y ON y.gap_id = b.gap_id GROUP BY 1, 2""")
def gap_overlaps(spark, d):
    return gaps.overlaps(_overlap_edges(spark, d)).select("gap_id", "other_id", F.round("overlap", 9).alias("overlap"))


def _overlap_edges(spark, d):
    return table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("gap_id"), F.col("l_partkey").alias("edge"), (F.col("l_partkey") % 1000 + 1.0).cast("double").alias("length")).distinct()


@query("""WITH RECURSIVE g AS (SELECT DISTINCT l_orderkey AS gap_id, l_partkey AS edge, l_partkey % 1000 + 1.0 AS length FROM lineitem WHERE l_returnflag = 'R'), t AS (SELECT gap_id, sum(length) AS l FROM g GROUP BY 1),
o AS (SELECT a.gap_id AS a, b.gap_id AS b FROM g a JOIN g b ON a.edge = b.edge AND a.gap_id < b.gap_id JOIN t x ON x.gap_id = a.gap_id JOIN t y ON y.gap_id = b.gap_id GROUP BY 1, 2 HAVING sum(a.length) / least(any_value(x.l), any_value(y.l)) > 0.9),
e AS (SELECT a, b FROM o UNION SELECT b, a FROM o),
r(node, root) USING KEY (node) AS (SELECT a, least(a, min(b)) FROM e GROUP BY 1 UNION SELECT e.b, min(r.root) FROM r JOIN e ON e.a = r.node JOIN recurring.r AS k ON k.node = e.b WHERE r.root < k.root GROUP BY 1)
SELECT gap_id, coalesce(root, gap_id) AS merged_id FROM t LEFT JOIN r ON node = gap_id""")
def gap_merge(spark, d):
    return gaps.merged(_overlap_edges(spark, d))


def _greedy_sql(k: int) -> str:
    """One pick after the other, each scored over what those before have left."""
    steps = ["c AS (SELECT DISTINCT l_suppkey AS gap_id, l_partkey AS cell, (l_partkey % 97 + 1.0)::DOUBLE AS population FROM lineitem)", "k0 AS MATERIALIZED (SELECT DISTINCT l_partkey AS cell FROM lineitem WHERE l_quantity = 50)"]
    for i in range(1, k + 1):
        before = " UNION ALL ".join(f"SELECT gap_id FROM p{j}" for j in range(1, i)) or "SELECT NULL WHERE false"
        steps.append(f"p{i} AS MATERIALIZED (SELECT {i} AS rank, gap_id, coalesce(sum(population) FILTER (WHERE k.cell IS NULL), 0) AS added FROM c LEFT JOIN k{i - 1} k USING (cell) WHERE gap_id NOT IN ({before}) GROUP BY gap_id ORDER BY added DESC, gap_id LIMIT 1)")
        steps.append(f"k{i} AS MATERIALIZED (SELECT cell FROM k{i - 1} UNION SELECT cell FROM c WHERE gap_id = (SELECT gap_id FROM p{i}))")
    return f"WITH {', '.join(steps)} " + " UNION ALL ".join(f"SELECT rank, gap_id, added FROM p{i}" for i in range(1, k + 1))


@query(_greedy_sql(11))
def gap_rank(spark, d):
    cells = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("gap_id"), F.col("l_partkey").alias("cell"), (F.col("l_partkey") % 97 + 1.0).cast("double").alias("population")).distinct()
    covered = table(spark, d, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("cell")).distinct()
    return gaps.greedy_rank(cells, covered, 11)


@query(f"""WITH RECURSIVE {MOVES}, e AS (SELECT u, v FROM moves WHERE u < v AND trips >= 4),
p(start, path, last) AS (SELECT u, [u], u FROM (SELECT DISTINCT u FROM e WHERE u NOT IN (SELECT v FROM e)) UNION ALL SELECT start, list_append(path, e.v), e.v FROM p JOIN e ON e.u = p.last)
SELECT start, array_to_string(path, ',') AS path FROM p WHERE len(path) > 1 AND last NOT IN (SELECT u FROM e)""")
def gap_paths(spark, d):
    """Gaps over relevant moves: those to higher places with 4 trips or more, which is what a gap is made of here."""
    e = _moves(spark, d).where("u < v AND trips >= 4").select("u", "v")
    return gaps.simple_paths(e).select("start", F.array_join("path", ",").alias("path"))


@query(f"""WITH RECURSIVE {MOVES}, e AS (SELECT u, v FROM moves WHERE u < v AND trips >= 4),
f(n, c, i) AS (SELECT DISTINCT u, 1::HUGEINT, 0 FROM e WHERE u NOT IN (SELECT v FROM e) UNION ALL SELECT e.v, sum(c)::HUGEINT, any_value(i) + 1 FROM f JOIN e ON e.u = f.n GROUP BY e.v),
b(n, c, i) AS (SELECT DISTINCT v, 1::HUGEINT, 0 FROM e WHERE v NOT IN (SELECT u FROM e) UNION ALL SELECT e.u, sum(c)::HUGEINT, any_value(i) + 1 FROM b JOIN e ON e.v = b.n GROUP BY e.u),
x AS (SELECT n, sum(c) AS c FROM f GROUP BY 1), y AS (SELECT n, sum(c) AS c FROM b GROUP BY 1)
SELECT n AS node, x.c::VARCHAR AS n_before, y.c::VARCHAR AS n_after, (x.c * y.c)::VARCHAR AS n_paths FROM x JOIN y USING (n)""")
def gap_path_counts(spark, d):
    """How many of the paths that ``gap_paths`` lists go through each place, without listing them."""
    e = _moves(spark, d).where("u < v AND trips >= 4").select("u", "v")
    return gaps.path_counts(e).select("node", *[F.col(c).cast("string").alias(c) for c in ("n_before", "n_after", "n_paths")])


@query()
def kmodes_cost(spark, d):
    """The cost of 2 to 40 clusters by three ways of first centres."""
    rows = table(spark, d, "part").select("p_brand", "p_type", F.col("p_size").cast("string").alias("p_size"))
    return kmodes.sweep(rows, ["p_brand", "p_type", "p_size"], list(range(2, 41)), ("random", "cao", "huang"))


@query(f"WITH {RIDES_SQL} SELECT bike, start_time, finish_time, start_place, finish_place FROM rides")
def stream_rides(spark, d):
    """Rides from the events replayed as a stream, equal to rides_from_changes."""
    from wheelwork.streaming.replay import replay_rides

    return replay_rides(spark, os.path.join(d, "events.parquet"))


@query("SELECT ts::DATE AS date, count(DISTINCT user_id) AS n, sum(DISTINCT user_id)::BIGINT AS bikes FROM events GROUP BY 1")
def stream_days(spark, d):
    """The bikes of each day from the events replayed as a stream, each day written once."""
    from wheelwork.streaming.replay import replay_days

    days = replay_days(spark, os.path.join(d, "events.parquet"))
    return days.select("date", "n", F.aggregate("keys", F.lit(0).cast("bigint"), lambda s, k: s + k).alias("bikes"))
