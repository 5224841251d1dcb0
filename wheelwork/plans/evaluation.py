"""Queries of betweenness inputs and follow-up, and of gap evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wheelwork.operators import evaluation as E
from wheelwork.operators import network as N
from wheelwork.plans.inputs import STREETS, streets, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _edges(spark, d):
    """Streets with a betweenness (the tax in percent less the share) and infrastructure on every seventh way."""
    return streets(spark, d).select("u", "v", "key", "osmid", "length", "flag", (F.col("tax") * 100 - F.col("share") * 10).alias("betweenness"))


def _infra(spark, d):
    return table(spark, d, "orders").where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("osmid"))


_EDGES = f"{STREETS}, edges AS (SELECT u, v, key, osmid, length, flag, tax * 100 - share * 10 AS betweenness FROM streets), infra AS (SELECT o_orderkey AS osmid FROM orders WHERE o_orderkey % 7 = 0)"


@query(f"""WITH {_EDGES}, n AS (SELECT u AS node, 1 AS o, 0 AS i, false AS t FROM edges UNION ALL SELECT v, 0, 1, false FROM edges UNION ALL SELECT u, 0, 0, true FROM edges WHERE flag = 'N' AND key = 7),
g AS (SELECT node, sum(o) AS o, sum(i) AS i, bool_or(t) AS t FROM n GROUP BY 1) SELECT node, i = 0 OR t AS is_start, o = 0 OR t AS is_target FROM g WHERE i = 0 OR o = 0 OR t""")
def start_and_target_nodes(spark, d):
    e = _edges(spark, d)
    return E.start_and_target_nodes(e, e.where("flag = 'N' AND key = 7"))


@query(f"""WITH {_EDGES}, s AS (SELECT u, v, CASE WHEN osmid % 3 > 0 THEN (osmid % 1000)::DOUBLE ELSE 0 END / 2 AS half FROM edges)
SELECT node, round(sum(half), 3) AS area FROM (SELECT u AS node, half FROM s UNION ALL SELECT v, half FROM s) GROUP BY 1""")
def node_areas(spark, d):
    areas = table(spark, d, "orders").where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("osmid"), (F.col("o_orderkey") % 1000).cast("double").alias("area"))
    return E.node_areas(_edges(spark, d), areas).select("node", F.round("area", 3).alias("area"))


@query("""WITH s AS (SELECT o_custkey AS node, count(*) AS starts, round(sum(o_totalprice) / 10000, 6) AS ends FROM orders GROUP BY 1)
SELECT c_custkey AS node, 0.0::DOUBLE AS area, c_acctbal AS population, coalesce(starts, 0)::DOUBLE AS starts, coalesce(ends, 0)::DOUBLE AS ends, CASE WHEN starts >= 8 THEN starts ELSE 0 END::DOUBLE AS starts_cutoff, CASE WHEN ends >= 8 THEN ends ELSE 0 END::DOUBLE AS ends_cutoff
FROM customer LEFT JOIN s ON node = c_custkey""")
def node_demand(spark, d):
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("node"))
    demand = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("node")).agg(F.count("*").alias("starts"), F.round(F.sum("o_totalprice") / 10000, 6).alias("ends"))
    none = nodes.limit(0).select("node", F.lit(0.0).alias("area"))
    return E.with_demand(nodes, none, table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_acctbal").alias("population")), demand, 8)


_PAIRS = {"spatial": "prod", "multiplication": "prod", "gravity": "CASE WHEN dist <> 0 THEN prod / (dist * dist) ELSE 0 END", "exponential": "prod * exp(-dist)"}


@query("WITH p AS (SELECT l_orderkey AS id, l_linenumber AS line, l_quantity * l_discount * 2 AS prod, (l_quantity + l_discount) * 2 AS added, l_tax * 100 AS dist FROM lineitem) SELECT id, line, round(prod, 9) AS spatial, "
       + ", ".join(f"round({x}, 9) AS {w}" for w, x in _PAIRS.items() if w != "spatial") + ", round(added, 6) AS added FROM p")
def pair_weights(spark, d):
    a, b, dist = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax") * 100
    ways = [F.round(E.pair_weight(w, a, b, dist, factor=2.0), 9).alias(w) for w in _PAIRS]
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), *ways, F.round(E.pair_weight("spatial", a, b, dist, "add", 2.0), 6).alias("added"))


@query(f"""WITH {_EDGES} SELECT CASE flag WHEN 'A' THEN 'left' WHEN 'N' THEN 'straight' ELSE 'right' END AS turn_direction, count(*) AS n, round(sum(betweenness), 4) AS total, round(avg(betweenness), 6) AS mean, min(betweenness) AS least, max(betweenness) AS most FROM edges GROUP BY 1""")
def betweenness_by_turn(spark, d):
    turn = F.when(F.col("flag") == "A", "left").when(F.col("flag") == "N", "straight").otherwise("right")
    return E.by_turn(_edges(spark, d).withColumn("turn_direction", turn)).select("turn_direction", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"), "least", "most")


@query(f"WITH {_EDGES} SELECT least(0, min(betweenness)) AS least, greatest(0, max(betweenness)) AS most FROM edges WHERE osmid NOT IN (SELECT osmid FROM infra)")
def betweenness_range(spark, d):
    return E.betweenness_range(_edges(spark, d), _infra(spark, d))


@query(f"""WITH {_EDGES}, x AS (SELECT u, v, key, max(betweenness) AS b FROM edges WHERE length > 20000 GROUP BY 1, 2, 3),
r AS (SELECT least(0, min(betweenness)) AS lo, greatest(0, max(betweenness)) AS hi FROM edges WHERE length > 20000 AND osmid NOT IN (SELECT osmid FROM infra))
SELECT e.u, e.v, e.key, e.osmid, round(x.b, 6) AS betweenness, round(CASE WHEN e.osmid NOT IN (SELECT osmid FROM infra) AND hi > lo THEN (coalesce(x.b, 0) - lo) / (hi - lo) END, 6) AS shade
FROM edges e LEFT JOIN x ON x.u = e.u AND x.v = e.v AND x.key = e.key, r""")
def betweenness_on_base(spark, d):
    e = _edges(spark, d)
    expanded = e.select(F.when(F.col("length") > 20000, F.struct("u", "v", "key")).alias("old_edge"), "osmid", "betweenness")
    out = E.onto_base(e.select("u", "v", "key", "osmid"), expanded, _infra(spark, d))
    return out.select("u", "v", "key", "osmid", F.round("betweenness", 6).alias("betweenness"), F.round("shade", 6).alias("shade"))


@query(f"""WITH {_EDGES}, r AS (SELECT l_orderkey AS route, l_suppkey + 1000000000 AS u, l_partkey AS v FROM lineitem), one AS (SELECT u, v, min(osmid) AS osmid FROM edges GROUP BY 1, 2)
SELECT osmid NOT IN (SELECT osmid FROM infra) AS lacking, count(*) AS n, count(DISTINCT (u, v)) AS segments FROM r JOIN one USING (u, v) GROUP BY 1""")
def route_segments(spark, d):
    """Routes are the line items of an order; of parallel streets the one of the smallest way counts."""
    e = _edges(spark, d)
    one = e.groupBy("u", "v").agg(F.min("osmid").alias("osmid"))
    return E.segment_counts(E.route_gaps(e.select(F.col("osmid").alias("route"), "u", "v"), one, _infra(spark, d)))


_CELLS = """cells AS (SELECT DISTINCT l_orderkey AS gap_id, l_partkey AS cell FROM lineitem WHERE l_returnflag = 'R'), covered AS (SELECT DISTINCT l_partkey AS cell FROM lineitem WHERE l_quantity = 50)"""


@query(f"""WITH {_CELLS}, n AS (SELECT gap_id, c.cell, p_size::DOUBLE AS population FROM cells c LEFT JOIN part ON p_partkey = c.cell WHERE c.cell NOT IN (SELECT cell FROM covered))
SELECT g.gap_id, coalesce(count(n.cell) * 2.5, 0)::DOUBLE AS added_area, coalesce(sum(population), 0)::DOUBLE AS added_population FROM (SELECT DISTINCT gap_id FROM cells) g LEFT JOIN n USING (gap_id) GROUP BY 1""")
def gap_added(spark, d):
    li = table(spark, d, "lineitem")
    cells = li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("gap_id"), F.col("l_partkey").alias("cell"))
    people = table(spark, d, "part").select(F.col("p_partkey").alias("cell"), F.col("p_size").cast("double").alias("population"))
    return E.added_by(cells, li.where("l_quantity = 50").select(F.col("l_partkey").alias("cell")), people, 2.5)


@query("""WITH r AS (SELECT l_orderkey AS osmid, l_partkey AS cell FROM lineitem WHERE l_linestatus = 'F'), e AS (SELECT l_orderkey AS osmid, l_suppkey + 1000000000 AS cell FROM lineitem)
SELECT cell FROM r WHERE osmid % 7 = 0 UNION SELECT cell FROM e WHERE osmid % 7 = 0""")
def protected_cells(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("osmid"), "l_partkey", "l_suppkey", "l_linestatus")
    return E.protected_cells(li.where("l_linestatus = 'F'").select("osmid", F.col("l_partkey").alias("cell")), li.select("osmid", (F.col("l_suppkey") + 1_000_000_000).alias("cell")), _infra(spark, d))


@query("""WITH o AS (SELECT n_nationkey AS district, sum(c_acctbal) AS official FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1), m AS (SELECT s_nationkey AS district, sum(s_acctbal) AS measured FROM supplier GROUP BY 1),
j AS (SELECT district, official, measured, official / sum(official) OVER () * 100 AS a, measured / sum(measured) OVER () * 100 AS b FROM o LEFT JOIN m USING (district))
SELECT district, round_even(official, 2) AS official, round_even(measured, 2) AS measured, round_even(a, 2) AS official_share, round_even(b, 2) AS measured_share, round_even((a - b) / a * 100, 2) AS difference FROM j""")
def compare_districts(spark, d):
    """Rounded half to even."""
    return _districts(spark, d).select("district", *[F.bround(c, 2).alias(c) for c in ("official", "measured", "official_share", "measured_share", "difference")])


def _districts(spark, d):
    own = table(spark, d, "nation").select(F.col("n_nationkey").alias("district")).join(table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("district")).agg(F.sum("c_acctbal").alias("official")), "district", "left")
    return E.compare_districts(own, table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("district")).agg(F.sum("s_acctbal").alias("measured")))


@query("""WITH o AS (SELECT n_nationkey AS district, sum(c_acctbal) AS official FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1), m AS (SELECT s_nationkey AS district, sum(s_acctbal) AS measured FROM supplier GROUP BY 1),
j AS (SELECT district, official / sum(official) OVER () * 100 AS a, measured / sum(measured) OVER () * 100 AS b FROM o LEFT JOIN m USING (district))
SELECT district, round((a - b) / a * 100, 6) AS difference FROM j ORDER BY abs((a - b) / a) DESC NULLS LAST, district LIMIT 10""")
def top_differences(spark, d):
    """The ten districts whose shares differ most."""
    return _districts(spark, d).orderBy(F.abs("difference").desc_nulls_last(), "district").limit(10).select("district", F.round("difference", 6).alias("difference"))


@query(f"""WITH {STREETS} SELECT osmid, key, CASE WHEN flag = 'R' OR quantity > 40 OR share < 0.03 THEN 0.0 ELSE round((tax * 100)::DOUBLE, 6) END AS slope FROM streets""")
def edge_slope(spark, d):
    """Two points only, so the slope is end to end; tunnels, bridges and layer -1 are flat."""
    s = streets(spark, d)
    tags = F.map_filter(F.create_map(F.lit("tunnel"), F.when(F.col("flag") == "R", "yes"), F.lit("bridge"), F.when(F.col("quantity") > 40, "yes"), F.lit("layer"), F.when(F.col("share") < 0.03, "-1").otherwise("0")), lambda k, v: v.isNotNull())
    slopes = N.slopes_along(F.array(F.lit(0.0), F.col("tax") * F.col("length")), F.col("length"))
    return s.select("osmid", "key", F.round(N.edge_slope(tags, slopes, F.col("tax") * F.col("length"), F.col("length")), 6).alias("slope"))


@query("""SELECT p_partkey AS node FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50) OR p_partkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50)""")
def without_isolated(spark, d):
    e = table(spark, d, "lineitem").where("l_quantity = 50").select(F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v"))
    return N.without_isolated(table(spark, d, "part").select(F.col("p_partkey").alias("node")), e)


@query("""SELECT l_orderkey AS id, l_linenumber AS line FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND l_partkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def induced_subgraph(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"))
    return N.induced(e, table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("node"))).select("id", "line")


@query("""WITH n AS (SELECT vec_id AS node, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), r AS (SELECT floor(x / 0.1)::BIGINT AS col, floor(y / 0.1)::BIGINT AS row, count(*) AS value FROM n WHERE node % 3 > 0 GROUP BY 1, 2)
SELECT node, value::BIGINT AS elevation FROM n LEFT JOIN r ON floor(x / 0.1)::BIGINT = col AND floor(y / 0.1)::BIGINT = row""")
def node_elevation(spark, d):
    from wheelwork.plans.inputs import points

    p = points(spark, d).select(F.col("id").alias("node"), "x", "y")
    raster = p.where("node % 3 > 0").groupBy(F.floor(F.col("x") / 0.1).cast("bigint").alias("col"), F.floor(F.col("y") / 0.1).cast("bigint").alias("row")).agg(F.count("*").alias("value"))
    return N.with_node_elevation(p, raster, 0.1, 0.1).select("node", "elevation")


@query("""WITH n AS (SELECT vec_id AS node, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), e AS (SELECT vec_id AS id, vec_id AS u, (vec_id * 7 + 3) % (SELECT count(*) FROM embeddings) AS v, vec_id % 2 = 0 AS has FROM embeddings)
SELECT id, CASE WHEN has THEN 0 ELSE a.x END AS x1, CASE WHEN has THEN 1 ELSE b.y END AS y2 FROM e JOIN n a ON a.node = u JOIN n b ON b.node = v""")
def straight_geometry(spark, d):
    from wheelwork.plans.inputs import points

    p = points(spark, d).select(F.col("id").alias("node"), "x", "y")
    n = table(spark, d, "embeddings").agg(F.count("*").alias("n"))
    own = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), F.struct(F.lit(1.0).alias("x"), F.lit(1.0).alias("y")))
    e = p.join(F.broadcast(n)).select(F.col("node").alias("id"), F.col("node").alias("u"), ((F.col("node") * 7 + 3) % F.col("n")).alias("v"), F.when(F.col("node") % 2 == 0, own).alias("geometry"))
    return N.with_straight_geometry(e, p).select("id", F.get("geometry", F.lit(0))["x"].alias("x1"), F.get("geometry", F.lit(1))["y"].alias("y2"))


@query("""SELECT l_orderkey AS id, l_linenumber AS line, array_to_string(list_sort(list_intersect(['all', l_returnflag, l_linestatus], ['all', l_linestatus, CASE WHEN l_quantity > 25 THEN 'R' ELSE 'N' END])), ',') AS filters FROM lineitem""")
def common_filters(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.array(F.lit("all"), "l_returnflag", "l_linestatus").alias("filters_in"), F.array(F.lit("all"), "l_linestatus", F.when(F.col("l_quantity") > 25, "R").otherwise("N")).alias("filters_out"))
    return N.common_filters(li).select("id", "line", F.array_join(F.array_sort("filters"), ",").alias("filters"))


@query(f"WITH {STREETS} SELECT v || '>' || u || '#' || key AS k, count(*) AS n FROM streets GROUP BY 1")
def reversed_keys(spark, d):
    k = streets(spark, d).select(N.reversed_key(F.struct("u", "v", "key")).alias("e"))
    return k.groupBy(F.concat(F.col("e.u").cast("string"), F.lit(">"), F.col("e.v").cast("string"), F.lit("#"), F.col("e.key").cast("string")).alias("k")).agg(F.count("*").alias("n"))


# places by kind of width and share, so that the network falls into many parts
_LAYERED = """li AS (SELECT l_orderkey AS gap_id, l_linenumber AS line, l_orderkey * 10 + l_linenumber AS key, l_suppkey * 10000 + l_quantity::BIGINT * 100 + round(l_discount * 100)::BIGINT + 1000000000000 AS u,
  l_partkey * 10000 + l_quantity::BIGINT * 100 + round(l_discount * 100)::BIGINT AS v, l_extendedprice AS length, l_returnflag AS flag FROM lineitem),
base AS (SELECT u, v, key, length FROM li WHERE flag <> 'R'),
gap AS (SELECT gap_id, u, v, key, length FROM li UNION ALL SELECT * FROM (SELECT gap_id, v AS u, lead(v) OVER (PARTITION BY gap_id ORDER BY line, v) AS v, -key AS key, length / 10 FROM li) WHERE v IS NOT NULL AND key % 3 <> 0)"""


def _layered(spark, d):
    """The network (items that were kept) and gaps (all items of an order, and links between most of its neighbouring ones)."""
    layer = F.col("l_quantity").cast("bigint") * 100 + F.round(F.col("l_discount") * 100).cast("bigint")
    li = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("gap_id"), "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), (F.col("l_suppkey") * 10000 + layer + 1_000_000_000_000).alias("u"),
        (F.col("l_partkey") * 10000 + layer).alias("v"), F.col("l_extendedprice").alias("length"), F.col("l_returnflag").alias("flag"),
    )
    after = F.lead("v").over(Window.partitionBy("gap_id").orderBy("l_linenumber", "v"))
    links = li.select("gap_id", F.col("v").alias("u"), after.alias("v"), (-F.col("key")).alias("key"), (F.col("length") / 10).alias("length")).where("v IS NOT NULL AND key % 3 <> 0")
    return li.where("flag <> 'R'").select("u", "v", "key", "length"), li.select("gap_id", "u", "v", "key", "length").unionByName(links)


@query(f"""WITH RECURSIVE {_LAYERED}, e AS (SELECT u AS a, v AS b FROM base UNION SELECT v, u FROM base),
r(node, root) USING KEY (node) AS (SELECT a, least(a, min(b)) FROM e GROUP BY 1 UNION SELECT e.b, min(r.root) FROM r JOIN e ON e.a = r.node JOIN recurring.r AS k ON k.node = e.b WHERE r.root < k.root GROUP BY 1),
t AS (SELECT (SELECT count(DISTINCT root) FROM r) AS n, (SELECT sum(length) FROM base) AS total),
p AS (SELECT gap_id, coalesce(a.root, g.u) AS a, coalesce(b.root, g.v) AS b, a.root AS ra, b.root AS rb FROM gap g LEFT JOIN r a ON a.node = g.u LEFT JOIN r b ON b.node = g.v),
l AS (SELECT gap_id, a, b FROM p UNION SELECT gap_id, b, a FROM p),
c(gap_id, node, root) USING KEY (gap_id, node) AS (SELECT gap_id, a, least(a, min(b)) FROM l GROUP BY 1, 2 UNION SELECT l.gap_id, l.b, min(c.root) FROM c JOIN l ON l.gap_id = c.gap_id AND l.a = c.node JOIN recurring.c AS k ON k.gap_id = l.gap_id AND k.node = l.b WHERE c.root < k.root GROUP BY 1, 2),
parts AS (SELECT gap_id, count(DISTINCT root) AS parts FROM c GROUP BY 1), k AS (SELECT gap_id, count(DISTINCT x) AS k FROM (SELECT gap_id, ra AS x FROM p UNION ALL SELECT gap_id, rb FROM p) GROUP BY 1),
o AS (SELECT gap_id, sum(length) AS own FROM (SELECT gap_id, u, v, key, any_value(length) AS length FROM gap GROUP BY 1, 2, 3, 4) x WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.u = x.u AND b.v = x.v AND b.key = x.key) GROUP BY 1)
SELECT gap_id, parts < k AS connects, round((total + coalesce(own, 0)) / (n - k + parts), 3) AS mean_length FROM parts JOIN k USING (gap_id) LEFT JOIN o USING (gap_id), t""")
def components_after_gap(spark, d):
    """Every order is a gap, the other orders' kept items are the network."""
    base, gap = _layered(spark, d)
    return E.components_after(gap, base).select("gap_id", "connects", F.round("mean_length", 3).alias("mean_length"))
