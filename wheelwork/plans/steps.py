"""Queries of single steps: row filters, orders and limits, summaries, flattening, formats."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wheelwork.functions import text as X
from wheelwork.operators import gaps, spatial
from wheelwork.operators import sets as U
from wheelwork.operators import statistics as S
from wheelwork.plans.inputs import POINTS, POSITIONS, STREETS, points, positions, streets, table
from wheelwork.plans.places import RING, _ring_sql, crosses_sql

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _rides(spark, d):
    """Line items as rides: distance, duration in minutes, start and finish points of which some are missing."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), (F.col("l_extendedprice") / 10).alias("distance"), (F.col("l_quantity") * 3).alias("minutes"), F.to_date("l_shipdate").alias("day"),
        F.when(F.col("l_partkey") % 11 > 0, F.col("l_partkey")).alias("start"), F.when(F.col("l_suppkey") % 7 > 0, F.col("l_suppkey")).alias("finish"),
    )


_RIDES = """rides AS (SELECT l_orderkey AS id, l_linenumber AS line, l_extendedprice / 10 AS distance, l_quantity * 3 AS minutes, l_shipdate::DATE AS day,
  CASE WHEN l_partkey % 11 > 0 THEN l_partkey END AS start, CASE WHEN l_suppkey % 7 > 0 THEN l_suppkey END AS finish FROM lineitem)"""


@query(f"WITH {_RIDES} SELECT id, line FROM rides WHERE start IS NOT NULL AND finish IS NOT NULL")
def rides_with_ends(spark, d):
    return _rides(spark, d).dropna(subset=["start", "finish"]).select("id", "line")


@query(f"WITH {_RIDES} SELECT id, line FROM rides WHERE distance > 150 AND distance < 20000 AND day NOT IN (DATE '1998-10-03', DATE '1999-05-01')")
def rides_between(spark, d):
    """Rides of more than 150 and less than 20,000 metres, without two days."""
    return _rides(spark, d).where("distance > 150 AND distance < 20000 AND day NOT IN (DATE '1998-10-03', DATE '1999-05-01')").select("id", "line")


@query(f"WITH {_RIDES} SELECT count(*) FILTER (distance <= 150) AS short, count(*) FILTER (distance < 50) AS still FROM rides")
def short_rides(spark, d):
    return _rides(spark, d).agg(F.count_if(F.col("distance") <= 150).alias("short"), F.count_if(F.col("distance") < 50).alias("still"))


@query("SELECT p_partkey AS id FROM part WHERE contains(p_name, 'ring') OR contains(p_type, 'ECO')")
def either_contains(spark, d):
    """Rows whose key or value contains a word."""
    return table(spark, d, "part").where(F.contains("p_name", F.lit("ring")) | F.contains("p_type", F.lit("ECO"))).select(F.col("p_partkey").alias("id"))


_WAYS = "CASE WHEN key = 1 THEN NULL WHEN key % 2 = 0 THEN [osmid] ELSE [osmid, osmid + key] END"


@query(f"""WITH {STREETS}, infra AS (SELECT o_orderkey AS i FROM orders WHERE o_orderstatus = 'F'), e AS (SELECT row_number() OVER () AS n, osmid, key, unnest({_WAYS}) AS w FROM streets WHERE share >= 0.13 / 2)
SELECT osmid, key FROM e GROUP BY n, osmid, key HAVING count(*) FILTER (w NOT IN (SELECT i FROM infra)) > 0""")
def relevant_edges(spark, d):
    """Edges with a share of at least half of 0.13 that lack infrastructure (ways of finished orders have it); every first line of an order has no way, others one or two."""
    infra = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("osmid"))
    ways = F.when(F.col("key") == 1, None).when(F.col("key") % 2 == 0, F.array("osmid")).otherwise(F.array("osmid", F.col("osmid") + F.col("key")))
    # a line of an order is an edge of its own
    e = streets(spark, d).select("u", "v", F.struct("osmid", "key").alias("key"), "share", ways.alias("osmid"))
    return gaps.relevant(e, infra, "share", 0.13 / 2).select("key.*")


@query("""WITH a AS (SELECT l_orderkey AS id, list(l_partkey) FILTER (l_returnflag <> 'A') AS a, list(l_suppkey) FILTER (l_linestatus = 'F') AS b FROM lineitem GROUP BY 1) SELECT id FROM a WHERE len(a) > 1 AND len(b) > 1""")
def both_routes_valid(spark, d):
    """Trips whose shortest and weighted route both have more than one node."""
    r = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.when(F.col("l_returnflag") != "A", F.col("l_partkey"))).alias("a"), F.collect_list(F.when(F.col("l_linestatus") == "F", F.col("l_suppkey"))).alias("b"))
    return r.where("size(a) > 1 AND size(b) > 1").select("id")


@query(f"""WITH {POINTS}, e AS (SELECT a.id AS u, b.id AS v, a.x AS ux, a.y AS uy, b.x AS vx, b.y AS vy, a.id % 5 = 0 AS turn FROM points a JOIN points b ON b.id = a.id + 1) 
SELECT u, v FROM e WHERE NOT turn AND (({_ring_sql('ux', 'uy', RING)}) OR ({_ring_sql('vx', 'vy', RING)}) OR {crosses_sql('ux', 'uy', 'vx', 'vy', RING)})""")
def streets_in_area(spark, d):
    """Street edges, turns left out, that the area contains or that cross it."""
    p = points(spark, d)
    other = p.select((F.col("id") - 1).alias("id"), F.col("id").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    e = p.join(other, "id").select(F.col("id").alias("u"), "v", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("vx").alias("x2"), F.col("vy").alias("y2"), F.when(F.col("id") % 5 == 0, 0.0).alias("turning_angle"))
    return spatial.with_area(e.where("turning_angle IS NULL"), RING).where("touching").select("u", "v")


@query(f"WITH {POSITIONS} SELECT bike, time, place FROM positions ORDER BY bike, time, place LIMIT 1000")
def first_positions(spark, d):
    return positions(spark, d).select("bike", "time", "place").orderBy("bike", "time", "place").limit(1000)


@query(f"WITH {_RIDES} SELECT id, line, distance FROM rides ORDER BY id, line, distance LIMIT 500")
def first_rides(spark, d):
    """A limit with the order that makes it definite."""
    return _rides(spark, d).select("id", "line", "distance").orderBy("id", "line", "distance").limit(500)


@query(f"WITH {_RIDES} SELECT id, line, distance FROM rides ORDER BY distance DESC, id, line LIMIT 100")
def longest_rides(spark, d):
    return _rides(spark, d).select("id", "line", "distance").orderBy(F.desc("distance"), "id", "line").limit(100)


@query("""SELECT l_suppkey AS gap_id, count(*) AS n, round(sum(l_extendedprice), 2) AS population, count(DISTINCT l_returnflag) > 2 AS connects FROM lineitem GROUP BY 1 ORDER BY connects DESC, population DESC, gap_id LIMIT 20""")
def gaps_by_rank(spark, d):
    """Gaps that connect first, then by population."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("gap_id")).agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("population"), (F.countDistinct("l_returnflag") > 2).alias("connects"))
    return g.orderBy(F.desc("connects"), F.desc("population"), "gap_id").limit(20)


@query("""WITH r AS (SELECT l_orderkey AS id, sum(l_extendedprice) AS length FROM lineitem GROUP BY 1) SELECT id, round(length, 2) AS length FROM r WHERE length > 180000 AND length < 250000 ORDER BY id LIMIT 10""")
def first_long_routes(spark, d):
    """The first ten routes, in input order, of a range of lengths."""
    r = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_extendedprice").alias("length"))
    return r.where("length > 180000 AND length < 250000").orderBy("id").limit(10).select("id", F.round("length", 2).alias("length"))


@query("""WITH g AS (SELECT l_suppkey AS gap_id, count(*) AS n FROM lineitem GROUP BY 1) SELECT gap_id, n, round(n / max(n) OVER () * 100, 6) AS percent FROM g ORDER BY n DESC, gap_id LIMIT 100""")
def percent_of_most(spark, d):
    """Gaps by their count in percent of the largest one."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("gap_id")).agg(F.count("*").alias("n"))
    most = g.agg(F.max("n").alias("m"))
    return g.join(F.broadcast(most)).select("gap_id", "n", F.round(F.col("n") / F.col("m") * 100, 6).alias("percent")).orderBy(F.desc("n"), "gap_id").limit(100)


@query(f"WITH {POSITIONS} SELECT place, min(time) AS first_seen FROM positions GROUP BY 1 ORDER BY first_seen DESC, place LIMIT 50")
def latest_stations(spark, d):
    return positions(spark, d).groupBy("place").agg(F.min("time").alias("first_seen")).orderBy(F.desc("first_seen"), "place").limit(50)


def _percent(x: str, at) -> str:
    return ", ".join(f"round(quantile_cont({x}, {p / 100}), 6) AS p{p}" for p in at)


_AT = [75, 85, 95, 99]


@query(f"WITH r AS (SELECT l_orderkey AS id, sum(l_extendedprice) AS x FROM lineitem GROUP BY 1) SELECT count(x) AS n, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(max(x), 6) AS most, round(min(x), 6) AS least, {_percent('x', _AT)} FROM r")
def route_length_summary(spark, d):
    r = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("x"))
    return _rounded(S.summary(r, "x", _AT))


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if c not in ("n", "flag") else F.col(c) for c in df.columns])


@query(f"WITH r AS (SELECT sum(l_extendedprice) AS a, sum(l_extendedprice * (1 + l_tax)) AS b FROM lineitem GROUP BY l_orderkey), x AS (SELECT b / a AS x FROM r WHERE a > 0 AND b > 0) SELECT count(x) AS n, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(max(x), 6) AS most, round(min(x), 6) AS least, {_percent('x', _AT)} FROM x")
def detour_summary(spark, d):
    r = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("a"), F.sum(F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("b")).where("a > 0 AND b > 0")
    return _rounded(S.summary(r.select((F.col("b") / F.col("a")).alias("x")), "x", _AT))


@query(f"WITH {_RIDES} SELECT count(minutes) AS n, round(avg(minutes), 6) AS mean, median(minutes) AS median, max(minutes) AS most, min(minutes) AS least, {_percent('minutes', _AT)} FROM rides")
def minutes_summary(spark, d):
    return _rounded(S.summary(_rides(spark, d), "minutes", _AT))


@query(f"WITH {_RIDES}, r AS (SELECT * FROM rides WHERE distance > 100) SELECT count(distance) AS n, round(avg(distance), 6) AS mean, round(median(distance), 6) AS median, max(distance) AS most, min(distance) AS least, {_percent('distance', _AT)} FROM r")
def distance_summary(spark, d):
    """Distances above 100 metres."""
    return _rounded(S.summary(_rides(spark, d).where("distance > 100"), "distance", _AT))


@query("SELECT grp, unnest([5, 50, 95, 99])::INT AS p, round(unnest(q), 6) AS value FROM (SELECT l_returnflag AS grp, quantile_cont(l_extendedprice, [0.05, 0.5, 0.95, 0.99]) AS q FROM lineitem GROUP BY 1)")
def percentiles_by_histogram(spark, d):
    """Exact percentiles by rank within histogram buckets, for groups of any size."""
    return S.exact_percentiles(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", [5, 50, 95, 99]).select("grp", "p", F.round("value", 6).alias("value"))


@query("""WITH g AS (SELECT DISTINCT l_orderkey AS gap_id, l_partkey AS edge, l_partkey % 1000 + 1.0 AS length FROM lineitem WHERE l_returnflag = 'R'), t AS (SELECT gap_id, sum(length) AS l FROM g GROUP BY 1),
o AS (SELECT sum(a.length) / least(any_value(x.l), any_value(y.l)) AS o FROM g a JOIN g b ON a.edge = b.edge AND a.gap_id < b.gap_id JOIN t x ON x.gap_id = a.gap_id JOIN t y ON y.gap_id = b.gap_id GROUP BY a.gap_id, b.gap_id),
s AS (SELECT list(o ORDER BY o) AS os, count(*) AS m, count(*) FILTER (o > 0.9) AS over FROM o), n AS (SELECT count(DISTINCT gap_id) AS g FROM g), z AS (SELECT os, over, g * (g - 1) AS pairs, g * (g - 1) - 2 * m AS zeros FROM s, n),
r AS (SELECT p, (pairs - 1) * p / 100.0 AS h, * FROM z, (SELECT unnest([25, 50, 75]) AS p)), v AS (SELECT p, h, CASE WHEN floor(h) < zeros THEN 0.0 ELSE os[((floor(h) - zeros) // 2 + 1)::BIGINT] END AS lo, CASE WHEN ceil(h) < zeros THEN 0.0 ELSE os[((ceil(h) - zeros) // 2 + 1)::BIGINT] END AS hi FROM r)
SELECT (SELECT round(2.0 * over / pairs, 12) FROM z) AS above, max(CASE WHEN p = 25 THEN round(lo + (hi - lo) * (h - floor(h)), 9) END) AS p25, max(CASE WHEN p = 50 THEN round(lo + (hi - lo) * (h - floor(h)), 9) END) AS p50, max(CASE WHEN p = 75 THEN round(lo + (hi - lo) * (h - floor(h)), 9) END) AS p75 FROM v""")
def overlap_quartiles(spark, d):
    """Share of overlaps above 0.9, and quartiles, over all ordered pairs of gaps; pairs without a shared edge are zeros."""
    e = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("gap_id"), F.col("l_partkey").alias("edge"), (F.col("l_partkey") % 1000 + 1.0).cast("double").alias("length")).distinct()
    return gaps.overlap_summary(e).select(F.round("above", 12).alias("above"), *[F.round(f"p{p}", 9).alias(f"p{p}") for p in (25, 50, 75)])


@query(f"""WITH {_RIDES}, h AS (SELECT 'minutes' AS "column", minutes AS x, 100.0 AS most FROM rides UNION ALL SELECT 'distance', distance, 5000.0 FROM rides UNION ALL SELECT 'speed', distance / minutes * 0.06, 25.0 FROM rides)
SELECT "column", least(floor(x / (most / 100)), 99)::INT AS bin, count(*) AS n FROM h WHERE x BETWEEN 0 AND most GROUP BY 1, 2""")
def ride_histograms(spark, d):
    """Minutes up to 100, metres up to 5,000 and speed up to 25 in 100 bins each."""
    r = _rides(spark, d).withColumn("speed", F.col("distance") / F.col("minutes") * 0.06)
    parts = [S.fixed_histogram(r, c, most / 100, 0.0, most).select(F.lit(c).alias("column"), "bin", "n") for c, most in (("minutes", 100.0), ("distance", 5000.0), ("speed", 25.0))]
    return U.union_by_name(*parts)


@query("""WITH r AS (SELECT sum(l_extendedprice) AS a, sum(l_extendedprice * (1 + l_tax)) AS b FROM lineitem GROUP BY l_orderkey), l AS (SELECT 'shortest' AS "column", a AS x FROM r UNION ALL SELECT 'weighted', b FROM r)
SELECT "column", floor(x / 5000)::INT AS bin, count(*) AS n FROM l WHERE x < 1000000 AND x >= 0 GROUP BY 1, 2""")
def both_route_histograms(spark, d):
    r = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("shortest"), F.sum(F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("weighted"))
    return S.both_histograms(r, ["shortest", "weighted"], 5000.0, 1_000_000.0)


@query("""SELECT name, string_agg(kind, ',' ORDER BY kind) AS kinds FROM (SELECT DISTINCT 'k' AS name, CASE WHEN json_type(props, '$.k') IN ('BIGINT', 'UBIGINT') THEN 'whole' WHEN json_type(props, '$.k') = 'DOUBLE' THEN 'decimal' ELSE 'text' END AS kind FROM events) GROUP BY 1""")
def attribute_kinds(spark, d):
    """Which kinds of values an attribute takes."""
    k = F.get_json_object("props", "$.k")
    kind = F.when(k.try_cast("bigint").isNotNull(), "whole").when(k.try_cast("double").isNotNull(), "decimal").otherwise("text")
    return table(spark, d, "events").groupBy(F.lit("k").alias("name")).agg(F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds"))


@query(f"""WITH {POSITIONS}, o AS (SELECT bike, time, place, lag(time) OVER w AS before, lag(place) OVER w AS last_place FROM positions WINDOW w AS (PARTITION BY bike ORDER BY time, place)) SELECT bike, time, place, abs(place - last_place) AS distance FROM o WHERE before IS NOT NULL""")
def distance_to_last(spark, d):
    """The distance of each position from the last one before it."""
    w = Window.partitionBy("bike").orderBy("time", "place")
    return positions(spark, d).select("bike", "time", "place", F.lag("place").over(w).alias("_p"), F.lag("time").over(w).alias("_t")).where("_t IS NOT NULL").select("bike", "time", "place", F.abs(F.col("place") - F.col("_p")).alias("distance"))


@query("""WITH a AS (SELECT l_suppkey AS u, l_partkey AS v, max(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2), b AS (SELECT l_suppkey AS u, l_partkey AS v, min(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT coalesce(a.u, b.u) AS u, coalesce(a.v, b.v) AS v, CASE WHEN b.u IS NOT NULL THEN b.q ELSE a.q END AS q FROM a FULL JOIN b ON a.u = b.u AND a.v = b.v""")
def composed_graphs(spark, d):
    """Edges of two graphs; where both have one, the second's attributes."""
    li = table(spark, d, "lineitem")
    side = lambda flag, q: li.where(F.col("l_returnflag") == flag).groupBy(F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v")).agg(q("l_quantity").alias("q"))
    return U.composed(side("A", F.max), side("R", F.min), ["u", "v"])


@query("""WITH g AS (SELECT l_orderkey, unnest(list_distinct(list(l_suppkey || '-' || l_partkey))) AS line FROM lineitem GROUP BY 1) SELECT count(DISTINCT line) AS n FROM g""")
def unique_lines(spark, d):
    """Lines of multi-lines, each once."""
    multi = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.concat(F.col("l_suppkey").cast("string"), F.lit("-"), F.col("l_partkey").cast("string"))).alias("lines"))
    return U.unique_lines(multi, "lines").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey AS id, format('Order {}: {} on {}', o_orderkey, o_orderstatus, strftime(o_orderdate, '%d.%m.%Y')) AS tip FROM orders""")
def tooltips(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.format_string("Order %d: %s on %s", "o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "dd.MM.yyyy")).alias("tip"))


@query("""WITH e AS (SELECT min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders), d AS (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day FROM e), n AS (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1)
SELECT date_trunc('week', day)::DATE AS week, count(*) AS days, coalesce(sum(n), 0)::BIGINT AS n FROM d LEFT JOIN n USING (day) GROUP BY 1""")
def weeks_of_range(spark, d):
    """Every day of the range, with and without rows, by its Monday."""
    o = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    days = X.date_range(o, "day")
    return days.join(o, "day", "left").groupBy(F.trunc("day", "week").alias("week")).agg(F.count("*").alias("days"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@query("""WITH z AS (SELECT l_shipdate::DATE AS day, sum(l_quantity) AS a, sum(l_extendedprice) AS b FROM lineitem GROUP BY 1), x AS (SELECT day, b / max(b) OVER () - a / max(a) OVER () AS diff FROM z) SELECT day, round(diff, 9) AS diff, row_number() OVER (ORDER BY abs(round(diff, 9)), day) AS place FROM x""")
def render_order(spark, d):
    """The normalised difference of two sums, and the order of drawing by its size."""
    z = table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("a"), F.sum("l_extendedprice").alias("b"))
    out = S.normalised_difference(z, "b", "a").select("day", F.round("diff", 9).alias("diff"))
    return S.ranked(out.withColumn("size", F.abs("diff")), [F.col("size"), F.col("day")], "size").select("day", "diff", F.col("_rn").cast("bigint").alias("place"))


@query("""SELECT l_orderkey AS id, array_to_string(list_sort(list_distinct(flatten(list([l_partkey, l_suppkey])))), ',') AS ids FROM lineitem GROUP BY 1""")
def flattened_ids(spark, d):
    """Way ids that are one number or a list, as one list."""
    pair = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.array("l_partkey", "l_suppkey")).alias("x"))
    return pair.select("id", F.array_join(F.array_sort(F.array_distinct(F.flatten("x"))), ",").alias("ids"))


@query("""SELECT p_partkey AS id, coalesce(CASE WHEN p_size > 25 THEN p_brand END, '') AS brand, coalesce(CASE WHEN p_size % 2 = 0 THEN p_type END, '') AS type FROM part""")
def wide_tags(spark, d):
    """Two tags of a map as columns, a missing one as the empty string."""
    tags = F.map_filter(F.create_map(F.lit("brand"), F.when(F.col("p_size") > 25, F.col("p_brand")), F.lit("type"), F.when(F.col("p_size") % 2 == 0, F.col("p_type"))), lambda k, v: v.isNotNull())
    get = lambda k: F.coalesce(F.try_element_at("t", F.lit(k)), F.lit("")).alias(k)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), tags.alias("t")).select("id", get("brand"), get("type"))


@query(f"""WITH {STREETS}, n AS (SELECT DISTINCT u AS node FROM streets UNION SELECT c_custkey FROM customer), r AS (SELECT u AS node, count(*) AS n_edges, sum(length) AS length FROM streets WHERE share > 0.05 GROUP BY 1)
SELECT node, coalesce(n_edges, 0) AS n_edges, coalesce(round(length, 2), 0) AS length FROM n LEFT JOIN r USING (node)""")
def reachable_per_node(spark, d):
    """Nodes with the edges they reach; those that reach none stay with 0."""
    s = streets(spark, d)
    nodes = s.select(F.col("u").alias("node")).union(table(spark, d, "customer").select(F.col("c_custkey").alias("node"))).distinct()
    r = s.where("share > 0.05").groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n_edges"), F.sum("length").alias("length"))
    return nodes.join(r, "node", "left").select("node", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.coalesce(F.round("length", 2), F.lit(0.0)).alias("length"))


@query("""SELECT c_mktsegment AS city, o_orderdate::DATE AS day, count(DISTINCT o_custkey) AS bikes FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2""")
def fleet_per_city(spark, d):
    """Distinct bikes a day and city."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("city"))
    return table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day")).join(c, "o_custkey").groupBy("city", "day").agg(F.countDistinct("o_custkey").alias("bikes"))
