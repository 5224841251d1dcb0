"""Queries over rentals and trips: percentiles, histograms, flows, shares, sets, strings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wheelwork.functions import codes
from wheelwork.functions import text as X
from wheelwork.operators import sets as U
from wheelwork.operators import statistics as S
from wheelwork.plans.inputs import TRIPS, rentals, table, trips

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _q(x: str, at: list[int]) -> str:
    return ", ".join(f"quantile_cont({x}, {p / 100}) AS p{p}" for p in at)


@query(f"SELECT count(*) AS n, median(o_totalprice) AS median, min(o_totalprice) AS least, max(o_totalprice) AS most, {_q('o_totalprice', [50, 75, 90, 95, 99])} FROM orders")
def duration_percentiles(spark, d):
    return S.summary(rentals(spark, d), "price", [50, 75, 90, 95, 99]).drop("mean")


@query(f"SELECT l_returnflag AS flag, avg(l_extendedprice) AS mean, {_q('l_extendedprice', [75, 85, 95, 99])} FROM lineitem GROUP BY 1")
def length_percentiles(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    return S.summary(rows, "l_extendedprice", [75, 85, 95, 99], ["flag"]).select("flag", "mean", "p75", "p85", "p95", "p99")


@query("SELECT median(l_extendedprice / l_quantity * 3.6) AS median_speed FROM lineitem WHERE l_quantity > 0")
def speed_median(spark, d):
    speeds = table(spark, d, "lineitem").where("l_quantity > 0").select((F.col("l_extendedprice") / F.col("l_quantity") * 3.6).alias("speed"))
    return S.described(speeds, "speed", [50]).select(F.get("_c", F.lit(0)).alias("median_speed"))


@query("SELECT hour AS hour, avg(n) AS mean FROM (SELECT ts::DATE AS day, hour(ts)::INT AS hour, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def hourly_mean(spark, d):
    e = table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    return e.groupBy("hour").agg(F.avg("n").alias("mean"))


@query("""SELECT weekday, hour, avg(n) AS mean FROM (SELECT year(ts) AS y, month(ts) AS m, (isodow(ts) - 1)::INT AS weekday, hour(ts)::INT AS hour, count(*) AS n FROM events GROUP BY 1, 2, 3, 4) GROUP BY 1, 2""")
def weekday_hour_mean(spark, d):
    e = table(spark, d, "events").groupBy(F.year("ts").alias("y"), F.month("ts").alias("m"), F.weekday("ts").alias("weekday"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    return e.groupBy("weekday", "hour").agg(F.avg("n").alias("mean"))


@query("SELECT year(o_orderdate)::INT AS year, count(*) AS n FROM orders GROUP BY 1")
def rentals_per_year(spark, d):
    return rentals(spark, d).groupBy(F.year("start").alias("year")).agg(F.count("*").alias("n"))


@query("""SELECT year(o_orderdate)::INT AS year, count(DISTINCT k) AS bikes FROM (SELECT o_orderdate, o_custkey AS k FROM orders UNION ALL SELECT o_orderdate, o_orderkey FROM orders) GROUP BY 1""")
def distinct_ids_per_year(spark, d):
    ids = rentals(spark, d).select(F.year("start").alias("year"), F.explode(F.array("customer", "id")).alias("k"))
    return ids.groupBy("year").agg(F.countDistinct("k").alias("bikes"))


ZONES = [0, 1, 2, 3]


@query(f"WITH {TRIPS} SELECT origin, {', '.join(f'count(*) FILTER (destination = {z}) AS to_{z}' for z in ZONES)} FROM trips GROUP BY 1")
def od_matrix(spark, d):
    return S.od_matrix(trips(spark, d), "origin", "destination", ZONES).select("origin", *[F.col(str(z)).alias(f"to_{z}") for z in ZONES])


@query(f"""WITH {TRIPS} SELECT count(*) FILTER (origin < 12 AND destination < 12) AS stay, count(*) FILTER (origin < 12 AND destination >= 12) AS leave, count(*) FILTER (origin >= 12 AND destination < 12) AS enter,
count(*) FILTER (origin >= 12 AND destination >= 12) AS outside, count(*) FILTER (origin < 12 AND destination < 12) / count(*) AS stay_share FROM trips""")
def zone_flows(spark, d):
    return S.zone_flows(trips(spark, d), F.col("origin") < 12, F.col("destination") < 12)


@query(f"WITH {TRIPS} SELECT origin, destination, count(*) AS n FROM trips WHERE origin <> destination GROUP BY 1, 2 ORDER BY n DESC, origin, destination LIMIT 10")
def top_pairs(spark, d):
    return S.top_k(trips(spark, d).where("origin <> destination"), ["origin", "destination"], 10)


@query("SELECT o_custkey AS customer, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, customer LIMIT 10")
def top_stations(spark, d):
    return S.top_k(rentals(spark, d), ["customer"], 10)


@query("SELECT count(*) FILTER (NOT starts_with(o_orderpriority, '1')) AS at_station, count(*) FILTER (starts_with(o_orderpriority, '1')) AS free FROM orders")
def station_or_free(spark, d):
    free = F.startswith("station", F.lit("1"))
    return rentals(spark, d).agg(F.count_if(~free).alias("at_station"), F.count_if(free).alias("free"))


@query("SELECT least(floor(l_extendedprice / 50), 199)::INT AS bin, count(*) AS n FROM lineitem WHERE l_extendedprice BETWEEN 0 AND 10000 GROUP BY 1")
def hist_50(spark, d):
    return S.fixed_histogram(table(spark, d, "lineitem"), "l_extendedprice", 50, 0, 10000)


@query("""WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT least(floor((o_totalprice - lo) / (hi - lo) * 200), 199)::INT AS bin, count(*) AS n FROM orders, b GROUP BY 1""")
def hist_range(spark, d):
    return S.range_histogram(rentals(spark, d), "price", 200)


NAMES = ["0-500", "500-1000", "1000-2000", "2000-5000", "5000-10000", "10000-20000", "20000-50000", "50000+"]
EDGES = [500.0, 1000.0, 2000.0, 5000.0, 10000.0, 20000.0, 50000.0]
_CASE = "CASE " + " ".join(f"WHEN l_extendedprice < {e} THEN '{n}'" for e, n in zip(EDGES, NAMES, strict=False)) + " ELSE '50000+' END"


@query(f"""WITH c AS (SELECT {_CASE} AS grp, count(*) AS n FROM lineitem GROUP BY 1), e AS (SELECT unnest({NAMES}) AS grp)
SELECT e.grp, coalesce(n, 0) AS n, coalesce(n, 0) / (SELECT sum(n) FROM c) AS share FROM e LEFT JOIN c USING (grp)""")
def length_groups(spark, d):
    return S.bucket_counts(table(spark, d, "lineitem"), "l_extendedprice", EDGES, NAMES)


@query("SELECT month(l_shipdate)::INT AS a, (isodow(l_shipdate) - 1)::INT AS b, count(*) AS n FROM lineitem GROUP BY 1, 2")
def hist2d(spark, d):
    return table(spark, d, "lineitem").groupBy(F.month("l_shipdate").alias("a"), F.weekday("l_shipdate").alias("b")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c FROM orders)
SELECT CASE WHEN o_totalprice <= a THEN 1 WHEN o_totalprice <= b THEN 2 WHEN o_totalprice <= c THEN 3 ELSE 4 END AS quartile, count(*) AS n FROM orders, c GROUP BY 1""")
def quartile_bins(spark, d):
    return S.quartile(rentals(spark, d), "price").groupBy("quartile").agg(F.count("*").alias("n"))


@query("SELECT (floor((o_totalprice % 86400) / 60))::INT AS minutes, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, minutes LIMIT 10")
def minutes_mode(spark, d):
    return S.top_k(rentals(spark, d).select(X.minutes_of_day(F.col("price")).alias("minutes")), ["minutes"], 10)


PARTS = "parts AS (SELECT l_partkey AS part, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1)"


def _parts(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query(f"WITH {PARTS}, r AS (SELECT *, sum(total) OVER (ORDER BY total DESC, part ROWS UNBOUNDED PRECEDING) AS run, sum(total) OVER () AS every FROM parts) SELECT part, total FROM r WHERE run <= every * 0.9")
def top_share_prefix(spark, d):
    return S.running_share(_parts(spark, d), "total", ["part"], 0.9)


@query(f"WITH {PARTS}, r AS (SELECT total, row_number() OVER (ORDER BY total, part) AS rn, count(*) OVER () AS n FROM parts) SELECT round(sum(total) FILTER (rn > floor(n * 0.8)) / sum(total), 9) AS share FROM r")
def top20_share(spark, d):
    return S.tail_share(_parts(spark, d), "total", ["part"], 0.8).select(F.round("share", 9).alias("share"))


@query(f"WITH {PARTS}, r AS (SELECT total, row_number() OVER (ORDER BY total, part) AS rn, count(*) OVER () AS n FROM parts), c AS (SELECT total FROM r WHERE rn = floor(n * 0.95) + 1) SELECT part, total FROM parts WHERE total >= (SELECT total FROM c)")
def top_five_percent(spark, d):
    return S.from_rank(_parts(spark, d), "total", ["part"], 0.95)


@query("""WITH a AS (SELECT l_suppkey AS k, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1)
SELECT k, round(q / max(q) OVER () - n / max(n) OVER (), 9) AS diff FROM a""")
def normalise_diff(spark, d):
    a = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    return S.normalised_difference(a, "q", "n").select("k", F.round("diff", 9).alias("diff"))


@query("SELECT n_name AS nation, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 9) AS share FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def share_of_total(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("nation")).agg(F.count("*").alias("n"))
    return c.select("nation", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 9).alias("share"))


@query("SELECT l_partkey AS part, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 0.1 * (SELECT max(c) FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_partkey))")
def share_of_max(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.count("*").alias("n"))
    return c.join(F.broadcast(c.agg(F.max("n").alias("m")))).where("n >= 0.1 * m").select("part", "n")


@query("""SELECT o_orderkey AS id, o_orderdate AS t, o_totalprice AS price, NULL::INT AS size FROM orders WHERE year(o_orderdate) = 1996 UNION ALL BY NAME SELECT p_partkey AS id, NULL::TIMESTAMP AS t, NULL::DOUBLE AS price, p_size AS size FROM part""")
def union_years(spark, d):
    a = rentals(spark, d).where("year(start) = 1996").select("id", F.col("start").alias("t"), "price")
    return U.union_by_name(a, table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))).select("id", "t", "price", "size")


@query("SELECT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O'")
def area_intersection(spark, d):
    li = table(spark, d, "lineitem")
    return li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")).intersect(li.where("l_linestatus = 'O'").select("l_orderkey"))


@query("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem a WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_quantity > 25 AND b.l_orderkey = a.l_orderkey AND b.l_partkey = a.l_partkey AND b.l_suppkey = a.l_suppkey)")
def edge_difference(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    keys = ["l_orderkey", "l_partkey", "l_suppkey"]
    return U.difference(li.where("l_returnflag = 'R'"), li.where("l_quantity > 25"), keys).select(*keys)


@query("SELECT o_orderkey AS id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount = 0)")
def semi_infra(spark, d):
    return U.members(rentals(spark, d), table(spark, d, "lineitem").where("l_discount = 0").select(F.col("l_orderkey").alias("id")), ["id"]).select("id")


@query("SELECT o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount = 0)")
def anti_infra(spark, d):
    return U.difference(rentals(spark, d), table(spark, d, "lineitem").where("l_discount = 0").select(F.col("l_orderkey").alias("id")), ["id"]).select("id")


@query("SELECT k, sum(q) AS q FROM (SELECT l_partkey AS k, l_quantity AS q FROM lineitem UNION ALL SELECT l_suppkey, l_quantity FROM lineitem) GROUP BY 1")
def full_outer_sum(spark, d):
    li = table(spark, d, "lineitem")
    a = li.select(F.col("l_partkey").alias("k"), F.col("l_quantity").alias("q"))
    return U.full_sum(a, li.select(F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("q")), "k", "q")


@query("""WITH g AS (SELECT o_custkey AS c, o_orderkey AS o, list(DISTINCT l_suppkey) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT a.o AS a, b.o AS b, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) AS jaccard FROM g a JOIN g b ON a.c = b.c AND a.o < b.o""")
def jaccard(spark, d):
    o = rentals(spark, d).join(table(spark, d, "lineitem"), F.col("id") == F.col("l_orderkey")).groupBy("customer", "id").agg(F.collect_set("l_suppkey").alias("s"))
    b = o.select("customer", F.col("id").alias("b"), F.col("s").alias("t"))
    return o.join(b, "customer").where("id < b").select(F.col("id").alias("a"), "b", X.jaccard(F.col("s"), F.col("t")).alias("jaccard"))


@query("SELECT p_partkey AS part, try_cast(replace(replace(p_retailprice::VARCHAR, '.', ','), ',', '.') AS DOUBLE) AS price FROM part")
def decimal_comma(spark, d):
    comma = F.replace(F.format_string("%.2f", F.round("p_retailprice", 2)), F.lit("."), F.lit(","))
    return table(spark, d, "part").select(F.col("p_partkey").alias("part"), X.decimal_comma(comma).alias("price"))


_MONTHS, _UNKNOWN = codes.CODES["month"]


@query(f"SELECT p_partkey AS part, coalesce(map_extract(MAP {{{', '.join(f'{k}: {v!r}' for k, v in _MONTHS.items())}}}, p_size)[1], '{_UNKNOWN}') AS month FROM part")
def code_map(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("part"), codes.mapped("month", F.col("p_size")).alias("month"))


@query("SELECT l_orderkey AS o, l_linenumber AS l, concat_ws(', ', CASE WHEN l_quantity > 25 THEN 'Fahrrad' END, CASE WHEN l_discount > 0.05 THEN 'PKW' END, CASE WHEN l_tax > 0.04 THEN 'Fußgänger' END) AS who FROM lineitem")
def participants_concat(spark, d):
    flags = [(F.col("l_quantity") > 25, "Fahrrad"), (F.col("l_discount") > 0.05, "PKW"), (F.col("l_tax") > 0.04, "Fußgänger")]
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), codes.participants(flags).alias("who"))


@query("SELECT o_orderkey AS id, strptime(strftime(o_orderdate, '%d.%m.%Y %H:%M'), '%d.%m.%Y %H:%M') AS t, o_orderdate - to_seconds(floor(o_totalprice)::BIGINT) AS started FROM orders")
def parse_dates(spark, d):
    text = F.date_format("start", "dd.MM.yyyy HH:mm")
    return rentals(spark, d).select("id", F.try_to_timestamp(text, F.lit("dd.MM.yyyy HH:mm")).alias("t"), (F.col("start") - F.make_dt_interval(secs=F.floor("price").cast("decimal(18,6)"))).alias("started"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""WITH t AS (SELECT p_partkey AS part, unnest([{'key': 'brand', 'value': p_brand}, {'key': 'type', 'value': CASE WHEN p_size > 25 THEN p_type END}]) AS e FROM part)
SELECT e.key AS key, count(e.value) AS n, count(e.value) / (SELECT count(*) FROM part) * 100 AS percent, count(DISTINCT e.value) AS n_values FROM t GROUP BY 1""")
def tag_profile(spark, d):
    tags = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.when(F.col("p_size") > 25, F.col("p_type")))
    return S.tag_profile(table(spark, d, "part").select(tags.alias("tags")), "tags")


@query("SELECT p_brand AS key, p_type AS value, count(*) AS n FROM part GROUP BY 1, 2")
def tag_frequency(spark, d):
    return table(spark, d, "part").select(F.explode(F.create_map("p_brand", "p_type")).alias("key", "value")).groupBy("key", "value").agg(F.count("*").alias("n"))


@query("""
SELECT brand, size FROM (SELECT p_brand AS brand, p_size AS size, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_size) AS rn FROM part GROUP BY 1, 2) WHERE rn = 1""")
def mode_per_group(spark, d):
    c = table(spark, d, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).agg(F.count("*").alias("n"))
    return c.groupBy("brand").agg(F.min_by("size", F.struct((-F.col("n")).alias("n"), "size")).alias("size"))


@query("SELECT count(*) FILTER (o_totalprice IS NULL) AS no_price, count(*) FILTER (NOT o_orderstatus IN ('O', 'F')) AS odd_status, count(*) FILTER (year(o_orderdate) < 1993) AS early FROM orders")
def quality_checks(spark, d):
    return S.quality_checks(rentals(spark, d), no_price=F.col("price").isNotNull(), odd_status=F.col("status").isin("O", "F"), early=F.year("start") >= 1993)


@query("SELECT count(*) AS n, count(*) FILTER (l_extendedprice > 250 AND l_extendedprice < 20000 AND l_quantity <= 36 AND l_shipdate::DATE NOT IN (DATE '1996-01-02', DATE '1996-01-03')) AS plausible FROM lineitem")
def plausible_rides(spark, d):
    ok = (F.col("l_extendedprice") > 250) & (F.col("l_extendedprice") < 20000) & (F.col("l_quantity") <= 36) & ~F.to_date("l_shipdate").isin("1996-01-02", "1996-01-03")
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"), F.count_if(ok).alias("plausible"))


@query("""WITH s AS (SELECT l_orderkey AS o, l_suppkey AS k, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2)
SELECT count(*) AS n, median(abs(a.v - b.v) / b.v) AS median_difference FROM (SELECT k, sum(v) AS v FROM s GROUP BY 1) a JOIN (SELECT l_suppkey AS k, sum(l_quantity * 1500) AS v FROM lineitem GROUP BY 1) b USING (k)""")
def relative_difference(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("a"), F.sum(F.col("l_quantity") * 1500).alias("b"))
    found = S.described(g.select((F.abs(F.col("a") - F.col("b")) / F.col("b")).alias("x")), "x", [50])
    return found.select("n", F.get("_c", F.lit(0)).alias("median_difference"))


@query("""SELECT l_orderkey AS o, sum(l_extendedprice) / sum(l_quantity) AS factor FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 0""")
def detour_factor(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.sum("l_extendedprice").alias("a"), F.sum("l_quantity").alias("b")).where("b > 0").select("o", (F.col("a") / F.col("b")).alias("factor"))
