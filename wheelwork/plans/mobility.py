"""Queries over snapshots and fleets: days, hours, rides, versions, as-of joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wheelwork.functions.text import monday_of, utc_to_berlin
from wheelwork.operators import statistics as S
from wheelwork.operators import versions as V
from wheelwork.plans.inputs import POSITIONS, positions, rentals, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _daily(spark, d):
    return positions(spark, d).groupBy(F.to_date("time").alias("date")).agg(F.countDistinct("bike").alias("n"))


@query("SELECT ts::DATE AS date, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def fleet_daily(spark, d):
    return _daily(spark, d)


@query("""SELECT year(date)::INT AS year, month(date)::INT AS month, median(n)::DOUBLE AS median_n, avg(n) AS mean_n, max(n) AS max_n, min(n) AS min_n
FROM (SELECT ts::DATE AS date, count(DISTINCT user_id) AS n FROM events GROUP BY 1) GROUP BY 1, 2""")
def fleet_monthly(spark, d):
    return _daily(spark, d).groupBy(F.year("date").alias("year"), F.month("date").alias("month")).agg(F.median("n").alias("median_n"), F.avg("n").alias("mean_n"), F.max("n").alias("max_n"), F.min("n").alias("min_n"))


@query("SELECT ts::DATE AS date, len(list(DISTINCT user_id))::BIGINT AS n, list_aggregate(list_sort(list(DISTINCT user_id::VARCHAR)), 'string_agg', ',') AS bikes FROM events GROUP BY 1")
def fleet_day_sets(spark, d):
    sets = positions(spark, d).groupBy(F.to_date("time").alias("date")).agg(F.array_sort(F.collect_set(F.col("bike").cast("string"))).alias("b"))
    return sets.select("date", F.size("b").cast("bigint").alias("n"), F.array_join("b", ",").alias("bikes"))


@query("SELECT date, n FROM (SELECT ts::DATE AS date, count(DISTINCT user_id) AS n FROM events GROUP BY 1) WHERE n >= 100 AND date NOT IN (DATE '2024-01-05', DATE '2024-01-06')")
def fleet_without_outliers(spark, d):
    return _daily(spark, d).where("n >= 100").where(~F.col("date").isin("2024-01-05", "2024-01-06"))


RIDES_SQL = f"""{POSITIONS}, rides AS (SELECT bike, lag(time) OVER w AS start_time, time AS finish_time, lag(place) OVER w AS start_place, place AS finish_place
  FROM positions WINDOW w AS (PARTITION BY bike ORDER BY time, place) QUALIFY lag(place) OVER w IS DISTINCT FROM place AND lag(time) OVER w IS NOT NULL)"""


def _rides(spark, d):
    return V.rides_from_changes(positions(spark, d).select("bike", "time", "place"), "bike", "time", ["place"])


@query(f"WITH {RIDES_SQL} SELECT bike, start_time, finish_time, start_place, finish_place FROM rides")
def rides_from_changes(spark, d):
    return _rides(spark, d).select("bike", "start_time", "finish_time", "start_place", "finish_place")


@query(f"WITH {RIDES_SQL} SELECT start_time::DATE AS date, count(*) AS n FROM rides GROUP BY 1")
def rides_per_day(spark, d):
    return _rides(spark, d).groupBy(F.to_date("start_time").alias("date")).agg(F.count("*").alias("n"))


@query(f"WITH {RIDES_SQL} SELECT hour(start_time)::INT AS hour, count(*) AS n FROM rides GROUP BY 1")
def rides_by_hour(spark, d):
    return _rides(spark, d).groupBy(F.hour("start_time").alias("hour")).agg(F.count("*").alias("n"))


@query(f"WITH {RIDES_SQL} SELECT hour(start_time)::INT AS hour, count(*) AS n, count(DISTINCT date_trunc('hour', start_time)) AS hours, count(*) / count(DISTINCT date_trunc('hour', start_time)) AS per_hour FROM rides GROUP BY 1")
def rides_by_hour_normalised(spark, d):
    h = _rides(spark, d).groupBy(F.date_trunc("hour", "start_time").alias("t")).agg(F.count("*").alias("n"))
    return h.groupBy(F.hour("t").alias("hour")).agg(F.sum("n").alias("n"), F.count("*").alias("hours")).select("hour", "n", "hours", (F.col("n") / F.col("hours")).alias("per_hour"))


@query(f"WITH {RIDES_SQL} SELECT date_trunc('hour', start_time)::TIMESTAMP AS hour, count(*) AS n FROM rides GROUP BY 1")
def rides_per_date_hour(spark, d):
    return _rides(spark, d).groupBy(F.date_trunc("hour", "start_time").alias("hour")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT ts::DATE AS date, count(*) AS n FROM events GROUP BY 1)
SELECT min(n) AS least, max(n) AS most, avg(n) AS mean, median(n)::DOUBLE AS median, (SELECT date FROM c ORDER BY n, date LIMIT 1) AS least_day, (SELECT date FROM c ORDER BY n DESC, date LIMIT 1) AS most_day FROM c""")
def daily_extremes(spark, d):
    return S.extremes(positions(spark, d).groupBy(F.to_date("time").alias("date")).agg(F.count("*").alias("n")), "date", "n")


@query("SELECT user_id AS bike, count(*) AS n FROM events GROUP BY 1")
def snapshots_per_bike(spark, d):
    return positions(spark, d).groupBy("bike").agg(F.count("*").alias("n"))


@query(f"WITH {POSITIONS} SELECT place, kind, min(time) AS first_seen FROM positions GROUP BY 1, 2")
def station_versions(spark, d):
    return V.first_seen(positions(spark, d), ["place", "kind"], "time")


@query(f"WITH {POSITIONS}, v AS (SELECT place, kind, min(time) AS first_seen FROM positions GROUP BY 1, 2) SELECT *, lead(first_seen) OVER (PARTITION BY place ORDER BY first_seen) AS valid_to FROM v")
def station_validity(spark, d):
    return V.valid_until(V.first_seen(positions(spark, d), ["place", "kind"], "time"), "place")


@query("SELECT user_id AS bike, event_type AS kind, min(ts) AS first_seen FROM events GROUP BY 1, 2")
def bike_first_seen(spark, d):
    return V.first_seen(positions(spark, d), ["bike", "kind"], "time")


@query(f"WITH {POSITIONS} SELECT bike, time, place, kind FROM positions QUALIFY row_number() OVER (PARTITION BY bike ORDER BY time DESC, place DESC, kind DESC) = 1")
def carry_over_last(spark, d):
    return V.last_per_key(positions(spark, d).select("bike", "time", "place", "kind"), "bike", "time")


@query(f"""WITH {RIDES_SQL}, v AS (SELECT place, time AS seen, kind, value FROM positions WHERE kind = 'purchase' QUALIFY row_number() OVER (PARTITION BY place, time ORDER BY value) = 1)
SELECT bike, start_time, start_place, v.value AS station_value FROM rides ASOF LEFT JOIN v ON rides.start_place = v.place AND rides.start_time >= v.seen""")
def ride_station_asof(spark, d):
    versions = V.skip_conflicts(positions(spark, d).where("kind = 'purchase'").select(F.col("place").alias("start_place"), F.col("time").alias("first_seen"), F.col("value").alias("station_value")), ["start_place", "first_seen"], ["station_value"])
    rides = _rides(spark, d).select("bike", "start_time", "start_place")
    return V.as_of(rides, versions, "start_place", "start_time", take=["station_value"])


@query("SELECT o_custkey AS customer, o_orderdate AS start, min(o_orderkey) AS id FROM orders GROUP BY 1, 2")
def bulk_skip_conflicts(spark, d):
    return V.skip_conflicts(rentals(spark, d).select("customer", "start", "id"), ["customer", "start"], ["id"])


@query("SELECT DISTINCT o_custkey AS customer, date_trunc('week', o_orderdate)::DATE AS monday FROM orders")
def rental_weeks(spark, d):
    return rentals(spark, d).select("customer", monday_of(F.col("start")).alias("monday")).distinct()


@query("SELECT event_id, (ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Berlin')::TIMESTAMP AS local, hour(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Berlin')::INT AS local_hour FROM events")
def tz_shift(spark, d):
    local = utc_to_berlin(F.col("ts"))
    return table(spark, d, "events").select("event_id", local.alias("local"), F.hour(local).alias("local_hour"))


@query("SELECT ts::DATE AS date, arg_min(event_id, {'ts': ts, 'e': event_id}) AS first_event FROM events WHERE hour(ts) = 3 GROUP BY 1")
def first_in_hour_per_day(spark, d):
    return table(spark, d, "events").where(F.hour("ts") == 3).groupBy(F.to_date("ts").alias("date")).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"))


@query("SELECT event_type AS kind, value, rank() OVER (PARTITION BY event_type ORDER BY value, event_id) AS place FROM events")
def rank_in_group(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("kind"), "value", F.row_number().over(Window.partitionBy("event_type").orderBy("value", "event_id")).cast("bigint").alias("place"))
