"""The driver's tables seen as the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def positions(spark, d) -> DataFrame:
    """Snapshots: bike (user), time, place (code in the properties), kind, value."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, d, "events").select(F.col("user_id").alias("bike"), F.col("ts").alias("time"), k.alias("place"), F.col("event_type").alias("kind"), "value")


def rentals(spark, d) -> DataFrame:
    """Rentals: id, customer, start, price as duration in seconds, priority as rental place."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), F.col("o_orderdate").alias("start"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("station"), F.col("o_orderstatus").alias("status"))


def trips(spark, d) -> DataFrame:
    """Trips between zones: the customer's nation to the supplier's nation, per line item."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("origin"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("destination"))
    return li.join(o, "l_orderkey").join(c, "c_custkey").join(s, "l_suppkey").select("origin", "destination", "l_quantity", "l_extendedprice")


TRIPS = """trips AS (SELECT c_nationkey AS origin, s_nationkey AS destination, l_quantity, l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""
POSITIONS = "positions AS (SELECT user_id AS bike, ts AS time, CAST(json_extract_string(props, '$.k') AS BIGINT) AS place, event_type AS kind, value FROM events)"


def points(spark, d) -> DataFrame:
    """Points: the first two elements of each embedding, as x and y."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))


POINTS = "points AS (SELECT vec_id AS id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"


def streets(spark, d) -> DataFrame:
    """Street edges: supplier to part per line item, with length, share and way number."""
    return table(spark, d, "lineitem").select(
        (F.col("l_suppkey") + 1_000_000_000).alias("u"), F.col("l_partkey").alias("v"), F.col("l_linenumber").alias("key"), F.col("l_orderkey").alias("osmid"),
        F.col("l_extendedprice").alias("length"), F.col("l_discount").alias("share"), F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("flag"),
    )


STREETS = """streets AS (SELECT l_suppkey + 1000000000 AS u, l_partkey AS v, l_linenumber AS key, l_orderkey AS osmid, l_extendedprice AS length,
  l_discount AS share, l_quantity AS quantity, l_tax AS tax, l_returnflag AS flag FROM lineitem)"""
