"""Replays a table of events as a stream in time order and reads what the stream wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wheelwork.operators.lineage import fresh_path
from wheelwork.streaming import incremental as I

#: Key of the row behind the last one that moves the watermark past all others.
BEAT = -1


def _spans(spark: SparkSession, rows: DataFrame, top: str, batches: int):
    """Writes ``rows`` (key, time, place) span by span of time, then a beat, and yields after each."""
    cuts = rows.agg(F.expr(f"percentile_approx(time, array({', '.join(str(i / batches) for i in range(1, batches))}))").alias("c")).first()["c"] or []
    edges = [None, *cuts, None]
    for lo, hi in zip(edges, edges[1:], strict=False):
        part = rows.where(F.col("time") >= F.lit(lo)) if lo else rows
        part = part.where(F.col("time") < F.lit(hi)) if hi else part
        part.write.mode("append").parquet(f"{top}/in")
        yield
    rows.agg(F.max("time").alias("time")).where("time IS NOT NULL").select(F.lit(BEAT).cast("bigint").alias("key"), (F.col("time") + F.expr("INTERVAL 3 DAYS")).alias("time"), F.lit(0).cast("bigint").alias("place")).write.mode("append").parquet(f"{top}/in")
    yield


def _events(spark: SparkSession, path: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return spark.read.parquet(path).select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("time"), k.alias("place"))


def replay_rides(spark: SparkSession, path: str, batches: int = 3) -> DataFrame:
    """bike, start_time, finish_time, start_place, finish_place, of consecutive time spans.

    The stream is stopped and started anew for each span; its state goes on from the checkpoint.
    """
    rows = _events(spark, path)
    top = fresh_path(spark, "stream")
    with I.ordered_state(spark):
        for _ in _spans(spark, rows, top, batches):
            source = I.poll(spark, f"{top}/in", rows.schema)
            I.started(I.rides(source).writeStream.format("parquet").option("checkpointLocation", f"{top}/state").option("path", f"{top}/out").outputMode("append")).awaitTermination()
    found = spark.read.schema(I.OUT).parquet(f"{top}/out").where(f"kind = 'ride' AND key <> {BEAT}")
    kind = dict(spark.read.parquet(path).select("ts").dtypes)["ts"]
    return found.select(F.col("key").alias("bike"), F.col("start_time").cast(kind).alias("start_time"), F.col("finish_time").cast(kind).alias("finish_time"), "start_place", "finish_place")


def replay_days(spark: SparkSession, path: str, batches: int = 3) -> DataFrame:
    """date, n, keys: the bikes seen on each day, written once a day while the stream goes on."""
    rows = _events(spark, path)
    top = fresh_path(spark, "stream")
    for _ in _spans(spark, rows, top, batches):
        source = I.poll(spark, f"{top}/in", rows.schema)
        I.started(I.daily_sets(source).writeStream.foreachBatch(I.once_a_day(f"{top}/out")).option("checkpointLocation", f"{top}/state").outputMode("append")).awaitTermination()
    return spark.read.parquet(f"{top}/out").where(f"NOT array_contains(keys, CAST({BEAT} AS BIGINT))").withColumn("date", F.col("date").cast("date"))
