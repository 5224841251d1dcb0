"""Streams: restarts, rows out of order, late rows, idle keys, days written once."""

import datetime
import random

import pytest

from wheelwork.streaming import incremental as I

START = datetime.datetime(2024, 3, 1)
SCHEMA = "key long, time timestamp, place long"


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def run(spark, tmp_path, batches, **options):
    """Feeds the batches one by one, each to a stream started anew, and gives all rows that came out."""
    with I.ordered_state(spark):
        for b in batches:
            spark.createDataFrame(b, SCHEMA).coalesce(2).write.mode("append").parquet(f"{tmp_path}/in")
            source = I.poll(spark, f"{tmp_path}/in", SCHEMA, files_per_trigger=3)
            I.started(I.rides(source, **options).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out")).awaitTermination()
    return [r for r in spark.read.schema(I.OUT).parquet(f"{tmp_path}/out").collect() if r["key"] != -1]


def batch_rides(rows):
    out = []
    for key in {r[0] for r in rows}:
        own = sorted((t, p) for k, t, p in rows if k == key)
        out += [(key, a[0], b[0], a[1], b[1]) for a, b in zip(own, own[1:], strict=False) if a[1] != b[1]]
    return sorted(out)


def test_restarts_and_disorder(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, at(m), rng.randrange(4)) for k in range(5) for m in rng.sample(range(600), 25)]
    rows.sort(key=lambda r: r[1] + datetime.timedelta(minutes=rng.uniform(0, 25)))
    batches = [rows[:40], rows[40:41], rows[41:90], rows[90:], [(-1, at(5000), 0)]]
    out = run(spark, tmp_path, batches, delay="30 minutes")
    assert sorted((r["key"], r["start_time"], r["finish_time"], r["start_place"], r["finish_place"]) for r in out if r["kind"] == "ride") == batch_rides(rows)
    assert {r["kind"] for r in out} == {"ride"}


def test_late_rows_and_idle_keys(spark, tmp_path):
    minute = 60_000
    batches = [[(1, at(0), 7), (2, at(1), 7), (-1, at(200), 0)], [(1, at(3), 8), (1, at(190), 9), (-1, at(400), 0)], [(1, at(500), 5), (-1, at(9000), 0)]]
    out = run(spark, tmp_path, batches, delay="10 minutes", idle_ms=240 * minute)
    assert [(r["key"], r["finish_time"], r["finish_place"]) for r in out if r["kind"] == "late"] == [(1, at(3), 8)]
    # key 2 leaves after four hours, key 1 goes on from its seed and leaves at the end
    assert sorted((r["key"], r["start_time"]) for r in out if r["kind"] == "idle") == [(1, at(500)), (2, at(1))]
    # the state held nothing of minute 3
    assert sorted((r["key"], r["start_time"], r["finish_time"]) for r in out if r["kind"] == "ride") == [(1, at(0), at(190)), (1, at(190), at(500))]


def test_days_once(spark, tmp_path):
    day = 24 * 60
    batches = [[(1, at(5), 0), (2, at(9), 0), (1, at(day + 1), 0)], [(2, at(day + 700), 0)], [(3, at(2 * day + 5), 0), (9, at(5 * day), 0)]]
    for b in batches:
        spark.createDataFrame(b, SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
        source = I.poll(spark, f"{tmp_path}/in", SCHEMA)
        I.started(I.daily_sets(source).writeStream.foreachBatch(I.once_a_day(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/state")).awaitTermination()
    days = lambda: sorted((str(r["date"]), r["keys"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = [("2024-03-01", [1, 2], 2), ("2024-03-02", [1, 2], 2), ("2024-03-03", [3], 1)]
    assert days() == want
    # a day that is there already stays as it is
    again = spark.createDataFrame([(datetime.date(2024, 3, 1), [5], 1), (datetime.date(2024, 4, 1), [6], 1)], "date date, keys array<long>, n long")
    for _ in range(2):
        I.once_a_day(f"{tmp_path}/out")(again, 7)
    assert days() == [*want, ("2024-04-01", [6], 1)]


def test_polling_deletes_what_it_has_read(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in")
    for n in range(3):
        spark.range(n).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = I.poll(spark, f"{tmp_path}/in", "id long", consumed="delete", files_per_trigger=None)
        query = I.started(source.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out"))
        query.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6
    assert I.started(I.poll(spark, f"{tmp_path}/in", "id long").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/s2"), every="1 second").stop() is None
    with pytest.raises(Exception):  # noqa: B017
        I.poll(spark, f"{tmp_path}/in", "id long", consumed="sometimes").isStreaming and I.started(I.poll(spark, f"{tmp_path}/in", "id long", consumed="sometimes").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/s3")).awaitTermination()
