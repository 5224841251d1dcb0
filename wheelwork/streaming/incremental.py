"""Streams that run for ever: positions polled from files, rides with ordered state, late rows counted, days written once.

Rows wait in the state of their key's slot until the watermark has passed them; rides are then made in
order of time, so rows may come out of order by up to ``delay``. Rows older than the
watermark come out as ``late`` instead of being dropped. A key that has had no row for ``idle`` of
event time leaves the state (as an ``idle`` row); without ``idle`` its last row is kept as the seed of
the next ride for good. Restarting from the checkpoint goes on where the last batch ended.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "kind string, key bigint, start_time timestamp, finish_time timestamp, start_place bigint, finish_place bigint"
#: The same with times as microseconds, which no worker's time zone can shift.
_RAW = OUT.replace("timestamp", "bigint")
#: States that all keys share.
SLOTS = 1024


def poll(spark: SparkSession, path: str, schema, files_per_trigger: int | None = 1000, consumed: str = "off", archive: str | None = None) -> DataFrame:
    """Parquet files of a folder as they come, ``files_per_trigger`` at once; ``consumed`` ones stay (off) or are deleted or archived."""
    reader = spark.readStream.schema(schema).option("cleanSource", consumed)
    if archive:
        reader = reader.option("sourceArchiveDir", archive)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


@contextlib.contextmanager
def ordered_state(spark: SparkSession):
    """The state store that timers and lists need, for the queries started within."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def started(writer, every: str | None = None) -> StreamingQuery:
    """Starts a stream that looks for new files ``every`` (such as "60 seconds"), or once over all there are."""
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _rows(chunks) -> np.ndarray:
    """key, time, place of rows that the state holds as bytes."""
    return np.concatenate([np.empty((0, 3), np.int64), *[np.frombuffer(bytes(c[0]), np.int64).reshape(-1, 3) for c in chunks]])


class Rides(StatefulProcessor):
    """Rides of the keys of one slot from their positions (key, time, place), each key's in order of time."""

    def __init__(self, idle_ms: int | None):
        self.idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.last = handle.getValueState("last", "rows binary")

    @staticmethod
    def _out(kind, start, finish, n: int) -> pd.DataFrame:
        """One row each from where it starts and where it finishes (rows of key, time, place, or None)."""
        columns = {"kind": kind, "key": (finish if start is None else start)[:, 0]}
        for i, what in ((1, "time"), (2, "place")):
            for name, rows in (("start", start), ("finish", finish)):
                columns[f"{name}_{what}"] = pd.array([pd.NA] * n if rows is None else rows[:, i], dtype="Int64")
        return pd.DataFrame(columns)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, first = timerValues.getCurrentWatermarkInMs(), None
        for frame in rows:
            new = np.column_stack([frame[c].to_numpy(np.int64) for c in ("key", "time", "place")])
            late = new[:, 1] < passed * 1000
            if late.any():
                yield self._out("late", None, new[late], int(late.sum()))
            held = new[~late]
            if len(held):
                self.waiting.appendValue((held.tobytes(),))
                least = int(held[:, 1].min()) // 1000
                first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = _rows(self.waiting.get()) if self.waiting.exists() else _rows([])
        last = _rows([self.last.get()]) if self.last.exists() else _rows([])
        due = held[:, 1] <= passed * 1000
        ready, kept = held[due], held[~due]
        # a key's last row goes before its new ones
        known, new = np.concatenate([last, ready]), np.repeat([0, 1], [len(last), len(ready)])
        known = known[np.lexsort((known[:, 2], known[:, 1], new, known[:, 0]))]
        same = known[1:, 0] == known[:-1, 0]
        ride = same & (known[1:, 2] != known[:-1, 2])
        if ride.any():
            yield self._out("ride", known[:-1][ride], known[1:][ride], int(ride.sum()))
        seeds = known[np.append(~same, True)] if len(known) else known
        timers = kept[:, 1] // 1000
        if self.idle is not None:
            ends, waits = seeds[:, 1] // 1000 + self.idle, np.isin(seeds[:, 0], kept[:, 0])
            gone = ~waits & (ends <= passed)
            if gone.any():
                yield self._out("idle", seeds[gone], None, int(gone.sum()))
            timers = np.append(timers, ends[~waits & ~gone])
            seeds = seeds[~gone]
        if len(ready):
            self.waiting.clear()
            if len(kept):
                self.waiting.appendValue((kept.tobytes(),))
        if len(seeds):
            self.last.update((seeds.tobytes(),))
        elif len(last):
            self.last.clear()
        if len(timers):
            self.handle.registerTimer(int(timers.min()))

    def close(self) -> None:
        pass


def rides(positions: DataFrame, delay: str = "10 minutes", idle_ms: int | None = None, slots: int = SLOTS) -> DataFrame:
    """kind (ride, late, idle), key, start_time, finish_time, start_place, finish_place of a stream of positions (key, time, place).

    A late row's time and place stand as the finish, an idle key's last ones as the start.
    To be started within ``ordered_state``. Rows without key, time or place are left out. Keys share
    ``slots`` states by their hash, so calls of the state do not grow with the keys; the number stays the same for the life of a checkpoint.
    """
    known = positions.where("key IS NOT NULL AND time IS NOT NULL AND place IS NOT NULL").withWatermark("time", delay)
    # as a number, the time moves the watermark but does not let the engine drop late rows uncounted
    raw = known.select(F.pmod(F.xxhash64("key"), F.lit(slots)).alias("slot"), "key", F.unix_micros("time").alias("time"), "place").groupBy("slot").transformWithStateInPandas(statefulProcessor=Rides(idle_ms), outputStructType=_RAW, outputMode="Append", timeMode="EventTime")
    return raw.withColumns({c: F.timestamp_micros(c) for c in ("start_time", "finish_time")})


def daily_sets(sightings: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """date, keys (sorted set), n: one row a day of a stream of sightings (key, time), once the watermark has passed its end."""
    day = sightings.withWatermark("time", delay).groupBy(F.window("time", "1 day")).agg(F.array_sort(F.collect_set("key")).alias("keys"))
    return day.select(F.col("window.start").cast("date").alias("date"), "keys", F.size("keys").cast("bigint").alias("n"))


def once_a_day(path: str):
    """For ``foreachBatch``: writes rows with a date into partitions of ``path``, but for dates that are there already.

    A batch that runs again after a failure finds its own dates there or writes them anew, so each
    day stands once. One stream may write to a path.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
        new = batch
        if there:
            known = spark.read.schema(batch.schema).parquet(path).select("date").distinct()
            new = batch.join(known, "date", "left_anti").select(*batch.columns)
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)

    return write
