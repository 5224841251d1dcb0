"""Time-ordered operators: rides from position changes, versions, as-of joins, carry-over."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rides_from_changes(positions: DataFrame, key: str, time: str, place: list[str], carry: list[str] = ()) -> DataFrame:
    """One row whenever an object's place differs from its previous one.

    Output: key, start_time, finish_time, and start_<c>, finish_<c> for place and carry.
    One shuffle by key; rows of a key are sorted by time, ties by place.
    """
    w = Window.partitionBy(key).orderBy(time, *place)
    columns = [time, *place, *carry]
    rows = positions.select(key, *columns, F.lag(F.struct(*columns)).over(w).alias("_p"))
    moved = F.lit(False)
    for c in place:
        moved = moved | ~F.col(f"_p.{c}").eqNullSafe(F.col(c))
    out = rows.where(F.col("_p").isNotNull() & moved)
    return out.select(
        key, F.col(f"_p.{time}").alias("start_time"), F.col(time).alias("finish_time"),
        *[x for c in [*place, *carry] for x in (F.col(f"_p.{c}").alias(f"start_{c}"), F.col(c).alias(f"finish_{c}"))],
    )


def first_seen(rows: DataFrame, attributes: list[str], time: str) -> DataFrame:
    """Versions: each distinct set of attributes with the first time it was seen (nulls are alike)."""
    return rows.groupBy(*attributes).agg(F.min(time).alias("first_seen"))


def valid_until(versions: DataFrame, key: str, time: str = "first_seen") -> DataFrame:
    """Versions with valid_to, the start of the key's next version (null for the last)."""
    return versions.withColumn("valid_to", F.lead(time).over(Window.partitionBy(key).orderBy(time)))


def as_of(events: DataFrame, versions: DataFrame, key: str, event_time: str, version_time: str = "first_seen", take: list[str] = ()) -> DataFrame:
    """Events with ``take`` of the key's latest version at or before the event (null: none).

    Events and versions are one stream per key in time order; the last version seen is
    carried forward. One shuffle, no range join; memory does not grow with a key's rows.
    """
    payload = F.struct(*[F.col(c).alias(c) for c in take])
    left = events.select(F.col(key).alias("_k"), F.col(event_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*events.columns).alias("_e"), F.lit(None).cast(versions.select(payload.alias("v")).schema["v"].dataType).alias("_v"))
    right = versions.select(F.col(key).alias("_k"), F.col(version_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_e"].dataType).alias("_e"), payload.alias("_v"))
    w = Window.partitionBy("_k").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = left.unionByName(right).withColumn("_v", F.last("_v", ignorenulls=True).over(w))
    return seen.where("_side = 1").select("_e.*", *[F.col(f"_v.{c}").alias(c) for c in take])


def last_per_key(rows: DataFrame, key: str, time: str) -> DataFrame:
    """The latest row of each key, to seed the next run (partial aggregation, no window)."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(time, *[c for c in rows.columns if c not in (key, time)])).alias("_r")).select("_r.*")


def skip_conflicts(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Insert that keeps the first row of each key and skips the others."""
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_r")).select("_r.*")


def insert_new(existing: DataFrame, rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows to append to ``existing``: new keys only, the first row of each."""
    return skip_conflicts(rows, key, order).join(existing.select(*key), key, "left_anti")
