"""Daily fleet sets as a stream; rides are in ``streaming.incremental``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_fleet(sightings: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Sightings (key, time) once per key and day, with a watermark for late ones."""
    return sightings.withWatermark("time", late).withColumn("date", F.window("time", "1 day")["start"].cast("date")).dropDuplicatesWithinWatermark(["key", "date"])
