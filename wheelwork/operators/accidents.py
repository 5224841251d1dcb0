"""Accident statistics: the accidents that count, and how many there are by month, weekday, hour, light and surface."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wheelwork.functions.codes import mapped
from wheelwork.functions.geo import strictly_in

#: statistic: column of the accident table, its code map. Fixed values.
BY = {"month": ("UMONAT", "month"), "weekday": ("UWOCHENTAG", "weekday"), "hour": ("USTUNDE", "hour"), "light": ("ULICHTVERH", "light"), "surface": ("IstStrassenzustand", "surface")}


def with_bicycles(accidents: DataFrame, state: int, city: list[tuple[float, float]]) -> DataFrame:
    """Accidents of a state, inside a city's ring, with a bicycle."""
    return accidents.where((F.col("ULAND") == state) & (F.col("IstRad") == 1)).where(strictly_in(F.col("XGCSWGS84"), F.col("YGCSWGS84"), city))


def counts(accidents: DataFrame, by: str) -> DataFrame:
    """code, name, n of one statistic; rows without the code are left out."""
    column, kind = BY[by]
    return accidents.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("code")).agg(F.count("*").alias("n")).select("code", mapped(kind, F.col("code")).alias("name"), "n")


def all_counts(accidents: DataFrame) -> DataFrame:
    """Every statistic in one pass: by, code, n."""
    pairs = F.array(*[F.struct(F.lit(by).alias("by"), F.col(column).cast("int").alias("code")) for by, (column, _) in BY.items()])
    return accidents.select(F.explode(pairs).alias("x")).where("x.code IS NOT NULL").groupBy("x.by", "x.code").agg(F.count("*").alias("n"))
