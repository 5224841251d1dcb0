"""Set operations on tables: union by name, differences, intersections, composition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_by_name(*frames: DataFrame) -> DataFrame:
    """All rows; columns by name, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def difference(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``a`` whose key is not in ``b``; nulls are never in."""
    return a.join(b.select(*on).distinct(), on, "left_anti")


def members(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.join(b.select(*on).distinct(), on, "left_semi")


def composed(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Edges of both; where both have a key, the attributes of ``b``."""
    return b.unionByName(difference(a, b, on), allowMissingColumns=True)


def full_sum(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Per key, the sum over both tables; missing counts as 0."""
    return a.select(key, value).unionByName(b.select(key, value)).groupBy(key).agg(F.sum(value).alias(value))


def unique_lines(rows: DataFrame, lines: str) -> DataFrame:
    """The parts of arrays of lines, each once."""
    return rows.select(F.explode(lines).alias("line")).distinct()
