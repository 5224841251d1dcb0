"""String and time expressions of the import and statistics steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decimal_comma(text: Column) -> Column:
    """'11,5' to 11.5; null where it is no number."""
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def safe_int(text: Column) -> Column:
    return text.try_cast("int")


def is_sublist(small: Column, big: Column) -> Column:
    """Whether array ``small`` occurs in ``big`` as a run (elements delimited, so 1 is not in 11)."""
    wrap = lambda a: F.concat(F.lit(","), F.array_join(a, ","), F.lit(","))
    return F.contains(wrap(big), wrap(small))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def split_ids(text: Column, sep: str = ",") -> Column:
    """'a,b' to [a, b]; an empty string is an empty list."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, sep))


def parse_tuple(text: Column) -> Column:
    """Numbers inside '(1, 2)' or '1' as an array."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("bigint"))


def is_tuple(text: Column) -> Column:
    return text.rlike(r"^\(.*\)$")


def split_outside_brackets(text: Column) -> Column:
    """Parts at commas outside brackets, two levels deep."""
    level1 = r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)"
    return F.filter(F.regexp_extract_all(text, F.lit(rf"(?:{level1}|[^,()\s])+"), F.lit(0)), lambda x: x != "")


def file_stem(path: Column) -> Column:
    """The file name without folders and last extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def utc_to_berlin(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, "Europe/Berlin")


def berlin_to_utc(ts: Column) -> Column:
    return F.to_utc_timestamp(ts, "Europe/Berlin")


def monday_of(ts: Column) -> Column:
    return F.to_date(F.date_trunc("week", ts))


def minutes_of_day(seconds: Column) -> Column:
    """Whole minutes of a duration, whole days left out."""
    return F.floor(F.pmod(seconds, F.lit(86400)) / 60).cast("int")


def date_range(rows: DataFrame, day: str) -> DataFrame:
    """Every day from the first to the last of a column, as ``day``."""
    return rows.agg(F.min(day).alias("a"), F.max(day).alias("b")).where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("day"))
