"""Writers: append, first-wins insert, CSV, compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wheelwork.operators.lineage import drop_path
from wheelwork.operators.versions import insert_new


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def insert_skip(df: DataFrame, path: str, key: list[str], order: list[str]) -> None:
    """Appends only rows with new keys; of several the first. One writer at a time: the check and the append are two steps."""
    spark = df.sparkSession
    existing = spark.read.schema(df.schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], df.schema)
    append(insert_new(existing, df, key, order), path)


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def insert_batch(df: DataFrame, path: str, key: list[str]) -> bool:
    """All or nothing: appends only if no key repeats or is already there. One writer at a time: the check and the append are two steps."""
    spark = df.sparkSession
    keys = df.select(*key)
    if _exists(spark, path):
        keys = keys.unionAll(spark.read.schema(df.schema).parquet(path).select(*key))
    if not keys.groupBy(*key).count().where("count > 1").isEmpty():
        return False
    append(df, path)
    return True


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def compact_day(df: DataFrame, path: str, time: str = "time") -> None:
    """Small files of a day into partitions by date; refuses to overwrite."""
    df.withColumn("date", F.to_date(time)).repartition("date").write.mode("errorifexists").partitionBy("date").parquet(path)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrites the partitions of a table that ``df`` has rows for; the others stay."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def compact_sources(spark, paths: list[str], target: str, time: str = "time") -> None:
    """Small folders of Parquet as one table by day, checked row by row count, and only then dropped."""
    rows = spark.read.parquet(*paths)
    compact_day(rows, target, time)
    if spark.read.parquet(target).count() != rows.count():
        raise ValueError(f"{target} has not all rows; its sources stay")
    for path in paths:
        drop_path(spark, path)
