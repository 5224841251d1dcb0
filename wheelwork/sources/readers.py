"""Readers of the raw inputs, each with an explicit schema; bad records are left out."""

from __future__ import annotations

import io
import tarfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wheelwork.functions.geo import from_wkt
from wheelwork.functions.text import decimal_comma

SNAPSHOT = """countries array<struct<cities:array<struct<uid:bigint,name:string,places:array<struct<uid:bigint,lat:double,lng:double,
bike:boolean,spot:boolean,name:string,number:bigint,bike_racks:bigint,special_racks:bigint,
bike_list:array<struct<number:string,bike_type:bigint>>>>>>>>, _corrupt string"""
RENTALS_2024 = "start_time string, end_time string, duration bigint, start_place_id string, end_place_id string, start_lat string, start_lng string, end_lat string, end_lng string"
ACCIDENTS = """ULAND int, UJAHR int, UMONAT int, UWOCHENTAG int, USTUNDE int, UKATEGORIE int, UART int, UTYP1 int, ULICHTVERH int, IstStrassenzustand int,
IstRad int, IstPKW int, IstFuss int, IstGkfz int, IstSonstige int, PLST int, XGCSWGS84 string, YGCSWGS84 string, LINREFX string, LINREFY string"""


def file_time(path):
    """The time in a file's name (ISO, with - or : between hours and minutes)."""
    stem = F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})[T_ ](\d{2})[-:](\d{2})(?:[-:](\d{2}))?", 0)
    return F.try_to_timestamp(F.regexp_replace(F.regexp_replace(stem, r"[T_]", " "), r"(?<= \d{2})-(\d{2})-?", ":$1:"), F.lit("yyyy-MM-dd HH:mm:ss"))


def snapshots(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Flattened places of snapshot files: time, city, place fields, bikes. Broken files are skipped.

    ``since`` and ``until`` (days, inclusive) select files by the time in their name.
    """
    raw = spark.read.schema(SNAPSHOT).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", True).json(path).select("*", file_time(F.col("_metadata.file_name")).alias("time"))
    if since:
        raw = raw.where(F.to_date("time") >= F.lit(since).cast("date"))
    if until:
        raw = raw.where(F.to_date("time") <= F.lit(until).cast("date"))
    return flattened(raw.where("_corrupt IS NULL"))


def flattened(raw: DataFrame) -> DataFrame:
    return raw.select("time", F.explode("countries").alias("c")).select("time", F.explode("c.cities").alias("c")).select("time", F.col("c.uid").alias("city"), F.explode("c.places").alias("p")).select("time", "city", "p.*")


def stations(places: DataFrame) -> DataFrame:
    """Station records: places that are spots and no bikes."""
    return places.where("spot AND NOT bike").select(F.col("uid").alias("station_id"), "name", F.col("number").cast("string").alias("short_name"), F.col("lng").alias("lon"), "lat", "bike_racks", "special_racks", F.col("time").alias("created_at"))


def bikes(places: DataFrame) -> DataFrame:
    """Position records of all bikes: at stations, and free-floating ones (no station)."""
    at = F.when(F.col("spot") & ~F.col("bike"), F.col("uid"))
    return places.where("(spot AND NOT bike) OR (bike AND NOT spot)").select("time", F.col("lng").alias("lon"), "lat", at.alias("station_id"), F.explode("bike_list").alias("b")).select(F.col("b.number").alias("id"), F.col("b.bike_type").cast("int").alias("vehicle_type_id"), "time", "lon", "lat", "station_id")


def vehicle_types(spark: SparkSession, path: str) -> DataFrame:
    kinds = "array<struct<vehicle_type_id:string,vehicle_image:string,name:string,description:string,form_factor:string,rider_capacity:string,propulsion_type:string>>"
    raw = spark.read.schema(f"data struct<vehicle_types:{kinds}>").option("multiLine", True).json(path)
    return raw.select(F.inline("data.vehicle_types")).withColumn("vehicle_type_id", F.col("vehicle_type_id").try_cast("int"))


def archives(spark: SparkSession, path: str, since: str, until: str) -> DataFrame:
    """Members (archive, name, content) of YYYY-MM-DD.tar.gz files of a range of days, both ends included."""
    day = F.try_to_timestamp(F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})\.tar\.gz$", 1), F.lit("yyyy-MM-dd")).cast("date")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar.gz").load(path).where(day.between(F.lit(since).cast("date"), F.lit(until).cast("date")))

    def unpack(frames):
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows, size = [], 0
                with tarfile.open(fileobj=io.BytesIO(content), mode="r|gz") as tar:
                    for m in tar:
                        if m.isfile():
                            rows.append((path, m.name, tar.extractfile(m).read()))
                            size += m.size
                        if size > 8 << 20:
                            yield pd.DataFrame(rows, columns=["archive", "name", "content"])
                            rows, size = [], 0
                yield pd.DataFrame(rows, columns=["archive", "name", "content"])

    return found.select("path", "content").mapInPandas(unpack, "archive string, name string, content binary")


def rentals_2024(spark: SparkSession, path: str) -> DataFrame:
    """Rentals with decimal commas and day-first times, canonical columns."""
    raw = spark.read.schema(RENTALS_2024).option("sep", ";").option("header", True).csv(path)
    point = lambda side: F.struct(decimal_comma(F.col(f"{side}_lng")).alias("lon"), decimal_comma(F.col(f"{side}_lat")).alias("lat"))
    time = lambda c: F.try_to_timestamp(F.col(c), F.lit("dd.MM.yyyy HH:mm"))
    return raw.select(time("start_time").alias("start_time"), time("end_time").alias("end_time"), "duration", F.col("start_place_id").alias("rental_place"), F.col("end_place_id").alias("return_place"), point("start").alias("start"), point("end").alias("finish"))


def with_start_time(rentals: DataFrame) -> DataFrame:
    """A missing start is the end less the duration in seconds."""
    return rentals.withColumn("start_time", F.coalesce("start_time", F.col("end_time") - F.make_dt_interval(secs=F.col("duration").cast("decimal(18,6)"))))


def accidents(spark: SparkSession, path: str) -> DataFrame:
    """All accident files of a folder; coordinates as numbers."""
    raw = spark.read.option("sep", ";").option("header", True).schema(ACCIDENTS).option("enforceSchema", False).csv(path)
    return raw.withColumns({c: decimal_comma(F.col(c)) for c in ("XGCSWGS84", "YGCSWGS84", "LINREFX", "LINREFY")})


def fleet_days(spark: SparkSession, path: str) -> DataFrame:
    """date, bikes (array) from ``date;bikes`` files; days without bikes are left out."""
    raw = spark.read.schema("date date, bikes string").option("sep", ";").option("header", True).csv(path)
    return raw.where("length(bikes) > 0").select("date", F.split("bikes", ",").alias("bikes"))


def zones(spark: SparkSession, path: str, city: int | None = None) -> DataFrame:
    """Zone polygons (city, rings) from a GeoJSON collection."""
    shape = "features array<struct<properties:struct<cityId:bigint>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>>"
    out = spark.read.schema(shape).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select(F.col("f.properties.cityId").alias("city"), F.col("f.geometry.coordinates").alias("rings"))
    return out.where(F.col("city") == city) if city is not None else out


def one_per_day(files: DataFrame, hour: int = 3, zone: str = "Europe/Berlin") -> DataFrame:
    """Per local day, the first file (path, UTC time) of a local hour."""
    local = F.from_utc_timestamp("time", zone)
    return files.where(F.hour(local) == hour).groupBy(F.to_date(local).alias("date")).agg(F.min_by("path", F.struct("time", "path")).alias("path"))


PROCESSED = "`Start time` timestamp, `End time` timestamp, Duration bigint, `Rental place` string, `Return place` string, starting_position string, finishing_position string"


def processed_rentals(spark: SparkSession, path: str) -> DataFrame:
    """Rentals as written after preprocessing: times, duration in seconds, places, and both positions from well-known text.

    Further columns of the file (distances, flags of areas) are read by name if the header has them as listed first.
    """
    raw = spark.read.schema(PROCESSED).option("header", True).option("enforceSchema", False).csv(path)
    return raw.select(
        F.col("Start time").alias("start_time"), F.col("End time").alias("end_time"), F.col("Duration").alias("duration"), F.col("Rental place").alias("rental_place"), F.col("Return place").alias("return_place"),
        from_wkt(F.col("starting_position")).alias("start"), from_wkt(F.col("finishing_position")).alias("finish"),
    )
