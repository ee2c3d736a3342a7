"""Known sensors, the sensor dimension and the default sensor."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import instant_literal, uptime_seconds
from ..schema import SENSORS


def sensors_union(recent: DataFrame, history: DataFrame) -> DataFrame:
    """Distinct ids of the recent view and the history, sorted. Each side is reduced before they meet."""
    return (
        recent.select("sensor_id").distinct()
        .union(history.select("sensor_id").distinct())
        .distinct().orderBy("sensor_id")
    )


def default_sensor(*sources: DataFrame) -> DataFrame:
    """The sensor used when a request names none: the smallest known id (one row, NULL when there is none)."""
    ids = reduce(DataFrame.union, [df.select("sensor_id") for df in sources])
    return ids.agg(F.min("sensor_id").alias("sensor_id"))


def sensor_info(
    spark: SparkSession, sensor_id: str, location: str, sensor_type: str, version: str, start_time: datetime | str
) -> DataFrame:
    """One row of the sensor dimension."""
    return (
        spark.range(1)
        .select(F.lit(sensor_id).alias("sensor_id"), F.lit(location).alias("location"),
                F.lit(sensor_type).alias("sensor_type"), F.lit(version).alias("version"),
                instant_literal(start_time).alias("start_time"))
        .to(SENSORS)
    )


def enrich(df: DataFrame, sensors: DataFrame) -> DataFrame:
    """Adds location, type and version of the sensor; readings of unknown sensors stay, with nulls."""
    described = sensors.select("sensor_id", "location", "sensor_type", "version").dropDuplicates(["sensor_id"])
    return df.join(described, "sensor_id", "left")


def first_seen(df: DataFrame) -> DataFrame:
    """Start time per sensor, taken from its first reading."""
    return df.groupBy("sensor_id").agg(F.min("recorded_at").alias("start_time"))


def sensor_uptime(sensors: DataFrame, as_of: datetime | str) -> DataFrame:
    return sensors.select("sensor_id", "start_time", uptime_seconds(as_of, "start_time").alias("uptime_seconds"))
