"""Aggregations over readings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quality import is_valid, valid_filter
from ..schema import DEFAULT_BOUNDS, RECENT_CAPACITY, ValidityBounds
from .scans import Instant, between, for_sensor


def daily_stats(
    df: DataFrame,
    start: Instant | None = None,
    end: Instant | None = None,
    sensor_id: str | None = None,
    valid_only: bool = False,
    bounds: ValidityBounds = DEFAULT_BOUNDS,
) -> DataFrame:
    """Per UTC day and sensor: min, max, average and count; newest day first. Invalid readings count too,
    unless ``valid_only``. Either bound may be absent."""
    rows = between(for_sensor(df, sensor_id), start, end)
    if valid_only:
        rows = rows.filter(valid_filter(bounds))
    return (
        rows.groupBy(F.to_date("recorded_at").alias("date"), "sensor_id")
        .agg(*daily_measures())
        .orderBy(F.desc("date"), F.asc("sensor_id"))
    )


def daily_measures() -> list[Column]:
    return [
        F.min("temperature").alias("min_temperature"),
        F.max("temperature").alias("max_temperature"),
        F.avg("temperature").alias("avg_temperature"),
        F.min("humidity").alias("min_humidity"),
        F.max("humidity").alias("max_humidity"),
        F.avg("humidity").alias("avg_humidity"),
        F.count(F.lit(1)).alias("reading_count"),
    ]


def storage_stats(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: count, oldest, newest and number of sensors; zero counts and NULL times when empty."""
    if approximate:
        totals = df.agg(
            F.count(F.lit(1)).alias("total_readings"),
            F.min("recorded_at").alias("oldest_reading"),
            F.max("recorded_at").alias("newest_reading"),
            F.approx_count_distinct("sensor_id").alias("unique_sensors"),
        )
    else:
        # one hash aggregation per sensor, then a total over the sensors
        totals = (
            df.groupBy("sensor_id")
            .agg(F.count(F.lit(1)).alias("n"), F.min("recorded_at").alias("lo"), F.max("recorded_at").alias("hi"))
            .agg(
                F.sum("n").alias("total_readings"),
                F.min("lo").alias("oldest_reading"),
                F.max("hi").alias("newest_reading"),
                F.count(F.lit(1)).alias("unique_sensors"),
            )
        )
    return totals.select(
        F.coalesce("total_readings", F.lit(0)).alias("total_readings"),
        "oldest_reading", "newest_reading", "unique_sensors",
    )


def sensor_ids(df: DataFrame) -> DataFrame:
    return df.select("sensor_id").distinct().orderBy("sensor_id")


def raw_vs_valid_counts(df: DataFrame, bounds: ValidityBounds = DEFAULT_BOUNDS) -> DataFrame:
    """Per sensor: rows that enter the history, and rows that also enter the recent view."""
    return df.groupBy("sensor_id").agg(
        F.count(F.lit(1)).alias("raw_count"), F.count_if(is_valid(bounds)).alias("valid_count"))


def reject_counts(df: DataFrame, reason: Column) -> DataFrame:
    return (
        df.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("reading_count"))
        .filter(F.col("reason").isNotNull())
    )


def recent_totals(df: DataFrame, capacity: int = RECENT_CAPACITY, bounds: ValidityBounds = DEFAULT_BOUNDS) -> DataFrame:
    """One row: accepted readings so far, sensors seen, readings held now by a view of ``capacity`` per sensor."""
    per_sensor = df.filter(valid_filter(bounds)).groupBy("sensor_id").agg(F.count(F.lit(1)).alias("accepted"))
    return per_sensor.agg(*_recent_measures(capacity))


def _recent_measures(capacity: int) -> list[Column]:
    return [
        F.coalesce(F.sum("accepted"), F.lit(0)).alias("total_readings"),
        F.count_if(F.col("accepted") > 0).alias("unique_sensors"),
        F.coalesce(F.sum(F.least("accepted", F.lit(capacity))), F.lit(0)).alias("current_readings"),
    ]


def fleet_totals(df: DataFrame, capacity: int = RECENT_CAPACITY, bounds: ValidityBounds = DEFAULT_BOUNDS) -> DataFrame:
    """``recent_totals`` and, under ``database_`` names, ``storage_stats``, in one pass over the readings."""
    per_sensor = df.groupBy("sensor_id").agg(
        F.count_if(is_valid(bounds)).alias("accepted"), F.count(F.lit(1)).alias("n"),
        F.min("recorded_at").alias("lo"), F.max("recorded_at").alias("hi"))
    return per_sensor.agg(
        *_recent_measures(capacity),
        F.coalesce(F.sum("n"), F.lit(0)).alias("database_total_readings"),
        F.min("lo").alias("database_oldest_reading"),
        F.max("hi").alias("database_newest_reading"),
        F.count(F.lit(1)).alias("database_unique_sensors"),
    )


def one_row(*parts: DataFrame) -> DataFrame:
    """Puts the columns of several one-row DataFrames side by side without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
