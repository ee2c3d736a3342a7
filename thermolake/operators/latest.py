"""Latest and current reading of every sensor in one aggregation, combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quality import is_valid, valid_filter
from ..schema import DEFAULT_BOUNDS, READING_COLUMNS, ValidityBounds
from .ranking import arrival

_VALUES = ["recorded_at", "humidity", "temperature"]


def _by_event_time(df: DataFrame) -> Column:
    """A reading as a struct that sorts by time and arrival."""
    return F.struct("recorded_at", *arrival(df), "humidity", "temperature")


def _by_arrival(df: DataFrame) -> Column:
    return F.struct(*arrival(df), *_VALUES)


def latest_per_sensor(df: DataFrame) -> DataFrame:
    """Per sensor the reading with the greatest time, by arrival among equals."""
    newest = df.groupBy("sensor_id").agg(F.max(_by_event_time(df)).alias("_newest"))
    return newest.select("sensor_id", "_newest.*").select(*arrival(df), *READING_COLUMNS)


def current_per_sensor(df: DataFrame, bounds: ValidityBounds = DEFAULT_BOUNDS) -> DataFrame:
    """Per sensor the valid reading that arrived last. Where one number gives the arrival, it is a hash aggregation."""
    if arrival(df) == ["seq"]:
        return df.filter(valid_filter(bounds)).groupBy("sensor_id").agg(
            *[F.max_by(c, "seq").alias(c) for c in _VALUES], F.max("seq").alias("seq")
        ).select("seq", *READING_COLUMNS)
    newest = df.filter(valid_filter(bounds)).groupBy("sensor_id").agg(F.max(_by_arrival(df)).alias("_newest"))
    return newest.select("sensor_id", "_newest.*").select(*arrival(df), *READING_COLUMNS)


def current_with_fallback(df: DataFrame, bounds: ValidityBounds = DEFAULT_BOUNDS) -> DataFrame:
    """Per sensor the valid reading that arrived last, else the latest reading of any kind, in one pass."""
    found = df.groupBy("sensor_id").agg(
        F.max(F.when(is_valid(bounds), _by_arrival(df))).alias("_current"), F.max(_by_event_time(df)).alias("_any"))
    has_current = F.col("_current").isNotNull()
    columns = [*arrival(df), *_VALUES]
    return found.select(
        *[F.when(has_current, F.col(f"_current.{c}")).otherwise(F.col(f"_any.{c}")).alias(c) for c in columns],
        "sensor_id",
        F.when(has_current, F.lit("memory")).otherwise(F.lit("database")).alias("source"),
    ).select(*arrival(df), *READING_COLUMNS, "source")


def current_or_latest(current: DataFrame, latest: DataFrame) -> DataFrame:
    """The same answer from a materialised recent view and the history's latest readings."""
    order = [c for c in arrival(current) if c in latest.columns]
    columns = [*order, *_VALUES]
    cur = current.select("sensor_id", *[F.col(c).alias(f"_cur_{c}") for c in columns])
    any_ = latest.select("sensor_id", *[F.col(c).alias(f"_any_{c}") for c in columns])
    has_current = F.col("_cur_seq").isNotNull()
    return cur.join(any_, "sensor_id", "full").select(
        *[F.when(has_current, F.col(f"_cur_{c}")).otherwise(F.col(f"_any_{c}")).alias(c) for c in columns],
        "sensor_id",
        F.when(has_current, F.lit("memory")).otherwise(F.lit("database")).alias("source"),
    ).select(*order, *READING_COLUMNS, "source")
