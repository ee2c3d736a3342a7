"""The bounded recent view: per sensor the valid readings that arrived last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quality import valid_filter
from ..schema import DEFAULT_BOUNDS, LATEST_COUNT, READING_COLUMNS, RECENT_CAPACITY, ValidityBounds
from .aggregates import one_row, recent_totals
from .ranking import arrival, newest_arrivals


def recent_view(
    df: DataFrame, capacity: int = RECENT_CAPACITY, bounds: ValidityBounds = DEFAULT_BOUNDS
) -> DataFrame:
    """Everything the view holds; ``arrival_rank`` 1 is the sensor's current reading."""
    valid = df.filter(valid_filter(bounds)).select(*arrival(df), *READING_COLUMNS)
    return newest_arrivals(valid, capacity, "arrival_rank")


def recent_n_per_sensor(
    df: DataFrame, n: int, capacity: int = RECENT_CAPACITY, bounds: ValidityBounds = DEFAULT_BOUNDS
) -> DataFrame:
    """The newest ``n`` of every sensor, never more than the view holds."""
    return recent_view(df, min(n, capacity), bounds)


def recent_of_sensor(
    df: DataFrame,
    sensor_id: str,
    n: int = LATEST_COUNT,
    capacity: int = RECENT_CAPACITY,
    bounds: ValidityBounds = DEFAULT_BOUNDS,
) -> DataFrame:
    """The newest ``n`` of one sensor by arrival, newest first."""
    return (
        df.filter((F.col("sensor_id") == sensor_id) & valid_filter(bounds))
        .select(*arrival(df), *READING_COLUMNS)
        .orderBy(*[F.desc(c) for c in arrival(df)]).limit(min(n, capacity))
    )


def recent_sensor_ids(df: DataFrame, bounds: ValidityBounds = DEFAULT_BOUNDS) -> DataFrame:
    return df.filter(valid_filter(bounds)).select("sensor_id").distinct().orderBy("sensor_id")


def held_bounds(view: DataFrame) -> DataFrame:
    """One row: event times of the oldest and newest reading of a recent view."""
    return view.agg(F.min("recorded_at").alias("oldest_reading"), F.max("recorded_at").alias("newest_reading"))


def recent_view_stats(
    df: DataFrame, capacity: int = RECENT_CAPACITY, bounds: ValidityBounds = DEFAULT_BOUNDS
) -> DataFrame:
    """One row: accepted so far, sensors, held now, and the event-time bounds of the held readings."""
    return one_row(recent_totals(df, capacity, bounds), held_bounds(recent_view(df, capacity, bounds)))
