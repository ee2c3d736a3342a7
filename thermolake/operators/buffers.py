"""Bounded per-sensor buffers that only receive pushes: contents, occupancy, peek and pop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import buffer_summary
from ..schema import BUFFER_CAPACITY, READING_COLUMNS
from .ranking import arrival, newest_arrivals, oldest_arrivals


def _last(df: DataFrame):
    """Arrival as one value; a bare number keeps the aggregation on hashes."""
    columns = arrival(df)
    return F.col(columns[0]) if len(columns) == 1 else F.struct(*columns)


def buffer_contents(df: DataFrame, capacity: int = BUFFER_CAPACITY, drop_oldest: bool = True) -> DataFrame:
    """What each sensor's buffer holds after all pushes; ``position`` 1 is the oldest.

    A full buffer drops its oldest row, or refuses the new one.
    """
    rows = df.select(*arrival(df), *READING_COLUMNS)
    if not drop_oldest:
        return oldest_arrivals(rows, capacity, "position")
    kept = newest_arrivals(rows, capacity, "_rank").drop("_rank")
    position = F.row_number().over(Window.partitionBy("sensor_id").orderBy(*arrival(df)))
    return kept.withColumn("position", position.cast("long"))


def buffer_peek(df: DataFrame, n: int, capacity: int = BUFFER_CAPACITY, drop_oldest: bool = True) -> DataFrame:
    """The oldest ``n`` rows of each buffer."""
    return buffer_contents(df, capacity, drop_oldest).filter(F.col("position") <= n)


def buffer_pop(df: DataFrame, n: int, capacity: int = BUFFER_CAPACITY, drop_oldest: bool = True) -> DataFrame:
    """Buffer contents with ``taken``: True for the oldest ``n``, which leave the buffer."""
    return buffer_contents(df, capacity, drop_oldest).withColumn("taken", F.col("position") <= n)


def buffer_stats(df: DataFrame, capacity: int = BUFFER_CAPACITY, drop_oldest: bool = True) -> DataFrame:
    """Counters and occupancy per sensor, in closed form over the number of pushes.

    Push and drop times are the event times of the readings concerned.
    """
    per_sensor = df.groupBy("sensor_id").agg(
        F.count(F.lit(1)).alias("_n"), F.max_by("recorded_at", _last(df)).alias("_last_arrival"))
    if drop_oldest:
        counted = per_sensor.withColumn("last_push_time", F.col("_last_arrival"))
        pushed = F.col("_n")
    else:
        last_kept = buffer_contents(df, capacity, False).groupBy("sensor_id").agg(
            F.max_by("recorded_at", _last(df)).alias("last_push_time"))
        counted = per_sensor.join(last_kept, "sensor_id", "left")
        pushed = F.least("_n", F.lit(capacity))
    size = F.least("_n", F.lit(capacity))
    dropped = F.greatest(F.col("_n") - capacity, F.lit(0))
    return counted.select(
        "sensor_id",
        pushed.alias("total_pushed"),
        dropped.alias("total_dropped"),
        size.alias("high_water_mark"),
        "last_push_time",
        F.when(dropped > 0, F.col("_last_arrival")).alias("last_drop_time"),
        size.alias("size"),
        F.lit(capacity).cast("long").alias("capacity"),
        (F.col("_n") >= capacity).alias("is_full"),
        (F.col("_n") == 0).alias("is_empty"),
        buffer_summary(size, capacity, dropped, drop_oldest).alias("summary"),
    )
