"""Heartbeat-based liveness: last seen, active sensors, sessions and silent gaps.

Heartbeats are first reduced to distinct seconds, so a (sensor, day) group never exceeds 86,400 rows however
many heartbeats arrive; neighbours are found inside the day, and the day's last second is handed on to the next
day of the sensor through a one-row-per-day summary.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import as_instant, instant_literal, truncate_second
from ..schema import PONG_TIMEOUT_SECONDS, SILENCE_SECONDS


def of_known_sensors(heartbeats: DataFrame) -> DataFrame:
    """A heartbeat without a sensor id says nothing about any sensor."""
    return heartbeats.filter(F.col("sensor_id") != "")


def last_seen(heartbeats: DataFrame) -> DataFrame:
    return of_known_sensors(heartbeats).groupBy("sensor_id").agg(F.max("received_at").alias("last_seen"))


def active_sensors(
    heartbeats: DataFrame, as_of: datetime | str, timeout_seconds: int = SILENCE_SECONDS
) -> DataFrame:
    """Sensors whose last heartbeat is at most ``timeout_seconds`` old. Older heartbeats are never read."""
    oldest = as_instant(as_of) - timedelta(seconds=timeout_seconds)
    return last_seen(heartbeats.filter(F.col("received_at").between(instant_literal(oldest), instant_literal(as_of))))


def _beats(heartbeats: DataFrame) -> DataFrame:
    """Distinct seconds per sensor with their count and the second before, NULL for the first."""
    seconds = (
        of_known_sensors(heartbeats).groupBy("sensor_id", truncate_second("received_at").alias("received_at"))
        .agg(F.count(F.lit(1)).alias("beats"))
        .withColumn("_day", F.to_date("received_at"))
    )
    days = (
        seconds.groupBy("sensor_id", "_day").agg(F.max("received_at").alias("_last"))
        .select("sensor_id", "_day",
                F.lag("_last").over(Window.partitionBy("sensor_id").orderBy("_day")).alias("_earlier_day"))
    )
    in_day = Window.partitionBy("sensor_id", "_day").orderBy("received_at")
    return (
        seconds.withColumn("_in_day", F.lag("received_at").over(in_day))
        .join(days, ["sensor_id", "_day"])
        .select("sensor_id", "_day", "received_at", "beats",
                F.coalesce("_in_day", "_earlier_day").alias("previous_at"))
    )


def _silence() -> Column:
    return F.unix_seconds("received_at") - F.unix_seconds("previous_at")


def heartbeat_gaps(
    heartbeats: DataFrame, timeout_seconds: int = PONG_TIMEOUT_SECONDS, as_of: datetime | str | None = None
) -> DataFrame:
    """Heartbeats that came more than ``timeout_seconds`` after the one before: sensor_id, previous_at, received_at,
    gap_seconds.

    With ``as_of`` also the silences that still last then: their ``received_at`` is NULL and ``gap_seconds`` counts up to
    ``as_of``. Later heartbeats are left out, as nobody knew of them yet.
    """
    if as_of is not None:
        heartbeats = heartbeats.filter(F.col("received_at") <= instant_literal(as_of))
    ended = (
        _beats(heartbeats)
        .select("sensor_id", "previous_at", "received_at", _silence().alias("gap_seconds"))
        .filter(F.col("gap_seconds") > timeout_seconds)
    )
    return ended if as_of is None else ended.unionByName(open_silences(heartbeats, as_of, timeout_seconds))


def open_silences(
    heartbeats: DataFrame, as_of: datetime | str, timeout_seconds: int = PONG_TIMEOUT_SECONDS
) -> DataFrame:
    """Sensors whose last heartbeat is more than ``timeout_seconds`` before ``as_of``, in the columns of the gaps. One
    aggregation, combined before the shuffle."""
    known = heartbeats.filter(F.col("received_at") <= instant_literal(as_of))
    silent = F.unix_seconds(instant_literal(as_of)) - F.unix_seconds("last_seen")
    return last_seen(known).select(
        "sensor_id", truncate_second("last_seen").alias("previous_at"), F.lit(None).cast("timestamp").alias("received_at"),
        silent.alias("gap_seconds")).filter(F.col("gap_seconds") > timeout_seconds)


def heartbeat_sessions(heartbeats: DataFrame, timeout_seconds: int = SILENCE_SECONDS) -> DataFrame:
    """Connection sessions: heartbeats of a sensor with no silence longer than the timeout between them."""
    opens = F.when(_silence() <= timeout_seconds, 0).otherwise(1)
    marked = _beats(heartbeats).withColumn("_opens", opens)
    before_day = Window.partitionBy("sensor_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = (
        marked.groupBy("sensor_id", "_day").agg(F.sum("_opens").alias("_opened"))
        .select("sensor_id", "_day", F.coalesce(F.sum("_opened").over(before_day), F.lit(0)).alias("_offset"))
    )
    in_day = Window.partitionBy("sensor_id", "_day").orderBy("received_at")
    return (
        marked.withColumn("_in_day", F.sum("_opens").over(in_day))
        .join(days, ["sensor_id", "_day"])
        .groupBy("sensor_id", (F.col("_offset") + F.col("_in_day")).alias("session_no"))
        .agg(F.min("received_at").alias("connected_at"), F.max("received_at").alias("last_seen"),
             F.sum("beats").alias("heartbeat_count"))
    )
