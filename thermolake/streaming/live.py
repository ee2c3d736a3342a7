"""Streaming aggregates per sensor, kept in tables whose size follows the keys, not the batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.quality import ahead_of_clock
from ..functions.times import truncate_second
from ..operators.aggregates import daily_measures
from ..operators.liveness import of_known_sensors
from ..schema import (
    CLOCK_TOLERANCE_SECONDS,
    LATENESS_SECONDS,
    PONG_TIMEOUT_SECONDS,
    RETENTION_DAYS,
    SILENCE_SECONDS,
    UPKEEP_BATCHES,
    stored_by_load,
)
from ..session import job_of
from ..sources.loads import MERGE_AT, LoadTable
from .tables import LiveTable, newest_by

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def live_daily_stats(
    readings: DataFrame, retention_days: int = RETENTION_DAYS,
    clock_tolerance_seconds: int | None = CLOCK_TOLERANCE_SECONDS,
) -> DataFrame:
    """Daily statistics that update as readings arrive.

    The watermark is the retention period, so only rows that retention would delete are late. One wrong clock must not
    advance it: rows dated ahead of their ``received_at`` are left out here (the history still has them), and the
    query's progress counts them as ``ahead_of_clock``. None, or a stream without ``received_at``, lets all in.
    """
    if clock_tolerance_seconds is not None and "received_at" in readings.columns:
        ahead = ahead_of_clock(clock_tolerance_seconds)
        readings = readings.observe("ahead_of_clock", F.count_if(ahead).alias("rows")).filter(~ahead)
    day = F.window("recorded_at", "1 day")
    return (
        readings.withWatermark("recorded_at", f"{retention_days} days")
        .groupBy(day, "sensor_id").agg(*daily_measures())
        .withColumn("date", F.to_date("window.start")).drop("window")
    )


def live_last_seen(heartbeats: DataFrame) -> DataFrame:
    return of_known_sensors(heartbeats).groupBy("sensor_id").agg(F.max("received_at").alias("last_seen"))


def live_sessions(heartbeats: DataFrame, timeout_seconds: int = SILENCE_SECONDS,
                  lateness_seconds: int = LATENESS_SECONDS) -> DataFrame:
    """Connection sessions as they end: sensor_id, connected_at, last_seen, heartbeat_count.

    A session ends ``timeout_seconds`` after its last heartbeat, in event time: no further heartbeat of the sensor is
    needed, only that others move the watermark on, so a sensor that fell silent is reported. Heartbeats may come in any
    order within ``lateness_seconds``. Each session comes out once, for append mode. Spark joins windows that touch, so
    a silence of exactly the timeout does not end a session, as in the batch form.
    """
    beats = of_known_sensors(heartbeats.withColumn("received_at", truncate_second("received_at")).withWatermark(
        "received_at", f"{lateness_seconds} seconds"))
    return (
        beats.groupBy("sensor_id", F.session_window("received_at", f"{timeout_seconds} seconds").alias("session"))
        .agg(F.min("received_at").alias("connected_at"), F.max("received_at").alias("last_seen"),
             F.count(F.lit(1)).alias("heartbeat_count"))
        .drop("session")
    )


def live_silences(heartbeats: DataFrame, timeout_seconds: int = PONG_TIMEOUT_SECONDS,
                  lateness_seconds: int = LATENESS_SECONDS) -> DataFrame:
    """An alarm for every silence longer than the timeout, as soon as the watermark shows it: sensor_id, silent_since,
    noticed_at (when the next heartbeat was due)."""
    ended = live_sessions(heartbeats, timeout_seconds, lateness_seconds)
    return ended.select("sensor_id", F.col("last_seen").alias("silent_since"),
                        (F.col("last_seen") + F.make_dt_interval(secs=F.lit(timeout_seconds))).alias("noticed_at"))


def start_log(rows: DataFrame, table: LoadTable, checkpoint: str, available_now: bool = False, seconds: int = 5,
              upkeep_every: int = UPKEEP_BATCHES) -> StreamingQuery:
    """Appends what a stream emits, such as ended sessions, to a table of loads. State lives on disk."""
    def add(df: DataFrame, batch_id: int) -> None:
        here = table.on(df.sparkSession)
        here.write(df.withColumn("load_id", F.lit(f"{job_of(df)}-{batch_id}")))
        if (batch_id + 1) % upkeep_every == 0:
            here.upkeep()

    return _start(rows, "append", add, checkpoint, available_now, seconds)


def log_table(spark: SparkSession, path: str, schema: T.StructType, merge_at: int = MERGE_AT) -> LoadTable:
    return LoadTable(spark, path, stored_by_load(schema), merge_at=merge_at)


def daily_stats_table(spark: SparkSession, path: str, schema: T.StructType, upkeep_every: int = UPKEEP_BATCHES,
                      merge_at: int = MERGE_AT) -> LiveTable:
    """The table of ``live_daily_stats``. Jobs count the readings of their own streams, which are added up."""
    keys = ["date", "sensor_id"]
    average = lambda c: F.sum(F.col(c) * F.col("reading_count")) / F.sum("reading_count")

    def across(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(
            *[F.min(f"min_{m}").alias(f"min_{m}") for m in ("temperature", "humidity")],
            *[F.max(f"max_{m}").alias(f"max_{m}") for m in ("temperature", "humidity")],
            *[average(f"avg_{m}").alias(f"avg_{m}") for m in ("temperature", "humidity")],
            F.sum("reading_count").alias("reading_count"))

    return LiveTable(spark, path, schema, newest_by(keys), across, upkeep_every, merge_at=merge_at)


def last_seen_table(spark: SparkSession, path: str, schema: T.StructType, upkeep_every: int = UPKEEP_BATCHES,
                    merge_at: int = MERGE_AT) -> LiveTable:
    """The table of ``live_last_seen``: a sensor was seen when any job saw it last."""
    return LiveTable(
        spark, path, schema, newest_by(["sensor_id"]),
        lambda rows: rows.groupBy("sensor_id").agg(F.max("last_seen").alias("last_seen")), upkeep_every,
        merge_at=merge_at)


def start_view(
    view: DataFrame, table: LiveTable, checkpoint: str, available_now: bool = False, seconds: int = 5
) -> StreamingQuery:
    """Adds the changed rows of every micro-batch to the table. State lives on disk, not in the heap."""
    return _start(view, "update", table.merge, checkpoint, available_now, seconds)


def _start(rows: DataFrame, mode: str, add, checkpoint: str, available_now: bool, seconds: int) -> StreamingQuery:
    trigger = {"availableNow": True} if available_now else {"processingTime": f"{seconds} seconds"}
    conf = rows.sparkSession.conf
    before = conf.get(_STORE)
    conf.set(_STORE, _ROCKS)
    try:
        return (
            rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(**trigger)
            .foreachBatch(lambda df, batch_id: add(df, batch_id)).start()
        )
    finally:
        conf.set(_STORE, before)
