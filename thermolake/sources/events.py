"""Telemetry derived from the given ``events`` table: readings and a message log."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import as_instant, truncate_second
from ..operators.inventory import first_seen
from ..operators.packing import pack_batches
from ..session import use_utc, work_dir
from .envelopes import batch_payload, encode_message, heartbeat_payload, reading_payload


def _events_path(sf_dir: str) -> str:
    return f"{sf_dir.rstrip('/')}/events.parquet"


def sensor_name(user_id: Column | str) -> Column:
    """``sensor-0007``; ids of more than four digits keep all of them."""
    digits = F.col(user_id).cast("string") if isinstance(user_id, str) else user_id.cast("string")
    return F.concat(F.lit("sensor-"), F.lpad(digits, F.greatest(F.length(digits), F.lit(4)), F.lit("0")))


def _readings(events: DataFrame) -> DataFrame:
    # props is an object with the one number k; a pattern is much cheaper than a JSON parser here, and the
    # optimiser copies this expression to every place that uses the humidity
    level = F.regexp_extract("props", r'"k": *(\d+)', 1).try_cast("double")
    return events.select(
        F.col("event_id").alias("seq"),
        sensor_name("user_id").alias("sensor_id"),
        truncate_second("ts").alias("recorded_at"),
        (F.col("value") - 30).alias("temperature"),
        (level * 1.25 - 10).alias("humidity"),
        "event_type",
        level.cast("long").alias("level"),
    )


def _ntz(value: datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def load_readings(
    spark: SparkSession,
    sf_dir: str,
    user_id: int | None = None,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
) -> DataFrame:
    """Readings, optionally of one device and a closed whole-second range. These bounds are put on the raw
    columns, so they reach the Parquet scan."""
    events = use_utc(spark).read.parquet(_events_path(sf_dir))
    if user_id is not None:
        events = events.filter(F.col("user_id") == user_id)
    if start is not None:
        events = events.filter(F.col("ts") >= _ntz(as_instant(start)))
    if end is not None:
        events = events.filter(F.col("ts") < _ntz(as_instant(end) + timedelta(seconds=1)))
    return _readings(events)


def stream_readings(spark: SparkSession, sf_dir: str, files: int = 4) -> DataFrame:
    """The same mapping over a file stream: the table is dealt to ``files`` files, one for each micro-batch, so that
    state and results cross batches. Each reading arrives at its own time."""
    events = use_utc(spark).read.parquet(_events_path(sf_dir))
    path = work_dir(spark, "event-files")
    part = F.pmod(F.xxhash64("event_id"), F.lit(files))
    for i in range(files):  # a file each, in this order
        events.filter(part == i).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return _readings(stream).withColumn("received_at", F.col("recorded_at"))


def load_heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signup events as heartbeats; uptime counts from the sensor's first event."""
    rows = load_readings(spark, sf_dir)
    beats = rows.filter(F.col("event_type") == "signup")
    return beats.join(first_seen(rows), "sensor_id").select(
        "seq", "sensor_id",
        (F.unix_seconds("recorded_at") - F.unix_seconds("start_time")).alias("uptime"),
        F.col("level").alias("buffer_size"),
        F.col("recorded_at").alias("received_at"),
    )


def heartbeat_times(readings: DataFrame) -> DataFrame:
    """Only sensor and time of the heartbeats, for the liveness queries."""
    return readings.filter(F.col("event_type") == "signup").select(
        "sensor_id", F.col("recorded_at").alias("received_at"))


def message_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelope strings: clicks and purchases as single readings, views packed into batches, signups as
    heartbeats, errors as error messages, and for every ninth error also an ack and a config message."""
    rows = load_readings(spark, sf_dir)
    single = rows.filter(F.col("event_type").isin("click", "purchase")).select(
        "seq", F.col("recorded_at").alias("received_at"),
        encode_message("reading", reading_payload(), F.col("recorded_at")).alias("value"))
    batches = pack_batches(rows.filter(F.col("event_type") == "view"))
    sent = F.element_at("readings", -1)["recorded_at"]
    batch = batches.select(
        F.col("last_seq").alias("seq"), sent.alias("received_at"),
        encode_message("batch", batch_payload(), sent).alias("value"))
    heartbeat = load_heartbeats(spark, sf_dir).select(
        "seq", "received_at",
        encode_message("heartbeat", heartbeat_payload(), F.col("received_at")).alias("value"))
    return single.union(batch).union(heartbeat).union(control_log(rows))


def control_log(rows: DataFrame) -> DataFrame:
    """Messages to the client: an error per error event; an ack where its level divides by 9, a config by 11."""
    errors = rows.filter(F.col("event_type") == "error")
    code = F.concat(F.lit("E"), F.col("level"))

    def said(kind: str, payload: Column, chosen: DataFrame) -> DataFrame:
        return chosen.select("seq", F.col("recorded_at").alias("received_at"),
                             encode_message(kind, payload, F.col("recorded_at")).alias("value"))

    return said("error", F.struct(code.alias("code"), F.col("sensor_id").alias("message")), errors).union(
        said("ack", F.struct(F.concat(F.lit("m"), F.col("seq")).alias("message_id"), F.lit("ok").alias("status")),
             errors.filter("level % 9 = 0"))).union(
        said("config", F.struct(F.col("level").alias("read_interval"), F.lit(50).alias("buffer_size"), "sensor_id"),
             errors.filter("level % 11 = 0")))
