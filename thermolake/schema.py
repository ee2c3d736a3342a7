"""Record types, table schemas and the fixed values of the telemetry model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# ---- fixed values -----------------------------------------------------------
# message types on the wire
MESSAGE_TYPES = ("reading", "batch", "heartbeat", "ack", "error", "config")
SERVER_TYPES = ("reading", "batch", "heartbeat")
CLIENT_TYPES = ("ack", "error", "config")

# defaults
RECENT_CAPACITY = 100
BUFFER_CAPACITY = 1000
DRAIN_BATCH = 50
WRITE_BATCH = 100
FLUSH_SECONDS = 5
RETENTION_DAYS = 30
CLEANUP_SECONDS = 3600
SILENCE_SECONDS = 60
PONG_TIMEOUT_SECONDS = 10
HISTORY_LIMIT = 50
HISTORY_LIMIT_MAX = 1000
HISTORY_WINDOW_HOURS = 6
DAILY_WINDOW_DAYS = 7
LATEST_COUNT = 10
LATEST_SENSOR = "pi-sensor-01"

# the instant that stands for "no timestamp"
ZERO_TIME = "0001-01-01 00:00:00"
# -----------------------------------------------------------------------------

# Arrival order: message number, position in the message, broker partition. A frame may hold only the first of them.
ARRIVAL = ("seq", "pos", "part")

# most bytes of log files that a micro-batch takes, and after how many micro-batches small loads are merged
BATCH_BYTES = 1 << 30
UPKEEP_BATCHES = 20

# how far ahead of its arrival a reading may be dated before a live view leaves it out
CLOCK_TOLERANCE_SECONDS = 3600
# how late a heartbeat may come on a stream
LATENESS_SECONDS = 600


@dataclass(frozen=True)
class ValidityBounds:
    """Inclusive limits of an acceptable reading."""

    min_temperature: float = -20.0
    max_temperature: float = 60.0
    min_humidity: float = 0.0
    max_humidity: float = 100.0


DEFAULT_BOUNDS = ValidityBounds()

READING_COLUMNS = ["sensor_id", "recorded_at", "humidity", "temperature"]

MESSAGE_LOG = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("part", T.IntegerType(), True),
    T.StructField("received_at", T.TimestampType(), False),
    T.StructField("value", T.StringType(), True),
])

READINGS = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("pos", T.LongType(), False),
    T.StructField("part", T.IntegerType(), False),
    T.StructField("sensor_id", T.StringType(), False),
    T.StructField("temperature", T.DoubleType(), False),
    T.StructField("humidity", T.DoubleType(), False),
    T.StructField("recorded_at", T.TimestampType(), False),
    T.StructField("created_at", T.TimestampType(), True),
])

# readings as stored: one directory per (day, load)
READINGS_STORED = T.StructType(READINGS.fields + [
    T.StructField("recorded_date", T.DateType(), False),
    T.StructField("load_id", T.StringType(), False),
])

HEARTBEATS = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("part", T.IntegerType(), False),
    T.StructField("sensor_id", T.StringType(), False),
    T.StructField("uptime", T.LongType(), False),
    T.StructField("buffer_size", T.LongType(), False),
    T.StructField("received_at", T.TimestampType(), False),
])

QUARANTINE = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("part", T.IntegerType(), False),
    T.StructField("value", T.StringType(), True),
    T.StructField("reason", T.StringType(), False),
    T.StructField("received_at", T.TimestampType(), False),
])

# readings dated further ahead of their arrival than a clock may be wrong
AHEAD = T.StructType([
    *[READINGS[c] for c in ("seq", "pos", "part", "sensor_id", "temperature", "humidity", "recorded_at")],
    T.StructField("received_at", T.TimestampType(), False),
    T.StructField("ahead_seconds", T.LongType(), False),
])

WRITE_LEDGER = T.StructType([
    T.StructField("job", T.StringType(), False),
    T.StructField("batch_id", T.LongType(), False),
    T.StructField("rows_written", T.LongType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("written_at", T.TimestampType(), False),
])

RETENTION_LEDGER = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("run_at", T.TimestampType(), False),
    T.StructField("retention_days", T.IntegerType(), False),
    T.StructField("deleted", T.LongType(), True),
    T.StructField("status", T.StringType(), False),
])

# one row per day, sensor and load
DAY_SUMMARIES = T.StructType([
    T.StructField("sensor_id", T.StringType(), False),
    T.StructField("readings", T.LongType(), False), T.StructField("accepted", T.LongType(), False),
    T.StructField("oldest", T.TimestampType(), False), T.StructField("newest", T.TimestampType(), False),
    *[T.StructField(f"{name}_{m}", T.DoubleType(), False)
      for m in ("temperature", "humidity") for name in ("min", "max", "sum")],
    T.StructField("recorded_date", T.DateType(), False), T.StructField("load_id", T.StringType(), False),
])

# one row per day and load: a sketch of its sensor ids
DAY_SKETCHES = T.StructType([
    T.StructField("sensors", T.BinaryType(), False),
    T.StructField("recorded_date", T.DateType(), False), T.StructField("load_id", T.StringType(), False),
])


def stored_by_load(schema: T.StructType) -> T.StructType:
    """A table without days, partitioned by load."""
    return T.StructType([*schema.fields, T.StructField("load_id", T.StringType(), False)])


SENSORS = T.StructType([
    T.StructField("sensor_id", T.StringType(), False),
    T.StructField("location", T.StringType(), True),
    T.StructField("sensor_type", T.StringType(), True),
    T.StructField("version", T.StringType(), True),
    T.StructField("start_time", T.TimestampType(), False),
])
