"""Micro-batched ingest: message log in, history, heartbeats, quarantine and write ledger out.

Every table is partitioned by load. A load is named after the job (the id that its checkpoint gives the streaming
query) and the micro-batch: a batch that is run again after a failure replaces its own rows, and another job, or the
same one with a fresh checkpoint, replaces nothing. Every so many batches the job merges the small loads of all tables.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.quality import ahead_of_clock, ahead_seconds, valid_filter
from ..schema import (
    AHEAD,
    BATCH_BYTES,
    FLUSH_SECONDS,
    HEARTBEATS,
    MESSAGE_LOG,
    QUARANTINE,
    UPKEEP_BATCHES,
    WRITE_LEDGER,
    stored_by_load,
)
from ..session import job_of, use_utc
from ..sources.envelopes import decode_heartbeats, decode_readings, parse_envelopes, quarantined
from ..sources.history import HistoryTable
from ..sources.loads import MERGE_AT, LoadTable, once
from ..sources.summaries import DaySummaries

OnValid = Callable[[DataFrame, int], None]


def read_log_files(spark: SparkSession, path: str, max_files_per_trigger: int | None = None,
                   max_bytes_per_trigger: int = BATCH_BYTES) -> DataFrame:
    """Stream of JSON lines with seq, received_at and the envelope text in ``value``. A micro-batch is bounded by the
    bytes of its files, or by their number if one is given."""
    reader = use_utc(spark).readStream.schema(MESSAGE_LOG)
    if max_files_per_trigger:
        return reader.option("maxFilesPerTrigger", max_files_per_trigger).json(path)
    return reader.option("maxBytesPerTrigger", max_bytes_per_trigger).json(path)


def from_broker(records: DataFrame) -> DataFrame:
    """Broker records (value, partition, offset, timestamp) to the message log. Records keyed by sensor share a
    partition, so offsets follow each sensor's arrival order. Offsets repeat between partitions, hence ``part``.

    Give the reader ``maxOffsetsPerTrigger``: it bounds a micro-batch as the writer's queue bounds its own.
    """
    part = F.col("partition") if "partition" in records.columns else F.lit(0)
    return records.select(
        F.col("offset").alias("seq"), part.cast("int").alias("part"), F.col("timestamp").alias("received_at"),
        F.col("value").cast("string").alias("value"))


class TelemetryTables:
    """The tables an ingest job fills, below one root folder. ``sketched`` keeps sketches of each day's sensor ids."""

    def __init__(self, spark: SparkSession, root: str, merge_at: int = MERGE_AT, sketched: bool = False):
        self.sketched = sketched
        self.spark = use_utc(spark)
        self.root = root.rstrip("/")
        self.merge_at = merge_at
        self.retention_ledger_path = f"{self.root}/retention_ledger"
        self.history = HistoryTable(spark, f"{self.root}/readings", merge_at=merge_at).create()
        self.summaries = DaySummaries(spark, f"{self.root}/summaries", merge_at=merge_at)
        self.heartbeat_table = self._table("heartbeats", HEARTBEATS)
        self.quarantine_table = self._table("quarantine", QUARANTINE)
        self.ledger_table = self._table("write_ledger", WRITE_LEDGER)
        self.ahead_table = self._table("ahead_of_clock", AHEAD)

    def _table(self, name: str, schema) -> LoadTable:
        return LoadTable(self.spark, f"{self.root}/{name}", stored_by_load(schema), merge_at=self.merge_at)

    def on(self, spark: SparkSession) -> TelemetryTables:
        """The same tables for another session, as a micro-batch has its own."""
        return self if spark is self.spark else TelemetryTables(spark, self.root, self.merge_at, self.sketched)

    def heartbeats(self) -> DataFrame:
        return self.heartbeat_table.read().drop("load_id")

    def quarantine(self) -> DataFrame:
        return self.quarantine_table.read().drop("load_id")

    def ledger(self) -> DataFrame:
        return self.ledger_table.read().drop("load_id")

    def ahead(self) -> DataFrame:
        """Readings dated over an hour ahead of their arrival. The history has them too; live statistics don't."""
        return self.ahead_table.read().drop("load_id")

    def upkeep(self) -> None:
        """Merges the small loads of every table."""
        for table in (self.history, self.heartbeat_table, self.quarantine_table, self.ledger_table, self.ahead_table):
            table.upkeep()
        self.summaries.upkeep()


def write_batch(tables: TelemetryTables, log: DataFrame, batch_id: int, on_valid: OnValid | None = None,
                job: str | None = None, upkeep_every: int = UPKEEP_BATCHES) -> None:
    """One micro-batch: all decoded readings go to the history, the valid ones also to ``on_valid``. After every
    ``upkeep_every`` batches small loads are merged."""
    tables = tables.on(log.sparkSession)
    job = job or job_of(log)
    load_id = f"{job}-{batch_id}"
    parsed, readings = parse_envelopes(log).persist(), None
    try:
        # decoded once for all the tables that take readings
        readings = decode_readings(parsed).persist()
        written = Observation()
        tables.history.append(readings, load_id, written)
        tables.summaries.add(readings, load_id, tables.sketched)
        for rows, table in (
            (decode_heartbeats(parsed), tables.heartbeat_table), (quarantined(parsed), tables.quarantine_table),
            (readings.filter(ahead_of_clock()).withColumn("ahead_seconds", ahead_seconds()), tables.ahead_table),
        ):
            table.write(rows.withColumn("load_id", F.lit(load_id)))
        if on_valid is not None:
            on_valid(readings.filter(valid_filter()), batch_id)
        _record(tables, job, batch_id, written.get["rows"], "ok", load_id)
    except Exception as failure:
        try:  # every failure is an entry of its own
            _record(tables, job, batch_id, 0, "error", once())
        except Exception as second:
            failure.add_note(f"the failure could not be recorded: {second}")
        raise
    finally:
        if readings is not None:
            readings.unpersist()
        parsed.unpersist()
    if (batch_id + 1) % upkeep_every == 0:
        tables.upkeep()


def _record(tables: TelemetryTables, job: str, batch_id: int, rows: int, status: str, load_id: str) -> None:
    row = tables.spark.range(1).select(
        F.lit(job).alias("job"), F.lit(batch_id).cast("long").alias("batch_id"),
        F.lit(rows).cast("long").alias("rows_written"), F.lit(status).alias("status"),
        F.current_timestamp().alias("written_at"), F.lit(load_id).alias("load_id"))
    tables.ledger_table.write(row)


def start_ingest(
    log: DataFrame,
    tables: TelemetryTables,
    checkpoint: str,
    available_now: bool = False,
    flush_seconds: int = FLUSH_SECONDS,
    on_valid: OnValid | None = None,
    upkeep_every: int = UPKEEP_BATCHES,
) -> StreamingQuery:
    """Starts the job. ``available_now`` drains what is there and stops. An ``on_valid`` must not fail on rows it has
    seen before, as a batch may be run again."""
    trigger = {"availableNow": True} if available_now else {"processingTime": f"{flush_seconds} seconds"}
    return (
        log.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger)
        .foreachBatch(lambda df, batch_id: write_batch(tables, df, batch_id, on_valid, upkeep_every=upkeep_every))
        .start()
    )


def write_stats(ledger: DataFrame) -> DataFrame:
    """One row: rows, batches and errors so far and the time of the last write. Batches without readings
    are not counted."""
    wrote = (F.col("status") == "ok") & (F.col("rows_written") > 0)
    return ledger.agg(
        F.coalesce(F.sum(F.when(wrote, F.col("rows_written"))), F.lit(0)).alias("total_written"),
        F.count_if(wrote).alias("total_batches"),
        F.count_if(F.col("status") == "error").alias("total_errors"),
        F.max(F.when(wrote, F.col("written_at"))).alias("last_write_time"),
    )


def _offset_sum(offsets) -> int | None:
    """Sum of a source's offsets: {topic: {partition: offset}} or a single number; None for anything else."""
    offsets = json.loads(offsets) if isinstance(offsets, str) else offsets
    if isinstance(offsets, int):
        return offsets
    if isinstance(offsets, dict):
        parts = [_offset_sum(v) for v in offsets.values()]
        return None if any(p is None for p in parts) else sum(parts)
    return None


def queue_length(query: StreamingQuery) -> int | None:
    """Records that have arrived and are not taken yet: latest less processed offsets over all sources. None where a
    source doesn't report its latest offset, as file sources don't."""
    progress = query.lastProgress
    if not progress:
        return 0
    total = 0
    for source in progress["sources"]:
        latest, done = _offset_sum(source.get("latestOffset")), _offset_sum(source.get("endOffset"))
        if latest is None or done is None:
            return None
        total += max(latest - done, 0)
    return total
