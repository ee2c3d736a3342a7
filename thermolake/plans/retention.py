"""Retention as a batch job with a ledger. Scheduling (at start, then every hour) is left to the scheduler."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import as_instant, instant_literal
from ..schema import CLEANUP_SECONDS, RETENTION_DAYS, RETENTION_LEDGER, stored_by_load
from ..sources.history import HistoryTable
from ..sources.loads import LoadTable, once
from ..sources.summaries import DaySummaries


def cutoff_literal(as_of: datetime | str, days: int = RETENTION_DAYS) -> Column:
    return instant_literal(as_instant(as_of) - timedelta(days=days))


def retention_kept(df: DataFrame, as_of: datetime | str, days: int = RETENTION_DAYS) -> DataFrame:
    """What a cleanup leaves; a row exactly at the cutoff stays."""
    return df.filter(F.col("recorded_at") >= cutoff_literal(as_of, days))


def retention_deleted(df: DataFrame, as_of: datetime | str, days: int = RETENTION_DAYS) -> DataFrame:
    """Per day the number of readings a cleanup removes."""
    return (
        df.filter(F.col("recorded_at") < cutoff_literal(as_of, days))
        .groupBy(F.to_date("recorded_at").alias("date")).agg(F.count(F.lit(1)).alias("deleted"))
    )


def cleanup_period(seconds: int | None) -> int:
    """Period between runs; absent or non-positive gives the default."""
    return seconds if seconds and seconds > 0 else CLEANUP_SECONDS


def _ledger(spark: SparkSession, path: str) -> LoadTable:
    return LoadTable(spark, path, stored_by_load(RETENTION_LEDGER))


def read_retention_ledger(spark: SparkSession, path: str) -> DataFrame:
    return _ledger(spark, path).read().select(*RETENTION_LEDGER.names)


def run_retention(
    table: HistoryTable, ledger_path: str, as_of: datetime | str, days: int = RETENTION_DAYS, run_id: str | None = None,
    summaries: DaySummaries | None = None,
) -> int:
    """One cleanup run, which also merges small loads of the history and of the ledger. A failed run is recorded too,
    then raised. A run with the id of an earlier one takes its place in the ledger."""
    if days < 1:
        raise ValueError("retention must keep at least one day")
    run_id = run_id or once()
    try:
        deleted = table.delete_older_than(days, as_of)
        table.upkeep()
        if summaries is not None:
            summaries.delete_older_than(days, as_of, table)
            summaries.upkeep()
    except Exception:
        _record(table.spark, ledger_path, run_id, as_of, days, None, "error")
        raise
    _record(table.spark, ledger_path, run_id, as_of, days, deleted, "ok")
    return deleted


def _record(spark, path, run_id, as_of, days, deleted, status) -> None:
    row = spark.range(1).select(
        F.lit(run_id).alias("run_id"), instant_literal(as_of).alias("run_at"),
        F.lit(days).alias("retention_days"), F.lit(deleted).cast("long").alias("deleted"),
        F.lit(status).alias("status"), F.lit(run_id).alias("load_id"))
    ledger = _ledger(spark, path)
    ledger.write(row)
    ledger.upkeep()


def retention_stats(ledger: DataFrame, days: int = RETENTION_DAYS) -> DataFrame:
    """One row of totals. A failed run counts as a cleanup but leaves the last delete count."""
    succeeded = F.when(F.col("status") == "ok", F.col("run_at"))
    return ledger.agg(
        F.coalesce(F.sum("deleted"), F.lit(0)).alias("total_deleted"),
        F.count(F.lit(1)).alias("total_cleanups"),
        F.max("run_at").alias("last_cleanup"),
        F.coalesce(F.max_by("deleted", succeeded), F.lit(0)).alias("last_delete_count"),
        F.lit(days).alias("retention_days"),
    )
