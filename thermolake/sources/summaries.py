"""One row per day, sensor and load, kept as readings are written: totals and daily statistics without the readings.

Every load of the history adds its own summary under the same name, so a micro-batch that is run again replaces both.
Upkeep adds the small loads of a day up. Beside it, for very large fleets, a mergeable sketch of each day's sensor ids
counts them approximately.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quality import is_valid
from ..functions.times import as_instant, truncate_second
from ..operators.scans import Instant
from ..schema import DAY_SKETCHES, DAY_SUMMARIES, DEFAULT_BOUNDS, RECENT_CAPACITY, ValidityBounds
from ..session import delete_path
from .history import HistoryTable
from .loads import MERGE_AT, LoadTable

# 2^12 registers: a relative standard error of about 1.6 %
SKETCH_BITS = 12
_MEASURES = ("temperature", "humidity")


def _added_up(rows: DataFrame, *keys: str) -> DataFrame:
    """Summaries of ``keys`` from those of their parts."""
    return rows.groupBy(*keys).agg(
        F.sum("readings").alias("readings"), F.sum("accepted").alias("accepted"),
        F.min("oldest").alias("oldest"), F.max("newest").alias("newest"),
        *[f(f"{name}_{m}").alias(f"{name}_{m}") for m in _MEASURES
          for name, f in (("min", F.min), ("max", F.max), ("sum", F.sum))])


def _merged_sketches(rows: DataFrame) -> DataFrame:
    return rows.groupBy("recorded_date", "load_id").agg(F.hll_union_agg("sensors").alias("sensors"))


class DaySummaries:
    """Summaries of a history table. ``add`` belongs beside each ``append``."""

    def __init__(self, spark: SparkSession, path: str, bounds: ValidityBounds = DEFAULT_BOUNDS,
                 merge_at: int = MERGE_AT):
        self.spark = spark
        self.path = path.rstrip("/")
        self.bounds = bounds
        self.merge_at = merge_at
        self.table = LoadTable(
            spark, f"{self.path}/days", DAY_SUMMARIES,
            lambda rows: _added_up(rows, "recorded_date", "sensor_id"), merge_at=merge_at)
        self.sketches = LoadTable(
            spark, f"{self.path}/sketches", DAY_SKETCHES,
            lambda rows: _merged_sketches(rows.withColumn("load_id", F.lit(""))), merge_at=merge_at)

    def on(self, spark: SparkSession) -> DaySummaries:
        return self if spark is self.spark else DaySummaries(spark, self.path, self.bounds, self.merge_at)

    # ---- writing --------------------------------------------------------------

    def summarised(self, readings: DataFrame, load_id: str) -> DataFrame:
        """Combined before the shuffle; one sensor with very many rows is one row per day and task."""
        at = truncate_second("recorded_at")
        return readings.withColumn("recorded_at", at).groupBy(
            F.to_date("recorded_at").alias("recorded_date"), "sensor_id").agg(
            F.count(F.lit(1)).alias("readings"), F.count_if(is_valid(self.bounds)).alias("accepted"),
            F.min("recorded_at").alias("oldest"), F.max("recorded_at").alias("newest"),
            *[f(m).alias(f"{name}_{m}") for m in _MEASURES
              for name, f in (("min", F.min), ("max", F.max), ("sum", F.sum))]).withColumn("load_id", F.lit(load_id))

    def add(self, readings: DataFrame, load_id: str, sketched: bool = False) -> None:
        """The summary of one load; ``sketched`` adds the sketch of its sensors."""
        self.table.write(self.summarised(readings, load_id))
        if sketched:
            self.sketches.write(_sketch(readings.withColumn("recorded_date", F.to_date("recorded_at")), load_id))

    def upkeep(self) -> None:
        self.table.upkeep()
        self.sketches.upkeep()

    def delete_older_than(self, days: int, as_of: datetime | str, history: HistoryTable) -> None:
        """Follows ``HistoryTable.delete_older_than``, and comes after it: whole days go, and the boundary day is
        summed up again from what the history kept of it."""
        cutoff = (as_instant(as_of) - timedelta(days=days)).date()
        kept = history.read_days([d for d in history.days() if d == cutoff])
        fresh = {self.table: lambda: self.summarised(kept, ""), self.sketches: lambda: _sketch(kept, "")}
        for table, rows in fresh.items():
            for folder in table.folders():
                if folder < f"recorded_date={cutoff}":
                    delete_path(self.spark, f"{table.path}/{folder}")
                elif folder == f"recorded_date={cutoff}":
                    table.replace({folder: table.loads(folder)}, lambda _: rows())  # noqa: B023

    # ---- reading --------------------------------------------------------------

    def read(self) -> DataFrame:
        """One row per day and sensor."""
        return _added_up(self.table.read(), "recorded_date", "sensor_id")

    def _per_sensor(self) -> DataFrame:
        return _added_up(self.table.read(), "sensor_id").filter("readings > 0")

    def sensor_ids(self) -> DataFrame:
        return self.table.read().select("sensor_id").distinct().orderBy("sensor_id")

    def storage_stats(self) -> DataFrame:
        """One row: count, oldest, newest and number of sensors of the history."""
        return self._per_sensor().agg(
            F.coalesce(F.sum("readings"), F.lit(0)).alias("total_readings"), F.min("oldest").alias("oldest_reading"),
            F.max("newest").alias("newest_reading"), F.count(F.lit(1)).alias("unique_sensors"))

    def recent_totals(self, capacity: int = RECENT_CAPACITY) -> DataFrame:
        """One row: accepted readings, sensors that have any, readings that a view of ``capacity`` per sensor holds."""
        return self._per_sensor().agg(
            F.coalesce(F.sum("accepted"), F.lit(0)).alias("total_readings"),
            F.count_if(F.col("accepted") > 0).alias("unique_sensors"),
            F.coalesce(F.sum(F.least("accepted", F.lit(capacity))), F.lit(0)).alias("current_readings"))

    def approximate_sensors(self) -> DataFrame:
        """One row: about how many sensors there are, from the sketches alone."""
        return self.sketches.read().agg(F.coalesce(
            F.hll_sketch_estimate(F.hll_union_agg("sensors")), F.lit(0)).alias("unique_sensors"))

    def daily_stats(self, first: Instant | None = None, last: Instant | None = None,
                    sensor_id: str | None = None) -> DataFrame:
        """Daily statistics of whole days; newest day first."""
        rows = self.read()
        if sensor_id:
            rows = rows.filter(F.col("sensor_id") == sensor_id)
        if first is not None:
            rows = rows.filter(F.col("recorded_date") >= F.lit(as_instant(first).date()))
        if last is not None:
            rows = rows.filter(F.col("recorded_date") <= F.lit(as_instant(last).date()))
        measures = [c for m in _MEASURES for c in (
            F.col(f"min_{m}").alias(f"min_{m}"), F.col(f"max_{m}").alias(f"max_{m}"),
            (F.col(f"sum_{m}") / F.col("readings")).alias(f"avg_{m}"))]
        return rows.select(F.col("recorded_date").alias("date"), "sensor_id", *measures,
                           F.col("readings").alias("reading_count")).orderBy(F.desc("date"), F.asc("sensor_id"))


def _sketch(rows: DataFrame, load_id: str) -> DataFrame:
    return rows.groupBy("recorded_date").agg(F.hll_sketch_agg("sensor_id", F.lit(SKETCH_BITS)).alias("sensors")).withColumn(
        "load_id", F.lit(load_id))
