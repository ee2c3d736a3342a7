"""The append-only readings history: Parquet, one directory per (UTC day, load)."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.times import as_instant, instant_literal, truncate_second
from ..operators.aggregates import one_row, storage_stats
from ..operators.ranking import with_arrival
from ..schema import READINGS_STORED
from ..session import delete_path, path_exists
from .loads import MERGE_AT, SMALL_BYTES, LoadTable, once

ROW_GROUP_BYTES = 32 << 20


class HistoryTable(LoadTable):
    def __init__(self, spark: SparkSession, path: str, small_bytes: int = SMALL_BYTES, merge_at: int = MERGE_AT):
        super().__init__(spark, path, READINGS_STORED, None, small_bytes, merge_at)

    def arranged(self, rows: DataFrame) -> DataFrame:
        """Each file holds a range of days, loads, sensors and times, so its min/max values prune; a sensor with very
        many rows spans several."""
        order = ("recorded_date", "load_id", "sensor_id", "recorded_at")
        return rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def file_options(self) -> dict[str, str]:
        """What an index on (sensor, time) is elsewhere: row groups small enough to skip by their ranges, and a filter
        of each one's sensor ids, no larger than these need, where ranges of sensors overlap."""
        return {"parquet.block.size": str(ROW_GROUP_BYTES), "parquet.bloom.filter.enabled#sensor_id": "true",
                "parquet.bloom.filter.adaptive.enabled": "true"}

    def append(self, readings: DataFrame, load_id: str | None = None, counted: Observation | None = None) -> str:
        """Appends readings without validating them; ``recorded_at`` is cut to the second. Readings numbered one by
        one may lack ``pos`` and ``part``. A load that is written again replaces itself."""
        load_id = load_id or once()
        recorded_at = truncate_second("recorded_at")
        self.write(with_arrival(readings).select(
            "seq", "pos", "part", "sensor_id", "temperature", "humidity",
            recorded_at.alias("recorded_at"),
            F.current_timestamp().alias("created_at"),
            F.to_date(recorded_at).alias("recorded_date"),
            F.lit(load_id).alias("load_id"),
        ), counted)
        return load_id

    def compact_day(self, day: date | str) -> None:
        """Merges the ended loads of one day, however few they are."""
        self.upkeep([_day_dir(day)], merge_at=2)

    # ---- days -----------------------------------------------------------------

    def days(self) -> list[date]:
        """The days that have a folder, in order: a listing of the table's folder, no data."""
        return [date.fromisoformat(n.removeprefix("recorded_date=")) for n in self.folders()]

    def read_days(self, days: list[date]) -> DataFrame:
        """The readings of some successive days. Neither files nor folders of other days are even listed."""
        if not days:
            return self.spark.createDataFrame([], self.schema)
        folders = [_day_dir(d) for d in days]
        rows = self._without_replaced(
            lambda: self.spark.read.schema(self.schema).option("basePath", self.path).parquet(
                *[self._at(f) for f in folders]), set(folders))
        return rows.filter(F.col("recorded_date").between(F.lit(days[0]), F.lit(days[-1])))

    # ---- statistics -------------------------------------------------------------

    def size_mb(self) -> DataFrame:
        """One row with the table's size. Only file names and lengths are read."""
        files = (
            self.spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
            .load(self.path)
        )
        return files.agg((F.coalesce(F.sum("length"), F.lit(0)) / F.lit(1024 * 1024)).alias("database_size_mb"))

    def stats(self) -> DataFrame:
        return one_row(storage_stats(self.read()), self.size_mb())

    # ---- retention --------------------------------------------------------------

    def delete_older_than(self, days: int, as_of: datetime | str) -> int:
        """Deletes readings with ``recorded_at`` before ``as_of`` minus ``days`` and returns their number.

        Whole days are dropped as directories. Of the boundary day, loads that hold expired rows only are dropped, and
        one new load takes the place of those that hold some.
        """
        if days < 1:
            raise ValueError("retention must keep at least one day")
        if not path_exists(self.spark, self.path):
            raise FileNotFoundError(self.path)
        cutoff = as_instant(as_of) - timedelta(days=days)
        past = [d for d in self.days() if d <= cutoff.date()]
        rows = self.read_days(past)
        expired = F.col("recorded_at") < instant_literal(cutoff)
        deleted = rows.filter(expired).count()

        folder = _day_dir(cutoff.date())
        # one entry per load of one day: metadata, not rows
        touched = (
            rows.filter(F.col("recorded_date") == F.lit(cutoff.date())).groupBy("load_id")
            .agg(F.count_if(~expired).alias("kept"), F.count_if(expired).alias("gone")).filter("gone > 0").collect())
        shrunk = [r.load_id for r in touched if r.kept]
        if shrunk:
            self.replace({folder: shrunk}, lambda found: found.filter(~expired))
        for load in (r.load_id for r in touched if not r.kept):
            delete_path(self.spark, self._at(folder, load))
        for day in past:
            if day < cutoff.date():
                delete_path(self.spark, self._at(_day_dir(day)))
        return deleted


def _day_dir(day: date | str) -> str:
    return f"recorded_date={day}"
