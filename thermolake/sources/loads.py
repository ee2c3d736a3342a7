"""Append-only Parquet tables of loads, which merge their small loads as they go.

A table is a folder with one partition per load, below one partition per day where it has days. A load that is written
again replaces itself. Loads of a streaming job are named ``<job>-<batch>``, loads that are written only once
``once-<random>``; both may be merged, any other name is left alone.

``upkeep`` merges the small loads of a folder into one. Spark moves a finished partition into place in one step, so the
merged load is seen wholly or not at all; a note beside the table, put there before, names the loads it replaces, and
readers leave those out from the moment they see the merged one. They are deleted by the next upkeep, which gives
running queries that long to finish. A job's newest load in a folder is never merged, as only that one can be run again.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable
from copy import copy

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import child_names, delete_path, hadoop_path, path_exists, use_utc

Change = Callable[[DataFrame], DataFrame]

# a load below this size is small; so many small ones in a folder are merged
SMALL_BYTES = 64 << 20
MERGE_AT = 16
# an upkeep that has not ended after this time never will
ABANDONED_SECONDS = 3600

_JOB_LOAD = re.compile(r"(.+)-(\d+)")
_DAY = re.compile(r"recorded_date=\d{4}-\d\d-\d\d")


def write_loads(df: DataFrame, path: str, *partitions: str, **options: str) -> None:
    """Replaces only the partitions that ``df`` holds; an empty ``df`` changes nothing."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**options)
     .partitionBy(*partitions).parquet(path))


def once() -> str:
    """The name of a load that is never written again."""
    return f"once-{uuid.uuid4().hex}"


class LoadTable:
    """``schema`` ends with the partition columns: ``load_id``, after ``recorded_date`` if the table has days. ``change``
    is applied to rows that are merged, for tables in which later rows take the place of earlier ones."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, change: Change | None = None,
                 small_bytes: int = SMALL_BYTES, merge_at: int = MERGE_AT):
        self.spark = use_utc(spark)
        self.path = path.rstrip("/")
        self.schema = schema
        self.change = change
        self.small_bytes = small_bytes
        self.merge_at = merge_at
        self.partitions = [c for c in ("recorded_date", "load_id") if c in schema.names]
        self._notes = f"{self.path}__replaced"
        self._lock = f"{self.path}__upkeep"

    def on(self, spark: SparkSession) -> LoadTable:
        """The same table for another session, as a micro-batch has its own."""
        if spark is self.spark:
            return self
        there = copy(self)
        there.spark = use_utc(spark)
        return there

    def create(self) -> LoadTable:
        """Creates the empty table; an existing one is left as it is."""
        if not path_exists(self.spark, self.path):
            self.write(self.spark.createDataFrame([], self.schema))
        return self

    def write(self, rows: DataFrame, counted: Observation | None = None) -> None:
        """Writes the loads that ``rows`` name; ``counted`` gets their number as ``rows``."""
        arranged = self.arranged(rows.select(*self.schema.names))
        if counted is not None:
            arranged = arranged.observe(counted, F.count(F.lit(1)).alias("rows"))
        write_loads(arranged, self.path, *self.partitions, **self.file_options())

    def arranged(self, rows: DataFrame) -> DataFrame:
        """How rows are dealt to files: by size."""
        return rows.hint("rebalance")

    def file_options(self) -> dict[str, str]:
        return {}

    # ---- reading --------------------------------------------------------------

    def read(self) -> DataFrame:
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        return self._without_replaced(lambda: self.spark.read.schema(self.schema).parquet(self.path))

    def _without_replaced(self, scan: Callable[[], DataFrame], folders: set[str] | None = None) -> DataFrame:
        """The scan without loads whose merged load it sees. Notes are read before and after Spark lists the files, so
        that neither a merge that begins nor one that ends meanwhile goes unnoticed."""
        before = self._noted()
        listed = rows = scan()
        for (folder, merged), replaced in (before | self._noted()).items():
            if folders is not None and folder not in folders:
                continue
            here = self._in_folder(folder)
            # partition values only: one row, from the files Spark has listed
            if listed.filter(here & (F.col("load_id") == merged)).limit(1).count():
                rows = rows.filter(~(here & F.col("load_id").isin(replaced)))
        return rows

    def _in_folder(self, folder: str):
        return F.col("recorded_date") == F.to_date(F.lit(folder.partition("=")[2])) if folder else F.lit(True)

    def _noted(self) -> dict[tuple[str, str], list[str]]:
        """(folder, merged load) -> loads it replaces; usually nothing."""
        found = {}
        for merged in child_names(self.spark, self._notes):
            for folder in child_names(self.spark, f"{self._notes}/{merged}"):
                names = child_names(self.spark, f"{self._notes}/{merged}/{folder}")
                found["" if folder == "all" else folder, merged] = names
        return found

    # ---- upkeep ---------------------------------------------------------------

    def folders(self) -> list[str]:
        """The folders that hold loads: those of the days, or the table itself."""
        if "recorded_date" not in self.partitions:
            return [""]
        return sorted(n for n in child_names(self.spark, self.path) if _DAY.fullmatch(n))

    def loads(self, folder: str) -> list[str]:
        names = child_names(self.spark, self._at(folder))
        return sorted(n.removeprefix("load_id=") for n in names if n.startswith("load_id="))

    def _at(self, folder: str, load: str | None = None) -> str:
        return "/".join([self.path, *([folder] if folder else []), *([f"load_id={load}"] if load else [])])

    def upkeep(self, folders: list[str] | None = None, merge_at: int | None = None) -> None:
        """Deletes what earlier merges replaced and merges the small loads of every folder (or of ``folders``) that
        holds many. Only one upkeep of a table runs at a time; a second one returns at once and leaves the work to the
        first."""
        merge_at = merge_at or self.merge_at
        fs, lock = hadoop_path(self.spark, self._lock)
        if not fs.createNewFile(lock):
            if time.time() - fs.getFileStatus(lock).getModificationTime() / 1000 < ABANDONED_SECONDS:
                return
        try:
            self._delete_replaced()
            found = {f: self._mergeable(f, merge_at) for f in (self.folders() if folders is None else folders)}
            self.replace({f: names for f, names in found.items() if len(names) >= merge_at}, self.change)
        finally:
            delete_path(self.spark, self._lock)

    def _mergeable(self, folder: str, merge_at: int) -> list[str]:
        names = self.loads(folder)
        if len(names) < merge_at:
            return []
        newest: dict[str, int] = {}
        for job, batch in (m.groups() for m in map(_JOB_LOAD.fullmatch, names) if m):
            newest[job] = max(newest.get(job, -1), int(batch))
        ended = [n for n in names if n.startswith("once-") or (
            (m := _JOB_LOAD.fullmatch(n)) and m[1] != "once" and int(m[2]) < newest[m[1]])]
        fs, _ = hadoop_path(self.spark, self.path)
        size = lambda n: fs.getContentSummary(hadoop_path(self.spark, self._at(folder, n))[1]).getLength()
        return [n for n in ended if size(n) < self.small_bytes]

    def replace(self, loads: dict[str, list[str]], change: Change | None = None) -> None:
        """In each of the folders one new load takes the place of the named ones. One job for all of them."""
        if not loads:
            return
        merged = once()
        noted = self._noted()
        for folder, names in loads.items():
            # what those have replaced themselves is still there
            earlier = {n for (at, m), replaced in noted.items() if at == folder and m in names for n in replaced}
            for name in [*names, *sorted(earlier)]:
                fs, note = hadoop_path(self.spark, f"{self._notes}/{merged}/{folder or 'all'}/{name}")
                fs.mkdirs(note)
        rows = self.spark.read.schema(self.schema).option("basePath", self.path).parquet(
            *[self._at(f, n) for f, names in loads.items() for n in names])
        self.write((change(rows) if change else rows).withColumn("load_id", F.lit(merged)))

    def _delete_replaced(self) -> None:
        """Finishes earlier merges. One that was interrupted before its load was in place changed nothing."""
        ended = [(folder, names) for (folder, merged), names in self._noted().items()
                 if path_exists(self.spark, self._at(folder, merged))]
        for folder, names in ended:
            for name in names:
                delete_path(self.spark, self._at(folder, name))
        if path_exists(self.spark, self._notes):
            delete_path(self.spark, self._notes)

    def clear(self) -> None:
        for path in (self.path, self._notes):
            delete_path(self.spark, path)
