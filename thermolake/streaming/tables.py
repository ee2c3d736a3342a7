"""Keyed views that streaming jobs keep as a table of loads.

Every micro-batch adds the rows it changed as one load, so jobs never write to each other's folders and a batch that is
run again replaces its own rows. Readers take the newest row of a key, and what different jobs say about it is put
together. Upkeep folds the small loads of many batches into one, keeping of each job and key the newest row: the table
follows the keys, not the batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import UPKEEP_BATCHES
from ..session import job_of
from ..sources.loads import MERGE_AT, SMALL_BYTES, LoadTable

Change = Callable[[DataFrame], DataFrame]


class LiveTable(LoadTable):
    """``newest`` reduces rows (with their ``job`` and ``batch``) to those that still count, however often it is
    applied; ``across`` puts the rows of different jobs together. ``files`` is how many files a batch's changes make."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, newest: Change, across: Change,
                 upkeep_every: int = UPKEEP_BATCHES, files: int = 4, small_bytes: int = SMALL_BYTES,
                 merge_at: int = MERGE_AT):
        stored = T.StructType([
            *schema.fields, T.StructField("job", T.StringType()), T.StructField("batch", T.LongType()),
            T.StructField("load_id", T.StringType())])
        super().__init__(spark, path, stored, newest, small_bytes, merge_at)
        self.columns = schema.names
        self.newest, self.across = newest, across
        self.upkeep_every = upkeep_every
        self.files = files

    def arranged(self, rows: DataFrame) -> DataFrame:
        # no sampling: a micro-batch is computed only once
        return rows.repartition(self.files)

    def merge(self, arrived: DataFrame, batch_id: int, job: str | None = None) -> None:
        """Takes in the changed rows of a micro-batch. A job's batches come one after the other, as Spark runs them."""
        job = job or job_of(arrived)
        table = self.on(arrived.sparkSession)
        table.write(arrived.select(*self.columns).withColumns({
            "job": F.lit(job), "batch": F.lit(batch_id).cast("long"), "load_id": F.lit(f"{job}-{batch_id}")}))
        if (batch_id + 1) % self.upkeep_every == 0:
            table.upkeep()

    def view(self) -> DataFrame:
        return self.across(self.newest(self.read())).select(*self.columns)


def newest_by(keys: list[str]) -> Change:
    """Of every job and key the row of the latest batch."""
    def newest(rows: DataFrame) -> DataFrame:
        latest = Window.partitionBy("job", *keys).orderBy(F.desc("batch"))
        return rows.withColumn("_place", F.row_number().over(latest)).filter("_place = 1").drop("_place")

    return newest
