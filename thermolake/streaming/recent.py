"""The recent view as a table that micro-batches update."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.quality import valid_filter
from ..operators.ranking import newest_arrivals, with_arrival
from ..schema import (
    ARRIVAL,
    DEFAULT_BOUNDS,
    FLUSH_SECONDS,
    READING_COLUMNS,
    READINGS,
    RECENT_CAPACITY,
    UPKEEP_BATCHES,
    ValidityBounds,
)
from ..sources.loads import MERGE_AT
from .tables import LiveTable

_COLUMNS = [*ARRIVAL, *READING_COLUMNS]
_SCHEMA = T.StructType([READINGS[c] for c in _COLUMNS])


class RecentViewTable:
    """Per sensor the newest ``capacity`` valid readings by arrival. A micro-batch writes the newest it holds itself and
    reads nothing; what newer ones push out goes when loads are merged, and is left out of what is read."""

    def __init__(
        self, spark: SparkSession, path: str, capacity: int = RECENT_CAPACITY,
        bounds: ValidityBounds = DEFAULT_BOUNDS, upkeep_every: int = UPKEEP_BATCHES, merge_at: int = MERGE_AT,
    ):
        self.bounds = bounds
        self.capacity = capacity

        def newest(rows: DataFrame) -> DataFrame:
            # rows that come twice, as from two jobs over one log, count once
            return newest_arrivals(rows.dropDuplicates([*ARRIVAL, "sensor_id"]), capacity, "_rank").drop("_rank")

        self.table = LiveTable(
            spark, path, _SCHEMA, newest, lambda rows: rows, upkeep_every=upkeep_every, merge_at=merge_at)

    def read(self) -> DataFrame:
        return self.table.view()

    def merge(self, arrived: DataFrame, batch_id: int, job: str | None = None) -> None:
        """Adds the valid readings of a micro-batch."""
        rows = with_arrival(arrived).filter(valid_filter(self.bounds)).select(*_COLUMNS)
        self.table.merge(newest_arrivals(rows, self.capacity, "_rank"), batch_id, job)

    def clear(self) -> None:
        """Forgets every reading. Jobs that go on begin again with the next batch."""
        self.table.clear()

    def start(
        self, readings: DataFrame, checkpoint: str, available_now: bool = False, seconds: int = FLUSH_SECONDS
    ) -> StreamingQuery:
        """Keeps the view up to date from a stream of readings."""
        trigger = {"availableNow": True} if available_now else {"processingTime": f"{seconds} seconds"}
        return (
            readings.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger)
            .foreachBatch(lambda df, batch_id: self.merge(df, batch_id)).start()
        )
