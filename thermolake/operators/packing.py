"""Packing buffered readings into batches, oldest first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DRAIN_BATCH, READING_COLUMNS
from .ranking import BLOCK, arrival, number_rows


def pack_batches(df: DataFrame, size: int = DRAIN_BATCH, block: int = BLOCK) -> DataFrame:
    """One row per batch of at most ``size`` readings of a sensor in arrival order. No rows give no batches."""
    numbered = number_rows(df.select(*arrival(df), *READING_COLUMNS), ["sensor_id"], "row_no", block)
    chunk = F.floor((F.col("row_no") - 1) / F.lit(size)).cast("long")
    return (
        numbered.groupBy("sensor_id", chunk.alias("batch_no"))
        .agg(
            F.sort_array(F.collect_list(F.struct(*arrival(df), *READING_COLUMNS))).alias("readings"),
            F.count(F.lit(1)).alias("count"),
            F.min("seq").alias("first_seq"),
            F.max("seq").alias("last_seq"),
        )
    )
