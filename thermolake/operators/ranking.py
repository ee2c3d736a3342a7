"""Per-key newest/oldest n and exact row numbers, built so that one hot key never becomes one task's input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ARRIVAL

# a hot key is ranked by so many tasks before its survivors meet
LANES = 256
# readings of so many successive message numbers are ordered together
BLOCK = 20_000


def arrival(df: DataFrame) -> list[str]:
    """The columns of the arrival order that ``df`` has."""
    return [c for c in ARRIVAL if c in df.columns]


def with_arrival(df: DataFrame) -> DataFrame:
    """Adds what is missing: readings numbered one by one have position 0 of partition 0."""
    missing = {"pos": F.lit(0).cast("long"), "part": F.lit(0)}
    return df.withColumns({c: v for c, v in missing.items() if c not in df.columns})


def _first_n(df: DataFrame, partition: list[str], order: list[Column], n: int, rank: str) -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def first_n_per_key(
    df: DataFrame, key: str, order: list[Column], n: int, rank: str = "rank", lanes: int = LANES
) -> DataFrame:
    """The first ``n`` rows of every key by ``order`` (a total order that includes the arrival), ranked from 1.

    Two levels: first within (key, lane), then within key over at most ``lanes * n`` rows. Spark cuts every
    map task to ``n`` rows per group before the shuffle (WindowGroupLimit), and a hot key is ranked by
    ``lanes`` tasks before its survivors meet.
    """
    laned = df.withColumn("_lane", F.pmod(F.xxhash64(*arrival(df)), F.lit(lanes)))
    survivors = _first_n(laned, [key, "_lane"], order, n, "_lane_rank").drop("_lane", "_lane_rank")
    return _first_n(survivors, [key], order, n, rank).withColumn(rank, F.col(rank).cast("long"))


def newest_arrivals(df: DataFrame, n: int, rank: str = "rank") -> DataFrame:
    return first_n_per_key(df, "sensor_id", [F.desc(c) for c in arrival(df)], n, rank)


def oldest_arrivals(df: DataFrame, n: int, rank: str = "rank") -> DataFrame:
    return first_n_per_key(df, "sensor_id", [F.asc(c) for c in arrival(df)], n, rank)


def with_block(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds ``_block``: rows of ``block`` successive message numbers. Blocks follow each other in arrival order."""
    return df.withColumn("_block", F.floor(F.col("seq") / F.lit(block)).cast("long"))


def number_rows(df: DataFrame, keys: list[str], name: str = "row_no", block: int = BLOCK) -> DataFrame:
    """Adds the 1-based position of every row within ``keys`` by arrival.

    Blocks are counted first (partial aggregation, one row per key and block), running totals of these counts give
    each block its offset, and rows are only ordered within their block. The totals run over groups of blocks
    before they run over the groups, so no task sees all blocks of a key.
    """
    group = [*keys, "_block"]
    blocked = with_block(df, block)
    counts = blocked.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_super", F.floor(F.col("_block") / F.lit(4096)))
    earlier = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_super").orderBy("_block").rowsBetween(*earlier)
    over = Window.partitionBy(*keys).orderBy("_super").rowsBetween(*earlier)
    supers = counts.groupBy(*keys, "_super").agg(F.sum("_n").alias("_total")).select(
        *keys, "_super", F.coalesce(F.sum("_total").over(over), F.lit(0)).alias("_start"))
    offsets = counts.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(
        supers, [*keys, "_super"]).select(*group, (F.col("_start") + F.col("_inside")).alias("_offset"))
    in_block = F.row_number().over(Window.partitionBy(*group).orderBy(*arrival(df)))
    return (
        blocked.withColumn("_in_block", in_block)
        .join(offsets, group)
        .withColumn(name, F.col("_offset") + F.col("_in_block"))
        .drop("_block", "_in_block", "_offset")
    )
