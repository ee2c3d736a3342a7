"""Replay of interleaved pushes and pops against bounded per-sensor buffers.

The size of a buffer after an event is ``clamp(size + amount, 0, capacity)``: +1 for a push, -n for a pop of n.
Such clamps compose into clamps ``x -> min(max(x + shift, low), high)``, so a long log is cut into blocks of
``seq``, each block is reduced to one clamp, and only these are carried from block to block. A hot sensor
is spread over its blocks; no task ever needs the whole log of one sensor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BUFFER_CAPACITY
from .ranking import BLOCK, newest_arrivals, with_block

Clamp = tuple[np.ndarray, np.ndarray, np.ndarray]


def _then(first: Clamp, second: Clamp) -> Clamp:
    shift, low, high = second
    return (first[0] + shift,
            np.minimum(np.maximum(first[1] + shift, low), high),
            np.minimum(np.maximum(first[2] + shift, low), high))


def _running_clamps(keys: list[str], capacity: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Within sorted runs of equal ``keys``: the clamp of everything before each row and up to it."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carried_key, carried = None, None
        for frame in frames:
            n = len(frame)
            if n == 0:
                continue
            index = np.arange(n)
            new_run = np.ones(n, dtype=bool)
            new_run[1:] = np.logical_or.reduce(
                [frame[k].to_numpy()[1:] != frame[k].to_numpy()[:-1] for k in keys])
            run_start = np.maximum.accumulate(np.where(new_run, index, 0))
            clamps = tuple(frame[c].to_numpy(dtype=np.int64).copy() for c in ("shift", "low", "high"))
            step, longest = 1, int((index - run_start).max()) + 1
            while step < longest:
                right = np.flatnonzero(index - step >= run_start)
                joined = _then(tuple(c[right - step] for c in clamps), tuple(c[right] for c in clamps))
                for column, values in zip(clamps, joined):
                    column[right] = values
                step *= 2
            first_key = tuple(frame[k].iat[0] for k in keys)
            continues = carried_key == first_key
            if continues:
                head = run_start == 0
                joined = _then(carried, tuple(c[head] for c in clamps))
                for column, values in zip(clamps, joined):
                    column[head] = values
            out = frame.copy()
            for name, column, neutral, at in zip(("shift", "low", "high"), clamps, (0, 0, capacity), range(3)):
                earlier = np.full(n, neutral, dtype=np.int64)
                inner = np.flatnonzero(~new_run)
                earlier[inner] = column[inner - 1]
                if continues:
                    earlier[0] = carried[at]
                out[f"{name}_before"] = earlier
                out[name] = column
            carried_key = tuple(frame[k].iat[n - 1] for k in keys)
            carried = tuple(c[n - 1] for c in clamps)
            yield out

    return scan


def _scan(df: DataFrame, keys: list[str], order: str, capacity: int) -> DataFrame:
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return (
        df.repartition(*keys).sortWithinPartitions(*keys, order)
        .mapInPandas(_running_clamps(keys, capacity),
                     f"{fields}, shift_before long, low_before long, high_before long")
    )


def _apply(size: Column, suffix: str = "") -> Column:
    return F.least(F.greatest(size + F.col(f"shift{suffix}"), F.col(f"low{suffix}")), F.col(f"high{suffix}"))


def replay_buffer(
    log: DataFrame, capacity: int = BUFFER_CAPACITY, drop_oldest: bool = True, block: int = BLOCK
) -> DataFrame:
    """``log``: sensor_id, seq, pop_count (NULL for a push). Per event: what happened and the size after it."""
    is_push = F.col("pop_count").isNull()
    clamps = with_block(log.select("sensor_id", "seq", F.col("pop_count").cast("long").alias("pop_count")), block).select(
        "*",
        F.when(is_push, F.lit(1)).otherwise(-F.col("pop_count")).cast("long").alias("shift"),
        F.lit(0).cast("long").alias("low"),
        F.lit(capacity).cast("long").alias("high"),
    )
    in_block = _scan(clamps, ["sensor_id", "_block"], "seq", capacity)
    blocks = in_block.groupBy("sensor_id", "_block").agg(
        *[F.max_by(c, "seq").alias(c) for c in ("shift", "low", "high")])
    starts = _scan(blocks, ["sensor_id"], "_block", capacity).select(
        "sensor_id", "_block", _apply(F.lit(0), "_before").alias("_start"))
    sized = in_block.join(starts, ["sensor_id", "_block"]).select(
        "sensor_id", "seq", is_push.alias("is_push"),
        _apply(F.col("_start"), "_before").alias("size_before"), _apply(F.col("_start")).alias("size_after"))
    full = F.col("is_push") & (F.col("size_before") >= capacity)
    return sized.select(
        "sensor_id", "seq", "is_push", "size_before", "size_after",
        (F.col("is_push") & (F.lit(drop_oldest) | ~full)).alias("accepted"),
        full.alias("dropped_one"),
        F.when(F.col("is_push"), F.lit(0)).otherwise(F.col("size_before") - F.col("size_after"))
        .cast("long").alias("popped"),
    )


def replay_stats(replayed: DataFrame) -> DataFrame:
    return replayed.groupBy("sensor_id").agg(
        F.count_if("accepted").alias("total_pushed"),
        F.count_if("dropped_one").alias("total_dropped"),
        F.sum("popped").alias("total_popped"),
        F.max("size_after").alias("high_water_mark"),
        F.max_by("size_after", "seq").alias("size"),
    )


def replay_contents(replayed: DataFrame, capacity: int = BUFFER_CAPACITY) -> DataFrame:
    """Rows left in each buffer: pops take from the front, so these are the newest accepted pushes."""
    sizes = replay_stats(replayed).select("sensor_id", "size")
    newest = newest_arrivals(replayed.filter("accepted").select("sensor_id", "seq"), capacity, "_rank")
    return newest.join(sizes, "sensor_id").filter(F.col("_rank") <= F.col("size")).select("sensor_id", "seq")
