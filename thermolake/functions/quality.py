"""Reading validity and the first check that fails."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CLOCK_TOLERANCE_SECONDS, DEFAULT_BOUNDS, ValidityBounds
from .times import zero_time


def _checks(bounds: ValidityBounds) -> list[tuple[str, Column]]:
    """(reason, passes) in the order in which the checks run."""
    return [
        ("empty_sensor", F.col("sensor_id") != ""),
        ("missing_timestamp", F.col("recorded_at") != zero_time()),
        ("temperature", F.col("temperature").between(bounds.min_temperature, bounds.max_temperature)),
        ("humidity", F.col("humidity").between(bounds.min_humidity, bounds.max_humidity)),
    ]


def valid_filter(bounds: ValidityBounds = DEFAULT_BOUNDS) -> Column:
    """Every check holds, as a plain conjunction for ``filter``, so that its parts can reach the scan. A NULL
    field makes it NULL, which a filter drops."""
    return reduce(Column.__and__, [passes for _, passes in _checks(bounds)])


def is_valid(bounds: ValidityBounds = DEFAULT_BOUNDS) -> Column:
    """True only where every check holds; a NULL in any field is invalid."""
    return F.coalesce(valid_filter(bounds), F.lit(False))


def reject_reason(bounds: ValidityBounds = DEFAULT_BOUNDS) -> Column:
    """Name of the first failed check, NULL for a valid reading."""
    return F.coalesce(*[
        F.when(~F.coalesce(passes, F.lit(False)), F.lit(reason)) for reason, passes in _checks(bounds)
    ])


def ahead_seconds() -> Column:
    """How far a reading is dated ahead of its arrival."""
    return F.unix_seconds("recorded_at") - F.unix_seconds("received_at")


def ahead_of_clock(tolerance_seconds: int = CLOCK_TOLERANCE_SECONDS) -> Column:
    """Whether a reading is dated further ahead of its arrival than a clock may be wrong."""
    return ahead_seconds() > tolerance_seconds
