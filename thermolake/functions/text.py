"""One-line text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .times import rfc3339


def one_decimal(value: Column | str) -> Column:
    """Text with one decimal, rounded from the exact binary value, ties to even.

    Spark's own ``%.1f`` rounds the shortest decimal text half up, which gives 0.3 for 0.25 and 0.2 for 0.15.
    Twenty times the value is held exactly as the sum of two doubles, and compared with the odd integer that
    marks the tie.
    """
    value = F.col(value) if isinstance(value, str) else value
    x16, x4 = F.abs(value) * 16.0, F.abs(value) * 4.0
    total = x16 + x4
    lost = x4 - (total - x16)
    below = F.floor(total / 2.0)
    tie = below.cast("double") * 2.0 + 1.0
    up = (total > tie) | ((total == tie) & ((lost > 0) | ((lost == 0) & (below % 2 == 1))))
    tenths = below + F.when(up, 1).otherwise(0)
    sign = F.when(value.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def describe_reading() -> Column:
    return F.concat(
        F.lit("SensorID: "), F.col("sensor_id"), F.lit(", Timestamp: "), rfc3339("recorded_at"),
        F.lit(", Humidity: "), one_decimal("humidity"), F.lit("%, Temperature: "), one_decimal("temperature"),
        F.lit("°C"),
    )


def buffer_summary(size: Column, capacity: int, dropped: Column, drop_oldest: bool) -> Column:
    mode = "drop-oldest" if drop_oldest else "drop-newest"
    return F.concat(
        F.lit("Buffer["), size.cast("string"), F.lit(f"/{capacity}, dropped: "),
        dropped.cast("string"), F.lit(f", mode: {mode}]"),
    )
