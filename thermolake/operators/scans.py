"""Filters, range scans and scrolling over a readings DataFrame or a table with a folder per day."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import as_instant, instant_literal
from ..schema import HISTORY_LIMIT, HISTORY_LIMIT_MAX, READING_COLUMNS
from .ranking import arrival

Instant = datetime | str

# larger pages are cut out by counts; smaller ones meet in one task
PAGE_OF_ONE_TASK = 10_000
CUT_PIECES = 4096


def _newest_first(df: DataFrame) -> list[Column]:
    return [F.desc(c) for c in ("recorded_at", *arrival(df))]


def _oldest_first(df: DataFrame) -> list[Column]:
    return [F.asc(c) for c in ("recorded_at", *arrival(df))]


def clamp_limit(limit: int | str | None) -> int:
    """Request limit to the one served: absent, unreadable or non-positive gives the default; large is capped."""
    try:
        wanted = int(limit)
    except (TypeError, ValueError):
        return HISTORY_LIMIT
    return min(wanted, HISTORY_LIMIT_MAX) if wanted > 0 else HISTORY_LIMIT


def for_sensor(df: DataFrame, sensor_id: str | None) -> DataFrame:
    """``None`` and ``''`` mean all sensors."""
    return df.filter(F.col("sensor_id") == sensor_id) if sensor_id else df


def _on_days(df: DataFrame, first: Instant | None, last: Instant | None) -> DataFrame:
    """Day predicate that prunes partitions; Catalyst does not derive it from ``recorded_at``."""
    if "recorded_date" in df.columns:
        if first is not None:
            df = df.filter(F.col("recorded_date") >= F.lit(as_instant(first).date()))
        if last is not None:
            df = df.filter(F.col("recorded_date") <= F.lit(as_instant(last).date()))
    return df


def between(df: DataFrame, start: Instant | None, end: Instant | None) -> DataFrame:
    """Closed range on ``recorded_at``; an absent bound leaves that side open."""
    rows = _on_days(df, start, end)
    if start is not None:
        rows = rows.filter(F.col("recorded_at") >= instant_literal(start))
    if end is not None:
        rows = rows.filter(F.col("recorded_at") <= instant_literal(end))
    return rows


def before(df: DataFrame, instant: Instant) -> DataFrame:
    return _on_days(df, None, instant).filter(F.col("recorded_at") < instant_literal(instant))


def after(df: DataFrame, instant: Instant) -> DataFrame:
    return _on_days(df, instant, None).filter(F.col("recorded_at") > instant_literal(instant))


def _place(rows: DataFrame, limit: int, newest: bool) -> tuple[dict[str, int | None], int, int] | None:
    """Of the ``limit``-th row in order: the values of its time and arrival, how many rows share them, and how many of
    these are within the limit. None if there are fewer rows.

    Column after column the range of its values is narrowed by counts of at most ``CUT_PIECES`` parts, so that only
    counts reach the driver. A missing value is the smallest.
    """
    place, found, wanted, n = {}, rows, limit, 0
    for name in ("recorded_at", *arrival(rows)):
        value = F.unix_micros(name) if name == "recorded_at" else F.col(name).cast("long")
        low, high, n, known = found.agg(F.min(value), F.max(value), F.count("*"), F.count(value)).first()
        if wanted > n:
            return None
        missing = wanted > known if newest else wanted <= n - known
        if missing == newest:  # the other group comes first and is within the limit
            wanted -= known if newest else n - known
        n = n - known if missing else known
        found = found.filter(F.col(name).isNull() if missing else F.col(name).isNotNull())
        while not missing and low < high:
            width = -(-(high - low + 1) // CUT_PIECES)
            counts = found.groupBy((value - F.pmod(value - low, F.lit(width))).alias("low")).count().collect()
            for part in sorted(counts, reverse=newest):
                n = part["count"]
                if wanted <= n:
                    break
                wanted -= n
            low, high = part.low, min(part.low + width - 1, high)
            found = found.filter(F.col(name).between(_value(name, low), _value(name, high)))
        place[name] = None if missing else low
    return place, n, wanted


def _value(name: str, number: int | None) -> Column:
    return F.timestamp_micros(F.lit(number)) if name == "recorded_at" else F.lit(number)


def _page(df: DataFrame, limit: int, newest: bool = True) -> DataFrame:
    """The first ``limit`` rows, newest or oldest first."""
    rows = df.select(*arrival(df), *READING_COLUMNS)
    order = _newest_first(rows) if newest else _oldest_first(rows)
    if limit <= PAGE_OF_ONE_TASK:
        return rows.orderBy(*order).limit(limit)
    cut = _place(rows, limit, newest)
    if cut is None:
        return rows.orderBy(*order)
    place, n, wanted = cut
    names, types = list(place), dict(rows.dtypes)
    key = F.struct(*names)
    last = F.struct(*[_value(c, place[c]).cast(types[c]).alias(c) for c in names])
    if place["recorded_at"] is not None:  # what files can be skipped by
        at = _value("recorded_at", place["recorded_at"])
        near = F.col("recorded_at") >= at if newest else F.coalesce(F.col("recorded_at") <= at, F.lit(True))
        rows = rows.filter(near)
    if n == wanted:
        return rows.filter(key >= last if newest else key <= last).orderBy(*order)
    # rows that repeat an arrival: any of them fill the page
    before_last = rows.filter(key > last if newest else key < last)
    return before_last.unionByName(rows.filter(key.eqNullSafe(last)).limit(wanted)).orderBy(*order)


class DayTable(Protocol):
    """A table with a folder per day, of which any days can be read alone."""

    def days(self) -> list[date]: ...

    def read_days(self, days: list[date]) -> DataFrame: ...


Readings = DataFrame | DayTable


def _nearest(
    table: Readings, first: Instant | None, last: Instant | None, limit: int, newest: bool,
    chosen: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """The ``chosen`` rows of a frame. Of a table: those of the days nearest to the cut that hold ``limit`` of them.

    The span widens fourfold over the days that have a folder, until the page is full or no day is left. A step counts
    only the days it adds, at most to ``limit`` if that is small, and no other day is read or listed.
    """
    if isinstance(table, DataFrame):
        return chosen(table)
    days = [d for d in table.days() if (first is None or d >= as_instant(first).date())
            and (last is None or d <= as_instant(last).date())]
    if newest:
        days.reverse()
    seen, span, found = 0, 1, 0
    while span < len(days):
        added = chosen(table.read_days(sorted(days[seen:span])))
        found += (added.limit(limit - found) if limit <= PAGE_OF_ONE_TASK else added).count()
        if found >= limit:
            break
        seen, span = span, span * 4
    return chosen(table.read_days(sorted(days[:span])))


def readings_in_range(
    df: Readings, start: Instant, end: Instant, limit: int, sensor_id: str | None = None
) -> DataFrame:
    """Newest ``limit`` readings of the closed range, newest first."""
    rows = _nearest(df, start, end, limit, True, lambda found: between(for_sensor(found, sensor_id), start, end))
    return _page(rows, limit)


def readings_before(df: Readings, instant: Instant, limit: int, sensor_id: str | None = None) -> DataFrame:
    """Newest ``limit`` readings strictly before the instant, newest first."""
    rows = _nearest(df, None, instant, limit, True, lambda found: before(for_sensor(found, sensor_id), instant))
    return _page(rows, limit)


def readings_after(df: Readings, instant: Instant, limit: int, sensor_id: str | None = None) -> DataFrame:
    """The ``limit`` readings closest after the instant, returned newest first."""
    rows = _nearest(df, instant, None, limit, False, lambda found: after(for_sensor(found, sensor_id), instant))
    return _page(rows, limit, newest=False).orderBy(*_newest_first(rows))


@dataclass(frozen=True)
class Cursor:
    """An exact place in the order newest first. Numbers only, so no time zone can move it."""

    epoch_seconds: int
    arrival: tuple[int, ...]


def cursor_after(page: DataFrame) -> Cursor | None:
    """The place of the last row of a page; None for an empty one."""
    order = arrival(page)
    last = page.agg(F.min(F.struct(F.unix_seconds("recorded_at").alias("at"), *order)).alias("last")).first().last
    return None if last is None else Cursor(last.at, tuple(last[c] for c in order))


def readings_before_cursor(df: Readings, cursor: Cursor, limit: int, sensor_id: str | None = None) -> DataFrame:
    """Scroll back from an exact row, so that rows sharing its second are not skipped."""
    cut = F.timestamp_seconds(F.lit(cursor.epoch_seconds))
    day = datetime(1970, 1, 1) + timedelta(seconds=cursor.epoch_seconds)

    def older(found: DataFrame) -> DataFrame:
        later = F.lit(False)
        for name, value in reversed(list(zip(arrival(found), cursor.arrival, strict=True))):
            later = (F.col(name) < value) | ((F.col(name) == value) & later)
        return _on_days(for_sensor(found, sensor_id), None, day).filter(
            (F.col("recorded_at") <= cut) & ((F.col("recorded_at") < cut) | later))

    rows = _nearest(df, None, day, limit, True, older)
    return _page(rows, limit)


def latest_reading(df: Readings, sensor_id: str) -> DataFrame:
    """Reading of the sensor with the greatest event time; no row for an unknown sensor."""
    rows = _nearest(df, None, None, 1, True, lambda found: found.filter(F.col("sensor_id") == sensor_id))
    return _page(rows, 1)
