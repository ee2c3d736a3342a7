"""The query surface: what a dashboard asks for, as DataFrames. ``as_of`` replaces the wall clock."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quality import valid_filter
from ..functions.times import (
    as_instant,
    end_of_given_day,
    instant_literal,
    parse_date_argument,
    parse_rfc3339_argument,
)
from ..operators import aggregates, inventory, latest, scans, views
from ..operators.ranking import arrival
from ..schema import (
    DAILY_WINDOW_DAYS,
    DEFAULT_BOUNDS,
    HISTORY_WINDOW_HOURS,
    LATEST_COUNT,
    LATEST_SENSOR,
    READING_COLUMNS,
    RECENT_CAPACITY,
    ValidityBounds,
)
from ..sources.history import HistoryTable
from ..sources.summaries import DaySummaries

When = datetime | str | None


@dataclass(frozen=True)
class HistoryPage:
    """Readings of one page with what the request asked for."""

    readings: DataFrame
    limit: int
    source: str
    window_start: datetime | None = None
    window_end: datetime | None = None
    one_more: Callable[[], DataFrame] | None = None

    def metadata(self) -> DataFrame:
        """One row: count, has_more (the page is full), the echoed window and the source."""
        counted = self.readings.agg(F.count(F.lit(1)).alias("count"))
        full = F.col("count") >= self.limit if self.source == "database" else F.lit(False)
        return counted.select(
            "count", full.alias("has_more"),
            _echo(self.window_start).alias("window_start"), _echo(self.window_end).alias("window_end"),
            F.lit(self.source).alias("source"))

    def with_metadata(self) -> DataFrame:
        """The page's rows, each with the metadata beside it (a page is at most the request limit long)."""
        page = Window.partitionBy()
        counted = self.readings.withColumn("count", F.count(F.lit(1)).over(page))
        full = F.col("count") >= self.limit if self.source == "database" else F.lit(False)
        return counted.withColumns({
            "has_more": full, "window_start": _echo(self.window_start), "window_end": _echo(self.window_end),
            "source": F.lit(self.source)})

    def has_more_exactly(self) -> DataFrame:
        """One row: whether a further reading exists, found by asking for one more than the limit."""
        probe = self.one_more() if self.one_more is not None else self.readings
        return probe.agg((F.count(F.lit(1)) > self.limit).alias("has_more"))


def _echo(value: datetime | None) -> Column:
    return F.lit(None).cast("timestamp") if value is None else instant_literal(value)


def _instant(value: When) -> datetime:
    return parse_rfc3339_argument(value) if isinstance(value, str) else as_instant(value)


class TelemetryApi:
    """Queries over a readings history; the recent view is derived from it unless one is given.

    ``readings`` are raw rows in any order with ``seq`` as arrival order, or the history table itself: then pages and
    daily statistics read only the days they need, and the statistics give the table's size. ``recent`` is a
    materialised recent view, for example the one the streaming job keeps. ``sensors`` lists the known sensor ids, so
    that a request without one reads that list instead of the history. With ``summaries`` totals, sensor ids and the
    default sensor come from the days' summaries, and no reading is read for them.
    """

    def __init__(
        self,
        readings: DataFrame | HistoryTable,
        as_of: datetime | str,
        recent: DataFrame | None = None,
        capacity: int = RECENT_CAPACITY,
        bounds: ValidityBounds = DEFAULT_BOUNDS,
        table: HistoryTable | None = None,
        sensors: DataFrame | None = None,
        summaries: DaySummaries | None = None,
    ):
        self.summaries = summaries
        self.table = readings if isinstance(readings, HistoryTable) else table
        self.known_sensors = sensors
        self.pages_of = readings
        self.readings = readings.read() if isinstance(readings, HistoryTable) else readings
        self.as_of = as_instant(as_of)
        self.recent = recent
        self.capacity = capacity
        self.bounds = bounds

    def _accepted(self) -> DataFrame:
        source = self.recent if self.recent is not None else self.readings
        return source.filter(valid_filter(self.bounds))

    def default_sensor(self) -> DataFrame:
        """One row: the sensor meant when a request names none."""
        if self.known_sensors is not None:
            return inventory.default_sensor(self.known_sensors)
        if self.summaries is not None:
            known = self.summaries.table.read()
            return inventory.default_sensor(*([] if self.recent is None else [self.recent]), known)
        return inventory.default_sensor(*([] if self.recent is None else [self.recent]), self.readings)

    def _of(self, df: DataFrame, sensor_id: str | None) -> DataFrame:
        if sensor_id:
            return scans.for_sensor(df, sensor_id)
        return df.filter(F.col("sensor_id") == self.default_sensor().scalar())

    def _named(self, sensor_id: str | None) -> str | None:
        """The sensor asked for; on a table the default one is looked up, as days are chosen by what it has there."""
        if sensor_id or isinstance(self.pages_of, DataFrame):
            return sensor_id
        found = self.default_sensor().first()
        return found[0] if found else None

    def current(self, sensor_id: str | None = None) -> DataFrame:
        """Current reading of one sensor from the recent view, else its latest in the history. With a view, the
        history is read only if the view lacks the sensor, and of a table only the days back to its latest reading."""
        if self.recent is None:
            return self._current(self._of(self.readings, sensor_id), None)
        shown = latest.current_per_sensor(self._of(self.recent, sensor_id), self.bounds)
        order = arrival(shown)
        if shown.limit(1).count():
            return shown.select(*order, *READING_COLUMNS, F.lit("memory").alias("source"))
        asked = sensor_id or self.default_sensor().first()[0]
        last = scans.latest_reading(self.pages_of, asked or "")
        return last.select(*order, *READING_COLUMNS, F.lit("database").alias("source"))

    def current_all(self) -> DataFrame:
        """The same for every sensor, in one pass."""
        return self._current(self.readings, self.recent)

    def _current(self, rows: DataFrame, recent: DataFrame | None) -> DataFrame:
        if recent is None:
            return latest.current_with_fallback(rows, self.bounds)
        current = latest.current_per_sensor(recent, self.bounds)
        # the history answers only for sensors that the view lacks
        lacking = rows.join(current.select("sensor_id"), "sensor_id", "left_anti")
        return latest.current_or_latest(current, latest.latest_per_sensor(lacking))

    def history(
        self,
        sensor_id: str | None = None,
        start: When = None,
        end: When = None,
        before: When = None,
        after: When = None,
        limit: int | str | None = None,
    ) -> HistoryPage:
        """One page. ``before`` wins over ``after``, which wins over a range; none of them reads the recent
        view. A range without start begins six hours before ``as_of``, without end it ends there."""
        n = scans.clamp_limit(limit)
        if before or after or start or end:
            sensor_id = self._named(sensor_id)
            rows = self.pages_of if isinstance(self.pages_of, HistoryTable) else self._of(self.readings, sensor_id)
            sensor_id = sensor_id if isinstance(self.pages_of, HistoryTable) else None
        if before:
            cut = _instant(before)
            ask = lambda k: scans.readings_before(rows, cut, k, sensor_id)
            return HistoryPage(ask(n), n, "database", window_end=cut, one_more=lambda: ask(n + 1))
        if after:
            cut = _instant(after)
            ask = lambda k: scans.readings_after(rows, cut, k, sensor_id)
            return HistoryPage(ask(n), n, "database", window_start=cut, one_more=lambda: ask(n + 1))
        if start or end:
            first = _instant(start) if start else self.as_of - timedelta(hours=HISTORY_WINDOW_HOURS)
            last = _instant(end) if end else self.as_of
            ask = lambda k: scans.readings_in_range(rows, first, last, k, sensor_id)
            return HistoryPage(ask(n), n, "database", first, last, one_more=lambda: ask(n + 1))
        recent = self._of(self._accepted(), sensor_id)
        order = arrival(recent)
        newest = recent.select(*order, *READING_COLUMNS).orderBy(*[F.desc(c) for c in order]).limit(
            min(n, self.capacity))
        return HistoryPage(newest, n, "memory")

    def stats(self) -> DataFrame:
        """One row: recent-view totals at the top level, the history's under ``database_`` names, with
        ``database_size_mb`` where the history table is known."""
        size = [] if self.table is None else [self.table.size_mb()]
        if self.summaries is not None:
            stored = self.summaries.storage_stats()
            return aggregates.one_row(
                self.summaries.recent_totals(self.capacity),
                stored.select(*[F.col(c).alias(f"database_{c}") for c in stored.columns]),
                views.held_bounds(self._view()), *size)
        return aggregates.one_row(
            aggregates.fleet_totals(self.readings, self.capacity, self.bounds), views.held_bounds(self._view()), *size)

    def _view(self) -> DataFrame:
        if self.recent is not None:
            return self.recent
        return views.recent_view(self.readings, self.capacity, self.bounds)

    def daily_stats(self, sensor_id: str | None = None, start: When = None, end: When = None) -> DataFrame:
        """Of all sensors when none is named. Default window: from midnight seven days ago. A given end is
        moved by a day minus a second."""
        if start:
            first = parse_date_argument(start) if isinstance(start, str) else as_instant(start)
        else:
            first = (self.as_of - timedelta(days=DAILY_WINDOW_DAYS)).replace(hour=0, minute=0, second=0)
        if end:
            last = end_of_given_day(parse_date_argument(end) if isinstance(end, str) else as_instant(end))
        else:
            last = self.as_of
        rows = self.readings
        if isinstance(self.pages_of, HistoryTable):
            rows = self.pages_of.read_days(
                [d for d in self.pages_of.days() if first.date() <= d <= last.date()])
        return aggregates.daily_stats(rows, first, last, sensor_id)

    def sensors(self) -> DataFrame:
        """Ids known to the recent view or the history, sorted. Their number is the row count."""
        known = self.readings if self.summaries is None else self.summaries.table.read()
        if self.recent is None:
            return aggregates.sensor_ids(known)
        return inventory.sensors_union(self.recent, known)

    def dashboard(self, sensor_id: str | None = None) -> DataFrame:
        """One row: the current reading of the asked (else the smallest) sensor from the recent view without
        fallback, the totals since the beginning, the bounds of what the view holds, ``last_update`` and
        ``has_history``. The list of ids, which grows with the fleet, is ``dashboard_sensor_ids``."""
        view = self._view()
        shown = F.col("sensor_id") == sensor_id if sensor_id else F.lit(True)
        wanted = F.when(shown, F.col("sensor_id"))
        newest = latest.current_per_sensor(view, self.bounds)
        current = newest.agg(
            F.min(wanted).alias("current_sensor_id"),
            *[F.min_by(c, wanted).alias(f"current_{c}") for c in READING_COLUMNS if c != "sensor_id"],
            instant_literal(self.as_of).alias("last_update"),
            F.lit(True).alias("has_history"),
        )
        return aggregates.one_row(
            current, aggregates.recent_totals(self.readings, self.capacity, self.bounds), views.held_bounds(view))

    def dashboard_sensor_ids(self) -> DataFrame:
        return self._accepted().select("sensor_id").distinct().orderBy("sensor_id")

    def latest_readings(self, sensor_id: str | None = None) -> DataFrame:
        """The newest ten of one sensor from the recent view."""
        return views.recent_of_sensor(
            self._accepted(), sensor_id or LATEST_SENSOR, LATEST_COUNT, self.capacity, self.bounds)

    def recent_stats(self) -> DataFrame:
        return aggregates.one_row(
            aggregates.recent_totals(self.readings, self.capacity, self.bounds), views.held_bounds(self._view()))
