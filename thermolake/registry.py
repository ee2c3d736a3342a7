"""Every query over the given tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.quality import reject_reason, valid_filter
from .functions.text import describe_reading
from .functions.times import as_instant, parse_instant, rfc3339
from .operators import aggregates, buffers, inventory, latest, liveness, packing, replay, scans, views
from .plans import retention
from .plans.api import TelemetryApi
from .schema import DAILY_WINDOW_DAYS, HISTORY_LIMIT, HISTORY_LIMIT_MAX, READING_COLUMNS
from .session import work_dir
from .sources import envelopes
from .sources.events import (
    control_log,
    heartbeat_times,
    load_heartbeats,
    load_readings,
    message_log,
    stream_readings,
)
from .sources.history import HistoryTable
from .streaming import ingest, live
from .streaming.recent import RecentViewTable
from .streaming.tables import LiveTable

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = "2024-01-31 00:00:00"
DEVICE = 7
SENSOR = "sensor-0007"
START, END = "2024-01-10 00:00:00", "2024-01-20 12:00:00"
CUT = "2024-01-15 12:00:00"
PAGE = 50
CAPACITY = 20
BUFFER = 50
REPLAY_CAPACITY, REPLAY_POP = 10, 5
KEEP_DAYS = 7
KEPT_FROM = as_instant(AS_OF) - timedelta(days=KEEP_DAYS)
SILENCE = 12 * 3600
GAP = 5 * 86400

# name -> (query, SQL or None)
_REGISTRY: dict[str, tuple[Query, str | None]] = {}


def _register(name: str, sql: str | None):
    def add(query: Query) -> Query:
        _REGISTRY[name] = (query, sql)
        return query

    return add


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _REGISTRY.items() if sql is not None}


def rfc3339_text(instant: str) -> str:
    return instant.replace(" ", "T") + "Z"


# the same readings in SQL
READINGS_SQL = """
WITH r AS (
  SELECT event_id AS seq,
         'sensor-' || lpad(CAST(user_id AS VARCHAR), greatest(4, CAST(length(CAST(user_id AS VARCHAR)) AS INTEGER)), '0')
           AS sensor_id,
         date_trunc('second', ts) AS recorded_at,
         value - 30 AS temperature,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) * CAST(1.25 AS DOUBLE) - 10 AS humidity,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS level,
         event_type
  FROM events
), v AS (
  SELECT * FROM r
  WHERE sensor_id <> '' AND temperature BETWEEN -20 AND 60 AND humidity BETWEEN 0 AND 100
)"""

_DAY = "strftime(recorded_at, '%Y-%m-%d')"
_DAILY_SQL = f"""SELECT {_DAY} AS date, sensor_id,
  min(temperature) AS min_temperature, max(temperature) AS max_temperature,
  round(avg(temperature), 6) AS avg_temperature,
  min(humidity) AS min_humidity, max(humidity) AS max_humidity, round(avg(humidity), 6) AS avg_humidity,
  count(*) AS reading_count"""
_READING = "sensor_id, recorded_at, humidity, temperature"


def _daily(df: DataFrame) -> DataFrame:
    return df.select(
        F.date_format("date", "yyyy-MM-dd").alias("date"), "sensor_id",
        "min_temperature", "max_temperature", F.round("avg_temperature", 6).alias("avg_temperature"),
        "min_humidity", "max_humidity", F.round("avg_humidity", 6).alias("avg_humidity"), "reading_count")


# ---- daily statistics -------------------------------------------------------


@_register("daily_stats_all", f"{READINGS_SQL} {_DAILY_SQL} FROM r GROUP BY 1, 2")
def daily_stats_all(spark, sf_dir):
    return _daily(aggregates.daily_stats(load_readings(spark, sf_dir)))


@_register("daily_stats", f"""{READINGS_SQL} {_DAILY_SQL} FROM r
  WHERE sensor_id = '{SENSOR}' AND recorded_at BETWEEN '{START}' AND '{END}' GROUP BY 1, 2""")
def daily_stats(spark, sf_dir):
    rows = load_readings(spark, sf_dir, DEVICE, START, END)
    return _daily(aggregates.daily_stats(rows, START, END, SENSOR))


@_register("daily_stats_default_window", f"""{READINGS_SQL} {_DAILY_SQL} FROM r
  WHERE recorded_at BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND TIMESTAMP '{AS_OF}' GROUP BY 1, 2""")
def daily_stats_default_window(spark, sf_dir):
    rows = load_readings(spark, sf_dir, start=as_instant(AS_OF) - timedelta(days=DAILY_WINDOW_DAYS), end=AS_OF)
    return _daily(TelemetryApi(rows, AS_OF).daily_stats())


@_register("daily_stats_given_dates", f"""{READINGS_SQL} {_DAILY_SQL} FROM r
  WHERE recorded_at BETWEEN '2024-01-10 00:00:00' AND '2024-01-12 23:59:59' GROUP BY 1, 2""")
def daily_stats_given_dates(spark, sf_dir):
    """Dates as a request gives them; the end means the whole of its day."""
    return _daily(TelemetryApi(load_readings(spark, sf_dir), AS_OF).daily_stats(start="2024-01-10", end="2024-01-12"))


@_register("daily_stats_from", f"{READINGS_SQL} {_DAILY_SQL} FROM r WHERE recorded_at >= '{CUT}' GROUP BY 1, 2")
def daily_stats_from(spark, sf_dir):
    return _daily(aggregates.daily_stats(load_readings(spark, sf_dir), start=CUT))


@_register("daily_stats_until", f"{READINGS_SQL} {_DAILY_SQL} FROM r WHERE recorded_at <= '{CUT}' GROUP BY 1, 2")
def daily_stats_until(spark, sf_dir):
    return _daily(aggregates.daily_stats(load_readings(spark, sf_dir), end=CUT))


@_register("daily_stats_valid_only", f"{READINGS_SQL} {_DAILY_SQL} FROM v GROUP BY 1, 2")
def daily_stats_valid_only(spark, sf_dir):
    return _daily(aggregates.daily_stats(load_readings(spark, sf_dir), valid_only=True))


# ---- validity ---------------------------------------------------------------


@_register("valid_readings", f"{READINGS_SQL} SELECT seq, {_READING} FROM v")
def valid_readings(spark, sf_dir):
    return load_readings(spark, sf_dir).filter(valid_filter()).select("seq", *READING_COLUMNS)


@_register("reject_reasons", f"""{READINGS_SQL}
  SELECT CASE WHEN sensor_id = '' THEN 'empty_sensor'
              WHEN temperature < -20 OR temperature > 60 THEN 'temperature'
              ELSE 'humidity' END AS reason, count(*) AS reading_count
  FROM r WHERE seq NOT IN (SELECT seq FROM v) GROUP BY 1""")
def reject_reasons(spark, sf_dir):
    return aggregates.reject_counts(load_readings(spark, sf_dir), reject_reason())


@_register("raw_vs_valid_counts", f"""{READINGS_SQL}
  SELECT sensor_id, count(*) AS raw_count,
         count(*) FILTER (WHERE temperature BETWEEN -20 AND 60 AND humidity BETWEEN 0 AND 100) AS valid_count
  FROM r GROUP BY 1""")
def raw_vs_valid_counts(spark, sf_dir):
    return aggregates.raw_vs_valid_counts(load_readings(spark, sf_dir))


@_register("describe_reading", f"""{READINGS_SQL}
  SELECT seq, printf('SensorID: %s, Timestamp: %s, Humidity: %.1f%%, Temperature: %.1f°C',
    sensor_id, strftime(recorded_at, '%Y-%m-%dT%H:%M:%SZ'), humidity, temperature) AS description
  FROM r""")
def describe_readings(spark, sf_dir):
    return load_readings(spark, sf_dir).select("seq", describe_reading().alias("description"))


# ---- scans ------------------------------------------------------------------


@_register("readings_in_range", f"""{READINGS_SQL} SELECT seq, {_READING} FROM r
  WHERE sensor_id = '{SENSOR}' AND recorded_at BETWEEN '{START}' AND '{END}'
  ORDER BY recorded_at DESC, seq DESC LIMIT {PAGE}""")
def readings_in_range(spark, sf_dir):
    rows = load_readings(spark, sf_dir, DEVICE, START, END)
    return scans.readings_in_range(rows, START, END, PAGE, SENSOR)


@_register("readings_in_range_all", f"""{READINGS_SQL} SELECT seq, {_READING} FROM r
  WHERE recorded_at BETWEEN '{START}' AND '{END}' ORDER BY recorded_at DESC, seq DESC LIMIT {PAGE}""")
def readings_in_range_all(spark, sf_dir):
    return scans.readings_in_range(load_readings(spark, sf_dir, None, START, END), START, END, PAGE)


@_register("readings_before", f"""{READINGS_SQL} SELECT seq, {_READING} FROM r
  WHERE sensor_id = '{SENSOR}' AND recorded_at < '{CUT}' ORDER BY recorded_at DESC, seq DESC LIMIT {PAGE}""")
def readings_before(spark, sf_dir):
    return scans.readings_before(load_readings(spark, sf_dir, DEVICE, end=CUT), CUT, PAGE, SENSOR)


@_register("readings_after", f"""{READINGS_SQL} SELECT seq, {_READING} FROM r
  WHERE sensor_id = '{SENSOR}' AND recorded_at > '{CUT}' ORDER BY recorded_at, seq LIMIT {PAGE}""")
def readings_after(spark, sf_dir):
    return scans.readings_after(load_readings(spark, sf_dir, DEVICE, start=CUT), CUT, PAGE, SENSOR)


@_register("readings_before_cursor", f"""{READINGS_SQL}, c AS (
    SELECT recorded_at AS t, max(seq) AS s FROM r WHERE recorded_at < '{CUT}' GROUP BY 1 ORDER BY 1 DESC LIMIT 1)
  SELECT seq, {_READING} FROM r, c WHERE recorded_at < t OR (recorded_at = t AND seq < s)
  ORDER BY recorded_at DESC, seq DESC LIMIT {PAGE}""")
def readings_before_cursor(spark, sf_dir):
    rows = load_readings(spark, sf_dir, end=CUT)
    cursor = scans.cursor_after(scans.readings_before(rows, CUT, 1))
    return scans.readings_before_cursor(rows, cursor, PAGE)


@_register("scroll_two_partitions", f"""{READINGS_SQL}
  SELECT seq // 2 AS seq, CAST(0 AS BIGINT) AS pos, CAST(seq % 2 AS INTEGER) AS part, sensor_id,
    date_trunc('hour', recorded_at) AS recorded_at, humidity, temperature FROM r""")
def scroll_two_partitions(spark, sf_dir):
    """Every reading once, page by page, from a table of two partitions whose numbers repeat and whose times tie."""
    rows = load_readings(spark, sf_dir).select(
        F.floor(F.col("seq") / 2).alias("seq"), F.lit(0).cast("long").alias("pos"),
        (F.col("seq") % 2).cast("int").alias("part"), "sensor_id",
        F.date_trunc("hour", "recorded_at").alias("recorded_at"), "temperature", "humidity")
    table = HistoryTable(spark, work_dir(spark, "scroll")).create()
    table.append(rows, "all")
    size = table.read().count() // 5 + 1
    pages = [scans.readings_before(table, "9999-01-01 00:00:00", size)]
    while (cursor := scans.cursor_after(pages[-1])) is not None:
        pages.append(scans.readings_before_cursor(table, cursor, size))
    every = pages[0]
    for page in pages[1:]:
        every = every.unionByName(page)
    return every


def _written(spark, sf_dir, label: str) -> HistoryTable:
    """The readings as a history table of two loads."""
    table = HistoryTable(spark, work_dir(spark, label)).create()
    rows = load_readings(spark, sf_dir)
    table.append(rows.filter("seq % 3 = 0"), "one")
    table.append(rows.filter("seq % 3 <> 0"), "two")
    return table


@_register("table_pages", f"""{READINGS_SQL}, p AS (
    (SELECT 'before' AS page, * FROM r WHERE sensor_id = '{SENSOR}' AND recorded_at < '{CUT}'
      ORDER BY recorded_at DESC, seq DESC LIMIT {PAGE})
    UNION ALL (SELECT 'after', * FROM r WHERE sensor_id = '{SENSOR}' AND recorded_at > '{CUT}'
      ORDER BY recorded_at, seq LIMIT {PAGE})
    UNION ALL (SELECT 'range', * FROM r WHERE recorded_at BETWEEN '{START}' AND '{END}'
      ORDER BY recorded_at DESC, seq DESC LIMIT {PAGE})
    UNION ALL (SELECT 'latest', * FROM r WHERE sensor_id = '{SENSOR}' ORDER BY recorded_at DESC, seq DESC LIMIT 1))
  SELECT page, seq, {_READING} FROM p""")
def table_pages(spark, sf_dir):
    """Scrolling, ranges and the latest reading on a written table: each reads its own days only."""
    table = _written(spark, sf_dir, "pages")
    api = TelemetryApi(table, AS_OF)
    pages = {
        "before": api.history(SENSOR, before=rfc3339_text(CUT), limit=PAGE).readings,
        "after": api.history(SENSOR, after=rfc3339_text(CUT), limit=PAGE).readings,
        "range": scans.readings_in_range(table, START, END, PAGE),
        "latest": scans.latest_reading(table, SENSOR),
    }
    named = [page.select(F.lit(name).alias("page"), "seq", *READING_COLUMNS) for name, page in pages.items()]
    return reduce(DataFrame.unionByName, named)


@_register("latest_reading", f"""{READINGS_SQL} SELECT seq, {_READING} FROM r
  WHERE sensor_id = '{SENSOR}' ORDER BY recorded_at DESC, seq DESC LIMIT 1""")
def latest_reading(spark, sf_dir):
    return scans.latest_reading(load_readings(spark, sf_dir, DEVICE), SENSOR)


_NEWEST = "QUALIFY row_number() OVER (PARTITION BY sensor_id ORDER BY {order}) <= {n}"


@_register("latest_per_sensor", f"""{READINGS_SQL} SELECT seq, {_READING} FROM r
  {_NEWEST.format(order='recorded_at DESC, seq DESC', n=1)}""")
def latest_per_sensor(spark, sf_dir):
    return latest.latest_per_sensor(load_readings(spark, sf_dir))


@_register("current_per_sensor", f"""{READINGS_SQL} SELECT seq, {_READING} FROM v
  {_NEWEST.format(order='seq DESC', n=1)}""")
def current_per_sensor(spark, sf_dir):
    return latest.current_per_sensor(load_readings(spark, sf_dir))


@_register("current_with_fallback", f"""{READINGS_SQL},
  c AS (SELECT * FROM v {_NEWEST.format(order='seq DESC', n=1)}),
  l AS (SELECT * FROM r {_NEWEST.format(order='recorded_at DESC, seq DESC', n=1)})
  SELECT coalesce(c.seq, l.seq) AS seq, sensor_id, coalesce(c.recorded_at, l.recorded_at) AS recorded_at,
    coalesce(c.humidity, l.humidity) AS humidity, coalesce(c.temperature, l.temperature) AS temperature,
    CASE WHEN c.seq IS NULL THEN 'database' ELSE 'memory' END AS source
  FROM c FULL JOIN l USING (sensor_id)""")
def current_with_fallback(spark, sf_dir):
    return TelemetryApi(load_readings(spark, sf_dir), AS_OF).current_all()


# a view that lost the sensors whose number divides by 3, and knows one more
_VIEW_SQL = f"""c AS (SELECT * FROM v WHERE CAST(right(sensor_id, 4) AS INTEGER) % 3 <> 0
    {_NEWEST.format(order='seq DESC', n=1)}),
  l AS (SELECT * FROM r {_NEWEST.format(order='recorded_at DESC, seq DESC', n=1)})"""


def _other_view(spark, sf_dir) -> DataFrame:
    rows = views.recent_view(load_readings(spark, sf_dir), CAPACITY).drop("arrival_rank")
    return rows.filter(F.right("sensor_id", F.lit(4)).cast("int") % 3 != 0)


@_register("current_from_view", f"""{READINGS_SQL}, {_VIEW_SQL}
  SELECT coalesce(c.seq, l.seq) AS seq, sensor_id, coalesce(c.recorded_at, l.recorded_at) AS recorded_at,
    coalesce(c.humidity, l.humidity) AS humidity, coalesce(c.temperature, l.temperature) AS temperature,
    CASE WHEN c.seq IS NULL THEN 'database' ELSE 'memory' END AS source
  FROM c FULL JOIN l USING (sensor_id)""")
def current_from_view(spark, sf_dir):
    """Both sides occur: sensors in the view, and sensors that only the history has."""
    return TelemetryApi(load_readings(spark, sf_dir), AS_OF, recent=_other_view(spark, sf_dir)).current_all()


# ---- recent view ------------------------------------------------------------


@_register("recent_n_per_sensor", f"""{READINGS_SQL} SELECT seq, {_READING} FROM v
  {_NEWEST.format(order='seq DESC', n=5)}""")
def recent_n_per_sensor(spark, sf_dir):
    return views.recent_n_per_sensor(load_readings(spark, sf_dir), 5, CAPACITY).drop("arrival_rank")


@_register("recent_view", f"""{READINGS_SQL}
  SELECT seq, {_READING}, row_number() OVER (PARTITION BY sensor_id ORDER BY seq DESC) AS arrival_rank FROM v
  {_NEWEST.format(order='seq DESC', n=CAPACITY)}""")
def recent_view(spark, sf_dir):
    return views.recent_view(load_readings(spark, sf_dir), CAPACITY)


@_register("recent_of_sensor", f"""{READINGS_SQL} SELECT seq, {_READING} FROM v
  WHERE sensor_id = '{SENSOR}' ORDER BY seq DESC LIMIT 10""")
def recent_of_sensor(spark, sf_dir):
    return TelemetryApi(load_readings(spark, sf_dir, DEVICE), AS_OF).latest_readings(SENSOR)


_RECENT_STATS_SQL = f"""held AS (SELECT * FROM v {_NEWEST.format(order='seq DESC', n=CAPACITY)}),
  recent AS (SELECT (SELECT count(*) FROM v) AS total_readings, count(DISTINCT sensor_id) AS unique_sensors,
    count(*) AS current_readings, min(recorded_at) AS oldest_reading, max(recorded_at) AS newest_reading FROM held)"""


@_register("recent_view_stats", f"{READINGS_SQL}, {_RECENT_STATS_SQL} SELECT * FROM recent")
def recent_view_stats(spark, sf_dir):
    return TelemetryApi(load_readings(spark, sf_dir), AS_OF, capacity=CAPACITY).recent_stats()


@_register("recent_sensor_ids", f"{READINGS_SQL} SELECT DISTINCT sensor_id FROM v")
def recent_sensor_ids(spark, sf_dir):
    return views.recent_sensor_ids(load_readings(spark, sf_dir))


# ---- pages, statistics, inventory -------------------------------------------


@_register("history_page", f"""{READINGS_SQL}, page AS (SELECT * FROM r
    WHERE sensor_id = '{SENSOR}' AND recorded_at < '{CUT}' ORDER BY recorded_at DESC, seq DESC LIMIT 10)
  SELECT seq, {_READING}, (SELECT count(*) FROM page) AS count, (SELECT count(*) FROM page) >= 10 AS has_more,
    CAST(NULL AS TIMESTAMP) AS window_start, TIMESTAMP '{CUT}' AS window_end, 'database' AS source FROM page""")
def history_page(spark, sf_dir):
    api = TelemetryApi(load_readings(spark, sf_dir, DEVICE, end=CUT), AS_OF)
    return api.history(SENSOR, before=CUT.replace(" ", "T") + "Z", limit=10).with_metadata()


@_register("history_default_window", f"""{READINGS_SQL}, page AS (SELECT * FROM r
    WHERE sensor_id = (SELECT min(sensor_id) FROM r) AND recorded_at BETWEEN '{START}' AND '{AS_OF}'
    ORDER BY recorded_at DESC, seq DESC LIMIT 50)
  SELECT count(*) AS count, count(*) >= 50 AS has_more, TIMESTAMP '{START}' AS window_start,
    TIMESTAMP '{AS_OF}' AS window_end, 'database' AS source FROM page""")
def history_default_window(spark, sf_dir):
    api = TelemetryApi(load_readings(spark, sf_dir), AS_OF)
    return api.history(start=START.replace(" ", "T") + "Z").metadata()


_STORAGE_SQL = """SELECT count(*) AS total_readings, min(recorded_at) AS oldest_reading,
  max(recorded_at) AS newest_reading, count(DISTINCT sensor_id) AS unique_sensors FROM r"""


@_register("storage_stats", f"{READINGS_SQL} {_STORAGE_SQL}")
def storage_stats(spark, sf_dir):
    return aggregates.storage_stats(load_readings(spark, sf_dir))


@_register("sensor_ids", f"{READINGS_SQL} SELECT DISTINCT sensor_id FROM r")
def sensor_ids(spark, sf_dir):
    return aggregates.sensor_ids(load_readings(spark, sf_dir))


@_register("sensors_union", f"{READINGS_SQL} SELECT sensor_id FROM v UNION SELECT sensor_id FROM r")
def sensors_union(spark, sf_dir):
    rows = load_readings(spark, sf_dir)
    return inventory.sensors_union(rows.filter(valid_filter()), rows)


@_register("sensors_of_either", f"""{READINGS_SQL}
  SELECT DISTINCT 'view-' || sensor_id AS sensor_id FROM v WHERE CAST(right(sensor_id, 4) AS INTEGER) % 3 <> 0
  UNION SELECT sensor_id FROM r""")
def sensors_of_either(spark, sf_dir):
    """A view with sensors that the history has never stored."""
    view = _other_view(spark, sf_dir).withColumn("sensor_id", F.concat(F.lit("view-"), "sensor_id"))
    return TelemetryApi(load_readings(spark, sf_dir), AS_OF, recent=view).sensors()


@_register("readings_with_sensor", f"""{READINGS_SQL}
  SELECT seq, sensor_id, CASE WHEN n % 2 = 0 THEN 'room ' || n END AS location,
    CASE WHEN n % 2 = 0 THEN 'DHT22' END AS sensor_type, CASE WHEN n % 2 = 0 THEN '1.0' END AS version
  FROM (SELECT *, CAST(right(sensor_id, 4) AS INTEGER) AS n FROM r)""")
def readings_with_sensor(spark, sf_dir):
    """Readings with the sensor dimension, which describes every second sensor."""
    rows = load_readings(spark, sf_dir)
    n = F.right("sensor_id", F.lit(4)).cast("int")
    sensors = inventory.first_seen(rows).filter(n % 2 == 0).select(
        "sensor_id", F.concat(F.lit("room "), n).alias("location"), F.lit("DHT22").alias("sensor_type"),
        F.lit("1.0").alias("version"), "start_time")
    return inventory.enrich(rows.select("seq", "sensor_id"), sensors)


@_register("default_sensor", f"{READINGS_SQL} SELECT min(sensor_id) AS sensor_id FROM r")
def default_sensor(spark, sf_dir):
    return TelemetryApi(load_readings(spark, sf_dir), AS_OF).default_sensor()


@_register("combined_stats", f"""{READINGS_SQL}, {_RECENT_STATS_SQL}, s AS ({_STORAGE_SQL})
  SELECT recent.*, s.total_readings AS database_total_readings, s.oldest_reading AS database_oldest_reading,
    s.newest_reading AS database_newest_reading, s.unique_sensors AS database_unique_sensors FROM recent, s""")
def combined_stats(spark, sf_dir):
    return TelemetryApi(load_readings(spark, sf_dir), AS_OF, capacity=CAPACITY).stats()


@_register("combined_stats_of_table", f"""{READINGS_SQL}, {_RECENT_STATS_SQL}, s AS ({_STORAGE_SQL})
  SELECT recent.*, s.total_readings AS database_total_readings, s.oldest_reading AS database_oldest_reading,
    s.newest_reading AS database_newest_reading, s.unique_sensors AS database_unique_sensors, true AS has_size
  FROM recent, s""")
def combined_stats_of_table(spark, sf_dir):
    """With a materialised view and a written table, whose size in megabytes SQL can't know."""
    table = _written(spark, sf_dir, "stats")
    view = views.recent_view(table.read(), CAPACITY).drop("arrival_rank")
    stats = TelemetryApi(table.read(), AS_OF, view, CAPACITY, table=table).stats()
    return stats.withColumn("has_size", F.col("database_size_mb") > 0).drop("database_size_mb")


@_register("dashboard_snapshot", f"""{READINGS_SQL}, {_RECENT_STATS_SQL},
  c AS (SELECT * FROM v WHERE sensor_id = (SELECT min(sensor_id) FROM v) ORDER BY seq DESC LIMIT 1)
  SELECT c.sensor_id AS current_sensor_id, c.recorded_at AS current_recorded_at, c.humidity AS current_humidity,
    c.temperature AS current_temperature, total_readings, unique_sensors, current_readings, oldest_reading,
    newest_reading, TIMESTAMP '{AS_OF}' AS last_update, true AS has_history FROM c, recent""")
def dashboard_snapshot(spark, sf_dir):
    return TelemetryApi(load_readings(spark, sf_dir), AS_OF, capacity=CAPACITY).dashboard()


@_register("dashboard_with_view", _REGISTRY["dashboard_snapshot"][1])
def dashboard_with_view(spark, sf_dir):
    """The same answer from a materialised view: its totals count all accepted readings, not those it holds."""
    rows = load_readings(spark, sf_dir)
    view = views.recent_view(rows, CAPACITY).drop("arrival_rank")
    return TelemetryApi(rows, AS_OF, view, CAPACITY).dashboard()


@_register("history_limits", f"""{READINGS_SQL}, asked(asked, served) AS (VALUES ('5000', {HISTORY_LIMIT_MAX}),
    ('1000', {HISTORY_LIMIT_MAX}), ('7', 7), ('0', {HISTORY_LIMIT}), ('-3', {HISTORY_LIMIT}), ('many', {HISTORY_LIMIT})),
  n AS (SELECT count(*) AS n FROM r WHERE recorded_at < '{CUT}' AND sensor_id = (SELECT min(sensor_id) FROM r))
  SELECT asked, least(n, served) AS count, n >= served AS has_more FROM asked, n""")
def history_limits(spark, sf_dir):
    """Limits as requests give them: too large, zero, negative and no number."""
    api = TelemetryApi(load_readings(spark, sf_dir), AS_OF)
    pages = [
        api.history(before=CUT.replace(" ", "T") + "Z", limit=asked).metadata().select(
            F.lit(asked).alias("asked"), "count", "has_more")
        for asked in ("5000", "1000", "7", "0", "-3", "many")]
    every = pages[0]
    for page in pages[1:]:
        every = every.unionByName(page)
    return every


@_register("parse_timestamps", f"""{READINGS_SQL}
  SELECT seq, CASE WHEN seq % 5 = 4 THEN NULL ELSE recorded_at END AS parsed FROM r""")
def parse_timestamps(spark, sf_dir):
    """Stored texts, with and without fractions, and RFC 3339 texts in two zones; every fifth text is no timestamp."""
    at = F.col("recorded_at")
    plain = F.date_format(at, "yyyy-MM-dd HH:mm:ss")
    east = F.concat(F.date_format(at + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    kind = F.col("seq") % 5
    text = F.when(kind == 0, plain).when(kind == 1, F.concat(plain, F.lit(".75"))).when(kind == 2, rfc3339(at)).when(
        kind == 3, east).otherwise(F.concat(F.lit("at "), plain))
    return load_readings(spark, sf_dir).select("seq", F.date_trunc("second", parse_instant(text)).alias("parsed"))


# ---- buffers ----------------------------------------------------------------

_PUSHED_SQL = """pushed AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY seq) AS nth,
    count(*) OVER (PARTITION BY sensor_id) AS n FROM r)"""


@_register("buffer_drop_oldest", f"""{READINGS_SQL}, {_PUSHED_SQL}
  SELECT seq, {_READING}, nth - greatest(n - {BUFFER}, 0) AS position FROM pushed WHERE nth > n - {BUFFER}""")
def buffer_drop_oldest(spark, sf_dir):
    return buffers.buffer_contents(load_readings(spark, sf_dir), BUFFER, True)


@_register("buffer_drop_newest", f"""{READINGS_SQL}, {_PUSHED_SQL}
  SELECT seq, {_READING}, nth AS position FROM pushed WHERE nth <= {BUFFER}""")
def buffer_drop_newest(spark, sf_dir):
    return buffers.buffer_contents(load_readings(spark, sf_dir), BUFFER, False)


def _buffer_stats_sql(mode: str, pushed: str, last_push: str) -> str:
    return f"""{READINGS_SQL}, {_PUSHED_SQL}
  SELECT sensor_id, {pushed} AS total_pushed, greatest(max(n) - {BUFFER}, 0) AS total_dropped,
    least(max(n), {BUFFER}) AS high_water_mark, {last_push} AS last_push_time,
    CASE WHEN max(n) > {BUFFER} THEN arg_max(recorded_at, seq) END AS last_drop_time,
    least(max(n), {BUFFER}) AS size, CAST({BUFFER} AS BIGINT) AS capacity,
    max(n) >= {BUFFER} AS is_full, false AS is_empty,
    'Buffer[' || least(max(n), {BUFFER}) || '/{BUFFER}, dropped: ' || greatest(max(n) - {BUFFER}, 0)
      || ', mode: {mode}]' AS summary
  FROM pushed GROUP BY sensor_id"""


@_register("buffer_stats", _buffer_stats_sql("drop-oldest", "max(n)", "arg_max(recorded_at, seq)"))
def buffer_stats(spark, sf_dir):
    return buffers.buffer_stats(load_readings(spark, sf_dir), BUFFER, True)


@_register("buffer_stats_drop_newest", _buffer_stats_sql(
    "drop-newest", f"least(max(n), {BUFFER})", f"arg_max(recorded_at, seq) FILTER (WHERE nth <= {BUFFER})"))
def buffer_stats_drop_newest(spark, sf_dir):
    return buffers.buffer_stats(load_readings(spark, sf_dir), BUFFER, False)


@_register("buffer_peek", f"""{READINGS_SQL}, {_PUSHED_SQL}
  SELECT seq, {_READING}, nth - greatest(n - {BUFFER}, 0) AS position FROM pushed
  WHERE nth > n - {BUFFER} AND nth - greatest(n - {BUFFER}, 0) <= 3""")
def buffer_peek(spark, sf_dir):
    return buffers.buffer_peek(load_readings(spark, sf_dir), 3, BUFFER)


@_register("buffer_pop", f"""{READINGS_SQL}, {_PUSHED_SQL}
  SELECT seq, {_READING}, nth - greatest(n - {BUFFER}, 0) AS position,
    nth - greatest(n - {BUFFER}, 0) <= 20 AS taken FROM pushed WHERE nth > n - {BUFFER}""")
def buffer_pop(spark, sf_dir):
    return buffers.buffer_pop(load_readings(spark, sf_dir), 20, BUFFER)


_REPLAY_SQL = f"""{READINGS_SQL.replace('WITH r', 'WITH RECURSIVE r', 1)}, log AS (
    SELECT sensor_id, seq, event_type <> 'signup' AS is_push,
      row_number() OVER (PARTITION BY sensor_id ORDER BY seq) AS nth FROM r),
  sized AS (
    SELECT sensor_id, seq, is_push, nth, CAST(0 AS BIGINT) AS size_before,
      CASE WHEN is_push THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS size_after FROM log WHERE nth = 1
    UNION ALL
    SELECT l.sensor_id, l.seq, l.is_push, l.nth, s.size_after,
      CASE WHEN l.is_push THEN least(s.size_after + 1, {REPLAY_CAPACITY})
           ELSE greatest(s.size_after - {REPLAY_POP}, 0) END
    FROM sized s JOIN log l ON l.sensor_id = s.sensor_id AND l.nth = s.nth + 1),
  replayed AS (
    SELECT sensor_id, seq, is_push, size_before, size_after,
      is_push AND {{accepted}} AS accepted, is_push AND size_before >= {REPLAY_CAPACITY} AS dropped_one,
      CASE WHEN is_push THEN 0 ELSE size_before - size_after END AS popped FROM sized)"""
_REPLAY_OLDEST_SQL = _REPLAY_SQL.format(accepted="true")
_REPLAY_NEWEST_SQL = _REPLAY_SQL.format(accepted=f"size_before < {REPLAY_CAPACITY}")


def _replayed(spark, sf_dir, drop_oldest: bool) -> DataFrame:
    rows = load_readings(spark, sf_dir)
    log = rows.select("sensor_id", "seq", F.when(F.col("event_type") == "signup", REPLAY_POP).alias("pop_count"))
    return replay.replay_buffer(log, REPLAY_CAPACITY, drop_oldest)


@_register("buffer_replay", f"{_REPLAY_OLDEST_SQL} SELECT * FROM replayed")
def buffer_replay(spark, sf_dir):
    return _replayed(spark, sf_dir, True)


@_register("buffer_replay_stats", f"""{_REPLAY_NEWEST_SQL}
  SELECT sensor_id, count(*) FILTER (WHERE accepted) AS total_pushed,
    count(*) FILTER (WHERE dropped_one) AS total_dropped, CAST(sum(popped) AS BIGINT) AS total_popped,
    max(size_after) AS high_water_mark, arg_max(size_after, seq) AS size FROM replayed GROUP BY 1""")
def buffer_replay_stats(spark, sf_dir):
    return replay.replay_stats(_replayed(spark, sf_dir, False))


@_register("buffer_replay_contents", f"""{_REPLAY_NEWEST_SQL},
  final AS (SELECT sensor_id, arg_max(size_after, seq) AS size FROM replayed GROUP BY 1),
  kept AS (SELECT sensor_id, seq, row_number() OVER (PARTITION BY sensor_id ORDER BY seq DESC) AS k
    FROM replayed WHERE accepted)
  SELECT sensor_id, seq FROM kept JOIN final USING (sensor_id) WHERE k <= size""")
def buffer_replay_contents(spark, sf_dir):
    return replay.replay_contents(_replayed(spark, sf_dir, False), REPLAY_CAPACITY)


# ---- messages ---------------------------------------------------------------


@_register("batch_pack", f"""{READINGS_SQL}, {_PUSHED_SQL}
  SELECT sensor_id, (nth - 1) // 50 AS batch_no, count(*) AS count, min(seq) AS first_seq, max(seq) AS last_seq,
    round(sum(temperature), 6) AS temperature_sum
  FROM pushed GROUP BY 1, 2""")
def batch_pack(spark, sf_dir):
    total = F.aggregate("readings", F.lit(0.0), lambda t, r: t + r["temperature"])
    return packing.pack_batches(load_readings(spark, sf_dir)).select(
        "sensor_id", "batch_no", "count", "first_seq", "last_seq", F.round(total, 6).alias("temperature_sum"))


@_register("encode_readings", f"""{READINGS_SQL}
  SELECT seq, 'reading' AS type, sensor_id, strftime(recorded_at, '%Y-%m-%dT%H:%M:%SZ') AS timestamp,
    humidity, temperature, strftime(recorded_at, '%Y-%m-%dT%H:%M:%SZ') AS sent_at
  FROM r WHERE event_type IN ('click', 'purchase')""")
def encode_readings(spark, sf_dir):
    rows = load_readings(spark, sf_dir).filter(F.col("event_type").isin("click", "purchase"))
    text = envelopes.encode_message("reading", envelopes.reading_payload(), F.col("recorded_at"))
    at = lambda path: F.get_json_object("value", path)
    return rows.select("seq", text.alias("value")).select(
        "seq", at("$.type").alias("type"), at("$.payload.sensor_id").alias("sensor_id"),
        at("$.payload.timestamp").alias("timestamp"),
        at("$.payload.humidity").cast("double").alias("humidity"),
        at("$.payload.temperature").cast("double").alias("temperature"),
        at("$.timestamp").alias("sent_at"))


_BATCHED_SQL = """b AS (
    SELECT *, (row_number() OVER (PARTITION BY sensor_id ORDER BY seq) - 1) // 50 AS chunk
    FROM r WHERE event_type = 'view')"""


@_register("envelope_routing", f"""{READINGS_SQL}, {_BATCHED_SQL},
  messages AS (
    SELECT CASE event_type WHEN 'signup' THEN 'heartbeat' WHEN 'error' THEN 'unknown' ELSE 'reading' END AS route
    FROM r WHERE event_type <> 'view'
    UNION ALL SELECT 'batch' FROM (SELECT DISTINCT sensor_id, chunk FROM b)
    UNION ALL SELECT 'unknown' FROM r WHERE event_type = 'error' AND level % 9 = 0
    UNION ALL SELECT 'unknown' FROM r WHERE event_type = 'error' AND level % 11 = 0)
  SELECT route, count(*) AS message_count,
    count(*) FILTER (WHERE route = 'unknown') AS quarantined_count FROM messages GROUP BY 1""")
def envelope_routing(spark, sf_dir):
    return envelopes.parse_envelopes(message_log(spark, sf_dir)).groupBy("route").agg(
        F.count(F.lit(1)).alias("message_count"), F.count("problem").alias("quarantined_count"))


@_register("batch_unpack", f"""{READINGS_SQL}, {_BATCHED_SQL}
  SELECT max(seq) OVER (PARTITION BY sensor_id, chunk) AS message_seq,
    row_number() OVER (PARTITION BY sensor_id, chunk ORDER BY seq) - 1 AS pos, {_READING}, true AS count_matches
  FROM b""")
def batch_unpack(spark, sf_dir):
    log = message_log(spark, sf_dir)
    messages = envelopes.parse_envelopes(log).filter(F.col("route") == "batch")
    return envelopes.decode_readings(messages).select(
        F.col("seq").alias("message_seq"), "pos", *READING_COLUMNS, "count_matches")


@_register("decode_readings", f"""{READINGS_SQL}
  SELECT {_READING} FROM r WHERE event_type IN ('click', 'purchase', 'view')""")
def decode_readings(spark, sf_dir):
    messages = envelopes.parse_envelopes(message_log(spark, sf_dir))
    return envelopes.decode_readings(messages).select(*READING_COLUMNS)


@_register("heartbeat_decode", f"""{READINGS_SQL},
  s AS (SELECT sensor_id, min(recorded_at) AS start_time FROM r GROUP BY 1)
  SELECT seq, sensor_id, CAST(epoch(recorded_at) - epoch(start_time) AS BIGINT) AS uptime, level AS buffer_size,
    recorded_at AS received_at
  FROM r JOIN s USING (sensor_id) WHERE event_type = 'signup'""")
def heartbeat_decode(spark, sf_dir):
    beats = load_heartbeats(spark, sf_dir).select(
        "seq", "received_at",
        envelopes.encode_message("heartbeat", envelopes.heartbeat_payload(), F.col("received_at")).alias("value"))
    return envelopes.decode_heartbeats(envelopes.parse_envelopes(beats)).drop("part")


@_register("control_messages", f"""{READINGS_SQL}, e AS (SELECT * FROM r WHERE event_type = 'error')
  SELECT 'ack' AS type, seq, 'm' || seq AS a, 'ok' AS b, CAST(NULL AS VARCHAR) AS c FROM e WHERE level % 9 = 0
  UNION ALL SELECT 'config', seq, CAST(level AS VARCHAR), '50', sensor_id FROM e WHERE level % 11 = 0
  UNION ALL SELECT 'error', seq, 'E' || level, sensor_id, NULL FROM e""")
def control_messages(spark, sf_dir):
    """All three kinds of control messages, typed."""
    found = envelopes.decode_control(envelopes.parse_envelopes(control_log(load_readings(spark, sf_dir))))
    fields = {"ack": ("message_id", "status", None), "config": ("read_interval", "buffer_size", "sensor_id"),
              "error": ("code", "message", None)}
    parts = [
        found[kind].select(F.lit(kind).alias("type"), "seq", *[
            (F.col(c) if c else F.lit(None)).cast("string").alias(n) for n, c in zip("abc", columns, strict=True)])
        for kind, columns in fields.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_register("decode_any_case", f"""{READINGS_SQL}
  SELECT seq, {_READING} FROM r WHERE event_type IN ('click', 'purchase')""")
def decode_any_case(spark, sf_dir):
    """A log of single readings whose keys come in three spellings."""
    rows = load_readings(spark, sf_dir).filter(F.col("event_type").isin("click", "purchase"))
    text = envelopes.encode_message("reading", envelopes.reading_payload(), F.col("recorded_at"))
    upper, mixed = text, text
    for key, other in (("type", "Type"), ("payload", "PayLoad"), ("sensor_id", "Sensor_ID"),
                       ("humidity", "Humidity"), ("temperature", "tempERATURE"), ("timestamp", "TimeStamp")):
        upper = F.replace(upper, F.lit(f'"{key}"'), F.lit(f'"{key.upper()}"'))
        mixed = F.replace(mixed, F.lit(f'"{key}"'), F.lit(f'"{other}"'))
    spelled = F.when(F.col("seq") % 3 == 0, text).when(F.col("seq") % 3 == 1, upper).otherwise(mixed)
    log = rows.select("seq", F.col("recorded_at").alias("received_at"), spelled.alias("value"))
    return envelopes.decode_readings(envelopes.parse_envelopes(log)).select("seq", *READING_COLUMNS)


@_register("control_log_counts", f"""{READINGS_SQL}
  SELECT 'error' AS type, 'E' || level AS code, count(*) AS message_count
  FROM r WHERE event_type = 'error' GROUP BY 2""")
def control_log_counts(spark, sf_dir):
    log = control_log(load_readings(spark, sf_dir))
    errors = envelopes.decode_control(envelopes.parse_envelopes(log))["error"]
    return errors.groupBy(F.lit("error").alias("type"), "code").agg(F.count(F.lit(1)).alias("message_count"))


# ---- retention and write ledgers --------------------------------------------


@_register("retention_kept", f"""{READINGS_SQL} SELECT seq, {_READING} FROM r
  WHERE recorded_at >= TIMESTAMP '{AS_OF}' - INTERVAL {KEEP_DAYS} DAY""")
def retention_kept(spark, sf_dir):
    rows = load_readings(spark, sf_dir, start=KEPT_FROM)
    return retention.retention_kept(rows, AS_OF, KEEP_DAYS).select("seq", *READING_COLUMNS)


@_register("retention_deleted", f"""{READINGS_SQL} SELECT {_DAY} AS date, count(*) AS deleted FROM r
  WHERE recorded_at < TIMESTAMP '{AS_OF}' - INTERVAL {KEEP_DAYS} DAY GROUP BY 1""")
def retention_deleted(spark, sf_dir):
    rows = load_readings(spark, sf_dir, end=KEPT_FROM)
    return retention.retention_deleted(rows, AS_OF, KEEP_DAYS).withColumn(
        "date", F.date_format("date", "yyyy-MM-dd"))


# three cleanups, each a day after the one before
_RUNS_SQL = f"""runs AS (SELECT i, TIMESTAMP '2024-01-20 06:00:00' + INTERVAL 1 DAY * i AS run_at FROM range(3) t(i)),
  ledger AS (
    SELECT run_at, (SELECT count(*) FROM r WHERE recorded_at < run_at - INTERVAL {KEEP_DAYS} DAY
        AND (i = 0 OR recorded_at >= run_at - INTERVAL {KEEP_DAYS + 1} DAY)) AS deleted FROM runs)"""


@_register("retention_stats", f"""{READINGS_SQL}, {_RUNS_SQL}
  SELECT CAST(sum(deleted) AS BIGINT) AS total_deleted, count(*) AS total_cleanups, max(run_at) AS last_cleanup,
    arg_max(deleted, run_at) AS last_delete_count, {KEEP_DAYS} AS retention_days FROM ledger""")
def retention_stats(spark, sf_dir):
    """From the ledger that three cleanups of a written table leave."""
    table = _written(spark, sf_dir, "retention")
    ledger = work_dir(spark, "retention-ledger")
    for day in (20, 21, 22):
        retention.run_retention(table, ledger, f"2024-01-{day} 06:00:00", KEEP_DAYS)
    return retention.retention_stats(retention.read_retention_ledger(spark, ledger), KEEP_DAYS)


@_register("retention_job", f"""{READINGS_SQL} SELECT seq, {_READING} FROM r
  WHERE recorded_at >= TIMESTAMP '2024-01-24 12:00:00'""")
def retention_job(spark, sf_dir):
    """Writes the history table, runs the cleanup on it and reads what is left."""
    table = HistoryTable(spark, work_dir(spark, "retention")).create()
    table.append(load_readings(spark, sf_dir), "all")
    table.delete_older_than(KEEP_DAYS, "2024-01-31 12:00:00")
    return table.read().select("seq", *READING_COLUMNS)


# messages in a file of the staged log
FILE_MESSAGES = 200_000


def _staged_log(spark, sf_dir, batches: int = 3) -> DataFrame:
    """The message log as a stream of ``batches`` micro-batches, each of as many files as its size asks for."""
    log_dir, whole = work_dir(spark, "log"), work_dir(spark, "messages")
    message_log(spark, sf_dir).write.parquet(whole)  # encoded once
    log = spark.read.parquet(whole)
    # round robin over many messages leaves no file out
    files = max(1, log.count() // (batches * FILE_MESSAGES))
    for i in range(batches):
        log.filter(F.pmod(F.xxhash64("seq"), F.lit(batches)) == i).repartition(files).write.mode("append").json(log_dir)
    return ingest.read_log_files(spark, log_dir, files)


def _ingested(spark, sf_dir, jobs: int = 1) -> ingest.TelemetryTables:
    tables = ingest.TelemetryTables(spark, work_dir(spark, "tables"))
    log = _staged_log(spark, sf_dir)
    for _ in range(jobs):
        ingest.start_ingest(log, tables, work_dir(spark, "checkpoint"), available_now=True).awaitTermination()
    return tables


@_register("write_ledger_stats", f"""{READINGS_SQL}
  SELECT count(*) AS total_written, CAST(3 AS BIGINT) AS total_batches, CAST(0 AS BIGINT) AS total_errors,
    true AS has_write_time FROM r WHERE event_type IN ('click', 'purchase', 'view')""")
def write_ledger_stats(spark, sf_dir):
    """From the ledger that an ingest run of three micro-batches leaves; SQL can't know the time of its last write."""
    stats = ingest.write_stats(_ingested(spark, sf_dir).ledger())
    return stats.withColumn("has_write_time", F.col("last_write_time").isNotNull()).drop("last_write_time")


@_register("ingest_two_jobs", f"""{READINGS_SQL}
  SELECT sensor_id, 2 * count(*) FILTER (WHERE event_type IN ('click', 'purchase', 'view')) AS readings FROM r
  GROUP BY 1 HAVING count(*) FILTER (WHERE event_type IN ('click', 'purchase', 'view')) > 0""")
def ingest_two_jobs(spark, sf_dir):
    """Two jobs, each with its own checkpoint, write one log into the same tables: nothing is replaced."""
    return _ingested(spark, sf_dir, jobs=2).history.read().groupBy("sensor_id").agg(
        F.count(F.lit(1)).alias("readings"))


@_register("ingest_upkeep", f"""{READINGS_SQL}
  SELECT 'readings' AS name, count(*) FILTER (WHERE event_type IN ('click', 'purchase', 'view')) AS row_count,
    true AS few_folders FROM r
  UNION ALL SELECT 'heartbeats', count(*) FILTER (WHERE event_type = 'signup'), true FROM r
  UNION ALL SELECT 'quarantine', count(*) FILTER (WHERE event_type = 'error')
    + count(*) FILTER (WHERE event_type = 'error' AND level % 9 = 0)
    + count(*) FILTER (WHERE event_type = 'error' AND level % 11 = 0), true FROM r
  UNION ALL SELECT 'write_ledger', 6, true""")
def ingest_upkeep(spark, sf_dir):
    """A job that merges its small loads after every second of six micro-batches. Without that there would be six
    folders of each day and table, and a reader that missed a merge would count rows twice."""
    tables = ingest.TelemetryTables(spark, work_dir(spark, "tables"), merge_at=2)
    ingest.start_ingest(_staged_log(spark, sf_dir, 6), tables, work_dir(spark, "checkpoint"), available_now=True,
                        upkeep_every=2).awaitTermination()
    kept = {"readings": tables.history, "heartbeats": tables.heartbeat_table, "quarantine": tables.quarantine_table,
            "write_ledger": tables.ledger_table}
    parts = []
    for name, table in kept.items():
        table.upkeep()
        table.upkeep()  # deletes what the one before replaced
        few = all(len(table.loads(folder)) <= 3 for folder in table.folders())
        parts.append(table.read().agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("name"), "row_count", F.lit(few).alias("few_folders")))
    return reduce(DataFrame.unionByName, parts)


_KEPT_SQL = """k AS (SELECT * FROM r WHERE event_type IN ('click', 'purchase', 'view')
    AND recorded_at >= TIMESTAMP '2024-01-24 12:00:00'),
  kv AS (SELECT * FROM v WHERE event_type IN ('click', 'purchase', 'view')
    AND recorded_at >= TIMESTAMP '2024-01-24 12:00:00')"""


def _summarised(spark, sf_dir) -> ingest.TelemetryTables:
    """Tables that a job of three micro-batches filled, merging summaries as it went, and retention then cut."""
    tables = ingest.TelemetryTables(spark, work_dir(spark, "tables"), merge_at=2, sketched=True)
    ingest.start_ingest(_staged_log(spark, sf_dir), tables, work_dir(spark, "checkpoint"), available_now=True,
                        upkeep_every=3).awaitTermination()
    retention.run_retention(tables.history, tables.retention_ledger_path, "2024-01-31 12:00:00", KEEP_DAYS,
                            summaries=tables.summaries)
    return tables


@_register("stats_from_summaries", f"""{READINGS_SQL}, {_KEPT_SQL},
  n AS (SELECT sensor_id, count(*) AS c FROM kv GROUP BY 1)
  SELECT count(*) AS total_readings, min(recorded_at) AS oldest_reading, max(recorded_at) AS newest_reading,
    count(DISTINCT sensor_id) AS unique_sensors, (SELECT count(*) FROM kv) AS accepted,
    (SELECT count(*) FROM n) AS sensors_in_view,
    (SELECT CAST(sum(least(c, {CAPACITY})) AS BIGINT) FROM n) AS current_readings, true AS estimate_is_near FROM k""")
def stats_from_summaries(spark, sf_dir):
    """Totals of history and recent view from the days' summaries, and whether the sketches' estimate is near."""
    summaries = _summarised(spark, sf_dir).summaries
    recent = summaries.recent_totals(CAPACITY).select(
        F.col("total_readings").alias("accepted"), F.col("unique_sensors").alias("sensors_in_view"), "current_readings")
    exact = summaries.storage_stats()
    estimate = summaries.approximate_sensors().select(F.col("unique_sensors").alias("estimated"))
    near = F.abs(F.col("estimated") - F.col("unique_sensors")) <= F.col("unique_sensors") * 0.05
    return aggregates.one_row(exact, recent, estimate).withColumn("estimate_is_near", near).drop("estimated")


@_register("daily_stats_from_summaries", f"{READINGS_SQL}, {_KEPT_SQL} {_DAILY_SQL} FROM k GROUP BY 1, 2")
def daily_stats_from_summaries(spark, sf_dir):
    return _daily(_summarised(spark, sf_dir).summaries.daily_stats())


# ---- liveness ---------------------------------------------------------------

_BEATS_SQL = """h AS (SELECT sensor_id, seq, recorded_at AS received_at FROM r WHERE event_type = 'signup'),
  g AS (SELECT *, lag(received_at) OVER (PARTITION BY sensor_id ORDER BY received_at, seq) AS previous_at FROM h)"""
_SILENCE_SQL = "CAST(epoch(received_at) - epoch(previous_at) AS BIGINT)"


def _beat_times(spark, sf_dir) -> DataFrame:
    return heartbeat_times(load_readings(spark, sf_dir))


@_register("last_seen", f"{READINGS_SQL}, {_BEATS_SQL} SELECT sensor_id, max(received_at) AS last_seen FROM h GROUP BY 1")
def last_seen(spark, sf_dir):
    return liveness.last_seen(_beat_times(spark, sf_dir))


@_register("active_sensors", f"""{READINGS_SQL}, {_BEATS_SQL}
  SELECT sensor_id, max(received_at) AS last_seen FROM h GROUP BY 1
  HAVING max(received_at) >= TIMESTAMP '{AS_OF}' - INTERVAL 2 DAY""")
def active_sensors(spark, sf_dir):
    rows = load_readings(spark, sf_dir, start=as_instant(AS_OF) - timedelta(days=2), end=AS_OF)
    return liveness.active_sensors(heartbeat_times(rows), AS_OF, 2 * 86400)


@_register("active_sensors_with_empty_ids", f"""{READINGS_SQL}, {_BEATS_SQL}
  SELECT sensor_id, max(received_at) AS last_seen FROM h WHERE CAST(right(sensor_id, 4) AS INTEGER) % 4 <> 0
  GROUP BY 1""")
def active_sensors_with_empty_ids(spark, sf_dir):
    """Heartbeats of every fourth sensor lost their id; they make no sensor active."""
    lost = F.right("sensor_id", F.lit(4)).cast("int") % 4 == 0
    beats = _beat_times(spark, sf_dir).withColumn("sensor_id", F.when(lost, "").otherwise(F.col("sensor_id")))
    return liveness.active_sensors(beats, AS_OF, 40 * 86400)


@_register("heartbeat_sessions", f"""{READINGS_SQL}, {_BEATS_SQL},
  s AS (SELECT *, CAST(sum(CASE WHEN {_SILENCE_SQL} <= {SILENCE} THEN 0 ELSE 1 END)
    OVER (PARTITION BY sensor_id ORDER BY received_at, seq) AS BIGINT) AS session_no FROM g)
  SELECT sensor_id, session_no, min(received_at) AS connected_at, max(received_at) AS last_seen,
    count(*) AS heartbeat_count FROM s GROUP BY 1, 2""")
def heartbeat_sessions(spark, sf_dir):
    return liveness.heartbeat_sessions(_beat_times(spark, sf_dir), SILENCE)


@_register("heartbeat_gaps", f"""{READINGS_SQL}, {_BEATS_SQL}
  SELECT sensor_id, previous_at, received_at, {_SILENCE_SQL} AS gap_seconds FROM g WHERE {_SILENCE_SQL} > {GAP}""")
def heartbeat_gaps(spark, sf_dir):
    return liveness.heartbeat_gaps(_beat_times(spark, sf_dir), GAP)


@_register("heartbeat_gaps_open", f"""{READINGS_SQL}, {_BEATS_SQL},
  known AS (SELECT * FROM g WHERE received_at <= '{CUT}'),
  seen AS (SELECT sensor_id, max(received_at) AS last_seen FROM known GROUP BY 1)
  SELECT sensor_id, previous_at, received_at, {_SILENCE_SQL} AS gap_seconds FROM known WHERE {_SILENCE_SQL} > {GAP}
  UNION ALL SELECT sensor_id, last_seen, NULL, CAST(epoch(TIMESTAMP '{CUT}') - epoch(last_seen) AS BIGINT) FROM seen
  WHERE epoch(TIMESTAMP '{CUT}') - epoch(last_seen) > {GAP}""")
def heartbeat_gaps_open(spark, sf_dir):
    """With the silences that still last at the given time: a sensor that fell silent has no next heartbeat."""
    return liveness.heartbeat_gaps(_beat_times(spark, sf_dir), GAP, CUT)


@_register("sensor_uptime", f"""{READINGS_SQL}
  SELECT sensor_id, min(recorded_at) AS start_time,
    CAST(epoch(TIMESTAMP '{AS_OF}') - epoch(min(recorded_at)) AS BIGINT) AS uptime_seconds FROM r GROUP BY 1""")
def sensor_uptime(spark, sf_dir):
    return inventory.sensor_uptime(inventory.first_seen(load_readings(spark, sf_dir)), AS_OF)


# ---- streaming --------------------------------------------------------------


def _drained(spark: SparkSession, table: LiveTable, *parts: DataFrame) -> DataFrame:
    """The view that jobs keep, one for each stream, all running at once."""
    jobs = [live.start_view(part, table, work_dir(spark, "checkpoint"), available_now=True) for part in parts]
    for job in jobs:
        job.awaitTermination()
    return table.view()


@_register("stream_daily_stats", f"{READINGS_SQL} {_DAILY_SQL} FROM r GROUP BY 1, 2")
def stream_daily_stats(spark, sf_dir):
    view = live.live_daily_stats(stream_readings(spark, sf_dir))
    return _daily(_drained(spark, live.daily_stats_table(spark, work_dir(spark, "view"), view.schema), view))


@_register("stream_two_jobs", f"{READINGS_SQL} {_DAILY_SQL} FROM r GROUP BY 1, 2")
def stream_two_jobs(spark, sf_dir):
    """Two jobs at once keep one view, each from its half of the readings, and fold it as they go."""
    rows = stream_readings(spark, sf_dir)
    halves = [live.live_daily_stats(rows.filter(F.col("seq") % 2 == i)) for i in (0, 1)]
    table = live.daily_stats_table(spark, work_dir(spark, "view"), halves[0].schema, upkeep_every=2, merge_at=2)
    return _daily(_drained(spark, table, *halves))


@_register("stream_recent_view", f"""{READINGS_SQL} SELECT seq, {_READING} FROM v
  {_NEWEST.format(order='seq DESC', n=CAPACITY)}""")
def stream_recent_view(spark, sf_dir):
    view = RecentViewTable(spark, work_dir(spark, "recent"), CAPACITY)
    view.start(stream_readings(spark, sf_dir), work_dir(spark, "checkpoint"), available_now=True).awaitTermination()
    return view.read().drop("pos", "part")


@_register("stream_last_seen", f"""{READINGS_SQL}, {_BEATS_SQL}
  SELECT sensor_id, max(received_at) AS last_seen FROM h GROUP BY 1""")
def stream_last_seen(spark, sf_dir):
    view = live.live_last_seen(heartbeat_times(stream_readings(spark, sf_dir)))
    return _drained(spark, live.last_seen_table(spark, work_dir(spark, "view"), view.schema), view)


def _closing_beat(spark, at: str) -> DataFrame:
    """A heartbeat of another device that comes long after all others, so that their sessions end."""
    return spark.range(1).select(F.lit("clock").alias("sensor_id"), F.lit(at).cast("timestamp").alias("received_at"))


def _beat_stream(spark, sf_dir, reverse: bool) -> DataFrame:
    """Heartbeats as a stream of files, a third of the time each, in order or newest first, and a closing one."""
    path = work_dir(spark, "beats")
    beats = _beat_times(spark, sf_dir)
    parts = [beats.filter((F.dayofmonth("received_at") > 10 * i) & ((F.dayofmonth("received_at") <= 10 * i + 10)
                          | F.lit(i == 2))) for i in range(3)]
    for part in [*(parts[::-1] if reverse else parts), _closing_beat(spark, "2024-06-01 00:00:00")]:
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(beats.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _logged(spark, rows: DataFrame) -> DataFrame:
    table = live.log_table(spark, work_dir(spark, "ended"), rows.schema)
    live.start_log(rows, table, work_dir(spark, "checkpoint"), available_now=True).awaitTermination()
    return table.read().drop("load_id")


# later than the last of the month's heartbeats by less than this
MONTH_SECONDS = 40 * 86400


@_register("stream_sessions", f"""{READINGS_SQL}, {_BEATS_SQL},
  s AS (SELECT *, CAST(sum(CASE WHEN {_SILENCE_SQL} <= {SILENCE} THEN 0 ELSE 1 END)
    OVER (PARTITION BY sensor_id ORDER BY received_at, seq) AS BIGINT) AS session_no FROM g),
  n AS (SELECT sensor_id, min(received_at) AS connected_at, max(received_at) AS last_seen,
    count(*) AS heartbeat_count FROM s GROUP BY sensor_id, session_no)
  SELECT files, n.* FROM n, (VALUES ('in order'), ('newest first')) f(files)""")
def stream_sessions(spark, sf_dir):
    """Sessions of a stream of four files, whose older ones come first, and then last: late, but within the watermark."""
    return reduce(DataFrame.unionByName, [
        _logged(spark, live.live_sessions(_beat_stream(spark, sf_dir, reverse), SILENCE, MONTH_SECONDS))
        .select(F.lit(name).alias("files"), "*")
        for name, reverse in (("in order", False), ("newest first", True))])


@_register("stream_silences", f"""{READINGS_SQL}, {_BEATS_SQL},
  n AS (SELECT *, lead(received_at) OVER (PARTITION BY sensor_id ORDER BY received_at, seq) AS next_at FROM h)
  SELECT sensor_id, received_at AS silent_since, received_at + INTERVAL {GAP} SECOND AS noticed_at FROM n
  WHERE next_at IS NULL OR epoch(next_at) - epoch(received_at) > {GAP}""")
def stream_silences(spark, sf_dir):
    """Every silence, also the last one of each sensor, after which no heartbeat comes."""
    return _logged(spark, live.live_silences(_beat_stream(spark, sf_dir, False), GAP, MONTH_SECONDS))


@_register("stream_recent_view_cleared", f"""{READINGS_SQL} SELECT seq, {_READING} FROM v WHERE seq % 3 = 0
  {_NEWEST.format(order='seq DESC', n=CAPACITY)}""")
def stream_recent_view_cleared(spark, sf_dir):
    """A view that held two thirds of the readings, was cleared, and then got the last third."""
    rows = load_readings(spark, sf_dir)
    view = RecentViewTable(spark, work_dir(spark, "recent"), CAPACITY)
    for batch, part in enumerate((1, 2)):
        view.merge(rows.filter(F.col("seq") % 3 == part), batch, "job")
    view.clear()
    view.merge(rows.filter("seq % 3 = 0"), 2, "job")
    return view.read().drop("pos", "part")


@_register("ingest_ahead_of_clock", f"""{READINGS_SQL}
  SELECT 'ahead' AS kept_in, seq, sensor_id, recorded_at + INTERVAL (CAST(level AS INTEGER)) HOUR AS recorded_at,
    CAST(level * 3600 AS BIGINT) AS ahead_seconds FROM r WHERE event_type = 'click' AND level % 3 = 0 AND level > 1
  UNION ALL SELECT 'history', seq, sensor_id,
    recorded_at + INTERVAL (CAST(CASE WHEN level % 3 = 0 THEN level ELSE 0 END AS INTEGER)) HOUR, NULL
  FROM r WHERE event_type = 'click'""")
def ingest_ahead_of_clock(spark, sf_dir):
    """A third of the devices' messages are dated by up to 99 hours ahead: the history has all, the side table those."""
    rows = load_readings(spark, sf_dir).filter("event_type = 'click'")
    wrong = F.when(F.col("level") % 3 == 0, F.col("level")).otherwise(0)
    dated = rows.withColumn("received_at", F.col("recorded_at")).withColumn(
        "recorded_at", F.timestamp_seconds(F.unix_seconds("recorded_at") + wrong * 3600))
    log = dated.select("seq", "received_at", envelopes.encode_message(
        "reading", envelopes.reading_payload(), F.col("received_at")).alias("value"))
    path = work_dir(spark, "log")
    log.write.json(path)
    tables = ingest.TelemetryTables(spark, work_dir(spark, "tables"))
    ingest.start_ingest(ingest.read_log_files(spark, path), tables, work_dir(spark, "checkpoint"),
                        available_now=True).awaitTermination()
    columns = ["seq", "sensor_id", "recorded_at"]
    return tables.ahead().select(F.lit("ahead").alias("kept_in"), *columns, "ahead_seconds").unionByName(
        tables.history.read().select(F.lit("history").alias("kept_in"), *columns, F.lit(None).cast("long").alias("ahead_seconds")))


@_register("stream_ingest", f"""{READINGS_SQL}
  SELECT {_READING} FROM r WHERE event_type IN ('click', 'purchase', 'view')""")
def stream_ingest(spark, sf_dir):
    """The ingest job end to end over three micro-batches: message files in, history table out."""
    return _ingested(spark, sf_dir).history.read().select(*READING_COLUMNS)
