import os
import random
import subprocess
import sys
from datetime import datetime, timedelta, timezone
from pathlib import Path

import duckdb
import pytest

from conftest import AS_OF, SF_DIR, minutes_ago
from thermolake import registry
from thermolake.operators import aggregates, inventory, latest, scans, views
from thermolake.session import work_dir
from thermolake.sources.history import HistoryTable


def seqs(df):
    return [r.seq for r in df.collect()]


def test_range_of_last_six_hours(make):
    rows = make([("sensor-01", i, AS_OF - timedelta(minutes=30 * (47 - i)), 20 + 0.5 * i, 50) for i in range(48)])
    page = scans.readings_in_range(rows, AS_OF - timedelta(hours=6), AS_OF, 100, "sensor-01")
    found = page.collect()
    assert len(found) == 13
    assert [r.recorded_at for r in found] == sorted((r.recorded_at for r in found), reverse=True)
    assert page.columns == ["seq", "sensor_id", "recorded_at", "humidity", "temperature"]


@pytest.mark.parametrize("no_sensor", [None, ""])
def test_no_sensor_means_all(make, no_sensor):
    rows = make([(f"sensor-0{i}", i, AS_OF, 20, 50) for i in (1, 2, 3)])
    assert len(seqs(scans.readings_in_range(rows, AS_OF, AS_OF, 10, no_sensor))) == 3


def test_range_bounds_are_closed_and_cut_to_the_second(make):
    rows = make([("s", i, AS_OF + timedelta(seconds=i), 20, 50) for i in range(5)])
    found = scans.readings_in_range(
        rows, AS_OF + timedelta(seconds=1, microseconds=900), AS_OF + timedelta(seconds=3, microseconds=100), 10)
    assert seqs(found) == [3, 2, 1]


@pytest.fixture(scope="module")
def fifty(make):
    """seq = age in minutes."""
    return make([("s", age, minutes_ago(age), 20, 50) for age in range(50)])


def test_scroll_back(fifty):
    assert seqs(scans.readings_before(fifty, minutes_ago(25), 10, "s")) == list(range(26, 36))


def test_scroll_forward_returns_the_closest(fifty):
    assert seqs(scans.readings_after(fifty, minutes_ago(25), 10, "s")) == list(range(15, 25))


def test_scroll_uses_top_k_plan(fifty):
    plan = scans.readings_before(fifty, AS_OF, 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_cursor_does_not_skip_ties(make):
    rows = make([("s", i, AS_OF, 20, 50) for i in range(5)])
    page = scans.readings_in_range(rows, AS_OF, AS_OF, 2, "s")
    assert seqs(page) == [4, 3]
    assert seqs(scans.readings_before(rows, AS_OF, 2)) == []
    cursor = scans.cursor_after(page)
    assert cursor == scans.Cursor(int(AS_OF.replace(tzinfo=timezone.utc).timestamp()), (3,))
    assert seqs(scans.readings_before_cursor(rows, cursor, 2)) == [2, 1]
    assert scans.cursor_after(rows.limit(0)) is None


def test_cursor_tells_partitions_and_positions_apart(spark):
    rows = spark.createDataFrame(
        [(s, p, k, "s", AS_OF, 20.0, 50.0) for s in range(2) for p in range(2) for k in range(2)],
        "seq long, pos long, part int, sensor_id string, recorded_at timestamp, temperature double, humidity double")
    seen, page = [], scans.readings_before(rows, AS_OF + timedelta(seconds=1), 1)
    while (cursor := scans.cursor_after(page)) is not None:
        seen.append(cursor.arrival)
        page = scans.readings_before_cursor(rows, cursor, 1)
    assert seen == sorted(((s, p, k) for s in range(2) for p in range(2) for k in range(2)), reverse=True)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_cursor_is_the_same_in_every_process_zone(zone):
    """The process zone is fixed when Python starts, hence a process of its own."""
    code = """
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[2]").config("spark.sql.session.timeZone", "UTC").config(
    "spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
rows = entry.queries()["readings_before_cursor"](spark, {sf!r}).collect()
print("SEQS", [r.seq for r in rows])
""".format(root=str(Path(__file__).resolve().parents[1]), sf=SF_DIR)
    said = subprocess.run([sys.executable, "-c", code], env=os.environ | {"TZ": zone}, capture_output=True, text=True)
    found = [line for line in said.stdout.splitlines() if line.startswith("SEQS")]
    assert found, said.stderr[-500:]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF_DIR}/events.parquet'")
    wanted = [r[0] for r in con.execute(registry.oracle_sql()["readings_before_cursor"]).fetchall()]
    assert found[0] == f"SEQS {wanted}"


def test_pages_of_a_table_read_only_the_days_they_need(spark, make):
    table = HistoryTable(spark, work_dir(spark, "days")).create()
    table.append(make([("s", i, AS_OF - timedelta(days=i), 20, 50) for i in range(40)]))
    page = scans.readings_before(table, AS_OF, 3, "s")
    assert seqs(page) == [1, 2, 3]
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "recorded_date" in plan.split("PartitionFilters")[1].split("]")[0] and ">=" in plan
    assert seqs(scans.readings_before(table, AS_OF, 100, "s")) == list(range(1, 40))
    assert seqs(scans.readings_after(table, AS_OF - timedelta(days=5), 2, "s")) == [3, 4]
    assert seqs(scans.latest_reading(table, "s")) == [0]
    assert scans.latest_reading(table, "nobody").collect() == []


def test_latest(make):
    rows = make([("s", i, AS_OF - timedelta(hours=2 - i), t, 50) for i, t in enumerate((20, 22, 25))])
    assert scans.latest_reading(rows, "s").first().temperature == 25
    assert scans.latest_reading(rows, "unknown").collect() == []


def test_history_orders_by_time_and_recent_view_by_arrival(make):
    rows = make([("s", i + 1, minutes_ago(60 - m), 20, 50) for i, m in enumerate((3, 1, 2, 6, 5, 4))])
    assert seqs(latest.latest_per_sensor(rows)) == [4]
    assert seqs(latest.current_per_sensor(rows)) == [6]
    assert sorted(seqs(views.recent_view(rows, 3))) == [4, 5, 6]
    assert seqs(views.recent_of_sensor(rows, "s", 2)) == [6, 5]


def test_latest_breaks_ties_by_arrival(make):
    big = 2**62
    rows = make([("s", q, AS_OF, 20, 50) for q in (5, big, 9)] + [("t", 1, datetime(1960, 1, 1), 20, 50)])
    found = {r.sensor_id: r.seq for r in latest.latest_per_sensor(rows).collect()}
    assert found == {"s": big, "t": 1}


def test_fallback_to_history(make):
    rows = make([("bad", 1, minutes_ago(5), 99, 50), ("bad", 2, minutes_ago(9), 99, 50),
                 ("good", 3, minutes_ago(9), 20, 50), ("good", 4, minutes_ago(5), 99, 50)])
    found = {r.sensor_id: (r.seq, r.source) for r in latest.current_with_fallback(rows).collect()}
    assert found == {"bad": (1, "database"), "good": (3, "memory")}
    joined = latest.current_or_latest(latest.current_per_sensor(rows), latest.latest_per_sensor(rows))
    assert {r.sensor_id: (r.seq, r.source) for r in joined.collect()} == found


def test_daily_stats_of_three_days(make):
    rows = make([("s", d * 24 + h, datetime(2024, 1, 10 + d, h), 20 + h, 50 + d) for d in range(3) for h in range(24)])
    found = aggregates.daily_stats(rows).collect()
    assert [str(r.date) for r in found] == ["2024-01-12", "2024-01-11", "2024-01-10"]
    for r in found:
        assert (r.reading_count, r.min_temperature, r.max_temperature, r.avg_temperature) == (24, 20, 43, 31.5)
    assert [r.avg_humidity for r in found] == [52, 51, 50]
    assert aggregates.daily_stats(rows, "2024-01-11 00:00:00", "2024-01-11 11:59:59").first().reading_count == 12


def test_daily_stats_include_invalid_unless_asked(make):
    rows = make([("s", 1, AS_OF, 20, 50), ("s", 2, AS_OF, 99, 50)])
    assert aggregates.daily_stats(rows).first().reading_count == 2
    assert aggregates.daily_stats(rows, valid_only=True).first().reading_count == 1
    assert aggregates.daily_stats(rows, "2030-01-01 00:00:00", "2030-01-02 00:00:00").collect() == []


def test_storage_stats(make):
    empty = aggregates.storage_stats(make([])).first()
    assert (empty.total_readings, empty.unique_sensors, empty.oldest_reading) == (0, 0, None)
    rows = make([("a", 1, minutes_ago(9), 20, 50), ("a", 2, minutes_ago(5), 20, 50), ("b", 3, AS_OF, 20, 50)])
    for approximate in (False, True):
        s = aggregates.storage_stats(rows, approximate).first()
        assert (s.total_readings, s.unique_sensors, s.oldest_reading, s.newest_reading) == (
            3, 2, minutes_ago(9), AS_OF)


def test_sensor_ids_sorted(make):
    names = ["sensor-03", "kitchen", "sensor-01", "bedroom", "sensor-02"]
    rows = make([(n, i, AS_OF, 20, 50) for i, n in enumerate(names * 2)])
    assert [r.sensor_id for r in aggregates.sensor_ids(rows).collect()] == sorted(names)
    assert inventory.default_sensor(rows).first().sensor_id == "bedroom"
    recent = make([("attic", 1, AS_OF, 20, 50)])
    assert [r.sensor_id for r in inventory.sensors_union(recent, rows).collect()] == sorted([*names, "attic"])


def test_recent_view_stats_are_cumulative(make):
    rows = make([("s", i, minutes_ago(i), 20, 50) for i in range(7)] + [("s", 9, AS_OF, 99, 50), ("t", 10, AS_OF, 1, 1)])
    s = views.recent_view_stats(rows, 3).first()
    assert (s.total_readings, s.unique_sensors, s.current_readings) == (8, 2, 4)
    assert (s.oldest_reading, s.newest_reading) == (minutes_ago(6), AS_OF)
    empty = views.recent_view_stats(make([]), 3).first()
    assert (empty.total_readings, empty.unique_sensors, empty.current_readings) == (0, 0, 0)


def test_duplicates_count(make):
    rows = make([("s", i, AS_OF, 20, 50) for i in range(4)])
    assert aggregates.daily_stats(rows).first().reading_count == 4


def test_sensor_dimension(spark):
    info = inventory.sensor_info(spark, "s", "hall", "hygrometer", "1.0", "2024-01-30 23:00:00")
    assert inventory.sensor_uptime(info, AS_OF).first().uptime_seconds == 3600
    assert info.first().location == "hall"


@pytest.mark.parametrize("newest", [True, False])
def test_large_pages_are_cut_by_counts(spark, monkeypatch, newest):
    """Ties, missing arrivals and repeated rows: the same rows as those of a sort, and no limit in one task."""
    monkeypatch.setattr(scans, "PAGE_OF_ONE_TASK", 0)
    monkeypatch.setattr(scans, "CUT_PIECES", 3)
    draw = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = [(draw.choice([None, -5, *range(40)]), draw.choice([None, 0, 1]), "s", start + timedelta(
        seconds=draw.choice([0, 0, 1, 100, 86_400 * 40])), 1.0, 2.0) for _ in range(200)]
    df = spark.createDataFrame(
        rows, "seq long, pos long, sensor_id string, recorded_at timestamp, temperature double, humidity double")
    order = scans._newest_first(df) if newest else scans._oldest_first(df)
    wanted = [tuple(r) for r in df.select("seq", "pos", "recorded_at").orderBy(*order).collect()]
    for limit in (1, 7, 60, 133, 199, 200, 500):
        page = scans._page(df, limit, newest)
        assert [(r.seq, r.pos, r.recorded_at) for r in page.collect()] == wanted[:limit], limit
