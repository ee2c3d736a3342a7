from datetime import datetime, timedelta, timezone

import pytest

from conftest import AS_OF
from thermolake.operators import scans
from thermolake.operators.views import recent_view
from thermolake.plans import retention
from thermolake.plans.api import TelemetryApi
from thermolake.session import child_names, delete_path, hadoop_path, path_exists, work_dir
from thermolake.sources import history, loads
from thermolake.sources.history import HistoryTable


@pytest.fixture
def table(spark):
    return HistoryTable(spark, work_dir(spark, "readings")).create()


def aged(make, days, n=5, first_seq=0):
    return make([("s", first_seq + i, AS_OF - timedelta(days=days, minutes=i), 20, 50) for i in range(n)])


def test_create_is_idempotent(make, table):
    table.append(aged(make, 1))
    table.create()
    assert table.read().count() == 5


def test_append_batch_and_single(make, table):
    table.append(make([("s", i, AS_OF - timedelta(minutes=i), 20 + i / 10, 50 + i / 10) for i in range(100)]))
    table.append(make([("s", 100, AS_OF, 99, 500)]))
    table.append(make([]))
    assert table.read().count() == 101
    assert table.read().filter("created_at is null").count() == 0


def test_time_is_cut_to_the_second(make, table):
    table.append(make([("s", 1, AS_OF + timedelta(microseconds=999_999), 20, 50)]))
    assert table.read().first().recorded_at == AS_OF


def test_writing_a_load_again_replaces_it(make, table):
    table.append(aged(make, 1), "load-1")
    table.append(aged(make, 1), "load-1")
    table.append(aged(make, 1, first_seq=9), "load-2")
    assert table.read().count() == 10


def test_duplicates_are_kept(make, table):
    rows = aged(make, 1)
    table.append(rows.union(rows))
    assert table.read().count() == 10


def test_stats(make, table):
    empty = table.stats().first()
    assert (empty.total_readings, empty.unique_sensors, empty.oldest_reading, empty.database_size_mb) == (0, 0, None, 0)
    table.append(aged(make, 1))
    full = table.stats().first()
    assert (full.total_readings, full.unique_sensors) == (5, 1) and 0 < full.database_size_mb < 1


def test_scan_prunes_days_and_pushes_filters(make, table):
    for days in (1, 2, 3):
        table.append(aged(make, days))
    page = TelemetryApi(table.read(), AS_OF).history("s", start="2024-01-30T00:00:00Z").readings
    assert page.count() == 1
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(recorded_date" in plan
    assert "EqualTo(sensor_id,s)" in plan and "TakeOrderedAndProject" in plan
    assert "created_at" not in plan.split("ReadSchema")[1]


def test_validity_reaches_the_scan(capsys, make, table):
    table.append(aged(make, 1))
    view = recent_view(table.read(), 3)
    view.explain("formatted")
    pushed = capsys.readouterr().out.split("PushedFilters: [")[1].split("ReadSchema")[0]
    assert "LessThanOrEqual(temperature,60.0)" in pushed and "GreaterThanOrEqual(humidity,0.0)" in pushed
    assert view.count() == 3


@pytest.mark.parametrize("keep, age, deleted", [(30, 35, True), (30, 25, False), (7, 10, True), (1, 2, True)])
def test_retention_pairs(make, table, keep, age, deleted):
    table.append(aged(make, 0).union(aged(make, age, first_seq=10)))
    assert table.delete_older_than(keep, AS_OF) == (5 if deleted else 0)
    assert table.read().count() == (5 if deleted else 10)


def test_boundary_day_is_rewritten_exactly(make, table):
    cut = datetime(2024, 1, 24, 12)
    table.append(make([("s", i, cut + timedelta(minutes=m), 20, 50) for i, m in enumerate((-60, -1, 0, 1))]), "mixed")
    table.append(make([("s", 10, cut - timedelta(minutes=5), 20, 50)]), "expired")
    table.append(make([("s", 11, cut + timedelta(minutes=5), 20, 50)]), "fresh")
    table.append(make([("s", 12, cut - timedelta(days=3), 20, 50)]), "old day")
    assert table.delete_older_than(7, AS_OF.replace(hour=12)) == 4
    assert sorted(r.seq for r in table.read().collect()) == [2, 3, 11]
    assert [n for n in child_names(table.spark, table.path) if n.startswith("recorded")] == ["recorded_date=2024-01-24"]
    assert table.delete_older_than(7, AS_OF.replace(hour=12)) == 0


def load_names(table, day):
    return table.loads(f"recorded_date={day}")


def rows_of(table):
    return sorted(map(tuple, table.read().drop("load_id").collect()))


def test_compaction_merges_loads_and_keeps_rows(make, table):
    for i in range(4):
        table.append(aged(make, 2, first_seq=10 * i), f"load-{i}")
    before = rows_of(table)
    table.compact_day("2024-01-29")
    table.compact_day("2024-01-28")
    # replaced loads stay for queries that run, but are not seen
    assert len(load_names(table, "2024-01-28")) == 5 and rows_of(table) == before
    table.compact_day("2024-01-28")
    assert rows_of(table) == before
    # the newest load of a job can be run again, so it is left alone
    left = load_names(table, "2024-01-28")
    assert len(left) == 2 and left[0] == "load-3" and left[1].startswith("once-")
    table.append(aged(make, 2, first_seq=30), "load-3")
    assert table.read().count() == 20


def test_upkeep_takes_small_ended_loads_only(spark, make):
    table = HistoryTable(spark, work_dir(spark, "readings"), merge_at=3).create()
    for i in range(3):
        table.append(aged(make, 2, first_seq=10 * i), f"a-{i}")
        table.append(aged(make, 2, first_seq=100 + 10 * i))
    table.append(aged(make, 2, first_seq=200), "named by hand")
    before = rows_of(table)
    table.small_bytes = 1
    table.upkeep()
    assert len(load_names(table, "2024-01-28")) == 7
    table.small_bytes = loads.SMALL_BYTES
    table.upkeep()
    table.upkeep()
    left = load_names(table, "2024-01-28")
    assert sorted(n.split("-")[0] for n in left) == ["a", "named by hand", "once"] and rows_of(table) == before


def test_two_upkeeps_do_not_meet(spark, make):
    table = HistoryTable(spark, work_dir(spark, "readings"), merge_at=2).create()
    for i in range(4):
        table.append(aged(make, 2, first_seq=10 * i), f"load-{i}")
    fs, lock = hadoop_path(spark, f"{table.path}__upkeep")
    assert fs.createNewFile(lock)
    table.upkeep()
    assert len(load_names(table, "2024-01-28")) == 4
    delete_path(spark, f"{table.path}__upkeep")
    table.upkeep()
    assert len(load_names(table, "2024-01-28")) == 5 and not path_exists(spark, f"{table.path}__upkeep")


def test_interrupted_merges(spark, make, table):
    """Before the merged load is in place nothing has changed; afterwards the replaced ones are not seen."""
    for i in range(3):
        table.append(aged(make, 2, first_seq=10 * i), f"load-{i}")
    before = rows_of(table)
    fs, note = hadoop_path(spark, f"{table.path}__replaced/once-x/recorded_date=2024-01-28/load-0")
    fs.mkdirs(note)
    assert rows_of(table) == before
    table.upkeep()
    assert rows_of(table) == before and len(load_names(table, "2024-01-28")) == 3
    # a reader whose files were listed before the merge still finds them
    seen = table.read()
    table.compact_day("2024-01-28")
    assert seen.count() == table.read().count() == 15


def test_merge_between_notes_and_listing_is_noticed(spark, make, table):
    for i in range(3):
        table.append(aged(make, 2, first_seq=10 * i), f"load-{i}")

    def scan():
        table.compact_day("2024-01-28")
        return spark.read.schema(table.schema).parquet(table.path)

    assert table._without_replaced(scan).count() == 15


def test_retention_twice_on_one_day(make, table):
    cut = datetime(2024, 1, 24, 12)
    table.append(make([("s", i, cut + timedelta(minutes=i), 20, 50) for i in range(6)]), "a")
    assert table.delete_older_than(7, AS_OF + timedelta(hours=12, minutes=2)) == 2
    assert table.delete_older_than(7, AS_OF + timedelta(hours=12, minutes=4)) == 2
    assert sorted(r.seq for r in table.read().collect()) == [4, 5]
    table.upkeep()
    assert sorted(r.seq for r in table.read().collect()) == [4, 5] and len(load_names(table, "2024-01-24")) == 1


def scanned_rows(df):
    """How many rows the scan passed on, after row groups were skipped."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "Adaptive" in plan.getClass().getName() else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_one_sensor_skips_row_groups(spark, table, monkeypatch):
    rows = spark.range(60_000).selectExpr(
        "id AS seq", "concat('s', lpad(2 * (id % 3000), 5, '0')) AS sensor_id",
        "timestamp'2024-01-20 00:00:00' + make_dt_interval(0, 0, 0, id % 80000) AS recorded_at",
        "rand(1) AS temperature", "rand(2) AS humidity")
    monkeypatch.setattr(history, "ROW_GROUP_BYTES", 1 << 16)
    table.append(rows)
    some = table.read().filter("sensor_id = 's02000'").select("temperature")
    # sorted, so most row groups are out of range
    assert some.count() == 20 and 20 <= scanned_rows(some) < 20_000
    # within the range of a row group, but not in its filter of ids
    none = table.read().filter("sensor_id = 's02001'").select("temperature")
    assert scanned_rows(none) == 0


def partition_filters(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("PartitionFilters: [")[1].split("], PushedFilters")[0]


def test_pages_read_and_list_only_their_days(spark, make, table, monkeypatch):
    for days in range(40):
        table.append(aged(make, days, n=3, first_seq=10 * days))
    cut = AS_OF - timedelta(days=20)
    read = []
    found = HistoryTable.read_days
    monkeypatch.setattr(HistoryTable, "read_days", lambda self, days: (read.append(days), found(self, days))[1])
    cursor = scans.Cursor(int(cut.replace(tzinfo=timezone.utc).timestamp()), (0, 0, 0))
    pages = {
        "before": lambda: scans.readings_before(table, cut, 4, "s"), "after": lambda: scans.readings_after(table, cut, 4),
        "cursor": lambda: scans.readings_before_cursor(table, cursor, 4),
        "latest": lambda: scans.latest_reading(table, "s"), "api": lambda: TelemetryApi(table, AS_OF).history(
            "s", before=cut.strftime("%Y-%m-%dT%H:%M:%SZ"), limit=4).readings,
        "range": lambda: scans.readings_in_range(table, cut - timedelta(days=9), cut, 4)}
    plain = table.read()
    wanted = {
        "before": scans.readings_before(plain, cut, 4, "s"), "after": scans.readings_after(plain, cut, 4),
        "cursor": scans.readings_before_cursor(plain, cursor, 4), "latest": scans.latest_reading(plain, "s"),
        "api": scans.readings_before(plain, cut, 4, "s"),
        "range": scans.readings_in_range(plain, cut - timedelta(days=9), cut, 4)}
    for name, page in pages.items():
        read.clear()
        df = page()
        assert "recorded_date#" in partition_filters(df) and partition_filters(df).count("recorded_date") >= 2, name
        assert ">=" in partition_filters(df) and "<=" in partition_filters(df), name
        assert df.collect() == wanted[name].collect(), name
        days = sorted({d for asked in read for d in asked})
        assert len(days) <= 5 and all(abs((d - cut.date()).days) <= 5 or name == "latest" for d in days), (name, days)
    read.clear()
    assert scans.latest_reading(table, "nobody").count() == 0
    # every day once, each step only the days it adds; then the empty page itself
    assert sum(map(len, read[:-1])) <= len(table.days())


def test_retention_job_and_ledger(spark, make, table):
    ledger = work_dir(spark, "ledger")
    table.append(aged(make, 35).union(aged(make, 0, first_seq=10)))
    assert retention.retention_stats(retention.read_retention_ledger(spark, ledger)).first().total_cleanups == 0
    assert retention.run_retention(table, ledger, AS_OF) == 5
    assert retention.run_retention(table, ledger, AS_OF + timedelta(hours=1)) == 0
    with pytest.raises(ValueError):
        retention.run_retention(table, ledger, AS_OF, 0)
    broken = HistoryTable(spark, work_dir(spark, "missing"))
    with pytest.raises(Exception):
        retention.run_retention(broken, ledger, AS_OF + timedelta(hours=2))
    s = retention.retention_stats(retention.read_retention_ledger(spark, ledger)).first()
    assert (s.total_deleted, s.total_cleanups, s.last_delete_count, s.retention_days) == (5, 3, 0, 30)
    assert s.last_cleanup == AS_OF + timedelta(hours=2)


def test_cleanup_period():
    assert [retention.cleanup_period(s) for s in (None, 0, -5, 60)] == [3600, 3600, 3600, 60]


def test_row_at_the_cutoff_stays(make):
    rows = make([("s", i, AS_OF - timedelta(days=30, seconds=s), 20, 50) for i, s in enumerate((-1, 0, 1))])
    assert sorted(r.seq for r in retention.retention_kept(rows, AS_OF).collect()) == [0, 1]
    assert [(str(r.date), r.deleted) for r in retention.retention_deleted(rows, AS_OF).collect()] == [("2023-12-31", 1)]
