from datetime import timedelta

import pytest
from conftest import AS_OF
from pyspark.sql import functions as F

from thermolake.operators import aggregates
from thermolake.plans import retention
from thermolake.plans.api import TelemetryApi
from thermolake.session import work_dir
from thermolake.sources.history import HistoryTable
from thermolake.sources.summaries import DaySummaries


@pytest.fixture
def both(spark):
    """A history table, its summaries, and a way to append to both."""
    history = HistoryTable(spark, work_dir(spark, "readings"), merge_at=2).create()
    summaries = DaySummaries(spark, work_dir(spark, "summaries"), merge_at=2)

    def append(rows, load):
        history.append(rows, load)
        summaries.add(rows, load, sketched=True)

    return history, summaries, append


def some(make, first, n=40):
    return make([(f"s{i % 7}", first + i, AS_OF - timedelta(hours=5 * i, seconds=first), 90 if i % 9 == 0 else i, 50)
                 for i in range(n)])


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def daily(df):
    return rows_of(df.select("date", "sensor_id", "min_temperature", "max_humidity", F.round("avg_temperature", 6),
                             "reading_count"))


def same(history, summaries):
    read = history.read()
    assert rows_of(summaries.storage_stats()) == rows_of(aggregates.storage_stats(read))
    assert rows_of(summaries.recent_totals(3)) == rows_of(aggregates.recent_totals(read, 3))
    assert rows_of(summaries.sensor_ids()) == rows_of(aggregates.sensor_ids(read))
    assert daily(summaries.daily_stats()) == daily(aggregates.daily_stats(read))


def test_totals_equal_those_of_the_readings(spark, make, both):
    history, summaries, append = both
    assert summaries.storage_stats().first().total_readings == 0
    assert summaries.approximate_sensors().first().unique_sensors == 0
    for n in range(5):
        append(some(make, 100 * n), f"job-{n}")
    append(some(make, 400), "job-4")  # run again
    same(history, summaries)
    for _ in range(2):
        history.upkeep()
        summaries.upkeep()
        same(history, summaries)
    stored = summaries.table.read()
    assert stored.count() < 5 * summaries.read().count()
    assert summaries.approximate_sensors().first().unique_sensors == 7


def test_retention_follows_the_history(spark, make, both):
    history, summaries, append = both
    for n in range(3):
        append(some(make, 100 * n), f"job-{n}")
    ledger = work_dir(spark, "ledger")
    for hour in (0, 9):
        retention.run_retention(history, ledger, AS_OF + timedelta(hours=hour), 4, summaries=summaries)
        same(history, summaries)
    before = history.read().count()
    append(some(make, 900, 3), "job-3")
    assert history.read().count() == before + 3
    same(history, summaries)


def test_estimate_is_within_its_error(spark, both):
    _, summaries, _ = both
    rows = spark.range(20_000).selectExpr(
        "id AS seq", "concat('s', id % 9000) AS sensor_id", "timestamp'2024-01-30' + make_dt_interval(id % 3) AS recorded_at",
        "20D AS temperature", "50D AS humidity")
    summaries.add(rows, "job-0", sketched=True)
    assert abs(summaries.approximate_sensors().first().unique_sensors - 9000) < 9000 * 0.05


def test_api_reads_no_readings(spark, make, both):
    history, summaries, append = both
    for n in range(2):
        append(some(make, 100 * n), f"job-{n}")
    plain = TelemetryApi(history, AS_OF, capacity=3)
    api = TelemetryApi(history, AS_OF, capacity=3, summaries=summaries)
    assert api.stats().columns == plain.stats().columns or set(api.stats().columns) == set(plain.stats().columns)
    assert api.stats().select(*plain.stats().columns).collect() == plain.stats().collect()
    assert api.default_sensor().collect() == plain.default_sensor().collect()
    assert rows_of(api.sensors()) == rows_of(plain.sensors())
    for df in (api.default_sensor(), api.sensors(), summaries.storage_stats()):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "humidity" not in plan.split("Relation")[-1] or "readings" in plan
        assert not [f for f in df.inputFiles() if f.startswith(f"file:{history.path}")]
