from datetime import datetime, timedelta

import pytest

from conftest import AS_OF, minutes_ago
from thermolake.operators import views
from thermolake.plans.api import TelemetryApi


@pytest.fixture(scope="module")
def rows(make):
    """Sensor a: one reading a minute for 12 h; b: only invalid readings; c: one valid reading long ago."""
    return make(
        [("a", 1000 - age, minutes_ago(age), 20 + age % 10, 50) for age in range(720)]
        + [("b", 2000 + i, minutes_ago(i), 99, 50) for i in range(3)]
        + [("c", 1, minutes_ago(60 * 24 * 10), 20, 50)]).cache()


@pytest.fixture(scope="module")
def api(rows):
    return TelemetryApi(rows, AS_OF)


def z(t):
    return t.strftime("%Y-%m-%dT%H:%M:%SZ")


def test_current(api):
    assert api.current().first().sensor_id == "a"
    assert (api.current("a").first().seq, api.current("a").first().source) == (1000, "memory")
    assert (api.current("b").first().seq, api.current("b").first().source) == (2000, "database")
    assert api.current("nobody").collect() == []
    assert {r.sensor_id for r in api.current_all().collect()} == {"a", "b", "c"}


def test_materialised_recent_view_gives_the_same(rows, api):
    view = views.recent_view(rows, 100).drop("arrival_rank")
    other = TelemetryApi(rows, AS_OF, recent=view)
    for sensor in (None, "a", "b", "c"):
        assert other.current(sensor).collect() == api.current(sensor).collect()
    assert sorted(map(tuple, other.current_all().collect())) == sorted(map(tuple, api.current_all().collect()))
    assert other.sensors().collect() == api.sensors().collect()
    assert other.history("a", limit=5).readings.collect() == api.history("a", limit=5).readings.collect()


def test_history_without_times_reads_the_recent_view(api):
    page = api.history("a", limit=500)
    meta = page.metadata().first()
    assert (meta["count"], meta.has_more, meta.source, meta.window_start) == (100, False, "memory", None)
    assert api.history("b").readings.collect() == []
    assert api.history("nobody").metadata().first()["count"] == 0


def test_history_default_sensor_and_limit(api):
    page = api.history()
    found = page.readings.collect()
    assert {r.sensor_id for r in found} == {"a"} and len(found) == 50
    assert found[0].seq == 1000


def test_before_wins_over_after_and_range(api):
    cut = minutes_ago(100)
    page = api.history("a", start=z(AS_OF), end=z(AS_OF), before=z(cut), after=z(AS_OF), limit=5)
    assert [r.seq for r in page.readings.collect()] == [899, 898, 897, 896, 895]
    meta = page.metadata().first()
    assert (meta.window_start, meta.window_end, meta.has_more) == (None, cut, True)
    page = api.history("a", start=z(AS_OF), after=z(cut), limit=5)
    assert [r.seq for r in page.readings.collect()] == [905, 904, 903, 902, 901]
    assert page.metadata().first().window_start == cut


def test_range_defaults(api):
    page = api.history("a", end=z(AS_OF), limit=1000)
    assert page.metadata().first()["count"] == 361
    assert (page.window_start, page.window_end) == (AS_OF - timedelta(hours=6), AS_OF)
    page = api.history("a", start=z(minutes_ago(10)))
    assert (page.window_start, page.window_end) == (minutes_ago(10), AS_OF)


def test_has_more_is_true_for_an_exactly_full_page(api):
    page = api.history("a", start=z(minutes_ago(9)), limit=10)
    assert page.metadata().first().has_more is True
    assert page.has_more_exactly().first().has_more is False
    page = api.history("a", start=z(minutes_ago(10)), limit=10)
    assert page.has_more_exactly().first().has_more is True
    assert all(r["count"] == 10 and r.has_more for r in page.with_metadata().collect())


def test_bad_times_are_refused(api):
    for bad in ("2024-01-30", "now", "2024-01-30 00:00:00"):
        with pytest.raises(ValueError):
            api.history("a", before=bad)


def test_daily_windows(api, make):
    assert {str(r.date) for r in api.daily_stats("a").collect()} == {"2024-01-30", "2024-01-31"}
    assert {r.sensor_id for r in api.daily_stats().collect()} == {"a", "b"}
    assert [r.sensor_id for r in api.daily_stats(start="2024-01-20", end="2024-01-21").collect()] == ["c"]
    days = TelemetryApi(make([("s", h, datetime(2024, 1, 10) + timedelta(hours=h), 20, 50) for h in range(72)]), AS_OF)
    assert [r.reading_count for r in days.daily_stats("s", "2024-01-10", "2024-01-10").collect()] == [24]
    # an end with a time of day is moved by a day as well
    assert [r.reading_count for r in days.daily_stats("s", "2024-01-10", "2024-01-10T06:00:00Z").collect()] == [6, 24]


def test_stats_and_dashboard(api):
    s = api.stats().first()
    assert (s.total_readings, s.unique_sensors, s.current_readings) == (721, 2, 101)
    assert (s.database_total_readings, s.database_unique_sensors) == (724, 3)
    assert api.recent_stats().first().total_readings == 721
    d = api.dashboard().first()
    assert (d.current_sensor_id, d.total_readings, d.unique_sensors, d.current_readings) == ("a", 721, 2, 101)
    assert (d.current_recorded_at, d.last_update, d.has_history) == (AS_OF, AS_OF, True)
    # no fallback to the history here
    assert api.dashboard("b").first().current_sensor_id is None
    assert api.dashboard("c").first().current_recorded_at == minutes_ago(60 * 24 * 10)
    assert [r.sensor_id for r in api.dashboard_sensor_ids().collect()] == ["a", "c"]


def test_latest_readings(api, make):
    assert [r.seq for r in api.latest_readings("a").collect()] == list(range(1000, 990, -1))
    assert api.latest_readings().collect() == []
    own = TelemetryApi(make([("pi-sensor-01", 1, AS_OF, 20, 50)]), AS_OF)
    assert own.latest_readings().count() == 1


def test_empty_engine(make):
    api = TelemetryApi(make([]), AS_OF)
    for df in (api.current(), api.history().readings, api.daily_stats(), api.sensors()):
        assert df.collect() == []
    assert api.dashboard().first().total_readings == 0
    assert api.stats().first().database_total_readings == 0
