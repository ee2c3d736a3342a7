import json
import os
import random
from datetime import timedelta, timezone

import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR, AS_OF, minutes_ago
from thermolake.operators import aggregates, liveness, views
from thermolake.schema import WRITE_LEDGER, stored_by_load
from thermolake.session import work_dir
from thermolake.sources.events import heartbeat_times, load_readings, message_log
from thermolake.sources.loads import LoadTable
from thermolake.streaming import ingest, live
from thermolake.streaming.recent import RecentViewTable
from thermolake.streaming.tables import LiveTable

READING = "seq long, sensor_id string, recorded_at timestamp, temperature double, humidity double, received_at timestamp"


def write_files(spark, frames):
    """One file per frame, with rising modification times."""
    path = work_dir(spark, "files")
    for i, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").json(path)
        new = [f for f in os.listdir(path) if f.endswith(".json") and not f.startswith("_")]
        for name in new:
            full = os.path.join(path, name)
            if os.path.getmtime(full) > 1_700_000_000 + 3600:
                os.utime(full, (1_700_000_000 + i, 1_700_000_000 + i))
    return path


def stream(spark, path, schema=READING):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path)


def view_table(spark, schema, **options):
    kind = live.daily_stats_table if "date" in schema.names else live.last_seen_table
    return kind(spark, work_dir(spark, "view"), schema, **options)


def drain(spark, view, **options):
    table = view_table(spark, view.schema, **options)
    live.start_view(view, table, work_dir(spark, "checkpoint"), available_now=True).awaitTermination()
    return table.view()


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def thirds(spark):
    rows = load_readings(spark, SF_DIR).withColumn("received_at", F.col("recorded_at")).cache()
    return rows, [rows.filter((F.col("seq") % 10 >= a) & (F.col("seq") % 10 < b)) for a, b in ((0, 4), (4, 7), (7, 10))]


@pytest.mark.parametrize("reverse", [False, True])
def test_daily_stats_stream_equals_batch_in_any_file_order(spark, thirds, reverse):
    rows, parts = thirds
    path = write_files(spark, parts[::-1] if reverse else parts)
    found = drain(spark, live.live_daily_stats(stream(spark, path)))
    columns = ["date", "sensor_id", "min_temperature", "max_temperature", "min_humidity", "max_humidity", "reading_count"]
    assert rows_of(found.select(*columns)) == rows_of(aggregates.daily_stats(rows).select(*columns))


@pytest.mark.parametrize("reverse", [False, True])
def test_recent_view_stream_equals_batch(spark, thirds, reverse):
    rows, parts = thirds
    path = write_files(spark, parts[::-1] if reverse else parts)
    view = RecentViewTable(spark, work_dir(spark, "recent"), 8)
    view.start(stream(spark, path), work_dir(spark, "checkpoint"), available_now=True).awaitTermination()
    columns = ["seq", "sensor_id", "recorded_at", "humidity", "temperature"]
    assert rows_of(view.read().select(*columns)) == rows_of(views.recent_view(rows, 8).select(*columns))


def test_recent_view_batches(spark, make):
    view = RecentViewTable(spark, work_dir(spark, "recent"), 3, upkeep_every=2, merge_at=2)
    assert view.read().count() == 0
    batches = [make([("s", 10 * n + i, minutes_ago(0), 20, 50) for i in range(2)]) for n in range(6)]
    for n, batch in enumerate(batches):
        view.merge(batch, n, "job")
        view.merge(batch, n, "job")
        assert sorted(r.seq for r in view.read().collect()) == [
            s for m in range(n + 1) for s in (10 * m, 10 * m + 1)][-3:]
    view.clear()
    assert view.read().count() == 0
    view.merge(batches[0], 6, "job")
    assert sorted(r.seq for r in view.read().collect()) == [0, 1]


def test_fresh_checkpoint_does_not_make_the_view_stale(spark, make):
    view = RecentViewTable(spark, work_dir(spark, "recent"), 3)
    for n in range(8):
        view.merge(make([("s", n, minutes_ago(0), 20, 50)]), n, "first")
    view.merge(make([("s", 100, minutes_ago(0), 20, 50), ("t", 101, minutes_ago(0), 20, 50)]), 0, "second")
    assert sorted(r.seq for r in view.read().collect()) == [6, 7, 100, 101]


def test_live_tables_follow_the_keys_not_the_batches(spark, make):
    view = RecentViewTable(spark, work_dir(spark, "recent"), 2, upkeep_every=4, merge_at=3)
    most = 0
    for n in range(24):
        view.merge(make([("s", n, minutes_ago(0), 20, 50), ("t", 100 + n, minutes_ago(0), 20, 50)]), n, "job")
        most = max(most, len(view.table.loads("")))
    assert most <= 10 and sorted(r.seq for r in view.read().collect()) == [22, 23, 122, 123]
    # of the folded batches only what the view still needs is stored
    assert view.table.read().count() <= 4 + 2 * 4


def test_two_jobs_that_merge_at_once_lose_nothing(spark, make):
    """Steps of one job's merge between those of another's."""
    view = RecentViewTable(spark, work_dir(spark, "recent"), 50, upkeep_every=2, merge_at=2)
    write = LiveTable.write

    def interleaved(self, rows, counted=None):
        if not inside:
            inside.append(1)
            view.merge(make([("s", 1000 + n, minutes_ago(0), 20, 50)]), n, "other")
            inside.clear()
        write(self, rows, counted)

    inside, n = [], 0
    LiveTable.write = interleaved
    try:
        for n in range(6):
            view.merge(make([("s", n, minutes_ago(0), 20, 50)]), n, "job")
    finally:
        LiveTable.write = write
    assert sorted(r.seq for r in view.read().collect()) == [*range(6), *range(1000, 1006)]


def test_two_streams_at_once(spark, thirds):
    rows, parts = thirds
    views_ = [live.live_daily_stats(stream(spark, write_files(spark, [p.filter(F.col("seq") % 2 == i) for p in parts])))
              for i in (0, 1)]
    table = view_table(spark, views_[0].schema, upkeep_every=2, merge_at=2)
    jobs = [live.start_view(v, table, work_dir(spark, "checkpoint"), available_now=True) for v in views_]
    for job in jobs:
        job.awaitTermination()
    columns = ["date", "sensor_id", "min_temperature", "max_humidity", "reading_count", F.round("avg_humidity", 6)]
    assert rows_of(table.view().select(*columns)) == rows_of(aggregates.daily_stats(rows).select(*columns))


def test_last_seen_stream(spark, thirds):
    rows, parts = thirds
    schema = "event_type string, sensor_id string, recorded_at timestamp"
    path = write_files(spark, parts[::-1])
    found = drain(spark, live.live_last_seen(heartbeat_times(stream(spark, path, schema))))
    wanted = heartbeat_times(rows).groupBy("sensor_id").agg(F.max("received_at"))
    assert rows_of(found.select("sensor_id", "last_seen")) == rows_of(wanted)


def test_one_wrong_clock_does_not_drop_good_rows(spark, make):
    ahead = make([("s", 1, AS_OF + timedelta(days=365), 20, 50)]).withColumn("received_at", F.lit(AS_OF))
    good = [make([("s", 10 * i + k, AS_OF - timedelta(hours=k), 20, 50) for k in range(5)]).withColumn(
        "received_at", F.col("recorded_at")) for i in (1, 2)]
    path = write_files(spark, [ahead, *good])
    count = lambda df: sum(r.reading_count for r in df.collect())
    guarded = live.live_daily_stats(stream(spark, path), 30, clock_tolerance_seconds=3600)
    assert count(drain(spark, guarded)) == 10
    by_default = live.live_daily_stats(stream(spark, path), 30)
    assert count(drain(spark, by_default)) == 10


def test_rows_ahead_of_the_clock_are_counted(spark, make):
    rows = make([("s", 1, AS_OF + timedelta(days=365), 20, 50), ("s", 2, AS_OF, 20, 50)]).withColumn(
        "received_at", F.lit(AS_OF))
    view = live.live_daily_stats(stream(spark, write_files(spark, [rows])))
    table = view_table(spark, view.schema)
    query = live.start_view(view, table, work_dir(spark, "checkpoint"), available_now=True)
    query.awaitTermination()
    seen = [p["observedMetrics"].get("ahead_of_clock") for p in query.recentProgress]
    assert sum(m["rows"] for m in seen if m) == 1


def test_result_table_does_not_grow_with_batches(spark, thirds):
    rows, parts = thirds
    for frames in ([rows], parts):
        view = live.live_last_seen(heartbeat_times(stream(spark, write_files(spark, frames),
                                                          "event_type string, sensor_id string, recorded_at timestamp")))
        found = drain(spark, view)
        assert found.count() == heartbeat_times(rows).select("sensor_id").distinct().count()


def test_empty_sensor_id_is_nobody(spark, make):
    rows = make([("", 1, AS_OF, 20, 50), ("s", 2, AS_OF, 20, 50)]).withColumn("event_type", F.lit("signup"))
    view = live.live_last_seen(heartbeat_times(stream(
        spark, write_files(spark, [rows]), "event_type string, sensor_id string, recorded_at timestamp")))
    assert [r.sensor_id for r in drain(spark, view).collect()] == ["s"]


def split_log(spark, log, n):
    return write_files(spark, [log.filter(F.col("seq") % n == i) for i in range(n)])


def test_ingest_end_to_end(spark):
    log = message_log(spark, SF_DIR).withColumn("part", F.lit(0)).select("seq", "part", "received_at", "value").cache()
    extra = spark.createDataFrame([(10**6, 0, AS_OF, "{broken"), (10**6 + 1, 0, AS_OF, '{"type":"config","payload":{}}')], log.schema)
    path = split_log(spark, log.union(extra), 3)
    tables = ingest.TelemetryTables(spark, work_dir(spark, "tables"))
    view = RecentViewTable(spark, work_dir(spark, "recent"), 4)
    query = ingest.start_ingest(
        ingest.read_log_files(spark, path, 1), tables, work_dir(spark, "checkpoint"), available_now=True,
        on_valid=view.merge)
    query.awaitTermination()
    rows = load_readings(spark, SF_DIR)
    decoded = rows.filter(F.col("event_type").isin("click", "purchase", "view"))
    columns = ["sensor_id", "recorded_at", "humidity", "temperature"]
    assert rows_of(tables.history.read().select(*columns)) == rows_of(decoded.select(*columns))
    assert tables.heartbeats().count() == rows.filter("event_type = 'signup'").count()
    reasons = {r.reason: r["count"] for r in tables.quarantine().groupBy("reason").count().collect()}
    control = [rows.filter(f"event_type = 'error' AND level % {n} = 0").count() for n in (1, 9, 11)]
    assert reasons == {"bad_envelope": 1, "unknown_type": sum(control) + 1}
    stats = ingest.write_stats(tables.ledger()).first()
    assert (stats.total_written, stats.total_batches, stats.total_errors) == (decoded.count(), 3, 0)
    assert stats.last_write_time is not None
    # arrival order in the history is that of the messages
    wanted = views.recent_view(tables.history.read(), 4)
    assert rows_of(view.read().select("seq", *columns)) == rows_of(wanted.select("seq", *columns))


def envelope(seq, t):
    return json.dumps({"type": "reading", "payload": {
        "sensor_id": "s", "timestamp": t.strftime("%Y-%m-%dT%H:%M:%SZ"), "humidity": 50, "temperature": seq}})


def test_batch_run_again_replaces_itself(spark, log):
    tables = ingest.TelemetryTables(spark, work_dir(spark, "tables"))
    first = log([envelope(i, minutes_ago(i * 600)) for i in range(6)])
    for _ in range(2):
        ingest.write_batch(tables, first, 0)
    ingest.write_batch(tables, log([envelope(9, minutes_ago(0))]), 1)
    assert tables.history.read().count() == 7
    stats = ingest.write_stats(tables.ledger()).first()
    assert (stats.total_written, stats.total_batches) == (7, 2)


def test_batch_without_readings(spark, log):
    tables = ingest.TelemetryTables(spark, work_dir(spark, "tables"))
    ingest.write_batch(tables, log(['{"type":"heartbeat","payload":{"sensor_id":"s"}}']), 0)
    ingest.write_batch(tables, log(["{broken"]), 1)
    assert tables.history.read().count() == 0 and tables.heartbeats().count() == 1
    stats = ingest.write_stats(tables.ledger()).first()
    assert (stats.total_written, stats.total_batches, stats.last_write_time) == (0, 0, None)


def test_failed_batch_is_counted_then_succeeds(spark, log):
    tables = ingest.TelemetryTables(spark, work_dir(spark, "tables"))
    batch = log([envelope(1, minutes_ago(0))])

    def fail(df, batch_id):
        raise RuntimeError("view is down")

    with pytest.raises(RuntimeError):
        ingest.write_batch(tables, batch, 0, fail)
    ingest.write_batch(tables, batch, 0)
    stats = ingest.write_stats(tables.ledger()).first()
    assert (stats.total_written, stats.total_batches, stats.total_errors) == (1, 1, 1)
    assert tables.history.read().count() == 1


def test_fresh_tables_are_empty(spark):
    tables = ingest.TelemetryTables(spark, work_dir(spark, "tables"))
    assert tables.heartbeats().count() == tables.quarantine().count() == tables.ledger().count() == 0


def test_two_jobs_and_a_fresh_checkpoint_lose_nothing(spark, log):
    tables = ingest.TelemetryTables(spark, work_dir(spark, "tables"))
    first = log([envelope(i, minutes_ago(i)) for i in range(5)]).coalesce(1)
    second = log([envelope(100 + i, minutes_ago(i)) for i in range(3)]).coalesce(1)
    for rows in (first, second):
        path = work_dir(spark, "log")
        rows.write.json(path)
        ingest.start_ingest(ingest.read_log_files(spark, path), tables, work_dir(spark, "checkpoint"),
                            available_now=True).awaitTermination()
    assert tables.history.read().count() == 8
    assert ingest.write_stats(tables.ledger()).first().total_batches == 2


def test_compaction_survives_a_batch_run_again(spark, log):
    tables = ingest.TelemetryTables(spark, work_dir(spark, "tables"))
    batches = [log([envelope(10 * b + i, AS_OF - timedelta(days=3 + i)) for i in range(3)]) for b in range(3)]
    for n, batch in enumerate(batches):
        ingest.write_batch(tables, batch, n, job="job")
    for day in (28, 27, 26):
        tables.history.compact_day(f"2024-01-{day}")
    ingest.write_batch(tables, batches[2], 2, job="job")
    assert tables.history.read().count() == 9


def test_upkeep_bounds_the_folders_of_a_long_job(spark, log):
    """What is run again doubles nothing, in no table."""
    tables = ingest.TelemetryTables(spark, work_dir(spark, "tables"), merge_at=4)
    beat = '{"type":"heartbeat","payload":{"sensor_id":"s"}}'
    batch = log([envelope(1, AS_OF), envelope(2, AS_OF - timedelta(days=1)), beat, "{broken"]).cache()
    all_tables = (tables.history, tables.heartbeat_table, tables.quarantine_table, tables.ledger_table)
    most = 0
    for n in range(30):
        for _ in range(2 if n in (9, 10, 17) else 1):
            ingest.write_batch(tables, batch, n, job="job", upkeep_every=5)
        most = max([most, *[len(t.loads(f)) for t in all_tables for f in t.folders()]])
    assert most <= 16, most
    assert tables.history.read().count() == 60
    assert tables.heartbeats().count() == tables.quarantine().count() == 30
    stats = ingest.write_stats(tables.ledger()).first()
    assert (stats.total_written, stats.total_batches) == (60, 30)


def test_upkeep_over_200_loads(spark):
    table = LoadTable(spark, work_dir(spark, "ledger"), stored_by_load(WRITE_LEDGER))
    most = 0
    for n in range(200):
        row = spark.range(1).selectExpr(
            "'job' AS job", f"{n}L AS batch_id", "1L AS rows_written", "'ok' AS status", "now() AS written_at",
            f"'job-{n}' AS load_id")
        table.write(row)
        if n % 10 == 9:
            table.write(row)
            table.upkeep()
        most = max(most, len(table.loads("")))
    assert most <= 2 * (16 + 10) and table.read().count() == 200
    assert table.read().select("batch_id").distinct().count() == 200


def test_every_failure_is_counted(spark, log):
    tables = ingest.TelemetryTables(spark, work_dir(spark, "tables"))

    def fail(df, batch_id):
        raise RuntimeError("view is down")

    for _ in range(2):
        with pytest.raises(RuntimeError, match="view is down"):
            ingest.write_batch(tables, log([envelope(1, minutes_ago(0))]), 0, fail)
    assert ingest.write_stats(tables.ledger()).first().total_errors == 2


def test_backlog_is_what_is_not_taken_yet():
    class Query:
        lastProgress = {"sources": [{"latestOffset": '{"t": {"0": 50, "1": 7}}', "endOffset": {"t": {"0": 40, "1": 7}}}]}

    assert ingest.queue_length(Query()) == 10
    Query.lastProgress = {"sources": [{"latestOffset": None, "endOffset": {"logOffset": 3}}]}
    assert ingest.queue_length(Query()) is None
    Query.lastProgress = None
    assert ingest.queue_length(Query()) == 0


BEAT = "sensor_id string, received_at timestamp"


def beat_files(spark, batches):
    frames = [spark.createDataFrame([(s, t.replace(tzinfo=timezone.utc)) for s, t in rows], BEAT) for rows in batches]
    return stream(spark, write_files(spark, frames), BEAT)


def logged(spark, rows, **options):
    table = live.log_table(spark, work_dir(spark, "log"), rows.schema, merge_at=2)
    live.start_log(rows, table, work_dir(spark, "checkpoint"), available_now=True, **options).awaitTermination()
    return table


@pytest.mark.parametrize("reverse", [False, True])
def test_streamed_sessions_equal_batch(spark, reverse):
    rng = random.Random(6)
    times = sorted(AS_OF + timedelta(seconds=rng.choice([30, 60, 61, 600]) * i + rng.randrange(3)) for i in range(120))
    rows = [(rng.choice("ab"), t) for t in times] + [("a", AS_OF), ("a", AS_OF + timedelta(seconds=60))]
    parts = [rows[i::3] if reverse else sorted(rows, key=lambda r: r[1])[40 * i:40 * i + 50] for i in range(3)]
    end = [("clock", AS_OF + timedelta(days=30))]
    given = [r for p in parts for r in p]
    table = logged(spark, live.live_sessions(beat_files(spark, [*(parts[::-1] if reverse else parts), end]), 60, 86400 * 2),
                   upkeep_every=1)
    batch = liveness.heartbeat_sessions(
        spark.createDataFrame([(s, t.replace(tzinfo=timezone.utc)) for s, t in given], BEAT), 60)
    assert rows_of(table.read().drop("load_id")) == rows_of(batch.drop("session_no"))


def test_silence_is_reported_without_a_next_heartbeat(spark):
    batches = [[("a", AS_OF), ("b", AS_OF)], [("b", AS_OF + timedelta(seconds=s)) for s in (8, 16, 24, 32)]]
    found = logged(spark, live.live_silences(beat_files(spark, batches), 10, 0)).read()
    # b goes on, so only a has fallen silent by the last heartbeat
    assert [(r.sensor_id, r.silent_since, r.noticed_at) for r in found.collect()] == [
        ("a", AS_OF, AS_OF + timedelta(seconds=10))]


def test_rows_ahead_of_the_clock_go_to_a_table_of_their_own(spark, log):
    tables = ingest.TelemetryTables(spark, work_dir(spark, "tables"))
    batch = log([envelope(1, AS_OF), envelope(2, AS_OF + timedelta(hours=1)), envelope(3, AS_OF + timedelta(seconds=3601))],
                received_at=AS_OF.strftime("%Y-%m-%d %H:%M:%S"))
    for _ in range(2):
        ingest.write_batch(tables, batch, 0, job="job")
    assert [(r.seq, r.ahead_seconds) for r in tables.ahead().collect()] == [(3, 3601)]
    assert tables.history.read().count() == 3
