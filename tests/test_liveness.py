import random
from datetime import datetime, timedelta, timezone

from conftest import AS_OF
from thermolake.operators import liveness

T0 = datetime(2024, 1, 10, 23, 50)


def beats(spark, rows):
    return spark.createDataFrame([(s, t.replace(tzinfo=timezone.utc)) for s, t in rows],
                                 "sensor_id string, received_at timestamp")


def test_last_seen_and_active(spark):
    df = beats(spark, [("a", AS_OF - timedelta(seconds=s)) for s in (60, 300)] + [("b", AS_OF - timedelta(seconds=61))])
    assert {r.sensor_id: r.last_seen for r in liveness.last_seen(df).collect()} == {
        "a": AS_OF - timedelta(seconds=60), "b": AS_OF - timedelta(seconds=61)}
    assert [r.sensor_id for r in liveness.active_sensors(df, AS_OF, 60).collect()] == ["a"]


def expected(rows, timeout):
    gaps, sessions = set(), {}
    for sensor in {s for s, _ in rows}:
        times = sorted(t for s, t in rows if s == sensor)
        number, previous = 0, None
        for t in times:
            if previous is None or (t - previous).total_seconds() > timeout:
                number += 1
                if previous is not None:
                    gaps.add((sensor, previous, t, int((t - previous).total_seconds())))
            first, _, n = sessions.get((sensor, number), (t, t, 0))
            sessions[sensor, number] = (first, t, n + 1)
            previous = t
    return gaps, sessions


def test_gaps_and_sessions_cross_midnight_and_empty_days(spark):
    rng = random.Random(4)
    rows, t = [], T0
    for _ in range(300):
        t += timedelta(seconds=rng.choice([0, 20, 40, 59, 60, 61, 600, 90_000, 200_000] if rng.random() < 0.3 else [30]))
        rows.append((rng.choice(["a", "a", "b"]), t))
    gaps, sessions = expected(rows, 60)
    df = beats(spark, rows)
    assert {(r.sensor_id, r.previous_at, r.received_at, r.gap_seconds)
            for r in liveness.heartbeat_gaps(df, 60).collect()} == gaps
    assert {(r.sensor_id, r.session_no): (r.connected_at, r.last_seen, r.heartbeat_count)
            for r in liveness.heartbeat_sessions(df, 60).collect()} == sessions


def test_silence_that_still_lasts(spark):
    rows = [("a", AS_OF - timedelta(seconds=s)) for s in (300, 100)] + [("b", AS_OF - timedelta(seconds=60)), (
        "c", AS_OF - timedelta(seconds=61)), ("c", AS_OF + timedelta(seconds=5)), ("", AS_OF - timedelta(days=1))]
    found = {(r.sensor_id, r.received_at): r.gap_seconds
             for r in liveness.heartbeat_gaps(beats(spark, rows), 60, AS_OF).collect()}
    # exactly the timeout is no silence; what comes after as_of is not known yet
    assert found == {("a", AS_OF - timedelta(seconds=100)): 200, ("a", None): 100, ("c", None): 61}
    assert liveness.heartbeat_gaps(beats(spark, rows), 60).filter("received_at IS NULL").count() == 0
    assert liveness.open_silences(beats(spark, rows[:0] + [("x", AS_OF)]), AS_OF, 60).count() == 0
