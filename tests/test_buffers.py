import random
from collections import deque

import pytest

from conftest import minutes_ago
from thermolake.operators import buffers, packing, replay
from thermolake.operators.ranking import first_n_per_key, newest_arrivals, number_rows
from pyspark.sql import functions as F


def ring(make, temps, sensor="s"):
    return make([(sensor, i, minutes_ago(100 - i), t, 50) for i, t in enumerate(temps)])


def temps(df):
    return [r.temperature for r in df.orderBy("position").collect()]


def test_drop_modes(make):
    rows = ring(make, (20, 21, 22, 99))
    assert temps(buffers.buffer_contents(rows, 3, True)) == [21, 22, 99]
    assert temps(buffers.buffer_contents(rows, 3, False)) == [20, 21, 22]


def test_peek_and_pop(make):
    rows = ring(make, (20, 21, 22, 23, 24))
    assert temps(buffers.buffer_peek(rows, 3, 10)) == [20, 21, 22]
    popped = buffers.buffer_pop(rows, 3, 10)
    assert temps(popped.filter("taken")) == [20, 21, 22]
    assert temps(popped.filter("not taken")) == [23, 24]
    assert temps(buffers.buffer_peek(rows, 99, 10)) == [20, 21, 22, 23, 24]


def test_stats(make):
    rows = ring(make, (20, 21, 22, 23, 24))
    s = buffers.buffer_stats(rows, 3, True).first()
    assert (s.total_pushed, s.total_dropped, s.high_water_mark, s.size, s.is_full) == (5, 2, 3, 3, True)
    assert s.summary == "Buffer[3/3, dropped: 2, mode: drop-oldest]"
    assert s.last_push_time == s.last_drop_time == minutes_ago(96)
    s = buffers.buffer_stats(rows, 3, False).first()
    assert (s.total_pushed, s.total_dropped, s.high_water_mark) == (3, 2, 3)
    assert (s.last_push_time, s.last_drop_time) == (minutes_ago(98), minutes_ago(96))
    assert s.summary == "Buffer[3/3, dropped: 2, mode: drop-newest]"
    s = buffers.buffer_stats(rows, 10, True).first()
    assert (s.total_dropped, s.last_drop_time, s.is_full, s.size) == (0, None, False, 5)


def test_hot_sensor_is_ranked_in_lanes(spark, make):
    hot = spark.range(5000).select(F.col("id").alias("seq"), F.lit("hot").alias("sensor_id"))
    cold = spark.range(40).select((F.col("id") + 5000).alias("seq"), F.concat(F.lit("c"), F.col("id") % 4).alias("sensor_id"))
    top = newest_arrivals(hot.union(cold), 7)
    # cut before and after each of the two shuffles
    assert top._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 4
    found = {}
    for r in top.collect():
        found.setdefault(r.sensor_id, []).append((r["rank"], r.seq))
    assert sorted(found["hot"]) == [(i + 1, 4999 - i) for i in range(7)]
    assert len(found) == 5 and all(len(v) == 7 for v in found.values())


def test_limits_beyond_the_group_limit_threshold(spark):
    rows = spark.range(3000).select(F.col("id").alias("seq"), F.lit("s").alias("sensor_id"))
    assert first_n_per_key(rows, "sensor_id", [F.asc("seq")], 2500).count() == 2500


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_number_rows_across_blocks(spark, block):
    seqs = sorted(random.Random(1).sample(range(500), 90))
    rows = spark.createDataFrame([(q, f"s{q % 3}") for q in seqs], "seq long, sensor_id string")
    expected, counts = {}, {}
    for q in seqs:
        counts[q % 3] = counts.get(q % 3, 0) + 1
        expected[q] = counts[q % 3]
    assert {r.seq: r.row_no for r in number_rows(rows, ["sensor_id"], block=block).collect()} == expected
    overall = {r.seq: r.row_no for r in number_rows(rows, [], block=block).collect()}
    assert overall == {q: i + 1 for i, q in enumerate(seqs)}


@pytest.mark.parametrize("block", [13, 1_000_000])
def test_pack_batches(make, block):
    rows = ring(make, range(107))
    batches = packing.pack_batches(rows, 50, block).orderBy("batch_no").collect()
    assert [b["count"] for b in batches] == [50, 50, 7]
    assert [r.temperature for b in batches for r in b.readings] == [float(t) for t in range(107)]
    assert packing.pack_batches(make([])).collect() == []


class Ring:
    """The rule that a replay must follow."""

    def __init__(self, capacity, drop_oldest):
        self.rows, self.capacity, self.drop_oldest = deque(), capacity, drop_oldest
        self.pushed = self.dropped = self.popped = self.high = 0

    def push(self, seq):
        if len(self.rows) >= self.capacity:
            self.dropped += 1
            if not self.drop_oldest:
                return
            self.rows.popleft()
        self.rows.append(seq)
        self.pushed += 1
        self.high = max(self.high, len(self.rows))

    def pop(self, n):
        for _ in range(min(n, len(self.rows))):
            self.rows.popleft()
            self.popped += 1


@pytest.mark.parametrize("drop_oldest", [True, False])
@pytest.mark.parametrize("seed, block", [(1, 17), (2, 64), (3, 1_000_000)])
def test_replay_follows_the_rule(spark, seed, block, drop_oldest):
    rng = random.Random(seed)
    capacity = rng.randint(3, 9)
    events, rings = [], {}
    for seq in range(600):
        sensor = "hot" if rng.random() < 0.6 else f"s{rng.randint(0, 4)}"
        pop = rng.randint(0, 12) if rng.random() < 0.2 else None
        events.append((sensor, seq, pop))
        r = rings.setdefault(sensor, Ring(capacity, drop_oldest))
        r.push(seq) if pop is None else r.pop(pop)
    log = spark.createDataFrame(events, "sensor_id string, seq long, pop_count int")
    replayed = replay.replay_buffer(log, capacity, drop_oldest, block)
    stats = {r.sensor_id: (r.total_pushed, r.total_dropped, r.total_popped, r.high_water_mark, r["size"])
             for r in replay.replay_stats(replayed).collect()}
    assert stats == {k: (r.pushed, r.dropped, r.popped, r.high, len(r.rows)) for k, r in rings.items()}
    left = {}
    for row in replay.replay_contents(replayed, capacity).collect():
        left.setdefault(row.sensor_id, set()).add(row.seq)
    assert left == {k: set(r.rows) for k, r in rings.items() if r.rows}


def test_replay_over_many_arrow_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    try:
        test_replay_follows_the_rule(spark, 5, 1_000_000, True)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_push_only_replay_equals_closed_form(make):
    rows = ring(make, range(40))
    log = rows.select("sensor_id", "seq", F.lit(None).cast("int").alias("pop_count"))
    for drop_oldest in (True, False):
        kept = replay.replay_contents(replay.replay_buffer(log, 6, drop_oldest), 6)
        held = buffers.buffer_contents(rows, 6, drop_oldest)
        assert {r.seq for r in kept.collect()} == {r.seq for r in held.collect()}
