import json

from pyspark.sql import functions as F

from conftest import AS_OF
from thermolake.operators.packing import pack_batches
from thermolake.sources import envelopes as env
from thermolake.streaming.ingest import from_broker

GOOD = {"sensor_id": "s", "timestamp": "2024-01-02T03:04:05Z", "humidity": 45, "temperature": 22.5}


def message(kind, payload, **more):
    return json.dumps({"type": kind, "payload": payload, "timestamp": "2024-01-02T03:04:06Z", **more})


def outcomes(log, texts):
    """Per message ('ok', decoded rows) or ('bad', problem)."""
    parsed = env.parse_envelopes(log(texts)).persist()
    found = {r.seq: ("bad", r.problem) if r.problem else ("ok", []) for r in parsed.select("seq", "problem").collect()}
    rows = env.decode_readings(parsed).withColumn("at", F.col("recorded_at").cast("string")).drop("recorded_at")
    for r in rows.orderBy("seq", "pos").collect():
        found[r.seq][1].append((r.sensor_id, r.at, r.humidity, r.temperature))
    parsed.unpersist()
    return [found[i + 1] for i in range(len(texts))]


def outcome(log, text):
    return outcomes(log, [text])[0]


ZERO = ("", "0001-01-01 00:00:00", 0.0, 0.0)


SINGLE = [
    (GOOD, [("s", "2024-01-02 03:04:05", 45.0, 22.5)]),
    ({**GOOD, "extra": [1, 2]}, [("s", "2024-01-02 03:04:05", 45.0, 22.5)]),
    ({"sensor_id": "s"}, [("s", "0001-01-01 00:00:00", 0.0, 0.0)]),
    ({**GOOD, "humidity": None}, [("s", "2024-01-02 03:04:05", 0.0, 22.5)]),
    ({**GOOD, "timestamp": "2024-01-02T03:04:05.999+02:00"}, [("s", "2024-01-02 01:04:05", 45.0, 22.5)]),
    ({**GOOD, "temperature": 1e-3}, [("s", "2024-01-02 03:04:05", 45.0, 0.001)]),
    ({}, [ZERO]),
    (None, [ZERO]),
    ({**GOOD, "humidity": "45"}, "undecodable_payload"),
    ({**GOOD, "sensor_id": 5}, "undecodable_payload"),
    ({**GOOD, "temperature": True}, "undecodable_payload"),
    ({**GOOD, "temperature": [1]}, "undecodable_payload"),
    ({**GOOD, "timestamp": "2024-01-02"}, "undecodable_payload"),
    ({**GOOD, "timestamp": "2024-01-02T03:04:05"}, "undecodable_payload"),
    ({**GOOD, "timestamp": 1704164645}, "undecodable_payload"),
    ([GOOD], "undecodable_payload"),
    ("text", "undecodable_payload"),
    (7, "undecodable_payload"),
]


def test_single_reading(log):
    found = outcomes(log, [message("reading", payload) for payload, _ in SINGLE])
    for (payload, expected), verdict in zip(SINGLE, found):
        assert verdict == (("bad", expected) if isinstance(expected, str) else ("ok", expected)), payload


def test_number_out_of_range_is_undecodable(log):
    text = message("reading", GOOD).replace("22.5", "1e400")
    assert outcome(log, text) == ("bad", "undecodable_payload")


BAD = [
    ("{broken", "bad_envelope"), ("", "bad_envelope"), ("[1]", "bad_envelope"), ("5", "bad_envelope"),
    (None, "bad_envelope"),
    ('{"type": 5, "payload": {}}', "bad_envelope"),
    ('{"type": "reading", "payload": {}, "timestamp": "soon"}', "bad_envelope"),
    ('{"type": "reading"}', "undecodable_payload"),
    ('{"type": "surprise", "payload": {}}', "unknown_type"),
    ('{"payload": {}}', "unknown_type"), ("null", "unknown_type"),
    (message("ack", {"status": "ok"}), "unknown_type"),
]


def test_bad_messages_are_kept_apart(log):
    assert outcomes(log, [text for text, _ in BAD]) == [("bad", problem) for _, problem in BAD]


BATCHES = [
    ({"readings": [GOOD, {**GOOD, "humidity": 46}], "count": 2}, 2),
    ({"readings": [GOOD, None], "count": 2}, 2),
    ({"readings": [], "count": 0}, 0), ({"readings": None}, 0), ({}, 0), (None, 0),
    ({"readings": [GOOD, {**GOOD, "humidity": "46"}], "count": 2}, None),
    ({"readings": [GOOD, 5], "count": 2}, None),
    ({"readings": [GOOD], "count": "1"}, None), ({"readings": [GOOD], "count": 1.5}, None),
    ({"readings": GOOD}, None),
]


def test_batch_is_taken_whole_or_not_at_all(log):
    found = outcomes(log, [message("batch", payload) for payload, _ in BATCHES])
    for (payload, n), (verdict, rows) in zip(BATCHES, found):
        assert (verdict, rows if n is None else len(rows)) == (
            ("bad", "undecodable_payload") if n is None else ("ok", n)), payload


def test_declared_count_is_only_compared(log):
    texts = [message("batch", {"readings": [GOOD] * 3, "count": c}) for c in (3, 7)]
    rows = env.decode_readings(env.parse_envelopes(log(texts))).collect()
    assert len(rows) == 6
    assert {(r.seq, r.count_matches) for r in rows} == {(1, True), (2, False)}
    assert [r.pos for r in sorted(rows, key=lambda r: (r.seq, r.pos))] == [0, 1, 2, 0, 1, 2]


def test_one_bad_message_does_not_end_the_log(log):
    parsed = env.parse_envelopes(log([message("reading", GOOD), "{broken", message("reading", GOOD)]))
    assert env.decode_readings(parsed).count() == 2
    kept = env.quarantined(parsed).collect()
    assert [(r.seq, r.value, r.reason) for r in kept] == [(2, "{broken", "bad_envelope")]


def test_heartbeats(log):
    texts = [message("heartbeat", p) for p in (
        {"sensor_id": "s", "uptime": 60, "buffer_size": 3}, {"sensor_id": "t"}, {"uptime": 1.5}, {"uptime": "1"}, None)]
    parsed = env.parse_envelopes(log(texts))
    assert [(r.seq, r.sensor_id, r.uptime, r.buffer_size) for r in env.decode_heartbeats(parsed).orderBy("seq").collect()] == [
        (1, "s", 60, 3), (2, "t", 0, 0), (5, "", 0, 0)]
    assert env.quarantined(parsed).count() == 2


def test_control_messages(log):
    texts = [message("ack", {"message_id": "m", "status": "ok"}), message("error", {"code": "E1", "message": "bad"}),
             message("config", {"read_interval": 30, "buffer_size": 1000, "sensor_id": "s"}),
             message("config", {"read_interval": "30"}), message("reading", GOOD)]
    found = {k: df.drop("received_at", "part").collect() for k, df in env.decode_control(env.parse_envelopes(log(texts))).items()}
    assert [tuple(r) for r in found["ack"]] == [(1, "m", "ok")]
    assert [tuple(r) for r in found["error"]] == [(2, "E1", "bad")]
    assert [tuple(r) for r in found["config"]] == [(3, 30, 1000, "s")]


def test_encode_then_decode_is_identity(spark, make):
    rows = make([(f"s{i % 3}", i, AS_OF, 0.1 * i - 3, 100 / (i + 1)) for i in range(120)])
    single = rows.select("seq", F.col("recorded_at").alias("received_at"),
                         env.encode_message("reading", env.reading_payload(), F.col("recorded_at")).alias("value"))
    text = json.loads(single.orderBy("seq").first().value)
    assert text == {"type": "reading", "timestamp": "2024-01-31T00:00:00Z", "payload": {
        "sensor_id": "s0", "timestamp": "2024-01-31T00:00:00Z", "humidity": 100.0, "temperature": -3.0}}
    batches = pack_batches(rows).select(
        F.col("last_seq").alias("seq"), F.lit(AS_OF).cast("timestamp").alias("received_at"),
        env.encode_message("batch", env.batch_payload(), F.lit(AS_OF).cast("timestamp")).alias("value"))
    wanted = sorted((r.sensor_id, r.recorded_at, r.humidity, r.temperature) for r in rows.collect())
    for encoded in (single, batches):
        decoded = env.decode_readings(env.parse_envelopes(encoded)).collect()
        assert sorted((r.sensor_id, r.recorded_at, r.humidity, r.temperature) for r in decoded) == wanted


def test_broker_records(spark):
    records = spark.createDataFrame([(bytearray(message("reading", GOOD), "utf8"), 41, AS_OF)],
                                    "value binary, offset long, timestamp timestamp")
    row = env.decode_readings(env.parse_envelopes(from_broker(records))).first()
    assert (row.seq, row.sensor_id) == (41, "s")


def test_fast_and_exact_reading_agree(log):
    texts = [message("reading", p) for p, _ in SINGLE] + [message("batch", p) for p, _ in BATCHES] + [t for t, _ in BAD]
    texts += [message("reading", GOOD).replace("22.5", v) for v in ("1e400", "NaN", '"NaN"', "-1E-3", "1E-7", "007")]
    texts += ["[" + message("reading", GOOD) + "]", message("reading", GOOD).replace('"', "'"), " " + message("reading", GOOD),
              message("reading", {**GOOD, "count": "x", "uptime": [], "readings": 5}),
              message("reading", {**GOOD, "sensor_id": "5"}), message("reading", {**GOOD, "sensor_id": "true"}),
              message("heartbeat", {"sensor_id": 5}), message("heartbeat", {"sensor_id": "5", "uptime": 1, "humidity": "x"}),
              message("heartbeat", {"uptime": 2**63}), message("ack", None), message("reading", GOOD, timestamp=None)]
    found = [
        {r.seq: str(r) for r in env.parse_envelopes(log(texts), exact).drop("value").withColumn(
            "readings", F.col("readings").cast("string")).collect()}
        for exact in (False, True)]
    for i, text in enumerate(texts):
        assert found[0][i + 1] == found[1][i + 1], text
