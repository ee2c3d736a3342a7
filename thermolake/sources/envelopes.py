"""JSON message codec: envelope parsing, routing, payload decoding and encoding.

A wrong JSON type rejects the payload; an absent or null field takes its zero value; keys are matched in any letter
case.
Clean messages are read by one ``from_json``. Whatever that cannot vouch for (a corrupt record, an unknown
type, a null payload) is read again as VARIANT, where the JSON type of every field is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import parse_rfc3339, rfc3339, truncate_second, zero_time
from ..schema import CLIENT_TYPES, MESSAGE_TYPES, SERVER_TYPES

# ---- encoding ---------------------------------------------------------------


def reading_payload() -> Column:
    return F.struct(
        F.col("sensor_id"), rfc3339("recorded_at").alias("timestamp"), F.col("humidity"), F.col("temperature"))


def batch_payload(readings: str = "readings", count: str = "count") -> Column:
    """Payload from an array of reading structs."""
    return F.struct(
        F.transform(readings, lambda r: F.struct(
            r["sensor_id"].alias("sensor_id"), rfc3339(r["recorded_at"]).alias("timestamp"),
            r["humidity"].alias("humidity"), r["temperature"].alias("temperature"))).alias("readings"),
        F.col(count).alias("count"))


def heartbeat_payload() -> Column:
    return F.struct("sensor_id", "uptime", "buffer_size")


def encode_message(message_type: str, payload: Column, sent_at: Column) -> Column:
    """Envelope text: type, payload and the time of sending."""
    return F.to_json(F.struct(
        F.lit(message_type).alias("type"), payload.alias("payload"), rfc3339(sent_at).alias("timestamp")))


# ---- keys -------------------------------------------------------------------

# fixed values: the keys of all messages
KEYS = ("type", "payload", "timestamp", "sensor_id", "humidity", "temperature", "readings", "count", "uptime",
        "buffer_size", "message_id", "status", "code", "message", "read_interval")
# an unescaped quote opens no string inside a string, so such a match is a key
_KEY = r'(?<!\\)"(?i:{})"(?=\s*:)'
_MISCASED = r'(?<!\\)"(?=[^"]*[A-Z])(?i:' + "|".join(KEYS) + r')"\s*:'


def with_plain_keys(value: Column) -> Column:
    """The text with all known keys in lower case."""
    plain = value
    for key in KEYS:
        plain = F.regexp_replace(plain, _KEY.format(key), f'"{key}"')
    return F.when(value.rlike(_MISCASED), plain).otherwise(value)


# ---- field access -----------------------------------------------------------


def _field(v: Column, path: str, as_type: str) -> Column:
    return F.try_variant_get(v, path, as_type)


def _kind(v: Column, path: str = "$") -> Column:
    """JSON type of a scalar field; VOID where it is absent or null."""
    return F.coalesce(F.schema_of_variant(_field(v, path, "variant")), F.lit("VOID"))


def _is_object(v: Column) -> Column:
    return _field(v, "$", "map<string,variant>").isNotNull()


def _is_text(v: Column, path: str) -> Column:
    return _kind(v, path).isin("VOID", "STRING")


def _is_whole(v: Column, path: str) -> Column:
    return _kind(v, path).isin("VOID", "BIGINT")


def _is_number(v: Column, path: str) -> Column:
    kind = _kind(v, path)
    finite = F.abs(F.coalesce(_field(v, path, "double"), F.lit(0.0))) < F.lit(float("inf"))
    return (kind.isin("VOID", "BIGINT", "DOUBLE") | kind.startswith("DECIMAL")) & finite


def _is_time(v: Column, path: str) -> Column:
    kind = _kind(v, path)
    return (kind == "VOID") | ((kind == "STRING") & parse_rfc3339(_field(v, path, "string")).isNotNull())


def _text(v: Column, path: str) -> Column:
    return F.coalesce(_field(v, path, "string"), F.lit(""))


def _whole(v: Column, path: str) -> Column:
    return F.coalesce(_field(v, path, "long"), F.lit(0).cast("long"))


def _number(v: Column, path: str) -> Column:
    return F.coalesce(_field(v, path, "double"), F.lit(0.0))


def _time(v: Column, path: str) -> Column:
    return F.coalesce(truncate_second(parse_rfc3339(_field(v, path, "string"))), zero_time())


# ---- exact reading of doubtful messages -------------------------------------


def _decoded(v: Column) -> Column:
    """One reading with ``ok``: an object whose fields have the right types, or null for an all-zero reading."""
    fields = (_is_object(v) & _is_text(v, "$.sensor_id") & _is_time(v, "$.timestamp")
              & _is_number(v, "$.humidity") & _is_number(v, "$.temperature"))
    return F.struct(
        (F.is_variant_null(v) | F.coalesce(fields, F.lit(False))).alias("ok"),
        _text(v, "$.sensor_id").alias("sensor_id"),
        _time(v, "$.timestamp").alias("recorded_at"),
        _number(v, "$.humidity").alias("humidity"),
        _number(v, "$.temperature").alias("temperature"),
    )


def _null_if_absent(element: Column) -> Column:
    return F.coalesce(element, F.parse_json(F.lit("null")))


def _readings_array(payload: Column) -> Column:
    return _field(payload, "$.readings", "array<variant>")


def _is_batch(payload: Column) -> Column:
    """The frame of a batch; its elements are judged by ``_decoded``."""
    has_array = _readings_array(payload).isNotNull() | (_kind(payload, "$.readings") == "VOID")
    return _is_object(payload) & _is_whole(payload, "$.count") & has_array


def _is_heartbeat(payload: Column) -> Column:
    return (_is_object(payload) & _is_text(payload, "$.sensor_id") & _is_whole(payload, "$.uptime")
            & _is_whole(payload, "$.buffer_size"))


def _read_exactly(doubtful: DataFrame) -> DataFrame:
    """Adds ``_exact`` for the rows with a ``_message``."""
    message, payload, kind = F.col("_message"), F.col("_payload"), F.col("_type")
    envelope_ok = F.is_variant_null(message) | F.coalesce(
        _is_object(message) & _is_text(message, "$.type") & _is_time(message, "$.timestamp"), F.lit(False))
    elements = (
        F.when(kind == "reading", F.array(payload))
        .when((kind == "batch") & ~F.is_variant_null(payload), _readings_array(payload))
    )
    all_ok = F.forall(F.coalesce("_readings", F.array()), lambda r: r["ok"])
    frame_ok = F.when(kind == "heartbeat", _is_heartbeat(payload)).when(kind == "batch", _is_batch(payload)).otherwise(
        F.lit(True))
    problem = (
        F.when(~F.col("_envelope_ok"), F.lit("bad_envelope"))
        .when(~kind.isin(*SERVER_TYPES), F.lit("unknown_type"))
        .when(payload.isNull(), F.lit("undecodable_payload"))
        .when(~F.is_variant_null(payload) & ~F.coalesce(frame_ok & all_ok, F.lit(False)), F.lit("undecodable_payload"))
    )
    return (
        doubtful.withColumns({
            "_envelope_ok": envelope_ok, "_type": _text(message, "$.type"),
            "_payload": _field(message, "$.payload", "variant")})
        .withColumn("_readings", F.transform(elements, lambda e: _decoded(_null_if_absent(e))))
        .withColumn("_exact", F.when(F.col("_doubtful"), _outcome(
            kind, F.col("_readings"), _whole(payload, "$.count"), _text(payload, "$.sensor_id"),
            _whole(payload, "$.uptime"), _whole(payload, "$.buffer_size"), problem)))
    )


# ---- decoding ---------------------------------------------------------------

_READING = "sensor_id VARIANT, timestamp STRING, humidity DOUBLE, temperature DOUBLE"
_ENVELOPE = (
    f"type STRING, payload STRUCT<{_READING}, readings ARRAY<STRUCT<{_READING}>>, count BIGINT, uptime BIGINT, "
    "buffer_size BIGINT>, timestamp STRING, _corrupt STRING")
_STRICT = {"columnNameOfCorruptRecord": "_corrupt", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _outcome(kind, readings, count, sensor_id, uptime, buffer_size, problem) -> Column:
    zero = F.lit(0).cast("long")
    return F.struct(
        kind.alias("type"),
        F.when(kind.isin(*SERVER_TYPES), kind).otherwise(F.lit("unknown")).alias("route"),
        readings.alias("readings"),
        F.coalesce(count, zero).alias("declared_count"),
        F.struct(F.coalesce(sensor_id, F.lit("")).alias("sensor_id"), F.coalesce(uptime, zero).alias("uptime"),
                 F.coalesce(buffer_size, zero).alias("buffer_size")).alias("heartbeat"),
        problem.alias("problem"),
    )


def _clean_reading(r: Column) -> Column:
    """One typed reading with ``ok``; an absent element is an all-zero reading."""
    time = parse_rfc3339(r["timestamp"])
    finite = [F.abs(F.coalesce(r[c], F.lit(0.0))) < F.lit(float("inf")) for c in ("humidity", "temperature")]
    return F.struct(
        (_kind(r["sensor_id"]).isin("VOID", "STRING") & (r["timestamp"].isNull() | time.isNotNull())
         & finite[0] & finite[1]).alias("ok"),
        F.coalesce(_field(r["sensor_id"], "$", "string"), F.lit("")).alias("sensor_id"),
        F.coalesce(truncate_second(time), zero_time()).alias("recorded_at"),
        F.coalesce(r["humidity"], F.lit(0.0)).alias("humidity"),
        F.coalesce(r["temperature"], F.lit(0.0)).alias("temperature"),
    )


def parse_envelopes(log: DataFrame, exact: bool = False) -> DataFrame:
    """Message log (seq, received_at, value, and part where the log has partitions) to (seq, part, received_at,
    value, type, route, readings, declared_count, heartbeat, problem).

    ``route`` is reading, batch, heartbeat, or unknown for every other type. ``readings`` holds the decoded
    readings of reading and batch messages. ``problem`` says why nothing can be taken from the message; such
    messages belong in quarantine, the rest of the log goes on. ``exact`` reads every message as VARIANT.
    """
    kind, payload = F.col("_fast.type"), F.col("_fast.payload")
    single = F.struct(*[payload[c].alias(c) for c in ("sensor_id", "timestamp", "humidity", "temperature")])
    elements = F.when(kind == "reading", F.array(single)).when(kind == "batch", payload["readings"])
    readable = (
        F.lit(not exact) & F.col("_fast._corrupt").isNull() & F.ltrim("_json").startswith("{")
        & kind.isin(*MESSAGE_TYPES) & payload.isNotNull()
        & (F.col("_fast.timestamp").isNull() | parse_rfc3339("_fast.timestamp").isNotNull())
        & F.forall(F.coalesce("_clean", F.array()), lambda r: r["ok"])
        & ((kind != "heartbeat") | _kind(payload["sensor_id"]).isin("VOID", "STRING"))
    )
    typed = (
        log.withColumn("_json", with_plain_keys(F.col("value")))
        .withColumn("_fast", F.from_json("_json", _ENVELOPE, _STRICT))
        .withColumn("_clean", F.transform(elements, _clean_reading))
        .withColumn("_doubtful", ~F.coalesce(readable, F.lit(False)))
        .withColumn("_message", F.when(F.col("_doubtful"), F.try_parse_json("_json")))
    )
    plain = _outcome(
        kind, F.col("_clean"), payload["count"], _field(payload["sensor_id"], "$", "string"), payload["uptime"],
        payload["buffer_size"], F.when(~kind.isin(*SERVER_TYPES), F.lit("unknown_type")))
    # a generator of one row keeps later filters from being moved before it, where they would parse again
    return _read_exactly(typed).select(
        "seq", _part(log).alias("part"), "received_at", "value", F.inline(F.array(F.coalesce("_exact", plain))))


def _part(log: DataFrame) -> Column:
    return F.coalesce("part", F.lit(0)) if "part" in log.columns else F.lit(0)


def decode_readings(messages: DataFrame) -> DataFrame:
    """Readings of all reading and batch messages, one row each, with their arrival: message number, position in
    the message, partition.

    ``count_matches`` compares a batch's declared count with what it holds; the count is never trusted.
    """
    count_matches = (F.col("route") != "batch") | (F.col("declared_count") == F.size("readings"))
    return (
        messages.filter(F.col("problem").isNull())
        .select(
            "seq", "part", "received_at", count_matches.alias("count_matches"),
            F.posexplode("readings").alias("pos", "_reading"))
        .select(
            "seq", F.col("pos").cast("long").alias("pos"), "part", "received_at", "count_matches",
            *[F.col(f"_reading.{c}").alias(c) for c in ("sensor_id", "recorded_at", "humidity", "temperature")])
    )


def decode_heartbeats(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("problem").isNull() & (F.col("route") == "heartbeat")).select(
        "seq", "part", "heartbeat.*", truncate_second("received_at").alias("received_at"))


def quarantined(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("problem").isNotNull()).select(
        "seq", "part", "value", F.col("problem").alias("reason"), "received_at")


def decode_control(messages: DataFrame) -> dict[str, DataFrame]:
    """Client side of the log: typed ack, error and config messages."""
    payload = F.col("_payload")
    logged = messages.filter(F.col("problem") == "unknown_type").withColumn(
        "_payload", _field(F.try_parse_json(with_plain_keys(F.col("value"))), "$.payload", "variant"))
    fields = {
        "ack": [(n, _is_text, _text) for n in ("message_id", "status")],
        "error": [(n, _is_text, _text) for n in ("code", "message")],
        "config": [("read_interval", _is_whole, _whole), ("buffer_size", _is_whole, _whole),
                   ("sensor_id", _is_text, _text)],
    }
    decoded = {}
    for kind in CLIENT_TYPES:
        rows = logged.filter(F.col("type") == kind)
        good = _is_object(payload)
        for name, check, _ in fields[kind]:
            good = good & check(payload, f"$.{name}")
        rows = rows.filter(F.is_variant_null(payload) | F.coalesce(good, F.lit(False)))
        decoded[kind] = rows.select(
            "seq", "part", "received_at", *[get(payload, f"$.{name}").alias(name) for name, _, get in fields[kind]])
    return decoded
