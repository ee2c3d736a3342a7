from datetime import date, datetime, timezone
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from thermolake.functions import (
    as_instant,
    describe_reading,
    end_of_given_day,
    is_valid,
    one_decimal,
    parse_date_argument,
    parse_instant,
    parse_rfc3339,
    parse_rfc3339_argument,
    reject_reason,
    rfc3339,
)
from thermolake.operators.scans import clamp_limit
from thermolake.schema import ValidityBounds

T0 = datetime(2024, 1, 15, 12)

VALIDITY = [
    ("valid", "s", T0, 22.5, 45, None),
    ("cold", "s", T0, -25, 45, "temperature"),
    ("hot", "s", T0, 65, 45, "temperature"),
    ("no time", "s", None, 22.5, 45, "missing_timestamp"),
    ("no sensor", "", T0, 22.5, 45, "empty_sensor"),
    ("low edge", "s", T0, -20, 0, None),
    ("high edge", "s", T0, 60, 100, None),
    ("dry", "s", T0, 22.5, -5, "humidity"),
    ("wet", "s", T0, 22.5, 105, "humidity"),
    ("both: temperature first", "s", T0, -30, 110, "temperature"),
    ("15 % is accepted", "s", T0, 22.5, 15, None),
    ("95 % is accepted", "s", T0, 22.5, 95, None),
    ("sensor before the rest", "", None, -30, 110, "empty_sensor"),
]


def test_validity_and_reason(make):
    rows = make([(s, i, t, a, b) for i, (_, s, t, a, b, _) in enumerate(VALIDITY)])
    found = {r.seq: (r.ok, r.why) for r in rows.select(
        "seq", is_valid().alias("ok"), reject_reason().alias("why")).collect()}
    for i, (label, *_, why) in enumerate(VALIDITY):
        assert found[i] == (why is None, why), label


def test_zero_time_is_missing(make):
    rows = make([("s", 1, T0, 20, 50)]).withColumn("recorded_at", F.lit("0001-01-01 00:00:00").cast("timestamp"))
    assert rows.select(reject_reason().alias("why")).first().why == "missing_timestamp"


def test_null_values_are_invalid(make):
    rows = make([("s", 1, T0, 20, 50)]).withColumn("temperature", F.lit(None).cast("double"))
    assert rows.select(is_valid().alias("ok")).first().ok is False


def test_strict_profile(make):
    rows = make([("s", 1, T0, 22, 15), ("s", 2, T0, 22, 50)])
    strict = ValidityBounds(min_humidity=20, max_humidity=90)
    assert [r.seq for r in rows.filter(is_valid(strict)).collect()] == [2]


@pytest.mark.parametrize("text, expected", [
    ("2024-01-02 03:04:05", "2024-01-02 03:04:05"),
    ("2024-01-02T03:04:05Z", "2024-01-02 03:04:05"),
    ("2024-01-02 03:04:05.678", "2024-01-02 03:04:05.678"),
    ("2024-01-02T03:04:05+02:00", "2024-01-02 01:04:05"),
    ("2024-01-02T03:04:05.123456789Z", "2024-01-02 03:04:05.123456"),
    ("2024-01-02", None),
    ("2024-13-02 03:04:05", None),
    ("yesterday", None),
    ("", None),
])
def test_parse_instant(spark, text, expected):
    row = spark.range(1).select(parse_instant(F.lit(text)).cast("string").alias("t")).first()
    assert row.t == expected


@pytest.mark.parametrize("text, ok", [
    ("2024-01-02T03:04:05Z", True), ("2024-01-02T03:04:05.5-08:00", True),
    ("2024-01-02T03:04:05", False), ("2024-01-02 03:04:05Z", False), ("2024-01-02", False),
])
def test_rfc3339_needs_a_zone(spark, text, ok):
    row = spark.range(1).select(parse_rfc3339(F.lit(text)).isNotNull().alias("ok")).first()
    assert row.ok is ok


def test_rfc3339_round_trip(spark):
    row = spark.range(1).select(rfc3339(parse_rfc3339(F.lit("2024-01-02T03:04:05+02:00"))).alias("t")).first()
    assert row.t == "2024-01-02T01:04:05Z"


def test_date_arguments():
    assert parse_date_argument("2024-01-02") == datetime(2024, 1, 2)
    assert parse_date_argument("2024-01-02T03:04:05Z") == datetime(2024, 1, 2, 3, 4, 5)
    assert parse_date_argument("2024-01-02T03:04:05+02:00") == datetime(2024, 1, 2, 1, 4, 5)
    for bad in ("02.01.2024", "2024-1-2", "2024-01-02T03:04:05", "2024-01-02 03:04:05", ""):
        with pytest.raises(ValueError):
            parse_date_argument(bad)
    with pytest.raises(ValueError):
        parse_rfc3339_argument("2024-01-02")


def test_as_instant():
    assert as_instant("2024-01-02 03:04:05") == datetime(2024, 1, 2, 3, 4, 5)
    assert as_instant(date(2024, 1, 2)) == datetime(2024, 1, 2)
    assert as_instant(datetime(2024, 1, 2, 3, 4, 5, 999, tzinfo=timezone.utc)) == datetime(2024, 1, 2, 3, 4, 5)


def test_end_of_given_day_keeps_the_time_of_day():
    assert end_of_given_day(datetime(2024, 1, 2)) == datetime(2024, 1, 2, 23, 59, 59)
    assert end_of_given_day(datetime(2024, 1, 2, 10)) == datetime(2024, 1, 3, 9, 59, 59)


@pytest.mark.parametrize("given_limit, served", [
    (None, 50), ("", 50), ("abc", 50), (0, 50), (-3, 50), ("7", 7), (1000, 1000), (1001, 1000)])
def test_limit_clamp(given_limit, served):
    assert clamp_limit(given_limit) == served


def test_describe(make):
    rows = make([("kitchen", 1, T0, 22.52, 45.11), ("kitchen", 2, T0, -0.04, 0.25)])
    assert [r[0] for r in rows.orderBy("seq").select(describe_reading()).collect()] == [
        "SensorID: kitchen, Timestamp: 2024-01-15T12:00:00Z, Humidity: 45.1%, Temperature: 22.5°C",
        "SensorID: kitchen, Timestamp: 2024-01-15T12:00:00Z, Humidity: 0.2%, Temperature: -0.0°C",
    ]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(
    st.floats(-1e6, 1e6), st.integers(-4000, 4000).map(lambda n: n / 20), st.integers(-400, 400).map(lambda n: n / 4)),
    min_size=200, max_size=200))
def test_one_decimal_rounds_the_exact_value(spark, values):
    rows = spark.createDataFrame([(float(v),) for v in values], "x double")
    for row in rows.select("x", one_decimal("x").alias("text")).collect():
        assert row.text == f"{row.x:.1f}", Decimal(row.x)
