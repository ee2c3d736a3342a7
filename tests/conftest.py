import sys
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF_DIR = "/root/testdata/sf0.001"
AS_OF = datetime(2024, 1, 31)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Readings from (sensor, seq, recorded_at, temperature, humidity) tuples."""

    def build(rows):
        rows = [(s, q, t.replace(tzinfo=timezone.utc) if isinstance(t, datetime) else t, float(a), float(b))
                for s, q, t, a, b in rows]
        return spark.createDataFrame(
            rows, "sensor_id string, seq long, recorded_at timestamp, temperature double, humidity double"
        ).select("seq", "sensor_id", "recorded_at", "temperature", "humidity")

    return build


@pytest.fixture(scope="session")
def log(spark):
    """Message log from envelope texts, numbered from 1."""

    def build(texts, received_at="2024-01-15 00:00:00"):
        rows = [(i + 1, t) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "seq long, value string").select(
            "seq", F.lit(received_at).cast("timestamp").alias("received_at"), "value")

    return build


def minutes_ago(n):
    return AS_OF - timedelta(minutes=n)
