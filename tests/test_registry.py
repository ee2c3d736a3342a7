"""Every registered query against its SQL, and the promises of the entry file."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_file
from conftest import SF_DIR
from thermolake import registry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: repr(round(v, 9) + 0.0) if isinstance(v, float) and not math.isnan(v) else str(v)
    return sorted(columns), sorted(tuple(cell(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, duck, name):
    df = entry_file.queries()[name](spark, SF_DIR)
    cursor = duck.execute(entry_file.oracle_sql()[name])
    wanted = canonical([d[0] for d in cursor.description], cursor.fetchall())
    found = canonical(df.columns, df.collect())
    assert wanted[1], "the SQL gives no rows"
    assert found == wanted


def test_entry(spark):
    df = entry_file.entry(spark)
    assert df.columns[:2] == ["date", "sensor_id"] and df.count() == 397


def test_no_cartesian_products_or_forced_broadcasts(spark):
    writing = ("stream_", "retention_", "write_", "ingest_", "scroll_", "table_", "combined_stats_of")
    for name, query in registry.queries().items():
        if not name.startswith(writing):
            plan = query(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_raw_bounds_reach_the_scan(spark):
    plan = entry_file.queries()["readings_in_range"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "user_id" in pushed and "ts" in pushed


def test_staged_log_has_files_by_its_size(spark, monkeypatch):
    """No task writes a whole micro-batch of a large log, and the files of a batch follow one another."""
    from pyspark.sql import functions as F

    made = {}
    work_dir = registry.work_dir
    monkeypatch.setattr(registry, "work_dir", lambda s, label: made.setdefault(label, work_dir(s, label)))
    monkeypatch.setattr(registry, "FILE_MESSAGES", 50)
    registry._staged_log(spark, SF_DIR)
    files = spark.read.json(made["log"], "seq long").groupBy(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("at")).agg(
        F.min(F.pmod(F.xxhash64("seq"), F.lit(3))).alias("low"), F.max(F.pmod(F.xxhash64("seq"), F.lit(3))).alias("high"))
    rows = files.orderBy("at").collect()
    each = spark.read.parquet(made["messages"]).count() // 150
    assert each > 1 and len(rows) == 3 * each
    assert [r.low for r in rows] == [r.high for r in rows] == [i for i in range(3) for _ in range(each)]
