"""Every registered query next to its SQL on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, rows_of
from hourloom.plans import queries as Q

QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLES)))
def test_query_equals_sql(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    want = db.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry(spark).count() == 3


@pytest.fixture
def csv_rows(spark, monkeypatch, tmp_path):
    """Rows of three tasks that say which task made them."""
    cols = [F.col("id").cast("string").alias("ride_id"), F.lit("2024-01-01 00:00:00").alias("started_at"), F.lit("A").alias("start_station_id")]
    cols += [F.spark_partition_id().cast("string").alias("start_station_name"), F.lit("1").alias("start_lat"), F.lit("2").alias("start_lng")]
    monkeypatch.setattr(Q.driver, "events_as_csv_rows", lambda spark, sf: spark.range(0, 300, 1, 3).select(*cols))
    monkeypatch.setattr(Q, "shared_dir", lambda spark, label: f"file://{tmp_path}/{label}")
    return tmp_path / "csv"


def test_one_file_is_written_from_rows_of_all_tasks(spark, csv_rows):
    assert [tuple(r) for r in Q.skipped_csv_files(spark, None).collect()] == [("missing columns: started_at", 1)]
    made = spark.read.option("header", True).csv(f"file://{csv_rows}/b")
    assert made.count() == 300 and made.select("start_station_name").distinct().count() == 3


def test_compressed_files_are_written_and_cut_side_by_side(spark, csv_rows):
    got = {(r.kind, r.problem): r.n_rows for r in Q.csv_outcomes(spark, None).collect()}
    assert got == {("whole", "none"): 300, ("packed", "none"): 300, ("cut", "cannot read"): 0, ("odd", "missing columns"): 0}
    packed = {f.name: f.stat().st_size for f in (csv_rows / "packed").glob("*.gz")}
    cut = {f.name: f.stat().st_size for f in (csv_rows / "cut").glob("*.gz")}
    assert len(packed) == 3 and cut == {name: size // 2 for name, size in packed.items()}
