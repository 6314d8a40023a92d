from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hourloom.functions import clock
from hourloom.operators import clean, counts, joins, quality
from tests.conftest import EDGE_HI, EDGE_LO, TZ


def ids(df):
    return sorted(int(r.ride_id) for r in df.collect())


def test_kept_rides(edge_clean):
    assert ids(edge_clean) == [1, 2, 4, 5, 7, 10, 13]


def test_dst_by_conversion_and_by_lookup_agree(edge):
    valid = clean.valid_trips(edge)
    a = ids(clean.drop_dst_edges(valid, TZ))
    b = ids(clean.drop_dst_edges(valid, TZ, lo="2022-01-01", hi="2024-12-31 23:59:59"))
    assert a == b == [1, 2, 4, 5, 7, 10, 11, 12, 13]


def test_dst_report(edge):
    got = {r.state: r.n for r in clean.dst_edge_report(clean.valid_trips(edge), TZ).collect()}
    assert got == {"kept": 9, "nonexistent": 1, "ambiguous": 1}


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/Berlin", "Australia/Lord_Howe", "UTC"])
def test_edges_of_zones_match_conversion(spark, zone):
    times = spark.range(0, 366 * 96).select(
        (clock.wall("2024-01-01") + F.make_dt_interval(mins=(F.col("id") * 15).cast("int"))).alias("t")
    )
    edges = clock.dst_edges(zone, "2024-01-01", "2024-12-31 23:59:59")
    by_change = clock.within_edges("t", edges)
    by_conversion = clock.is_nonexistent("t", zone) | clock.is_ambiguous("t", zone)
    got = times.agg(F.count_if(by_change != by_conversion), F.count_if(by_change)).first()
    per_hour = {"America/New_York": 8, "Europe/Berlin": 8, "Australia/Lord_Howe": 4, "UTC": 0}
    assert tuple(got) == (0, per_hour[zone])


def test_clock_does_not_depend_on_session_zone(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-03-10 02:10:11.5' AS t")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        row = df.select(
            clock.floor_hour("t").alias("h"),
            clock.hour_of_day("t").alias("n"),
            clock.day_of_week("t").alias("d"),
            clock.is_weekend("t").alias("w"),
            clock.instant_to_wall(F.lit("2023-01-01 05:30:00-05:00"), "Europe/Berlin").alias("b"),
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert row.h == datetime(2024, 3, 10, 2)
    assert (row.n, row.d, row.w) == (2, 6, 1)
    assert row.b == datetime(2023, 1, 1, 11, 30)


def test_hourly_counts(edge_clean):
    got = {(r.station_id, str(r.datetime)): r.departures for r in counts.hourly_counts(edge_clean).collect()}
    assert got == {
        ("A", "2024-03-10 01:00:00"): 2,
        ("A", "2024-03-10 03:00:00"): 1,
        ("A", "2024-03-10 05:00:00"): 1,
        ("B", "2024-11-03 00:00:00"): 1,
        ("B", "2024-12-31 23:00:00"): 1,
        ("C", "2024-03-10 01:00:00"): 1,
    }


def test_dimension_takes_smallest_mode(edge_clean):
    got = {tuple(r) for r in counts.station_dim(edge_clean).collect()}
    assert got == {
        ("A", "Alpha", 1.0, 5.0),
        ("A", "Alpha (moved)", 9.0, 9.0),
        ("B", "Beta", 4.0, 4.0),
    }


def test_rename_fans_out_only_without_dedupe(edge_clean):
    hourly, dim = counts.hourly_counts(edge_clean), counts.station_dim(edge_clean)
    raw = joins.join_dim(hourly, dim, dedupe=False).collect()
    one = joins.join_dim(hourly, dim).collect()
    assert len(raw) == 9 and len(one) == 6
    assert {r.station_name for r in one if r.station_id == "A"} == {"Alpha"}
    assert [r.station_name for r in one if r.station_id == "C"] == [None]
    report = joins.fan_out_report(dim).collect()
    assert [(r.station_id, r.n_names, r.kept_name) for r in report] == [("A", 2, "Alpha")]


def test_quality_report(edge):
    got = quality.quality_report(edge, EDGE_LO, EDGE_HI, TZ).first().asDict()
    assert got == {
        "n_loaded": 13, "n_bad_time": 1, "n_no_key": 1, "n_valid": 11,
        "n_in_range": 9, "n_dst_edge": 2, "n_kept": 7,
    }


def test_first_per_key_keeps_stated_row(spark):
    df = spark.createDataFrame([(1, "b", 5), (1, "a", 9), (2, "c", 1)], "k int, o string, v int")
    got = {tuple(r) for r in counts.first_per_key(df.repartition(3), ["k"], ["o"]).collect()}
    assert got == {(1, "a", 9), (2, "c", 1)}
