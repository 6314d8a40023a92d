from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hourloom import schema as S
from hourloom.operators import counts, fill, panel
from hourloom.plans import demand, driver
from hourloom.streaming import ingest, refresh

SPAN = panel.Span("2024-01-01 00:00:00", "2024-01-30 23:00:00")


def test_edge_grid_is_dense(edge_clean):
    hourly = counts.hourly_counts(edge_clean)
    span = panel.Span("2023-01-01 00:00:00", "2024-12-31 23:00:00")
    assert span.n_steps == 17_544
    keys = demand.keys_of(hourly)
    assert panel.fill_grid(panel.build_grid(keys, span), hourly).count() == 52_632
    dense = panel.dense_panel(keys, hourly, span)
    got = dense.agg(F.count("*"), F.sum("departures"), F.countDistinct("station_id")).first()
    assert tuple(got) == (52_560, 7, 3)


@pytest.mark.parametrize("block_days", [1, 2, 7, 90])
def test_lags_equal_time_shift_for_any_block(spark, sf, block_days):
    span = panel.Span(SPAN.lo, SPAN.hi, block_days=block_days)
    hourly = driver.counts(spark, sf)
    dense = panel.dense_panel(demand.keys_of(hourly), hourly, span)
    base = panel.fill_grid(panel.build_grid(demand.keys_of(hourly), span), hourly)
    for k in (1, 2, 24):
        shifted = base.select(
            "station_id",
            (F.col("datetime") + F.make_dt_interval(hours=F.lit(k))).alias("datetime"),
            F.col("departures").cast("float").alias("want"),
        )
        joined = dense.join(shifted, ["station_id", "datetime"])
        wrong = joined.where(F.col(f"lag_{k}h") != F.col("want")).count()
        assert wrong == 0 and joined.count() == dense.count()
    n = demand.keys_of(hourly).count()
    assert dense.count() == n * (span.n_steps - 24)
    report = panel.density_report(base, span).first()
    assert report.is_dense and report.n_rows == n * span.n_steps


def test_add_lags_equals_dense_panel(spark, sf):
    span = panel.Span(SPAN.lo, SPAN.hi, block_days=4)
    hourly = driver.counts(spark, sf)
    keys = demand.keys_of(hourly)
    a = panel.dense_panel(keys, hourly, span)
    b = panel.add_lags(panel.fill_grid(panel.build_grid(keys, span), hourly), span)
    cols = sorted(a.columns)
    assert a.select(cols).exceptAll(b.select(cols)).count() == 0
    assert a.count() == b.count()


def test_lag_longer_than_block_is_refused(spark, sf):
    span = panel.Span(SPAN.lo, SPAN.hi, block_days=1)
    with pytest.raises(ValueError):
        panel.add_lags(spark.range(1), span, lags=(25,))


def test_no_leakage_from_the_future(spark, sf):
    cut = "2024-01-15 00:00:00"
    cols = ["station_id", "datetime", "departures", "lag_1h", "lag_2h", "lag_24h", *S.HOUR_COLS]
    trips, weather = driver.trips(spark, sf), driver.weather(spark, sf)
    args = (driver.holidays(spark), SPAN, driver.TRAIN_END, driver.VAL_END)
    early = F.col("datetime") < F.lit(cut).cast("timestamp_ntz")
    full = demand.features_from_trips(trips, weather, *args).where(early)
    past = demand.features_from_trips(
        trips.where(F.col("started_at") < F.lit(cut).cast("timestamp_ntz")), weather.where(early), *args
    ).where(early)
    known = past.select("station_id").distinct()
    assert full.join(known, "station_id", "left_semi").select(cols).exceptAll(past.select(cols)).count() == 0


def test_result_does_not_depend_on_partitioning(spark, sf):
    trips = driver.trips(spark, sf)
    args = (driver.weather(spark, sf), driver.holidays(spark), SPAN, driver.TRAIN_END, driver.VAL_END)
    a = demand.features_from_trips(trips, *args)
    b = demand.features_from_trips(trips.repartition(7, F.rand(1)), *args)
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_split_is_total_and_sums_agree(spark, sf):
    rows = driver.features(spark, sf)
    got = {r.split: r.n for r in counts.split_counts(rows).collect()}
    assert set(got) == {"train", "val", "test"} and sum(got.values()) == rows.count()
    base = panel.fill_grid(panel.build_grid(demand.keys_of(driver.counts(spark, sf)), SPAN), driver.counts(spark, sf))
    total = base.agg(F.sum("departures")).first()[0]
    assert total == driver.counts(spark, sf).agg(F.sum("departures")).first()[0] == 1000


def test_feature_types(spark, sf):
    kinds = dict(driver.features(spark, sf).dtypes)
    assert kinds["departures"] == "int" and kinds["hour_of_day"] == "tinyint"
    assert kinds["lag_24h"] == "float" and kinds["datetime"] == "timestamp_ntz"
    assert {"split", *S.FEATURES} <= set(kinds)


GAP = [None, 3.0, None, 5.0, None]


@pytest.mark.parametrize("block_days", [90, 1])
def test_fill_carries_forward_then_zero(spark, block_days):
    rows = [(datetime(2024, 1, 1, h), x) for h, x in enumerate(GAP)]
    df = spark.createDataFrame(rows, "datetime timestamp_ntz, temperature double")
    got = fill.forward_fill(df, "datetime", ["temperature"], default=0, block_days=block_days)
    assert [r.temperature for r in got.orderBy("datetime").collect()] == [0.0, 3.0, 3.0, 5.0, 5.0]
    raw = fill.forward_fill(df, "datetime", ["temperature"], block_days=block_days)
    assert raw.orderBy("datetime").first().temperature is None


def test_fill_over_blocks_equals_one_window(spark):
    df = spark.range(0, 2000).select(
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("datetime"),
        F.when(F.col("id") % 97 == 5, F.col("id").cast("double")).alias("a"),
        F.when((F.col("id") > 500) & (F.col("id") < 510), F.col("id").cast("int")).alias("b"),
    )
    one = fill.forward_fill(df, "datetime", ["a", "b"], default=0, block_days=4000)
    many = fill.forward_fill(df, "datetime", ["a", "b"], default=0, block_days=3)
    assert one.dtypes == many.dtypes
    assert one.exceptAll(many).count() == 0 and many.count() == 2000


def test_missing_hours_have_no_weather_until_filled(spark, sf):
    raw, full = driver.features(spark, sf), driver.model_features(spark, sf)
    assert raw.where("is_holiday IS NULL").count() > 0
    assert full.where(" OR ".join(f"{c} IS NULL" for c in S.HOUR_COLS)).count() == 0


def test_dense_rows_are_not_shuffled(spark, sf):
    """The grid join and the lag window share the exchange of the key rows."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hourly = driver.counts(spark, sf)
        df = panel.dense_panel(demand.keys_of(hourly), hourly, SPAN)
        lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    window = next(i for i, x in enumerate(lines) if "Window [lag" in x)
    generate = next(i for i, x in enumerate(lines) if "explode(sequence" in x)
    between = lines[window:generate]
    assert not any("Exchange" in x for x in between)
    assert sum("Sort [" in x for x in between) == 1


def _file_times(folder):
    return {str(f.relative_to(folder)): f.stat().st_mtime_ns for f in folder.rglob("part-*.parquet")}


def _partitions(files):
    return {f.rsplit("/", 1)[0] for f in files}


def test_a_refresh_replaces_only_what_new_events_touch(spark, tmp_path):
    days = [f"2024-01-{d:02d}" for d in range(1, 13)]
    span = panel.Span(f"{days[0]} 00:00:00", f"{days[-1]} 23:00:00", block_days=3)
    head = ",".join(S.TRIPS.names)
    table, store = str(tmp_path / "table"), str(tmp_path / "store")

    def arrive(name, rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.csv").write_text("\n".join([head, *rows]) + "\n")
        ingest.ingest_new_files(spark, str(tmp_path / "in"), str(tmp_path / "state"), table)
        return refresh.refresh(spark, table, store, span)

    def whole():
        n = counts.hourly_counts(ingest.read_ingested(spark, table))
        return {tuple(r) for r in panel.dense_panel(n.select("station_id").distinct(), n, span).collect()}

    def stored():
        got = [tuple(r) for r in refresh.read_panel(spark, store).select("station_id", "datetime", "departures", "lag_1h", "lag_2h", "lag_24h").collect()]
        assert len(got) == len(set(got))
        return set(got)

    base = [f"{i},{d} {i % 24:02d}:10:00,{s},N,1,2" for i, (d, s) in enumerate((d, s) for d in days for s in "ABC")]
    blocks = span.blocks[1] - span.blocks[0] + 1
    assert len({b for b, _ in arrive("a", base)}) == blocks and stored() == whole()
    before = _file_times(tmp_path / "store" / "panel")
    # In the middle of a block: that block of one part alone.
    again = arrive("b", [f"900,{days[3]} 05:00:00,A,N,1,2"])
    after = _file_times(tmp_path / "store" / "panel")
    changed = {p for p in _partitions(after) if any(before.get(f) != t for f, t in after.items() if f.startswith(p))}
    assert len(again) == len(changed) == 1 and stored() == whole()
    # At the end of a block: the next one's lags reach it.
    block = int(next(iter(changed)).split("_block=")[1].split("/")[0])
    last = (panel.EPOCH + panel.timedelta(days=(block + 1) * 3 - 1)).isoformat()
    assert [b for b, _ in arrive("c", [f"901,{last} 23:30:00,A,N,1,2"])] == [block, block + 1] and stored() == whole()
    # A new entity has a row for every hour.
    assert len(arrive("d", [f"902,{days[6]} 05:00:00,D,N,1,2"])) == blocks and stored() == whole()
    assert arrive("e", []) == [] and refresh.refresh(spark, table, store, span) == []
