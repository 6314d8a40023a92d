from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hourloom import schema as S
from hourloom.operators import binning, calendar, diagnostics, quality, quantile, results, sampling
from hourloom.plans import driver


def scored_of(spark, pairs):
    return spark.createDataFrame([(float(y), float(p)) for y, p in pairs], "departures double, pred double")


def test_buckets(spark):
    df = scored_of(spark, [(y, y + 1) for y in (0, 1, 2, 3, 9, 49, 50, 199, 200)])
    got = {r.bucket: (r.n, r.rmse) for r in binning.bucket_error(df, S.BUCKET_EDGES, S.BUCKET_LABELS).collect()}
    assert got == {
        "0": (1, 1.0), "1-2": (2, 1.0), "3-5": (1, 1.0), "6-9": (1, 1.0),
        "10-19": (0, 0.0), "20-49": (1, 1.0), "50+": (2, 1.0),
    }


def test_daily_gap_is_zero(spark):
    rows = [(datetime(2024, 1, 1, 5), 2, 1.5), (datetime(2024, 1, 3, 7), 3, 2.5)]
    df = spark.createDataFrame(rows, "datetime timestamp_ntz, departures int, pred double")
    got = [(str(r.day), r.departures, r.pred) for r in diagnostics.daily_totals(df).orderBy("day").collect()]
    assert got == [("2024-01-01", 2, 1.5), ("2024-01-02", 0, 0.0), ("2024-01-03", 3, 2.5)]


def test_daily_sum_equals_hourly_sum(spark, sf):
    series = diagnostics.total_series(driver.scored(spark, sf))
    a = series.agg(F.sum("departures")).first()[0]
    b = diagnostics.daily_totals(series).agg(F.sum("departures")).first()[0]
    assert a == b


@pytest.mark.parametrize("bins", [1, 7, 80])
def test_histogram_equals_numpy(spark, bins):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(0, 9, 3000), 1)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = binning.histogram(df, "x", bins, -20, 20).orderBy("bin").collect()
    n, edges = np.histogram(np.clip(x, -20, 20), bins=bins)
    assert [r.n for r in got] == list(n)
    assert np.allclose([r.bin_lo for r in got], edges[:-1]) and np.allclose(got[-1].bin_hi, edges[-1])


def test_histogram_of_a_constant(spark):
    got = binning.histogram(spark.range(5).select(F.lit(2.0).alias("x")), "x", 4).collect()
    assert sum(r.n for r in got) == 5 and len(got) == 4


def test_hexbin_counts_every_point_at_its_nearest_centre(spark):
    rng = np.random.default_rng(5)
    x, y = rng.gamma(1, 6, 2000), rng.gamma(1, 6, 2000)
    df = scored_of(spark, zip(x, y))
    got = binning.hexbin(df, gridsize=20, cap=30.0).collect()
    assert sum(r.n for r in got) == 2000
    cx, cy = np.minimum(x, 30), np.minimum(y, 30)
    sx, sy = (cx.max() - cx.min()) / 20, (cy.max() - cy.min()) / int(20 / 3**0.5)
    grid = [
        (cx.min() + (i + h) * sx, cy.min() + (j + h) * sy) for i in range(21) for j in range(13) for h in (0, 0.5)
    ]
    centres = np.array(grid)
    d = ((cx[:, None] - centres[None, :, 0]) / sx) ** 2 + 3 * ((cy[:, None] - centres[None, :, 1]) / sy) ** 2
    want = np.bincount(d.argmin(1), minlength=len(grid))
    mine = {(round(r.x, 4), round(r.y, 4)): r.n for r in got}
    theirs = {(round(a, 4), round(b, 4)): int(n) for (a, b), n in zip(grid, want) if n}
    assert mine == theirs


def test_ties_go_by_id(spark):
    df = spark.createDataFrame(
        [("b", "B", 1.0), ("a", "A", 1.0 + 1e-13), ("c", "C", 0.5)], "station_id string, station_name string, rmse double"
    )
    assert [r.station_id for r in diagnostics.top_entities(df, 2).collect()] == ["a", "b"]
    row = diagnostics.entity_summary(df).first()
    assert (row.max_name, row.min_name, row.median_rmse) == ("A", "C", 1.0)


def test_minimum_support(spark):
    rows = [("a", h, 1, 1.0) for h in range(5)] + [("b", h, 2, 1.0) for h in range(3)]
    df = spark.createDataFrame(rows, "station_id string, h int, departures int, pred double").select(
        "*", F.col("station_id").alias("station_name"), F.lit(1.0).alias("start_lat"), F.lit(1.0).alias("start_lng"),
        F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.lit(1), F.col("h"), F.lit(0), F.lit(0)).alias("datetime"),
    )
    assert [r.station_id for r in diagnostics.entity_error(df, 5).collect()] == ["a"]
    assert diagnostics.focus_entity(df, 3).first().station_id == "b"
    assert diagnostics.focus_entity(df, 4).first().station_id == "a"


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.floats(-1e6, 1e6), st.just(2.0)), min_size=1, max_size=60), st.lists(st.floats(0, 1), min_size=1, max_size=4, unique=True))
def test_quantiles_equal_numpy(spark, values, probs):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = {r.prob: r.quantile for r in quantile.exact_quantiles(df, "x", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(values, p), rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("share_of_hot", [0.0, 0.4, 0.95])
def test_quantiles_through_the_sketch(spark, share_of_hot):
    rng = np.random.default_rng(1)
    x = np.where(rng.random(60_000) < share_of_hot, 7.0, rng.lognormal(2, 2, 60_000))
    path_df = spark.createDataFrame([(i % 2, float(v)) for i, v in enumerate(x)], "g int, x double")
    probs = [0.0, 0.05, 0.5, 0.9, 0.999, 1.0]
    for r in quantile.exact_quantiles(path_df, "x", probs).collect():
        assert r.quantile == pytest.approx(np.quantile(x, r.prob), rel=1e-12)
    for r in quantile.exact_quantiles(path_df, "x", probs, ["g"]).collect():
        assert r.quantile == pytest.approx(np.quantile(x[r.g :: 2], r.prob), rel=1e-12)


def test_describe_equals_pandas(spark):
    df = spark.createDataFrame([(1.0, 5), (4.0, None), (9.0, 7), (None, 8)], "a double, b int")
    got = {r.column_name: r.asDict() for r in quality.describe_numeric(df, ["a", "b"]).collect()}
    want = df.toPandas().describe()
    for c in ("a", "b"):
        mine = [got[c][k] for k in ("n", "mean", "std", "min", "q25", "q50", "q75", "max")]
        assert mine == pytest.approx(list(want[c]))


@pytest.mark.parametrize("method", ["xxhash64", "md5"])
def test_samples_are_exact_nested_and_stable(spark, sf, method):
    keys = ["station_id", "datetime"]
    rows = driver.features(spark, sf).select(*keys, "departures").persist()
    total = rows.count()

    def draw(df, n, seed=1):
        return sampling.sample_exact(df, n, seed, keys, method)

    big, small = draw(rows, 3000), draw(rows.repartition(5), 700)
    assert big.count() == 3000 and small.count() == 700
    assert small.exceptAll(big).count() == 0
    assert draw(rows, 700, seed=2).exceptAll(small).count() > 0
    assert draw(rows, total + 5).count() == draw(rows, total).count() == total
    assert draw(rows, 1).count() == 1 and draw(rows, 0).count() == 0
    brute = rows.orderBy(sampling.sample_order(keys, 1, method), *keys).limit(700)
    assert brute.exceptAll(small).count() == 0
    rows.unpersist()


def test_holidays(spark):
    got = {str(r.date): r.holiday_name for r in calendar.holiday_calendar(calendar.rules_table(spark), 2023, 2024).collect()}
    want = {
        "2023-01-01": "New Year's Day",
        "2023-01-02": "New Year's Day (observed)",
        "2023-01-16": "Martin Luther King Jr. Day",
        "2023-02-20": "Washington's Birthday",
        "2023-05-29": "Memorial Day",
        "2023-11-10": "Veterans Day (observed)",
        "2023-11-23": "Thanksgiving",
        "2024-05-27": "Memorial Day",
        "2024-09-02": "Labor Day",
        "2024-10-14": "Columbus Day",
        "2024-11-05": "Election Day",
        "2024-11-28": "Thanksgiving",
        "2024-12-25": "Christmas Day",
    }
    assert want.items() <= got.items()
    next_year = {str(r.date) for r in calendar.holiday_calendar(calendar.rules_table(spark), 2021, 2021).collect()}
    assert "2021-12-31" in next_year


def test_leaderboard_and_improvement(spark):
    rows = [("a", "val", 3.0, 1.0), ("a", "test", 2.0, 1.0), ("b", "val", 2.0, 0.5), ("b", "test", 1.5, 0.75)]
    metrics = spark.createDataFrame(rows, S.METRICS)
    board = results.leaderboard(metrics).collect()
    assert [(r.model, r.rmse_val, r.rmse_test, r.mae_test) for r in board] == [("b", 2.0, 1.5, 0.75), ("a", 3.0, 2.0, 1.0)]
    gain = {(r.model, r.split): r.rmse_gain_pct for r in results.improvement(metrics, "a").collect()}
    assert gain[("b", "test")] == 25.0 and gain[("a", "val")] == 0.0


def test_published_improvement(spark):
    # Published test scores of the naive and the best model.
    rows = [("naive", "test", 2.0170428589866436, 0.9232707023620605), ("best", "test", 1.500867685211481, 0.7586406683697918)]
    got = results.improvement(spark.createDataFrame(rows, S.METRICS), "naive").where("model = 'best'").first()
    assert (round(got.rmse_gain_pct, 1), round(got.mae_gain_pct, 1)) == (25.6, 17.8)


def test_bucket_rows_add_up(spark, sf):
    scored = driver.scored(spark, sf)
    got = binning.bucket_error(scored, S.BUCKET_EDGES, S.BUCKET_LABELS).agg(F.sum("n")).first()[0]
    assert got == scored.count()


def test_sample_is_exact_where_keys_repeat(spark):
    df = spark.range(0, 2000).select((F.col("id") / 2).cast("long").alias("k"), F.lit("x").alias("t"))
    for n in (1, 501, 502, 1999, 2000, 2500):
        for method in ("xxhash64", "md5"):
            assert sampling.sample_exact(df, n, 3, ["k"], method).count() == min(n, 2000)
    hot = df.withColumn("k", F.lit(7))
    assert sampling.sample_exact(hot, 777, 3, ["k"]).count() == 777


def test_quantiles_neither_broadcast_data_nor_rank_it(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(size=4000), np.full(3000, 0.25), [1e300, -1e300]])
    df = spark.createDataFrame([(float(v), int(i % 3)) for i, v in enumerate(values)], "v double, g int")
    got = quantile.exact_quantiles(df, "v", [0.0, 0.001, 0.3, 0.5, 0.77, 1.0], ["g"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Broadcast" not in plan
    for r in got.collect():
        assert r.quantile == pytest.approx(np.quantile(values[np.arange(len(values)) % 3 == r.g], r.prob))


def test_quantiles_of_many_groups(spark, monkeypatch):
    rng = np.random.default_rng(8)
    n = 200_000
    group = np.where(np.arange(n) < 60_000, 7, rng.integers(0, 50_000, n))
    value = np.where(rng.random(n) < 0.3, 5.0, rng.normal(0, 1, n).round(3))
    frame = pd.DataFrame({"g": group, "v": value})
    df = spark.createDataFrame(frame)
    probs = [0.0, 0.05, 0.5, 0.9, 1.0]
    want = {(int(g), q): x for q in probs for g, x in frame.groupby("g").v.quantile(q).items()}
    got = {(r.g, r.prob): r.quantile for r in quantile.exact_quantiles(df, "v", probs, ["g"]).collect()}
    assert len(got) == len(want) > 5 * 45_000
    assert all(got[k] == pytest.approx(x, abs=1e-12) for k, x in want.items())


@pytest.mark.parametrize("slack", [0.002, -0.2])
def test_both_ways_to_quantiles_agree(spark, monkeypatch, slack):
    rows = [(g, h, float(v)) for g, h, m in ((1, "a", 900), (None, "a", 50), (1, None, 3), (2, "b", 1)) for v in np.sin(np.arange(m)) * 100]
    rows += [(3, "c", None), (4, "d", 1e308), (4, "d", -1e308), (4, "d", 0.5)]
    df = spark.createDataFrame(rows, "g int, h string, v double")
    probs = [0.0, 0.001, 0.3, 0.5, 0.77, 1.0]
    want = sorted(map(tuple, quantile.exact_quantiles(df, "v", probs, ["g", "h"]).collect()), key=repr)
    monkeypatch.setattr(quantile, "MOST_GROUPS", 2)
    monkeypatch.setattr(quantile, "SLACK", slack)  # a bracket that misses is widened
    monkeypatch.setattr(quantile, "SLICES", 4)
    got = quantile.exact_quantiles(df, "v", probs, ["g", "h"])
    assert got.columns == ["g", "h", "prob", "quantile"] and sorted(map(tuple, got.collect()), key=repr) == want


def test_small_groups_are_ordered_and_large_ones_narrowed(spark, monkeypatch):
    rows = [(g, float(v)) for g, m in ((1, 500), (None, 30), (2, 40), (3, 41)) for v in np.sin(np.arange(m)) * 100]
    df = spark.createDataFrame([*rows, (4, None)], "g int, v double").repartition(3)
    narrowed, asked = quantile._narrowed, []
    monkeypatch.setattr(quantile, "MOST_GROUPS", 2)
    monkeypatch.setattr(quantile, "FEW_VALUES", 40)
    monkeypatch.setattr(quantile, "_narrowed", lambda x, *rest: asked.extend(r[0] for r in x.select("_b0").distinct().collect()) or narrowed(x, *rest))
    probs = [0.0, 0.05, 0.5, 0.77, 1.0]
    got = {(r.g, r.prob): r.quantile for r in quantile.exact_quantiles(df, "v", probs, ["g"]).collect()}
    values = {g: [v for k, v in rows if k == g] for g in (1, None, 2, 3)}
    assert sorted(asked) == [1, 3] and len(got) == 4 * len(probs)
    assert all(x == pytest.approx(np.quantile(values[g], q), abs=1e-12) for (g, q), x in got.items())
