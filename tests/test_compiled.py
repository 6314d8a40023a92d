"""Compiled loops next to the plain ones of the same step."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourloom.models import boosting as B
from hourloom.models import trees
from hourloom.plans import queries as Q

COLS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.integers(0, 30, 2400), rng.integers(0, 4, 2400), rng.normal(0, 1, 2400).round(2), np.ones(2400)]).astype(float)
    y = 2.0 * (x[:, 0] > 14) * (x[:, 1] > 1) + 0.5 * x[:, 2] + rng.normal(0, 0.3, 2400)
    # A null key, and rows that come twice.
    made = [(str(i) if i % 7 else None, i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(made + made[:50], "station_id string, datetime int, a double, b double, c double, d double, departures double").persist()
    yield df
    df.unpersist()


@pytest.mark.parametrize(
    "plan",
    [
        dict(depth=4), dict(depth=3, l1=4.0, l2=1.0, min_leaf=25), dict(depth=None, leaves=12, columns=0.6),
        dict(depth=4, leaves=9, l1=2.0, l2=3.0, min_leaf=15), dict(depth=3, columns=0.3),
    ],
)
@pytest.mark.parametrize("bins", [64, 400])
def test_compiled_rounds_equal_the_plain_ones(table, plan, bins, monkeypatch):
    monkeypatch.setattr(B, "PIECE_ROWS", 700)
    monkeypatch.setattr(B, "PART_ROWS", 300)
    monkeypatch.setattr(B, "CUT", 3)  # parts are made anew
    train, val = table.where("datetime % 4 > 0"), table.where("datetime % 4 = 0")
    plan = B.Plan(**{"rounds": 9, "step": 0.3, "rows": 0.7, "patience": 3, **plan})
    codes = B.quantised(train, val, COLS, "departures", bins)
    sizes = [len(e) + 1 for e in codes.edges]
    plain = B.spread(table.sparkSession, codes.blocks, len(COLS))
    want = B.boost(plain, plan, sizes, True)
    plain.close()
    for one_task in (True, False):
        got, clipped = B.compiled(codes.blocks, plan, sizes, True, len(COLS), one_task=one_task)
        assert got.start == pytest.approx(want.start, rel=1e-12) and got.errors == pytest.approx(want.errors, rel=1e-9)
        assert [(t.input, t.cut, t.left, t.count) for t in got.trees] == [(t.input, t.cut, t.left, t.count) for t in want.trees]
        for a, b in zip(got.trees, want.trees, strict=True):
            assert a.value == pytest.approx(b.value, rel=1e-7, abs=1e-9) and a.gain == pytest.approx(b.gain, rel=1e-7, abs=1e-7)
        assert len(clipped) == len(got.errors)


def test_larger_tables_are_boosted_by_the_compiled_loops(table, monkeypatch):
    monkeypatch.setattr(B, "ONE_TASK_ROWS", 100)
    monkeypatch.setattr(B, "COMPILED_ROWS", 100)
    monkeypatch.setattr(B, "grow", lambda *args: pytest.fail("a pass in Python"))
    model = trees.fit_gbt(table, table, COLS, rounds=3, depth=3)
    assert model.stages[-1].getNumTrees == 4  # the start value is a tree


def test_rows_are_scored_once_for_a_report(spark):
    rows = spark.createDataFrame([(s, float(i), float(i + 1)) for i, s in enumerate(["val", "test"] * 3)], "split string, departures double, lag_1h double")
    asked = []

    class Model:
        def transform(self, df):
            asked.append(1)
            return df.withColumn("prediction", F.col("departures") - 0.5)

    got = {r.split: (r.n, r.n_negative, r.n_missing, r.beats_naive) for r in Q._report(Model(), rows, "m").collect()}
    assert got == {"val": (3, 0, 0, True), "test": (3, 0, 0, True)} and len(asked) == 1
