"""Boosting next to a plain tree learner, and what its rounds cost."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourloom.models import boosting as B
from hourloom.models import curve, trees
from hourloom.plans import queries as Q

COLS = ["a", "b", "c"]


def rows(n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 9, n), rng.integers(0, 4, n), rng.normal(0, 1, n).round(1)]).astype(float)
    y = 2.0 * (x[:, 0] > 4) * (x[:, 1] > 1) + 0.5 * x[:, 2] + rng.normal(0, 0.3, n)
    return x, y


@pytest.fixture(scope="module")
def table(spark):
    x, y = rows()
    made = [(str(i), i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(made, "station_id string, datetime int, a double, b double, c double, departures double").persist()
    yield df
    df.unpersist()


def soft(g, l1):
    return np.sign(g) * max(abs(g) - l1, 0)


def plain_split(x, r, plan):
    """The best split of some rows by trying every threshold: gain, input, threshold."""
    best, at = 0.0, None
    score = lambda q: soft(q.sum(), plan.l1) ** 2 / max(len(q) + plan.l2, 1e-12)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= t
            if min(left.sum(), (~left).sum()) < plan.min_leaf:
                continue
            gain = score(r[left]) + score(r[~left]) - score(r)
            if gain > best * (1 + 1e-12) + 1e-12:
                best, at = gain, (f, t)
    return best, at


def plain_tree(x, r, plan):
    """Predictions of one tree, grown with plain recursion or best leaf first."""
    leaves = [(np.ones(len(r), bool), 0)]
    while plan.leaves is None or len(leaves) < plan.leaves:
        found = []
        for k, (rows_, depth) in enumerate(leaves):
            if plan.depth is None or depth < plan.depth:
                gain, at = plain_split(x[rows_], r[rows_], plan)
                if at:
                    found.append((-gain, k, at))
        if not found:
            break
        _, k, (f, t) = min(found)
        rows_, depth = leaves.pop(k)
        leaves += [(rows_ & (x[:, f] <= t), depth + 1), (rows_ & (x[:, f] > t), depth + 1)]
    out = np.zeros(len(r))
    for rows_, _ in leaves:
        out[rows_] = soft(r[rows_].sum(), plan.l1) / (rows_.sum() + plan.l2)
    return out


def predictions(model, df):
    return np.array([r.prediction for r in model.transform(df).orderBy("datetime").collect()])


@pytest.mark.parametrize("one_task", [B.ONE_TASK_ROWS, 0])
@pytest.mark.parametrize(
    "plan",
    [
        dict(depth=3), dict(depth=2, l2=7.0), dict(depth=3, l1=4.0, l2=1.0, min_leaf=25),
        dict(depth=None, leaves=7), dict(depth=None, leaves=9, l1=2.0, l2=3.0, min_leaf=15), dict(depth=3, leaves=6),
    ],
)
def test_trees_equal_plain_ones(table, plan, one_task, monkeypatch):
    monkeypatch.setattr(B, "ONE_TASK_ROWS", one_task)
    plan = {"rounds": 4, "step": 0.4, "rows": 1.0, "columns": 1.0, **plan}
    model = trees.fit_gbt(table, None, COLS, **plan)
    x, y = rows()
    want = np.full(len(y), y.mean())
    for _ in range(4):
        want += 0.4 * plain_tree(x, y - want, B.Plan(**plan))
    assert np.allclose(predictions(model, table), want)


def test_one_tree_a_round_and_no_round_twice(table, monkeypatch):
    monkeypatch.setattr(B, "ONE_TASK_ROWS", 0)
    grown, passes = [], []
    grow, sums = B.grow, B.Spread.sums
    monkeypatch.setattr(B, "grow", lambda *args: grown.append(1) or grow(*args))
    monkeypatch.setattr(B.Spread, "sums", lambda self, of: passes.append(1) or sums(self, of))
    noise = table.withColumn("departures", F.rand(1) * 100)
    _, run = B.fit(table, noise, B.Plan(rounds=60, depth=3, step=0.5, patience=4), COLS, "departures", 32)
    assert len(grown) == len(run.trees) == len(run.errors) < 60
    # The mean, then at most one pass a level and round, and the one that finds the stop.
    assert len(passes) <= 2 + 3 * len(grown)
    assert B.best_round(run.errors, 4) == (len(run.errors) - 4, True)


def test_a_broken_run_goes_on_from_its_last_state(spark, table, monkeypatch, tmp_path):
    monkeypatch.setattr(B, "CUT", 3)
    plan = B.Plan(rounds=8, depth=3, columns=0.7, rows=0.6)
    whole, _ = B.fit(table, table, plan, COLS, "departures", 32, str(tmp_path / "whole"))
    grow, grown = B.grow, []

    def breaks(*args):
        if len(grown) == 7:
            raise RuntimeError("lost")
        grown.append(1)
        return grow(*args)

    monkeypatch.setattr(B, "grow", breaks)
    with pytest.raises(RuntimeError):
        B.fit(table, table, plan, COLS, "departures", 32, str(tmp_path / "broken"))
    again = []
    monkeypatch.setattr(B, "grow", lambda *args: again.append(1) or grow(*args))
    model, run = B.fit(table, table, plan, COLS, "departures", 32, str(tmp_path / "broken"))
    assert len(again) == 2 and len(run.trees) == 8 and len(run.errors) == 8
    assembled = B.F.col("datetime")
    from hourloom.models.linear import assemble

    data = assemble(table, COLS)
    a, b = (np.array([r.prediction for r in m.transform(data).orderBy(assembled).collect()]) for m in (whole, model))
    assert np.allclose(a, b)


def test_columns_are_drawn_per_tree_and_rows_per_round(table):
    plan = B.Plan(rounds=12, depth=3, columns=0.34, rows=0.5)
    _, run = B.fit(table, None, plan, COLS, "departures", 64)
    used = [{f for f in t.input if f >= 0} for t in run.trees]
    assert all(len(u) == 1 for u in used) and len({min(u) for u in used}) == 3
    sizes = [t.count[0] for t in run.trees]
    assert len(set(sizes)) > 1 and all(240 < n < 360 for n in sizes)


def test_wide_codes_and_quantile_cuts(spark):
    values = [(str(i), i, float(i), float((i * 37) % 1000)) for i in range(2000)]
    df = spark.createDataFrame(values, "station_id string, datetime int, a double, departures double")
    for bins, kind in ((255, 1), (511, 2)):
        edges = B.cut_points(df, ["a"], bins)
        assert 0.8 * bins < len(edges[0]) < bins
        blocks = B.binned(df, None, ["a"], "departures", edges).collect()
        assert sum(len(b["id"]) // 8 for b in blocks) == 2000 and all(len(b["x"]) == kind * len(b["id"]) // 8 for b in blocks)


def test_inputs_of_few_bins_share_codes_and_come_apart():
    rng = np.random.default_rng(5)
    sizes = [3, 1, 300, 4, 70, 2]
    x = np.stack([rng.integers(0, s, 500) for s in sizes]).astype(np.uint16)
    packing = B.Packing.of(sizes)
    assert sorted(f for g in packing.groups for f in g) == [0, 2, 3, 4, 5] and len(packing.groups) < 4
    codes, rest = packing.codes(x), rng.normal(0, 1, 500)
    block = (False, codes, rest, np.zeros(500), np.arange(500), None)
    inputs = [1, 2, 3, 5]
    count, total = (packing.apart(s, inputs) for s in B.summed(block, iter([(0, np.arange(500))]), 1, packing, inputs))
    want = [np.bincount(x[f], minlength=sizes[f]) for f in inputs], [np.bincount(x[f], rest, sizes[f]) for f in inputs]
    assert (count[0] == np.concatenate(want[0])).all() and np.allclose(total[0], np.concatenate(want[1]))


def test_passes_below_the_root_read_only_the_drawn_rows(table, monkeypatch):
    monkeypatch.setattr(B, "ONE_TASK_ROWS", 0)
    read, sums = [], B.Spread.sums

    def spy(self, of):
        read.append(sums(self, lambda b: [0 if b[0] else len(b[2])])[0])
        return sums(self, of)

    monkeypatch.setattr(B.Spread, "sums", spy)
    B.fit(table, table, B.Plan(rounds=2, depth=3, rows=0.5), COLS, "departures", 32)
    below = [n for n in read if n != 600]
    assert len(below) == 4 and all(240 < n < 360 for n in below)


def test_only_codes_are_exchanged(spark, table):
    plan = B.binned(table, None, COLS, "departures", B.cut_points(table, COLS, 32))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.rindex("MapInArrow") and plan.count("MapInArrow") == 2


def test_null_inputs_raise(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0)], "a double, departures double")
    with pytest.raises(Exception, match="null or NaN"):
        B.fit(df, None, B.Plan(rounds=1), ["a"], "departures", 8)


def test_a_nested_layout_gives_exact_pruned_prefixes(spark, table):
    layout = curve.nested_layout(table, ["station_id", "datetime"], 42, "md5", parts=3)
    order = F.md5(F.concat_ws("|", "station_id", F.col("datetime").cast("string"), F.lit("42")))
    want = [r.datetime for r in table.orderBy(order, "station_id", "datetime").collect()]
    assert layout.total == 600 and len([s for s in layout.sizes if s]) == 3
    for n in (0, 1, 200, 201, 599, 600):
        part = layout.first(n)
        assert part.columns == table.columns and {r.datetime for r in part.collect()} == set(want[:n])
    assert "PushedFilters: [IsNotNull(_place), LessThan(_place" in layout.first(5)._jdf.queryExecution().toString()


def test_a_layout_has_tasks_by_its_rows_and_serves_several_calls(spark, table, monkeypatch):
    monkeypatch.setattr(curve, "LAYOUT_ROWS", 60)
    layout = curve.nested_layout(table, ["station_id", "datetime"], 42)
    assert layout.total == 600 and len([n for n in layout.sizes if n]) == 10 and max(layout.sizes) < 120
    monkeypatch.setattr(curve, "nested_layout", lambda *args: pytest.fail("laid out again"))
    fit = {"ridge": lambda train, val: curve.fit_ridge(train, COLS)}
    runs = curve.learning_curve(spark, table, table, table, ["ridge"], fit, [0.5, 1.0], layout=layout)
    assert sorted(r.n_rows for r in runs.collect()) == [300, 600]


@pytest.mark.parametrize("ask", [Q.learning_curve, Q._runs])
def test_curves_of_one_input_store_only_that_input(spark, ask, monkeypatch):
    class Stop(Exception):
        pass

    def store(df, label):
        seen.extend(df.columns)
        raise Stop

    seen = []
    monkeypatch.setattr(Q, "_model_rows", lambda spark, sf: spark.range(1).selectExpr("1 AS split", *[f"1 AS {c}" for c in (*Q.ROW, "departures", *Q.S.FEATURES)]))
    monkeypatch.setattr(Q.sinks, "materialize", store)
    with pytest.raises(Stop):
        ask(spark, None)
    assert len(seen) == 5 and "departures" in seen


def test_models_over_shared_codes_are_those_of_their_inputs_alone(spark, table):
    codes = B.quantised(table, None, COLS, "departures", 64)
    plan = {"rounds": 3, "depth": 2, "rows": 0.7, "columns": 1.0, "bins": 64}
    for names in (["b"], ["c", "a"]):
        alone, shared = (trees.fit_gbt(table, None, names, codes=c, **plan).stages[-1] for c in (None, codes))
        strip = lambda m: [t.toDebugString.split("\n", 1)[1] for t in m.trees]
        assert strip(alone) == strip(shared)
    with pytest.raises(ValueError):
        trees.fit_gbt(table, table, COLS, codes=codes, bins=64, rounds=1)
    with pytest.raises(ValueError):
        trees.fit_gbt(table, None, COLS, codes=codes, bins=32, rounds=1)


def test_tree_gains_quantises_its_rows_once(spark, sf, monkeypatch):
    made, binned = [], B.binned
    monkeypatch.setattr(B, "binned", lambda train, val, features, *rest: made.append(features) or binned(train, val, features, *rest))
    assert Q.tree_gains(spark, sf).count() == len(Q.FEW_VALUES)
    assert made == [Q.FEW_VALUES]


def test_without_validation_no_pass_follows_the_last_tree():
    x, y = rows()
    block = (False, np.searchsorted(np.arange(9), x.T).astype(np.uint8), y, np.zeros(len(y)), np.arange(len(y), dtype=np.uint64), None)
    passes = []

    class Counted(B.Held):
        def sums(self, of):
            passes.append(of)
            return super().sums(of)

    B.boost(Counted([block]), B.Plan(rounds=2, depth=1, rows=1.0, columns=1.0), [10, 10, 10], False)
    assert len(passes) == 1 + 2  # the start value, then one root a tree
