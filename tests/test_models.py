import numpy as np
import pytest
from pyspark.sql import functions as F

from hourloom.models import boosting, curve, importance, linear, mlp, search, trees
from hourloom.models.boosting import best_round
from hourloom.operators import results
from hourloom.sources import sinks

COLS = ["a", "b", "c"]


def table(spark, n=200, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 5.0, 0.2] + [0.0, 3.0, -1.0]
    y = 2.0 + x @ [1.0, -0.5, 4.0] + rng.normal(size=n)
    df = spark.createDataFrame(
        [(str(i), i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))],
        "station_id string, datetime int, a double, b double, c double, departures double",
    )
    return x, y, df


@pytest.mark.parametrize("scale", [True, False])
@pytest.mark.parametrize("alpha", [1.0, 40.0])
def test_ridge_equals_closed_form(spark, scale, alpha):
    x, y, df = table(spark)
    model = linear.fit_ridge(df, COLS, alpha=alpha, scale=scale).stages[-1]
    centre = x.mean(0)
    spread = x.std(0) if scale else np.ones(3)
    z = (x - centre) / spread
    w = np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ (y - y.mean())) / spread
    assert np.allclose(model.coefficients.toArray(), w, atol=1e-6)
    assert model.intercept == pytest.approx(y.mean() - centre @ w, abs=1e-6)


def test_ridge_of_a_constant_target(spark):
    _, _, df = table(spark)
    model = linear.fit_ridge(df.withColumn("departures", F.lit(3.0)), COLS)
    assert model.transform(df).agg(F.max(F.abs(F.col("prediction") - 3.0))).first()[0] < 1e-9


def test_null_input_raises(spark):
    df = spark.createDataFrame([(1.0, None)], "a double, b double")
    with pytest.raises(Exception):
        linear.assemble(df, ["a", "b"]).collect()


def test_standardize_uses_population_spread(spark):
    x, _, df = table(spark)
    df = df.withColumn("flat", F.lit(4.0))
    got = linear.apply_standard(df, linear.standardize(df, [*COLS, "flat"]), [*COLS, "flat"])
    z = np.array([[r.a, r.b, r.c, r.flat] for r in got.orderBy("datetime").collect()])
    assert np.allclose(z[:, :3], (x - x.mean(0)) / x.std(0)) and np.allclose(z[:, 3], 0)


def test_patience_rule():
    assert best_round([3, 2, 1, 1.5, 1.4, 1.3], 3) == (3, True)
    assert best_round([3, 2, 1, 1.5, 1.4], 3) == (3, False)
    assert best_round([3, 2, 1], 3) == (3, False)
    assert best_round([1, 1, 1, 1], 2) == (1, True)


def signal(spark, n=3000):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 1, size=(n, 3))
    y = np.maximum(0, 5 * x[:, 0] + 3 * (x[:, 1] > 0.5) + rng.normal(0, 0.3, n))
    split = np.where(np.arange(n) % 5 == 0, "val", np.where(np.arange(n) % 5 == 1, "test", "train"))
    rows = [(str(i), i, *map(float, r), float(t), s) for i, (r, t, s) in enumerate(zip(x, y, split))]
    df = spark.createDataFrame(
        rows, "station_id string, datetime int, a double, b double, c double, departures double, split string"
    )
    return df, float(y.std())


@pytest.fixture(scope="module")
def data(spark):
    df, spread = signal(spark)
    df = df.persist()
    yield {s: df.where(F.col("split") == s) for s in ("train", "val", "test")}, spread
    df.unpersist()


def rmse_of(model, rows):
    return results.evaluate(model.transform(rows), "m").first().rmse


def test_every_model_beats_the_mean(spark, data):
    parts, spread = data
    fits = {
        "ridge": linear.fit_ridge(parts["train"], COLS),
        "rf": trees.fit_rf(parts["train"], COLS, trees=10, depth=6),
        "gbt": trees.fit_gbt(parts["train"], parts["val"], COLS, rounds=20, step=0.3, depth=4, patience=4),
        "mlp": mlp.fit_mlp(parts["train"], COLS, layers=(16, 8), max_epochs=15, partitions=2, batch=20, rate=0.01),
    }
    scores = {name: rmse_of(m, parts["test"]) for name, m in fits.items()}
    assert all(s < 0.7 * spread for s in scores.values()), (scores, spread)
    assert scores["gbt"] < scores["ridge"]


def test_row_cap_trains_on_an_exact_sample(spark, data):
    parts, spread = data
    model = trees.fit_rf(parts["train"], COLS, trees=5, depth=4, min_leaf=1, max_rows=300)
    assert rmse_of(model, parts["test"]) < spread


def test_a_forest_of_many_rows_is_fitted_in_groups_of_trees(spark, data, monkeypatch):
    parts, spread = data
    fitted, n = [], parts["train"].count()

    class Counted(trees.RandomForestRegressor):
        def _fit(self, rows):
            fitted.append(super()._fit(rows))
            assert self.getMaxMemoryInMB() <= 256
            return fitted[-1]

    monkeypatch.setattr(trees, "RandomForestRegressor", Counted)
    monkeypatch.setattr(trees, "ROWS_TIMES_TREES", 3 * n)
    model = trees.fit_rf(parts["train"], COLS, trees=7, depth=4)
    assert sorted(f.getNumTrees for f in fitted) == [2, 2, 3]
    whole = model.stages[-1]
    assert whole.getNumTrees == 7 and whole.numFeatures == len(COLS)
    drawn = lambda f: [t.toDebugString.split("\n", 1)[1] for t in f.trees]
    assert drawn(whole) == [t for f in fitted for t in drawn(f)] and len(set(drawn(whole))) == 7
    assert rmse_of(model, parts["test"]) < 0.7 * spread


def test_shorter_boosting_run_is_a_prefix(spark, data):
    parts, _ = data
    long = trees.fit_gbt(parts["train"], None, COLS, rounds=6, depth=3).stages[-1]
    short = trees.fit_gbt(parts["train"], None, COLS, rounds=3, depth=3).stages[-1]
    assert [t.toDebugString.split("\n", 1)[1] for t in long.trees[:4]] == [  # the start value is a tree
        t.toDebugString.split("\n", 1)[1] for t in short.trees
    ]


def test_early_stop_keeps_the_best_round(spark, data):
    parts, _ = data
    val = parts["val"].withColumn("departures", F.rand(1))
    model = trees.fit_gbt(parts["train"], val, COLS, rounds=40, step=0.5, depth=3, patience=2)
    assert model.stages[-1].getNumTrees < 6


def test_importance(spark, data):
    parts, _ = data
    model = trees.fit_gbt(parts["train"], None, [*COLS], rounds=5, depth=3, columns=1.0)
    got = {r.feature: r for r in importance.tree_importance(spark, model, COLS, {"a": "First"}).collect()}
    assert got["a"].label == "First" and got["b"].label == "b"
    # One split on b explains 9 / 4 of the variance, several on a at most 25 / 12, c nothing.
    assert got["b"].gain > got["a"].gain > 100 * got["c"].gain
    assert sum(r.gain_pct for r in got.values()) == pytest.approx(100)
    assert sum(r.splits_pct for r in got.values()) == pytest.approx(100)


def test_saved_model_predicts_the_same(spark, data, tmp_path):
    parts, _ = data
    model = trees.fit_rf(parts["train"], COLS, trees=3, depth=3)
    sinks.save_model(model, str(tmp_path / "m"))
    assert rmse_of(sinks.load_model(str(tmp_path / "m")), parts["test"]) == rmse_of(model, parts["test"])


def test_trials_are_seeded_and_in_range():
    a, b = search.draw_trials(search.SPACE, 30, 42), search.draw_trials(search.SPACE, 5, 42)
    assert a[:5] == b and a != search.draw_trials(search.SPACE, 30, 43)
    for t in a:
        assert 63 <= t["num_leaves"] <= 511 and 0.01 <= t["learning_rate"] <= 0.2
        assert t["max_bin"] in (255, 511) and set(search.SPACE) | {"trial"} == set(t)
        assert 0 <= t["reg_alpha"] <= 2 and 0 <= t["reg_lambda"] <= 10
        plan = search.boost_args(t)
        assert plan.pop("bins") == t["max_bin"] and boosting.Plan(**plan).leaves == t["num_leaves"]


SMALL_SPACE = {
    **search.SPACE, "num_leaves": search.Param("int", 3, 8), "max_bin": search.Param("choice", options=(32, 64)),
}


def test_search_keeps_a_ledger_and_finds_the_best(spark, data, monkeypatch, tmp_path):
    parts, _ = data
    path, fitted = str(tmp_path / "ledger"), []
    one = search._trial
    monkeypatch.setattr(search, "_trial", lambda codes, sizes, plan: fitted.append(plan) or one(codes, sizes, plan))
    args = dict(rounds=3, patience=2, max_rows=500, path=path, features=COLS)
    search.search(spark, parts["train"], parts["val"], SMALL_SPACE, n_trials=2, **args)
    assert len(fitted) == 2
    trials = search.search(spark, parts["train"], parts["val"], SMALL_SPACE, n_trials=4, **args)
    assert len(fitted) == 4  # trials of the ledger are not run again
    rows = sorted(trials.collect(), key=lambda r: r.trial)
    assert [r.trial for r in rows] == [0, 1, 2, 3]
    drawn = search.draw_trials(SMALL_SPACE, 4, 42)
    assert all(getattr(r, k) == pytest.approx(d[k]) for r, d in zip(rows, drawn) for k in SMALL_SPACE)
    best = search.best_params(trials, SMALL_SPACE).first()
    assert best.best_val_rmse == min(r.val_rmse for r in rows)
    monkeypatch.setattr(search, "fit_gbt", lambda train, val, **kw: trees.fit_gbt(train, val, COLS, **kw))
    model = search.refit_best(parts["train"], parts["val"], best.asDict(), rounds=4, patience=2)
    assert 2 <= model.stages[-1].getNumTrees <= 5


def test_a_trial_in_one_task_equals_the_spread_fit(spark, data):
    parts, _ = data
    plan = boosting.Plan(rounds=4, step=0.3, depth=None, leaves=6, l1=0.5, l2=2.0, rows=0.7, patience=9)
    edges = boosting.cut_points(parts["train"], COLS, 64)
    codes = boosting.binned(parts["train"], parts["val"], COLS, "departures", edges).persist()
    held = search._trial(codes, [len(e) + 1 for e in edges], plan)
    model = boosting.to_model(spark, *_spread_run(spark, codes, edges, plan), edges, plan, "departures")
    rows = linear.assemble(parts["val"], COLS)
    got = model.transform(rows).agg(F.sqrt(F.avg((F.greatest("prediction", F.lit(0.0)) - F.col("departures")) ** 2))).first()[0]
    assert held == pytest.approx(got, rel=1e-9)
    codes.unpersist()


def _spread_run(spark, codes, edges, plan):
    data = boosting.spread(spark, codes, len(COLS))
    run = boosting.boost(data, plan, [len(e) + 1 for e in edges], True)
    data.close()
    return run, run.kept(plan.patience)


def test_learning_curve_resumes(spark, data, tmp_path):
    parts, _ = data
    calls = []

    def fit(train, val):
        calls.append(train.count())
        return linear.fit_ridge(train, COLS)

    args = (spark, parts["train"], parts["val"], parts["test"])
    path = str(tmp_path / "curve")
    curve.learning_curve(*args, ["ridge"], {"ridge": fit}, [0.1, 0.4], path=path)
    got = curve.learning_curve(*args, ["ridge"], {"ridge": fit}, [0.1, 0.4, 1.0], path=path, caps={"ridge": 1000})
    n = parts["train"].count()
    assert sorted(calls) == [int(n * 0.1), int(n * 0.4), 1000]  # runs go side by side
    assert sorted(r.fraction for r in got.collect()) == [0.1, 0.4, 1.0]
    with pytest.raises(ValueError):
        curve.parse_models("ridge, nope")
    assert curve.parse_models(" Ridge,RF") == ["ridge", "rf"]


def test_steps_of_the_network_are_adam_in_single_precision():
    rng = np.random.default_rng(4)
    shapes = mlp._shapes(3, (5, 4))
    start = mlp._initial(shapes, 1)
    x, y = rng.normal(size=(60, 3)), rng.normal(size=60)
    adam = mlp._Adam(start, shapes, 0.01, 0.1)
    flat, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)

    def loss(w, at):
        weights = mlp._unpack(w, shapes)
        miss = mlp._forward(x[at], weights)[-1][:, 0] - y[at]
        return (miss @ miss + 0.1 * sum((a * a).sum() for a, _ in weights)) / 2 / len(at)

    for t in range(1, 4):
        at = np.arange(60)[(t - 1) * 20 : t * 20]
        g = np.array([(loss(flat + d, at) - loss(flat - d, at)) / 2e-6 for d in 1e-6 * np.eye(len(flat))])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        flat = flat - 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        adam.learn(x[at].astype(np.float32), y[at].astype(np.float32))
    assert adam.flat.dtype == np.float32 and np.abs(adam.flat - flat).max() < 2e-3
