"""The registered model queries run the reported settings."""

import inspect

import pytest

from hourloom.models import curve, search, trees
from hourloom.plans import queries as Q


@pytest.fixture
def calls(monkeypatch):
    seen = []
    keep = lambda name: lambda *args, **kw: seen.append((name, args, kw))
    monkeypatch.setattr(Q, "_parts", lambda spark, sf: ("rows", "train", "val"))
    monkeypatch.setattr(Q, "_fit_and_report", lambda spark, sf, name, fit: fit("train", "val"))
    monkeypatch.setattr(Q.trees, "fit_gbt", keep("gbt"))
    monkeypatch.setattr(Q.mlp, "fit_mlp", keep("mlp"))
    monkeypatch.setattr(Q.search, "search", keep("search"))
    return seen


def test_boosting_and_network_run_their_presets(calls):
    Q.boost_scores(None, None)
    Q.boost_leaves_scores(None, None)
    Q._boosted(None, None)
    Q.mlp_scores(None, None)
    rows = ("train", "val")
    assert calls == [("gbt", rows, trees.BOOST), ("gbt", rows, trees.BOOST_LEAVES), ("gbt", rows, trees.BOOST), ("mlp", ("train",), {})]


def test_the_search_runs_all_trials_and_rounds(calls):
    Q._search(None, None)
    (_, _, given), = calls
    assert given.pop("n_trials") == search.TRIALS and not {"rounds", "patience", "max_rows", "space"} & set(given)
    assert "rounds" not in inspect.getsource(Q.best_trial_refit)


def test_a_query_runs_all_trainers(monkeypatch):
    asked = []

    class Runs:
        def drop(self, *names):
            return self

    monkeypatch.setattr(Q, "_parts", lambda spark, sf: ("rows", "train", "val"))
    monkeypatch.setattr(Q.clean, "for_split", lambda rows, *s: s)
    monkeypatch.setattr(Q, "shared_dir", lambda spark, label: label)
    monkeypatch.setattr(Q.curve, "learning_curve", lambda *args, **kw: asked.append((args, kw)) or Runs())
    Q.learning_curve_trainers(None, None)
    (args, given), = asked
    assert args[4] == list(curve.TRAINERS) and not {"trainers", "fractions", "caps"} & set(given)
