"""What a fit grows and keeps: the models that a query needs, of the rows that they use."""

from types import SimpleNamespace

import numpy as np

from shelfwise.operators import tree_boosting as boosting
from shelfwise.plans import forecasts
from shelfwise.plans.series import HORIZONS


def test_queries_fit_the_models_they_need(spark, monkeypatch):
    f = forecasts.Forecasts(None)
    f.kept = {"search": [("variant", "squared", True, 0, 1.0, True)], "strategies": {"all": "first"}, "strategy": "all"}
    fitted = []
    f.fit = lambda specs: (fitted.append([s.use for s in specs]), [s.use for s in specs])[1]
    monkeypatch.setattr(forecasts, "forecasts_of", lambda spark, sf_dir: f)
    monkeypatch.setattr(boosting, "permutation_importance", lambda model, rows, repeats: model)
    f.period = lambda h, name: None
    assert forecasts.h13_importance(None, "") == "first" and not fitted
    monkeypatch.setattr(forecasts, "_each_horizon", lambda make: None)
    forecasts.h12_intervals(SimpleNamespace(), "")
    assert fitted == [[f"{kind}_{h}_all" for h in HORIZONS for kind in ("train", "known") if (kind, h) != ("train", HORIZONS[0])]]
    # later ones add what is missing
    f.models(("train", "known", "every"))
    assert fitted[1:] == [[f"every_{h}_all" for h in HORIZONS]]


def test_search_uses_every_training_origin(spark, monkeypatch):
    f = forecasts.Forecasts(None)
    fitted = []
    f.fit = lambda specs: (fitted.extend(specs), specs)[1]
    monkeypatch.setattr(forecasts.Forecasts, "_wape", lambda self, spec: float(spec.rounds))
    assert len(f.search) == len(fitted) == 6
    origins = spark.createDataFrame([(d, 7, "train", 1, 0) for d in range(9000, 9010)] + [(9010, 7, "validation", 1, 0)], "day_no long, n_seen int, period_7 string, target_7 long, censored_7 long")
    named = forecasts.uses()
    assert all(origins.where(named[s.use]).count() == 10 for s in fitted)


def test_models_on_the_same_rows_are_fitted_once(spark, monkeypatch):
    """The search has fitted all training origins; without censored ones among them nothing is left to fit for the choice of targets."""
    monkeypatch.setattr(forecasts.Forecasts, "_wape", lambda self, spec: float(spec.l2))
    for censored, more in ((0, []), (3, ["train_7_uncensored"])):
        f = forecasts.Forecasts(None)
        fitted = []
        f.fit = lambda specs: (fitted.extend(specs), list(specs))[1]
        f.kept["rows"] = spark.createDataFrame([(9000, "train", 1, 0), (9001, "train", 2, censored), (9010, "validation", 1, 1)], "day_no long, period_7 string, target_7 long, censored_7 long")
        models = f.strategies
        assert [s.use for s in fitted[6:]] == more and models["all"] is fitted[0] and (models["uncensored"] is models["all"]) == (not more)


def test_sums_are_sent_as_they_are():
    rng = np.random.default_rng(3)
    n = rng.integers(0, 3, (4, 50)) * 70_000
    held = n > 0
    small, large = (np.where(held, np.rint(rng.normal(size=n.shape) * scale) * boosting.STEP, 0.0) for scale in (1e3, 2.0**45))
    for g, h in ((small, None), (large, small), (np.where(held, np.inf, 0.0), large)):
        back = boosting._unpacked(boosting._packed([None, [g, h, n]]))
        assert back[0] is None and (back[1][0] == g).all() and (back[1][2] == n).all()
        assert back[1][1] is None if h is None else (back[1][1] == h).all()
    wide = [[small, None, n]]
    assert len(boosting._packed(wide)) < 0.5 * len(boosting.pickle.dumps(wide))


def test_unused_rows_are_not_kept(monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 7)
    uses = np.array([[1, 0, 0, 1, 0], [0, 0, 1, 0, 0], [1, 1, 1, 1, 1]], bool)
    block = {"bins": np.arange(10, dtype=np.uint8).reshape(2, 5), "targets": np.arange(15.0).reshape(3, 5), "uses": uses, "margins": np.zeros((2, 5))}
    got = list(boosting._joined(iter([block] * 5), [2, 0], [0, 1]))
    assert [b["last"] for b in got] == [False, False, True] and [b["bins"].shape[1] for b in got] == [6, 6, 3]
    assert got[2]["bins"].tolist() == [[0, 2, 3], [5, 7, 8]] and got[2]["targets"].tolist() == [[10.0, 12.0, 13.0], [0.0, 2.0, 3.0]]
    assert got[2]["uses"].tolist() == [[True, False, True], [False, True, False]]
