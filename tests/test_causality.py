"""The causality harness finds planted leaks and passes what is causal."""

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.plans import causality
from tests.test_whole_job import mart as small_mart


@pytest.fixture(scope="module")
def facts(spark):
    rng = np.random.default_rng(7)
    sales = [(s, k, 1, int(d), int(rng.integers(1, 30)), 100) for s in (1, 2) for k in (1, 2) for d in np.flatnonzero(rng.random(130) < 0.6)] + [(1, 1, 1, 129, 1, 100)]
    receipts = [(s, k, 1, d, 300, 50) for s in (1, 2) for k in (1, 2) for d in range(0, 130, 9)]
    made = small_mart(spark, sales, receipts)
    return causality.Mart(made.roles, {"t_ledger": made.table("t_ledger").cache()})


def test_perturbations_change_what_comes_after_the_day_only(spark, facts):
    day = spark.createDataFrame([(9600,)], "as_of long")
    for name in causality.SCRAMBLED:
        whole = facts.table(name)
        before = whole.where("day_no <= 9600")
        assert causality.differing(before, causality.cut(facts, day).table(name)).first().differing == 0
        mixed = causality.scrambled(facts, day).table(name)
        assert causality.differing(before, mixed.where("day_no <= 9600")).first().differing == 0
        assert mixed.columns == whole.columns and mixed.count() == whole.count()
        after = mixed.where("day_no > 9600")
        assert causality.differing(whole.where("day_no > 9600"), after).first().differing > after.count()


def test_differing_counts_repeated_rows(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, 0.5)], "x int, y double")
    b = spark.createDataFrame([(1, None), (2, 0.5), (3, 1.0)], "x int, y double")
    assert tuple(causality.differing(a, b).first()) == (3, 2) and tuple(causality.differing(a, a).first()) == (3, 0)
    assert tuple(causality.differing(a.limit(0), a.limit(0)).first()) == (0, 0)


def lead(mart, day):
    of = W.partitionBy("site_key", "maker").orderBy("day_no")
    return causality.known(mart.table("t_ledger").select("site_key", "maker", "day_no", F.lead("sold").over(of).alias("tomorrow")), day)


def centred(mart, day):
    of = W.partitionBy("site_key", "maker").orderBy("day_no").rowsBetween(-3, 3)
    return causality.known(mart.table("t_ledger").select("site_key", "maker", "day_no", F.sum("sold").over(of).alias("week")), day)


def share_of_all(mart, day):
    return causality.known(mart.table("t_ledger").select("site_key", "maker", "day_no", (F.col("sold") / F.sum("sold").over(W.partitionBy("site_key", "maker"))).alias("share")), day)


def test_planted_leaks_are_caught_and_causal_plans_pass(facts):
    leaks = {"lead": lead, "centred": centred, "share": share_of_all}
    causal = {"features": causality.features_known, "series": causality.series_known, "lots": causality.lots_known, "state": causality.decisions.pair_state}
    found = {(r.what, r.how): r for r in causality.checked(facts, [30], leaks | causal).collect()}
    assert len(found) == 2 * 7
    for (what, _), r in found.items():
        assert r.n_rows > 0 and (r.differing > 0) == (what in leaks), r
    # a day on which lots are still good
    for r in causality.checked(facts, [100], {"live lots": causality.decisions.live_lots}).collect():
        assert r.n_rows > 0 and r.differing == 0


def test_inputs_of_the_queue_are_made_once_for_each_mart(spark, facts, monkeypatch):
    monkeypatch.setattr(causality, "roles", lambda spark, sf_dir: facts.roles)
    monkeypatch.setattr(causality, "Mart", lambda roles, given=None: causality.decisions.Mart(roles, given if given is not None else facts.given))
    made = []
    for name in ("pair_state", "live_lots", "baseline_forecasts"):
        real = getattr(causality.decisions, name)
        monkeypatch.setattr(causality.decisions, name, lambda *args, name=name, real=real: (made.append(name), real(*args))[1])
    found = {(r.what, r.how): r for r in causality.y12_causality(spark, "").collect()}
    assert len(found) == 8 and all(r.differing == 0 and r.days_back == 60 for r in found.values())
    assert found["state", "cut"].n_rows == found["queue", "scrambled"].n_rows == 4
    assert {name: made.count(name) for name in set(made)} == {"pair_state": 3, "live_lots": 3, "baseline_forecasts": 3}
