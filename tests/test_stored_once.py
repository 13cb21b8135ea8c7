"""Queries store what they need and no more, and nothing twice."""

import pytest

from shelfwise.operators.mining import TEXTS
from shelfwise.operators.reports import run_sql
from shelfwise.plans import spans, views
from shelfwise.plans.ledger import ledger
from shelfwise.plans.views import Mart, item_totals
from shelfwise.sources.roles import roles

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def fresh(spark, monkeypatch):
    """Roles without any table that was kept before."""
    kept = roles(spark, SF).kept
    before = dict(kept)
    kept.clear()
    yield kept
    kept.clear()
    kept.update(before)


def test_episodes_of_series_dont_store_lots(spark, fresh):
    spans.j10_episodes(spark, SF)
    assert "v_series" in fresh and not {"v_lotseries", "t_lots"} & set(fresh)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ledger_and_expiry_read_the_same_lots(spark, fresh):
    mart = Mart(roles(spark, SF))
    made = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(views, "ledger", lambda r, lots: (made.append(lots), ledger(r, lots))[1])
        run_sql(spark, mart, TEXTS["N6"])
    assert {"t_batches", "t_lots"} <= set(fresh) and made == [fresh["t_lots"]]
    plan = plan_of(mart.table("v_expiry"))
    assert "Join Inner, (batch_id" not in plan and "Aggregate [site_key" in plan
    assert mart.table("v_expiry").where("remaining <= 0").count() == 0


def test_item_totals_dont_copy_lines(spark):
    rows = [(1, "a", "m", "t1", 1, 2, 10), (1, "a", "m", "t1", 1, 3, 20), (1, "a", "m", "t1", 2, 1, 5), (1, "a", "m", "t2", 2, 1, 5), (1, "a", None, "t2", 3, 4, 7), (2, "b", "n", None, None, None, None)]
    sales = spark.createDataFrame(rows, "item_key long, category string, maker string, transaction_id string, d int, quantity long, total_c long")
    got = item_totals(sales)
    assert "Expand" not in plan_of(got) and got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "a", "m", 7, 40, 2, 2), (1, "a", None, 4, 7, 1, 1), (2, "b", "n", None, None, 0, 0)]
