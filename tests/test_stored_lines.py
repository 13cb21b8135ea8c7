"""What the mart stores and shuffles: narrow lines, flows made once; a median that no task holds."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfwise.plans.ledger import ledger
from shelfwise.operators import segmentation
from shelfwise.plans.views import median_of, mid_ranks
from shelfwise.sources.roles import roles

SF = "/root/testdata/sf0.001"


def test_lines_are_stored_without_what_follows_from_others(spark):
    sales = roles(spark, SF).sales
    kept = spark.read.parquet(*sales.inputFiles())
    assert not {"d", "batch_id", "total_c"} & set(kept.columns)
    wrong = (F.unix_date("d") != F.col("day_no")) | (F.col("total_c") != F.col("quantity") * F.col("price_c") - F.col("discount_c")) | (F.col("batch_id") != F.concat_ws("-", "item_key", "supplier_key"))
    assert sales.count() and not sales.where(wrong).count()


def test_ledger_makes_lots_once(spark):
    plan = ledger(roles(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner, (batch_id") == 1


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 2.0], [5.0, 1.0, 1.0, None], list(np.random.default_rng(1).integers(0, 40, 501) / 7.0), list(np.random.default_rng(2).normal(size=1000))])
def test_median_is_exact(spark, values):
    known = [v for v in values if v is not None]
    got = median_of(spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double"), "x").first()["median"]
    assert got is None if not known else got == pytest.approx(float(np.median(known)), rel=1e-12)


def test_mid_ranks_of_many_columns_take_two_shuffles(spark):
    rng = np.random.default_rng(3)
    values = {"a": rng.integers(0, 5, 700) * 1.0, "b": rng.normal(size=700), "c": np.zeros(700), "d": rng.integers(-300, 300, 700) / 3}
    rows = spark.createDataFrame(pd.DataFrame({"k": np.arange(700), **values}))
    ranks = mid_ranks(rows, "k", list(values))
    got = ranks.toPandas().sort_values("k")
    for c, v in values.items():
        assert got[c].tolist() == pd.Series(v).rank(ascending=False).tolist()
    # the shuffles of whole rows, besides those of one-row aggregates and bucket sizes
    assert ranks._jdf.queryExecution().optimizedPlan().toString().count("Window [rank(") == 1


def test_settled_runs_are_left_out(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(m, 0.3, (60, 2)) for m in (0, 4, 9)])
    vectors = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "k long, vector array<double>")
    seen, whole = [], segmentation._sums
    monkeypatch.setattr(segmentation, "_sums", lambda v, centers, bounds, moving: (seen.append(len(moving)), whole(v, centers, bounds, moving))[1])
    runs = segmentation.fit_all(vectors, "k", range(2, 6), 4)
    assert seen[0] == 16 and seen[-1] < 16
    exact = segmentation._matrix(pd.DataFrame({"vector": list(x)}))
    for run in runs.values():
        near = segmentation._squared(exact, run.centers).argmin(1)
        for c in np.unique(near):
            assert np.allclose(exact[near == c].mean(0), run.centers[c], atol=1e-9)
