"""Queries cover all of their input: small fixtures against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import ingest, relational
from shelfwise.operators.reports import run_sql
from shelfwise.plans.views import Mart
from shelfwise.sources.roles import Roles, calendar

DAY0 = 9500


def mart(spark, sales, receipts):
    """Roles from (site_key, item_key, supplier_key, day offset, quantity, cents a unit); a maker for each item."""

    def lines(rows, money):
        full = [(i, DAY0 + d, s, f"SITE{s}", k, "C", f"Brand#{k}", p, f"{k}-{p}", q, c, 0, q * c) for i, (s, k, p, d, q, c) in enumerate(rows)]
        schema = f"transaction_id long, day_no long, site_key long, site string, item_key long, category string, maker string, supplier_key long, batch_id string, quantity long, {money} long, discount_c long, total_c long"
        return spark.createDataFrame(full, schema).selectExpr("*", "date_from_unix_date(cast(day_no as int)) as d")

    sold, got = lines(sales, "price_c"), lines(receipts, "cost_c")
    first = [F.min(c).alias(c) for c in ("item_key", "supplier_key", "category", "maker")]
    batches = got.groupBy("batch_id").agg(*first, F.min("day_no").alias("first_day_no"), (F.min("day_no") + 50).alias("expiry_day_no"), F.max("cost_c").alias("cost_c"), F.sum("quantity").alias("initial_quantity"))
    return Mart(Roles(sold, got, batches, calendar(sold.select("d").unionByName(got.select("d")))))


def test_rolling_median_covers_every_series(spark):
    rng = np.random.default_rng(4)
    sales = [(s, k, 1, int(d), int(rng.integers(1, 30)), 100) for s in (1, 2) for k in (1, 2, 3) for d in np.flatnonzero(rng.random(40) < 0.7)] + [(1, 1, 1, 39, 1, 100)]
    receipts = [(s, k, 1, 0, 2000, 50) for s in (1, 2) for k in (1, 2, 3)]
    got = {(r.site, r.maker, r.day_no): (r.median28, r.mad28) for r in run_sql(spark, mart(spark, sales, receipts), relational.TEXTS["W10"][0]).collect()}
    want = {}
    for s in (1, 2):
        for k in (1, 2, 3):
            units = np.zeros(40)
            for s_, k_, _, d, q, _ in sales:
                units[d] += q * ((s_, k_) == (s, k))
            for d in range(27, 40):
                seen = units[d - 27 : d + 1]
                want[f"SITE{s}", f"Brand#{k}", DAY0 + d] = (np.median(seen), np.median(np.abs(seen - np.median(seen))))
    assert got == want


def test_costs_come_from_all_receipts(spark):
    """Items 1 to 3 have receipts of any supplier, item 4 has none and takes its price by the median ratio."""
    sales = [(1, k, 1, 5, 10, 1000) for k in (1, 2, 3, 4)]
    receipts = [(1, 1, 1, 0, 1, 300), (1, 1, 3, 0, 3, 700), (1, 2, 2, 0, 4, 500), (1, 3, 4, 0, 2, 800)]
    got = {r.item_key: r.cost_c for r in run_sql(spark, mart(spark, sales, receipts), ingest.TEXTS["F5"]).collect()}
    assert got == {1: 600.0, 2: 500.0, 3: 800.0, 4: pytest.approx(600.0)}
