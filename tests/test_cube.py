"""The cube against plain sums, its totals, orders and caps; questions along hierarchies."""

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import cube
from shelfwise.sources.roles import calendar
from tests.test_whole_job import mart


@pytest.fixture(scope="module")
def sales(spark):
    rows = [(s, k, 1, d, q, 100 * k) for s in (1, 2, 3) for k in (1, 2, 3, 4) for d, q in ((0, 1), (1, 2), (40, s), (100, k))]
    made = mart(spark, rows, [(1, 1, 1, 0, 5, 50)])
    r = made.roles
    named = r.sales.withColumns({"area": F.concat("site", F.lit("-"), F.col("item_key") % 2), "transaction_id": F.pmod(F.col("transaction_id"), F.lit(5))})
    return cube.Mart(type(r)(named, r.receipts, r.batches, calendar(named.select("d")))), named.collect()


def test_cells_and_totals(sales):
    m, lines = sales
    got = cube.answer(m, cube.Question("site", "item", "transactions")).collect()
    for r in got:
        of = lambda **on: len({x.transaction_id for x in lines if all(str(x[k]) == v for k, v in on.items())})
        assert (r.value, r.row_total, r.column_total, r.grand_total) == (of(site=r.row_label, item_key=r.column_label), of(site=r.row_label), of(item_key=r.column_label), of())
    # distinct counts don't add up, so totals have to be counted
    assert sum(r.value for r in got if r.row_label == "SITE1") > next(r.row_total for r in got if r.row_label == "SITE1")
    assert len(got) == 12 and {r.all_rows for r in got} == {3} and {r.all_columns for r in got} == {4}


def test_orders_and_caps(sales):
    m, lines = sales
    by_value = cube.answer(m, cube.Question("item", None, "units", most_rows=2)).orderBy("row_place").collect()
    assert [r.row_label for r in by_value] == ["4", "3"] and {r.all_rows for r in by_value} == {4} and {r.grand_total for r in by_value} == {sum(x.quantity for x in lines)}
    by_time = cube.answer(m, cube.Question("day", "month", "units", most_rows=3, most_columns=2)).orderBy("row_place").collect()
    assert [r.row_label for r in by_time] == sorted(r.row_label for r in by_time) and len({r.row_label for r in by_time}) <= 3
    assert len({r.column_label for r in by_time}) <= 2 and {r.all_columns for r in by_time} == {3}


def test_filters_and_drill(sales):
    m, lines = sales
    q = cube.Question("site", None, "units", {"item": ["1", "2"]}).drilled("down", "SITE2")
    assert q.row == "area" and dict(q.filters) == {"item": ["1", "2"], "site": ["SITE2"]}
    got = {r.row_label: r.value for r in cube.answer(m, q).collect()}
    assert got == {a: sum(x.quantity for x in lines if x.area == a and x.item_key in (1, 2)) for a in ("SITE2-0", "SITE2-1")}
    up = q.drilled("up")
    assert up.row == "site" and dict(up.filters) == {"item": ["1", "2"]}
    assert cube.answer(m, cube.Question("site", filters={"item": ["none"]})).count() == 0
    for wrong in (lambda: cube.Question("site", "site"), lambda: cube.Question("shop"), lambda: cube.Question("site", measure="profit"), lambda: cube.Question("site", filters={"item": "1"}), lambda: cube.Question("year").drilled("up"), lambda: cube.Question("item").drilled("down")):
        with pytest.raises(ValueError):
            wrong()
