"""A spread of queries against the same SQL in DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
NAMES = ["S1_sales_kpis", "S7", "B4_top3_per_category_site", "I6", "I15", "X2", "X11", "P7", "D4", "D6", "K2", "K8", "O1_time_rollup", "O18_cube", "A14", "C2", "C4", "C10", "C14", "C21", "E5", "E7", "Q5", "W12", "W14", "G8", "N3", "N12", "H14", "Y6", "Y10", "F2", "F7_clean_sales", "IO1_contract", "ST2_run_onset"]


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def shown(v):
        if v is None:
            return "~"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float) or type(v).__name__ == "Decimal":
            return "~nan" if math.isnan(v) else f"{float(v):.9g}"
        return str(v)

    return [columns[i] for i in order], sorted(tuple(shown(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, duck, name):
    key = next(k for k in __spark_entry__.queries() if k == name or k.split("_")[0] == name)
    df = __spark_entry__.queries()[key](spark, SF)
    duck.execute(__spark_entry__.oracle_sql()[key])
    columns = [d[0] for d in duck.description]
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(duck.fetchall(), columns)


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
