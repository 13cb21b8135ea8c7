"""Causality by perturbation: what is known on a day may not change when everything after the day is cut off or scrambled.

A perturbation acts on the facts (sales, receipts, the daily ledger); the same plan runs on the facts as they are and as perturbed, and
the rows of both that lie on the day or before are compared as multisets. Dimensions (calendar, batches) stay: they hold what is known
beforehand. The ledger is a fact too; its opening stock, the least that keeps a pair's stock from going negative, is a constant of the
pair that comes from the whole history.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decisions, forecasting, mining
from ..operators.reports import run_sql
from ..sources.io import stored
from ..sources.roles import Roles, roles
from .decided import BACK, QUEUE
from .views import Mart

#: Columns of each fact that a scramble replaces, with the number of values that it draws from.
SCRAMBLED = {
    "t_sales": {"quantity": 60, "price_c": 10_000, "total_c": 600_000, "discount_c": 100}, "t_receipts": {"quantity": 90, "cost_c": 10_000, "total_c": 900_000},
    "t_ledger": {"sold": 60, "purchased": 60, "expired": 4, "opening": 90, "closing": 4, "value_c": 40_000},
}
SEED = 42


def _facts(mart: Mart, change: Callable[[str, DataFrame], DataFrame]) -> Mart:
    made = {name: change(name, mart.table(name)) for name in SCRAMBLED}
    r = mart.roles
    # what several plans derive from the changed facts is stored once
    return Mart(Roles(made["t_sales"], made["t_receipts"], mart.table("t_batches"), r.calendar, {}), {"t_ledger": made["t_ledger"]})


def cut(mart: Mart, day: DataFrame) -> Mart:
    """The mart without facts after the day (one row, a column as_of)."""
    return _facts(mart, lambda _, df: df.join(F.broadcast(day), F.col("day_no") <= F.col("as_of")).drop("as_of"))


def scrambled(mart: Mart, day: DataFrame, seed: int = SEED) -> Mart:
    """The mart with every number of a fact after the day replaced by one drawn from a hash of its row."""

    def change(name: str, df: DataFrame) -> DataFrame:
        def drawn(c: str, values: int) -> Column:
            return F.when(F.col("day_no") > F.col("as_of"), F.pmod(F.xxhash64(F.lit(f"{seed} {c}"), *df.columns), F.lit(values))).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c)

        dated = df.join(F.broadcast(day))
        return dated.select(*(drawn(c, SCRAMBLED[name][c]) if c in SCRAMBLED[name] else F.col(c) for c in df.columns))

    return _facts(mart, change)


PERTURBATIONS = {"cut": cut, "scrambled": scrambled}


def differing_each(a: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """how, n_rows, differing by name of the others: the rows of a, and how many rows of either have no equal in the other.

    Repeated rows count each. One shuffle serves all of the others, so a is made once.
    """
    kind, frames = a.columns, [a, *others.values()]
    every = reduce(DataFrame.unionByName, (df.select(*kind, F.lit(k).alias("_of")) for k, df in enumerate(frames)))
    counts = every.groupBy(*kind).agg(*(F.count_if(F.col("_of") == k).alias(f"_n{k}") for k in range(len(frames))))
    none = F.lit(0).cast("long")
    sums = counts.agg(F.coalesce(F.sum("_n0"), none).alias("n_rows"), *(F.coalesce(F.sum(F.abs(F.col(f"_n{k}") - F.col("_n0"))), none).alias(f"_d{k}") for k in range(1, len(frames))))
    found = F.array(*(F.struct(F.lit(name).alias("how"), F.col(f"_d{k}").alias("differing")) for k, name in enumerate(others, 1)))
    return sums.select("n_rows", F.explode(found).alias("_f")).select("_f.how", "n_rows", "_f.differing")


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the rows of a, and how many rows of either have no equal in the other; repeated rows count each."""
    return differing_each(a, {"": b}).select("n_rows", "differing")


def checked(mart: Mart, backs: list[int], plans: dict[str, Callable[[Mart, DataFrame], DataFrame]], how: list[str] | None = None, prepare: Callable[[Mart, DataFrame], Mart] = lambda mart, day: mart) -> DataFrame:
    """what, how, days_back, n_rows, differing: each plan (mart, day) -> rows that are known on the day, for each perturbation and day.

    prepare: gives a mart, as it is or perturbed, the tables that several plans share.
    """
    out = []
    for back in backs:
        day = decisions.decision_day(mart, back)
        whole = prepare(mart, day)
        others = {name: prepare(PERTURBATIONS[name](mart, day), day) for name in how or list(PERTURBATIONS)}
        for what, plan in plans.items():
            found = differing_each(plan(whole, day), {name: plan(other, day) for name, other in others.items()})
            out.append(found.select(F.lit(what).alias("what"), "how", F.lit(back).alias("days_back"), "n_rows", "differing"))
    return reduce(DataFrame.unionByName, out)


def known(rows: DataFrame, day: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(day), F.col("day_no") <= F.col("as_of")).drop("as_of")


def features_known(mart: Mart, day: DataFrame) -> DataFrame:
    """All features of all origins up to the day."""
    return known(mart.table("v_features"), day).select("site", "maker", "day_no", "n_seen", *(c for c in forecasting.FEATURES if c != "site_key"), "weekly_7", "weekly_14", "weekly_30")


def series_known(mart: Mart, day: DataFrame) -> DataFrame:
    return known(mart.table("v_series"), day)


def flags_known(mart: Mart, day: DataFrame) -> DataFrame:
    flags = run_sql(mart.roles.sales.sparkSession, mart, mining.TEXTS["N9"])
    return known(flags, day)


def lots_known(mart: Mart, day: DataFrame) -> DataFrame:
    return known(mart.table("v_lotseries"), day)


def with_inputs(mart: Mart, day: DataFrame) -> Mart:
    """The mart with what the decisions of the day are made from, each made once from the mart's own facts."""
    made = {"d_state": decisions.pair_state(mart, day), "d_lots": decisions.live_lots(mart, day), "d_forecasts": decisions.baseline_forecasts(mart, day)}
    return Mart(mart.roles, (mart.given or {}) | {name: stored(df, f"causality-{name}") for name, df in made.items()})


def queue_known(mart: Mart, day: DataFrame) -> DataFrame:
    return decisions.decide(mart.table("d_state"), mart.table("d_lots"), mart.table("d_forecasts")).queue.select(*QUEUE)


def h15_causality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(Mart(roles(spark, sf_dir)), [BACK, 3 * 365], {"features": features_known})


def n20_causality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(Mart(roles(spark, sf_dir)), [BACK], {"series": series_known, "flags": flags_known, "lots": lots_known})


def y12_causality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State, lots, forecasts and the whole queue of the historical decision day."""
    plans = {what: lambda mart, _, name=f"d_{what}": mart.table(name) for what in ("state", "lots", "forecasts")} | {"queue": queue_known}
    return checked(Mart(roles(spark, sf_dir)), [BACK], plans, prepare=with_inputs)


QUERIES = {"H15_causality": h15_causality, "N20_causality": n20_causality, "Y12_causality": y12_causality}

_HOW = "(select 'cut' as how union all select 'scrambled') h"


def _expected(parts: dict[str, tuple[str, int]]) -> str:
    return " union all ".join(
        f"select '{what}' as what, how, {back} as days_back, (select count(*) from {rows.format(day=f'(select max(day_no) - {back} from t_calendar)')}) as n_rows, 0 as differing from {_HOW}" for (what, back), rows in parts.items()
    )


#: The same numbers of rows, and no difference.
SQL = {
    "H15_causality": _expected({("features", b): "v_features where day_no <= {day}" for b in (BACK, 3 * 365)}),
    "N20_causality": _expected({("series", BACK): "v_series where day_no <= {day}", ("flags", BACK): f"({mining.TEXTS['N9']}) n where day_no <= {{day}}", ("lots", BACK): "v_lotseries where day_no <= {day}"}),
    "Y12_causality": _expected({
        ("state", BACK): "(select distinct site_key, maker from t_ledger where day_no <= {day}) s",
        ("lots", BACK): "(select r.site_key, r.batch_id from t_receipts r join t_batches b on b.batch_id = r.batch_id where r.day_no <= {day} and expiry_day_no > {day} group by r.site_key, r.batch_id having sum(r.quantity) > coalesce((select sum(s.quantity) from t_sales s where s.site_key = r.site_key and s.batch_id = r.batch_id and s.day_no <= {day}), 0)) l",
        ("forecasts", BACK): "(select site_key, maker, h from v_features, (select unnest([7, 14, 30]) as h) where day_no = {day} and n_seen >= 364) f",
        ("queue", BACK): "(select distinct site_key, maker from t_ledger where day_no <= {day}) q",
    }),
}
