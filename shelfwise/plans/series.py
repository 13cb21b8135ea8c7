"""Causal features of the stock series and of the lots of an item: robust levels from median and MAD on a square-root scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Days of the current level; earlier levels and single days that it is held against; least scale on the square-root scale.
LEVEL, LEVELS, DAYS, LEAST_SCALE = 7, 56, 28, 0.5
#: Earlier lots that a lot is held against, and the least number of them.
LOTS, LEAST_LOTS = 64, 8
MAD_TO_SIGMA = 1.4826


def _middle(sorted_values: Column) -> Column:
    n = F.size(sorted_values)
    return (F.element_at(sorted_values, F.floor((n + 1) / 2).cast("int")) + F.element_at(sorted_values, (F.floor(n / 2) + 1).cast("int"))) / 2


def _robust(rows: DataFrame, name: str, value: Column, earlier: Column, enough: Column) -> DataFrame:
    """rows with `<name>_median` and `<name>_z` of value against the sorted array of earlier values; null unless `enough`."""
    rows = rows.withColumn("_seen", F.when(enough, F.array_sort(earlier))).withColumn(f"{name}_median", _middle(F.col("_seen")))
    away = _middle(F.array_sort(F.transform("_seen", lambda x: F.abs(x - F.col(f"{name}_median")))))
    return rows.withColumn(f"{name}_z", (value - F.col(f"{name}_median")) / F.greatest(away * MAD_TO_SIGMA, F.lit(LEAST_SCALE))).drop("_seen")


def stock_series(stock: DataFrame) -> DataFrame:
    """Two grains, (site, maker) and maker: the level of the last week and the day's sales against the time before, stock-out runs.

    Frames are bounded, so a task holds at most LEVELS values a row; a series has as many rows as the calendar has days.
    """
    fine = stock.select(F.lit("site_maker").alias("grain"), "site", "maker", "day_no", "sold", "closing")
    coarse = stock.groupBy("maker", "day_no").agg(F.sum("sold").alias("sold"), F.sum("closing").alias("closing")).select(F.lit("maker").alias("grain"), F.lit("ALL").alias("site"), "maker", "day_no", "sold", "closing")
    of = W.partitionBy("grain", "site", "maker").orderBy("day_no")
    week = of.rowsBetween(1 - LEVEL, 0)
    empty = (F.col("closing") == 0).cast("long")
    rows = fine.unionByName(coarse).select(
        "*", F.row_number().over(of).alias("n_seen"), F.sum("sold").over(week).alias("u7"), F.sum(empty).over(week).alias("empty_days_7"), F.sqrt(F.col("sold") + 0.375).alias("y"), F.sum(1 - empty).over(of).alias("island"),
    )
    rows = rows.withColumn("y7", F.sqrt(F.col("u7") + 0.375)).withColumn("stock_run", F.when(F.col("closing") == 0, F.row_number().over(W.partitionBy("grain", "site", "maker", "island").orderBy("day_no")) - F.when(F.col("island") > 0, 1).otherwise(0)).otherwise(0))
    rows = _robust(rows, "level", F.col("y7"), F.collect_list("y7").over(of.rowsBetween(1 - LEVEL - LEVELS, -LEVEL)), F.col("n_seen") >= 2 * LEVEL - 1 + LEVELS)
    rows = _robust(rows, "day", F.col("y"), F.collect_list("y").over(of.rowsBetween(-DAYS, -1)), F.col("n_seen") > DAYS)
    back = lambda c: F.col(c) * F.col(c) - 0.375
    return rows.select(
        "grain", "site", "maker", "day_no", "sold", "closing", "n_seen", F.when(F.col("n_seen") >= LEVEL, F.col("u7")).alias("units_7d"), back("level_median").alias("usual_7d"), F.col("level_z").alias("z7"),
        back("day_median").alias("usual_day"), F.col("day_z").alias("zd"), "empty_days_7", F.col("stock_run").cast("long").alias("stock_run"),
    )


def lot_series(receipts: DataFrame) -> DataFrame:
    """Every lot (receipt line) of an item against up to LOTS earlier ones of it: quantity, days since the last lot, unit cost."""
    lots = receipts.groupBy("item_key", "day_no", "transaction_id", "batch_id").agg(F.sum("quantity").alias("quantity"), F.max("cost_c").alias("cost_c"))
    of = W.partitionBy("item_key").orderBy("day_no", "transaction_id", "batch_id")
    before = of.rowsBetween(-LOTS, -1)
    rows = lots.select("*", F.row_number().over(of).alias("lot_no"), (F.col("day_no") - F.lag("day_no").over(of)).alias("gap"))
    enough = F.col("lot_no") > LEAST_LOTS
    for name, value in (("quantity", F.col("quantity")), ("gap", F.col("gap")), ("cost", F.col("cost_c"))):
        rows = rows.withColumn("_y", F.sqrt(value + 0.375))
        # of the first lot no gap is known: the array holds the known ones
        rows = _robust(rows, name, F.col("_y"), F.collect_list("_y").over(before), enough).withColumn(f"{name}_median", F.col(f"{name}_median") * F.col(f"{name}_median") - 0.375)
    return rows.select("item_key", "day_no", "transaction_id", "batch_id", "lot_no", "quantity", "gap", "cost_c", "quantity_median", "quantity_z", "gap_median", "gap_z", "cost_median", "cost_z")


HORIZONS = (7, 14, 30)
LAGS = (1, 2, 3, 7, 14, 21, 28)
#: Most days since the last day without stock; one more if there was none.
SINCE_CAP = 60


def demand_features(stock: DataFrame, calendar: DataFrame) -> DataFrame:
    """Of each (site, maker) and day: features from that day and before, calendar of the next day, and for each horizon what follows.

    target_h and censored_h (days without stock) are null unless all h days follow; naive, weekly and yearly baselines of a horizon
    are those that differ by more than a factor from one to the next.
    """
    of = W.partitionBy("site_key", "maker").orderBy("day_no")
    back = lambda n: of.rowsBetween(1 - n, 0)
    sold, empty = F.col("sold"), (F.col("closing") == 0).cast("long")
    rows = stock.select("site_key", "site", "maker", "family", "day_no", "sold", "closing", F.row_number().over(of).alias("n_seen"))
    seen = F.col("n_seen")
    for n in (7, 14, 28):
        total, squares = F.sum("sold").over(back(n)), F.sum(sold * sold).over(back(n))
        rows = rows.withColumn(f"mean_{n}", F.when(seen >= n, total / float(n))).withColumn(f"sd_{n}", F.when(seen >= n, F.sqrt((n * squares - total * total).cast("double") / (n * (n - 1)))))
    for n in (7, 28):
        rows = rows.withColumn(f"median_{n}", F.when(seen >= n, _middle(F.array_sort(F.collect_list("sold").over(back(n))))))
    days_in = F.sum(1 - empty).over(back(28))
    rows = rows.select(
        "*", *(F.lag("sold", k - 1).over(of).alias(f"lag_{k}") for k in LAGS), F.sum(empty).over(back(7)).alias("empty_days_7"), F.sum(empty).over(back(28)).alias("empty_days_28"),
        F.when(seen >= 28, F.coalesce(F.try_divide(F.sum(sold * (1 - empty)).over(back(28)), days_in), F.col("mean_28"))).alias("mean_28_in_stock"), empty.alias("was_empty"),
        F.coalesce(F.least(F.col("day_no") - F.max(F.when(empty == 1, F.col("day_no"))).over(of), F.lit(SINCE_CAP)), F.lit(SINCE_CAP + 1)).alias("days_since_empty"),
        F.sum("sold").over(back(7)).alias("u7"), (F.lag("sold", 6).over(of) + F.lag("sold", 5).over(of)).alias("two_days"),
        *(F.when(seen >= 364, F.sum("sold").over(of.rowsBetween(-363, h - 364))).alias(f"yearly_{h}") for h in HORIZONS),
        *(F.when(F.count(F.lit(1)).over(of.rowsBetween(1, h)) == h, F.sum(c).over(of.rowsBetween(1, h))).alias(f"{name}_{h}") for h in HORIZONS for name, c in (("target", sold), ("censored", empty))),
    )
    next_days = calendar.select((F.col("day_no") - 1).alias("day_no"), F.col("dow").alias("next_dow"), F.col("day").alias("next_day"), F.col("month").alias("next_month"), F.col("quarter").alias("next_quarter"), F.col("iso_week").alias("next_week"), F.col("is_weekend").cast("int").alias("next_weekend"))
    # one row a day
    out = rows.join(F.broadcast(next_days), "day_no", "left")
    turn = lambda c, n: 2 * F.pi() * (F.col(c) - 1) / n
    return out.select(
        "*", (F.col("mean_7") / (F.col("mean_28") + 0.1)).alias("ratio_7_28"), (F.col("closing") / (F.col("mean_28") + 0.1)).alias("stock_to_demand"), (F.col("empty_days_7") > 0).cast("int").alias("empty_last_7"),
        F.sin(turn("next_dow", 7)).alias("dow_sin"), F.cos(turn("next_dow", 7)).alias("dow_cos"), F.sin(turn("next_month", 12)).alias("month_sin"), F.cos(turn("next_month", 12)).alias("month_cos"),
        F.regexp_extract("family", "([0-9]+)$", 1).cast("int").alias("family_no"), F.col("u7").alias("weekly_7"), (2 * F.col("u7")).alias("weekly_14"), (4 * F.col("u7") + F.col("two_days")).alias("weekly_30"),
    ).drop("u7", "two_days")


def _z(value: str, seen: str) -> str:
    return f"({value} - list_median({seen})) / greatest(list_median(list_transform({seen}, lambda x: abs(x - list_median({seen})))) * {MAD_TO_SIGMA}e0, {LEAST_SCALE}e0)"


_FRAME, _OF = "partition by grain, site, maker order by day_no", "partition by item_key order by day_no, transaction_id, batch_id"
_PAIR, _EMPTY = "partition by site_key, maker order by day_no", "(case when closing = 0 then 1 else 0 end)"
_BACK = "list_median({0}) * list_median({0}) - 0.375e0"
def _run(n: int, expr: str = "sold") -> str:
    return f"cast(sum({expr}) over ({_PAIR} rows between {n - 1} preceding and current row) as bigint)"


SERIES_SQL = f"""
grains as (
  select 'site_maker' as grain, site, maker, day_no, sold, closing from t_ledger
  union all select 'maker', 'ALL', maker, day_no, cast(sum(sold) as bigint), cast(sum(closing) as bigint) from t_ledger group by maker, day_no),
seen_week as (
  select *, row_number() over ({_FRAME}) as n_seen, cast(sum(sold) over ({_FRAME} rows between 6 preceding and current row) as bigint) as u7,
    cast(sum(case when closing = 0 then 1 else 0 end) over ({_FRAME} rows between 6 preceding and current row) as bigint) as empty_days_7,
    day_no - coalesce(max(case when closing > 0 then day_no end) over ({_FRAME}), min(day_no) over (partition by grain, site, maker) - 1) as stock_run from grains),
seen_long as (
  select *, list(sqrt(u7 + 0.375e0)) over ({_FRAME} rows between {LEVEL + LEVELS - 1} preceding and {LEVEL} preceding) as levels,
    list(sqrt(sold + 0.375e0)) over ({_FRAME} rows between {DAYS} preceding and 1 preceding) as days from seen_week),
v_series as (
  select grain, site, maker, day_no, sold, closing, n_seen, case when n_seen >= {LEVEL} then u7 end as units_7d,
    case when n_seen >= {2 * LEVEL - 1 + LEVELS} then {_BACK.format('levels')} end as usual_7d, case when n_seen >= {2 * LEVEL - 1 + LEVELS} then {_z('sqrt(u7 + 0.375e0)', 'levels')} end as z7,
    case when n_seen > {DAYS} then {_BACK.format('days')} end as usual_day, case when n_seen > {DAYS} then {_z('sqrt(sold + 0.375e0)', 'days')} end as zd, empty_days_7, stock_run from seen_long),
lot_lines as (
  select *, row_number() over ({_OF}) as lot_no, day_no - lag(day_no) over ({_OF}) as gap
  from (select item_key, day_no, transaction_id, batch_id, cast(sum(quantity) as bigint) as quantity, max(cost_c) as cost_c from t_receipts group by item_key, day_no, transaction_id, batch_id)),
lot_seen as (
  select *, {', '.join(f'list(sqrt({c} + 0.375e0)) filter (where {c} is not null) over ({_OF} rows between {LOTS} preceding and 1 preceding) as {c}_seen' for c in ('quantity', 'gap', 'cost_c'))} from lot_lines),
v_lotseries as (
  select item_key, day_no, transaction_id, batch_id, lot_no, quantity, gap, cost_c,
    {', '.join(f"case when lot_no > {LEAST_LOTS} then {_BACK.format(c + '_seen')} end as {n}_median, case when lot_no > {LEAST_LOTS} then {_z(f'sqrt({c} + 0.375e0)', c + '_seen')} end as {n}_z" for n, c in (('quantity', 'quantity'), ('gap', 'gap'), ('cost', 'cost_c')))}
  from lot_seen),
feature_rows as (select site_key, site, maker, family, day_no, sold, closing, row_number() over ({_PAIR}) as n_seen from t_ledger),
feature_sums as (
  select *, {', '.join(f'case when n_seen >= {n} then {_run(n)} / {n}e0 end as mean_{n}' for n in (7, 14, 28))},
    {', '.join(f"case when n_seen >= {n} then sqrt(cast({n} * {_run(n, 'sold * sold')} - {_run(n)} * {_run(n)} as double) / ({n} * {n - 1})) end as sd_{n}" for n in (7, 14, 28))},
    {', '.join(f'case when n_seen >= {n} then median(sold) over ({_PAIR} rows between {n - 1} preceding and current row) end as median_{n}' for n in (7, 28))},
    {', '.join(f'lag(sold, {k - 1}) over ({_PAIR}) as lag_{k}' for k in LAGS)}, {_run(7, _EMPTY)} as empty_days_7, {_run(28, _EMPTY)} as empty_days_28, {_EMPTY} as was_empty,
    {_run(28, f'sold * (1 - {_EMPTY})')} as in_stock_units, {_run(28, f'1 - {_EMPTY}')} as in_stock_days, day_no - max(case when closing = 0 then day_no end) over ({_PAIR}) as since, {_run(7)} as u7,
    lag(sold, 6) over ({_PAIR}) + lag(sold, 5) over ({_PAIR}) as two_days,
    {', '.join(f'case when n_seen >= 364 then cast(sum(sold) over ({_PAIR} rows between 363 preceding and {364 - h} preceding) as bigint) end as yearly_{h}' for h in HORIZONS)},
    {', '.join(f'case when count(*) over ({_PAIR} rows between 1 following and {h} following) = {h} then cast(sum({e}) over ({_PAIR} rows between 1 following and {h} following) as bigint) end as {n}_{h}' for h in HORIZONS for n, e in (('target', 'sold'), ('censored', _EMPTY)))}
  from feature_rows),
v_features as (
  select f.* exclude (in_stock_units, in_stock_days, since, u7, two_days), case when n_seen >= 28 then coalesce(in_stock_units / nullif(in_stock_days, 0), mean_28) end as mean_28_in_stock,
    coalesce(least(since, {SINCE_CAP}), {SINCE_CAP + 1}) as days_since_empty, c.dow as next_dow, c.day as next_day, c.month as next_month, c.quarter as next_quarter, c.iso_week as next_week, cast(c.is_weekend as int) as next_weekend,
    mean_7 / (mean_28 + 0.1e0) as ratio_7_28, closing / (mean_28 + 0.1e0) as stock_to_demand, case when empty_days_7 > 0 then 1 else 0 end as empty_last_7,
    sin(2 * pi() * (c.dow - 1) / 7) as dow_sin, cos(2 * pi() * (c.dow - 1) / 7) as dow_cos, sin(2 * pi() * (c.month - 1) / 12) as month_sin, cos(2 * pi() * (c.month - 1) / 12) as month_cos,
    cast(regexp_extract(family, '([0-9]+)$', 1) as int) as family_no, u7 as weekly_7, 2 * u7 as weekly_14, 4 * u7 + two_days as weekly_30
  from feature_sums f left join t_calendar c on c.day_no = f.day_no + 1)
"""
