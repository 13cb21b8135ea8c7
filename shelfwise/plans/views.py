"""The reusable views: performance of items and sites, demand, stockouts, current stock, expiry risk."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.io import stored
from ..sources.roles import Roles, floor_div
from .ledger import ledger, write_offs
from .series import SERIES_SQL, demand_features, lot_series, stock_series

MONEY = 100.0
#: Days to expiry within which unsold units are projected.
EXPIRY_HORIZON = 365


def deviation(n: Column, total: Column, squares: Column) -> Column:
    """Sample standard deviation from exact sums, so that it doesn't depend on the order of rows; null for one row."""
    return F.when(n > 1, F.sqrt((n * squares - total * total).cast("double") / (n * (n - 1))))


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def monthly_sales(sales: DataFrame) -> DataFrame:
    return sales.groupBy(F.trunc("d", "MM").alias("month_start")).agg(
        F.sum("quantity").alias("units"), F.sum("total_c").alias("revenue_c"), F.sum("discount_c").alias("discount_c"), F.count(F.lit(1)).alias("sales_lines"), F.countDistinct("transaction_id").alias("transactions"),
    )


def item_totals(sales: DataFrame) -> DataFrame:
    """Units, revenue, transactions and days with sales of each item.

    Lines are dealt out by item once and doubled there, for the days and for the transactions; two counts of distinct values in one
    aggregation would shuffle every line three times.
    """
    item, none = ["item_key", "category", "maker"], lambda c: F.lit(None).cast(sales.schema[c].dataType).alias(c)
    dealt = sales.select(*item, "d", "transaction_id", "quantity", "total_c").repartition("item_key")
    parts = F.array(F.struct("d", none("transaction_id"), "quantity", "total_c"), F.struct(none("d"), "transaction_id", none("quantity"), none("total_c")))
    each = dealt.select(*item, F.explode(parts).alias("p")).groupBy(*item, "p.d", "p.transaction_id").agg(F.sum("p.quantity").alias("units"), F.sum("p.total_c").alias("revenue_c"))
    return each.groupBy(*item).agg(F.sum("units").alias("units"), F.sum("revenue_c").alias("revenue_c"), F.count("transaction_id").alias("transaction_count"), F.count("d").alias("sales_days"))


def item_performance(sales: DataFrame, calendar: DataFrame) -> DataFrame:
    """Totals, ranks by revenue, units and frequency, and mover class of each item: FAST from 0.80, MEDIUM from 0.50 of the percent rank by units."""
    totals = item_totals(sales)
    ranked = with_ranks(totals, ["revenue_c", "units", "transaction_count"])
    whole = totals.agg(F.count(F.lit(1)).alias("n_items"), F.sum("revenue_c").alias("all_revenue_c"))
    days = calendar.agg(F.count(F.lit(1)).alias("n_days"))
    # percent_rank from the low end: items with fewer units, of all others
    below = F.col("n_items") - (F.col("units_rank") - 1) - F.col("units_ties")
    place = F.when(F.col("n_items") > 1, below / (F.col("n_items") - 1)).otherwise(0.0)
    return ranked.crossJoin(F.broadcast(days)).crossJoin(F.broadcast(whole)).select(
        "item_key", "category", "maker", "units", "revenue_c", "transaction_count", "sales_days", (F.col("units") / F.col("n_days")).alias("avg_daily_units"),
        (100 * F.col("revenue_c") / F.col("all_revenue_c")).alias("revenue_share_pct"), F.col("revenue_c_rank").alias("revenue_rank"), "units_rank",
        F.col("transaction_count_rank").alias("frequency_rank"), F.when(place >= 0.8, "FAST").when(place >= 0.5, "MEDIUM").otherwise("SLOW").alias("mover_class"),
    )


def with_ranks(rows: DataFrame, columns: list[str], buckets: int = 64) -> DataFrame:
    """rows with `<column>_rank`, from the largest value on, and `<column>_ties`, rows of the same value, for each column.

    Values are cut into buckets at approximate quantiles; a rank is the rows of higher buckets and the rank within the bucket. So no
    task sorts all rows; what is broadcast is one row of quantiles and one of bucket sizes.
    """
    edges = rows.agg(*(F.array_distinct(F.percentile_approx(c, [k / buckets for k in range(1, buckets)])).alias(f"_edges_{c}") for c in columns))

    def bucket(c: str) -> Column:
        return F.size(F.filter(f"_edges_{c}", lambda e: e < F.col(c)))

    placed = rows.crossJoin(F.broadcast(edges)).withColumns({f"_bucket_{c}": bucket(c) for c in columns}).drop(*edges.columns)
    # rows of each bucket and of all higher ones, as arrays by bucket number
    sizes = placed.agg(*(F.count_if(F.col(f"_bucket_{c}") > k).alias(f"_{c}_{k}") for c in columns for k in range(buckets)))
    above = sizes.select(*(F.array(*(F.col(f"_{c}_{k}") for k in range(buckets))).alias(f"_above_{c}") for c in columns))
    out = placed.crossJoin(F.broadcast(above))
    for c in columns:
        inside = W.partitionBy(f"_bucket_{c}").orderBy(F.desc(c))
        out = out.withColumn(f"{c}_rank", F.element_at(f"_above_{c}", F.col(f"_bucket_{c}") + 1) + F.rank().over(inside)).withColumn(f"{c}_ties", F.count(F.lit(1)).over(W.partitionBy(f"_bucket_{c}", c)))
    return out.drop(*(f"_{x}_{c}" for x in ("bucket", "above") for c in columns))


def mid_ranks(rows: DataFrame, key: str, columns: list[str], buckets: int = 64) -> DataFrame:
    """key (one row each) and, under its name, the rank of each column from the largest value on; equal values share their mean rank.

    As with_ranks, but (key, value) of all columns are ranked in one shuffle and brought back in another, however many columns there
    are; what is broadcast is a row of quantiles and the sizes of the buckets.
    """
    edges = rows.agg(*(F.array_distinct(F.percentile_approx(c, [k / buckets for k in range(1, buckets)])).alias(f"_edges_{c}") for c in columns))
    cells = F.array(*(F.struct(F.col(c).cast("double").alias("v"), F.size(F.filter(f"_edges_{c}", lambda e: e < F.col(c))).alias("bucket")) for c in columns))
    long = rows.crossJoin(F.broadcast(edges)).select(key, F.posexplode(cells).alias("at", "cell")).select(key, "at", "cell.*")
    higher = W.partitionBy("at").orderBy(F.desc("bucket")).rowsBetween(W.unboundedPreceding, -1)
    sizes = long.groupBy("at", "bucket").agg(F.count(F.lit(1)).alias("n")).select("at", "bucket", F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("above"))
    ranked = long.select(key, "at", "bucket", F.rank().over(W.partitionBy("at", "bucket").orderBy(F.desc("v"))).alias("place"), F.count(F.lit(1)).over(W.partitionBy("at", "bucket", "v")).alias("ties"))
    placed = ranked.join(F.broadcast(sizes), ["at", "bucket"]).select(key, "at", (F.col("above") + F.col("place") + (F.col("ties") - 1) / 2).alias("r"))
    return placed.groupBy(key).agg(*(F.max(F.when(F.col("at") == k, F.col("r"))).alias(c) for k, c in enumerate(columns)))


def median_of(rows: DataFrame, column: str) -> DataFrame:
    """One row, `median` of the column, null left out; null for no rows. Ranks come from buckets, so no task holds all values."""
    ranked = with_ranks(rows.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v")), ["v"])
    n = ranked.agg(F.count(F.lit(1)).alias("n"))
    low, high = (F.col("n") + 1) / 2, F.floor(F.col("n") / 2) + 1
    covers = lambda k: (F.col("v_rank") <= k) & (k < F.col("v_rank") + F.col("v_ties"))
    found = ranked.crossJoin(F.broadcast(n)).agg(F.max(F.when(covers(F.floor(low)), F.col("v"))).alias("a"), F.max(F.when(covers(high), F.col("v"))).alias("b"))
    return found.select((F.col("b") * 0.5 + F.col("a") * 0.5).alias("median"))


def site_performance(sales: DataFrame) -> DataFrame:
    totals = sales.groupBy("site_key", "site").agg(F.sum("quantity").alias("units"), F.sum("total_c").alias("revenue_c"), F.countDistinct("transaction_id").alias("transactions"))
    everything = W.partitionBy()
    return totals.select(
        "*", (F.col("revenue_c") / MONEY / F.col("transactions")).alias("average_basket_value"), (F.col("units") / F.col("transactions")).alias("average_basket_units"),
        (100 * F.col("revenue_c") / F.sum("revenue_c").over(everything)).alias("revenue_share_pct"), (100 * F.col("units") / F.sum("units").over(everything)).alias("units_share_pct"),
        F.rank().over(everything.orderBy(F.desc("revenue_c"))).alias("revenue_rank"),
    )


def demand_stats(stock: DataFrame, calendar: DataFrame) -> DataFrame:
    """Daily mean and deviation and the weekly coefficient of variation over whole ISO weeks, of each (site, maker)."""
    pair = ["site_key", "site", "maker"]
    sums = lambda c: (F.count(F.lit(1)).alias("n"), F.sum(c).alias("total"), F.sum(F.col(c) * F.col(c)).alias("squares"))
    n, total, squares = F.col("n"), F.col("total"), F.col("squares")
    daily = stock.groupBy(*pair).agg(*sums("sold")).select(*pair, n.alias("n_days"), total.alias("units"), (total / n).alias("daily_mean"), deviation(n, total, squares).alias("daily_sd"))
    weeks = stock.join(F.broadcast(calendar.select("day_no", "iso_year", "iso_week")), "day_no").groupBy(*pair, "iso_year", "iso_week").agg(F.count(F.lit(1)).alias("days"), F.sum("sold").alias("week")).where("days = 7")
    weekly = weeks.groupBy("site_key", "maker").agg(*sums("week")).select("site_key", "maker", n.alias("n_weeks"), (total / n).alias("weekly_mean"), deviation(n, total, squares).alias("weekly_sd"))
    out = daily.join(weekly, ["site_key", "maker"], "left").withColumn("weekly_cv", ratio(F.col("weekly_sd"), F.col("weekly_mean")))
    return out.withColumn("variability", F.when(F.col("weekly_cv").isNull(), "NO DEMAND").when(F.col("weekly_cv") < 0.5, "STABLE").when(F.col("weekly_cv") < 1.0, "MODERATELY VARIABLE").otherwise("HIGHLY VARIABLE"))


def stockout_summary(stock: DataFrame) -> DataFrame:
    empty = F.count_if(F.col("closing") == 0)
    return stock.groupBy("site_key", "site", "maker", "family").agg(empty.alias("stockout_days"), F.count(F.lit(1)).alias("days_observed"), (100 * empty / F.count(F.lit(1))).alias("stockout_rate_pct"))


def current_stock(stock: DataFrame) -> DataFrame:
    """Stock of each (site, maker) on the last day, sales of its last 30 days, days of cover and status.

    Overstock is more than 90 days of cover by integers: closing * 30 > 90 * units_30d.
    """
    # the last day first, as one number: the windows below then only read what they need
    last = stock.agg(F.max("day_no").alias("last_day"))
    recent = stock.join(F.broadcast(last), F.col("day_no") > F.col("last_day") - 30)
    now = recent.groupBy("site_key", "site", "maker", "family").agg(
        F.sum("sold").alias("units_30d"), F.max_by("closing", "day_no").alias("closing"), F.max_by("value_c", "day_no").alias("value_c"), F.max("day_no").alias("day_no"),
    )
    units, closing = F.col("units_30d"), F.col("closing")
    status = F.when(closing == 0, "OUT_OF_STOCK").when(units == 0, "NO_DEMAND").when(closing * 30 < 7 * units, "LOW_STOCK").when(closing * 30 > 90 * units, "OVERSTOCK").otherwise("NORMAL")
    return now.select("site_key", "site", "maker", "family", "day_no", "closing", "value_c", "units_30d", ratio(closing * 30, units).alias("days_of_inventory"), status.alias("stock_status"))


def expiry_risk(r: Roles, lots: DataFrame | None = None) -> DataFrame:
    """Lots with remaining units: days to expiry, units that expire before them at the site, projected unsold units and risk class.

    Live lots lose what demand of the last 90 days doesn't sell by their expiry, earlier lots first, if that is within a year: CRITICAL
    within 30 days, HIGH within 90, MEDIUM later. A lot that will sell is MEDIUM within 90 days and SAFE later. Expired lots lose all.
    lots: where they are stored, else they are made.
    """
    last = r.sales.agg(F.max("day_no").alias("last_day"))
    sold = r.sales.crossJoin(F.broadcast(last)).where("day_no > last_day - 90").groupBy("site_key", "item_key").agg(F.sum("quantity").alias("units_90d"))
    lots = (write_offs(r) if lots is None else lots).where("remaining > 0").crossJoin(F.broadcast(last)).join(sold, ["site_key", "item_key"], "left")
    lots = lots.withColumn("units_90d", F.coalesce("units_90d", F.lit(0))).withColumn("days_to_expiry", F.col("expiry_day_no") - F.col("last_day"))
    live = F.col("days_to_expiry") > 0
    before = W.partitionBy("site_key", "item_key").orderBy("expiry_day_no", "batch_id").rowsBetween(W.unboundedPreceding, -1)
    lots = lots.withColumn("units_ahead", F.coalesce(F.sum(F.when(live, F.col("remaining")).otherwise(0)).over(before), F.lit(0)))
    # in ninetieths of a unit, which are whole numbers: what is left when the trailing demand has sold the earlier lots and this one until it expires
    days, left = F.col("days_to_expiry"), 90 * F.col("remaining")
    sells = F.least(left, F.greatest(F.col("units_90d") * days - 90 * F.col("units_ahead"), F.lit(0)))
    unsold = F.when(~live, left).when(days <= EXPIRY_HORIZON, left - sells).otherwise(0)
    at_risk = F.col("unsold_90") > 0
    risk = F.when(~live, "EXPIRED").when(at_risk & (days <= 30), "CRITICAL").when(at_risk & (days <= 90), "HIGH").when(at_risk | (days <= 90), "MEDIUM").otherwise("SAFE")
    out = lots.withColumn("unsold_90", unsold).withColumn("risk_class", risk)
    return out.select(
        "site_key", "site", "batch_id", "item_key", "category", "maker", "supplier_key", "remaining", "cost_c", "expiry_day_no", "days_to_expiry", "units_90d", "units_ahead", "unsold_90", (F.col("unsold_90") / 90).alias("projected_unsold"),
        (F.col("remaining") * F.col("cost_c")).alias("value_c"), floor_div(F.col("unsold_90") * F.col("cost_c") + 45, F.lit(90)).alias("value_at_risk_c"), "risk_class",
    )


#: What the mart keeps once it was asked for: the batches, the dense stock facts, the lots, the ranks of all items and the series' features.
KEPT = ("t_batches", "t_ledger", "t_lots", "v_item", "v_series", "v_lotseries", "v_features", "v_itemsets")


@dataclass(frozen=True)
class Mart:
    """Roles with the ledger and the views, by the names that reports use. given: tables that take the place of derived ones."""

    roles: Roles
    given: dict[str, DataFrame] | None = None

    def table(self, name: str) -> DataFrame:
        r = self.roles
        if self.given and name in self.given:
            return self.given[name]
        made = {
            "t_sales": lambda: r.sales, "t_receipts": lambda: r.receipts, "t_batches": lambda: r.batches, "t_calendar": lambda: r.calendar,
            "t_ledger": lambda: ledger(r, self._known("t_lots")), "t_lots": lambda: write_offs(r, self._known("t_batches")), "v_monthly": lambda: monthly_sales(r.sales), "v_item": lambda: item_performance(r.sales, r.calendar),
            "v_site": lambda: site_performance(r.sales), "v_demand": lambda: demand_stats(self.table("t_ledger"), r.calendar), "v_stockout": lambda: stockout_summary(self.table("t_ledger")),
            "v_stock": lambda: current_stock(self.table("t_ledger")), "v_expiry": lambda: expiry_risk(r, None if r.kept is None else self.table("t_lots")), "v_series": lambda: stock_series(self.table("t_ledger")), "v_lotseries": lambda: lot_series(r.receipts), "v_features": lambda: demand_features(self.table("t_ledger"), r.calendar),
            "v_itemsets": self._itemsets,
        }
        if r.kept is None or name not in KEPT:
            return made[name]()
        if name not in r.kept:
            r.kept[name] = stored(made[name](), f"mart-{name}")
        return r.kept[name]

    def tables(self, names: set[str]) -> dict[str, DataFrame]:
        """The tables by name; batches and lots come first, so that what is made of them reads the stored ones."""
        first = [n for n in ("t_batches", "t_lots", "v_expiry") if n in names]
        return {n: self.table(n) for n in (*first, *sorted(names.difference(first)))}

    def _known(self, name: str) -> DataFrame | None:
        """The table if it is stored by now; else None, as for one reader alone it takes less to make it than to store it."""
        return (self.roles.kept or {}).get(name)

    def _itemsets(self) -> DataFrame:
        from ..operators import mining, reports

        return reports.run_sql(self.roles.sales.sparkSession, self, f"select * from {mining.ITEMSETS} s")


VIEW_SQL = """
v_monthly as (
  select cast(date_trunc('month', d) as date) as month_start, cast(sum(quantity) as bigint) as units, cast(sum(total_c) as bigint) as revenue_c, cast(sum(discount_c) as bigint) as discount_c,
    count(*) as sales_lines, count(distinct transaction_id) as transactions
  from t_sales group by 1),
item_totals as (
  select item_key, category, maker, cast(sum(quantity) as bigint) as units, cast(sum(total_c) as bigint) as revenue_c, count(distinct transaction_id) as transaction_count, count(distinct d) as sales_days
  from t_sales group by item_key, category, maker),
v_item as (
  select *, units / (select count(*) from t_calendar) as avg_daily_units, 100 * revenue_c / cast(sum(revenue_c) over () as bigint) as revenue_share_pct, rank() over (order by revenue_c desc) as revenue_rank,
    rank() over (order by units desc) as units_rank, rank() over (order by transaction_count desc) as frequency_rank,
    case when percent_rank() over (order by units) >= 0.8 then 'FAST' when percent_rank() over (order by units) >= 0.5 then 'MEDIUM' else 'SLOW' end as mover_class
  from item_totals),
v_site as (
  select *, revenue_c / 100e0 / transactions as average_basket_value, units / transactions as average_basket_units, 100 * revenue_c / cast(sum(revenue_c) over () as bigint) as revenue_share_pct,
    100 * units / cast(sum(units) over () as bigint) as units_share_pct, rank() over (order by revenue_c desc) as revenue_rank
  from (select site_key, site, cast(sum(quantity) as bigint) as units, cast(sum(total_c) as bigint) as revenue_c, count(distinct transaction_id) as transactions from t_sales group by site_key, site)),
daily as (select site_key, site, maker, count(*) as n, cast(sum(sold) as bigint) as total, cast(sum(sold * sold) as bigint) as squares from t_ledger group by site_key, site, maker),
week as (
  select site_key, maker, iso_year, iso_week, cast(sum(sold) as bigint) as week from t_ledger l join t_calendar c on c.day_no = l.day_no
  group by site_key, maker, iso_year, iso_week having count(*) = 7),
weekly as (select site_key, maker, count(*) as n, cast(sum(week) as bigint) as total, cast(sum(week * week) as bigint) as squares from week group by site_key, maker),
joined_demand as (
  select d.site_key, d.site, d.maker, d.n as n_days, d.total as units, d.total / d.n as daily_mean,
    case when d.n > 1 then sqrt(cast(d.n * d.squares - d.total * d.total as double) / (d.n * (d.n - 1))) end as daily_sd,
    w.n as n_weeks, w.total / w.n as weekly_mean, case when w.n > 1 then sqrt(cast(w.n * w.squares - w.total * w.total as double) / (w.n * (w.n - 1))) end as weekly_sd
  from daily d left join weekly w on w.site_key = d.site_key and w.maker = d.maker),
v_demand as (
  select *, weekly_sd / nullif(weekly_mean, 0) as weekly_cv,
    case when weekly_sd / nullif(weekly_mean, 0) is null then 'NO DEMAND' when weekly_sd / weekly_mean < 0.5 then 'STABLE' when weekly_sd / weekly_mean < 1.0 then 'MODERATELY VARIABLE' else 'HIGHLY VARIABLE' end as variability
  from joined_demand),
v_stockout as (
  select site_key, site, maker, family, count(*) filter (where closing = 0) as stockout_days, count(*) as days_observed, 100 * (count(*) filter (where closing = 0)) / count(*) as stockout_rate_pct
  from t_ledger group by site_key, site, maker, family),
stock_now as (
  select l.site_key, l.site, l.maker, l.family, l.day_no, l.closing, l.value_c, u.units_30d
  from t_ledger l join (select site_key, maker, cast(sum(sold) as bigint) as units_30d from t_ledger where day_no > (select max(day_no) from t_ledger) - 30 group by site_key, maker) u
    on u.site_key = l.site_key and u.maker = l.maker
  where l.day_no = (select max(day_no) from t_ledger)),
v_stock as (
  select *, closing * 30 / nullif(units_30d, 0) as days_of_inventory,
    case when closing = 0 then 'OUT_OF_STOCK' when units_30d = 0 then 'NO_DEMAND' when closing * 30 < 7 * units_30d then 'LOW_STOCK' when closing * 30 > 90 * units_30d then 'OVERSTOCK' else 'NORMAL' end as stock_status
  from stock_now),
lot_base as (
  select l.*, l.expiry_day_no - (select max(day_no) from t_sales) as days_to_expiry,
    coalesce((select cast(sum(s.quantity) as bigint) from t_sales s where s.site_key = l.site_key and s.item_key = l.item_key and s.day_no > (select max(day_no) from t_sales) - 90), 0) as units_90d
  from t_lots l where remaining > 0),
lot_ahead as (
  select *, coalesce(cast(sum(case when days_to_expiry > 0 then remaining else 0 end) over (partition by site_key, item_key order by expiry_day_no, batch_id rows between unbounded preceding and 1 preceding) as bigint), 0) as units_ahead
  from lot_base),
lot_unsold as (
  select *, case when days_to_expiry <= 0 then remaining * 90 when days_to_expiry > 365 then 0
    when units_90d * days_to_expiry <= units_ahead * 90 then remaining * 90
    when units_90d * days_to_expiry >= (units_ahead + remaining) * 90 then 0 else (units_ahead + remaining) * 90 - units_90d * days_to_expiry end as unsold_90
  from lot_ahead),
v_expiry as (
  select site_key, site, batch_id, item_key, category, maker, supplier_key, remaining, cost_c, expiry_day_no, days_to_expiry, units_90d, units_ahead, unsold_90, unsold_90 / 90 as projected_unsold,
    remaining * cost_c as value_c, (unsold_90 * cost_c + 45) // 90 as value_at_risk_c,
    case when days_to_expiry <= 0 then 'EXPIRED' when unsold_90 = 0 then case when days_to_expiry <= 90 then 'MEDIUM' else 'SAFE' end when days_to_expiry <= 30 then 'CRITICAL'
      when days_to_expiry <= 90 then 'HIGH' else 'MEDIUM' end as risk_class
  from lot_unsold),
""" + SERIES_SQL.lstrip()
