"""Behaviour features of every item over the whole calendar, from sparse movements: no day without a movement is made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.views import Mart, deviation, ratio
from ..sources.roles import floor_div

#: in the order of their priority where two are near copies of each other
FEATURES = [
    "units", "revenue_c", "average_price_c", "daily_units", "daily_revenue_c", "weekly_units", "weekly_sd", "weekly_cv", "dispersion", "sales_days", "zero_sales_days", "average_stock", "average_value_c", "closing", "value_c",
    "turnover", "days_of_inventory", "stockout_days", "stockout_rate", "stockout_events", "expired_units", "expired_value_c", "expiry_risk_c", "bought", "spend_c", "average_cost_c",
]


def item_stock(mart: Mart) -> DataFrame:
    """item_key, site_days, stock_days (units times days), last stock, days without stock and times that it ran out, over all sites.

    Between two movements of a site and item the stock stays, so each movement counts for the days up to the next one.
    """
    one = ["site_key", "item_key"]
    span = mart.table("t_calendar").agg(F.min("day_no").alias("lo"), F.max("day_no").alias("hi"))
    lost = mart.table("t_lots").where("remaining > 0").join(F.broadcast(span), F.col("expiry_day_no") <= F.col("hi")).select(*one, F.col("expiry_day_no").alias("day_no"), (-F.col("remaining")).alias("delta"))
    moved = mart.table("t_receipts").select(*one, "day_no", F.col("quantity").alias("delta")).unionByName(mart.table("t_sales").select(*one, "day_no", (-F.col("quantity")).alias("delta"))).unionByName(lost)
    moved = moved.groupBy(*one, "day_no").agg(F.sum("delta").alias("delta"))
    starts = moved.select(*one).distinct().crossJoin(F.broadcast(span)).select(*one, F.col("lo").alias("day_no"), F.lit(0).cast("long").alias("delta"))
    moved = moved.unionByName(starts).groupBy(*one, "day_no").agg(F.sum("delta").alias("delta"))
    pair = W.partitionBy(*one)
    by_day = pair.orderBy("day_no")
    ran = moved.withColumn("running", F.sum("delta").over(by_day)).withColumns({"base": F.greatest(-F.min("running").over(pair), F.lit(0)), "next_day": F.lead("day_no").over(by_day)})
    ran = ran.crossJoin(F.broadcast(span)).withColumn("stock", F.col("base") + F.col("running")).withColumn("days", F.coalesce(F.col("next_day"), F.col("hi") + 1) - F.col("day_no"))
    empty = F.col("stock") == 0
    ran = ran.withColumn("ran_out", empty & (F.coalesce(F.lag("stock").over(by_day), F.lit(1)) != 0))
    return ran.groupBy("item_key").agg(
        F.sum("days").alias("site_days"), F.sum(F.col("stock") * F.col("days")).alias("stock_days"), F.sum(F.when(F.col("next_day").isNull(), F.col("stock")).otherwise(0)).alias("closing"),
        F.sum(F.when(empty, F.col("days")).otherwise(0)).alias("stockout_days"), F.count_if("ran_out").alias("stockout_events"),
    )


def item_features(mart: Mart) -> DataFrame:
    """item_key, category and FEATURES. Items that were never bought, or whose sold lots are all unknown, have no row (dropped_items counts them).

    Weeks are the calendar's whole ISO weeks, those without sales included; deviations come from exact sums. Stock is valued at the
    item's average cost.
    """
    sales, calendar = mart.table("t_sales"), mart.table("t_calendar")
    days = calendar.agg(F.count(F.lit(1)).alias("n_days"), F.max("day_no").alias("last_day"))
    whole = calendar.groupBy("iso_year", "iso_week").agg(F.count(F.lit(1)).alias("n")).where("n = 7")
    n_weeks = whole.agg(F.count(F.lit(1)).alias("n_weeks"))
    week_days = calendar.join(F.broadcast(whole.select("iso_year", "iso_week")), ["iso_year", "iso_week"]).select("day_no", "iso_year", "iso_week")
    # one row a day
    weekly = sales.join(F.broadcast(week_days), "day_no").groupBy("item_key", "iso_year", "iso_week").agg(F.sum("quantity").alias("week"))
    weekly = weekly.groupBy("item_key").agg(F.sum("week").alias("week_total"), F.sum(F.col("week") * F.col("week")).alias("week_squares"))
    sold = sales.crossJoin(F.broadcast(days.select("last_day"))).groupBy("item_key", "category").agg(
        F.sum("quantity").alias("units"), F.sum("total_c").alias("revenue_c"), F.countDistinct("day_no").alias("sales_days"), F.sum(F.when(F.col("day_no") > F.col("last_day") - 30, F.col("quantity")).otherwise(0)).alias("units_30d"),
    )
    cogs = sales.join(mart.table("t_batches").select("batch_id", "cost_c"), "batch_id").groupBy("item_key").agg(F.sum(F.col("quantity") * F.col("cost_c")).alias("cogs_c"))
    bought = mart.table("t_receipts").groupBy("item_key").agg(F.sum("quantity").alias("bought"), F.sum("total_c").alias("spend_c"))
    expiry = mart.table("v_expiry").groupBy("item_key").agg(
        F.sum(F.when(F.col("days_to_expiry") <= 0, F.col("remaining")).otherwise(0)).alias("expired_units"), F.sum(F.when(F.col("days_to_expiry") <= 0, F.col("value_c")).otherwise(0)).alias("expired_value_c"),
        F.sum(F.when(F.col("days_to_expiry") > 0, F.col("value_at_risk_c")).otherwise(0)).alias("expiry_risk_c"),
    )
    rows = sold.join(bought, "item_key").join(cogs, "item_key").join(item_stock(mart), "item_key").join(weekly, "item_key", "left").join(expiry, "item_key", "left").crossJoin(F.broadcast(days)).crossJoin(F.broadcast(n_weeks))
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = rows.withColumns({"unit_c": floor_div(F.col("spend_c"), F.col("bought")), "week_total": zero("week_total"), "week_squares": zero("week_squares")})
    rows = rows.withColumns({
        "weekly_units": F.col("week_total") / F.col("n_weeks"), "weekly_sd": deviation(F.col("n_weeks"), F.col("week_total"), F.col("week_squares")), "average_stock": F.col("stock_days") / F.col("n_days"),
        "average_value_c": F.col("stock_days") * F.col("unit_c") / F.col("n_days"), "value_c": F.col("closing") * F.col("unit_c"),
    })
    made = {
        "average_price_c": F.col("revenue_c") / F.col("units"), "daily_units": F.col("units") / F.col("n_days"), "daily_revenue_c": F.col("revenue_c") / F.col("n_days"), "weekly_cv": ratio(F.col("weekly_sd"), F.col("weekly_units")),
        "dispersion": ratio(F.col("weekly_sd"), F.sqrt("weekly_units")), "zero_sales_days": F.col("n_days") - F.col("sales_days"), "turnover": ratio(F.col("cogs_c"), F.col("average_value_c")) * 365.25 / F.col("n_days"),
        "days_of_inventory": ratio(F.col("closing") * 30, F.col("units_30d")), "stockout_rate": F.col("stockout_days") / F.col("site_days"), "expired_units": zero("expired_units"),
        "expired_value_c": zero("expired_value_c"), "expiry_risk_c": zero("expiry_risk_c"), "average_cost_c": F.col("spend_c") / F.col("bought"),
    }
    return rows.withColumns(made).select("item_key", "category", *FEATURES)


def dropped_items(mart: Mart) -> DataFrame:
    """One row: items with sales, and those of them without a row of features."""
    sold = mart.table("t_sales").select("item_key").distinct()
    kept = item_features(mart).select("item_key", F.lit(1).alias("has_features"))
    return sold.join(kept, "item_key", "left").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("has_features").isNull()).alias("dropped"))


ITEM_SQL = f"""
with i_span as (select min(day_no) as lo, max(day_no) as hi, count(*) as n_days from t_calendar),
i_move as (
  select site_key, item_key, day_no, cast(sum(delta) as bigint) as delta from (
    select site_key, item_key, day_no, quantity as delta from t_receipts union all select site_key, item_key, day_no, -quantity from t_sales
    union all select site_key, item_key, expiry_day_no, -remaining from t_lots where remaining > 0 and expiry_day_no <= (select hi from i_span)
    union all select distinct site_key, item_key, (select lo from i_span), 0 from (select site_key, item_key from t_receipts union all select site_key, item_key from t_sales))
  group by all),
i_run as (select *, cast(sum(delta) over (partition by site_key, item_key order by day_no) as bigint) as running, coalesce(lead(day_no) over (partition by site_key, item_key order by day_no), (select hi + 1 from i_span)) as until from i_move),
i_level as (select *, running - least(min(running) over (partition by site_key, item_key), 0) as stock from i_run),
i_stock as (
  select item_key, cast(sum(until - day_no) as bigint) as site_days, cast(sum(stock * (until - day_no)) as bigint) as stock_days, cast(sum(stock) filter (where until = (select hi + 1 from i_span)) as bigint) as closing,
    cast(coalesce(sum(until - day_no) filter (where stock = 0), 0) as bigint) as stockout_days, count(*) filter (where stock = 0 and before <> 0) as stockout_events
  from (select *, lag(stock, 1, 1) over (partition by site_key, item_key order by day_no) as before from i_level) group by item_key),
i_whole as (select iso_year, iso_week from t_calendar group by all having count(*) = 7),
i_week as (select item_key, cast(sum(week) as bigint) as s, cast(sum(week * week) as bigint) as q from (select item_key, iso_year, iso_week, cast(sum(quantity) as bigint) as week from t_sales join t_calendar using (day_no) join i_whole using (iso_year, iso_week) group by all) group by item_key),
i_sold as (select item_key, category, cast(sum(quantity) as bigint) as units, cast(sum(total_c) as bigint) as revenue_c, count(distinct day_no) as sales_days, cast(coalesce(sum(quantity) filter (where day_no > (select hi - 30 from i_span)), 0) as bigint) as units_30d from t_sales group by all),
i_bought as (select item_key, cast(sum(quantity) as bigint) as bought, cast(sum(total_c) as bigint) as spend_c from t_receipts group by all),
i_cogs as (select s.item_key, cast(sum(s.quantity * b.cost_c) as bigint) as cogs_c from t_sales s join t_batches b using (batch_id) group by all),
i_expiry as (
  select item_key, cast(coalesce(sum(remaining) filter (where days_to_expiry <= 0), 0) as bigint) as expired_units, cast(coalesce(sum(value_c) filter (where days_to_expiry <= 0), 0) as bigint) as expired_value_c,
    cast(coalesce(sum(value_at_risk_c) filter (where days_to_expiry > 0), 0) as bigint) as expiry_risk_c from v_expiry group by all),
i_joined as (
  select s.*, b.bought, b.spend_c, g.cogs_c, k.site_days, k.stock_days, k.closing, k.stockout_days, k.stockout_events, n_days, spend_c // bought as unit_c, (select count(*) from i_whole) as n_weeks, coalesce(w.s, 0) as s, coalesce(w.q, 0) as q,
    coalesce(expired_units, 0) as expired_units, coalesce(expired_value_c, 0) as expired_value_c, coalesce(expiry_risk_c, 0) as expiry_risk_c
  from i_sold s join i_bought b using (item_key) join i_cogs g using (item_key) join i_stock k using (item_key) left join i_week w using (item_key) left join i_expiry x using (item_key), i_span),
i_made as (
  select *, s / n_weeks as weekly_units, case when n_weeks > 1 then sqrt(cast(n_weeks * q - s * s as double) / (n_weeks * (n_weeks - 1))) end as weekly_sd, stock_days / n_days as average_stock, stock_days * unit_c / n_days as average_value_c, closing * unit_c as value_c from i_joined),
i_features as (
  select item_key, category, units, revenue_c, revenue_c / units as average_price_c, units / n_days as daily_units, revenue_c / n_days as daily_revenue_c, weekly_units, weekly_sd, weekly_sd / nullif(weekly_units, 0) as weekly_cv, weekly_sd / nullif(sqrt(weekly_units), 0) as dispersion,
    sales_days, n_days - sales_days as zero_sales_days, average_stock, average_value_c, closing, value_c, cogs_c / nullif(average_value_c, 0) * 365.25e0 / n_days as turnover, closing * 30 / nullif(units_30d, 0) as days_of_inventory, stockout_days, stockout_days / site_days as stockout_rate,
    stockout_events, expired_units, expired_value_c, expiry_risk_c, bought, spend_c, spend_c / bought as average_cost_c from i_made)
select item_key, category, {', '.join(FEATURES)} from i_features"""
