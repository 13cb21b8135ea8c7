"""The named reports, as SQL over the roles (t_*) and views (v_*).

Each text is valid in Spark and, for cross-checks, in any engine with the same standard functions. Spark gets the tables as
DataFrames, so a report is one lazy plan from the sources on; money is in cents until it is shown.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..plans.views import Mart


def total(expr: str, extra: str = "") -> str:
    """An exact sum as a bigint; extra: a filter or a window."""
    return f"cast(sum({expr}) {extra} as bigint)"


def money(expr: str, extra: str = "") -> str:
    return f"{total(expr, extra)} / 100e0"


def pct(part: str, whole: str) -> str:
    return f"100 * {part} / nullif({whole}, 0)"


def where(cond: str) -> str:
    return f"filter (where {cond})"


UNITS, REVENUE = f"{total('quantity')} as units", f"{money('total_c')} as revenue"
TX = "count(distinct transaction_id) as transactions"
SALES_DAYS = "t_sales s join t_calendar c on c.day_no = s.day_no"
LEDGER_DAYS = "t_ledger l join t_calendar c on c.day_no = l.day_no"
YEAR, SITES = 1998, "('ASIA', 'EUROPE')"
TOP_CATEGORY = "(select min(category) from t_sales)"
LAST = "(select max(day_no) from t_ledger)"
STATUS_ORDER = "case stock_status when 'OUT_OF_STOCK' then 1 when 'LOW_STOCK' then 2 when 'NORMAL' then 3 when 'OVERSTOCK' then 4 else 5 end"
RISK_ORDER = "case risk_class when 'EXPIRED' then 1 when 'CRITICAL' then 2 when 'HIGH' then 3 when 'MEDIUM' then 4 else 5 end"


def _by(keys: str, source: str = SALES_DAYS, cond: str = "", tx: bool = True) -> str:
    return f"select {keys}, {UNITS}, {REVENUE}{', ' + TX if tx else ''} from {source} {'where ' + cond if cond else ''} group by {keys}"


def _top_items(measure: str, n: int = 10) -> str:
    """The items with most of a measure: a rank among them is one among all."""
    return f"(select item_key, category, {UNITS}, {total('total_c')} as revenue_c, count(distinct transaction_id) as transaction_count, count(distinct d) as sales_days from t_sales group by item_key, category, maker order by {measure} desc, item_key limit {n})"


SALES = {
    "S1": f"""select {money('total_c')} as total_revenue, {total('quantity')} as total_units_sold, {TX}, count(*) as sales_lines,
        {money('total_c')} / nullif(count(distinct transaction_id), 0) as average_transaction_value, {total('quantity')} / nullif(count(distinct transaction_id), 0) as average_units_per_transaction,
        {money('total_c')} / max(n_days) as average_daily_revenue, {total('quantity')} / max(n_days) as average_daily_units, {money('discount_c')} as total_discount,
        {pct(total('discount_c'), total('total_c + discount_c'))} as discount_rate_pct
      from t_sales cross join (select count(*) as n_days from t_calendar) n""",
    "S2": _by("c.d, day_name"),
    "S3": f"select iso_year, iso_week, min(c.d) as week_first_day, count(distinct c.d) as days_in_data, {UNITS}, {REVENUE} from {SALES_DAYS} group by iso_year, iso_week",
    "S4": "select month_start, units, revenue_c / 100e0 as revenue, discount_c / 100e0 as discount, sales_lines, transactions from v_monthly",
    "S5": _by("year, quarter", tx=False),
    "S6": _by("year"),
    "S7": f"""select year, month, revenue, units, lag(revenue) over (partition by month order by year) as previous_revenue, lag(units) over (partition by month order by year) as previous_units,
        100 * (revenue - lag(revenue) over (partition by month order by year)) / nullif(lag(revenue) over (partition by month order by year), 0) as yoy_growth_pct
      from ({_by('year, month', tx=False)}) m""",
    # the first items by one measure need no ranks of all items; held against the view that has them
    "S8": (f"select rank() over (order by revenue_c desc) as revenue_rank, item_key, category, units, revenue_c / 100e0 as revenue, transaction_count, 100 * revenue_c / all_c as revenue_share_pct from {_top_items('revenue_c')} x cross join (select {total('total_c')} as all_c from t_sales) w", "select revenue_rank, item_key, category, units, revenue_c / 100e0 as revenue, transaction_count, revenue_share_pct from v_item order by revenue_rank, item_key limit 10"),
    "S9": (f"select rank() over (order by units desc) as units_rank, item_key, category, units, revenue_c / 100e0 as revenue, units / n_days as avg_daily_units from {_top_items('units')} x cross join (select count(*) as n_days from t_calendar) w", "select units_rank, item_key, category, units, revenue_c / 100e0 as revenue, avg_daily_units from v_item order by units_rank, item_key limit 10"),
    "S10": (f"select rank() over (order by transaction_count desc) as frequency_rank, item_key, category, units, transaction_count, sales_days from {_top_items('transaction_count')} x", "select frequency_rank, item_key, category, units, transaction_count, sales_days from v_item order by frequency_rank, item_key limit 10"),
    "S11": f"""select rank() over (order by sum(total_c) desc) as revenue_rank, category, count(distinct item_key) as items, {UNITS}, {REVENUE}, {TX}, {money('total_c')} / {total('quantity')} as average_selling_price,
        {pct(total('total_c'), total('sum(total_c)', 'over ()'))} as revenue_share_pct, {pct(total('quantity'), total('sum(quantity)', 'over ()'))} as units_share_pct
      from t_sales group by category""",
}

BRANCHES = {
    "B1": "select revenue_rank, site, revenue_c / 100e0 as revenue, units, transactions, average_basket_value, average_basket_units, revenue_share_pct, units_share_pct from v_site",
    "B2": f"""select site, category, {REVENUE}, {pct(total('total_c'), total('sum(total_c)', 'over (partition by site)'))} as share_of_site_pct,
        ({total('total_c')} / {total('sum(total_c)', 'over (partition by site)')}) / ({total('sum(total_c)', 'over (partition by category)')} / {total('sum(total_c)', 'over ()')}) as category_share_index
      from t_sales group by site, category""",
    "B3": f"select case when grouping(site) = 1 then 'ALL' else site end as site, case when grouping(category) = 1 then 'ALL' else category end as category, {UNITS}, {REVENUE} from t_sales group by rollup(site, category)",
    "B4": f"""select site, category, rank_in_category, item_key, units, revenue_c / 100e0 as revenue from (
        select *, row_number() over (partition by site, category order by revenue_c desc, item_key) as rank_in_category
        from (select site, category, item_key, {UNITS}, {total('total_c')} as revenue_c from t_sales group by site, category, item_key) x) y where rank_in_category <= 3""",
    "B5": f"""select s.site, s.revenue_c / 100e0 as revenue, s.units, k.stock_units, k.stock_value, k.out_of_stock, o.stockout_days, o.stockout_rate_pct, x.expired_value, x.value_at_risk
      from v_site s
      join (select site, {total('closing')} as stock_units, {money('value_c')} as stock_value, count(*) {where("stock_status = 'OUT_OF_STOCK'")} as out_of_stock from v_stock group by site) k on k.site = s.site
      join (select site, {total('stockout_days')} as stockout_days, {pct(total('stockout_days'), total('days_observed'))} as stockout_rate_pct from v_stockout group by site) o on o.site = s.site
      join (select site, {money('value_c', where("risk_class = 'EXPIRED'"))} as expired_value, {money('value_at_risk_c', where("risk_class <> 'EXPIRED'"))} as value_at_risk from v_expiry group by site) x on x.site = s.site""",
}


def _stock_by(keys: str) -> str:
    return f"select {keys}, {total('closing')} as stock_units, {money('value_c')} as stock_value, count(*) {where('closing > 0')} as stocked, {pct(total('value_c'), total('sum(value_c)', 'over ()'))} as value_share_pct from v_stock group by {keys}"


def _turnover(keys: str) -> str:
    """Cost of goods sold against the average daily stock value."""
    on = " and ".join(f"g.{k} = v.{k}" for k in keys.split(", "))
    return f"""select {', '.join(f'g.{k}' for k in keys.split(', '))}, g.cogs_c / 100e0 as cogs, v.value_days_c / 100e0 / n.n_days as average_stock_value, g.cogs_c * n.n_days / nullif(v.value_days_c, 0) as turnover,
        g.cogs_c * 365 / nullif(v.value_days_c, 0) as annual_turnover, v.value_days_c / nullif(g.cogs_c, 0) as days_of_stock
      from (select {keys}, {total('s.quantity * u.unit_c')} as cogs_c from (select site_key, site, maker, substr(maker, 1, 7) as family, quantity from t_sales) s
        join (select site_key as u_site, maker as u_maker, cast(floor({total('total_c')} / {total('quantity')}) as bigint) as unit_c from t_receipts group by site_key, maker) u on u_site = site_key and u_maker = maker group by {keys}) g
      join (select {keys}, {total('value_c')} as value_days_c from t_ledger group by {keys}) v on {on} cross join (select count(*) as n_days from t_calendar) n"""


INVENTORY = {
    "I1": f"select max(day_no) as snapshot_day, {total('closing')} as stock_units, {money('value_c')} as stock_value, count(distinct case when closing > 0 then maker end) as stocked_makers, count(distinct case when closing > 0 then site end) as stocked_sites, count(*) {where('closing = 0')} as out_of_stock_pairs from v_stock",
    "I2": _stock_by("site"),
    "I3": _stock_by("family"),
    "I4": f"select maker, {total('closing')} as stock_units, {money('value_c')} as stock_value, count(*) {where('closing > 0')} as sites_with_stock from v_stock group by maker order by stock_value desc, maker limit 20",
    "I5": f"""select case when grouping(family) = 1 then 'ALL' else family end as family, case when grouping(maker) = 1 then 'ALL' else maker end as maker, {total('closing')} as stock_units, {money('value_c')} as stock_value
      from v_stock where site = (select site from v_site order by revenue_c desc, site limit 1) group by rollup(family, maker) order by stock_units desc, family, maker limit 25""",
    "I6": f"select {STATUS_ORDER} as status_order, stock_status, count(*) as pairs, {total('closing')} as units, {money('value_c')} as value, {pct('count(*)', total('count(*)', 'over ()'))} as pair_share_pct, {pct(total('value_c'), total('sum(value_c)', 'over ()'))} as value_share_pct from v_stock group by stock_status",
    "I7": "select site, " + ", ".join(f"count(*) {where(f'''stock_status = '{s}' ''')} as {s.lower()}" for s in ("OUT_OF_STOCK", "LOW_STOCK", "NORMAL", "OVERSTOCK", "NO_DEMAND")) + " from v_stock group by site",
    "I8": "select site, maker, stock_status, closing, units_30d, days_of_inventory from v_stock where stock_status in ('OUT_OF_STOCK', 'LOW_STOCK') order by units_30d desc, site, maker limit 30",
    "I9": "select site, maker, closing, value_c / 100e0 as value, days_of_inventory from v_stock where stock_status = 'OVERSTOCK' order by value_c desc, site, maker limit 20",
    "I10": f"select family, {total('closing')} as units, {total('units_30d')} / 30e0 as daily_demand, 30 * {total('closing')} / nullif({total('units_30d')}, 0) as days_of_inventory from v_stock group by family",
    "I11": f"""select year, month, {total('closing')} as month_end_units, {money('value_c')} as month_end_value
      from t_ledger l join (select year, month, max(day_no) as end_day from t_calendar group by year, month) m on m.end_day = l.day_no group by year, month""",
    "I12": f"""select g.cogs_c / 100e0 as cogs, v.value_days_c / 100e0 / n_days as average_stock_value, g.cogs_c * n_days / nullif(v.value_days_c, 0) as turnover, g.cogs_c * 365 / nullif(v.value_days_c, 0) as annual_turnover, v.value_days_c / nullif(g.cogs_c, 0) as days_of_stock
      from (select {total('quantity * unit_c')} as cogs_c from t_sales s join (select site_key as u_site, maker as u_maker, cast(floor({total('total_c')} / {total('quantity')}) as bigint) as unit_c from t_receipts group by site_key, maker) u on u_site = site_key and u_maker = maker) g
      cross join (select {total('value_c')} as value_days_c, count(distinct day_no) as n_days from t_ledger) v""",
    "I13": _turnover("family"),
    "I14": _turnover("site"),
    "I15": f"""select maker, annual_turnover, top_rank, bottom_rank, case when top_rank <= 15 then 'TOP' else 'BOTTOM' end as side from (
        select maker, annual_turnover, rank() over (order by annual_turnover desc, maker) as top_rank, rank() over (order by annual_turnover, maker) as bottom_rank from ({_turnover('maker')}) t) r where top_rank <= 15 or bottom_rank <= 15""",
    "I16": f"select mover_class, count(*) as items, {total('units')} as units, {pct('count(*)', total('count(*)', 'over ()'))} as item_share_pct, {pct(total('units'), total('sum(units)', 'over ()'))} as units_share_pct, min(avg_daily_units) as least_daily, max(avg_daily_units) as most_daily from v_item group by mover_class",
    "I17": "select item_key, category, units, avg_daily_units from v_item where mover_class = 'FAST' order by units desc, item_key limit 10",
    "I18": "select item_key, category, units, avg_daily_units from v_item where mover_class = 'SLOW' order by units, item_key limit 10",
    "I19": f"""select p.maker, p.units, k.stock_units, k.stock_value_c / 100e0 as stock_value from (select maker, {total('units')} as units from v_item where mover_class = 'SLOW' group by maker) p
      join (select maker, {total('closing')} as stock_units, {total('value_c')} as stock_value_c from v_stock group by maker) k on k.maker = p.maker order by stock_value_c desc, p.maker limit 15""",
}


def _expired_by(keys: str, cond: str = "risk_class = 'EXPIRED'", tail: str = "") -> str:
    return f"select {keys}, count(*) as lots, {total('remaining')} as units, {money('value_c')} as value, {pct(total('value_c'), total('sum(value_c)', 'over ()'))} as value_share_pct from v_expiry where {cond} group by {keys} {tail}"


def _risk_by(keys: str) -> str:
    return f"select {keys}, count(*) as lots, {total('unsold_90')} / 90e0 as projected_unsold, {money('value_at_risk_c')} as value_at_risk, {pct(total('value_at_risk_c'), total('sum(value_at_risk_c)', 'over ()'))} as share_of_risk_pct from v_expiry where days_to_expiry > 0 and projected_unsold > 0 group by {keys}"


EXPIRY = {
    "X1": "select " + ", ".join(f"count(*) {where(c)} as {n}_lots, {total('remaining', where(c))} as {n}_units, {money('value_c', where(c))} as {n}_value" for n, c in (("expired", "days_to_expiry <= 0"), ("near_expiry", "days_to_expiry between 1 and 90"), ("at_risk", "days_to_expiry > 0 and projected_unsold > 0"))) + " from v_expiry",
    "X2": f"select {RISK_ORDER} as risk_order, risk_class, count(*) as lots, {total('remaining')} as units, {money('value_c')} as value, {money('value_at_risk_c')} as value_at_risk from v_expiry group by risk_class",
    "X3": _expired_by("category"),
    "X4": _expired_by("site"),
    "X5": f"select c.year, c.month, count(*) as lots, {total('remaining')} as units, {money('value_c')} as value from v_expiry x join t_calendar c on c.day_no = x.expiry_day_no where risk_class = 'EXPIRED' group by c.year, c.month",
    "X6": f"select item_key, count(*) as lots, {total('remaining')} as units, {total('value_c')} as value_c from v_expiry where risk_class = 'EXPIRED' group by item_key order by value_c desc, item_key limit 15",
    "X7": f"""select case when days_to_expiry <= 30 then '1-30' when days_to_expiry <= 90 then '31-90' when days_to_expiry <= 180 then '91-180' when days_to_expiry <= 365 then '181-365' else '>365' end as bucket,
        count(*) as lots, {total('remaining')} as units, {money('value_c')} as value from v_expiry where days_to_expiry > 0 group by 1""",
    "X8": _expired_by("category", "days_to_expiry between 1 and 90"),
    "X9": _risk_by("category"),
    "X10": _risk_by("site"),
    "X11": f"""select coalesce(site, 'ALL') as site, coalesce(category, 'ALL') as category, coalesce(maker, 'ALL') as maker, grouping_id(site, category, maker) as level, {total('unsold_90')} / 90e0 as projected_unsold, {total('value_at_risk_c')} as value_at_risk_c
      from v_expiry where days_to_expiry > 0 and projected_unsold > 0 group by rollup(site, category, maker) order by level desc, value_at_risk_c desc, site, category, maker limit 40""",
    "X12": "select site, batch_id, remaining, days_to_expiry, projected_unsold, value_at_risk_c / 100e0 as value_at_risk, risk_class from v_expiry where days_to_expiry > 0 order by value_at_risk_c desc, site, batch_id limit 20",
    "X13": "select site, batch_id, days_to_expiry, units_90d / 90e0 as daily_demand, units_ahead, remaining, projected_unsold from v_expiry where days_to_expiry between 1 and 30 order by days_to_expiry, remaining desc, site, batch_id limit 20",
}

PRICES = f"""select item_key, min_by(cost_c, rank_no) as first_c, max_by(cost_c, rank_no) as latest_c, min(cost_c) as least_c, max(cost_c) as most_c, {total('total_c')} / {total('quantity')} as average_c, count(*) as lines
  from (select *, row_number() over (partition by item_key order by day_no, supplier_key, cost_c, transaction_id, quantity) as rank_no from t_receipts) r group by item_key having count(*) >= 10"""
PURCHASES = {
    "P1": f"select count(*) as purchase_lines, {total('quantity')} as quantity, {money('total_c')} as cost, {money('total_c')} / {total('quantity')} as average_price, count(distinct supplier_key) as suppliers, count(distinct item_key) as items, count(distinct batch_id) as batches from t_receipts",
    "P2": f"select year, month, {total('quantity')} as quantity, {money('total_c')} as cost, count(*) as lines from t_receipts r join t_calendar c on c.day_no = r.day_no group by year, month",
    "P3": f"select rank() over (order by sum(total_c) desc) as spend_rank, supplier_key, {money('total_c')} as spend, count(distinct item_key) as items, count(distinct category) as categories, {money('total_c')} / {total('quantity')} as average_price, {pct(total('total_c'), total('sum(total_c)', 'over ()'))} as share_pct from t_receipts group by supplier_key",
    "P4": f"""select count(*) as suppliers, 100e0 / count(*) as equal_share_pct, {', '.join(f"{pct(total('spend_c', where(f'place <= {n}')), total('spend_c'))} as top_{n}_share_pct" for n in (1, 5, 10))}
      from (select spend_c, row_number() over (order by spend_c desc, supplier_key) as place from (select supplier_key, {total('total_c')} as spend_c from t_receipts group by supplier_key) s) r""",
    "P5": f"select category, {total('quantity')} as quantity, {money('total_c')} as cost, {pct(total('total_c'), total('sum(total_c)', 'over ()'))} as cost_share_pct from t_receipts group by category",
    "P6": f"select item_key, {total('quantity')} as quantity, {total('total_c')} as cost_c, count(distinct supplier_key) as suppliers from t_receipts group by item_key order by cost_c desc, item_key limit 20",
    "P7": f"select item_key, lines, first_c, latest_c, least_c, most_c, average_c, 100 * (latest_c - first_c) / first_c as change_pct, 100 * (most_c - least_c) / least_c as range_pct, abs(latest_c - first_c) * 100 > 15 * first_c as significant from ({PRICES}) p",
    "P8": f"select count(*) as items, count(*) {where('(latest_c - first_c) * 100 > 15 * first_c')} as rises, count(*) {where('(first_c - latest_c) * 100 > 15 * first_c')} as falls, {total('latest_c - first_c')} / count(*) as average_change_c from ({PRICES}) p",
}

CV = "case when count(*) > 1 then sqrt(cast(count(*) * cast(sum(week * week) as bigint) - cast(sum(week) as bigint) * cast(sum(week) as bigint) as double) / (count(*) * (count(*) - 1))) / nullif(cast(sum(week) as bigint) / count(*), 0) end"


def _weekly(key: str) -> str:
    return f"select {key}, iso_year, iso_week, {total('sold')} as week from {LEDGER_DAYS} group by {key}, iso_year, iso_week having count(distinct l.day_no) = 7"


SEASON = f"""select a.category, a.month, (a.units / a.days) / nullif(w.units / w.days, 0) as seasonal_index
  from (select category, month, {total('quantity')} as units, max(days) as days from {SALES_DAYS} join (select month as m, count(*) as days from t_calendar group by month) k on k.m = c.month group by category, month) a
  join (select category, {total('quantity')} as units, max(n_days) as days from t_sales cross join (select count(*) as n_days from t_calendar) n group by category) w on w.category = a.category"""
DEMAND = {
    "D1": "select site, maker, units, daily_mean, daily_sd, weekly_mean, weekly_sd, weekly_cv, variability from v_demand order by units desc, site, maker limit 40",
    "D2": f"select count(*) as pairs, {total('units')} as units, {total('units')} / {total('n_days')} as average_daily_units, count(*) {where('units = 0')} as pairs_without_demand, max(weekly_cv) as largest_weekly_cv from v_demand",
    "D3": f"select variability, count(*) as pairs, {total('units')} as units, {pct(total('units'), total('sum(units)', 'over ()'))} as units_share_pct from v_demand group by variability",
    "D4": f"""select maker, weekly_mean, weekly_cv, variable_rank, stable_rank from (select *, rank() over (order by weekly_cv desc, maker) as variable_rank, rank() over (order by weekly_cv, maker) as stable_rank
        from (select maker, {total('week')} / count(*) as weekly_mean, {CV} as weekly_cv from ({_weekly('maker')}) w group by maker) m where weekly_mean >= 7) r where variable_rank <= 5 or stable_rank <= 5""",
    "D5": f"select family, weekly_cv, rank() over (order by weekly_cv) as stability_rank from (select family, {CV} as weekly_cv from ({_weekly('family')}) w group by family) f",
    "D6": "select category, " + ", ".join(f"max(case when month = {m} then seasonal_index end) as m{m}" for m in range(1, 13)) + f" from ({SEASON}) s group by category",
    "D7": f"""select category, max(case when down = 1 then month end) as peak_month, max(case when up = 1 then month end) as lowest_month, max(seasonal_index) - min(seasonal_index) as amplitude, rank() over (order by max(seasonal_index) - min(seasonal_index) desc) as amplitude_rank
      from (select *, row_number() over (partition by category order by seasonal_index desc, month) as down, row_number() over (partition by category order by seasonal_index, month) as up from ({SEASON}) s) r group by category""",
    "D8": f"select case when is_weekend then 'WEEKEND' else 'WEEKDAY' end as day_kind, {UNITS}, {REVENUE}, {total('quantity')} / count(distinct c.d) as units_per_day, {money('total_c')} / count(distinct c.d) as revenue_per_day from {SALES_DAYS} group by is_weekend",
    "D9": _by("dow, day_name", tx=False),
}

ONSET = "(select l.*, case when closing = 0 and coalesce(lag(closing) over (partition by site_key, maker order by day_no), 1) > 0 then 1 else 0 end as onset from t_ledger l)"


def _stockouts_by(keys: str) -> str:
    empty = where("closing = 0")
    return f"select {keys}, count(*) {empty} as stockout_days, count(*) as days_observed, {pct(f'(count(*) {empty})', 'count(*)')} as stockout_rate_pct, {total('onset')} as stockout_events, {pct(f'(count(*) {empty})', total('case when closing = 0 then 1 else 0 end', '') if not keys else 'max(all_days)')} as share_pct from (select o.*, {total('case when closing = 0 then 1 else 0 end', 'over ()')} as all_days from {ONSET} o) p group by {keys}"


STOCKOUTS = {
    "K1": f"select count(*) {where('closing = 0')} as stockout_days, {pct('(count(*) ' + where('closing = 0') + ')', 'count(*)')} as stockout_rate_pct, {total('onset')} as stockout_events, count(distinct case when closing = 0 then maker end) as makers_affected, count(distinct case when closing = 0 then site end) as sites_affected, count(distinct case when closing = 0 then concat(site, '/', maker) end) as pairs_affected from {ONSET} o",
    "K2": _stockouts_by("site"),
    "K3": _stockouts_by("family"),
    "K4": f"select * from (select rank() over (order by sum(stockout_days) desc, maker) as place, maker, {total('stockout_days')} as stockout_days, count(*) {where('stockout_days > 0')} as sites_affected from v_stockout group by maker) r where place <= 20",
    "K5": "select site, maker, stockout_days, stockout_rate_pct from v_stockout order by stockout_days desc, site, maker limit 20",
    "K6": f"select {', '.join(f'''{pct(total('days', where(f'place <= {n}')), total('days'))} as top_{n}_share_pct, 100e0 * {n} / count(*) as top_{n}_of_makers_pct''' for n in (10, 20))} from (select days, row_number() over (order by days desc, maker) as place from (select maker, {total('stockout_days')} as days from v_stockout group by maker) m) r",
    "K7": f"select year, month, count(*) {where('closing = 0')} as stockout_days, {pct('(count(*) ' + where('closing = 0') + ')', 'count(*)')} as stockout_rate_pct from {LEDGER_DAYS} group by year, month",
    "K8": f"""select mover_class, count(*) as makers, {total('stockout_days')} as stockout_days, {pct(total('stockout_days'), total('sum(stockout_days)', 'over ()'))} as share_pct
      from (select maker, {total('stockout_days')} as stockout_days from v_stockout group by maker) o join (select maker, case when place >= 0.8 then 'FAST' when place >= 0.5 then 'MEDIUM' else 'SLOW' end as mover_class
        from (select maker, percent_rank() over (order by units) as place from (select maker, {total('units')} as units from v_item group by maker) u) r) p on p.maker = o.maker group by mover_class""",
}

DICE = f"year = {YEAR} and category = {TOP_CATEGORY} and site in {SITES}"
OLAP = {
    "O1": f"select case grouping_id(year, quarter, month, day) when 0 then 'DAY' when 1 then 'MONTH' when 3 then 'QUARTER' when 7 then 'YEAR' else 'ALL' end as level, year, quarter, month, day, {UNITS}, {REVENUE}, {TX} from {SALES_DAYS} group by rollup(year, quarter, month, day)",
    "O2": f"select case grouping_id(category, item_key) when 0 then 'ITEM' when 1 then 'CATEGORY' else 'ALL' end as level, category, item_key, {UNITS}, {REVENUE} from t_sales where category in (select category from t_sales group by category order by sum(total_c) desc, category limit 2) group by rollup(category, item_key)",
    "O3": _by("year"),
    "O4": _by("year, quarter", cond=f"year = {YEAR}"),
    "O5": _by("year, quarter, month", cond=f"year = {YEAR} and quarter = 2"),
    "O6": _by("c.d", cond=f"year = {YEAR} and month = 5"),
    "O7": _by("category"),
    "O8": f"select * from ({_by('item_key', cond=f'category = {TOP_CATEGORY}')}) x order by revenue desc, item_key limit 20",
    "O9": _by("site"),
    "O10": _by("category", cond="site = 'ASIA'"),
    "O11": f"select * from ({_by('item_key', cond=f'''site = 'ASIA' and category = {TOP_CATEGORY}''')}) x order by revenue desc, item_key limit 20",
    "O12": _by("category", cond=f"year = {YEAR}"),
    "O13": _by("site", cond=DICE),
    "O14": _by("quarter, site", cond=DICE),
    "O15": f"select site, {', '.join(f'''{money('total_c', where(f'year = {y}'))} as y{y}''' for y in range(1995, 2002))}, {money('total_c')} as total, {pct(f'''({total('total_c', where(f'year = {YEAR}'))} - {total('total_c', where(f'year = {YEAR - 1}'))})''', total('total_c', where(f'year = {YEAR - 1}')))} as growth_pct from {SALES_DAYS} group by site",
    "O16": f"select category, {', '.join(f'''{money('total_c', where(f'site_key = {k}'))} as site_{k}''' for k in range(5))} from t_sales group by category",
    "O17": f"select month, {', '.join(f'''{money('total_c', where(f'year = {y}'))} as y{y}''' for y in range(1995, 2002))} from {SALES_DAYS} group by month",
    "O18": f"select coalesce(site, 'ALL') as site, coalesce(category, 'ALL') as category, grouping_id(site, category) as grouping_level, {UNITS}, {REVENUE} from {SALES_DAYS} where year = {YEAR} group by cube(site, category)",
}

EXAMPLES = {
    "A1": f"select year, cast(null as int) as quarter, {UNITS}, {REVENUE} from {SALES_DAYS} group by year union all select year, quarter, {UNITS}, {REVENUE} from {SALES_DAYS} group by year, quarter",
    "A2": f"select year, month, revenue, lag(revenue, 12) over (order by year, month) as year_before, 100 * (revenue - lag(revenue, 12) over (order by year, month)) / nullif(lag(revenue, 12) over (order by year, month), 0) as growth_pct from ({_by('year, month', tx=False)}) m",
    "A3": f"select c.d, {UNITS}, {REVENUE} from {SALES_DAYS} where s.day_no > (select max(day_no) from t_sales) - 14 group by c.d",
    "A4": f"select coalesce(cast(year as varchar(10)), 'All years') as year_label, coalesce(cast(quarter as varchar(10)), 'All quarters') as quarter_label, {REVENUE} from {SALES_DAYS} group by rollup(year, quarter)",
    "A5": _by("is_weekend", tx=False),
    "A6": f"select year, category, {REVENUE}, {pct(total('total_c'), total('sum(total_c)', 'over (partition by year)'))} as share_of_year_pct from {SALES_DAYS} group by year, category",
    "A6a": f"select {pct(total('revenue_c', where('revenue_rank <= 10')), total('revenue_c'))} as top_10_share_pct from v_item",
    "A7": f"select coalesce(cast(item_key as varchar(20)), 'TOTAL') as item, {UNITS}, {total('total_c')} as revenue_c from {SALES_DAYS} where {DICE} group by rollup(item_key) order by revenue_c desc, item limit 15",
    "A8": f"select site, {', '.join(f'''{money('total_c', where(f'''category = '{c}' '''))} as {c.lower().replace(' ', '_')}''' for c in ('ECONOMY', 'STANDARD'))}, {money('total_c')} as total from t_sales group by site",
    "A9": f"select site, category, item_key, {UNITS}, {total('total_c')} as revenue_c from t_sales where site = 'ASIA' group by site, category, item_key order by revenue_c desc, category, item_key limit 15",
    "A10": f"select maker, {total('closing')} as units from t_ledger where day_no = {LAST} group by maker order by units desc, maker limit 15",
    "A11": f"select year, quarter, {total('closing')} as quarter_end_units from t_ledger l join (select year, quarter, max(day_no) as end_day from t_calendar group by year, quarter) q on q.end_day = l.day_no group by year, quarter",
    "A12": f"select site, family, {pct('(count(*) ' + where('closing = 0') + ')', 'count(*)')} as stockout_pct from t_ledger group by site, family order by stockout_pct desc, site, family limit 15",
    "A13": f"select coalesce(cast(item_key as varchar(20)), 'TOTAL') as item, {total('quantity')} as quantity, {money('total_c')} as cost from t_receipts where supplier_key = (select supplier_key from t_receipts group by supplier_key order by sum(total_c) desc, supplier_key limit 1) group by rollup(item_key)",
    "A14": f"""select coalesce(category, 'ALL') as category, coalesce(site, 'ALL') as site, {total('surplus')} as surplus_units, {total('surplus * cost_c')} as surplus_value_c
      from (select site, category, cost_c, remaining - cast(floor(units_90d * days_to_expiry / 90) as bigint) as surplus from v_expiry where days_to_expiry between 1 and 180) x where surplus > 0 group by rollup(category, site)""",
    "A15": f"select category, {total('remaining')} as expired_units, {money('remaining * cost_c')} as expired_value from t_lots where remaining > 0 and expiry_day_no <= (select max(day_no) from t_calendar) group by category",
}

REPORTS = SALES | BRANCHES | INVENTORY | EXPIRY | PURCHASES | DEMAND | STOCKOUTS | OLAP | EXAMPLES
_NAMES = re.compile(r"\b((?:from|join)\s+)([tv]_[a-z]+)\b")


def run_sql(spark: SparkSession, mart: Mart, text: str) -> DataFrame:
    """The text with its tables given as DataFrames."""
    used = {m[1] for m in _NAMES.findall(text)}
    return spark.sql(_NAMES.sub(r"\1{\2}", text), **mart.tables(used))


def report(spark: SparkSession, mart: Mart, name: str) -> DataFrame:
    text = REPORTS[name]
    return run_sql(spark, mart, text if isinstance(text, str) else text[0])
