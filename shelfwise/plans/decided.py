"""The decision queries, and the same decisions as SQL, written apart from the operators' expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import decisions
from ..sources.roles import roles
from .views import Mart

#: Days before the last one that the historical decision is taken on.
BACK = 60


def made(spark: SparkSession, sf_dir: str, back: int = 0) -> decisions.Decisions:
    """Decisions of a day from the forecasts of the best baselines."""
    mart = Mart(roles(spark, sf_dir))
    day = decisions.decision_day(mart, back)
    return decisions.decide(decisions.pair_state(mart, day), decisions.live_lots(mart, day), decisions.baseline_forecasts(mart, day))


STATE = ["site", "maker", "as_of", "last_day_used", "stock", "stock_value_c", "units_7d", "units_28d", "units_30d", "units_90d", "empty_28d", "empty_90d", "empty_days", "days_observed", "stockout_events", "n_weeks", "weekly_mean", "weekly_sd", "price_c"]
LOT = ["site", "maker", "item_key", "batch_id", "days_to_expiry", "remaining", "units_90d", "units_ahead"]
QUEUE = [
    "position", "priority", "site", "maker", "stock", "cover_days", "f7", "f30", "risk", "reorder_status", "order_quantity", "overstock_status", "pair_expiry_risk", "primary_action", "primary_reason", "secondary_reasons",
    "short_units", "short_value_c", "excess_value_c", "expiry_value_c", "exposure_c", "active_issues", "score",
]
SHOWN = {
    "Y1": ("state", STATE), "Y2": ("lots", LOT), "Y3": ("frame", ["site", "maker", *(f"{c}{h}" for h in (7, 14, 30) for c in ("f", "lower", "upper"))]),
    "Y4": ("frame", ["site", "maker", "stock", "recent_daily", "daily", "daily_sd", "weekly_cv", "empty_share", "unit_c", "price_c"]),
    "Y5": ("pairs", ["site", "maker", "stock", "daily", "cover_days", "cover_days_upper", "base_risk", "risk", "risk_score", "risk_reason", "risk_notes"]),
    "Y6": ("pairs", ["site", "maker", "stock", "daily", "lead_demand", "safety_stock", "reorder_point", "order_up_to", "reorder_status", "order_quantity", "reorder_priority"]),
    "Y7": ("pairs", ["site", "maker", "stock", "units_30d", "overstock_status", "excess_units", "excess_value_c"]),
    "Y8": ("expiry", [*LOT, "unsold_90", "unsold_value_c", "expiry_risk", "expiry_action", "forecast_to_expiry"]),
    "Y9": ("by_pair", ["site_key", "maker", "pair_expiry_risk", "worst_batch", "worst_days", "expiry_lots", "expiry_lots_at_risk", "expiry_value_c", "expiry_acts"]),
    "Y10": ("queue", QUEUE),
}


def _shown(name: str, back: int = 0) -> Callable[[SparkSession, str], DataFrame]:
    part, columns = SHOWN[name]
    return lambda spark, sf_dir: getattr(made(spark, sf_dir, back), part).select(*columns)


def y11_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = made(spark, sf_dir)
    return decisions.summary(d.queue, d.expiry)


QUERIES = {name: _shown(name) for name in SHOWN} | {"Y11": y11_summary, "Y12": _shown("Y10", BACK)}

_Z = repr(decisions.RULES.z) + "e0"


def _num(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', floor(({x}) * 1e{digits} + 0.5e0) / 1e{digits})"


def _rank(x: str) -> str:
    return f"coalesce(list_position(['CRITICAL', 'HIGH', 'MEDIUM'], {x}), 4) - 1"


def _baseline(h: int) -> str:
    values = {"naive": f"{h}e0 * sold", "ma_7": f"{h} * mean_7", "ma_28": f"{h} * mean_28", "seasonal_weekly": f"weekly_{h}", "seasonal_yearly": f"yearly_{h}"}
    return " union all ".join(f"select site_key, maker, day_no, {h} as horizon, target_{h} as target, '{m}' as model, cast(floor(({v}) * 1000e0 + 0.5e0) as bigint) as point_k from v_features where n_seen >= 28 and ({v}) is not null" for m, v in values.items())


def chain(back: int) -> str:
    """The decisions of a day as common table expressions, from the roles, the ledger and the features on."""
    windows = ", ".join(f"cast(coalesce(sum(sold) filter (where day_no > as_of - {n}), 0) as bigint) as units_{n}d" for n in (7, 28, 30, 90))
    return f"""
d_day as (select max(day_no) - {back} as as_of from t_calendar),
d_known as (select l.*, as_of, lag(closing, 1, 1) over (partition by site_key, maker order by day_no) as before from t_ledger l, d_day where day_no <= as_of),
d_week as (select site_key, maker, (as_of - day_no) // 7 as block, cast(sum(sold) as bigint) as units from d_known where day_no > as_of - 182 group by all),
d_weekly as (select site_key, maker, count(*) as n_weeks, cast(sum(units) as bigint) as s, cast(sum(units * units) as bigint) as q from d_week group by all),
d_price as (
  select site_key, maker, coalesce(cast(sum(total_c) filter (where day_no > as_of - 90) as bigint) / cast(sum(quantity) filter (where day_no > as_of - 90) as bigint), cast(sum(total_c) as bigint) / cast(sum(quantity) as bigint)) as price_c
  from t_sales, d_day where day_no <= as_of group by all),
d_state as (
  select k.*, n_weeks, s / n_weeks as weekly_mean, case when n_weeks > 1 then sqrt(cast(n_weeks * q - s * s as double) / (n_weeks * (n_weeks - 1))) end as weekly_sd, price_c
  from (select site_key, site, maker, max(as_of) as as_of, max(day_no) as last_day_used, max(closing) filter (where day_no = as_of) as stock, max(value_c) filter (where day_no = as_of) as stock_value_c, {windows},
      count(*) filter (where closing = 0 and day_no > as_of - 28) as empty_28d, count(*) filter (where closing = 0 and day_no > as_of - 90) as empty_90d, count(*) filter (where closing = 0) as empty_days,
      count(*) as days_observed, count(*) filter (where closing = 0 and before <> 0) as stockout_events
    from d_known group by site_key, site, maker) k
  left join d_weekly using (site_key, maker) left join d_price using (site_key, maker)),
d_in as (select site_key, site, batch_id, cast(sum(quantity) as bigint) as n from t_receipts, d_day where day_no <= as_of group by all),
d_out as (select site_key, batch_id, cast(sum(quantity) as bigint) as n from t_sales, d_day where day_no <= as_of group by all),
d_sold as (select site_key, item_key, cast(sum(quantity) as bigint) as units_90d from t_sales, d_day where day_no between as_of - 89 and as_of group by all),
d_lots as (
  select i.site_key, i.site, b.maker, b.item_key, i.batch_id, b.cost_c, expiry_day_no, expiry_day_no - as_of as days_to_expiry, i.n - coalesce(o.n, 0) as remaining, coalesce(units_90d, 0) as units_90d
  from d_in i left join d_out o using (site_key, batch_id) join t_batches b using (batch_id) left join d_sold s on s.site_key = i.site_key and s.item_key = b.item_key, d_day
  where i.n > coalesce(o.n, 0) and expiry_day_no > as_of),
d_ahead as (select *, cast(coalesce(sum(remaining) over (partition by site_key, item_key order by expiry_day_no, batch_id rows between unbounded preceding and 1 preceding), 0) as bigint) as units_ahead from d_lots),
d_base as ({' union all '.join(map(_baseline, (7, 14, 30)))}),
d_val as (select b.* from d_base b, (select max(day_no) as last_day from t_calendar) where day_no > last_day - 360 and day_no + horizon <= last_day - 180 and target is not null),
d_err as (select horizon, model, cast(sum(abs(point_k - 1000 * target)) as bigint) / nullif(cast(sum(target) as bigint), 0) as wape from d_val group by all),
d_best as (select horizon, model from d_err qualify row_number() over (partition by horizon order by wape nulls last, model) = 1),
d_res as (select v.horizon, point_k, 1000 * target - point_k as residual from d_val v join d_best using (horizon, model)),
d_edge as (select horizon, {', '.join(f'floor(quantile_cont(point_k, {k / 5}) * 10 + 0.5e0) as e{k}' for k in range(1, 5))} from d_res group by horizon),
d_band as (
  select horizon, {' + '.join(f'cast(10 * point_k >= e{k} as int)' for k in range(1, 5))} as bin, floor(quantile_cont(residual, 0.1) * 10 + 0.5e0) as low, floor(quantile_cont(residual, 0.9) * 10 + 0.5e0) as high
  from d_res join d_edge using (horizon) group by all),
d_point as (
  select site_key, maker, horizon, point_k, coalesce({' + '.join(f'cast(10 * point_k >= e{k} as int)' for k in range(1, 5))}, 0) as bin
  from d_base join d_best using (horizon, model) left join d_edge using (horizon), d_day where day_no = as_of),
d_fore as (
  select site_key, maker, horizon, point_k / 1000e0 as point, greatest(10 * point_k + coalesce(low, 0), 0) / 10000e0 as lower, greatest(10 * point_k + coalesce(high, 0), 0) / 10000e0 as upper
  from d_point left join d_band using (horizon, bin)),
d_wide as (
  select site_key, maker, {', '.join(f"max(point) filter (where horizon = {h}) as f{h}, max(lower) filter (where horizon = {h}) as lower{h}, max(upper) filter (where horizon = {h}) as upper{h}" for h in (7, 14, 30))}
  from d_fore group by all),
d_frame as (
  select s.*, {', '.join(f'{c}{h}' for h in (7, 14, 30) for c in ('f', 'lower', 'upper'))}, units_28d / 28e0 as recent_daily, greatest(coalesce(f7, 0) / 7e0, units_28d / 28e0) as daily,
    case when n_weeks >= 8 then weekly_sd / sqrt(7e0) end as daily_sd, case when n_weeks >= 8 and weekly_mean > 0 then weekly_sd / weekly_mean end as weekly_cv, empty_days / days_observed as empty_share, stock_value_c / nullif(stock, 0) as unit_c
  from d_state s left join d_wide using (site_key, maker)),
d_cover as (
  select *, case when daily > 0 then stock / daily end as cover_days, case when upper7 / 7e0 > 0 then stock / (upper7 / 7e0) end as cover_days_upper,
    case when daily <= 0 then 'NO_DEMAND_DATA' when stock = 0 or stock / daily < 3 then 'CRITICAL' when stock / daily < 7 then 'HIGH' when stock / daily < 14 then 'MEDIUM' else 'LOW' end as base_risk,
    empty_28d >= 3 or empty_share > 0.025e0 as history from d_frame),
d_up as (select *, base_risk in ('LOW', 'MEDIUM') and (history or coalesce(cover_days_upper < 7, false)) as raised from d_cover),
d_risk as (
  select *, case when not raised then base_risk when base_risk = 'LOW' then 'MEDIUM' else 'HIGH' end as risk,
    case when base_risk = 'NO_DEMAND_DATA' then 0e0 when stock = 0 then 100e0 else 100e0 * (1e0 - least(cover_days, 14e0) / 14e0) end as risk_score,
    case when base_risk = 'NO_DEMAND_DATA' then 'no demand seen or forecast' when stock = 0 then concat('out of stock, ', {_num('daily', 2)}, ' units a day expected')
      else concat({_num('cover_days', 1)}, ' days of cover at ', {_num('daily', 2)}, ' units a day') end as risk_reason,
    concat(empty_28d, ' empty days of 28, empty on ', {_num('100 * empty_share', 1)}, '% of all days') as of_history from d_up),
d_notes as (
  select *, case when base_risk = 'NO_DEMAND_DATA' then '' else concat_ws('; ', case when raised and history then concat('raised from ', base_risk, ': ', of_history) end,
    case when raised and cover_days_upper < 7 then concat('raised from ', base_risk, ': ', {_num('cover_days_upper', 1)}, ' days of cover at the upper forecast') end,
    case when not raised and history and risk in ('CRITICAL', 'HIGH') then of_history end, case when stock > 0 and f7 > stock then 'the 7-day forecast is over the stock' end,
    case when weekly_cv >= 1 then 'weekly demand varies by its mean or more' end) end as risk_notes from d_risk),
d_point_of as (select *, daily * 7e0 as lead_demand, greatest({_Z} * coalesce(daily_sd, sqrt(daily)) * sqrt(7e0), 0e0) as safety_stock from d_notes),
d_level as (select *, lead_demand + safety_stock as reorder_point, floor((lead_demand + safety_stock + daily * 14e0) * 100e0 + 0.5e0) / 100e0 as order_up_to from d_point_of),
d_status as (select *, case when daily <= 0 then 'NO_DEMAND_DATA' when stock <= lead_demand then 'ORDER_NOW' when stock < reorder_point then 'REORDER_SOON' else 'NO_REORDER' end as reorder_status from d_level),
d_order as (
  select *, cast(case when reorder_status in ('ORDER_NOW', 'REORDER_SOON') then ceil(greatest(order_up_to - stock, 0e0) - 1e-9) else 0 end as bigint) as order_quantity,
    case when reorder_status = 'ORDER_NOW' then case when stock = 0 or cover_days < 3 then 'CRITICAL' else 'HIGH' end
      when reorder_status = 'REORDER_SOON' then case when stock < 7 * (upper7 / 7e0) then 'HIGH' else 'MEDIUM' end else 'LOW' end as reorder_priority,
    case when stock > 0 and (units_30d = 0 or stock * 30 > 90 * units_30d) then 'OVERSTOCK' else 'NORMAL' end as overstock_status from d_status),
d_excess as (select *, cast(case when overstock_status = 'OVERSTOCK' then ceil(greatest(stock - 90 * greatest(units_30d / 30e0, coalesce(f30, 0) / 30e0), 0e0) - 1e-9) else 0 end as bigint) as excess_units from d_order),
d_pairs as (select *, cast(case when excess_units > 0 then floor((2 * excess_units * stock_value_c + stock) / (2 * stock)) else 0 end as bigint) as excess_value_c from d_excess),
d_unsold as (
  select *, case when days_to_expiry > 365 or units_90d * days_to_expiry >= (units_ahead + remaining) * 90 then 0 when units_90d * days_to_expiry <= units_ahead * 90 then remaining * 90
    else (units_ahead + remaining) * 90 - units_90d * days_to_expiry end as unsold_90 from d_ahead),
d_expiry as (
  select u.*, (unsold_90 * cost_c + 45) // 90 as unsold_value_c, case when unsold_90 = 0 then case when days_to_expiry <= 90 then 'MEDIUM' else 'LOW' end when days_to_expiry <= 30 then 'CRITICAL' when days_to_expiry <= 90 then 'HIGH' else 'MEDIUM' end as expiry_risk,
    f30 / 30e0 * least(days_to_expiry, 365) as forecast_to_expiry from d_unsold u left join d_wide using (site_key, maker)),
d_acted as (select *, case expiry_risk when 'LOW' then 'NO_ACTION' when 'MEDIUM' then 'MONITOR' else 'PRIORITIZE_SALE' end as expiry_action, case when unsold_90 < 90 and expiry_risk in ('CRITICAL', 'HIGH') then 'MEDIUM' else expiry_risk end as level from d_expiry),
d_first as (
  select *, row_number() over (partition by site_key, maker order by {_rank('level')}, unsold_value_c desc, days_to_expiry, batch_id) as place, count(*) over (partition by site_key, maker) as expiry_lots,
    count(*) filter (where unsold_90 > 0) over (partition by site_key, maker) as expiry_lots_at_risk, cast(sum(unsold_value_c) over (partition by site_key, maker) as bigint) as expiry_value_c,
    bool_or(level in ('CRITICAL', 'HIGH') or (level = 'MEDIUM' and unsold_90 > 0)) over (partition by site_key, maker) as expiry_acts from d_acted),
d_worst as (select site_key, maker, level as pair_expiry_risk, batch_id as worst_batch, days_to_expiry as worst_days, expiry_lots, expiry_lots_at_risk, expiry_value_c, expiry_acts from d_first where place = 1),
d_all as (
  select p.*, coalesce(pair_expiry_risk, 'NONE') as pair_expiry_risk, worst_batch, worst_days, coalesce(expiry_value_c, 0) as expiry_value_c, reorder_status in ('ORDER_NOW', 'REORDER_SOON') as orders,
    least({_rank('risk')}, {_rank('reorder_priority')}) as stock_rank, case when pair_expiry_risk = 'MEDIUM' and not expiry_acts then 3 else {_rank("coalesce(pair_expiry_risk, 'NONE')")} end as expiry_rank,
    case when overstock_status = 'OVERSTOCK' and excess_value_c >= 250000 then 2 else 3 end as over_rank, floor(greatest(daily * 7e0 - stock, 0e0) * 100e0 + 0.5e0) / 100e0 as short_units
  from d_pairs p left join d_worst using (site_key, maker)),
d_sums as (select *, cast(floor(short_units * coalesce(price_c, 0) + 0.5e0) as bigint) as short_value_c from d_all),
d_issue as (
  select site_key, maker, stock_rank as rank, 0 as kind, case when orders then reorder_status else 'MONITOR_STOCK_CLOSELY' end as action,
    concat(risk_reason, case when orders then concat(', order ', order_quantity) else '' end, case when risk_notes <> '' then concat(' (', risk_notes, ')') else '' end) as reason from d_sums where stock_rank < 3 or orders
  union all select site_key, maker, expiry_rank, 1, case when expiry_rank < 2 then 'PRIORITIZE_SALE_EXPIRING_STOCK' else 'MONITOR_EXPIRY' end, concat('batch ', worst_batch, ' expires in ', worst_days, ' days') from d_sums where expiry_rank < 3
  union all select site_key, maker, over_rank, 2, 'REVIEW_OVERSTOCK', concat(excess_units, ' units over 90 days of cover') from d_sums where overstock_status = 'OVERSTOCK'),
d_ranked as (select *, row_number() over (partition by site_key, maker order by rank, kind) as place from d_issue),
d_issues as (
  select site_key, maker, max(rank) filter (where place = 1) as rank, max(action) filter (where place = 1) as action, max(reason) filter (where place = 1) as reason, count(*) filter (where rank < 3) as active_issues,
    coalesce(string_agg(concat('[', ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'][rank + 1], '] ', reason), ' | ' order by place) filter (where place > 1), '') as secondary_reasons from d_ranked group by all),
d_scored as (
  select s.*, short_value_c + excess_value_c + expiry_value_c as exposure_c, coalesce(rank, 3) as priority_rank, coalesce(action, case when risk = 'NO_DEMAND_DATA' then 'NO_DEMAND_DATA' else 'MONITOR' end) as primary_action,
    coalesce(reason, case when risk = 'NO_DEMAND_DATA' then risk_reason else concat('no issue: ', risk_reason) end) as primary_reason, coalesce(secondary_reasons, '') as secondary_reasons, coalesce(active_issues, 0) as active_issues
  from d_sums s left join d_issues using (site_key, maker)),
d_points as (
  select *, ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'][priority_rank + 1] as priority, floor((400 - 100 * priority_rank + 5 * active_issues + least(exposure_c / 100000, 50e0)) * 100e0 + 0.5e0) / 100e0 as score from d_scored),
d_queue as (select *, row_number() over (order by priority_rank, score desc, site, maker) as position from d_points)"""


def _sql(back: int, columns: str, table: str) -> str:
    return f"with {chain(back).lstrip()} select {columns} from {table}"


_TABLES = {"state": "d_state", "lots": "d_ahead", "frame": "d_frame", "pairs": "d_pairs", "expiry": "d_acted", "by_pair": "d_worst", "queue": "d_queue"}
_COUNTS = ", ".join(
    f"count(*) filter (where {c} = '{v}') as {n}_{v.lower()}"
    for c, n, vs in (("priority", "priority", decisions.SEVERITY), ("risk", "risk", (*decisions.SEVERITY, "NO_DEMAND_DATA")), ("reorder_status", "reorder", ("ORDER_NOW", "REORDER_SOON", "NO_REORDER")), ("overstock_status", "stock", ("OVERSTOCK",)))
    for v in vs
)
_SUMS = ", ".join(f"cast(sum({c}) as bigint) as {c}" for c in ("order_quantity", "excess_units", "short_value_c", "excess_value_c", "expiry_value_c"))
_LOT_COUNTS = "(select count(*) from d_acted) as lots, " + ", ".join(f"(select count(*) from d_acted where expiry_risk = '{v}') as lots_{v.lower()}" for v in decisions.SEVERITY)
#: on the roles and views; the registry puts them before
SQL = {name: _sql(0, ", ".join(columns), _TABLES[part]) for name, (part, columns) in SHOWN.items()}
SQL |= {"Y11": _sql(0, f"count(*) as pairs, {_COUNTS}, {_SUMS}, {_LOT_COUNTS}", "d_queue"), "Y12": _sql(BACK, ", ".join(QUEUE), "d_queue")}
