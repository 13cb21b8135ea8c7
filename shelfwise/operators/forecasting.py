"""Demand series, causal features, targets, baselines and metrics as SQL; fitted models are in models.py."""

from __future__ import annotations

from ..plans.series import HORIZONS, LAGS
from .reports import total

SERIES = "(select l.site_key, l.site, l.maker, l.family, l.day_no, l.sold, l.closing, c.dow, c.month, c.is_weekend, row_number() over (partition by l.site_key, l.maker order by l.day_no) as n_seen from t_ledger l join t_calendar c on c.day_no = l.day_no)"
FEATURES = [
    *(f"lag_{k}" for k in LAGS), "mean_7", "mean_14", "mean_28", "sd_7", "sd_14", "sd_28", "median_7", "median_28", "ratio_7_28", "mean_28_in_stock", "closing", "was_empty", "empty_last_7", "empty_days_7", "empty_days_28",
    "days_since_empty", "stock_to_demand", "next_dow", "next_day", "next_month", "next_quarter", "next_week", "next_weekend", "dow_sin", "dow_cos", "month_sin", "month_cos", "site_key", "family_no",
]
#: Days of history that an origin needs; days at the end that validation and test targets lie in.
HISTORY, TEST_DAYS = 28, 180
LAST = "(select max(day_no) as last_day from t_calendar)"


def split(horizon: str = "horizon", day: str = "day_no") -> str:
    """The period that the whole target lies in; null across borders."""
    return f"case when {day} + {horizon} <= last_day - {2 * TEST_DAYS} then 'train' when {day} > last_day - {2 * TEST_DAYS} and {day} + {horizon} <= last_day - {TEST_DAYS} then 'validation' when {day} > last_day - {TEST_DAYS} and {day} + {horizon} <= last_day then 'test' end"


BASE = "(" + " union all ".join(
    f"select site_key, site, maker, family, day_no, n_seen, {h} as horizon, target_{h} as target, censored_{h} as censored_days, {h}e0 * sold as naive, {h} * mean_7 as ma_7, {h} * mean_28 as ma_28, cast(weekly_{h} as double) as seasonal_weekly, cast(yearly_{h} as double) as seasonal_yearly from v_features"
    for h in HORIZONS
) + ")"
BASELINES = ("naive", "ma_7", "ma_28", "seasonal_weekly", "seasonal_yearly")
# scaled to whole thousandths, so that sums don't depend on the order of rows
LONG = "(" + " union all ".join(f"select family, horizon, '{b}' as model, {split()} as split, target, cast(round({b} * 1000) as bigint) - target * 1000 as error_k from {BASE} b cross join {LAST} d where target is not null and {b} is not null and n_seen >= {HISTORY}" for b in BASELINES) + ")"
METRICS = f"""count(*) as n, {total('abs(error_k)')} / 1e3 / count(*) as mae, sqrt({total('error_k * error_k')} / 1e6 / count(*)) as rmse, {total('abs(error_k)')} / 1e3 / nullif({total('target')}, 0) as wape, {total('error_k')} / 1e3 / count(*) as bias"""
RUNNING = f"(select site_key, maker, day_no, {total('sold', 'over (partition by site_key, maker order by day_no)')} as running from t_ledger)"
# what a forecast's error is held against: that of the naive one over the training period
SCALE = f"(select horizon, {total('abs(error_k)')} / 1e3 / count(*) as naive_mae from {LONG} l0 where split = 'train' and model = 'naive' group by horizon)"

TEXTS = {
    "H1": f"select site, maker, day_no, sold, closing, dow, month, is_weekend from {SERIES} s",
    "H2": f"select site, maker, day_no, {', '.join(FEATURES)} from v_features where n_seen >= {HISTORY}",
    "H3": " union all ".join(f"select site, maker, day_no, {h} as horizon, target_{h} as target, censored_{h} as censored_days from v_features where target_{h} is not null" for h in HORIZONS),
    "H4": f"select horizon, split, count(*) as origins, min(day_no) as first_day, max(day_no) as last_day_used from (select day_no, horizon, {split()} as split from {BASE} b cross join {LAST} d where n_seen >= {HISTORY}) x where split is not null group by horizon, split",
    "H5": f"""select site, maker, units, sold_days, case when sold_days < 28 then 'too few sales days' when units < 100 then 'too few units' else 'eligible' end as eligibility, row_number() over (order by units desc, site, maker) as volume_place
      from (select site, maker, {total('sold')} as units, count(*) filter (where sold > 0) as sold_days from t_ledger group by site, maker) p""",
    "H6": f"select site, maker, day_no, horizon, target, naive, ma_7, ma_28, seasonal_weekly, seasonal_yearly from {BASE} b where target is not null and n_seen >= {HISTORY}",
    "H11": f"select m.*, m.mae / s.naive_mae as mase from (select horizon, model, family, {METRICS} from {LONG} l where split = 'test' group by horizon, model, family) m join {SCALE} s on s.horizon = m.horizon",
    "H14": f"select horizon, model, wape from (select *, row_number() over (partition by horizon order by wape, model) as place from (select horizon, model, {METRICS} from {LONG} l where split = 'validation' group by horizon, model) m) r where place = 1",
    # every series and day: the mean of the last 28 days again, from running totals of the day and of 28 days before, joined by the day
    "H15": f"""select count(*) as rows_checked, {total('case when f.mean_28 is distinct from (g.running - coalesce(b.running, 0)) / 28e0 then 1 else 0 end')} as leaks
      from v_features f join {RUNNING} g on g.site_key = f.site_key and g.maker = f.maker and g.day_no = f.day_no left join {RUNNING} b on b.site_key = f.site_key and b.maker = f.maker and b.day_no = f.day_no - 28 where f.n_seen >= 28""",
}
