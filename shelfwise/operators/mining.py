"""Baskets and rules, series anomalies, lots, episodes: SQL over roles; see models.py for the fitted ones."""

from __future__ import annotations

from .reports import pct, total

SUPPORT, CONFIDENCE = 0.002, 0.02
BASKETS = "(select distinct transaction_id, maker as item from t_sales)"
COUNT = f"(select count(distinct transaction_id) as n from {BASKETS} n0)"
# only baskets' frequent items go into pairs and triples
FREQUENT = f"(select item, count(*) as c from {BASKETS} f0 group by item having count(*) >= (select ceil({SUPPORT} * n) from {COUNT} n1))"
KEPT = f"(select b.transaction_id, b.item from {BASKETS} b join {FREQUENT} f on f.item = b.item)"
PAIRS = f"(select a.item as i1, b.item as i2, count(*) as c from {KEPT} a join {KEPT} b on b.transaction_id = a.transaction_id and a.item < b.item group by a.item, b.item having count(*) >= (select ceil({SUPPORT} * n) from {COUNT} n2))"
TRIPLES = f"""(select a.item as i1, b.item as i2, c.item as i3, count(*) as c from {KEPT} a join {KEPT} b on b.transaction_id = a.transaction_id and a.item < b.item
  join {KEPT} c on c.transaction_id = b.transaction_id and b.item < c.item group by a.item, b.item, c.item having count(*) >= (select ceil({SUPPORT} * n) from {COUNT} n3))"""
ITEMSETS = f"""(select item as itemset, 1 as size, c, item as i1, cast(null as varchar(20)) as i2, cast(null as varchar(20)) as i3 from {FREQUENT} a1 union all select concat(i1, '|', i2), 2, c, i1, i2, null from {PAIRS} a2
  union all select concat(i1, '|', i2, '|', i3), 3, c, i1, i2, i3 from {TRIPLES} a3)"""
# every way to part an itemset of two or three into antecedent and consequent; v_itemsets are the mined itemsets, stored once
_PARTS = {2: (("i1", "i2"), ("i2", "i1")), 3: (("i1", "concat(i2, '|', i3)"), ("i2", "concat(i1, '|', i3)"), ("i3", "concat(i1, '|', i2)"), ("concat(i2, '|', i3)", "i1"), ("concat(i1, '|', i3)", "i2"), ("concat(i1, '|', i2)", "i3"))}
SPLITS = "(" + " union all ".join(f"select {a} as antecedent, {b} as consequent, c, i1, i2, i3 from v_itemsets p{size} where size = {size}" for size, sides in _PARTS.items() for a, b in sides) + ")"
RULES = f"""(select r.*, c / n as support, c / ca as confidence, c * n / (ca * cb) as lift, c / n - (ca / n) * (cb / n) as leverage, (1 - cb / n) / nullif(1 - c / ca, 0) as conviction from (
  select p.antecedent, p.consequent, p.c, p.i1, p.i2, p.i3, a.c as ca, b.c as cb, a.size as antecedent_size, b.size as consequent_size, n.n from {SPLITS} p join v_itemsets a on a.itemset = p.antecedent join v_itemsets b on b.itemset = p.consequent cross join {COUNT} n
  ) r where c >= {CONFIDENCE} * ca and c * n > ca * cb)"""

# the items of every rule, one a row
RULE_ITEMS = "(" + " union all ".join(f"select antecedent, consequent, i{k} as item, antecedent_size + consequent_size as items from {RULES} r{k} where i{k} is not null" for k in (1, 2, 3)) + ")"

#: Robust z of the week and of the day, units that a movement has at least, days without stock that make a pattern, days of history.
Z7, ZD, BIG, RUN, HISTORY, EPISODE_GAP = 5, 6, 5, 7, 70, 3
KNOWN = f"n_seen > {HISTORY} and z7 is not null and zd is not null"
# sales are censored while there is no stock: a drop needs stock on every day of the week
FLAGS = f"""(select *, {KNOWN} and ((z7 >= {Z7} and units_7d - usual_7d >= {BIG}) or (zd >= {ZD} and sold - usual_day >= {BIG})) as spike, {KNOWN} and z7 <= -{Z7} and usual_7d - units_7d >= {BIG} and empty_days_7 = 0 as drop_flag,
  {KNOWN} and stock_run = {RUN} as stockout_onset from v_series)"""
# half of the threshold is enough to name the type; the last match counts
KIND = f"case when stock_run >= {RUN} then 'stockout_pattern' when z7 >= {Z7} / 2e0 and units_7d - usual_7d >= {BIG} then 'demand_spike' when z7 <= -{Z7} / 2e0 and usual_7d - units_7d >= {BIG} and empty_days_7 = 0 then 'demand_drop' else 'unclassified' end"
LOT_KIND = "case when quantity_z >= 5 and quantity >= 2.5e0 * quantity_median then 'bulk_purchase' when gap_z >= 5 and gap >= 2 * gap_median then 'supply_gap' when abs(cost_z) >= 5 and abs(cost_c - cost_median) >= 0.25e0 * cost_median then 'cost_change' end"
_OF_SERIES = f"select grain, site, maker, day_no, {KIND} as anomaly_type from {FLAGS} f1 where spike or drop_flag or stockout_onset"
ANOMALIES = f"({_OF_SERIES} union all select 'lot', 'ALL', cast(item_key as varchar(20)), day_no, {LOT_KIND} from v_lotseries l1 where {LOT_KIND} is not null)"


def episodes(anomalies: str) -> str:
    return f"""(select grain, site, maker, anomaly_type, episode, min(day_no) as first_day, max(day_no) as last_day, count(*) as days from (select *, {total('fresh', 'over (partition by grain, site, maker, anomaly_type order by day_no)')} as episode
  from (select *, case when day_no - lag(day_no) over (partition by grain, site, maker, anomaly_type order by day_no) <= {EPISODE_GAP} then 0 else 1 end as fresh from (select distinct * from {anomalies} a0) a) b) c group by grain, site, maker, anomaly_type, episode)"""


EPISODES = episodes(ANOMALIES)
# those of the stock series alone: episodes are made within a grain, so lots, a grain of their own, take no part in them
SERIES_EPISODES = episodes(f"({_OF_SERIES})")
# events to hold detectors against: the tables hold no labelled ones, so the day with most units of a series and its longest time without stock
EVENTS = f"""(select 'demand_spike' as event_type, site, maker, day_no as start_day, day_no + 6 as end_day from (select *, row_number() over (partition by site, maker order by sold desc, day_no) as place from v_series where grain = 'site_maker') e0 where place = 1 and sold >= 60
  union all select 'stockout_pattern', site, maker, day_no - stock_run + 1, day_no + 6 from (select *, row_number() over (partition by site, maker order by stock_run desc, day_no) as place from v_series where grain = 'site_maker') e1 where place = 1 and stock_run >= {RUN})"""
HITS = f"""(select e.event_type, e.site, e.maker, max(case when x.anomaly_type = e.event_type then 1 else 0 end) as strict, max(case when x.anomaly_type is null then 0 else 1 end) as any_hit from {EVENTS} e
  left join {EPISODES} x on x.site = e.site and x.maker = e.maker and x.first_day <= e.end_day and x.last_day >= e.start_day group by e.event_type, e.site, e.maker)"""
MATCHED = f"""(select x.anomaly_type, x.site, x.maker, x.first_day, max(case when e.event_type is null then 0 else 1 end) as matched from {EPISODES} x
  left join {EVENTS} e on e.event_type = x.anomaly_type and e.site = x.site and e.maker = x.maker and x.first_day <= e.end_day and x.last_day >= e.start_day
  where x.grain = 'site_maker' group by x.anomaly_type, x.site, x.maker, x.first_day)"""

# every behaviour feature of a maker's items over the whole calendar; weeks are whole ISO weeks, deviations come from exact sums
_DAYS = "(select count(*) as days from t_calendar)"
_BY_DAY = f"(select maker, day_no, {total('sold')} as units, {total('closing')} as stock, {total('value_c')} as value_c from t_ledger group by maker, day_no)"
_BY_WEEK = f"(select maker, iso_year, iso_week, {total('sold')} as week from t_ledger l join t_calendar c on c.day_no = l.day_no group by maker, iso_year, iso_week having count(distinct l.day_no) = 7)"
_WEEKLY = f"(select maker, count(*) as n, {total('week')} as s, {total('week * week')} as ss, max(week) as best_week from {_BY_WEEK} w0 group by maker)"
_EMPTY = f"""(select maker, {total('case when closing = 0 then 1 else 0 end')} as stockout_days, count(*) as site_days, {total('case when closing = 0 and coalesce(before, 1) <> 0 then 1 else 0 end')} as stockout_events
  from (select maker, closing, lag(closing) over (partition by site_key, maker order by day_no) as before from t_ledger) e0 group by maker)"""
_EXPIRY = f"""(select maker, {total('case when days_to_expiry <= 0 then remaining else 0 end')} as expired_units, {total('case when days_to_expiry <= 0 then value_c else 0 end')} as expired_value_c,
  {total('case when days_to_expiry > 0 then value_at_risk_c else 0 end')} as expiry_risk_c from v_expiry group by maker)"""
ITEM_FEATURES = f"""select p.maker, p.items, p.units, p.revenue_c, p.revenue_c / nullif(p.units, 0) as average_price_c, p.units / t.days as daily_units, p.revenue_c / t.days as daily_revenue_c,
    w.weekly_units, w.weekly_sd, w.weekly_sd / nullif(w.weekly_units, 0) as weekly_cv, w.weekly_sd / nullif(sqrt(w.weekly_units), 0) as dispersion, w.best_week, d.sales_days, d.zero_sales_days, d.average_stock, d.average_value_c,
    k.closing, k.value_c, g.cogs_c / nullif(d.average_value_c, 0) * 365.25e0 / t.days as turnover, k.closing * 30 / nullif(k.units_30d, 0) as days_of_inventory, e.stockout_days, e.stockout_days / e.site_days as stockout_rate, e.stockout_events,
    coalesce(x.expired_units, 0) as expired_units, coalesce(x.expired_value_c, 0) as expired_value_c, coalesce(x.expiry_risk_c, 0) as expiry_risk_c, r.lots, r.bought, r.spend_c, r.spend_c / nullif(r.bought, 0) as average_cost_c
  from (select maker, {total('units')} as units, {total('revenue_c')} as revenue_c, count(*) as items from v_item group by maker) p cross join {_DAYS} t
  join (select maker, count(*) filter (where units > 0) as sales_days, count(*) filter (where units = 0) as zero_sales_days, {total('stock')} / count(*) as average_stock, {total('value_c')} / count(*) as average_value_c from {_BY_DAY} d0 group by maker) d on d.maker = p.maker
  join (select maker, s / n as weekly_units, case when n > 1 then sqrt(cast(n * ss - s * s as double) / (n * (n - 1))) end as weekly_sd, best_week from {_WEEKLY} w1) w on w.maker = p.maker
  join (select maker, {total('closing')} as closing, {total('value_c')} as value_c, {total('units_30d')} as units_30d from v_stock group by maker) k on k.maker = p.maker
  join {_EMPTY} e on e.maker = p.maker left join {_EXPIRY} x on x.maker = p.maker
  left join (select maker, count(*) as lots, {total('quantity')} as bought, {total('total_c')} as spend_c from t_receipts group by maker) r on r.maker = p.maker
  left join (select s.maker, {total('s.quantity * b.cost_c')} as cogs_c from t_sales s join t_batches b on b.batch_id = s.batch_id group by s.maker) g on g.maker = p.maker"""

TEXTS = {
    "N1": f"select transaction_id, item from {BASKETS} b",
    "N2": f"select itemset, size, c as support_count, c / n as support from v_itemsets i cross join {COUNT} n",
    "N3": f"select r.antecedent, r.consequent, r.antecedent_size, r.consequent_size, r.c as support_count, r.ca as antecedent_count, r.cb as consequent_count, r.support, r.confidence, r.lift, r.leverage, r.conviction, case when q.antecedent is null then false else true end as reverse_rule_present from {RULES} r left join {RULES} q on q.antecedent = r.consequent and q.consequent = r.antecedent",
    "N4": f"select s.support, i.size, count(*) as itemsets from v_itemsets i cross join {COUNT} n join (select 0.002 as support union all select 0.004 union all select 0.008) s on i.c >= ceil(s.support * n.n) group by s.support, i.size",
    "N5": f"select antecedent, consequent, confidence, lift from (select *, row_number() over (partition by least(antecedent, consequent), greatest(antecedent, consequent) order by confidence desc, antecedent) as place from {RULES} r where antecedent_size = 1 and consequent_size = 1) x where place = 1 order by lift desc, antecedent, consequent limit 15",
    "N6": ITEM_FEATURES,
    "N7": "select grain, site, maker, day_no, units_7d, usual_7d, z7, usual_day, zd, (sold + 1) / (usual_day + 1) as ratio_to_usual_day, (units_7d + 1) / (usual_7d + 1) as ratio_to_usual_week, empty_days_7, stock_run from v_series where z7 is not null",
    "N9": f"select grain, site, maker, day_no, spike, drop_flag, stockout_onset from {FLAGS} f where spike or drop_flag or stockout_onset",
    "N10": f"select anomaly_type, grain, site, count(*) as n, min(day_no) as first_day from (select grain, site, day_no, {KIND} as anomaly_type from {FLAGS} f where spike or drop_flag or stockout_onset) x group by anomaly_type, grain, site",
    "N11": f"select item_key, day_no, transaction_id, batch_id, lot_no, quantity, gap, cost_c, quantity_median, quantity_z, gap_median, gap_z, cost_median, cost_z, coalesce({LOT_KIND}, 'normal') as lot_label from v_lotseries where quantity_z is not null",
    "N12": f"select grain, site, maker, anomaly_type, episode, first_day, last_day, days from {EPISODES} e",
    "N13": f"""select h.event_type, h.events, h.strict_hits, h.any_hits, h.recall, h.any_recall, m.episodes, m.matched, m.precision_, 2 * h.recall * m.precision_ / nullif(h.recall + m.precision_, 0) as f1
      from (select event_type, count(*) as events, {total('strict')} as strict_hits, {total('any_hit')} as any_hits, {total('strict')} / count(*) as recall, {total('any_hit')} / count(*) as any_recall from {HITS} h0 group by event_type) h
      left join (select anomaly_type, count(*) as episodes, {total('matched')} as matched, {total('matched')} / count(*) as precision_ from {MATCHED} m0 group by anomaly_type) m on m.anomaly_type = h.event_type""",
    "N19": f"select grain, anomaly_type, count(*) as n, {pct('count(*)', total('count(*)', 'over ()'))} as share_pct from {ANOMALIES} a group by grain, anomaly_type",
    # every rule of two and of three items counted again, item by item
    "N20": f"""select count(*) as rules, {total('case when q.c is null or r.c <> q.c then 1 else 0 end')} as differing_counts, count(*) - count(r.lift) as infinite_metrics from {RULES} r
      left join (select antecedent, consequent, count(*) as c from (
          select x.antecedent, x.consequent, b.transaction_id from {RULE_ITEMS} x join {BASKETS} b on b.item = x.item group by x.antecedent, x.consequent, x.items, b.transaction_id having count(*) = x.items) m
        group by antecedent, consequent) q on q.antecedent = r.antecedent and q.consequent = r.consequent""",
}
