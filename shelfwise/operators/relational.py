"""Star-schema builds, parameterised reads and the relational building blocks, as SQL over roles and views.

A text is valid in Spark and in other engines; where their functions differ in name, the entry is a pair (Spark's, the other's).
"""

from __future__ import annotations

from .reports import REVENUE, SALES_DAYS, TX, UNITS, pct, total, where

STAR = {
    "E1": "select min(day_no) as lo, max(day_no) as hi from (select day_no from t_sales union all select day_no from t_receipts) d",
    "E2": "select date_key, d, day, dow, day_name, iso_week, month, month_name, quarter, year, is_weekend from t_calendar",
    "E3": "select row_number() over (order by maker) as maker_key, maker from (select distinct maker from t_receipts union select distinct maker from t_sales) m",
    "E4": f"select b.batch_id, b.item_key, b.supplier_key, s.spend_c, b.cost_c, b.first_day_no, b.expiry_day_no, b.initial_quantity from t_batches b left join (select supplier_key, {total('total_c')} as spend_c from t_receipts group by supplier_key) s on s.supplier_key = b.supplier_key",
    "E5": "select c.date_key, s.site_key, s.item_key, s.batch_id, s.transaction_id, s.quantity, s.price_c, s.discount_c, s.total_c from t_sales s join t_calendar c on c.day_no = s.day_no",
    "E6": "select c.date_key, r.site_key, r.supplier_key, r.item_key, r.batch_id, r.quantity, r.cost_c, r.total_c from t_receipts r join t_calendar c on c.day_no = r.day_no join t_batches b on b.batch_id = r.batch_id",
    "E7": "select date_key, site_key, maker, opening, purchased, sold, expired, closing, value_c from t_ledger",
    "E8": "select site, batch_id, expiry_day_no, remaining, remaining * cost_c as lost_value_c from t_lots where remaining > 0 and expiry_day_no <= (select max(day_no) from t_calendar)",
    # received less sold before it is floored at zero, and lines against the expiry of their batch
    "E9": f"""select count(*) {where('sold > received')} as over_sold_batches, count(*) {where('received - sold < 0 and remaining <> 0')} as wrongly_floored, {total('case when received < sold then sold - received else 0 end')} as units_over_sold, count(*) - count(distinct concat(cast(site_key as varchar(9)), '/', batch_id)) as repeated_keys,
      (select count(*) from t_sales s join t_batches b on b.batch_id = s.batch_id where s.day_no >= b.expiry_day_no) as sold_after_expiry, (select count(*) from t_receipts r join t_batches b on b.batch_id = r.batch_id where r.day_no >= b.expiry_day_no) as received_after_expiry,
      (select count(*) from t_ledger where closing < 0 or opening < 0) as negative_stock, (select count(*) - count(distinct date_key) from t_calendar) as repeated_days from t_lots""",
    "E10": f"select {total('purchased')} as purchased, {total('sold')} as sold, {total('expired')} as expired, {total('case when day_no = last_day then closing else 0 end')} as closing, {total('case when day_no = last_day then value_c else 0 end')} as value_c from t_ledger cross join (select max(day_no) as last_day from t_calendar) c",
    "E11": f"""select m.item_key, m.category, coalesce(s.price_c, r.cost_c, 100e0) as base_price_c from (select distinct item_key, category from t_sales union select distinct item_key, category from t_receipts) m
      left join (select item_key, {total('total_c')} / {total('quantity')} as price_c from t_sales group by item_key) s on s.item_key = m.item_key
      left join (select item_key, {total('total_c')} / {total('quantity')} as cost_c from t_receipts group by item_key) r on r.item_key = m.item_key""",
}

QUERYING = {
    "Q1": f"select year, month, {UNITS}, {REVENUE}, {pct(total('total_c'), total('sum(total_c)', 'over ()'))} as share_pct from {SALES_DAYS} where c.d >= date '1996-01-01' and c.d <= date '1997-12-31' group by year, month",
    "Q2": "select stock_status, site, maker, closing, days_of_inventory, count(*) over () as total_rows from v_stock where site = 'ASIA' order by days_of_inventory asc nulls last, maker limit 20 offset 5",
    "Q3": f"""select s.site, s.revenue_c, k.stock_units, o.stockout_days from v_site s left join (select site, {total('closing')} as stock_units from v_stock group by site) k on k.site = s.site
      left join (select site, {total('stockout_days')} as stockout_days from v_stockout group by site) o on o.site = s.site""",
    "Q4": f"""select p.maker, p.units, p.revenue_c, d.daily_units, k.closing, k.closing * 30 / nullif(k.units_30d, 0) as cover_days from (select maker, {total('units')} as units, {total('revenue_c')} as revenue_c from v_item group by maker) p
      join (select maker, {total('units')} / max(n_days) as daily_units from v_demand group by maker) d on d.maker = p.maker join (select maker, {total('closing')} as closing, {total('units_30d')} as units_30d from v_stock group by maker) k on k.maker = p.maker order by p.revenue_c desc, p.maker limit 50""",
    "Q5": f"""select coalesce(site, 'TOTAL') as row_label, coalesce(cast(year as varchar(9)), 'TOTAL') as col_label, grouping_id(site, year) as level, {REVENUE}, {UNITS}, {TX} from {SALES_DAYS}
      where category in ('ECONOMY', 'STANDARD') group by grouping sets ((site, year), (site), (year), ())""",
    "Q6": f"select year, quarter, site, {UNITS}, {REVENUE} from {SALES_DAYS} where year = 1998 and site = 'EUROPE' group by year, quarter, site",
    "Q7": f"""select s.revenue_c, s.transactions, k.stock_units, k.out_of_stock, x.at_risk_c from (select {total('total_c')} as revenue_c, {TX} from t_sales) s
      cross join (select {total('closing')} as stock_units, count(*) {where('closing = 0')} as out_of_stock from v_stock) k cross join (select {total('value_at_risk_c')} as at_risk_c from v_expiry where days_to_expiry > 0) x""",
    "Q8": "select item_key, revenue_c, count(*) over () as total_rows from v_item order by revenue_c desc, item_key limit 25 offset 50",
    "Q9": "select site, maker, variability, weekly_cv from v_demand where variability <> 'NO DEMAND' and weekly_cv >= 0.5 order by weekly_cv desc, site, maker limit 30",
    "Q10": "select site, batch_id, risk_class, days_to_expiry, projected_unsold from v_expiry where risk_class in ('CRITICAL', 'HIGH') and site = 'ASIA'",
}

PREDICATES = {
    "R1": "select transaction_id, item_key, quantity * price_c as gross_c, case when discount_c = 0 then 'NONE' when discount_c * 20 < quantity * price_c then 'SMALL' else 'LARGE' end as discount_kind from t_sales",
    "R2": "select transaction_id, item_key, quantity from t_sales where category = 'PROMO' and quantity between 10 and 20 and site in ('ASIA', 'AFRICA') and d >= date '1998-01-01'",
    "R3": "select site, count(*) as lines from t_sales where (cast(null as varchar(10)) is null or site = cast(null as varchar(10))) and ('PROMO' is null or category = 'PROMO') group by site",
    "R4": f"select maker, {UNITS} from t_sales where maker in ('Brand#1', 'Brand#12', 'Brand#25') group by maker",
    "R5": f"select site, {total('quantity', where('day_no > last_day - 30'))} as units_30d, {total('quantity', where('day_no > last_day - 90'))} as units_90d from t_sales cross join (select max(day_no) as last_day from t_sales) m group by site",
    "R6": f"select item_key, {UNITS}, count(*) as lines from t_sales group by item_key having count(*) >= 20",
    "R7": f"select category, count(*) {where('discount_c = 0')} as undiscounted, {total('quantity', where('discount_c > 0'))} as discounted_units from t_sales group by category",
    "R8": "select site, maker, closing from t_ledger where day_no = (select max(day_no) from t_ledger) and closing > (select avg(closing) from t_ledger where day_no = (select max(day_no) from t_ledger))",
    "R9": f"with per_day as (select site, day_no, {total('quantity')} as units from t_sales group by site, day_no), best as (select site, max(units) as most from per_day group by site) select b.site, b.most, count(*) as days_at_most from best b join per_day p on p.site = b.site and p.units = b.most group by b.site, b.most",
    "R10": "select reason, count(*) as n from (select case when quantity <= 0 then 'quantity' when price_c < 100000 then 'low price' when discount_c * 10 > quantity * price_c then 'discount over tenth' else 'kept' end as reason from t_sales) r group by reason",
}

JOINS = {
    "J1": f"select c.year, b.category, {UNITS} from t_sales s join t_calendar c on c.day_no = s.day_no join (select distinct item_key, category from t_batches) b on b.item_key = s.item_key group by c.year, b.category",
    "J2": f"select a.site_key, a.maker, a.sold, b.bought from (select site_key, maker, {total('quantity')} as sold from t_sales group by site_key, maker) a join (select site_key, maker, {total('quantity')} as bought from t_receipts group by site_key, maker) b on b.site_key = a.site_key and b.maker = a.maker",
    "J3": f"select i.item_key, coalesce(r.bought, 0) as bought from v_item i left join (select item_key, {total('quantity')} as bought from t_receipts group by item_key) r on r.item_key = i.item_key",
    "J4": f"select coalesce(a.batch_id, b.batch_id) as batch_id, coalesce(a.sold, 0) as sold, coalesce(b.bought, 0) as bought from (select batch_id, {total('quantity')} as sold from t_sales group by batch_id) a full outer join (select batch_id, {total('quantity')} as bought from t_receipts group by batch_id) b on b.batch_id = a.batch_id",
    "J5": f"select item_key, a.sold, b.lots from (select item_key, {total('quantity')} as sold from t_sales group by item_key) a join (select item_key, count(*) as lots from t_batches group by item_key) b using (item_key)",
    "J6": "select distinct s.batch_id from t_sales s left join t_batches b on b.batch_id = s.batch_id where b.batch_id is null",
    "J7": "select batch_id, maker, expiry_day_no from t_batches b where exists (select 1 from t_sales s where s.batch_id = b.batch_id)",
    "J8": "select s.site, c.year, count(*) as days from (select distinct site from t_sales) s cross join t_calendar c group by s.site, c.year",
    "J9": f"select x.site, {total('x.quantity')} as units from t_sales x join (select max(day_no) as last_day from t_sales) m on x.day_no between m.last_day - 27 and m.last_day group by x.site",
    "J10": "select a.site, a.batch_id as batch_a, b.batch_id as batch_b from v_expiry a join v_expiry b on b.site = a.site and b.item_key = a.item_key and a.batch_id < b.batch_id and a.days_to_expiry - 30 <= b.days_to_expiry and b.days_to_expiry - 30 <= a.days_to_expiry",
    "J11": f"select e.maker, e.start_day, {total('l.sold')} as units from (select maker, min(day_no) + 100 as start_day from t_ledger group by maker) e join t_ledger l on l.maker = e.maker and l.day_no between e.start_day and e.start_day + 13 group by e.maker, e.start_day",
    "J12": f"""select site_key, item_key, day_no, {total('sold')} as sold, max(available) as available from (
        select site_key, item_key, day_no, sold, {total('got', 'over (partition by site_key, item_key order by day_no range between unbounded preceding and current row)')} as available
        from (select site_key, item_key, day_no, quantity as sold, 0 as got from t_sales union all select site_key, item_key, day_no, 0, quantity from t_receipts) m) x where sold > 0 group by site_key, item_key, day_no""",
    "J13": "select a.maker as left_maker, b.maker as right_maker, count(distinct a.transaction_id) as together from t_sales a join t_sales b on b.transaction_id = a.transaction_id and a.maker < b.maker group by a.maker, b.maker",
    "J14": "select c.day_name, s.site, count(*) as lines from t_sales s join t_calendar c on c.day_no = s.day_no group by c.day_name, s.site",
}

AGGREGATES = {
    "G1": f"select site, {UNITS}, count(*) as lines, min(price_c) as least_c, max(price_c) as most_c, {total('price_c')} / count(*) as mean_c from t_sales group by site",
    "G2": "select site, count(distinct item_key) as items, count(distinct category) as categories, count(distinct transaction_id) as transactions from t_sales group by site",
    "G3": (
        "select family, count(distinct struct(site, maker)) as pairs, count(distinct struct(site, maker)) filter (where closing = 0) as empty_pairs from t_ledger group by family",
        "select family, count(distinct (site, maker)) as pairs, count(distinct (site, maker)) filter (where closing = 0) as empty_pairs from t_ledger group by family",
    ),
    "G4": f"select category, case when count(*) > 1 then sqrt(cast(count(*) * {total('quantity * quantity')} - {total('quantity')} * {total('quantity')} as double) / (count(*) * (count(*) - 1))) end as sd_quantity, {total('quantity')} / count(*) as mean_quantity from t_sales group by category",
    "G5": f"select site, category, maker, grouping_id(site, category, maker) as level, {UNITS} from t_sales group by rollup(site, category, maker)",
    "G6": f"select site, category, grouping_id(site, category) as level, {UNITS} from t_sales group by cube(site, category)",
    "G7": f"select grouping(site) as g_site, grouping(category) as g_category, grouping_id(site, category) as bits, site, category, {UNITS} from t_sales group by rollup(site, category)",
    "G8": (
        f"select * from (select site, category, quantity from t_sales) p pivot (cast(sum(quantity) as bigint) for category in ('ECONOMY' as economy, 'PROMO' as promo, 'STANDARD' as standard))",
        f"select site, {', '.join(f'''{total('quantity', where(f'''category = '{c}' '''))} as {c.lower()}''' for c in ('ECONOMY', 'PROMO', 'STANDARD'))} from t_sales group by site",
    ),
    "G9": (
        "select item_key, min_by(price_c, struct(day_no, transaction_id, price_c)) as first_c, max_by(price_c, struct(day_no, transaction_id, price_c)) as last_c from t_sales group by item_key",
        "select item_key, arg_min(price_c, (day_no, transaction_id, price_c)) as first_c, arg_max(price_c, (day_no, transaction_id, price_c)) as last_c from t_sales group by item_key",
    ),
    "G10": f"select item_key, {total('cost_c * quantity')} / {total('quantity')} as weighted_cost_c from t_receipts group by item_key",
    "G11": f"select site, {total('units')} / count(*) as mean_daily_units, max(units) as best_day from (select site, day_no, {total('quantity')} as units from t_sales group by site, day_no) x group by site",
    "G12": (
        "select category, median(quantity) as median_quantity, percentile(quantity, 0.9) as p90_quantity from t_sales group by category",
        "select category, median(quantity) as median_quantity, quantile_cont(quantity, 0.9) as p90_quantity from t_sales group by category",
    ),
    "G13": (
        "select item_key, min_by(site, struct(day_no, transaction_id, site)) filter (where quantity > 40) as first_large_site from t_sales group by item_key",
        "select item_key, arg_min(site, (day_no, transaction_id, site)) filter (where quantity > 40) as first_large_site from t_sales group by item_key",
    ),
    "G14": f"select transaction_id, item_key, min(d) as d, min(site) as site, {total('quantity')} as quantity, {total('total_c')} as total_c, count(*) as merged from t_sales group by transaction_id, item_key",
    "G15": f"select item_key, supplier_key, min(day_no) as first_receipt, {total('quantity')} as quantity, {total('total_c')} / {total('quantity')} as weighted_cost_c from t_receipts group by item_key, supplier_key",
    "G16": (
        "select site, array_join(transform(array_sort(collect_list(struct(place, category))), x -> x.category), ', ') as top_categories from (select site, category, row_number() over (partition by site order by count(*) desc, category) as place from t_sales group by site, category) r where place <= 3 group by site",
        "select site, string_agg(category, ', ' order by place) as top_categories from (select site, category, row_number() over (partition by site order by count(*) desc, category) as place from t_sales group by site, category) r where place <= 3 group by site",
    ),
}

PAIR = "partition by site_key, maker order by day_no"
WINDOWS = {
    "W1": "select supplier_key, rank() over (order by sum(total_c) desc) as spend_rank from t_receipts group by supplier_key",
    "W2": "select site, item_key, place from (select site, item_key, row_number() over (partition by site order by sum(quantity) desc, item_key) as place from t_sales group by site, item_key) r where place <= 5",
    "W3": "select item_key, percent_rank() over (order by units) as place from v_item",
    "W4": f"select month_start, units, lag(units) over (order by month_start) as before, lag(units, 12) over (order by month_start) as year_before, lag(units, 1, 0) over (order by month_start) as before_or_0 from v_monthly",
    "W5": f"select site, category, {total('quantity')} / {total('sum(quantity)', 'over (partition by site)')} as share_of_site, {total('quantity')} / {total('sum(quantity)', 'over ()')} as share_of_all from t_sales group by site, category",
    "W6": f"select batch_id, coalesce({total('initial_quantity', 'over (partition by item_key order by expiry_day_no, batch_id rows between unbounded preceding and 1 preceding)')}, 0) as units_ahead from t_batches",
    "W7": f"select site, maker, day_no, {total('sold', f'over ({PAIR} rows between unbounded preceding and current row)')} as sold_so_far from t_ledger",
    "W8": "select site, maker, count(*) over () as total_rows from v_stock where stock_status = 'OVERSTOCK'",
    "W9": f"select site, maker, day_no, case when row_number() over ({PAIR}) >= 7 then {total('sold', f'over ({PAIR} rows between 6 preceding and current row)')} end as sold_7d from t_ledger",
    "W10": (
        f"select site, maker, day_no, element_at(s, 14) / 2 + element_at(s, 15) / 2 as median28, element_at(away, 14) / 2 + element_at(away, 15) / 2 as mad28 from (select *, array_sort(transform(s, x -> abs(x - (element_at(s, 14) / 2 + element_at(s, 15) / 2)))) as away from (select site, maker, day_no, array_sort(collect_list(sold) over ({PAIR} rows between 27 preceding and current row)) as s from t_ledger) x where size(s) = 28) y",
        f"select site, maker, day_no, median(seen_x) as median28, any_value(mad28) as mad28 from (select site, maker, day_no, unnest(seen) as seen_x, list_median(list_transform(seen, lambda x: abs(x - list_median(seen)))) as mad28 from (select site, maker, day_no, list(sold) over ({PAIR} rows between 27 preceding and current row) as seen from t_ledger) x where len(seen) = 28) y group by site, maker, day_no",
    ),
    "W11": f"select site, maker, day_no, lag(sold, 7) over ({PAIR}) as lag_7, {total('sold', f'over ({PAIR} rows between 1 following and 7 following)')} as next_7 from t_ledger",
    "W12": f"select site, maker, day_no, row_number() over (partition by site_key, maker, island order by day_no) as run_length from (select *, {total('case when sold > 0 then 1 else 0 end', f'over ({PAIR})')} as island from t_ledger) x where sold = 0",
    "W13": f"select site, maker, day_no, least(day_no - max(case when closing = 0 then day_no end) over ({PAIR}), 365) as days_since_empty from t_ledger",
    "W14": f"select site, maker, episode, min(day_no) as first_day, max(day_no) as last_day, count(*) as days from (select *, {total('fresh', f'over ({PAIR})')} as episode from (select *, case when day_no - lag(day_no) over ({PAIR}) <= 3 then 0 else 1 end as fresh from t_ledger where sold > 0) x) y group by site, maker, episode",
    "W15": (
        "select item_key, lot_no, median_before from (select item_key, lot_no, case when lot_no > 8 then percentile(initial_quantity, 0.5) over (partition by item_key order by lot_no rows between unbounded preceding and 1 preceding) end as median_before from (select *, row_number() over (partition by item_key order by first_day_no, batch_id) as lot_no from t_batches) b) x",
        "select item_key, lot_no, case when lot_no > 8 then quantile_cont(initial_quantity, 0.5) over (partition by item_key order by lot_no rows between unbounded preceding and 1 preceding) end as median_before from (select *, row_number() over (partition by item_key order by first_day_no, batch_id) as lot_no from t_batches) b",
    ),
    "W16": f"select transaction_id, item_key, quantity, {total('quantity', 'over (partition by transaction_id)')} as basket_units, row_number() over (partition by transaction_id order by item_key, batch_id, quantity, total_c) = 1 as is_first from t_sales",
    "W17": "select maker, item_key, revenue_c from (select *, row_number() over (partition by maker order by revenue_c desc, item_key) as place from v_item) r where place = 1",
}

SORTS = {
    "T1": "select site, maker, days_of_inventory, stock_status from v_stock order by case stock_status when 'OUT_OF_STOCK' then 1 else 2 end, days_of_inventory asc nulls last, site, maker limit 40",
    "T2": "select item_key, revenue_c from v_item order by revenue_c desc, item_key limit 10",
    "T3": "select category, item_key, units from (select *, row_number() over (partition by category order by units desc, item_key) as place from v_item) r where place <= 3",
    "T4": "select item_key, units, up, down from (select *, rank() over (order by units, item_key) as up, rank() over (order by units desc, item_key) as down from v_item) r where up <= 10 or down <= 10",
    "T5": "select item_key from v_item order by item_key limit 10 offset 20",
    "T6": "select site, maker, stockout_days from v_stockout order by stockout_days desc, site, maker limit 25",
    "T7": (
        "select i.item_key, i.units from v_item i cross join (select percentile(units, 0.99) as cut from v_item) p where i.units >= p.cut",
        "select i.item_key, i.units from v_item i cross join (select quantile_cont(units, 0.99) as cut from v_item) p where i.units >= p.cut",
    ),
    "U1": "select 'sale' as kind, site, count(*) as lines from t_sales group by site union all select 'receipt', site, count(*) from t_receipts group by site",
    "U2": "select batch_id from t_sales except select batch_id from t_batches",
    "U3": "select item_key from t_sales intersect select item_key from t_receipts",
    "U4": "select item_key, category from t_sales union select item_key, category from t_receipts",
}

SCALARS = {
    "SC1": "select item_key, coalesce(nullif(units, 0), -1) as units, revenue_c / nullif(units - units, 0) as undefined from v_item",
    "SC2": "select item_key, round(units / 7e0, 2) as rounded, abs(units - 100) as distance, sqrt(units) as root, least(units, 50) as low, greatest(units, 50) as high, ceil(units / 7e0) as up, ln(units + 1) as log_units, sqrt(units + 0.375e0) as anscombe, sin(units / 10e0) as s, cos(units / 10e0) as c from v_item",
    "SC3": "select c.d, iso_year, c.day_no - (select min(day_no) from t_calendar) as offset_days, floor((c.day_no - (select min(day_no) from t_calendar)) / 7) as block, cast(date_trunc('month', c.d) as date) as month_start from t_calendar c",
    "SC4": "select distinct maker, lower(maker) as low, trim(concat('  ', maker, ' ')) as trimmed, substr(maker, 1, 5) as part, length(maker) as n, regexp_replace(maker, '[^A-Za-z0-9]', '_') as header, lpad(substr(maker, 7), 4, '0') as padded, replace('1,234', ',', '') as plain from t_sales",
    "SC5": "select distinct maker, try_cast(substr(maker, 7) as int) as number, try_cast(maker as int) as not_a_number, cast(cast(quantity as double) as bigint) as q from t_sales where quantity < 3",
    "SC6": (
        "select site, array_join(array_sort(collect_set(category)), '|') as categories, size(array_intersect(collect_set(category), array('PROMO', 'NONE'))) as n_promo from t_sales group by site",
        "select site, array_to_string(list_sort(list(distinct category)), '|') as categories, len(list_intersect(list(distinct category), ['PROMO', 'NONE'])) as n_promo from t_sales group by site",
    ),
    "SC7": (
        "select site, to_json(map_from_entries(array_sort(collect_list(struct(category, n))))) as counts from (select site, category, count(*) as n from t_sales group by site, category) x group by site",
        "select site, '{' || string_agg('\"' || category || '\":' || n, ',' order by category) || '}' as counts from (select site, category, count(*) as n from t_sales group by site, category) x group by site",
    ),
    "SC8": "select site, maker, concat_ws('; ', case when closing = 0 then 'no stock' end, case when units_30d > 30 then concat('sells ', cast(units_30d as varchar(20)), ' in 30 days') end) as reason from v_stock",
    "SC9": (
        "select category, skewness(quantity) as skew, 1.6448536269514722e0 as z95 from t_sales group by category",
        "select category, (sum(power(quantity - m, 3)) / count(*)) / power(sum(power(quantity - m, 2)) / count(*), 1.5) as skew, 1.6448536269514722e0 as z95 from (select category, quantity, avg(quantity) over (partition by category) as m from t_sales) x group by category",
    ),
}

TEXTS = STAR | QUERYING | PREDICATES | JOINS | AGGREGATES | WINDOWS | SORTS | SCALARS
