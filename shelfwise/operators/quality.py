"""Data-quality and reconciliation checks: rows of (check_name, actual, expected, status).

Constraints that a table can't enforce are counted as violations; totals are computed on two paths and compared.
"""

from __future__ import annotations

from .reports import SALES_DAYS, pct, total, where


def check(name: str, actual: str, expected: str = "0") -> str:
    """One row; actual and expected are scalar subqueries or expressions of integers."""
    return f"select '{name}' as check_name, {actual} as actual, {expected} as expected"


def checked(*rows: str, info: bool = False) -> str:
    body = " union all ".join(rows)
    status = "'INFO'" if info else "case when actual = expected then 'PASS' else 'FAIL' end"
    return f"select check_name, cast(actual as bigint) as actual, cast(expected as bigint) as expected, {status} as status from ({body}) c"


def one(expr: str, source: str, cond: str = "") -> str:
    return f"(select {expr} from {source} {'where ' + cond if cond else ''})"


N = "count(*)"
LAG = "(select l.*, lag(closing) over (partition by site_key, maker order by day_no) as before from t_ledger l)"


def orphans(name: str, child: str, key: str, parent: str, parent_key: str) -> str:
    return check(name, f"(select count(*) from {child} x left join (select distinct {parent_key} as pk from {parent}) p on p.pk = x.{key} where p.pk is null)")


#: Dimensions by their key: distinct members as the batches, lines and calendar have them.
PARENTS = {
    "day_no": "t_calendar", "item_key": "(select item_key from t_sales union select item_key from t_receipts) d1", "site_key": "(select site_key from t_ledger) d2", "batch_id": "t_batches",
    "supplier_key": "(select supplier_key from t_receipts) d3", "category": "(select category from t_sales union select category from t_receipts) d4", "maker": "(select maker from t_sales union select maker from t_receipts) d5",
}
CHILDREN = {
    "sales": "t_sales", "receipts": "t_receipts", "ledger": "t_ledger", "lots": "t_lots", "batches": "t_batches",
    "items": "(select item_key, min(category) as category, min(maker) as maker from (select item_key, category, maker from t_sales union all select item_key, category, maker from t_receipts) i0 group by item_key)",
}
#: (child, key, parent's key): the star's fifteen foreign keys. A sale's batch is an item of a supplier, known or not (see README).
FOREIGN_KEYS = [
    ("sales", "day_no", "day_no"), ("sales", "item_key", "item_key"), ("sales", "site_key", "site_key"), ("sales", "batch_id", "batch_id"), ("receipts", "day_no", "day_no"), ("receipts", "item_key", "item_key"), ("receipts", "site_key", "site_key"),
    ("receipts", "supplier_key", "supplier_key"), ("receipts", "batch_id", "batch_id"), ("ledger", "day_no", "day_no"), ("ledger", "maker", "maker"), ("ledger", "site_key", "site_key"), ("items", "category", "category"),
    ("batches", "item_key", "item_key"), ("batches", "supplier_key", "supplier_key"),
]


def grouped(expr: str, keys: str, source: str) -> str:
    """The total of sums by group: as much as the sum over all rows if groups part the rows."""
    return f"(select sum(v) from (select sum({expr}) as v from {source} group by {keys}) g)"


LAST_DAY = "day_no = (select max(day_no) from t_calendar)"
FIRST_OPENING = "(select sum(opening) from t_ledger where day_no = (select min(day_no) from t_calendar))"
RECEIVED_DAYS = "t_receipts r join t_calendar c on c.day_no = r.day_no"
#: Every layer of analytics against the facts: (name, actual, expected).
TIE_OUTS = [
    ("monthly revenue", one("sum(revenue_c)", "v_monthly"), one("sum(total_c)", "t_sales")), ("monthly units", one("sum(units)", "v_monthly"), one("sum(quantity)", "t_sales")),
    ("monthly transactions", one("sum(transactions)", "v_monthly"), one("count(distinct transaction_id)", "t_sales")), ("monthly lines", one("sum(sales_lines)", "v_monthly"), one(N, "t_sales")),
    ("monthly discount", one("sum(discount_c)", "v_monthly"), one("sum(discount_c)", "t_sales")), ("yearly revenue", grouped("total_c", "c.year", SALES_DAYS), one("sum(revenue_c)", "v_monthly")),
    ("ISO-weekly revenue", grouped("total_c", "c.iso_year, c.iso_week", SALES_DAYS), one("sum(total_c)", "t_sales")), ("item revenue", one("sum(revenue_c)", "v_item"), one("sum(total_c)", "t_sales")),
    ("item units", one("sum(units)", "v_item"), one("sum(quantity)", "t_sales")), ("category revenue", grouped("revenue_c", "category", "v_item"), one("sum(total_c)", "t_sales")),
    ("site revenue", one("sum(revenue_c)", "v_site"), one("sum(total_c)", "t_sales")), ("site units", one("sum(units)", "v_site"), one("sum(quantity)", "t_sales")),
    ("site transactions", one("sum(transactions)", "v_site"), one("count(distinct transaction_id)", "t_sales")), ("site revenue shares in millionths", one("round(sum(revenue_share_pct) * 10000)", "v_site"), "1000000"),
    ("mover classes cover items", one(N, "v_item", "mover_class in ('FAST', 'MEDIUM', 'SLOW')"), one("count(distinct item_key)", "t_sales")),
    ("stock units on the last day", one("sum(closing)", "v_stock"), one("sum(closing)", "t_ledger", LAST_DAY)), ("stock value on the last day", one("sum(value_c)", "v_stock"), one("sum(value_c)", "t_ledger", LAST_DAY)),
    ("stock identity", one("sum(closing)", "v_stock"), f"{FIRST_OPENING} + (select sum(quantity) from t_receipts) - (select sum(quantity) from t_sales) - (select sum(expired) from t_ledger)"),
    ("status covers pairs", one(N, "v_stock", "stock_status in ('OUT_OF_STOCK', 'LOW_STOCK', 'NORMAL', 'OVERSTOCK', 'NO_DEMAND')"), "(select count(*) from (select distinct site_key, maker from t_ledger) p)"),
    ("month-end units of the last month", one("sum(closing)", "t_ledger", "day_no = (select max(day_no) from t_calendar where year = (select max(year) from t_calendar))"), one("sum(closing)", "v_stock")),
    # of lots that weren't sold beyond what came in: cost of what came in = cost of what went out + cost of what is left
    ("cost identity of whole lots", one("sum(sold * cost_c)", "t_lots", "sold <= received"), "(select sum(received * cost_c) from t_lots where sold <= received) - (select sum(remaining * cost_c) from t_lots where sold <= received)"),
    ("stockout days", one("sum(stockout_days)", "v_stockout"), one(N, "t_ledger", "closing = 0")), ("stockout days by site", grouped("stockout_days", "site", "v_stockout"), one(N, "t_ledger", "closing = 0")),
    ("stockout days by family", grouped("stockout_days", "family", "v_stockout"), one(N, "t_ledger", "closing = 0")), ("empty pairs on the last day", one(N, "v_stock", "stock_status = 'OUT_OF_STOCK'"), one(N, "t_ledger", f"closing = 0 and {LAST_DAY}")),
    ("expired units", "(select sum(remaining) from v_expiry where expiry_day_no <= (select max(day_no) from t_calendar))", one("sum(expired)", "t_ledger")), ("units of all lots", one("sum(remaining)", "v_expiry"), one("sum(remaining)", "t_lots")),
    ("value of all lots", one("sum(value_c)", "v_expiry"), one("sum(remaining * cost_c)", "t_lots")), ("risk classes cover lots", one(N, "v_expiry", "risk_class in ('EXPIRED', 'CRITICAL', 'HIGH', 'MEDIUM', 'SAFE')"), one(N, "v_expiry")),
    ("unsold over remaining", one(N, "v_expiry", "unsold_90 > 90 * remaining or unsold_90 < 0"), "0"), ("supplier cost", grouped("total_c", "supplier_key", "t_receipts"), one("sum(total_c)", "t_receipts")),
    ("category cost", grouped("total_c", "category", "t_receipts"), one("sum(total_c)", "t_receipts")), ("monthly cost", grouped("total_c", "c.year, c.month", RECEIVED_DAYS), one("sum(total_c)", "t_receipts")),
    ("demand units", one("sum(units)", "v_demand"), one("sum(quantity)", "t_sales")), ("demand days of a pair", one(N, "v_demand", "n_days <> (select count(*) from t_calendar)"), "0"),
    ("variability covers pairs", one(N, "v_demand", "variability in ('STABLE', 'MODERATELY VARIABLE', 'HIGHLY VARIABLE', 'NO DEMAND')"), one(N, "v_demand")),
    ("category-month units", grouped("quantity", "s.category, c.month", SALES_DAYS), one("sum(quantity)", "t_sales")), ("weekday and weekend revenue", grouped("total_c", "c.is_weekend", SALES_DAYS), one("sum(total_c)", "t_sales")),
]


CHECKS = {
    "C1": checked(
        check("sales_rows", one(N, "t_sales"), "null"), check("sales_quantity", one("sum(quantity)", "t_sales"), "null"), check("sales_revenue_c", one("sum(total_c)", "t_sales"), "null"),
        check("purchase_cost_c", one("sum(total_c)", "t_receipts"), "null"), check("closing_stock", one("sum(closing)", "t_ledger", "day_no = (select max(day_no) from t_calendar)"), "null"), info=True,
    ),
    "C2": checked(check("row_equation", one(N, "t_ledger", "opening + purchased - sold - expired <> closing"))),
    "C3": checked(check("continuity", f"(select count(*) from {LAG} x where before is not null and before <> opening)")),
    "C4": checked(
        check("negative_stock", one(N, "t_ledger", "closing < 0 or opening < 0")),
        # no sale is meant to come on or after its batch's expiry day, whatever the tables hold
        check("sold_after_expiry", "(select count(*) from t_sales s join t_batches b on b.batch_id = s.batch_id where s.day_no >= b.expiry_day_no)"),
        check("received_after_expiry", "(select count(*) from t_receipts r join t_batches b on b.batch_id = r.batch_id where r.day_no >= b.expiry_day_no)"),
    ),
    "C5": checked(*(orphans(f"{child}.{key}", CHILDREN[child], key, PARENTS[parent], parent) for child, key, parent in FOREIGN_KEYS)),
    "C6": checked(
        check("batch_key", one("count(*) - count(distinct batch_id)", "t_batches")), check("calendar_key", one("count(*) - count(distinct date_key)", "t_calendar")),
        check("ledger_grain", "(select count(*) from (select 1 as x from t_ledger group by day_no, site_key, maker having count(*) > 1) d)"),
    ),
    "C7": checked(
        check("calendar_gaps", one("max(day_no) - min(day_no) + 1 - count(*)", "t_calendar")), check("first_day", one("min(day_no)", "t_calendar"), "(select least((select min(day_no) from t_sales), (select min(day_no) from t_receipts)))"),
        check("last_day", one("max(day_no)", "t_calendar"), "(select greatest((select max(day_no) from t_sales), (select max(day_no) from t_receipts)))"),
    ),
    "C8": checked(
        check("sites", one("count(distinct site_key)", "t_ledger"), one("count(distinct site_key)", "(select site_key from t_sales union all select site_key from t_receipts) a")),
        check("makers", one("count(distinct maker)", "t_ledger"), one("count(distinct maker)", "(select maker from t_sales union all select maker from t_receipts) a")),
        check("suppliers", one("count(distinct supplier_key)", "t_batches"), one("count(distinct supplier_key)", "t_receipts")),
    ),
    "C9": checked(
        check("batch_item", "(select count(*) from t_receipts r join t_batches b on b.batch_id = r.batch_id where r.item_key is distinct from b.item_key)"),
        check("batch_supplier", "(select count(*) from t_receipts r join t_batches b on b.batch_id = r.batch_id where r.supplier_key is distinct from b.supplier_key)"),
        check("batch_price", "(select count(*) from t_receipts r join t_batches b on b.batch_id = r.batch_id where r.cost_c is distinct from b.cost_c)"),
        check("initial_quantity", one("sum(initial_quantity)", "t_batches"), one("sum(quantity)", "t_receipts")),
    ),
    "C10": checked(
        check("sold_total", one("sum(sold)", "t_ledger"), one("sum(quantity)", "t_sales")), check("purchased_total", one("sum(purchased)", "t_ledger"), one("sum(quantity)", "t_receipts")),
        check("sold_cells", f"""(select count(*) from (select site_key, maker, day_no, {total('quantity')} as units from t_sales group by site_key, maker, day_no) s
          left join (select * from t_ledger) l on l.site_key = s.site_key and l.maker = s.maker and l.day_no = s.day_no where l.sold is distinct from s.units)"""),
    ),
    "C11": checked(check("density", one(N, "t_ledger"), "(select count(*) from t_calendar) * (select count(*) from (select distinct site_key, maker from t_ledger) p)")),
    "C11_infos": checked(check("stockout_rows", one(N, "t_ledger", "closing = 0"), "null"), check("expired_rows", one(N, "t_ledger", "expired > 0"), "null"), check("expired_units", one("sum(expired)", "t_ledger"), "null"), info=True),
    "C12": checked(*(check(*t) for t in TIE_OUTS)),
    "C13": checked(
        check("units_sold", one("sum(quantity)", "t_sales"), one("sum(sold)", "t_ledger")), check("units_received", one("sum(quantity)", "t_receipts"), one("sum(purchased)", "t_ledger")),
        check("net_plus_discount", one("sum(total_c + discount_c)", "t_sales"), one("sum(quantity * price_c)", "t_sales")),
        check("closing_identity", one("sum(closing)", "t_ledger", "day_no = (select max(day_no) from t_calendar)"), "(select sum(opening) from t_ledger where day_no = (select min(day_no) from t_calendar)) + (select sum(purchased - sold - expired) from t_ledger)"),
    ),
    "C14": checked(
        check("positive_quantity", one(N, "t_sales", "quantity <= 0")), check("positive_price", one(N, "t_sales", "price_c <= 0")), check("discount_range", one(N, "t_sales", "discount_c < 0 or discount_c > quantity * price_c")),
        check("line_arithmetic", one(N, "t_sales", "total_c <> quantity * price_c - discount_c")), check("shelf_life", one(N, "t_batches", "expiry_day_no <= first_day_no")),
        check("one_day_per_transaction", "(select count(*) from (select transaction_id from t_sales group by transaction_id having count(distinct day_no) > 1) x)"),
        check("one_site_per_transaction", "(select count(*) from (select transaction_id from t_sales group by transaction_id having count(distinct site_key) > 1) x)"),
    ),
    "C15": f"""select site, count(*) as batches, count(*) {where('lowest < 0')} as overdrawn, cast(min(lowest) as bigint) as lowest from (
        select site, batch_id, min(running) as lowest from (
          select site, batch_id, {total('q', 'over (partition by site, batch_id order by day_no, kind rows between unbounded preceding and current row)')} as running
          from (select site, batch_id, day_no, 0 as kind, {total('quantity')} as q from t_receipts group by site, batch_id, day_no union all select site, batch_id, day_no, 1 as kind, -{total('quantity')} as q from t_sales group by site, batch_id, day_no) m) r
        group by site, batch_id) b group by site""",
    "C16": checked(
        check("rows", one(N, "t_sales"), one("sum(sales_lines)", "v_monthly")), check("units", one("sum(units)", "v_monthly"), one("sum(quantity)", "t_sales")),
        check("stock_identity", one("sum(opening + purchased - sold - expired)", "t_ledger"), one("sum(closing)", "t_ledger")),
    ),
    "C17": f"""select year, month, count(*) as lines, count(distinct transaction_id) as transactions, {total('quantity')} as units, median(quantity) as median_quantity, {total('quantity')} / count(*) as mean_quantity from {SALES_DAYS} group by year, month""",
    "C18": f"""select site, maker, count(*) {where('closing = 0')} as zero_days, {total('onset')} as zero_runs, count(*) {where('seen >= 7 and mean30 is not null')} as judged_days, count(*) {where('seen >= 7 and closing < 3 * mean30')} as low_days
      from (select l.*, case when closing = 0 and coalesce(lag(closing) over (partition by site_key, maker order by day_no), 1) > 0 then 1 else 0 end as onset,
        count(*) over (partition by site_key, maker order by day_no rows between 30 preceding and 1 preceding) as seen, avg(sold) over (partition by site_key, maker order by day_no rows between 30 preceding and 1 preceding) as mean30 from t_ledger l) x group by site, maker""",
    "C19": f"""select category, site, count(*) as lots, {total('remaining', where('days_to_expiry <= 0'))} as expired_units, {total('remaining', where('days_to_expiry between 1 and 180'))} as units_180d, {total('value_c', where('days_to_expiry between 1 and 180'))} as value_180d_c from v_expiry group by category, site""",
    "C20": f"""select count(*) as items, {total('(2 * up - n - 1) * units')} / (max(n) * {total('units')}) as gini, {pct(total('units', where('down * 10 <= n')), total('units'))} as top_10_pct_share, {pct(total('units', where('down * 5 <= n')), total('units'))} as top_20_pct_share,
        {pct(total('units', where('up * 2 <= n')), total('units'))} as bottom_50_pct_share, max(units) / min(units) as max_min_ratio, median(units) as median_units
      from (select units, row_number() over (order by units, item_key) as up, row_number() over (order by units desc, item_key) as down, count(*) over () as n from v_item) r""",
    "C21": f"""select abc_class, count(*) as items, {total('revenue_c')} as revenue_c from (select revenue_c, case when before * 100 < 70 * all_c then 'A' when before * 100 < 90 * all_c then 'B' else 'C' end as abc_class
        from (select revenue_c, coalesce({total('revenue_c', 'over (order by revenue_c desc, item_key rows between unbounded preceding and 1 preceding)')}, 0) as before, {total('revenue_c', 'over ()')} as all_c from v_item) x) y group by abc_class""",
    "C22": f"""select category, month, rate / nullif(mean_rate, 0) as seasonality, case when place = 1 then true else false end as is_peak from (select *, total_rate / n as mean_rate, row_number() over (partition by category order by rate desc, month) as place
        from (select *, count(*) over (partition by category) as n, sum(rate) over (partition by category order by month rows between unbounded preceding and unbounded following) as total_rate
          from (select category, month, {total('quantity')} / count(distinct c.day_no) as rate from {SALES_DAYS} group by category, month) r) s) t""",
    "C23": f"""select site, category, share / nullif(total_share / n, 0) as mix_index from (select *, sum(share) over (partition by category order by site rows between unbounded preceding and unbounded following) as total_share, count(*) over (partition by category) as n
        from (select site, category, {total('total_c')} / {total('sum(total_c)', 'over (partition by site)')} as share from t_sales group by site, category) s) t""",
    "C24": f"""select a.item as left_item, b.item as right_item, count(*) as together, count(*) / max(n.n) as support, count(*) / max(a.c) as confidence_ab, count(*) / max(b.c) as confidence_ba, count(*) * max(n.n) / (max(a.c) * max(b.c)) as lift,
        (max(b.c) - count(*)) / nullif(max(n.n) - max(a.c), 0) as p_b_without_a
      from (select t.*, count(*) over (partition by item) as c from (select distinct transaction_id, maker as item from t_sales) t) a
      join (select t.*, count(*) over (partition by item) as c from (select distinct transaction_id, maker as item from t_sales) t) b on b.transaction_id = a.transaction_id and a.item < b.item
      cross join (select count(distinct transaction_id) as n from t_sales) n group by a.item, b.item having count(*) >= greatest(60, 0.0008 * max(n.n))""",
    "C25": f"""select family, start_day, {total('case when inside then 1 else 0 end')} as window_days, {total('case when inside then sold else 0 end')} / nullif({total('case when inside then 1 else 0 end')}, 0) as window_mean,
      {total('case when inside then 0 else sold end')} / nullif({total('case when inside then 0 else 1 end')}, 0) as baseline_mean
    from (select e.family, e.start_day, d.sold, d.day_no between e.start_day and e.start_day + 6 as inside
      from (select family, min(day_no) as start_day from (select family, day_no, {total('sold')} as day_sold from t_ledger group by family, day_no) f where day_sold > 100 group by family) e
      join (select family, day_no, {total('sold')} as sold from t_ledger group by family, day_no) d on d.family = e.family and d.day_no between e.start_day - 45 and e.start_day + 51) w
    group by family, start_day""",
}
