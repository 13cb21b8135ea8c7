"""Cleaning of uploaded sales and purchase files: header mapping, typed parsing with counted reasons, merging, capabilities."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import stored
from .dimensions import with_key
from .reports import total, where

#: Header synonyms of the canonical columns of a sales file and of a purchase file.
SYNONYMS = {
    "transaction_date": ("date", "sale date", "bill date", "transaction date"), "item_id": ("item code", "item", "sku", "product id"), "quantity": ("qty", "quantity", "units"),
    "unit_price": ("price", "rate", "unit price", "unit selling price"), "transaction_id": ("bill no", "invoice", "transaction id", "receipt no"), "site_id": ("store", "branch", "site", "branch id"), "discount": ("discount", "disc"),
    "item_name": ("item name", "product name", "description"), "category": ("category", "group", "department"),
}
PURCHASE_SYNONYMS = {
    "received_on": ("received", "date", "purchase date", "grn date"), "item_id": ("item code", "item", "sku", "product id"), "quantity": ("qty", "quantity", "units"),
    "unit_cost": ("cost", "rate", "purchase price", "unit purchase price"), "batch_id": ("batch", "batch no", "lot", "lot no"), "expires_on": ("expiry", "expiry date", "best before"), "site_id": ("store", "branch", "site", "branch id"),
    "supplier": ("supplier", "vendor", "supplier name"),
}
REQUIRED = ("transaction_date", "item_id", "quantity", "unit_price")
PURCHASE_REQUIRED = ("received_on", "item_id", "quantity", "unit_cost")
#: Shares of unreadable dates and expiry dates from which on a file is refused, longest code, days that forecasts need, and what
#: stands for a missing site, category, supplier and expiry date.
BAD_DATES, BAD_EXPIRY, LONGEST_ID, FORECAST_DAYS = 0.05, 0.5, 40, 90
MAIN_SITE, NO_CATEGORY, NO_SUPPLIER, NEVER = "MAIN", "Uncategorised", "Unknown supplier", "9999-12-31"
LEAST_ROWS = 100


class UploadError(ValueError):
    """A file that can't be used, with all problems found."""

    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


class CleanSales(NamedTuple):
    """Lines merged by transaction and item, counts by reason, master data of the items, and what the file is good for."""

    sales: DataFrame
    reasons: DataFrame
    items: DataFrame
    report: dict


class CleanPurchases(NamedTuple):
    """Receipts, lots (one a batch), suppliers with codes, counts by reason."""

    receipts: DataFrame
    lots: DataFrame
    suppliers: DataFrame
    reasons: DataFrame


def suggest_mapping(headers: list[str], synonyms: dict[str, tuple[str, ...]] = SYNONYMS) -> dict[str, str]:
    """Canonical column -> header; every header serves once, in the order of the synonyms."""
    plain = {h: re.sub(r"[^a-z0-9]+", " ", h.lower()).strip() for h in headers}
    out: dict[str, str] = {}
    for column, names in synonyms.items():
        for wanted in (column.replace("_", " "), *names):
            hit = next((h for h in headers if plain[h] == wanted and h not in out.values()), None)
            if hit is not None:
                out[column] = hit
                break
    return out


def _mapped(raw: DataFrame, mapping: dict[str, str], synonyms: dict, required: tuple[str, ...]) -> dict[str, Column]:
    """Trimmed text of each canonical column (null where empty or unmapped); a mapping that doesn't fit the file is an error."""
    problems = [f"no column for {c}" for c in required if c not in mapping]
    problems += [f"{c}: no column {h!r}" for c, h in mapping.items() if c not in synonyms or h not in raw.columns]
    if len(set(mapping.values())) < len(mapping):
        problems.append("a column of the file serves twice")
    if problems:
        raise UploadError(problems)
    return {c: F.nullif(F.trim(F.col(f"`{mapping[c]}`")), F.lit("")) if c in mapping else F.lit(None).cast("string") for c in synonyms}


def _number(c: Column) -> Column:
    return F.regexp_replace(c, ",", "").try_cast("decimal(18,6)")


def _cents(c: Column) -> Column:
    return F.round(_number(c) * 100).cast("long")


def _id(prefix: str, columns: list[str]) -> Column:
    """An id by content: the same in every run and on every cluster. Rows that are equal in all columns are told apart by _copy."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return F.concat(F.lit(prefix), F.substring(F.md5(text), 1, 16), F.lit("-"), F.col("_copy").cast("string"))


def _with_copies(df: DataFrame) -> DataFrame:
    """df with _copy, 1..n among rows that are equal in all columns; equal rows are counted before they are shuffled."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).select(*df.columns, F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_copy"))


def _counted(judged: DataFrame) -> DataFrame:
    return judged.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def clean_sales(raw: DataFrame, mapping: dict[str, str], least_rows: int = LEAST_ROWS) -> CleanSales:
    """Typed sales without the rows that have a reason to go, one line for each transaction and item.

    raw holds text. Reasons, the first counts: no item, no date, no number, bad quantity, bad price, no transaction; then lines whose
    price rounds to nothing and lines merged into others. More than 5 % unreadable dates, codes of over 40 characters, too few rows
    or an unusable mapping are an UploadError. The unit price is taken again from the merged line in whole cents, a discount is at
    least 0 and at most the line's value, and the total follows from both. Without a site column all is one site. If half of the rows
    or more have no transaction id, every line is its own transaction and there are no baskets.
    """
    text = _mapped(raw, mapping, SYNONYMS, REQUIRED)
    typed = raw.select(
        F.try_to_date(text["transaction_date"], "yyyy-MM-dd").alias("d"), text["item_id"].alias("item_id"), _number(text["quantity"]).alias("amount"), _cents(text["unit_price"]).alias("price_c"),
        text["transaction_id"].alias("transaction_id"), text["site_id"].alias("site_id"), F.coalesce(_cents(text["discount"]), F.lit(0)).alias("discount_c"), text["item_name"].alias("item_name"), text["category"].alias("category"),
    ).withColumn("quantity", F.round("amount").cast("long"))
    typed = stored(typed, "upload")  # parsed once
    # one row about the whole file
    seen = typed.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("d").isNull() & F.col("item_id").isNotNull()).alias("bad_dates"), F.count("item_id").alias("with_item"), F.count("transaction_id").alias("with_transaction"),
        F.count("site_id").alias("with_site"), *(F.coalesce(F.max(F.length(c)), F.lit(0)).alias(f"longest_{c}") for c in ("item_id", "transaction_id", "site_id")),
    ).first()
    problems = [f"{c} has codes of over {LONGEST_ID} characters" for c in ("item_id", "transaction_id", "site_id") if seen[f"longest_{c}"] > LONGEST_ID]
    if seen["bad_dates"] > BAD_DATES * seen["with_item"]:
        problems.append(f"{seen['bad_dates']} of {seen['with_item']} dates can't be read, dates are written 2025-03-31")
    if seen["n"] < least_rows:
        problems.append(f"{seen['n']} rows, at least {least_rows} are needed")
    if problems:
        raise UploadError(problems)
    baskets = 2 * seen["with_transaction"] > seen["n"]
    bad = (
        F.when(F.col("item_id").isNull(), "no item").when(F.col("d").isNull(), "no date").when(F.col("amount").isNull() | F.col("price_c").isNull(), "no number")
        .when(F.col("quantity") <= 0, "bad quantity").when(F.col("price_c") <= 0, "bad price")
    )
    if baskets:
        bad = bad.when(F.col("transaction_id").isNull(), "no transaction")
    judged = typed.withColumn("reason", F.coalesce(bad, F.lit("kept")))
    kept = judged.where("reason = 'kept'").drop("reason", "amount").withColumns({"discount_c": F.greatest("discount_c", F.lit(0)), "site_id": F.coalesce("site_id", F.lit(MAIN_SITE))})
    lines = kept if baskets else _with_copies(kept).withColumn("transaction_id", _id("T-", ["d", "site_id", "item_id", "quantity", "price_c", "discount_c"]))
    merged = lines.groupBy("transaction_id", "item_id").agg(
        F.min("d").alias("d"), F.min("site_id").alias("site_id"), F.sum("quantity").alias("quantity"), F.sum(F.col("quantity") * F.col("price_c")).alias("gross_c"), F.sum("discount_c").alias("asked_c"), F.count(F.lit(1)).alias("merged"),
    ).withColumn("price_c", F.bround(F.col("gross_c") / F.col("quantity")).cast("long"))
    merged = stored(merged, "upload-lines")
    discount = F.least("asked_c", F.col("quantity") * F.col("price_c"))
    sales = merged.where("price_c > 0").select("transaction_id", "item_id", "d", "site_id", "quantity", "price_c", discount.alias("discount_c"), (F.col("quantity") * F.col("price_c") - discount).alias("total_c"), "merged")
    later = merged.agg(F.coalesce(F.sum(F.col("merged") - 1), F.lit(0)).alias("merged into one"), F.count_if(F.col("price_c") <= 0).alias("price rounds to zero"))
    later = later.select(F.explode(F.array(*(F.struct(F.lit(c).alias("reason"), F.col(f"`{c}`").alias("n")) for c in later.columns))).alias("r")).select("r.reason", "r.n").where("n > 0")
    # names and categories are the least ones that a row of the item has
    items = kept.groupBy("item_id").agg(F.min("item_name").alias("item_name"), F.min("category").alias("category"))
    items = items.select("item_id", F.substring(F.coalesce("item_name", "item_id"), 1, 120).alias("item_name"), F.substring(F.coalesce("category", F.lit(NO_CATEGORY)), 1, 60).alias("category"))
    whole = sales.agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.count(F.lit(1)).alias("rows_loaded"), F.countDistinct("item_id").alias("items"), F.countDistinct("site_id").alias("sites"), F.sum("quantity").alias("units"), F.sum("total_c").alias("revenue_c")).first()
    days = (whole["last_day"] - whole["first_day"]).days + 1 if whole["rows_loaded"] else 0
    if days < 2:
        raise UploadError(["the usable sales are of fewer than two days"])
    able = {"sales_analytics": True, "association_rules": baskets, "multi_site": bool(seen["with_site"]) and whole["sites"] > 1, "forecasting": days >= FORECAST_DAYS, "stock_decisions": False}
    return CleanSales(sales, _counted(judged).unionByName(later), items, {"rows_uploaded": seen["n"], **whole.asDict(), "days": days, "mapping": mapping, "capabilities": able})


def clean_purchases(raw: DataFrame, mapping: dict[str, str], sales: DataFrame) -> CleanPurchases:
    """Typed receipts on the calendar of the sales (columns d, site_id), their lots and suppliers.

    raw holds text. Reasons, the first counts: no item, no date, no number, bad quantity, bad cost, after the last sale, expired when
    received. Receipts from before the first sale count as of its day. A missing or unreadable expiry date is never. More than 5 %
    unreadable dates, more than half unreadable expiry dates, codes of over 40 characters, an unusable mapping, no usable row or sales
    of several sites without a site column are an UploadError. A batch id of several items gets the item behind it; without one, each
    receipt is its own lot. A lot has its earliest expiry date, first day, units and mean cost (in whole cents, at least 1).
    """
    text = _mapped(raw, mapping, PURCHASE_SYNONYMS, PURCHASE_REQUIRED)
    # one row, and at most two sites: whether there are several is all that matters
    span = sales.agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"))
    few = [r[0] for r in sales.select("site_id").distinct().limit(2).collect()]
    if "site_id" not in mapping and len(few) > 1:
        raise UploadError(["the sales are of several sites, so purchases need a site column"])
    home = MAIN_SITE if "site_id" in mapping or not few else few[0]
    typed = raw.select(
        F.try_to_date(text["received_on"], "yyyy-MM-dd").alias("received"), text["item_id"].alias("item_id"), _number(text["quantity"]).alias("amount"), _cents(text["unit_cost"]).alias("cost_c"), text["batch_id"].alias("batch_id"),
        F.try_to_date(text["expires_on"], "yyyy-MM-dd").alias("expires"), F.coalesce(text["site_id"], F.lit(home)).alias("site_id"), F.substring(F.coalesce(text["supplier"], F.lit(NO_SUPPLIER)), 1, 120).alias("supplier"),
    ).withColumn("quantity", F.round("amount").cast("long"))
    late = F.col("received") > F.col("last_day")
    typed = stored(typed, "upload-receipts")
    bad = (
        F.when(F.col("item_id").isNull(), "no item").when(F.col("received").isNull(), "no date").when(F.col("amount").isNull() | F.col("cost_c").isNull(), "no number").when(F.col("quantity") <= 0, "bad quantity")
        .when(F.col("cost_c") <= 0, "bad cost").when(late, "after the last sale").when(F.col("expires") <= F.greatest("received", "first_day"), "expired when received")
    )
    judged = typed.crossJoin(F.broadcast(span)).withColumn("reason", F.coalesce(bad, F.lit("kept")))
    # the share of unreadable expiry dates is taken over the rows that have no other fault
    fit = F.col("reason").isin("kept", "expired when received")
    seen = judged.agg(
        F.count("item_id").alias("with_item"), F.count_if(F.col("received").isNull() & F.col("item_id").isNotNull()).alias("bad_dates"), F.count_if(fit).alias("fit"), F.count_if(fit & F.col("expires").isNull()).alias("bad_expiry"),
        F.count_if(F.col("reason") == "kept").alias("kept"), *(F.coalesce(F.max(F.length(c)), F.lit(0)).alias(f"longest_{c}") for c in ("item_id", "batch_id", "site_id")),
    ).first()
    problems = [f"{c} has codes of over {LONGEST_ID} characters" for c in ("item_id", "batch_id", "site_id") if seen[f"longest_{c}"] > LONGEST_ID]
    if seen["bad_dates"] > BAD_DATES * seen["with_item"]:
        problems.append(f"{seen['bad_dates']} of {seen['with_item']} dates can't be read, dates are written 2025-03-31")
    if "expires_on" in mapping and seen["bad_expiry"] > BAD_EXPIRY * seen["fit"]:
        problems.append(f"{seen['bad_expiry']} of {seen['fit']} expiry dates can't be read")
    if not seen["kept"]:
        problems.append("no usable row")
    if problems:
        raise UploadError(problems)
    kept = judged.where("reason = 'kept'").select(
        F.greatest("received", "first_day").alias("d"), "site_id", "item_id", "batch_id", "supplier", "quantity", "cost_c", F.coalesce("expires", F.to_date(F.lit(NEVER))).alias("expires"),
    )
    shared = kept.where("batch_id is not null").groupBy("batch_id").agg(F.min("item_id").alias("a"), F.max("item_id").alias("b")).where("a <> b").select("batch_id", F.lit(True).alias("_shared"))
    numbered = _with_copies(kept).withColumn("purchase_id", _id("P-", kept.columns)).join(shared, "batch_id", "left")
    batch = F.when(F.col("batch_id").isNull(), F.concat(F.lit("L-"), "purchase_id")).when(F.col("_shared"), F.concat("batch_id", F.lit("-"), "item_id")).otherwise(F.col("batch_id"))
    receipts = stored(numbered.select("purchase_id", "d", "site_id", "supplier", "item_id", batch.alias("batch_id"), "quantity", "cost_c", (F.col("quantity") * F.col("cost_c")).alias("total_c"), "expires"), "receipts")
    suppliers = with_key(receipts.select("supplier").distinct(), "supplier", "supplier_no").select(F.concat(F.lit("SUP"), F.lpad(F.col("supplier_no").cast("string"), F.greatest(F.lit(4), F.length(F.col("supplier_no").cast("string"))), F.lit("0"))).alias("supplier_id"), "supplier")
    lots = receipts.groupBy("batch_id").agg(
        F.min("item_id").alias("item_id"), F.min("supplier").alias("supplier"), F.min("d").alias("first_day"), F.min("expires").alias("expires"), F.sum("quantity").alias("quantity"),
        F.greatest(F.bround(F.sum("total_c") / F.sum("quantity")).cast("long"), F.lit(1)).alias("cost_c"), (F.min("expires") < F.max("expires")).alias("differing_expiry"),
    )
    return CleanPurchases(receipts, lots, suppliers, _counted(judged))


def raw_lines(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Sale lines as an upload would bring them: text under other headers, a few fields unusable by a rule on the line's numbers."""
    k = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 100
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    item = F.col("l_partkey").cast("string")
    return lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").cast("string").alias("Bill No"), F.when(k == 1, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("Bill Date"), F.when(k == 2, " ").otherwise(item).alias("Item Code"),
        F.when(k == 3, "0").otherwise(F.col("l_quantity").cast("long").cast("string")).alias("Qty"), F.when(k == 4, "n/a").otherwise(F.concat(F.floor(cents / 5000).cast("string"), F.lit(".50"))).alias("Rate"),
        F.when(k < 50, F.lit(None)).otherwise("1.25").alias("Disc"), F.when(F.col("l_partkey") % 2 == 1, F.concat(F.lit("Item "), item)).otherwise("").alias("Item Name"),
    )


def raw_receipts(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Receipts as an upload would bring them: fulfilled lines as text, batch ids by supplier, a few fields unusable or missing."""
    k = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 100
    item, supplier = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    return lineitem.where("l_linestatus = 'F'").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.when(k == 1, "later").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("GRN Date"), F.when(k == 2, "").otherwise(item).alias("Item Code"),
        F.when(k == 3, "-1").otherwise(F.col("l_quantity").cast("long").cast("string")).alias("Qty"), F.when(k == 4, "free").when(k == 5, "0").otherwise(F.concat((10 + F.col("l_suppkey") % 20).cast("string"), F.lit(".25"))).alias("Cost"),
        F.when(k < 20, "").when(k < 60, F.concat(F.lit("S"), supplier, F.lit("/"), (F.col("l_partkey") % 50).cast("string"))).otherwise(F.concat(item, F.lit("/"), supplier)).alias("Batch No"),
        F.when(k % 10 == 7, "").otherwise(F.date_format(F.date_add("o_orderdate", (F.col("l_orderkey") % 400 + 60).cast("int")), "yyyy-MM-dd")).alias("Expiry"), F.when(k % 10 == 8, " ").otherwise(F.concat(F.lit("Supplier "), supplier)).alias("Vendor"),
    )


_RAW = """(select *, (l_orderkey * 7 + l_linenumber) % 100 as k, cast(floor(cast(round(l_extendedprice * 100) as bigint) / 5000) as bigint) * 100 + 50 as p_c from lineitem join orders on o_orderkey = l_orderkey)"""
_JUDGED = f"""(select cast(l_orderkey as varchar) as transaction_id, cast(l_partkey as varchar) as item_id, l_partkey % 2 = 1 as named, cast(o_orderdate as date) as d, cast(l_quantity as bigint) as quantity, p_c as price_c, case when k < 50 then 0 else 125 end as discount_c,
  case k when 1 then 'no date' when 2 then 'no item' when 3 then 'bad quantity' when 4 then 'no number' else 'kept' end as reason from {_RAW} r)"""
_MERGED = f"(select transaction_id, item_id, min(d) as d, {total('quantity')} as quantity, cast(round_even({total('quantity * price_c')} / {total('quantity')}, 0) as bigint) as price_c, {total('discount_c')} as asked_c, count(*) as merged from {_JUDGED} j where reason = 'kept' group by transaction_id, item_id)"
CLEAN_SQL = f"select transaction_id, item_id, d, '{MAIN_SITE}' as site_id, quantity, price_c, least(asked_c, quantity * price_c) as discount_c, quantity * price_c - least(asked_c, quantity * price_c) as total_c, merged from {_MERGED} m where price_c > 0"
REASONS_SQL = f"""select reason, n from (select reason, count(*) as n from {_JUDGED} j group by reason union all select 'merged into one', {total('merged - 1')} from {_MERGED} m1
  union all select 'price rounds to zero', count(*) from {_MERGED} m2 where price_c <= 0) r where n > 0"""
ITEMS_SQL = f"select item_id, case when named then concat('Item ', item_id) else item_id end as item_name, '{NO_CATEGORY}' as category from {_JUDGED} j where reason = 'kept' group by item_id, named"

# the purchase file once more, in SQL
_SPAN = f"(select min(d) as first_day, max(d) as last_day from {_MERGED} s0)"
_RECEIVED = f"""(select *, case when k = 2 then 'no item' when k = 1 then 'no date' when k = 4 then 'no number' when k = 3 then 'bad quantity' when k = 5 then 'bad cost' when received > last_day then 'after the last sale'
    when expires <= greatest(received, first_day) then 'expired when received' else 'kept' end as reason
  from (select (l_orderkey * 7 + l_linenumber) % 100 as k, cast(o_orderdate as date) as received, cast(l_partkey as varchar) as item_id, cast(l_quantity as bigint) as quantity, (10 + l_suppkey % 20) * 100 + 25 as cost_c,
    case when (l_orderkey * 7 + l_linenumber) % 100 < 20 then null when (l_orderkey * 7 + l_linenumber) % 100 < 60 then concat('S', cast(l_suppkey as varchar), '/', cast(l_partkey % 50 as varchar)) else concat(cast(l_partkey as varchar), '/', cast(l_suppkey as varchar)) end as batch_id,
    case when (l_orderkey * 7 + l_linenumber) % 10 <> 7 then cast(o_orderdate as date) + cast(l_orderkey % 400 + 60 as int) end as expires,
    case when (l_orderkey * 7 + l_linenumber) % 10 = 8 then '{NO_SUPPLIER}' else concat('Supplier ', cast(l_suppkey as varchar)) end as supplier
    from lineitem join orders on o_orderkey = l_orderkey where l_linestatus = 'F') r cross join {_SPAN} d)"""
_FIELDS = "d, site_id, item_id, batch_id, supplier, quantity, cost_c, expires"
_NUMBERED = f"""(select *, row_number() over (partition by {_FIELDS}) as copy from (select greatest(received, first_day) as d, '{MAIN_SITE}' as site_id, item_id, batch_id, supplier, quantity, cost_c, coalesce(expires, date '{NEVER}') as expires from {_RECEIVED} j where reason = 'kept') k)"""
_TEXT = " || '|' || ".join(f"coalesce(cast({c} as varchar), '')" for c in _FIELDS.split(", "))
_IDENTIFIED = f"(select *, concat('P-', substr(md5({_TEXT}), 1, 16), '-', cast(copy as varchar)) as purchase_id from {_NUMBERED} n)"
RECEIPTS_SQL = f"""select purchase_id, d, site_id, supplier, item_id, case when p.batch_id is null then concat('L-', purchase_id) when s.batch_id is not null then concat(p.batch_id, '-', item_id) else p.batch_id end as batch_id, quantity, cost_c, quantity * cost_c as total_c, expires
  from {_IDENTIFIED} p left join (select batch_id from {_NUMBERED} n1 group by batch_id having min(item_id) <> max(item_id)) s on s.batch_id = p.batch_id"""
LOTS_SQL = f"""select batch_id, min(item_id) as item_id, min(supplier) as supplier, min(d) as first_day, min(expires) as expires, {total('quantity')} as quantity, greatest(cast(round_even({total('total_c')} / {total('quantity')}, 0) as bigint), 1) as cost_c, min(expires) < max(expires) as differing_expiry
  from ({RECEIPTS_SQL}) r group by batch_id"""
SUPPLIERS_SQL = f"select concat('SUP', lpad(cast(no as varchar), cast(greatest(4, length(cast(no as varchar))) as int), '0')) as supplier_id, supplier from (select supplier, row_number() over (order by supplier) as no from (select distinct supplier from {_RECEIVED} j where reason = 'kept') s) n"
PURCHASE_REASONS_SQL = f"select reason, count(*) as n from {_RECEIVED} j group by reason"

INTERVALS = "partition by site_key, item_key order by day_no, transaction_id, batch_id, quantity, total_c rows between unbounded preceding and current row"
TEXTS = {
    # allocation without limits of expiry or receipt: overlaps of the running sums
    "F2": f"""select s.site_key, s.item_key, s.transaction_id, l.batch_id, {total('least(s.hi, l.hi) - greatest(s.lo, l.lo)')} as quantity from (
        select site_key, item_key, transaction_id, hi - quantity as lo, hi from (select *, {total('quantity', f'over ({INTERVALS})')} as hi from t_sales) s0) s
      join (select site_key, item_key, batch_id, hi - units as lo, hi from (select *, {total('units', 'over (partition by site_key, item_key order by expiry_day_no, batch_id rows between unbounded preceding and current row)')} as hi
        from (select r.site_key, r.item_key, r.batch_id, min(b.expiry_day_no) as expiry_day_no, {total('r.quantity')} as units from t_receipts r join t_batches b on b.batch_id = r.batch_id group by r.site_key, r.item_key, r.batch_id) l0) l1) l
        on l.site_key = s.site_key and l.item_key = s.item_key and l.lo < s.hi and s.lo < l.hi group by s.site_key, s.item_key, s.transaction_id, l.batch_id""",
    "F3": f"""select transaction_id, item_key, part, units, floor_share + case when part = 1 then discount_c - {total('floor_share', 'over (partition by transaction_id, item_key)')} else 0 end as discount_c
      from (select transaction_id, item_key, part, discount_c, case when part = 1 then quantity - cast(floor(quantity / 2) as bigint) else cast(floor(quantity / 2) as bigint) end as units,
        cast(floor(discount_c * (case when part = 1 then quantity - cast(floor(quantity / 2) as bigint) else cast(floor(quantity / 2) as bigint) end) / quantity) as bigint) as floor_share
        from (select transaction_id, item_key, {total('quantity')} as quantity, {total('discount_c')} as discount_c from t_sales group by transaction_id, item_key) s cross join (select 1 as part union all select 2) p) x""",
    "F5": f"""select i.item_key, greatest(coalesce(r.cost_c, i.price_c * m.ratio), 1e0) as cost_c from (select item_key, {total('total_c')} / {total('quantity')} as price_c from t_sales group by item_key) i
      left join (select item_key, {total('total_c')} / {total('quantity')} as cost_c from t_receipts group by item_key) r on r.item_key = i.item_key
      cross join (select median(c.cost_c / s.price_c) as ratio from (select item_key, {total('total_c')} / {total('quantity')} as cost_c from t_receipts group by item_key) c join (select item_key, {total('total_c')} / {total('quantity')} as price_c from t_sales group by item_key) s on s.item_key = c.item_key) m""",
    "F8": f"""select case when n > 1 then concat(lot, '/', cast(supplier_key as varchar(20))) else lot end as batch_id, day_no, expiry_day_no, quantity from (select *, count(*) over (partition by lot) as n from (
        select cast(item_key as varchar(20)) as lot, supplier_key, greatest(min(r.day_no), min(f.first_day)) as day_no, min(r.day_no) + 200 as expiry_day_no, {total('quantity')} as quantity from t_receipts r cross join (select min(day_no) as first_day from t_sales) f
        where r.day_no + 200 > f.first_day group by item_key, supplier_key) g) x""",
    "F9": f"select count(*) as n_rows, count(distinct item_key) as items, count(distinct site) as sites, case when count(distinct item_key) > 5000 then 1 else 0 end + case when count(distinct site) > 200 then 1 else 0 end + case when count(*) < 100 then 1 else 0 end as violations, count(*) {where('length(batch_id) > 40')} as long_ids from t_sales",
    "F10": "select s.has_discount, r.has_batches, r.has_suppliers, s.n_days >= 90 as can_forecast, s.n_baskets >= 1000 as can_mine from (select max(case when discount_c > 0 then 1 else 0 end) = 1 as has_discount, count(distinct day_no) as n_days, count(distinct transaction_id) as n_baskets from t_sales) s cross join (select count(distinct batch_id) > 1 as has_batches, count(distinct supplier_key) > 1 as has_suppliers from t_receipts) r",
    "F11": "select batch_id, expiry_day_no from t_batches where expiry_day_no < (select max(day_no) - 30 from t_sales)",
    "F12": f"select s.site, s.maker, min(l.opening) as opening, {total('s.quantity')} as units, count(*) as lines from (select site, maker, quantity from t_sales where site in ('ASIA', 'EUROPE') and maker in ('Brand#1', 'Brand#2', 'Brand#3')) s join (select site, maker, opening from t_ledger where day_no = (select min(day_no) from t_calendar)) l on l.site = s.site and l.maker = s.maker group by s.site, s.maker",
}
