"""The retail roles of the source tables: sales, receipts, batches, calendar.

Every operator of the library takes DataFrames of these roles. Money is in integer cents throughout, so sums are exact and don't
depend on their order. `role_sql` states the same roles as SQL for cross-checks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import source_state, stored


def cents(c: Column) -> Column:
    return F.round(c * 100).cast("long")


def floor_div(a: Column, b: Column) -> Column:
    return F.floor(a / b).cast("long")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with site (region of the customer's nation), area (nation), item, category and maker (part type and brand).

    Orders meet customers before their lines and names come last, so rows are narrow where they are shuffled. What follows from other
    columns isn't kept here; `widened` adds it.
    """
    line, order, customer, nation, region, part = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "region", "part"))
    bought = order.join(customer, order.o_custkey == customer.c_custkey).select("o_orderkey", F.unix_date(F.to_date("o_orderdate")).alias("day"), "c_nationkey")
    joined = (
        line.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_linestatus")
        .join(bought, F.col("l_orderkey") == bought.o_orderkey)
        .join(part, F.col("l_partkey") == part.p_partkey)
        .join(nation, F.col("c_nationkey") == nation.n_nationkey)
        .join(region, F.col("n_regionkey") == region.r_regionkey)
    )
    quantity = F.col("l_quantity").cast("long")
    price = floor_div(cents(F.col("l_extendedprice")), quantity)
    discount = floor_div(cents(F.col("l_extendedprice")) * cents(F.col("l_discount")), F.lit(100))
    return joined.select(
        F.col("l_linestatus").alias("st"), F.col("l_orderkey").alias("transaction_id"), F.col("day").cast("long").alias("day_no"),
        F.col("r_regionkey").alias("site_key"), F.col("r_name").alias("site"), F.col("n_name").alias("area"), F.col("p_partkey").alias("item_key"),
        F.col("p_type").alias("category"), F.col("p_brand").alias("maker"), F.col("l_suppkey").alias("supplier_key"), quantity.alias("quantity"), price.alias("price_c"),
        F.least(discount, quantity * price).alias("discount_c"), floor_div(cents(F.col("p_retailprice")) * (50 + F.col("l_suppkey") % 20), F.lit(100)).alias("cost_c"), F.col("p_size").cast("long").alias("p_size"),
    )


def widened(lines: DataFrame) -> DataFrame:
    """The stored lines with the columns that follow from others: date, batch and total."""
    return lines.select(
        "st", "transaction_id", F.date_from_unix_date(F.col("day_no").cast("int")).alias("d"), "site_key", "site", "area", "item_key", "category", "maker", "supplier_key",
        F.concat(F.col("item_key").cast("string"), F.lit("-"), F.col("supplier_key").cast("string")).alias("batch_id"), "quantity", "price_c", "discount_c",
        (F.col("quantity") * F.col("price_c") - F.col("discount_c")).alias("total_c"), "cost_c", "p_size", "day_no",
    )


@dataclass(frozen=True)
class Roles:
    sales: DataFrame
    receipts: DataFrame
    batches: DataFrame
    calendar: DataFrame
    #: tables derived from the roles that are stored beside them, by name; None where the roles aren't stored
    kept: dict[str, DataFrame] | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {"sales": self.sales, "receipts": self.receipts, "batches": self.batches, "calendar": self.calendar}


def calendar(days: DataFrame) -> DataFrame:
    """A row for each day from the first to the last of `days` (a column d), with ISO parts; day_no counts from 1970-01-01."""
    span = days.agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo is not null")
    d = span.select(F.explode(F.sequence("lo", "hi")).alias("d"))
    return d.select(
        F.date_format("d", "yyyyMMdd").cast("int").alias("date_key"), "d", F.unix_date("d").cast("long").alias("day_no"), F.dayofmonth("d").alias("day"), (F.weekday("d") + 1).alias("dow"),
        F.date_format("d", "EEEE").alias("day_name"), F.weekofyear("d").alias("iso_week"), F.extract(F.lit("YEAROFWEEK"), "d").cast("int").alias("iso_year"), F.month("d").alias("month"),
        F.date_format("d", "MMMM").alias("month_name"), F.quarter("d").alias("quarter"), F.year("d").alias("year"), (F.weekday("d") >= 5).alias("is_weekend"),
    )


#: The stored marts of this process, by application, folder and state of the sources.
_MARTS: dict[tuple, Roles] = {}
SOURCES = ("lineitem", "orders", "customer", "nation", "region", "part")


def roles(spark: SparkSession, sf_dir: str) -> Roles:
    """The roles, stored as a mart: joined and written once as long as the source files stay as they are, then read from there."""
    key = spark.sparkContext.applicationId, sf_dir, source_state(spark, [f"{sf_dir}/{t}.parquet" for t in SOURCES])
    if key not in _MARTS:
        for old in [k for k in _MARTS if k[:2] == key[:2]]:
            del _MARTS[old]
        made = derived(widened(stored(_lines(spark, sf_dir), "mart-lines")))
        _MARTS[key] = Roles(made.sales, made.receipts, made.batches, stored(made.calendar, "mart-calendar"), {})
    return _MARTS[key]


def derived(lines: DataFrame) -> Roles:
    """Sales are the open lines, receipts the fulfilled ones; a batch is what one supplier delivers of one item."""
    sales = lines.where("st = 'O'").drop("st", "cost_c", "p_size")
    receipts = (
        lines.where("st = 'F'").withColumn("total_c", F.col("quantity") * F.col("cost_c"))
        .select("transaction_id", "d", "day_no", "site_key", "site", "area", "item_key", "category", "maker", "supplier_key", "batch_id", "quantity", "cost_c", "total_c", "p_size")
    )
    # dealt out by batch once: both groupings, and a join on the batch, take the rows where they are; words are grouping keys, as a hash aggregate has no least one
    each = receipts.repartition("batch_id").groupBy("batch_id", "category", "maker").agg(
        F.min("item_key").alias("item_key"), F.min("supplier_key").alias("supplier_key"), F.min("day_no").alias("first"), F.max("day_no").alias("last"), F.max("p_size").alias("p_size"), F.max("cost_c").alias("cost_c"), F.sum("quantity").alias("quantity"),
    )
    batches = each.groupBy("batch_id").agg(
        F.min("item_key").alias("item_key"), F.min("supplier_key").alias("supplier_key"), F.min("category").alias("category"), F.min("maker").alias("maker"),
        F.min("first").alias("first_day_no"), (F.max("last") + 180 + F.max("p_size") * 10).alias("expiry_day_no"), F.max("cost_c").alias("cost_c"), F.sum("quantity").alias("initial_quantity"),
    )
    # lines of either status are sales or receipts, so the calendar needs one scan of their dates
    return Roles(sales, receipts, batches, calendar(lines.where("st in ('O', 'F')").select("d")))


ROLE_SQL = """
base0 as (
  select l_orderkey as transaction_id, cast(o_orderdate as date) as d, r_regionkey as site_key, r_name as site, n_name as area, p_partkey as item_key,
    p_type as category, p_brand as maker, l_suppkey as supplier_key, l_linestatus as st, cast(l_quantity as bigint) as quantity, cast(p_size as bigint) as p_size,
    concat(cast(l_partkey as varchar), '-', cast(l_suppkey as varchar)) as batch_id,
    cast(floor(cast(round(l_extendedprice * 100) as bigint) / cast(l_quantity as bigint)) as bigint) as price_c,
    cast(floor(cast(round(l_extendedprice * 100) as bigint) * cast(round(l_discount * 100) as bigint) / 100) as bigint) as disc_c,
    cast(floor(cast(round(p_retailprice * 100) as bigint) * (50 + l_suppkey % 20) / 100) as bigint) as cost_c
  from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey
    join region on r_regionkey = n_regionkey join part on p_partkey = l_partkey),
base as (select *, least(disc_c, quantity * price_c) as discount_c, quantity * price_c - least(disc_c, quantity * price_c) as total0_c, cast(d - date '1970-01-01' as bigint) as day_no from base0),
sales as (select * exclude (st, cost_c, p_size, disc_c, total0_c), total0_c as total_c from base where st = 'O'),
receipts as (select transaction_id, d, day_no, site_key, site, area, item_key, category, maker, supplier_key, batch_id, quantity, cost_c, quantity * cost_c as total_c, p_size from base where st = 'F'),
batches as (
  select batch_id, min(item_key) as item_key, min(supplier_key) as supplier_key, min(category) as category, min(maker) as maker, min(day_no) as first_day_no,
    max(day_no) + 180 + max(p_size) * 10 as expiry_day_no, max(cost_c) as cost_c, cast(sum(quantity) as bigint) as initial_quantity
  from receipts group by batch_id),
calendar as (
  select cast(strftime(d, '%Y%m%d') as int) as date_key, d, cast(d - date '1970-01-01' as bigint) as day_no, cast(day(d) as int) as day, cast(isodow(d) as int) as dow, dayname(d) as day_name,
    cast(week(d) as int) as iso_week, cast(isoyear(d) as int) as iso_year, cast(month(d) as int) as month, monthname(d) as month_name, cast(quarter(d) as int) as quarter,
    cast(year(d) as int) as year, isodow(d) >= 6 as is_weekend
  from (select cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as d
    from (select min(d) as lo, max(d) as hi from (select d from sales union all select d from receipts))))
"""
