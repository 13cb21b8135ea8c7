"""Dense daily stock ledger of each (site, maker), from sparse flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.roles import Roles, floor_div

PAIR = ["site_key", "site", "maker"]


def write_offs(r: Roles, batches: DataFrame | None = None) -> DataFrame:
    """Units of a batch that a site has left at its expiry day: received less sold, if positive. batches: where they are stored, else they are made."""
    moved = r.receipts.select("site_key", "site", "batch_id", F.col("quantity").alias("got"), F.lit(0).cast("long").alias("gone")).unionByName(
        r.sales.select("site_key", "site", "batch_id", F.lit(0).cast("long").alias("got"), F.col("quantity").alias("gone"))
    )
    # one shuffle serves the sums and the join
    left = moved.repartition("batch_id").groupBy("site_key", "site", "batch_id").agg(F.sum("got").alias("received"), F.sum("gone").alias("sold"))
    return left.join(r.batches if batches is None else batches, "batch_id").withColumn("remaining", F.greatest(F.col("received") - F.col("sold"), F.lit(0)))


def flows(r: Roles, lots: DataFrame | None = None) -> DataFrame:
    """(pair, day_no, purchased, sold, expired), a row for each pair and day with a movement. lots: where they are stored, else they are made."""
    zero = F.lit(0).cast("long")
    last = r.calendar.agg(F.max("day_no").alias("last_day"))
    lost = (write_offs(r) if lots is None else lots).where("remaining > 0").join(F.broadcast(last), F.col("expiry_day_no") <= F.col("last_day"))
    parts = (
        r.receipts.select(*PAIR, "day_no", F.col("quantity").alias("purchased"), zero.alias("sold"), zero.alias("expired")),
        r.sales.select(*PAIR, "day_no", zero.alias("purchased"), F.col("quantity").alias("sold"), zero.alias("expired")),
        lost.select(*PAIR, F.col("expiry_day_no").alias("day_no"), zero.alias("purchased"), zero.alias("sold"), F.col("remaining").alias("expired")),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(*PAIR, "day_no").agg(*(F.sum(c).alias(c) for c in ("purchased", "sold", "expired")))


def ledger(r: Roles, lots: DataFrame | None = None) -> DataFrame:
    """opening + purchased - sold - expired = closing for each pair and calendar day; value_c at the pair's average cost.

    Windows run over days with movements only; the days in between are exploded afterwards, so no dense spine is joined or sorted.
    The opening stock of a pair is the least that keeps its stock from going negative.
    """
    found = flows(r, lots)
    span = r.calendar.agg(F.min("day_no").alias("lo"), F.max("day_no").alias("hi"))
    # each movement and a row without any on the first day, so that flows are made once
    moved, zero = ("purchased", "sold", "expired"), F.lit(0).cast("long")
    both = F.array(F.struct("day_no", *moved), F.struct(F.col("lo").alias("day_no"), *(zero.alias(c) for c in moved)))
    events = found.crossJoin(F.broadcast(span)).select(*PAIR, F.explode(both).alias("m")).select(*PAIR, "m.*").groupBy(*PAIR, "day_no").agg(*(F.sum(c).alias(c) for c in ("purchased", "sold", "expired")))
    pair = W.partitionBy("site_key", "maker")
    by_day = pair.orderBy("day_no")
    delta = F.col("purchased") - F.col("sold") - F.col("expired")
    events = events.withColumn("running", F.sum(delta).over(by_day)).withColumn("next_day", F.lead("day_no").over(by_day)).withColumn("base", F.greatest(-F.min("running").over(pair), F.lit(0)))
    days = events.join(F.broadcast(span)).withColumn("on", F.explode(F.sequence("day_no", F.coalesce(F.col("next_day") - 1, F.col("hi")))))
    moves = F.col("on") == F.col("day_no")
    flow = {c: F.when(moves, F.col(c)).otherwise(0) for c in ("purchased", "sold", "expired")}
    closing = F.col("base") + F.col("running")
    # one row a pair
    cost = r.receipts.groupBy("site_key", "maker").agg(floor_div(F.sum("total_c"), F.sum("quantity")).alias("unit_c"))
    out = days.join(cost, ["site_key", "maker"], "left").select(
        F.col("on").alias("day_no"), *PAIR, F.substring("maker", 1, 7).alias("family"), (closing - F.when(moves, delta).otherwise(0)).alias("opening"), *(v.alias(c) for c, v in flow.items()),
        closing.alias("closing"), (closing * F.coalesce("unit_c", F.lit(0))).alias("value_c"),
    )
    return out.withColumn("date_key", F.date_format(F.date_from_unix_date(F.col("day_no").cast("int")), "yyyyMMdd").cast("int"))


def period_end(stock: DataFrame, period: list[str], calendar: DataFrame) -> DataFrame:
    """Stock on the last day of each period: the only rows that may be added up over a period (stock is semi-additive)."""
    last = calendar.groupBy(*period).agg(F.max("day_no").alias("day_no"))
    return stock.join(F.broadcast(last), "day_no")


LEDGER_SQL = """
moved as (
  select site_key, site, batch_id, cast(sum(got) as bigint) as received, cast(sum(gone) as bigint) as sold
  from (select site_key, site, batch_id, quantity as got, 0 as gone from t_receipts union all select site_key, site, batch_id, 0, quantity from t_sales)
  group by site_key, site, batch_id),
t_lots as (select m.*, b.item_key, b.supplier_key, b.category, b.maker, b.first_day_no, b.expiry_day_no, b.cost_c, b.initial_quantity, greatest(m.received - m.sold, 0) as remaining
  from moved m join t_batches b on b.batch_id = m.batch_id),
t_flows as (
  select site_key, site, maker, day_no, cast(sum(p) as bigint) as purchased, cast(sum(s) as bigint) as sold, cast(sum(e) as bigint) as expired
  from (select site_key, site, maker, day_no, quantity as p, 0 as s, 0 as e from t_receipts
    union all select site_key, site, maker, day_no, 0, quantity, 0 from t_sales
    union all select site_key, site, maker, expiry_day_no, 0, 0, remaining from t_lots where remaining > 0 and expiry_day_no <= (select max(day_no) from t_calendar))
  group by site_key, site, maker, day_no),
dense as (
  select c.day_no, c.date_key, p.site_key, p.site, p.maker, coalesce(f.purchased, 0) as purchased, coalesce(f.sold, 0) as sold, coalesce(f.expired, 0) as expired
  from (select distinct site_key, site, maker from t_flows) p cross join t_calendar c
  left join t_flows f on f.site_key = p.site_key and f.maker = p.maker and f.day_no = c.day_no),
ran as (select *, cast(sum(purchased - sold - expired) over (partition by site_key, maker order by day_no) as bigint) as running from dense),
based as (select *, greatest(-min(running) over (partition by site_key, maker), 0) as base from ran),
unit as (select site_key, maker, cast(floor(cast(sum(total_c) as bigint) / cast(sum(quantity) as bigint)) as bigint) as unit_c from t_receipts group by site_key, maker),
t_ledger as (
  select b.day_no, b.date_key, b.site_key, b.site, b.maker, substr(b.maker, 1, 7) as family, base + running - (purchased - sold - expired) as opening, purchased, sold, expired,
    base + running as closing, (base + running) * coalesce(unit_c, 0) as value_c
  from based b left join unit u on u.site_key = b.site_key and u.maker = b.maker)
"""
