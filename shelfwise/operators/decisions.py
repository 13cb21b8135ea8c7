"""Replenishment decisions as of a day, from what is known on it and a table of forecasts.

A forecast is a row (site_key, maker, horizon, point, lower, upper) with the units that the next `horizon` days are expected to sell and
bounds of them; any model or baseline that makes such rows can be used. Every rule is a function from a frame with a row for each
(site, maker) to the same rows with more columns; thresholds are the fields of `Rules`.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.series import HORIZONS
from ..plans.views import Mart, deviation, ratio
from ..sources.roles import floor_div

PAIR = ["site_key", "site", "maker"]


@dataclass(frozen=True)
class Rules:
    """Thresholds of the decision rules, planning assumptions included."""

    critical_days: float = 3.0
    high_days: float = 7.0
    medium_days: float = 14.0
    escalate_empty_28d: int = 3
    escalate_empty_share: float = 0.025
    lead_days: int = 7
    service_level: float = 0.95
    order_days: int = 14
    least_weeks: int = 8
    weeks: int = 26
    overstock_days: int = 90
    material_excess_c: int = 250_000
    expiry_horizon: int = 365
    expiry_critical: int = 30
    expiry_high: int = 90
    #: units that a lot must lose at least to stay CRITICAL or HIGH in the queue, in ninetieths
    material_unsold_90: int = 90

    @property
    def z(self) -> float:
        return NormalDist().inv_cdf(self.service_level)


RULES = Rules()
#: Severities from the worst on, and the score that a priority begins with.
SEVERITY = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
BASE_SCORE = (400, 300, 200, 100)


def rank_of(level: Column) -> Column:
    """0 for CRITICAL to 3 for LOW, and for whatever else."""
    return F.when(level == "CRITICAL", 0).when(level == "HIGH", 1).when(level == "MEDIUM", 2).otherwise(3)


def level_of(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITY)), rank + 1)


def rounded(x: Column, digits: int) -> Column:
    """Half up, by a floor, so that the shown digits don't depend on how an engine rounds."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def shown(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", rounded(x.cast("double"), digits))


def pair_state(mart: Mart, day: DataFrame, rules: Rules = RULES) -> DataFrame:
    """What is known of each pair on the day (one row, a column as_of): stock, sales of trailing windows, stock-outs, weeks, price.

    Rows after the day are dropped before anything else; blocks of seven days are counted back from the day.
    """
    known = mart.table("t_ledger").join(F.broadcast(day), F.col("day_no") <= F.col("as_of"))
    by_day = W.partitionBy("site_key", "maker").orderBy("day_no")
    age, empty = F.col("as_of") - F.col("day_no"), F.col("closing") == 0
    known = known.withColumn("started", empty & (F.coalesce(F.lag("closing").over(by_day), F.lit(1)) != 0))
    sold = lambda n: F.sum(F.when(age < n, F.col("sold")).otherwise(0)).alias(f"units_{n}d")
    out = known.groupBy(*PAIR).agg(
        F.max("as_of").alias("as_of"), F.max("day_no").alias("last_day_used"), F.max(F.when(age == 0, F.col("closing"))).alias("stock"), F.max(F.when(age == 0, F.col("value_c"))).alias("stock_value_c"),
        *map(sold, (7, 28, 30, 90)), F.count_if(empty & (age < 28)).alias("empty_28d"), F.count_if(empty & (age < 90)).alias("empty_90d"), F.count_if(empty).alias("empty_days"),
        F.count(F.lit(1)).alias("days_observed"), F.count_if("started").alias("stockout_events"),
    )
    blocks = known.where(age < 7 * rules.weeks).groupBy("site_key", "maker", F.floor(age / 7).alias("block")).agg(F.sum("sold").alias("units"))
    n, total, squares = F.count(F.lit(1)), F.sum("units"), F.sum(F.col("units") * F.col("units"))
    weekly = blocks.groupBy("site_key", "maker").agg(n.alias("n_weeks"), (total / n).alias("weekly_mean"), deviation(n, total, squares).alias("weekly_sd"))
    lines = mart.table("t_sales").join(F.broadcast(day), F.col("day_no") <= F.col("as_of"))
    recent = age < 90
    price = lines.groupBy("site_key", "maker").agg(
        ratio(F.sum(F.when(recent, F.col("total_c"))), F.sum(F.when(recent, F.col("quantity")))).alias("recent"), ratio(F.sum("total_c"), F.sum("quantity")).alias("ever"),
    )
    price = price.select("site_key", "maker", F.coalesce("recent", "ever").alias("price_c"))
    return out.join(weekly, ["site_key", "maker"], "left").join(price, ["site_key", "maker"], "left")


def live_lots(mart: Mart, day: DataFrame) -> DataFrame:
    """Lots of a site that hold units on the day and haven't expired: received less sold up to the day, and the units of earlier ones."""
    moved = mart.table("t_receipts").select("day_no", "site_key", "site", "batch_id", "quantity").unionByName(mart.table("t_sales").select("day_no", "site_key", "site", "batch_id", (-F.col("quantity")).alias("quantity")))
    known = moved.join(F.broadcast(day), F.col("day_no") <= F.col("as_of")).select("site_key", "site", "batch_id", "quantity")
    # one shuffle serves the sums and the join; batches that have expired are left out before theirs
    left = known.repartition("batch_id").groupBy("site_key", "site", "batch_id").agg(F.sum("quantity").alias("remaining"))
    good = mart.table("t_batches").join(F.broadcast(day), F.col("expiry_day_no") > F.col("as_of"))
    lots = left.where("remaining > 0").join(good, "batch_id")
    recent = mart.table("t_sales").join(F.broadcast(day), (F.col("day_no") <= F.col("as_of")) & (F.col("day_no") > F.col("as_of") - 90))
    sold = recent.groupBy("site_key", "item_key").agg(F.sum("quantity").alias("units_90d"))
    lots = lots.join(sold, ["site_key", "item_key"], "left")
    before = W.partitionBy("site_key", "item_key").orderBy("expiry_day_no", "batch_id").rowsBetween(W.unboundedPreceding, -1)
    return lots.select(
        *PAIR, "item_key", "batch_id", "cost_c", "expiry_day_no", (F.col("expiry_day_no") - F.col("as_of")).alias("days_to_expiry"), "remaining", F.coalesce("units_90d", F.lit(0)).alias("units_90d"),
        F.coalesce(F.sum("remaining").over(before), F.lit(0)).alias("units_ahead"),
    )


def pivoted(forecasts: DataFrame) -> DataFrame:
    """A row for each pair with f7, lower7, upper7 and so on; a pair has one forecast of a horizon at most."""
    wanted = [F.max(F.when(F.col("horizon") == h, F.col(c))).alias(f"{name}{h}") for h in HORIZONS for c, name in (("point", "f"), ("lower", "lower"), ("upper", "upper"))]
    return forecasts.groupBy("site_key", "maker").agg(*wanted)


def decision_frame(state: DataFrame, forecasts: DataFrame, rules: Rules = RULES) -> DataFrame:
    """The inputs of all rules: expected daily demand is the larger of the 7-day forecast's rate and that of the last 28 days."""
    out = state.join(pivoted(forecasts), ["site_key", "maker"], "left")
    enough = F.coalesce("n_weeks", F.lit(0)) >= rules.least_weeks
    return out.withColumns({
        "recent_daily": F.col("units_28d") / 28.0,
        "daily": F.greatest(F.coalesce("f7", F.lit(0.0)) / 7.0, F.col("units_28d") / 28.0),
        "daily_sd": F.when(enough, F.col("weekly_sd") / F.sqrt(F.lit(7.0))),
        "weekly_cv": F.when(enough & (F.col("weekly_mean") > 0), F.col("weekly_sd") / F.col("weekly_mean")),
        "empty_share": F.col("empty_days") / F.col("days_observed"),
        "unit_c": ratio(F.col("stock_value_c"), F.col("stock")),
    })


def stockout_risk(frame: DataFrame, rules: Rules = RULES) -> DataFrame:
    """base_risk by days of cover, risk after at most one step up, score from 0 to 100 and the reasons.

    A step goes from LOW to MEDIUM or from MEDIUM to HIGH: for frequent or recent stock-outs, or if the upper 7-day forecast would empty
    the stock within high_days. CRITICAL only comes from the cover itself.
    """
    stock, daily, demand = F.col("stock"), F.col("daily"), F.col("daily") > 0
    cover = F.when(demand, stock / daily)
    upper = F.col("upper7") / 7.0
    cover_upper = F.when(upper > 0, stock / upper)
    base = F.when(~demand, "NO_DEMAND_DATA").when((stock == 0) | (cover < rules.critical_days), "CRITICAL").when(cover < rules.high_days, "HIGH").when(cover < rules.medium_days, "MEDIUM").otherwise("LOW")
    out = frame.withColumns({"cover_days": cover, "cover_days_upper": cover_upper, "base_risk": base})
    history = (F.col("empty_28d") >= rules.escalate_empty_28d) | (F.col("empty_share") > rules.escalate_empty_share)
    short = F.coalesce(F.col("cover_days_upper") < rules.high_days, F.lit(False))
    out = out.withColumns({"_history": history, "_short": short})
    raised = F.col("base_risk").isin("LOW", "MEDIUM") & (F.col("_history") | F.col("_short"))
    risk = F.when(raised & (F.col("base_risk") == "LOW"), "MEDIUM").when(raised, "HIGH").otherwise(F.col("base_risk"))
    score = F.when(F.col("base_risk") == "NO_DEMAND_DATA", 0.0).when(stock == 0, 100.0).otherwise(100.0 * (1.0 - F.least(F.col("cover_days"), F.lit(rules.medium_days)) / rules.medium_days))
    out = out.withColumns({"risk": risk, "risk_score": score})
    of_history = F.concat(F.col("empty_28d").cast("string"), F.lit(" empty days of 28, empty on "), shown(100 * F.col("empty_share"), 1), F.lit("% of all days"))
    notes = F.concat_ws(
        "; ", F.when(raised & F.col("_history"), F.concat(F.lit("raised from "), F.col("base_risk"), F.lit(": "), of_history)),
        F.when(raised & F.col("_short"), F.concat(F.lit("raised from "), F.col("base_risk"), F.lit(": "), shown(F.col("cover_days_upper"), 1), F.lit(" days of cover at the upper forecast"))),
        F.when(~raised & F.col("_history") & F.col("risk").isin("CRITICAL", "HIGH"), of_history),
        F.when((stock > 0) & (F.col("f7") > stock), F.lit("the 7-day forecast is over the stock")), F.when(F.col("weekly_cv") >= 1.0, F.lit("weekly demand varies by its mean or more")),
    )
    reason = (
        F.when(F.col("base_risk") == "NO_DEMAND_DATA", F.lit("no demand seen or forecast"))
        .when(stock == 0, F.concat(F.lit("out of stock, "), shown(daily, 2), F.lit(" units a day expected")))
        .otherwise(F.concat(shown(F.col("cover_days"), 1), F.lit(" days of cover at "), shown(daily, 2), F.lit(" units a day")))
    )
    return out.withColumns({"risk_reason": reason, "risk_notes": F.when(F.col("base_risk") == "NO_DEMAND_DATA", F.lit("")).otherwise(notes)}).drop("_history", "_short")


def reorder(frame: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Reorder point, order-up-to level, recommendation, whole quantity and priority; of stockout_risk's rows.

    ORDER_NOW at or below the demand of the lead time, REORDER_SOON below the reorder point. Without eight weeks the deviation is that of
    a Poisson demand. REORDER_SOON is HIGH where the lead time isn't covered at the upper forecast, ORDER_NOW is CRITICAL under
    critical_days of cover.
    """
    stock, daily, demand = F.col("stock"), F.col("daily"), F.col("daily") > 0
    lead = daily * float(rules.lead_days)
    safety = F.greatest(rules.z * F.coalesce("daily_sd", F.sqrt("daily")) * F.sqrt(F.lit(float(rules.lead_days))), F.lit(0.0))
    out = frame.withColumns({"lead_demand": lead, "safety_stock": safety})
    out = out.withColumn("reorder_point", F.col("lead_demand") + F.col("safety_stock"))
    out = out.withColumn("order_up_to", rounded(F.col("reorder_point") + daily * float(rules.order_days), 2))
    status = F.when(~demand, "NO_DEMAND_DATA").when(stock <= F.col("lead_demand"), "ORDER_NOW").when(stock < F.col("reorder_point"), "REORDER_SOON").otherwise("NO_REORDER")
    out = out.withColumn("reorder_status", status)
    covered = F.coalesce(stock >= rules.lead_days * (F.col("upper7") / 7.0), F.lit(True))
    now, soon = F.col("reorder_status") == "ORDER_NOW", F.col("reorder_status") == "REORDER_SOON"
    priority = F.when(now & ((stock == 0) | (F.col("cover_days") < rules.critical_days)), "CRITICAL").when(now | (soon & ~covered), "HIGH").when(soon, "MEDIUM").otherwise("LOW")
    quantity = F.when(now | soon, F.ceil(F.greatest(F.col("order_up_to") - stock, F.lit(0.0)) - 1e-9)).otherwise(0)
    return out.withColumns({"order_quantity": quantity.cast("long"), "reorder_priority": priority})


def overstock(frame: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Over 90 days of cover, by whole numbers; the excess is over 90 days of the larger of the recent and the forecast 30-day rate."""
    stock, sold = F.col("stock"), F.col("units_30d")
    over = (stock > 0) & ((sold == 0) | (stock * 30 > rules.overstock_days * sold))
    rate = F.greatest(sold / 30.0, F.coalesce("f30", F.lit(0.0)) / 30.0)
    units = F.when(over, F.ceil(F.greatest(stock - rules.overstock_days * rate, F.lit(0.0)) - 1e-9)).otherwise(0).cast("long")
    out = frame.withColumns({"overstock_status": F.when(over, "OVERSTOCK").otherwise("NORMAL"), "excess_units": units})
    # unit_c is stock_value_c / stock, so the value is a whole number of cents but for a division
    return out.withColumn("excess_value_c", F.when(F.col("excess_units") > 0, floor_div(2 * F.col("excess_units") * F.col("stock_value_c") + stock, 2 * stock)).otherwise(0))


def expiry_actions(lots: DataFrame, forecasts: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Of each live lot: units that demand of the last 90 days leaves unsold (in ninetieths), risk and action; what is forecast, as evidence."""
    days, left = F.col("days_to_expiry"), 90 * F.col("remaining")
    sells = F.least(left, F.greatest(F.col("units_90d") * days - 90 * F.col("units_ahead"), F.lit(0)))
    out = lots.withColumn("unsold_90", F.when(days <= rules.expiry_horizon, left - sells).otherwise(0))
    lost, near = F.col("unsold_90") > 0, days <= rules.expiry_high
    level = F.when(lost & (days <= rules.expiry_critical), "CRITICAL").when(lost & near, "HIGH").when(lost | near, "MEDIUM").otherwise("LOW")
    out = out.withColumns({"expiry_risk": level, "unsold_value_c": floor_div(F.col("unsold_90") * F.col("cost_c") + 45, F.lit(90))})
    action = F.when(F.col("expiry_risk").isin("CRITICAL", "HIGH"), "PRIORITIZE_SALE").when(F.col("expiry_risk") == "MEDIUM", "MONITOR").otherwise("NO_ACTION")
    rate = pivoted(forecasts).select("site_key", "maker", (F.col("f30") / 30.0).alias("_rate"))
    out = out.join(rate, ["site_key", "maker"], "left").withColumns({"expiry_action": action, "forecast_to_expiry": F.col("_rate") * F.least(days, F.lit(rules.expiry_horizon))})
    return out.drop("_rate")


def expiry_by_pair(lots: DataFrame, rules: Rules = RULES) -> DataFrame:
    """The worst lot of each pair and its sums: a lot that loses under a unit is MEDIUM at most; MEDIUM counts if anything is lost.

    The worst is found by an aggregate over structs, so no task sorts the lots of a pair.
    """
    small = F.col("expiry_risk").isin("CRITICAL", "HIGH") & (F.col("unsold_90") < rules.material_unsold_90)
    lots = lots.withColumn("level", F.when(small, "MEDIUM").otherwise(F.col("expiry_risk")))
    order = F.struct(rank_of(F.col("level")).alias("rank"), (-F.col("unsold_value_c")).alias("value"), F.col("days_to_expiry"), F.col("batch_id"), F.col("level"), F.col("unsold_90"))
    acts = F.col("level").isin("CRITICAL", "HIGH") | ((F.col("level") == "MEDIUM") & (F.col("unsold_90") > 0))
    out = lots.groupBy("site_key", "maker").agg(
        F.min(order).alias("w"), F.count(F.lit(1)).alias("expiry_lots"), F.count_if(F.col("unsold_90") > 0).alias("expiry_lots_at_risk"), F.sum("unsold_value_c").alias("expiry_value_c"), F.max(acts).alias("expiry_acts"),
    )
    return out.select("site_key", "maker", F.col("w.level").alias("pair_expiry_risk"), F.col("w.batch_id").alias("worst_batch"), F.col("w.days_to_expiry").alias("worst_days"), "expiry_lots", "expiry_lots_at_risk", "expiry_value_c", "expiry_acts")


def action_queue(frame: DataFrame, by_pair: DataFrame, rules: Rules = RULES) -> DataFrame:
    """A row for each pair, with its issues as an array of structs ordered by severity; the first is the primary action.

    frame: rows of stockout_risk, reorder and overstock. Ties go to stock, then expiry, then overstock. The score orders rows of a
    priority: base + 5 for each issue above LOW + a thousandth of the exposure in money, 50 at most. The position comes from counts of
    the queue's priorities and a rank within each, so that no task sorts all pairs.
    """
    q = frame.join(by_pair, ["site_key", "maker"], "left").withColumns({
        "pair_expiry_risk": F.coalesce("pair_expiry_risk", F.lit("NONE")), "expiry_lots": F.coalesce("expiry_lots", F.lit(0)), "expiry_lots_at_risk": F.coalesce("expiry_lots_at_risk", F.lit(0)),
        "expiry_value_c": F.coalesce("expiry_value_c", F.lit(0)), "expiry_acts": F.coalesce("expiry_acts", F.lit(False)),
    })
    orders = F.col("reorder_status").isin("ORDER_NOW", "REORDER_SOON")
    stock_rank = F.least(rank_of(F.col("risk")), rank_of(F.col("reorder_priority")))
    expiry_rank = F.when(F.col("pair_expiry_risk").isin("CRITICAL", "HIGH"), rank_of(F.col("pair_expiry_risk"))).when((F.col("pair_expiry_risk") == "MEDIUM") & F.col("expiry_acts"), 2).otherwise(3)
    over = F.col("overstock_status") == "OVERSTOCK"
    over_rank = F.when(over & (F.col("excess_value_c") >= rules.material_excess_c), 2).otherwise(3)
    units_short = rounded(F.greatest(F.col("daily") * float(rules.lead_days) - F.col("stock"), F.lit(0.0)), 2)
    q = q.withColumns({"_stock": stock_rank, "_expiry": expiry_rank, "_over": over_rank, "short_units": units_short})
    q = q.withColumn("short_value_c", F.floor(F.col("short_units") * F.coalesce("price_c", F.lit(0.0)) + 0.5).cast("long"))
    q = q.withColumn("exposure_c", F.col("short_value_c") + F.col("excess_value_c") + F.col("expiry_value_c"))

    def issue(on: Column, rank: Column, kind: int, action: Column, reason: Column) -> Column:
        return F.when(on, F.struct(rank.alias("rank"), F.lit(kind).alias("kind"), action.alias("action"), reason.alias("reason")))

    of_stock = F.concat(
        F.col("risk_reason"), F.when(orders, F.concat(F.lit(", order "), F.col("order_quantity").cast("string"))).otherwise(F.lit("")),
        F.when(F.col("risk_notes") != "", F.concat(F.lit(" ("), F.col("risk_notes"), F.lit(")"))).otherwise(F.lit("")),
    )
    found = F.array(
        issue((F.col("_stock") < 3) | orders, F.col("_stock"), 0, F.when(orders, F.col("reorder_status")).otherwise("MONITOR_STOCK_CLOSELY"), of_stock),
        issue(F.col("_expiry") < 3, F.col("_expiry"), 1, F.when(F.col("_expiry") < 2, "PRIORITIZE_SALE_EXPIRING_STOCK").otherwise("MONITOR_EXPIRY"), F.concat(F.lit("batch "), F.col("worst_batch"), F.lit(" expires in "), F.col("worst_days").cast("string"), F.lit(" days"))),
        issue(over, F.col("_over"), 2, F.lit("REVIEW_OVERSTOCK"), F.concat(F.col("excess_units").cast("string"), F.lit(" units over 90 days of cover"))),
    )
    q = q.withColumn("issues", F.array_sort(F.filter(found, lambda x: x.isNotNull())))
    any_issue = F.size("issues") > 0
    active = F.size(F.filter("issues", lambda x: x["rank"] < 3))
    no_data = F.col("risk") == "NO_DEMAND_DATA"
    q = q.withColumns({
        "priority_rank": F.when(any_issue, F.get("issues", F.lit(0))["rank"]).otherwise(3),
        "primary_action": F.when(any_issue, F.get("issues", F.lit(0))["action"]).when(no_data, "NO_DEMAND_DATA").otherwise("MONITOR"),
        "primary_reason": F.when(any_issue, F.get("issues", F.lit(0))["reason"]).when(no_data, F.col("risk_reason")).otherwise(F.concat(F.lit("no issue: "), F.col("risk_reason"))),
        "secondary_reasons": F.concat_ws(" | ", F.transform(F.slice("issues", 2, 3), lambda x: F.concat(F.lit("["), level_of(x["rank"]), F.lit("] "), x["reason"]))),
        "active_issues": active,
    })
    base = F.element_at(F.array(*map(F.lit, BASE_SCORE)), F.col("priority_rank") + 1)
    q = q.withColumns({"priority": level_of(F.col("priority_rank")), "score": rounded(base + 5 * F.col("active_issues") + F.least(F.col("exposure_c") / 100_000, F.lit(50.0)), 2)})
    sizes = q.groupBy().agg(*(F.count_if(F.col("priority_rank") < k).alias(f"_{k}") for k in range(4)))
    before = F.element_at(F.array(*(F.col(f"_{k}") for k in range(4))), F.col("priority_rank") + 1)
    place = F.row_number().over(W.partitionBy("priority_rank").orderBy(F.desc("score"), "site", "maker"))
    return q.crossJoin(F.broadcast(sizes)).withColumn("position", before + place).drop("_stock", "_expiry", "_over", *(f"_{k}" for k in range(4)))


def summary(queue: DataFrame, lots: DataFrame) -> DataFrame:
    """One row: pairs by priority, risk and recommendation, units to order and exposures, lots by risk."""
    counts = [F.count_if(F.col(c) == v).alias(f"{n}_{v.lower()}") for c, n, vs in (
        ("priority", "priority", SEVERITY), ("risk", "risk", (*SEVERITY, "NO_DEMAND_DATA")), ("reorder_status", "reorder", ("ORDER_NOW", "REORDER_SOON", "NO_REORDER")), ("overstock_status", "stock", ("OVERSTOCK",)),
    ) for v in vs]
    sums = [F.sum(c).alias(c) for c in ("order_quantity", "excess_units", "short_value_c", "excess_value_c", "expiry_value_c")]
    of_lots = lots.agg(F.count(F.lit(1)).alias("lots"), *(F.count_if(F.col("expiry_risk") == v).alias(f"lots_{v.lower()}") for v in SEVERITY))
    return queue.agg(F.count(F.lit(1)).alias("pairs"), *counts, *sums).crossJoin(F.broadcast(of_lots))


@dataclass(frozen=True)
class Decisions:
    """All tables of a decision day."""

    state: DataFrame
    lots: DataFrame
    frame: DataFrame
    pairs: DataFrame
    expiry: DataFrame
    by_pair: DataFrame
    queue: DataFrame


def decide(state: DataFrame, lots: DataFrame, forecasts: DataFrame, rules: Rules = RULES) -> Decisions:
    frame = decision_frame(state, forecasts, rules)
    pairs = overstock(reorder(stockout_risk(frame, rules), rules), rules)
    expiry = expiry_actions(lots, forecasts, rules)
    by_pair = expiry_by_pair(expiry, rules)
    return Decisions(state, lots, frame, pairs, expiry, by_pair, action_queue(pairs, by_pair, rules))


def decision_day(mart: Mart, back: int) -> DataFrame:
    """One row, as_of: the day that lies `back` days before the last one of the calendar."""
    return mart.table("t_calendar").agg((F.max("day_no") - back).alias("as_of"))


#: Periods that validation targets lie in: from 360 to 180 days before the last day.
HISTORY, PERIOD, BINS = 28, 180, 5


def baselines(mart: Mart, horizon: int) -> DataFrame:
    """pair, day_no, target and the five baselines of a horizon in whole thousandths of a unit, of every origin with enough history."""
    rows = mart.table("v_features").where(F.col("n_seen") >= HISTORY)
    values = {"naive": float(horizon) * F.col("sold"), "ma_7": horizon * F.col("mean_7"), "ma_28": horizon * F.col("mean_28"), "seasonal_weekly": F.col(f"weekly_{horizon}"), "seasonal_yearly": F.col(f"yearly_{horizon}")}
    long = F.explode(F.filter(F.array(*(F.struct(F.lit(n).alias("model"), F.floor(v.cast("double") * 1000 + 0.5).alias("point_k")) for n, v in values.items())), lambda x: x["point_k"].isNotNull()))
    return rows.select("site_key", "maker", "day_no", F.lit(horizon).alias("horizon"), F.col(f"target_{horizon}").alias("target"), long.alias("m")).select("*", "m.*").drop("m")


def baseline_forecasts(mart: Mart, day: DataFrame) -> DataFrame:
    """Forecasts as of the day: for each horizon the baseline of least validation error, with bounds from its validation residuals.

    Bounds are the 10 and 90 % quantiles of residuals in five bins of the prediction. Predictions, residuals and quantiles are whole
    numbers (thousandths, and tenths of them), so that they don't depend on the order of rows. Broadcasts hold three rows.
    """
    last = mart.table("t_calendar").agg(F.max("day_no").alias("last_day"))
    rows = baselines(mart, HORIZONS[0])
    for h in HORIZONS[1:]:
        rows = rows.unionByName(baselines(mart, h))
    rows = rows.crossJoin(F.broadcast(last))
    validation = rows.where((F.col("day_no") > F.col("last_day") - 2 * PERIOD) & (F.col("day_no") + F.col("horizon") <= F.col("last_day") - PERIOD) & F.col("target").isNotNull())
    errors = validation.groupBy("horizon", "model").agg((F.sum(F.abs(F.col("point_k") - 1000 * F.col("target"))) / F.nullif(F.sum("target"), F.lit(0))).alias("wape"))
    best = errors.groupBy("horizon").agg(F.min(F.struct(F.coalesce("wape", F.lit(float("inf"))).alias("wape"), "model"))["model"].alias("model"))
    chosen = validation.join(F.broadcast(best), ["horizon", "model"])
    # the quantile of whole numbers lies on a tenth of one
    tenths = lambda c, q: F.floor(F.percentile(c, q) * 10 + 0.5)
    edges = chosen.groupBy("horizon").agg(F.array(*(tenths("point_k", k / BINS) for k in range(1, BINS))).alias("edges"))
    bin_of = F.size(F.filter("edges", lambda e: e <= 10 * F.col("point_k")))
    residual = 1000 * F.col("target") - F.col("point_k")
    bounds = chosen.join(F.broadcast(edges), "horizon").withColumn("bin", bin_of).groupBy("horizon", "bin").agg(tenths(residual, 0.1).alias("low"), tenths(residual, 0.9).alias("high"))
    known = rows.join(F.broadcast(day), F.col("day_no") == F.col("as_of")).join(F.broadcast(best), ["horizon", "model"]).join(F.broadcast(edges), "horizon", "left").withColumn("bin", F.coalesce(bin_of, F.lit(0)))
    known = known.join(F.broadcast(bounds), ["horizon", "bin"], "left")
    bound = lambda c: F.greatest(10 * F.col("point_k") + F.coalesce(c, F.lit(0)), F.lit(0)) / 10000.0
    return known.select("site_key", "maker", "horizon", "model", (F.col("point_k") / 1000.0).alias("point"), bound("low").alias("lower"), bound("high").alias("upper"))
