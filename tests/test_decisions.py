"""Decision rules at their thresholds, and the scenarios that they are meant for: one pair a case, all in one frame."""

import pytest

from shelfwise.operators import decisions

STATE = "site_key long, site string, maker string, as_of long, last_day_used long, stock long, stock_value_c long, units_7d long, units_28d long, units_30d long, units_90d long, empty_28d long, empty_90d long, empty_days long, days_observed long, stockout_events long, n_weeks long, weekly_mean double, weekly_sd double, price_c double"
LOTS = "site_key long, site string, maker string, item_key long, batch_id string, cost_c long, expiry_day_no long, days_to_expiry long, remaining long, units_90d long, units_ahead long"
FORECASTS = "site_key long, maker string, horizon int, point double, lower double, upper double"


def decided(spark, cases, lots=()):
    """cases: name -> (stock, units_28d, units_30d, f7, f30, upper7, more state fields)."""
    state, forecasts = [], []
    for name, (stock, u28, u30, f7, f30, up7, more) in cases.items():
        row = {"as_of": 100, "last_day_used": 100, "stock": stock, "stock_value_c": stock * more.pop("cost_c", 1000), "units_7d": u28 // 4, "units_28d": u28, "units_30d": u30, "units_90d": 3 * u30, "empty_28d": 0, "empty_90d": 0, "empty_days": 0, "days_observed": 730, "stockout_events": 0, "n_weeks": 26, "weekly_mean": u28 / 4, "weekly_sd": 5.0, "price_c": 2000.0} | more
        state.append((1, "S", name, *row.values()))
        if f7 is not None:
            forecasts += [(1, name, 7, float(f7), 0.0, float(up7)), (1, name, 14, 2.0 * f7, 0.0, 2.0 * up7), (1, name, 30, float(f30), 0.0, 4.0 * up7)]
    lot_rows = [(1, "S", name, 1, batch, cost, 100 + days, days, left, units, ahead) for name, batch, cost, days, left, units, ahead in lots]
    return decisions.decide(spark.createDataFrame(state, STATE), spark.createDataFrame(lot_rows, LOTS), spark.createDataFrame(forecasts, FORECASTS))


def by_maker(df):
    return {r.maker: r for r in df.collect()}


def test_scenarios(spark):
    cases = {
        "1 empty with demand": (0, 56, 60, 14, 60, 20, {}), "2 no demand": (500, 0, 0, 0, 0, 0, {}), "3 expiring": (100, 14, 15, 3.5, 15, 6, {}), "3b expiring but sold": (5, 140, 150, 35, 150, 45, {}),
        "4 healthy": (200, 140, 150, 35, 150, 45, {}), "5 nothing known": (0, 0, 0, None, None, None, {}), "6 frequent stock-outs": (60, 140, 150, 35, 150, 70, {"empty_28d": 5, "empty_days": 36}),
    }
    lots = [("3 expiring", "B1", 1000, 10, 100, 45, 0), ("3b expiring but sold", "B2", 1000, 10, 5, 450, 0)]
    d = decided(spark, cases, lots)
    q, lot = by_maker(d.queue), by_maker(d.expiry)
    one = q["1 empty with demand"]
    assert (one.risk, one.reorder_status, one.priority, one.primary_action) == ("CRITICAL", "ORDER_NOW", "CRITICAL", "ORDER_NOW") and one.order_quantity > 0 and one.score >= 400
    two = q["2 no demand"]
    assert (two.overstock_status, two.excess_units, two.excess_value_c, two.order_quantity, two.risk, two.primary_action) == ("OVERSTOCK", 500, 500_000, 0, "NO_DEMAND_DATA", "REVIEW_OVERSTOCK")
    assert (lot["3 expiring"].expiry_risk, lot["3 expiring"].expiry_action, lot["3 expiring"].unsold_90) == ("CRITICAL", "PRIORITIZE_SALE", 95 * 90)
    assert q["3 expiring"].primary_action == "PRIORITIZE_SALE_EXPIRING_STOCK" and q["3 expiring"].expiry_value_c == 95_000
    assert lot["3b expiring but sold"].unsold_90 == 0 and lot["3b expiring but sold"].expiry_risk == "MEDIUM"
    four = q["4 healthy"]
    assert (four.risk, four.reorder_status, four.overstock_status, four.priority, four.primary_action, four.active_issues) == ("LOW", "NO_REORDER", "NORMAL", "LOW", "MONITOR", 0)
    five = q["5 nothing known"]
    assert (five.risk, five.reorder_status, five.order_quantity, five.primary_action) == ("NO_DEMAND_DATA", "NO_DEMAND_DATA", 0, "NO_DEMAND_DATA")
    six = q["6 frequent stock-outs"]
    assert (six.base_risk, six.risk) == ("MEDIUM", "HIGH") and "5 empty days of 28" in six.risk_notes and "5 empty days of 28" in six.primary_reason
    ranked = sorted(q.values(), key=lambda r: (r.priority_rank, -r.score, r.site, r.maker))
    assert [r.position for r in ranked] == list(range(1, 8))


@pytest.mark.parametrize(
    ("stock", "more", "upper7", "base", "risk"),
    [
        (0, {}, 0, "CRITICAL", "CRITICAL"), (29, {}, 0, "CRITICAL", "CRITICAL"), (30, {}, 0, "HIGH", "HIGH"), (69, {}, 0, "HIGH", "HIGH"), (70, {}, 0, "MEDIUM", "MEDIUM"), (139, {}, 0, "MEDIUM", "MEDIUM"),
        (140, {}, 0, "LOW", "LOW"), (140, {"empty_28d": 2}, 0, "LOW", "LOW"), (140, {"empty_28d": 3}, 0, "LOW", "MEDIUM"), (139, {"empty_28d": 3}, 0, "MEDIUM", "HIGH"), (69, {"empty_28d": 3}, 0, "HIGH", "HIGH"),
        (140, {"empty_days": 25, "days_observed": 1000}, 0, "LOW", "LOW"), (140, {"empty_days": 26, "days_observed": 1000}, 0, "LOW", "MEDIUM"), (140, {}, 140, "LOW", "LOW"), (140, {}, 141, "LOW", "MEDIUM"),
        (139, {"empty_28d": 9}, 900, "MEDIUM", "HIGH"),
    ],
)
def test_stockout_levels(spark, stock, more, upper7, base, risk):
    """Ten units a day: cover of 3, 7 and 14 days, one step up at most and never into CRITICAL."""
    r = by_maker(decided(spark, {"x": (stock, 280, 300, 0, 0, upper7, dict(more))}).pairs)["x"]
    assert (r.base_risk, r.risk) == (base, risk) and r.cover_days == stock / 10
    assert r.risk_score == (100.0 if stock == 0 else 100.0 * (1 - min(stock / 10, 14) / 14))


def test_reorder_bands(spark):
    """Ten units a day with a weekly deviation of 7 * sqrt(7): 70 in the lead time, safety stock z * 7 * sqrt(7) = 30.46."""
    more = {"weekly_sd": 7 * 7**0.5}
    cases = {str(s): (s, 280, 300, 0, 0, 0, dict(more)) for s in (0, 29, 30, 70, 71, 100, 101)}
    cases |= {"71 upper": (71, 280, 300, 0, 0, 72, dict(more)), "few weeks": (71, 280, 300, 0, 0, 0, {"n_weeks": 7}), "forecast leads": (71, 280, 300, 77, 300, 0, dict(more))}
    r = by_maker(decided(spark, cases).pairs)
    assert {k: (x.reorder_status, x.reorder_priority) for k, x in r.items()} == {
        "0": ("ORDER_NOW", "CRITICAL"), "29": ("ORDER_NOW", "CRITICAL"), "30": ("ORDER_NOW", "HIGH"), "70": ("ORDER_NOW", "HIGH"), "71": ("REORDER_SOON", "MEDIUM"), "100": ("REORDER_SOON", "MEDIUM"),
        "101": ("NO_REORDER", "LOW"), "71 upper": ("REORDER_SOON", "HIGH"), "few weeks": ("REORDER_SOON", "MEDIUM"), "forecast leads": ("ORDER_NOW", "HIGH"),
    }
    assert r["0"].safety_stock == pytest.approx(1.6448536269514722 * 7 * 7**0.5) and r["0"].order_quantity == 241 and r["71"].order_quantity == 170 and r["101"].order_quantity == 0
    assert r["few weeks"].safety_stock == pytest.approx(1.6448536269514722 * 10**0.5 * 7**0.5) and r["forecast leads"].daily == 11.0


def test_overstock_boundary_and_excess(spark):
    cases = {"90 days": (900, 280, 300, 0, 0, 0, {}), "over": (901, 280, 300, 0, 0, 0, {}), "forecast absorbs": (1200, 280, 300, 0, 400, 0, {}), "idle": (30, 0, 0, 0, 10, 0, {}), "large": (1151, 280, 300, 0, 0, 0, {}), "just under": (1149, 280, 300, 0, 0, 0, {})}
    d = decided(spark, cases)
    q = by_maker(d.queue)
    assert {k: (x.overstock_status, x.excess_units) for k, x in q.items()} == {"90 days": ("NORMAL", 0), "over": ("OVERSTOCK", 1), "forecast absorbs": ("OVERSTOCK", 0), "idle": ("OVERSTOCK", 0), "large": ("OVERSTOCK", 251), "just under": ("OVERSTOCK", 249)}
    # an excess of 2500 in money or more is MEDIUM, else LOW, but is reviewed all the same
    assert (q["large"].priority, q["just under"].priority) == ("MEDIUM", "LOW") and q["just under"].primary_action == "REVIEW_OVERSTOCK"


@pytest.mark.parametrize(
    ("days", "remaining", "units_90d", "ahead", "unsold_90", "risk"),
    [
        (30, 100, 90, 0, 70 * 90, "CRITICAL"), (31, 100, 90, 0, 69 * 90, "HIGH"), (90, 100, 90, 0, 10 * 90, "HIGH"), (91, 100, 90, 0, 9 * 90, "MEDIUM"), (91, 91, 90, 0, 0, "LOW"), (90, 90, 90, 0, 0, "MEDIUM"),
        (90, 90, 90, 1, 90, "HIGH"), (365, 1000, 90, 0, 635 * 90, "MEDIUM"), (366, 1000, 90, 0, 0, "LOW"), (10, 3, 26, 0, 10, "CRITICAL"), (10, 3, 0, 50, 270, "CRITICAL"),
    ],
)
def test_expiry_ladder(spark, days, remaining, units_90d, ahead, unsold_90, risk):
    d = decided(spark, {"x": (200, 140, 150, 35, 150, 45, {})}, [("x", "B", 100, days, remaining, units_90d, ahead)])
    lot, pair = by_maker(d.expiry)["x"], by_maker(d.queue)["x"]
    assert (lot.unsold_90, lot.expiry_risk) == (unsold_90, risk)
    # what loses under a unit ranks as MEDIUM in the queue, and MEDIUM counts only if something is lost
    level = "MEDIUM" if risk in ("CRITICAL", "HIGH") and unsold_90 < 90 else risk
    assert pair.pair_expiry_risk == level and pair.priority == ("LOW" if level == "MEDIUM" and not unsold_90 else level)


def test_issues_are_ranked_and_kept(spark):
    """Three issues at once: stock before expiry before overstock in a tie, the others as secondary reasons."""
    lots = [("x", "B1", 1000, 20, 30, 0, 0), ("x", "B2", 1000, 15, 30, 0, 0), ("x", "B3", 10, 5, 1, 0, 0)]
    q = by_maker(decided(spark, {"x": (0, 280, 300, 0, 0, 0, {}), "y": (3000, 28, 30, 0, 0, 0, {"empty_28d": 4})}, [*lots, ("y", "B4", 100, 60, 9, 0, 0)]).queue)
    x, y = q["x"], q["y"]
    assert [i.kind for i in x.issues] == [0, 1] and x.primary_action == "ORDER_NOW" and x.secondary_reasons == "[CRITICAL] batch B2 expires in 15 days" and x.active_issues == 2
    assert x.expiry_value_c == 61_010 - 1000 and x.short_units == 70 and x.short_value_c == 140_000 and x.exposure_c == 200_010 and x.score == 412.0
    assert [(i.rank, i.kind) for i in y.issues] == [(1, 1), (2, 0), (2, 2)] and y.primary_action == "PRIORITIZE_SALE_EXPIRING_STOCK" and y.secondary_reasons.startswith("[MEDIUM] 3000.0 days of cover")
    assert (x.position, y.position) == (1, 2)


def test_no_forecast_no_lots_no_pairs(spark):
    d = decided(spark, {"x": (10, 28, 30, None, None, None, {})})
    x = by_maker(d.queue)["x"]
    assert x.daily == 1.0 and x.cover_days_upper is None and x.pair_expiry_risk == "NONE" and x.expiry_value_c == 0
    s = decisions.summary(d.queue, d.expiry).first()
    assert (s.pairs, s.lots, s.priority_critical + s.priority_high + s.priority_medium + s.priority_low) == (1, 0, 1)
    none = decisions.decide(d.state.limit(0), d.lots, spark.createDataFrame([], FORECASTS))
    assert none.queue.count() == 0
