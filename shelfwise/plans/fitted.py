"""Queries that fit models or keep state, as functions (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import dimensions, fefo, ingest, items, mining, models, segmentation
from ..operators.reports import run_sql
from ..sources.io import fingerprint, source_state, stored, violations
from ..sources.roles import SOURCES, read, roles
from ..streaming.stateful import admission, user_events
from .views import Mart, median_of


def _mart(spark: SparkSession, sf_dir: str) -> Mart:
    return Mart(roles(spark, sf_dir))


def f1_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = roles(spark, sf_dir)
    return fefo.allocate(r.sales, r.receipts, r.batches)


def f4_opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fefo.opening_lots(f1_allocation(spark, sf_dir))


def _cleaned_sales(spark: SparkSession, sf_dir: str) -> ingest.CleanSales:
    raw = ingest.raw_lines(read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders"))
    return ingest.clean_sales(raw, ingest.suggest_mapping(raw.columns))


def _cleaned_purchases(spark: SparkSession, sf_dir: str) -> ingest.CleanPurchases:
    raw = ingest.raw_receipts(read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders"))
    return ingest.clean_purchases(raw, ingest.suggest_mapping(raw.columns, ingest.PURCHASE_SYNONYMS), _cleaned_sales(spark, sf_dir).sales)


def _cleaned(part: str) -> Callable[[SparkSession, str], DataFrame]:
    make = _cleaned_purchases if part in ingest.CleanPurchases._fields and part != "reasons" else _cleaned_sales
    return lambda spark, sf_dir: getattr(make(spark, sf_dir), part)


def f8_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned_purchases(spark, sf_dir).reasons


def f5_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average cost of every sold item, its price by the median ratio of cost to price where it was never bought; one cent at least."""
    r = roles(spark, sf_dir)
    mean = lambda rows, name: rows.groupBy("item_key").agg((F.sum("total_c") / F.sum("quantity")).alias(name))
    both = stored(mean(r.sales, "price_c").join(mean(r.receipts, "cost_c"), "item_key", "left"), "item-costs")
    ratio = median_of(both.where("cost_c is not null").select((F.col("cost_c") / F.col("price_c")).alias("ratio")), "ratio")
    return both.crossJoin(F.broadcast(ratio)).select("item_key", F.greatest(F.coalesce("cost_c", F.col("price_c") * F.col("median")), F.lit(1.0)).alias("cost_c"))


def _dimension(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: dimensions.build_dimensions(roles(spark, sf_dir), *(read(spark, sf_dir, t) for t in ("part", "region", "supplier", "nation")))[name]


def io1_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = ingest.raw_lines(read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")).withColumnsRenamed({"Bill No": "bill", "Item Code": "item", "Qty": "qty", "Rate": "rate"})
    return violations(raw, {"bill": "int", "item": "int", "qty": "int", "rate": "money"}, ["bill", "item"])


IO1_SQL = """
with raw as (select l_orderkey as bill, l_partkey as item, (l_orderkey * 7 + l_linenumber) % 100 as k from lineitem join orders on o_orderkey = l_orderkey),
keyed as (select bill, case when k = 2 then ' ' else cast(item as varchar) end as item from raw)
select 'bill: empty' as rule, 0 as n union all select 'bill: not int', 0 union all select 'item: empty', count(*) filter (where k = 2) from raw union all select 'item: not int', count(*) filter (where k = 2) from raw
union all select 'qty: empty', 0 union all select 'qty: not int', 0 union all select 'rate: empty', 0 union all select 'rate: not money', count(*) filter (where k = 4) from raw
union all select 'key: repeated', count(*) from (select 1 as x from keyed group by bill, item having count(*) > 1) g
"""


def io3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(read(spark, sf_dir, "lineitem"))


def n8_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, _mart(spark, sf_dir), """select grain, site, maker, day_no, greatest(-15e0, least(15e0, z7)) as z7, greatest(-15e0, least(15e0, zd)) as zd, ln((units_7d + 1) / (usual_7d + 1)) as week_ratio, ln((sold + 1) / (usual_day + 1)) as day_ratio,
      ln(1 + units_7d) as log_week, ln(1 + closing) as log_stock, case when closing = 0 then 1 else 0 end as empty, least(stock_run, 30) as run from v_series where z7 is not null""")
    return models.isolation_forest(rows, ["grain", "site", "maker", "day_no"], ["z7", "zd", "week_ratio", "day_ratio", "log_week", "log_stock", "empty", "run"], share=0.003)


def n12_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the rules, the forest or both flag."""
    rules = run_sql(spark, _mart(spark, sf_dir), mining.TEXTS["N9"]).withColumn("is_statistical_anomaly", F.lit(True))
    isolated = n8_isolation(spark, sf_dir).where("is_isolation_anomaly")
    both = isolated.join(rules, ["grain", "site", "maker", "day_no"], "full")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("is_statistical_anomaly", "is_isolation_anomaly")]
    return both.select("grain", "site", "maker", "day_no", *flags, "isolation_score").withColumn("combined_anomaly", F.col("is_statistical_anomaly") & F.col("is_isolation_anomaly"))


#: Candidate features in the order in which one of two near copies is kept.
CANDIDATES = [
    "units", "average_price_c", "dispersion", "weekly_cv", "turnover", "stockout_rate", "days_of_inventory", "revenue_c", "average_cost_c", "expired_value_c", "expiry_risk_c", "sales_days", "average_value_c", "stockout_events",
    "spend_c", "daily_revenue_c", "weekly_units", "daily_units", "bought", "average_stock", "value_c", "expired_units", "zero_sales_days", "weekly_sd", "closing", "stockout_days",
]
#: Words for a segment whose centre lies half a deviation or more above or below the mean of a feature.
WORDS = {
    "units": ("high volume", "low volume"), "revenue_c": ("high revenue", "low revenue"), "turnover": ("fast turnover", "slow turnover"), "weekly_cv": ("variable demand", "stable demand"),
    "stockout_rate": ("frequent stockouts", "rare stockouts"), "days_of_inventory": ("long cover", "short cover"), "average_price_c": ("high price", "low price"), "expired_value_c": ("write-offs", None),
    "expiry_risk_c": ("expiry risk", None), "average_cost_c": ("high cost", "low cost"),
}


class Segments:
    """Features, vectors, runs of k-means and their quality of one mart; each is made when it is first asked for."""

    def __init__(self, mart: Mart):
        self.mart = mart

    @cached_property
    def features(self) -> DataFrame:
        return stored(items.item_features(self.mart), "item-features")

    @cached_property
    def prepared(self) -> tuple[DataFrame, list[str], list[dict]]:
        vectors, kept, report = models.prepare_features(self.features, "item_key", CANDIDATES)
        return stored(vectors, "item-vectors"), kept, report

    @cached_property
    def runs(self) -> dict[int, segmentation.Run]:
        return segmentation.fit_all(self.prepared[0], "item_key")

    @cached_property
    def quality(self) -> list[tuple]:
        return segmentation.quality(self.prepared[0], self.runs)

    @cached_property
    def plane(self) -> list[tuple[int, float, list[float]]]:
        return models.principal_plane(self.prepared[0])

    @property
    def chosen(self) -> segmentation.Run:
        return self.runs[next(r[0] for r in self.quality if r[-1])]

    def label(self, center: list[float]) -> str:
        """The four most outstanding features in words."""
        found = [(abs(z), WORDS[c][0 if z > 0 else 1]) for c, z in zip(self.prepared[1], center) if c in WORDS and abs(z) >= 0.5 and WORDS[c][0 if z > 0 else 1]]
        return ", ".join(w for _, w in sorted(found, reverse=True)[:4]) or "average"

    def table(self) -> DataFrame:
        """item_key, segment (by falling mean units), label, x, y in the plane."""
        run = self.chosen
        near = segmentation.assigned(self.prepared[0], "item_key", run)
        volume = near.join(self.features.select("item_key", "units"), "item_key").groupBy("center").agg(F.avg("units").alias("units")).collect()
        order = {r["center"]: k for k, r in enumerate(sorted(volume, key=lambda r: (-r["units"], r["center"])), 1)}
        spark = self.features.sparkSession
        names = spark.createDataFrame([(c, k, self.label(run.centers[c].tolist())) for c, k in order.items()], "center int, segment int, label string")
        axes = [F.aggregate(F.zip_with("vector", F.array(*map(F.lit, loadings)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) for _, _, loadings in self.plane]
        return near.join(F.broadcast(names), "center").join(self.prepared[0], "item_key").select("item_key", "segment", "label", axes[0].alias("x"), axes[1].alias("y"))


_SEGMENTS: dict[tuple, Segments] = {}


def segments_of(spark: SparkSession, sf_dir: str) -> Segments:
    key = spark.sparkContext.applicationId, sf_dir, source_state(spark, [f"{sf_dir}/{t}.parquet" for t in SOURCES])
    if key not in _SEGMENTS:
        for old in [k for k in _SEGMENTS if k[:2] == key[:2]]:
            del _SEGMENTS[old]
        _SEGMENTS[key] = Segments(_mart(spark, sf_dir))
    return _SEGMENTS[key]


def n6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.item_features(_mart(spark, sf_dir))


def n6_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.dropped_items(_mart(spark, sf_dir))


def n14_preparation(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = segments_of(spark, sf_dir).prepared[2]
    return spark.createDataFrame([tuple(r.values()) for r in report], "feature string, skewness double, filled long, logged boolean, kept boolean, reason string")


def n15_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments for the number of them that n16_quality chooses."""
    return segments_of(spark, sf_dir).table().select("item_key", "segment", "x", "y")


def n16_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(segments_of(spark, sf_dir).quality, "k int, start int, cost double, silhouette double, calinski_harabasz double, davies_bouldin double, smallest int, largest int, chosen boolean")


def n17_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a segment: label, size, means, share of all units, its three categories with most items."""
    s = segments_of(spark, sf_dir)
    found = stored(s.table().join(s.features, "item_key"), "segments")
    whole = found.agg(F.sum("units").alias("all_units"))
    place = F.row_number().over(W.partitionBy("segment").orderBy(F.desc("n"), "category"))
    top = found.groupBy("segment", "category").agg(F.count(F.lit(1)).alias("n")).withColumn("place", place).where("place <= 3")
    top = top.groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("place", "category", "n"))).alias("c")).select("segment", F.concat_ws("; ", F.transform("c", lambda x: F.concat(x["category"], F.lit(" ("), x["n"].cast("string"), F.lit(")")))).alias("top_categories"))
    means = ["units", "revenue_c", "average_stock", "turnover", "stockout_rate", "expiry_risk_c", "weekly_cv", "expired_value_c", "days_of_inventory", "average_price_c", "x", "y"]
    each = found.groupBy("segment", "label").agg(F.count(F.lit(1)).alias("items"), F.sum("units").alias("total_units"), *(F.avg(c).alias(f"mean_{c}") for c in means))
    return each.join(top, "segment").crossJoin(F.broadcast(whole)).withColumn("units_share_pct", 100 * F.col("total_units") / F.col("all_units")).drop("all_units")


def n18_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(segments_of(spark, sf_dir).plane, "component int, explained_variance double, loadings array<double>")


def _view(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _mart(spark, sf_dir).table(name)


def st1_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission(user_events(read(spark, sf_dir, "events")), limit=3, window_s=24 * 3600)


ST2 = """select site, maker, day_no from (select site, maker, day_no, row_number() over (partition by site_key, maker, island order by day_no) - case when island > 0 then 1 else 0 end as run, sold
  from (select *, cast(sum(case when sold > 0 then 1 else 0 end) over (partition by site_key, maker order by day_no) as bigint) as island from t_ledger) x) y where sold = 0 and run = 7"""

VIEWS = {1: "v_monthly", 2: "v_item", 3: "v_site", 4: "v_demand", 5: "v_stockout", 6: "v_stock", 7: "v_expiry"}

QUERIES = {
    "F1_fefo_allocation": f1_allocation, "F4_opening_lots": f4_opening, "F5": f5_costs, "F7_clean_sales": _cleaned("sales"), "F7_reasons": _cleaned("reasons"), "F7_items": _cleaned("items"),
    "F8_receipts": _cleaned("receipts"), "F8_lots": _cleaned("lots"), "F8_suppliers": _cleaned("suppliers"), "F8_reasons": f8_reasons, **{f"E4_{d}": _dimension(d) for d in dimensions.DIMENSION_SQL},
    "IO1_contract": io1_contract, "IO3_fingerprint": io3_fingerprint,
    "N8_isolation_forest": n8_isolation, "N12_combined": n12_combined, "N6_items": n6_items, "N6_dropped": n6_dropped, "N14_feature_preparation": n14_preparation, "N15_segments": n15_segments, "N16_segment_quality": n16_quality, "N17_segment_summary": n17_summary, "N18_plane": n18_plane,
    "ST1_admission": st1_admission,
    **{f"V{k}_{name[2:]}": _view(name) for k, name in VIEWS.items()},
}
ORACLES = {
    "F7_clean_sales": ingest.CLEAN_SQL, "F7_reasons": ingest.REASONS_SQL, "F7_items": ingest.ITEMS_SQL, "F8_receipts": ingest.RECEIPTS_SQL, "F8_lots": ingest.LOTS_SQL, "F8_suppliers": ingest.SUPPLIERS_SQL,
    "F8_reasons": ingest.PURCHASE_REASONS_SQL, "IO1_contract": IO1_SQL,
}
