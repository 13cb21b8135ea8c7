"""Worked scenarios with known answers."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import fefo, ingest, models, segmentation
from shelfwise.operators.dimensions import build_dimensions, with_key
from shelfwise.plans.views import current_stock
from shelfwise.sources import io
from shelfwise.sources.roles import read, roles
from shelfwise.streaming.stateful import admission, admission_stream, admit, run_onset_stream


def day(text):
    return (dt.date.fromisoformat(text) - dt.date(1970, 1, 1)).days


def test_fefo_example(spark):
    """Lots A (expires first) and B; the third sale meets an expired A and runs out of B."""
    sales = spark.createDataFrame(
        [(1, 7, 1, day("2025-01-10"), "-", 12, 1000, 300, 11700), (1, 7, 2, day("2025-03-05"), "-", 5, 1000, 0, 5000), (1, 7, 3, day("2025-03-06"), "-", 10, 1000, 0, 10000)],
        "site_key long, item_key long, transaction_id long, day_no long, batch_id string, quantity long, price_c long, discount_c long, total_c long",
    )
    receipts = spark.createDataFrame([(1, 7, "A", day("2025-01-01"), 10), (1, 7, "B", day("2025-01-01"), 10)], "site_key long, item_key long, batch_id string, day_no long, quantity long")
    batches = spark.createDataFrame([("A", day("2025-03-01")), ("B", day("2025-06-01"))], "batch_id string, expiry_day_no long")
    parts = fefo.allocate(sales, receipts, batches)
    got = {(r.transaction_id, r.batch_id): r for r in parts.collect()}
    assert {k: v.quantity for k, v in got.items()} == {(1, "A"): 10, (1, "B"): 2, (2, "B"): 5, (3, "B"): 3, (3, "OPENING-7"): 7}
    assert sum(v.discount_c for k, v in got.items() if k[0] == 1) == 300
    assert all(v.total_c == v.quantity * v.price_c - v.discount_c for v in got.values())
    assert [tuple(r) for r in fefo.opening_lots(parts).select("item_key", "opening_units").collect()] == [(7, 7)]


def test_clean_sales_counts_reasons_and_merges(spark):
    raw = spark.createDataFrame(
        [("b1", "2024-01-01", "x", "2", "1,000.50", "5.00"), ("b1", "2024-01-01", "x", "1", "10.00", "99.00"), ("b2", "later", "x", "1", "1.00", ""), ("b3", "2024-01-02", "y", "0", "1.00", None), ("b4", "2024-01-02", "y", "1", "0.00", None), ("b5", "2024-01-02", " ", "1", "1.00", None)],
        "`Bill No` string, `Bill Date` string, `Item Code` string, Qty string, Rate string, Disc string",
    )
    mapping = ingest.suggest_mapping(raw.columns)
    assert mapping == {"transaction_date": "Bill Date", "item_id": "Item Code", "quantity": "Qty", "unit_price": "Rate", "transaction_id": "Bill No", "discount": "Disc"}
    good = spark.createDataFrame([(f"c{k}", f"2024-01-0{1 + k % 3}", "z", "1", "0.01", "9.00") for k in range(30)], raw.schema)
    sales, reasons, items, report = ingest.clean_sales(raw.union(good), mapping, least_rows=1)
    assert {r.reason: r.n for r in reasons.collect()} == {"kept": 32, "no date": 1, "bad quantity": 1, "bad price": 1, "no item": 1, "merged into one": 1}
    row = sales.where("item_id = 'x'").collect()
    assert len(row) == 1 and row[0].quantity == 3 and row[0].merged == 2
    # 2 x 1000.50 and 1 x 10.00 are 670.33 a unit; the total follows from it
    assert (row[0].price_c, row[0].discount_c, row[0].total_c) == (67033, 10400, 3 * 67033 - 10400)
    assert {r.total_c for r in sales.where("item_id = 'z'").collect()} == {0}  # a discount stops at the value of its line
    assert {r.item_id: (r.item_name, r.category) for r in items.collect()} == {k: (k, ingest.NO_CATEGORY) for k in "xz"}
    assert report["days"] == 3 and report["capabilities"]["association_rules"] and not report["capabilities"]["multi_site"]


def test_unusable_sales_files_are_refused(spark):
    columns = "d string, item string, qty string, price string, note string"
    rows = [(f"2024-01-{1 + k % 9:02d}", "x", "1", "1.00", None) for k in range(90)]
    mapping = {"transaction_date": "d", "item_id": "item", "quantity": "qty", "unit_price": "price"}
    with pytest.raises(ingest.UploadError, match="dates can't be read"):
        ingest.clean_sales(spark.createDataFrame(rows + [("31/31", "x", "1", "1.00", None)] * 10, columns), mapping)
    with pytest.raises(ingest.UploadError, match="at least 100"):
        ingest.clean_sales(spark.createDataFrame(rows, columns), mapping)
    with pytest.raises(ingest.UploadError, match="no column for item_id; quantity: no column 'units'"):
        ingest.clean_sales(spark.createDataFrame(rows, columns), {"transaction_date": "d", "quantity": "units", "unit_price": "price"})
    with pytest.raises(ingest.UploadError, match="over 40 characters"):
        ingest.clean_sales(spark.createDataFrame([*rows, ("2024-01-01", "x" * 41, "1", "1.00", None)] * 2, columns), mapping)
    # no transaction ids: equal lines are transactions of their own
    got = ingest.clean_sales(spark.createDataFrame(rows + rows, columns), mapping)
    assert got.sales.count() == 180 == got.sales.select("transaction_id").distinct().count() and not got.report["capabilities"]["association_rules"]


def test_clean_purchases(spark):
    sales = spark.createDataFrame([("2024-02-01", "A"), ("2024-03-01", "A")], "d string, site_id string").withColumn("d", F.to_date("d"))
    raw = spark.createDataFrame(
        [
            ("2024-01-01", "x", "4", "1.00", "b", "2024-12-01", "Zed"), ("2024-02-05", "x", "2", "4.00", "b", "2024-11-01", "Zed"), ("2024-02-05", "y", "1", "1.00", "c", "2024-12-01", ""),
            ("2024-02-05", "x", "1", "1.00", "c", "2024-12-01", "Abe"), ("2024-02-06", "y", "1", "1.00", "", "", "Abe"), ("2024-02-06", "y", "1", "1.00", "", "", "Abe"), ("2024-01-01", "y", "1", "1.00", "e", "2024-02-01", "Abe"),
            ("2024-03-02", "y", "1", "1.00", "f", "2024-12-01", "Abe"), ("2024-02-05", "", "1", "1.00", "f", "2024-12-01", "Abe"), ("2024-02-05", "y", "0", "1.00", "f", "2024-12-01", "Abe"), ("2024-02-05", "y", "1", "x", "f", "2024-12-01", "Abe"),
            ("2024-02-05", "y", "1", "0", "f", "2024-12-01", "Abe"),
        ],
        "Received string, Item string, Qty string, Cost string, Lot string, Expiry string, Vendor string",
    )
    mapping = ingest.suggest_mapping(raw.columns, ingest.PURCHASE_SYNONYMS)
    receipts, lots, suppliers, reasons = ingest.clean_purchases(raw, mapping, sales)
    assert {r.reason: r.n for r in reasons.collect()} == {"kept": 6, "expired when received": 1, "after the last sale": 1, "no item": 1, "bad quantity": 1, "no number": 1, "bad cost": 1}
    assert {r.site_id for r in receipts.collect()} == {"A"} and str(receipts.agg(F.min("d")).first()[0]) == "2024-02-01"
    lot = {r.batch_id: r for r in lots.collect()}
    assert (lot["b"].quantity, lot["b"].cost_c, str(lot["b"].expires), lot["b"].differing_expiry) == (6, 200, "2024-11-01", True)
    assert {"b", "c-x", "c-y"} < set(lot) and sum(k.startswith("L-") for k in lot) == 2 and len(lot) == 5
    assert sorted(tuple(r) for r in suppliers.collect()) == [("SUP0001", "Abe"), ("SUP0002", ingest.NO_SUPPLIER), ("SUP0003", "Zed")]
    with pytest.raises(ingest.UploadError, match="several sites"):
        ingest.clean_purchases(raw, mapping, sales.union(sales.withColumn("site_id", F.lit("B"))))
    with pytest.raises(ingest.UploadError, match="expiry dates can't be read"):
        ingest.clean_purchases(raw.withColumn("Expiry", F.lit("soon")), mapping, sales)


def test_keys_and_dimensions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("natural"), F.lit("x").alias("other")).repartition(7)
    assert sorted(tuple(r) for r in with_key(df, "natural", "sk").collect()) == [(k + 1, k, "x") for k in range(1000)]
    sf = "/root/testdata/sf0.001"
    tables = {t: read(spark, sf, t) for t in ("part", "region", "supplier", "nation")}
    made = build_dimensions(roles(spark, sf), **tables)
    assert made["item"].count() == tables["part"].count() and made["batch"].where("batch_sk is null or item_sk is null").isEmpty()
    with pytest.raises(ValueError, match="supplier: null or unresolved key in area"):
        build_dimensions(roles(spark, sf), **tables | {"nation": tables["nation"].where("n_nationkey > 3")})


@pytest.mark.parametrize(("closing", "units", "status"), [(90, 30, "NORMAL"), (91, 30, "OVERSTOCK"), (0, 30, "OUT_OF_STOCK"), (6, 30, "LOW_STOCK"), (5, 0, "NO_DEMAND")])
def test_overstock_boundary_is_exact(spark, closing, units, status):
    rows = [(1, "s", "m", "f", d, closing, closing * 10, units if d == 100 else 0) for d in range(71, 101)]
    stock = spark.createDataFrame(rows, "site_key long, site string, maker string, family string, day_no long, closing long, value_c long, sold long")
    assert current_stock(stock).first().stock_status == status


def test_admission_rejected_events_do_not_count(spark):
    assert admit([0, 1, 2, 12, 13], [], 2, 10)[0] == [True, True, False, True, True]
    assert admit([0, 0, 0], [], 0, 10)[0] == [True, True, True]
    base = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame([(k, i, base + dt.timedelta(seconds=s)) for k in (1, 2) for i, s in enumerate((0, 1, 2, 12, 13))], "key long, event_id long, ts timestamp")
    got = {(r.key, r.event_id): r.admitted for r in admission(events, 2, 10).collect()}
    assert [got[1, i] for i in range(5)] == [got[2, i] for i in range(5)] == [True, True, False, True, True]


def test_streams_agree_with_batch(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame([(k, i, base + dt.timedelta(seconds=s)) for k in (1, 2) for i, s in enumerate((0, 1, 2, 12, 13))], "key long, event_id long, ts timestamp")
    events.write.parquet(str(tmp_path / "events"))
    stream = admission_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")), 2, 10)
    query = stream.writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "c1")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("admitted").collect())) == sorted(map(tuple, admission(events, 2, 10).collect()))
    days = spark.createDataFrame([(1, d, 0 if d else 5) for d in range(12)], "key long, day_no long, sold long")
    days.write.parquet(str(tmp_path / "days"))
    stream = run_onset_stream(spark.readStream.schema(days.schema).parquet(str(tmp_path / "days")))
    query = stream.writeStream.format("memory").queryName("runs").option("checkpointLocation", str(tmp_path / "c2")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [tuple(r) for r in spark.table("runs").collect()] == [(1, 7)]


def test_strict_source_and_mart_round_trip(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,price,n\n1,2.50,3\n2,2.5,x\n2,1.00,\n")
    contract = {"id": "int", "price": "money", "n": "int"}
    df = io.read_source(spark, str(tmp_path / "a.csv"), contract)
    broken = {r.rule: r.n for r in io.violations(df, contract, ["id"]).collect() if r.n}
    assert broken == {"price: not money": 1, "n: not int": 1, "n: empty": 1, "key: repeated": 1}
    with pytest.raises(ValueError, match="columns"):
        io.read_source(spark, str(tmp_path / "a.csv"), {"id": "int"})
    assert io.preview(spark, str(tmp_path / "a.csv"), 2).count() == 2
    mart = str(tmp_path / "mart")
    io.write_mart({"t": df, "u": df.limit(1)}, mart)
    io.write_mart({"t": df}, mart)
    back = io.read_mart(spark, mart, ["t"])["t"]
    assert io.fingerprint(back).first() == io.fingerprint(df.repartition(3)).first()
    log = io.run_reports(spark, {"good": lambda: df, "bad": lambda: df.select("nothing")}, str(tmp_path / "reports"))
    assert {r.name: r.status[:2] for r in log.collect()}["good"] == "OK" and log.count() == 2
    assert io.load_report(spark, str(tmp_path / "reports"), "good", "id = 1", ["price"]).collect()[0].price == "2.50"
    io.export({"good": df.select(F.struct("id").alias("s"))}, str(tmp_path / "out"), {"rows": 3})
    assert spark.read.text(str(tmp_path / "out" / "summary")).first().value == '{"rows": 3}'
    assert io.template(df.schema) == "id,price,n"


def test_isolation_forest_ranks_outliers_first(spark):
    rng = np.random.default_rng(0)
    rows = [(i, *map(float, rng.normal(size=2))) for i in range(400)] + [(999, 12.0, -11.0)]
    got = models.isolation_forest(spark.createDataFrame(rows, "id long, a double, b double"), ["id"], ["a", "b"], trees=50)
    assert got.orderBy(F.desc("isolation_score")).first().id == 999
    assert got.where("is_isolation_anomaly").count() <= 8


def test_segments_and_preparation(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(i % 3 * 10 + rng.normal()), float(i % 3 * 10 + rng.normal() * 2), 1.0, float(np.exp(rng.normal() * 2))) for i in range(120)]
    df = spark.createDataFrame(rows, "item_key long, units double, close double, flat double, wide double")
    vectors, kept, report = models.prepare_features(df, "item_key", ["units", "close", "flat", "wide"])
    assert "flat" not in kept and "units" in kept and {r["feature"]: r["logged"] for r in report}["wide"]
    runs = segmentation.fit_all(vectors, "item_key", range(2, 5))
    quality = segmentation.quality(vectors, runs)
    assert sum(q[-1] for q in quality) == 1 and all(a[2] >= b[2] for a, b in zip(quality, quality[1:]))
    assert segmentation.assigned(vectors, "item_key", runs[3]).select("center").distinct().count() == 3
