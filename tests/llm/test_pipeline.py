"""The pipeline on the smallest tables and on awkward ones: each stage against what it says it does."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfwise.llm import boosting, fertility, minhash, packing

SF = "/root/testdata/sf0.001"
PROSE = " ".join(f"The committee number {i} has published a report about growth of markets in region {i % 9}." for i in range(12))
LONG = " ".join(f"page{i % 977} line{i}" for i in range(30_000))
#: Columns whose names the operators use themselves.
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, _rows int, rows int, _kept boolean, kept boolean, row string, text_key string, hub long, label int, n int, salt int"


def awkward(spark, texts):
    return spark.createDataFrame([(i, t, None, "s", None, k, 1, True, False, "r", "k", 3, 1, 2, 4) for k, (i, t) in enumerate(texts)], CLASHING)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == columns
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        assert 0 < kept.count() <= before, name
        docs, before = kept, kept.count()
    assert minhash.near_duplicates(docs).where("not kept").count() == 0
    assert packing.pack_documents(docs).select("doc_id").distinct().count() == before


def test_run_is_the_stages_by_hand(spark):
    """The same decisions row by row: the forest, the rules, groups by brute force, then the pieces of what is left."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    forest = boosting.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = [r.doc_id for r in boosting.score_quality(docs, forest).where("predicted = 1").collect()]
    fine = {r.doc_id for r in fertility.quality_rules(docs).where("kept").collect()} & set(good)
    sets = {}
    for r in docs.where(F.col("doc_id").isin(sorted(fine))).collect():
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text).split()
        sets[r.doc_id] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    left = set(sets)
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                left.discard(b)  # chains of links end in their smallest id, which has no smaller neighbour
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert {r.doc_id for r in out.collect()} == left


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_awkward_tables(spark, name, stage):
    texts = [(1, PROSE), (1, PROSE), (2, PROSE + " tail"), (3, None), (4, ""), (5, " \n"), (None, PROSE), (None, None), (6, LONG), (7, "x" * 40_000)]
    docs = awkward(spark, texts)
    got = stage(spark, docs, SF)
    rows = got.collect()
    assert stage(spark, docs.limit(0), SF).count() == 0
    if name != "packing":
        assert got.columns == docs.columns and set(rows) <= set(docs.collect())
    if name == "quality_rules":
        assert {r.doc_id for r in rows} <= {1, 2, None} and not any(r.text is None or not r.text.strip() for r in rows)
    if name == "near_duplicates":
        assert sorted((r.doc_id or 0, r.text or "") for r in rows) == sorted([(1, PROSE), (3, ""), (4, ""), (5, " \n"), (0, PROSE), (0, ""), (6, LONG), (7, "x" * 40_000)])
        assert [r._rows for r in rows if r.doc_id == 1] in ([0], [1])
    if name == "packing":
        assert len({(r.doc_id, r.piece) for r in rows}) >= 8 and len(rows) == len({(r.sequence_id, r.offset) for r in rows})


def test_repeated_ids_with_different_texts(spark):
    """Rows of one id are one document: 2 links what either text links, and one row of it stays whatever the rows' order."""
    other = " ".join(f"quite another text with item {i} and no common run" for i in range(30))
    texts = [(2, PROSE), (2, other), (5, other), (1, "alone " + " ".join(f"u{i}" for i in range(80))), (2, ""), (2, None)]
    seen = set()
    for order in (texts, texts[::-1]):
        docs = awkward(spark, order).repartition(3)
        groups = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()}
        assert groups == {(1, 1), (2, 2), (5, 2)}
        seen.add(tuple(sorted((r.doc_id, r.text or "~") for r in minhash.without_near_duplicates(docs).collect())))
    assert len(seen) == 1 and [k for k, t in next(iter(seen)) if t not in ("~", "")].count(2) == 1 and len(next(iter(seen))) == 4
