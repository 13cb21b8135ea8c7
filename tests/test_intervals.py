"""Bucketed joins against all pairs."""

import numpy as np
from pyspark.sql import functions as F

from shelfwise.operators.intervals import band_join, overlap_join


def test_pairs_within_reach_once(spark):
    rng = np.random.default_rng(1)
    left, right = ([(int(k), int(v), i) for i, (k, v) in enumerate(zip(rng.integers(0, 3, n), rng.integers(-100, 100, n)))] for n in (80, 120))
    a = spark.createDataFrame([*left, (None, 5, 900), (1, None, 901)], "k long, v long, i long")
    b = spark.createDataFrame([*right, (None, 5, 900), (1, None, 901)], "k long, w long, j long")
    for reach in (1, 7, 30):
        got = sorted((r.i, r.j) for r in band_join(a, b, ["k"], "v", "w", reach).collect())
        assert got == sorted((i, j) for k, v, i in left for m, w, j in right if k == m and abs(v - w) <= reach)
    plan = band_join(a, b, ["k"], "v", "w", 7)._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_overlaps_once(spark):
    rng = np.random.default_rng(2)

    def spans(n):
        first = rng.integers(-50, 150, n)
        return [(int(k), int(s), int(s + d), i) for i, (k, s, d) in enumerate(zip(rng.integers(0, 2, n), first, rng.integers(-2, 60, n)))]

    left, right = spans(70), spans(90)
    a = spark.createDataFrame(left, "k long, s long, e long, i long")
    b = spark.createDataFrame(right, "k long, t long, f long, j long")
    want = sorted((i, j) for k, s, e, i in left for m, t, f, j in right if k == m and s <= e and t <= f and s <= f and t <= e)
    for width in (1, 10, 500):
        assert sorted((r.i, r.j) for r in overlap_join(a, b, ["k"], ("s", "e"), ("t", "f"), width).collect()) == want
    assert overlap_join(a.withColumn("s", F.lit(None).cast("long")), b, ["k"], ("s", "e"), ("t", "f"), 10).count() == 0
