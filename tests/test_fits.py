"""Distributed fits against plain numpy: boosted trees, k-means from many starts and its measures."""

import numpy as np
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from shelfwise.operators import models, segmentation
from shelfwise.operators import tree_boosting as boosting

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=3000), rng.integers(0, 5, 3000), rng.random(3000), rng.normal(size=3000)])
    x[rng.random(3000) < 0.1, 3] = np.nan
    mean = np.exp(0.8 * x[:, 0] + 0.3 * x[:, 1] + np.where(np.isnan(x[:, 3]), 1.0, 0.0))
    return x, rng.poisson(mean).astype(float)


def blocks_of(spark, x, y, partitions):
    rows = spark.createDataFrame([(i, *(None if np.isnan(v) else float(v) for v in r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "i long, a double, b double, c double, d double, y double").repartition(partitions)
    edges = boosting.bin_edges(rows, NAMES)
    uses = {"train": F.col("i") < 2000, "few": (F.col("i") < 2000) & (F.col("i") % 3 == 0), "none": F.col("i") < 0}
    return rows, edges, boosting.row_blocks(rows, NAMES, ["y"], uses, edges), list(uses)


SPECS = [
    boosting.Spec("y", "train", rounds=6, leaves=8, least_rows=20), boosting.Spec("y", "train", loss="poisson", rounds=4, leaves=6, least_rows=30, l2=1.0),
    boosting.Spec("y", "few", log_target=True, rounds=5, leaves=31, least_rows=10, depth=20), boosting.Spec("y", "none", rounds=2),
]


def plain_fit(bins, y, spec):
    """The same trees, each grown by looking for the best leaf again and again."""
    target = np.log1p(y) if spec.log_target else y
    exact = np.rint(target / boosting.STEP) * boosting.STEP
    margin = np.full(len(y), np.log(exact.mean()) if spec.loss == "poisson" else exact.mean())
    trees = []
    for _ in range(spec.rounds):
        g = np.exp(margin) - y if spec.loss == "poisson" else margin - target
        h = np.rint(np.exp(margin) / boosting.STEP) * boosting.STEP if spec.loss == "poisson" else np.ones(len(y))
        g = np.rint(g / boosting.STEP) * boosting.STEP
        leaves = [(np.arange(len(y)), 0)]
        splits = []
        while len(leaves) < spec.leaves:
            best = None
            for k, (rows, depth) in enumerate(leaves):
                if depth >= spec.most_depth:
                    continue
                for f in range(len(bins)):
                    for cut in np.unique(bins[f, rows])[:-1]:
                        on = bins[f, rows] <= cut
                        if on.sum() < spec.least_rows or (~on).sum() < spec.least_rows:
                            continue
                        parts = [rows[on], rows[~on], rows]
                        a, b, whole = (g[r].sum() ** 2 / (h[r].sum() + spec.l2) for r in parts)
                        if a + b - whole > 0 and (best is None or a + b - whole > best[0]):
                            best = a + b - whole, k, f, int(cut), parts, depth
            if best is None:
                break
            _, k, f, cut, (a, b, _), depth = best
            splits.append((f, cut))
            leaves[k : k + 1] = [(a, depth + 1), (b, depth + 1)]
        for rows, _ in leaves:
            margin[rows] -= spec.rate * g[rows].sum() / (h[rows].sum() + spec.l2)
        trees.append(sorted(splits))
    return margin, trees


def test_trees_equal_plain_ones(spark, data):
    x, y = data
    rows, edges, blocks, uses = blocks_of(spark, x, y, 3)
    models = boosting.fit(blocks, NAMES, edges, ["y"], uses, SPECS)
    bins = boosting.binned(x, edges)
    index = np.arange(3000)
    for spec, model, used in zip(SPECS[:3], models, (index < 2000, index < 2000, (index < 2000) & (index % 3 == 0))):
        margin, trees = plain_fit(bins[:, used], y[used], spec)
        assert [sorted((int(f), int(c)) for f, c in zip(t[0], t[1]) if f >= 0) for t in model.trees] == trees
        assert np.allclose(model.margin(bins)[used], margin, rtol=1e-9, atol=1e-9)
        # a row's prediction by walking the trees node by node
        for r in (0, 7, 2999):
            walked = model.start
            for feature, cut, left, right, value in model.trees:
                at = 0
                while feature[at] >= 0:
                    at = left[at] if bins[feature[at], r] <= cut[at] else right[at]
                walked += value[at]
            assert model.margin(bins[:, r : r + 1])[0] == pytest.approx(walked, rel=1e-12)
        counts = np.bincount(boosting.leaf_of(model.trees[0], bins[:, used]))
        assert counts[counts > 0].min() >= spec.least_rows
    assert models[3].trees[0][0].tolist() == [-1] and models[3].predict(x).tolist() == [0.0] * 3000
    got = {r.i: r.predicted for r in boosting.predict(models[1], rows, ["i"]).collect()}
    want = models[1].predict(x)
    assert all(got[i] == pytest.approx(want[i]) for i in range(3000))


def test_fits_dont_depend_on_partitions_and_learn(spark, data, monkeypatch):
    x, y = data
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 100)
    monkeypatch.setattr(boosting, "CUT", 2)
    monkeypatch.setattr(boosting, "TREE_FROM", 5)
    spec = [boosting.Spec("y", "train", loss="poisson", rounds=30, leaves=15, least_rows=20)]
    fits = []
    for partitions in (2, 7):
        _, edges, blocks, uses = blocks_of(spark, x, y, partitions)
        fits.append(boosting.fit(blocks, NAMES, edges, ["y"], uses, spec)[0])
    assert all((np.array(a) == np.array(b)).all() for s, t in zip(fits[0].trees, fits[1].trees) for a, b in zip(s, t))
    held = np.arange(3000) >= 2000
    error = np.abs(fits[0].predict(x[held]) - y[held]).mean()
    assert error < 0.6 * np.abs(y[held] - np.median(y[~held])).mean()
    assert abs(fits[0].predict(x[~held]).mean() - y[~held].mean()) < 0.1 * y[~held].mean()


def test_permutation_importance_finds_what_matters(spark, data):
    x, y = data
    rows, edges, blocks, uses = blocks_of(spark, x, y, 2)
    model = boosting.fit(blocks, NAMES, edges, ["y"], uses, [boosting.Spec("y", "train", rounds=20, leaves=8, least_rows=20)])[0]
    rise = {r.feature: r.mae_rise for r in boosting.permutation_importance(model, rows.withColumn("target", F.col("y"))).collect()}
    assert set(rise) == set(NAMES) and rise["a"] > rise["b"] > rise["c"] and abs(rise["c"]) < 0.1 * rise["a"]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(n, 3)) + c for n, c in ((60, (0, 0, 0)), (90, (7, 0, 0)), (40, (0, 8, 1)), (30, (6, 7, -5)))])
    x = np.rint(x / segmentation.STEP) * segmentation.STEP
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<double>").repartition(3)


def test_all_starts_and_all_numbers_at_once(spark, points):
    x, df = points
    passes = []
    real = segmentation._sums

    def counted(*args):
        passes.append(len(args[1]))
        return real(*args)

    segmentation._sums = counted
    try:
        runs = segmentation.fit_all(df, "id", range(2, 6), starts=20)
    finally:
        segmentation._sums = real
    assert set(passes) == {20 * (2 + 3 + 4 + 5)} and len(passes) < 60
    for k, run in runs.items():
        away = ((x[:, None] - run.centers[None]) ** 2).sum(2)
        near = away.argmin(1)
        assert run.cost == pytest.approx(away.min(1).sum(), rel=1e-6)
        # a fixed point of the plain iteration
        assert np.allclose(run.centers, [x[near == c].mean(0) for c in range(k)], atol=1e-6)
    assert sorted(np.bincount(((x[:, None] - runs[4].centers[None]) ** 2).sum(2).argmin(1))) == [30, 40, 60, 90]
    again = segmentation.fit_all(df.repartition(5), "id", range(2, 6), starts=20)
    assert all((again[k].centers == runs[k].centers).all() and again[k].cost == runs[k].cost for k in runs)


def test_measures_of_segments(spark, points):
    x, df = points
    runs = segmentation.fit_all(df, "id", range(2, 6), starts=5)
    for k, _, cost, silhouette, harabasz, bouldin, smallest, largest, _ in segmentation.quality(df, runs):
        near = ((x[:, None] - runs[k].centers[None]) ** 2).sum(2).argmin(1)
        labelled = segmentation.assigned(df, "id", runs[k]).join(df, "id").select(array_to_vector("vector").alias("features"), F.col("center").alias("prediction"))
        assert silhouette == pytest.approx(ClusteringEvaluator().evaluate(labelled), rel=1e-6)
        means = np.array([x[near == c].mean(0) for c in range(k)])
        sizes = np.bincount(near)
        between, within = (sizes[:, None] * (means - x.mean(0)) ** 2).sum(), ((x - means[near]) ** 2).sum()
        assert harabasz == pytest.approx(between / (k - 1) / (within / (len(x) - k)), rel=1e-6) and cost == pytest.approx(within, rel=1e-6)
        s = np.array([np.linalg.norm(x[near == c] - means[c], axis=1).mean() for c in range(k)])
        d = np.linalg.norm(means[:, None] - means[None], axis=2)
        assert bouldin == pytest.approx(np.mean([max((s[i] + s[j]) / d[i, j] for j in range(k) if j != i) for i in range(k)]), rel=1e-5)
        assert (smallest, largest) == (sizes.min(), sizes.max())


def test_few_and_no_rows(spark):
    none = spark.createDataFrame([], "id long, vector array<double>")
    assert segmentation.fit_all(none, "id") == {} and segmentation.quality(none, {}) == []
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)] + [(9, [3.0, 3.0])], "id long, vector array<double>")
    runs = segmentation.fit_all(same, "id")
    assert set(runs) == {2} and runs[2].cost == 0.0 and segmentation.quality(same, runs)[0][-1]


def test_isolation_trees_grow_where_their_rows_are(spark):
    rng = np.random.default_rng(3)
    rows = [(i, *map(float, rng.normal(size=2))) for i in range(3000)] + [(9000, 15.0, -12.0), (9001, None, 30.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    one, other = (models.isolation_forest(df.repartition(p), ["id"], ["a", "b"], trees=30, sample=128) for p in (2, 7))
    scores = {r.id: r.isolation_score for r in one.collect()}
    assert scores == {r.id: r.isolation_score for r in other.collect()}
    ranked = sorted(scores, key=scores.get)
    assert ranked[-1] == 9000 and 9001 in ranked[-30:]
    forest, size = models.grown_forest(df.na.fill(0.0).repartition(3), ["id"], ["a", "b"], 30, 128)
    assert size == 128 and len(forest) == 30 and len({str(t) for t in forest}) == 30
    assert models.isolation_forest(df.limit(0), ["id"], ["a", "b"]).count() == 0 and models.isolation_forest(df.limit(5), ["id"], ["a", "b"], trees=5).count() == 5
