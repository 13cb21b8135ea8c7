"""Fitted models: isolation forest, preparation and plane of features; errors and intervals of forecasts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.views import mid_ranks
from ..sources.io import stored

#: Rows that a tree of the forest grows from, and the surplus that is drawn so that chance leaves it enough.
SAMPLE_ROWS, SURPLUS = 4096, 1.25


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of every value (the public splitmix64 finaliser)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _path_length(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else 1.0


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, limit: int) -> list:
    """A random tree as nested lists [feature, cut, left, right], or the depth that a leaf stands for."""
    spread = x.max(0) - x.min(0) if len(x) else np.zeros(1)
    usable = np.flatnonzero(spread > 0)
    if depth >= limit or len(x) <= 1 or not len(usable):
        return [depth + _path_length(len(x))]
    f = int(rng.choice(usable))
    cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    left = x[:, f] < cut
    return [f, cut, _grow(x[left], rng, depth + 1, limit), _grow(x[~left], rng, depth + 1, limit)]


def _depths(tree: list, x: np.ndarray, out: np.ndarray, rows: np.ndarray) -> None:
    if len(tree) == 1:
        out[rows] += tree[0]
        return
    left = x[rows, tree[0]] < tree[1]
    _depths(tree[2], x, out, rows[left])
    _depths(tree[3], x, out, rows[~left])


def grown_forest(known: DataFrame, keys: list[str], features: list[str], trees: int, sample: int) -> tuple[list[list], int]:
    """The trees, and the rows that each was grown from.

    One pass draws for every tree the rows whose hash with the tree's number is low enough; the rows of a tree, a bounded number, meet
    in one task that grows it from the `sample` of least hash. Only trees come back, whose size `sample` bounds. Hashes come from the
    rows' values, so neither order nor partitions matter.
    """
    n = known.count()
    size = min(sample, n)
    if not size:
        return [], 0
    limit = np.uint64(min(1.0, SURPLUS * sample / n) * (2**64 - 1025))
    numbers = _mixed(np.arange(trees, dtype=np.uint64))
    columns = [f"f{k}" for k in range(len(features))]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own, x = batch["h"].to_numpy().astype(np.int64).view(np.uint64), batch[columns]
            for t in range(trees):
                drawn = _mixed(own ^ numbers[t])
                at = np.flatnonzero(drawn <= limit)
                yield x.iloc[at].assign(tree=np.int32(t), drawn=drawn[at].view(np.int64))

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(order=rows["drawn"].to_numpy().view(np.uint64)).sort_values(["order", *columns]).head(size)
        t = int(rows["tree"].iloc[0])
        tree = _grow(rows[columns].to_numpy(float), np.random.default_rng(t), 0, int(np.ceil(np.log2(max(size, 2)))))
        return pd.DataFrame({"tree": [t], "grown": [json.dumps(tree)]})

    shown = known.select(F.xxhash64(*keys, *features).alias("h"), *(F.col(c).alias(k) for c, k in zip(features, columns)))
    drawn = shown.mapInPandas(draw, ", ".join(f"{c} double" for c in columns) + ", tree int, drawn long")
    found = drawn.groupBy("tree").applyInPandas(grow, "tree int, grown string").orderBy("tree").collect()
    return [json.loads(r["grown"]) for r in found], size


def isolation_forest(df: DataFrame, keys: list[str], features: list[str], trees: int = 200, sample: int = SAMPLE_ROWS, share: float = 0.01) -> DataFrame:
    """keys, isolation_score and is_isolation_anomaly: the share of rows with the highest scores.

    Scoring is a map over all rows; the cut is one percentile. Null features are 0. An empty table gives no rows.
    """
    known = df.select(*keys, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features))
    forest, size = grown_forest(known, keys, features, trees, sample)
    norm = max(_path_length(size), 1e-9)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values, total = batch[features].to_numpy(float), np.zeros(len(batch))
            for tree in forest:
                _depths(tree, values, total, np.arange(len(batch)))
            yield batch[keys].assign(isolation_score=np.power(2.0, -total / max(len(forest), 1) / norm))

    scored = known.mapInPandas(score, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in known.schema if f.name in keys) + ", isolation_score double")
    cut = scored.agg(F.percentile("isolation_score", 1 - share).alias("cut"))
    return scored.crossJoin(F.broadcast(cut)).withColumn("is_isolation_anomaly", F.col("isolation_score") >= F.col("cut")).drop("cut")


#: Cover in days that a missing one stands for and that others are capped at.
COVER_CAP = 365.0


def prepare_features(df: DataFrame, key: str, features: list[str]) -> tuple[DataFrame, list[str], list[dict]]:
    """(key and array `vector` of standardised features, features used, report of what was filled, logged and dropped and why).

    Missing values are 0, missing covers COVER_CAP, which also caps them; log1p where nothing is negative and the skewness is over 1;
    constants go, and features whose rank correlation with one that is kept is over 0.9. Deviations are those of the population. An
    empty table keeps no feature.
    """
    fill = {c: COVER_CAP if c == "days_of_inventory" else 0.0 for c in features}
    value = {c: F.coalesce(F.col(c).cast("double"), F.lit(fill[c])) for c in features}
    value = {c: F.least(v, F.lit(COVER_CAP)) if c == "days_of_inventory" else v for c, v in value.items()}
    filled = stored(df.select(key, *(v.alias(c) for c, v in value.items()), *(F.col(c).isNull().cast("int").alias(f"_no_{c}") for c in features)), "item-values")
    stats = filled.agg(
        *(F.skewness(c).alias(f"s_{c}") for c in features), *(F.stddev_pop(c).alias(f"d_{c}") for c in features), *(F.min(c).alias(f"m_{c}") for c in features), *(F.sum(f"_no_{c}").alias(f"n_{c}") for c in features),
    ).first()
    varied = [c for c in features if (stats[f"d_{c}"] or 0) > 0]
    logged = {c for c in varied if abs(stats[f"s_{c}"] or 0) > 1 and stats[f"m_{c}"] >= 0}
    shaped = stored(filled.select(key, *(F.log1p(c).alias(c) if c in logged else F.col(c) for c in varied)), "item-features")
    ranks = mid_ranks(shaped, key, varied) if varied else shaped
    pairs = [(a, b) for i, b in enumerate(varied) for a in varied[:i]]
    corr = ranks.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs)).first() if pairs else {}
    kept: list[str] = []
    reasons = {c: "constant" for c in features if c not in varied}
    for c in varied:
        near = {a: abs(corr[f"{a}|{c}"] or 0) for a in kept}
        partner = max(near, key=near.get, default=None)
        if partner and near[partner] > 0.9:
            reasons[c] = f"redundant with {partner}"
        else:
            kept.append(c)
    scale = shaped.agg(*(F.avg(c).alias(f"a_{c}") for c in kept), *(F.stddev_pop(c).alias(f"d_{c}") for c in kept)).first() if kept else {}
    vector = F.array(*((F.col(c) - scale[f"a_{c}"]) / scale[f"d_{c}"] for c in kept)) if kept else F.array().cast("array<double>")
    report = [{"feature": c, "skewness": float(stats[f"s_{c}"] or 0), "filled": int(stats[f"n_{c}"] or 0), "logged": c in logged, "kept": c in kept, "reason": reasons.get(c)} for c in features]
    return shaped.select(key, vector.alias("vector")), kept, report


def principal_plane(vectors: DataFrame, k: int = 2) -> list[tuple[int, float, list[float]]]:
    """(component, share of variance explained, loadings with the largest one positive)."""
    model = PCA(k=k, inputCol="point", outputCol="plane").fit(vectors.select(array_to_vector("vector").alias("point")))
    loadings = np.array(model.pc.toArray()).T
    return [(i + 1, float(v), (c if max(c, key=abs) >= 0 else -c).tolist()) for i, (v, c) in enumerate(zip(model.explainedVariance.toArray(), loadings))]


def metrics(df: DataFrame, by: list[str]) -> DataFrame:
    error = F.col("predicted") - F.col("target")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.try_divide(F.sum(F.abs(error)), F.sum("target")).alias("wape"), F.avg(error).alias("bias"),
    )


def intervals(validation: DataFrame, scored: DataFrame, bins: int = 5) -> DataFrame:
    """Bounds from the 10 and 90 % residual quantiles of validation rows in bins of the prediction."""
    edges = validation.agg(*(F.percentile("predicted", k / bins).alias(f"e{k}") for k in range(1, bins))).first()
    which = F.lit(0)
    for k in range(1, bins):
        which = which + F.when(F.col("predicted") > edges[f"e{k}"], 1).otherwise(0)
    residual = F.col("target") - F.col("predicted")
    bounds = validation.groupBy(which.alias("bin")).agg(F.percentile(residual, 0.1).alias("low"), F.percentile(residual, 0.9).alias("high"))
    return scored.withColumn("bin", which).join(F.broadcast(bounds), "bin", "left").withColumn("lower_bound", F.greatest(F.col("predicted") + F.col("low"), F.lit(0.0))).withColumn("upper_bound", F.col("predicted") + F.col("high")).drop("low", "high")
