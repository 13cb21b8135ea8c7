"""K-means for every number of segments from many starts at once, and the quality of each number, in few passes over the rows.

The centres of all starts and all numbers of segments are carried together: a pass assigns every row to the nearest centre of each run
and adds up rows, vectors and squared distances by centre, one row of sums for each centre and task. So an iteration is one aggregation
whatever the number of runs, and runs that have settled are left out of it. Vectors are whole multiples of 2^-20, so sums don't depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STARTS, KS, SEED_ROWS, STEP = 20, range(2, 9), 4096, 2.0**-20
MOST_ROUNDS, LEAST_K, NEAR_BEST = 100, 3, 0.02


@dataclass(frozen=True)
class Run:
    """One fit: number of segments, start, centres and the sum of squared distances to them."""

    k: int
    start: int
    centers: np.ndarray
    cost: float


def _seeded(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++: each next centre is a row of the sample with a chance by its squared distance to those before."""
    centers = [sample[rng.integers(len(sample))]]
    away = ((sample - centers[0]) ** 2).sum(1)
    for _ in range(k - 1):
        total = away.sum()
        at = rng.choice(len(sample), p=away / total) if total > 0 else rng.integers(len(sample))
        centers.append(sample[at])
        away = np.minimum(away, ((sample - centers[-1]) ** 2).sum(1))
    return np.array(centers)


def _matrix(batch: pd.DataFrame) -> np.ndarray:
    return np.rint(np.stack(batch["vector"].to_numpy()).astype(float) / STEP) * STEP


def _squared(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)[None], 0.0)


def _sums(vectors: DataFrame, centers: np.ndarray, bounds: list[int], moving: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, sums of vectors and of squared distances of each centre; the centres of a run are those between two bounds. moving: runs to do, others stay zero."""
    p = centers.shape[1]
    spans = [(bounds[r], bounds[r + 1]) for r in (range(len(bounds) - 1) if moving is None else moving)]
    columns = ["n", "cost", *(f"s{k}" for k in range(p))]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(centers), 2 + p))
        for batch in batches:
            x = _matrix(batch)
            rows = np.arange(len(x))
            for a, b in spans:
                # run by run, so that distances stay in the processor's cache
                away = _squared(x, centers[a:b])
                near = away.argmin(1)
                total[a:b, 0] += np.bincount(near, minlength=b - a)
                total[a:b, 1] += np.bincount(near, np.rint(away[rows, near] / STEP) * STEP, b - a)
                for k in range(p):
                    total[a:b, 2 + k] += np.bincount(near, x[:, k], b - a)
        yield pd.DataFrame(total, columns=columns).assign(center=np.arange(len(centers)))

    rows = vectors.select("vector").mapInPandas(add, ", ".join(f"{c} double" for c in columns) + ", center int")
    found = rows.groupBy("center").agg(*(F.sum(c).alias(c) for c in columns)).toPandas().sort_values("center")
    if not len(found):
        return np.zeros(len(centers)), np.zeros_like(centers), np.zeros(len(centers))
    return found["n"].to_numpy(), found[columns[2:]].to_numpy(), found["cost"].to_numpy()


def fit_all(vectors: DataFrame, key: str, ks: range = KS, starts: int = STARTS) -> dict[int, Run]:
    """For each k the run of least cost of all starts (the first in a tie). vectors: key and an array of doubles, `vector`.

    Starts are seeded from at most SEED_ROWS rows, the first by a hash of their key; all else takes every row. A centre without rows
    stays where it is. A run goes on until none of its centres moves, MOST_ROUNDS passes at most. k goes no further than the sample has
    distinct rows; an empty table gives no runs.
    """
    sample = vectors.select(key, "vector").orderBy(F.xxhash64(key), key).limit(SEED_ROWS).toPandas()
    if not len(sample):
        return {}
    sample = np.unique(_matrix(sample), axis=0)
    runs = [(k, s) for k in ks if k <= len(sample) for s in range(starts)]
    if not runs:
        return {}
    centers = np.concatenate([_seeded(sample, k, np.random.default_rng([k, s])) for k, s in runs])
    bounds = np.cumsum([0, *(k for k, _ in runs)]).tolist()
    spans = list(zip(bounds, bounds[1:]))
    costs, moving = [0.0] * len(runs), list(range(len(runs)))
    for _ in range(MOST_ROUNDS):
        # a run whose centres stay where they are would stay for ever: rows are only held against the others
        n, sums, cost = _sums(vectors, centers, bounds, moving)
        moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
        away = np.abs(moved - centers).max(1)
        for r in moving:
            costs[r] = float(cost[slice(*spans[r])].sum())
        if away.max() <= 1e-9:
            break
        centers = moved
        moving = [r for r in moving if away[slice(*spans[r])].max() > 0]
    out: dict[int, Run] = {}
    for (k, s), a, b, c in zip(runs, bounds, bounds[1:], costs):
        if k not in out or c < out[k].cost:
            out[k] = Run(k, s, centers[a:b], c)
    return out


def quality(vectors: DataFrame, runs: dict[int, Run]) -> list[tuple]:
    """(k, start, cost, silhouette, calinski_harabasz, davies_bouldin, smallest, largest, chosen) of each number of segments.

    The silhouette is that of squared distances, whose means over a segment follow from its rows, sum and sum of squares. Two passes for
    all numbers together. Chosen is the least k from LEAST_K on within NEAR_BEST of the best silhouette among those.
    """
    if not runs:
        return []
    centers = np.concatenate([r.centers for r in runs.values()])
    bounds = np.cumsum([0, *runs]).tolist()
    n, sums, cost = _sums(vectors, centers, bounds)
    means = sums / np.maximum(n, 1)[:, None]
    # mean squared distance of a segment's rows to their mean
    spread = np.maximum(cost / np.maximum(n, 1) - ((means - centers) ** 2).sum(1), 0.0)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(centers), 2))
        for batch in batches:
            x = _matrix(batch)
            away, to_mean = _squared(x, centers), _squared(x, means)
            rows = np.arange(len(x))
            for a, b in zip(bounds, bounds[1:]):
                near = away[:, a:b].argmin(1)
                size = n[a:b]
                # mean squared distance to the rows of each segment, the row itself left out of its own
                each = np.where(size > 0, to_mean[:, a:b] + spread[a:b], np.inf)
                own = each[rows, near] * size[near] / np.maximum(size[near] - 1, 1)
                each[rows, near] = np.inf
                other = each.min(1)
                score = np.where(size[near] > 1, (other - own) / np.maximum(np.maximum(own, other), 1e-300), 0.0)
                total[a:b, 0] += np.bincount(near, score, b - a)
                total[a:b, 1] += np.bincount(near, np.sqrt(to_mean[rows, a + near]), b - a)
        yield pd.DataFrame(total, columns=["silhouette", "away"]).assign(center=np.arange(len(centers)))

    found = vectors.select("vector").mapInPandas(add, "silhouette double, away double, center int").groupBy("center").agg(F.sum("silhouette").alias("silhouette"), F.sum("away").alias("away")).toPandas().sort_values("center")
    rows_all = n[bounds[0] : bounds[1]].sum()
    whole = sums[bounds[0] : bounds[1]].sum(0) / max(rows_all, 1)
    out = []
    for (k, run), a, b in zip(runs.items(), bounds, bounds[1:]):
        size, mean = n[a:b], means[a:b]
        between = float((size[:, None] * (mean - whole) ** 2).sum())
        within = float((spread[a:b] * size).sum())
        near = found["away"].to_numpy()[a:b] / np.maximum(size, 1)
        apart = np.sqrt(_squared(mean, mean))
        np.fill_diagonal(apart, np.inf)
        used = size > 0
        worst = ((near[:, None] + near[None]) / np.maximum(apart, 1e-300))[used][:, used]
        harabasz = float(between / (k - 1) / (within / max(rows_all - k, 1))) if within > 0 else float("inf")
        out.append((k, run.start, run.cost, float(found["silhouette"].to_numpy()[a:b].sum() / max(rows_all, 1)), harabasz, float(worst.max(1).mean()) if used.sum() > 1 else 0.0, int(size.min()), int(size.max())))
    candidates = [r for r in out if r[0] >= LEAST_K] or out
    best = max(r[3] for r in candidates)
    chosen = min(r[0] for r in candidates if r[3] >= best - NEAR_BEST)
    return [(*r, r[0] == chosen) for r in out]


def assigned(vectors: DataFrame, key: str, run: Run) -> DataFrame:
    """key, number of the nearest centre and the distance to it; a map over the rows."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            away = _squared(_matrix(batch), run.centers)
            at = away.argmin(1)
            yield batch[[key]].assign(center=at.astype(np.int32), distance=np.sqrt(away[np.arange(len(at)), at]))

    return vectors.select(key, "vector").mapInPandas(near, f"{key} {dict(vectors.dtypes)[key]}, center int, distance double")
