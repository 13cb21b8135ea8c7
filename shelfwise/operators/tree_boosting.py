"""Gradient-boosted trees fitted on all rows of a cluster: histograms by (node, feature, bin) are summed over partitions.

Rows are cut into blocks of small integers once: every feature's values are replaced by the number of their bin, whose edges are
quantiles. A pass over the blocks yields for each growing node, feature and bin the sums of gradients, second derivatives and rows; the
driver gets one such table, or one from each of a few tasks, whose size the parameters bound and not the data, and picks the splits. If
there are more tasks, others add up their sums first, a few features each. Several models that are fitted on
the same rows (targets, losses, parameters, subsets) grow in the same passes.

Trees grow leaf by leaf: of all leaves the one of the largest gain is split next. As a node's gain doesn't depend on when others are
split, a pass makes the histograms of all nodes that may still be chosen, and the leaf-wise order is followed between passes; of two
children the larger one's histogram is its parent's less its sister's. Gradients are whole multiples of 2^-16, so sums don't depend on
the order of rows.

Blocks are an RDD, for a pass is imperative work on arrays in a partition whose only result is a table that is added up; the rows'
predictions so far are kept with the blocks and written to the shared folder every CUT rounds, so a lost executor costs the rounds since.
"""

from __future__ import annotations

import gc
import heapq
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import stored

#: Most bins of a feature; bin 0 is that of null. Rows of a block. Rounds after which predictions are written and read again.
BINS, BLOCK_ROWS, CUT = 64, 8_192, 50
#: Gradients are multiples of it. Rows, times the models that use them, of a task of a pass. Tasks from which on executors add up the
#: tasks' sums in a stage of its own, and how many tasks add up.
STEP, TASK_ROWS, TREE_FROM, ADDERS = 2.0**-16, 131_072, 16, 4
LEAST_HESSIAN = 1e-3
LOSSES = ("squared", "poisson")


@dataclass(frozen=True)
class Spec:
    """One model of a fit: rows of the blocks whose column `use` is true, towards the column `target`.

    loss: squared, or poisson on a log scale; log_target: fits log(1 + target). least_rows: of a leaf; l2: added to the second derivative.
    depth: most splits above a leaf, which bounds the passes that a tree takes; 0 is the least that has room for `leaves`.
    """

    target: str
    use: str
    loss: str = "squared"
    log_target: bool = False
    rate: float = 0.1
    rounds: int = 200
    leaves: int = 31
    least_rows: int = 100
    l2: float = 0.0
    depth: int = 0

    @property
    def most_depth(self) -> int:
        return self.depth or max(1, int(np.ceil(np.log2(self.leaves))))


@dataclass
class Tree:
    """Nodes as arrays: feature (-1 for a leaf), last bin that goes left, children, value of a leaf (times the learning rate)."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, left_value: float, right_value: float) -> tuple[int, int]:
        n = len(self.feature)
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, n, n + 1
        for v in (left_value, right_value):
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(0)
            self.right.append(0)
            self.value.append(v)
        return n, n + 1

    def arrays(self) -> tuple[np.ndarray, ...]:
        return np.array(self.feature, np.int16), np.array(self.cut, np.uint8), np.array(self.left, np.int16), np.array(self.right, np.int16), np.array(self.value)


def _parted(tree: tuple[np.ndarray, ...], bins: np.ndarray, rows: np.ndarray, wanted: set[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """The leaves of a tree (those wanted, or all) with those of the rows (columns of bins) that end in them; other branches aren't followed."""
    feature, cut, left, right, _ = (a.tolist() for a in tree)
    on_the_way = None
    if wanted is not None:
        on_the_way = set(wanted)
        # a child's number is larger than its parent's
        for node in reversed(range(len(feature))):
            if feature[node] >= 0 and (left[node] in on_the_way or right[node] in on_the_way):
                on_the_way.add(node)
    todo = [(0, rows)]
    while todo:
        node, rows = todo.pop()
        if feature[node] < 0:
            yield node, rows
            continue
        goes_left = bins[feature[node]].take(rows) <= cut[node]
        for child, goes in ((left[node], goes_left), (right[node], ~goes_left)):
            if on_the_way is None or child in on_the_way:
                todo.append((child, rows[goes]))


def leaf_of(tree: tuple[np.ndarray, ...], bins: np.ndarray) -> np.ndarray:
    """The node that each row (a column of bins) ends in."""
    at = np.zeros(bins.shape[1], np.int16)
    for node, rows in _parted(tree, bins, np.arange(bins.shape[1])):
        at[rows] = node
    return at


@dataclass(frozen=True)
class Model:
    """A fitted model: edges of the features' bins, start and trees."""

    features: tuple[str, ...]
    edges: tuple[np.ndarray, ...]
    spec: Spec
    start: float
    trees: tuple[tuple[np.ndarray, ...], ...]

    def predict(self, values: np.ndarray) -> np.ndarray:
        """Of rows by features (null as nan): on the scale of the target, not below zero."""
        return self.shown(self.margin(binned(values, self.edges)))

    def margin(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(bins.shape[1], self.start)
        for tree in self.trees:
            out += tree[4][leaf_of(tree, bins)]
        return out

    def shown(self, margin: np.ndarray) -> np.ndarray:
        if self.spec.loss == "poisson":
            return np.exp(margin)
        return np.maximum(np.expm1(margin) if self.spec.log_target else margin, 0.0)


def binned(values: np.ndarray, edges: tuple[np.ndarray, ...]) -> np.ndarray:
    """Features by rows: 0 for null, else 1 + the edges below the value."""
    out = np.zeros((len(edges), len(values)), np.uint8)
    for k, e in enumerate(edges):
        known = ~np.isnan(values[:, k])
        out[k, known] = 1 + np.searchsorted(e, values[known, k], side="left")
    return out


def bin_edges(rows: DataFrame, features: list[str], bins: int = BINS) -> tuple[np.ndarray, ...]:
    """Approximate quantiles of each feature, without repeats: one row from an aggregate."""
    shares = [k / (bins - 1) for k in range(1, bins - 1)]
    found = rows.agg(*(F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(c) for c in features)).first()
    return tuple(np.unique(np.array(found[c] or [], float)) for c in features)


def row_blocks(rows: DataFrame, features: list[str], targets: list[str], uses: dict[str, Column], edges: tuple[np.ndarray, ...]) -> DataFrame:
    """Blocks of rows, stored: bins by feature, targets and which rows are of use to what, all as bytes of arrays."""
    shown = rows.select(*(F.col(c).cast("double").alias(f"f{k}") for k, c in enumerate(features)), *(F.col(c).cast("double").alias(f"t{k}") for k, c in enumerate(targets)), *(F.coalesce(c, F.lit(False)).alias(f"u{k}") for k, c in enumerate(uses.values())))

    n_features, n_targets, n_uses = len(features), len(targets), len(uses)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0

        def block() -> pa.RecordBatch:
            df = pd.concat(waiting)
            x = binned(df[[f"f{k}" for k in range(n_features)]].to_numpy(float), edges)
            y = df[[f"t{k}" for k in range(n_targets)]].to_numpy(float).T
            u = df[[f"u{k}" for k in range(n_uses)]].to_numpy(bool).T
            return pa.RecordBatch.from_pydict({"n": [len(df)], "bins": [x.tobytes()], "targets": [np.ascontiguousarray(y).tobytes()], "uses": [np.ascontiguousarray(u).tobytes()]})

        for batch in batches:
            waiting.append(batch.to_pandas())
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield block()
                waiting, n = [], 0
        if n:
            yield block()

    return stored(shown.mapInArrow(pack, "n long, bins binary, targets binary, uses binary"), "boosting-blocks")


def _gradients(spec: Spec, margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    if spec.loss == "poisson":
        mean = np.exp(margin)
        g, h = mean - y, np.rint(mean / STEP) * STEP
    else:
        g, h = margin - (np.log1p(y) if spec.log_target else y), None
    return np.rint(g / STEP) * STEP, h


def _settle() -> None:
    """Leaves what a worker has loaded out of the search for garbage that follows each of its tasks, as that takes longer than a pass."""
    if not gc.get_freeze_count():
        gc.freeze()


def _histograms(blocks: Iterator[dict], plans: list[tuple], targets: list[str], uses: list[str], widths: list[int], parts: list[range]) -> Iterator[tuple[int, list]]:
    """The partition's sums, by part of the features: for each model (g, h, rows) by waiting node, feature and bin; h is None if it is the rows.

    Sums leave with the last block; the end of the input, which comes about 40 ms after it, isn't waited for before.
    """
    _settle()
    starts, width = np.cumsum([0, *widths]), sum(widths)
    total = [None] * len(plans)
    for b in blocks:
        for m, plan in enumerate(plans):
            if plan is None:
                continue
            spec, tree, slots = plan
            if total[m] is None:
                total[m] = [np.zeros(len(slots) * width), np.zeros(len(slots) * width) if spec.loss == "poisson" else None, np.zeros(len(slots) * width, np.int64)]
            slot_of = {node: k for k, node in enumerate(slots.tolist())}
            found = [(slot_of[node], rows) for node, rows in _parted(tree, b["bins"], np.flatnonzero(b["uses"][uses.index(spec.use)]), set(slot_of))]
            rows = np.concatenate([r for _, r in found])
            g, h = _gradients(spec, b["margins"][m].take(rows), b["targets"][targets.index(spec.target)].take(rows))
            at = b["bins"].take(rows, axis=1).astype(np.int64)
            at += starts[:-1, None]
            at += np.repeat([k * width for k, _ in found], [len(r) for _, r in found])
            at, (sum_g, sum_h, n) = at.ravel(), total[m]
            sum_g += np.bincount(at, np.tile(g, len(widths)), len(sum_g))
            n += np.bincount(at, minlength=len(n))
            if h is not None:
                sum_h += np.bincount(at, np.tile(h, len(widths)), len(sum_h))
        if b["last"]:
            break
    for k, part in enumerate(parts):
        columns = slice(starts[part.start], starts[part.stop])
        yield k, [None if t is None else [None if x is None else x.reshape(-1, width)[:, columns] for x in t] for t in total]
    for _ in blocks:
        pass


def _itself(k: int) -> int:
    return k


def _merged(sums: Iterator[tuple[int, list]]) -> dict[int, list]:
    """The tables of each part of the features, added up."""
    found: dict[int, list] = {}
    for k, tables in sums:
        if k not in found:
            found[k] = tables
            continue
        for m, (a, b) in enumerate(zip(found[k], tables)):
            found[k][m] = b if a is None else a if b is None else [None if x is None else x + y for x, y in zip(a, b)]
    return found


def _narrow(sums: np.ndarray) -> np.ndarray:
    """Sums, which are whole multiples of STEP, as integers of few bytes; as they are if they aren't finite or too large for that."""
    whole = np.rint(sums / STEP)
    most = np.abs(whole).max(initial=0)
    return whole.astype(np.int32 if most < 2**31 else np.int64) if most < 2**62 else sums


def _packed(tables: list) -> bytes:
    """Few bytes: of each model's table the cells that hold rows, as most cells of a deep node hold nothing."""
    out = []
    for t in tables:
        if t is None:
            out.append(None)
            continue
        g, h, n = t
        held = n > 0
        rows = n[held]
        out.append((n.shape, np.packbits(held), _narrow(g[held]), None if h is None else _narrow(h[held]), rows.astype(np.min_scalar_type(rows.max(initial=0)))))
    return zlib.compress(pickle.dumps(out, protocol=5), 1)


def _unpacked(packed: bytes) -> list:
    def opened(shape: tuple[int, int], held: np.ndarray, sums: np.ndarray, scale: float) -> np.ndarray:
        out = np.zeros(shape)
        out[held] = sums * scale if sums.dtype.kind in "iu" else sums
        return out

    out = []
    for t in pickle.loads(zlib.decompress(packed)):
        if t is None:
            out.append(None)
            continue
        shape, bits, g, h, n = t
        held = np.unpackbits(bits, count=shape[0] * shape[1]).astype(bool).reshape(shape)
        out.append([opened(shape, held, g, STEP), None if h is None else opened(shape, held, h, STEP), opened(shape, held, n, 1)])
    return out


def _added(sums: Iterator[tuple[int, list]]) -> Iterator[tuple[int, bytes]]:
    """The tables of each part of the features, added up and packed."""
    _settle()
    for k, tables in _merged(sums).items():
        yield k, _packed(tables)


def _tables(packed: list[tuple[int, bytes]], n_models: int, widths: list[int]) -> list[np.ndarray | None]:
    """For each model (g, h, rows) by waiting node, feature and bin: nodes first."""
    by_part = [tables for _, tables in sorted(_merged((k, _unpacked(b)) for k, b in packed).items())]
    cells = np.concatenate([f * BINS + np.arange(w) for f, w in enumerate(widths)])
    out: list[np.ndarray | None] = []
    for m in range(n_models):
        found = [tables[m] for tables in by_part if tables[m] is not None]
        if not found:
            out.append(None)
            continue
        g, h, n = (None if x[0] is None else np.concatenate(x, axis=1) for x in zip(*found))
        table = np.zeros((3, len(n), len(widths) * BINS))
        for k, sums in enumerate((g, n if h is None else h, n)):
            table[k][:, cells] = sums
        out.append(table.reshape(3, len(n), len(widths), BINS).transpose(1, 0, 2, 3))
    return out


def _with_trees(b: dict, trees: list) -> dict:
    """The block with the trees' values added to its predictions."""
    margins = b["margins"].copy()
    for m, tree in enumerate(trees):
        if tree is not None:
            margins[m] += tree[4][leaf_of(tree, b["bins"])]
    return b | {"margins": margins}


def _opened(row, starts: np.ndarray, n_features: int, n_targets: int, n_uses: int) -> dict:
    n = row["n"]
    return {
        "bins": np.frombuffer(row["bins"], np.uint8).reshape(n_features, n), "targets": np.frombuffer(row["targets"], float).reshape(n_targets, n),
        "uses": np.frombuffer(row["uses"], bool).reshape(n_uses, n),
        "margins": np.frombuffer(row["margins"], float).reshape(-1, n) if "margins" in row else np.repeat(starts[:, None], n, axis=1),
    }


def _joined(blocks: Iterator[dict], targets: list[int], uses: list[int]) -> Iterator[dict]:
    """The rows that a model of the fit uses, with these targets and uses only, in blocks of about BLOCK_ROWS rows; a partition's last one says so."""
    waiting, n, ready = [], 0, None

    def block() -> dict:
        return {c: np.concatenate([b[c] for b in waiting], axis=1) for c in waiting[0]} | {"last": False}

    for b in blocks:
        used = b["uses"][uses]
        kept = used.any(axis=0)
        b = {"bins": b["bins"][:, kept], "targets": b["targets"][targets][:, kept], "uses": used[:, kept], "margins": b["margins"][:, kept]}
        if waiting and n + kept.sum() > BLOCK_ROWS:
            if ready:
                yield ready
            ready, waiting, n = block(), [], 0
        waiting.append(b)
        n += kept.sum()
    if waiting:
        if ready:
            yield ready
        yield block() | {"last": True}


def _closed(b: dict) -> tuple:
    return b["bins"].shape[1], b["bins"].tobytes(), b["targets"].tobytes(), b["uses"].tobytes(), b["margins"].tobytes()


def best_splits(hists: np.ndarray, spec: Spec) -> list[tuple | None]:
    """Of each node's histogram (gain, feature, cut, (g, h, rows) left, right) of the best cut between bins, or None; ties go to the first feature and cut."""
    left = hists.cumsum(axis=3)
    whole = left[..., -1:]
    right = whole - left
    allowed = (left[:, 2] >= spec.least_rows) & (right[:, 2] >= spec.least_rows) & (left[:, 1] >= LEAST_HESSIAN) & (right[:, 1] >= LEAST_HESSIAN)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[:, 0] ** 2 / (left[:, 1] + spec.l2) + right[:, 0] ** 2 / (right[:, 1] + spec.l2) - whole[:, 0] ** 2 / (whole[:, 1] + spec.l2)
    gain = np.where(allowed, gain, -np.inf)
    out: list[tuple | None] = []
    for k, at in enumerate(gain.reshape(len(gain), -1).argmax(axis=1).tolist()):
        f, cut = divmod(at, hists.shape[3])
        out.append((float(gain[k, f, cut]), f, cut, left[k, :, f, cut].copy(), right[k, :, f, cut].copy()) if gain[k, f, cut] > 0 else None)
    return out


def _leaf_value(sums: np.ndarray, spec: Spec) -> float:
    return float(-spec.rate * sums[0] / (sums[1] + spec.l2)) if sums[1] + spec.l2 > 0 else 0.0


class _Growing:
    """A model while it is fitted: its trees so far, and the one that grows.

    `tree` holds every node whose split was needed to know the order of gains; the tree that is kept has those that come first in it.
    """

    def __init__(self, spec: Spec, start: float):
        self.spec, self.start, self.trees = spec, start, []

    def begin(self) -> None:
        self.tree = Tree()
        #: of nodes with a known histogram: the best split and the histogram
        self.known: dict[int, tuple] = {}
        #: (node, sister, parent) of nodes whose histogram the next pass makes; the root has neither
        self.waiting: list[tuple[int, int | None, int | None]] = [(0, None, None)]
        self.depth = {0: 0}
        self.done = False

    def take(self, table: np.ndarray | None) -> None:
        """Histograms of the waiting nodes; then the next nodes to wait for, or the finished tree."""
        found: dict[int, np.ndarray] = {}
        for k, (node, sister, parent) in enumerate(self.waiting):
            hist = np.zeros((3, 1, BINS)) if table is None else table[k]
            if parent is None:
                self.tree.value[0] = _leaf_value(hist[:, 0].sum(axis=1), self.spec)
            else:
                found[sister] = self.known[parent][1] - hist
            found[node] = hist
        hists = np.stack(list(found.values()))
        self.known |= {node: known for node, *known in zip(found, best_splits(hists, self.spec), hists)}
        self.waiting = []
        kept, unsure = self._first_by_gain()
        for node in unsure:
            children = self._split(node)
            small, large = children if self.known[node][0][3][2] <= self.known[node][0][4][2] else children[::-1]
            self.waiting.append((small, large, node))
        if not unsure:
            for node in kept:
                if self.tree.feature[node] < 0:
                    self._split(node)
            self.trees.append(_pruned(self.tree, kept).arrays())
            self.done = True

    def _is_last(self, node: int) -> bool:
        """Whether the node's children can't be split, so that their histograms aren't needed."""
        return self.depth[node] + 1 >= self.spec.most_depth

    def _split(self, node: int) -> tuple[int, int]:
        _, feature, cut, left, right = self.known[node][0]
        children = self.tree.split(node, feature, cut, _leaf_value(left, self.spec), _leaf_value(right, self.spec))
        self.depth |= dict.fromkeys(children, self.depth[node] + 1)
        return children

    def _first_by_gain(self) -> tuple[set[int], list[int]]:
        """Nodes that are split when always the largest gain comes next, and those among them whose children's gains aren't known yet.

        The last split of all is no such node, as nothing comes after it, nor are splits at the most depth.
        """
        heap = [(-self.known[0][0][0], 0)] if self.known[0][0] else []
        kept, unsure, leaves = set(), [], 1
        while heap and leaves < self.spec.leaves:
            node = heapq.heappop(heap)[1]
            kept.add(node)
            leaves += 1
            if self._is_last(node):
                continue
            if self.tree.feature[node] < 0:
                if leaves < self.spec.leaves:
                    unsure.append(node)
                continue
            for child in (self.tree.left[node], self.tree.right[node]):
                if self.known[child][0]:
                    heapq.heappush(heap, (-self.known[child][0][0], child))
        return kept, unsure


def _pruned(tree: Tree, kept: set[int]) -> Tree:
    out, todo = Tree(value=[tree.value[0]]), [(0, 0)]
    while todo:
        old, new = todo.pop()
        if old in kept:
            a, b = tree.left[old], tree.right[old]
            todo += zip((a, b), out.split(new, tree.feature[old], tree.cut[old], tree.value[a], tree.value[b]))
    return out


def _starts(blocks: Iterator[dict], specs: list[Spec], targets: list[str], uses: list[str]) -> Iterator[np.ndarray]:
    total = np.zeros((len(specs), 2))
    for b in blocks:
        for m, s in enumerate(specs):
            y = b["targets"][targets.index(s.target)][b["uses"][uses.index(s.use)]]
            total[m] += (np.rint((np.log1p(y) if s.log_target else y) / STEP) * STEP).sum(), len(y)
    yield total


def fit(blocks: DataFrame, features: list[str], edges: tuple[np.ndarray, ...], targets: list[str], uses: list[str], specs: list[Spec]) -> list[Model]:
    """Fits all specs in the same passes over the blocks; one whose rounds are over waits for the others."""
    opened = partial(_opened, n_features=len(features), n_targets=len(targets), n_uses=len(uses))
    first = blocks.rdd.map(partial(opened, starts=np.zeros(0)))
    each = first.mapPartitions(partial(_starts, specs=specs, targets=targets, uses=uses))
    sums = each.treeReduce(np.add) if each.getNumPartitions() >= TREE_FROM else each.reduce(np.add)
    means = sums[:, 0] / np.maximum(sums[:, 1], 1)
    starts = np.array([np.log(max(m, 1e-6)) if s.loss == "poisson" else m for m, s in zip(means, specs)])
    growing = [_Growing(s, float(start)) for s, start in zip(specs, starts)]
    # blocks are dealt out by the work there is and not by how they were stored: a table of sums from each task is what the driver gets
    most = max(blocks.sparkSession.sparkContext.defaultParallelism, blocks.rdd.getNumPartitions())
    blocks = blocks.repartition(max(1, min(most, int(-(-sums[:, 1].sum() // TASK_ROWS)))))
    # a feature has bin 0, one for each edge and one above
    widths = [len(e) + 2 for e in edges]
    several = blocks.rdd.getNumPartitions() >= TREE_FROM
    step = -(-len(features) // (ADDERS if several else 1))
    parts = [range(k, min(k + step, len(features))) for k in range(0, len(features), step)]
    # every pass hands all that is kept to the tasks, so what no model uses isn't kept
    wanted = sorted({s.target for s in specs}, key=targets.index), sorted({s.use for s in specs}, key=uses.index)
    narrowed = partial(_joined, targets=[targets.index(t) for t in wanted[0]], uses=[uses.index(u) for u in wanted[1]])
    rdd, before = blocks.rdd.map(partial(opened, starts=starts)).mapPartitions(narrowed).persist(StorageLevel.MEMORY_AND_DISK), None
    targets, uses = wanted
    reopened = partial(_opened, starts=starts, n_features=len(features), n_targets=len(targets), n_uses=len(uses))
    rejoined = partial(_joined, targets=list(range(len(targets))), uses=list(range(len(uses))))
    for done in range(max(s.rounds for s in specs)):
        now = [m for m in growing if m.spec.rounds > done]
        for m in now:
            m.begin()
        while not all(m.done for m in now):
            plans = [(m.spec, m.tree.arrays(), np.array([w[0] for w in m.waiting])) if m in now and not m.done else None for m in growing]
            passed = rdd.mapPartitions(partial(_histograms, plans=plans, targets=targets, uses=uses, widths=widths, parts=parts))
            passed = passed.partitionBy(len(parts), _itself).mapPartitions(_added) if several else passed.mapValues(_packed)
            tables = _tables(passed.collect(), len(specs), widths)
            if before is not None:
                before.unpersist()
                before = None
            for m, table in zip(growing, tables):
                if m in now and not m.done:
                    m.take(table)
        if done + 1 < max(s.rounds for s in specs):
            before, rdd = rdd, rdd.map(partial(_with_trees, trees=[m.trees[-1] if m in now else None for m in growing])).persist(StorageLevel.MEMORY_AND_DISK)
            if (done + 1) % CUT == 0:
                kept = stored(rdd.map(_closed).toDF("n long, bins binary, targets binary, uses binary, margins binary"), "boosting-margins")
                rdd.unpersist()
                before.unpersist()
                before, rdd = None, kept.repartition(rdd.getNumPartitions()).rdd.map(reopened).mapPartitions(rejoined).persist(StorageLevel.MEMORY_AND_DISK)
    rdd.unpersist()
    return [Model(tuple(features), edges, m.spec, m.start, tuple(m.trees)) for m in growing]


def predict(model: Model, rows: DataFrame, keys: list[str], name: str = "predicted") -> DataFrame:
    """keys and the prediction of each row; a map over the rows. The model, whose size its parameters bound, is broadcast."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    columns = [f"f{k}" for k in range(len(model.features))]
    schema = rows.select(*keys).schema

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[keys].assign(**{name: sent.value.predict(batch[columns].to_numpy(float))})

    shown = rows.select(*keys, *(F.col(c).cast("double").alias(f) for c, f in zip(model.features, columns)))
    return shown.mapInPandas(score, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + f", {name} double")


def permutation_importance(model: Model, rows: DataFrame, repeats: int = 3, seed: int = 1) -> DataFrame:
    """feature, mae_rise, mae_rise_sd: rise of the mean absolute error of rows (with a column target) when a feature's values change rows.

    Values change places within a batch of rows, so one map over the rows and one sum do; every row counts, `repeats` times each.
    """
    sent = rows.sparkSession.sparkContext.broadcast(model)
    columns = [f"f{k}" for k in range(len(model.features))]

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        total: dict[tuple, list[float]] = {}
        for number, batch in enumerate(batches):
            y = batch["target"].to_numpy(float)
            bins = binned(batch[columns].to_numpy(float), m.edges)

            def add(key: tuple) -> None:
                now = total.setdefault(key, [0.0, 0])
                now[0] += float(np.abs(m.shown(m.margin(bins)) - y).sum())
                now[1] += len(y)

            add((-1, 0))
            for k in range(len(columns)):
                held = bins[k].copy()
                for r in range(repeats):
                    bins[k] = np.random.default_rng([seed, number, k, r]).permutation(held)
                    add((k, r))
                bins[k] = held
        yield pd.DataFrame([(k, r, *x) for (k, r), x in total.items()], columns=["feature", "repeat", "error", "n"])

    shown = rows.select(F.col("target").cast("double").alias("target"), *(F.col(c).cast("double").alias(f) for c, f in zip(model.features, columns)))
    mae = shown.mapInPandas(errors, "feature int, repeat int, error double, n long").groupBy("feature", "repeat").agg((F.sum("error") / F.sum("n")).alias("mae"))
    base = mae.where("feature = -1").select(F.col("mae").alias("base"))
    names = F.array(*map(F.lit, model.features))
    each = mae.where("feature >= 0").crossJoin(F.broadcast(base)).withColumn("rise", F.col("mae") - F.col("base"))
    return each.groupBy("feature").agg(F.avg("rise").alias("mae_rise"), F.stddev_pop("rise").alias("mae_rise_sd")).select(F.element_at(names, F.col("feature") + 1).alias("feature"), "mae_rise", "mae_rise_sd")
