"""Embedding near-duplicates by a robust-pruned flat graph over overlapping cluster shards."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .components import components


@dataclass(frozen=True)
class Graph:
    threshold: float = 0.9
    #: vectors that have their home in a shard, on average; centroids at most, found on sample_rows vectors. Where there are more
    #: vectors, a centroid's are parted by the signs of random projections of what they differ from it
    shard_rows: int = 500
    max_centers: int = 2048
    sample_rows: int = 8192
    #: shards that a vector is a member of, members from which on a shard is dealt into parts, and queries that a task gets at once
    overlap: int = 4
    part_rows: int = 1500
    query_rows: int = 1024
    #: keys over which the rows of one shard are dealt for look-ups by shard
    salts: int = 32
    #: neighbours considered and kept by pruning; slack of the pruning; random neighbours added for long edges
    pool: int = 48
    degree: int = 16
    alpha: float = 1.2
    far: int = 12
    #: width of the greedy search, its medoids, and how far below the threshold the range still expands
    beam: int = 24
    entries: int = 8
    margin: float = 0.06
    #: queries of the recall audit, which grow until audit_linked of them have a link or audit_most are asked, and the recall below which
    #: shards are made to overlap more
    audit_queries: int = 256
    audit_linked: int = 64
    audit_most: int = 4096
    least_recall: float = 0.98


def _unit(packed: Iterable[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(packed), "<f8").reshape(len(packed), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares of tiny or huge components stay within doubles
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(embeddings: DataFrame) -> DataFrame:
    """vec_id, vector: little-endian doubles; null if the vector is null, zero or holds a null or non-finite component."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                x = None if v is None or not v or any(c is None for c in v) else np.array(v, "<f8") + 0.0
                out.append(x.tobytes() if x is not None and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "vector"])

    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(pack, "vec_id long, vector binary")


def centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means of unit vectors."""
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        home = (x @ centers.T).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, home, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centers)
    return centers


def robust_prune(x: np.ndarray, nodes: np.ndarray, pool: np.ndarray, how: Graph) -> np.ndarray:
    """For each node the kept neighbours of its pool (rows of indices, -1 for none), nearest first.

    A candidate goes once a kept one is nearer to it, by the factor alpha, than the node is.
    """
    pool = np.where(pool == nodes[:, None], -1, pool)
    ordered = np.sort(pool, 1)
    pool = np.where(np.concatenate([np.zeros((len(pool), 1), bool), ordered[:, 1:] == ordered[:, :-1]], 1), -1, ordered)
    c = x[np.maximum(pool, 0)]
    d = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nld,nd->nl", c, x[nodes])))
    d[pool < 0] = np.inf
    among = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nld,nkd->nlk", c, c)))
    kept = np.full((len(nodes), how.degree), -1)
    lines, left = np.arange(len(nodes)), d.copy()
    for k in range(how.degree):
        pick = left.argmin(1)
        live = np.isfinite(left[lines, pick])
        if not live.any():
            break
        kept[live, k] = pool[lines, pick][live]
        left[how.alpha * among[lines, pick] <= d] = np.inf
        left[lines, pick] = np.inf
    return kept


def build_graph(x: np.ndarray, how: Graph, seed: int = 11) -> np.ndarray:
    """Neighbours of every vector: pruned from the nearest ones and a few random ones, with the reverse edges."""
    n, rng = len(x), np.random.default_rng(seed)
    out = []
    for a in range(0, n, 256):
        nodes = np.arange(a, min(n, a + 256))
        near = x[nodes] @ x.T
        k = min(how.pool, n)
        pool = np.argpartition(-near, k - 1, axis=1)[:, :k]
        out.append(robust_prune(x, nodes, np.concatenate([pool, rng.integers(0, n, (len(nodes), how.far))], 1), how))
    return np.concatenate(out)


def _padded(sources: np.ndarray, targets: np.ndarray, n: int) -> np.ndarray:
    """Edge lists as rows of neighbours, -1 for none."""
    pairs = np.unique(np.column_stack([sources, targets]), axis=0)
    counts = np.bincount(pairs[:, 0], minlength=n)
    out = np.full((n, max(1, counts.max(initial=0))), -1)
    out[pairs[:, 0], np.arange(len(pairs)) - np.repeat(np.cumsum(counts) - counts, counts)] = pairs[:, 1]
    return out


def range_search(x: np.ndarray, queries: np.ndarray, neighbours: np.ndarray, starts: tuple[np.ndarray, np.ndarray], how: Graph) -> np.ndarray:
    """Cosines of queries (rows) with the vectors that the search meets; -2 for the others.

    From the medoids and the query's own `starts` (query, vector) on, each query expands the best `beam` vectors met so far and, as
    soon as some are near the range, all that are within it (less a margin), until nothing new comes.
    """
    n = len(x)
    entry = [int((x @ x.mean(0)).argmax())]
    best = x @ x[entry[0]]
    while len(entry) < min(how.entries, n):
        entry.append(int(best.argmin()))
        best = np.maximum(best, x @ x[entry[-1]])
    seen = np.full((len(queries), n), -2.0)
    seen[:, entry] = queries @ x[entry].T
    seen[starts] = np.einsum("nd,nd->n", queries[starts[0]], x[starts[1]])
    expanded = np.zeros(seen.shape, bool)
    width = min(how.beam, n)
    while True:
        worst = np.partition(seen, n - width, axis=1)[:, n - width]
        front = ~expanded & (seen > -2) & ((seen >= worst[:, None]) | (seen >= how.threshold - how.margin))
        q, node = np.nonzero(front)
        if not len(q):
            return seen
        expanded |= front
        for a in range(0, len(q), 20000):
            near = neighbours[node[a : a + 20000]]
            flat = (q[a : a + 20000, None] * n + near)[near >= 0]
            flat = np.unique(flat)
            flat = flat[seen.ravel()[flat] == -2]
            seen.ravel()[flat] = np.einsum("nd,nd->n", queries[flat // n], x[flat % n])


def _home_codes(x: np.ndarray, center: int, centers: np.ndarray, bits: int) -> tuple[int, list[int]]:
    """The code of a vector among those of its centroid, and its codes across the nearest of the planes that part them."""
    side = np.random.default_rng(center).normal(size=(bits, len(x))) @ (x - centers[center])
    code = int(((side > 0) << np.arange(bits)).sum())
    return code, [code ^ (1 << int(k)) for k in np.argsort(np.abs(side))]


def _assigned(reps: DataFrame, centers: np.ndarray, bits: np.ndarray, overlap: int) -> DataFrame:
    """shard, vec_id, n, vector, home (shard): the shards that each vector is a member of."""
    fields = pa.schema([("shard", pa.int64()), ("vec_id", pa.int64()), ("n", pa.int64()), ("vector", pa.binary()), ("home", pa.int64())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                rows = []
                for vec_id, n, vector in zip(*(whole.slice(at, 1024).column(c).to_pylist() for c in ("vec_id", "n", "vector")), strict=True):
                    x = _unit([vector])[0]
                    if len(x) != centers.shape[1]:
                        shards = [-len(vector)]  # vectors of another dimension: a shard to themselves
                    else:
                        order = np.argsort(-(centers @ x), kind="stable")[:overlap].tolist()
                        codes = [_home_codes(x, c, centers, bits[c]) for c in order]
                        shards = [c + len(centers) * code for c, (code, _) in zip(order, codes)] + [order[0] + len(centers) * code for code in codes[0][1][: overlap - 1]]
                    rows += [(shard, vec_id, n, vector, shards[0]) for shard in shards]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

    return reps.mapInArrow(assign, "shard long, vec_id long, n long, vector binary, home long")


def _grouped_lists(source: np.ndarray, values: np.ndarray, n: int) -> list[list[int]]:
    """Distinct values of each source 0 .. n - 1."""
    pairs = np.unique(np.column_stack([source, values]), axis=0)
    return [v.tolist() for v in np.split(pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(1, n)))]


def united_graph(members: DataFrame, how: Graph) -> DataFrame:
    """vec_id, near, homes: a vector's neighbours, united over its shards, and the home shards of those near the range."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id", ignore_index=True)
        ids, home = group["vec_id"].to_numpy(), group["home"].to_numpy()
        x = _unit(group["vector"]).astype(np.float32)
        kept = build_graph(x, how)
        node, to = np.repeat(np.arange(len(ids)), kept.shape[1])[kept.ravel() >= 0], kept.ravel()[kept.ravel() >= 0]
        a, b = np.concatenate([node, to]), np.concatenate([to, node])
        close = np.einsum("nd,nd->n", x[a], x[b]) >= how.threshold - how.margin
        # its own home is one of them: who finds the vector in a shard that it is a guest of goes on to its home
        every = np.arange(len(ids))
        return pd.DataFrame({"vec_id": ids, "near": _grouped_lists(a, ids[b], len(ids)), "homes": _grouped_lists(np.append(a[close], every), np.append(home[b[close]], home), len(ids))})

    lists = members.select("shard", "part", "vec_id", "vector", "home").groupBy("shard", "part").applyInPandas(build, "vec_id long, near array<long>, homes array<long>")
    # as many lists a vector as it has shards
    return lists.groupBy("vec_id").agg(*(F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("near", "homes")))


def _pairs(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of all values of lists."""
    sizes = lists.map(len).to_numpy()
    return np.repeat(np.arange(len(lists)), sizes), np.concatenate([np.empty(0, np.int64), *lists])


def _places(ids: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted in the sorted ids, and which are there."""
    at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
    return at, ids[at] == wanted


def _has(lists: pd.Series, columns: np.ndarray) -> np.ndarray:
    """Which list (row) holds which of the sorted columns."""
    out = np.zeros((len(lists), len(columns)), bool)
    row, value = _pairs(lists)
    at, there = _places(columns, value)
    out[row[there], at[there]] = True
    return out


def _walked(shard: int, own: pd.DataFrame, asked: pd.DataFrame, how: Graph) -> Iterator[pd.DataFrame]:
    """What the queries find in one part of a shard: see search_round."""
    ids, n, x = own["vec_id"].to_numpy(), own["n"].to_numpy(), _unit(own["vector"])
    source, target = _pairs(own["near"])
    at, there = _places(ids, target)
    neighbours = _padded(source[there], at[there], len(ids))
    q_ids, q_n = asked["vec_id"].to_numpy(), asked["n"].to_numpy()
    homes = np.unique(np.concatenate([asked["home"].to_numpy(), _pairs(own["homes"])[1]]))
    of_home = np.searchsorted(homes, asked["home"].to_numpy())
    leads, before, now = _has(own["homes"], homes), _has(own["seen"], homes), _has(own["new"], homes)
    known = _has(asked["seen"], homes) | _has(asked["new"], homes)
    lives_here = own["home"].to_numpy() == shard
    everyone = np.union1d(ids, q_ids)
    label, links = np.arange(len(everyone)), np.zeros(len(everyone), np.int64)
    of_member, of_query = np.searchsorted(everyone, ids), np.searchsorted(everyone, q_ids)
    for a in range(0, len(asked), 128):
        some = slice(a, a + 128)
        row, value = _pairs(asked["near"][some])
        place, there = _places(ids, value)
        own_place, own_there = _places(ids, q_ids[some])
        starts = np.concatenate([row[there], np.flatnonzero(own_there)]), np.concatenate([place[there], own_place[own_there]])
        found = range_search(x, _unit(asked["vector"][some]), neighbours, starts, how) >= how.threshold
        found &= ids[None, :] != q_ids[some, None]
        q, shard_at = np.nonzero((found.astype(np.float32) @ leads.astype(np.float32) > 0) & ~known[some])
        yield pd.DataFrame({"vec_id": q_ids[some][q], "visit": homes[shard_at]})
        # a link counts in the first round in which one end visits the other's home, there once: by the smaller id if both do
        theirs = of_home[some]
        counted = found & lives_here[None, :] & ~before[:, theirs].T & (~now[:, theirs].T | (q_ids[some, None] < ids[None, :]))
        links[of_query[some]] += counted @ n
        np.add.at(links, of_member, counted.T.astype(np.int64) @ q_n[some])
        for k in np.flatnonzero(counted.any(1)):
            merged = np.unique(np.append(label[of_member[counted[k]]], label[of_query[a + k]]))
            if len(merged) > 1:
                label[np.isin(label, merged)] = merged[0]
                yield pd.DataFrame({"vec_id": everyone[merged[1:]], "other": everyone[merged[0]]})
    yield pd.DataFrame({"vec_id": everyone[links > 0], "n_links": links[links > 0]})


def search_round(walk: DataFrame, members: DataFrame, how: Graph) -> DataFrame:
    """(vec_id, n_links), (vec_id, other) or (vec_id, visit): links counted, links that connect what is counted, shards to go on to.

    walk: a row a vector with its neighbours, the shards that it visited (seen) and is to visit now (new). A task has one part of a
    shard and a bounded block of the queries that visit it. It counts links with vectors at home there, at both ends, and each link
    in one task only; so counts add up without a row for each link. A query that finds vectors whose neighbours live in a shard that
    it hasn't visited goes on to that shard in the next round: so the shards' graphs are walked as one.
    """
    columns = ["vec_id", "n", "vector", "home", "near", "homes", "seen", "new"]

    def search(group: pd.DataFrame) -> pd.DataFrame:
        own, asked = (group[group["member"] == m].sort_values("vec_id", ignore_index=True) for m in (True, False))
        parts = list(_walked(int(group["shard"].iloc[0]), own, asked, how)) if len(own) and len(asked) else []
        # whole columns of nullable integers, so that large ids aren't turned into floats
        return pd.concat([p.reindex(columns=["vec_id", "n_links", "other", "visit"]).astype("Int64") for p in (pd.DataFrame({"vec_id": []}), *parts)], ignore_index=True)

    visits = walk.where(F.size("new") > 0).select(*columns, F.explode("new").alias("shard"))
    parts = members.groupBy("shard").agg(F.max("parts").alias("parts"))
    shards = parts.join(visits.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / how.query_rows).cast("int").alias("blocks")), "shard")
    numbers = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    block = F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.col("blocks")).cast("int")
    queries = _of_shard(visits, shards, how).withColumn("part", numbers("parts")).select("shard", "part", block.alias("block"), *columns, F.lit(False).alias("member"))
    targets = _of_shard(members.select("shard", "part", "vec_id"), shards.select("shard", "blocks"), how).join(walk, "vec_id").withColumn("block", numbers("blocks"))
    both = targets.select("shard", "part", "block", *columns, F.lit(True).alias("member")).unionByName(queries)
    return both.groupBy("shard", "part", "block").applyInPandas(search, "vec_id long, n_links long, other long, visit long")


def _of_shard(rows: DataFrame, per_shard: DataFrame, how: Graph) -> DataFrame:
    """rows (shard, vec_id, ...) with the values of their shard: a shard's rows are dealt over `salts` keys, per_shard is repeated for each."""
    salted = per_shard.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(how.salts - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.lit(how.salts)).cast("int")).join(salted, ["shard", "salt"]).drop("salt")


def walk_graph(reps: DataFrame, centers: np.ndarray, bits: np.ndarray, overlap: int, how: Graph) -> DataFrame:
    """What all rounds find: (vec_id, n_links) to be added up and (vec_id, other)."""
    members = stored(_assigned(reps, centers, bits, overlap), "shards")
    sizes = members.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / how.part_rows).cast("int").alias("parts"))
    members = _of_shard(members, sizes, how).withColumn("part", F.pmod(F.xxhash64("vec_id", "shard"), F.col("parts")).cast("int"))
    union = united_graph(members, how)
    at_home = members.where("shard = home").select("vec_id", "n", "vector", "home")
    none = F.array().cast("array<long>")
    walk = stored(at_home.join(union, "vec_id").select("*", none.alias("seen"), F.array_union(F.array("home"), "homes").alias("new")), "walk")
    found = stored(search_round(walk, members, how), "found")
    rounds = found
    while not found.where("visit is not null").isEmpty():
        onward = found.where("visit is not null").groupBy("vec_id").agg(F.collect_set("visit").alias("next"))
        walk = walk.join(onward, "vec_id", "left").withColumn("seen", F.array_union("seen", "new")).withColumn("new", F.coalesce("next", none)).drop("next")
        walk = stored(walk, "walk")
        found = stored(search_round(walk, members, how), "found")
        rounds = rounds.unionByName(found)
    return rounds


def _links(found: DataFrame) -> DataFrame:
    """(vec_id, links) of what the rounds count."""
    return found.where("n_links is not null").groupBy("vec_id").agg(F.sum("n_links").alias("links"))


def _true_links(reps: DataFrame, queries: int, how: Graph) -> DataFrame:
    """(vec_id, truth): all links of the first `queries` vectors by a hash, against all vectors in blocks; without those that have none."""
    sample = reps.orderBy(F.xxhash64(F.lit(3), "vec_id"), "vec_id").limit(queries).select("vec_id", "vector").collect()
    by_size: dict[int, list] = {}
    for r in sample:
        by_size.setdefault(len(r["vector"]), []).append(r)
    asked = {size: (np.array([r["vec_id"] for r in rows]), _unit(pd.Series([bytes(r["vector"]) for r in rows]))) for size, rows in by_size.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids, n, vectors = batch.column("vec_id").to_numpy(), batch.column("n").to_numpy(), pd.Series(batch.column("vector").to_pylist())
                for size in set(vectors.map(len)) & set(asked):
                    own = (vectors.map(len) == size).to_numpy()
                    q_ids, q = asked[size]
                    hit = (q @ _unit(vectors[own]).T >= how.threshold) & (q_ids[:, None] != ids[own][None, :])
                    for k in np.flatnonzero(hit.any(1)).tolist():
                        total[int(q_ids[k])] = total.get(int(q_ids[k]), 0) + int(n[own][hit[k]].sum())
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int64()), pa.array(list(total.values()), pa.int64())], names=["vec_id", "truth"])

    return stored(reps.select("vec_id", "n", "vector").mapInArrow(count, "vec_id long, truth long").groupBy("vec_id").agg(F.sum("truth").alias("truth")), "audit")


def linked_sample(reps: DataFrame, total: int, how: Graph) -> DataFrame:
    """(vec_id, truth) of sampled vectors that have links; four times as many vectors are asked as long as too few have any."""
    queries = how.audit_queries
    while True:
        truth = _true_links(reps, queries, how)
        if queries >= min(total, how.audit_most) or truth.count() >= how.audit_linked:
            return truth
        queries = min(4 * queries, how.audit_most)


def audit_recall(truth: DataFrame, found: DataFrame) -> float | None:
    """Share of a vector's links that the search has found, against all vectors: the mean over the sampled vectors that have links, so
    that members of large groups count no more than others; None if no sampled vector has any."""
    share = F.least(F.coalesce("links", F.lit(0)), "truth") / F.col("truth")
    return truth.join(_links(found), "vec_id", "left").agg(F.avg(share).alias("recall")).first()["recall"]


#: Internal ids of vectors whose vec_id another vector has too begin here.
SURROGATES = 1 << 62


def _classes(named: DataFrame) -> DataFrame:
    """vector, n, own (the smallest vec_id of equal vectors) and vec_id, an id that no other class has: own but for repeated ids."""
    classes = stored(named.groupBy("vector").agg(F.min("vec_id").alias("own"), F.count(F.lit(1)).alias("n")), "classes")
    repeated = stored(classes.groupBy("own").agg(F.count(F.lit(1)).alias("times"), F.min("vector").alias("first")).where("times > 1").drop("times"), "repeated-ids")
    if repeated.isEmpty():
        return classes.withColumn("vec_id", F.col("own"))
    joined = classes.join(repeated, "own", "left")
    later = F.col("first").isNotNull() & (F.col("first") != F.col("vector"))
    return stored(joined.withColumn("vec_id", F.when(later, F.lit(SURROGATES) + F.monotonically_increasing_id()).otherwise(F.col("own"))).drop("first"), "classes")


def _smallest_ids(classes: DataFrame, groups: DataFrame) -> DataFrame:
    """(vec_id, component_id) with the smallest own id of the component, where internal ids stand in it."""
    placed = classes.select("vec_id", "own").join(groups.select(F.col("node").alias("vec_id"), "component_id"), "vec_id", "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    lower = placed.where(F.col("vec_id") >= SURROGATES).groupBy("component_id").agg(F.min("own").alias("lower"))
    known = F.when(F.col("component_id") < SURROGATES, F.col("component_id"))
    return placed.join(lower, "component_id", "left").select("vec_id", F.least(known, F.col("lower")).alias("component_id"))


def near_vectors(embeddings: DataFrame, how: Graph = Graph()) -> DataFrame:
    """vec_id, n_links, component_id, kept, audited_recall for every vector.

    Equal vectors are one class, whose smallest id stands for it and whose size weighs its links. Representatives are members of the
    shards of their nearest centroids (found on a bounded sample); shards are parted further where vectors outgrow the centroids.
    Each part's graph is built and pruned in a task, a vector's lists are united over its shards, and the united graph is walked by
    range-expanding greedy search in double precision, from the medoids of its home shard on to other shards as far as neighbours
    within the range lead (search_round). Every task's members and queries are bounded, whatever the shard.

    The recall of vectors with links is always audited against all vectors, on a bounded sample that grows until enough of it has links,
    and returned (null if none has any: nothing was measured); while it is below least_recall, vectors become members of twice as
    many shards and searches four times as wide, in the end of all shards and over all of their members, which compares all with all. A link that the walk doesn't meet is lost: the audit tells
    how many.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do vectors of different
    dimensions with each other. A null vec_id names no vector: n_links 0, component_id null, kept true. Repeated rows count as
    vectors of their own and keep a row each. An empty table gives no rows; other columns are ignored.
    """
    spark = embeddings.sparkSession
    packed = stored(_packed(embeddings), "vectors")
    named = packed.where("vec_id is not null and vector is not null")
    classes = _classes(named)
    total = classes.count()
    found, recall = spark.createDataFrame([], "vec_id long, n_links long, other long, visit long"), None
    if total:
        sample = classes.orderBy(F.xxhash64("vec_id"), "vec_id").limit(how.sample_rows).select("vector").collect()
        size = max(sorted({len(r["vector"]) for r in sample}), key=lambda s: sum(len(r["vector"]) == s for r in sample))
        x = _unit(pd.Series([bytes(r["vector"]) for r in sample if len(r["vector"]) == size]))
        centers = centroids(x, min(how.max_centers, -(-total // how.shard_rows), len(x)))
        bits, overlap = np.zeros(len(centers), np.int64), how.overlap
        if total > 4 * how.shard_rows * len(centers):
            # a row for each centroid, max_centers at most
            for r in _assigned(classes, centers, bits, 1).where("home >= 0").groupBy("home").count().collect():
                bits[r["home"]] = max(0, int(np.ceil(np.log2(r["count"] / (4 * how.shard_rows)))))
        truth = linked_sample(classes, total, how)
        reps = classes.drop("own")
        while True:
            found = walk_graph(reps, centers, bits, overlap, how)
            recall = audit_recall(truth, found)
            if recall is None or recall >= how.least_recall or (overlap >= len(centers) + bits.max() and how.beam >= how.part_rows):
                break
            overlap, how = 2 * overlap, replace(how, beam=4 * how.beam)
    groups = components(found.where("other is not null").select(F.col("vec_id").alias("a"), F.col("other").alias("b")))
    of_class = classes.join(_links(found), "vec_id", "left").join(_smallest_ids(classes, groups), "vec_id").select("vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component_id")
    joined = packed.join(of_class, "vector", "left")
    unnamed = F.col("vec_id").isNull()
    out = joined.select("vec_id", F.when(unnamed, 0).otherwise(F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.when(~unnamed, F.coalesce("component_id", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))).withColumn("audited_recall", F.lit(recall).cast("double"))


def op3_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
