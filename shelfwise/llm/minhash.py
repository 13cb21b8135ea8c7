"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find grouping."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_ROWS, splitmix, stored, table, windows, word_hashes
from .components import components

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@dataclass(frozen=True)
class Similarity:
    """Link if 100 * intersection >= percent * union over sets of `width`-word shingles."""

    width: int = 5
    percent: int = 80
    bands: int = 25
    rows: int = 5
    #: rows that a task compares with each other at once; larger groups are dealt out in blocks
    block: int = 128
    #: keys over which the members of one hub are dealt for look-ups by hub
    salts: int = 64


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted set of the text's shingle hashes; the whole sequence is one if there are fewer words; empty without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    if len(words) < width:
        return windows(hashes, len(words)) + np.uint64(len(words))
    return np.unique(windows(hashes, width))


def super_minhash(elements: np.ndarray, set_of: np.ndarray, n_sets: int, slots: int, seed: int = 7) -> np.ndarray:
    """Signatures, n_sets x slots, of sets given as their elements' hashes and set numbers (ascending, none empty).

    Element e draws for each rank j in turn a slot from its own random permutation and offers j + r with r uniform in [0, 1);
    a slot keeps the least offer. Ranks of one element are so spread over all slots, which lowers the variance. A set stops at the
    rank at which every slot holds an offer of a lower rank, as no later one can win. Offers are 64-bit integers: the rank in the
    top byte, r below.
    """
    top = np.uint64(np.iinfo(np.uint64).max)
    out = np.full(n_sets * slots, top, np.uint64)
    stream = splitmix(elements ^ np.uint64(seed * 0x9E37))
    live = np.ones(n_sets, bool)
    place: np.ndarray | None = None
    for rank in range(slots):
        draw = splitmix(stream + np.uint64(rank * 0xD1B54A32D192ED03 % 2**64))
        pick = (rank + ((draw >> np.uint64(40)) * np.uint64(slots - rank) >> np.uint64(24))).astype(np.int64)
        offer = (np.uint64(rank) << np.uint64(56)) | (splitmix(draw) >> np.uint64(8))
        if place is None:
            slot = pick
        else:
            lines = np.arange(len(pick))
            slot = place[lines, pick].astype(np.int64)
            place[lines, pick] = place[:, rank]
            place[:, rank] = slot
        np.minimum.at(out, set_of * slots + slot, offer)
        worst = out.reshape(n_sets, slots).max(1)
        live = worst >= (np.uint64(rank + 1) << np.uint64(56))
        keep = live[set_of]
        if not keep.any():
            break
        if place is None:
            stream, set_of, pick = stream[keep], set_of[keep], pick[keep]
            place = np.broadcast_to(np.arange(slots, dtype=np.uint8), (len(stream), slots)).copy()
            place[np.arange(len(pick)), pick] = 0
            place[:, 0] = pick
        elif not keep.all():
            stream, set_of, place = stream[keep], set_of[keep], place[keep]
    return out.reshape(n_sets, slots)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signatures[:, : bands * rows].reshape(len(signatures), bands, rows)
    key = splitmix(np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]))
    for k in range(rows):
        key = splitmix(key ^ parts[:, :, k])
    return key.view(np.int64)


def text_key() -> F.Column:
    """What tells the texts of one id apart."""
    return F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("null"))


def _signed(documents: DataFrame, how: Similarity) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key (16 bytes; null for empty sets), keys (one for each band)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.string()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS // 2):
                batch = whole.slice(at, SLICE_ROWS // 2)
                sets = [shingles(t, how.width) for t in batch.column(1).to_pylist()]
                full = [k for k, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                if full:
                    sizes = [len(sets[k]) for k in full]
                    signatures = super_minhash(np.concatenate([sets[k] for k in full]), np.repeat(np.arange(len(full)), sizes), len(full), how.bands * how.rows)
                    for k, row in zip(full, band_keys(signatures, how.bands, how.rows)):
                        keys[k] = row
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(map(len, sets)), pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], schema=schema)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key().alias("text_key"))
    return rows.mapInArrow(sign, "doc_id long, text_key string, n_shingles long, set_key binary, keys array<long>")


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _links(sets: list[np.ndarray], probes: list[int], targets: list[int], percent: int, union: _Union) -> Iterator[tuple[int, int]]:
    """Links of probes with targets that join two groups which no link has joined so far."""
    if not probes or not targets:
        return
    sizes = np.array([len(sets[t]) for t in targets])
    items = np.concatenate([sets[t] for t in targets])
    owner = np.repeat(np.arange(len(targets)), sizes)
    order = np.argsort(items, kind="stable")
    items, owner = items[order], owner[order]
    for p in probes:
        low, high = np.searchsorted(items, sets[p]), np.searchsorted(items, sets[p], side="right")
        runs = high - low
        total = int(runs.sum())
        if not total:
            continue
        at = np.repeat(low - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(total)
        common = np.bincount(owner[at], minlength=len(targets))
        for t in np.flatnonzero(100 * common >= percent * (sizes + len(sets[p]) - common)).tolist():
            if targets[t] != p and union.join(p, targets[t]):
                yield p, targets[t]


def _verified(pairs: DataFrame, how: Similarity, first: bool) -> DataFrame:
    """Links (a, b) within the tasks' groups; for the first pass also (a, null) for members that hang not together with the hub.

    pairs: hub, block, doc_id, role (0 hub or target, 1 probe or member), text; grouped by a shuffle on (hub, block). Groups are
    bounded by how.block, they are read one at a time from the sorted partition.
    """

    def group(hub: int, ids: list[int], roles: list[int], texts: list[str]) -> tuple[list, list]:
        sets = [shingles(t, how.width) for t in texts]
        union = _Union(len(ids))
        order = sorted(range(len(ids)), key=lambda k: (roles[k], ids[k]))
        zero, one = [k for k in order if roles[k] == 0], [k for k in order if roles[k] == 1]
        a, b = [], []
        for x, y in _links(sets, one, zero, how.percent, union):
            a.append(ids[x]), b.append(ids[y])
        if first:
            base = [union.root(k) for k in zero[:1]]
            apart = [k for k in one if union.root(k) not in base]
            for x, y in _links(sets, apart, one, how.percent, union):
                a.append(ids[x]), b.append(ids[y])
            base = {union.root(k) for k in zero[:1]}
            for k in one:
                if union.root(k) not in base:
                    a.append(ids[k]), b.append(None)
        return a, b

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, roles, texts = None, [], [], []
        out_hub, out_a, out_b = [], [], []

        def close() -> None:
            if now is not None:
                a, b = group(now[0], ids, roles, texts)
                out_hub.extend([now[0]] * len(a)), out_a.extend(a), out_b.extend(b)

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(out_hub, pa.int64()), pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["hub", "a", "b"])
            out_hub.clear(), out_a.clear(), out_b.clear()
            return made

        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                for *key, doc_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("hub", "block", "block2", "doc_id", "role", "text")), strict=True):
                    if key != now:
                        close()
                        now, ids, roles, texts = key, [], [], []
                    ids.append(doc_id), roles.append(role), texts.append(text)
                if len(out_a) >= 5000:
                    yield batch_of()
        close()
        yield batch_of()

    rows = pairs.repartition("hub", "block", "block2").sortWithinPartitions("hub", "block", "block2", "role", "doc_id").select("hub", "block", "block2", "doc_id", "role", "text")
    return rows.mapInArrow(verify, "hub long, a long, b long")


def _members(bands: DataFrame, how: Similarity) -> DataFrame:
    """(hub, doc_id): each document with the hub of every bucket that it is in; the hub is the bucket's member with most company."""
    keys = bands.select("doc_id", F.explode("keys").alias("key"))
    full = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = stored(keys.join(full, "key"), "buckets")
    company = buckets.groupBy("doc_id").agg(F.sum("n").alias("company"))
    hubs = buckets.join(company, "doc_id").groupBy("key").agg(F.max_by("doc_id", F.struct("company", -F.col("doc_id"))).alias("hub"))
    return buckets.join(hubs, "key").select("hub", "doc_id").distinct()


def _block(n: str, of: str, how: Similarity) -> F.Column:
    return F.pmod(F.xxhash64(of), F.ceil(F.coalesce(F.col(n), F.lit(1)) / how.block)).cast("int")


def _of_hub(rows: DataFrame, per_hub: DataFrame, how: Similarity, kind: str = "inner") -> DataFrame:
    """rows (hub, doc_id, ...) with the values of their hub: a hub's rows are dealt over `salts` keys, per_hub is repeated for each."""
    salted = per_hub.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(how.salts - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(how.salts)).cast("int")).join(salted, ["hub", "salt"], kind).drop("salt")


def _blocks(n: str, how: Similarity) -> F.Column:
    return F.sequence(F.lit(0), F.ceil(F.col(n) / how.block).cast("int") - 1)


def near_links(texts: DataFrame, bands: DataFrame, how: Similarity, repeated: bool = False) -> DataFrame:
    """Links (a, b) between different sets that connect all that verified candidates connect.

    Candidates are the members of a bucket. A bucket's pairs are tested within the group of its hub: first every member against the
    hub and against its own block; then those that don't hang together with the hub, against all blocks. Members in one group
    already need no test, since only connections count. Every task gets at most two blocks of documents; rows grow with the
    members and, for members apart from the hub, with the number of blocks. `repeated`: an id may have several rows in texts, of
    which each different text counts.
    """
    members = stored(_members(bands, how), "members")
    # the members' texts: the only shuffle of texts, cut down to candidates by the semi join
    wanted = stored(texts.join(members.select("doc_id").distinct(), "doc_id", "left_semi"), "candidates")
    if repeated:
        wanted = stored(wanted.groupBy("doc_id", "text_key").agg(F.first("text").alias("text")), "candidates")
    wanted = wanted.select("doc_id", "text")
    sizes = stored(members.groupBy("hub").agg(F.count(F.lit(1)).alias("n")), "hubs")
    large = sizes.where(F.col("n") > how.block)
    # only large hubs have more than one block: their members alone find a size
    own = _of_hub(members.where("doc_id <> hub"), large, how, "left").select("hub", _block("n", "doc_id", how).alias("block"), "doc_id", F.lit(1).alias("role"))
    hub = sizes.select("hub", F.explode(_blocks("n", how)).alias("block"), F.col("hub").alias("doc_id"), F.lit(0).alias("role"))
    one = own.unionByName(hub).withColumn("block2", F.lit(0)).join(wanted, "doc_id")
    found = stored(_verified(one, how, first=True), "links")
    links = found.where("b is not null").select("a", "b")

    alone = found.where("b is null").select("hub", F.col("a").alias("doc_id"))
    apart_of = stored(alone.groupBy("hub").agg(F.count(F.lit(1)).alias("n_apart")).join(large, "hub"), "apart")
    probes = _of_hub(alone, apart_of, how).select("hub", F.explode(_blocks("n", how)).alias("block"), _block("n_apart", "doc_id", how).alias("block2"), "doc_id", F.lit(1).alias("role"))
    targets = _of_hub(members, apart_of, how).select("hub", _block("n", "doc_id", how).alias("block"), F.explode(_blocks("n_apart", how)).alias("block2"), "doc_id", F.lit(0).alias("role"))
    two = probes.unionByName(targets).join(wanted, "doc_id")
    return links.unionByName(_verified(two, how, first=False).select("a", "b"))


def _grouped(documents: DataFrame, how: Similarity, text_key: F.Column) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key for every document."""
    signed = stored(_signed(documents, how, text_key), "signed")
    named = signed.where("doc_id is not null and set_key is not null")
    classes = named.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    reps = named.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys")).select("set_key", "doc_id", "keys")
    # the text by which a class is compared; its texts have equal sets
    texts = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_key.alias("text_key"), F.col("text").cast("string").alias("text"))
    spoken = named.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("at")).select("at.doc_id", "at.text_key", "set_key")
    found = components(near_links(texts, spoken, reps, how))
    rep_of = classes.join(found, classes["rep"] == found["node"], "left").select("set_key", F.coalesce("component_id", "rep").alias("component_id"))
    out = signed.join(rep_of, "set_key", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), "text_key").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _grouped(documents: DataFrame, how: Similarity) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept for every document."""
    signed = stored(_signed(documents, how), "signed")
    named = signed.where("doc_id is not null and set_key is not null")
    classes = named.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"))
    # ids with several rows; those with several sets link them
    again = stored(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("set_key").alias("low"), F.max("set_key").alias("high")).where("n > 1"), "repeated")
    own = named.join(again.where("low <> high").select("doc_id"), "doc_id", "left_semi").join(classes.select("set_key", "rep"), "set_key")
    texts = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.col("text").cast("string").alias("text"))
    links = near_links(texts, classes.select(F.col("rep").alias("doc_id"), "keys"), how, repeated=not again.isEmpty())
    found = components(links.unionByName(own.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    rep_of = classes.join(found, classes["rep"] == found["node"], "left").select("set_key", F.coalesce("component_id", "rep").alias("component_id"))
    out = signed.join(rep_of, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(documents: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document.

    Documents with equal sets are one class, whose smallest id stands for it; only these are signed into buckets, so exact copies
    cost a partial aggregation. Links between representatives come from near_links, groups from components.

    Null or empty text, or white space only: n_shingles 0, linked with nothing. A null doc_id can't name a group: such a row is
    linked with nothing, component_id null, kept true. Repeated rows keep a row each. Rows of one id are one document: if their texts
    differ, what any of them links is linked. An empty table gives no rows; other columns are ignored.
    """
    return _grouped(documents, how).drop("text_key")


def op8_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Similarity(width=3, percent=85, bands=21, rows=6))


def without_near_duplicates(documents: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """documents, all columns, with one row of each near-duplicate group.

    That row has the group's smallest doc_id; of several such rows (an id that is repeated) the one whose text has the smallest MD5
    stays, of rows with that id and text the one whose columns have it as JSON. So what stays doesn't depend on the order of rows.
    Rows without an id and texts without words are linked with nothing: the former all stay, of the latter one of each id and text.
    Other columns may have any names. An empty table gives no rows.

    The verdicts are a row for each id and text and are joined by both: documents are shuffled once for it, at every size alike.
    """
    rows = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"))
    found = stored(_grouped(documents, how), "near-duplicates").where("doc_id is not null and kept")
    # of an id's texts one stays; texts without words are groups of their own
    verdict = found.groupBy("doc_id", F.when(F.col("n_shingles") == 0, F.col("text_key")).alias("alone")).agg(F.min("text_key").alias("text_key"), F.count(F.lit(1)).alias("rows"))
    joined = rows.join(verdict.select("doc_id", "text_key", "rows").hint("merge"), ["doc_id", "text_key"])
    one = joined.where("rows = 1").select("row")
    first = joined.where("rows > 1").groupBy("doc_id", "text_key").agg(F.min_by("row", F.md5(F.to_json("row"))).alias("row"))
    return one.unionByName(first.select("row")).unionByName(rows.where("doc_id is null").select("row")).select("row.*")
