"""Sharding by a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import splitmix, stored, table


def feistel(rows: np.ndarray, n: int, seed: int, rounds: int = 6) -> np.ndarray:
    """The places of row numbers below n in a keyed permutation of range(n).

    A balanced Feistel network permutes the smallest domain of 4**k values that holds n; values that fall outside of range(n) walk
    on along their cycle until they are inside, so every result is below n and no two agree.
    """
    if n <= 1:
        return np.zeros(len(rows), np.int64)
    bits = np.uint64(max(1, (int(n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    keys = splitmix(np.arange(rounds, dtype=np.uint64) + np.uint64(seed))
    out = rows.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        x = out[walking]
        left, right = x >> bits, x & mask
        for key in keys:
            left, right = right, left ^ (splitmix(right ^ key) & mask)
        out[walking] = x = (left << bits) | right
        walking = walking[x >= np.uint64(n)]
    return out.astype(np.int64)


def numbered(rows: DataFrame, order: list[str], label: str) -> tuple[DataFrame, int]:
    """rows with `row_no`, 0 .. n-1 in the order given, and n.

    One range shuffle; what the driver gets is one count a partition. The sorted rows are stored before they are counted, so a
    rerun of lost tasks can't move the numbers.
    """
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    kept = stored(ordered.withColumn("_part", F.shiftright(at, 33)).withColumn("_at", at.bitwiseAND(F.lit((1 << 33) - 1))), label)
    counts = {r["_part"]: r["n"] for r in kept.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, n = [], 0
    for part in sorted(counts):
        starts.append((part, n))
        n += counts[part]
    offsets = rows.sparkSession.createDataFrame(starts, "_part long, _start long")
    # as many rows as the sort has partitions
    return kept.join(F.broadcast(offsets), "_part").withColumn("row_no", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start"), n


def shuffle_shards(documents: DataFrame, shards: int = 40, seed: int = 20240607) -> DataFrame:
    """doc_id, size, text_crc32, law 'rows', shard, slot, grown_shard (null).

    Rows get global numbers in the order of (doc_id, text_crc32, size); the permuted number p goes to shard p % shards, slot
    p // shards. Shard sizes so differ by one row at most and slots have no gaps; any row's place follows from its number, the row
    count and the seed alone. Only ids, sizes and checksums are shuffled, never texts.

    Null text: size 16, checksum of no bytes (0). Null ids sort first. Repeated rows keep a row each; rows equal in all three
    values are interchangeable. An empty table gives an empty result. Other columns are ignored.
    """
    raw = F.col("text").cast("binary")
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(raw), F.lit(0)).cast("long") + 16).alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
    )
    rows, n = numbered(rows, ["doc_id", "text_crc32", "size"], "sharding")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = feistel(batch.column("row_no").to_numpy(zero_copy_only=False), n, seed)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("size"), batch.column("text_crc32"), pa.array((at % shards).astype(np.int32)), pa.array(at // shards)],
                names=["doc_id", "size", "text_crc32", "shard", "slot"],
            )

    out = rows.mapInArrow(place, "doc_id long, size long, text_crc32 long, shard int, slot long")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffle_shards(table(spark, sf_dir, "documents"))
