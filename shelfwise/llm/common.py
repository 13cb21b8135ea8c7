"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
import zlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a worker unpacks from an Arrow batch at once.
SLICE_ROWS = 256
#: Entries after which a worker empties a word cache.
CACHE_ENTRIES = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shelfwise-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class WordHashes(dict):
    """Cache: word in bytes -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_ACTIVE: dict = {}


def worker_cache(key, make):
    """The worker's cache for `key`; that of another operator, which ran before in the same worker, goes."""
    if key not in _ACTIVE:
        _ACTIVE.clear()
        _ACTIVE[key] = make()
    return _ACTIVE[key]

#: Odd multipliers of the splitmix64 generator.
MIX_A, MIX_B, GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of every value (splitmix64's finaliser)."""
    x = x + GOLDEN
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(worker_cache("hashes", WordHashes).__getitem__, words), dtype=np.uint64, count=len(words))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of `width` words in order; empty if there are fewer words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n]
    for k in range(1, width):
        out = splitmix(out) + hashes[k : k + n]
    return splitmix(out)


def held_out(doc_id) -> bool | None:
    """The split of the labels: crc32 of the id as text, modulo 5, is 0; null for a null id."""
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % 5 == 0


def fit_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) of the rows that a fit may learn from: those that are not held out.

    Labels other than 0 and 1 and null ids are ignored, an id with contradicting labels counts by its largest.
    """
    rows = labels.select(F.col("doc_id").alias("doc_id"), F.col(column).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    return rows.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).groupBy("doc_id").agg(F.max("label").alias("label"))


def label_sample(rows: DataFrame, per_class: int) -> tuple[DataFrame, float | None]:
    """At most per_class rows of either class of fit_labels, the first by a hash of doc_id, and the share of label 1 among all rows.

    The bound keeps the fit's input independent of the corpus; the share is null without rows.
    """
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = rows.where("label = 0").orderBy(*order).limit(per_class).unionByName(rows.where("label = 1").orderBy(*order).limit(per_class))
    return sample, rows.agg(F.avg("label")).first()[0]
