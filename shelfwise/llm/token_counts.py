"""Token counts through a cache of digests: stored counts are joined, and only distinct texts without one are encoded.

A count depends on the normalised text and the tokenizer alone, so the cache maps (version of the tokenizer, digest of the text) to
a count. The version is a digest of the tokenizer's file, its library and the way it is called; a table of counts is partitioned by
it, so a run reads the counts of its own tokenizer only.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from .common import SLICE_ROWS, shared_dir, stored, table
from .vocab import byte_bpe, hf_tokenizer, piece_model, space_chunks, tokenizer_path

CACHE_SCHEMA = StructType().add("digest", StringType()).add("n_tokens", LongType())
#: Characters of texts that a call of a tokenizers library gets at most, apart from one longer text.
BATCH_CHARS = 1_000_000
#: Texts of more rows than this get their counts by a broadcast; there are at most rows / HOT_ROWS of them, and at most HOT_TEXTS.
HOT_ROWS, HOT_TEXTS = 1_000, 10_000


def tokenizer_version(path: str) -> str:
    """Digest of what a count depends on besides the text: the file, the library and its version, and the options of the call."""
    library = __import__("sentencepiece" if path.endswith(".model") else "tokenizers")
    with open(path, "rb") as file:
        found = hashlib.sha256(file.read())
    found.update(f"|{library.__name__} {library.__version__}|no special tokens, no truncation, no padding".encode())
    return found.hexdigest()


def normalised(text: Column, path: str) -> Column:
    """The form of a text that its tokens depend on: null is empty, and a tokenizer's own normalizer is applied if it has one.

    Texts that hold an added token are left as they are, for the library looks for those before or after it normalises.
    """
    text = F.coalesce(text, F.lit(""))
    if path.endswith(".model") or hf_tokenizer(path).normalizer is None:
        return text

    @F.pandas_udf("string")
    def normal(texts: pd.Series) -> pd.Series:
        tokenizer = hf_tokenizer(path)
        added = re.compile("|".join(re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        return texts.map(lambda t: t if added.search(t) else tokenizer.normalizer.normalize_str(t))

    return normal(text)


def counter(path: str, ranks_path: str | None) -> Callable[[list[str]], list[int]]:
    """Counts of texts by the library of the file; a byte-level tokenizer with an equal table of ranks encodes repeated chunks once."""
    if path.endswith(".model"):
        model = piece_model(path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    if ranks_path:
        cache = byte_bpe(path, ranks_path)
        return lambda texts: [sum(map(len, map(cache.__getitem__, space_chunks(t)))) // 4 if t else 0 for t in texts]
    tokenizer = hf_tokenizer(path)
    return lambda texts: [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def _encoded(texts: DataFrame, path: str, ranks_path: str | None) -> DataFrame:
    """digest, n_tokens of (digest, text)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, ranks_path)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                counts, waiting, chars = [], [], 0
                for text in batch.column(1).to_pylist():
                    if chars and chars + len(text) > BATCH_CHARS:
                        counts += count(waiting)
                        waiting, chars = [], 0
                    waiting.append(text)
                    chars += len(text)
                counts += count(waiting)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return texts.mapInArrow(encode, CACHE_SCHEMA)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_cache(spark: SparkSession, cache_dir: str, version: str) -> DataFrame:
    """digest, n_tokens: the counts stored for a version of a tokenizer, without those that two runs have stored both."""
    path = f"{cache_dir}/version={version}"
    found = spark.read.schema(CACHE_SCHEMA).parquet(path) if _exists(spark, path) else spark.createDataFrame([], CACHE_SCHEMA)
    return found.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(documents: DataFrame, cache_dir: str, path: str, ranks_path: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, was_cached of every document.

    Texts are read once for their digests, which are stored with the ids. The distinct digests are joined with the cache; for those
    it lacks, one document's text each is read, encoded and counted, and the counts are appended to the cache. Where these misses are
    few Spark broadcasts them, so that a warm run shuffles digests and no texts; else texts meet them by digest and id, which parts
    the copies of a text. Counts reach the documents by digest; those of very frequent texts (over HOT_ROWS rows, and no more than
    HOT_TEXTS of them whatever the table) by a broadcast.

    A run that fails before the append leaves the cache as it was; a part of an append is of whole rows and right; two runs may store
    the same count twice. If the folder of the cache is gone, everything is encoded again. ranks_path: a table of ranks that equals
    a byte-level tokenizer, or None.

    Null text: empty, no bytes, no tokens. Rows without an id and repeated rows keep their row. An empty table gives no rows and
    appends none. Other columns are ignored.
    """
    spark, version = documents.sparkSession, tokenizer_version(path)
    text = F.col("text").cast("string")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.sha2(normalised(text, path), 256).alias("digest"))
    # rows without an id take a number by their text: equal texts then share it, others don't meet
    owner = F.coalesce("doc_id", F.xxhash64("digest"))
    keys = stored(rows.select("doc_id", "digest", owner.alias("owner"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")), "token-keys")
    distinct = keys.groupBy("digest").agg(F.min("owner").alias("owner"), F.count(F.lit(1)).alias("n_rows"))
    looked = stored(distinct.join(read_cache(spark, cache_dir, version), "digest", "left"), "token-lookups")
    # a table of its own, whose size Spark knows before it plans the join with texts
    missing = stored(looked.where("n_tokens is null").select("digest", "owner"), "token-missing")
    texts = rows.withColumn("owner", owner).join(missing, ["digest", "owner"], "left_semi").select("digest", F.coalesce("text", F.lit("")).alias("text"))
    # a document that stands more than once in the table was encoded as often
    new = stored(_encoded(texts, path, ranks_path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-misses")
    new.write.mode("append").parquet(f"{cache_dir}/version={version}")
    hits = looked.where("n_tokens is not null").select("digest", "n_tokens", "n_rows", F.lit(True).alias("was_cached"))
    counts = hits.unionByName(new.join(looked.select("digest", "n_rows"), "digest").withColumn("was_cached", F.lit(False)))
    hot = F.broadcast(stored(counts.where(F.col("n_rows") > HOT_ROWS).orderBy(F.desc("n_rows"), "digest").limit(HOT_TEXTS).drop("n_rows"), "token-hot"))
    frequent = keys.join(hot, "digest")
    rest = keys.join(hot, "digest", "left_anti").join(counts.drop("n_rows"), "digest")
    out = frequent.unionByName(rest)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "was_cached")


#: The session's setting that names the folder of the cache.
CACHE_SETTING = "spark.shelfwise.tokenCache"


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is that of CACHE_SETTING; where it is unset, a new one in the shared folder, so that measured runs do the whole work."""
    cache_dir = spark.conf.get(CACHE_SETTING, None) or f"{shared_dir(spark)}/token-count-cache-{uuid.uuid4().hex}"
    return token_counts(table(spark, sf_dir, "documents"), cache_dir, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"))
