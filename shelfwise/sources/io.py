"""Sources and sinks: strict CSV contracts, previews, fingerprints, staged mart writes, report runs and exports."""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY, INTEGER = r"^\d+\.\d{2}$", r"^\d+$"
KINDS = {"text": None, "money": MONEY, "int": INTEGER}


def read_source(spark: SparkSession, path: str, contract: dict[str, str]) -> DataFrame:
    """A CSV file as text, its header in the order of the contract (column -> text, money or int); another header is an error."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in contract])
    found = spark.read.option("header", True).csv(path).columns
    if found != list(contract):
        raise ValueError(f"columns are {found}, not {list(contract)}")
    return spark.read.option("header", True).schema(schema).csv(path)


def violations(df: DataFrame, contract: dict[str, str], key: list[str]) -> DataFrame:
    """(rule, n) of broken rules, in one aggregation over the table and one over its keys."""
    counts: dict[str, Column] = {}
    for c, kind in contract.items():
        counts[f"{c}: empty"] = F.count_if(F.coalesce(F.trim(c), F.lit("")) == "")
        if KINDS[kind]:
            counts[f"{c}: not {kind}"] = F.count_if(~F.col(c).rlike(KINDS[kind]))
    once = df.agg(*(v.alias(str(k)) for k, v in enumerate(counts.values())))
    pairs = F.array(*(F.struct(F.lit(name).alias("rule"), F.col(str(k)).alias("n")) for k, name in enumerate(counts)))
    repeated = df.groupBy(*key).count().where("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("key: repeated").alias("rule"), "n")
    return once.select(F.explode(pairs).alias("p")).select("p.rule", "p.n").unionByName(repeated)


def preview(spark: SparkSession, path: str, n: int = 20) -> DataFrame:
    return spark.read.option("header", True).csv(path).limit(n)


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-free sum of row hashes."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("hash_sum"))


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
    """df written once to the shared folder and read from there."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def source_state(spark: SparkSession, paths: list[str]) -> tuple:
    """(path, bytes, time of change) of every file under the paths: another state is another source."""
    hadoop, out = spark._jvm.org.apache.hadoop.fs.Path, []
    for path in paths:
        at = hadoop(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        found = fs.listFiles(at, True)
        while found.hasNext():
            f = found.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def write_mart(tables: dict[str, DataFrame], path: str) -> None:
    """All tables as a new version of the mart, which readers see once every one is written.

    A version is a folder of its own; the pointer file that names it is replaced by one rename, and the version before the last one
    is kept, so that there is a whole mart at any time, whatever fails.
    """
    spark = next(iter(tables.values())).sparkSession
    version = f"v-{time.time_ns()}-{uuid.uuid4().hex[:8]}"
    for name, df in tables.items():
        df.write.parquet(f"{path}/{version}/{name}")
    hadoop, options = spark._jvm.org.apache.hadoop.fs, spark._jvm.org.apache.hadoop.fs.Options.Rename
    where = hadoop.Path(path)
    context = hadoop.FileContext.getFileContext(where.toUri() if where.toUri().getScheme() else hadoop.Path(f"file:{path}").toUri(), spark._jsc.hadoopConfiguration())
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    pointer = fs.create(hadoop.Path(f"{path}/{version}.current"), True)
    pointer.write(version.encode())
    pointer.close()
    kinds = spark.sparkContext._gateway.new_array(options, 1)
    kinds[0] = options.OVERWRITE
    context.rename(hadoop.Path(f"{path}/{version}.current"), hadoop.Path(f"{path}/CURRENT"), kinds)
    versions = sorted(f.getPath().getName() for f in fs.listStatus(where) if f.isDirectory() and f.getPath().getName().startswith("v-"))
    for old in versions[:-2]:
        fs.delete(hadoop.Path(f"{path}/{old}"), True)


def read_mart(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    version = spark.read.text(f"{path}/CURRENT").first()[0]
    return {name: spark.read.parquet(f"{path}/{version}/{name}") for name in names}


def run_reports(spark: SparkSession, reports: dict[str, Callable[[], DataFrame]], path: str, names: list[str] | None = None) -> DataFrame:
    """Writes the reports (all, or those named) and returns the log: name, rows, seconds, status. A failing report doesn't stop the rest."""
    log = []
    for name in names or list(reports):
        began = time.time()
        try:
            reports[name]().write.mode("overwrite").parquet(f"{path}/{name}")
            log.append((name, spark.read.parquet(f"{path}/{name}").count(), time.time() - began, "OK"))
        except Exception as error:
            log.append((name, None, time.time() - began, f"{type(error).__name__}: {str(error)[:200]}"))
    return spark.createDataFrame(log, "name string, rows long, seconds double, status string")


def load_report(spark: SparkSession, path: str, name: str, cond: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A stored report; the condition and the columns reach the scan."""
    df = spark.read.parquet(f"{path}/{name}")
    df = df.where(cond) if cond else df
    return df.select(*columns) if columns else df


def export(results: dict[str, DataFrame], path: str, summary: dict) -> None:
    """Results as CSV (nested columns as JSON) and the summary as a JSON text file."""
    for name, df in results.items():
        nested = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)]
        df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
    spark = next(iter(results.values())).sparkSession
    spark.createDataFrame([(json.dumps(summary, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/summary")


def template(schema: T.StructType) -> str:
    """The header line that an upload of this schema needs."""
    return ",".join(schema.fieldNames())
