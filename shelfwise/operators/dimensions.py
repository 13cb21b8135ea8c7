"""The entity dimensions of the star schema, with surrogate keys and resolved foreign keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.io import stored
from ..sources.roles import Roles


def with_key(df: DataFrame, natural: str, key: str) -> DataFrame:
    """df with a first column `key`, 1..n in the order of the natural key.

    Rows are range-sorted and numbered within their partition; the rows of the partitions before are added from a table of one row
    a partition. So no task sorts all rows.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = stored(df.orderBy(natural).select("*", F.spark_partition_id().alias("_part"), place.alias("_place")), f"keyed-{key}")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    return placed.join(F.broadcast(starts), "_part").select((F.col("_before") + F.col("_place") + 1).alias(key), *df.columns)


def _resolved(df: DataFrame, name: str) -> DataFrame:
    """df, if no column of any row is null; else an error that names the columns."""
    nulls = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns)).first().asDict()
    if any(nulls.values()):
        raise ValueError(f"{name}: null or unresolved key in " + ", ".join(f"{c} ({n} rows)" for c, n in nulls.items() if n))
    return df


def build_dimensions(r: Roles, part: DataFrame, region: DataFrame, supplier: DataFrame, nation: DataFrame) -> dict[str, DataFrame]:
    """The five entity dimensions by name; a null or a foreign key without its row is an error.

    Keys count from 1 in natural-key order. Columns that only describe how the data were made are not carried over.
    """
    category = with_key(part.select(F.col("p_type").alias("category")).distinct(), "category", "category_sk")
    items = part.select(F.col("p_partkey").alias("item_key"), F.col("p_name").alias("item_name"), F.col("p_type").alias("category"), F.col("p_brand").alias("maker"))
    item = with_key(items, "item_key", "item_sk").join(category, "category", "left").select("item_sk", "item_key", "item_name", "category_sk", "maker")
    site = with_key(region.select(F.col("r_name").alias("site"), F.col("r_regionkey").alias("site_key")), "site", "site_sk")
    at = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("area"))
    suppliers = supplier.join(at, "s_nationkey", "left").select(F.col("s_suppkey").alias("supplier_key"), F.col("s_name").alias("supplier_name"), "area")
    supplied = with_key(suppliers, "supplier_key", "supplier_sk")
    batch = (
        with_key(r.batches.select("batch_id", "item_key", "supplier_key", "first_day_no", "expiry_day_no", "initial_quantity", "cost_c"), "batch_id", "batch_sk")
        .join(item.select("item_key", "item_sk"), "item_key", "left").join(supplied.select("supplier_key", "supplier_sk"), "supplier_key", "left")
        .select("batch_sk", "batch_id", "item_sk", "supplier_sk", "first_day_no", "expiry_day_no", "initial_quantity", "cost_c")
    )
    made = {"category": category, "item": item, "site": site, "supplier": supplied, "batch": batch}
    return {name: _resolved(df, name) for name, df in made.items()}


#: The same dimensions as SQL.
_NUMBERED = "row_number() over (order by {})"
DIMENSION_SQL = {
    "category": f"select {_NUMBERED.format('category')} as category_sk, category from (select distinct p_type as category from part) c",
    "site": f"select {_NUMBERED.format('r_name')} as site_sk, r_name as site, r_regionkey as site_key from region",
    "supplier": f"select {_NUMBERED.format('s_suppkey')} as supplier_sk, s_suppkey as supplier_key, s_name as supplier_name, n_name as area from supplier join nation on n_nationkey = s_nationkey",
    "item": f"""select {_NUMBERED.format('p_partkey')} as item_sk, p_partkey as item_key, p_name as item_name, c.category_sk, p_brand as maker from part
      join (select {_NUMBERED.format('category')} as category_sk, category from (select distinct p_type as category from part) c0) c on c.category = p_type""",
    "batch": f"""select {_NUMBERED.format('batch_id')} as batch_sk, batch_id, i.item_sk, s.supplier_sk, first_day_no, expiry_day_no, initial_quantity, cost_c from t_batches b
      join (select {_NUMBERED.format('p_partkey')} as item_sk, p_partkey as item_key from part) i on i.item_key = b.item_key
      join (select {_NUMBERED.format('s_suppkey')} as supplier_sk, s_suppkey as supplier_key from supplier) s on s.supplier_key = b.supplier_key""",
}
