"""Joins on nearness and on overlap, by buckets: an equi-join brings together what may match, an exact condition decides.

A range condition alone makes Spark compare every row of a key with every other, days squared for a daily series. Cut into buckets, a
key's rows only meet those of the same or a neighbouring bucket, and the bucket is part of the join's key, so it spreads hot keys too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_value: str, right_value: str, reach: int) -> DataFrame:
    """Rows of both sides with equal keys and values at most `reach` (1 or more) apart; each pair once.

    Buckets are `reach` wide: a row's partners lie in its own bucket or one of the two beside it. Null keys and values match nothing.
    Columns of both sides but for the keys have to have different names.
    """
    bucket = lambda c: F.floor(F.col(c) / reach).cast("long")
    near = right.withColumn("_bucket", F.explode(F.sequence(bucket(right_value) - 1, bucket(right_value) + 1)))
    met = left.withColumn("_bucket", bucket(left_value)).join(near, [*keys, "_bucket"])
    return met.where(F.abs(F.col(left_value) - F.col(right_value)) <= reach).drop("_bucket")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int) -> DataFrame:
    """Rows of both sides with equal keys whose spans (first, last; both included) overlap; each pair once.

    Every span has a row for each bucket of `width` that it touches; of a pair's common buckets the first counts, which is that in
    which the later one begins. A span of n buckets is copied n times, so width should be about a usual span. Spans with a null end or
    that end before they begin match nothing.
    """

    def cut(df: DataFrame, span: tuple[str, str], name: str) -> DataFrame:
        first, last = (F.floor(F.col(c) / width).cast("long") for c in span)
        return df.where(F.col(span[0]) <= F.col(span[1])).withColumn(name, first).withColumn("_bucket", F.explode(F.sequence(first, last)))

    met = cut(left, left_span, "_left").join(cut(right, right_span, "_right"), [*keys, "_bucket"])
    met = met.where(F.col("_bucket") == F.greatest("_left", "_right"))
    return met.where((F.col(left_span[0]) <= F.col(right_span[1])) & (F.col(right_span[0]) <= F.col(left_span[1]))).drop("_bucket", "_left", "_right")
