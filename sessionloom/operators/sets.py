"""Sorts, limits and set operations on rows or on list members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import cols, last_per


def _order(keys):
    return [F.col(k).asc() if up else F.col(k).desc() for k, up in keys]


def sort_rows(df: DataFrame, keys) -> DataFrame:
    """Total order by (column, ascending) pairs; Spark range-partitions the sort."""
    return df.orderBy(*_order(keys))


def first_k(df: DataFrame, k: int, keys) -> DataFrame:
    return df.orderBy(*_order(keys)).limit(k)


def union_keep_last(older: DataFrame, newer: DataFrame, keys) -> DataFrame:
    both = older.withColumn("_v", F.lit(0)).unionByName(newer.withColumn("_v", F.lit(1)))
    return last_per(both, cols(keys), "_v").drop("_v")


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def symmetric_difference(a: DataFrame, b: DataFrame, on) -> DataFrame:
    """Keys of exactly one side, with the side; one aggregation over both inputs."""
    k = cols(on)
    both = a.select(*k, F.lit(1).alias("_s")).unionByName(b.select(*k, F.lit(2).alias("_s")))
    g = both.groupBy(*k).agg(F.min("_s").alias("_a"), F.max("_s").alias("_b")).filter("_a = _b")
    return g.select(*k, F.when(F.col("_a") == 1, "left").otherwise("right").alias("side"))


def distinct_members(df: DataFrame, lists: str, out: str) -> DataFrame:
    return df.select(F.explode(lists).alias(out)).distinct()
