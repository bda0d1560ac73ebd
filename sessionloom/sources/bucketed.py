"""Panels stored by key: windows and joins on the key read them without an exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..frames import cols
from ..session import scratch_path

ROWS_PER_BUCKET = 1 << 20


def bucket_count(df: DataFrame, rows: int = ROWS_PER_BUCKET) -> int:
    """Buckets of about ``rows`` rows; counted, so it grows with the table."""
    return max(1, min(100_000, -(-df.count() // rows)))


def write_bucketed(df: DataFrame, key="ticker", order="date", buckets: int | None = None, path: str | None = None, name: str | None = None) -> DataFrame:
    """``df`` as a table of ``buckets`` sorted files, hashed on ``key``; returns the table.

    Rows are shuffled once, on the way in: one file per bucket, so the sort order
    of a file is that of its bucket. Tables that are to be joined need equal
    ``buckets``. Without ``path`` the files lie in this application's part of the
    shared folder. A key with more rows than a bucket makes that bucket larger:
    meant for bars, where a key has at most one row per session.
    """
    spark = df.sparkSession
    n = buckets or bucket_count(df)
    name = name or f"bucketed_{uuid.uuid4().hex}"
    dealt = df.repartition(n, *cols(key))
    out = dealt.write.bucketBy(n, *cols(key)).sortBy(*cols(key), *cols(order)).format("parquet")
    out.option("path", path or scratch_path(spark, name)).saveAsTable(name)
    return spark.table(name)
