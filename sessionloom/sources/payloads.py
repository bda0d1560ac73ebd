"""Vendor JSON payloads to rows, with built-in JSON and array functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_D = "array<double>"
CHART = (f"struct<chart:struct<result:array<struct<timestamp:array<bigint>,indicators:struct<"
         f"quote:array<struct<open:{_D},high:{_D},low:{_D},close:{_D},volume:{_D}>>,"
         f"adjclose:array<struct<adjclose:{_D}>>>>>>>")
RECORD = "array<struct<date:string,open:double,high:double,low:double,close:double,volume:double,adjClose:double>>"


def fit_length(xs: Column, n: Column) -> Column:
    """Array padded with nulls or cropped to ``n`` elements."""
    xs = F.coalesce(xs, F.array().cast(_D))
    return F.slice(F.concat(xs, F.array_repeat(F.lit(None).cast("double"), n)), F.lit(1), n)


def parse_chart_json(df: DataFrame, raw: str = "raw", keep=("ticker",)) -> DataFrame:
    """Parallel arrays -> one row per time stamp; adjusted close falls back to close; no close, no row."""
    d = df.select(*keep, F.from_json(raw, CHART)["chart"]["result"].alias("_r"))
    d = d.select(*keep, F.get("_r", F.lit(0)).alias("_r")).filter(F.size("_r.timestamp") > 0)
    q, n = F.get(F.col("_r.indicators.quote"), F.lit(0)), F.size("_r.timestamp")
    adj = F.get(F.col("_r.indicators.adjclose"), F.lit(0))["adjclose"]
    close = fit_length(q["close"], n)
    z = F.arrays_zip(F.col("_r.timestamp").alias("t"), *[fit_length(q[f], n).alias(f) for f in ("open", "high", "low")],
                     close.alias("close"), fit_length(q["volume"], n).alias("volume"),
                     F.when(F.size(adj) == n, adj).otherwise(close).alias("adj_close"))
    rows = d.select(*keep, F.inline(z))
    return rows.filter("close is not null").select(
        *keep, F.to_date(F.timestamp_seconds("t")).alias("date"), "open", "high", "low", "close", "volume", "adj_close")


def parse_record_json(df: DataFrame, raw: str = "raw", keep=("ticker",)) -> DataFrame:
    d = df.select(*keep, F.inline(F.from_json(raw, RECORD)))
    return d.select(*keep, F.to_date(F.substring("date", 1, 10)).alias("date"), "open", "high", "low", "close", "volume",
                    F.col("adjClose").alias("adj_close"))
