"""Windowed bars, VWAP, sliding volume and activity sessions on a tick stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_bars(ticks: DataFrame, size: str = "1 minute", watermark: str = "10 minutes") -> DataFrame:
    o = F.struct("ts", "seq")
    g = ticks.withWatermark("ts", watermark).groupBy(F.window("ts", size).alias("w"), "ticker").agg(
        F.min_by("price", o).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", o).alias("close"), F.sum("size").alias("volume"))
    return g.select("ticker", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume")


def session_vwap(ticks: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Day-to-date VWAP and volume per ticker (update mode gives the running value)."""
    g = ticks.withWatermark("ts", watermark).groupBy(F.window("ts", "1 day").alias("w"), "ticker").agg(
        F.try_divide(F.sum(F.col("price") * F.col("size")), F.sum("size")).alias("vwap"), F.sum("size").alias("volume"))
    return g.select("ticker", F.to_date("w.start").alias("date"), "vwap", "volume")


def sliding_volume(ticks: DataFrame, size: str = "2 hours", slide: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    g = ticks.withWatermark("ts", watermark).groupBy(F.window("ts", size, slide).alias("w"), "ticker").agg(
        F.sum("size").alias("volume"), F.avg("price").alias("mean_price"))
    return g.select("ticker", F.col("w.start").alias("start"), "volume", "mean_price")


def activity_sessions(ticks: DataFrame, gap: str = "6 hours", watermark: str = "1 hour", key: str = "user") -> DataFrame:
    """Activity sessions per key, emitted when the watermark has passed their end (append mode)."""
    g = ticks.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap).alias("w"), key).agg(
        F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")
