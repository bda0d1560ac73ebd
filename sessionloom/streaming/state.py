"""Once-only triggers, order time-outs and repeated deliveries.

All three are built-in aggregations or deduplication on event time, so a hot key
is combined before the shuffle and no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_triggers(signals: DataFrame, fires, keys=("persona", "ticker"), watermark: str = "1 day") -> DataFrame:
    """The earliest firing signal per key and day; a second one never replaces it."""
    k = list(keys)
    o = F.struct("ts", "seq")
    g = signals.filter(F.col("gate").isin(*fires)).withWatermark("ts", watermark).groupBy(F.window("ts", "1 day").alias("w"), *k).agg(
        F.min_by("gate", o).alias("gate"), F.min_by("price", o).alias("price"), F.min("ts").alias("ts"))
    return g.select(*k, F.to_date("w.start").alias("date"), "gate", "price", "ts")


def order_outcomes(ticks: DataFrame, limits: DataFrame, watermark: str = "10 minutes", close_at: str = "15 hours 55 minutes") -> DataFrame:
    """FILLED at the first tick at or over the limit, ABORTED when the session ends without one.

    The session window ends at ``close_at``; append mode emits it when the
    watermark passes that time, which is the time-out.
    """
    j = ticks.withWatermark("ts", watermark).join(limits, "ticker")
    o = F.when(F.col("price") >= F.col("limit_price"), F.struct("ts", "seq"))
    g = j.groupBy(F.window("ts", "1 day", startTime=close_at).alias("w"), "ticker").agg(F.min_by("price", o).alias("fill_price"))
    return g.select("ticker", F.to_date("w.end").alias("session"), "fill_price",
                    F.when(F.col("fill_price").isNull(), "ABORTED").otherwise("FILLED").alias("outcome"))


def batch_order_outcomes(ticks: DataFrame, limits: DataFrame, close_at: str = "15 hours 55 minutes") -> DataFrame:
    """The same outcomes from stored ticks."""
    o = F.when(F.col("price") >= F.col("limit_price"), F.struct("ts", "seq"))
    g = ticks.join(limits, "ticker").groupBy(F.window("ts", "1 day", startTime=close_at).alias("w"), "ticker").agg(
        F.min_by("price", o).alias("fill_price"))
    return g.select("ticker", F.to_date("w.end").alias("session"), "fill_price",
                    F.when(F.col("fill_price").isNull(), "ABORTED").otherwise("FILLED").alias("outcome"))


def without_repeats(ticks: DataFrame, keys=("seq",), watermark: str = "1 hour") -> DataFrame:
    return ticks.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(list(keys))
