"""Audit figures taken in passing from rows on their way to a table or a stream (``DataFrame.observe``)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..frames import KEYS, by, cols
from ..functions.scalars import holdings_total


def ledger_figures(tolerance: float = 0.05, skip=("RESTORED",), max_days: int = 31) -> dict[str, Column]:
    """Aggregates over ledger rows with :func:`gap_days`: balance, lost equity, nulls, gaps, open labels."""
    diff = F.abs(F.col("cash") + holdings_total(F.col("holdings")) - F.col("total_equity"))
    counted = ~F.coalesce(F.col("intraday_status"), F.lit("")).isin(*skip)
    return {"rows": F.count(F.lit(1)), "unbalanced": F.count_if(counted & (diff > tolerance)),
            "zero_equity": F.count_if(counted & (F.col("total_equity") < tolerance)),
            "null_cash": F.count_if(F.col("cash").isNull()), "null_equity": F.count_if(F.col("total_equity").isNull()),
            "gaps": F.count_if(F.col("gap_days") > max_days), "carried": F.count_if(F.col("intraday_status").startswith("CARRYOVER"))}


def gap_days(df: DataFrame, keys=KEYS, date: str = "date") -> DataFrame:
    """Days since the key's row before (null for its first)."""
    return df.withColumn("gap_days", F.date_diff(date, F.lag(date).over(by(cols(keys), date))))


def write_observed(df: DataFrame, path: str, figures: Mapping[str, Column], drop=(), name: str = "audit") -> dict:
    """Writes ``df`` (without ``drop``) as Parquet and returns its figures, taken by the tasks that write.

    The figures are taken after the last shuffle, in the stage that writes, where
    only the attempt of a task that counts is added; no second scan is made. Rows
    of an empty table give zero counts.
    """
    seen = Observation(name)
    out = df.observe(seen, *[c.alias(n) for n, c in figures.items()])
    out.drop(*drop).write.parquet(path)
    return seen.get


def stream_figures(query: StreamingQuery, name: str = "audit") -> list[dict]:
    """Figures of each finished batch of a stream that was built with ``observe(name, ...)``, oldest first.

    Of the batches that the engine's progress list still holds.
    """
    return [p.observedMetrics[name].asDict() for p in query.recentProgress if name in (p.observedMetrics or {})]
