"""Joins that put gates and gauges on live ticks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.gates import entry_gate, exit_gate
from ..operators.joins import as_of

ROWS = 65536  # in a batch that leaves Python


def exit_signals(ticks: DataFrame, positions: DataFrame) -> DataFrame:
    """Ticks joined with the day's positions (persona, ticker, date, prev_close, vix) and the exit rule."""
    t = ticks.withColumn("date", F.to_date("ts"))
    j = t.join(positions, ["ticker", "date"])
    g = exit_gate(F.col("persona"), F.col("ticker"), F.col("price"), F.col("prev_close"), F.col("vix"))
    return j.select("persona", "ticker", "date", "ts", "seq", "price", g.alias("gate"))


def entry_signals(bars: DataFrame, orders: DataFrame) -> DataFrame:
    """Running day bars joined with pending orders (persona, ticker, prev_close, vwap, expected_volume, vix, witching)."""
    j = bars.join(orders, ["ticker", "date"])
    c = F.col
    g = entry_gate(c("persona"), c("price"), c("prev_close"), c("vwap"), c("vix"), c("witching"), c("volume"), c("expected_volume"))
    return j.select("persona", "ticker", "date", g.alias("gate"))


def with_latest_gauge(batch: DataFrame, gauge: DataFrame, value: str = "gauge") -> DataFrame:
    """Each tick of a batch with the gauge value known at its time; one gauge for all tickers.

    Only the gauge rows within the batch's time span, and those of the last
    instant before it, are read: the gauge's history is never sliced again.
    """
    first, last = batch.agg(F.min("ts"), F.max("ts")).first()
    start = gauge.filter(F.col("gauge_ts") <= F.lit(first)).agg(F.max("gauge_ts")).first()[0] if first else None
    near = gauge.filter(F.col("gauge_ts") <= F.lit(last)) if start is None else gauge.filter(F.col("gauge_ts").between(F.lit(start), F.lit(last)))
    b, g = batch.withColumn("_all", F.lit(1)), near.withColumn("_all", F.lit(1))
    return as_of(b, g, value, keys="_all", left_time="ts", right_time="gauge_ts").drop("_all")


def _newest_known(max_age: int):
    """Per row (a cell: its ticks, its gauges, the newest gauge before it) each tick once, with the gauge known at its time."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ticks = pa.RecordBatch.from_struct_array(b.column("ticks").slice(i, 1).flatten())
                if not ticks.num_rows:
                    continue
                ticks = pa.Table.from_batches([ticks]).group_by(ticks.schema.names).aggregate([]).combine_chunks()
                own, before = (b.column(c).slice(i, 1) for c in ("own", "before"))
                known = pa.RecordBatch.from_struct_array(pa.concat_arrays([before.filter(before.is_valid()), own.flatten()]))
                known = known.take(pc.sort_indices(known, [("us", "ascending"), ("seq", "ascending")]))
                at, us = ticks.column("us").to_numpy(), known.column("us").to_numpy()
                last = np.searchsorted(us, at, "right") - 1
                near = last >= 0
                near[near] = at[near] - us[last[near]] <= max_age * 1_000_000
                gauge = known.column("gauge").take(pa.array(last, pa.int64(), mask=~near))
                for lo in range(0, len(at), ROWS):
                    part = ticks.slice(lo, ROWS).combine_chunks().to_batches()[0]
                    yield pa.RecordBatch.from_arrays([*part.columns, gauge.slice(lo, ROWS)], [*part.schema.names, "gauge"])
    return scan


def live_gauge(ticks: DataFrame, gauge: DataFrame, max_age: int = 3600, watermark: str = "10 minutes", spread: int = 8) -> DataFrame:
    """(ts, seq, ticker, price, gauge): each tick with the newest gauge value not older than ``max_age`` seconds, null without one.

    ``gauge`` is a stream of its own (gauge_ts, gauge_seq, gauge); of equal
    instants the greatest gauge_seq counts. A gauge that comes after its ticks,
    but within the watermark, is still used. All tickers share the gauge. State is
    one row per cell of time, ``spread`` of them to ``max_age``: the cell's ticks,
    its gauges and, of the gauges in the cells before, only the newest, as the
    others can be nobody's newest. So a row is stored once however many gauges an
    hour has; when the watermark closes a cell, one sorted search gives its ticks
    their gauges. Append mode; ticks with one (ts, seq, ticker, price) count once,
    and a tick is emitted when the watermark has passed its cell.
    """
    width = -(-max_age // spread)
    left = ticks.select("ts", "seq", "ticker", "price").withWatermark("ts", watermark)
    right = gauge.select("gauge_ts", "gauge_seq", "gauge").withWatermark("gauge_ts", watermark)
    tick = F.struct(F.unix_micros("ts").alias("us"), "seq", "ticker", "price")
    value = F.struct(F.unix_micros("gauge_ts").alias("us"), F.col("gauge_seq").alias("seq"), "gauge")
    kinds = {"us": "long", **{c: t for c, t in left.dtypes if c != "ts"}, "gauge": dict(right.dtypes)["gauge"]}
    cells = F.posexplode(F.sequence(F.lit(0), F.lit(-(-max_age // width)))).alias("_ahead", "_cells")
    reach = right.select("*", cells).select((F.col("gauge_ts") + F.make_dt_interval(secs=F.col("_cells") * width)).alias("at"), "_ahead", value.alias("value"))
    both = left.select(F.col("ts").alias("at"), tick.alias("tick")).unionByName(
        reach.select("at", F.when(F.col("_ahead") == 0, F.col("value")).alias("own"), F.when(F.col("_ahead") > 0, F.col("value")).alias("before")), allowMissingColumns=True)
    closed = both.groupBy(F.window("at", f"{width} seconds")).agg(
        F.collect_list("tick").alias("ticks"), F.collect_list("own").alias("own"),
        F.max_by("before", F.struct("before.us", "before.seq")).alias("before"))
    known = closed.select("ticks", "own", "before").mapInArrow(_newest_known(max_age), ", ".join(f"{c} {t}" for c, t in kinds.items()))
    return known.select(F.timestamp_micros("us").alias("ts"), "seq", "ticker", "price", "gauge")
