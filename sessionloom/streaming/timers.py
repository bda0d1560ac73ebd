"""Orders that end by themselves: arbitrary state with event-time timers, many orders to a state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NO_TICK = 2**63 - 1
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def session_close(session: Column, close_at: str) -> Column:
    """The instant at which a session (a date) closes."""
    return session.cast("timestamp") + F.expr(f"INTERVAL {close_at}")


def session_of(ts: Column, close_at: str) -> Column:
    """The session a tick belongs to: the one that closes next."""
    return F.to_date(ts - F.expr(f"INTERVAL {close_at}") + F.expr("INTERVAL 1 DAY"))


class OrderTimers(StatefulProcessor):
    """The orders of one part of a close: whether each was placed, its earliest firing tick so far, and a timer that ends them all.

    They are held as one Arrow table, so a batch costs each part one read, one
    merge and one write of state, not one of each per order.
    """

    def __init__(self, keys: list[str]) -> None:
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "orders binary")

    def _merged(self, parts: list[pd.DataFrame]) -> pd.DataFrame:
        d = pd.concat(parts, ignore_index=True).sort_values(["us", "seq"])
        d["placed"] = d.groupby(self.keys, sort=False, dropna=False)["placed"].transform("max").astype(bool)
        return d.drop_duplicates(self.keys)

    def _read(self) -> pd.DataFrame:
        return pa.ipc.open_stream(self.held.get()[0]).read_pandas()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fields = [*self.keys, "placed", "us", "seq", "price"]
        known = self.held.exists()
        parts = [self._read()] if known else []
        for d in rows:
            parts.append(d[fields])
            if sum(map(len, parts[1:])) > len(parts[0]) + 65536:
                parts = [self._merged(parts)]
        if not known:
            self.handle.registerTimer(int(key[-1]) // 1000)
        out = pa.BufferOutputStream()
        table = pa.Table.from_pandas(self._merged(parts), preserve_index=False)
        with pa.ipc.new_stream(out, table.schema) as writer:
            writer.write_table(table)
        self.held.update((out.getvalue().to_pybytes(),))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        d = self._read()
        self.held.clear()
        d = d[d["placed"]]
        if len(d):
            fired = d["us"] != NO_TICK
            ends = {"fill_us": d["us"].astype("Int64").where(fired), "fill_price": d["price"], "outcome": fired.map({True: "FILLED", False: "ABORTED"}),
                    "empty": int(key[-2]), "close": int(key[-1])}
            yield d[self.keys].assign(**ends)[[*ends, *self.keys]]

    def close(self) -> None:
        pass


def _firsts(keys: list[str]):
    """Of each Arrow batch only the earliest firing tick of an order moves on, so a hot order is combined before the shuffle."""
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            yield d.sort_values(["us", "seq"]).drop_duplicates(keys)
    return scan


def order_timeouts(orders: DataFrame, ticks: DataFrame, limits: DataFrame, keys=("ticker",), watermark: str = "10 minutes",
                   close_at: str = "15 hours 55 minutes", parts: int = 64) -> DataFrame:
    """FILLED or ABORTED for every order of the stream ``orders`` when its session closes, whether its ticker ever ticks or not.

    ``orders`` has keys and session (date); ``ticks`` is a stream with the keys,
    ts, seq and price; ``limits`` is a static table with the keys and
    limit_price. A tick at or over the limit fires; the earliest one (ts, then
    seq) fills the order. The orders of a close are dealt by their keys to
    ``parts`` states, each with a timer at the close. The ticks of all keys
    together are the clock: a tick that is late by less than ``watermark`` still
    counts, and an order that comes after its close ends at once. A null limit
    never fires; a tick without an order is forgotten at the close. Repeated
    orders are one.
    """
    k, names = list(keys), [f"k{i}" for i in range(len(keys))]
    kinds = dict(orders.dtypes)
    part = F.pmod(F.xxhash64(*names), F.lit(parts)).cast("int").alias("part")
    fired = ticks.withWatermark("ts", watermark).join(limits, k).filter(F.col("price") >= F.col("limit_price"))
    tick_rows = fired.select(*[F.col(c).cast(kinds[c]).alias(n) for c, n in zip(k, names)], F.lit(0).alias("empty"),
                             F.unix_micros(session_close(session_of(F.col("ts"), close_at), close_at)).alias("close"), F.lit(False).alias("placed"),
                             F.unix_micros("ts").alias("us"), F.col("seq").cast("long").alias("seq"), F.col("price").cast("double").alias("price"), "ts")
    tick_rows = tick_rows.mapInPandas(_firsts([*names, "close"]), ", ".join(f"{c} {t}" for c, t in tick_rows.dtypes))
    # Pandas has no null integers: they travel as zero, and ``empty`` tells which keys they are.
    empty = sum((F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(k)), F.lit(0))
    order_rows = orders.select(*[(F.coalesce(F.col(c), F.lit(0).cast(kinds[c])) if kinds[c] in NUMBERS else F.col(c)).alias(n) for c, n in zip(k, names)],
                               empty.cast("int").alias("empty"), F.unix_micros(session_close(F.col("session"), close_at)).alias("close"), F.lit(True).alias("placed"),
                               F.lit(NO_TICK).alias("us"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("double").alias("price"), F.lit(None).cast("timestamp").alias("ts"))
    both = order_rows.unionByName(tick_rows).select("*", part)
    out = ", ".join(["fill_us long, fill_price double, outcome string, empty int, close long", *[f"{n} {kinds[c]}" for c, n in zip(k, names)]])
    ended = both.groupBy("part", "empty", "close").transformWithStateInPandas(OrderTimers(names), out, "Append", "EventTime")
    return ended.select(*[F.when(F.col("empty").bitwiseAND(1 << i) == 0, F.col(n)).alias(c) for i, (c, n) in enumerate(zip(k, names))],
                        F.to_date(F.timestamp_micros("close")).alias("session"),
                        F.when(F.col("fill_us").isNotNull(), F.timestamp_micros("fill_us")).alias("fill_ts"), "fill_price", "outcome")


def with_rocks(spark, fn):
    """What ``fn`` returns, with the state store that timers need; the session's own setting is put back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return fn()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
