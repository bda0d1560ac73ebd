"""R: Structured Streaming queries, run over the available events and read back."""

from pyspark.sql import functions as F

from .. import schemas
from ..frames import by
from ..session import scratch_path
from ..sources import replay
from ..streaming import bars, gates, sinks, source, state, timers
from .registry import query
from .sqltext import sql


def _ticks(c):
    return source.read_ticks(c.spark, f"{c.root}/events.parquet")


def _ntz(*names):
    return [F.col(n).cast("timestamp_ntz").alias(n) for n in names]


@query("r1_tick_source", sql("ticks", "SELECT ticker, seq, price, ts FROM ticks"))
def _(c):
    return sinks.materialise(_ticks(c), "ticks", mode="append").select("ticker", "seq", "price", *_ntz("ts"))


@query("r1_replayed_ticks", sql("ticks", "SELECT ticker, seq, price, ts FROM ticks"))
def _(c):
    path, base = f"{c.root}/events.parquet", scratch_path(c.spark, "replay")
    rows = -(-max(1, c.table("events").count()) // 6)  # six batches at every size
    d = source.as_ticks(replay.stream_replay(c.spark, path, rows, f"{base}/notes", schemas.TICKS))
    sinks.run_until_idle(d, sinks.batch_folder_sink(f"{base}/data"), f"{base}/checkpoint", "append")
    return c.spark.read.schema(d.schema).option("recursiveFileLookup", True).parquet(f"{base}/data").select("ticker", "seq", "price", *_ntz("ts"))


@query("r2_tumbling_bars", """SELECT event_type AS ticker, time_bucket(INTERVAL 5 MINUTE, ts) AS start, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, row(ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2""")
def _(c):
    d = sinks.materialise(bars.tumbling_bars(_ticks(c), "5 minutes"), "bars", ["ticker", "start"])
    return d.select("ticker", *_ntz("start"), "open", "high", "low", "close", "volume")


@query("r3_session_vwap", "SELECT event_type AS ticker, CAST(ts AS DATE) AS date, round(avg(value), 6) AS vwap, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2")
def _(c):
    return sinks.materialise(bars.session_vwap(_ticks(c)), "vwap", ["ticker", "date"])


@query("r4_sliding_volume", """WITH w AS (SELECT event_type AS ticker, value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events)
SELECT ticker, start, CAST(count(*) AS DOUBLE) AS volume, round(avg(value), 6) AS mean_price FROM w GROUP BY 1, 2""")
def _(c):
    d = sinks.materialise(bars.sliding_volume(_ticks(c)), "sliding", ["ticker", "start"])
    return d.select("ticker", *_ntz("start"), "volume", "mean_price")


@query("r5_activity_sessions", """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS brk FROM events),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g), a AS (SELECT user_id, s, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY 1, 2)
SELECT user_id AS "user", start, "end", n, total FROM a WHERE "end" <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def _(c):
    d = sinks.materialise(bars.activity_sessions(_ticks(c)), "sessions", mode="append")
    return d.select("user", *_ntz("start", "end"), "n", F.round("total", 4).alias("total"))


def _held(c):
    """Yesterday's close of every ticker as a position of three personas."""
    w = by()
    b = c.dense.select("ticker", "date", F.lag("close").over(w).alias("prev_close"), F.lag((F.col("high") + F.col("low") + F.col("close")) / 3).over(w).alias("vwap"),
                       F.lag("volume").over(w).alias("expected_volume"))
    p = F.explode(F.array(*[F.lit(x) for x in ("conservative", "neutral", "aggressive")]))
    return b.filter("prev_close is not null").select("*", p.alias("persona"), F.lit(18.0).alias("vix"), F.lit(False).alias("witching"))


_EXIT = """, h AS (SELECT ticker, date, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS pc FROM dense),
x AS (SELECT persona, t.ticker, t.date, t.ts, t.seq, t.price, 100 * (t.price - pc) / pc AS s, CASE persona WHEN 'conservative' THEN 5 WHEN 'aggressive' THEN 20 ELSE 10 END AS lv
  FROM ticks t JOIN h ON h.ticker = t.ticker AND h.date = t.date CROSS JOIN (SELECT unnest(['conservative', 'neutral', 'aggressive']) AS persona) u WHERE pc IS NOT NULL),
g AS (SELECT *, CASE WHEN s >= lv THEN 'TAKE_PROFIT' WHEN s <= -lv THEN 'STOP' ELSE 'HOLD' END AS gate FROM x)
"""


@query("r6_exit_signals", sql("dense", _EXIT + "SELECT persona, ticker, date, seq, price, gate FROM g"))
def _(c):
    return sinks.materialise(gates.exit_signals(_ticks(c), _held(c)), "exits", mode="append").select(
        "persona", "ticker", "date", "seq", "price", "gate")


@query("r6_entry_signals", sql("dense", """, h AS (SELECT ticker, date, volume, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS pc, lag((high + low + close) / 3) OVER (PARTITION BY ticker ORDER BY date) AS vw, lag(volume) OVER (PARTITION BY ticker ORDER BY date) AS ev FROM dense),
v AS (SELECT ticker, date, avg(price) AS price FROM ticks GROUP BY 1, 2)
SELECT persona, h.ticker, h.date, CASE WHEN vw IS NULL OR ev IS NULL THEN 'NO_DATA' WHEN NOT (v.price > pc AND v.price > vw * CASE persona WHEN 'conservative' THEN 1.01::DOUBLE WHEN 'aggressive' THEN 1.0025 ELSE 1.005 END) THEN 'WAIT' WHEN volume < ev * 0.5 THEN 'LOW_VOLUME' ELSE 'BUY' END AS gate
FROM h JOIN v ON v.ticker = h.ticker AND v.date = h.date CROSS JOIN (SELECT unnest(['conservative', 'neutral', 'aggressive']) AS persona) u WHERE pc IS NOT NULL"""))
def _(c):
    running = bars.session_vwap(_ticks(c)).withColumnRenamed("vwap", "price")
    return sinks.materialise(gates.entry_signals(running, _held(c)), "entries", ["persona", "ticker", "date"])


@query("r7_first_triggers", sql("dense", _EXIT + "SELECT persona, ticker, date, arg_min(gate, row(ts, seq)) AS gate, arg_min(price, row(ts, seq)) AS price, min(ts) AS ts FROM g WHERE gate <> 'HOLD' GROUP BY 1, 2, 3"))
def _(c):
    sig = gates.exit_signals(_ticks(c), _held(c))
    d = sinks.materialise(state.first_triggers(sig, ["TAKE_PROFIT", "STOP", "PANIC"]), "triggers", ["persona", "ticker", "date"])
    return d.select("persona", "ticker", "date", "gate", "price", *_ntz("ts"))


_LIMIT = """WITH l AS (SELECT event_type AS ticker, max(value) * 0.6 AS lim FROM events GROUP BY 1), t AS (SELECT event_type AS ticker, ts, event_id, value, CAST(time_bucket(INTERVAL 1 DAY, ts - INTERVAL '15 hours 55 minutes') + INTERVAL 1 DAY AS DATE) AS session FROM events),
o AS (SELECT t.ticker, session, arg_min(value, row(ts, event_id)) FILTER (value >= lim) AS fill_price FROM t JOIN l ON l.ticker = t.ticker GROUP BY 1, 2)
SELECT ticker, session, fill_price, CASE WHEN fill_price IS NULL THEN 'ABORTED' ELSE 'FILLED' END AS outcome FROM o"""


def _limits(c):
    return c.table("events").groupBy(F.col("event_type").alias("ticker")).agg((F.max("value") * 0.6).alias("limit_price"))


@query("r8_order_outcomes", _LIMIT + " WHERE session + INTERVAL '15 hours 55 minutes' <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def _(c):
    return sinks.materialise(state.order_outcomes(_ticks(c), _limits(c)), "outcomes", mode="append")


@query("r8_order_outcomes_batch", _LIMIT)
def _(c):
    return state.batch_order_outcomes(source.as_ticks(c.table("events")), _limits(c))


@query("r8_order_timeouts", """WITH d AS (SELECT CAST(min(ts) AS DATE) AS lo, CAST(max(ts) AS DATE) AS hi, max(ts) AS last FROM events),
o AS (SELECT user_id AS "user", max(value) * 0.6 AS lim, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS session FROM events, d GROUP BY 1, lo, hi),
t AS (SELECT user_id AS "user", ts, event_id, value, CAST(ts - INTERVAL '15 hours 55 minutes' + INTERVAL 1 DAY AS DATE) AS session FROM events),
f AS (SELECT o."user", o.session, arg_min(value, row(ts, event_id)) AS fill_price, min(ts) AS fill_ts FROM o JOIN t ON t."user" = o."user" AND t.session = o.session AND value >= lim GROUP BY 1, 2)
SELECT o."user", o.session, fill_ts, fill_price, CASE WHEN fill_price IS NULL THEN 'ABORTED' ELSE 'FILLED' END AS outcome
FROM o CROSS JOIN d LEFT JOIN f ON f."user" = o."user" AND f.session = o.session WHERE o.session + INTERVAL '15 hours 55 minutes' <= last - INTERVAL 10 MINUTE""")
def _(c):
    e = c.table("events")
    base = scratch_path(c.spark, "orders")
    days = e.agg(F.sequence(F.to_date(F.min("ts")), F.to_date(F.max("ts"))).alias("days")).scalar()  # bounded by the calendar
    limits = e.groupBy(F.col("user_id").alias("user")).agg((F.max("value") * 0.6).alias("limit_price"))
    limits.select("user", F.explode(days).alias("session")).write.parquet(f"{base}/orders")  # one order per user and session, ticks or not
    orders = c.spark.readStream.schema("user long, session date").parquet(f"{base}/orders")
    d = timers.order_timeouts(orders, _ticks(c), limits, ["user"])
    return timers.with_rocks(c.spark, lambda: sinks.materialise(d, "timeouts", mode="append")).select(
        "user", "session", *_ntz("fill_ts"), "fill_price", "outcome")


@query("r9_latest_gauge", """SELECT e.event_id AS seq, e.event_type AS ticker, g.value AS gauge FROM (SELECT * FROM events WHERE event_type <> 'error') e
  ASOF LEFT JOIN (SELECT ts, value FROM events WHERE event_type = 'error') g ON e.ts >= g.ts""")
def _(c):
    gauge = source.as_ticks(c.table("events")).filter("ticker = 'error'").select(F.col("ts").alias("gauge_ts"), F.col("price").alias("gauge"))
    base = scratch_path(c.spark, "gauge")
    ticks = _ticks(c).filter("ticker <> 'error'")
    sinks.run_available(ticks, sinks.with_batch(lambda b: gates.with_latest_gauge(b, gauge), f"{base}/data"), f"{base}/checkpoint", "append")
    return c.spark.read.option("basePath", f"{base}/data").parquet(f"{base}/data").select("seq", "ticker", "gauge")


@query("r9_live_gauge", """WITH g AS (SELECT ts, arg_max(value, event_id) AS value FROM events WHERE event_type = 'error' GROUP BY 1),
w AS (SELECT date_trunc('hour', least(max(ts) FILTER (event_type = 'error'), max(ts) FILTER (event_type <> 'error')) - INTERVAL 70 MINUTE) AS settled FROM events)
SELECT e.event_id AS seq, e.event_type AS ticker, e.value AS price, CASE WHEN e.ts - g.ts <= INTERVAL 1 HOUR THEN g.value END AS gauge
FROM (SELECT * FROM events, w WHERE event_type <> 'error' AND ts < settled) e ASOF LEFT JOIN g ON e.ts >= g.ts""")
def _(c):
    gauge = _ticks(c).filter("ticker = 'error'").select(F.col("ts").alias("gauge_ts"), F.col("seq").alias("gauge_seq"), F.col("price").alias("gauge"))
    d = sinks.materialise(gates.live_gauge(_ticks(c).filter("ticker <> 'error'"), gauge), "live_gauge", mode="append")
    newest = [F.max(F.when(F.col("event_type") == "error" if own else F.col("event_type") != "error", F.col("ts").cast("timestamp"))) for own in (True, False)]
    settled = c.table("events").agg(F.date_trunc("hour", F.least(*newest) - F.expr("INTERVAL 70 MINUTES"))).scalar()  # hours that both streams have closed
    return d.filter(F.col("ts") < settled).select("seq", "ticker", "price", "gauge")


@query("r10_late_rows", """WITH m AS (SELECT max(ts) FILTER (ts >= TIMESTAMP '2024-01-15') AS hi FROM events)
SELECT CASE WHEN ts < TIMESTAMP '2024-01-15' AND ts < hi - INTERVAL 1 DAY THEN 'late' ELSE 'on_time' END AS arrival, count(*) AS n, round(sum(value), 2) AS total FROM events, m GROUP BY 1""")
def _(c):
    base = scratch_path(c.spark, "late")
    e = c.table("events")
    # the newer half is delivered first, the older half arrives afterwards
    for name, cond in (("a", "ts >= timestamp_ntz'2024-01-15'"), ("b", "ts < timestamp_ntz'2024-01-15'")):
        e.filter(cond).write.parquet(f"{base}/in/{name}")
    for name, after in (("a", None), ("b", "a")):
        stream = source.read_ticks(c.spark, f"{base}/in/{name}")
        sinks.run_available(stream, sinks.split_late_sink(f"{base}/out", "ts", 86400, name, after), f"{base}/cp-{name}", "append")
    parts = [c.spark.read.option("basePath", f"{base}/out/{k}").parquet(f"{base}/out/{k}").select(F.lit(k).alias("arrival"), "price") for k in ("on_time", "late")]
    d = parts[0].unionByName(parts[1])
    return d.groupBy("arrival").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("total"))


@query("r10_dropped_rows", """WITH m AS (SELECT max(ts) FILTER (ts >= TIMESTAMP '2024-01-15') AS hi FROM events)
SELECT CASE WHEN ts < TIMESTAMP '2024-01-15' AND ts <= hi - INTERVAL 1 DAY THEN 'late' ELSE 'on_time' END AS arrival, count(*) AS n FROM events, m GROUP BY 1""")
def _(c):
    base, e = scratch_path(c.spark, "dropped"), c.table("events")
    late = 0
    # the newer half is delivered first, the older half arrives afterwards; the second run goes on from the first one's checkpoint
    for name, cond in (("a", "ts >= timestamp_ntz'2024-01-15'"), ("b", "ts < timestamp_ntz'2024-01-15'")):
        e.filter(cond).write.parquet(f"{base}/in/{name}")
        once = state.without_repeats(source.read_ticks(c.spark, f"{base}/in/*"), ["seq", "ts"], "1 day")
        late += sinks.dropped_rows(sinks.run_available(once, sinks.batch_folder_sink(f"{base}/data"), f"{base}/checkpoint", "append"))
    kept = c.spark.read.schema(once.schema).option("recursiveFileLookup", True).parquet(f"{base}/data")
    n = kept.agg(F.count(F.lit(1)).alias("on_time"), F.lit(late).cast("bigint").alias("late"))
    return n.unpivot([], ["on_time", "late"], "arrival", "n").filter("n > 0")


@query("r11_idempotent_ledger", "SELECT event_type AS ticker, CAST(ts AS DATE) AS date, round(avg(value), 6) AS vwap, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2")
def _(c):
    base = scratch_path(c.spark, "ledger")
    write = sinks.upsert_sink(f"{base}/data", ["ticker", "date"], "date", order="volume")

    def twice(batch, batch_id):  # a repeated delivery must not change the table
        write(batch, batch_id)
        write(batch, batch_id)

    stream = bars.session_vwap(_ticks(c))
    sinks.run_available(stream, twice, f"{base}/checkpoint", "update")
    return c.spark.read.schema(stream.schema).parquet(f"{base}/data")


@query("r12_without_repeats", "SELECT event_type AS ticker, event_id AS seq, value AS price FROM events")
def _(c):
    t = _ticks(c)
    return sinks.materialise(state.without_repeats(t.unionByName(t)), "dedup", mode="append").select("ticker", "seq", "price")
