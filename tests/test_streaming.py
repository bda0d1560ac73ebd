"""Streams over several files against the batch result."""

import datetime as dt

from pyspark.sql import functions as F

from sessionloom import schemas
from sessionloom.session import scratch_path
from sessionloom.streaming import bars, gates, sinks, source, state, timers

T0 = dt.datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame([(i, T0 + dt.timedelta(minutes=m), u, t, v, "{}") for i, (m, u, t, v) in enumerate(rows)], schemas.TICKS)


def feed(spark, rows, files):
    """One file per slice of rows, in order."""
    base = scratch_path(spark, "feed")
    d = events(spark, rows)
    step = -(-len(rows) // files)
    for i in range(files):
        d.filter(f"event_id div {step} = {i}").coalesce(1).write.parquet(f"{base}/events{i}.parquet")
    return base, d


def stream(spark, base, **kw):
    return source.read_ticks(spark, f"{base}/events*.parquet", 1)


def rows_of(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_bars_over_several_batches_equal_batch(spark):
    rows = [(i * 7 % 600, i % 3, "ab"[i % 2], float(i * 13 % 50)) for i in range(300)]
    base, d = feed(spark, rows, 3)
    got = sinks.materialise(bars.tumbling_bars(stream(spark, base), "30 minutes", "30 days"), "bars", ["ticker", "start"])
    t = source.as_ticks(d)
    o = F.struct("ts", "seq")
    want = t.groupBy("ticker", F.window("ts", "30 minutes").start.alias("start")).agg(
        F.min_by("price", o).alias("open"), F.max_by("price", o).alias("close"), F.sum("size").alias("volume"))
    assert rows_of(got, "ticker", "start", "open", "close", "volume") == rows_of(want, "ticker", "start", "open", "close", "volume")


def test_repeats_are_dropped_across_batches(spark):
    rows = [(i, 0, "a", 1.0) for i in range(20)]
    base, _ = feed(spark, rows, 2)
    s = stream(spark, base)
    got = sinks.materialise(state.without_repeats(s.withColumn("seq", F.col("seq") % 10), watermark="1 day"), "once", mode="append")
    assert got.count() == 10


def test_orders_time_out_when_the_session_closes(spark):
    h = 60
    rows = [(9 * h, 0, "a", 5.0), (10 * h, 0, "a", 12.0), (11 * h, 0, "a", 15.0), (9 * h, 0, "b", 3.0), (16 * h, 0, "b", 50.0), (40 * h, 0, "a", 1.0)]
    base, d = feed(spark, rows, 1)
    limits = spark.createDataFrame([("a", 10.0), ("b", 10.0)], "ticker string, limit_price double")
    got = sinks.materialise(state.order_outcomes(stream(spark, base), limits), "orders", mode="append")
    day = dt.date(2024, 1, 1)
    assert {(r["ticker"], r["outcome"], r["fill_price"]) for r in got.filter(F.col("session") == day).collect()} == {
        ("a", "FILLED", 12.0), ("b", "ABORTED", None)}
    whole = state.batch_order_outcomes(source.as_ticks(d), limits)
    assert whole.filter(F.col("session") == day).count() == 2


def test_native_watermark_drops_late_rows(spark):
    # late rows are judged by the mark of the batch before the previous one
    rows = [(0, 0, "a", 1.0), (3000, 0, "a", 1.0), (4500, 0, "a", 1.0), (5, 0, "a", 9.0)]
    base, _ = feed(spark, rows, 4)
    got = sinks.materialise(bars.tumbling_bars(stream(spark, base), "10 minutes", "1 hour"), "late", ["ticker", "start"])
    assert {r["volume"] for r in got.collect()} == {1.0}


def test_late_rows_are_counted_and_retries_change_nothing(spark):
    base = scratch_path(spark, "marks")
    sink = sinks.split_late_sink(base, "ts", 3600)
    one = source.as_ticks(events(spark, [(600, 0, "a", 1.0)]))
    two = source.as_ticks(events(spark, [(10, 0, "a", 1.0), (580, 0, "a", 1.0), (700, 0, "a", 1.0)]))
    for batch, i in ((one, 0), (two, 1), (two, 1)):
        sink(batch, i)
    assert spark.read.option("recursiveFileLookup", True).parquet(f"{base}/late").count() == 1
    assert spark.read.option("recursiveFileLookup", True).parquet(f"{base}/on_time").count() == 3


def test_every_stream_query_reads_a_table_of_several_files(spark, tmp_path):
    import os
    import sys

    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
    import check
    from sessionloom import plans

    root = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    for name in check.TABLES:
        if name != "events":
            os.symlink(f"{root}/{name}.parquet", tmp_path / f"{name}.parquet")
    spark.read.parquet(f"{root}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    con = check.connect(root)
    for name in sorted(q for q in plans.queries() if q.startswith("r") and q[1].isdigit()):
        status, note, _ = check.compare(spark, con, name, root, str(tmp_path))
        assert status == "ok", (name, note)


def test_stream_without_input_gives_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], schemas.TICKS).write.parquet(str(tmp_path / "events.parquet"))
    s = source.read_ticks(spark, str(tmp_path / "events.parquet"))
    assert sinks.materialise(bars.session_vwap(s), "none", ["ticker", "date"]).count() == 0


def test_late_rows_are_kept_over_two_deliveries(spark):
    base = scratch_path(spark, "two")
    for delivery, minutes in (("a", [100, 200, 300]), ("b", [10, 290, 400])):
        for i, m in enumerate(minutes):
            events(spark, [(m, 0, "a", float(m))]).coalesce(1).write.parquet(f"{base}/{delivery}/{i}")
        s = source.read_ticks(spark, f"{base}/{delivery}/*", 1)
        sinks.run_available(s, sinks.split_late_sink(f"{base}/out", "ts", 3600, delivery, "a" if delivery == "b" else None), f"{base}/cp-{delivery}", "append")
    late = spark.read.parquet(f"{base}/out/late")
    assert rows_of(late, "price") == [(10.0,)] and spark.read.parquet(f"{base}/out/on_time").count() == 5


ORDERS = "ticker string, session date"


def timed_orders(spark, base, orders):
    limits = spark.createDataFrame([(t, 10.0) for t in "abcd"] + [("e", None)], "ticker string, limit_price double")
    placed = spark.readStream.schema(ORDERS).option("maxFilesPerTrigger", 1).parquet(f"{base}/{orders}*.parquet")
    return timers.order_timeouts(placed, stream(spark, base), limits)


def test_timers_end_orders_with_and_without_ticks(spark):
    h, day = 60, [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]
    rows = [(9 * h, 0, "a", 5.0), (11 * h, 0, "a", 15.0), (9 * h, 0, "b", 3.0), (10 * h, 0, "a", 12.0), (10 * h, 0, "e", 99.0), (10 * h, 0, "d", 50.0),
            (16 * h, 0, "b", 50.0), (41 * h, 0, "a", 1.0)]
    base, _ = feed(spark, rows, 4)  # the tick of a at 10 h arrives after the one at 11 h
    spark.createDataFrame([(t, d) for t in "abce" for d in day] + [("c", day[0])], ORDERS).coalesce(1).write.parquet(f"{base}/orders1.parquet")
    got = timers.with_rocks(spark, lambda: sinks.materialise(timed_orders(spark, base, "orders"), "timers", mode="append"))
    at10 = T0 + dt.timedelta(hours=10)
    assert rows_of(got.fillna(0.0, ["fill_price"]).fillna("-", ["outcome"]), "ticker", "session", "fill_price", "outcome") == [
        ("a", day[0], 12.0, "FILLED"), ("a", day[1], 0.0, "ABORTED"), ("b", day[0], 0.0, "ABORTED"), ("b", day[1], 50.0, "FILLED"),
        ("c", day[0], 0.0, "ABORTED"), ("c", day[1], 0.0, "ABORTED"), ("e", day[0], 0.0, "ABORTED"), ("e", day[1], 0.0, "ABORTED")]
    assert got.filter("ticker = 'a' AND outcome = 'FILLED'").first()["fill_ts"] == at10


def test_timers_survive_a_restart(spark):
    h = 60
    first, second = [(9 * h, 0, "a", 12.0), (9 * h, 0, "b", 1.0)], [(17 * h, 0, "a", 30.0)]
    base = scratch_path(spark, "restart")
    events(spark, first).coalesce(1).write.parquet(f"{base}/events0.parquet")
    spark.createDataFrame([(t, dt.date(2024, 1, 1)) for t in "abc"], ORDERS).coalesce(1).write.parquet(f"{base}/orders0.parquet")

    def run():
        sinks.run_available(timed_orders(spark, base, "orders"), sinks.batch_folder_sink(f"{base}/out"), f"{base}/checkpoint", "append")

    def both():
        run()
        events(spark, second).coalesce(1).write.parquet(f"{base}/events1.parquet")
        run()  # a new query on the old checkpoint: fills and timers are where they were

    timers.with_rocks(spark, both)
    got = spark.read.option("recursiveFileLookup", True).parquet(f"{base}/out")
    assert sorted((r["ticker"], r["fill_price"], r["outcome"]) for r in got.collect()) == [("a", 12.0, "FILLED"), ("b", None, "ABORTED"), ("c", None, "ABORTED")]


def test_a_late_gauge_still_reaches_its_ticks(spark):
    # files by rows: ticks of 10:00 to 10:20, then gauges that are older than those ticks, then the far end of both streams
    t = [(600 + i, 0, "ab"[i % 2], float(i)) for i in range(20)]
    g = [(590, 1, "g", 70.0), (605, 1, "g", 71.0), (605, 1, "g", 72.0), (400, 1, "g", 1.0)]
    end = [(700, 0, "a", 99.0), (1500, 0, "a", 0.0), (1500, 1, "g", 0.0), (2900, 0, "a", 0.0), (2900, 1, "g", 0.0)]
    base, _ = feed(spark, t + g + end, 3)
    ticks = stream(spark, base).filter("ticker <> 'g'")
    gauge = stream(spark, base).filter("ticker = 'g'").select(F.col("ts").alias("gauge_ts"), F.col("seq").alias("gauge_seq"), F.col("price").alias("gauge"))
    got = sinks.materialise(gates.live_gauge(ticks, gauge, watermark="30 minutes"), "gauge", mode="append")
    assert got.select("seq").distinct().count() == got.count()
    by = {r["seq"]: r["gauge"] for r in got.collect()}
    want = {i: 70.0 if i < 5 else 72.0 for i in range(20)} | {24: None, 25: 0.0}
    assert {k: by.get(k, "missing") for k in want} == want


def test_a_busy_hour_of_gauges_is_not_multiplied(spark):
    n = 6000  # one hour: all pairs within it would be about nine million
    rows = [(i / 200, 0, "ga"[i % 2], float(i)) for i in range(n)] + [(85, 0, "a", -1.0), (95, 0, "a", -2.0)]
    rows += [(m, 0, t, 0.0) for m in (1000, 2000) for t in "ag"]
    base, d = feed(spark, rows, 1)
    ticks = stream(spark, base).filter("ticker <> 'g'")
    gauge = stream(spark, base).filter("ticker = 'g'").select(F.col("ts").alias("gauge_ts"), F.col("seq").alias("gauge_seq"), F.col("price").alias("gauge"))
    out = gates.live_gauge(ticks.unionByName(ticks), gauge)
    path = scratch_path(spark, "busy")
    q = sinks.run_available(out, sinks.batch_folder_sink(f"{path}/data"), f"{path}/checkpoint", "append")
    assert sum(o.numRowsTotal for o in q.recentProgress[0].stateOperators) < 100  # one row a cell, none a pair
    got = {r["price"]: r["gauge"] for r in spark.read.option("recursiveFileLookup", True).parquet(f"{path}/data").filter("seq < 6002").collect()}
    assert got == {float(i): float(i - 1) for i in range(1, n, 2)} | {-1.0: n - 2.0, -2.0: None}


def test_timers_hold_many_orders_to_a_state(spark):
    n, day = 5000, dt.date(2024, 1, 1)  # one state row an order would be 5,000
    base, path = scratch_path(spark, "many"), scratch_path(spark, "ended")
    events(spark, [(9 * 60, u, "a", float(u % 3)) for u in range(0, n, 2)] + [(30 * 60, 0, "a", 0.0)]).write.parquet(f"{base}/events0.parquet")
    spark.createDataFrame([(u, day) for u in [*range(n), None, 2**60 + 1]], "user long, session date").coalesce(1).write.parquet(f"{base}/orders0.parquet")
    limits = spark.range(n).select(F.col("id").alias("user"), (F.col("id") * 0.0 + 1.0).alias("limit_price"))
    placed = spark.readStream.schema("user long, session date").parquet(f"{base}/orders*.parquet")
    d = timers.order_timeouts(placed, stream(spark, base), limits, ["user"])
    q = timers.with_rocks(spark, lambda: sinks.run_available(d, sinks.batch_folder_sink(f"{path}/data"), f"{path}/checkpoint", "append"))
    assert max(o.numRowsTotal for p in q.recentProgress for o in p.stateOperators) < 1000
    got = spark.read.schema(d.schema).option("recursiveFileLookup", True).parquet(f"{path}/data")
    want = {u: float(u % 3) if u % 2 == 0 and u % 3 else None for u in range(n)} | {None: None, 2**60 + 1: None}
    assert {r["user"]: r["fill_price"] for r in got.collect()} == want and got.count() == n + 2
    assert got.filter("(outcome = 'FILLED') <> (fill_ts is not null) or session <> '2024-01-01'").count() == 0
