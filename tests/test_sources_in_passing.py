"""Variant values, bucketed panels, the replaying source and figures taken in passing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sessionloom import schemas
from sessionloom.frames import by
from sessionloom.functions import variants
from sessionloom.operators import observed
from sessionloom.session import scratch_path
from sessionloom.sources import bucketed, replay
from sessionloom.streaming import sinks, source, state

T0 = dt.datetime(2024, 1, 1)


def events(spark, n, start=0):
    return spark.createDataFrame([(i, T0 + dt.timedelta(minutes=i), i % 3, "ab"[i % 2], float(i), "{}") for i in range(start, start + n)], schemas.TICKS)


def test_variant_members_of_any_shape(spark):
    rows = [(1, '{"A": {"dollars": 5.5, "units": 2}, "B": 7.25, "C": "8.5", "D": null, "E": [1], "F": {}}'), (2, "not json"), (3, None), (4, ""),
            (5, "{'P': {'dollars': 3, 'price': None}}"), (6, "12"), (7, "[]"), (8, "{}")]
    d = spark.createDataFrame(rows, "id int, t string").select("id", variants.parsed(F.col("t")).alias("v"))
    got = variants.members(d, "v", ["id"]).select("id", "key", *variants.holding(F.col("value")))
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, "A", 5.5, 2.0, 0.0), (1, "B", 7.25, 0.0, 0.0), (1, "C", 8.5, 0.0, 0.0), (1, "D", None, 0.0, 0.0),
        (1, "E", None, 0.0, 0.0), (1, "F", None, 0.0, 0.0), (5, "P", 3.0, 0.0, 0.0)]


def typed_files(spark, path):
    names = [r["path"] for r in spark.read.format("binaryFile").load(f"{path}/*.parquet").filter(F.instr(F.col("content").cast("string"), "typed_value") > 0).select("path").collect()]
    return len(names)


def test_shredded_variants_come_back_whole(spark):
    alike = [(i, f'{{"dollars": {i}.25, "units": {i}, "note": {{"k": {i}}}}}' if i % 50 else f'{{"dollars": "{i}", "other": [{i}]}}') for i in range(400)] + [(400, None)]
    mixed = [(i, ["[1, 2]", '"x"', "7", '{"a": 1}'][i % 4]) for i in range(40)]
    for rows, shared in ((alike, True), (mixed, False)):
        d = spark.createDataFrame(rows, "id int, t string").select("id", F.try_parse_json("t").alias("v"))
        path = scratch_path(spark, "shredded")
        variants.write_shredded(d, path)
        back = variants.read_shredded(spark, path, d.schema)
        assert sorted(map(tuple, back.select("id", F.to_json("v")).collect())) == sorted(map(tuple, d.select("id", F.to_json("v")).collect()))
        assert (typed_files(spark, path) > 0) == shared  # fields that most rows share are columns of their own
        numbers = back.select("id", variants.number(F.col("v"), "$.dollars").alias("x"))
        assert sorted(map(str, numbers.collect())) == sorted(map(str, d.select("id", variants.number(F.col("v"), "$.dollars").alias("x")).collect()))


def test_variant_records_skip_what_is_no_record(spark):
    raw = '[{"date": "2024-01-02T00:00:00Z", "open": 1, "close": "2.5", "volume": "n/a"}, 7, null, {"date": "bad"}]'
    d = spark.createDataFrame([("x", raw), ("y", "{"), ("z", None)], "ticker string, t string")
    got = variants.records(d.select("ticker", variants.parsed(F.col("t")).alias("v")), "v").collect()
    assert sorted((r["ticker"], r["date"], r["open"], r["close"], r["volume"]) for r in got if r["date"]) == [("x", dt.date(2024, 1, 2), 1.0, 2.5, None)]
    assert [r["open"] for r in got if r["date"] is None] == [None] and len(got) == 2


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_panel_needs_no_exchange(spark):
    rows = [(f"T{t}", dt.date(2024, 1, 1) + dt.timedelta(days=d), float(t * d % 17)) for t in range(40) for d in range(30)]
    d = spark.createDataFrame(rows, "ticker string, date date, close double").repartition(7)
    p = bucketed.write_bucketed(d, buckets=4)
    other = bucketed.write_bucketed(d.groupBy("ticker").agg(F.max("close").alias("peak")), order=[], buckets=4)

    def work(x, y):
        w = x.select("ticker", "date", (F.col("close") - F.lag("close").over(by())).alias("diff"))
        return w.join(y.hint("merge"), "ticker").join(x.groupBy("ticker").agg(F.sum("close").alias("total")).hint("merge"), "ticker")

    fast, slow = work(p, other), work(d, d.groupBy("ticker").agg(F.max("close").alias("peak")))
    assert "Exchange" not in plan(fast) and "Exchange" in plan(slow)
    assert sorted(map(str, fast.collect())) == sorted(map(str, slow.collect()))
    files = p.select(F.input_file_name().alias("f")).distinct().count()
    assert files <= 4  # one sorted file per bucket


def test_bucketed_panel_of_no_rows(spark):
    p = bucketed.write_bucketed(spark.createDataFrame([], "ticker string, date date, close double"))
    assert p.count() == 0 and p.columns == ["ticker", "date", "close"]


@pytest.fixture
def stored(spark):
    base = scratch_path(spark, "events")
    for i in range(3):
        events(spark, 40, 40 * i).coalesce(1).write.parquet(f"{base}/in/part{i}.parquet")
    return base


def test_replay_in_batches_goes_on_after_a_restart(spark, stored):
    def run(limit):
        seen = []
        write = sinks.batch_folder_sink(f"{stored}/data")

        def sink(batch, batch_id):
            if limit is not None and len(seen) >= limit:
                raise RuntimeError("lost")
            write(batch, batch_id)
            seen.append(batch.count())

        d = source.as_ticks(replay.stream_replay(spark, f"{stored}/in", 25, f"{stored}/notes", schemas.TICKS))
        try:
            sinks.run_until_idle(d, sink, f"{stored}/checkpoint")
        except Exception as e:
            assert limit is not None and "lost" in str(e)
        return seen

    assert run(2) == [25, 25]
    rest = run(None)
    assert sum(rest) == 70 and max(rest) <= 50
    events(spark, 10, 120).coalesce(1).write.parquet(f"{stored}/in/part3.parquet")  # a new file
    assert run(None) == [10]
    got = spark.read.option("recursiveFileLookup", True).parquet(f"{stored}/data")
    assert sorted(r["seq"] for r in got.select("seq").collect()) == list(range(130))


def test_replayed_batch_equals_parquet(spark, stored):
    got = replay.read_replay(spark, f"{stored}/in")
    want = spark.read.parquet(f"{stored}/in/*")
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    few = replay.read_replay(spark, f"{stored}/in", schemas.TICKS).select("value")
    assert few.agg(F.sum("value")).first()[0] == sum(range(120))


def test_listing_cuts_row_groups(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq
    for name in "ab":
        pq.write_table(pa.table({"x": list(range(10))}), tmp_path / f"{name}.parquet", row_group_size=4)
    found = replay.Listing(str(tmp_path))
    assert found.rows == 20 and found.pieces(5, 5) == []
    assert [(p.file[-9:], p.group, p.lo, p.hi) for p in found.pieces(5, 13)] == [
        ("a.parquet", 1, 1, 4), ("a.parquet", 2, 0, 2), ("b.parquet", 0, 0, 3)]


def ledger(spark, n):
    h = F.create_map(F.lit("A"), F.struct(F.lit(10.0).alias("dollars"), F.lit(1.0).alias("units"), F.lit(10.0).alias("price")))
    return spark.range(n).select(
        F.lit("p").alias("persona"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") * 20).cast("int")).alias("date"),
        F.when(F.col("id") % 4 != 3, F.lit(90.0)).alias("cash"), F.when(F.col("id") % 5 == 0, 100.5).otherwise(100.0).alias("total_equity"),
        h.alias("holdings"), F.when(F.col("id") % 2 == 0, "CARRYOVER").otherwise("SETTLED").alias("intraday_status"))


def test_observed_figures_equal_a_second_scan(spark):
    for n in (0, 23):
        d = observed.gap_days(ledger(spark, n), "persona")
        path = scratch_path(spark, "audited")
        figures = observed.ledger_figures(max_days=19)
        seen = observed.write_observed(d, path, figures, drop=["gap_days"])
        assert seen == d.agg(*[c.alias(k) for k, c in figures.items()]).first().asDict()
        assert spark.read.parquet(path).count() == n


def test_observed_figures_of_a_stream(spark, stored):
    d = source.as_ticks(replay.stream_replay(spark, f"{stored}/in", 50, f"{stored}/notes", schemas.TICKS))
    d = d.observe("audit", F.count(F.lit(1)).alias("rows"), F.count_if(F.col("price") < 60).alias("low"))
    q = sinks.run_until_idle(d, sinks.batch_folder_sink(f"{stored}/seen"), f"{stored}/cp")
    found = [f for f in observed.stream_figures(q) if f["rows"]]
    assert [f["rows"] for f in found] == [50, 50, 20] and sum(f["low"] for f in found) == 60


def test_engine_counts_late_rows(spark):
    base = scratch_path(spark, "late")
    late = []
    for name, first in (("a", 4000), ("b", 0)):  # the second delivery is older than the watermark, but for its newest rows
        n = 10 if name == "a" else 4000
        events(spark, n, first).write.parquet(f"{base}/in/{name}")
        once = state.without_repeats(source.read_ticks(spark, f"{base}/in/*"), ["seq", "ts"], "1 day")
        late.append(sinks.dropped_rows(sinks.run_available(once, sinks.batch_folder_sink(f"{base}/data"), f"{base}/cp", "append")))
    cut = 4009 - 24 * 60  # rows at or before the watermark are late
    assert late == [0, cut + 1]
    assert spark.read.option("recursiveFileLookup", True).parquet(f"{base}/data").count() == 10 + 4000 - (cut + 1)
