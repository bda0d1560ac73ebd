"""Fixed input-output pairs: sizing, settlement, tiers, calendar, gates."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import dates
from sessionloom.operators import gates, report, settle, sizing


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def lit(*xs):
    return [F.lit(float(x)) for x in xs]


@pytest.mark.parametrize("variant", ["strict", "guarded", "scorecard", "backtest"])
@pytest.mark.parametrize("args,want", [((0.8, -0.05, 0.2), 0.0), ((0.99, 0.1, 0.05), 0.985), ((0.4, 0.05, 0.2), 0.0)])
def test_kelly(spark, variant, args, want):
    assert one(spark, sizing.kelly(*lit(*args), variant)) == pytest.approx(want)


def test_kelly_etf_has_no_return_gate(spark):
    assert one(spark, sizing.kelly(*lit(0.8, -0.05, 0.2), "etf")) == pytest.approx(0.6)


@pytest.mark.parametrize("persona,want", [
    ("conservative", [1.0, 0.3, 0.0, 0.0, 0.0]), ("neutral", [1.0, 0.8, 0.8, 0.0, 0.0]),
    ("dynamic", [1.0, 0.8, 0.8, 0.0, 0.0]), ("aggressive", [1.0, 1.0, 1.0, 0.8, 0.0]), ("etf_neutral", [1.0, 0.8, 0.5, 0.0, 0.0])])
def test_fear_tiers(spark, persona, want):
    d = spark.createDataFrame([(float(v),) for v in (15, 22, 28, 38, 50)], "v double")
    got = [r[0] for r in d.orderBy("v").select(sizing.fear_multiplier(F.lit(persona), F.col("v"))).collect()]
    assert got == want


def test_stop_levels(spark):
    assert one(spark, sizing.stop_level(F.lit("dynamic"), F.lit(40.0))) == -0.03
    assert one(spark, sizing.stop_level(F.lit("neutral"), F.lit(30.0))) == -0.035
    assert one(spark, sizing.stop_level(F.lit("etf_conservative"), F.lit(10.0))) == -0.025


@pytest.mark.parametrize("day,want", [("2026-03-20", True), ("2026-06-18", True), ("2026-06-19", False), ("2026-04-17", False)])
def test_triple_witching(spark, day, want):
    assert one(spark, dates.is_triple_witching(F.lit(day).cast("date"))) is want


@pytest.mark.parametrize("day,want", [("2026-06-15", True), ("2026-06-19", False), ("2026-07-03", False), ("2026-06-20", False)])
def test_session_calendar(spark, day, want):
    assert one(spark, dates.is_open(F.lit(day).cast("date"))) is want


def test_business_day_shift_matches_pandas(spark):
    import pandas as pd
    days = pd.date_range("2026-01-01", "2026-02-10")
    d = spark.createDataFrame([(x.date(),) for x in days], "d date")
    for n in (-11, -1, 0, 1, 4, 23):
        got = {r[0]: r[1] for r in d.select("d", dates.add_business_days(F.col("d"), n)).collect()}
        assert all(v == (pd.Timestamp(k) + n * pd.offsets.BDay()).date() for k, v in got.items())


def test_holiday_rules_match_other_rules(spark):
    from sessionloom.plans.sqltext import closed_days
    days = spark.sql("SELECT explode(sequence(DATE'1990-01-01', DATE'2035-12-31')) AS d")
    shut = days.filter((F.weekday("d") < 5) & ~dates.is_open(F.col("d")))
    got = {f"DATE '{r[0]}'" for r in shut.collect()}
    want = set(closed_days().split(", "))
    assert got == {w for w in want if dt.date.fromisoformat(w[6:-1]).weekday() < 5}


def test_missed_sessions(spark):
    cal = spark.sql("SELECT explode(sequence(DATE'2026-06-08', DATE'2026-06-30')) AS session").withColumn("is_open", dates.is_open(F.col("session")))
    d = dt.date.fromisoformat
    marks = spark.createDataFrame([("late", d("2026-06-16")), ("new", None), ("staged", d("2026-06-18")), ("stale", d("2026-06-18")), ("none", d("2026-06-18"))],
                                  "pipeline_name string, last_completed_date date")
    pending = spark.createDataFrame([("staged", d("2026-06-22")), ("stale", d("2026-06-18"))], "pipeline_name string, date date")
    got = dates.missed_sessions(marks, cal, F.lit("2026-06-20").cast("date"), pending).collect()  # the 19th is a holiday, the 20th a Saturday
    assert sorted((r[0], str(r[1])) for r in got) == [
        ("late", "2026-06-17"), ("late", "2026-06-18"), ("new", "2026-06-18"), ("none", "2026-06-18"), ("stale", "2026-06-18")]


def test_sell_with_zero_return_is_a_hit(spark):
    assert one(spark, sizing.hit_label(F.lit("Sell"), F.lit(0.0))) == "On target"
    assert one(spark, sizing.hit_label(F.lit("Buy"), F.lit(0.0))) == "Miss"


def test_entry_gate_needs_known_values(spark):
    none = F.lit(None).cast("double")
    for vwap, live, expected in ((none, F.lit(10.0), F.lit(1.0)), (F.lit(100.0), none, F.lit(1.0)), (F.lit(100.0), F.lit(10.0), none)):
        assert one(spark, gates.entry_gate(F.lit("neutral"), *lit(110, 100), vwap, F.lit(15.0), F.lit(False), live, expected)) == "NO_DATA"


def test_as_of_takes_left_rows_with_maps(spark):
    from sessionloom.operators.joins import as_of
    left = spark.sql("SELECT 'a' AS k, 5 AS t, map('x', 1.0D) AS m UNION ALL SELECT 'a', 1, map('y', 2.0D)")
    right = spark.sql("SELECT 'a' AS k, 3 AS rt, 7.0D AS v")
    got = as_of(left, right, "v", keys="k", left_time="t", right_time="rt").collect()
    assert sorted((r["t"], r["v"], r["m"]) for r in got) == [(1, None, {"y": 2.0}), (5, 7.0, {"x": 1.0})]


def test_last_of_several_updates_of_one_key_wins(spark):
    from sessionloom.sources.maintain import upsert
    stored = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    new = spark.createDataFrame([(1, 9.0, 1), (1, 4.0, 3), (1, 8.0, 2), (3, 5.0, 1)], "k int, v double, seq int")
    assert sorted(tuple(r) for r in upsert(stored, new, "k", "seq").collect()) == [(1, 4.0), (2, 2.0), (3, 5.0)]


def test_expected_volume_and_gate(spark):
    assert round(one(spark, dates.expected_volume(F.lit(1_000_000.0), F.lit(150.0)))) == 384615
    for share, want in ((0.4, "LOW_VOLUME"), (0.8, "BUY")):
        g = gates.entry_gate(F.lit("neutral"), *lit(110, 100, 100, 15), F.lit(False), *lit(384615 * share, 384615))
        assert one(spark, g) == want
    g = gates.entry_gate(F.lit("neutral"), *lit(101, 100, 100, 25), F.lit(False), *lit(10, 1))
    assert one(spark, g) == "WAIT"  # the threshold widens when volatility is high


def test_exit_gate_leverage_and_panic(spark):
    def g(persona, ticker, live, vix):
        return one(spark, gates.exit_gate(F.lit(persona), F.lit(ticker), *lit(live, 100, vix)))

    assert g("etf_neutral", "TQQQ", 105, 15) == "HOLD"
    assert g("etf_neutral", "TQQQ", 110, 15) == "TAKE_PROFIT"
    assert g("etf_neutral", "XLK", 104, 15) == "TAKE_PROFIT"
    assert g("conservative", "AAA", 97.9, 22) == "STOP"
    assert g("neutral", "AAA", 86, 22) == "HOLD"
    assert g("neutral", "AAA", 100, 31) == "PANIC"


def test_settlement_adds_up(spark):
    pos = spark.createDataFrame([("neutral", "AAA", "2026-01-05", 2000.0, 100.0)], "persona string, ticker string, date string, dollars double, price double").withColumn("date", F.to_date("date"))
    px = spark.createDataFrame([("AAA", "2026-01-05", 105.0, 101.0)], "ticker string, date string, close double, low double").withColumn("date", F.to_date("date"))
    fear = px.select("date", F.lit(15.0).alias("vix_close"))
    pnl = settle.settle(pos, px, fear).first()["pnl"]
    assert 10000 + 2000 + pnl == pytest.approx(12100)


def test_zero_price_returns_zero(spark):
    assert one(spark, settle.settled_return(*lit(0, 105, 101, -0.05))) == 0.0


def test_zero_unit_refund(spark):
    pos = spark.createDataFrame([("neutral", "AAA", d, 1000.0, 0.0) for d in ("2026-01-05", "2026-01-06")],
                                "persona string, ticker string, date string, dollars double, units double").withColumn("date", F.to_date("date"))
    led = spark.createDataFrame([("neutral", "2026-01-06", 9000.0, 9000.0)], "persona string, date string, cash double, total_equity double").withColumn("date", F.to_date("date"))
    assert settle.refund(led, settle.lost_cash(pos)).first()["cash"] == 10000.0


def test_order_delta(spark):
    def side(rows):
        d = spark.createDataFrame(rows, "ticker string, units double")
        h = F.map_from_entries(F.collect_list(F.struct("ticker", F.struct(F.lit(1.0).alias("dollars"), "units", F.lit(1.0).alias("price")))))
        return d.agg(h.alias("holdings")).withColumn("persona", F.lit("neutral"))

    got = {r["ticker"]: r["action"] for r in report.order_delta(
        side([("A", 5.0), ("B", 5.0), ("C", 5.0)]), side([("B", 3.0), ("C", 5.0), ("D", 2.0)])).collect()}
    assert got == {"A": "SELL", "B": "REDUCE", "C": "HOLD", "D": "BUY"}


def test_balance_tolerance(spark):
    h = F.create_map(F.lit("A"), F.struct(F.lit(60.0).alias("dollars"), F.lit(1.0).alias("units"), F.lit(60.0).alias("price")))
    d = spark.createDataFrame([(40.0, 100.0), (45.0, 100.0), (40.05, 100.0)], "cash double, total_equity double").withColumn("holdings", h)
    got = sorted((r["total_equity"], round(r["cash"], 2), r["corrected"]) for r in settle.enforce_balance(d).collect())
    assert got == [(100.0, 40.0, False), (100.0, 40.0, True), (100.0, 40.05, False)]


def test_restricted_capital_and_items(spark):
    cands = spark.createDataFrame([("p", 1, "a", 100.0, 0.5), ("p", 1, "b", 100.0, 0.1), ("p", 1, "c", 100.0, 0.2), ("q", 1, "a", 50.0, 0.5)],
                                  "persona string, date int, ticker string, cash double, pct double").withColumn("raw", F.col("cash") * F.col("pct"))
    held = spark.createDataFrame([("p", 1, "b", 30.0), ("p", 1, "z", 10.0)], "persona string, date int, ticker string, value double")
    barred = spark.createDataFrame([("c",)], "ticker string")
    got = sorted(tuple(r) for r in sizing.restrict(cands, held, barred).select("persona", "ticker", "cash", "raw").collect())
    assert got == [("p", "a", 60.0, 30.0), ("q", "a", 50.0, 25.0)]
