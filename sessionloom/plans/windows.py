"""W: row-frame window functions."""

from pyspark.sql import functions as F

from ..operators import ewm
from ..operators import windows as w
from .registry import query
from .sqltext import sql

W = "PARTITION BY ticker ORDER BY date"


def ov(n: int) -> str:
    return f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


CUM = f"OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("w1_pct_change", sql("bars", f"""SELECT ticker, date,
  round(close / lag(close) OVER ({W}) - 1, 6) + 0 AS ret1, round(close / lag(close, 5) OVER ({W}) - 1, 6) + 0 AS ret5 FROM bars"""))
def _(c):
    d = w.pct_change(w.pct_change(c.bars, out="ret1"), n=5, out="ret5")
    return d.select("ticker", "date", "ret1", "ret5")


@query("w2_diff", sql("bars", f"""SELECT ticker, date, round(close - lag(close) OVER ({W}), 4) + 0 AS d1,
  round(close - lag(close, 3) OVER ({W}), 4) + 0 AS d3 FROM bars"""))
def _(c):
    d = w.difference(w.difference(c.bars, out="d1"), n=3, out="d3")
    return d.select("ticker", "date", F.round("d1", 4).alias("d1"), F.round("d3", 4).alias("d3"))


@query("w3_shift", sql("bars", f"""SELECT ticker, date, round(lag(close, 2) OVER ({W}), 6) AS lag2,
  round(lead(close) OVER ({W}), 6) AS next_close FROM bars"""))
def _(c):
    return w.shift(w.shift(c.bars, "close", 2, "lag2"), "close", -1, "next_close").select(
        "ticker", "date", "lag2", "next_close")


@query("w4_rolling_mean", sql("bars", f"""SELECT ticker, date,
  round(CASE WHEN count(close) {ov(20)} >= 20 THEN avg(close) {ov(20)} END, 4) AS strict20,
  round(avg(close) {ov(20)}, 4) AS partial20 FROM bars"""))
def _(c):
    d = w.rolling_mean(c.bars, "close", 20, "strict20")
    d = w.rolling_mean(d, "close", 20, "partial20", min_periods=1)
    return d.select("ticker", "date", F.round("strict20", 4).alias("strict20"), F.round("partial20", 4).alias("partial20"))


@query("w5_rolling_std", sql("bars", f"""SELECT ticker, date, """ + ", ".join(
    f"round(CASE WHEN count(close) {ov(n)} >= {n} THEN stddev_samp(close) {ov(n)} END, 4) AS std{n}" for n in (5, 10, 20))
    + " FROM bars"))
def _(c):
    d = c.bars
    for n in (5, 10, 20):
        d = w.rolling_std(d, "close", n, f"std{n}")
    return d.select("ticker", "date", *[F.round(f"std{n}", 4).alias(f"std{n}") for n in (5, 10, 20)])


@query("w6_rolling_max_min", sql("bars", f"""SELECT ticker, date,
  round(CASE WHEN count(*) {ov(20)} >= 20 THEN max(high) {ov(20)} END, 6) AS hi20,
  round(CASE WHEN count(*) {ov(20)} >= 20 THEN min(low) {ov(20)} END, 6) AS lo20 FROM bars"""))
def _(c):
    d = w.rolling_min(w.rolling_max(c.bars, "high", 20, "hi20"), "low", 20, "lo20")
    return d.select("ticker", "date", "hi20", "lo20")


_EW = f"""e AS (SELECT ticker, date, close, CAST(row_number() OVER ({W}) AS DOUBLE) AS i FROM bars)"""


@query("w7_ewm_adjusted", sql("bars", f""", {_EW}
SELECT ticker, date, round(CASE WHEN count(close) {CUM} >= 14 THEN
  sum(close * power(14.0/13, i)) {CUM} / sum(CASE WHEN close IS NOT NULL THEN power(14.0/13, i) END) {CUM} END, 4) AS ewm FROM e"""))
def _(c):
    d = ewm.ewm_adjusted(c.bars, "close", alpha=1 / 14, min_periods=14, out="ewm")
    return d.select("ticker", "date", F.round("ewm", 4).alias("ewm"))


@query("w8_ewm_recursive", sql("bars", f""", {_EW}
SELECT ticker, date, round(sum(CASE WHEN i = 1 THEN close ELSE close / 14 END * power(14.0/13, i - 1)) {CUM}
  / power(14.0/13, i - 1), 4) AS ewm FROM e"""))
def _(c):
    d = ewm.ewm_recursive(c.bars, "close", alpha=1 / 14, out="ewm")
    return d.select("ticker", "date", F.round("ewm", 4).alias("ewm"))


@query("w9_ratchet", sql("bars", f"""SELECT ticker, date, round(max(coalesce(low, 0)) {CUM}, 6) AS ratchet FROM bars"""))
def _(c):
    return w.ratchet(c.bars, "low", "ratchet").select("ticker", "date", "ratchet")


@query("w10_cumulative_sum", sql("positions", """SELECT persona, ticker, date,
  round(sum(pnl) OVER (PARTITION BY persona, ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) + 0 AS cum_pnl
  FROM positions"""))
def _(c):
    d = w.running_sum(c.positions, "pnl", "cum_pnl", keys=["persona", "ticker"])
    return d.select("persona", "ticker", "date", F.round("cum_pnl", 2).alias("cum_pnl"))


@query("w11_compounding", sql("pred", f"""SELECT ticker, date,
  round(10000 * exp(sum(ln(1 + coalesce(ret, 0) / 10)) {CUM}), 3) AS equity,
  round(exp(sum(coalesce(ret, 0) / 10) {CUM}) - 1, 6) + 0 AS log_growth FROM pred"""))
def _(c):
    d = c.pred.withColumn("x", F.coalesce(F.col("ret"), F.lit(0.0)) / 10)
    d = w.log_growth(w.compound(d, "x"), "x", "log_growth")
    return d.select("ticker", "date", F.round("equity", 3).alias("equity"), "log_growth")


@query("w12_drawdown", sql("bars", f"""SELECT ticker, date, round(max(close) {CUM}, 6) AS peak,
  round((close - max(close) {CUM}) / max(close) {CUM}, 6) + 0 AS drawdown FROM bars"""))
def _(c):
    return w.drawdown(c.bars, "close").select("ticker", "date", "peak", "drawdown")


@query("w13_rank", sql("bars", """SELECT ticker, date,
  rank() OVER (PARTITION BY date ORDER BY round(close, 0) DESC) AS place FROM bars"""))
def _(c):
    d = c.bars.withColumn("level", F.round("close", 0))
    return w.rank_within(d, "level", "date", out="place").select("ticker", "date", "place")


@query("w14_top_k", sql("bars", """SELECT date, ticker, round(close, 6) AS close, rn AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY date ORDER BY close DESC, ticker) AS rn FROM bars) WHERE rn <= 5"""))
def _(c):
    return w.top_k(c.bars, 5, "date", [F.col("close").desc(), F.col("ticker")], "place").select(
        "date", "ticker", "close", "place")


@query("w15_block_index", sql("bars", f"""SELECT ticker, date,
  CAST(floor((row_number() OVER ({W}) - 1) / 5) AS BIGINT) AS block FROM bars"""))
def _(c):
    return w.block_index(c.bars).select("ticker", "date", "block")


@query("w16_relative_volume", sql("bars", f"""SELECT ticker, date, round(volume / avg(volume) {ov(30)}, 6) AS rel30,
  round(volume / CASE WHEN count(volume) {ov(20)} >= 20 THEN avg(volume) {ov(20)} END, 6) AS rel20 FROM bars"""))
def _(c):
    return c.bars.select("ticker", "date", w.relative_to_mean("volume", 30, min_periods=1).alias("rel30"),
                         w.relative_to_mean("volume", 20).alias("rel20"))


@query("w17_until_weight", sql("weights", """SELECT etf, ticker, weight, round(cum, 6) AS cum_weight FROM (
  SELECT *, sum(weight) OVER (PARTITION BY etf ORDER BY weight DESC, ticker ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM weights) WHERE cum - weight < 60"""))
def _(c):
    return w.until_weight(c.weights, 60.0)


@query("w18_min_max_scale", sql("panel", """, x AS (SELECT sector, ticker, avg(close) AS liq, stddev_samp(close) AS vol FROM panel GROUP BY 1, 2)
SELECT sector, ticker, round(coalesce((liq - min(liq) OVER s) / nullif(max(liq) OVER s - min(liq) OVER s, 0), 0), 6) AS liq_scaled,
  round(1 - coalesce((vol - min(vol) OVER s) / nullif(max(vol) OVER s - min(vol) OVER s, 0), 0), 6) AS vol_scaled
FROM x WINDOW s AS (PARTITION BY sector)"""))
def _(c):
    g = c.panel.groupBy("sector", "ticker").agg(F.avg("close").alias("liq"), F.stddev_samp("close").alias("vol"))
    return w.min_max_scale(g, ["liq", "vol"], "sector", invert=["vol"]).select(
        "sector", "ticker", "liq_scaled", "vol_scaled")


@query("w19_sequences", sql("bars", f""", s AS (SELECT ticker, date, list([close, volume]) OVER ({W} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS seq FROM bars)
SELECT ticker, date, CAST(len(seq) AS BIGINT) AS n, round(seq[1][1], 6) AS first_close, round(seq[30][1], 6) AS last_close,
  round(list_sum(list_transform(seq, lambda x: x[2])), 4) AS volume FROM s WHERE len(seq) = 30"""))
def _(c):
    d = w.sequences(c.bars, ["close", "volume"], 30)
    s = F.col("sequence")
    return d.select("ticker", "date", F.size(s).alias("n"), s[0][0].alias("first_close"), s[29][0].alias("last_close"),
                    F.aggregate(s, F.lit(0.0), lambda a, x: a + x[1]).alias("volume"))


@query("w20_train_standardise", stage="bars", oracle=sql("bars", f""", x AS (SELECT *, row_number() OVER ({W}) <= floor(count(*) OVER (PARTITION BY ticker) * 0.8) AS tr FROM bars),
s AS (SELECT ticker, avg(close) FILTER (tr) AS m, stddev_pop(close) FILTER (tr) AS sd FROM x GROUP BY 1)
SELECT x.ticker, date, tr AS is_train, round((close - m) / (sd + 1e-8), 6) + 0 AS close_z FROM x JOIN s ON x.ticker = s.ticker"""))
def _(c):
    d = w.chronological_split(c.bars, train_share=0.8)
    return w.standardise_on_train(d, "close", "is_train", keys="ticker").select("ticker", "date", "is_train", "close_z")


@query("w21_last_sessions", stage="bars", oracle=sql("bars", """SELECT ticker, date, round(close, 6) AS close FROM (
  SELECT *, dense_rank() OVER (ORDER BY date DESC) AS d FROM bars) WHERE d <= 10"""))
def _(c):
    return w.last_sessions(c.bars, 10).select("ticker", "date", "close")


@query("w22_chronological_split", sql("bars", f"""SELECT ticker, date, n AS rn,
  n <= floor(c * 0.8) AS train80, n <= c - 30 AS train_but_30 FROM (
  SELECT *, row_number() OVER ({W}) AS n, count(*) OVER (PARTITION BY ticker) AS c FROM bars)"""))
def _(c):
    d = w.chronological_split(c.bars, train_share=0.8, out="train80")
    d = w.chronological_split(d, test_rows=30, out="train_but_30")
    return d.select("ticker", "date", F.row_number().over(w.by()).alias("rn"), "train80", "train_but_30")


@query("w23_walk_forward_folds", sql("bars", f"""SELECT ticker, date, CAST(CASE WHEN i < n - (n // 6) * 5 THEN 0
  ELSE least(5, (i - (n - (n // 6) * 5)) // (n // 6) + 1) END AS BIGINT) AS test_fold FROM (
  SELECT *, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM bars)"""))
def _(c):
    return w.walk_forward_folds(c.bars, 5).select("ticker", "date", "test_fold")


@query("w24_expanding_from_date", sql("bars", f"""SELECT ticker, date,
  round(avg(close) {CUM}, 4) AS mean_since FROM bars WHERE date >= DATE '1998-01-01'"""))
def _(c):
    d = w.from_date(c.bars, "1998-01-01")
    return d.select("ticker", "date", F.round(F.avg("close").over(w.so_far()), 4).alias("mean_since"))


@query("w25_gaps", sql("gappy", f"""SELECT * FROM (SELECT ticker, lag(date) OVER ({W}) AS previous, date,
  CAST(date - lag(date) OVER ({W}) AS BIGINT) AS gap_days FROM gappy) WHERE gap_days > 2"""))
def _(c):
    return w.gaps(c.gappy, 2)


@query("w26_row_std", sql("bars", """SELECT ticker, date, round(sqrt(((open-m)*(open-m)+(high-m)*(high-m)+(low-m)*(low-m)+(close-m)*(close-m))/3), 4) AS ohlc_std
  FROM (SELECT *, (open+high+low+close)/4 AS m FROM bars)"""))
def _(c):
    return c.bars.select("ticker", "date", F.round(w.row_std("open", "high", "low", "close"), 4).alias("ohlc_std"))


@query("w27_first_of_runs", sql("positions", """SELECT persona, ticker, date, pnl FROM (SELECT *, lag(pnl < 0) OVER (PARTITION BY persona, ticker ORDER BY date) AS p FROM positions)
  WHERE pnl < 0 AND NOT coalesce(p, false)"""))
def _(c):
    return w.first_of_runs(c.positions, F.col("pnl") < 0, ["persona", "ticker"]).select(
        "persona", "ticker", "date", "pnl")
