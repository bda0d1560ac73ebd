"""A: aggregations."""

from pyspark.sql import functions as F

from ..frames import by
from ..functions.scalars import explode_pnl
from ..operators import aggregates as a
from ..operators import report
from ..operators.indicators import sector_regime, trend_set
from ..operators.windows import ratio_change
from .indicators import REGIME, TREND
from .registry import query
from .sqltext import sql
from .windows import CUM, W


@query("a1_group_means", stage="pred", oracle=sql("pred", """SELECT date, sector, round(avg(ret), 6) + 0 AS mean_ret FROM pred GROUP BY 1, 2
UNION ALL SELECT date, 'MARKET', round(avg(ret), 6) + 0 FROM pred GROUP BY 1"""))
def _(c):
    s = a.group_mean(c.pred, ["date", "sector"], "ret", "mean_ret")
    m = a.group_mean(c.pred, "date", "ret", "mean_ret").select("date", F.lit("MARKET").alias("sector"), "mean_ret")
    return s.unionByName(m)


@query("a2_date_span", sql("gappy", "SELECT ticker, min(date) AS first_date, max(date) AS last_date FROM gappy GROUP BY 1"))
def _(c):
    return a.date_span(c.gappy, "ticker")


@query("a3_last_row", sql("bars", """SELECT ticker, max(date) AS date, round(arg_max(open, date), 6) AS open, round(arg_max(close, date), 6) AS close, arg_max(volume, date) AS volume FROM bars GROUP BY 1"""))
def _(c):
    return a.last_row(c.bars).select("ticker", "date", "open", "close", "volume")


@query("a4_signal_counts", sql("bars", TREND + "SELECT s AS ras_signal, count(*) AS n FROM (SELECT ticker, arg_max(ras_signal, date) AS s FROM trend GROUP BY 1) GROUP BY 1"))
def _(c):
    return a.value_counts(a.last_row(trend_set(c.bars).select("ticker", "date", "ras_signal")), "ras_signal")


@query("a5_liquidity", sql("bars", """SELECT ticker, round(avg(close * volume), 4) AS liquidity FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM bars) WHERE n <= 30 GROUP BY 1"""))
def _(c):
    d = a.tail_mean(c.bars, F.col("close") * F.col("volume"), 30, "liquidity")
    return d.select("ticker", F.round("liquidity", 4).alias("liquidity"))


@query("a6_return_volatility", sql("pred", "SELECT ticker, round(stddev_samp(ret), 6) AS volatility, round(stddev_samp(ret) * sqrt(252.0), 6) AS annual_volatility FROM pred GROUP BY 1"))
def _(c):
    return a.return_volatility(c.pred)


@query("a7_dollar_volume", sql("bars", "SELECT ticker, round(avg(volume) * avg(close), 4) AS dollar_volume FROM bars GROUP BY 1 HAVING avg(volume) * avg(close) >= 7000"))
def _(c):
    d = a.dollar_volume(c.bars, 7000.0)
    return d.select("ticker", F.round("dollar_volume", 4).alias("dollar_volume"))


@query("a8_vwap", sql("bars", "SELECT ticker, round(sum((high + low + close) / 3 * volume) / sum(volume), 6) AS vwap FROM bars GROUP BY 1"))
def _(c):
    return a.vwap(c.bars, "ticker")


@query("a9_average_volume", sql("dense", "SELECT ticker, round(avg(volume), 6) AS avg_volume FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM dense) WHERE n <= 10 GROUP BY 1"))
def _(c):
    return a.tail_mean(c.dense, F.col("volume"), 10, "avg_volume")


@query("a10_bars_from_ticks", sql("gappy", "SELECT ticker, date, open, high, low, close, volume FROM gappy"))
def _(c):
    return c.gappy


@query("a11_sharpe", stage="pred", oracle=sql("pred", """, t AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM pred)
SELECT ticker, round(avg(ret) / stddev_samp(ret) * sqrt(252.0), 6) + 0 AS sharpe, round(CASE WHEN count(ret) FILTER (n <= 30) >= 10 THEN
  avg(ret) FILTER (n <= 30) / stddev_samp(ret) FILTER (n <= 30) * sqrt(252.0) END, 6) + 0 AS sharpe_30 FROM t GROUP BY 1"""))
def _(c):
    from ..operators.cleaning import tail
    p = c.pred.select("ticker", "date", "ret")
    s = a.sharpe(p, keys="ticker").drop("n")
    s30 = a.sharpe(tail(p, 30), keys="ticker", min_rows=10).select("ticker", F.col("sharpe").alias("sharpe_30"))
    return s.join(s30, "ticker")


@query("a12_max_drawdown", sql("bars", f"SELECT ticker, round(100 * min(dd), 6) + 0 AS max_drawdown_pct FROM (SELECT ticker, (close - max(close) {CUM}) / max(close) {CUM} AS dd FROM bars) GROUP BY 1"))
def _(c):
    return a.max_drawdown(c.bars, "close", "ticker")


@query("a13_total_return", sql("ledger", "SELECT persona, round(arg_max(total_equity, date) / 10000 - 1, 6) + 0 AS return_on_start, round(arg_max(total_equity, date) / arg_min(total_equity, date) - 1, 6) + 0 AS return_on_first FROM ledger GROUP BY 1"))
def _(c):
    return a.total_return(c.ledger)


@query("a14_win_rate", sql("positions", "SELECT persona, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl <> 0) AS active, round(100.0 * count(*) FILTER (pnl > 0) / count(*) FILTER (pnl <> 0), 6) AS win_pct FROM positions GROUP BY 1"))
def _(c):
    return a.win_rate(c.positions)


@query("a15_asset_breakdown", stage="ledger", oracle=sql("positions", """, l AS (SELECT persona, max(date) AS date FROM positions GROUP BY 1),
h AS (SELECT p.persona, p.ticker, p.dollars FROM positions p JOIN l ON p.persona = l.persona AND p.date = l.date),
s AS (SELECT p.persona, p.ticker, sum(pnl) AS pnl, count(*) FILTER (pnl <> 0) AS trades, count(*) FILTER (pnl > 0) AS wins, coalesce(any_value(h.dollars), 0) AS deployed
  FROM positions p LEFT JOIN h ON p.persona = h.persona AND p.ticker = h.ticker GROUP BY 1, 2)
SELECT persona, coalesce(ticker, 'TOTAL') AS ticker, round(sum(pnl), 2) + 0 AS pnl, CAST(sum(trades) AS BIGINT) AS trades, CAST(sum(wins) AS BIGINT) AS wins,
  round(100.0 * sum(wins) / sum(trades), 6) AS win_pct, round(sum(deployed), 2) AS deployed, sum(deployed) > 0 AS holding FROM s GROUP BY GROUPING SETS ((persona, ticker), (persona))"""))
def _(c):
    d = report.asset_breakdown(c.ledger)
    return d.withColumns({"pnl": F.round("pnl", 2), "deployed": F.round("deployed", 2)})


@query("a16_serial_offenders", sql("positions", "SELECT ticker, round(sum(pnl), 2) AS loss, count(*) AS n FROM positions WHERE pnl < -1 GROUP BY 1 ORDER BY 2, 1 LIMIT 10"))
def _(c):
    d = report.serial_offenders(explode_pnl(c.ledger), 10, -1.0)
    return d.withColumn("loss", F.round("loss", 2))


@query("a17_loss_by_weekday", sql("positions", """, d AS (SELECT unnest(['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday']) AS weekday)
SELECT weekday, round(coalesce(sum(pnl), 0), 2) AS loss FROM d LEFT JOIN positions ON dayname(date) = weekday AND pnl < 0 GROUP BY 1"""))
def _(c):
    d = report.loss_by_weekday(explode_pnl(c.ledger))
    return d.withColumn("loss", F.round("loss", 2))


@query("a18_strikes", stage="ledger", oracle=sql("positions", """, d AS (SELECT persona, date, row_number() OVER (PARTITION BY persona ORDER BY date DESC) AS n FROM (SELECT DISTINCT persona, date FROM positions))
SELECT p.persona, ticker, count(*) FILTER (pnl < 0) AS strikes, count(*) FILTER (pnl < 0) >= 3 AS blacklisted FROM positions p JOIN d ON p.persona = d.persona AND p.date = d.date AND n <= 6 GROUP BY 1, 2"""))
def _(c):
    return report.strikes(explode_pnl(c.ledger), 6)


@query("a19_threshold_hits", sql("pred", """, t AS (SELECT CAST(unnest([0.5, 0.55, 0.6, 0.65, 0.7]) AS DOUBLE) AS t)
SELECT t AS threshold, count(*) FILTER (p_up > t) AS longs, count(*) FILTER (p_up < 1 - t) AS shorts, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) FILTER (p_up > t), 6) AS long_hit_rate,
  round(avg(CASE WHEN ret < 0 THEN 1.0 ELSE 0 END) FILTER (p_up < 1 - t), 6) AS short_hit_rate, round(avg(ret) FILTER (p_up > t), 6) + 0 AS long_mean_ret,
  round(-avg(ret) FILTER (p_up < 1 - t), 6) + 0 AS short_mean_ret FROM pred, t WHERE p_up IS NOT NULL AND ret IS NOT NULL GROUP BY 1"""))
def _(c):
    return a.threshold_grid(c.pred, [0.5, 0.55, 0.6, 0.65, 0.7], actual="ret")


_SIG = """, z AS (SELECT sector, sign(p_up - 0.5) AS x, sign(exp_ret) AS y, sign(ret) AS t FROM pred WHERE p_up IS NOT NULL AND exp_ret IS NOT NULL AND ret IS NOT NULL)"""


@query("a20_agreement", sql("pred", _SIG + """ SELECT sector, round(avg((x = t)::INT), 6) AS accuracy_all, round(avg((x = t)::INT) FILTER (x = y), 6) AS accuracy_agree,
  round(avg((x = t)::INT) FILTER (x <> y), 6) AS accuracy_disagree, round(avg((x = y)::INT), 6) AS coverage, count(*) AS n FROM z GROUP BY 1"""))
def _(c):
    d = c.pred.select("sector", F.signum(F.col("p_up") - 0.5).alias("x"), F.signum("exp_ret").alias("y"), F.signum("ret").alias("t"))
    return a.agreement(d, "x", "y", "t", "sector")


@query("a21_confidence", sql("pred", """, z AS (SELECT ticker, p_up, (p_up > 0.5) = (ret > 0) AS ok, p_up > 0.65 OR p_up < 0.35 AS sure, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n
  FROM pred WHERE p_up IS NOT NULL AND ret IS NOT NULL)
SELECT ticker, round(avg(ok::INT), 6) AS accuracy, round(avg(ok::INT) FILTER (sure), 6) AS sure_accuracy, round(avg(sure::INT), 6) AS coverage, round(avg(ok::INT) FILTER (n <= 30), 6) AS recent_accuracy FROM z GROUP BY 1"""))
def _(c):
    return a.confidence(c.pred, actual="ret")


@query("a22_fit_quality", sql("pred", """SELECT ticker, count(*) AS n, round(1 - sum((ret - exp_ret) * (ret - exp_ret)) / (var_pop(ret) * count(*)), 6) + 0 AS r2,
  round(avg((sign(ret) = sign(exp_ret))::INT), 6) AS direction_accuracy FROM pred WHERE ret IS NOT NULL AND exp_ret IS NOT NULL GROUP BY 1"""))
def _(c):
    return a.fit_quality(c.pred, "ret", "exp_ret", "ticker")


@query("a23_pearson", sql("pred", "SELECT ticker, round(corr(ret, exp_ret), 6) + 0 AS corr, count(*) FILTER (ret IS NOT NULL AND exp_ret IS NOT NULL) AS n FROM pred GROUP BY 1"))
def _(c):
    return a.correlate(c.pred, "ret", "exp_ret", "ticker")


_G = ("one", "ret", "p_up", "exp_ret", "exp_vol")


@query("a24_gram_sums", sql("pred", """, z AS (SELECT sector, 1.0 AS one, ret, p_up, exp_ret, exp_vol FROM pred WHERE ret IS NOT NULL AND p_up IS NOT NULL AND exp_ret IS NOT NULL AND exp_vol IS NOT NULL)
""" + " UNION ALL ".join(f"SELECT sector, '{x}' AS x, '{y}' AS y, round(sum({x} * {y}), 5) + 0 AS xy FROM z GROUP BY 1"
                        for i, x in enumerate(_G) for y in _G[i:])))
def _(c):
    d = c.pred.withColumn("one", F.lit(1.0)).dropna(subset=list(_G))
    return a.gram(d, _G, "sector").withColumn("xy", F.round("xy", 5))


@query("a25_weekly_summary", sql("ledger", """, b AS (SELECT persona, date, total_equity, CAST(floor((row_number() OVER (PARTITION BY persona ORDER BY date) - 1) / 5) AS BIGINT) AS block FROM ledger),
g AS (SELECT persona, block, min(date) AS first_date, max(date) AS last_date, arg_min(total_equity, date) AS start_equity, arg_max(total_equity, date) AS end_equity FROM b GROUP BY 1, 2),
h AS (SELECT *, coalesce(lag(end_equity) OVER (PARTITION BY persona ORDER BY block), start_equity) AS base FROM g)
SELECT persona, block, first_date, last_date, start_equity, end_equity, round(end_equity - base, 2) + 0 AS profit, round(100 * (end_equity - base) / base, 6) + 0 AS profit_pct FROM h"""))
def _(c):
    return report.weekly_summary(c.ledger).withColumn("profit", F.round("profit", 2))


@query("a26_brief", sql("ledger", """, p AS (SELECT persona, date, total_equity, coalesce(lag(total_equity) OVER (PARTITION BY persona ORDER BY date), total_equity) AS prev FROM ledger),
l AS (SELECT persona, CASE WHEN persona LIKE 'etf%' THEN 'etf' ELSE 'stock' END AS k, arg_max(total_equity, date) AS e, arg_max(prev, date) AS p FROM p GROUP BY 1)
SELECT coalesce(k, 'ALL') AS asset_class, coalesce(persona, 'ALL') AS persona, round(sum(e), 2) AS equity, round(sum(e - p), 2) + 0 AS pnl, round(100 * sum(e - p) / sum(p), 6) + 0 AS pnl_pct FROM l GROUP BY ROLLUP (k, persona)"""))
def _(c):
    d = report.brief(c.ledger)
    return d.withColumns({"equity": F.round("equity", 2), "pnl": F.round("pnl", 2)})


@query("a27_ticker_profit", sql("positions", "SELECT persona, ticker, round(sum(pnl), 2) + 0 AS profit FROM positions GROUP BY 1, 2"))
def _(c):
    d = report.ticker_profit(explode_pnl(c.ledger))
    return d.withColumn("profit", F.round("profit", 2))


@query("a28_fold_summary", sql("pred", """, i AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM pred),
f AS (SELECT *, CASE WHEN i < n - (n // 6) * 5 THEN 0 ELSE least(5, (i - (n - (n // 6) * 5)) // (n // 6) + 1) END AS fold FROM i),
q AS (SELECT ticker, fold, 1 - sum((ret - exp_ret) * (ret - exp_ret)) / (var_pop(ret) * count(*)) AS r2, avg((sign(ret) = sign(exp_ret))::INT) AS acc FROM f
  WHERE ret IS NOT NULL AND exp_ret IS NOT NULL AND fold > 0 GROUP BY 1, 2)
SELECT ticker, round(avg(r2), 6) + 0 AS mean_r2, round(stddev_samp(r2), 6) AS std_r2, round(avg(acc), 6) AS mean_accuracy, count(*) AS folds,
  CASE WHEN avg(r2) > 0 THEN 'GENERALISES' ELSE 'OVERFIT' END AS verdict FROM q GROUP BY 1"""))
def _(c):
    from ..operators.windows import walk_forward_folds
    f = walk_forward_folds(c.pred, 5).filter("test_fold > 0")
    q = a.fit_quality(f, "ret", "exp_ret", ["ticker", "test_fold"]).withColumnRenamed("direction_accuracy", "accuracy")
    return report.fold_summary(q, "ticker")


@query("a29_weighted_mean", sql("weights", "SELECT etf, round(sum(s_acctbal * weight) / sum(weight), 6) AS weighted FROM weights JOIN supplier ON ticker = 'S' || s_suppkey GROUP BY 1"))
def _(c):
    s = c.table("supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"), "s_acctbal")
    return a.weighted_mean(c.weights.join(s, "ticker"), "s_acctbal", "weight", "etf")


@query("a30_distinct", sql("gappy", """SELECT ticker, count(DISTINCT close) AS closes, count(DISTINCT date) AS dates FROM gappy GROUP BY 1"""))
def _(c):
    return c.gappy.groupBy("ticker").agg(F.count_distinct("close").alias("closes"), F.count_distinct("date").alias("dates"))


@query("a31_loss_kpis", stage="ledger", oracle=sql("positions", """, d AS (SELECT *, dayname(date) AS dn FROM positions WHERE pnl < 0), m AS (SELECT persona, dn, count(*) AS n FROM d GROUP BY 1, 2),
w AS (SELECT persona, dn FROM (SELECT *, row_number() OVER (PARTITION BY persona ORDER BY n DESC, dn) AS k FROM m) WHERE k = 1),
x AS (SELECT persona, ticker FROM (SELECT *, row_number() OVER (PARTITION BY persona ORDER BY pnl, ticker) AS k FROM d) WHERE k = 1)
SELECT d.persona, round(sum(pnl), 2) AS total_loss, min(pnl) AS worst_loss, any_value(x.ticker) AS worst_ticker, any_value(w.dn) AS modal_weekday
FROM d JOIN w ON d.persona = w.persona JOIN x ON d.persona = x.persona GROUP BY 1"""))
def _(c):
    d = report.loss_kpis(explode_pnl(c.ledger))
    return d.withColumn("total_loss", F.round("total_loss", 2))


@query("a32_transitions", stage="panel", oracle=sql("panel", REGIME + f""", t AS (SELECT lag(sector_regime) OVER ({W}) AS a, sector_regime AS b FROM regime),
g AS (SELECT * FROM (VALUES ('BULL_REGIME'), ('BEAR_REGIME')) x(a), (VALUES ('BULL_REGIME'), ('BEAR_REGIME')) y(b)),
n AS (SELECT g.a, g.b, count(t.a) AS n FROM g LEFT JOIN t ON g.a = t.a AND g.b = t.b GROUP BY 1, 2)
SELECT a AS from_state, b AS to_state, n, round((n + 1.0) / sum(n + 1.0) OVER (PARTITION BY a), 6) AS prob FROM n"""))
def _(c):
    p = c.panel.withColumn("ret", ratio_change("close", 1, by()))
    return a.transitions(sector_regime(p), "sector_regime", ["BULL_REGIME", "BEAR_REGIME"])


@query("report_ledger_metrics", stage="ledger", oracle=sql("ledger", """, x AS (SELECT *, total_equity / lag(total_equity) OVER (PARTITION BY persona ORDER BY date) - 1 AS ret,
  max(total_equity) OVER (PARTITION BY persona ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pk FROM ledger)
SELECT persona, round(arg_max(total_equity, date) / 10000 - 1, 6) + 0 AS return_on_start, round(arg_max(total_equity, date) / arg_min(total_equity, date) - 1, 6) + 0 AS return_on_first,
  round(100 * min((total_equity - pk) / pk), 6) + 0 AS max_drawdown_pct, count(ret) AS n, round(avg(ret) / stddev_samp(ret) * sqrt(252.0), 6) + 0 AS sharpe,
  count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl <> 0) AS active, round(100.0 * count(*) FILTER (pnl > 0) / count(*) FILTER (pnl <> 0), 6) AS win_pct FROM x GROUP BY 1"""))
def _(c):
    return report.ledger_metrics(c.ledger)


