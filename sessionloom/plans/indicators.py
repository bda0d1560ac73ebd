"""T: technical indicators and market features."""

from pyspark.sql import functions as F

from ..operators import indicators as t
from ..operators.windows import ratio_change
from ..frames import by
from .registry import query
from .sqltext import r, sql
from .windows import CUM, W, ov


def strict(f: str, n: int, x: str) -> str:
    return f"CASE WHEN count({x}) {ov(n)} >= {n} THEN {f}({x}) {ov(n)} END"


def ew(x: str) -> str:
    return (f"CASE WHEN count({x}) {CUM} >= 14 THEN sum({x} * power(14.0/13, i)) {CUM} / "
            f"sum(CASE WHEN {x} IS NOT NULL THEN power(14.0/13, i) END) {CUM} END")


TREND = f""", m0 AS (SELECT *, CAST(row_number() OVER ({W}) AS DOUBLE) AS i, close - lag(close) OVER ({W}) AS ch,
  greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W}))) AS tr,
  high - lag(high) OVER ({W}) AS up, lag(low) OVER ({W}) - low AS dn,
  CASE WHEN count(*) {ov(20)} >= 20 THEN max(high) {ov(20)} END AS hi20 FROM bars),
m1 AS (SELECT *, CASE WHEN ch > 0 THEN ch ELSE 0 END AS g, CASE WHEN ch < 0 THEN -ch ELSE 0 END AS l,
  CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pu, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS pd FROM m0),
m2 AS (SELECT *, {ew('g')} AS ag, {ew('l')} AS al, {ew('tr')} AS atr, {ew('pu')} AS su, {ew('pd')} AS sd FROM m1),
m3 AS (SELECT *, 100 - 100 / (1 + ag / CASE WHEN al = 0 THEN 1e-5 ELSE al END) AS rsi,
  100 * su / CASE WHEN atr = 0 THEN 1e-5 ELSE atr END AS plus_di, 100 * sd / CASE WHEN atr = 0 THEN 1e-5 ELSE atr END AS minus_di FROM m2),
m4 AS (SELECT *, 100 * abs(plus_di - minus_di) / CASE WHEN plus_di + minus_di = 0 THEN 1e-5 ELSE plus_di + minus_di END AS dx FROM m3),
m5 AS (SELECT *, {ew('dx')} AS adx, CASE WHEN atr IS NOT NULL THEN max(coalesce(hi20 - 2.5 * atr, 0)) {CUM} END AS trailing_stop FROM m4),
trend AS (SELECT *, tr AS true_range, CASE WHEN close < trailing_stop THEN 'STOP_HIT' WHEN rsi IS NULL OR adx IS NULL THEN 'HOLD'
  WHEN rsi <= 35 AND adx >= 25 THEN 'BUY' WHEN rsi >= 65 AND adx >= 25 THEN 'SELL' ELSE 'HOLD' END AS ras_signal FROM m5)
"""


def _trend(*names, text=()):
    return sql("bars", TREND + "SELECT ticker, date, " + ", ".join([r(*names)] * bool(names) + list(text)) + " FROM trend")


@query("t1_rsi_wilder", _trend("rsi"))
def _(c):
    return t.rsi_wilder(c.bars).select("ticker", "date", "rsi")


@query("t2_rsi_recursive", sql("bars", TREND + f""", x AS (SELECT *, sum(CASE WHEN i = 1 THEN g ELSE g / 14 END * power(14.0/13, i - 1)) {CUM} / power(14.0/13, i - 1) AS rg,
  sum(CASE WHEN i = 1 THEN l ELSE l / 14 END * power(14.0/13, i - 1)) {CUM} / power(14.0/13, i - 1) AS rl FROM m1)
SELECT ticker, date, round(CASE WHEN rl = 0 AND rg > 0 THEN 100 WHEN rl = 0 THEN NULL ELSE 100 - 100 / (1 + rg / rl) END, 6) AS rsi_recursive FROM x"""))
def _(c):
    return t.rsi_recursive(c.bars).select("ticker", "date", "rsi_recursive")


@query("t3_rsi_sma", sql("bars", f""", x AS (SELECT *, close - lag(close) OVER ({W}) AS ch FROM bars),
y AS (SELECT *, CASE WHEN ch > 0 THEN ch WHEN ch IS NOT NULL THEN 0 END AS g, CASE WHEN ch < 0 THEN -ch WHEN ch IS NOT NULL THEN 0 END AS l FROM x),
z AS (SELECT ticker, date, {strict('avg', 14, 'g')} AS ag, {strict('avg', 14, 'l')} AS al FROM y)
SELECT ticker, date, round(coalesce(CASE WHEN al = 0 AND ag > 0 THEN 100 WHEN al = 0 THEN NULL ELSE 100 - 100 / (1 + ag / al) END, 50), 6) AS rsi_sma FROM z"""))
def _(c):
    return t.rsi_sma(c.bars).select("ticker", "date", "rsi_sma")


@query("t4_true_range_atr", _trend("true_range", "atr"))
def _(c):
    return t.true_range_atr(c.bars).select("ticker", "date", "true_range", "atr")


@query("t5_directional", _trend("plus_di", "minus_di"))
def _(c):
    return t.directional(c.bars).select("ticker", "date", "plus_di", "minus_di")


@query("t6_adx", _trend("adx"))
def _(c):
    return t.adx(c.bars).select("ticker", "date", "adx")


@query("t7_trailing_stop", _trend("trailing_stop"))
def _(c):
    return t.trailing_stop(c.bars).select("ticker", "date", "trailing_stop")


@query("t8_ras_signal", _trend(text=["ras_signal"]))
def _(c):
    return t.trend_set(c.bars).select("ticker", "date", "ras_signal")


@query("t9_dispersion", sql("bars", f"""SELECT ticker, date,
  round(sqrt(((open-m)*(open-m)+(high-m)*(high-m)+(low-m)*(low-m)+(close-m)*(close-m))/3), 6) AS ohlc_std,
  {', '.join(f"round({strict('stddev_samp', n, 'close')}, 6) AS std_{n}" for n in (5, 10, 20))},
  round({strict('max', 20, 'high')}, 6) AS max_high_20, round({strict('min', 20, 'low')}, 6) AS min_low_20
  FROM (SELECT *, (open+high+low+close)/4 AS m FROM bars)"""))
def _(c):
    return t.dispersion(c.bars).drop("open", "high", "low", "close", "volume")


REGIME = f""", sr AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS ret FROM panel),
sd AS (SELECT sector, date, avg(ret) AS s FROM sr GROUP BY 1, 2),
sm AS (SELECT sector, date, avg(s) OVER (PARTITION BY sector ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS sm FROM sd),
md AS (SELECT date, avg(ret) AS m FROM sr GROUP BY 1),
mm AS (SELECT date, avg(m) OVER (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS mm FROM md),
regime AS (SELECT sr.ticker, sr.sector, sr.date, sr.close, sr.ret, sm - mm AS sector_momentum,
  CASE WHEN sm - mm >= 0 THEN 'BULL_REGIME' ELSE 'BEAR_REGIME' END AS sector_regime
  FROM sr LEFT JOIN sm ON sr.sector = sm.sector AND sr.date = sm.date LEFT JOIN mm ON sr.date = mm.date)
"""


@query("t10_sector_regime", stage="panel", oracle=sql("panel", REGIME + f"SELECT ticker, sector, date, {r('sector_momentum')}, sector_regime FROM regime"))
def _(c):
    p = c.panel.withColumn("ret", ratio_change("close", 1, by()))
    return t.sector_regime(p).select("ticker", "sector", "date", "sector_momentum", "sector_regime")


@query("t11_std_adjusted_return", sql("bars", f"""SELECT ticker, date, round((close / lag(close) OVER ({W}) - 1) /
  (sqrt(((open-m)*(open-m)+(high-m)*(high-m)+(low-m)*(low-m)+(close-m)*(close-m))/3) + 1e-8), 6) + 0 AS adj_ret
  FROM (SELECT *, (open+high+low+close)/4 AS m FROM bars)"""))
def _(c):
    return c.bars.select("ticker", "date", t.std_adjusted(ratio_change("close", 1, by()), t.row_std("open", "high", "low", "close")).alias("adj_ret"))


@query("t12_volume_adjusted_return", sql("bars", f""", x AS (SELECT ticker, date, (close / lag(close) OVER ({W}) - 1) *
  volume / ({strict('avg', 20, 'volume')}) AS vol_adj_ret FROM bars)
SELECT ticker, date, round(vol_adj_ret, 6) + 0 AS vol_adj_ret, round({strict('avg', 3, 'vol_adj_ret')}, 6) + 0 AS vol_adj_ma3 FROM x"""))
def _(c):
    return t.volume_adjusted(c.bars).select("ticker", "date", "vol_adj_ret", "vol_adj_ma3")


@query("t13_risk_adjusted_return", sql("bars", f""", x AS (SELECT ticker, date, close / lag(close) OVER ({W}) - 1 AS ret,
  {strict('stddev_samp', 20, 'close')} AS s FROM bars), y AS (SELECT ticker, date, ret / (s + 1e-8) AS a, ret * s AS b FROM x)
SELECT ticker, date, round(a, 6) + 0 AS risk_adj_ret, round(b, 6) + 0 AS vol_amp_ret,
  round({strict('avg', 3, 'a')}, 6) + 0 AS risk_adj_ma3, round({strict('avg', 3, 'b')}, 6) + 0 AS vol_amp_ma3 FROM y"""))
def _(c):
    return t.risk_adjusted(c.bars).select("ticker", "date", "risk_adj_ret", "vol_amp_ret", "risk_adj_ma3", "vol_amp_ma3")


@query("t14_ma3_smoothing", sql("pred", f"SELECT ticker, date, round({strict('avg', 3, 'ret')}, 6) + 0 AS ret_ma3 FROM pred"))
def _(c):
    return t.smooth3(c.pred, "ret", "ret_ma3").select("ticker", "date", "ret_ma3")


@query("t15_sma_gap", sql("pred", f"""SELECT ticker, date, round({strict('avg', 10, 'close')} / close - 1, 6) + 0 AS sma_gap_10,
  round({strict('avg', 50, 'close')} / close - 1, 6) + 0 AS sma_gap_50, round({strict('stddev_samp', 20, 'ret')}, 6) AS vol_20 FROM pred"""))
def _(c):
    return t.sma_gap(c.bars).select("ticker", "date", "sma_gap_10", "sma_gap_50", "vol_20")


@query("t16_spreads", sql("pred", f"""SELECT ticker, date, round(ln(close / lag(close) OVER ({W})), 6) + 0 AS log_ret,
  round((high - low) / close, 6) + 0 AS hl_spread, round((close - open) / close, 6) + 0 AS co_spread,
  round({strict('stddev_samp', 14, 'ret')}, 6) AS vol_14 FROM pred"""))
def _(c):
    return t.spreads(c.bars).select("ticker", "date", "log_ret", "hl_spread", "co_spread", "vol_14")


def _mp(x, n):
    return f"{x} / lag({x}, {n}) OVER (ORDER BY date) - 1"


@query("t17_macro_spreads", sql("macro", f""", f AS (SELECT date, {', '.join(
    f'last_value({x} IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {x}'
    for x in 'vix_close tnx_close irx hyg ief sphb splv oil copper usd'.split())} FROM macro),
g AS (SELECT *, tnx_close - irx AS curve, hyg / ief AS credit, sphb / splv AS risk_on FROM f
  WHERE {' AND '.join(f'{x} IS NOT NULL' for x in 'vix_close tnx_close irx hyg ief sphb splv oil copper usd'.split())}),
h AS (SELECT date, curve, curve - lag(curve, 5) OVER (ORDER BY date) AS curve_trend, credit, {_mp('credit', 5)} AS credit_trend,
  risk_on, {_mp('risk_on', 5)} AS risk_on_trend, {', '.join(f"{_mp(s, 1)} AS {s}_ret, {_mp(s, 5)} AS {s}_trend" for s in ('oil', 'copper', 'usd'))},
  {_mp('tnx_close', 1)} AS tnx_ret, {_mp('tnx_close', 5)} AS tnx_pct_trend FROM g)
SELECT date, {r('curve', 'curve_trend', 'credit', 'credit_trend', 'risk_on', 'risk_on_trend', 'oil_ret', 'oil_trend', 'copper_ret', 'copper_trend', 'usd_ret', 'usd_trend', 'tnx_ret', 'tnx_pct_trend')}
FROM h WHERE curve_trend IS NOT NULL"""))
def _(c):
    return t.macro_spreads(c.macro)


@query("t18_tnx_features", sql("macro", f""", x AS (SELECT date, tnx_close, {_mp('tnx_close', 1)} AS q,
  CASE WHEN count(*) OVER z >= 5 THEN avg(tnx_close) OVER z END AS m FROM macro WINDOW z AS (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT date, tnx_close, round(lag(q) OVER (ORDER BY date), 6) + 0 AS tnx_lag1_ret, round(m, 6) AS tnx_mean_5 FROM x"""))
def _(c):
    return t.tnx_features(c.macro)


@query("t19_fear_ratio", sql("bars macro", f""", x AS (SELECT ticker, date, {strict('stddev_samp', 20, 'close')} AS s FROM bars)
SELECT ticker, x.date, round(vix_close / nullif(s, 0), 6) AS fear_ratio FROM x LEFT JOIN macro m ON x.date = m.date"""))
def _(c):
    d = c.bars.select("ticker", "date", t.std_over("close", 20).alias("s"))
    return d.join(c.macro, "date", "left").select("ticker", "date", t.fear_ratio(F.col("vix_close"), F.col("s")).alias("fear_ratio"))


@query("t20_opportunity", sql("bars", f""", x AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM bars),
y AS (SELECT ticker, date, close, close / lag(close) OVER ({W}) - 1 AS q FROM x WHERE rn <= 30),
z AS (SELECT ticker, arg_max(close, date) / arg_min(close, date) - 1 AS momentum, stddev_samp(q) * sqrt(252.0) AS annual_volatility FROM y GROUP BY 1 HAVING count(*) >= 30)
SELECT ticker, {r('momentum', 'annual_volatility')}, round(momentum * annual_volatility, 6) + 0 AS opportunity FROM z"""))
def _(c):
    return t.opportunity(c.bars, 30)


@query("t21_sector_gravity", stage="dense", oracle=sql("dense", f""", x AS (SELECT ticker, date, (close - lag(close, 4) OVER ({W})) / lag(close, 4) OVER ({W}) AS m FROM dense),
y AS (SELECT ticker, arg_max(m, date) AS momentum FROM x GROUP BY 1)
SELECT ticker, round(momentum, 6) + 0 AS momentum, round(b, 6) + 0 AS benchmark_momentum, NOT (momentum < 0 AND momentum < b) AS is_green
FROM y, (SELECT momentum AS b FROM y WHERE ticker = 'view') q"""))
def _(c):
    return t.sector_gravity(c.dense, "view")


@query("t22_lag_frame", sql("bars", f""", x AS (SELECT ticker, date, 100 * (close / lag(close) OVER ({W}) - 1) AS ret_pct FROM bars)
SELECT ticker, date, round(ret_pct, 6) + 0 AS ret_pct, CASE WHEN ret_pct > 0 THEN 1 ELSE 0 END AS direction,
  {', '.join(f'round(lag(ret_pct, {i}) OVER ({W}), 6) + 0 AS lag{i}' for i in range(1, 6))}, round({strict('stddev_samp', 20, 'ret_pct')}, 6) AS std_20 FROM x"""))
def _(c):
    return t.lag_frame(c.bars)


@query("t23_volume_weighted_lags", sql("bars", f""", x AS (SELECT ticker, date, close / lag(close) OVER ({W}) - 1 AS q, volume / avg(volume) {ov(30)} AS v FROM bars)
SELECT ticker, date, {', '.join(f'round(lag(q, {i}) OVER ({W}) * coalesce(lag(v, {i}) OVER ({W}), 1), 6) + 0 AS vw_lag{i}' for i in (1, 2, 3))} FROM x"""))
def _(c):
    return t.volume_weighted_lags(c.bars)


@query("t24_analyst_upside", """SELECT p_partkey, round(100 * (avg_price - p_retailprice) / p_retailprice, 6) + 0 AS upside_pct,
  replace(upper(p_name), '_', ' ') AS consensus FROM (SELECT p_partkey, any_value(p_retailprice) AS p_retailprice,
  any_value(replace(p_name, ' ', '_')) AS p_name, avg(l_extendedprice / 29) AS avg_price
  FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1)""")
def _(c):
    px = c.table("lineitem").groupBy("l_partkey").agg(F.avg(F.col("l_extendedprice") / 29).alias("target"))
    p = c.table("part")
    return p.join(px, p.p_partkey == px.l_partkey, "left").select(
        "p_partkey", t.upside_pct(F.col("target"), F.col("p_retailprice")).alias("upside_pct"),
        t.consensus_label(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("consensus"))


@query("t25_unify_features", stage="dense", oracle=sql("dense", f""", x AS (SELECT ticker, date, 100 * (close / lag(close) OVER ({W}) - 1) AS q FROM dense),
y AS (SELECT ticker, date, q, lag(q) OVER ({W}) AS l1, lag(q, 2) OVER ({W}) AS l2 FROM x)
SELECT y.ticker, y.date, round(coalesce(y.q, 0), 6) + 0 AS target_ret_pct, round(coalesce(y.l1, 0), 6) + 0 AS target_lag1,
  round(coalesce(y.l2, 0), 6) + 0 AS target_lag2, CASE WHEN y.ticker = 'error' THEN 0 ELSE round(coalesce(s.l1, 0), 6) + 0 END AS error_lag1
FROM y LEFT JOIN y s ON y.date = s.date AND s.ticker = 'error'"""))
def _(c):
    lf = t.lag_frame(c.dense, 2)
    three = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in ("ret_pct", "lag1", "lag2")])).alias("f")
    own = lf.select("ticker", "date", F.col("ticker").alias("owner"), three).select("ticker", "date", "owner", "f.*")
    # each frame also holds the lag of one common owner and of the session's first other ticker
    first = lf.groupBy("date").agg(F.min_by(F.struct(F.col("ticker").alias("owner"), F.col("lag1").alias("value")), "ticker").alias("o"))
    common = lf.filter("ticker = 'error'").select("date", F.lit("error").alias("owner"), F.col("lag1").alias("value"))
    foreign = common.unionByName(first.select("date", "o.*").filter("owner <> 'error'"))
    rest = lf.select("ticker", "date").join(foreign, "date").filter("owner <> ticker").select("ticker", "date", "owner", F.lit("lag1").alias("feature"), "value")
    return t.unify_features(own.unionByName(rest), "error")
