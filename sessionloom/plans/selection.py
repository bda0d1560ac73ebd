"""M1-M8: predictor selection and lag chains."""

from pyspark.sql import functions as F

from ..operators import select as s
from ..operators.indicators import sector_regime
from .indicators import REGIME, TREND
from .registry import query
from .sqltext import sql
from .windows import W

FEATURES = TREND + f""", tr2 AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS ret FROM trend),
features AS (SELECT date, ticker, 'RET' AS feature, ret AS value FROM tr2 UNION ALL SELECT date, ticker, 'RSI', rsi FROM tr2 UNION ALL SELECT date, ticker, 'ADX', adx FROM tr2
  UNION ALL SELECT date, ticker, 'ATR', atr FROM tr2 UNION ALL SELECT date, ticker, 'PLUS_DI', plus_di FROM tr2 UNION ALL SELECT date, ticker, 'MINUS_DI', minus_di FROM tr2)
"""
LAGGED = f""", lg1 AS (SELECT ticker, date, ret, lag(ret) OVER ({W}) AS l FROM pred)"""


def returns(c):
    return c.pred.select("ticker", "date", F.col("ret").alias("value"))


@query("m1_feature_matrix", sql("bars", FEATURES + """SELECT date, round(max(value) FILTER (ticker = 'S1' AND feature = 'RSI'), 6) AS "S1_RSI", round(max(value) FILTER (ticker = 'S2' AND feature = 'ATR'), 6) AS "S2_ATR",
  round(max(value) FILTER (ticker = 'S3' AND feature = 'RET'), 6) + 0 AS "S3_RET" FROM features WHERE ticker || '_' || feature IN ('S1_RSI', 'S2_ATR', 'S3_RET') GROUP BY 1"""))
def _(c):
    return s.feature_matrix(c.features, ["S1_RSI", "S2_ATR", "S3_RET"])


@query("m2_top_k_features", stage="bars", oracle=sql("bars", FEATURES + """, d AS (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars)) WHERE i <= floor(n * 0.8)),
fl AS (SELECT ticker || '_' || feature AS predictor, date, lag(value) OVER (PARTITION BY ticker, feature ORDER BY date) AS x FROM features),
g AS (SELECT t.ticker AS target, predictor, corr(t.ret, x) AS corr, count(*) AS n FROM tr2 t JOIN fl ON t.date = fl.date WHERE t.ret IS NOT NULL AND x IS NOT NULL AND t.date IN (SELECT date FROM d) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY abs(corr) DESC, predictor) AS rank FROM g WHERE n >= 30)
SELECT target, predictor, n, round(corr, 6) + 0 AS corr, rank FROM r WHERE rank <= 5"""))
def _(c):
    f = c.features
    t = f.filter("feature = 'RET'").select("ticker", "date", "value")
    return s.top_k_features(t, f, 5, min_obs=30).select("target", "predictor", "n", "corr", "rank")


@query("m3_lagged_r2_returns", stage="pred", oracle=sql("pred", LAGGED + """, f AS (SELECT date FROM lg1 WHERE ret IS NOT NULL AND l IS NOT NULL GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT ticker) FROM pred))
SELECT a.ticker AS target, b.ticker AS predictor, count(*) AS n, round(power(corr(a.ret, b.l), 2), 6) AS r2 FROM lg1 a JOIN lg1 b ON a.date = b.date JOIN f ON f.date = a.date GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY a.ticker ORDER BY abs(corr(a.ret, b.l)) DESC, b.ticker) <= 20"""))
def _(c):
    return s.lagged_r2(returns(c), 1)


@query("m3_lagged_r2_prices", stage="bars", oracle=sql("bars", f""", sp AS (SELECT ticker, min(date) AS a FROM bars GROUP BY 1), g AS (SELECT sp.ticker, d.date FROM sp JOIN (SELECT DISTINCT date FROM bars) d ON d.date >= sp.a),
f AS (SELECT g.ticker, g.date, last_value(close IGNORE NULLS) OVER (PARTITION BY g.ticker ORDER BY g.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM g LEFT JOIN bars b ON g.ticker = b.ticker AND g.date = b.date),
x AS (SELECT *, lag(v) OVER ({W}) AS l FROM f) SELECT a.ticker AS target, b.ticker AS predictor, count(*) AS n, round(power(corr(a.v, b.l), 2), 6) AS r2 FROM x a JOIN x b ON a.date = b.date WHERE b.l IS NOT NULL GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY a.ticker ORDER BY abs(corr(a.v, b.l)) DESC, b.ticker) <= 20"""))
def _(c):
    return s.lagged_r2(c.bars.select("ticker", "date", F.col("close").alias("value")), 1, mode="prices")


LAGS = (1, 2, 3, 4, 5)
MULTI = ", " + ", ".join(f"l{i} AS (SELECT ticker, date, ret, lag(ret, {i}) OVER ({W}) AS l FROM pred)" for i in LAGS) + """,
mc AS (""" + " UNION ALL ".join(f"SELECT a.ticker AS target, b.ticker AS predictor, {i} AS lag, corr(a.ret, b.l) AS corr, count(*) AS n FROM l{i} a JOIN l{i} b ON a.date = b.date AND a.ticker <> b.ticker WHERE a.ret IS NOT NULL AND b.l IS NOT NULL GROUP BY 1, 2" for i in LAGS) + """),
mr AS (SELECT *, row_number() OVER (PARTITION BY target, lag ORDER BY abs(corr) DESC, predictor) AS rank FROM mc)
"""


@query("m4_multi_lag", sql("pred", MULTI + "SELECT target, lag, predictor, n, round(corr, 6) + 0 AS corr, round(corr * corr, 6) AS r2, rank FROM mr WHERE rank <= 3"))
def _(c):
    return s.multi_lag(returns(c), LAGS, 3).select("target", "lag", "predictor", "n", "corr", "r2", "rank")


@query("m4_best_over_lags", sql("pred", MULTI + "SELECT target, predictor, lag, round(r2, 6) AS r2 FROM (SELECT target, predictor, lag, corr * corr AS r2, row_number() OVER (PARTITION BY target ORDER BY corr * corr DESC, lag, predictor) AS k FROM mr) WHERE k = 1"))
def _(c):
    return s.best_over_lags(s.multi_lag(returns(c), LAGS, 3))


EDGES = LAGGED + """, ec AS (SELECT a.ticker AS target, b.ticker AS predictor, corr(a.ret, b.l) AS corr, count(*) AS n FROM lg1 a JOIN lg1 b ON a.date = b.date WHERE a.ret IS NOT NULL AND b.l IS NOT NULL GROUP BY 1, 2),
edges AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY abs(corr) DESC, predictor) AS k FROM ec WHERE n >= 50) WHERE k = 1),
ch AS (SELECT e.target AS ticker, e.predictor AS lag1, f.predictor AS lag2, g.predictor AS lag3, h.predictor AS lag4, i.predictor AS lag5 FROM edges e LEFT JOIN edges f ON f.target = e.predictor
  LEFT JOIN edges g ON g.target = f.predictor LEFT JOIN edges h ON h.target = g.predictor LEFT JOIN edges i ON i.target = h.predictor)
"""


@query("m5_best_lag1", sql("pred", EDGES + "SELECT target, predictor, n, round(corr, 6) + 0 AS corr FROM edges"))
def _(c):
    return s.best_lag1(returns(c)).select("target", "predictor", "n", "corr")


@query("m6_lag_chain", sql("pred", EDGES + "SELECT * FROM ch"))
def _(c):
    return s.lag_chain(s.best_lag1(returns(c)), 5)


STEPS = ", st AS (" + " UNION ALL ".join(f"SELECT ticker, {d} AS depth, lag{d} AS leader, [" + ", ".join(["ticker", *[f"lag{i}" for i in range(1, d)]]) + f"] AS met FROM ch WHERE lag{d} IS NOT NULL" for d in range(1, 6)) + ")"


@query("m6_chain_steps", sql("pred", EDGES + STEPS + """, f AS (SELECT *, list_contains(met, leader) AS repeats, min(depth) FILTER (list_contains(met, leader)) OVER (PARTITION BY ticker) AS ends FROM st)
SELECT ticker, depth, leader, repeats FROM f WHERE ends IS NULL OR depth <= ends"""))
def _(c):
    return s.chain_steps(s.best_lag1(returns(c)), 5)


LEADERS = EDGES + ", " + ", ".join(f"s{d} AS (SELECT ticker, date, lag(ret, {d}) OVER ({W}) AS x FROM pred)" for d in (1, 2, 3)) + " "


@query("m7_chain_features", stage="pred", oracle=sql("panel pred", REGIME + LEADERS + f""", rg AS (SELECT ticker, date, lag(sector_momentum) OVER ({W}) AS sector_momentum FROM regime),
w AS (SELECT p.ticker, p.date, p.ret AS target, a.x AS c1, b.x AS c2, e.x AS c3, rg.sector_momentum AS m FROM pred p LEFT JOIN ch ON ch.ticker = p.ticker LEFT JOIN s1 a ON a.ticker = lag1 AND a.date = p.date
  LEFT JOIN s2 b ON b.ticker = lag2 AND b.date = p.date LEFT JOIN s3 e ON e.ticker = lag3 AND e.date = p.date LEFT JOIN rg ON rg.ticker = p.ticker AND rg.date = p.date),
f AS (SELECT ticker, date, target, """ + ", ".join(f"last_value({a} IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {b}" for a, b in (("c1", "chain1"), ("c2", "chain2"), ("c3", "chain3"), ("m", "sector_momentum"))) + """ FROM w)
SELECT ticker, date, round(target, 6) + 0 AS target, round(chain1, 6) + 0 AS chain1, round(chain2, 6) + 0 AS chain2, round(chain3, 6) + 0 AS chain3, round(sector_momentum, 6) + 0 AS sector_momentum FROM f
WHERE target IS NOT NULL AND chain1 IS NOT NULL AND chain2 IS NOT NULL AND chain3 IS NOT NULL AND sector_momentum IS NOT NULL"""))
def _(c):
    r = returns(c)
    chain = s.lag_chain(s.best_lag1(r), 3)
    extra = sector_regime(c.pred).select("ticker", "date", "sector_momentum")
    return s.chain_features(r, chain, 3, extra)


@query("m8_verify_chain", stage="pred", oracle=sql("pred", LEADERS + " UNION ALL ".join(f"SELECT p.ticker, {d} AS depth, lag{d} AS leader, round(corr(ret, x), 6) + 0 AS corr, count(*) FILTER (ret IS NOT NULL AND x IS NOT NULL) AS n FROM pred p JOIN ch ON ch.ticker = p.ticker JOIN s{d} ON s{d}.ticker = lag{d} AND s{d}.date = p.date GROUP BY 1, 2, 3" for d in (1, 2, 3))))
def _(c):
    r = returns(c)
    return s.verify_chain(r, s.lag_chain(s.best_lag1(r), 3), 3)
