"""K: sizing, settlement, allocation, gates and backtests."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates
from ..frames import by
from ..operators import backtest as bt
from ..operators import gates, report, settle, sizing
from ..operators.joins import moved_to_next_session
from ..operators.windows import rank_within, top_k
from .registry import query
from .sqltext import sql
from .windows import W

KG = ("CASE WHEN exp_ret > 0 AND exp_vol > 0 THEN greatest(0, p_up - (1 - p_up) / CASE WHEN exp_ret / exp_vol > 0.1 THEN exp_ret / exp_vol ELSE 1 END) ELSE 0 END")
KE = ("greatest(0, p_up - (1 - p_up) / CASE WHEN exp_ret > 0 AND exp_vol > 0 AND exp_ret / exp_vol > 0.1 THEN exp_ret / exp_vol ELSE 1 END)")


@query("k1_kelly", sql("pred", f"""SELECT ticker, date,
  round(CASE WHEN exp_ret > 0 AND exp_vol > 0 THEN greatest(0, p_up - (1 - p_up) / (exp_ret / exp_vol)) ELSE 0 END, 6) + 0 AS strict,
  round({KG}, 6) + 0 AS guarded, round({KE}, 6) + 0 AS etf,
  round(CASE WHEN exp_ret > 1e-4 AND exp_vol > 1e-4 THEN least(1, greatest(0, p_up - (1 - p_up) / CASE WHEN exp_ret / exp_vol > 0.1 THEN exp_ret / exp_vol ELSE 1 END)) ELSE 0 END, 6) + 0 AS backtest,
  round(CASE WHEN p_up > 0.65 AND exp_ret > 0 THEN least(1, coalesce(greatest(0, p_up - (1 - p_up) / (exp_ret / exp_vol)), 0)) ELSE 0 END, 6) + 0 AS scorecard
  FROM pred WHERE p_up IS NOT NULL AND exp_ret IS NOT NULL AND exp_vol IS NOT NULL"""))
def _(c):
    d = c.pred.dropna(subset=["p_up", "exp_ret", "exp_vol"])
    return d.select("ticker", "date", *[sizing.kelly("p_up", "exp_ret", "exp_vol", v).alias(v)
                                        for v in ("strict", "guarded", "etf", "backtest", "scorecard")])


@query("k2_recommendation", sql("pred", """SELECT ticker, date, CASE WHEN p_up > 0.65 THEN 'Buy' WHEN p_up < 0.35 THEN 'Sell' ELSE 'Hold' END AS stock,
  CASE WHEN p_up >= 0.51 THEN 'Buy' WHEN p_up <= 0.49 THEN 'Sell' ELSE 'Hold' END AS etf,
  CASE WHEN coalesce(exp_vol > 1, false) THEN 'Hold' WHEN p_up > 0.65 THEN 'Buy' WHEN p_up < 0.35 THEN 'Sell' ELSE 'Hold' END AS forced FROM pred"""))
def _(c):
    return c.pred.select("ticker", "date", sizing.recommendation("p_up").alias("stock"), sizing.recommendation("p_up", "etf").alias("etf"),
                         sizing.recommendation("p_up", hold=F.coalesce(F.col("exp_vol") > 1, F.lit(False))).alias("forced"))


_REC = "CASE WHEN p_up > 0.65 THEN 'Buy' WHEN p_up < 0.35 THEN 'Sell' ELSE 'Hold' END"


@query("k3_hit_label", sql("pred", f""", x AS (SELECT ticker, date, {_REC} AS rec, lead(ret) OVER ({W}) AS nxt FROM pred)
SELECT ticker, date, rec, CASE WHEN nxt IS NULL THEN 'Pending' WHEN rec = 'Hold' THEN 'Hold' WHEN (rec = 'Buy' AND nxt > 0) OR (rec = 'Sell' AND nxt <= 0) THEN 'On target' ELSE 'Miss' END AS hit FROM x"""))
def _(c):
    d = c.pred.select("ticker", "date", sizing.recommendation("p_up").alias("rec"), F.lead("ret").over(by()).alias("nxt"))
    return d.select("ticker", "date", "rec", sizing.hit_label(F.col("rec"), F.col("nxt")).alias("hit"))


@query("k4_override_note", sql("pred macro", f""", x AS (SELECT ticker, p.date, {_REC} AS rec, p_up, {KG} AS k, vix_close FROM pred p LEFT JOIN macro m ON p.date = m.date)
SELECT ticker, date, CASE WHEN rec = 'Buy' AND vix_close > 30 THEN 'VETO: volatility index above 30' WHEN rec = 'Buy' AND k = 0
  THEN 'VETO: zero stake at P(UP)=' || format('{{:.1f}}', round(p_up * 100, 1)) || '%' ELSE '' END AS note FROM x"""))
def _(c):
    d = c.pred.join(c.macro.select("date", "vix_close"), "date", "left")
    return d.select("ticker", "date", sizing.override_note(
        sizing.recommendation("p_up"), F.col("vix_close"), sizing.kelly("p_up", "exp_ret", "exp_vol"), F.col("p_up")).alias("note"))


def fear_sql(p: str, v: str) -> str:
    return f"""CASE WHEN {p} LIKE 'etf%' THEN CASE WHEN {v} > 30 THEN 0.0 WHEN {v} > 25 THEN 0.5 WHEN {v} > 20 THEN 0.8 ELSE 1.0 END
  WHEN {p} = 'conservative' THEN CASE WHEN {v} > 25 THEN 0.0 WHEN {v} > 20 THEN 0.3 ELSE 1.0 END
  WHEN {p} = 'aggressive' THEN CASE WHEN {v} > 45 THEN 0.0 WHEN {v} > 35 THEN 0.8 ELSE 1.0 END
  ELSE CASE WHEN {v} > 30 THEN 0.0 WHEN {v} > 20 THEN 0.8 ELSE 1.0 END END"""


def stop_sql(p: str, v: str) -> str:
    def t(a, b, c):
        return f"CASE WHEN {v} > 35 THEN {a} WHEN {v} > 25 THEN {b} ELSE {c} END"
    return f"""CASE {p} WHEN 'etf_neutral' THEN {t(-0.01, -0.02, -0.03)} WHEN 'conservative' THEN {t(-0.01, -0.025, -0.04)}
  WHEN 'neutral' THEN {t(-0.02, -0.035, -0.05)} ELSE {t(-0.03, -0.045, -0.06)} END"""


@query("k5_fear_multiplier", sql("ledger macro", f"SELECT persona, l.date, CAST({fear_sql('persona', 'vix_close')} AS DOUBLE) AS multiplier FROM ledger l JOIN macro m ON l.date = m.date"))
def _(c):
    d = c.ledger.select("persona", "date").join(c.macro, "date")
    return d.select("persona", "date", sizing.fear_multiplier(F.col("persona"), F.col("vix_close")).alias("multiplier"))


@query("k6_stop_level", sql("ledger macro", f"SELECT persona, l.date, CAST({stop_sql('persona', 'vix_close')} AS DOUBLE) AS stop FROM ledger l JOIN macro m ON l.date = m.date"))
def _(c):
    d = c.ledger.select("persona", "date").join(c.macro, "date")
    return d.select("persona", "date", sizing.stop_level(F.col("persona"), F.col("vix_close")).alias("stop"))


# positions in suppliers: previous close is the entry, one holding per persona and bar
POS = f""", hp AS (SELECT ticker, date, low, close, lag(close) OVER ({W}) AS entry, volume FROM bars),
pos AS (SELECT u.persona, ticker, date, low, close, entry AS price, volume * 10 AS dollars FROM hp, (SELECT unnest(['conservative', 'neutral', 'aggressive']) AS persona) u WHERE entry IS NOT NULL)
"""


def _pos(c):
    b = c.bars.select("ticker", "date", F.lag("close").over(by()).alias("price"), (F.col("volume") * 10).alias("dollars"))
    return sizing.with_personas(b.filter("price is not null")).select("persona", "ticker", "date", "price", "dollars")


SETTLED = POS + f""", st AS (SELECT persona, ticker, p.date, dollars, price, p.close, CASE WHEN (low - price) / price <= {stop_sql('persona', 'vix_close')} THEN {stop_sql('persona', 'vix_close')}
  ELSE (close - price) / price END AS ret FROM pos p LEFT JOIN macro m ON p.date = m.date)
"""


@query("k7_settle", stage="bars", oracle=sql("bars macro", SETTLED + "SELECT persona, ticker, date, round(ret, 6) + 0 AS ret, round(dollars * ret, 4) + 0 AS pnl FROM st"))
def _(c):
    d = settle.settle(_pos(c), c.bars, c.macro)
    return d.select("persona", "ticker", "date", "ret", F.round("pnl", 4).alias("pnl"))


@query("k8_settle_missing", stage="bars", oracle=sql("bars", """, lost AS (SELECT ticker, date, close * 0.9 AS price, volume AS dollars FROM bars WHERE ticker NOT IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_acctbal > 0)),
px AS (SELECT ticker, date AS price_date, close FROM bars WHERE month(date) % 2 = 0), j AS (SELECT l.*, px.close FROM lost l ASOF LEFT JOIN px ON l.ticker = px.ticker AND l.date >= px.price_date)
SELECT ticker, date, round(coalesce(dollars * (close - price) / price, 0), 4) + 0 AS pnl, CASE WHEN close IS NULL THEN 'AT_COST' ELSE 'RECOVERED' END AS resolution FROM j"""))
def _(c):
    b = c.bars
    pos = b.select("ticker", "date", (F.col("close") * 0.9).alias("price"), F.col("volume").alias("dollars"))
    ok = c.table("supplier").filter("s_acctbal > 0").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"))
    d = settle.settle_missing(pos, ok, b.filter(F.month("date") % 2 == 0))
    return d.select("ticker", "date", F.round("pnl", 4).alias("pnl"), "resolution")


ALLOC = f""", ca AS (SELECT u.persona, u.th, u.mu, u.cap, u.fl, p.ticker, p.date, p_up, close AS price, exp_ret, exp_vol, vix_close, abs(l.total_equity) AS equity,
  {fear_sql('u.persona', 'vix_close')} AS fm FROM pred p JOIN macro m ON p.date = m.date
  JOIN (SELECT * FROM (VALUES ('conservative', 0.60, 0.25, 0.10, 0.05), ('neutral', 0.60, 0.50, 0.10, 0.10), ('aggressive', 0.55, 0.90, 0.15, 0.15)) v(persona, th, mu, cap, fl)) u ON true
  JOIN ledger l ON l.persona = u.persona AND l.date = p.date),
cb AS (SELECT *, {KG} * CAST(mu AS DOUBLE) * CAST(fm AS DOUBLE) AS ap FROM ca WHERE p_up > CAST(th AS DOUBLE) AND fm > 0),
cc AS (SELECT *, least(CASE WHEN ap = 0 THEN CAST(fl AS DOUBLE) * CAST(fm AS DOUBLE) ELSE ap END, CAST(cap AS DOUBLE)) AS pct FROM cb),
cd AS (SELECT persona, date, ticker, price, equity, pct, equity * pct AS raw, row_number() OVER (PARTITION BY persona, date ORDER BY p_up DESC, ticker) AS rn FROM cc WHERE pct > 0)
"""


def _cands(c):
    d = sizing.with_personas(c.pred.join(c.macro.select("date", "vix_close"), "date"))
    d = d.join(c.ledger.select("persona", "date", F.abs("total_equity").alias("cash")), ["persona", "date"])
    d = d.withColumn("pct", sizing.stake_fraction()).filter("pct > 0")
    return d.select("persona", "date", "ticker", (-F.col("p_up")).alias("neg_p"), F.col("close").alias("price"), "cash", "pct",
                    (F.col("cash") * F.col("pct")).alias("raw"))


@query("k9_allocate", sql("pred macro ledger", ALLOC + """, f AS (SELECT persona, date, CAST(0 AS BIGINT) AS rn, max(equity) AS cash, CAST('' AS VARCHAR) AS ticker, 0.0::DOUBLE AS price, 0.0::DOUBLE AS a FROM cd GROUP BY 1, 2
UNION ALL SELECT f.persona, f.date, c.rn, f.cash - floor(least(c.raw, f.cash) / c.price) * c.price, c.ticker, c.price, floor(least(c.raw, f.cash) / c.price) * c.price
  FROM f JOIN cd c ON c.persona = f.persona AND c.date = f.date AND c.rn = f.rn + 1)
SELECT persona, date, ticker, round(a, 4) AS dollars, round(a / price, 0) AS units FROM f WHERE a > 0""").replace("WITH", "WITH RECURSIVE", 1))
def _(c):
    d = sizing.allocate(_cands(c))
    return d.select("persona", "date", "ticker", F.round("dollars", 4).alias("dollars"), "units")


@query("x4_ordered_fold", sql("pred macro ledger", ALLOC + """, f AS (SELECT persona, date, CAST(0 AS BIGINT) AS rn, max(equity) AS cash, CAST(0 AS BIGINT) AS bought FROM cd GROUP BY 1, 2
UNION ALL SELECT f.persona, f.date, c.rn, f.cash - floor(least(c.raw, f.cash) / c.price) * c.price, f.bought + CASE WHEN floor(least(c.raw, f.cash) / c.price) > 0 THEN 1 ELSE 0 END
  FROM f JOIN cd c ON c.persona = f.persona AND c.date = f.date AND c.rn = f.rn + 1)
SELECT persona, date, round(arg_max(cash, rn), 4) AS cash_left, max(bought) AS bought FROM f GROUP BY 1, 2""").replace("WITH", "WITH RECURSIVE", 1))
def _(c):
    """What the cash walk of each persona and session leaves; one row per ticker and session bounds a group."""
    folded = sizing.fold_cash(_cands(c), ["persona", "date"], ["neg_p", "ticker"], each=False)
    return folded.select("persona", "date", F.round("acc.left", 4).alias("cash_left"), F.col("acc.bought").alias("bought"))


_BARRED = """, hd AS (SELECT date, ticker, close * 10 AS v FROM pred WHERE ret < -0.3), fz AS (SELECT date, sum(v) AS f FROM hd GROUP BY 1),
br AS (SELECT ticker, date FROM (SELECT *, count(*) FILTER (ret < 0) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS k FROM pred) WHERE k >= 4),
cf AS (SELECT persona, date, ticker, price, pct, greatest(0, equity - coalesce(f, 0)) AS equity, row_number() OVER (PARTITION BY persona, date ORDER BY rn) AS rn FROM cd LEFT JOIN fz USING (date)
  WHERE NOT EXISTS (SELECT 1 FROM hd WHERE hd.date = cd.date AND hd.ticker = cd.ticker) AND NOT EXISTS (SELECT 1 FROM br WHERE br.date = cd.date AND br.ticker = cd.ticker)),
cr AS (SELECT *, equity * pct AS raw FROM cf)
"""


@query("k9_restricted", stage="pred", oracle=sql("pred macro ledger", ALLOC + _BARRED + """, f AS (SELECT persona, date, CAST(0 AS BIGINT) AS rn, max(equity) AS cash, CAST('' AS VARCHAR) AS ticker, 0.0::DOUBLE AS price, 0.0::DOUBLE AS a FROM cr GROUP BY 1, 2
UNION ALL SELECT f.persona, f.date, c.rn, f.cash - floor(least(c.raw, f.cash) / c.price) * c.price, c.ticker, c.price, floor(least(c.raw, f.cash) / c.price) * c.price
  FROM f JOIN cr c ON c.persona = f.persona AND c.date = f.date AND c.rn = f.rn + 1)
SELECT persona, date, ticker, round(a, 4) AS dollars, round(a / price, 0) AS units FROM f WHERE a > 0""").replace("WITH", "WITH RECURSIVE", 1))
def _(c):
    """Frozen positions keep their value; tickers with four losing sessions in six may not be bought."""
    cands = _cands(c)
    who = F.explode(F.array(*[F.lit(p) for p in sizing.STOCK_RULES])).alias("persona")
    held = c.pred.filter("ret < -0.3").select(who, "date", "ticker", (F.col("close") * 10).alias("value"))
    strikes = F.count_if(F.col("ret") < 0).over(by().rowsBetween(-5, 0))
    barred = c.pred.select("ticker", "date", strikes.alias("k")).filter("k >= 4")
    d = sizing.allocate(sizing.restrict(cands, held, barred))
    return d.select("persona", "date", "ticker", F.round("dollars", 4).alias("dollars"), "units")


@query("k10_retained", sql("positions", """, f AS (SELECT persona, ticker FROM positions WHERE pnl < -1000 GROUP BY 1, 2)
SELECT p.persona, p.ticker, p.date, round(dollars + pnl, 2) + 0 AS value FROM positions p JOIN f ON p.persona = f.persona AND p.ticker = f.ticker WHERE dollars > 0"""))
def _(c):
    d = settle.retained(c.positions, c.positions.filter("pnl < -1000"))
    return d.select("persona", "ticker", "date", F.round("value", 2).alias("value"))


@query("k11_target_state", sql("positions", """, t AS (SELECT persona, date, round(sum(dollars), 2) AS held FROM positions GROUP BY 1, 2)
SELECT p.persona, p.date, p.ticker, round(dollars, 2) AS dollars, round(units, 2) AS units, round(price * 1.0007, 2) AS price, held FROM positions p JOIN t ON p.persona = t.persona AND p.date = t.date"""))
def _(c):
    d = settle.target_state(c.positions.withColumn("price", F.col("price") * 1.0007))
    return d.select("persona", "date", "held", F.explode("target_holdings").alias("ticker", "h")).select(
        "persona", "date", "ticker", "h.dollars", "h.units", "h.price", "held")


@query("k12_best_persona", stage="pred", oracle=sql("pred", """, g AS (SELECT sector AS persona, date, avg(ret) AS ret FROM pred GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY persona ORDER BY date DESC) AS n FROM g),
s AS (SELECT persona, avg(ret) / stddev_samp(ret) * sqrt(252.0) AS sharpe FROM t WHERE n <= 30 GROUP BY 1)
SELECT arg_max(persona, sharpe) AS winner, round(max(sharpe), 6) AS sharpe FROM s"""))
def _(c):
    g = c.pred.groupBy(F.col("sector").alias("persona"), "date").agg(F.avg("ret").alias("ret"))
    return sizing.best_persona(g)


@query("k13_enforce_balance", sql("ledger", """SELECT persona, date, abs(cash + held - total_equity) > 0.1 AS corrected,
  round(CASE WHEN abs(cash + held - total_equity) > 0.1 THEN total_equity - held ELSE cash END, 2) + 0 AS cash FROM ledger"""))
def _(c):
    return settle.enforce_balance(c.ledger).select("persona", "date", "corrected", F.round("cash", 2).alias("cash"))


#: Every session with the one before it and the one after it.
_SESSIONS = "se AS (SELECT date, lead(date) OVER (ORDER BY date) AS next, lag(date) OVER (ORDER BY date) AS prev FROM (SELECT DISTINCT date FROM positions))"

FILLS = f""", {_SESSIONS}, cur AS (SELECT p.* REPLACE (next AS date) FROM positions p JOIN se USING (date) WHERE next IS NOT NULL AND ticker <> 'BUILDING'),
tgt AS (SELECT p.* FROM positions p JOIN se USING (date) WHERE prev IS NOT NULL AND ticker NOT IN ('FURNITURE', 'HOUSEHOLD')),
fl AS (SELECT persona, prev AS date, ticker, CASE ticker WHEN 'BUILDING' THEN 'BUY' WHEN 'FURNITURE' THEN 'SELL' WHEN 'HOUSEHOLD' THEN 'ABORTED_SELL' ELSE 'SELL' END AS type, price * 1.0100013 AS fp
  FROM positions p JOIN se USING (date) WHERE prev IS NOT NULL AND ticker <> 'MACHINERY'),
mg AS (SELECT persona, date, ticker, coalesce(fl.type, 'NONE') AS type, t.dollars IS NOT NULL AS it, c.dollars IS NOT NULL AS ic, fp,
  t.dollars AS td, t.units AS tu, t.price AS tp, c.units AS cu, c.price AS cp, q.pnl FROM tgt t FULL JOIN cur c USING (persona, date, ticker)
  LEFT JOIN fl USING (persona, date, ticker) LEFT JOIN positions q USING (persona, date, ticker)),
mh AS (SELECT *, CASE WHEN type = 'BUY' AND it THEN tu * tp - floor(tu * tp / fp) * fp WHEN type = 'NONE' AND it AND NOT ic THEN td WHEN type = 'SELL' AND NOT it THEN cu * fp - cu * cp - coalesce(pnl, 0)
    WHEN type = 'SELL' THEN tu * fp WHEN type = 'ABORTED_SELL' AND ic THEN -(cu * cp + coalesce(pnl, 0)) ELSE 0 END AS cash_move,
  CASE WHEN type = 'BUY' AND it THEN floor(tu * tp / fp) * fp WHEN type = 'ABORTED_SELL' AND ic THEN cu * cp + coalesce(pnl, 0) WHEN type = 'NONE' AND it AND ic THEN td END AS d,
  CASE WHEN type = 'SELL' AND NOT it THEN cu * fp - cu * cp WHEN type = 'SELL' THEN coalesce(pnl, 0) + tu * fp - td ELSE pnl END AS np FROM mg)
"""


def _merged(c):
    """Each session's targets against the holdings before it; the next session's prices are the fills."""
    p = c.positions
    cur = moved_to_next_session(p).filter("ticker <> 'BUILDING'")
    o = Window.orderBy("date")  # one row per session
    se = p.select("date").distinct().withColumn("prev", F.lag("date").over(o)).filter("prev is not null")
    later = p.join(se, "date")
    fl = later.filter("ticker <> 'MACHINERY'").select(
        "persona", F.col("prev").alias("date"), "ticker", F.when(F.col("ticker") == "BUILDING", "BUY").when(F.col("ticker") == "HOUSEHOLD", "ABORTED_SELL").otherwise("SELL").alias("type"),
        (F.col("price") * 1.0100013).alias("fill_price"), F.lit(False).alias("cash_reversed"))
    return settle.merge_executions(later.filter("ticker not in ('FURNITURE', 'HOUSEHOLD')"), cur, fl, p, ("persona", "date"))


@query("k14_merge_executions", stage="positions", oracle=sql("positions", FILLS + "SELECT persona, date, ticker, type, d IS NOT NULL AS held, round(d, 3) AS dollars, round(cash_move, 3) + 0 AS cash_move, round(np, 3) + 0 AS pnl FROM mh"))
def _(c):
    return _merged(c).select("persona", "date", "ticker", "type", "held", *[F.round(x, 3).alias(x) for x in ("dollars", "cash_move", "pnl")])


@query("k14_executed_ledger", stage="positions", oracle=sql("positions", FILLS + """SELECT persona, date, round(5000.0000301 + sum(cash_move), 2) AS cash, round(5000.0000301 + sum(cash_move) + coalesce(sum(d), 0), 2) AS total_equity,
  CASE WHEN bool_and(type = 'NONE') THEN '@HELD@' ELSE '@DONE@' || concat_ws(' & ', CASE WHEN bool_or(type = 'BUY') THEN 'BUY' END, CASE WHEN bool_or(type = 'SELL') THEN 'TP/SL' END, CASE WHEN bool_or(type = 'ABORTED_SELL') THEN 'ABORTED SELL' END) END AS intraday_status FROM mh GROUP BY 1, 2""".replace("@HELD@", settle.HELD_ALL).replace("@DONE@", settle.EXECUTED)))
def _(c):
    merged = _merged(c)
    orders = merged.select("persona", "date", F.lit(5000.0000301).alias("target_cash")).distinct()
    return settle.executed_ledger(merged, orders, ("persona", "date"))


_GATE = f""", gx AS (SELECT ticker, b.date, open AS live, lag(close) OVER (PARTITION BY ticker ORDER BY b.date) AS pc, lag((high + low + close) / 3) OVER (PARTITION BY ticker ORDER BY b.date) AS vw, volume,
  avg(volume) OVER (PARTITION BY ticker ORDER BY b.date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS av, vix_close FROM bars b LEFT JOIN macro m ON b.date = m.date),
gp AS (SELECT gx.*, u.persona FROM gx, (SELECT unnest(['conservative', 'neutral', 'aggressive']) AS persona) u)
"""


def _gate(c):
    w = by()
    trail = w.rowsBetween(-10, -1)
    b = c.bars.join(c.macro.select("date", "vix_close"), "date", "left").select(
        "ticker", "date", F.col("open").alias("live"), F.lag("close").over(w).alias("pc"),
        F.lag((F.col("high") + F.col("low") + F.col("close")) / 3).over(w).alias("vw"), "volume", F.avg("volume").over(trail).alias("av"), "vix_close")
    return sizing.with_personas(b)


@query("k15_entry_gate", sql("bars macro", _GATE + """SELECT persona, ticker, date, CASE WHEN pc IS NULL OR vw IS NULL OR av IS NULL THEN 'NO_DATA' WHEN NOT (live > pc AND live > vw * (CASE persona WHEN 'conservative' THEN 1.01::DOUBLE WHEN 'aggressive' THEN 1.0025 ELSE 1.005 END
    + CASE WHEN vix_close >= 20 THEN 0.015::DOUBLE ELSE 0 END)) THEN 'WAIT' WHEN volume < av * (150.0 / 390.0) * 0.5 THEN 'LOW_VOLUME' ELSE 'BUY' END AS gate,
  CASE WHEN pc IS NULL OR (live > pc AND live > vw * CASE persona WHEN 'conservative' THEN 1.01::DOUBLE WHEN 'aggressive' THEN 1.0025 ELSE 1.005 END) THEN 'ABORTED_SELL' ELSE 'SELL' END AS shield FROM gp"""))
def _(c):
    d = _gate(c)
    col = F.col
    ev = dates.expected_volume(col("av"), F.lit(150.0))
    return d.select("persona", "ticker", "date", gates.entry_gate(
        col("persona"), col("live"), col("pc"), col("vw"), col("vix_close"), F.lit(False), col("volume"), ev).alias("gate"),
        gates.sell_shield(col("persona"), col("live"), col("pc"), col("vw")).alias("shield"))


@query("k16_exit_gate", sql("bars macro", _GATE + """, e AS (SELECT persona, ticker, date, 100 * (live - pc) / pc AS s, vix_close AS v,
  CASE persona WHEN 'conservative' THEN 5 WHEN 'aggressive' THEN 20 ELSE 10 END AS lv, CASE persona WHEN 'conservative' THEN 25 WHEN 'aggressive' THEN 45 ELSE 30 END AS pv,
  CASE WHEN vix_close >= 20 THEN CASE persona WHEN 'conservative' THEN 0.4 WHEN 'aggressive' THEN 1.0 ELSE 1.5 END ELSE 1.0 END AS sc FROM gp)
SELECT persona, ticker, date, CASE WHEN s IS NULL THEN 'NO_DATA' WHEN v >= pv THEN 'PANIC' WHEN s >= lv THEN 'TAKE_PROFIT' WHEN s <= -lv * sc THEN 'STOP' ELSE 'HOLD' END AS gate FROM e"""))
def _(c):
    col = F.col
    return _gate(c).select("persona", "ticker", "date", gates.exit_gate(
        col("persona"), col("ticker"), col("live"), col("pc"), col("vix_close")).alias("gate"))


@query("k17_leaderboard", sql("ledger", """, l AS (SELECT persona, arg_max(total_equity, date) AS total_equity FROM ledger GROUP BY 1)
SELECT persona, total_equity, rank() OVER (ORDER BY total_equity DESC) AS place FROM l"""))
def _(c):
    last = c.ledger.groupBy("persona").agg(F.max_by("total_equity", "date").alias("total_equity"))
    return rank_within(last.withColumn("board", F.lit("all")), "total_equity", "board", out="place").drop("board")


BT = f""", bx AS (SELECT p.*, m.vix_close AS v, lead(close) OVER (PARTITION BY ticker ORDER BY p.date) AS nc, lead(low) OVER (PARTITION BY ticker ORDER BY p.date) AS nl FROM pred p LEFT JOIN macro m ON p.date = m.date),
by_ AS (SELECT *, least(CASE WHEN exp_ret > 1e-4 AND ev > 1e-4 THEN least(1, greatest(0, p_up - (1 - p_up) / CASE WHEN exp_ret / ev > 0.1 THEN exp_ret / ev ELSE 1 END)) ELSE 0 END, 0.2) AS pct,
  CASE WHEN (nl - close) / close <= st THEN st ELSE (nc - close) / close END AS r FROM (SELECT *, CASE WHEN exp_vol > 0 THEN exp_vol ELSE 0.01::DOUBLE END AS ev,
    CASE WHEN v > 35 THEN -0.03::DOUBLE WHEN v > 25 THEN -0.045 ELSE -0.06 END AS st FROM bx WHERE p_up > 0.5 AND exp_ret > 0 AND nc IS NOT NULL)),
bz AS (SELECT ticker, date, p_up, pct, r, least(pct, greatest(0, 1 - coalesce(sum(pct) OVER (PARTITION BY date ORDER BY p_up DESC, ticker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS share FROM by_ WHERE pct > 0),
bd AS (SELECT date, sum(share * r) AS ret, count(*) FILTER (share > 1e-12) AS held FROM bz GROUP BY 1),
be AS (SELECT d.date, coalesce(ret, 0) AS ret, coalesce(held, 0) AS held FROM (SELECT DISTINCT date FROM pred) d LEFT JOIN bd ON d.date = bd.date)
"""


def _bt(c, **kw):
    s = c.pred.join(c.macro.select("date", F.col("vix_close").alias("vix_next")), "date", "left")
    return bt.backtest_positions(s, **kw)


@query("k18_backtest", sql("pred macro", BT + """SELECT date, round(ret, 6) + 0 AS ret, held, round(ln(10000) + sum(ln(1 + ret)) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS log_equity FROM be"""))
def _(c):
    p = _bt(c).withColumn("share", F.when(F.col("share") > 1e-12, F.col("share")).otherwise(0.0))
    d = bt.equity_curve(p, c.pred)
    return d.select("date", "ret", "held", F.ln("equity").alias("log_equity"))


@query("k19_strategy_race", stage="ledger", oracle=sql("ledger", """SELECT a.date, a.total_equity AS one, b.total_equity AS two FROM ledger a JOIN ledger b ON a.date = b.date AND b.persona = 'dynamic' WHERE a.persona = 'neutral' AND a.date > DATE '1998-01-01'
UNION ALL SELECT date, 1.0, 2.0 FROM ledger WHERE persona = 'aggressive' AND date < DATE '2000-01-01' AND date NOT IN
  (SELECT a.date FROM ledger a JOIN ledger b ON a.date = b.date AND b.persona = 'dynamic' WHERE a.persona = 'neutral' AND a.date > DATE '1998-01-01')"""))
def _(c):
    old = c.ledger.filter("persona = 'aggressive' and date < DATE'2000-01-01'").select("date", F.lit(1.0).alias("one"), F.lit(2.0).alias("two"))
    new = {n: c.ledger.filter((F.col("persona") == p) & (F.col("date") > F.lit("1998-01-01").cast("date"))).select("date", F.col("total_equity").alias("equity"))
           for n, p in (("one", "neutral"), ("two", "dynamic"))}
    return bt.strategy_race(old, new)


_STATS = """, lv AS (SELECT ticker, sector, close, volume, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS q, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n, count(*) OVER (PARTITION BY ticker) AS m FROM panel),
stats AS (SELECT ticker, any_value(sector) AS sector, avg(close * volume) FILTER (n <= 30) AS liquidity, stddev_samp(q) AS volatility FROM lv WHERE m >= 50 GROUP BY 1)
"""


@query("k20_composite_scores", stage="bars", oracle=sql("panel", _STATS + """, n AS (SELECT *, coalesce((liquidity - min(liquidity) OVER s) / nullif(max(liquidity) OVER s - min(liquidity) OVER s, 0), 0) AS a, coalesce(1 - (volatility - min(volatility) OVER s) / nullif(max(volatility) OVER s - min(volatility) OVER s, 0), 0) AS b FROM stats WINDOW s AS (PARTITION BY sector)),
x AS (SELECT sector, ticker, 0.7 * a + 0.3 * b AS cap_score, 0.3 * a + 0.7 * b AS vol_score FROM n),
y AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY cap_score DESC, ticker) AS place FROM x)
SELECT sector, ticker, round(cap_score, 6) AS cap_score, round(vol_score, 6) AS vol_score, place FROM y WHERE place <= 5"""))
def _(c):
    s = sizing.liquidity_and_volatility(c.bars).join(c.sectors, "ticker")
    d = sizing.composite_scores(s)
    return top_k(d, 5, "sector", [F.col("cap_score").desc(), F.col("ticker")], "place").select("sector", "ticker", "cap_score", "vol_score", "place")


@query("k21_rebalance_list", stage="bars", oracle=sql("panel", _STATS + """SELECT * FROM (SELECT sector, ticker, round(liquidity / volatility, 4) AS score, row_number() OVER (PARTITION BY sector ORDER BY liquidity / volatility DESC, ticker) AS place FROM stats) WHERE place <= 50"""))
def _(c):
    d = sizing.rebalance_list(c.bars, c.sectors, 50)
    return d.select("sector", "ticker", F.round("score", 4).alias("score"), "place")


@query("k22_list_churn", stage="bars", oracle=sql("bars", """, s AS (SELECT date, lead(date) OVER (ORDER BY date) AS next FROM (SELECT DISTINCT date FROM bars)), o AS (SELECT ticker, next AS date, 1 AS a FROM bars JOIN s USING (date) WHERE next IS NOT NULL), n AS (SELECT ticker, date, 1 AS b FROM bars)
SELECT date, ticker, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'dropped' ELSE 'kept' END AS change FROM o FULL JOIN n USING (date, ticker)"""))
def _(c):
    return sizing.list_churn(moved_to_next_session(c.bars), c.bars, ["date", "ticker"])


@query("k23_universe", stage="bars", oracle=sql("bars sectors", """, co AS (SELECT ticker FROM sectors WHERE industry = 'NATION_3'), lq AS (SELECT ticker FROM bars GROUP BY 1 HAVING avg(volume) * avg(close) >= 8000),
p AS (SELECT b.*, row_number() OVER (PARTITION BY b.ticker ORDER BY date DESC) AS n FROM bars b WHERE ticker IN (SELECT ticker FROM lq) AND ticker NOT IN (SELECT ticker FROM co)),
q AS (SELECT ticker, date, close, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS x FROM p WHERE n <= 10),
z AS (SELECT ticker, (arg_max(close, date) / arg_min(close, date) - 1) * stddev_samp(x) * sqrt(252.0) AS o FROM q GROUP BY 1 HAVING count(*) >= 5)
SELECT ticker, 'core' AS origin FROM co UNION ALL SELECT * FROM (SELECT ticker, 'thematic' AS origin FROM z WHERE o IS NOT NULL ORDER BY o DESC, ticker LIMIT 24)"""))
def _(c):
    return sizing.universe(c.bars, c.sectors.filter("industry = 'NATION_3'").select("ticker"), 8000.0)


@query("k24_fundamental_score", """WITH g AS (SELECT l_partkey, avg(l_discount) * 3 - 0.02 AS margin, avg(l_tax) * 5000 AS debt, avg(l_quantity) - 22 AS eps, avg(l_linenumber) AS rating, avg(l_extendedprice) / 40 AS target FROM lineitem GROUP BY 1),
s AS (SELECT p_partkey, CASE WHEN margin > 0.2 THEN 4 WHEN margin > 0.1 THEN 2 WHEN margin < 0 THEN -4 ELSE 0 END + CASE WHEN coalesce(debt, 100) < 50 THEN 3 WHEN debt > 200 THEN -3 ELSE 0 END
 + CASE WHEN eps > 5 THEN 2 WHEN eps > 0 THEN 1 WHEN eps < 0 THEN -2 ELSE 0 END + CASE WHEN rating <= 2 THEN 2 WHEN rating >= 3 THEN -2 ELSE 0 END
 + CASE WHEN target / p_retailprice - 1 > 0.2 THEN 3 WHEN target / p_retailprice - 1 > 0.1 THEN 1 WHEN target / p_retailprice - 1 < 0 THEN -3 ELSE 0 END AS s FROM part LEFT JOIN g ON p_partkey = l_partkey)
SELECT p_partkey, round(greatest(-1.0, least(1.0, s / 10.0)), 1) + 0 AS score FROM s""")
def _(c):
    g = c.table("lineitem").groupBy("l_partkey").agg(
        (F.avg("l_discount") * 3 - 0.02).alias("margin"), (F.avg("l_tax") * 5000).alias("debt"), (F.avg("l_quantity") - 22).alias("eps"),
        F.avg("l_linenumber").alias("rating"), (F.avg("l_extendedprice") / 40).alias("target"))
    p = c.table("part").join(g, F.col("p_partkey") == F.col("l_partkey"), "left")
    s = sizing.fundamental_score(*[F.col(x) for x in ("margin", "debt", "eps", "rating", "target", "p_retailprice")])
    return p.select("p_partkey", F.round(s, 1).alias("score"))


_TWO = f""", {_SESSIONS}, a AS (SELECT p.* REPLACE (next AS date) FROM positions p JOIN se USING (date) WHERE next IS NOT NULL),
ab AS (SELECT persona, date, ticker, coalesce(a.units, 0) AS ou, coalesce(b.units, 0) AS nu, coalesce(a.dollars, 0) AS od, coalesce(b.dollars, 0) AS nd FROM a FULL JOIN positions b USING (persona, date, ticker))
"""
_DAY = ("persona", "date")


def _two(c):
    return moved_to_next_session(c.ledger), c.ledger


@query("k25_pending_change", stage="ledger", oracle=sql("positions", _TWO + "SELECT persona, date, bool_or(abs(nd - od) > 1) AS pending FROM ab GROUP BY 1, 2"))
def _(c):
    return report.pending_change(*_two(c), keys=_DAY)


@query("k26_recent_trades", sql("positions", """, x AS (SELECT persona, ticker, date, dollars FROM positions), s AS (SELECT persona, date, lag(date) OVER (PARTITION BY persona ORDER BY date) AS prev FROM (SELECT DISTINCT persona, date FROM positions)),
k AS (SELECT s.persona, s.date, t.ticker, coalesce(n.dollars, 0) - coalesce(o.dollars, 0) AS change FROM s CROSS JOIN (SELECT DISTINCT ticker FROM positions) t
  LEFT JOIN x n ON n.persona = s.persona AND n.date = s.date AND n.ticker = t.ticker LEFT JOIN x o ON o.persona = s.persona AND o.date = s.prev AND o.ticker = t.ticker WHERE s.prev IS NOT NULL)
SELECT persona, date, ticker, round(change, 2) + 0 AS change, CASE WHEN change > 0 THEN 'BOUGHT $' ELSE 'SOLD $' END || format('{:,.2f}', abs(change)) || ' of ' || ticker AS trade FROM k WHERE abs(change) > 100"""))
def _(c):
    d = report.recent_trades(c.ledger)
    return d.withColumn("change", F.round("change", 2))


@query("k27_action_text", stage="ledger", oracle=sql("positions", _TWO + "SELECT persona, date, string_agg(CASE WHEN od = 0 AND nd > 0 THEN 'BUY' WHEN od > 0 AND nd = 0 THEN 'SELL' ELSE 'HOLD' END || ' ' || ticker, ' | ' ORDER BY CASE WHEN od = 0 AND nd > 0 THEN 'BUY' WHEN od > 0 AND nd = 0 THEN 'SELL' ELSE 'HOLD' END || ' ' || ticker) AS actions FROM ab GROUP BY 1, 2"))
def _(c):
    return report.action_text(*_two(c), keys=_DAY)


@query("k28_order_delta", stage="ledger", oracle=sql("positions", _TWO + "SELECT persona, date, ticker, ou AS old_units, nu AS new_units, CASE WHEN nu = 0 AND ou > 0 THEN 'SELL' WHEN nu < ou THEN 'REDUCE' WHEN nu > ou THEN 'BUY' ELSE 'HOLD' END AS action FROM ab"))
def _(c):
    return report.order_delta(*_two(c), keys=_DAY)


_BUG = "CASE WHEN ticker = 'BUILDING' AND month(date) IN (4, 5, 9) THEN 0 ELSE units END"


@query("k29_refund", stage="positions", oracle=sql("positions ledger", f""", u AS (SELECT persona, ticker, date, dollars, {_BUG} AS units FROM positions), v AS (SELECT *, lag(units = 0 AND dollars > 0) OVER (PARTITION BY persona, ticker ORDER BY date) AS p FROM u),
t AS (SELECT persona, sum(dollars) AS rf FROM v WHERE units = 0 AND dollars > 0 AND NOT coalesce(p, false) GROUP BY 1), m AS (SELECT persona, max(date) AS date FROM ledger GROUP BY 1)
SELECT l.persona, l.date, round(cash + CASE WHEN m.date IS NOT NULL THEN rf ELSE 0 END, 2) + 0 AS cash, round(total_equity + CASE WHEN m.date IS NOT NULL THEN rf ELSE 0 END, 2) + 0 AS total_equity
FROM ledger l JOIN t ON l.persona = t.persona LEFT JOIN m ON l.persona = m.persona AND l.date = m.date"""))
def _(c):
    bug = F.when((F.col("ticker") == "BUILDING") & F.month("date").isin(4, 5, 9), 0.0).otherwise(F.col("units"))
    lost = settle.lost_cash(c.positions.withColumn("units", bug))
    return settle.refund(c.ledger, lost).select("persona", "date", "cash", "total_equity")


@query("k30_compounding_curves", sql("pred", """, g AS (SELECT sector AS strategy, date, coalesce(avg(ret), 0) / 10 AS ret FROM pred GROUP BY 1, 2)
SELECT strategy, date, round(10000 * exp(sum(ln(1 + ret)) OVER (PARTITION BY strategy ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 2) AS equity FROM g"""))
def _(c):
    g = c.pred.groupBy(F.col("sector").alias("strategy"), "date").agg((F.coalesce(F.avg("ret"), F.lit(0.0)) / 10).alias("ret"))
    return bt.compounding_curves(g).select("strategy", "date", "equity")


@query("k31_pnl_race", stage="ledger", oracle=sql("positions", """, e AS (SELECT max(date) AS e FROM positions), d AS (SELECT DISTINCT persona, p.date FROM positions p, e WHERE p.date >= e.e - 300)
SELECT d.persona, d.date, round(sum(coalesce(pnl, 0)) OVER (PARTITION BY d.persona ORDER BY d.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) + 0 AS cum_pnl
FROM d LEFT JOIN positions p ON p.persona = d.persona AND p.date = d.date AND p.ticker = 'MACHINERY'"""))
def _(c):
    return bt.pnl_race(c.ledger, "MACHINERY", 300).withColumn("cum_pnl", F.round("cum_pnl", 2))


@query("k32_prediction_history", sql("pred", "SELECT ticker, date, exp_ret, round(ret, 6) + 0 AS actual_ret, round(coalesce(exp_ret / nullif(exp_vol, 0), 0), 6) + 0 AS expected_sharpe FROM pred WHERE exp_ret IS NOT NULL AND ret IS NOT NULL"))
def _(c):
    return bt.prediction_history(c.pred.withColumnRenamed("ret", "actual_ret"))


@query("k33_triple_witching", """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders UNION SELECT DISTINCT CAST(ts AS DATE) FROM events),
f AS (SELECT date, date_trunc('month', date)::DATE + CAST((5 - isodow(date_trunc('month', date)) + 7) % 7 AS INTEGER) + 14 AS third FROM d)
SELECT date, month(date) IN (3, 6, 9, 12) AND date = third AS is_witching FROM f""")
def _(c):
    d = c.table("orders").select(F.to_date("o_orderdate").alias("date")).union(c.table("events").select(F.to_date("ts"))).distinct()
    return d.select("date", dates.is_triple_witching(F.col("date")).alias("is_witching"))


