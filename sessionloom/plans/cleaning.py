"""P: projections, filters and cleaning."""

from pyspark.sql import functions as F

from ..operators import cleaning as p
from .indicators import REGIME
from .registry import query
from .sqltext import r, sql
from .windows import CUM, W


@query("p1_dedup_keep_first", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (
  PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""")
def _(c):
    li = c.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return p.dedup(li, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]).drop("l_shipdate")


@query("p2_encode_categorical", sql("panel macro", REGIME + """SELECT ticker, re.date, CASE sector_regime WHEN 'BULL_REGIME' THEN 1 WHEN 'BEAR_REGIME' THEN -1 ELSE 0 END AS regime_code,
  CASE WHEN vix_close >= 30 THEN 0 WHEN vix_close >= 20 THEN 1 ELSE 0 END AS fear_code,
  CASE WHEN ret > 0.3 THEN 1 WHEN ret < -0.3 THEN -1 ELSE 0 END AS signal_code,
  CASE WHEN ret > 0.5 THEN 2 WHEN ret > 0.2 THEN 1 WHEN ret < -0.5 THEN -2 WHEN ret < -0.2 THEN -1 ELSE 0 END AS analyst_code
FROM regime re LEFT JOIN macro m ON re.date = m.date"""))
def _(c):
    from ..operators.indicators import sector_regime
    d = sector_regime(c.pred).join(c.macro.select("date", "vix_close"), "date", "left")
    ret = F.col("ret")
    sig = F.when(ret > 0.3, "BUY").when(ret < -0.3, "SELL").when(ret.isNotNull(), "HOLD")
    ana = (F.when(ret > 0.5, "Strong Buy").when(ret > 0.2, "Buy").when(ret < -0.5, "Strong Sell")
           .when(ret < -0.2, "Sell").when(ret.isNotNull(), "N/A"))
    return d.select("ticker", "date", p.encode("sector_regime", p.REGIME_CODES).alias("regime_code"),
                    p.encode(p.fear_level(F.col("vix_close")), p.FEAR_CODES).alias("fear_code"),
                    p.encode(sig, p.RAS_CODES).alias("signal_code"), p.encode(ana, p.ANALYST_CODES).alias("analyst_code"))


@query("p3_normalise_symbols", """SELECT p_partkey, replace(trim(' ' || replace(p_name, ' ', '.') || ' '), '.', '-') AS dashed,
  replace(trim(p_brand || '-A'), '-', '.') AS dotted, replace(trim(p_name), ' ', '_') AS label FROM part""")
def _(c):
    n = F.col("p_name")
    raw = F.concat(F.lit(" "), F.replace(n, F.lit(" "), F.lit(".")), F.lit(" "))
    return c.table("part").select("p_partkey", p.dash_symbol(raw).alias("dashed"),
                                  p.dot_symbol(F.concat("p_brand", F.lit("-A"))).alias("dotted"), p.sector_label(n).alias("label"))


_RAW = ("CASE event_id % 7 WHEN 0 THEN 'n/a' WHEN 1 THEN '' WHEN 2 THEN 'inf' WHEN 3 THEN ' ' || value || ' ' "
        "WHEN 4 THEN 'NaN' ELSE CAST(value AS VARCHAR) END")


def _raw(c):
    v, k = F.col("value").cast("string"), F.col("event_id") % 7
    return c.table("events").withColumn("raw", F.when(k == 0, "n/a").when(k == 1, "").when(k == 2, "inf").when(
        k == 3, F.concat(F.lit(" "), v, F.lit(" "))).when(k == 4, "NaN").otherwise(v))


@query("p4_coerce_numeric", f"""SELECT event_id, CASE WHEN isfinite(x) THEN x END AS num FROM (
  SELECT event_id, TRY_CAST(trim({_RAW}) AS DOUBLE) AS x FROM events)""")
def _(c):
    return _raw(c).select("event_id", p.to_number(F.col("raw")).alias("num"))


@query("p5_local_date", """SELECT event_id, CAST(ts AS DATE) AS utc_date, CAST(ts - INTERVAL 5 HOUR AS DATE) AS new_york_date FROM events""")
def _(c):
    return c.table("events").select("event_id", F.to_date("ts").alias("utc_date"),
                                    p.local_date(F.col("ts"), "America/New_York").alias("new_york_date"))


@query("p6_finite_target", f"""SELECT event_id, x AS target FROM (SELECT event_id, TRY_CAST(trim({_RAW}) AS DOUBLE) AS x FROM events)
  WHERE x IS NOT NULL AND isfinite(x)""")
def _(c):
    d = _raw(c).select("event_id", F.trim("raw").try_cast("double").alias("target"))
    return p.drop_missing_target(d, "target")


_DAYS = """, span AS (SELECT min(date) AS a, max(date) AS b FROM gappy), cal AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM span),
grid AS (SELECT t.ticker, cal.date, g.close FROM (SELECT DISTINCT ticker FROM gappy) t, cal LEFT JOIN gappy g ON g.ticker = t.ticker AND g.date = cal.date)
"""


@query("p7_fill_forward_back", stage="gappy", oracle=sql("gappy", _DAYS.replace("FROM (SELECT DISTINCT ticker FROM gappy) t, cal LEFT JOIN", "FROM (SELECT DISTINCT ticker FROM gappy) t CROSS JOIN cal LEFT JOIN") +
       f"""SELECT ticker, date, coalesce(last_value(close IGNORE NULLS) {CUM}, first_value(close IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS close
FROM grid WHERE isodow(date) < 6"""))
def _(c):
    from ..operators.joins import densify
    g = densify(c.gappy.select("ticker", "date", "close"), fill=False)
    return p.fill_forward_back(g, "close")


@query("p8_min_history", stage="gappy", oracle=sql("gappy", "SELECT ticker, date, close FROM gappy WHERE ticker IN (SELECT ticker FROM gappy GROUP BY 1 HAVING count(*) >= 28)"))
def _(c):
    return p.min_history(c.gappy, 28).select("ticker", "date", "close")


@query("p9_date_slice", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, o_totalprice FROM orders WHERE o_orderdate >= DATE '1996-03-01' AND o_orderdate <= DATE '1998-06-30'")
def _(c):
    # compared on the stored column, so the bounds reach the Parquet scan
    return p.between_dates(c.table("orders"), "1996-03-01", "1998-06-30", "o_orderdate").select(
        "o_orderkey", F.to_date("o_orderdate").alias("date"), "o_totalprice")


_FEATS = {"close": "RET_ADJ", "volume": "vix_level", "high": "SEC_MOM", "low": "macro_x"}
_LONG = ", ".join(f"(ticker || '_{v}', {k})" for k, v in _FEATS.items())


def _features(c):
    return c.bars.select("ticker", "date", F.inline(F.array(*[
        F.struct(F.concat("ticker", F.lit(f"_{v}")).alias("feature"), F.col(k).alias("value")) for k, v in _FEATS.items()])))


@query("p10_exclude_features", sql("bars", """SELECT ticker, date, ticker || '_RET_ADJ' AS feature, round(close, 6) AS value FROM bars"""))
def _(c):
    return p.exclude_features(_features(c))


@query("p11_drop_empty_features", sql("bars", """, x AS (SELECT ticker || '_RET_ADJ' AS feature, date, close AS value FROM bars UNION ALL
  SELECT ticker || '_VOL', date, CASE WHEN ticker < 'S5' THEN NULL ELSE volume END FROM bars)
SELECT feature, date, round(value, 6) AS value FROM x WHERE feature IN (SELECT feature FROM x WHERE value IS NOT NULL)"""))
def _(c):
    x = c.bars.select("date", F.inline(F.array(
        F.struct(F.concat("ticker", F.lit("_RET_ADJ")).alias("feature"), F.col("close").alias("value")),
        F.struct(F.concat("ticker", F.lit("_VOL")).alias("feature"), F.when(F.col("ticker") >= "S5", F.col("volume")).alias("value")))))
    return p.drop_empty_features(x)


@query("p12_tail_head", stage="bars", oracle=sql("bars", """, x AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS d, row_number() OVER (PARTITION BY ticker ORDER BY date) AS a FROM bars)
SELECT ticker, date, round(close, 6) AS close, 'tail' AS part FROM x WHERE d <= 30 UNION ALL SELECT ticker, date, round(close, 6), 'head' FROM x WHERE a <= 5"""))
def _(c):
    b = c.bars.select("ticker", "date", "close")
    return p.tail(b, 30).withColumn("part", F.lit("tail")).unionByName(p.head(b, 5).withColumn("part", F.lit("head")))


@query("p13_fear_bins", sql("macro", """SELECT date, CASE WHEN vix_close >= 30 THEN 'Extreme Panic' WHEN vix_close >= 20 THEN 'High Volatility'
  ELSE 'Complacency / Calm' END AS fear FROM macro"""))
def _(c):
    return c.macro.select("date", p.fear_level(F.col("vix_close")).alias("fear"))


@query("p14_baseline_cut", sql("pred", f"SELECT ticker, date, p_up, {r('ret')} FROM pred WHERE date >= DATE '2000-01-01'"))
def _(c):
    return p.between_dates(c.pred, "2000-01-01").select("ticker", "date", "p_up", "ret")


@query("p15_display", sql("ledger", """SELECT persona, strftime(date, '%Y-%m-%d') AS date, CASE WHEN cash < 0 THEN '-' ELSE '' END || '$' || format('{:,.2f}', abs(cash)) AS cash,
  CASE WHEN total_equity < 0 THEN '-' ELSE '' END || '$' || format('{:,.2f}', abs(total_equity)) AS total_equity, CASE WHEN intraday_status = 'SETTLED' THEN '☑' ELSE '☐' END AS settled FROM ledger"""))
def _(c):
    d = c.ledger.select(
        "persona", "date", "cash", "total_equity", (F.col("intraday_status") == "SETTLED").alias("settled"))
    return p.display(d)


@query("p16_future_row", stage="gappy", oracle=sql("gappy", """SELECT ticker, date, close, volume FROM gappy UNION ALL
SELECT ticker, d + CASE isodow(d) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END, NULL, v FROM (SELECT ticker, max(date) AS d, arg_max(volume, date) AS v FROM gappy GROUP BY 1)"""))
def _(c):
    return p.with_future_row(c.gappy.select("ticker", "date", "close", "volume"), known=["volume"])


@query("p17_remove_key", sql("positions", """SELECT persona, date, ticker, pnl FROM positions WHERE ticker <> 'MACHINERY'"""))
def _(c):
    return c.ledger.withColumn("daily_pnl", p.remove_key(F.col("daily_pnl"), "MACHINERY")).select(
        "persona", "date", F.explode("daily_pnl").alias("ticker", "pnl"))


SCORES = """, sc AS (SELECT ticker, date, CASE WHEN day(date + CAST(volume AS INTEGER)) = 3 THEN 1.5 ELSE p_up END AS p_up, exp_ret, exp_vol, ret AS actual_ret,
  CASE WHEN p_up > 0.65 THEN 'Buy' WHEN p_up < 0.35 THEN 'Sell' ELSE 'Hold' END AS recommendation,
  round(CASE WHEN p_up > 0.65 AND exp_ret > 0 THEN 2 * p_up - 1 ELSE 0 END, 6) AS kelly, '' AS note, 'Stable' AS status FROM pred WHERE p_up IS NOT NULL)
"""


def scores(c):
    """Predictions as a scorecard; some probabilities are deliberately out of range."""
    pu = F.col("p_up")
    return c.pred.filter(pu.isNotNull()).select(
        "ticker", "date",
        F.when(F.day(F.date_add("date", F.col("volume").cast("int"))) == 3, 1.5).otherwise(pu).alias("p_up"),
        "exp_ret", "exp_vol", F.col("ret").alias("actual_ret"),
        F.when(pu > 0.65, "Buy").when(pu < 0.35, "Sell").otherwise("Hold").alias("recommendation"),
        F.round(F.when((pu > 0.65) & (F.col("exp_ret") > 0), 2 * pu - 1).otherwise(0.0), 6).alias("kelly"),
        F.lit("").alias("note"), F.lit("Stable").alias("status"))


@query("p18_repair_bounds", sql("pred", SCORES + """, b AS (SELECT *, coalesce(NOT (p_up BETWEEN 0 AND 1) OR abs(exp_ret) > 0.2, false) AS bad FROM sc)
SELECT ticker, date, CASE WHEN bad THEN 'Hold' ELSE recommendation END AS recommendation, CASE WHEN bad THEN 0 ELSE kelly END AS kelly,
  CASE WHEN bad THEN 'OUT_OF_BOUNDS' ELSE note END AS note FROM b"""))
def _(c):
    return p.repair_bounds(scores(c)).select("ticker", "date", "recommendation", "kelly", "note")


@query("p19_quarantine_substitution", stage="bars", oracle=sql("pred", SCORES + """, q AS (SELECT ticker FROM bars GROUP BY 1 HAVING arg_max(volume, date) < 100),
x AS (SELECT sc.*, q.ticker IS NOT NULL AS q, row_number() OVER (PARTITION BY sc.ticker ORDER BY date DESC) AS rn FROM sc LEFT JOIN q ON sc.ticker = q.ticker)
SELECT ticker, date, CASE WHEN q AND rn = 1 THEN 0.5 ELSE p_up END AS p_up, CASE WHEN q AND rn = 1 THEN 0 ELSE exp_ret END AS exp_ret,
  CASE WHEN q AND rn = 1 THEN 'Hold' ELSE recommendation END AS recommendation, CASE WHEN q AND rn = 1 THEN 'QUARANTINED' ELSE status END AS status
FROM x"""))
def _(c):
    q = c.bars.groupBy("ticker").agg(F.max_by("volume", "date").alias("v")).filter("v < 100")
    return p.neutralise_quarantined(scores(c), q).select("ticker", "date", "p_up", "exp_ret", "recommendation", "status")


