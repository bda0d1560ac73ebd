"""J: joins."""

from pyspark.sql import functions as F

from ..functions.scalars import explode_pnl
from ..operators import correlate
from ..operators import joins as j
from ..operators.windows import top_k
from ..sources.tables import PERSONAS
from .registry import query
from .sqltext import sql
from .windows import W


@query("j1_attach_macro", sql("panel macro", "SELECT ticker, p.date, round(close, 6) AS close, vix_close, tnx_close FROM panel p LEFT JOIN macro m ON p.date = m.date"))
def _(c):
    p = c.panel.withColumn("vix_close", F.lit(0.0))
    return j.attach_macro(p, c.macro.select("date", "vix_close", "tnx_close")).select("ticker", "date", "close", "vix_close", "tnx_close")


@query("j2_reattach_means", stage="pred", oracle=sql("pred", """SELECT p.ticker, p.date, round(g.m, 6) + 0 AS group_mean, round(k.m, 6) + 0 AS market_mean FROM pred p
  LEFT JOIN (SELECT sector, date, avg(ret) AS m FROM pred GROUP BY 1, 2) g ON p.sector = g.sector AND p.date = g.date
  LEFT JOIN (SELECT date, avg(ret) AS m FROM pred GROUP BY 1) k ON p.date = k.date"""))
def _(c):
    return j.reattach_means(c.pred, "ret", "sector").select("ticker", "date", "group_mean", "market_mean")


@query("j3_inner_chain", stage="ledger", oracle=sql("ledger", """SELECT a.date, a.total_equity AS neutral, b.total_equity AS dynamic, c.total_equity AS aggressive FROM ledger a
  JOIN ledger b ON a.date = b.date AND b.persona = 'dynamic' JOIN ledger c ON a.date = c.date AND c.persona = 'aggressive' WHERE a.persona = 'neutral'"""))
def _(c):
    return j.inner_chain([c.ledger.filter(F.col("persona") == n).select("date", F.col("total_equity").alias(n))
                          for n in ("neutral", "dynamic", "aggressive")], "date")


_FI = "OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("j4_outer_chain_filled", sql("ledger", ", y AS (SELECT date, " + ", ".join(f"max(total_equity) FILTER (persona = '{p}') AS {p}" for p in PERSONAS.values())
    + " FROM ledger GROUP BY 1) SELECT date, " + ", ".join(f"last_value({p} IGNORE NULLS) {_FI} AS {p}" for p in PERSONAS.values()) + " FROM y"))
def _(c):
    return j.outer_chain_filled(c.ledger, list(PERSONAS.values()))


@query("j5_override_latest", stage="pred", oracle=sql("pred", """, s AS (SELECT ticker, round(avg(p_up), 6) AS v FROM pred WHERE sector <> 'ASIA' GROUP BY 1),
m AS (SELECT ticker, max(date) AS date FROM pred GROUP BY 1)
SELECT p.ticker, p.date, CASE WHEN m.date IS NOT NULL THEN coalesce(s.v, p_up) ELSE p_up END AS p_up FROM pred p
LEFT JOIN m ON p.ticker = m.ticker AND p.date = m.date LEFT JOIN s ON s.ticker = p.ticker"""))
def _(c):
    s = c.pred.filter("sector <> 'ASIA'").groupBy("ticker").agg(F.round(F.avg("p_up"), 6).alias("p_up"))
    return j.override_latest(c.pred.select("ticker", "date", "p_up"), s, "p_up")


@query("j6_semi_active", sql("bars", "SELECT ticker, date, round(close, 6) AS close FROM bars WHERE ticker IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_acctbal > 0)"))
def _(c):
    act = c.table("supplier").filter("s_acctbal > 0").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"))
    return j.only_active(c.bars, act).select("ticker", "date", "close")


@query("j7_anti_orphans", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(c):
    k = c.table("orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return j.not_in(c.table("customer").select("c_custkey", "c_mktsegment"), k, "c_custkey")


@query("j8_as_of", """SELECT e.event_id, e.user_id, p.value AS last_price FROM events e
  ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type <> 'purchase'""")
def _(c):
    e = c.table("events").select("event_id", "user_id", "ts", "event_type", "value")
    quotes = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("qts"), F.col("value").alias("last_price"))
    left = e.filter("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    return j.as_of(left, quotes, "last_price", keys="user_id", left_time="ts", right_time="qts").drop("ts")


@query("j9_exact_else_latest", stage="macro", oracle=sql("bars macro", """SELECT ticker, b.date, coalesce(m.vix_close, (SELECT arg_max(vix_close, date) FROM macro)) AS vix_close
  FROM bars b LEFT JOIN macro m ON b.date = m.date"""))
def _(c):
    return j.exact_else_latest(c.bars.select("ticker", "date"), c.macro, "vix_close")


@query("j10_lookup", sql("panel", "SELECT ticker, date, industry, sector, 'N' || replace(sector, ' ', '_') AS sector_etf FROM panel"))
def _(c):
    etf = c.table("region").select(F.col("r_name").alias("sector"), F.concat(F.lit("N"), F.replace("r_name", F.lit(" "), F.lit("_"))).alias("sector_etf"))
    return j.lookup(c.panel.select("ticker", "date", "industry", "sector"), etf, "sector")


@query("j11_lagged_pairs", sql("pred", f""", x AS (SELECT ticker, date, ret, lag(ret) OVER ({W}) AS l FROM pred)
SELECT a.ticker AS target, b.ticker AS predictor, count(*) AS n, round(corr(a.ret, b.l), 6) + 0 AS corr FROM x a JOIN x b ON a.date = b.date
WHERE a.ret IS NOT NULL AND b.l IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2
QUALIFY row_number() OVER (PARTITION BY a.ticker ORDER BY abs(corr(a.ret, b.l)) DESC, b.ticker) <= 20"""))
def _(c):
    pairs = correlate.lagged_correlation(c.pred.select("ticker", "date", F.col("ret").alias("value")), lag=1, top=20)
    return correlate.strongest(pairs, 20).select("target", "predictor", "n", "corr")


@query("j12_threshold_grid", sql("pred", """, t AS (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7]) AS t)
SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (p_up > t) AS longs, count(*) FILTER (p_up < 1 - CAST(t AS DOUBLE)) AS shorts
FROM pred, t WHERE p_up IS NOT NULL AND ret IS NOT NULL GROUP BY 1"""))
def _(c):
    from ..operators.aggregates import threshold_grid
    return threshold_grid(c.pred, [0.5, 0.55, 0.6, 0.65, 0.7], actual="ret").select("threshold", "longs", "shorts")


@query("j13_combinations", sql("panel", """, g AS (SELECT sector AS target, ticker AS feature, row_number() OVER (PARTITION BY sector ORDER BY sum(volume) DESC, ticker) AS r FROM panel GROUP BY 1, 2),
a AS (SELECT * FROM g WHERE r <= 15), b AS (SELECT target, feature, r FROM g WHERE r BETWEEN 16 AND 30)
SELECT m.target, m.feature AS macro_1, n.feature AS macro_2, x.feature AS micro_1, y.feature AS micro_2 FROM a m JOIN a n ON m.target = n.target AND m.r < n.r
JOIN b x ON x.target = m.target JOIN b y ON y.target = m.target AND x.r < y.r"""))
def _(c):
    g = c.panel.groupBy(F.col("sector").alias("target"), F.col("ticker").alias("feature")).agg(F.sum("volume").alias("v"))
    g = top_k(g, 30, "target", [F.col("v").desc(), F.col("feature")], "rank")
    return j.combine_pairs(g.filter("rank <= 15"), g.filter("rank > 15"))


@query("j14_at_trade_time", stage="ledger", oracle=sql("positions ledger", """SELECT p.persona, p.ticker, p.date, p.pnl, l.total_equity, l.intraday_status FROM positions p
  LEFT JOIN ledger l ON p.persona = l.persona AND p.date = l.date WHERE p.pnl < 0"""))
def _(c):
    trades = explode_pnl(c.ledger).filter("pnl < 0").select("persona", "date", "ticker", "pnl")
    return j.at_trade_time(trades, c.ledger.select("persona", "date", "total_equity", "intraday_status"), ["persona", "date"])


@query("j15_calendar_densify", stage="gappy", oracle=sql("gappy", f""", s AS (SELECT ticker, min(date) AS a, max(date) AS b FROM gappy GROUP BY 1),
g AS (SELECT ticker, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM s)
SELECT g.ticker, g.date, last_value(close IGNORE NULLS) OVER (PARTITION BY g.ticker ORDER BY g.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close
FROM g LEFT JOIN gappy x ON g.ticker = x.ticker AND g.date = x.date WHERE isodow(g.date) < 6"""))
def _(c):
    return j.densify(c.gappy.select("ticker", "date", "close"), per_key_span=True)


@query("j16_compare_maps", stage="ledger", oracle=sql("positions", """, s AS (SELECT date, lead(date) OVER (ORDER BY date) AS next FROM (SELECT DISTINCT date FROM positions)),
a AS (SELECT persona, ticker, units, next AS date FROM positions JOIN s USING (date) WHERE next IS NOT NULL), b AS (SELECT persona, ticker, units, date FROM positions)
SELECT date, persona, ticker, coalesce(a.units, 0) AS old_units, coalesce(b.units, 0) AS new_units FROM a FULL JOIN b USING (date, persona, ticker)"""))
def _(c):
    h = c.ledger.select("persona", "date", F.explode("holdings").alias("ticker", "h")).select("persona", "date", "ticker", "h.units")
    return j.compare_maps(j.moved_to_next_session(h), h, ("date", "persona", "ticker"))


@query("j17_weighted_lookup", sql("weights", """SELECT etf, round(sum(weight * s_acctbal) / sum(weight), 6) AS weighted_score, count(*) AS n FROM weights
  JOIN supplier ON ticker = 'S' || s_suppkey GROUP BY 1"""))
def _(c):
    s = c.table("supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"), F.col("s_acctbal").alias("score"))
    return j.weighted_lookup(c.weights, s)


@query("j18_fold_bands", stage="pred", oracle=sql("pred", """, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM pred)),
b AS (SELECT date, CASE WHEN i < n - (n // 6) * 5 THEN 0 ELSE (i - (n - (n // 6) * 5)) // (n // 6) + 1 END AS blk FROM d), f AS (SELECT unnest([1, 2, 3, 4, 5]) AS fold)
SELECT fold, fold = blk AS is_test, count(*) AS n, min(p.date) AS first_date, max(p.date) AS last_date FROM pred p JOIN b ON p.date = b.date JOIN f ON fold >= blk GROUP BY 1, 2"""))
def _(c):
    return j.fold_rows(c.pred.select("ticker", "date"), 5).groupBy("fold", "is_test").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


