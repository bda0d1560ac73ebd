"""Q: data-quality checks."""

from pyspark.sql import functions as F

from ..operators import cleaning, observed, quality as q
from ..operators import sizing, windows
from .cleaning import SCORES, scores
from ..session import scratch_path
from ..sources.tables import PERSONAS
from .registry import query
from .sqltext import sql
from .windows import W


def v(check: str, key: str, detail: str, rest: str) -> str:
    return f"SELECT '{check}' AS \"check\", {key} AS \"key\", CAST({detail} AS VARCHAR) AS detail {rest}"


PD = "persona || '|' || date"
TD = "ticker || '|' || date"


@query("q1_balance", sql("ledger", v("balance", PD, "format('{:.2f}', round(cash + held - total_equity, 2) + 0)", "FROM ledger WHERE abs(cash + held - total_equity) > 0.05") + " UNION ALL "
                         + v("zero_equity", PD, "format('{:.2f}', total_equity)", "FROM ledger WHERE total_equity < 0.05")))
def _(c):
    return q.balance(c.ledger)


@query("q1_observed_audit", sql("ledger", f""", g AS (SELECT *, date - lag(date) OVER (PARTITION BY persona ORDER BY date) AS gd FROM (SELECT persona, date, CASE WHEN month(date) <> 9 THEN cash END AS cash, held, total_equity, intraday_status FROM ledger WHERE month(date) <> 2)),
f AS (SELECT count(*) AS "rows", count(*) FILTER (abs(cash + held - total_equity) > 0.05) AS unbalanced, count(*) FILTER (total_equity < 0.05) AS zero_equity, count(*) FILTER (cash IS NULL) AS null_cash,
  count(*) FILTER (total_equity IS NULL) AS null_equity, count(*) FILTER (gd > 31) AS gaps, count(*) FILTER (intraday_status = 'CARRYOVER') AS carried FROM g)
UNPIVOT f ON "rows", unbalanced, zero_equity, null_cash, null_equity, gaps, carried INTO NAME figure VALUE n"""))
def _(c):
    led = c.ledger.filter(F.month("date") != 2).withColumn("cash", F.when(F.month("date") != 9, F.col("cash")))
    seen = observed.write_observed(observed.gap_days(led, "persona"), scratch_path(c.spark, "audited"), observed.ledger_figures(), drop=["gap_days"])
    return c.spark.range(1).select(F.explode(F.map_from_arrays(F.array(*map(F.lit, seen)), F.array(*[F.lit(n) for n in seen.values()]))).alias("figure", "n"))


@query("q2_missing_sessions", stage="gappy", oracle=sql("gappy", """, s AS (SELECT ticker, min(date) AS a, max(date) AS b FROM gappy GROUP BY 1), g AS (SELECT ticker, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM s)
""" + v("missing_session", "g.ticker", "g.date", "FROM g WHERE isodow(date) < 6 AND date <> DATE '2024-01-15' AND NOT EXISTS (SELECT 1 FROM gappy x WHERE x.ticker = g.ticker AND x.date = g.date)")))
def _(c):
    return q.missing_sessions(c.gappy, "ticker", holidays=["2024-01-15"])


@query("q3_gaps_and_nulls", stage="gappy", oracle=sql("gappy", f""", n AS (SELECT ticker, date, CASE WHEN day(date) <> 9 THEN close END AS close, CASE WHEN ticker > 'U5' THEN volume ELSE NULL END AS volume FROM gappy),
g AS (SELECT ticker, date, date - lag(date) OVER ({W}) AS gd FROM n)
""" + v("gap", TD, "gd", "FROM g WHERE gd > 2") + " UNION ALL " + v("nulls", "ticker || '|close'", "count(*)", "FROM n WHERE close IS NULL GROUP BY ticker") + " UNION ALL "
                               + v("nulls", "ticker || '|volume'", "count(*)", "FROM n WHERE volume IS NULL GROUP BY ticker")))
def _(c):
    d = c.gappy.select("ticker", "date", F.when(F.day("date") != 9, F.col("close")).alias("close"), F.when(F.col("ticker") > "U5", F.col("volume")).alias("volume"))
    return q.gaps_and_nulls(d, ["close", "volume"], "ticker", max_days=2)


@query("q4_lagging", stage="gappy", oracle=sql("gappy", """, l AS (SELECT ticker, max(date) AS l FROM gappy WHERE ticker > 'U3' GROUP BY 1)
""" + v("lagging", "ticker", "l", "FROM l WHERE l < (SELECT max(l) FROM l)")))
def _(c):
    return q.lagging(c.gappy, c.gappy.filter("ticker > 'U3'").select("ticker"))


@query("q5_orphan_holdings", sql("positions", v("orphan", "persona", "ticker", "FROM (SELECT DISTINCT persona, ticker FROM positions WHERE ticker NOT IN (SELECT c_mktsegment FROM customer WHERE c_mktsegment < 'H'))")))
def _(c):
    return q.orphans(c.positions, c.table("customer").filter("c_mktsegment < 'H'").select(F.col("c_mktsegment").alias("ticker")))


@query("q6_flatlined", sql("bars", """, x AS (SELECT ticker, CASE WHEN ticker LIKE 'S1%' THEN 7 ELSE close END AS c, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM bars)
""" + v("flatline", "ticker", "count(*)", "FROM x WHERE n <= 15 GROUP BY ticker HAVING count(*) = 15 AND count(DISTINCT c) <= 1")))
def _(c):
    return q.flatlined(c.bars.withColumn("close", F.when(F.col("ticker").startswith("S1"), 7.0).otherwise(F.col("close"))))


@query("q7_return_mismatch", sql("pred", f""", x AS (SELECT ticker, abs(100 * (close / lag(close) OVER ({W}) - 1) - (100 * ret + CASE WHEN month(date) = 5 AND ticker > 'S5' THEN 0.02 ELSE 0 END)) AS d FROM pred)
""" + v("return_mismatch", "ticker", "format('{:.4f}', round(max(d), 4))", "FROM x GROUP BY ticker HAVING max(d) > 0.01")))
def _(c):
    d = c.pred.withColumn("ret", 100 * F.col("ret") + F.when((F.month("date") == 5) & (F.col("ticker") > "S5"), 0.02).otherwise(0.0))
    return q.return_mismatch(d)


@query("q8_bounds", sql("pred", SCORES + v("probability_bounds", TD, "format('{:.2f}', p_up)", "FROM sc WHERE p_up < 0 OR p_up > 1") + " UNION ALL "
                       + v("return_bounds", TD, "format('{:.6f}', exp_ret)", "FROM sc WHERE abs(exp_ret) > 0.2")))
def _(c):
    return q.bounds(scores(c))


@query("q9_paradoxes", sql("pred", SCORES + v("paradox", TD, "format('{:.6f}', exp_ret)", "FROM sc WHERE p_up <> 0.5 AND p_up > 0.6 AND exp_ret < -0.01") + " UNION ALL "
                          + v("zero_volatility", TD, "format('{:.6f}', exp_vol)", "FROM sc WHERE p_up <> 0.5 AND exp_vol <= 0")))
def _(c):
    return q.paradoxes(scores(c))


@query("q10_dummy_scorecards", stage="pred", oracle=sql("pred", """, sc AS (SELECT ticker, CASE WHEN ticker LIKE 'S2%' THEN 0.5 ELSE p_up END AS p, CASE WHEN ticker LIKE 'S3%' THEN 0 ELSE exp_ret END AS e, CASE WHEN ticker LIKE 'S4%' AND month(date) = 1 THEN 'QUARANTINED' ELSE 'Stable' END AS s,
  ticker LIKE 'S5%' AS short, date = max(date) OVER (PARTITION BY ticker) AS tip FROM pred), k AS (SELECT * FROM sc WHERE NOT short OR tip)
""" + v("all_half", "ticker", "count(*)", "FROM k GROUP BY ticker HAVING bool_and(p = 0.5)") + " UNION ALL " + v("all_zero_return", "ticker", "count(*)", "FROM k GROUP BY ticker HAVING bool_and(e = 0)")
                                + " UNION ALL " + v("quarantined", "ticker", "count(*)", "FROM k WHERE s LIKE 'QUARANTIN%' GROUP BY ticker") + " UNION ALL " + v("too_few_rows", "ticker", "count(*)", "FROM k GROUP BY ticker HAVING count(*) < 2")))
def _(c):
    t = F.col("ticker")
    p = c.pred
    newest = p.groupBy("ticker").agg(F.max("date").alias("date"))
    d = p.filter(~t.startswith("S5")).unionByName(p.filter(t.startswith("S5")).join(newest, ["ticker", "date"], "left_semi"))
    return q.dummy_scorecards(d.select(
        "ticker", F.when(t.startswith("S2"), 0.5).otherwise(F.col("p_up")).alias("p_up"), F.when(t.startswith("S3"), 0.0).otherwise(F.col("exp_ret")).alias("exp_ret"),
        F.when(t.startswith("S4") & (F.month("date") == 1), "QUARANTINED").otherwise("Stable").alias("status")))


@query("q11_pending_wipeout", sql("pred", """, n AS (SELECT ticker, count(*) FILTER (ret IS NULL OR ticker LIKE 'S7%') AS n FROM pred GROUP BY 1) """ + v("pending_wipeout", "ticker", "n", "FROM n WHERE n >= 15")))
def _(c):
    actual = F.when(~F.col("ticker").startswith("S7"), F.col("ret"))
    d = c.pred.select("ticker", sizing.hit_label(sizing.recommendation("p_up"), actual).alias("hit"))
    return q.pending_wipeout(d)


@query("q12_holdings_without_scores", stage="positions", oracle=sql("positions", v("no_score", "persona", "ticker", "FROM (SELECT DISTINCT persona, ticker FROM positions WHERE date = (SELECT max(date) FROM positions) AND ticker NOT IN (SELECT c_mktsegment FROM customer WHERE c_mktsegment > 'M'))")))
def _(c):
    held = c.positions.filter(F.col("date") == c.positions.agg(F.max("date")).scalar())
    return q.orphans(held, c.table("customer").filter("c_mktsegment > 'M'").select(F.col("c_mktsegment").alias("ticker")), "no_score")


@query("q13_stale_personas", sql("ledger", """, w AS (SELECT DISTINCT persona FROM ledger UNION ALL SELECT 'etf_dynamic'), l AS (SELECT persona, max(date) AS l FROM ledger GROUP BY 1)
""" + v("stale_persona", "w.persona", "coalesce(CAST(l AS VARCHAR), 'MISSING')", "FROM w LEFT JOIN l ON w.persona = l.persona WHERE l IS NULL OR l < DATE '2001-08-01'")))
def _(c):
    return q.stale_personas(c.ledger, "2001-08-01", [*PERSONAS.values(), "etf_dynamic"])


@query("q14_freshness", sql("bars", v("stale_table", "'bars'", "max(date)", "FROM bars HAVING max(date) < DATE '2030-01-01'")))
def _(c):
    return q.freshness(c.bars, "2030-01-01", name="bars")


@query("q15_schema_risk", """SELECT 'truncation' AS "check", 'o_totalprice' AS "key", 'double into bigint: ' || count(*) FILTER (o_totalprice <> floor(o_totalprice)) AS detail FROM orders
UNION ALL SELECT 'type_mismatch', 'o_orderpriority', 'string into double: ' || count(*) FILTER (TRY_CAST(o_orderpriority AS DOUBLE) IS NULL) FROM orders""")
def _(c):
    o = c.table("orders")
    stored = o.select("o_orderkey", F.col("o_totalprice").cast("bigint").alias("o_totalprice"), F.lit(0.0).alias("o_orderpriority"), "o_orderstatus")
    return q.schema_check(o, stored)


@query("q16_future_row", stage="gappy", oracle=sql("gappy", v("duplicate_date", TD, "2", "FROM gappy WHERE ticker = 'U7' AND day(date) < 4") + " UNION ALL " + v("future_row", "ticker", "max(date)", "FROM gappy WHERE ticker LIKE 'U2%' GROUP BY ticker")))
def _(c):
    g = c.gappy.select("ticker", "date", "close")
    ok = cleaning.with_future_row(g.filter("ticker not like 'U2%'"))
    return q.future_row(ok.unionByName(g.filter("ticker like 'U2%'")).unionByName(g.filter("ticker = 'U7' and day(date) < 4")), "close")


@query("q17_split_alignment", sql("gappy", """, n AS (SELECT ticker, count(*) AS n FROM gappy GROUP BY 1) """ + v("split_length", "ticker", "least(n, 27)", "FROM n WHERE least(n, 27) <> 27")))
def _(c):
    d = windows.chronological_split(c.gappy, test_rows=27)
    return q.split_alignment(d, "is_train", 27)


@query("q18_scaling_leak", stage="bars", oracle=sql("pred", v("scaling_leak", "ticker", "'train statistics differ'", "FROM pred WHERE ticker LIKE 'S9%' GROUP BY ticker")))
def _(c):
    d = windows.chronological_split(c.bars, train_share=0.8)
    good = windows.standardise_on_train(d.filter("ticker not like 'S9%'"), "close", "is_train", keys="ticker")
    leak = windows.standardise_on_train(d.filter("ticker like 'S9%'").withColumn("every", F.lit(True)), "close", "every", keys="ticker").drop("every")
    return q.scaling_leak(good.unionByName(leak), "close_z", "is_train")


@query("q19_series_age", sql("gappy", """, g AS (SELECT ticker, min(date) AS a, max(date) AS b FROM gappy GROUP BY 1) """ + v("stale_series", "ticker", "DATE '2024-02-03' - b", "FROM g WHERE DATE '2024-02-03' - b > 4")
                             + " UNION ALL " + v("late_start", "ticker", "a", "FROM g WHERE a > DATE '2024-01-01'")))
def _(c):
    return q.series_age(c.gappy, "2024-02-03", "2024-01-01", "ticker")


