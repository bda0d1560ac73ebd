"""One-session-hold backtest and strategy comparison, without a loop over dates.

Every position is closed at the next session, so equity is multiplicative:
E_t = E_{t-1} * (1 + sum(a_i * r_i)). The cash limit inside a session equals a
capped running sum of the stakes in priority order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import UNB, by, cols, last_per, ranged_running
from .settle import settled_return
from .sizing import kelly, stop_level
from .windows import growth


def backtest_positions(scores: DataFrame, cap: float = 0.20, persona: str = "aggressive", keys=("date",),
                       fixed_stop: float | None = None) -> DataFrame:
    """Bought rows with stake share and next-session return.

    ``scores``: ticker, date, close, low, p_up, exp_ret, exp_vol, vix_next.
    """
    w = by()
    d = scores.withColumns({"next_close": F.lead("close").over(w), "next_low": F.lead("low").over(w)})
    d = d.filter("p_up > 0.5 and exp_ret > 0 and close > 0 and next_close is not null")
    vol = F.when(F.col("exp_vol") > 0, F.col("exp_vol")).otherwise(0.01)
    pct = F.least(kelly(F.col("p_up"), F.col("exp_ret"), vol, "backtest"), F.lit(cap))
    stop = F.lit(fixed_stop) if fixed_stop is not None else stop_level(F.lit(persona), F.col("vix_next"))
    d = d.withColumns({"pct": pct, "ret": settled_return(F.col("close"), F.col("next_close"), F.col("next_low"), stop)})
    run = ranged_running(d.filter("pct > 0"), keys, [F.col("p_up").desc(), F.col("ticker")], {"_cum": F.col("pct")})
    room = F.greatest(F.lit(0.0), 1 - (F.col("_cum") - F.col("pct")))
    return run.withColumn("share", F.least(F.col("pct"), room)).drop("_cum")


def equity_curve(positions: DataFrame, sessions: DataFrame, start: float = 10000.0) -> DataFrame:
    """Equity after each session's positions have been settled."""
    day = positions.groupBy("date").agg(F.sum(F.col("share") * F.col("ret")).alias("ret"), F.count_if(F.col("share") > 0).alias("held"))
    d = sessions.select("date").distinct().join(day, "date", "left").na.fill(0.0, ["ret"]).na.fill(0, ["held"])
    o = Window.orderBy("date").rowsBetween(UNB, 0)  # one row per session
    return d.withColumn("equity", start * growth(F.col("ret"), o))


def strategy_race(existing: DataFrame, curves: dict[str, DataFrame], date="date") -> DataFrame:
    """Join the curves on date, append to the stored table, keep the newest row per date."""
    fresh = None
    for name, c in curves.items():
        part = c.select(date, F.col("equity").alias(name))
        fresh = part if fresh is None else fresh.join(part, date)
    both = existing.withColumn("_v", F.lit(0)).unionByName(fresh.withColumn("_v", F.lit(1)))
    return last_per(both, date, "_v").drop("_v")


def compounding_curves(returns: DataFrame, name="strategy", start: float = 10000.0) -> DataFrame:
    return returns.withColumn("equity", F.round(
        start * growth(F.coalesce(F.col("ret"), F.lit(0.0)), by(name).rowsBetween(UNB, 0)), 2))


def pnl_race(ledger: DataFrame, ticker: str, days: int = 35) -> DataFrame:
    """Cumulative PnL of one ticker per persona over the last days of the ledger."""
    end = ledger.agg(F.max("date")).scalar()
    d = ledger.filter(F.col("date") >= F.date_sub(end, days))
    v = F.coalesce(F.try_element_at("daily_pnl", F.lit(ticker)), F.lit(0.0))
    return d.select("persona", "date", F.sum(v).over(by("persona").rowsBetween(UNB, 0)).alias("cum_pnl"))


def expected_sharpe(ret: Column, vol: Column) -> Column:
    return F.coalesce(F.try_divide(ret, vol), F.lit(0.0))


def prediction_history(scores: DataFrame, keys=("ticker",)) -> DataFrame:
    return scores.filter("exp_ret is not null and actual_ret is not null").select(
        *cols(keys), "date", "exp_ret", "actual_ret", expected_sharpe(F.col("exp_ret"), F.col("exp_vol")).alias("expected_sharpe"))
