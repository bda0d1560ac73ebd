"""Settlement, retention, execution merge and balance enforcement, all in long form.

One row is one (persona, date, ticker); maps are only built at the ledger edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import cols
from .joins import as_of
from .sizing import stop_level
from .windows import first_of_runs


def settled_return(entry: Column, close: Column, low: Column, stop: Column) -> Column:
    """Close over entry, replaced by the stop when the low reaches it; nothing known gives 0."""
    ret = F.when(entry > 0, F.try_divide(close - entry, entry))
    drop = F.when(entry > 0, F.try_divide(low - entry, entry))
    return F.coalesce(F.when(drop <= stop, stop).otherwise(ret), F.lit(0.0))


def settle(positions: DataFrame, prices: DataFrame, fear: DataFrame, fixed_stop: float | None = None) -> DataFrame:
    """Positions (persona, date, ticker, dollars, price) valued on that date's close and low."""
    p = prices.select("ticker", "date", "close", "low")
    d = positions.join(p, ["ticker", "date"], "left").join(fear.select("date", "vix_close"), "date", "left")
    stop = F.lit(fixed_stop) if fixed_stop is not None else stop_level(F.col("persona"), F.col("vix_close"))
    d = d.withColumn("ret", settled_return(F.col("price"), F.col("close"), F.col("low"), stop))
    return d.withColumn("pnl", F.col("dollars") * F.col("ret"))


def settle_missing(positions: DataFrame, priced: DataFrame, prices: DataFrame) -> DataFrame:
    """Positions whose ticker is not in ``priced``: last known close, otherwise cost."""
    lost = positions.join(priced.select("ticker").distinct(), "ticker", "left_anti")
    px = prices.select("ticker", F.col("date").alias("price_date"), "close")
    d = as_of(lost, px, "close", left_time="date", right_time="price_date", out="last_close")
    ret = F.when(F.col("price") > 0, F.try_divide(F.col("last_close") - F.col("price"), F.col("price")))
    return d.withColumn("pnl", F.coalesce(F.col("dollars") * ret, F.lit(0.0))).withColumn(
        "resolution", F.when(ret.isNotNull(), "RECOVERED").otherwise("AT_COST"))


def retained(positions: DataFrame, frozen: DataFrame, on=("persona", "ticker")) -> DataFrame:
    """Held positions that must not trade, at their current value."""
    return positions.filter("dollars > 0").join(frozen.select(*cols(on)).distinct(), cols(on), "left_semi").withColumn(
        "value", F.col("dollars") + F.coalesce(F.col("pnl"), F.lit(0.0)))


def target_state(positions: DataFrame, keys=("persona", "date")) -> DataFrame:
    """Rounded holdings map and held total per key; entries are the key's own positions."""
    k = cols(keys)
    h = F.struct(F.round("dollars", 2).alias("dollars"), F.round("units", 2).alias("units"), F.round("price", 2).alias("price"))
    return positions.groupBy(*k).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("ticker", h.alias("h"))))).alias("target_holdings"),
        F.round(F.sum("dollars"), 2).alias("held"))


def enforce_balance(ledger: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Cash is corrected when cash plus holdings is off the stated equity."""
    from ..functions.scalars import holdings_total
    held = holdings_total(F.col("holdings"))
    off = F.abs(F.col("cash") + held - F.col("total_equity")) > tolerance
    return ledger.withColumns({"corrected": off, "cash": F.when(off, F.col("total_equity") - held).otherwise(F.col("cash"))})


def merge_executions(target: DataFrame, current: DataFrame, fills: DataFrame, pnl: DataFrame, keys=("persona",)) -> DataFrame:
    """Per (keys, ticker): final holding, cash movement and PnL after the day's fills.

    ``target``/``current``: keys, ticker, dollars, units, price. ``fills``: keys,
    ticker, type (BUY, SELL, ABORTED_SELL), fill_price, cash_reversed. With the
    date among the keys all sessions are settled at once.
    """
    on = [*cols(keys), "ticker"]

    def side(df, tag):
        return df.select(*on, *[F.col(c).alias(f"{tag}_{c}") for c in ("dollars", "units", "price")], F.lit(True).alias(f"in_{tag}"))

    d = (side(target, "t").join(side(current, "c"), on, "full_outer").join(fills, on, "left")
         .join(pnl.select(*on, F.col("pnl").alias("_pnl")), on, "left"))
    t, c = F.coalesce("in_t", F.lit(False)), F.coalesce("in_c", F.lit(False))
    kind, px = F.coalesce("type", F.lit("NONE")), F.col("fill_price")
    day = F.coalesce("_pnl", F.lit(0.0))
    paid = F.col("t_units") * F.col("t_price")
    got_units = F.floor(F.try_divide(paid, px))
    cost = F.col("c_units") * F.col("c_price")
    credited = cost + day
    kept_back = F.coalesce("cash_reversed", F.lit(False))
    buy, unfilled = (kind == "BUY") & t, (kind == "NONE") & t & ~c
    sell_old, sell_live = (kind == "SELL") & ~t & c, (kind == "SELL") & t
    back = (kind == "ABORTED_SELL") & c
    cash = (F.when(buy, paid - got_units * px).when(unfilled, F.col("t_dollars"))
            .when(sell_old, F.col("c_units") * px - credited).when(sell_live, F.col("t_units") * px)
            .when(back & ~kept_back, -credited).otherwise(0.0))
    held = F.when(buy, True).when(unfilled | sell_old | sell_live, False).when(back, True).otherwise(t)
    dollars = (F.when(buy, got_units * px).when(back & ~kept_back, credited).when(back, F.col("c_dollars")).otherwise(F.col("t_dollars")))
    units = F.when(buy, got_units.cast("double")).when(back, F.col("c_units")).otherwise(F.col("t_units"))
    price = (F.when(buy, px).when(back & ~kept_back, F.coalesce(F.try_divide(credited, F.col("c_units")), F.lit(0.0)))
             .when(back, F.col("c_price")).otherwise(F.col("t_price")))
    new_pnl = (F.when(sell_old, F.col("c_units") * px - cost)
               .when(sell_live, day + F.col("t_units") * px - F.col("t_dollars")).otherwise(F.col("_pnl")))
    return d.select(*on, kind.alias("type"), held.alias("held"), F.when(held, dollars).alias("dollars"),
                    F.when(held, units).alias("units"), F.when(held, price).alias("price"),
                    cash.alias("cash_move"), new_pnl.alias("pnl"))


# Status texts that readers of the ledger look for.
HELD_ALL, EXECUTED = "EOD Forced HOLD", "Tracker Executed: "
STATUS_WORDS = {"BUY": "BUY", "SELL": "TP/SL", "ABORTED_SELL": "ABORTED SELL"}


def executed_ledger(merged: DataFrame, orders: DataFrame, keys=("persona",)) -> DataFrame:
    """Cash, equity and status line per key from merged rows and target cash."""
    k = cols(keys)
    g = merged.groupBy(*k).agg(
        F.sum("cash_move").alias("_m"), F.coalesce(F.sum("dollars"), F.lit(0.0)).alias("held"),
        *[F.bool_or(F.col("type") == k).alias(f"_{k}") for k in ("BUY", "SELL", "ABORTED_SELL")])
    words = F.filter(F.array(F.when(F.col("_BUY"), STATUS_WORDS["BUY"]), F.when(F.col("_SELL"), STATUS_WORDS["SELL"]),
                             F.when(F.col("_ABORTED_SELL"), STATUS_WORDS["ABORTED_SELL"])), lambda x: x.isNotNull())
    status = F.when(F.size(words) == 0, HELD_ALL).otherwise(
        F.concat(F.lit(EXECUTED), F.array_join(words, " & ")))
    d = orders.join(g, k).withColumn("cash", F.col("target_cash") + F.col("_m"))
    return d.select(*k, F.round("cash", 2).alias("cash"), F.round(F.col("cash") + F.col("held"), 2).alias("total_equity"),
                    status.alias("intraday_status"))


def lost_cash(positions: DataFrame, keys=("persona", "ticker"), date="date") -> DataFrame:
    """Dollars held with zero units: counted on the first session of each such run."""
    bug = (F.col("units") == 0) & (F.col("dollars") > 0)
    return first_of_runs(positions, bug, keys, date)


def refund(ledger: DataFrame, lost: DataFrame) -> DataFrame:
    """Adds each persona's lost cash to its newest ledger row."""
    total = lost.groupBy("persona").agg(F.sum("dollars").alias("_refund"))
    newest = ledger.groupBy("persona").agg(F.max("date").alias("date")).join(total, "persona")
    d = ledger.join(newest, ["persona", "date"], "left")
    add = F.coalesce("_refund", F.lit(0.0))
    return d.withColumns({"cash": F.round(F.col("cash") + add, 2), "total_equity": F.round(F.col("total_equity") + add, 2)}).drop("_refund")


