"""Entry and exit gates shared by the batch and streaming paths: pure column rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# VWAP multipliers, leveraged funds, exit rules.
ENTRY_MULTIPLIER = {"conservative": 1.01, "neutral": 1.005, "aggressive": 1.0025}
LEVERAGED = ("UDOW", "MSTZ", "UPRO", "TQQQ", "SOXL", "SPXL", "TECL", "FAS", "LABU")
# style -> (threshold %, liquidation volatility, scalar when volatility >= 20)
STOCK_EXIT = {"conservative": (5.0, 25.0, 0.4), "neutral": (10.0, 30.0, 1.5), "aggressive": (20.0, 45.0, 1.0)}
ETF_EXIT = {"conservative": (2.0, 25.0, 0.4), "neutral": (4.0, 30.0, 1.5), "aggressive": (8.0, 45.0, 1.0)}


def _style(persona: Column) -> Column:
    s = F.regexp_replace(persona, "^etf_", "")
    return F.when(s.isin("conservative", "aggressive"), s).otherwise("neutral")


def _pick(persona: Column, table: dict, i: int | None = None) -> Column:
    s = _style(persona)

    def v(k):
        return F.lit(table[k] if i is None else table[k][i])

    return F.when(s == "conservative", v("conservative")).when(s == "aggressive", v("aggressive")).otherwise(v("neutral"))


def entry_threshold(persona: Column, vwap: Column, vix: Column, witching: Column) -> Column:
    widen = F.when((vix >= 20) | F.coalesce(witching, F.lit(False)), 0.015).otherwise(0.0)
    return vwap * (_pick(persona, ENTRY_MULTIPLIER) + widen)


def entry_gate(persona, live, prev_close, vwap, vix, witching, live_volume, expected_volume) -> Column:
    """BUY when price momentum and pro-rata volume both pass; says what blocked it otherwise.

    Any unknown among price, previous close, VWAP and the volumes is NO_DATA:
    money moves only on what is known. An unknown volatility does not widen.
    """
    known = prev_close.isNotNull() & live.isNotNull() & vwap.isNotNull() & live_volume.isNotNull() & expected_volume.isNotNull()
    momentum = (live > prev_close) & (live > entry_threshold(persona, vwap, vix, witching))
    return (F.when(~known, "NO_DATA").when(~momentum, "WAIT")
            .when(live_volume < expected_volume * 0.5, "LOW_VOLUME").otherwise("BUY"))


def sell_shield(persona, live, prev_close, vwap) -> Column:
    """A pending sell is dropped when price momentum turned up."""
    up = (live > prev_close) & (live > vwap * _pick(persona, ENTRY_MULTIPLIER))
    return F.when(prev_close.isNull() | live.isNull() | up, "ABORTED_SELL").otherwise("SELL")


def exit_gate(persona, ticker, live, prev_close, vix) -> Column:
    """PANIC, TAKE_PROFIT, STOP or HOLD by persona, asset class, leverage and volatility."""
    etf = persona.startswith("etf_")
    lev = F.when(etf & ticker.isin(*LEVERAGED), 2.5).otherwise(1.0)

    def rule(i):
        return F.when(etf, _pick(persona, ETF_EXIT, i)).otherwise(_pick(persona, STOCK_EXIT, i))

    level = rule(0) * lev
    stop = -level * F.when(vix >= 20, rule(2)).otherwise(1.0)
    surge = 100 * F.try_divide(live - prev_close, prev_close)
    return (F.when(surge.isNull(), "NO_DATA").when(vix >= rule(1), "PANIC").when(surge >= level, "TAKE_PROFIT")
            .when(surge <= stop, "STOP").otherwise("HOLD"))
