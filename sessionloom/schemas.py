"""Explicit schemas of the tables the operators exchange."""

from pyspark.sql import types as T

_D, _S, _DATE = T.DoubleType(), T.StringType(), T.DateType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


PANEL = _struct(ticker=_S, sector=_S, date=_DATE, open=_D, high=_D, low=_D, close=_D,
                adj_close=_D, volume=_D)
FEATURES = _struct(date=_DATE, ticker=_S, feature=_S, value=_D)
MACRO = _struct(date=_DATE, vix_close=_D, tnx_close=_D, irx=_D, hyg=_D, ief=_D, sphb=_D,
                splv=_D, oil=_D, copper=_D, usd=_D)
HOLDING = _struct(dollars=_D, units=_D, price=_D)
HOLDINGS = T.MapType(_S, HOLDING)
PNL = T.MapType(_S, _D)
LEDGER = _struct(persona=_S, date=_DATE, cash=_D, total_equity=_D, holdings=HOLDINGS,
                 daily_pnl=PNL, intraday_status=_S, engine_version=_S)
WEIGHTS = _struct(etf=_S, ticker=_S, weight=_D)
PREDICTION = T.MapType(_S, _struct(prob=_D, exp_ret=_D, exp_vol=_D))
TICKS = _struct(event_id=T.LongType(), ts=T.TimestampNTZType(), user_id=T.LongType(),
                event_type=_S, value=_D, props=_S)
