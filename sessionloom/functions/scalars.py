"""Scalar expression builders: numbers, text, arrays, maps, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# ---- numbers ---------------------------------------------------------------

def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def squash(x: Column, gain: float = 100.0) -> Column:
    return sigmoid(gain * x)


def prior_shift(p: Column, gain: float = 4.0) -> Column:
    return (p - 0.5) * gain


def clean_number(x: Column) -> Column:
    """NaN, infinities and nulls become zero."""
    return F.coalesce(F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x), F.lit(0.0))


def dollars_text(x: Column) -> Column:
    return F.concat(F.when(x < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(x), 2))


def percent_text(x: Column, places: int = 1) -> Column:
    return F.concat(F.format_number(x, places), F.lit("%"))


# ---- text ------------------------------------------------------------------

def feature_ticker(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"^(.*)_Lag(\d+)$", 1), F.lit(""))


def feature_lag(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"^(.*)_Lag(\d+)$", 2), F.lit("")).cast("int")


# ---- maps and JSON ---------------------------------------------------------

def map_total(m: Column) -> Column:
    return F.aggregate(F.map_values(m), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))


def holdings_total(h: Column) -> Column:
    return F.aggregate(F.map_values(h), F.lit(0.0), lambda a, v: a + F.coalesce(v["dollars"], F.lit(0.0)))


def tolerant_map(text: Column, value_type: str = "double") -> Column:
    """JSON or Python-literal text -> map; anything else is an empty map."""
    kind = f"map<string,{value_type}>"
    fixed = F.regexp_replace(F.regexp_replace(text, "'", '"'), r"\bNone\b", "null")
    return F.coalesce(F.from_json(text, kind), F.from_json(fixed, kind),
                      F.from_json(F.lit("{}"), kind))


def mixed_holdings(text: Column) -> Column:
    """Map text whose values are objects or bare numbers -> map of (dollars, units, price)."""
    raw = F.coalesce(F.from_json(text, "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))

    def value(_, v):
        obj = v.startswith("{")
        return F.struct(
            F.when(obj, F.get_json_object(v, "$.dollars").try_cast("double")).otherwise(v.try_cast("double")).alias("dollars"),
            F.coalesce(F.get_json_object(v, "$.units").try_cast("double"), F.lit(0.0)).alias("units"),
            F.coalesce(F.get_json_object(v, "$.price").try_cast("double"), F.lit(0.0)).alias("price"))

    return F.transform_values(raw, value)


def explode_pnl(ledger: DataFrame) -> DataFrame:
    """Ledger rows with one row per ticker of the PnL map."""
    return ledger.select(*[c for c in ledger.columns if c != "daily_pnl"],
                         F.explode("daily_pnl").alias("ticker", "pnl"))


def explode_holdings(ledger: DataFrame) -> DataFrame:
    return ledger.select(*[c for c in ledger.columns if c != "holdings"],
                         F.explode("holdings").alias("ticker", "_h")).select("*", "_h.*").drop("_h")


def flatten_lists(m: Column) -> Column:
    """Distinct members of the lists held by a map."""
    return F.array_distinct(F.flatten(F.map_values(m)))
