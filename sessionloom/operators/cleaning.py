"""Deduplication, coercion, filling and row selection."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import END, UNB, by, cols, first_per, last_per

# Categorical codes.
RAS_CODES = {"BUY": 1, "HOLD": 0, "SELL": -1}
FEAR_CODES = {"Complacency / Calm": 0, "High Volatility": 1}
REGIME_CODES = {"BULL_REGIME": 1, "BEAR_REGIME": -1}
ANALYST_CODES = {"Strong Buy": 2, "Buy": 1, "Hold": 0, "Sell": -1, "Strong Sell": -2}
INTERCEPT_CODES = {"Trend_Reversal_BUY": 1, "Trend_Reversal_SELL": -1}
# Fixed value: features that never enter a predictor set.
EXCLUDED_FEATURES = "(?i)SEC_REG|SEC_MOM|VIX|Market_Fear|macro"


def dedup(df: DataFrame, keys=("ticker", "date"), order=("seq",), keep: str = "first") -> DataFrame:
    """One row per key by an explicit order; copies combine before the shuffle."""
    return (first_per if keep == "first" else last_per)(df, keys, order)


def encode(c: str | Column, codes: Mapping[str, int], default: int = 0) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    table = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), F.lit(default))


def dash_symbol(c: Column) -> Column:
    return F.replace(F.trim(c), F.lit("."), F.lit("-"))


def dot_symbol(c: Column) -> Column:
    return F.replace(F.trim(c), F.lit("-"), F.lit("."))


def sector_label(c: Column) -> Column:
    return F.replace(F.trim(c), F.lit(" "), F.lit("_"))


def to_number(c: Column) -> Column:
    """Number or null; infinities and NaN count as missing."""
    return finite(F.trim(c).try_cast("double"))


def finite(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def local_date(c: Column, zone: str) -> Column:
    """UTC instant -> calendar date in ``zone``."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), c))


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    return df.withColumn(target, finite(F.col(target))).filter(F.col(target).isNotNull())


def fill_forward_back(df: DataFrame, values, keys=("ticker",), order="date") -> DataFrame:
    w = by(keys, order)
    fwd, back = w.rowsBetween(UNB, 0), w.rowsBetween(0, END)
    return df.withColumns({
        v: F.coalesce(F.last(v, True).over(fwd), F.first(v, True).over(back)) for v in cols(values)})


def min_history(df: DataFrame, n: int, keys=("ticker",)) -> DataFrame:
    """Keep keys with at least ``n`` rows (counted by aggregation, then semi join)."""
    enough = df.groupBy(*cols(keys)).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n)
    return df.join(enough, cols(keys), "left_semi")


def between_dates(df: DataFrame, start=None, end=None, date="date") -> DataFrame:
    if start is not None:
        df = df.filter(F.col(date) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col(date) <= F.lit(end).cast("date"))
    return df


def exclude_features(df: DataFrame, pattern: str = EXCLUDED_FEATURES, feature="feature") -> DataFrame:
    return df.filter(~F.col(feature).rlike(pattern))


def drop_empty_features(df: DataFrame, feature="feature", value="value") -> DataFrame:
    alive = df.filter(F.col(value).isNotNull()).select(feature).distinct()
    return df.join(alive, feature, "left_semi")


def tail(df: DataFrame, n: int, keys=("ticker",), order="date") -> DataFrame:
    """Last ``n`` rows of each key; Spark prunes to ``n`` per key before the shuffle."""
    k = cols(keys)
    w = by(k, []).orderBy(*[F.col(o).desc() for o in cols(order)])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def head(df: DataFrame, n: int, keys=("ticker",), order="date") -> DataFrame:
    w = by(keys, order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def fear_level(vix: Column) -> Column:
    return (F.when(vix >= 30, "Extreme Panic").when(vix >= 20, "High Volatility")
            .when(vix.isNotNull(), "Complacency / Calm"))


def display(df: DataFrame) -> DataFrame:
    """Text rendering chosen by column name: equity and dollars, percent, dates, flags."""
    out = []
    for name, kind in df.dtypes:
        c, low = F.col(name), name.lower()
        if kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind == "boolean":
            c = F.when(c, "☑").otherwise("☐")
        elif kind in ("double", "float") and ("pct" in low or "rate" in low):
            c = F.concat(F.format_number(c, 1), F.lit("%"))
        elif kind in ("double", "float") and any(t in low for t in ("equity", "cash", "dollars", "pnl")):
            c = F.concat(F.when(c < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(c), 2))
        out.append(c.alias(name))
    return df.select(*out)


def with_future_row(df: DataFrame, date="date", keys=("ticker",), known=()) -> DataFrame:
    """Append one row per key dated the next business day; only ``known`` columns carry over."""
    from ..functions.dates import next_business_day
    k = cols(keys)
    kept = [c for c in known]
    tip = df.groupBy(*k).agg(F.max(date).alias("_d"), *[F.max_by(c, date).alias(c) for c in kept])
    nxt = tip.select(*k, next_business_day(F.col("_d")).alias(date), *kept)
    return df.unionByName(nxt, allowMissingColumns=True)


def remove_key(c: Column, key: str) -> Column:
    return F.map_filter(c, lambda k, _: k != key)


def repair_bounds(df: DataFrame) -> DataFrame:
    """Scores outside their range become Hold with zero stake and a note."""
    bad = (~F.col("p_up").between(0, 1)) | (F.abs("exp_ret") > 0.20)
    bad = F.coalesce(bad, F.lit(False))
    return df.withColumns({
        "note": F.when(bad, "OUT_OF_BOUNDS").otherwise(F.col("note")),
        "recommendation": F.when(bad, "Hold").otherwise(F.col("recommendation")),
        "kelly": F.when(bad, 0.0).otherwise(F.col("kelly"))})


def neutralise_quarantined(scores: DataFrame, quarantine: DataFrame, keep_rows: int | None = None) -> DataFrame:
    """Replace the newest score of quarantined tickers by a neutral Hold.

    All their older rows stay, or the newest ``keep_rows`` where that is given.
    """
    q = quarantine.select("ticker").distinct().withColumn("_q", F.lit(True))
    rn = F.row_number().over(by("ticker", []).orderBy(F.col("date").desc()))
    j = scores.join(q, "ticker", "left").withColumn("_rn", rn)
    hit = F.coalesce(F.col("_q"), F.lit(False)) & (F.col("_rn") == 1)
    if keep_rows is not None:
        j = j.filter(F.col("_q").isNull() | (F.col("_rn") <= keep_rows))
    return j.withColumns({
        "p_up": F.when(hit, 0.5).otherwise(F.col("p_up")),
        "exp_ret": F.when(hit, 0.0).otherwise(F.col("exp_ret")),
        "recommendation": F.when(hit, "Hold").otherwise(F.col("recommendation")),
        "status": F.when(hit, "QUARANTINED").otherwise(F.col("status")),
    }).drop("_q", "_rn")
