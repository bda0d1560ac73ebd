"""Technical indicators and market features over bars (open, high, low, close, volume)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import KEYS, UNB, by, cols, last_n, so_far
from . import ewm
from .windows import extreme_over, mean_over, ratio_change, relative_to_mean, row_std, std_over

TINY = 1e-5


def nonzero(x: Column) -> Column:
    return F.when(x == 0, TINY).otherwise(x)


def _moves(df: DataFrame, keys, order) -> DataFrame:
    """Gain, loss, true range and directional moves; the first row has zero moves."""
    w = by(keys, order)
    ch = F.col("close") - F.lag("close").over(w)
    prev = F.lag("close").over(w)
    up = F.col("high") - F.lag("high").over(w)
    down = F.lag("low").over(w) - F.col("low")
    return df.withColumns({
        "_gain": F.when(ch > 0, ch).otherwise(0.0),
        "_loss": F.when(ch < 0, -ch).otherwise(0.0),
        "_tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)),
        "_up": F.when((up > down) & (up > 0), up).otherwise(0.0),
        "_dn": F.when((down > up) & (down > 0), down).otherwise(0.0)})


def _smoothed(df: DataFrame, n: int, keys, order) -> DataFrame:
    """Chunked frame with every Wilder average at once, sharing one window."""
    d = ewm.chunked(_moves(df, keys, order), keys, order)

    def sm(c):
        return ewm.adjusted(F.col(c), 1.0 / n, n, keys, order)

    d = d.withColumns({"_ag": sm("_gain"), "_al": sm("_loss"), "atr": sm("_tr"),
                       "_su": sm("_up"), "_sd": sm("_dn")})
    d = d.withColumn("rsi", 100 - 100 / (1 + F.col("_ag") / nonzero(F.col("_al"))))
    d = d.withColumns({"plus_di": 100 * F.col("_su") / nonzero(F.col("atr")),
                       "minus_di": 100 * F.col("_sd") / nonzero(F.col("atr"))})
    dx = 100 * F.abs(F.col("plus_di") - F.col("minus_di")) / nonzero(F.col("plus_di") + F.col("minus_di"))
    d = d.withColumn("_dx", dx)
    d = d.withColumn("adx", sm("_dx"))
    return ewm.unchunk(d).drop("_gain", "_loss", "_up", "_dn", "_ag", "_al", "_su", "_sd", "_dx")


def trend_set(bars: DataFrame, n: int = 14, keys=KEYS, order="date") -> DataFrame:
    """rsi, atr, plus_di, minus_di, adx, true_range, trailing_stop and ras_signal in one pass."""
    hi = extreme_over("high", 20, F.max, keys, order)
    d = _smoothed(bars.withColumn("max_high_20", hi), n, keys, order)
    raw = F.col("max_high_20") - 2.5 * F.col("atr")
    ratcheted = F.max(F.coalesce(raw, F.lit(0.0))).over(so_far(keys, order))
    d = d.withColumn("trailing_stop", F.when(F.col("atr").isNotNull(), ratcheted))
    return d.withColumn("ras_signal", ras_signal()).withColumnRenamed("_tr", "true_range")


def rsi_wilder(bars, n=14, keys=KEYS, order="date") -> DataFrame:
    return trend_set(bars, n, keys, order).select(*bars.columns, "rsi")


def true_range_atr(bars, n=14, keys=KEYS, order="date") -> DataFrame:
    return trend_set(bars, n, keys, order).select(*bars.columns, "true_range", "atr")


def directional(bars, n=14, keys=KEYS, order="date") -> DataFrame:
    return trend_set(bars, n, keys, order).select(*bars.columns, "plus_di", "minus_di")


def adx(bars, n=14, keys=KEYS, order="date") -> DataFrame:
    return trend_set(bars, n, keys, order).select(*bars.columns, "adx")


def trailing_stop(bars, n=14, keys=KEYS, order="date") -> DataFrame:
    return trend_set(bars, n, keys, order).select(*bars.columns, "trailing_stop")


def ras_signal() -> Column:
    c, stop, rsi, adx_ = (F.col(x) for x in ("close", "trailing_stop", "rsi", "adx"))
    return (F.when(c < stop, "STOP_HIT")
            .when(rsi.isNull() | adx_.isNull(), "HOLD")
            .when((rsi <= 35) & (adx_ >= 25), "BUY")
            .when((rsi >= 65) & (adx_ >= 25), "SELL").otherwise("HOLD"))


def rsi_recursive(bars, n=14, keys=KEYS, order="date", out="rsi_recursive") -> DataFrame:
    """Same index from recursively seeded averages, without the zero-loss guard."""
    d = ewm.chunked(_moves(bars, keys, order), keys, order)
    d = d.withColumns({"_ag": ewm.recursive(F.col("_gain"), 1.0 / n, keys, order),
                       "_al": ewm.recursive(F.col("_loss"), 1.0 / n, keys, order)})
    return ewm.unchunk(d.withColumn(out, _index(F.col("_ag"), F.col("_al")))).select(*bars.columns, out)


def _index(gain: Column, loss: Column) -> Column:
    """100 - 100/(1+gain/loss) with an infinite ratio giving 100 and 0/0 giving null."""
    return F.when((loss == 0) & (gain > 0), 100.0).otherwise(100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(gain, loss)))


def rsi_sma(bars, n=14, keys=KEYS, order="date", out="rsi_sma") -> DataFrame:
    """Simple-mean variant; undefined values become 50."""
    ch = F.col("close") - F.lag("close").over(by(keys, order))
    d = bars.withColumns({"_g": F.greatest(ch, F.when(ch.isNotNull(), 0.0)),
                          "_n": F.greatest(-ch, F.when(ch.isNotNull(), 0.0))})
    g, s = mean_over("_g", n, keys, order), mean_over("_n", n, keys, order)
    return d.withColumn(out, F.coalesce(_index(g, s), F.lit(50.0))).drop("_g", "_n")


def dispersion(bars, keys=KEYS, order="date") -> DataFrame:
    return bars.withColumns({
        "ohlc_std": row_std("open", "high", "low", "close"),
        **{f"std_{n}": std_over("close", n, keys, order) for n in (5, 10, 20)},
        "max_high_20": extreme_over("high", 20, F.max, keys, order),
        "min_low_20": extreme_over("low", 20, F.min, keys, order)})


def sector_regime(panel: DataFrame, ret="ret", n: int = 60) -> DataFrame:
    """Sector mean return against the market, both as n-session partial means.

    The means are formed on the (date, sector) and (date) aggregates and joined
    back, so no window ever spans the raw panel.
    """
    per = panel.groupBy("sector", "date").agg(F.avg(ret).alias("_s"), F.sum(ret).alias("_sum"), F.count(ret).alias("_n"))
    market = per.groupBy("date").agg(F.try_divide(F.sum("_sum"), F.sum("_n")).alias("_m"))
    market = market.select("date", F.avg("_m").over(Window.orderBy("date").rowsBetween(-(n - 1), 0)).alias("_mm"))
    sector = per.select("sector", "date", F.avg("_s").over(last_n(n, "sector")).alias("_sm"))
    score = sector.join(market, "date").select("sector", "date", (F.col("_sm") - F.col("_mm")).alias("sector_momentum"))
    return panel.join(score, ["sector", "date"], "left").withColumn(
        "sector_regime", F.when(F.col("sector_momentum") >= 0, "BULL_REGIME").otherwise("BEAR_REGIME"))


def std_adjusted(ret: Column, stdev: Column) -> Column:
    return ret / (stdev + 1e-8)


def volume_adjusted(bars, keys=KEYS, order="date") -> DataFrame:
    """Return times relative volume, and its three-row mean."""
    w = by(keys, order)
    d = bars.withColumn("vol_adj_ret", ratio_change("close", 1, w) * relative_to_mean("volume", 20, keys, order))
    return d.withColumn("vol_adj_ma3", mean_over("vol_adj_ret", 3, keys, order))


def risk_adjusted(bars, keys=KEYS, order="date") -> DataFrame:
    w = by(keys, order)
    r, s = ratio_change("close", 1, w), std_over("close", 20, keys, order)
    d = bars.withColumns({"risk_adj_ret": r / (s + 1e-8), "vol_amp_ret": r * s})
    return d.withColumns({"risk_adj_ma3": mean_over("risk_adj_ret", 3, keys, order),
                          "vol_amp_ma3": mean_over("vol_amp_ret", 3, keys, order)})


def smooth3(df, value, out, keys=KEYS, order="date") -> DataFrame:
    return df.withColumn(out, mean_over(value, 3, keys, order))


def sma_gap(bars, keys=KEYS, order="date") -> DataFrame:
    d = bars.withColumn("_r", ratio_change("close", 1, by(keys, order)))
    return d.withColumns({
        **{f"sma_gap_{n}": F.try_divide(mean_over("close", n, keys, order), F.col("close")) - 1 for n in (10, 50)},
        "vol_20": std_over("_r", 20, keys, order)}).drop("_r")


def spreads(bars, keys=KEYS, order="date") -> DataFrame:
    w = by(keys, order)
    c = F.col("close")
    d = bars.withColumn("_r", ratio_change("close", 1, w))
    return d.withColumns({
        "log_ret": F.ln(F.try_divide(c, F.lag("close").over(w))),
        "hl_spread": F.try_divide(F.col("high") - F.col("low"), c),
        "co_spread": F.try_divide(c - F.col("open"), c),
        "vol_14": std_over("_r", 14, keys, order)}).drop("_r")


def macro_spreads(macro: DataFrame, n: int = 5) -> DataFrame:
    """Curve, credit, risk-on and commodity features on the joint, filled macro series."""
    o = Window.orderBy("date")  # one row per session
    names = [c for c in macro.columns if c != "date"]
    filled = macro.select("date", *[F.last(c, True).over(o.rowsBetween(UNB, 0)).alias(c) for c in names]).dropna()
    f = filled.withColumns({"curve": F.col("tnx_close") - F.col("irx"),
                            "credit": F.try_divide("hyg", "ief"), "risk_on": F.try_divide("sphb", "splv")})
    out = f.select(
        "date", "curve", (F.col("curve") - F.lag("curve", n).over(o)).alias("curve_trend"),
        "credit", ratio_change("credit", n, o).alias("credit_trend"),
        "risk_on", ratio_change("risk_on", n, o).alias("risk_on_trend"),
        *[x for s in ("oil", "copper", "usd") for x in
          (ratio_change(s, 1, o).alias(f"{s}_ret"), ratio_change(s, n, o).alias(f"{s}_trend"))],
        ratio_change("tnx_close", 1, o).alias("tnx_ret"), ratio_change("tnx_close", n, o).alias("tnx_pct_trend"))
    return out.dropna()


def tnx_features(macro: DataFrame) -> DataFrame:
    """Yesterday's rate return and the five-session mean level."""
    o = Window.orderBy("date")
    d = macro.select("date", "tnx_close", ratio_change("tnx_close", 1, o).alias("_r"))
    five = F.when(F.count("tnx_close").over(o.rowsBetween(-4, 0)) >= 5, F.avg("tnx_close").over(o.rowsBetween(-4, 0)))
    return d.select("date", "tnx_close", F.lag("_r").over(o).alias("tnx_lag1_ret"), five.alias("tnx_mean_5"))


def fear_ratio(vix: Column, stdev: Column) -> Column:
    return F.try_divide(vix, stdev)


def opportunity(bars: DataFrame, n: int = 30, min_rows: int | None = None, keys=KEYS, order="date",
                periods: int = 252) -> DataFrame:
    """Momentum over the last n rows, annualised volatility, and their product."""
    from .cleaning import tail
    k = cols(keys)
    t = tail(bars, n, k, order)
    t = t.withColumn("_r", ratio_change("close", 1, by(k, order)))
    g = t.groupBy(*k).agg(
        (F.try_divide(F.max_by("close", order), F.min_by("close", order)) - 1).alias("momentum"),
        (F.stddev_samp("_r") * F.sqrt(F.lit(float(periods)))).alias("annual_volatility"),
        F.count(F.lit(1)).alias("_n"))
    g = g.filter(F.col("_n") >= (n if min_rows is None else min_rows)).drop("_n")
    return g.withColumn("opportunity", F.col("momentum") * F.col("annual_volatility"))


def sector_gravity(bars: DataFrame, benchmark: str, gap: int = 4) -> DataFrame:
    """Latest momentum per ticker; red when negative and below the benchmark's."""
    mom = F.try_divide(F.col("close") - F.lag("close", gap).over(by()), F.lag("close", gap).over(by()))
    m = bars.select("ticker", "date", mom.alias("momentum"))
    last = m.groupBy("ticker").agg(F.max_by("momentum", "date").alias("momentum"))
    bench = last.filter(F.col("ticker") == benchmark).agg(F.first("momentum")).scalar()
    j = last.withColumn("benchmark_momentum", bench)
    red = (F.col("momentum") < 0) & (F.col("momentum") < F.col("benchmark_momentum"))
    return j.select("ticker", "momentum", "benchmark_momentum", (~F.coalesce(red, F.lit(False))).alias("is_green"))


def lag_frame(bars, lags: int = 5, keys=KEYS, order="date") -> DataFrame:
    """Percent return, direction, lags 1..n and 20-session deviation."""
    w = by(keys, order)
    d = bars.withColumn("ret_pct", 100 * ratio_change("close", 1, w))
    return d.select(*cols(keys), order, "ret_pct", (F.coalesce(F.col("ret_pct"), F.lit(0.0)) > 0).cast("int").alias("direction"),
                    *[F.lag("ret_pct", i).over(w).alias(f"lag{i}") for i in range(1, lags + 1)],
                    std_over("ret_pct", 20, keys, order).alias("std_20"))


def volume_weighted_lags(bars, depths=(1, 2, 3), keys=KEYS, order="date") -> DataFrame:
    """Lagged return scaled by the relative volume of the same session (1 when unknown)."""
    w = by(keys, order)
    d = bars.withColumns({"_r": ratio_change("close", 1, w),
                          "_v": relative_to_mean("volume", 30, keys, order, min_periods=1)})
    return d.select(*cols(keys), order, *[
        (F.lag("_r", i).over(w) * F.coalesce(F.lag("_v", i).over(w), F.lit(1.0))).alias(f"vw_lag{i}") for i in depths])


def upside_pct(target: Column, price: Column) -> Column:
    ok = (target != 0) & (price != 0)
    return F.when(ok, 100 * F.try_divide(target - price, price))


def consensus_label(key: Column) -> Column:
    return F.coalesce(F.replace(F.upper(key), F.lit("_"), F.lit(" ")), F.lit("N/A"))


def unify_features(long: DataFrame, shared, keys=KEYS, order="date") -> DataFrame:
    """One row per (key, date) from long rows (key, date, owner, feature, value) of what each key's frame holds.

    A key's own features become target_*, features of the ``shared`` owners keep
    their owner's name, lags and nested probabilities of any other owner are
    left out, gaps are 0. The plan does not grow with the number of keys.
    """
    k, shared = cols(keys), cols(shared)
    own = F.col("owner") == F.col(k[0])
    foreign = ~own & ~F.col("owner").isin(*shared) & (F.contains(F.col("feature"), F.lit("lag")) | F.contains(F.col("feature"), F.lit("nested_p_up")))
    named = long.filter(~foreign).withColumn("_name", F.when(own, F.concat(F.lit("target_"), "feature")).otherwise(F.concat_ws("_", "owner", "feature")))
    names = sorted(r[0] for r in named.select("_name").distinct().collect())  # column names, as many as there are features
    wide = named.groupBy(*k, order).agg(*[F.max(F.when(F.col("_name") == n, F.col("value"))).alias(n) for n in names])
    return wide.na.fill(0)
