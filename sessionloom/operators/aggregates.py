"""Group aggregates: bars, liquidity, risk, hit rates, correlation sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import by, cols, last_per


# ---- bars and volume -------------------------------------------------------

def packed_order(*parts: tuple[Column, int]) -> Column:
    """One decimal that sorts like the tuple of non-negative whole parts.

    Each part comes with its number of digits (38 in all). Unlike a struct, a
    decimal lets min_by and max_by run in a hash aggregate, so raw rows are not
    sorted before they are combined.
    """
    total, room = None, sum(d for _, d in parts)
    if room > 38:
        raise ValueError(f"{room} digits do not fit")
    for c, digits in parts:
        room -= digits
        term = c.cast(f"decimal({digits},0)") * F.lit("1" + "0" * room).cast(f"decimal({room + 1},0)") if room else c.cast(f"decimal({digits},0)")
        total = term if total is None else total + term
    return total.cast("decimal(38,0)")


def bars_from_ticks(ticks: DataFrame, keys, order) -> DataFrame:
    """OHLCV bars; open and close follow ``order``, all parts combine on the map side.

    Give ``order`` as one column (see :func:`packed_order`) where it can be.
    """
    o = F.col(order) if isinstance(order, str) else F.struct(*cols(order))
    return ticks.groupBy(*cols(keys)).agg(
        F.min_by("price", o).alias("open"), F.max("price").alias("high"),
        F.min("price").alias("low"), F.max_by("price", o).alias("close"),
        F.sum("size").alias("volume"))


def typical_price() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def vwap(df: DataFrame, keys, order="date") -> DataFrame:
    """Volume-weighted typical price; with no volume, the last close."""
    return df.groupBy(*cols(keys)).agg(
        F.coalesce(F.try_divide(F.sum(typical_price() * F.col("volume")), F.sum("volume")),
                   F.max_by("close", F.struct(*cols(order)))).alias("vwap"))


def tail_mean(df: DataFrame, value: Column, n: int, out: str, keys="ticker", order="date") -> DataFrame:
    """Mean over the last ``n`` rows of each key (liquidity, average volume)."""
    from .cleaning import tail
    return tail(df, n, keys, order).groupBy(*cols(keys)).agg(F.avg(value).alias(out))


def dollar_volume(df: DataFrame, floor: float, keys="ticker") -> DataFrame:
    g = df.groupBy(*cols(keys)).agg((F.avg("volume") * F.avg("close")).alias("dollar_volume"))
    return g.filter(F.col("dollar_volume") >= floor)


def return_volatility(df: DataFrame, ret="ret", keys="ticker", periods: int = 252) -> DataFrame:
    return df.groupBy(*cols(keys)).agg(
        F.stddev_samp(ret).alias("volatility"),
        (F.stddev_samp(ret) * F.sqrt(F.lit(float(periods)))).alias("annual_volatility"))


# ---- market and sector means ----------------------------------------------

def group_mean(df: DataFrame, keys, value, out: str) -> DataFrame:
    return df.groupBy(*cols(keys)).agg(F.avg(value).alias(out))


def date_span(df: DataFrame, keys, date="date") -> DataFrame:
    return df.groupBy(*cols(keys)).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def last_row(df: DataFrame, keys="ticker", order="date") -> DataFrame:
    return last_per(df, keys, order)


def value_counts(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))


# ---- risk and performance --------------------------------------------------

def sharpe(df: DataFrame, ret="ret", keys="persona", periods: int = 252, min_rows: int = 1) -> DataFrame:
    g = df.groupBy(*cols(keys)).agg(
        F.try_divide(F.avg(ret), F.stddev_samp(ret)).alias("_s"), F.count(ret).alias("n"))
    enough = F.col("n") >= min_rows
    return g.select(*cols(keys), "n",
                    F.when(enough, F.col("_s") * F.sqrt(F.lit(float(periods)))).alias("sharpe"))


def max_drawdown(df: DataFrame, equity="total_equity", keys="persona", order="date") -> DataFrame:
    from .windows import drawdown
    d = drawdown(df, equity, keys=keys, order=order)
    return d.groupBy(*cols(keys)).agg((F.min("drawdown") * 100).alias("max_drawdown_pct"))


def total_return(df: DataFrame, equity="total_equity", keys="persona", order="date",
                 start: float = 10000.0) -> DataFrame:
    first, last = F.min_by(equity, order), F.max_by(equity, order)
    return df.groupBy(*cols(keys)).agg(
        (F.try_divide(last, F.lit(start)) - 1).alias("return_on_start"),
        (F.try_divide(last, first) - 1).alias("return_on_first"))


def win_rate(df: DataFrame, value="pnl", keys="persona") -> DataFrame:
    """Share of positive among non-zero values."""
    v = F.col(value)
    return df.groupBy(*cols(keys)).agg(
        F.count_if(v > 0).alias("wins"), F.count_if(v != 0).alias("active"),
        F.coalesce(F.try_divide(100.0 * F.count_if(v > 0), F.count_if(v != 0)), F.lit(0.0)).alias("win_pct"))


# ---- statistics ------------------------------------------------------------

def pearson(x, y) -> Column:
    """Pairwise-complete Pearson correlation; null when either side is constant."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def correlate(df: DataFrame, x, y, keys) -> DataFrame:
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    return df.groupBy(*cols(keys)).agg(pearson(x, y).alias("corr"), F.count_if(both).alias("n"))


def fit_quality(df: DataFrame, actual: str, predicted: str, keys) -> DataFrame:
    """R-squared 1 - SSE/SST against the mean, and share of equal signs."""
    a, p = F.col(actual), F.col(predicted)
    ok = df.filter(a.isNotNull() & p.isNotNull())
    return ok.groupBy(*cols(keys)).agg(
        F.count(F.lit(1)).alias("n"),
        (1 - F.try_divide(F.sum((a - p) * (a - p)), F.var_pop(a) * F.count(F.lit(1)))).alias("r2"),
        F.avg((F.signum(a) == F.signum(p)).cast("double")).alias("direction_accuracy"))


def weighted_mean(df: DataFrame, value, weight, keys, out="weighted") -> DataFrame:
    v, w = F.col(value), F.col(weight)
    return df.groupBy(*cols(keys)).agg(F.try_divide(F.sum(v * w), F.sum(w)).alias(out))


def threshold_grid(df: DataFrame, thresholds, prob="p_up", actual="actual_ret") -> DataFrame:
    """Hit rate and mean return of long and short calls at each threshold.

    Rows are never multiplied by the grid: each is counted once under the number
    of thresholds it reaches, and the few bucket sums are then accumulated.
    """
    ts = sorted(float(t) for t in thresholds)
    ladder = F.array(*[F.lit(t) for t in ts])
    p, a = F.col(prob), F.col(actual)
    ok = df.filter(p.isNotNull() & a.isNotNull())
    up = F.size(F.filter(ladder, lambda t: p > t))
    down = F.size(F.filter(ladder, lambda t: p < 1 - t))
    buckets = ok.groupBy(up.alias("up"), down.alias("down")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(a > 0).alias("pos"), F.count_if(a < 0).alias("neg"),
        F.sum(a).alias("ret"))
    # at most (len+1)^2 bucket rows from here on
    per = buckets.select("*", F.explode(F.transform(
        F.sequence(F.lit(1), F.lit(len(ts))),
        lambda k: F.struct(k.alias("k"), F.element_at(ladder, k).alias("t")))).alias("s"))
    long_, short = F.col("up") >= F.col("s.k"), F.col("down") >= F.col("s.k")

    def total(cond, c):
        return F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))

    return per.groupBy(F.col("s.t").alias("threshold")).agg(
        total(long_, "n").alias("longs"), total(short, "n").alias("shorts"),
        F.try_divide(total(long_, "pos"), total(long_, "n")).alias("long_hit_rate"),
        F.try_divide(total(short, "neg"), total(short, "n")).alias("short_hit_rate"),
        F.try_divide(total(long_, "ret"), total(long_, "n")).alias("long_mean_ret"),
        F.try_divide(-total(short, "ret"), total(short, "n")).alias("short_mean_ret"))


def agreement(df: DataFrame, a: str, b: str, actual: str, keys=()) -> DataFrame:
    """Accuracy of ``a`` on all rows, where both signals agree, and where they differ."""
    right = (F.col(a) == F.col(actual)).cast("double")
    same = F.col(a) == F.col(b)
    ok = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(actual).isNotNull())
    return ok.groupBy(*cols(keys)).agg(
        F.avg(right).alias("accuracy_all"), F.avg(F.when(same, right)).alias("accuracy_agree"),
        F.avg(F.when(~same, right)).alias("accuracy_disagree"),
        F.avg(same.cast("double")).alias("coverage"), F.count(F.lit(1)).alias("n"))


def confidence(df: DataFrame, prob="p_up", actual="actual_ret", keys="ticker", order="date",
               high: float = 0.65, recent: int = 30) -> DataFrame:
    """Accuracy overall, on confident rows, on the last rows, and confident coverage."""
    p, a = F.col(prob), F.col(actual)
    ok = df.filter(p.isNotNull() & a.isNotNull())
    age = F.row_number().over(by(keys, []).orderBy(F.col(order).desc()))
    right = ((p > 0.5) == (a > 0)).cast("double")
    sure = (p > high) | (p < 1 - high)
    return ok.withColumn("_age", age).groupBy(*cols(keys)).agg(
        F.avg(right).alias("accuracy"), F.avg(F.when(sure, right)).alias("sure_accuracy"),
        F.avg(sure.cast("double")).alias("coverage"),
        F.avg(F.when(F.col("_age") <= recent, right)).alias("recent_accuracy"))


def gram(df: DataFrame, names, keys=()) -> DataFrame:
    """Cross-product sums of a handful of named columns, one row per ordered pair.

    One pass computes every pair as a separate sum, so rows are never multiplied.
    """
    names = list(names)
    pairs = [(x, y) for i, x in enumerate(names) for y in names[i:]]
    sums = df.groupBy(*cols(keys)).agg(*[
        F.sum(F.col(x) * F.col(y)).alias(f"_{i}") for i, (x, y) in enumerate(pairs)])
    items = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"_{i}").alias("xy"))
                      for i, (x, y) in enumerate(pairs)])
    return sums.select(*cols(keys), F.inline(items))


def transitions(df: DataFrame, state: str, states, keys="ticker", order="date",
                smoothing: float = 1.0) -> DataFrame:
    """State-to-state probabilities with additive smoothing, rows summing to one."""
    k = cols(keys)
    prev = df.select(*k, F.lag(state).over(by(k, order)).alias("from_state"),
                     F.col(state).alias("to_state")).filter("from_state is not null and to_state is not null")
    counts = prev.groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in states for b in states], "from_state string, to_state string")
    full = F.broadcast(grid).join(counts, ["from_state", "to_state"], "left")
    sm = F.coalesce(F.col("n"), F.lit(0)) + smoothing
    row = full.groupBy("from_state").agg(F.sum(sm).alias("row_total"))
    return full.join(F.broadcast(row), "from_state").select(
        "from_state", "to_state", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        (sm / F.col("row_total")).alias("prob"))
