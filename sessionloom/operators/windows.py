"""Row-frame window functions over bars, and group transforms that avoid wide windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import KEYS, by, cols, last_n, ranged_running, so_far


def ratio_change(c, n: int, w) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.try_divide(c, F.lag(c, n).over(w)) - 1


def pct_change(df: DataFrame, value="close", n: int = 1, out="ret", keys=KEYS, order="date") -> DataFrame:
    return df.withColumn(out, ratio_change(value, n, by(keys, order)))


def difference(df, value="close", n: int = 1, out="diff", keys=KEYS, order="date") -> DataFrame:
    return df.withColumn(out, F.col(value) - F.lag(value, n).over(by(keys, order)))


def shift(df, value, k: int, out, keys=KEYS, order="date") -> DataFrame:
    """Positive ``k`` looks back, negative looks ahead (next-session target)."""
    return df.withColumn(out, F.lag(value, k).over(by(keys, order)))


def mean_over(c, n: int, keys=KEYS, order="date", min_periods: int | None = None) -> Column:
    w = last_n(n, keys, order)
    need = n if min_periods is None else min_periods
    c = F.col(c) if isinstance(c, str) else c
    m = F.avg(c).over(w)
    return m if need <= 1 else F.when(F.count(c).over(w) >= need, m)


def std_over(c, n: int, keys=KEYS, order="date", min_periods: int | None = None) -> Column:
    w = last_n(n, keys, order)
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.count(c).over(w) >= (n if min_periods is None else min_periods), F.stddev_samp(c).over(w))


def extreme_over(c, n: int, fn, keys=KEYS, order="date") -> Column:
    w = last_n(n, keys, order)
    return F.when(F.count(c).over(w) >= n, fn(c).over(w))


def rolling_mean(df, value, n, out, keys=KEYS, order="date", min_periods=None) -> DataFrame:
    return df.withColumn(out, mean_over(value, n, keys, order, min_periods))


def rolling_std(df, value, n, out, keys=KEYS, order="date", min_periods=None) -> DataFrame:
    return df.withColumn(out, std_over(value, n, keys, order, min_periods))


def rolling_max(df, value, n, out, keys=KEYS, order="date") -> DataFrame:
    return df.withColumn(out, extreme_over(value, n, F.max, keys, order))


def rolling_min(df, value, n, out, keys=KEYS, order="date") -> DataFrame:
    return df.withColumn(out, extreme_over(value, n, F.min, keys, order))


def ratchet(df, value, out, keys=KEYS, order="date") -> DataFrame:
    return df.withColumn(out, F.max(F.coalesce(F.col(value), F.lit(0.0))).over(so_far(keys, order)))


def running_sum(df, value, out, keys=KEYS, order="date") -> DataFrame:
    return df.withColumn(out, F.sum(value).over(so_far(keys, order)))


def growth(ret: Column, w) -> Column:
    """Product of 1+r as exp(sum(log)); a loss of 100 % or more leaves nothing."""
    wiped = F.max(F.when(ret <= -1, 1).otherwise(0)).over(w) == 1
    logs = F.sum(F.when(ret > -1, F.log1p(ret)).otherwise(0.0)).over(w)
    return F.when(wiped, 0.0).otherwise(F.exp(logs))


def compound(df, ret="ret", start: float = 10000.0, out="equity", keys=KEYS, order="date") -> DataFrame:
    return df.withColumn(out, start * growth(F.coalesce(F.col(ret), F.lit(0.0)), so_far(keys, order)))


def log_growth(df, log_ret, out, keys=KEYS, order="date") -> DataFrame:
    return df.withColumn(out, F.exp(F.sum(log_ret).over(so_far(keys, order))) - 1)


def drawdown(df, equity="total_equity", keys=KEYS, order="date") -> DataFrame:
    peak = F.max(equity).over(so_far(keys, order))
    return df.withColumns({"peak": peak, "drawdown": F.try_divide(F.col(equity) - peak, peak)})


def rank_within(df: DataFrame, value: str, keys, out="rank", descending: bool = True) -> DataFrame:
    """Rank with ties sharing the lowest place, for groups of any size.

    Distinct values are counted first, the counts accumulate over range slices,
    and the places are joined back; no window ever holds a whole group.
    """
    k = cols(keys)
    counts = df.groupBy(*k, value).agg(F.count(F.lit(1)).alias("_n"))
    o = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    run = ranged_running(counts, k, [o], {"_upto": F.col("_n")})
    places = run.select(*k, F.col(value).alias("_v"), (F.col("_upto") - F.col("_n") + 1).alias(out))
    a = df.alias("a")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"p.{c}")) for c in k]
    cond = F.col(f"a.{value}").eqNullSafe(F.col("p._v"))
    for s in same:
        cond = cond & s
    return a.join(places.alias("p"), cond, "left").select("a.*", F.col(f"p.{out}").cast("bigint").alias(out))


def top_k(df: DataFrame, k: int, keys, order: list[Column], rank_col: str | None = None) -> DataFrame:
    """First ``k`` rows per key; pruned to ``k`` per key and task before the shuffle."""
    w = Window.partitionBy(*cols(keys)).orderBy(*order)
    out = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    return out.withColumnRenamed("_rn", rank_col) if rank_col else out.drop("_rn")


def block_index(df, size: int = 5, out="block", keys=KEYS, order="date") -> DataFrame:
    return df.withColumn(out, F.floor((F.row_number().over(by(keys, order)) - 1) / size))


def relative_to_mean(c, n: int, keys=KEYS, order="date", min_periods: int | None = None) -> Column:
    return F.try_divide(F.col(c), mean_over(c, n, keys, order, min_periods))


def until_weight(df: DataFrame, target: float, group="etf", item="ticker", weight="weight") -> DataFrame:
    """Heaviest items until their weight reaches ``target``; the crossing item is included."""
    run = ranged_running(df, group, [F.col(weight).desc(), F.col(item)], {"cum_weight": F.col(weight)})
    return run.filter(F.col("cum_weight") - F.col(weight) < target)


def min_max_scale(df: DataFrame, values, keys, invert=()) -> DataFrame:
    """Scale to 0..1 inside each key; a flat key gives 0. Bounds come from an aggregate join."""
    k, vs = cols(keys), cols(values)
    b = df.groupBy(*k).agg(*[f(v).alias(f"_{n}_{v}") for v in vs for n, f in (("lo", F.min), ("hi", F.max))])
    j = df.join(b, k)
    for v in vs:
        x = F.coalesce(F.try_divide(F.col(v) - F.col(f"_lo_{v}"), F.col(f"_hi_{v}") - F.col(f"_lo_{v}")), F.lit(0.0))
        j = j.withColumn(f"{v}_scaled", 1 - x if v in invert else x)
    return j.drop(*[c for c in b.columns if c not in k])


def sequences(df: DataFrame, values, length: int, out="sequence", keys=KEYS, order="date") -> DataFrame:
    """Array of the previous ``length`` rows' feature vectors; shorter histories are dropped."""
    w = by(keys, order).rowsBetween(-length, -1)
    seq = F.collect_list(F.array(*[F.col(v) for v in cols(values)])).over(w)
    return df.withColumn(out, seq).filter(F.size(out) == length)


def standardise_on_train(df: DataFrame, values, train: str, keys=(), eps: float | None = 1e-8) -> DataFrame:
    """z-score with mean and population deviation of the train rows only.

    ``eps`` is added to the deviation; ``None`` selects the other guard, which
    replaces deviations under 1e-5 by one.
    """
    k, vs = cols(keys), cols(values)
    stats = df.filter(F.col(train)).groupBy(*k).agg(
        *[f(v).alias(f"_{n}_{v}") for v in vs for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    if k:
        j = df.join(stats, k, "left")
    else:
        j = df.withColumns({c: stats.select(c).scalar() for c in stats.columns})
    for v in vs:
        s = F.col(f"_s_{v}")
        s = s + eps if eps is not None else F.when(s < 1e-5, 1.0).otherwise(s)
        j = j.withColumn(f"{v}_z", F.try_divide(F.col(v) - F.col(f"_m_{v}"), s))
    return j.drop(*[c for c in stats.columns if c not in k])


def last_sessions(df: DataFrame, n: int, date="date") -> DataFrame:
    """Rows of the last ``n`` distinct dates of the whole frame."""
    recent = df.select(date).distinct().orderBy(F.col(date).desc()).limit(n)
    return df.join(F.broadcast(recent), date, "left_semi")  # n dates


def last_sessions_per(df: DataFrame, n: int, keys, date="date") -> DataFrame:
    k = cols(keys)
    recent = top_k(df.select(*k, date).distinct(), n, k, [F.col(date).desc()])
    return df.join(recent, [*k, date], "left_semi")


def chronological_split(df, train_share: float | None = None, test_rows: int | None = None,
                        out="is_train", keys=KEYS, order="date") -> DataFrame:
    k = cols(keys)
    n = F.count(F.lit(1)).over(Window.partitionBy(*k))
    i = F.row_number().over(by(k, order))
    cut = F.floor(n * F.lit(train_share)) if train_share is not None else n - F.lit(test_rows)
    return df.withColumn(out, i <= cut)


def walk_forward_folds(df, splits: int = 5, keys=KEYS, order="date") -> DataFrame:
    """Rows annotated with the fold whose test block they fall into (0 = initial train)."""
    k = cols(keys)
    n = F.count(F.lit(1)).over(Window.partitionBy(*k))
    i = F.row_number().over(by(k, order)) - 1
    size = F.floor(n / (splits + 1))
    start = n - size * splits
    return df.withColumn("test_fold", F.when(i < start, 0).otherwise(
        F.least(F.lit(splits), F.floor(F.try_divide(i - start, size)) + 1)).cast("bigint"))


def from_date(df, start, date="date") -> DataFrame:
    return df.filter(F.col(date) >= F.lit(start).cast("date"))


def gaps(df, max_days: int = 4, keys=KEYS, date="date") -> DataFrame:
    prev = F.lag(date).over(by(keys, date))
    return (df.select(*cols(keys), prev.alias("previous"), date, F.datediff(date, prev).alias("gap_days"))
            .filter(F.col("gap_days") > max_days))


def row_std(*names: str) -> Column:
    """Sample deviation across the columns of one row."""
    xs = [F.col(n) for n in names]
    m = sum(xs[1:], xs[0]) / len(xs)
    ss = [(x - m) * (x - m) for x in xs]
    return F.sqrt(sum(ss[1:], ss[0]) / (len(xs) - 1))


def first_of_runs(df, flag: Column, keys, order="date") -> DataFrame:
    """First row of each unbroken run where ``flag`` holds."""
    w = by(keys, order)
    d = df.withColumn("_f", F.coalesce(flag, F.lit(False)))
    return (d.withColumn("_p", F.coalesce(F.lag("_f").over(w), F.lit(False)))
            .filter(F.col("_f") & ~F.col("_p")).drop("_f", "_p"))


