"""Joins of panels with macro series, calendars, lookups, ledgers and each other.

No side is broadcast by hint unless its size is fixed by construction; the
planner and AQE choose from measured sizes otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import UNB, by, cols, ranged_last
from ..functions.dates import business_days


def attach_macro(panel: DataFrame, macro: DataFrame, date="date") -> DataFrame:
    """Left join by date; macro columns already in the panel are replaced."""
    clash = [c for c in macro.columns if c != date and c in panel.columns]
    return panel.drop(*clash).join(macro, date, "left")


def reattach_means(df: DataFrame, value: str, group: str, date="date") -> DataFrame:
    """Market and group means per date, aggregated first and joined back."""
    per = df.groupBy(date, group).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    g = per.select(date, group, F.try_divide("_s", F.col("_n")).alias("group_mean"))
    m = per.groupBy(date).agg(F.try_divide(F.sum("_s"), F.sum("_n")).alias("market_mean"))
    return df.join(g, [date, group], "left").join(m, date, "left")


def inner_chain(frames: list[DataFrame], on) -> DataFrame:
    return reduce(lambda a, b: a.join(b, on, "inner"), frames)


def outer_chain_filled(df: DataFrame, names: list[str], name_col="persona", value="total_equity",
                       date="date") -> DataFrame:
    """One column per named series on the union of dates, filled forward.

    One conditional aggregation replaces a chain of full outer joins.
    """
    wide = df.filter(F.col(name_col).isin(*names)).groupBy(date).agg(
        *[F.max(F.when(F.col(name_col) == n, F.col(value))).alias(n) for n in names])
    o = Window.orderBy(date).rowsBetween(UNB, 0)  # one row per session
    return wide.select(date, *[F.last(n, True).over(o).alias(n) for n in names])


def override_latest(df: DataFrame, shadow: DataFrame, value: str, keys=("ticker",), order="date") -> DataFrame:
    """On each key's newest row use the shadow's value where it has one."""
    k = cols(keys)
    newest = df.groupBy(*k).agg(F.max(order).alias(order))
    s = newest.join(shadow.select(*k, F.col(value).alias("_v")), k).select(*k, order, "_v")
    return df.join(s, [*k, order], "left").withColumn(value, F.coalesce("_v", value)).drop("_v")


def only_active(df: DataFrame, active: DataFrame, on="ticker") -> DataFrame:
    return df.join(active, on, "left_semi")


def not_in(df: DataFrame, known: DataFrame, on="ticker") -> DataFrame:
    return df.join(known, on, "left_anti")


def as_of(left: DataFrame, right: DataFrame, value: str, *, keys=("ticker",), left_time: str, right_time: str,
          out: str | None = None, strict: bool = False) -> DataFrame:
    """Latest ``value`` at or before each left row's time (before it, if ``strict``).

    Both sides are stacked and the last seen value is carried along range slices
    of (key, time), so neither a hot key nor a hot time span lands in one task
    and no range join is planned. Left rows of one instant are told apart by a
    hash of their columns (maps, which have no order, left out), which lets even
    a single instant be split.
    """
    hashed = [c for c, t in left.dtypes if "map<" not in t and "variant" not in t]
    k, out = cols(keys), out or value
    quotes = right.filter(F.col(value).isNotNull()).groupBy(*k, F.col(right_time).alias("_t")).agg(F.max(value).alias("_v"))
    r = quotes.withColumns({"_side": F.lit(1 if strict else 0), "_h": F.lit(0).cast("bigint"), "_is_left": F.lit(False)})
    l = left.withColumns({"_t": F.col(left_time), "_side": F.lit(0 if strict else 1), "_h": F.xxhash64(*hashed), "_is_left": F.lit(True)})
    both = l.unionByName(r, allowMissingColumns=True)
    seen = ranged_last(both, k, ["_t", "_side", "_h"], "_v", "_seen")
    return seen.filter("_is_left").select(*[c for c in left.columns if c != out], F.col("_seen").alias(out))


def exact_else_latest(df: DataFrame, series: DataFrame, value: str, date="date") -> DataFrame:
    """Value on the date, otherwise the newest value of the series."""
    newest = series.agg(F.max_by(value, date)).scalar()
    j = df.join(series.select(date, value), date, "left")
    return j.withColumn(value, F.coalesce(F.col(value), newest))


def lookup(df: DataFrame, table: DataFrame, on) -> DataFrame:
    return df.join(table, on, "left")


def combinations(df: DataFrame, group="target", item="feature", rank="rank") -> DataFrame:
    """Unordered pairs of a pre-ranked short list (k items give k(k-1)/2 pairs per group)."""
    a = df.select(F.col(group).alias(group), F.col(item).alias("first"), F.col(rank).alias("_ra"))
    b = df.select(F.col(group).alias(group), F.col(item).alias("second"), F.col(rank).alias("_rb"))
    return a.join(b, group).filter("_ra < _rb").select(group, "first", "second")


def combine_pairs(macro: DataFrame, micro: DataFrame, group="target") -> DataFrame:
    m = combinations(macro, group).withColumnsRenamed({"first": "macro_1", "second": "macro_2"})
    s = combinations(micro, group).withColumnsRenamed({"first": "micro_1", "second": "micro_2"})
    return m.join(s, group)


def at_trade_time(trades: DataFrame, scorecard: DataFrame, on=("ticker", "date")) -> DataFrame:
    return trades.join(scorecard, cols(on), "left")


def densify(df: DataFrame, keys=("ticker",), date="date", fill: bool = True, per_key_span: bool = False) -> DataFrame:
    """Reindex every key to the business days of the frame (or of the key) and fill forward."""
    k = cols(keys)
    if per_key_span:
        spans = df.groupBy(*k).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    else:
        first, last = df.agg(F.min(date)).scalar(), df.agg(F.max(date)).scalar()
        spans = df.select(*k).distinct().withColumns({"_a": first, "_b": last})
    grid = spans.select(*k, F.explode(business_days(F.col("_a"), F.col("_b"))).alias(date))
    out = grid.join(df, [*k, date], "left")
    if not fill:
        return out
    w = by(k, date).rowsBetween(UNB, 0)
    rest = [c for c in df.columns if c not in (*k, date)]
    return out.select(*k, date, *[F.last(c, True).over(w).alias(c) for c in rest])


def moved_to_next_session(df: DataFrame, date="date") -> DataFrame:
    """Every row under the frame's next session, so that an equi join meets consecutive sessions; the last one drops out."""
    o = Window.orderBy(date)  # one row per session
    s = df.select(date).distinct().select(date, F.lead(date).over(o).alias("_next")).filter("_next is not null")
    return df.join(s, date).drop(date).withColumnRenamed("_next", date).select(*df.columns)


def compare_maps(before: DataFrame, after: DataFrame, on=("persona", "ticker"), value="units") -> DataFrame:
    """Full outer comparison of two exploded holdings frames; absent means zero."""
    a = before.select(*cols(on), F.col(value).alias(f"old_{value}"))
    b = after.select(*cols(on), F.col(value).alias(f"new_{value}"))
    return a.join(b, cols(on), "full_outer").na.fill(0.0, [f"old_{value}", f"new_{value}"])


def weighted_lookup(weights: DataFrame, scores: DataFrame, value="score", group="etf") -> DataFrame:
    w, v = F.col("weight"), F.col(value)
    return weights.join(scores, "ticker").groupBy(group).agg(
        F.try_divide(F.sum(v * w), F.sum(w)).alias(f"weighted_{value}"), F.count(F.lit(1)).alias("n"))


def fold_rows(df: DataFrame, splits: int, date="date") -> DataFrame:
    """Rows with every fold they take part in, as train (before the test block) or test.

    Folds are cut on the distinct sessions; each row is exploded only to the
    folds it belongs to (at most ``splits``), so there is no band join.
    """
    o = Window.orderBy(date)  # one row per session
    s = df.select(date).distinct().select(date, (F.row_number().over(o) - 1).alias("_i"))
    s = s.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    size = F.floor(F.col("_n") / (splits + 1))
    start = F.col("_n") - size * splits
    block = F.when(F.col("_i") < start, 0).otherwise(F.floor(F.try_divide(F.col("_i") - start, size)) + 1)
    roles = s.withColumn("_blk", block.cast("int")).select(date, F.explode(F.transform(
        F.sequence(F.greatest(F.col("_blk"), F.lit(1)), F.lit(splits)),
        lambda f: F.struct(f.alias("fold"), (f == F.col("_blk")).alias("is_test")))).alias("_f"))
    roles = roles.select(date, "_f.fold", "_f.is_test")
    return df.join(roles, date)


def positive(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))
