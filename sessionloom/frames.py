"""Window shorthands and skew-safe group primitives shared by the operators.

Per-ticker windows run on *bars* (one row per ticker and session), so a group is
never longer than the session calendar however many raw rows the ticker has.
Groups without such a bound (all tickers of a date, all copies of a key) use the
aggregate-based helpers below, which combine on the map side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import pin

UNB = Window.unboundedPreceding
END = Window.unboundedFollowing
KEYS = ("ticker",)


def cols(names) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def by(keys=KEYS, order="date"):
    return Window.partitionBy(*cols(keys)).orderBy(*cols(order))


def last_n(n: int, keys=KEYS, order="date"):
    return by(keys, order).rowsBetween(-(n - 1), 0)


def so_far(keys=KEYS, order="date"):
    return by(keys, order).rowsBetween(UNB, 0)


def before(keys=KEYS, order="date"):
    return by(keys, order).rowsBetween(UNB, -1)


def _pick(df: DataFrame, keys, order, fn) -> DataFrame:
    keys, order = cols(keys), cols(order)
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(fn(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def first_per(df: DataFrame, keys, order) -> DataFrame:
    """Row with the smallest ``order`` of each key; partial aggregation, no per-key sort."""
    return _pick(df, keys, order, F.min_by)


def last_per(df: DataFrame, keys, order) -> DataFrame:
    return _pick(df, keys, order, F.max_by)


def _sliced(df: DataFrame, keys, order: Sequence[Column], slices: int | None, stored: bool) -> DataFrame:
    """Rows range-partitioned on (keys, order) with their slice number.

    A hot key is spread over many slices. Range bounds are sampled in a job of
    their own, so the input is kept meanwhile (unless it is stored already). The
    result is stored in the shared folder because the slice number must not
    change on a retry.
    """
    kept = df if stored else df.persist()
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = kept.repartitionByRange(n, *[F.col(k) for k in keys], *order)
    out = pin(ranged.withColumn("_slice", F.spark_partition_id()))
    if not stored:
        kept.unpersist()
    return out


def ranged_running(
    df: DataFrame,
    keys,
    order: Sequence[Column],
    sums: Mapping[str, Column],
    slices: int | None = None,
    stored: bool = False,
) -> DataFrame:
    """Running sums inside groups of any size.

    Each slice sums locally, the slice totals (at most one row per key and
    slice) are accumulated, and both parts are added.
    """
    keys = cols(keys)
    sliced = _sliced(df, keys, order, slices, stored)
    local = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(UNB, 0)
    part = sliced.select("*", *[F.sum(e).over(local).alias(f"_l_{c}") for c, e in sums.items()])
    totals = sliced.groupBy(*keys, "_slice").agg(*[F.sum(e).alias(f"_t_{c}") for c, e in sums.items()])
    prior = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(UNB, -1)
    offsets = totals.select(
        *keys, "_slice",
        *[F.coalesce(F.sum(f"_t_{c}").over(prior), F.lit(0)).alias(f"_o_{c}") for c in sums],
    )
    joined = part.join(offsets, [*keys, "_slice"])
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.coalesce(F.col(f"_l_{c}"), F.lit(0)) + F.col(f"_o_{c}")).alias(c) for c in sums],
    )


def ranged_last(df: DataFrame, keys, order, value: str, out: str, slices: int | None = None) -> DataFrame:
    """Last non-null value so far inside groups of any size; ``order`` are ascending column names."""
    keys, order = cols(keys), cols(order)
    sliced = _sliced(df, keys, [F.col(c) for c in order], slices, False)
    local = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(UNB, 0)
    part = sliced.withColumn("_l", F.last(value, True).over(local))
    ends = sliced.filter(F.col(value).isNotNull()).groupBy(*keys, "_slice").agg(F.max_by(value, F.struct(*order)).alias("_e"))
    marks = sliced.select(*keys, "_slice").distinct().join(ends, [*keys, "_slice"], "left")
    prior = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(UNB, -1)
    carry = marks.select(*keys, "_slice", F.last("_e", True).over(prior).alias("_c"))
    return part.join(carry, [*keys, "_slice"]).select(*df.columns, F.coalesce("_l", "_c").alias(out))
