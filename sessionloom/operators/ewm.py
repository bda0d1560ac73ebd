"""Exponentially weighted means in closed form, without a UDF.

With q = 1/(1-alpha) the weighted mean is sum(x*q^i) / sum(q^i), two plain
running sums. q^i would overflow on long histories, so rows are cut into chunks;
each chunk repeats the ``WARM`` rows before it, whose remaining weight is far
below double precision, and restarts ``i``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import KEYS, UNB, by, cols

CHUNK = 2048
WARM = 1024


def chunked(df: DataFrame, keys=KEYS, order="date") -> DataFrame:
    """Adds _row (1-based), _chunk, _i (position in chunk) and _warm; warm rows are copies."""
    k = cols(keys)
    d = df.withColumn("_row", F.row_number().over(by(k, order)))
    home = F.floor((F.col("_row") - 1) / CHUNK)
    lead_in = (F.col("_row") - 1) % CHUNK >= CHUNK - WARM
    d = d.withColumn("_chunk", F.explode(F.when(lead_in, F.array(home, home + 1)).otherwise(F.array(home))))
    warm = F.col("_chunk") != home
    offset = F.when(F.col("_chunk") == 0, 0).otherwise(F.col("_chunk") * CHUNK - WARM)
    return d.withColumns({"_i": (F.col("_row") - offset).cast("double"), "_warm": warm})


def chunk_window(keys=KEYS, order="date"):
    return by([*cols(keys), "_chunk"], order).rowsBetween(UNB, 0)


def unchunk(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("_warm")).drop("_row", "_chunk", "_i", "_warm")


def adjusted(x: Column, alpha: float, min_periods: int, keys=KEYS, order="date") -> Column:
    """Expression over a chunked frame; later chunks have passed ``min_periods`` in their lead-in."""
    w = chunk_window(keys, order)
    q = F.pow(F.lit(1.0 / (1.0 - alpha)), F.col("_i"))
    num = F.sum(x * q).over(w)
    den = F.sum(F.when(x.isNotNull(), q)).over(w)
    return F.when(F.count(x).over(w) >= min_periods, F.try_divide(num, den))


def recursive(x: Column, alpha: float, keys=KEYS, order="date") -> Column:
    """y0 = x0, y = alpha*x + (1-alpha)*y; needs a null-free series."""
    w = chunk_window(keys, order)
    q = F.lit(1.0 / (1.0 - alpha))
    seed = F.col("_i") == 1
    num = F.sum(F.when(seed, x).otherwise(alpha * x) * F.pow(q, F.col("_i") - 1)).over(w)
    return num / F.pow(q, F.col("_i") - 1)


def ewm_adjusted(df, value, alpha: float, min_periods: int, out="ewm", keys=KEYS, order="date") -> DataFrame:
    d = chunked(df, keys, order)
    return unchunk(d.withColumn(out, adjusted(F.col(value), alpha, min_periods, keys, order)))


def ewm_recursive(df, value, alpha: float, out="ewm", keys=KEYS, order="date") -> DataFrame:
    d = chunked(df, keys, order)
    return unchunk(d.withColumn(out, recursive(F.col(value), alpha, keys, order)))
