"""Look-ups whose hot keys AQE can split."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(rows: DataFrame, table: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row per ``on`` (whole numbers, not null).

    A table that was just aggregated on the join key joins without an exchange of
    its own, and then AQE cannot split a hot key of ``rows``. Joining on a hash of
    the key, with the key itself as a further condition, gives both sides one.
    """
    on = [on] if isinstance(on, str) else on
    rest = [c for c in table.columns if c not in on]
    right = table.select(F.xxhash64(*on).alias("_lk"), *[F.col(c).alias(f"_k_{c}") for c in on], *rest)
    left = rows.withColumn("_lh", F.xxhash64(*on))
    same = reduce(lambda a, b: a & b, [F.col(c).bitwiseXOR(F.col(f"_k_{c}")) == 0 for c in on])
    out = left.join(right, (F.col("_lh") == F.col("_lk")) & same, how)
    return out.select(*rows.columns, *rest)
