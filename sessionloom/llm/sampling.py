"""Bounded labelled samples for the models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def labelled_sample(rows: DataFrame, label: str, id_col: str, per_class: int) -> DataFrame:
    """About ``per_class`` rows of each label (at most twice as many in all); no label is left out.

    With more than 64 labels fewer rows of each are taken, as many in all as for
    64, but not below 100 (or ``per_class``) of each. Rows are picked by a hash of
    the id, so the pick is the same in every run and spread over the whole table.
    """
    counts = rows.groupBy(label).count().filter(F.col(label).isNotNull()).collect()
    if not counts:
        return rows.limit(0)
    each = max(min(per_class, 100), min(per_class, 64 * per_class // len(counts)))
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r[0], each / r["count"])])
    return rows.filter(F.col(label).isNotNull() & (draw < F.try_element_at(share, F.col(label)))).limit(2 * each * len(counts))
