"""Table maintenance: increments, upserts, watermarks, repairs.

Merges are DataFrame -> DataFrame; :func:`upsert_table` is the writing form and
rewrites only the partitions that receive updates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frames import END, UNB, by, cols, last_per
from ..functions.dates import business_days
from ..session import pin


#: Status of a carried row (fixed value: readers of the ledger look for it).
CARRIED = "CARRYOVER (100% HOLD)"


def merge_sources(primary: DataFrame, *backups: DataFrame, keys=("ticker", "date"), value="close") -> DataFrame:
    """Per key the row of the best-ranked source that has ``value``; copies combine before the shuffle."""
    parts = [d.withColumn("_rank", F.lit(i)) for i, d in enumerate((primary, *backups))]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    k = cols(keys)
    rest = [c for c in both.columns if c not in (*k, "_rank")]
    ok = both.filter(F.col(value).isNotNull())
    best = ok.groupBy(*k).agg(F.min_by(F.struct(*rest), "_rank").alias("_r"), F.min("_rank").alias("source_rank"))
    return best.select(*k, *[F.col("_r")[c].alias(c) for c in rest], "source_rank")


def quarantined(wanted: DataFrame, merged: DataFrame, on="ticker") -> DataFrame:
    return wanted.join(merged.select(*cols(on)).distinct(), cols(on), "left_anti")


def append_increment(existing: DataFrame, new: DataFrame, key="ticker", date="date") -> DataFrame:
    """Rows of ``new`` after each key's last stored date, added to the stored rows once per (key, date)."""
    last = existing.groupBy(key).agg(F.max(date).alias("_last"))
    fresh = new.join(last, key, "left").filter(F.col("_last").isNull() | (F.col(date) > F.col("_last"))).drop("_last")
    once = last_per(fresh, [key, date], [c for c in fresh.columns if c not in (key, date)])
    return existing.unionByName(once)


def upsert(target: DataFrame, updates: DataFrame, keys, order) -> DataFrame:
    """Last write wins per key; among updates the greatest ``order`` wins (its columns may be left out of the target)."""
    k = cols(keys)
    updates = last_per(updates, k, order).drop(*[c for c in cols(order) if c not in target.columns])
    both = target.withColumn("_v", F.lit(0)).unionByName(updates.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    return last_per(both, k, "_v").drop("_v")


def upsert_table(spark: SparkSession, path: str, updates: DataFrame, keys, partition_by: str, order) -> None:
    """Upsert into a Parquet table partitioned by a key column; untouched partitions stay as they are.

    The partition pruning comes from the join on ``partition_by``; the merged
    rows are pinned before the partitions they came from are replaced.
    """
    stored = spark.read.parquet(path)
    touched = updates.select(partition_by).distinct()
    merged = pin(upsert(stored.join(touched, partition_by, "left_semi"), updates, keys, order))
    (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).parquet(path))


def advance_watermark(table: DataFrame, name: str, date) -> DataFrame:
    new = table.sparkSession.createDataFrame([(name, date)], "pipeline_name string, last_completed_date date")
    return upsert(table, new, "pipeline_name", "last_completed_date")


def read_watermark(table: DataFrame, name: str) -> DataFrame:
    return table.filter(F.col("pipeline_name") == name).select("last_completed_date")


def compile_scorecards(spark: SparkSession, *paths: str) -> DataFrame:
    """All sheets below the given folders in one scan; a column that a sheet lacks is null there."""
    return spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(*paths)


def backfill_defaults(df: DataFrame, start: float = 10000.0, money=("cash", "total_equity"), json=("holdings_json", "daily_pnl_json")) -> DataFrame:
    return df.na.fill(start, list(money)).na.fill("{}", list(json))


def carry_forward(ledger: DataFrame, sessions: DataFrame, key="persona", date="date", status="intraday_status") -> DataFrame:
    """A row for every session after a key's first; missing ones copy the last row with a carry-over status."""
    span = ledger.groupBy(key).agg(F.min(date).alias("_a"))
    days = span.withColumn("_z", sessions.agg(F.max("session")).scalar())
    days = days.select(key, F.explode(business_days(F.col("_a"), F.col("_z"))).alias(date))
    grid = days.join(sessions.select(F.col("session").alias(date)), date, "left_semi")
    j = grid.join(ledger.withColumn("_here", F.lit(True)), [key, date], "left")
    w = by(key, date).rowsBetween(UNB, 0)
    rest = [c for c in ledger.columns if c not in (key, date, status)]
    return j.select(key, date, *[F.last(c, True).over(w).alias(c) for c in rest],
                    F.when(F.col("_here"), F.col(status)).otherwise(CARRIED).alias(status))


def heal_gaps(dense: DataFrame, interpolate, hold, keys=("ticker",), date="date") -> DataFrame:
    """Missing values on a full calendar: ``interpolate`` columns take the mean of both neighbours, ``hold`` the last."""
    k = cols(keys)
    back = by(k, date).rowsBetween(UNB, 0)
    ahead = by(k, date).rowsBetween(0, END)

    def mean(c) -> Column:
        a, b = F.last(c, True).over(back), F.first(c, True).over(ahead)
        return F.coalesce(F.col(c), (a + b) / 2, a)

    return dense.select(*k, date, *[mean(c).alias(c) for c in cols(interpolate)],
                        *[F.last(c, True).over(back).alias(c) for c in cols(hold)])
