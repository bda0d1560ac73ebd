"""Sinks that give the same table when a batch is delivered again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frames import last_per
from ..session import scratch_path
from ..sources.maintain import upsert_table


def run_available(stream: DataFrame, sink: Callable, checkpoint: str, mode: str = "update"):
    """Process all that has arrived, then stop; progress lives in ``checkpoint``."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = w.foreachBatch(sink).start()
    q.awaitTermination()
    return q


def run_until_idle(stream: DataFrame, sink: Callable, checkpoint: str, mode: str = "append"):
    """Batch after batch until the source has no newer offset, then stop; for sources that limit their batches themselves."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return q


def dropped_rows(query) -> int:
    """Rows that the stateful operators of a finished run dropped as later than the watermark, by the engine's own count.

    Exact for operators that meet single rows (repeats, joins); an aggregate
    counts the partial groups that reach it. Progress is kept for the newest
    batches only (``spark.sql.streaming.numRecentProgressUpdates``).
    """
    return sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)


def batch_folder_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Each batch owns one folder and overwrites it, so a retried batch leaves no second copy."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def upsert_sink(path: str, keys, partition_by: str, order) -> Callable[[DataFrame, int], None]:
    """Ledger-style sink: rows replace stored rows with the same keys; of several in a batch the greatest ``order`` counts.

    A batch rewrites the partitions it touches, so partition by what batches
    have in common (the date), not by what every batch contains (the ticker).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if _exists(spark, path):
            upsert_table(spark, path, batch, keys, partition_by, order)
        else:
            last_per(batch, keys, order).write.partitionBy(partition_by).parquet(path)

    return write


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def latest_by_batch(spark: SparkSession, path: str, keys) -> DataFrame:
    """Newest version of each key written by :func:`batch_folder_sink` in update mode."""
    return last_per(spark.read.option("basePath", path).parquet(path), keys, "batch_id").drop("batch_id")


def materialise(stream: DataFrame, label: str, keys=None, mode: str = "update") -> DataFrame:
    """Run a stream over the available input and return its result table (empty, if no batch had input)."""
    spark = stream.sparkSession
    base = scratch_path(spark, label)
    run_available(stream, batch_folder_sink(f"{base}/data"), f"{base}/checkpoint", mode)
    if not _exists(spark, f"{base}/data"):
        return spark.createDataFrame([], stream.schema)
    if keys is not None:
        return latest_by_batch(spark, f"{base}/data", keys)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{base}/data")


def with_batch(fn: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink that applies a batch operator before writing the batch's folder."""
    write = batch_folder_sink(path)

    def sink(batch: DataFrame, batch_id: int) -> None:
        write(fn(batch), batch_id)

    return sink


def split_late_sink(path: str, event_time: str, delay_seconds: int, delivery: str = "stream", after: str | None = None) -> Callable[[DataFrame, int], None]:
    """Late rows go to ``late``, the others to ``on_time``, each batch to a folder of its own below its delivery's.

    A row is late when it is older than the greatest event time of earlier
    batches minus the delay. Each batch stores the greatest time so far under
    its number, so a batch reads one mark and a retry sees the same one.
    ``after`` names a finished delivery whose last mark this one starts from.
    """
    marks = f"{path}/marks"

    def before(spark: SparkSession, batch_id: int):
        own = f"{marks}/{delivery}/{batch_id - 1}"
        if batch_id > 0 and _exists(spark, own):
            return spark.read.schema("hi timestamp").parquet(own)
        if after is not None:
            return spark.read.schema("hi timestamp").option("recursiveFileLookup", True).parquet(f"{marks}/{after}")
        return spark.createDataFrame([], "hi timestamp")

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()  # written in three parts
        seen = before(spark, batch_id)
        late = F.coalesce(F.col(event_time) < seen.agg(F.max("hi")).scalar() - F.make_dt_interval(secs=F.lit(delay_seconds)), F.lit(False))
        d = batch.withColumn("_late", late)
        for name, part in (("on_time", d.filter(~F.col("_late"))), ("late", d.filter("_late"))):
            part.drop("_late").write.mode("overwrite").parquet(f"{path}/{name}/delivery={delivery}/batch_id={batch_id}")
        top = batch.select(F.col(event_time).alias("hi")).unionByName(seen).agg(F.max("hi").alias("hi"))
        top.write.mode("overwrite").parquet(f"{marks}/{delivery}/{batch_id}")
        batch.unpersist()

    return sink
