"""Tick sources with event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def read_ticks(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table (one file, a folder of part files, or a glob of either) as a stream of ticks; the schema is fixed."""
    r = spark.readStream.schema(schemas.TICKS)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    path = path.rstrip("/")
    if not any(c in path for c in "*?[{"):
        path = f"{path[:-1]}[{path[-1]}]"  # as a pattern of that one name: only then is a single file taken as well as a folder
    return as_ticks(r.parquet(path))


def as_ticks(events: DataFrame) -> DataFrame:
    """Watermarks need an instant, so the session time zone must be UTC (see ``build_session``)."""
    return events.select(
        F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
        F.col("value").alias("price"), F.lit(1.0).alias("size"), F.col("user_id").alias("user"))


def read_kafka_ticks(spark: SparkSession, servers: str, topic: str, **options) -> DataFrame:
    """The same ticks from JSON messages; needs the public Kafka connector on the class path."""
    r = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    raw = r.options(**options).load().select(F.from_json(F.col("value").cast("string"), schemas.TICKS).alias("e"))
    return as_ticks(raw.select("e.*"))
