"""Session construction and the shared folder that survives executor loss."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def build_session(app: str = "sessionloom", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, skew join)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ship_package(spark)
    return spark


def is_local(spark: SparkSession) -> bool:
    """True if driver and executors are one process on one machine."""
    return bool(re.match(r"local(\[|$)", spark.sparkContext.master))


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, so that grouped functions import it from any working folder (once per application)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.gettempdir(), f"{os.path.basename(here)}-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(here):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(target)
    atexit.register(os.remove, target)  # executors fetch it when they start


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names in ``spark.checkpoint.dir``.

    In local mode, where driver and executors are one process, an unset folder is
    set to one below the system's temporary folder. Anywhere else it has to be
    set: a machine-local folder would lose rows silently.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = os.path.join(tempfile.gettempdir(), f"sessionloom-{spark.sparkContext.applicationId}")
    os.makedirs(own, exist_ok=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under :func:`shared_dir`, in this application's own folder."""
    return f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def clean_scratch(spark: SparkSession) -> None:
    """Remove this application's folder under :func:`shared_dir`; frames that read from it are void afterwards."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def pin(df: DataFrame, rows_a_file: int = 0) -> DataFrame:
    """Cut lineage by writing the rows to the shared folder and reading them back.

    A retried task then sees the same rows, later scans read only the columns
    they need, and join planning knows the real size. ``rows_a_file``: at most so
    many rows in a file; a reader decodes many rows of a file at once.
    """
    path = scratch_path(df.sparkSession, "pin")
    df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pin_by_row(df: DataFrame) -> DataFrame:
    """:func:`pin` for Python steps that are given large rows: each is an Arrow batch of its own, so a task holds one at a time."""
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        return pin(df)
    finally:
        spark.conf.set(name, before)
