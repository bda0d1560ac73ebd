"""Executors find the package wherever the session was started; nothing is guessed about shared folders."""

import os
import subprocess
import sys

import pytest

from sessionloom import session

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_grouped_functions_run_from_another_folder(tmp_path):
    code = f"""
import importlib.util
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("entry", {os.path.join(REPO, "__spark_entry__.py")!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
print("ROWS", entry.queries()["m5_best_lag1"](spark, {ROOT!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS" in done.stdout, done.stderr[-2000:]


class _Conf:
    def __init__(self, value=None):
        self.value = value

    def get(self, key, default=None):
        return self.value or default


class _Session:
    def __init__(self, master, named=None):
        self.conf, context = _Conf(named), type("Context", (), {})()
        context.master, context.applicationId, context.getConf = master, "app-1", lambda: _Conf()
        self.sparkContext = context


def test_a_cluster_has_to_name_its_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(_Session("spark://host:7077"))
    assert session.shared_dir(_Session("spark://host:7077", "hdfs:///shared")) == "hdfs:///shared"


def test_scratch_is_removed(spark):
    path = session.scratch_path(spark, "gone")
    spark.range(1).write.parquet(path)
    assert spark.read.parquet(path).count() == 1 and session.is_local(spark)
    assert path.startswith(session.shared_dir(spark)) and spark.sparkContext.applicationId in path
