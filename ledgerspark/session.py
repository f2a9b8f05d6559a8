"""Session defaults for local runs and tests, and the shared scratch folder.

On a cluster the session comes from the platform. Defaults are given to the builder only
for keys that are set nowhere yet, and never change a session that already runs.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "ledgerspark") -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    wanted = dict(_DEFAULTS)
    if shuffle_partitions:
        wanted["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if memory := os.environ.get("LEDGERSPARK_DRIVER_MEMORY"):
        wanted["spark.driver.memory"] = memory
    SparkContext._ensure_initialized()
    known = SparkConf()  # what spark-submit and spark-defaults have set
    builder = SparkSession.builder.appName(app_name)
    if master and not known.contains("spark.master"):
        builder = builder.master(master)
    for k, v in wanted.items():
        if not known.contains(k):
            builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names. Only where it is unset and Spark
    runs in this one process (tests) is a scratch folder made; a cluster without it is an error."""
    sc = spark.sparkContext
    if current := sc.getCheckpointDir():
        return current
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="ledgerspark-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """``df`` written to the shared folder and read again: what is scanned several times is computed once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Executions that begin inside remove their shuffle files when they end, for steps whose result is stored by then. Spark
    would keep them until the driver happens to collect its garbage. Not for several threads at once: it is a session setting."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a stored intermediate result that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
