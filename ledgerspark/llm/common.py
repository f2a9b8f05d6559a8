"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.session import checkpoint_dir, scratch_path

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_BITMAP_BITS = 1 << 22  # half a megabyte in a plan
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application: functions in tasks refer to it by
    name, and a cluster need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="ledgerspark-ship-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Executions that begin inside remove their shuffle files when they end: their result is
    stored in the shared folder by then."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Executions inside hand whole texts to Python at most ``rows`` at a time: a worker holds a batch twice or more."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release_memory() -> None:
    """Give what this process has freed back to the system. A Python worker outlives its tasks, and the allocators keep
    most of what a task's arrays took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint in the shared folder: survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    with _shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = scratch_path(spark, "stored")
    with _shuffles_dropped(spark):
        df.select("*").write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(rows: DataFrame, keys: DataFrame, on: list[str], once: str | None = None) -> DataFrame:
    """``rows`` whose ``on`` columns (null equals null) are not in ``keys``. Where ``keys`` has a boolean column named ``once``
    that is true, one row of the key stays.

    The rows are wide and most stay: a bitmap of the keys' hashes, of bounded size, lets the rows through that cannot be
    meant, where they are; only the others move to be joined. A table with more keys than the bitmap has room for joins
    more rows, with the same result."""
    keys = cut_lineage(keys.select(*on, *([once] if once else [])))
    n = keys.count()
    if not n:
        return rows
    bits = min(_BITMAP_BITS, max(1 << 10, 1 << (16 * n).bit_length()))
    at = F.pmod(F.xxhash64(*on), F.lit(bits))
    words = keys.select(at.alias("at")).groupBy((F.col("at") / 8).cast("int").alias("byte")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("at") % 8).cast("int"))).alias("set")).toPandas()  # at most _BITMAP_BITS / 8 rows
    bitmap = bytearray(bits // 8)
    for byte, value in zip(words["byte"].tolist(), words["set"].tolist()):
        bitmap[byte] = value
    held = F.conv(F.hex(F.substring(F.lit(bytes(bitmap)), (at / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    may = F.getbit(held, (at % 8).cast("int")) == 1
    own = keys.select(*[F.col(c).alias(f"_k_{c}") for c in on], *([F.col(once).alias("_once")] if once else []))
    same = None
    for c in on:
        same = F.col(c).eqNullSafe(F.col(f"_k_{c}")) if same is None else same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    others, meant = rows.where(~may), rows.where(may)
    if once is None:
        return others.unionByName(meant.join(own, same, "left_anti"))
    told = meant.join(own.withColumn("_told", F.lit(True)), same, "left")
    free = told.where("_told IS NULL").select(*rows.columns)
    return others.unionByName(free).unionByName(told.where("_told AND _once").dropDuplicates(on).select(*rows.columns))
