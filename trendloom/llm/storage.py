"""Tables that cut lineage, written to the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS = 1000
#: This process's part of the shared folder; it is removed when the process ends.
_OWN = uuid.uuid4().hex
_registered: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where a local session names none (tests), one of our own."""
    found = spark.conf.get(SETTING, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="trendloom-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        found = f"file://{made}"
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    folder = f"{shared_dir(spark)}/trendloom/{_OWN}"
    if folder not in _registered:
        _registered.add(folder)
        atexit.register(_at_exit, spark, folder)
    return f"{folder}/{tag}-{uuid.uuid4().hex}"


def _at_exit(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        remove(spark, folder)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of ROWS rows at most: rows are texts, of which ten thousand take more memory than a task needs at a time."""
    found = spark.conf.get(BATCHES)
    spark.conf.set(BATCHES, str(min(int(found), ROWS) if int(found) > 0 else ROWS))
    try:
        yield
    finally:
        spark.conf.set(BATCHES, found)


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back, so a lost executor costs no recomputation before it."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    with small_batches(spark):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._trendloom_path = path
    return back


def drop(*tables: DataFrame) -> None:
    """Remove tables made by cut() that no later plan reads."""
    for df in tables:
        path = getattr(df, "_trendloom_path", None)
        if path:
            remove(df.sparkSession, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that cut() has made tables of and that nothing refers to any more.

    Spark does that when its references are collected, for which there is no call but a hint; only disk depends on it.
    """
    gc.collect()
    spark._jvm.System.gc()
