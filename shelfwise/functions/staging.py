"""Written intermediate tables in the shared checkpoint folder of the cluster.

A staged table is computed once, survives the loss of executors, and gives later plans file statistics and column pruning.
"""
from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import TypeVar

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Of staged and clean Parquet files: smaller than Spark's default at little CPU time.
CODEC = "zstd"
Result = TypeVar("Result")


def _is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """Folder named by the session or its context. One is made up in local mode only, where driver and executors are one process."""
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not _is_local(spark):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="run-")
        spark.conf.set(CHECKPOINT_CONF, folder)
    return folder.rstrip("/")


def _application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/staged/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path nobody has used yet, grouped by application so that operators can expire it as a whole."""
    return f"{_application_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _hadoop_path(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def exists(spark: SparkSession, path: str) -> bool:
    system, there = _hadoop_path(spark, path)
    return system.exists(there)


def remove(spark: SparkSession, path: str) -> None:
    system, there = _hadoop_path(spark, path)
    system.delete(there, True)


def drop_staged(spark: SparkSession) -> None:
    """Remove everything this application has staged; frames that still read it can no longer be computed."""
    remove(spark, _application_folder(spark))


def together(*jobs: Callable[[], Result]) -> list[Result]:
    """Run independent Spark actions at the same time; the first failure is raised."""
    with ThreadPoolExecutor(max_workers=max(len(jobs), 1)) as pool:
        return [future.result() for future in [pool.submit(job) for job in jobs]]


_setting_lock = threading.Lock()
_setting_users: dict[int, int] = {}
_setting_before: dict[int, str | None] = {}


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a job that ends in a written table are of no use after it.

    The setting belongs to the session: the first of several stages at once sets it, the last one puts the old value back.
    """
    key = id(spark._jsparkSession)
    with _setting_lock:
        if not _setting_users.get(key):
            _setting_before[key] = spark.conf.get(CLEANUP_CONF, None)
            spark.conf.set(CLEANUP_CONF, "true")
        _setting_users[key] = _setting_users.get(key, 0) + 1
    try:
        yield
    finally:
        with _setting_lock:
            _setting_users[key] -= 1
            if not _setting_users[key]:
                before = _setting_before.pop(key)
                if before is None:
                    spark.conf.unset(CLEANUP_CONF)
                else:
                    spark.conf.set(CLEANUP_CONF, before)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write the frame once and continue from the files. A copy without the mark of a finished job is never read."""
    spark = df.sparkSession
    path = new_path(spark, label)
    with _shuffles_removed(spark):
        df.write.option("compression", CODEC).parquet(path)
    return staged(spark, path, df)


def staged(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The staged copy at `path`, with the schema of the frame it was written from."""
    if not exists(spark, f"{path}/_SUCCESS"):
        raise RuntimeError(f"{path} was not written to the end, or not to a folder that the driver sees")
    return spark.read.schema(like.schema).parquet(path)
