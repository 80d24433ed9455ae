"""The folder that the driver and all executors share, for tables that an operator must read twice."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

#: Paths given out by this process, deleted at its end.
_given: list[str] = []


def at_once(calls: Iterable[Callable[[], Any]]) -> list:
    """What the calls return, in their order; they run side by side, so that small jobs don't wait for each
    other.  All are ended when the first failure, if any, is raised."""
    calls = list(calls)
    with ThreadPoolExecutor(max(1, min(8, len(calls)))) as pool:
        waiting = [pool.submit(inheritable_thread_target(c)) for c in calls]
    return [w.result() for w in waiting]


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; a folder of this machine only where the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="atlasframe-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).rename(where, spark._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"{path} can't be moved to {to}")


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing is at.  Its own parent folder is deleted when the JVM ends,
    with or without a session."""
    name = uuid.uuid4().hex
    parent = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/scratch-{name}")
    store = parent.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(parent)
    store.deleteOnExit(parent)
    _given.append(f"{parent.toString()}/{name}")
    return _given[-1]


def written(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: later uses don't compute it again."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Delete what is at a path given out, once nothing reads it any more."""
    delete(spark, path.rsplit("/", 1)[0])
    _given.remove(path)


def forget_written(df: DataFrame) -> None:
    """Delete the table behind ``df``, once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        for path in [p for p in _given if folder.endswith(p.rsplit("/", 1)[1])]:
            forget(df.sparkSession, path)


def given() -> tuple[str, ...]:
    return tuple(_given)
