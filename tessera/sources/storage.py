"""Shared storage: where intermediate tables go so that a lost executor cannot take them along."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []
_FOLDERS: dict[tuple[str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that all executors share (spark.checkpoint.dir). Where it is unset, a folder of this machine does
    for a local master; on a cluster that is an error, because the executors would not see each other's files."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        given = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(given)
    return given if "://" in given else "file://" + os.path.abspath(given)


def _own_folder(spark: SparkSession) -> str:
    """The folder of this application in the shared one; the JVM deletes it when it ends: also after spark.stop(), and when Python
    did not end well."""
    shared = shared_dir(spark).rstrip("/")
    path = _FOLDERS.get((spark.sparkContext.applicationId, shared))
    if path is None:
        path = f"{shared}/tessera-{uuid.uuid4().hex}"
        file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(file)
        fs.deleteOnExit(file)
        _FOLDERS[spark.sparkContext.applicationId, shared] = path
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, for release() to delete, or else the end of the application's JVM."""
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def settled(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept as a table in the shared folder.

    A written table and not checkpoint(): its readers prune columns, and it starts a fresh plan, where a checkpoint hands
    on the constraints of the plan before it, which grow with every round of an iteration."""
    path = scratch(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(file, True)


def release(spark: SparkSession) -> None:
    """Deletes what this process has put at scratch() paths. Results that still read it are lost."""
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop()[1])


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was put at scratch() paths inside it; what must stay is written out within."""
    before = len(_WRITTEN)
    try:
        yield
    finally:
        while len(_WRITTEN) > before:
            _delete(spark, _WRITTEN.pop()[1])
