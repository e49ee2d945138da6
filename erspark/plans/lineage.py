"""Cutting lineage: reliable checkpoints and scratch tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


#: Shuffle files are removed at the end of the action that wrote them, not when the driver happens to collect its garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; a local one is set only where the session names none (tests)."""
    spark.conf.set(RELEASE, "true")
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="erspark-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: the rows are written once to the shared folder and read back by later plans."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if made := getattr(_scopes, "made", None):
        made[-1].append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back. Columnar and compressed, so better than
    ``cut`` for wide or large intermediate tables, and later plans see true file sizes."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Per thread, the scratch paths of the scopes that are open.
_scopes = threading.local()


def replaced(spark: SparkSession, make: Callable[[], DataFrame], name: str, before: str | None = None) -> tuple[DataFrame, str]:
    """The rows of ``make()``, stored, and their path. Once they are written, the scratch tables that ``make`` has stored on the way are removed, and
    the table at ``before``, which its plan read, too: a chain of steps holds two tables at a time. If it fails, ``before`` stays."""
    _scopes.made = [*getattr(_scopes, "made", []), []]
    try:
        path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        made = make()
        made.write.parquet(path)
    finally:
        for scratch in _scopes.made.pop():
            removed(spark, scratch)
    if before:
        removed(spark, before)
    return spark.read.schema(made.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def small_batches(spark: SparkSession, rows: int = 1024, size: str = "16m") -> None:
    """Bound the Arrow batches that Python workers receive, in rows and bytes, so long texts don't add up."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
