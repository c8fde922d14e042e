"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder; on a
    cluster a folder of one machine would not be seen by the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="vacancia-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path nobody has written to yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by=()) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here,
    and a lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if (scratch := _SCRATCH.get()) is not None:
        scratch.append(path)
    rows = df.hint("rebalance", *partition_by) if partition_by else df
    rows.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of any file system Spark knows, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Inside, shuffle files go with the query that wrote them and materialized tables at the end.

    For jobs that write their results: no lazy table that reads a materialized one may leave.
    """
    before, paths = spark.conf.get(_CLEANUP, None), []
    token = _SCRATCH.set(paths)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
        for path in paths:
            remove(spark, path)
