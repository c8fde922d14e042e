"""Helpers the operators share: reading, cutting lineage, gapless numbers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vacancia.sources.workspace import shared_folder


def on_workers(spark: SparkSession) -> None:
    """Let Python workers started from here on find this library beside the driver's copy.

    On machines without that folder it has to be installed or sent along (--py-files).
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder.

    Rows and partitions are fixed from here on, whatever executor is lost;
    Spark deletes the files when the frame is gone, if told to
    (spark.cleaner.referenceTracking.cleanCheckpoints).
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def fresh(columns, *names: str) -> list[str]:
    """Column names like the given ones that clash with none of the columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def gapless(df: DataFrame, groups: list[str], number: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps, and without bringing a group together.

    Only counts per (task, group) are summed up along a group; its rows are
    numbered within their task and moved up by the sum of the tasks before.
    `df` must be the result of `cut`, else its tasks are not fixed. The order
    is that of its partitions.
    """
    part, place, before, n = fresh(df.columns, "part", "place", "before", "n")
    rows = (df.withColumn(part, F.spark_partition_id())
            .withColumn(place, F.monotonically_increasing_id()))
    counts = rows.groupBy(part, *groups).agg(F.count(F.lit(1)).alias(n))
    up_to = Window.partitionBy(*groups).orderBy(part).rowsBetween(
        Window.unboundedPreceding, -1)
    starts = counts.select(part, *groups, F.coalesce(F.sum(n).over(up_to), F.lit(0)).alias(before))
    inside = Window.partitionBy(part, *groups).orderBy(place)
    return (rows.withColumn(number, F.row_number().over(inside) - 1)
            .join(starts, [part, *groups])
            .withColumn(number, F.col(number).cast("long") + F.col(before))
            .drop(part, place, before))


def vocabulary_file(name: str) -> str:
    """Where a vocabulary file lies on the machine that asks."""
    import public_tokenizers
    return public_tokenizers.path(name)
