"""Structured Streaming forms of ingest, dedupe and weekly counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.keys import add_norm_columns
from ..operators.merge import fresh_rows_by_index, merge_index
from ..sources.readers import path_exists


def read_stream(spark: SparkSession, folder: str, schema, glob: str | None = None,
                files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, a few files per batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(folder)


def incremental_ingest(stream: DataFrame, table: str, checkpoint: str, order: str = "seq",
                       id_col: str = "id", index: str | None = None):
    """Append the rows of each batch that the table does not hold yet.

    What the table holds is looked up in an index of its keys (by default beside the
    table), so the cost of a batch does not grow with the rows stored before; a
    table without an index gets one when the first batch comes. Each batch has its own
    folders, named by the batch number: a batch that is replayed after a failure
    replaces its own folders and sees only the batches before it, so the table
    comes out the same.
    """
    index = index or f"{table.rstrip('/')}-keys"

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keys = merge_index(spark, index, id_col)
        stored = StructType([*batch.schema.fields, StructField("batch", IntegerType())])

        def index_rows(rows: DataFrame, n: int) -> None:
            named = rows if id_col in rows.columns else rows.withColumn(id_col, F.lit(None).cast("string"))
            keys.add(add_norm_columns(named), n)
        if path_exists(spark, table) and not path_exists(spark, index):
            before = spark.read.schema(stored).parquet(table).where(F.col("batch") < number)
            index_rows(before.drop("batch"), -1)
        rows = fresh_rows_by_index(keys, batch, number, order, id_col)
        rows.write.mode("overwrite").parquet(f"{table}/batch={number}")
        index_rows(spark.read.schema(batch.schema).parquet(f"{table}/batch={number}"), number)

    return (stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def dedupe_stream(stream: DataFrame, keys, posted: str, delay: str = "1 hour") -> DataFrame:
    """First row per key; a key is remembered for the delay, later rows of a
    time before the watermark are dropped."""
    timed = stream.withColumn(posted, F.col(posted).cast("timestamp"))
    return timed.withWatermark(posted, delay).dropDuplicatesWithinWatermark(list(keys))


def weekly_counts(stream: DataFrame, key: str, posted: str, delay: str = "7 days") -> DataFrame:
    """Rows per Monday week and key. 1970-01-05 was a Monday, hence the start."""
    timed = stream.withColumn(posted, F.col(posted).cast("timestamp"))
    week = F.window(posted, "7 days", startTime="4 days")
    return (timed.withWatermark(posted, delay).groupBy(week, key)
            .agg(F.count("*").alias("count"))
            .select(F.to_date("window.start").alias("week"), key, "count"))


def write_stream(stream: DataFrame, table: str, checkpoint: str, mode: str = "append"):
    """Run over all available input and stop."""
    return (stream.writeStream.format("parquet").outputMode(mode).option("path", table)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def write_result(stream: DataFrame, table: str, checkpoint: str):
    """Like `write_stream`, for aggregates whose open windows count as well:
    each batch replaces the whole (reduced) result under its own number."""
    def put(result: DataFrame, number: int) -> None:
        result.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return (stream.writeStream.foreachBatch(put).outputMode("complete")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_result(spark: SparkSession, table: str) -> DataFrame:
    rows = spark.read.parquet(table)
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).scalar()).drop("batch")
