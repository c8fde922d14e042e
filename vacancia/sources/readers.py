"""Scans: CSV and Parquet postings, fallback chain, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.fixed_values import NULL_TOKENS
from .schema import RAW_POSTINGS


def path_exists(spark: SparkSession, path: str) -> bool:
    """Is there a file or folder at a path of any file system Spark knows?"""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_postings(spark: SparkSession, path: str, schema: StructType = RAW_POSTINGS,
                    null_tokens=NULL_TOKENS, multi_line: bool = True) -> DataFrame:
    """CSV postings with a header, read by column name.

    Fields may hold quotes and, with `multi_line`, line breaks; without it a
    large file is split over tasks. The usual tokens for missing text become
    null as they stand, blanks around them are text; text that does not parse
    as its type becomes null. Any path Spark can open works, an object store
    included (s3a://...). Files of one folder must have the same columns; read
    others one by one and union them (`union_all`).
    """
    text = (spark.read.option("header", True).option("multiLine", multi_line)
            .option("quote", '"').option("escape", '"').option("enforceSchema", False))
    names = text.option("inferSchema", False).csv(path).columns
    types = {f.name: f.dataType for f in schema}
    raw = text.schema(StructType([StructField(n, StringType()) for n in names])).csv(path)

    def typed(name: str):
        value = F.col(f"`{name}`")
        value = F.when(~value.isin(*null_tokens), value)
        kind = types.get(name, StringType())
        return value if kind == StringType() else F.trim(value).try_cast(kind)

    return raw.select(*[typed(n).alias(n) for n in names])


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_first_available(spark: SparkSession, paths, schema: StructType = RAW_POSTINGS) -> DataFrame:
    """The first path that exists (CSV by its ending, else Parquet); with none,
    an empty table of the schema.

    A store that cannot be reached is an error: taken for an empty one, the
    next snapshot would lack all of its rows.
    """
    for path in paths:
        if path_exists(spark, path):
            return (read_postings(spark, path, schema) if path.rstrip("/").endswith(".csv")
                    else read_table(spark, path))
    return spark.createDataFrame([], schema)


def read_snapshot(spark: SparkSession, base: str, stamp: str | None = None) -> DataFrame:
    """One snapshot, the newest by default. Stamps sort as text."""
    rows = spark.read.option("basePath", base).parquet(f"{base}/snapshot=*")
    rows = rows.withColumn("snapshot", F.col("snapshot").cast("string"))
    newest = rows.agg(F.max("snapshot")).scalar() if stamp is None else F.lit(stamp)
    return rows.where(F.col("snapshot") == newest).drop("snapshot")


def read_collected(spark: SparkSession, base: str) -> DataFrame:
    """Parts stored as base/term=.../place=.../..., with their provenance: the
    folder names and the file each row came from."""
    return spark.read.parquet(base).withColumn("source_file", F.col("_metadata.file_path"))
