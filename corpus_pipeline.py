"""From raw documents to packed training sequences, one written table per stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vacancia.llm import language, near, packing, pseudonyms
from vacancia.llm.queries import BYTE_VOCABULARY, PSEUDONYM_KEY
from vacancia.llm.tables import fresh, read
from vacancia.sources.workspace import new_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language go on.

    Null texts, texts without letters and those that the network puts into its noise class
    (in no language that it learned) are rejected. An error if there are texts with letters
    but no labelled one to learn from.
    """
    label, score = fresh(docs.columns, "lang_pred", "score")
    model = language.fit(docs, noise=True)
    if model is None and not docs.where(F.col("text").rlike(r"\p{L}")).isEmpty():
        raise ValueError("no document with a language to learn from")
    seen = language.predict(docs, model, label=label, score=score)
    return seen.where(F.col(label) != language.UNKNOWN).drop(label, score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id."""
    return near.keep_one(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by format-preserving pseudonyms; n_chars follows the text."""
    hidden = pseudonyms.pseudonymize(docs, PSEUDONYM_KEY, count_col=None)
    if "n_chars" not in docs.columns:
        return hidden
    return hidden.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text"))
                             .cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Everything kept, packed into windows of 2048 tokens."""
    return packing.pack(docs, BYTE_VOCABULARY, end_id=1)


STAGES = [("language ID", identify_language), ("n-gram Jaccard join", drop_near_duplicates),
          ("PII", hide_personal_data), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
