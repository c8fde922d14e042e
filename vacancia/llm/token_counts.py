"""Token counts without the token ids of any text.

Three tables: the pre-token frequencies of every document, stored once; the
distinct pre-tokens with the number of pieces the model cuts each into, asked
once for the whole table; and their join, summed per document. The model's
pieces of one pre-token are made to be counted; those of a text never are.

Pre-tokens are as unequal as words: a few stand in most documents. The most
frequent ones (COMMON at most, by a key of at most 64 bytes) are joined by broadcast,
so they meet the documents where those lie; any other holds less than one
COMMONth of all rows, so the shuffled join has no hot key.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vacancia.sources.workspace import new_path

from .pretokens import Pretokenizer
from .tables import vocabulary_file
from .words import slices

COMMON = 65_536  # pre-tokens joined by broadcast: at most 64 bytes and a number each


@lru_cache(maxsize=1)
def cutter_of(vocabulary: str) -> Pretokenizer:
    """Of the worker process, so that later tasks do not read the file again."""
    return Pretokenizer(vocabulary_file(vocabulary))


def piece_counter(cutter: Pretokenizer):
    """Pieces of a pre-token; a special string is one piece."""
    model = cutter.library.model

    def learn(pretoken: str) -> int:
        return 1 if pretoken in cutter.special else len(model.tokenize(cutter.letters(pretoken)))
    return learn


def pretoken_frequencies(df: DataFrame, vocabulary: str, id_col: str, text_col: str) -> DataFrame:
    """(row, id, n_bytes, words, times): the distinct pre-tokens of each text and how often each stands there.

    `row` tells rows with equal ids apart; it is fixed once the table is stored.
    """
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                     F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches):
        cutter = cutter_of(vocabulary)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for part in slices(texts):
                found = [Counter(cutter(t)) for t in texts[part]]
                ends = pa.array(accumulate(map(len, found), initial=0), pa.int32())
                words = pa.array(chain.from_iterable(found), pa.string())
                times = pa.array(chain.from_iterable(f.values() for f in found), pa.int64())
                size = pa.array([len((t or "").encode("utf-8")) for t in texts[part]], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part], batch.column(1)[part], size,
                     pa.ListArray.from_arrays(ends, words), pa.ListArray.from_arrays(ends, times)],
                    ["row", "id", "n_bytes", "words", "times"])

    return rows.mapInArrow(
        run, f"row long, id {id_type}, n_bytes long, words array<string>, times array<long>")


def _stored(df: DataFrame, name: str) -> DataFrame:
    """Written densely to the shared folder and read back."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _key(word: str):
    """The pre-token, or the digest of one beyond 32 bytes: 64 bytes at most."""
    return F.when(F.octet_length(word) > 32, F.sha2(F.col(word).cast("binary"), 256)).otherwise(F.col(word))


def pieces_of(words: DataFrame, vocabulary: str) -> DataFrame:
    """(key, texts, pieces) of the distinct pre-tokens in column `word`; texts: rows that hold it."""
    distinct = words.groupBy("word").agg(F.count("*").alias("texts"))
    keyed = distinct.select(_key("word").alias("key"), "texts", "word")

    def run(batches):
        count = piece_counter(cutter_of(vocabulary))
        for batch in batches:
            pieces = pa.array(map(count, batch.column(2).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pieces], ["key", "texts", "pieces"])

    return keyed.mapInArrow(run, "key string, texts long, pieces long")


def count_tokens(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 2048, common: int = COMMON) -> DataFrame:
    """One row per input row: the id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens. Null and repeated ids are
    kept as they are. Other columns are left out, whatever their names.
    An empty table gives an empty result. The frequencies and the distinct
    pre-tokens are written to the shared folder when this is called; `common`
    moves work between the two joins, not results.
    """
    texts = _stored(pretoken_frequencies(df, vocabulary, id_col, text_col), "token-frequencies")
    pieces = _stored(pieces_of(texts.select(F.explode("words").alias("word")), vocabulary), "token-pieces")
    # Only the row number goes through the joins; id and size come back at the end.
    rows = texts.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select(
        "row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    rows = rows.select("row", _key("word").alias("key"), "times")
    frequent = F.broadcast(pieces.orderBy(F.desc("texts"), "key").limit(common).select("key", "pieces"))
    rest = rows.join(frequent, "key", "left_anti").join(
        pieces.select("key", "pieces").hint("merge"), "key")
    tokens = (F.col("times") * F.col("pieces")).alias("n")
    parts = rows.join(frequent, "key").select("row", tokens).unionAll(rest.select("row", tokens))
    sums = parts.groupBy("row").agg(F.sum("n").alias("n"))
    counted = texts.select("row", "id", "n_bytes").join(sums, "row", "left").withColumn(
        "n_tokens", F.coalesce("n", F.lit(0).cast("long")))
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens",
                          (F.col("n_tokens") > limit).alias("over_limit"))
