"""Packing token sequences into windows by minimum bin slack.

A document is cut into full windows and one rest. The rests are a multiset of
lengths below the window size, so a table of at most `window` counts describes
all of them, at any corpus size. The plan is made from those counts: the
longest length left opens a window, a bitset subset sum over the remaining
multiset finds the fill closest to capacity, and backtracking gives how many of
each length are used. The same fill is repeated as often as the counts last.
Pieces then look up their place by their number within their length.
"""

from __future__ import annotations

import zlib
from array import array
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

from .pretokens import BYTE_LETTERS, Learned, Pretokenizer
from .tables import cut, gapless, vocabulary_file
from .bpe import encoded
from .words import slices

WINDOW = 2048


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length sum up closest to `capacity` from below.

    Bit s of the set is on if some part of the multiset sums to s. Lengths come
    in descending order, each split into powers of two of its count; the set
    before each step is kept, so that the chosen sum can be walked back.
    """
    reach, full = 1, (1 << (capacity + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted((n for n in counts if n <= capacity), reverse=True):
        left, take = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(take, left)
            grown = (reach | reach << (take * length)) & full
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
            left -= take
            take *= 2
        if reach >> capacity & 1:
            break
    at, fill = reach.bit_length() - 1, {}
    for length, take, earlier in reversed(steps):
        if not earlier >> at & 1:
            fill[length] = fill.get(length, 0) + take
            at -= take * length
    return fill


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple]:
    """Rows (length, first, last, per_window, sequence, offset).

    The pieces numbered first..last of a length go to windows from `sequence`
    on, `per_window` in each, from `offset` on. Every piece of the counts is
    covered once.
    """
    left = {n: c for n, c in counts.items() if c}
    used = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        fill = best_fill({n: c for n, c in left.items() if c}, window - longest)
        left[longest] += 1
        fill[longest] = fill.get(longest, 0) + 1
        times = min(left[n] // m for n, m in fill.items())
        offset = 0
        for n in sorted(fill, reverse=True):
            m = fill[n]
            rows.append((n, used[n], used[n] + m * times - 1, m, sequence, offset))
            used[n] += m * times
            left[n] -= m * times
            offset += m * n
            if not left[n]:
                del left[n]
        sequence += times
    return rows


@lru_cache(maxsize=1)
def library_ids(vocabulary: str) -> tuple[Pretokenizer, Learned]:
    """Ids of pre-tokens by a library, kept by the worker process for later tasks.

    A byte-level vocabulary whose ids are its merge order is the same as ranks
    of byte strings, which tiktoken works off faster; any other file goes to
    the model of its own library.
    """
    cutter = Pretokenizer(vocabulary_file(vocabulary))
    byte_of = {c: b for b, c in enumerate(BYTE_LETTERS)}
    ranks = {t: i for t, i in cutter.ids.items() if t not in cutter.special}
    merged = [cutter.ids[a + b] for a, b in cutter.merges]
    if not cutter.word_end and merged == list(range(256, 256 + len(merged))):
        piece = tiktoken.Encoding(
            vocabulary, pat_str="(?!)", special_tokens={}, mergeable_ranks={
                bytes(map(byte_of.__getitem__, t)): i for t, i in ranks.items()})._encode_single_piece

        def ids(word: str) -> list[int]:
            return piece(word.encode("utf-8") if word[0] != "\0" or len(word) < 2
                         else bytes(map(byte_of.__getitem__, word[1:])))
    else:
        model = cutter.library.model

        def ids(word: str) -> list[int]:
            return [t.id for t in model.tokenize(cutter.letters(word))]

    def learn(word: str) -> bytes:
        return array("I", [cutter.special[word]] if word in cutter.special else ids(word)).tobytes()
    return cutter, Learned(learn)


def pieces(df: DataFrame, vocabulary: str, end_id: int, window: int = WINDOW,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of each document, the end id included, cut into windows.

    Columns: id, start, length, ids_crc32, doc_tokens. A null or empty text has
    the end id alone.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    end, step = end_id.to_bytes(4, "little"), 4 * window

    def run(batches):
        cutter, known = library_ids(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in slices(texts):
                owner, start, length, crc, total = [], [], [], [], []
                for i, ids in enumerate(encoded(texts[part], cutter, known), part.start):
                    ids += end
                    for at in range(0, len(ids), step):
                        piece = ids[at:at + step]
                        owner.append(i)
                        start.append(at // 4)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(len(ids) // 4)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner, pa.int64())),
                     *(pa.array(x, pa.int64()) for x in (start, length, crc, total))],
                    ["id", "start", "length", "ids_crc32", "doc_tokens"])

    return rows.mapInArrow(run, f"id {id_type}, start long, length long, ids_crc32 long, "
                                "doc_tokens long")


def pack(df: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 1,
         window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: the id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is one piece of the end id. Null and repeated ids are
    documents of their own. Other columns are left out. An empty table has no
    pieces. The pieces are checkpointed, since they are read for the counts and
    again for their places. What reaches the driver is one count per length.
    """
    spark = df.sparkSession
    cut_up = cut(pieces(df, vocabulary, end_id, window, id_col, text_col))
    counts = {r["length"]: r["n"] for r in
              cut_up.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = spark.createDataFrame(
        plan(counts, window), "length long, first long, last long, per_window long, "
                              "sequence long, at long")
    # At most a few rows per length below the window size: its size is bounded.
    return (gapless(cut_up, ["length"], "number")
            .join(F.broadcast(places), "length")
            .where(F.col("number").between(F.col("first"), F.col("last")))
            .withColumn("number", F.col("number") - F.col("first"))
            .select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
                    (F.col("sequence") + F.expr("number div per_window")).alias("sequence_id"),
                    (F.col("at") + F.col("number") % F.col("per_window") * F.col("length"))
                    .alias("offset")))
