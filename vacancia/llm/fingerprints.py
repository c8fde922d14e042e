"""Bottom-k sketches of shingle hashes.

A sketch holds the k smallest distinct shingle hashes of a text as big-endian
64-bit integers, ascending. The sketch of a union is made of the sketches of
its parts alone. Two sketches tell resemblance, containment and the number of
distinct shingles; where a text has no more than k shingles this is exact.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .tables import fresh
from .words import SHINGLE_WORDS, shingle_sets, slices

K = 256


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of sorted distinct hashes."""
    return hashes[:k]


def to_bytes(sketch: np.ndarray) -> bytes:
    return sketch.astype(">u8").tobytes()


def from_bytes(data: bytes | None) -> np.ndarray:
    return np.frombuffer(data or b"", dtype=">u8").astype(np.uint64)


def _shared(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest hashes of the union, and those of them in both."""
    union = np.unique(np.concatenate((a, b)))[:k]
    both = np.intersect1d(a, b, assume_unique=True)
    return union, both[both <= union[-1]] if len(union) else both


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Jaccard likeness of the texts behind two sketches; 1 for two empty ones."""
    union, both = _shared(a, b, k)
    return len(both) / len(union) if len(union) else 1.0


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0 ** 64 / float(a[k - 1])


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too; 1 if a is empty."""
    if not len(a):
        return 1.0
    union, both = _shared(a, b, k)
    inside = np.count_nonzero(np.isin(a[a <= union[-1]], both, assume_unique=True))
    return inside / np.count_nonzero(a <= union[-1])


def sketches(texts: list, k: int = K, width: int = SHINGLE_WORDS) -> list[np.ndarray]:
    return [bottom(s, k) for s in shingle_sets(texts, width)]


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K,
                width: int = SHINGLE_WORDS) -> DataFrame:
    """One row per input row: the id and its sketch (binary).

    A null text counts as empty; texts without words have the empty sketch.
    Null and repeated ids are kept. Other columns are left out.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts, out = batch.column(1).to_pylist(), []
            for part in slices(texts):
                out += [to_bytes(s) for s in sketches(texts[part], k, width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())],
                                             ["id", "sketch"])

    return rows.mapInArrow(run, f"id {id_type}, sketch binary").withColumnRenamed("id", id_col)


def merge(df: DataFrame, keys: list[str], sketch: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per group: that of the union of its texts.

    Each task passes on at most k hashes per group, so a hot group is small
    before it is shuffled. Null sketches count as empty; null keys are a group.
    """
    hashed, place = fresh(df.columns, "hash", "place")
    at = F.sequence(F.lit(0), F.floor(F.octet_length(sketch) / 8).cast("int") - 1)
    known = F.octet_length(sketch) >= 8
    hashes = F.when(known, F.transform(at, lambda i: F.substring(F.col(sketch), i * 8 + 1, F.lit(8))))
    single = df.select(*keys, F.explode_outer(hashes).alias(hashed)).distinct()
    ranked = single.withColumn(place, F.row_number().over(
        Window.partitionBy(*keys).orderBy(F.col(hashed).asc_nulls_last())))
    # At most k hashes a group are collected.
    return (ranked.where(F.col(place) <= k).groupBy(*keys)
            .agg(F.sort_array(F.collect_list(hashed)).alias(hashed))
            .select(*keys, F.aggregate(hashed, F.lit(b""), lambda a, b: F.concat(a, b))
                    .alias(sketch)))


def compare(df: DataFrame, a: str, b: str, k: int = K) -> DataFrame:
    """The rows with resemblance, a_in_b, b_in_a, a_shingles, b_shingles (double) of two sketch columns.

    Null sketches count as empty. Columns named like the results are replaced.
    """
    made = ["resemblance", "a_in_b", "b_in_a", "a_shingles", "b_shingles"]
    rows = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in made])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema),
                        *(f"{m} double" for m in made)])

    def run(batches):
        for batch in batches:
            left, right = ([from_bytes(x) for x in batch.column(batch.schema.get_field_index(c)).to_pylist()]
                           for c in (a, b))
            pairs = list(zip(left, right))
            out = [[resemblance(x, y, k) for x, y in pairs], [containment(x, y, k) for x, y in pairs],
                   [containment(y, x, k) for x, y in pairs], [distinct_shingles(x, k) for x in left],
                   [distinct_shingles(y, k) for y in right]]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(v, pa.float64()) for v in out)],
                [*batch.schema.names, *made])

    return rows.mapInArrow(run, schema)


def _order_key(row) -> tuple:
    return (row[0] is not None, row[0] or 0, row[1])


RANGES_PER_TASK = 16


def with_next(df: DataFrame, id_col: str, text_col: str, rows_per_range: int = 1024,
              most_ranges: int = 262_144) -> DataFrame:
    """Sorted ranges of documents, each followed by the first document of the next range.

    Columns: range, helper, id, tie, text; sorted by them inside each task. The
    order is by id (nulls first), then by a hash of the text. Some keys of the
    table itself are the ranges' first rows; their number is bounded, so they
    may pass through the driver. The first range's head follows the last range.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"),
                     F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tie"),
                     F.col(text_col).alias("text"))
    keys = rows.select("id", "tie")
    n = df.count()
    ranges = max(1, min(most_ranges, -(-n // rows_per_range)))
    share = max(1, n // (4 * ranges))
    some = keys.where(F.pmod(F.xxhash64("id", "tie"), F.lit(share)) == 0).distinct()
    starts = sorted({_order_key(r) for r in some.collect()})
    first = keys.orderBy(F.col("id").asc_nulls_first(), "tie").limit(1).collect()
    starts = sorted({*map(_order_key, first), *starts[::max(1, len(starts) // ranges)]})

    @F.arrow_udf("array<long>")
    def ranges_of(id: pa.Array, tie: pa.Array) -> pa.Array:  # noqa: A002
        out = []
        for row in zip(id.to_pylist(), tie.to_pylist()):  # integers all the way: a null makes no doubles of them
            key = _order_key(row)
            at = bisect_right(starts, key) - 1
            out.append([at, (at - 1) % len(starts)] if starts[at] == key else [at])
        return pa.array(out, pa.list_(pa.int64()))

    spread = rows.select("*", F.posexplode(ranges_of("id", "tie")).alias("helper", "range"))
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-len(starts) // RANGES_PER_TASK))
    return (spread.select("range", "helper", "id", "tie", "text").repartition(tasks, "range")
            .sortWithinPartitions("range", "helper", F.col("id").asc_nulls_first(), "tie"))


def edited(text: str, following: str) -> str:
    """The text with its last floor(n/2) characters replaced by the first as many of the following one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K,
                      width: int = SHINGLE_WORDS) -> DataFrame:
    """Each document, its sketch, that of its edited text, and likenesses.

    Columns: the id (long), n_chars, edited_text, sketch, edited_sketch,
    near_edited, near_next. The next document is the next one by id (nulls
    first, equal ids by a hash of their texts); after the last comes the first.
    A null text counts as empty. One row per input row; none for an empty table.
    """
    def run(batches):
        waiting = None  # the last row so far: its successor is in the next batch
        for batch in batches:
            ranges, helper, ids, _, texts = (c.to_pylist() for c in batch.columns)
            texts = [t or "" for t in texts]
            if waiting is not None:
                ranges, helper, ids, texts = (
                    [w, *c] for w, c in zip(waiting, (ranges, helper, ids, texts)))
            if not ids:
                continue
            waiting = (ranges[-1], helper[-1], ids[-1], texts[-1])
            for part in slices(texts[:-1], 2 << 20):
                some = texts[part.start:part.stop + 1]
                marks = sketches(some, k, width)
                own = [i for i in range(len(some) - 1) if not helper[part.start + i]]
                if any(ranges[part.start + i] != ranges[part.start + i + 1] for i in own):
                    raise ValueError("a range without the first document of the next one")
                new = [edited(some[i], some[i + 1]) for i in own]
                changed = sketches(new, k, width)
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[part.start + i] for i in own], pa.int64()),
                    pa.array([len(some[i]) for i in own], pa.int64()),
                    pa.array(new, pa.string()),
                    pa.array([to_bytes(marks[i]) for i in own], pa.binary()),
                    pa.array([to_bytes(c) for c in changed], pa.binary()),
                    pa.array([resemblance(marks[i], c, k) for i, c in zip(own, changed)], pa.float64()),
                    pa.array([resemblance(marks[i], marks[i + 1], k) for i in own], pa.float64()),
                ], ["id", "n_chars", "edited_text", "sketch", "edited_sketch", "near_edited",
                    "near_next"])
        if waiting is not None and not waiting[1]:
            raise ValueError("a range without the first document of the next one")

    if not df.take(1):
        return df.sparkSession.createDataFrame(
            [], f"`{id_col}` long, n_chars long, edited_text string, sketch binary, "
                "edited_sketch binary, near_edited double, near_next double")
    return (with_next(df, id_col, text_col)
            .mapInArrow(run, "id long, n_chars long, edited_text string, sketch binary, "
                             "edited_sketch binary, near_edited double, near_next double")
            .withColumnRenamed("id", id_col))


def as_text(sketch: str) -> Column:
    """A sketch column as base64 text without line breaks."""
    return F.regexp_replace(F.base64(F.col(sketch)), r"\s", "")
