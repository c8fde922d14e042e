"""Exact top-k by inner product, a block of documents at a time.

Vectors are integers. Documents, sorted so that alike ones are neighbours, are
cut into blocks; a block keeps its forward index (a matrix) and per component
the largest and smallest value. For a query, the sum of the larger of
q * largest and q * smallest bounds every score in the block. Two passes:

1. each query scores its block of the highest bound, which gives a first k-th score;
2. the other blocks whose bound reaches that score are scored in descending
   order of bound, until the bounds fall below the query's k-th score so far.

Queries and blocks meet as chunks of queries and packs of block bounds, so a
row pair of tables is never formed and every task holds a few megabytes.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .tables import cut

BLOCK, CHUNK, PACK = 256, 256, 256
_MOST = (1 << 63) - 1


def integers(vector: str, scale: int = 1024):
    """floor(scale * x) of each component; null if the vector or a component is null or not finite.

    A finite component whose result is no long is an error.
    """
    v = F.col(vector)
    bad = v.isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double"))
                                | (F.abs(x.cast("double")) == float("inf")))
    def whole(x):
        y = F.floor(x.cast("double") * float(scale))
        return F.when(F.abs(x.cast("double") * float(scale)) >= 2.0 ** 63, F.raise_error(
            F.lit("a component leaves a long")).cast("long")).otherwise(y)
    return F.when(~bad, F.transform(v, whole))


def _matrix(rows: list) -> np.ndarray:
    """Rows side by side; a shorter one counts as filled up with zeros."""
    wide = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), wide), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _unpack(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<i8").reshape(rows, len(data) // 8 // rows)


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (a, b))


def _largest(rows: np.ndarray) -> np.ndarray:
    """Largest absolute value of each row; as doubles, so the least long has one too."""
    return np.abs(rows.astype(np.float64)).max(axis=1, initial=0)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exact. A score that is no long is an error.

    Pairs of rows whose scores may leave the whole numbers of a double are done with longs, those
    that may leave a long with integers of any size; all others with doubles.
    """
    a, b = _same_width(a, b)
    most = np.outer(_largest(a), _largest(b)) * (a.shape[1] + 1)
    small = most < 2.0 ** 53
    if small.all():
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    out = a @ b.T  # right wherever the sums stay in a long, which wraps around
    i, j = np.nonzero(most >= 2.0 ** 63)
    for x, y in zip(i.tolist(), j.tolist()):
        exact = sum(int(p) * int(q) for p, q in zip(a[x], b[y]))
        if not -_MOST - 1 <= exact <= _MOST:
            raise OverflowError("a score leaves a long")
        out[x, y] = exact
    return out


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Upper bound of every query's score in every block, at most the largest long.

    Exact where doubles are; elsewhere the sum of doubles and what rounding may have taken from it.
    """
    up, down = (f(queries, 0).astype(np.float64) for f in (np.maximum, np.minimum))
    high, low = high.astype(np.float64), low.astype(np.float64)
    total = up @ high.T + down @ low.T
    size = up @ np.abs(high).T - down @ np.abs(low).T
    off = np.where(size < 2.0 ** 52, 0, size * (queries.shape[1] + 4) * 2.0 ** -51)
    total = np.ceil(total + off)
    return np.where(total >= 2.0 ** 63, _MOST, np.where(total >= 2.0 ** 63, 0, total).astype(np.int64))


def _rows(batches):
    for batch in batches:
        yield from batch.to_pylist()


def _blocks(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """Blocks of neighbouring documents: block, ids, forward, high, low."""
    strongest = F.transform("values", lambda x: F.abs(x))
    rows = (df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("values"))
            .where(F.col("values").isNotNull())
            .withColumn("alike", F.array_position(strongest, F.array_max(strongest))))
    placed = rows.repartitionByRange("alike", "id", F.xxhash64("values")).sortWithinPartitions(
        "alike", "id", "values")

    def run(batches):
        from pyspark import TaskContext
        part, rows = TaskContext.get().partitionId(), _rows(batches)
        for n in itertools.count():
            some = list(itertools.islice(rows, BLOCK))
            if not some:
                return
            values = _matrix([r["values"] for r in some])
            yield pa.RecordBatch.from_pylist([{
                "block": (part << 32) + n, "ids": [r["id"] for r in some],
                "forward": values.astype("<i8").tobytes(),
                "high": values.max(axis=0).tolist(), "low": values.min(axis=0).tolist()}],
                schema=pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())),
                                  ("forward", pa.binary()), ("high", pa.list_(pa.int64())),
                                  ("low", pa.list_(pa.int64()))]))

    return cut(placed.mapInArrow(
        run, "block long, ids array<long>, forward binary, high array<long>, low array<long>"))


def _numbered(df: DataFrame, size: int, run, schema: str) -> DataFrame:
    """Rows dealt into groups of about `size`, folded by `run`, numbered from 0 by `no`."""
    n = df.count()
    groups = max(1, -(-n // size))
    # By partition, so that each group is one task's stream; `no` may have gaps where a task is empty.
    return cut(df.repartition(groups).mapInArrow(run, schema))


def _chunks(blocks: DataFrame, every: int) -> DataFrame:
    """Chunks of queries: no, n, ids, own_block, own_place, vectors."""
    def pick(batches):
        for r in _rows(batches):
            values = _unpack(r["forward"], len(r["ids"]))
            picked = [i for i, x in enumerate(r["ids"]) if x is not None and x % every == 0]
            if picked:
                yield pa.RecordBatch.from_pylist(
                    [{"id": r["ids"][i], "block": r["block"], "place": i,
                      "values": values[i].tolist()} for i in picked],
                    schema=pa.schema([("id", pa.int64()), ("block", pa.int64()),
                                      ("place", pa.int64()), ("values", pa.list_(pa.int64()))]))

    def fold(batches):
        from pyspark import TaskContext
        part, rows = TaskContext.get().partitionId(), _rows(batches)
        some = list(rows)  # about CHUNK rows: the number of partitions follows the count
        if some:
            values = _matrix([r["values"] for r in some])
            yield pa.RecordBatch.from_pylist([{
                "no": part, "ids": [r["id"] for r in some],
                "own_block": [r["block"] for r in some], "own_place": [r["place"] for r in some],
                "vectors": values.astype("<i8").tobytes()}],
                schema=pa.schema([("no", pa.int64()), ("ids", pa.list_(pa.int64())),
                                  ("own_block", pa.list_(pa.int64())),
                                  ("own_place", pa.list_(pa.int64())), ("vectors", pa.binary())]))

    queries = cut(blocks.select("block", "ids", "forward").mapInArrow(
        pick, "id long, block long, place long, values array<long>"))
    return _numbered(queries, CHUNK, fold, "no long, ids array<long>, own_block array<long>, "
                                           "own_place array<long>, vectors binary")


def _packs(blocks: DataFrame) -> DataFrame:
    """Packs of block bounds: pack, blocks, high, low."""
    def fold(batches):
        from pyspark import TaskContext
        part, some = TaskContext.get().partitionId(), list(_rows(batches))
        if some:
            high, low = (_matrix([r[c] for r in some]) for c in ("high", "low"))
            yield pa.RecordBatch.from_pylist([{
                "pack": part, "blocks": [r["block"] for r in some],
                "high": high.astype("<i8").tobytes(), "low": low.astype("<i8").tobytes()}],
                schema=pa.schema([("pack", pa.int64()), ("blocks", pa.list_(pa.int64())),
                                  ("high", pa.binary()), ("low", pa.binary())]))

    return _numbered(blocks.select("block", "high", "low"), PACK, fold,
                     "pack long, blocks array<long>, high binary, low binary")


def _meet(chunks: DataFrame, packs: DataFrame, n_chunks: int) -> DataFrame:
    """Every chunk of queries with every pack of bounds."""
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(n_chunks - 1).cast("long"))
    return packs.withColumn("no", F.explode(numbers)).join(chunks, "no")


def _all_bounds(r: dict) -> np.ndarray:
    n = len(r["blocks"])
    queries = _unpack(r["vectors"], len(r["ids"]))
    high, low = _unpack(r["high"], n), _unpack(r["low"], n)
    queries, high = _same_width(queries, high)
    return bounds(queries, high, _same_width(queries, low)[1])


_PAIR = pa.schema([("no", pa.int64()), ("block", pa.int64()), ("places", pa.list_(pa.int64())),
                   ("reach", pa.list_(pa.int64())), ("pack", pa.int64())])
_PAIR_DDL = "no long, block long, places array<long>, reach array<long>, pack long"


def _best_blocks(batches):
    """Of each pack, the block of the highest bound for each query."""
    for r in _rows(batches):
        reach = _all_bounds(r)
        best = reach.argmax(axis=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in (
                [r["no"]] * len(best), np.arange(len(best)), np.array(r["blocks"])[best],
                reach[np.arange(len(best)), best], [r["pack"]] * len(best))],
            ["no", "place", "block", "reach", "pack"])


def _blocks_above(batches):
    """The blocks of each pack with the queries whose k-th score they may reach."""
    for r in _rows(batches):
        reach = _all_bounds(r)
        wanted = reach >= np.array(r["floor"], dtype=np.int64)[:, None]
        wanted &= np.array(r["scored"], dtype=np.int64)[:, None] != np.array(r["blocks"])  # the first pass did these
        out = [{"no": r["no"], "block": b, "places": np.flatnonzero(wanted[:, j]).tolist(),
                "reach": reach[wanted[:, j], j].tolist(), "pack": r["pack"]}
               for j, b in enumerate(r["blocks"]) if wanted[:, j].any()]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_PAIR)


def _scorer(k: int):
    """Scores pairs of a chunk and a block, highest bounds first; k best of each query per run."""
    def run(batches):
        key, best = None, {}
        for r in _rows(batches):
            if (r["no"], r["part"]) != key:
                yield from _emit(key, best, k)
                key, best = (r["no"], r["part"]), {}
            places = [p for p, reach in zip(r["places"], r["reach"])
                      if len(best.get(p, ())) < k or reach >= best[p][-1][0]]
            if not places:
                continue
            queries = _unpack(r["vectors"], len(r["own_block"]))[places]
            scores = products(queries, _unpack(r["forward"], len(r["ids"])))
            ids = np.array([-(1 << 63) if i is None else i for i in r["ids"]], dtype=np.int64)
            for p, line in zip(places, scores):
                some = np.arange(len(ids))
                if r["own_block"][p] == r["block"]:
                    some = some[some != r["own_place"][p]]
                some = some[np.lexsort((ids[some], -line[some]))[:k]]
                merged = best.get(p, []) + [(int(line[i]), r["ids"][i]) for i in some]
                merged.sort(key=lambda x: (-x[0], x[1] is not None, x[1] or 0))
                best[p] = merged[:k]
        yield from _emit(key, best, k)
    return run


def _emit(key, best: dict, k: int):
    out = [(key[0], p, i, s) for p, found in best.items() for s, i in found]
    if out:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in zip(*out)], ["no", "place", "vec_id", "score"])


_SCORED = "no long, place long, vec_id long, score long"


def _score(pairs: DataFrame, chunks: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """`part` keeps the blocks one task works through to a bounded number."""
    ready = (pairs.withColumn("part", F.floor(F.col("pack") / 16))
             .withColumn("top", F.array_max("reach"))
             .join(blocks.select("block", "ids", "forward"), "block")
             .join(chunks.select("no", "own_block", "own_place", "vectors"), "no"))
    return (ready.repartition("no", "part").sortWithinPartitions("no", "part", F.desc("top"), "block")
            .mapInArrow(_scorer(k), _SCORED))


def second_pass(seeded: DataFrame, first: DataFrame, chunks: DataFrame, packs: DataFrame, n_chunks: int,
                k: int) -> DataFrame:
    """Blocks, not scored yet, that may reach the k-th score of the first pass, with the queries they may do so for."""
    least = -_MOST - 1
    lowest = seeded.groupBy("no", "place").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n"))
    floors = (first.select("no", "place", F.col("block").alias("scored")).join(lowest, ["no", "place"], "left")
              .withColumn("floor", F.when(F.col("n") >= k, F.col("floor")).otherwise(least))
              .groupBy("no").agg(*(F.map_from_entries(F.collect_list(F.struct("place", c))).alias(f"by_{c}")
                                   for c in ("floor", "scored"))))
    places = F.sequence(F.lit(0).cast("long"), F.size("ids").cast("long") - 1)

    def by_place(c: str):
        return F.transform(places, lambda i: F.coalesce(F.try_element_at(F.col(f"by_{c}"), i), F.lit(least).cast("long")))
    aimed = (chunks.join(floors, "no", "left").withColumns({c: by_place(c) for c in ("floor", "scored")})
             .drop("by_floor", "by_scored"))
    return _meet(aimed, packs, n_chunks + 1).mapInArrow(_blocks_above, _PAIR_DDL)


def top_k(df: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id",
          vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each query.

    Queries are the rows whose id is divisible by `every`; candidates all rows
    but the query's own row. Vectors that are null or hold nulls or values that
    are not finite take no part; shorter ones count as filled up with zeros. A
    null id is a candidate (it comes before all others in ties), never a query.
    Components and scores are exact; one that is no long is an error.
    Repeated ids are rows of their own. Without queries the result is empty.
    """
    spark = df.sparkSession
    blocks = _blocks(df.select(F.col(id_col).alias("id"), integers(vector, scale).alias("v")),
                     "id", "v")
    chunks = _chunks(blocks, every)
    n_chunks = chunks.agg(F.max("no")).first()[0]
    if n_chunks is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    packs = _packs(blocks)
    both = _meet(chunks, packs, n_chunks + 1)
    first = cut(both.mapInArrow(_best_blocks, "no long, place long, block long, reach long, pack long")
                .withColumn("order", F.row_number().over(
                    Window.partitionBy("no", "place").orderBy(F.desc("reach"), "block")))
                .where(F.col("order") == 1))
    # A chunk has about CHUNK queries, so the lists are bounded.
    seeds = first.groupBy("no", "block").agg(
        F.collect_list("place").alias("places"), F.collect_list("reach").alias("reach"),
        F.min("pack").alias("pack"))
    seeded = cut(_score(seeds, chunks, blocks, k))
    pairs = second_pass(seeded, first, chunks, packs, n_chunks, k)
    scored = seeded.unionByName(_score(pairs, chunks, blocks, k))
    best = (scored.withColumn("rank", F.row_number().over(
        Window.partitionBy("no", "place").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_first())))
        .where(F.col("rank") <= k))
    queries = chunks.select("no", F.posexplode("ids").alias("place", "query_id"))
    return (best.join(queries.withColumn("place", F.col("place").cast("long")), ["no", "place"])
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
