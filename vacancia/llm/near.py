"""Jaccard join on word shingles by an LSH forest, verified exactly.

1. *Tries.* Each distinct text has a label per tree: the minhashes of that tree in order.
   The labels of a tree, sorted, are its prefix trie: what shares a prefix stands together.
2. *Shortening.* Texts meet at the longest prefix that they share. The tries are walked
   level by level, from whole labels to shorter ones; each pair is met once, at its deepest
   level in any tree, and compared by all its minhashes. After each level the recall is
   estimated from the likeness of what was met so far; the prefixes are shortened until it
   reaches the target, at the latest to the length where texts at exactly the threshold
   meet with that probability.
3. *Clusters.* Everything that may reach the threshold is joined up; a cluster holds every
   pair that any tree proposed, each text once, however many trees found it.
4. *Verification.* Inside a cluster all pairs get their exact Jaccard likeness,
   by products of text-by-shingle matrices.

A prefix or a cluster of any size is dealt out as pairs of chunks, so a task
holds two chunks, and no row is made per pair: blocks give link counts and a
spanning forest of their links. Equal texts are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .tables import cut, fresh
from .words import SHINGLE_WORDS, mix, shingle_sets, shingles, slices

THRESHOLD = 0.8
TREES, DEPTH, RECALL = 16, 8, 0.9995
MARGIN = 0.25  # of estimated likeness below the threshold: seven standard errors of 128 minhashes
DOUBT = 0.25  # links at the very threshold that the estimate of recall supposes, as a share of those met
_U = np.uint64


def prefix_length(threshold: float, trees: int = TREES, depth: int = DEPTH,
                  recall: float = RECALL) -> int:
    """Where shortening ends at the latest: a pair at the threshold meets with the target recall."""
    while depth > 1 and meeting(threshold, depth, trees) < recall:
        depth -= 1
    return depth


def meeting(likeness: float | np.ndarray, level: int, trees: int):
    """How likely texts of that likeness share `level` values in some tree."""
    return 1 - (1 - likeness ** level) ** trees


def estimated_recall(seen: np.ndarray, level: int, trees: int, threshold: float, doubt: float = DOUBT) -> float:
    """The share of all links that prefixes of `level` values meet, from the pairs met so far.

    seen[k] counts the met pairs of k equal minhashes. Each stands for one over its chance to be
    met, taken at its likeness less a standard error, but not below the threshold; `doubt` times as
    many are supposed at the threshold itself. Pairs that are surely less alike are left out.
    """
    likeness = np.arange(len(seen)) / (len(seen) - 1)
    lower = likeness - np.sqrt(likeness * (1 - likeness) / (len(seen) - 1))
    links = np.where(likeness + (likeness - lower) >= threshold, seen, 0)
    if not links.sum():
        return 0.0
    met = links.sum() * (1 + doubt)
    at_threshold = doubt * links.sum() / meeting(threshold, level, trees)
    return float(met / ((links / meeting(np.maximum(lower, threshold), level, trees)).sum() + at_threshold))


def node(text: str) -> Column:
    """What equal texts share: the md5 of the text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def minhashes(texts: list, n: int, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """n minhashes (32 bits) of each text that has words, and which texts those are."""
    values, at = shingles(texts, width)
    some = np.flatnonzero(np.diff(at))
    factors = mix(np.arange(1, n + 1, dtype=np.uint64)) | _U(1)
    out = np.empty((len(some), n), dtype=np.uint32)
    if len(some):
        for i, factor in enumerate(factors):
            out[:, i] = np.minimum.reduceat(((values * factor) >> _U(32)).astype(np.uint32), at[some])
    return out, some


def forest(df: DataFrame, text: str, trees: int, depth: int, width: int) -> DataFrame:
    """node, size, marks (8 bits of each minhash: the labels, tree after tree) per distinct text with words."""
    rows = df.select(node(text).alias("node"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in slices(texts, 1 << 20):
                values, some = minhashes(texts[part], trees * depth, width)
                if not len(some):
                    continue
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(some + part.start)),
                    pa.array([len(texts[part.start + i]) for i in some], pa.int64()),
                    pa.array([r.tobytes() for r in values.astype(np.uint8)], pa.binary())],
                    ["node", "size", "marks"])

    found = rows.mapInArrow(run, "node binary, size long, marks binary")
    return found.groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", "marks")])


def tries(texts: DataFrame, trees: int, depth: int, shortest: int) -> DataFrame:
    """The labels of all trees, sorted within tasks; a task holds whole subtries below `shortest` values.

    Columns path (the subtrie), i, j, chunk (see `in_blocks`), label, node, marks.
    """
    label = F.substring("marks", F.col("tree") * depth + 1, F.lit(depth))
    paths = (texts.select("node", "marks", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
             .select("node", "tree", F.xxhash64("tree", F.substring(label, 1, shortest)).alias("path")))
    return cut(in_blocks(paths, "path", 1024).join(texts.select("node", "marks"), "node")
               .select("path", "i", "j", "chunk", label.alias("label"), "node", "marks")
               .repartition("path", "i", "j").sortWithinPartitions("path", "i", "j", "label", "node"))


def in_blocks(members: DataFrame, group: str, rows: int, size: int | None = None) -> DataFrame:
    """Deal the members of each group into pairs of chunks: columns i, j, chunk.

    A group of one chunk is the block (0, 0). Block (i, i) compares chunk i
    with itself, (i, j) the two with each other. A chunk has about `rows` rows
    and `size` characters. Groups of one member are dropped. Sizes are counts
    made before any group is brought together.
    """
    parts = F.ceil(F.count(F.lit(1)) / rows)
    if size:
        parts = F.greatest(parts, F.ceil(F.sum("size") / size))
    counts = (members.groupBy(group).agg(F.count(F.lit(1)).alias("n"), parts.cast("int").alias("parts"))
              .where(F.col("n") > 1).drop("n"))
    chunk = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    return (members.join(counts, group).withColumn("chunk", chunk)
            .withColumn("other", F.explode(others))
            .withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other"))
            .drop("other", "parts"))


def whole_runs(batches: Iterable[pa.RecordBatch], key: list[str], at_least: int) -> Iterator[pa.Table]:
    """Tables of complete runs of equal keys, of `at_least` rows where there are so many."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < at_least:
            continue
        table = pa.Table.from_batches(held)
        starts = run_starts(table, key)
        if starts[-1]:
            yield table.slice(0, starts[-1])
            table = table.slice(starts[-1])
        held, rows = table.to_batches(), table.num_rows
    if rows:
        yield pa.Table.from_batches(held)


def run_starts(table: pa.Table, key: list[str]) -> np.ndarray:
    columns = [table.column(c).to_numpy() if pa.types.is_integer(table.column(c).type)
               else np.array(table.column(c).to_pylist(), dtype=object) for c in key]
    change = np.zeros(max(0, table.num_rows - 1), dtype=bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    return np.concatenate(([0], np.flatnonzero(change) + 1))


def leaders(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of 0..n-1's component under the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def _nodes(column) -> tuple[list[bytes], np.ndarray]:
    """The distinct nodes, sorted, and which one each row has."""
    values = np.array(column.to_pylist(), dtype=object)
    names, place = np.unique(values, return_inverse=True)
    return names.tolist(), place


def _meeting(batches, level: int, trees: int, depth: int, least: float):
    """Pairs that share `level` values of a tree, in no tree more, and whose minhashes agree well enough.

    Links as stars (a, b), and how many pairs have how many equal minhashes (same, pairs); a
    pair that meets in several trees counts as one.
    """
    n = trees * depth
    for table in whole_runs(batches, ["path", "i", "j"], 20_000):
        rows = table.num_rows
        top = np.zeros((rows, 8), np.uint8)
        top[:, :depth] = np.frombuffer(b"".join(table.column("label").to_pylist()), np.uint8).reshape(-1, depth)
        labels = top.view(">u8")[:, 0].astype(np.uint64)
        block = np.zeros(rows, dtype=bool)
        block[run_starts(table, ["path", "i", "j"])] = True

        def run_ends(length: int) -> np.ndarray:
            head = labels >> _U(64 - 8 * length)
            first = block.copy()
            first[1:] |= head[1:] != head[:-1]
            starts = np.append(np.flatnonzero(first), rows)
            return np.repeat(starts[1:], np.diff(starts))

        end = run_ends(level)
        partner = run_ends(level + 1) if level < depth else np.arange(rows) + 1
        sign = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.uint8).reshape(-1, n)
        chunk, i, j = (table.column(c).to_numpy() for c in ("chunk", "i", "j"))
        names, who = _nodes(table.column("node"))
        first, second, seen = [], [], np.zeros(n + 1)
        here, step = np.arange(rows), 0
        while len(here):
            here = here[partner[here] + step < end[here]]
            for at in range(0, len(here), 1 << 15):
                a = here[at:at + (1 << 15)]
                b = partner[a] + step
                apart = (i[a] == j[a]) | (chunk[a] != chunk[b])
                a, b = a[apart], b[apart]
                equal = sign[a] == sign[b]
                same = equal.sum(axis=1)
                close = np.flatnonzero(same >= least * n)
                shared = np.logical_and.accumulate(
                    equal[close].reshape(-1, trees, depth), axis=2).sum(axis=2)
                new = shared.max(axis=1, initial=0) == level
                close, shared = close[new], shared[new]
                seen += np.bincount(same[close], 1 / (shared == level).sum(axis=1), minlength=n + 1)
                first.append(who[a[close]])
                second.append(who[b[close]])
            step += 1
        if not seen.any():
            continue
        label = leaders(len(names), np.concatenate(first), np.concatenate(second))
        out, counts = np.flatnonzero(label != np.arange(len(names))), np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[x] for x in out] + [None] * len(counts), pa.binary()),
             pa.array([names[x] for x in label[out]] + [None] * len(counts), pa.binary()),
             pa.array([None] * len(out) + counts.tolist(), pa.int32()),
             pa.array([None] * len(out) + seen[counts].tolist(), pa.float64())], ["a", "b", "same", "pairs"])


def proposals(found: DataFrame, trees: int, depth: int, shortest: int, threshold: float,
              recall: float) -> tuple[DataFrame, int, float]:
    """Links a, b of the sorted tries, the level that the prefixes were shortened to, the recall estimated there.

    One job per level; what reaches the driver is a count per number of equal minhashes.
    """
    links, seen = [], np.zeros(trees * depth + 1)
    for level in range(depth, shortest - 1, -1):
        met = cut(found.mapInArrow(partial(_meeting, level=level, trees=trees, depth=depth, least=threshold - MARGIN),
                                   "a binary, b binary, same int, pairs double"))
        links.append(met.where("a is not null").select("a", "b"))
        for r in met.where("same is not null").groupBy("same").agg(F.sum("pairs").alias("pairs")).collect():
            seen[r["same"]] += r["pairs"]
        reached = estimated_recall(seen, level, trees, threshold)
        if reached >= recall:
            break
    return reduce(DataFrame.unionByName, links), level, reached


def shared_shingles(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many shingles each two of the sets share: products of slices of the text-by-shingle matrix."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[ids]
    owner, shared = owner[shared >= 0], shared[shared >= 0]
    order = np.argsort(shared, kind="stable")
    owner, shared = owner[order], shared[order]
    total = int(shared[-1]) + 1 if len(shared) else 0
    out = np.zeros((len(sets), len(sets)), dtype=np.int64)
    for at in range(0, total, columns):
        a, b = np.searchsorted(shared, [at, at + columns])
        part = np.zeros((len(sets), min(columns, total - at)), dtype=np.float32)
        part[owner[a:b], shared[a:b] - at] = 1
        out += (part @ part.T).astype(np.int64)
    return out


def _verified(batches, threshold: float, width: int):
    """Links of each text in a block, and the smallest text its links lead to."""
    for table in whole_runs(batches, ["cluster", "i", "j"], 256):
        starts = np.append(run_starts(table, ["cluster", "i", "j"]), table.num_rows)
        for start, end in zip(starts[:-1], starts[1:]):
            run = table.slice(start, end - start)
            names, texts = run.column("node").to_pylist(), run.column("text").to_pylist()
            sets = []
            for part in slices(texts):
                sets += shingle_sets(texts[part], width)
            both = shared_shingles(sets)
            sizes = np.array([len(s) for s in sets])
            near = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9
            chunk = run.column("chunk").to_numpy()
            if run.column("i")[0].as_py() != run.column("j")[0].as_py():
                near &= chunk[:, None] != chunk[None, :]
            np.fill_diagonal(near, False)
            links = near.sum(axis=1)
            out = np.flatnonzero(links)
            if len(out):
                label = leaders(len(names), *np.nonzero(np.triu(near)))
                yield pa.RecordBatch.from_arrays([
                    pa.array([names[x] for x in out], pa.binary()), pa.array(links[out], pa.int64()),
                    pa.array([names[x] for x in label[out]], pa.binary())], ["node", "links", "leader"])


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each node's component, for edges a, b.

    Alternating large and small stars: each round hangs the larger (smaller)
    neighbours of every node onto the smallest one. Minima are combined before
    they are shuffled and joined back, so a node with very many neighbours is
    split like any skewed join. Every round is checkpointed.
    """
    def star(both: DataFrame) -> DataFrame:
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        return both.join(least, "a")

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                .where("a <> b").distinct())
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (star(both).where(F.col("b") > F.col("a"))
                 .select(F.col("b").alias("a"), F.col("low").alias("b")))
        large = cut(large.where("a <> b").distinct())
        near = star(large)  # here a is the larger end of every edge
        small = near.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            near.select("a", F.col("low").alias("b")))
        edges = cut(small.where("a <> b").distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD, width: int = SHINGLE_WORDS, trees: int = TREES,
                    recall: float = RECALL) -> DataFrame:
    """One row per input row: the id (long), node, root, class_id, copies, links, group_id.

    node stands for the text, root for the group (ids may repeat, these do not);
    class_id is the smallest id with the very same text, copies how many rows
    have it, links how many other texts are at least `threshold` alike, and
    group_id the smallest id that such links lead to, over any number of steps.
    A null text counts as empty. Texts without words have no links. Null ids
    count for copies and get the ids of their class and group, null if none is
    known. Repeated rows are rows of their own. Other columns are left out.
    """
    shortest = prefix_length(threshold, trees, DEPTH, recall)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = cut(forest(rows, "text", trees, DEPTH, width))
    proposed, _, _ = proposals(tries(texts, trees, DEPTH, shortest), trees, DEPTH, shortest, threshold, recall)
    clusters = components(proposed).withColumnRenamed("root", "cluster")

    members = cut(in_blocks(clusters.join(texts.select("node", "size"), "node"), "cluster", 256, 8 << 20))
    wanted = members.select("node").distinct()
    bodies = (rows.select(node("text").alias("node"), "text").join(wanted, "node", "left_semi")
              .groupBy("node").agg(F.first("text").alias("text")))
    blocks = (members.join(bodies, "node").repartition("cluster", "i", "j")
              .sortWithinPartitions("cluster", "i", "j", "node"))
    linked = cut(blocks.select("cluster", "i", "j", "chunk", "node", "text").mapInArrow(
        lambda batches: _verified(batches, threshold, width), "node binary, links long, leader binary"))

    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(linked.select(F.col("node").alias("a"), F.col("leader").alias("b")))
    ids = rows.select("id", node("text").alias("node"))
    classes = cut(ids.groupBy("node").agg(F.min("id").alias("class_id"),
                                          F.count(F.lit(1)).alias("copies"))
                  .join(links, "node", "left").join(roots, "node", "left")
                  .withColumn("root", F.coalesce("root", "node")))
    groups = classes.groupBy("root").agg(F.min("class_id").alias("group_id"))
    facts = classes.join(groups, "root").select(
        "node", "root", "class_id", "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"), "group_id")
    return ids.join(facts, "node").select(
        F.col("id").alias(id_col), "node", "root", "class_id", "copies", "links", "group_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `df` less all near duplicates: of each group the row of the smallest id stays.

    Without a known id in the group it is a row of its smallest node. Rows of
    one id with texts that are not alike all stay; of repeated rows one does.
    All columns are kept as they are.
    """
    key, place = fresh(df.columns, "node", "place")
    found = near_duplicates(df, id_col, text_col, **options)
    stays = (found.where(F.col(id_col).eqNullSafe(F.col("group_id")))
             .groupBy("root").agg(F.min("node").alias(key)))
    one = Window.partitionBy(key).orderBy(F.col(f"`{id_col}`").asc_nulls_last())
    rows = (df.withColumn(key, node(f"`{text_col}`")).withColumn(place, F.row_number().over(one))
            .where(F.col(place) == 1).drop(place))
    return rows.join(stays.select(key), key, "left_semi").drop(key)
