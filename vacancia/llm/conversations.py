"""Cheapest repair of the structure of conversations, with the least audit of its edits.

A repaired conversation's role initials read (s?(ua)+)?, which is a machine of
four states. A node is a row still to come and a state; an edit is an arc:
Delete, Insert, Keep or Rerole. State and letter fix where an arc leads, so the
letters of a path (its audit) fix the path.

Rows are sorted over the cluster and cut into blocks of at most BLOCK rows of
one conversation. In each block, for all of its exits at once, costs are found
from the end; the arcs that reach the least cost stay, and their nodes are
ranked by audits of 1, 2, 4, ... letters: the rank of a node for twice as many
letters follows from its own rank and that of the node its pointer leads to,
and the pointer then jumps twice as far. A block is thereby summed up as 16
costs and the order of 16 audits. The blocks of a conversation are chained by
these sums alone (audits to different exits never begin one another, since each
ends with its block's last row), and each block reads its part of the least
path through the doubled pointers. So no task holds the nodes of more than a
few blocks, however long a conversation is. The sums of a conversation are far
fewer than the letters of its audit, which one result row has to hold anyway.
Texts are shuffled once, at the end, and digested as a stream.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from .tables import cut

BLOCK = 1024  # rows of a conversation that are ranked together; a power of two
_RUN = 8192  # rows that a task ranks at once
_WHITE = " \t\n\x0b\x0c\r"
# Initials as numbers: anything else, s, u, a. Faults: none, blank, duplicate, truncated.
_INITIALS = "sua"
_FINE, _BLANK, _DUPLICATE, _TRUNCATED = range(4)
# States: nothing yet, after s, after u, after a. Where Keep leads by initial (-1: nowhere),
# where a user or an assistant leads, and what the end costs.
_KEEP = np.array([[-1, 1, 2, -1], [-1, -1, 2, -1], [-1, -1, -1, 3], [-1, -1, 2, -1]])
_SPEAK = np.array([2, 2, 3, 2])
_SPEAKER = ("user", "user", "assistant", "user")
_END_COST = np.array([0, 4, 2, 0])
_END_AUDIT = (b"", b"II", b"I", b"")
_DELETE, _INSERT, _REROLE, _OPEN_END = 3, 2, 2, 1
_LETTERS = np.frombuffer(b"\0DIKR", dtype=np.uint8)
_FAR = 1 << 40
_WIDTH = 39  # a block's sum: first row, 16 costs, 16 ranks, 3 fault counts, illegal pairs, first and last initial


def solve(codes: np.ndarray, starts: np.ndarray, exits: np.ndarray):
    """Costs, letters and successors of the optimal arcs of some blocks.

    `codes` (fault * 4 + initial) of all rows, `starts` where each block begins
    and, last, where they end; `exits` the states to leave each block by. Nodes are
    numbered by (layer, exit, state); a block has one layer more than rows.
    """
    blocks, width = exits.shape
    sizes = np.diff(starts)
    first = starts[:-1] + np.arange(blocks)  # layer of each block's first row
    last = first + sizes
    cost = np.full((len(codes) + blocks, width, 4), _FAR, dtype=np.int64)
    cost[last] = np.where(exits[:, :, None] == np.arange(4), 0, _FAR)
    faults, initials = codes >> 2, codes & 3
    bound = (faults == _BLANK) | (faults == _DUPLICATE)
    kept_cost = np.where(bound, _FAR, np.where(faults == _TRUNCATED, _OPEN_END, 0))
    keep_to = _KEEP[:, initials].T  # by row and state

    def options(layers, rows):
        after = cost[layers + 1]
        to = keep_to[rows][:, None, :]
        keep = np.where(to >= 0, np.take_along_axis(after, np.maximum(to, 0), 2), _FAR)
        extra = kept_cost[rows][:, None, None]
        return after + _DELETE, keep + extra, after[:, :, _SPEAK] + extra + _REROLE

    for back in range(1, int(sizes.max(initial=0)) + 1):
        some = sizes >= back
        layers, rows = last[some] - back, starts[1:][some] - back
        best = np.minimum.reduce(options(layers, rows))
        for _ in range(3):  # more inserts in a row only go round in circles
            best = np.minimum(best, best[:, :, _SPEAK] + _INSERT)
        cost[layers] = np.minimum(best, _FAR)

    layers = np.delete(np.arange(len(cost)), last)
    letter = np.zeros(cost.shape, dtype=np.int8)
    nodes = np.arange(cost.size).reshape(cost.shape)
    to = nodes.copy()
    drop, keep, rerole = options(layers, np.arange(len(codes)))
    here, after = cost[layers], nodes[layers + 1]
    arcs = [(drop, after), (here[:, :, _SPEAK] + _INSERT, nodes[layers][:, :, _SPEAK]),
            (keep, np.take_along_axis(after, np.broadcast_to(np.maximum(
                keep_to, 0)[:, None, :], after.shape), 2)), (rerole, after[:, :, _SPEAK])]
    optimal = [(price == here) & (here < _FAR) for price, _ in arcs]
    letter[layers] = np.select(optimal, [1, 2, 3, 4], 0)
    to[layers] = np.select(optimal, [a for _, a in arcs], nodes[layers])
    return cost, letter.ravel(), to.ravel(), nodes[first]


def doubled(letter: np.ndarray, to: np.ndarray):
    """Ranks of all nodes by their whole audits, the doubled pointers, and the audits' lengths."""
    rank, pointers, length = letter.astype(np.int64), [to], (letter > 0).astype(np.int64)
    while letter[pointers[-1]].any():
        jump = pointers[-1]
        rank = np.unique(rank * (rank.max() + 1) + rank[jump], return_inverse=True)[1]
        length = length + length[jump]
        pointers.append(jump[jump])
    return rank, pointers, length


def sums(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each block: costs and order of audits by entry and exit, faults, illegal pairs, its outer initials."""
    blocks = len(starts) - 1
    cost, letter, to, first = solve(codes, starts, np.tile(np.arange(4), (blocks, 1)))
    rank = doubled(letter, to)[0]
    by_exit = rank[first].transpose(0, 2, 1)  # block, entry, exit
    order = by_exit.argsort(axis=2).argsort(axis=2)
    costs = cost.ravel()[first].transpose(0, 2, 1)
    faults, initials = codes >> 2, codes & 3
    pairs = ~legal(initials[:-1], initials[1:])
    pairs = np.append(pairs, False)
    pairs[starts[1:] - 1] = False  # the last row of a block has no successor here
    counts = [np.add.reduceat(x.astype(np.int64), starts[:-1])
              for x in (faults == _BLANK, faults == _DUPLICATE, faults == _TRUNCATED, pairs)]
    return np.column_stack([costs.reshape(blocks, 16), order.reshape(blocks, 16), *counts,
                            initials[starts[:-1]], initials[starts[1:] - 1]])


def legal(a, b):
    """Whether su, ua or au."""
    return ((a == 1) & (b == 2)) | ((a == 2) & (b == 3)) | ((a == 3) & (b == 2))


def paths(codes: np.ndarray, starts: np.ndarray, entries: np.ndarray, exits: np.ndarray) -> list[bytes]:
    """The least audit of each block from its entry to its exit, read through the doubled pointers."""
    _, letter, to, first = solve(codes, starts, exits[:, None])
    _, pointers, length = doubled(letter, to)
    node = first[np.arange(len(entries)), 0, entries]
    lengths = length[node]
    ends = np.cumsum(lengths)
    step = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
    node = np.repeat(node, lengths)
    for k, jump in enumerate(pointers):
        node = np.where((step >> k) & 1, jump[node], node)
    read = _LETTERS[letter[node]].tobytes()
    return [read[e - n:e] for e, n in zip(ends.tolist(), lengths.tolist())]


def chain(table: np.ndarray, starts: np.ndarray):
    """Entry and exit of every block, and cost and counts of every conversation.

    `table` has the blocks' sums in order, `starts` where each conversation begins and ends.
    """
    sizes, n = np.diff(starts), len(starts) - 1
    costs, ranks = table[:, 1:17].reshape(-1, 4, 4), table[:, 17:33].reshape(-1, 4, 4)
    due, choice = np.tile(_END_COST, (n, 1)), np.zeros((len(table), 4), dtype=np.int64)
    for back in range(1, int(sizes.max(initial=0)) + 1):
        some = np.flatnonzero(sizes >= back)
        at = starts[1:][some] - back
        total = costs[at] + due[some][:, None, :]
        choice[at] = (total * 4 + ranks[at]).argmin(axis=2)
        due[some] = total.min(axis=2)
    entries, exits, state = (np.zeros(len(table), dtype=np.int64), np.zeros(len(table), dtype=np.int64),
                             np.zeros(n, dtype=np.int64))
    for ahead in range(int(sizes.max(initial=0))):
        some = np.flatnonzero(sizes > ahead)
        at = starts[:-1][some] + ahead
        entries[at] = state[some]
        exits[at] = state[some] = choice[at, state[some]]
    counts = np.add.reduceat(table[:, 33:37], starts[:-1]) if n else np.zeros((0, 4), dtype=np.int64)
    apart = ~legal(table[:-1, 38], table[1:, 37])
    apart = np.append(apart, False)
    apart[starts[1:] - 1] = False
    counts[:, 3] += np.add.reduceat(apart.astype(np.int64), starts[:-1]) if n else 0
    return entries, exits, due[:, 0], counts


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists, and where each list begins and ends."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten(), np.concatenate([[0], np.cumsum(sizes)])


def _runs(sizes: np.ndarray):
    """Slices of at most about _RUN rows."""
    at, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > _RUN:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield at, len(sizes)


def _sum_up(batches):
    """Rows and marks of first occurrences of a block -> its codes and its sum."""
    for batch in batches:
        values, starts = _lists(batch.column("marked"))
        values = values.to_numpy(zero_copy_only=False)
        mark = (values & 16) > 0
        first = np.append(mark[1:], False)[~mark]  # a row's mark comes right after it
        codes = values[~mark] & 15
        codes = np.where(first | ((codes >> 2) == _BLANK), codes, (codes & 3) | (_DUPLICATE << 2))
        starts = np.concatenate([[0], np.cumsum(~mark)])[starts]
        parts = [sums(codes[starts[a]:starts[b]], starts[a:b + 1] - starts[a])
                 for a, b in _runs(np.diff(starts))]
        table = np.column_stack([batch.column("block").to_numpy(), np.concatenate(parts)]) if parts else \
            np.zeros((0, _WIDTH), dtype=np.int64)
        held = codes.astype(np.uint8).tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("block"),
             pa.array([held[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())], pa.binary()),
             pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1) * _WIDTH, pa.int32()),
                                      pa.array(table.ravel(), pa.int64()))],
            ["conv", "block", "codes", "sum"])


def _chain_up(batches):
    for batch in batches:
        lists, starts = _lists(batch.column("sums"))
        table = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, _WIDTH)
        entries, exits, cost, counts = chain(table, starts)
        sizes, leads = np.diff(starts), np.zeros(len(table), dtype=bool)
        leads[starts[:-1]] = True
        ends = np.zeros(len(table), dtype=bool)
        ends[starts[1:] - 1] = True
        whose = np.repeat(np.arange(len(sizes)), sizes)

        def once(values):
            return pa.array(np.where(leads, values[whose], 0), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(table[:, 0], pa.int64()), pa.array(entries, pa.int64()), pa.array(exits, pa.int64()),
             pa.array(ends), once(cost), *(once(counts[:, i]) for i in range(4))],
            ["block", "entry", "exit", "ends", "cost", "blank", "duplicate", "truncated", "illegal"])


def _read_off(batches):
    for batch in batches:
        held = [np.frombuffer(c, dtype=np.uint8) for c in batch.column("codes").to_pylist()]
        entries, exits = (batch.column(c).to_numpy() for c in ("entry", "exit"))
        sizes, audits = np.array([len(c) for c in held], dtype=np.int64), []
        for a, b in _runs(sizes):
            audits += paths(np.concatenate(held[a:b]).astype(np.int64),
                            np.concatenate([[0], np.cumsum(sizes[a:b])]), entries[a:b], exits[a:b])
        audits = [a + _END_AUDIT[x] if e else a for a, x, e in zip(
            audits, exits.tolist(), batch.column("ends").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("block"), pa.array([a.decode() for a in audits], pa.string()),
             *(batch.column(c) for c in _COUNTS)], ["conv", "block", "audit", *_COUNTS])


_COUNTS = ["cost", "blank", "duplicate", "truncated", "illegal"]


def repaired(audit: str, rows):
    """(role, text) of a repaired conversation, from its audit and its rows in order."""
    state, rows = 0, iter(rows)
    for letter in audit:
        if letter == "I":
            yield _SPEAKER[state], ""
        else:
            role, text = next(rows)
            if letter == "D":
                continue
            if letter == "K":
                yield role, text
                state = int(_KEEP[state, 1 + _INITIALS.index(role[0])])
                continue
            yield _SPEAKER[state], text
        state = int(_SPEAK[state])


def _digests(schema: pa.Schema):
    """A stream of conversations, each as its head and its rows in order -> heads with their digest."""
    def stream(batches):
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("head", "role", "text")))

    def run(batches):
        rows, held = stream(batches), []
        head = next(rows, None)
        while head is not None:
            following = None

            def own():  # up to the next head; texts pass one by one
                nonlocal following
                for h, role, text in rows:
                    if h is not None:
                        following = (h, role, text)
                        return
                    yield role, text
            digest, mine, comma = hashlib.sha256(), own(), ""
            for role, text in repaired(head[0]["audit"], mine):
                digest.update(f"{comma}{role}:{text}".encode())
                comma = "\n"
            for _ in mine:
                raise ValueError("more rows than the audit has edits")
            held.append(head[0] | {"repaired_sha256": digest.hexdigest()})
            if len(held) >= 1000:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held = []
            head = following
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
    return run


def damaged(df: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """conv, turn, role, text, times: planted damage by crc32(`conv:turn`) % 20; nulls count as one space.

    0 drops the row (times 0), 1 empties its text, 2 removes its sentence ends,
    3 repeats it (times 2), 4 makes it a user's.
    """
    def text_of(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of(conv_col), F.lit(":"), text_of(turn_col)).cast("binary")) % 20
    return df.select(
        F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(text_of(role_col)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text_of(text_col), ".!?", ""))
        .otherwise(text_of(text_col)).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"))


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of `rows` (conv, turn, role, text, times): its faults, cost, audit and digest.

    A row stands `times` times; conversations whose rows all have times 0 are
    returned with zeros, an empty audit and the digest of the empty string. Rows
    go by turn, nulls first; ties by the digest of role and text. Null role or
    text is one space. A null conversation is one of its own. An empty role has
    no initial, so it is never kept. Gaps that leave a long are null. An empty
    table gives an empty result. The rows are sorted and the blocks summed up
    when this is called (two checkpoints); the rest is lazy.
    """
    rows = rows.select("conv", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                       F.coalesce("text", F.lit(" ")).alias("text"), "times").withColumn(
        "digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
                                 .cast("binary"), 256)))
    end = F.rtrim("text", F.lit(_WHITE))
    fault = (F.when(end == "", _BLANK).when(F.substring(end, -1, 1).isin(".", "!", "?"), _FINE)
             .otherwise(_TRUNCATED))
    initial = F.when(F.col("role") == "", 0).otherwise(F.instr(F.lit(_INITIALS), F.substring("role", 1, 1)))
    light = rows.select(
        "conv", "turn", "digest", F.explode(F.array_repeat(
            F.when(F.col("times") == 0, -1).otherwise(fault * 4 + initial), F.greatest("times", F.lit(1)))
        ).alias("code")).withColumn("salt", F.monotonically_increasing_id())  # equal rows can be cut apart
    order = ["conv", F.col("turn").asc_nulls_first(), "digest", "salt"]
    light = cut(light.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt")
                .withColumn("pos", F.monotonically_increasing_id()))
    there = light.where("code >= 0")
    heads = light.groupBy("conv").agg(*(f(F.expr("if(code >= 0, turn, null)")).alias(n) for f, n in (
        (F.min, "low"), (F.max, "high"), (F.count_distinct, "n_turns"))))
    firsts = there.groupBy("conv", "digest").agg(F.min("pos").alias("pos"))
    marked = there.select("conv", "pos", "code").unionAll(firsts.select("conv", "pos", F.lit(16).alias("code")))
    blocks = marked.groupBy("conv", F.floor(F.col("pos") / BLOCK).alias("no")).agg(
        F.min("pos").alias("block"),
        F.sort_array(F.collect_list(F.shiftleft(F.col("pos").bitwiseAND(BLOCK - 1), 5) + F.col("code")))
        .alias("marked"))
    kind = rows.schema["conv"].dataType.simpleString()
    blocks = cut(blocks.select("conv", "block", "marked").mapInArrow(
        _sum_up, f"conv {kind}, block long, codes binary, sum array<long>"))
    chained = blocks.groupBy("conv").agg(F.sort_array(F.collect_list("sum")).alias("sums")).mapInArrow(
        _chain_up, "block long, entry long, exit long, ends boolean, " + ", ".join(f"{c} long" for c in _COUNTS))
    read = blocks.select("conv", "block", "codes").join(chained, "block").mapInArrow(
        _read_off, f"conv {kind}, block long, audit string, " + ", ".join(f"{c} long" for c in _COUNTS))
    audits = read.groupBy("conv").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "")
        .alias("audit"), *(F.sum(c).alias(c) for c in _COUNTS))
    gaps = (F.col("high").cast("decimal(20,0)") - F.col("low").cast("decimal(20,0)") + 1
            - F.col("n_turns").cast("decimal(20,0)"))
    heads = heads.alias("h").join(audits.alias("a"), F.col("h.conv").eqNullSafe(F.col("a.conv")), "left").select(
        F.col("h.conv").alias("conv"),
        F.when(F.col("high").isNull(), F.lit(0).cast("long")).otherwise(gaps.try_cast("long")).alias("gaps"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COUNTS),
        F.coalesce("audit", F.lit("")).alias("audit"))
    texts = rows.withColumn("copy", F.explode(F.array_repeat(F.lit(True), F.col("times").cast("int"))))
    # The head of a conversation comes before its rows, wherever these are sorted to.
    both = heads.select("conv", F.struct("*").alias("head")).unionByName(
        texts.select("conv", "turn", "digest", "role", "text"), allowMissingColumns=True)
    schema = StructType([*heads.schema.fields, StructField("repaired_sha256", StringType())])
    return (both.repartition("conv").sortWithinPartitions(
        "conv", F.col("head").isNull(), F.col("turn").asc_nulls_first(), "digest")
        .select("head", "role", "text").mapInArrow(_digests(to_arrow_schema(schema)), schema))
