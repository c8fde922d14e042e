"""Merkle manifest of a dataset, and proofs read from its content-addressed records.

Rows are leaves. Per group they ascend by key; every 3 consecutive nodes become
the digest of their digests until one, the subroot, remains; the subroots in
order of their groups become the root likewise.

Each inner node is a record: its digest -> its children. The records of up to
LEVELS levels below a node lie together in one pack, found by the digest of that
node; equal packs are stored once. A request for a leaf starts at the root
and goes down by the digits (base 3) of its rank: a record's child at the digit is
where it goes on, the other children are collected. Requests for leaves below
the same pack go down to it once. Each pack gives a segment of the path from the
top; the segments are reversed, so that a proof runs from the leaf to the root.

Ranks need no group in one task: rows are sorted over the cluster, and only counts
per (task, group) are summed up along a group. A pack's lowest level holds 3 ** LEVELS nodes.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from vacancia.sources.workspace import materialize

from .tables import cut

FAN = 3
LEVELS = 7  # so a pack's lowest level has at most 2187 nodes


def digest(parts) -> str:
    """H: sha256 of concatenated hexadecimal digests."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """`-` for null, else UTF-8 byte count, `:`, value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """The digest of a row, in 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, values)).cast("binary"), 256))


def climb(nodes: list[bytes], whole: bool, levels: int = LEVELS) -> tuple[bytes, int, dict[bytes, list[bytes]]]:
    """Root, height and records over some nodes: up to one node if they are the whole level, else `levels` levels."""
    height, records = 0, {}
    while len(nodes) > 1 if whole else height < levels:
        above = []
        for i in range(0, len(nodes), FAN):
            children = nodes[i:i + FAN]
            parent = bytes.fromhex(digest(c.hex() for c in children))
            records[parent] = children
            above.append(parent)
        nodes, height = above, height + 1
    return nodes[0], height, records


def segment(records: dict[bytes, list[bytes]], root: bytes, height: int, place: int) -> tuple[bytes, bytes]:
    """Where the digits of `place` lead from a pack's root, and the steps there, the lowest first.

    A step is a byte (digit * 16 + number of the other children) and the other children.
    """
    steps, node = [], root
    for level in range(height - 1, -1, -1):
        digit = place // FAN ** level % FAN
        children = records[node]
        others = children[:digit] + children[digit + 1:]
        steps.append(bytes([digit * 16 + len(others)]) + b"".join(others))
        node = children[digit]
    return node, b"".join(reversed(steps))


def steps_of(path: bytes) -> list[tuple[int, list[str]]]:
    """(digit, other children) from the lowest step to the root."""
    out, at = [], 0
    while at < len(path):
        digit, n = divmod(path[at], 16)
        out.append((digit, [path[at + 1 + 32 * i:at + 33 + 32 * i].hex() for i in range(n)]))
        at += 1 + 32 * n
    return out


def fold(node: str, steps) -> str:
    """The root that a leaf and its steps give."""
    for digit, others in steps:
        node = digest([*others[:digit], node, *others[digit:]])
    return node


def _one_by_one(batches):
    """Rows as dicts; only one pack is ever unpacked."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _pack_up(levels: int):
    """Lists of (rank, digest) of a tree -> packs."""
    def run(batches):
        for r in _one_by_one(batches):
            node, height, records = climb([x["node"] for x in r["nodes"]], r["n"] <= FAN ** levels, levels)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["tree"]], pa.string()), pa.array([r["no"]], pa.int64()), pa.array([r["n"]], pa.int64()),
                 pa.array([node], pa.binary()), pa.array([height], pa.int32()),
                 pa.array([list(records.items())], pa.map_(pa.binary(), pa.list_(pa.binary())))],
                ["tree", "no", "n", "node", "height", "records"])
    return run


def _numbered(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """Rows with `rank` (gapless from 0 within their tree, by order) and `n`, the tree's number of rows.

    The salt lets equal rows be cut apart, so no key has to fit a task.
    """
    by = [F.col(tree), *(F.col(o).asc_nulls_first() for o in order), F.col("salt")]
    rows = cut(rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*by)
               .sortWithinPartitions(*by).drop("salt").withColumn("pos", F.monotonically_increasing_id()))
    rows = rows.withColumn("part", F.shiftright("pos", 33))
    counts = rows.groupBy("part", tree).agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("here"))
    along = Window.partitionBy(tree)
    before = along.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", tree, (F.coalesce(F.sum("here").over(before), F.lit(0)) - F.col("first"))
                           .alias("shift"), F.sum("here").over(along).alias("n"))
    return rows.join(starts, ["part", tree]).withColumn("rank", F.col("pos") + F.col("shift")).drop(
        "part", "pos", "shift")


def build(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Packs of trees given by their leaves (tree, rank, n, node), one table per `levels` levels.

    Table k holds the trees that have more than span ** k nodes (span = 3 ** levels), and table 0 all;
    columns tree, no, n (nodes of the tree at its lowest level), node (the digest), height, records.
    The number of tables follows the largest tree: one number reaches the driver.
    """
    span, tables, most = FAN ** levels, [], nodes.agg(F.max("n")).first()[0] or 0
    while not tables or most > span ** len(tables):
        packs = (nodes.groupBy("tree", F.floor(F.col("rank") / span).alias("no"))
                 .agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("rank", "node"))).alias("nodes"))
                 .mapInArrow(_pack_up(levels), "tree string, no long, n long, node binary, height int, "
                                       "records map<binary,array<binary>>"))
        tables.append(materialize(packs, "manifest-packs"))
        nodes = tables[-1].where(F.col("n") > span).select(
            "tree", F.col("no").alias("rank"), F.ceil(F.col("n") / span).alias("n"), "node")
    return tables


def _arrive(packs: DataFrame, arrivals: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """Packs reached (tree, no, node, above, ...) with their records and the requests below them."""
    stored = packs.select("node", "height", "records").dropDuplicates(["node"])
    requests = wanted.groupBy("tree", F.floor(F.col("rank") / span).alias("no")).agg(
        F.collect_list(F.struct("rank", "carry")).alias("requests"))
    return arrivals.join(stored, "node").join(requests, ["tree", "no"])


def _go_down(schema: pa.Schema, span: int):
    """Requests go down one pack each: where they come out, and their path to the root."""
    def run(batches):
        for r in _one_by_one(batches):
            records, out = dict(r["records"]), []
            for request in r["requests"]:
                node, steps = segment(records, r["node"], r["height"], request["rank"] % span)
                out.append({"tree": r["tree"], "no": request["rank"], "node": node, "above": steps + r["above"],
                            "subroot": r["subroot"], "root": r["root"], "carry": request["carry"]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    return run


_STATE = "tree string, no long, node binary, above binary, subroot binary, root binary"


def _down(packs: DataFrame, arrivals: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    carry = wanted.schema["carry"].dataType.simpleString()
    ddl = f"{_STATE}, carry {carry}"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return _arrive(packs, arrivals, wanted, span).mapInArrow(_go_down(schema, span), ddl)


def _prove(schema: pa.Schema, span: int):
    """Leaf requests at their lowest pack: proofs, and what the evidence folds to."""
    def run(batches):
        for r in _one_by_one(batches):
            records, above = dict(r["records"]), steps_of(r["above"])
            upper = "".join(s for _, others in above for s in others)
            subroot, root, out = r["subroot"].hex(), r["root"].hex(), []
            for request in r["requests"]:
                node, steps = segment(records, r["node"], r["height"], request["rank"] % span)
                carry, steps = request["carry"], steps_of(steps)
                if node != carry["leaf"]:
                    raise ValueError("the records do not lead to the leaf")
                siblings = "".join(s for _, others in steps for s in others) + upper
                folded = fold(fold((carry["evidence"] or node).hex(), steps), above)
                out.append(carry["kept"] | {
                    "leaf": node.hex(), "subroot": subroot, "root": root, "proof_sha256": digest([siblings]),
                    "folded_root": folded, "verified": folded == root})
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    return run


def prove(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Proofs of all leaves (tree, key, leaf, evidence, kept: a struct), checked with their evidence.

    Columns of `kept`, then leaf, subroot, root, proof_sha256 (of the siblings from
    the leaf up, in hexadecimal), folded_root (from the evidence, or the leaf
    where that is null, and the siblings) and verified. A null tree is one of its own and
    comes first. Leaves ascend by key, nulls first; equal keys by leaf, so
    repeated rows are leaves of their own. An empty table gives an empty result.
    The records are built and stored when this is called; the proofs are lazy.
    """
    span = FAN ** levels
    named = F.when(F.col("tree").isNull(), "-").otherwise(F.concat(F.lit("="), "tree"))  # in the same order
    # Stored before they are sorted, since sorting looks at its rows twice: every text is digested once.
    leaves = materialize(leaves.withColumn("tree", named), "manifest-digests")
    numbered = materialize(_numbered(leaves, "tree", "key", "leaf"), "manifest-leaves")
    nodes = numbered.select("tree", "rank", "n", F.col("leaf").alias("node"))
    packs = build(nodes, levels)

    subroots = packs[0].where(F.col("n") <= span)
    for table in packs[1:]:
        subroots = subroots.unionByName(table.where(F.col("n") <= span))
    subroots = subroots.select(F.lit("").alias("top"), F.col("tree").alias("name"), "node")
    listed = materialize(_numbered(subroots, "top", "name").withColumnRenamed("top", "tree"), "manifest-subroots")
    tops = build(listed.select("tree", "rank", "n", "node"), levels)

    nothing = F.lit(b"")
    arrivals = tops[-1].select("tree", "no", "node", nothing.alias("above"), nothing.alias("subroot"),
                               F.col("node").alias("root"))
    for k in range(len(tops) - 1, 0, -1):
        arrivals = _down(tops[k], arrivals, _below(tops[k - 1], span), span).drop("carry")
    reached = _down(tops[0], arrivals, listed.select("tree", "rank", F.struct("name").alias("carry")), span)
    reached = reached.select(F.col("carry.name").alias("tree"), F.lit(0).cast("long").alias("no"), "node",
                             "above", F.col("node").alias("subroot"), "root")

    arrivals = reached
    for k in range(len(packs) - 1, 0, -1):
        # Trees that end below this table pass it by.
        lower = _down(packs[k], arrivals, _below(packs[k - 1], span), span).drop("carry")
        arrivals = lower.unionByName(arrivals.join(packs[k].select("tree"), "tree", "left_anti"))
    wanted = numbered.select("tree", "rank", F.struct("leaf", "evidence", "kept").alias("carry"))
    schema = StructType([*leaves.schema["kept"].dataType.fields, *(
        StructField(c, StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")),
        StructField("verified", BooleanType())])
    return _arrive(packs[0], arrivals, wanted, span).mapInArrow(_prove(to_arrow_schema(schema), span), schema)


def _below(packs: DataFrame, span: int) -> DataFrame:
    """Requests for all packs of the table below, where their tree goes on above it."""
    return packs.where(F.col("n") > span).select(
        "tree", F.col("no").alias("rank"), F.lit(None).cast("struct<x:int>").alias("carry"))


def manifest(df: DataFrame, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text",
             fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
             tampered: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    A leaf is the digest of `fields`. Where the condition `tampered` holds, the evidence
    is the row without the line feeds of its text; a null condition does not hold.
    Only digests are shuffled, never texts.
    """
    def of(text: Column) -> Column:
        return leaf(*(text if f == text_col else F.col(f"`{f}`") for f in fields))
    text = F.col(f"`{text_col}`")
    evidence = F.lit(None).cast("binary") if tampered is None else F.when(
        tampered & text.contains("\n"), of(F.translate(text, "\n", "")))
    key = F.col(f"`{id_col}`")
    return prove(df.select(F.col(f"`{group_col}`").cast("string").alias("tree"), key.alias("key"),
                           of(text).alias("leaf"), evidence.alias("evidence"),
                           F.struct(key.alias(id_col)).alias("kept")), levels)
