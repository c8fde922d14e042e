"""The manifest and its proofs against plain lists of digests."""

import hashlib
import zlib

import pytest

from vacancia.llm import manifest
from vacancia.llm.queries import op12_manifest

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i:i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def steps(tree, at):
    for level in tree[:-1]:
        start = at // 3 * 3
        run = level[start:start + 3]
        yield run[:at - start], run[at - start + 1:]
        at //= 3


def plain(rows):
    """rows: (doc_id, source, lang, n_chars, text) -> what the manifest says."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, bytes.fromhex(leaf(r))))
        trees[g] = levels([leaf(r) for r in groups[g]])
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for place, g in enumerate(order):
        for at, r in enumerate(groups[g]):
            path = [*steps(trees[g], at), *steps(top, place)]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            node = leaf((*r[:4], r[4].replace("\n", ""))) if tampered else leaf(r)
            for left, right in path:
                node = h("".join([*left, node, *right]))
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[g][-1][0], root, h("".join("".join(a + b) for a, b in path)),
                        node, node == root))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_query_equals_plain_lists(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    got = found(op12_manifest(spark, folder))
    assert got == plain([tuple(r) for r in rows.collect()])
    assert 0 < sum(r[-1] for r in got) < len(got)  # tampering with line feeds is seen


@pytest.mark.parametrize("power", [1, 2, manifest.LEVELS])
def test_packs_of_any_height(spark, power):
    """Nulls, repeated rows, lone leaves, groups by bytes, and trees over several tables of packs."""
    rows = [(i, f"s{i % 2}", "en", i, f"text\n{i}") for i in range(95)]
    rows += [(None, None, None, None, None), (None, None, None, None, None), (5, None, "", 0, ""),
             (7, "é", "de", 1, "x\ny"), (8, "z", None, 1, None), (9, "", "fr", 3, "\n\n"), (9, "", "fr", 3, "")]
    rows += [(1, "s0", "en", 1, "same\n")] * 40 + [(i, f"t{i}", "en", i, "a\n") for i in range(30)]
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    condition = manifest.F.crc32(manifest.F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    table = table.withColumn("leaf", manifest.F.lit("clash")).repartition(4)
    got = found(manifest.manifest(table, tampered=condition, levels=power))
    assert got == plain(rows)


def test_empty_table_and_one_row(spark):
    table = spark.createDataFrame([(3, "s", "en", 1, "a")],
                                  "doc_id long, source string, lang string, n_chars long, text string")
    assert found(manifest.manifest(table)) == [(3, *[leaf((3, "s", "en", 1, "a"))] * 3, h(""),
                                               leaf((3, "s", "en", 1, "a")), True)]
    assert manifest.manifest(table.limit(0)).collect() == []


def test_records_are_found_by_digest():
    """Equal nodes share a record, and a request that the records do not hold is an error."""
    same = [bytes(32)] * 27
    root, height, records = manifest.climb(same, whole=True)
    assert height == 3 and len(records) == 3
    assert all(manifest.segment(records, root, height, i)[0] == bytes(32) for i in range(27))
    with pytest.raises(KeyError):
        manifest.segment(records, bytes(32), 1, 0)
