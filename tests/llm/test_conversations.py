"""Conversation repair against a plain search over all (cost, audit) pairs."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from vacancia.llm import conversations
from vacancia.llm.queries import op11_conversation_repair

COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
WHITE = " \t\n\x0b\x0c\r"
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
SPEAK = [(2, "user"), (2, "user"), (3, "assistant"), (2, "user")]


def spoil(rows):
    """The contract's damage, row by row: conversation -> rows."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        kept = out[conv]
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        kept += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def least(rows):
    """What repair has to say about the rows of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(
        f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        faults.append("blank" if not text.strip(WHITE) else "duplicate" if (role, text) in seen
                      else "truncated" if text.strip(WHITE)[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))

    def better(a, b):
        return min((x for x in (a, b) if x), key=lambda x: x[:2], default=None)

    def with_inserts(best):
        for _ in range(4):
            for s, (to, role) in enumerate(SPEAK):
                if best[to]:
                    cost, audit, lines = best[to]
                    best[s] = better(best[s], (cost + 2, "I" + audit, [role + ":"] + lines))
        return best

    best = with_inserts([(0, "", []), None, None, (0, "", [])])
    for (_, role, text), fault in zip(rows[::-1], faults[::-1]):
        now, extra = [None] * 4, int(fault == "truncated")
        for s, (to, speaker) in enumerate(SPEAK):
            if best[s]:
                now[s] = (best[s][0] + 3, "D" + best[s][1], best[s][2])
            if fault in ("blank", "duplicate"):
                continue
            for letter, price, there, line in (("K", 0, KEEP.get((s, role[:1])), role), ("R", 2, to, speaker)):
                if there is not None and best[there]:
                    cost, audit, lines = best[there]
                    now[s] = better(now[s], (cost + price + extra, letter + audit, [f"{line}:{text}"] + lines))
        best = with_inserts(now)
    cost, audit, lines = best[0]
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def results(df, name="conv"):
    rows = df.collect()
    found = {r[name]: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(found) == len(rows)
    return found


def test_query_equals_plain_search(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    found = op11_conversation_repair(spark, folder)
    assert dict(found.dtypes)["cost"] == dict(found.dtypes)["gaps"] == "bigint"
    assert results(found, "conv_id") == {c: least(r) for c, r in spoil(map(tuple, rows)).items()}


def test_odd_rows_and_a_conversation_of_many_blocks(spark):
    """Nulls in all columns, empty roles, repeated turns and rows, and one conversation over a dozen blocks."""
    pick = random.Random(5).choice
    rows = [(conv, pick([None, *range(30)]), pick(["user", "assistant", "system", "tool", "", None, "u", "User"]),
             pick(["a.", "b", "", None, "c! ", "  \n", "d? ", "e.\x0b", " "]))
            for conv in [*range(60), None] for _ in range(pick([1, 2, 3, 9, 40]))]
    rows += [(99, pick(range(5000)), pick(["user", "assistant", "system"]),
              f"{pick('xyz')}{i % 1500}{pick(['.', ''])}") for i in range(3 * conversations.BLOCK)]
    rows += [(7, -(1 << 62), "user", "far."), (7, 1 << 62, "user", "far.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    found = results(conversations.repair(conversations.damaged(table)))
    want = {c: least(r) for c, r in spoil(rows).items()}
    assert found.keys() == want.keys() and all(found[c] == want[c] for c in want)


def test_names_types_and_empty_tables(spark):
    """Text ids, other column names, clashing extra columns, and gaps that leave a long."""
    table = spark.createDataFrame(
        [("c", -(1 << 63), "user", "one.", "x"), ("c", (1 << 63) - 1, "assistant", "two.", "y")],
        "thread string, at long, who string, said string, conv string")
    assert conversations.damaged(table, "thread", "at", "who", "said").columns == ["conv", "turn", "role", "text", "times"]
    plain = table.selectExpr("thread as conv", "at as turn", "who as role", "said as text", "1 as times", "conv as cost")
    row = conversations.repair(plain).first()
    assert (row.conv, row.gaps, row.audit, row.cost) == ("c", None, "KK", 0)
    assert row.repaired_sha256 == hashlib.sha256(b"user:one.\nassistant:two.").hexdigest()
    gone = conversations.repair(plain.withColumn("times", conversations.F.lit(0))).first()
    assert (gone.gaps, gone.cost, gone.audit, gone.repaired_sha256) == (0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversations.repair(plain.limit(0)).collect() == []


def test_ranks_order_whole_audits():
    """Doubled ranks order the audits of all nodes as the strings themselves do."""
    np = conversations.np
    codes = np.array([6, 2, 13, 3, 0, 14, 7, 2, 2, 3, 1], dtype=np.int64)
    starts = np.array([0, 1, 5, len(codes)])
    cost, letter, to, _ = conversations.solve(codes, starts, np.tile(np.arange(4), (3, 1)))
    rank, _, length = conversations.doubled(letter, to)

    def audit(node):
        return "" if not letter[node] else "DIKR"[letter[node] - 1] + audit(to[node])
    audits = [audit(n) for n in range(len(letter))]
    assert length.tolist() == [len(a) for a in audits]
    assert np.unique(audits, return_inverse=True)[1].tolist() == rank.tolist()
