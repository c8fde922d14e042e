"""Byte-pair encoding by an index of pair occurrences, and decoding.

All pre-tokens a run of texts brings anew are laid out in one array of symbols.
An index maps each pair (by its rank) to all its positions. The active ranks
are worked off in ascending order: every occurrence of the pair is merged at
once, and only the lists of the pairs beside the merged places are extended.
A symbol's rank is always below the ranks of the pairs it takes part in, so one
pass over the ranks is complete; this is checked when the file is read.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .pretokens import BYTE_LETTERS, Known, Learned, Pretokenizer
from .tables import vocabulary_file
from .words import slices


class PairIndexEncoder:
    """Encodes lists of pre-tokens; ids as the file has them."""

    def __init__(self, cutter: Pretokenizer):
        self.cutter = cutter
        ids = cutter.ids
        n = len(ids) + 1
        born: dict[str, int] = {}
        left, right, made = [], [], []
        for rank, (a, b) in enumerate(cutter.merges):
            if max(born.get(a, -1), born.get(b, -1)) >= rank or a + b in born:
                raise ValueError(f"merge {rank} comes before its parts")
            born[a + b] = rank
            left.append(ids[a])
            right.append(ids[b])
            made.append(ids[a + b])
        self.left, self.right, self.made = (np.array(x, dtype=np.int64) for x in (left, right, made))
        keys = self.left * n + self.right
        self.order = np.argsort(keys)
        self.keys, self.n = keys[self.order], n
        self.first = np.array([ids.get(c, -1) for c in BYTE_LETTERS], dtype=np.int64)
        self.last = np.array([ids.get(c + cutter.word_end, -1) for c in BYTE_LETTERS],
                             dtype=np.int64)
        self.byte_of = {c: b for b, c in enumerate(BYTE_LETTERS)}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 for none."""
        if not len(self.keys):
            return np.full(len(a), -1, dtype=np.int64)
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def encode(self, pretokens: list[str]) -> list[bytes]:
        """The ids of each pre-token as little-endian unsigned 32-bit integers."""
        cutter, byte_of = self.cutter, self.byte_of
        raw = [b"" if w in cutter.special
               else bytes(map(byte_of.__getitem__, w[1:])) if w[0] == "\0" and len(w) > 1
               else w.encode("utf-8") for w in pretokens]
        symbols, ends = self._merged(raw)
        data, out, start = symbols.astype("<u4").tobytes(), [], 0
        for w, end in zip(pretokens, (ends * 4).tolist()):
            out.append(cutter.special[w].to_bytes(4, "little") if w in cutter.special
                       else data[start:end])
            start = end
        return out

    def _merged(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(r) for r in raw], dtype=np.int64)
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        total = len(data)
        stop = np.cumsum(sizes)
        symbol = self.first[data]
        is_last = np.zeros(total, dtype=bool)
        is_last[stop[sizes > 0] - 1] = True
        symbol[is_last] = self.last[data[is_last]]
        after = np.where(is_last, -1, np.arange(1, total + 1))
        is_first = np.zeros(total, dtype=bool)
        is_first[(stop - sizes)[sizes > 0]] = True
        before = np.where(is_first, -1, np.arange(-1, total - 1))
        alive = np.ones(total, dtype=bool)

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(places: np.ndarray) -> None:
            """Enter the pairs that begin at these places."""
            rank = self.ranks(symbol[places], symbol[after[places]])
            found = rank >= 0
            rank, places = rank[found], places[found]
            if not len(rank):
                return
            by_rank = np.argsort(rank, kind="stable")
            rank, places = rank[by_rank], places[by_rank]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, chunk in zip(rank[np.concatenate(([0], cuts))].tolist(),
                                np.split(places, cuts) if len(cuts) else [places]):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(chunk)

        add(np.flatnonzero(~is_last))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            places = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            a, b = self.left[rank], self.right[rank]
            places = places[alive[places] & (symbol[places] == a) & (after[places] >= 0)]
            places = places[symbol[after[places]] == b]
            if a == b and len(places) > 1:  # of overlapping pairs every other one, from the left
                joined = np.concatenate(([False], after[places[:-1]] == places[1:]))
                number = np.arange(len(places))
                run = np.maximum.accumulate(np.where(joined, 0, number))
                places = places[(number - run) % 2 == 0]
            if not len(places):
                continue
            gone = after[places]
            then = after[gone]
            alive[gone] = False
            symbol[places] = self.made[rank]
            after[places] = then
            before[then[then >= 0]] = places[then >= 0]
            front = before[places]
            add(np.unique(np.concatenate((front[front >= 0], places[then >= 0]))))
        left = np.cumsum(alive)
        ends = np.where(stop > 0, left[stop - 1], 0) if total else np.zeros(len(raw), np.int64)
        return symbol[alive], ends


class Decoder:
    """Text of ids. Files without a decoder join the pieces with spaces; byte-level ones join bytes."""

    def __init__(self, cutter: Pretokenizer):
        self.pieces = {i: t for t, i in cutter.ids.items()}
        self.pieces |= {i: t for t, i in cutter.special.items()}
        self.spaced = cutter.decoder is None
        self.byte_of = {c: b for b, c in enumerate(BYTE_LETTERS)}

    def __call__(self, ids: bytes) -> str:
        pieces = map(self.pieces.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())
        if self.spaced:
            return " ".join(pieces)
        return bytes(map(self.byte_of.__getitem__, "".join(pieces))).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def known_ids(vocabulary: str) -> tuple[Pretokenizer, Known]:
    """Of the worker process: later tasks go on with what earlier ones learned."""
    cutter = Pretokenizer(vocabulary_file(vocabulary))
    return cutter, Known(PairIndexEncoder(cutter).encode)


@lru_cache(maxsize=1)
def decoder(vocabulary: str) -> Decoder:
    return Decoder(Pretokenizer(vocabulary_file(vocabulary)))


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """One row per input row: the id, n_tokens and token_ids (little-endian unsigned 32-bit).

    A null text counts as empty and has no ids. Null and repeated ids are kept.
    Other columns are left out, whatever their names.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches):
        cutter, known = known_ids(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in slices(texts, 4 << 20):
                ids = encoded(texts[part], cutter, known)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.start, part.stop - part.start),
                     pa.array([len(i) // 4 for i in ids], pa.int64()),
                     pa.array(ids, pa.binary())], ["id", "n_tokens", "token_ids"])

    return (rows.mapInArrow(run, f"id {id_type}, n_tokens long, token_ids binary")
            .withColumnRenamed("id", id_col))


def encoded(texts: list, cutter: Pretokenizer, known: Known | Learned) -> list[bytes]:
    """The ids of each text: the known ids of its pre-tokens, one after the other."""
    return [b"".join(ids) for ids in known.lookup([cutter(t) for t in texts])]


def decode(df: DataFrame, vocabulary: str, ids_col: str = "token_ids",
           out_col: str = "decoded") -> DataFrame:
    """All columns but the ids, and the decoded text (null for null ids).

    A column named like the result is replaced.
    """
    keep = [c for c in df.columns if c not in (ids_col, out_col)]
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(ids_col).alias(ids_col))
    kept = rows.drop(ids_col).schema

    def run(batches):
        text_of = decoder(vocabulary)
        for batch in batches:
            ids = batch.column(len(keep))
            size = max(1, (1 << 20) * batch.num_rows // (1 + ids.nbytes // 4))
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                texts = [None if i is None else text_of(i)
                         for i in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(texts, pa.string())], [*keep, out_col])

    from pyspark.sql.types import StringType, StructField, StructType
    return rows.mapInArrow(run, StructType([*kept.fields, StructField(out_col, StringType())]))
