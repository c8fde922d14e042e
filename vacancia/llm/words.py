"""Words and word shingles of texts as 64-bit hashes, for whole batches at once.

A word is a run of ASCII letters, ASCII digits and characters beyond ASCII in
the lower-cased text. A shingle is `width` words in a row; a text of fewer
words has one shingle of all of them, a text without words has none.
Everything works on the joined bytes of a batch, so a long text costs its
length and a short one no Python loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
_P = _U(0x100000001B3)  # odd, so it has an inverse modulo 2^64
_P_INVERSE = _U(pow(0x100000001B3, -1, 1 << 64))
_IN_WORD = np.array([chr(b).isalnum() or b >= 128 for b in range(128)] + [True] * 128)
SHINGLE_WORDS = 5


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values (the splitmix64 finish)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def slices(texts: list, limit: int = 1 << 20) -> Iterator[slice]:
    """Cut a batch into runs of about `limit` characters (one text at least)."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text) if text is not None else 0
        if i > start and size + n > limit:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(texts):
        yield slice(start, len(texts))


def word_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the offset of each text's first one.

    Nulls count as empty. The offsets have one entry more than the texts.
    """
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    inside = np.concatenate(([False], _IN_WORD[data]))  # the last byte is a break
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edges[0::2], edges[1::2]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * _powers(_P, len(data)), out=sums[1:])
    hashes = (sums[last] - sums[first]) * _powers(_P_INVERSE, len(data))[first]
    hashes = mix(hashes + _U(0x9E3779B97F4A7C15) * (last - first).astype(np.uint64))
    ends = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
    return hashes, np.concatenate(([0], np.searchsorted(first, ends))).astype(np.int64)


def word_hash(word: str) -> np.uint64:
    hashes, _ = word_hashes([word])
    if len(hashes) != 1:
        raise ValueError(f"not one word: {word!r}")
    return hashes[0]


def shingles(texts: list, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in order (repeats included) and their offsets."""
    words, at = word_hashes(texts)
    counts = np.diff(at)
    long = counts >= width
    combined = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
    for i in range(width):
        combined = combined * _U(0x9E3779B97F4A7C15) + words[i:i + len(combined)]
    combined = mix(combined)
    n = np.where(long, counts - width + 1, (counts > 0).astype(np.int64))
    out_at = np.concatenate(([0], np.cumsum(n)))
    out = np.empty(int(out_at[-1]), dtype=np.uint64)
    owner = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(out)) - out_at[owner] + at[owner]
    from_long = long[owner]
    out[from_long] = combined[place[from_long]]
    for i in np.flatnonzero(~long & (counts > 0)):
        h = _U(0)
        with np.errstate(over="ignore"):
            for w in words[at[i]:at[i + 1]]:
                h = h * _U(0x9E3779B97F4A7C15) + w
            h = h + _U(int(counts[i]))
        out[out_at[i]] = mix(np.array([h]))[0]
    return out, out_at


def shingle_sets(texts: list, width: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    out, at = shingles(texts, width)
    return [np.unique(out[a:b]) for a, b in zip(at[:-1], at[1:])]
