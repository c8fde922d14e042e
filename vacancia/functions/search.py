"""Many plain words in long texts, in one pass over the bytes of a batch.

A pattern is a list of plain alternatives, each a literal that may begin with `\\b` and end with `\\b` or
`\\s`. All literals of all patterns are searched together: one look-up per pair of bytes says which of them
have that pair, their rarest one, so few places are left to compare. Next to ASCII, a Latin letter or a
dash or quote a boundary is decided there; next to any other character it stays open, and Spark's regex
decides. Letters are lower-cased on the way, so that only texts with something open need be.
"""

from __future__ import annotations

import re
import sys
from functools import reduce
from operator import or_
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .text import UNICODE, alternative

_PER_WORD, _SLICE = 63, 1 << 20
_PLAIN = re.compile(r"(\\b)?((?:\\\.|[^\\.^$*+?()\[\]{}|])+)(\\[bs])?")
_WORD = np.array([chr(i).isalnum() or i == 95 for i in range(128)] + [False] * 128)
_SPACE = np.array([i in (9, 10, 11, 12, 13, 32) for i in range(256)])
_DIGIT = np.array([48 <= i < 58 for i in range(256)])
# Letters outside ASCII whose lower case holds an ASCII letter.
_TO_ASCII = {c: c.lower() for c in ("\u0130", "\u212a")}
# From frequent to rare in prose; what is not here is taken as rarest.
_FREQUENT = b" etaoinsrhldcumfpg.wybvkxjqz"
_FREQUENT_PAIRS = b"th he in er an re nd on en at ou ed ha to or it is hi es ng ch de se ar te nt st le al ti me ic".split()
# The functions travel with the plan, so executors need numpy and pyarrow alone.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
# A number before a unit of time, at the literal that follows it: digits, perhaps a plus, perhaps white space.
NUMBER = "#"
# In place of a number of years: none is stated, or Spark's regexes have to say.
NONE, OPEN = -1, -2


class Word(NamedTuple):
    literal: bytes
    lead: str
    tail: str


def plain(pattern: str) -> Word | None:
    """An alternative as a literal with its conditions, or None if it is more than that."""
    if pattern.startswith(NUMBER):
        return Word(pattern[1:].encode(), NUMBER, "")
    found = _PLAIN.fullmatch(pattern)
    if not found or pattern != pattern.lower():
        return None
    literal = found[2].replace("\\.", ".")
    if not literal.isascii():
        return None
    return Word(literal.encode(), found[1] or "", found[3] or "")


def _core(pattern: str) -> str | None:
    """The longest literal that any match holds, where '.' is all that the alternative has besides literals."""
    parts = pattern.split(".")
    if all(p and plain(p) for p in parts) and "\\" not in pattern:
        return max(parts, key=len)
    return None


def _complex(pattern: str) -> bool:
    """Whether a pattern is more than a list of alternatives in lower case."""
    return bool(set(pattern) & set("()[]{}*+?^$")) or pattern != pattern.lower()


class TextSearch:
    """The plain alternatives of some patterns, searched together."""

    def __init__(self, patterns):
        self.words: dict[str, int] = {}
        self.cores: set[str] = set()
        self.plain = True  # whether no pattern has to run on every text
        for pattern in patterns:
            self.plain &= not _complex(pattern)
            for part in pattern.split("|"):
                word = part if plain(part) else _core(part)
                if word:
                    self.words.setdefault(word, len(self.words))
                else:
                    self.plain = False
                if word != part:
                    self.cores |= {word} - {None}

    def hits(self, text: Column | str) -> Column:
        """Per 63 words two numbers: s, bits of the words a text holds in any case, and m, of those that stay open.

        With the word `#year` also y, the years of experience (see `_stated`).
        """
        words = [plain(p) for p in self.words]
        numbers = -(-len(words) // _PER_WORD)
        names = [f"{kind}{i}" for i in range(numbers) for kind in "sm"] + ["y"]
        kind = StructType([StructField(n, LongType()) for n in names])

        @F.arrow_udf(kind)
        def search(texts: pa.Array) -> pa.Array:
            sure, open_, years = find(texts, words)
            return pa.StructArray.from_arrays(
                [pa.array(part[i]) for i in range(numbers) for part in (sure, open_)] + [pa.array(years)], names)

        return search(text)

    def lowered(self, text: Column | str, found: str, rest=()) -> Column:
        """The text in lower case where regexes may have to run: where a word or the years stay open, or a word
        of the patterns in `rest` or part of a longer alternative is held. Null elsewhere."""
        low = F.lower(text)
        if not self.plain:
            return low
        tests = [F.col(f"{found}.m{n}") != 0 for n in range(-(-len(self.words) // _PER_WORD))]
        tests += [F.col(f"{found}.y") == OPEN, *[self.held(found, p) for p in rest],
                  *[self.held(found, core) for core in self.cores]]
        return F.when(reduce(or_, tests), low)

    def _bit(self, found: str, kind: str, parts) -> Column:
        masks: dict[int, int] = {}
        for part in parts:
            number, bit = divmod(self.words[part], _PER_WORD)
            masks[number] = masks.get(number, 0) | 1 << bit
        return reduce(or_, [F.col(f"{found}.{kind}{n}").bitwiseAND(F.lit(mask).cast("long")) != 0
                            for n, mask in masks.items()])

    def held(self, found: str, pattern: str) -> Column:
        """Whether a text may match any alternative, all of them plain; what stays open counts."""
        parts = pattern.split("|")
        return self._bit(found, "s", parts) | self._bit(found, "m", parts)

    def matches(self, low: Column, found: str, pattern: str) -> Column:
        """Whether a text matches the pattern; regexes run only where the search leaves it open."""
        if _complex(pattern):
            return low.rlike(UNICODE + pattern)
        parts = pattern.split("|")
        known = [p for p in parts if p in self.words]
        tests = [self._bit(found, "s", known)] if known else []
        tests += [self._bit(found, "m", [p]) & alternative(low, p) for p in known if plain(p).lead or plain(p).tail]
        tests += [self.held(found, _core(p)) & alternative(low, p) if _core(p) in self.words else alternative(low, p)
                  for p in parts if p not in self.words]
        return reduce(or_, tests)


def find(texts: pa.Array, words: list[Word]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of the words each text holds, and of those it may hold: one row of numbers per 63 words; years stated."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    numbers, all_words = -(-len(words) // _PER_WORD), [*words, *[Word(c.encode(), "", "") for c in _TO_ASCII]]
    sure = np.zeros((-(-len(all_words) // _PER_WORD), len(texts)), np.int64)
    open_, years = np.zeros_like(sure), np.full(len(texts), NONE, np.int64)
    if not len(texts) or texts.buffers()[2] is None:
        return sure[:numbers], open_[:numbers], years
    raw, ends = _bytes(texts)
    tables = _tables(all_words)
    row = 0
    while row < len(texts):  # slices that stay in the cache; a longer text is one of its own
        last = max(row + 1, int(np.searchsorted(ends, ends[row] + _SLICE, "right")) - 1)
        last = min(last, len(texts))
        _find(raw[ends[row]:ends[last]], ends[row:last + 1] - ends[row], all_words, tables, sure[:, row:last],
              open_[:, row:last], years[row:last])
        row = last
    again = np.zeros(len(texts), bool)
    for i in range(len(words), len(all_words)):
        number, bit = divmod(i, _PER_WORD)
        again |= sure[number] & (1 << bit) != 0
    sure, open_ = sure[:numbers], open_[:numbers]
    if again.any():
        rows = np.flatnonzero(again)
        texts = texts.take(pa.array(rows))
        for letter, ascii_ in _TO_ASCII.items():
            texts = pc.replace_substring(texts, letter, ascii_)
        sure[:, rows], open_[:, rows], years[rows] = find(texts, words)
    return sure, open_, years


def _bytes(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of all texts, and where each text begins and the last one ends."""
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    ends = np.frombuffer(texts.buffers()[1], width)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    return texts.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes(), ends - ends[0]


def _rarest_pair(word: Word) -> tuple[int, list[int], list[int]]:
    """Offset of two bytes of a word, and what the first and the second of them may be."""
    literal = word.literal
    if len(literal) == 1:
        foreign, every = np.arange(256) >= 128, list(range(256))
        if word.lead == r"\b":
            return -1, list(np.flatnonzero(foreign | (_WORD != _WORD[literal[0]]))), [literal[0]]
        return 0, [literal[0]], every
    rank = [_FREQUENT.find(bytes([b])) % (len(_FREQUENT) + 1) + 1 for b in literal]
    at = max(range(len(literal) - 1),
             key=lambda i: rank[i] * rank[i + 1] / (10 if literal[i:i + 2] in _FREQUENT_PAIRS else 1))
    return at, [literal[at]], [literal[at + 1]]


def _tables(words: list[Word]):
    """Per pair of bytes the number of the set of words that may stand there; per word its offset and its sets."""
    offsets, holders = [], {}
    for i, word in enumerate(words):
        offset, first, second = _rarest_pair(word)
        offsets.append(offset)
        for a in first:
            for b in second:
                holders.setdefault(int(a) | int(b) << 8, []).append(i)
    numbers = {s: n for n, s in enumerate(sorted({tuple(h) for h in holders.values()}), 1)}
    table = np.zeros(1 << 16, np.uint8 if len(numbers) < 256 else np.uint16)
    for pair, held_by in holders.items():
        table[pair] = numbers[tuple(held_by)]
    return table, len(numbers), [(offset, [n for s, n in numbers.items() if i in s]) for i, offset in enumerate(offsets)]


def _filled(values: np.ndarray) -> np.ndarray:
    """Places that are not zero, where few are: eight bytes are looked at together first."""
    eights = values.view(np.uint64)
    some = np.flatnonzero(eights != 0)
    width = 8 // values.itemsize
    places = (some[:, None] * width + np.arange(width)).ravel()
    return places[eights[some].view(values.dtype) != 0]


def _find(part: bytes, ends: np.ndarray, words, tables, sure: np.ndarray, open_: np.ndarray, years: np.ndarray) -> None:
    table, sets, of_word = tables
    size = len(part)
    data = np.zeros(size + max(len(w.literal) for w in words) + 1, np.uint8)
    data[:size] = np.frombuffer(part, np.uint8)
    data += ((data - np.uint8(ord("A"))) < 26).view(np.uint8) << 5
    pairs = data[1:size + 1].astype(np.uint16)
    pairs <<= 8
    pairs |= data[:size]
    kinds = np.zeros(-(-size // 8) * 8, table.dtype)
    table.take(pairs, mode="clip", out=kinds[:size])  # no pair is out of bounds; the other modes check each
    places = _filled(kinds)
    kinds = kinds[places]
    order = np.argsort(kinds, kind="stable")
    places = places[order]
    borders = np.searchsorted(kinds[order], np.arange(sets + 2))
    for i, word in enumerate(words):
        offset, mine = of_word[i]
        at = np.concatenate([places[borders[n]:borders[n + 1]] for n in mine]) - offset
        if len(word.literal) == 1:  # what stands beside the text is another text
            at = np.concatenate([at, ends[:-1], ends[1:] - 1])
            at = at[(at >= 0) & (at < size)]
        elif offset:
            at = at[at >= 0]
        for j, byte in enumerate(word.literal):
            if not len(at):
                break
            at = at[data[at + j] == byte]
        if not len(at):
            continue
        text = np.searchsorted(ends, at, "right") - 1
        after = at + len(word.literal)
        whole = after <= ends[text + 1]
        at, text, after = at[whole], text[whole], after[whole]
        good, unsure = _conditions(data, word, at, after, ends[text], ends[text + 1])
        number, bit = divmod(i, _PER_WORD)
        for out, chosen in ((sure, good), (open_, unsure)):
            rows = np.zeros(out.shape[1], np.int64)
            rows[text[chosen]] = 1 << bit
            out[number] |= rows
        if word == _YEAR:
            _years(data[:size].tobytes(), ends, at[good], text[good], years)


_YEAR = Word(b"year", NUMBER, "")
_UNIT, _BLANK = re.compile(rb"years?\s*(?:of\s*)?"), b" \t\n\x0b\f\r"


def _years(part: bytes, ends: np.ndarray, places, texts, years: np.ndarray) -> None:
    """Years stated in each text: of its first place per pattern, that of the first pattern."""
    best: dict[int, tuple[int, int]] = {}
    for place, text in zip(places.tolist(), texts.tolist()):
        for rank, value in _stated(part, int(ends[text]), place, int(ends[text + 1])):
            if text not in best or rank < best[text][0]:
                best[text] = rank, value
    for text, (_, value) in best.items():
        years[text] = value


def _back(part: bytes, start: int, end: int, among: bytes) -> int:
    """Where the run of such bytes begins that ends before `end`."""
    while end > start and part[end - 1] in among:
        end -= 1
    return end


# What ends in such bytes is a Latin letter, a dash, a quote or a dot: neither blank nor digit (see `_known`).
_NO_BLANK = re.compile(rb"[\xc3-\xc8].|\xe2\x80[\x90-\xa7]", re.DOTALL)


def _strange(part: bytes, start: int, at: int, end: int) -> bool:
    """Whether the byte before `at` belongs to a character that may be a blank or a digit outside ASCII."""
    if not start < at <= end or part[at - 1] < 128:
        return False
    first = at - 1
    while first > start and part[first] & 0xC0 == 0x80:
        first -= 1
    return not _NO_BLANK.match(part, first, end)


def _stated(part: bytes, start: int, place: int, end: int):
    """(rank, number) for each of the patterns `YEARS_PATTERNS` that match at a "year" after a number.

    Rank -1 stays open: a character that is not ASCII stands where it may be a blank or a digit, or the
    number is long.
    """
    unit = _UNIT.match(part, place, end).end()
    blank = _back(part, start, place, _BLANK)
    plus = blank > start and part[blank - 1] == ord("+")
    last = blank - plus
    first = _back(part, start, last, b"0123456789")
    before = _back(part, start, first, _BLANK)
    of = _back(part, start, before - 2, _BLANK) if before - 2 >= start and part[before - 2:before] == b"of" else before
    ranged = first > start and part[first - 1] == ord("-")
    low = _back(part, start, first - 1, b"0123456789") if ranged else first
    edges = [blank, last, first] + ([] if plus else [before, of]) + ([low, first - 1] if ranged else [])
    if (any(_strange(part, start, i, end) for i in edges) or _strange(part, start, unit + 1, end)
            or max(last - first, first - low) > 18):
        return [(-1, OPEN)]
    if first == last:
        return []
    out = []
    if part.startswith(b"experience", unit) and unit + 10 <= end:
        out.append((0, int(part[first:last])))
    if ranged and not plus and low < first - 1 and part.startswith(b"years", place) and place + 5 <= end:
        out.append((1, int(part[low:first - 1])))
    if not plus and of - 7 >= start and part[of - 7:of] == b"minimum":
        out.append((2, int(part[first:last])))
    return out


def _known(data, foreign, two, three, start, end):
    """Whether a Latin letter of two bytes stands at `two`, or a dash, quote or dot of three bytes at `three`.

    Only looked at where the byte is foreign. They are U+00C0 to U+023F without the signs for times and divided
    by, and U+2010 to U+2027: word characters and none, whatever the version of Unicode, and no blanks.
    """
    letter, sign = np.zeros(len(foreign), bool), np.zeros(len(foreign), bool)
    rows = np.flatnonzero(foreign)
    if not len(rows):
        return letter, sign
    two, three, start, end = two[rows], three[rows], start[rows], end[rows]
    last = len(data) - 1

    def byte(at):
        return data[np.clip(at, 0, last)]
    lead, tail = byte(two), byte(two + 1)
    letter[rows] = ((two >= start) & (two + 2 <= end) & (lead >= 0xC3) & (lead <= 0xC8) & (tail >= 0x80)
                    & (tail < 0xC0) & ~((lead == 0xC3) & ((tail == 0x97) | (tail == 0xB7))))
    sign[rows] = ((three >= start) & (three + 3 <= end) & (byte(three) == 0xE2) & (byte(three + 1) == 0x80)
                  & (byte(three + 2) >= 0x90) & (byte(three + 2) <= 0xA7))
    return letter, sign


def _conditions(data, word: Word, at, after, start, end):
    """Which places fulfil the word's conditions, and which of the others may."""
    good, unsure = np.ones(len(at), bool), np.zeros(len(at), bool)
    if word.lead == NUMBER:
        place = at - 1
        while (blank := (place >= start) & _SPACE[data[place]]).any():
            place = place - blank
        place = place - ((place >= start) & (data[place] == ord("+")))
        byte = data[place]
        good = (place >= start) & (_DIGIT[byte] | (byte >= 128))
    elif word.lead:
        inside, byte = at > start, data[at - 1]
        foreign = inside & (byte >= 128)
        letter, sign = _known(data, foreign, at - 2, at - 3, start, at)
        good = (inside & (_WORD[byte] | letter)) != _WORD[word.literal[0]]
        unsure = foreign & ~letter & ~sign
    if word.tail:
        inside, byte = after < end, data[after]
        foreign = inside & (byte >= 128)
        letter, sign = _known(data, foreign, after, after, after, end)
        foreign &= ~letter & ~sign
        if word.tail == r"\s":
            right = inside & _SPACE[byte]
        else:
            right = (inside & (_WORD[byte] | letter)) != _WORD[word.literal[-1]]
        # Open where one side is and the other does not rule the place out.
        unsure = (unsure & (right | foreign)) | (good & foreign)
        good = good & right & ~foreign
    return good & ~unsure, unsure
