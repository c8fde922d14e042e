"""License notices in texts, by patience alignment with templates.

A passage is aligned with a template word by word: words that occur once in
both are anchors, the longest increasing run of them is kept, and the gaps
between anchors are aligned in the same way. A gap without anchors gets its
longest common subsequence. Coverage is the share of the template's words that
found their place.

Words in brackets name the license (name, version, BY/NC/SA). They must stand in
the passage in full and without foreign words between them; the rest of the
template is aligned before, between and behind them. A passage within that of a
longer name which holds all of its naming words is left out.

Where to align templates without such words is found exactly, not guessed: a passage that covers `least` of
a template holds one of any floor((1 - least) * words) + 1 of its words, so
texts without those key words are left alone, and a passage is aligned only if
it holds enough words of the template at all.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import slices, word_hashes

# Public notices and the opening words of public licenses, by SPDX id.
_GPL = ("This program is free software: you can redistribute it and/or modify it under the terms of the [GNU {0}] "
        "as published by the Free Software Foundation, either [version {1}] of the License, or (at your option) "
        "any later version.")
_GNU = [("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"),
        ("LGPL-2.0", "Library General Public License", "2"),
        ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3"),
        ("AGPL-3.0", "Affero General Public License", "3")]
_CC = [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"),
       ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
       ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]
_BSD = ("[Redistribution and use in source and binary forms], with or without modification, "
        "are permitted provided that the following conditions are met")
_BSD_CLAUSES = (_BSD + ": Redistributions of source code must retain the above copyright notice, this list of conditions "
                "and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
                "this list of conditions and the following disclaimer in the documentation and/or other materials "
                "provided ")
_MIT = ("[Permission is hereby granted, free of charge], to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software")
TEMPLATES = [
    ("MIT", "Released [under the MIT] License."),
    ("MIT-0", "Released [under the MIT No Attribution] License."),
    ("MIT", _MIT),
    ("MIT-0", _MIT + ", and to permit persons to whom the Software is [furnished to do so. THE SOFTWARE IS PROVIDED]"),
    *(("Apache-2.0", f"Licensed under the [{name}].") for name in (
        "Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0")),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed "
                   "under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                   "CONDITIONS OF ANY KIND, either express or implied."),
    *((spdx, f"This work is licensed under the [GNU {name}{by}{version}].")
      for spdx, name, version in _GNU for by in (", version ", " v")),
    *((spdx, _GPL.format(name, version)) for spdx, name, version in _GNU),
    *((f"CC-{short}-4.0", f"Licensed under [CC {short} 4.0].") for short, _ in _CC),
    *((f"CC-{short}-4.0", f"This work is licensed under a [Creative Commons {name} 4.0] International License.")
      for short, name in _CC),
    ("LicenseRef-BSD", _BSD),  # the opening words alone, which all BSD licenses share
    ("BSD-2-Clause", _BSD_CLAUSES + "[with the distribution. THIS SOFTWARE IS PROVIDED]"),
    ("BSD-3-Clause", _BSD_CLAUSES + "[with the distribution. Neither the name of]"),
    ("BSD-3-Clause", _BSD_CLAUSES + "[with the distribution. 3. Neither the name of]"),
    ("BSD-4-Clause", _BSD_CLAUSES + "with the distribution. [All advertising materials mentioning features or use]"),
    ("LicenseRef-all-rights-reserved", "[All rights reserved]."),
]
COVERAGE = 0.8
_WORD = re.compile(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+")  # the words of word_hashes


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing run, by patience sorting with back pointers."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, value in enumerate(values):
        at = bisect_left(tops, value)
        back.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(value)
            piles.append(i)
        else:
            tops[at], piles[at] = value, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def common_subsequence(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence, as early in both as can be; for gaps without anchors."""
    rows = [[0] * (len(b) + 1)]  # rows[-1 - i][j]: length of the best for a[i:] and b[j:]
    for x in reversed(a):
        last, row = rows[-1], [0] * (len(b) + 1)
        for j in range(len(b) - 1, -1, -1):
            row[j] = last[j + 1] + 1 if x == b[j] else max(row[j + 1], last[j])
        rows.append(row)
    rows.reverse()
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif rows[i + 1][j] >= rows[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Patience alignment of two word lists: pairs of places with equal words, increasing in both."""
    if not a or not b:
        return []
    times_a, times_b = Counter(a), Counter(b)
    place = {w: j for j, w in enumerate(b) if times_b[w] == 1}
    unique = [(i, place[w]) for i, w in enumerate(a) if times_a[w] == 1 and w in place]
    if not unique:
        return common_subsequence(a, b) if not times_a.keys().isdisjoint(times_b) else []
    anchors = [unique[k] for k in increasing([j for _, j in unique])]
    out, i, j = [], 0, 0
    for x, y in [*anchors, (len(a), len(b))]:
        out += [(i + p, j + q) for p, q in align(a[i:x], b[j:y])]
        if x < len(a):
            out.append((x, y))
        i, j = x + 1, y + 1
    return out


@dataclass
class Template:
    license_id: str
    words: list[int]
    names: list[tuple[int, int]]  # runs of naming words: first, and behind the last
    known: np.ndarray  # its distinct words
    keys: np.ndarray  # one of these is in every passage that covers enough

    def __init__(self, license_id: str, text: str, least: float):
        hashes, _ = word_hashes([text])
        long = sorted(range(len(hashes)), key=lambda i: -len(_WORD.findall(text)[i]))
        self.license_id, self.words = license_id, hashes.tolist()
        self.known = np.unique(hashes)
        self.keys = np.unique(hashes[long[:int((1 - least) * len(hashes) + 1e-9) + 1]])
        self.names = [tuple(len(_WORD.findall(text[:i])) for i in m.span()) for m in re.finditer(r"\[[^\]]*\]", text)]
        self.naming = frozenset(w for x, y in self.names for w in self.words[x:y])
        if self.names:  # the longest word of each run is in every passage
            self.keys = np.unique(hashes[[next(i for i in long if x <= i < y) for x, y in self.names]])


def passages(words: np.ndarray, template: Template, least: float) -> list[tuple[float, int, int]]:
    """(coverage, first word, last word) of the passages covering at least `least` of a template."""
    n = len(template.words)
    need = least * n - 1e-9
    if template.names:
        return named_passages(words, template, need)
    hits = np.flatnonzero(np.isin(words, template.keys))
    if not len(hits):
        return []
    held = np.concatenate(([0], np.cumsum(np.isin(words, template.known))))
    reach = n + n // 2 + 4
    low, high = np.maximum(hits - reach, 0), np.minimum(hits + reach + 1, len(words))
    out, after = [], -1
    for hit, a, b in zip(hits.tolist(), low.tolist(), high.tolist()):
        a = max(a, after + 1)
        if hit <= after or held[b] - held[a] < need:
            continue
        pairs = align(template.words, words[a:b].tolist())
        if len(pairs) >= need:
            after = a + pairs[-1][1]
            out.append((len(pairs) / n, a + pairs[0][1], after))
    return out


def runs_of(words: np.ndarray, run: list[int]) -> list[int]:
    """Where a run of words stands without foreign words between them."""
    at = np.flatnonzero(words == np.uint64(run[0]))
    for k, w in enumerate(run):
        at = at[at + k < len(words)]
        at = at[words[at + k] == np.uint64(w)]
    return at.tolist()


def named_passages(words: np.ndarray, template: Template, need: float) -> list[tuple[float, int, int]]:
    """The passages around each place of the naming words, these pinned and the rest aligned around them."""
    t, n = template.words, len(template.words)
    reach = n + n // 2 + 4
    places = [runs_of(words, t[x:y]) for x, y in template.names]
    if not all(places):
        return []
    out, after = [], -1
    for hit in places[0]:
        if hit <= after:
            continue
        start, pairs, x0, at = max(after + 1, hit - reach), [], 0, max(after + 1, hit - reach)
        for k, (x, y) in enumerate(template.names):
            here = hit if k == 0 else next((p for p in places[k] if at <= p <= hit + reach), None)
            if here is None:
                break
            pairs += [(x0 + i, at + j) for i, j in align(t[x0:x], words[at:here].tolist())]
            pairs += [(x + i, here + i) for i in range(y - x)]
            x0, at = y, here + y - x
        else:
            pairs += [(x0 + i, at + j) for i, j in align(t[x0:], words[at:hit + reach + 1].tolist())]
            if len(pairs) >= need:
                after = pairs[-1][1]
                out.append((len(pairs) / n, pairs[0][1], after))
    return out


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=None,
         least: float = COVERAGE) -> DataFrame:
    """One row per input row: the id, license_id, coverage, start_char, end_char, licenses, n_passages.

    license_id is the best covered one (ties: more words, then the earlier
    place, then the id), with its place in the text as characters from 0, the
    end exclusive; `licenses` has all ids found, sorted. Without a notice, and
    for null and empty texts, license_id and the place are null, coverage is 0
    and the list is empty. Null and repeated ids are kept, other columns left out.
    """
    known = [Template(name, text, least) for name, text in (TEMPLATES if templates is None else templates)]
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    keys = np.unique(np.concatenate([t.keys for t in known])) if known else np.empty(0, np.uint64)

    def look(text: str, words: np.ndarray):
        held = set(words[np.isin(words, keys)].tolist())
        every = [(t, c, a, b) for t in known if not t.names or held.issuperset(t.keys.tolist())
                 for c, a, b in passages(words, t, least)]
        found = [(c, len(t.words), -a, t.license_id, a, b) for t, c, a, b in every
                 if not any(t.naming and t.naming < u.naming and t.license_id != u.license_id and x <= b and a <= y
                            for u, _, x, y in every)]
        if not found:
            return None, 0.0, None, None, [], 0
        # Templates of one license that meet in one place are one passage.
        found = [f for i, f in enumerate(found) if not any(
            f[3] == g[3] and f[4] <= g[5] and g[4] <= f[5] and (f[0] * f[1], -i) < (g[0] * g[1], -k)
            for k, g in enumerate(found))]
        best = min(found, key=lambda x: (-x[0], -x[1], -x[2], x[3]))
        places = [m.span() for m in _WORD.finditer(text)]
        return (best[3], best[0], places[best[4]][0], places[best[5]][1],
                sorted({x[3] for x in found}), len(found))

    def run(batches):
        for batch in batches:
            texts, out = batch.column(1).to_pylist(), []
            for part in slices(texts):
                words, at = word_hashes(texts[part])
                hit = np.concatenate(([0], np.cumsum(np.isin(words, keys))))
                some = hit[at[1:]] > hit[at[:-1]]
                out += [look(texts[part.start + i], words[at[i]:at[i + 1]]) if some[i]
                        else (None, 0.0, None, None, [], 0) for i in range(part.stop - part.start)]
            kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))],
                ["id", "license_id", "coverage", "start_char", "end_char", "licenses", "n_passages"])

    return rows.mapInArrow(run, f"id {id_type}, license_id string, coverage double, start_char long, "
                                "end_char long, licenses array<string>, n_passages int"
                           ).withColumnRenamed("id", id_col)
