"""Ordered rule lists as expressions: first hit wins, no UDF."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from . import fixed_values as V
from .search import OPEN, TextSearch
from .text import UNICODE, col, contains_any, contains_word, matches, strip


def first_hit(rules, otherwise=None) -> Column:
    """[(condition, value)] -> value of the first true condition."""
    out = F
    for condition, value in rules:
        out = out.when(condition, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def _lower(text, lowered: bool) -> Column:
    return col(text) if lowered else F.lower(col(text))


def extract_years(text, patterns=V.YEARS_PATTERNS, zero_pattern: str = V.ENTRY_LEVEL_PATTERN,
                  lowered: bool = False, gate: str | None = None) -> Column:
    """Years of experience asked for in a text, as bigint.

    The number is the first group of the first pattern that matches. Texts
    without the word `gate` skip the patterns; the built-in patterns bring
    theirs, others have none unless it is given. `lowered` says that the text
    column is in lower case already: for long texts lower-case once, in a
    projection of its own.
    """
    low = _lower(text, lowered)
    if gate is None and tuple(patterns) == V.YEARS_PATTERNS:
        gate = V.YEARS_GATE
    found = F.coalesce(*[F.regexp_extract(low, UNICODE + p, 1).try_cast("bigint") for p in patterns])
    stated = F.when(low.contains(gate), found) if gate else found
    return F.coalesce(stated, F.when(matches(low, zero_pattern), F.lit(0).cast("bigint")))


def _degree_hits(low: Column, rules, words):
    """Plain search for a word of the degree first, its pattern only after.

    Words belong to the built-in rules; other rules have none unless they are given.
    """
    if words is None:
        words = V.DEGREE_WORDS if tuple(rules) in (V.DEGREE_STRICT, V.DEGREE_DEFAULT) else {}
    hits = []
    for degree, pattern in rules:
        hit = low.rlike(UNICODE + pattern)
        hits.append((contains_word(low, words[degree]) & hit if degree in words else hit, degree))
    return hits


def years_found(low: Column, found: str, search: TextSearch) -> Column:
    """`extract_years` with the built-in patterns, which run only where the search leaves the number open."""
    known = F.col(f"{found}.y")
    stated = F.when(known >= 0, known).when(known == OPEN, F.coalesce(*[
        F.regexp_extract(low, UNICODE + p, 1).try_cast("bigint") for p in V.YEARS_PATTERNS]))
    entry = search.matches(low, found, V.ENTRY_LEVEL_PATTERN)
    return F.coalesce(stated, F.when(entry, F.lit(0).cast("bigint")))


def degree_found(low: Column, found: str, search: TextSearch) -> Column:
    """`degree_strict` with the built-in rules, which run only where the search leaves them open."""
    hits = []
    for degree, p in V.DEGREE_STRICT:
        forms, rest = V.DEGREE_FORMS[p]
        hit = search.matches(low, found, forms)
        hits.append((hit | (search.held(found, rest) & low.rlike(UNICODE + p)) if rest else hit, degree))
    return first_hit(hits)


def degree_strict(text, rules=V.DEGREE_STRICT, words=None, lowered: bool = False) -> Column:
    """Highest degree named in a text, else null."""
    return first_hit(_degree_hits(_lower(text, lowered), rules, words))


def degree_default(text, rules=V.DEGREE_DEFAULT, fallback: str = V.DEGREE_FALLBACK,
                   words=None, lowered: bool = False) -> Column:
    """Highest degree named in a text, else the fallback; null text -> null."""
    low = _lower(text, lowered)
    return F.when(low.isNotNull(), first_hit(_degree_hits(low, rules, words), fallback))


def role_category(title, rules=V.ROLE_RULES, otherwise: str = V.OTHER_ROLE, lowered: bool = False) -> Column:
    low = _lower(title, lowered)
    return first_hit([(contains_any(low, words), role) for role, words in rules], otherwise)


def job_type_key(value) -> Column:
    return F.replace(F.lower(strip(value)), F.lit("_"), F.lit("-"))


def job_type_norm(value, rules=V.JOB_TYPE_RULES, exact=V.JOB_TYPE_EXACT, keyed: bool = False) -> Column:
    """Canonical job type; `keyed` says that the column is the `job_type_key` already."""
    v = col(value) if keyed else job_type_key(value)
    hits = [(contains_any(v, words), name) for name, words in rules]
    return first_hit(hits + [(v == word, name) for word, name in exact.items()])


def state_raw(location) -> Column:
    """Text after the last ", ", unchecked."""
    loc = col(location)
    return F.when(loc.contains(", "), F.substring_index(loc, ", ", -1))


def state_code(location) -> Column:
    """Two-letter code after the last ", ", upper-cased, else null."""
    code = strip(state_raw(location))
    return F.when(code.rlike(r"^\p{L}{2}$"), F.upper(code))


def cost_tier(location, tiers=V.COST_TIERS, lowered: bool = False) -> Column:
    low = _lower(location, lowered)
    return first_hit([(contains_any(low, words), tier) for tier, words in tiers], 0)


def years_from_title(title, rules=V.TITLE_YEARS, strict_words: bool = False, lowered: bool = False) -> Column:
    """Years a title stands for, else null.

    Words match anywhere in the title ("director" holds "cto" and counts as
    15). `strict_words` asks for whole words instead. `lowered` says that the
    column is in lower case already: one expression lower-cases it once per word.
    """
    low = _lower(title, lowered)
    hits = []
    for years, words, endings in rules:
        if strict_words:
            whole = "|".join(re.escape(w.strip()) for w in (*words, *endings))
            found = low.rlike(rf"{UNICODE}(?<!\w)(?:{whole})(?!\w)")
        else:
            found = contains_any(low, words, endings)
        hits.append((found, years))
    return first_hit(hits)


def encode_label(value, codes=V.DEGREE_CODES, unknown: str = V.NO_DEGREE) -> Column:
    """Code of a label from a fixed set; other values get the unknown's code."""
    return first_hit([(col(value) == label, code) for label, code in codes.items()],
                     codes[unknown])


def degree_rank(value, ranks=V.DEGREE_RANKS) -> Column:
    return first_hit([(col(value) == label, rank) for label, rank in ranks.items()], 0)


def first_col(df: DataFrame, names) -> str | None:
    """First of the names the table has."""
    return next((n for n in names if n in df.columns), None)


def first_value(df: DataFrame, names) -> Column:
    """Row by row, the first non-null of the named columns the table has."""
    present = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def prefixed(df: DataFrame, prefix: str) -> dict[str, str]:
    """Columns starting with a prefix -> name without it."""
    return {c: c[len(prefix):] for c in df.columns if c.startswith(prefix)}


def flags_to_list(df: DataFrame, prefix: str = "skill_", limit: int | None = 10) -> Column:
    """Names of the 0/1 columns equal to 1, in column order."""
    names = F.array_compact(F.array(*[
        F.when(F.col(f"`{c}`") == 1, F.lit(n)) for c, n in prefixed(df, prefix).items()]))
    return names if limit is None else F.slice(names, 1, limit)
