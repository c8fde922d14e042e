"""Text expressions: keys, URLs, pattern flags and structured replies."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F
from pyspark.sql.types import (ArrayType, DoubleType, StringType, StructField,
                               StructType)

# White space of any kind (Unicode), as a pattern and as characters.
_SPACE = r"(?U)[\s\x1c-\x1f]+"
_SPACES = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
           "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


# Character classes and word boundaries of patterns mean all of Unicode, whatever
# the Java version, and '.' stops at line feeds alone, as in Python.
UNICODE = "(?dU)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(col(c), F.lit(_SPACES))


def norm_text(c: Column | str) -> Column:
    """Key form of a text: lower case, single spaces, trimmed; '' -> null."""
    flat = F.trim(F.lower(F.regexp_replace(col(c), _SPACE, " ")))
    return F.nullif(flat, F.lit(""))


_URL_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"


def clean_url(c: Column | str) -> Column:
    return F.translate(strip(c), "\t\r\n", "")


def url_parts(url: Column | str) -> dict[str, Column]:
    """scheme, host and raw path of a cleaned link; '' where absent."""
    return {name: F.regexp_extract(col(url), _URL_PARTS, i)
            for i, name in enumerate(("scheme", "host", "path"), 1)}


def join_url(url: Column, scheme: Column, host: Column, path: Column) -> Column:
    """Key form of a link from its cleaned text and its parts."""
    scheme, host = F.lower(scheme), F.lower(host)
    # '+' is a plain character in a path, and a stray '%' stands for itself.
    safe = F.replace(F.regexp_replace(path, "%(?![0-9A-Fa-f]{2})", "%25"),
                     F.lit("+"), F.lit("%2B"))
    decoded = F.when(path.contains("%"), F.coalesce(F.try_url_decode(safe), path)).otherwise(path)
    trimmed = F.when(path.isin("", "/"), "/").otherwise(F.rtrim(decoded, F.lit("/")))
    prefix = (F.when((host != "") & (scheme != ""), F.concat(scheme, F.lit("://"), host))
              .when(host != "", F.concat(F.lit("https://"), host))
              .when(url.rlike(r"^[^:/?#]+://"), F.concat(scheme, F.lit("://")))
              .when(scheme != "", F.concat(scheme, F.lit(":")))
              .otherwise(F.lit("https://")))
    dirty = host.rlike(r"^[^\[]*\]|\[[^\]]*$")
    return F.when(dirty, F.lower(url)).otherwise(F.concat(prefix, trimmed))


def norm_url(c: Column | str) -> Column:
    """Key form of a link: default scheme https, lower-case authority, decoded
    path without trailing slash, no query and no fragment. Text that is not a
    URL is lower-cased.

    A link without scheme ("www.x.com/a") gets "https://", so it equals the
    full form of the same link.
    """
    url = clean_url(c)
    return join_url(url, **url_parts(url))


def truncate(c: Column | str, n: int = 200) -> Column:
    """First n characters; missing text gives ''."""
    return F.substring(F.coalesce(col(c), F.lit("")), 1, n)


def contains_any(c: Column, words, endings=()) -> Column:
    """Does a short text hold one of the words (or end with one of the endings)?

    One expression, however many words: plans stay small where a rule list is
    used in filters and repeated by the optimizer.
    """
    parts = [re.escape(w) for w in words] + [re.escape(e) + r"\z" for e in endings]
    return c.rlike("|".join(parts))


def contains_word(c: Column, words) -> Column:
    """The same for long texts and few words, by plain search."""
    return reduce(or_, [c.contains(w) for w in words])


def alternative(low: Column, pattern: str) -> Column:
    """One alternative of a pattern, in its cheapest form (same matches).

    Plain search runs over the bytes as they are stored; a regex decodes the text
    first. So a literal is searched plainly, and its boundaries are looked at only
    where it occurs. A pattern that starts with the literal lets the engine skip
    ahead, so a leading boundary moves behind it.
    """
    literal = pattern.replace(r"\b", "")
    regex = low.rlike(UNICODE + _boundary_last(pattern))
    if set(literal) & set("\\.^$*+?()[]{}|"):
        return regex
    found = low.contains(literal)
    return found if literal == pattern else found & regex


def _boundary_last(pattern: str) -> str:
    if not pattern.startswith(r"\b"):
        return pattern
    return f"{pattern[2:]}(?<={pattern})"


def matches(low: Column, pattern: str) -> Column:
    """Does lower-cased text match a pattern of plain alternatives?"""
    if set(pattern) & set("()[]{}*+?^$") or pattern != pattern.lower():
        return low.rlike(UNICODE + pattern)
    return reduce(or_, [alternative(low, p) for p in pattern.split("|")])


def keyword_flags(low: Column | str, patterns: dict[str, str]) -> dict[str, Column]:
    """name -> boolean flag. `low` is lower-cased text; null text -> false."""
    return {name: F.coalesce(matches(col(low), p), F.lit(False))
            for name, p in patterns.items()}


def keyword_list(low: Column | str, patterns: dict[str, str]) -> Column:
    """Names whose pattern matches, in the order of the table."""
    return F.array_compact(F.array(*[
        F.when(flag, F.lit(name)) for name, flag in keyword_flags(low, patterns).items()]))


REPLY_ITEM = StructType([
    StructField("id", StringType()),
    StructField("match_percentage", DoubleType()),
    StructField("matched_skills", ArrayType(StringType())),
    StructField("missing_skills", ArrayType(StringType())),
    StructField("explanation", StringType()),
])


def strip_fence(c: Column | str) -> Column:
    """Content of the first fenced block, or the whole text without one."""
    text = col(c)
    fence = F.lit("```")
    inner = (F.when(text.contains("```json"), F.split_part(text, F.lit("```json"), F.lit(2)))
             .when(text.contains("```"), F.split_part(text, fence, F.lit(2))))
    return strip(F.coalesce(F.split_part(inner, fence, F.lit(1)), text))


def parse_reply(c: Column | str, item: StructType = REPLY_ITEM) -> Column:
    """Array of items in a JSON reply; anything but a JSON array gives null."""
    body = strip_fence(c)
    return F.when(F.get_json_object(body, "$").startswith("["),
                  F.from_json(body, ArrayType(item)))
