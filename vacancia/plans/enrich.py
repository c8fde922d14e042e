"""From raw to processed postings."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as V
from ..functions.pay import annualize, average_salary
from ..functions.rules import (cost_tier, degree_found, degree_strict, first_col, job_type_key,
                               job_type_norm, role_category, state_code, years_found)
from ..functions.search import TextSearch
from ..functions.text import keyword_flags, keyword_list
from ..operators.dedupe import dedupe_by_keys, dedupe_parts

_NAMES = ["title", "company", "location"]


def add_pay(df: DataFrame, period: str = "interval") -> DataFrame:
    low, high = annualize("min_amount", "max_amount", period)
    df = df.withColumns({"annual_min_salary": low, "annual_max_salary": high})
    return df.withColumn("average_salary", average_salary("annual_min_salary",
                                                          "annual_max_salary"))


def add_categories(df: DataFrame) -> DataFrame:
    """Categories of short columns a table does not have yet; an absent source
    counts as null. Sources are lower-cased in a projection of their own, not once per word."""
    def source(name):
        return F.col(name) if name in df.columns else F.lit(None).cast("string")
    low = df.withColumns({"_title": F.lower(source("title")), "_type": job_type_key(source("job_type")),
                          "_location": F.lower(source("location"))})
    new = {
        "role_category": role_category("_title", lowered=True),
        "job_type_norm": job_type_norm("_type", keyed=True),
        "state": state_code(source("location")),
        "col_tier": cost_tier("_location", lowered=True),
    }
    return low.withColumns({k: c for k, c in new.items() if k not in df.columns}).drop(
        "_title", "_type", "_location")


def lower_once(df: DataFrame, text: str, name: str = "_low") -> DataFrame:
    """Lower-case a text in a projection of its own, so that many patterns on
    it share one pass."""
    return df.withColumn(name, F.lower(text))


def add_skills(df: DataFrame, text: str = "description", patterns=V.SKILL_PATTERNS,
               flags: bool = False) -> DataFrame:
    """`skills` array, or with `flags` one 0/1 column skill_<Name> per skill."""
    low = lower_once(df, text)
    if flags:
        new = {f"skill_{n}": f.cast("int") for n, f in keyword_flags("_low", patterns).items()}
    else:
        new = {"skills": keyword_list("_low", patterns)}
    return low.withColumns(new).drop("_low")


def add_text_features(df: DataFrame, text: str = "description",
                      patterns=V.SKILL_PATTERNS) -> DataFrame:
    """skills, years_experience_required and, if absent, education_level.

    All plain words are searched in one pass over the text as it is. Only where that leaves something open is
    the text lower-cased and a regex run.
    """
    rest = [r for _, r in V.DEGREE_FORMS.values() if r]
    search = TextSearch([*patterns.values(), V.YEARS_STATED, V.ENTRY_LEVEL_PATTERN,
                         *[forms for forms, _ in V.DEGREE_FORMS.values()], *rest])
    low = df.withColumn("_found", search.hits(text)).withColumn("_low", search.lowered(text, "_found", rest))
    plain = F.col("_low")
    new = {"skills": F.array_compact(F.array(*[
               F.when(F.coalesce(search.matches(plain, "_found", p), F.lit(False)), F.lit(name))
               for name, p in patterns.items()])),
           "years_experience_required": years_found(plain, "_found", search)}
    if "education_level" not in df.columns:
        source = first_col(df, V.TEXT_ALIASES)
        if source == text:
            new["education_level"] = degree_found(plain, "_found", search)
        else:
            new["education_level"] = degree_strict(source) if source else F.lit(None).cast("string")
    return low.withColumns(new).drop("_low", "_found")


def enrich(df: DataFrame, period: str = "interval") -> DataFrame:
    """All derived columns; unused ones cost nothing (they are pruned)."""
    return add_text_features(add_categories(add_pay(df, period)))


def process_all(raw: DataFrame, order: str = "seq", period: str = "interval",
                wide: DataFrame | None = None) -> DataFrame:
    """Drop repeated title + company + location (first row stays), then enrich.

    Keys decide which rows stay, texts are in no sort; `wide` is a cheaper plan for the same rows.
    """
    return enrich(dedupe_by_keys(raw, _NAMES, order, wide), period)


def process_parts(raw: DataFrame, order: str = "seq", period: str = "interval",
                  wide: DataFrame | None = None) -> Iterator[DataFrame]:
    """`process_all` in a few parts, to be written one after the other."""
    for part in dedupe_parts(raw, _NAMES, order, wide):
        yield enrich(part, period)
