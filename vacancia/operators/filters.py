"""Row filters. A missing value never matches."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.pay import to_number
from ..functions.text import col

ALL = "All"

# Experience bands, both ends included (None: open).
EXPERIENCE_BANDS = {
    "New Grad (0 yrs)": (0, 0),
    "Entry Level (0-2 yrs)": (None, 2),
    "Mid-Level (3-5 yrs)": (3, 5),
}


def experience_band(years, band: str) -> Column:
    low, high = EXPERIENCE_BANDS[band]
    value = to_number(years)
    return value <= high if low is None else value.between(low, high)


@dataclass(frozen=True)
class FilterSpec:
    """A set of dashboard filters; 'All' (or False) switches a filter off."""

    state: str = ALL
    job_type: str = ALL
    remote_only: bool = False
    education: str = ALL
    experience: str = ALL
    role: str = ALL

    def tests(self) -> list[Column]:
        equal = {"state": self.state, "job_type_norm": self.job_type,
                 "education_level": self.education, "role_category": self.role}
        tests = [F.col(c) == v for c, v in equal.items() if v != ALL]
        if self.remote_only:
            tests.append(F.col("is_remote"))
        if self.experience != ALL:
            tests.append(experience_band("years_experience_required", self.experience))
        return tests

    def predicate(self) -> Column:
        """True where a row passes every filter, else false (never null)."""
        tests = self.tests()
        return F.coalesce(reduce(and_, tests), F.lit(False)) if tests else F.lit(True)


def apply_filters(df: DataFrame, spec: FilterSpec) -> DataFrame:
    """Plain conjunction, so each test can reach the scan by itself."""
    return df.where(reduce(and_, spec.tests(), F.lit(True)))


MONTH = "posted_month"  # the partition column of the processed table, yyyy-MM


def within_days(posted, as_of: Column, days: int, skip: int = 0, month: str | None = None) -> Column:
    """posted in [as_of - days, as_of - skip); no upper end without skip.

    `month` names a partition column with the month of the date: bounds on it, a day
    wider than the dates' (time zones), let the scan leave out other months, also
    where `as_of` is only known when the query runs.
    """
    at = col(posted)

    def before(n: int) -> Column:
        return as_of - F.expr(f"INTERVAL {n} DAYS")
    recent = at >= before(days)
    if skip:
        recent = recent & (at < before(skip))
    if month:
        recent = recent & (F.col(month) >= F.date_format(before(days + 1), "yyyy-MM"))
        if skip:
            recent = recent & (F.col(month) <= F.date_format(before(skip - 1), "yyyy-MM"))
    return recent


def recent_rows(df: DataFrame, posted, as_of: Column, days: int, skip: int = 0) -> DataFrame:
    """Rows of the last days; only their months are read from a table that is stored by month."""
    return df.where(within_days(posted, as_of, days, skip, MONTH if MONTH in df.columns else None))


def drop_missing(df: DataFrame, columns) -> DataFrame:
    return df.na.drop(subset=list(columns))


def exclude_value(df: DataFrame, column: str, value) -> DataFrame:
    """Rows with another value; rows without a value stay."""
    return df.where(~F.col(column).eqNullSafe(F.lit(value)))


def in_top(df: DataFrame, column: str, k: int) -> DataFrame:
    """Rows whose value is one of the k most frequent. The list has k rows."""
    from .metrics import top_counts
    return df.join(F.broadcast(top_counts(df, column, k).select(column)), column, "left_semi")


def min_support(counts: DataFrame, column: str, least: int) -> DataFrame:
    return counts.where(F.col(column) >= least)


def options(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values of a filter list."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)
