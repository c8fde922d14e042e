"""Pay and number expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .fixed_values import PAY_RANGE, PERIODS_PER_YEAR
from .text import col


def annualize(low, high, period, factors: dict[str, int] = PERIODS_PER_YEAR):
    """Yearly (min, max). If either bound is missing, both are null."""
    factor = F
    for name, n in factors.items():
        factor = factor.when(col(period) == name, n)
    factor = factor.otherwise(1)
    both = col(low).isNotNull() & col(high).isNotNull()
    return tuple(F.when(both, col(c).cast("double") * factor) for c in (low, high))


def average_salary(low, high) -> Column:
    return (col(low) + col(high)) / 2


def in_pay_range(c, bounds=PAY_RANGE) -> Column:
    return col(c).between(*bounds)


def clip_upper(c, top) -> Column:
    """Cap a value; null stays null."""
    return F.when(col(c).isNotNull(), F.least(col(c), F.lit(top)))


def percent(part, whole, digits: int | None = None) -> Column:
    """part / whole * 100, 0 for an empty whole."""
    p = F.when(col(whole) > 0, col(part) / col(whole) * 100.0).otherwise(F.lit(0.0))
    return p if digits is None else F.round(p, digits)


def to_number(c) -> Column:
    """Number or null; text that is no number gives null."""
    return col(c).try_cast("double")


def to_time(c) -> Column:
    """Time or null; text that is no time gives null."""
    return F.try_to_timestamp(col(c))


def week_start(c) -> Column:
    """Monday of the week, as a date (independent of the session time zone)."""
    day = F.to_date(col(c))
    return F.date_sub(day, F.weekday(day))
