"""Trends over days and weeks.

Every window runs on counts that are already reduced to one row per day (or
week) and key, so its input is bounded by the calendar, not by the postings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.fixed_values import OTHER_ROLE
from ..functions.pay import percent
from .filters import drop_missing, recent_rows, within_days
from .metrics import (daily_counts, flag_totals, period_counts, top_counts)


def densify(counts: DataFrame, period: str, key: str, value: str = "count") -> DataFrame:
    """All observed periods with all observed keys; absent pairs count 0.

    The observed periods travel as one array, which the calendar bounds; every
    key expands by itself, however many there are.
    """
    periods = counts.agg(F.collect_set(period)).scalar()
    grid = counts.select(key).distinct().withColumn(period, F.explode(periods))
    return grid.join(counts, [period, key], "left").fillna(0, [value])


def share_within(df: DataFrame, group: str, value: str = "count", name="percentage") -> DataFrame:
    """Share of a value in the total of its group, in percent."""
    total = F.sum(value).over(Window.partitionBy(group))
    return df.withColumn(name, percent(F.col(value), total))


def weekly_role_mix(df: DataFrame, key: str = "role_category", posted="date_posted",
                    other: str = OTHER_ROLE) -> DataFrame:
    """Weekly shares of the roles, the catch-all left out of the total."""
    return role_mix_of(period_counts(df, key, posted, "week"), key, other)


def role_mix_of(weekly: DataFrame, key: str = "role_category", other: str = OTHER_ROLE) -> DataFrame:
    """`weekly_role_mix` of counts per (week, key)."""
    return share_within(densify(weekly.where(F.col(key) != other), "week", key), "week")


def cumulative(df: DataFrame, order: str, value: str = "count", by=(), name="cum_count"):
    """Running total per key of a table with one row per day (and key)."""
    window = (Window.partitionBy(*(by or [F.lit(0)])).orderBy(order)
              .rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, F.sum(value).over(window))


def cumulative_mix(df: DataFrame, key: str = "education_level", posted="date_posted",
                   start: Column | None = None, dense: bool = False) -> DataFrame:
    """Running share of each key among rows with a known key, per day.

    A key has a row on the days it occurs; `dense` fills the other days.
    """
    rows = drop_missing(df, [posted, key])
    rows = rows if start is None else rows.where(F.col(posted) >= start)
    return cumulative_mix_of(period_counts(rows, key, posted, "day"), key, dense)


def cumulative_mix_of(counts: DataFrame, key: str = "education_level", dense: bool = False) -> DataFrame:
    """`cumulative_mix` of counts per (day, key)."""
    totals = counts.groupBy("day").agg(F.sum("count").alias("total"))
    if dense:
        counts = densify(counts, "day", key)
    totals = cumulative(totals, "day", "total", name="cum_total").drop("total")
    mix = cumulative(counts, "day", by=[key]).join(totals, "day")
    return mix.withColumn("percentage", percent("cum_count", "cum_total"))


def wow_change(flags: DataFrame, names, as_of: Column, posted="date_posted",
               least_pct: float = 1.0) -> DataFrame:
    """Share of each skill in the last 7 days and the 7 before, and the change.

    Skills above the floor in either period; no rows if a period is empty.
    """
    current = F.coalesce(within_days(posted, as_of, 7), F.lit(False))
    previous = F.coalesce(within_days(posted, as_of, 14, skip=7), F.lit(False))
    recent = recent_rows(flags, posted, as_of, 14).withColumns(
        {"_current": current, "_previous": previous})  # worked out once, not once per skill
    sums = flag_totals(recent, names, {"cur": F.col("_current"), "prev": F.col("_previous")})
    sums = sums.where((F.col("cur_rows") > 0) & (F.col("prev_rows") > 0))
    shares = sums.select("skill", percent("cur", "cur_rows").alias("current_pct"),
                         percent("prev", "prev_rows").alias("previous_pct"))
    shares = shares.where((F.col("current_pct") > least_pct) | (F.col("previous_pct") > least_pct))
    return shares.withColumn("change", F.col("current_pct") - F.col("previous_pct"))


def trending(changes: DataFrame, k: int = 5, rising: bool = True) -> DataFrame:
    order = F.desc("change") if rising else F.asc("change")
    return changes.orderBy(order, "skill").limit(k)


def daily_share(df: DataFrame, key: str = "title", k: int = 8, posted="date_posted") -> DataFrame:
    """Daily share of the k most frequent keys among all rows of the day.

    One count per day and key, missing keys included, gives all three: the top
    keys, their days and the totals.
    """
    rows = drop_missing(df, [posted])
    return daily_share_of(rows.groupBy(F.to_date(posted).alias("day"), key).agg(F.count("*").alias("count")),
                          key, k)


def daily_share_of(counts: DataFrame, key: str = "title", k: int = 8) -> DataFrame:
    """`daily_share` of counts per (day, key), missing keys included."""
    known = counts.where(F.col(key).isNotNull())
    top = (known.groupBy(key).agg(F.sum("count").alias("n")).orderBy(F.desc("n"), key)
           .limit(k).select(key))
    totals = counts.groupBy("day").agg(F.sum("count").alias("total"))
    return (known.join(F.broadcast(top), key, "left_semi").join(totals, "day", "left")
            .withColumn("percentage", F.round(F.col("count") / F.col("total") * 100, 2)))


def growth_metrics(df: DataFrame, as_of: Column, key: str = "title", k: int = 8, days: int = 7,
                   posted="date_posted") -> DataFrame:
    """Share of the last days per top key, whole and per day."""
    rows = drop_missing(df, [posted])
    recent = recent_rows(rows, posted, as_of, days)
    total = recent.agg(F.count("*")).scalar()
    counts = recent.groupBy(key).agg(F.count("*").alias("recent"))
    share = percent(F.coalesce("recent", F.lit(0)), total)
    out = top_counts(rows, key, k).select(key).join(counts, key, "left").select(
        key, F.round(share, 2).alias("share"), F.round(share / days, 2).alias("per_day"))
    return out.where(total > 0).orderBy(F.desc("per_day"), key)


def elapsed_days(df: DataFrame, key: str, day: str = "day") -> DataFrame:
    """Days since the key's first day."""
    first = F.min(day).over(Window.partitionBy(key))
    return df.withColumn("elapsed", F.datediff(day, first))
