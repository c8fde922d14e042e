"""Counts, shares and headline figures.

Group counts are combined per task before the shuffle. Totals and other
one-row results enter a plan as scalar subqueries: no join, nothing collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.fixed_values import SKILL_PATTERNS
from ..functions.pay import percent, week_start
from ..functions.rules import prefixed
from ..functions.text import keyword_flags
from .filters import FilterSpec, recent_rows
from .quantiles import median


def _true(column: str):
    return F.coalesce(F.col(column), F.lit(False))


def summary_stats(df: DataFrame, company="company", pay="average_salary",
                  remote="is_remote") -> DataFrame:
    return df.agg(
        F.count("*").alias("total_jobs"),
        F.count_distinct(company).alias("unique_companies"),
        F.avg(pay).alias("avg_salary"),
        median(df, pay).scalar().alias("median_salary"),
        F.count(pay).alias("jobs_with_salary"),
        F.count_if(_true(remote)).alias("remote_jobs"))


def kpis(df: DataFrame, spec: FilterSpec) -> DataFrame:
    """Headline figures of the filtered rows, in one scan of all rows."""
    hit = spec.predicate()
    sums = df.agg(
        F.count("*").alias("total"), F.count_if(hit).alias("jobs"),
        F.count_distinct(F.when(hit, F.col("company"))).alias("unique_companies"),
        F.avg(F.when(hit, F.col("average_salary"))).alias("avg_salary"),
        F.count_if(hit & _true("is_remote")).alias("remote"))
    return sums.select("jobs", percent("jobs", "total").alias("pct_of_total"),
                       "unique_companies", "avg_salary",
                       percent("remote", "jobs").alias("remote_pct"))


def value_counts(df: DataFrame, column: str, missing: bool = False) -> DataFrame:
    """Rows per value; with `missing`, null is a value too."""
    rows = df if missing else df.where(F.col(column).isNotNull())
    return rows.groupBy(column).agg(F.count("*").alias("count"))


def top_counts(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values; ties in value order."""
    return value_counts(df, column).orderBy(F.desc("count"), column).limit(k)


def top_share(df: DataFrame, column: str, k: int, digits: int = 2) -> DataFrame:
    """Share of the k most frequent values among all rows, in percent."""
    total = df.agg(F.count("*")).scalar()
    return top_counts(df, column, k).select(
        column, "count", F.round(F.col("count") / total * 100, digits).alias("share"))


def group_mean(df: DataFrame, by: str, value: str) -> DataFrame:
    return (df.where(F.col(by).isNotNull()).groupBy(by)
            .agg(F.avg(value).alias("mean")).orderBy(F.desc_nulls_last("mean"), by))


def period_counts(df: DataFrame, key: str, posted="date_posted", period="day") -> DataFrame:
    """Rows per (day or week, key)."""
    start = {"day": F.to_date(posted), "week": week_start(posted)}[period]
    return (df.where(F.col(posted).isNotNull() & F.col(key).isNotNull())
            .groupBy(start.alias(period), key).agg(F.count("*").alias("count")))


def daily_counts(df: DataFrame, posted="date_posted") -> DataFrame:
    return (df.where(F.col(posted).isNotNull())
            .groupBy(F.to_date(posted).alias("day")).agg(F.count("*").alias("count")))


def recent_daily_volume(df: DataFrame, days: int = 7, posted="date_posted") -> DataFrame:
    """The last days that have rows, with their mean."""
    last = daily_counts(df, posted).orderBy(F.desc("day")).limit(days)
    return last.withColumn("mean", last.agg(F.avg("count")).scalar())


def skill_flag_columns(df: DataFrame, text="description", patterns=SKILL_PATTERNS):
    """Table with one boolean column per skill, named as the skill."""
    low = df.withColumn("_low", F.lower(text))
    return low.select("*", *[f.alias(n) for n, f in keyword_flags("_low", patterns).items()])


def skill_flags(df: DataFrame, names, skills: str = "skills") -> DataFrame:
    """The same from a stored array of skills: the text is not read again."""
    return df.select("*", *[F.array_contains(skills, n).alias(n) for n in names])


def _quoted(name: str):
    return F.col(f"`{name}`")


def flag_totals(df: DataFrame, names, conditions: dict) -> DataFrame:
    """Long table (skill, one count per condition) from one aggregate.

    `conditions` maps an output name to a boolean column; the row totals come
    along as `<name>_rows`.
    """
    names = list(names)
    aggs = [F.count_if(c).alias(f"{k}_rows") for k, c in conditions.items()]
    aggs += [F.count_if(c & _quoted(n)).alias(f"{k}:{i}")
             for k, c in conditions.items() for i, n in enumerate(names)]
    wide = df.agg(*aggs)
    entries = F.array(*[F.struct(F.lit(n).alias("skill"),
                                 *[_quoted(f"{k}:{i}").alias(k) for k in conditions],
                                 *[_quoted(f"{k}_rows").alias(f"{k}_rows") for k in conditions])
                        for i, n in enumerate(names)])
    return wide.select(F.inline(entries))


def skill_share(flags: DataFrame, names, k: int | None = 15) -> DataFrame:
    """Share of rows per skill in percent, most frequent first."""
    totals = flag_totals(flags, names, {"jobs": F.lit(True)})
    shares = totals.select("skill", "jobs", percent("jobs", "jobs_rows").alias("share"))
    shares = shares.orderBy(F.desc("share"), "skill")
    return shares if k is None else shares.limit(k)


def flag_column_share(df: DataFrame, prefix: str = "skill_", k: int | None = 15) -> DataFrame:
    """`skill_share` for a table that holds 0/1 columns with a prefix."""
    names = prefixed(df, prefix)
    flags = df.select(*[(_quoted(c) == 1).alias(n) for c, n in names.items()])
    return skill_share(flags, names.values(), k)


def window_volume(df: DataFrame, as_of, days: int = 30, posted="date_posted",
                  title="title") -> DataFrame:
    """Rows, distinct titles and rows per day of the last days."""
    return recent_rows(df, posted, as_of, days).agg(
        F.count("*").alias("jobs"), F.count_distinct(title).alias("unique_titles"),
        (F.count("*") / days).alias("jobs_per_day"))


def distinct_counts(df: DataFrame, columns, approx: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(*[count(c).alias(f"{c}_distinct") for c in columns])
