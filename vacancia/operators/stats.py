"""Distribution diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.pay import percent
from ..functions.text import col
from .quantiles import (exact_percentiles, join_group_table, percentiles_of_weights,
                        value_weights)


def _rows(df: DataFrame, value: str, by) -> DataFrame:
    rows = df.where(F.col(value).isNotNull())
    for key in by:
        rows = rows.where(F.col(key).isNotNull())
    return rows


def _with_percentiles(table: DataFrame, df: DataFrame, value: str, by, names: dict,
                      approx: bool = False) -> DataFrame:
    """Add percentile columns (name -> probability) to a per-group table."""
    points = exact_percentiles(df, value, list(names.values()), by, approx=approx)
    if by:
        table = table.join(points, list(by))
        array = F.col("p")
    else:
        array = points.scalar()
    return table.withColumns({n: F.get(array, i) for i, n in enumerate(names)}).drop("p")


def group_stats(df: DataFrame, by: str, value: str, k: int | None = None) -> DataFrame:
    """count, mean and sample std per group, largest groups first."""
    out = _rows(df, value, [by]).groupBy(by).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std")).orderBy(F.desc("count"), by)
    return out if k is None else out.limit(k)


def profile(df: DataFrame, value: str, by=(), approx: bool = False) -> DataFrame:
    """n, min, max, mean, median, sample std and coefficient of variation (%)."""
    table = _rows(df, value, by).groupBy(*by).agg(
        F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    table = table.withColumn("cv_pct", F.when(F.col("mean") != 0,
                                              F.col("std") / F.col("mean") * 100))
    return _with_percentiles(table, df, value, by, {"median": 0.5}, approx)


def describe(df: DataFrame, value: str, by=(), approx: bool = False) -> DataFrame:
    table = _rows(df, value, by).groupBy(*by).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"), F.min(value).alias("min"),
        F.max(value).alias("max"))
    return _with_percentiles(table, df, value, by,
                             {"p25": 0.25, "p50": 0.5, "p75": 0.75}, approx)


def percentiles(df: DataFrame, value: str, by=(), points=(10, 25, 50, 75, 90),
                approx: bool = False) -> DataFrame:
    """Columns p10, p25, ... per group, linear interpolation."""
    table = exact_percentiles(df, value, [p / 100 for p in points], by, approx=approx)
    return table.select(*by, *[F.get("p", i).alias(f"p{p}") for i, p in enumerate(points)])


def iqr_outliers(df: DataFrame, value: str, by=(), reach: float = 1.5) -> DataFrame:
    """Rows outside q1 - reach*iqr .. q3 + reach*iqr: count and percent."""
    weights = value_weights(df, value, by)
    quartiles = percentiles_of_weights(weights, [0.25, 0.75], by)
    if by:
        marked = join_group_table(weights, quartiles, by, "v").withColumn("q", F.col("p"))
    else:
        marked = weights.withColumn("q", quartiles.scalar())
    q1, q3 = F.get("q", 0), F.get("q", 1)
    iqr = q3 - q1
    out = (F.col("v") < q1 - reach * iqr) | (F.col("v") > q3 + reach * iqr)
    sums = marked.groupBy(*by).agg(F.sum("n").alias("n"),
                                   F.sum(F.when(out, F.col("n")).otherwise(0)).alias("outliers"))
    return sums.withColumn("outlier_pct", percent("outliers", "n"))


def skewness(value) -> Column:
    """Bias-adjusted sample skewness; fewer than 3 values give null, equal
    values 0."""
    n = F.count(col(value))
    adjusted = F.skewness(col(value)) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n >= 3, F.when(F.var_pop(col(value)) > 0, adjusted).otherwise(0.0))


def skewness_by(df: DataFrame, value: str, by=()) -> DataFrame:
    return _rows(df, value, by).groupBy(*by).agg(skewness(value).alias("skewness"))


def correlation(x, y) -> Column:
    """Pearson correlation over rows with both values; null if one is constant."""
    x, y = col(x).cast("double"), col(y).cast("double")
    spread = (F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y)))
    return F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))


def correlations(df: DataFrame, value: str, others, by=()) -> DataFrame:
    """Pearson correlation with each other column over rows that have both."""
    rows = df
    for key in by:
        rows = rows.where(F.col(key).isNotNull())
    return rows.groupBy(*by).agg(*[
        correlation(value, o).alias(f"corr_{o}")
        for o in others])


def flag_correlations(df: DataFrame, value: str, names, k: int | None = 5) -> DataFrame:
    """Flags with the strongest Pearson correlation to a value, in one aggregate.

    For a 0/1 flag set in a share p of the rows the covariance is
    p * (mean with the flag - overall mean), so two sums per flag are enough.
    Constant flags have no correlation and are left out.
    """
    names = list(names)
    rows = df.where(F.col(value).isNotNull())
    sums = [F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd")]
    for i, name in enumerate(names):
        hit = F.col(f"`{name}`")
        sums += [F.count_if(hit).alias(f"n{i}"), F.avg(F.when(hit, F.col(value))).alias(f"mean{i}")]
    wide = rows.agg(*sums)
    pairs = F.array(*[F.struct(F.lit(n).alias("skill"), (F.col(f"n{i}") / F.nullif(F.col("n"), F.lit(0)))
                               .alias("p"), F.col(f"mean{i}").alias("m"))
                      for i, n in enumerate(names)])
    parts = wide.select("mean", "sd", F.inline(pairs))
    spread = F.sqrt(F.col("p") * (1 - F.col("p"))) * F.col("sd")
    corr = F.col("p") * (F.col("m") - F.col("mean")) / F.nullif(spread, F.lit(0.0))
    out = parts.select("skill", corr.alias("corr")).where(F.col("corr").isNotNull())
    out = out.orderBy(F.desc(F.abs("corr")), "skill")
    return out if k is None else out.limit(k)


def null_audit(df: DataFrame, pay="average_salary", years="years_experience_required",
               degree="education_level", remote="is_remote", bounds=(30000, 500000)) -> DataFrame:
    """Threshold counts and missing shares in one row."""
    return df.agg(
        F.count_if(F.col(pay) < bounds[0]).alias("below_range"),
        F.count_if(F.col(pay) > bounds[1]).alias("above_range"),
        F.count(years).alias("with_experience"),
        F.count_if(F.col(years).isNull()).alias("missing_experience"),
        F.avg(F.col(degree).eqNullSafe(F.lit("No education")).cast("double")).alias(
            "share_no_degree"),
        (F.avg(F.coalesce(F.col(remote), F.lit(False)).cast("double")) * 100).alias("remote_pct"))


def histogram(df: DataFrame, value: str, bins: int, condition: Column | None = None) -> DataFrame:
    """Equal-width bins over [min, max]; empty bins count 0."""
    rows = _rows(df, value, ())
    rows = rows.where(condition) if condition is not None else rows
    ends = rows.agg(F.struct(F.min(value).cast("double").alias("lo"),
                             F.max(value).cast("double").alias("hi"))).scalar()
    width = (ends["hi"] - ends["lo"]) / bins
    number = F.when(width == 0, 0).otherwise(
        F.least(F.floor((F.col(value) - ends["lo"]) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)))
    counts = rows.groupBy(number.cast("int").alias("bin")).agg(F.count("*").alias("count"))
    grid = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").select(
        "bin", (ends["lo"] + F.col("bin") * width).alias("bin_start"),
        F.coalesce("count", F.lit(0)).alias("count"))
