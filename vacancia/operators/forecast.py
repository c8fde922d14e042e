"""Linear forecast of cumulative counts, for all keys in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.pay import percent
from .filters import drop_missing
from .merge import union_all
from .metrics import period_counts, top_counts
from .trends import cumulative, elapsed_days


def history(df: DataFrame, key: str = "title", k: int | None = 5, posted="date_posted"):
    """Cumulative count and elapsed days per key and day (of the top k keys)."""
    rows = drop_missing(df, [posted])
    counts = period_counts(rows, key, posted, "day")
    if k is not None:
        counts = counts.join(F.broadcast(top_counts(rows, key, k).select(key)), key, "left_semi")
    return elapsed_days(cumulative(counts, "day", by=[key], name="cumulative"), key)


def fit(past: DataFrame, key: str = "title", min_days: int = 5) -> DataFrame:
    """Least-squares line of the cumulative count per key."""
    y, x = F.col("cumulative").cast("double"), F.col("elapsed").cast("double")
    line = past.groupBy(key).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), F.count("*").alias("days"),
        F.max("elapsed").alias("last_elapsed"), F.max("day").alias("last_day"),
        F.max("cumulative").alias("current_total"))
    return line.where(F.col("days") >= min_days)


def predict(line: DataFrame, key: str = "title", horizon: int = 30, band: float = 0.1):
    """The next days of each line with a band around them."""
    ahead = line.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    value = F.col("intercept") + F.col("slope") * (F.col("last_elapsed") + F.col("step"))
    return ahead.select(key, F.date_add("last_day", F.col("step")).alias("day"),
                        value.alias("cumulative"), (value * (1 - band)).alias("lower"),
                        (value * (1 + band)).alias("upper"))


def forecast(df: DataFrame, key: str = "title", k: int | None = 5, horizon: int = 30,
             band: float = 0.1, min_days: int = 5, posted="date_posted") -> DataFrame:
    """History and forecast in one table, tagged Historical / Predicted."""
    past = history(df, key, k, posted)
    line = fit(past, key, min_days)
    known = past.join(line.select(key), key, "left_semi").select(
        key, "day", F.col("cumulative").cast("double").alias("cumulative"),
        F.lit("Historical").alias("type"))
    coming = predict(line, key, horizon, band).withColumn("type", F.lit("Predicted"))
    return union_all([coming, known])


def forecast_summary(df: DataFrame, key: str = "title", k: int | None = 5, horizon: int = 30,
                     min_days: int = 5, posted="date_posted") -> DataFrame:
    """Expected growth until the end of the horizon; whole numbers, cut off."""
    line = fit(history(df, key, k, posted), key, min_days)
    end = F.col("intercept") + F.col("slope") * (F.col("last_elapsed") + horizon)
    out = line.withColumn("predicted", end.cast("bigint"))
    growth = F.col("predicted") - F.col("current_total")
    return out.select(key, "current_total", "predicted", growth.alias("growth"),
                      percent(growth, "current_total").alias("growth_pct"), "r2", "days")
