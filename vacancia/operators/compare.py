"""Two filter sets side by side, from one scan of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.pay import percent
from .filters import FilterSpec
from .metrics import flag_totals


def _sets(a: FilterSpec, b: FilterSpec) -> dict:
    return {"A": a.predicate(), "B": b.predicate()}


def compare_kpis(df: DataFrame, a: FilterSpec, b: FilterSpec) -> DataFrame:
    """(metric, a, b, delta) for jobs, companies, mean pay and remote %."""
    sums = []
    for name, hit in _sets(a, b).items():
        remote = hit & F.coalesce("is_remote", F.lit(False))
        sums += [F.count_if(hit).alias(f"{name}_jobs"),
                 F.count_distinct(F.when(hit, F.col("company"))).alias(f"{name}_companies"),
                 F.avg(F.when(hit, F.col("average_salary"))).alias(f"{name}_pay"),
                 F.count_if(remote).alias(f"{name}_remote")]
    wide = df.agg(*sums)

    def values(s: str):
        return [F.col(f"{s}_jobs").cast("double"), F.col(f"{s}_companies").cast("double"),
                F.col(f"{s}_pay"), percent(f"{s}_remote", f"{s}_jobs")]

    names = ("total_jobs", "unique_companies", "avg_salary", "remote_pct")
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), x.alias("a"), y.alias("b"))
                     for n, x, y in zip(names, values("A"), values("B"))])
    return wide.select(F.inline(rows)).withColumn("delta", F.col("b") - F.col("a"))


def _long(df: DataFrame, value_columns: dict) -> DataFrame:
    """One row per set: (set, the rest)."""
    rows = F.array(*[F.struct(F.lit(s).alias("set"), F.col(c).alias("count"))
                     for s, c in value_columns.items()])
    keep = [c for c in df.columns if c not in value_columns.values()]
    return df.select(*keep, F.inline(rows)).where(F.col("count") > 0)


def _top_per_set(df: DataFrame, order: str, key: str, k: int) -> DataFrame:
    tops = [df.where(F.col("set") == s).orderBy(F.desc(order), key).limit(k) for s in ("A", "B")]
    return tops[0].unionByName(tops[1])


def compare_top(df: DataFrame, a: FilterSpec, b: FilterSpec, column: str = "company",
                k: int = 5) -> DataFrame:
    """The k most frequent values of each set."""
    hits = _sets(a, b)
    counts = (df.where(F.col(column).isNotNull() & (hits["A"] | hits["B"])).groupBy(column)
              .agg(F.count_if(hits["A"]).alias("n_a"), F.count_if(hits["B"]).alias("n_b")))
    return _top_per_set(_long(counts, {"A": "n_a", "B": "n_b"}), "count", column, k)


def compare_skills(flags: DataFrame, names, a: FilterSpec, b: FilterSpec, k: int = 10):
    """The k most frequent skills of each set with their share."""
    sums = flag_totals(flags, names, _sets(a, b))
    rows = F.array(*[F.struct(F.lit(s).alias("set"), percent(s, f"{s}_rows").alias("share"),
                              F.col(f"{s}_rows").alias("rows")) for s in ("A", "B")])
    shares = sums.select("skill", F.inline(rows)).where(F.col("rows") > 0).drop("rows")
    return _top_per_set(shares, "share", "skill", k)


def compare_histogram(df: DataFrame, a: FilterSpec, b: FilterSpec, value="average_salary",
                      bins: int = 20) -> DataFrame:
    """Histogram of each set over its own range: one aggregate for both ranges, one for both counts."""
    hits = _sets(a, b)
    rows = df.where(F.col(value).isNotNull() & (hits["A"] | hits["B"])).select(
        F.col(value).cast("double").alias("v"), hits["A"].alias("A"), hits["B"].alias("B"))
    ends = rows.agg(F.struct(*[f(F.when(F.col(s), F.col("v"))).alias(f"{s}{n}")
                               for s in ("A", "B") for n, f in (("lo", F.min), ("hi", F.max))])).scalar()

    def place(s: str):
        width = (ends[f"{s}hi"] - ends[f"{s}lo"]) / bins
        number = F.when(width == 0, 0).otherwise(F.least(
            F.floor((F.col("v") - ends[f"{s}lo"]) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)))
        return F.struct(F.lit(s).alias("set"), F.when(F.col(s), number.cast("int")).alias("bin"))

    counts = (rows.select(F.inline(F.array(place("A"), place("B")))).where(F.col("bin").isNotNull())
              .groupBy("set", "bin").agg(F.count("*").alias("count")))
    sets = F.array(*[F.struct(F.lit(s).alias("set"), ends[f"{s}lo"].alias("lo"), ends[f"{s}hi"].alias("hi"))
                     for s in ("A", "B")])
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), F.inline(sets))
    return grid.join(counts, ["set", "bin"], "left").select(
        "bin", (F.col("lo") + F.col("bin") * ((F.col("hi") - F.col("lo")) / bins)).alias("bin_start"),
        F.coalesce("count", F.lit(0)).alias("count"), "set")
