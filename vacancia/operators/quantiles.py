"""Exact percentiles and positions that no single task has to hold.

Spark's `percentile` keeps every distinct value of a group in one task, and a window
over a group sorts it in one. Here equal values are counted first (combined
before the shuffle) and sorted over the cluster by group and value; Spark's range
partitioning cuts the sorted rows into even ranges wherever groups begin and end. Only row
counts per (range, group) are summed up along a group: they say which ranges hold a
wanted rank, and only these are looked at. The more data, the more ranges: a
group of any size is spread over as many tasks as it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.workspace import materialize


def value_weights(df: DataFrame, value: str, by=()) -> DataFrame:
    """(by..., v, n): rows per distinct non-null value; null groups dropped."""
    rows = df
    for key in by:
        rows = rows.where(F.col(key).isNotNull())
    # What counts is asked after the count: a filter below would work a long expression out once more per mention.
    rows = rows.select(*by, F.col(value).cast("double").alias("v"))
    return rows.groupBy(*by, "v").agg(F.count(F.when(~F.isnan("v"), F.col("v"))).alias("n")).where("n > 0")


_SALTS = 16


def join_group_table(rows: DataFrame, table: DataFrame, by, spread: str, how: str = "inner") -> DataFrame:
    """Join a table of one row per group without bringing a group together.

    The rows are salted by the column `spread`, the table is repeated once per
    salt: a group that holds most rows meets its row in many tasks.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(_SALTS)).cast("int"))
    repeated = table.withColumn("_salt", F.explode(F.array(*map(F.lit, range(_SALTS)))))
    return salted.join(repeated, [*by, "_salt"], how).drop("_salt")


def ranges(rows: DataFrame, by, order, parts: int | None = None) -> DataFrame:
    """The rows stored in sorted ranges: `_part` and `_at` ascend with group and order.

    They are sorted and stored when this is called, since a second sort might cut them elsewhere.
    """
    keys = [*by, *order]
    placed = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    return materialize(placed.sortWithinPartitions(*keys).withColumns({
        "_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranges")


def range_sizes(rows: DataFrame, by, n: Column) -> DataFrame:
    """Per (range, group): size, first `_at`, below (rows of the group in earlier ranges), total of the group."""
    sizes = rows.groupBy("_part", *by).agg(F.sum(n).alias("size"), F.min("_at").alias("_first"))
    group = Window.partitionBy(*(by or [F.lit(0)]))
    upto = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    return (sizes.withColumn("below", F.sum("size").over(upto) - F.col("size"))
            .withColumn("total", F.sum("size").over(group)))


def positions(rows: DataFrame, by, order, parts: int | None = None) -> DataFrame:
    """The rows with `position` (0-based, gapless in their group by order) and `total` of the group.

    Groups and order must not be null. Rows of equal order stand side by side.
    """
    by, salt = list(by), "_salt"
    rows = ranges(rows.withColumn(salt, F.monotonically_increasing_id()), by, [order, salt], parts)
    sizes = range_sizes(rows, by, F.lit(1).cast("bigint"))
    return (rows.join(sizes, ["_part", *by])
            .withColumn("position", F.col("_at") - F.col("_first") + F.col("below"))
            .drop(salt, "_part", "_at", "_first", "size", "below"))


def exact_percentiles(df: DataFrame, value: str, probs, by=(), parts: int | None = None,
                      approx: bool = False) -> DataFrame:
    """One row per group with `p` (array of percentiles, linear interpolation)."""
    by, probs = list(by), [float(p) for p in probs]
    if approx:
        rows = df.where(F.col(value).isNotNull())
        for key in by:
            rows = rows.where(F.col(key).isNotNull())
        return rows.groupBy(*by).agg(F.percentile_approx(value, probs, 10000).alias("p"))
    return percentiles_of_weights(value_weights(df, value, by), probs, by, parts)


def percentiles_of_weights(weights: DataFrame, probs, by=(), parts: int | None = None) -> DataFrame:
    def wanted(total: Column):
        for p in probs:
            at = (total - 1) * F.lit(p)
            yield [(F.floor(at), 1 - (at - F.floor(at))), (F.ceil(at), at - F.floor(at))]

    return values_at_ranks(weights, wanted, len(probs), by, parts)


def values_at_ranks(weights: DataFrame, wanted, count: int, by=(), parts: int | None = None) -> DataFrame:
    """One row per group with `p`: `count` values read at 0-based ranks.

    `wanted(total)` yields, for each value, the (rank, share) pairs it is mixed
    from: one pair, or a lower and a higher rank. The weights are sorted and stored
    when this is called.
    """
    by = list(by)
    table = ranges(weights, by, ["v"], parts)
    sizes = range_sizes(table, by, F.col("n"))

    # Wanted ranks, kept with the range that holds them.
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), rank.cast("bigint").alias("rank"),
                               F.lit(share).cast("double").alias("share"))
                      for i, pairs in enumerate(wanted(F.col("total")))
                      for rank, share in pairs])
    here = F.filter(ranks, lambda r: (r["rank"] >= F.col("below")) &
                    (r["rank"] < F.col("below") + F.col("size")))
    targets = (sizes.select(*by, "_part", "below", here.alias("ranks"))
               .where(F.size("ranks") > 0))

    # Look at those ranges alone and read the values at the ranks.
    ordered = (Window.partitionBy(*by, "_part").orderBy("v")
               .rowsBetween(Window.unboundedPreceding, 0))
    placed = (table.join(targets, [*by, "_part"])
              .withColumn("end", F.col("below") + F.sum("n").over(ordered)))
    hits = placed.select(*by, "v", F.explode(F.filter("ranks", lambda r: (
        r["rank"] >= F.col("end") - F.col("n")) & (r["rank"] < F.col("end")))).alias("r"))

    def value(i: int) -> Column:
        mine = F.col("r.i") == i
        low = F.min(F.when(mine, F.col("v")))
        high = F.max(F.when(mine, F.struct(F.col("r.rank"), F.col("v"), F.col("r.share"))))
        return low + F.when(high["v"] > low, (high["v"] - low) * high["share"]).otherwise(0.0)

    return hits.groupBy(*by).agg(F.array(*[value(i) for i in range(count)]).alias("p"))


def median(df: DataFrame, value: str) -> DataFrame:
    """One row, one column: the exact median; null without values."""
    return exact_percentiles(df, value, [0.5]).select(F.element_at("p", 1).alias("median"))
