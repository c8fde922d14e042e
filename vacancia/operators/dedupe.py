"""Keep-first dedupe and top-n per group.

All of it is `row_number` under a small bound. Spark turns such a filter into a
limit per task and group *before* the shuffle, so a key that holds a third of
all rows sends a few rows per task, not its whole group, to one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.workspace import materialize

# Spark limits before the shuffle up to this rank (its documented default).
_PRE_SHUFFLE_LIMIT = 1000
_SALTS = 64
_PART_ROWS, _PARTS = 200_000, 3


def _order(order) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def top_n_per_group(df: DataFrame, keys, order, n: int, rank: str | None = None) -> DataFrame:
    """First n rows of each group in the given (total) order.

    Beyond the rank Spark limits ahead of the shuffle, each group is first cut
    to n rows in each of its salted parts; the result is the same.
    """
    order = _order(order)
    name = rank or "_rank"
    if n > _PRE_SHUFFLE_LIMIT:
        salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns
                                   if dict(df.dtypes)[c].split("<")[0] != "map"]), F.lit(_SALTS))
        parts = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (df.withColumn("_salt", salt).withColumn(name, F.row_number().over(parts))
              .where(F.col(name) <= n).drop("_salt", name))
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    ranked = ranked.where(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)


def dedupe_first(df: DataFrame, keys, order, null_keys: str = "collapse") -> DataFrame:
    """One row per key, the first in the given order.

    null_keys='collapse' takes null keys as equal to each other;
    'keep' keeps every row in which all keys are null.
    """
    if null_keys not in ("collapse", "keep"):
        raise ValueError(f"null_keys must be 'collapse' or 'keep', not {null_keys!r}")
    keys = list(keys)
    if null_keys == "collapse":
        return top_n_per_group(df, keys, order, 1)
    known = reduce(or_, [F.col(k).isNotNull() for k in keys])
    unknown = reduce(and_, [F.col(k).isNull() for k in keys])
    return top_n_per_group(df.where(known), keys, order, 1).unionByName(df.where(unknown))


def told_apart(df: DataFrame, order: str, *by: str) -> bool:
    """Whether the order has a value in each row, and each but once (per `by`); one grouped count."""
    return df.groupBy(order, *by).count().where((F.col("count") > 1) | F.col(order).isNull()).isEmpty()


def pick(df: DataFrame, chosen: DataFrame, order: str) -> DataFrame:
    """Rows whose order value is one of the chosen.

    As a condition Spark moves it below the joins that bring long columns: those are
    then joined to the chosen rows alone, and neither sorted nor shuffled after.
    """
    return df.where(F.col(order).isin(chosen.select(order)))


def pick_parts(df: DataFrame, chosen: DataFrame, order: str, rows: int = _PART_ROWS,
               most: int = _PARTS) -> Iterator[DataFrame]:
    """`pick` in several plans, of about `rows` rows each or, if they were more than `most`, of equal shares.

    For rows with long columns that a writer shuffles: one part after the other has its shuffle on
    disk. Each part reads the tables again, so there are few. `chosen` should be a stored table.
    """
    parts = min(most, -(-chosen.count() // rows)) if most > 1 else 1
    if parts < 2:
        yield pick(df, chosen, order)
        return
    part = F.pmod(F.xxhash64(order), F.lit(parts))
    for i in range(parts):
        yield pick(df, chosen.where(part == i), order)


def dedupe_parts(df: DataFrame, keys, order: str, wide: DataFrame | None = None,
                 most: int = _PARTS) -> Iterator[DataFrame]:
    """`dedupe_first` for rows with long columns, in parts (see `pick_parts`): keys and order alone decide,
    then the rows are picked.

    `wide` is a cheaper plan for the same rows, if there is one. Where the order
    does not tell rows apart, they are ranked whole, in one part.
    """
    if not told_apart(df, order):
        yield dedupe_first(df, keys, [order])
        return
    firsts = df.groupBy(*keys).agg(F.min(order).alias(order))
    chosen = materialize(firsts.select(order), "first-keys")
    yield from pick_parts(df if wide is None else wide, chosen, order, most=most)


def dedupe_by_keys(df: DataFrame, keys, order: str, wide: DataFrame | None = None) -> DataFrame:
    """`dedupe_parts` in one part."""
    return next(dedupe_parts(df, keys, order, wide, most=1))
