"""Shards by jump consistent hashing, in Spark functions only.

The published algorithm: from a 64-bit key a linear congruential generator gives
the buckets at which the key would jump as buckets are added; the last one
below the number of shards is the shard. There is no table, and shard n+1 takes
its rows evenly from the others and moves nothing else. The 64-bit state is
kept as two 32-bit halves, so that no product leaves a long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .tables import cut, fresh, gapless

# The multiplier of the published generator, as 32-bit and 16-bit parts.
_MULTIPLIER = 2862933555777941757
_HIGH, _LOW = _MULTIPLIER >> 32, _MULTIPLIER & 0xFFFFFFFF
_MASK16, _MASK32 = 0xFFFF, 0xFFFFFFFF


def _product32(a: Column, factor: int) -> Column:
    """a * factor modulo 2^32, both below 2^32."""
    low, high = F.lit(factor & _MASK16), F.lit(factor >> 16)
    return (a * low + F.shiftleft((a * high).bitwiseAND(_MASK16), 16)).bitwiseAND(_MASK32)


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """state * multiplier + 1 modulo 2^64."""
    middle = low * F.lit(_LOW >> 16)  # below 2^48
    first = low * F.lit(_LOW & _MASK16) + F.shiftleft(middle.bitwiseAND(_MASK16), 16) + 1
    carry = F.shiftright(first, 32) + F.shiftright(middle, 16)
    return ((carry + _product32(high, _LOW) + _product32(low, _HIGH)).bitwiseAND(_MASK32),
            first.bitwiseAND(_MASK32))


def key_halves(key: Column) -> tuple[Column, Column]:
    """The first 64 bits of the md5 of the key's text, as two 32-bit halves; null counts as ''."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return tuple(F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))


def jump_shard(high: Column, low: Column, shards: int) -> Column:
    """Shard of a 64-bit key from 0 to shards - 1. Each step jumps ahead by one shard at least."""
    if shards < 1:
        raise ValueError("at least one shard")
    start = F.struct(high.alias("high"), low.alias("low"), F.lit(0).cast("long").alias("shard"),
                     F.lit(0).cast("long").alias("jump"))

    def step(s: Column, _: Column) -> Column:
        up, down = _next(s["high"], s["low"])
        jump = F.floor((s["jump"] + 1) * (F.lit(float(1 << 31)) / (F.shiftright(up, 1) + 1)))
        return F.when(s["jump"] < shards, F.struct(
            up.alias("high"), down.alias("low"), s["jump"].alias("shard"),
            jump.cast("long").alias("jump"))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step)["shard"].cast("int")


def shard(df: DataFrame, shards: int = 16, key: str = "doc_id") -> DataFrame:
    """All columns, and shard, grown_shard (with one shard more) and slot (gapless from 0 in a shard).

    The shard depends on the key and the number of shards alone; a null key
    counts as the empty string, rows of equal keys share a shard. The slot
    follows the table's order. Columns named like the results are replaced. An
    empty table gives an empty result. The rows are checkpointed, so keep only
    the columns that are needed; slots are numbered per task and moved up by
    counts, so a hot key or shard never meets in one task.
    """
    df = df.drop("shard", "grown_shard", "slot")
    high, low = fresh(df.columns, "high", "low")
    key_high, key_low = key_halves(F.col(f"`{key}`"))
    placed = (df.withColumns({high: key_high, low: key_low})
              .withColumns({"shard": jump_shard(F.col(high), F.col(low), shards),
                            "grown_shard": jump_shard(F.col(high), F.col(low), shards + 1)})
              .drop(high, low))
    return gapless(cut(placed), ["shard"], "slot")
