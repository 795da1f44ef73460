"""Joins of many rows with the one row of their key, when some keys have very many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Rows of a key that one partition may hold.
ROWS_PER_PART = 128
#: So many hot keys are dealt out at most, those with the most rows: each key beyond them has less than a 100,000th of the rows.
BROADCAST_KEYS = 100_000


def spread_join(many: DataFrame, one: DataFrame, keys: str | list[str], by: str | Column, rows: int = ROWS_PER_PART, sizes: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """``many`` with ``one`` (inner or left) on ``keys``: a key with more than ``rows`` rows is dealt out by a hash of ``by``
    to as many parts as it needs, and its row in ``one`` is given to each of them. ``sizes`` is a table of the keys and their
    number of rows ``n``, if the caller has it; else ``many`` is read once more to count them, so give a written table."""
    keys = [keys] if isinstance(keys, str) else keys
    counted = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if sizes is None else sizes
    hot = counted.where(F.col("n") > rows).select(*(F.col(k).alias(f"_hot_{k}") for k in keys), F.ceil(F.col("n") / rows).cast("int").alias("_parts"))
    n = hot.limit(BROADCAST_KEYS + 1).count()
    if not n:
        return many.join(one, keys, how)
    hot = F.broadcast(hot if n <= BROADCAST_KEYS else hot.orderBy(F.desc("_parts")).limit(BROADCAST_KEYS))
    parts, extra = F.coalesce("_parts", F.lit(1)), [*(f"_hot_{k}" for k in keys), "_parts"]

    def dealt(side: DataFrame) -> DataFrame:
        same = F.lit(True)
        for k in keys:
            same &= side[k] == hot[f"_hot_{k}"]
        return side.join(hot, same, "left")

    left = dealt(many).withColumn("_part", F.pmod(F.xxhash64(by), parts).cast("int")).drop(*extra)
    right = dealt(one).withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop(*extra)
    return left.join(right, [*keys, "_part"], how).drop("_part")
