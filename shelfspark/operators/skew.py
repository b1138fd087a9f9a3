"""Even work: joins that survive a key holding a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Fewer than HOT_SHARE ids can each hold more than a 1/HOT_SHARE part of the rows; what stays
# whole is at most that part (5 GB of 100 TB), or HOT_ROWS rows of a smaller input.
HOT_SHARE = 20_000
HOT_ROWS = 1_000_000


def hot_keys(
    df: DataFrame, key: str, share: int = HOT_SHARE, least: int = HOT_ROWS
) -> DataFrame:
    """Keys with more than 1/share of all rows, and at least ``least``.

    There are fewer than ``share`` of them, whatever the data.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    hot = (F.col("_n") >= least) & (F.col("_n") * share > total)
    return counts.filter(hot).select(F.col(key).alias("_hot"))


def splittable_left_join(left: DataFrame, right: DataFrame, key: str, right_key: str) -> DataFrame:
    """Left join to a side with one row per key, whose hot left partitions AQE may split.

    AQE splits a skewed partition only where both sides come straight from a shuffle. A right
    side grouped by the same key would be joined in place, without one; joining on the key and
    its hash asks for the shuffle, so the split stays possible. Only the right side, one row per
    key, pays for it.
    """
    same = (F.col(key) == F.col(right_key)) & (F.xxhash64(F.col(key)) == F.xxhash64(F.col(right_key)))
    return left.join(right, same, "left")

