"""First and latest record per product, rejects with reasons, price history, limits, unions.

No operator gathers a product in one task. "First" and "latest" are whole rows picked by a grouped
minimum or maximum, combined before the one shuffle. Verdicts and history look at the row before, in
ranges of a global order (``ranged``): read once, dealt once, and a hot id is spread like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from shelfspark.functions.text import blank_to_null, safe_str
from shelfspark.operators.ranged import content, with_previous
from shelfspark.operators.skew import splittable_left_join
from shelfspark.session import scratch

MISSING = "missing product_id"
DUPLICATE = "duplicate product_id"
EMPTY = "empty document text"
# More first records than this are not gathered in one task.
FIRST_IN_ONE_TASK = 10_000


def _position(order: list[Column], latest: bool = False) -> list[Column]:
    """A position that is never null: missing order values come last among firsts, first among latest."""
    parts = []
    for i, c in enumerate(order):
        missing = c.isNull()
        parts += [(~missing if latest else missing).alias(f"m{i}"), c.alias(f"v{i}")]
    return parts


def _extreme(df: DataFrame, key: str, order: list[str], latest: bool) -> DataFrame:
    """One row per key at its first or last position.

    Whole rows are picked by a minimum or maximum that is combined where they are read, so a hot key
    sends one row a task. Rows that tie in ``order`` are told apart by their content, and of equal
    rows one is taken. The row is one column, so none of its names clashes.
    """
    by = {c: F.col(f"`{c}`") for c in order}
    at = F.struct(*_position(list(by.values()), latest), content(df).alias("tie"))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    pick = F.max_by if latest else F.min_by
    ends = df.groupBy(F.col(f"`{key}`").alias("key")).agg(pick(row, at).alias("row"))
    return ends.select(*[F.col("row")[c].alias(c) for c in df.columns])


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row per key in encounter order; rows without an order value come last."""
    return _extreme(df, key, order, latest=False)


def keep_latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last row per key by ``order``; rows without an order value come before all others."""
    return _extreme(df, key, order, latest=True)


def with_reject_reason(
    df: DataFrame, key: str, order: str | list[str], document: str
) -> DataFrame:
    """Add ``reason``: null for accepted rows, else why the row is skipped.

    Checked in turn: missing id, id already claimed by an earlier row, empty document. An id is
    claimed before its document is checked, so a later row never replaces an empty first one.
    Exactly one row claims an id: rows without an order value come last, ties are broken by content,
    and of equal rows one is taken. A row claims its id if the row before it, in the order of id and
    position, has another.
    """
    by = [order] if isinstance(order, str) else list(order)
    id_ = blank_to_null(safe_str(F.col(f"`{key}`")))
    places = _position([F.col(f"`{c}`") for c in by])
    flagged = with_previous(df, id_, places, F.lit(None).cast("boolean"), "claimed before", "no value")
    reason = (
        F.when(id_.isNull(), MISSING)
        .when(F.col("claimed before"), DUPLICATE)
        .when(F.coalesce(F.col(f"`{document}`"), F.lit("")) == "", EMPTY)
    )
    return flagged.select(*[F.col(f"`{c}`") for c in df.columns], reason.alias("reason"))


def accepted(flagged: DataFrame) -> DataFrame:
    return flagged.filter(F.col("reason").isNull()).drop("reason")


def rejected(flagged: DataFrame) -> DataFrame:
    return flagged.filter(F.col("reason").isNotNull())


def reason_counts(flagged: DataFrame) -> DataFrame:
    """Rows per verdict; accepted rows count as ``accepted``."""
    return flagged.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n")
    )


def price_history(df: DataFrame, key: str, time: str, price: str, ties: list[str]) -> DataFrame:
    """Add ``previous_price`` and ``price_change`` of each record against the one before it.

    Records are put in the order of id, time and ties, and each takes the price of the row before if
    that has its id. A missing id is an id; missing times come first. Neither an id nor one instant
    of it is a task of its own.
    """
    order = [F.col(f"`{c}`") for c in (time, *ties)]
    found = with_previous(df, F.col(f"`{key}`"), order, F.col(f"`{price}`"), "same id", "previous price")
    return found.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.col("previous price").alias("previous_price"),
        (F.col(f"`{price}`") - F.col("previous price")).alias("price_change"),
    )


def first_n(df: DataFrame, n: int | None, order: list[str], zero_means_all: bool = True) -> DataFrame:
    """First ``n`` records in encounter order; None is all.

    ``n=0`` is all records for the ``adv`` and catalog-link readers and none for the HTTP readers
    (``zero_means_all=False``).
    """
    if n is None or (n == 0 and zero_means_all):
        return df
    if n <= FIRST_IN_ONE_TASK:
        return df.orderBy(*order).limit(n)
    # sorted ranges, counted; each range then knows how many rows go before it
    spark = df.sparkSession
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
    path = scratch(spark, "first")
    ranged.write.parquet(path)
    rows = spark.read.schema(ranged.schema).parquet(path)
    counts = {r["_range"]: r["n"] for r in rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}
    left, whole, cut = n, [], None
    for part in sorted(counts):
        if counts[part] > left:
            cut = part
            break
        whole.append(part)
        left -= counts[part]
    kept = rows.filter(F.col("_range") <= (whole[-1] if whole else -1))
    if cut is not None and left:
        # the one range that is cut holds a share of the rows, as every task does
        kept = kept.unionByName(rows.filter(F.col("_range") == cut).orderBy(*order).limit(left))
    return kept.drop("_range")


def first_pages(df: DataFrame, n: int | None, page: str = "page_num") -> DataFrame:
    """Rows of the first ``n`` pages; None or 0 is all."""
    return df if not n else df.filter(F.col(page) <= n)


def before_marker_rows(df: DataFrame, key: str, order: str, marker: Column) -> DataFrame:
    """Rows of each group before its first marker row (all rows if it has none).

    The first marker position is a pre-combined minimum per group; the join back keeps the rows
    where they are and may split a hot group.
    """
    firsts = (
        df.filter(marker)
        .groupBy(F.col(key).alias("_k"))
        .agg(F.min(order).alias("_stop"))
    )
    joined = splittable_left_join(df, firsts, key, "_k")
    return joined.filter(F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))).select(*df.columns)


def union_all(*frames: DataFrame) -> DataFrame:
    """Bag union of pages with one schema."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def union_runs(*frames: DataFrame) -> DataFrame:
    """Bag union of runs with drifting columns; missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one frame the other lacks, both ways; empty when the bags are equal."""
    return a.exceptAll(b).unionByName(b.exceptAll(a))
