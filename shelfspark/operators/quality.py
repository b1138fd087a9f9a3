"""The data validation checklist as one table (check, n_rows, n_bad)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfspark.functions.nested import iso_to_time
from shelfspark.functions.text import blank_to_null
from shelfspark.operators.ranged import content


def bad_price(price: Column) -> Column:
    """Not a number, not above zero, or not finite."""
    value = price.cast("string").try_cast("double")
    return value.isNull() | F.isnan(value) | (value <= 0) | (value == float("inf"))


def bad_rating(rating: Column) -> Column:
    return rating.isNull() | ~rating.between(0, 5)


def bad_url(url: Column) -> Column:
    return url.isNull() | ~url.startswith("https://")


def bad_time(text: Column) -> Column:
    return iso_to_time(text).isNull()


def row_checks(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """All row-level checks in one aggregate."""
    one = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.coalesce(bad, F.lit(True))).alias(name) for name, bad in checks.items()],
    )
    rows = F.array(
        *[F.struct(F.lit(c).alias("check"), F.col(c).alias("n_bad")) for c in checks]
    )
    return one.select(F.col("_n").alias("n_rows"), F.inline(rows)).select("check", "n_rows", "n_bad")


def duplicate_ids(df: DataFrame, key: str = "product_id") -> DataFrame:
    """Rows beyond the first of each non-empty id. Counts per id combine before the shuffle."""
    per_id = (
        df.groupBy(blank_to_null(F.col(key)).alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    )
    return per_id.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("_id").isNotNull(), F.col("_n") - 1)), F.lit(0)).alias("n_bad"),
    ).select(F.lit("unique_ids").alias("check"), "n_rows", "n_bad")


def row_digest(df: DataFrame) -> Column:
    """128 bits of a whole row, as two numbers."""
    return F.struct(content(df).alias("a"), content(df, seed=1).alias("b"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of equal rows.

    Digests are counted, combined before their shuffle. Only rows whose digest another row has are
    compared whole, so the rows that are alone never move, however wide they are.
    """
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), row_digest(df).alias("digest"))
    counts = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    met = counts.filter("n > 1")
    same = rows.join(met, "digest", "left_semi").groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    all_rows = counts.agg(F.sum("n").alias("n_rows"))
    repeated = same.agg(F.sum(F.col("n") - 1).alias("n_bad"))
    # one row each
    return all_rows.select(F.lit("duplicate_rows").alias("check"), F.coalesce("n_rows", F.lit(0)).alias("n_rows")).join(
        repeated.select(F.coalesce("n_bad", F.lit(0)).alias("n_bad"))
    )


def breadcrumb_hierarchy(df: DataFrame, path: str = "category_breadcrumb", sep: str = " > ") -> DataFrame:
    """Nodes of the breadcrumb tree that appear under more than one chain of parents."""
    parts = F.split(F.col(path), sep)
    # equal paths collapse first, so the explode sees each path once
    edges = (
        df.groupBy(path)
        .agg(F.lit(1).alias("_one"))
        .select(F.posexplode(parts).alias("_at", "node"), parts.alias("_parts"))
        .select("node", F.array_join(F.slice("_parts", F.lit(1), F.col("_at")), sep).alias("above"))
        .distinct()
    )
    per_node = edges.groupBy("node").agg(F.count(F.lit(1)).alias("_chains"))
    return per_node.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("_chains") > 1).alias("n_bad")
    ).select(F.lit("breadcrumb_hierarchy").alias("check"), "n_rows", "n_bad")
