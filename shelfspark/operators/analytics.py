"""Filters and aggregates over the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MONEY = "decimal(12,2)"


def sale_items(df: DataFrame, *columns: str) -> DataFrame:
    return df.filter("is_sale").select(*columns) if columns else df.filter("is_sale")


def high_rated(df: DataFrame, least: float = 4.5, rating: str = "rating") -> DataFrame:
    return df.filter(F.col(rating) >= least)


def new_items(df: DataFrame) -> DataFrame:
    return df.filter("is_new")


def product_cards(df: DataFrame) -> DataFrame:
    """Records that name a product: a product URL and a title."""
    return df.filter(F.contains("url", F.lit("/A-")) & (F.col("title") != ""))


def exact_mean(price: str) -> Column:
    """Mean of a price summed as decimals, so the order of rows cannot change it."""
    c = F.col(price).cast(MONEY)
    return F.sum(c).cast("double") / F.count(c)


def mean_price(df: DataFrame, price: str = "price_current", by: str | None = None) -> DataFrame:
    """Mean price, per group if ``by`` is set."""
    grouped = df.groupBy(by) if by else df.groupBy()
    return grouped.agg(exact_mean(price).alias("mean_price"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def completeness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(field, n_rows, n_present, share) per column in one pass; empty text is absent."""
    names = columns or df.columns
    types = dict(df.dtypes)

    def present(c: str) -> Column:
        there = F.col(c).isNotNull()
        return there & (F.col(c) != "") if types[c] == "string" else there

    one = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(present(c)).alias(c) for c in names]
    )
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n_present")) for c in names])
    return one.select("_n", F.inline(fields)).select(
        "field",
        F.col("_n").alias("n_rows"),
        "n_present",
        (F.col("n_present") / F.nullif(F.col("_n"), F.lit(0).cast("bigint"))).alias("share"),
    )


def shortest(df: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """Shortest text per group, the earliest on ties."""
    return df.groupBy(key).agg(
        F.min_by(text, F.struct(F.length(text), F.col(order))).alias(text),
        F.min(F.length(text)).alias("length"),
    )
