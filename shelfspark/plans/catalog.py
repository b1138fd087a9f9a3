"""Listing pages and detail pages to one catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from shelfspark.functions import nested as N
from shelfspark.functions.text import is_product_url
from shelfspark.operators.dedupe import first_n
from shelfspark.operators.merge import merge_adv, merge_cmp
from shelfspark.operators.page_tree import page_nodes
from shelfspark.operators.pages import (
    card_records,
    card_records_http,
    detail_records,
    detail_records_http,
    listing_cards,
    product_fields,
    product_links,
)
from shelfspark.operators.skew import splittable_left_join
from shelfspark.session import scratch
from shelfspark.site import SiteProfile

ORDER = ["page_id", "block"]
# Columns of the HTTP record the detail page fills, "N/A" until then.
_FILLED_BY_DETAIL = (
    "category_breadcrumb", "material_text", "description", "feature_bullets", "dimensions",
    "tcin", "upc", "brand",
)


def _kept(cards: DataFrame) -> DataFrame:
    """Listing records, written once: their pages are read once, their URLs prune the detail pages."""
    path = scratch(cards.sparkSession, "listing")
    cards.write.parquet(path)
    return cards.sparkSession.read.schema(cards.schema).parquet(path)


def _wanted_pages(pages: DataFrame, listed: DataFrame, url: str) -> DataFrame:
    """One page for each listed URL, before any page is read: the first by ``page_id``.

    The first page is found over narrow columns; payloads are only filtered by semi-joins, never
    sorted. Without a ``page_id``, a URL's copies are told apart by a hash of the page.
    """
    kept = [c for c in ("url", "page_id", "html") if c in pages.columns]
    wanted = listed.filter(F.col(url) != "").select(F.col(url).alias("_listed")).distinct()
    rows = pages.select(*kept).withColumn("_at", F.col("page_id") if "page_id" in kept else F.xxhash64("html"))
    rows = rows.filter(F.col("url") != "").join(wanted, F.col("url") == F.col("_listed"), "left_semi")
    first = rows.groupBy(F.col("url").alias("_first_url")).agg(F.min("_at").alias("_first_at"))
    same = (F.col("url") == F.col("_first_url")) & (F.col("_at") == F.col("_first_at"))
    # equal copies of one page may be left
    copies = Window.partitionBy("url").orderBy("_at")
    one = rows.join(first, same, "left_semi").withColumn("_copy", F.row_number().over(copies))
    return one.filter("_copy = 1").select(*kept)


def _with_capture_time(pages: DataFrame) -> tuple[DataFrame, list[str]]:
    """Pages with ``scraped_at``, and the columns that go with every card."""
    if "scraped_at" not in pages.columns:
        pages = pages.withColumn("scraped_at", F.lit(None).cast("timestamp_ntz"))
    return pages, ["page_id", "scraped_at"]


def build_catalog(
    listing_pages: DataFrame,
    detail_pages: DataFrame | None = None,
    profile: SiteProfile = SiteProfile(),
    max_products: int | None = None,
) -> DataFrame:
    """Typed catalog of (page_id, html) listing pages, merged with (url, html) detail pages.

    Without detail pages this is the listing-only mode: no join is planned. Encounter order is
    page, then card. ``scraped_at`` is the listing page's own capture time, null if it has none.
    """
    pages, keys = _with_capture_time(listing_pages)
    cards = card_records(listing_cards(pages, keys), profile, keys)
    cards = first_n(cards, max_products, ORDER).select(
        "*", F.lit(True).alias("in_stock"), F.lit("").alias("fulfillment_info")
    )
    if detail_pages is None:
        return cards
    listing = cards.select(
        "*",
        F.lit(0.0).alias("sale_price"),
        *[F.lit("").alias(c) for c in ("color_selected", "category_breadcrumb", "description", "material_text", "seller")],
        *[N.empty_list().alias(c) for c in ("highlights", "feature_bullets")],
        *[N.empty_map().alias(c) for c in ("dimensions", "dimensions_table", "specifications")],
    )
    listing = _kept(listing)
    details = detail_records(page_nodes(_wanted_pages(detail_pages, listing, "url"), ["url"]), profile)
    return merge_adv(listing, details)


def build_catalog_http(
    listing_pages: DataFrame,
    detail_pages: DataFrame | None = None,
    profile: SiteProfile = SiteProfile(),
    max_products: int | None = None,
    variant: str = "cmp",
) -> DataFrame:
    """Catalog in the HTTP record form; ``sim`` has no detail step."""
    pages, keys = _with_capture_time(listing_pages)
    cards = card_records_http(listing_cards(pages, keys, variant), profile, keys, variant)
    cards = first_n(cards, max_products, ORDER, zero_means_all=False)
    if variant == "sim":
        return cards
    listing = cards.select(
        "*",
        *[F.lit("N/A").alias(c) for c in _FILLED_BY_DETAIL],
        F.when(F.col("image_url") != "", F.col("image_url")).otherwise(F.lit("N/A")).alias("all_images"),
        F.lit(False).alias("best_seller"),
    )
    if detail_pages is None:
        return listing
    listing = _kept(listing)
    details = detail_records_http(
        page_nodes(_wanted_pages(detail_pages, listing, "product_url"), ["url"]), profile
    )
    return merge_cmp(listing, details.withColumnRenamed("url", "product_url"))


def build_catalog_from_links(
    catalog_pages: DataFrame,
    product_pages: DataFrame,
    profile: SiteProfile = SiteProfile(),
    max_products: int | None = None,
) -> DataFrame:
    """Product links of (page_id, html) catalog pages, each with the six fields of its page.

    A link whose page is not among the (url, html) product pages gives no record.
    """
    links = product_links(
        catalog_pages, ["page_id"], profile.base, lambda u: is_product_url(u, profile.host)
    )
    wanted = _kept(first_n(links, max_products, ["page_id", "pos"]))
    fields = product_fields(_wanted_pages(product_pages, wanted, "url")).withColumnRenamed("url", "_page")
    joined = splittable_left_join(wanted, fields, "url", "_page")
    return joined.filter(F.col("_page").isNotNull()).drop("_page")
