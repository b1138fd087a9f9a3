"""Listing rows joined with detail rows by URL, field by field.

The join is a left equi-join on a key that is unique on the detail side. A URL that holds a
large share of the listing rows is split by AQE's skew join (``skew.splittable_left_join``), so
no group ever has to fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfspark.functions import nested as N
from shelfspark.functions.text import blank_to_null, join_pipes
from shelfspark.operators.skew import splittable_left_join

# Which detail fields win, and by which test.
ADV_IF_NON_EMPTY_TEXT = ("description", "seller", "category_breadcrumb", "material_text", "color_selected")
ADV_IF_NON_EMPTY_LIST = ("images", "highlights", "feature_bullets", "colors")
ADV_IF_NON_EMPTY_MAP = ("dimensions", "dimensions_table", "specifications")
ADV_IF_POSITIVE = ("sale_price", "price_current", "price_regular")


def one_per_key(df: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """First row of every key by ``order`` (default: all other orderable columns).

    A grouped minimum, so copies of a hot key collapse before the shuffle.
    """
    rest = [c for c in df.columns if c != key]
    by = order or [c for c, t in df.dtypes if c != key and not t.startswith("map")]
    first = F.min_by(F.struct(*rest), F.struct(*by))
    return df.groupBy(key).agg(first.alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def _joined(listing: DataFrame, detail: DataFrame, key: str) -> DataFrame:
    """Left join; detail columns come prefixed with ``d_``. Rows without a URL never match."""
    renamed = detail.filter(F.col(key) != "").select(
        F.col(key).alias("_key"), *[F.col(c).alias(f"d_{c}") for c in detail.columns if c != key]
    )
    return splittable_left_join(listing, renamed, key, "_key")


def merge_adv(listing: DataFrame, detail: DataFrame, key: str = "url") -> DataFrame:
    """Detail wins where it has something; title, brand, rating, discounts and flags stay.

    A non-empty list of empty colours wins, an empty list loses. Without a detail row the
    listing row is unchanged. ``detail`` must hold one row per URL (``one_per_key``).
    """

    def pick(c: str) -> Column:
        if f"d_{c}" not in have:
            return F.col(c)
        d = F.col(f"d_{c}")
        if c in ADV_IF_NON_EMPTY_TEXT:
            d = blank_to_null(d)
        elif c in ADV_IF_NON_EMPTY_LIST or c in ADV_IF_NON_EMPTY_MAP:
            d = F.when(F.size(d) > 0, d)
        elif c in ADV_IF_POSITIVE:
            d = F.when(d > 0, d)
        else:
            return F.col(c)
        return F.coalesce(d, F.col(c)).alias(c)

    joined = _joined(listing, detail, key)
    have = set(joined.columns)
    return joined.select(*[pick(c) for c in listing.columns])


def merge_cmp(listing: DataFrame, detail: DataFrame, key: str = "product_url") -> DataFrame:
    """HTTP merge: title and breadcrumb always overwritten, prices if non-zero, rating and count
    if positive, lists if non-empty; material, dimensions, tcin and upc reset only with specs.

    Discounts are not recomputed. ``detail`` holds one row per URL, keyed by ``key``.
    """
    joined = _joined(listing, detail, key)
    found = F.col("_key").isNotNull()
    specs = F.col("d_specifications")
    has_specs = found & (F.size(specs) > 0)

    def when_detail(value: Column, c: str) -> Column:
        return F.when(found, value).otherwise(F.col(c))

    def from_specs(word: str, c: str) -> Column:
        value = F.coalesce(blank_to_null(N.value_by_word(specs, word)), F.lit("N/A"))
        return F.when(has_specs, value).otherwise(F.col(c))

    features = N.spec_features(specs)
    rules = {
        "product_name": lambda c: when_detail(F.col("d_title"), c),
        "category_breadcrumb": lambda c: when_detail(F.col("d_category_breadcrumb"), c),
        "current_price": lambda c: F.coalesce(F.nullif(F.col("d_current_price"), F.lit(0.0)), F.col(c)),
        "regular_price": lambda c: F.coalesce(F.nullif(F.col("d_regular_price"), F.lit(0.0)), F.col(c)),
        "rating": lambda c: F.when(F.col("d_rating") > 0, F.col("d_rating")).otherwise(F.col(c)),
        "review_count": lambda c: F.when(
            F.col("d_review_count") > 0, F.col("d_review_count")
        ).otherwise(F.col(c)),
        "all_images": lambda c: F.when(
            F.size("d_images") > 0, join_pipes(F.col("d_images"))
        ).otherwise(F.col(c)),
        "colors": lambda c: F.when(F.size("d_colors") > 0, join_pipes(F.col("d_colors"))).otherwise(
            F.col(c)
        ),
        "material_text": lambda c: from_specs("material", c),
        "dimensions": lambda c: from_specs("dimensions", c),
        "tcin": lambda c: from_specs("tcin", c),
        "upc": lambda c: from_specs("upc", c),
        "feature_bullets": lambda c: F.when(
            has_specs & (F.size(features) > 0), join_pipes(features)
        ).otherwise(F.col(c)),
    }
    return joined.select(
        *[rules[c](c).alias(c) if c in rules else F.col(c) for c in listing.columns]
    )


def with_image_vectors(text: DataFrame, image: DataFrame | None, key: str = "id") -> DataFrame:
    """Text vectors with their image vectors (null where missing or switched off).

    ``text`` has (key, ..., text_vector), ``image`` (key, image_vector) with unique keys.
    """
    if image is None:
        return text.withColumn("image_vector", F.lit(None).cast("array<float>"))
    return text.join(image.select(key, "image_vector"), key, "left")
