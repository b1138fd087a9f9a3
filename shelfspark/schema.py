"""The canonical product schema and the mapping of the other record forms onto it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DoubleType,
    IntegerType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

from shelfspark.functions.nested import text_to_list
from shelfspark.functions.text import blank_to_null, strip

# The file schema, with nested fields as text. The seven marked columns came later.
_FILE_COLUMNS = """
product_id string, title string, url string, brand string,
price_current double, price_regular double, sale_price double,
discount_percent int, discount_amount double, rating double, rating_count int,
bought_last_month string, colors string, color_selected string, category_breadcrumb string,
description string, material_text string, highlights string, feature_bullets string,
images string, dimensions string, dimensions_table string, specifications string,
is_sale boolean, is_clearance boolean, is_new boolean, best_seller boolean,
seller string, fulfillment_info string, in_stock boolean, scraped_at string
"""
LATER_COLUMNS = (
    "sale_price",
    "category_breadcrumb",
    "material_text",
    "feature_bullets",
    "dimensions_table",
    "specifications",
    "best_seller",
)
LIST_COLUMNS = ("colors", "highlights", "feature_bullets", "images")
MAP_COLUMNS = ("dimensions", "dimensions_table", "specifications")

_TYPES: dict[str, DataType] = {
    "string": StringType(),
    "double": DoubleType(),
    "int": IntegerType(),
    "boolean": BooleanType(),
}
FILE_SCHEMA = StructType(
    [
        StructField(name, _TYPES[kind])
        for name, kind in (column.split() for column in _FILE_COLUMNS.split(","))
    ]
)
EARLY_FILE_SCHEMA = StructType([f for f in FILE_SCHEMA if f.name not in LATER_COLUMNS])


def _typed(field: StructField) -> StructField:
    if field.name in LIST_COLUMNS:
        return StructField(field.name, ArrayType(StringType()))
    if field.name in MAP_COLUMNS:
        return StructField(field.name, MapType(StringType(), StringType()))
    if field.name == "scraped_at":
        return StructField(field.name, TimestampNTZType())
    return field


CATALOG_SCHEMA = StructType([_typed(f) for f in FILE_SCHEMA])

# Names the other record forms use for canonical columns.
RENAMES = {
    "product_name": "title",
    "product_url": "url",
    "current_price": "price_current",
    "price": "price_current",
    "regular_price": "price_regular",
    "review_count": "rating_count",
    "rating_avg": "rating",
    "all_images": "images",
    "image_url": "images",
    "tcin": "product_id",
}
SENTINEL = "N/A"


def unify_null(c: Column) -> Column:
    """Text conventions for "nothing" (``N/A``, empty, blank) to null."""
    text = strip(c)
    return F.nullif(blank_to_null(text), F.lit(SENTINEL))


def to_canonical(df: DataFrame) -> DataFrame:
    """Rename and retype any record form to the canonical columns; absent ones are null.

    A canonical name already present wins over a renamed one, and ``all_images`` over
    ``image_url``. Price text becomes a number by its first digits.
    """
    have = {name: kind for name, kind in df.dtypes}
    source: dict[str, str] = {name: name for name in have if name in CATALOG_SCHEMA.names}
    for old, new in RENAMES.items():
        if old in have and new not in source:
            source[new] = old

    def typed(field) -> Column:
        if field.name not in source:
            return F.lit(None).cast(field.dataType).alias(field.name)
        name = source[field.name]
        c = F.col(name)
        if have[name] == "string":
            c = unify_null(c)
            if field.name in LIST_COLUMNS:
                c = text_to_list(c)
            elif field.name in MAP_COLUMNS:
                c = F.from_json(c, "map<string,string>")
            elif field.name == "price_current":
                c = F.regexp_replace(c, r"[$,]", "").try_cast("double")
            elif field.dataType.simpleString() != "string":
                c = c.try_cast(field.dataType)
        else:
            c = c.cast(field.dataType)
        return c.alias(field.name)

    return df.select(*[typed(f) for f in CATALOG_SCHEMA])
