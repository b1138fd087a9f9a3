"""Arrays, maps, variants and timestamps as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from shelfspark.functions.text import (
    MAX_METADATA_CHARS,
    blank_to_null,
    join_pipes,
    let,
    safe_str,
    strip,
)

# Spec keys holding one of these words are not feature bullets.
NON_FEATURE_WORDS = ("dimensions", "material", "tcin", "upc", "item number", "origin")
# Fixed value: heading of the description block.
DESCRIPTION_HEADING = "Fit & style"
# Keys of the flat metadata, in order.
METADATA_KEYS = (
    "product_id",
    "title",
    "url",
    "brand",
    "price_current",
    "category_breadcrumb",
    "in_stock",
)
_STRING_MAP = "map<string,string>"


def first_of(items: Column) -> Column:
    return F.get(items, F.lit(0))


def empty_map() -> Column:
    return F.create_map().cast(_STRING_MAP)


def empty_list() -> Column:
    return F.array().cast("array<string>")


# -- variants ---------------------------------------------------------------------------------


def pick_first(doc: Column, paths: Sequence[Sequence[str]]) -> Column:
    """First path that exists, as a variant; an existing JSON null wins over later paths.

    Only objects are walked, so a digit step never reads a list.
    """
    steps = ["$" + "".join(f"['{step}']" for step in path) for path in paths]
    return F.coalesce(*[F.try_variant_get(doc, step, "variant") for step in steps])


def variant_text(v: Column) -> Column:
    """Scalar text of a variant; JSON null and SQL null are null."""
    return F.try_variant_get(v, "$", "string")


# -- arrays -----------------------------------------------------------------------------------


def distinct_non_empty(items: Column, cap: int | None = None) -> Column:
    """Drop null and empty entries, keep each once in first-seen order, keep the first ``cap``."""
    kept = F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != "")))
    return kept if cap is None else F.slice(kept, 1, cap)


def before_marker(items: Column, marker) -> Column:
    """Prefix of an ordered array up to (not including) the first entry ``marker`` accepts."""
    at = F.array_position(F.transform(items, lambda x: F.coalesce(marker(x), F.lit(False))), True)
    return F.when(at > 0, F.slice(items, F.lit(1), (at - 1).cast("int"))).otherwise(items)


def description_without_bullets(
    text: Column, highlights: Column, heading: str = DESCRIPTION_HEADING, spaced: bool = True
) -> Column:
    """Keep only the heading when the block merely repeats the highlight bullets.

    ``spaced=False`` compares with all spaces removed, which also catches blocks whose bullets
    ran together without separators.
    """

    def squeezed(c: Column) -> Column:
        return c if spaced else F.regexp_replace(c, r"\s+", "")

    def body_of(t: Column) -> Column:
        at = F.instr(t, heading)
        rest = F.concat(
            F.substring(t, F.lit(1), at - 1), F.substring(t, at + len(heading), F.length(t))
        )
        return squeezed(F.lower(strip(F.when(at > 0, rest).otherwise(t))))

    joined = squeezed(F.array_join(F.transform(highlights, lambda h: F.lower(strip(h))), " "))

    def repeats(body: Column) -> Column:
        return (F.length(body) > 15) & let(
            joined, lambda j: F.contains(body, j) | F.contains(j, body)
        )

    return let(
        text,
        lambda t: F.when(
            (F.size(highlights) > 0) & let(body_of(t), repeats), F.lit(heading)
        ).otherwise(t),
    )


# -- maps of specifications -------------------------------------------------------------------


def value_by_word(specs: Column, word: str) -> Column:
    """Value of the first key that holds ``word``, else null."""
    hits = F.filter(F.map_entries(specs), lambda e: F.contains(F.lower(e["key"]), F.lit(word)))
    return first_of(hits)["value"]


def _dimension_class(key: Column) -> Column:
    k = F.lower(key)

    def has(word: str) -> Column:
        return F.contains(k, F.lit(word))

    return (
        F.when(has("dimensions") & has("overall"), "dimensions_overall")
        .when(has("height"), "height")
        .when(has("width"), "width")
        .when(has("depth"), "depth")
        .when(has("material") | has("shell"), "material")
    )


def dimension_table(specs: Column) -> Column:
    """Dimension-like spec keys under fixed names; the last key of a class gives its value."""
    classed = F.transform(
        F.map_entries(specs),
        lambda e: F.struct(_dimension_class(e["key"]).alias("key"), e["value"].alias("value")),
    )
    return F.map_from_entries(
        F.filter(classed, lambda e: e["key"].isNotNull() & (e["key"] != "material"))
    )


def material_of(specs: Column) -> Column:
    """Last key classed as material or shell, else the first key holding ``material``, else empty."""
    classed = F.filter(
        F.map_entries(specs), lambda e: F.coalesce(_dimension_class(e["key"]) == "material", F.lit(False))
    )
    last = F.try_element_at(classed, F.lit(-1))["value"]
    return F.coalesce(blank_to_null(last), value_by_word(specs, "material"), F.lit(""))


def dimensions_from(highlights: Column, table: Column) -> Column:
    """Dimensions named in the bullets (the last of a kind wins) overlaid by the dimension table."""

    def kind(h: Column) -> Column:
        low = F.lower(h)
        return F.when(F.contains(low, F.lit("measurements")), "measurements").when(
            F.contains(low, F.lit("drop")), "handle_drop"
        )

    named = F.filter(
        F.transform(highlights, lambda h: F.struct(kind(h).alias("key"), h.alias("value"))),
        lambda e: e["key"].isNotNull(),
    )
    return F.map_concat(F.map_from_entries(named), table)


def spec_features(specs: Column) -> Column:
    """``Key: value`` for every spec whose key holds none of the excluded words."""

    def kept(e: Column) -> Column:
        low = F.lower(e["key"])
        excluded = F.lit(False)
        for word in NON_FEATURE_WORDS:
            excluded = excluded | F.contains(low, F.lit(word))
        return ~excluded

    return F.transform(
        F.filter(F.map_entries(specs), kept),
        lambda e: F.concat(strip(e["key"]), F.lit(": "), strip(e["value"])),
    )


def spec_rows_to_map(rows: Column, cap: int | None = 1000) -> Column:
    """``Key: value`` texts to a map: split at the first colon, the last of a repeated key wins.

    With ``cap`` set, empty keys, empty values and values over ``cap`` characters are dropped.
    """
    pairs = F.transform(
        F.filter(rows, lambda r: F.contains(r, F.lit(":"))),
        lambda r: F.struct(
            strip(F.substring_index(r, ":", 1)).alias("key"),
            strip(F.substring(r, F.instr(r, ":") + 1, F.length(r))).alias("value"),
        ),
    )
    if cap is not None:
        pairs = F.filter(
            pairs, lambda e: (e["key"] != "") & (e["value"] != "") & (F.length(e["value"]) <= cap)
        )
    return F.map_from_entries(pairs)


# -- records ----------------------------------------------------------------------------------


def flat_metadata(df) -> Column:
    """JSON text of the flat metadata of a product frame.

    Null and empty values are left out, numbers and booleans keep their type (0 and false stay),
    text is stripped and cut. Columns the frame lacks are simply absent.
    """
    fields = []
    types = dict(df.dtypes)
    for key in METADATA_KEYS:
        if key not in types:
            continue
        c = F.col(key)
        if types[key] == "string":
            c = F.when(c != "", F.left(safe_str(c), F.lit(MAX_METADATA_CHARS)))
        fields.append(c.alias(key))
    return F.to_json(F.struct(*fields))


def list_to_text(items: Column) -> Column:
    return join_pipes(items)


def text_to_list(c: Column) -> Column:
    """Inverse of ``list_to_text``; empty entries carry nothing and are dropped."""
    return F.filter(F.split(c, "[|]"), lambda x: x != "")


def map_to_text(m: Column) -> Column:
    """Map as JSON text, ``{}`` for null."""
    return F.coalesce(F.to_json(m), F.lit("{}"))


def text_to_map(c: Column) -> Column:
    return F.from_json(c, _STRING_MAP)


# -- time -------------------------------------------------------------------------------------


def iso_to_time(c: Column) -> Column:
    """ISO-8601 text without a zone to a time without a zone; anything else is null."""
    return F.when(
        c.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$"),
        c.try_cast("timestamp_ntz"),
    )


def time_to_iso(c: Column) -> Column:
    """ISO-8601 text, a fraction only where there is one; null without a time."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(c, "SSSSSS")
    return F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))


def run_label(c: Column) -> Column:
    """Label of a run: ``YYYYmmdd_HHMMSS``."""
    return F.date_format(c, "yyyyMMdd_HHmmss")


