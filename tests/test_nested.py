"""Literal cases of the array, map, variant, metadata and time rules."""

import json

import pytest
from pyspark.sql import functions as F

from shelfspark import schema
from shelfspark.functions import nested as N


def arr(*items):
    return F.array(*[F.lit(i) for i in items]).cast("array<string>")


@pytest.mark.parametrize(
    "doc, want",
    [
        ('{"a":{"b":1}}', "1"),
        ('{"a":{"b":null},"c":2}', "null"),
        ('{"a":[{"b":1}],"c":2}', "2"),
        ('{"a":{"0":{"b":5}}}', None),
        ("{}", None),
        ("{bad", None),
    ],
)
def test_pick_first(one, doc, want):
    v = N.pick_first(F.try_parse_json(F.lit(doc)), [["a", "b"], ["c"]])
    got = one(F.when(F.is_variant_null(v), "null").otherwise(N.variant_text(v)))
    assert got == (want,)


def test_digit_step_reads_objects_only(one):
    path = [["a", "0", "b"]]
    obj = N.pick_first(F.try_parse_json(F.lit('{"a":{"0":{"b":5}}}')), path)
    lst = N.pick_first(F.try_parse_json(F.lit('{"a":[{"b":5}]}')), path)
    assert one(N.variant_text(obj), N.variant_text(lst)) == ("5", None)


def test_specs(one):
    rows = arr("A: 1", "b", " : x", "C:", "A: 2:3", "D: " + "x" * 1001)
    m = N.spec_rows_to_map(rows)
    assert one(m) == ({"A": "2:3"},)
    assert one(F.map_keys(N.spec_rows_to_map(arr("A: 1", "B: 2", "A: 3"), cap=None))) == (["A", "B"],)


def test_dimension_classes(one):
    m = N.spec_rows_to_map(arr("Overall Dimensions: 1", "Height: 2", "Max height: 3", "Shell Height: 4", "Shell: wool"))
    assert one(N.dimension_table(m), N.material_of(m)) == ({"dimensions_overall": "1", "height": "4"}, "wool")
    only = N.spec_rows_to_map(arr("Material Width: w"))
    assert one(N.material_of(only), N.material_of(N.empty_map())) == ("w", "")


def test_dimensions_overlay(one):
    table = F.create_map(F.lit("measurements"), F.lit("t"))
    assert one(N.dimensions_from(arr("Measurements a", "strap Drop b", "drop c"), table)) == (
        {"measurements": "t", "handle_drop": "drop c"},
    )


def test_before_marker(one):
    stop = lambda x: x == "s"
    assert one(N.before_marker(arr("a", "b", "s", "c"), stop), N.before_marker(arr("a"), stop)) == (["a", "b"], ["a"])
    assert one(N.before_marker(arr("s", "a"), stop)) == ([],)


@pytest.mark.parametrize(
    "text, highlights, spaced, want",
    [
        ("Fit & styleRoomy enough for all Soft", ["Roomy enough for all", "Soft"], True, "Fit & style"),
        ("Fit & styleRoomy enough for allSoft", ["Roomy enough for all", "Soft"], True, None),
        ("Fit & styleRoomy enough for allSoft", ["Roomy enough for all", "Soft"], False, "Fit & style"),
        ("Fit & styleSoft", ["Soft"], True, None),
        ("Fit & styleanything at all", [], True, None),
    ],
)
def test_description(one, text, highlights, spaced, want):
    got = one(N.description_without_bullets(F.lit(text), arr(*highlights), spaced=spaced))
    assert got == (want or text,)


def test_metadata(spark):
    rows = [
        ("1", "  ", "u" * 600, "", 0.0, None, False),
        (None, "", None, " B ", None, "x", True),
    ]
    df = spark.createDataFrame(
        rows,
        "product_id string, title string, url string, brand string, price_current double, "
        "category_breadcrumb string, in_stock boolean",
    )
    got = [json.loads(r[0]) for r in df.select(N.flat_metadata(df)).collect()]
    assert got[0] == {"product_id": "1", "title": "", "url": "u" * 500, "price_current": 0.0, "in_stock": False}
    assert got[1] == {"brand": "B", "category_breadcrumb": "x", "in_stock": True}


def test_time(one):
    t = N.iso_to_time(F.lit("2026-02-20T14:30:45.123456"))
    assert one(N.time_to_iso(t), N.run_label(t)) == ("2026-02-20T14:30:45.123456", "20260220_143045")
    assert one(N.iso_to_time(F.lit("20/02/2026")), N.iso_to_time(F.lit("2026-13-01"))) == (None, None)


def test_canonical_names(spark):
    sim = spark.createDataFrame(
        [("1", "Bag", "u", 5.0, None, 10.0, "N/A", "img")],
        "product_id string, title string, url string, current_price double, regular_price double, "
        "discount_percent double, colors string, image_url string",
    )
    row = schema.to_canonical(sim).first()
    assert (row.price_current, row.price_regular, row.discount_percent, row.colors, row.images) == (5.0, None, 10, None, ["img"])
    assert len(row) == 31
