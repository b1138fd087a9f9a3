"""Literal cases of the text, price and number rules."""

import random
from urllib.parse import parse_qs, urlencode, urljoin, urlsplit, urlunsplit

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import pricing as P
from shelfspark.functions import text as T


def lit(v):
    return F.lit(v).cast("string") if v is None else F.lit(v)


@pytest.mark.parametrize(
    "url, adv, cmp, strict",
    [
        ("/p/x/-/A-123?preselect=9#l", "123", "123", "123"),
        ("/p/x/A-7", "7", "7", None),
        ("/A-", "", "N/A", None),
        ("/A-12x", "12", "12", None),
        ("", "", "N/A", None),
    ],
)
def test_product_id(one, url, adv, cmp, strict):
    u = lit(url)
    got = one(
        T.product_id_from_url(u), T.product_id_from_url(u, "N/A"), T.product_id_from_url(u, None, strict=True)
    )
    assert got == (adv, cmp, strict)


@pytest.mark.parametrize(
    "text, adv, cmp, sim",
    [
        ("$1,299.50", 1299.5, 1299.5, 1299.5),
        ("$10.00 - $20.00", 10.0, 10.0, 10.0),
        (".5 off", 0.5, 0.5, 5.0),
        ("Inc. $5", 0.0, None, 5.0),
        ("1.2.3", 0.0, None, 1.2),
        ("", 0.0, None, None),
        (None, 0.0, None, None),
    ],
)
def test_prices(one, text, adv, cmp, sim):
    t = lit(text)
    assert one(P.price_adv(t), P.price_cmp(t), P.price_sim(t)) == (adv, cmp, sim)


def test_dollar_text(one):
    assert one(
        P.first_dollar_text(lit("was $1,299.00")), P.first_dollar_text(lit("$12.345")), P.first_dollar_text(lit("5"))
    ) == ("$1", "$12.34", None)
    assert one(P.comparison_price(lit("reg $1,050.00")), P.comparison_price(lit("reg 10"))) == (1050.0, 0.0)


def test_numbers(one):
    assert one(P.first_int(lit("(53)")), P.first_int(lit("1,234")), P.first_int(lit("none"))) == (53, 1, None)
    assert one(P.to_int(lit("12")), P.to_int(lit("12 reviews"))) == (12, None)
    assert one(P.to_float(lit("4.5")), P.to_float(lit("5f")), P.to_float(lit("n/a"))) == (4.5, None, None)


def test_one_decimal_rounding_is_exact(spark):
    random.seed(3)
    values = [0.25, 0.35, 0.45, 0.75, 2.675, 0.0, 99.95, 100.0, 33.25, 1e-9]
    values += [random.random() * 100 for _ in range(2000)]
    values += [(2 * random.randrange(1000) + 1) / 20 for _ in range(500)]
    values += [(a - b) / a * 100 for a, b in [(random.randrange(1, 9999) / 100, 0.0) for _ in range(200)]]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = [(r.v, r.r) for r in df.select("v", P.round_one_place(F.col("v")).alias("r")).collect()]
    assert [(v, r) for v, r in got if r != round(v, 1)] == []


def test_discounts(one):
    d = one(P.discount_adv(F.lit(7.5), F.lit(10.0)), P.discount_rounded(F.lit(0.0), F.lit(10.0)))
    assert d[0] == (2.5, 25) and d[1] == (0.0, 0.0)


def cut(text, limit=500):
    return (text[:limit].rsplit(" ", 1)[0] or text[:limit]) if len(text) > limit else text


@pytest.mark.parametrize(
    "text",
    ["a " * 250, "a " * 250 + "b", "x" * 501, " " + "x" * 500, "é" * 499 + "😀 tail", "😀" * 500 + " y", "", "ab " * 400],
)
def test_cut_at_word(one, text):
    assert one(T.cut_at_word(F.lit(text))) == (cut(text),)


def test_strip_is_unicode(one):
    text = " \x1c　a b \n\x85"
    assert one(T.strip(F.lit(text))) == (text.strip(),)


def test_document_text(one):
    none = lit(None)
    assert one(T.document_text(lit(" Bag "), lit(""), none, lit("Silk"), lit("a|b"), lit("||"))) == ("Bag Silk a b",)
    assert one(T.document_text(none, lit(""), lit("  "), none, none, none)) == ("",)


@pytest.mark.parametrize(
    "href",
    ["/a/b", "a?x=1", "//h/x", "http://o/p", "?q=1", "#f", "", "../up", "/a/../b?c=/../d", "./s/./t/", "..", " /pad", "mailto:x"],
)
def test_resolve_url(one, href):
    base = "https://shop.example/c/cat/page"
    assert one(T.resolve_url(F.lit(href), base)) == (urljoin(base, href),)


@pytest.mark.parametrize(
    "url",
    [
        "https://s.e/c?x=1&Nao=24&y=&x=2&flag#f",
        "https://s.e/c?a=b%20c&d=e+f&g=*~%2F",
        "https://s.e/c?bad=%zz&Nao=0&Nao=1",
        "https://s.e/c?",
        "https://s.e/c?only=",
    ],
)
def test_query_param(one, url):
    parts = urlsplit(url)
    params = parse_qs(parts.query)
    params["Nao"] = ["48"]
    want = urlunsplit(parts._replace(query=urlencode(params, doseq=True)))
    assert one(T.set_query_param(F.lit(url), "Nao", F.lit(48))) == (want,)


def test_query_param_without_query(one):
    assert one(T.set_query_param(F.lit("https://s.e/c"), "Nao", F.lit(24))) == ("https://s.e/c?Nao=24",)


def test_first_image(one):
    got = one(*[T.first_image_url(lit(v)) for v in (" https://a/1.jpg |x", "/rel|https://b", "", None)])
    assert got == ("https://a/1.jpg", None, None, None)


def test_selected_color(one):
    colors = F.array(F.lit("Navy"), F.lit(""), F.lit("RED"))
    assert one(
        T.selected_color(F.lit("https://s/p/red/navy/-/A-1"), colors), T.selected_color(F.lit("https://s/p/x"), colors)
    ) == ("red", "")
