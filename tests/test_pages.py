"""The page tree and the records read from it."""

from html.parser import HTMLParser

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from shelfspark import site as S
from shelfspark.functions import markup as M
from shelfspark.operators import pages as H
from shelfspark.operators.page_tree import _VOID, flatten, page_nodes
from shelfspark.plans.catalog import build_catalog, build_catalog_http
from shelfspark.site import SiteProfile

SHOP = SiteProfile()


class Events(HTMLParser):
    """Brute force: the same nodes from the standard parser's events."""

    def __init__(self, html):
        super().__init__()
        self.out, self.stack = [], []
        self.feed(html)
        self.close()
        while self.stack:
            self.pop()

    def pop(self):
        self.stack.pop()[1] = len(self.out) - 1

    def add(self, tag, attrs=None, text=None):
        self.out.append([len(self.out), len(self.out), len(self.stack), tag, attrs, text])
        return self.out[-1]

    def handle_starttag(self, tag, attrs):
        node = self.add(tag, list({k: v or "" for k, v in attrs}.items()))
        if tag not in _VOID:
            self.stack.append(node)

    def handle_endtag(self, tag):
        if any(n[3] == tag for n in self.stack):
            while self.stack[-1][3] != tag:
                self.pop()
            self.pop()

    def handle_data(self, data):
        last = self.out[-1] if self.out else None
        if last and last[3] == "#text" and last[2] == len(self.stack):
            last[5] += data
        else:
            self.add("#text", None, data)


piece = st.sampled_from(
    ["<div>", "</div>", "<p class='a b'>", "</p>", "<br>", "<img src=x>", "text ", "&amp;", "<b a=\"1>2\">", "</b>", "<i/>", "é", "\n"]
)


@settings(max_examples=300, deadline=None)
@given(st.lists(piece, max_size=25))
def test_flatten_matches_standard_parser(parts):
    html = ""
    for part in parts:  # a stray end tag between texts splits them here and not there
        html += part
    mine = [n[:6] for n in flatten(html)]
    theirs = Events(html).out
    join = lambda nodes: [(n[3], n[2], n[4]) for n in nodes if n[5] is None]
    assert join(mine) == join(theirs)
    text = lambda nodes: "".join(n[5] or "" for n in nodes)
    assert text(mine) == text(theirs)


def test_flatten_odd_markup():
    assert [n[3] for n in flatten("a < b <c")] == ["#text"]
    assert flatten("<a href=/x/>t</a>")[0][4] == [("href", "/x/")]
    assert [n[3] for n in flatten('<script>if(a<b){"</p>"}</script>z')] == ["script", "#raw", "#text"]
    assert flatten("") == []
    deep = flatten("<div>" * 3000 + "x")
    assert len(deep) == 3001 and deep[0][1] == 3000


CARD = (
    '<div data-test="{wrap}" data-focusid="{i}_product_card"><a data-test="{title}" href="/p/bag/-/A-{i}">Bag {i}</a>'
    '<span data-test="current-price">$10.00</span><span data-test="comparison-price">reg $20.00</span></div>'
)


def listing(n, first=0):
    cards = "".join(CARD.format(wrap=S.CARD_WRAPPER, title=S.CARD_TITLE, i=i) for i in range(first, first + n))
    return f"<html><body>{cards}</body></html>"


def test_catalog_from_pages(spark):
    pages = spark.createDataFrame([(1, listing(3)), (2, listing(2, 10)), (3, "<p>nothing")], "page_id long, html string")
    detail = spark.createDataFrame(
        [("https://shop.example/p/bag/-/A-1", '<span data-test="product-price">$7</span>', 1)] * 2,
        "url string, html string, page_id long",
    )
    full = build_catalog(pages, detail, SHOP).orderBy("page_id", "block").collect()
    assert [(r.product_id, r.price_current, r.discount_percent) for r in full] == [
        ("0", 10.0, 50), ("1", 7.0, 50), ("2", 10.0, 50), ("10", 10.0, 50), ("11", 10.0, 50),
    ]
    assert build_catalog(pages, None, SHOP, max_products=4).count() == 4
    assert build_catalog(pages, None, SHOP, max_products=0).count() == 5
    assert build_catalog_http(pages, None, SHOP, max_products=0).count() == 0
    assert build_catalog_http(pages, None, SHOP, variant="sim").count() == 5


def test_listing_only_plans_no_join(spark):
    pages = spark.createDataFrame([(1, listing(1))], "page_id long, html string")
    plan = build_catalog(pages, None, SHOP)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    detail = spark.createDataFrame([("u", "<p>")], "url string, html string")
    plan = build_catalog(pages, detail, SHOP)._jdf.queryExecution().optimizedPlan().toString()
    # each page set is read once: the listing's pages when its records were written, before this plan
    assert plan.count("MapInArrow") == 1


def test_card_without_link_or_title_is_dropped(spark):
    html = (
        f'<div data-test="{S.CARD_WRAPPER}"><a href="/c/x">No</a></div>'
        f'<div data-test="{S.CARD_WRAPPER}"><a href="/p/x/-/A-5"></a></div>'
    )
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert H.card_records(H.listing_cards(pages, ["page_id"]), SHOP, ["page_id"]).count() == 0


def nodes_of(spark, html):
    return page_nodes(spark.createDataFrame([(1, html)], "id long, html string"), ["id"])


def test_rating_without_box_has_no_range_check(spark):
    html = '<span aria-hidden="true">7.5</span><span class="x styles_ratingCount__QDWQY">(12)</span>'
    assert nodes_of(spark, html).select(H.rating_adv(F.col("nodes")).alias("r")).first().r == (7.5, 12)


def test_only_string(spark):
    html = "<span><b>Out of Stock</b></span><span>Out of <b>Stock</b></span><span></span>"
    n = F.col("nodes")
    got = nodes_of(spark, html).select(
        F.transform(M.find_all(n, M.tagged("span")), lambda e: M.only_string(n, e)).alias("s")
    )
    assert got.first().s == ["Out of Stock", None, None]


def test_spec_box_stops_at_disclaimer_and_keeps_last_key(spark):
    html = (
        f'<div data-test="{S.SPEC_BOX}"><div><b>A:</b> 1: x</div><div><b>A</b>: 2</div><div><b>B::</b>{"y" * 1001}</div>'
        f'<div data-test="{S.SPEC_DISCLAIMER}"></div><div><b>C:</b> 3</div></div>'
    )
    assert nodes_of(spark, html).select(H.specifications(F.col("nodes")).alias("m")).first().m == {"A": "2"}


def test_gallery_caps(spark):
    imgs = "".join(f'<img src="https://images.shop.example/{i // 2}.jpg?x={i}">' for i in range(40))
    html = f'<section aria-label="Image gallery">{imgs}</section>'
    n = F.col("nodes")
    got = nodes_of(spark, html).select(
        F.size(H.gallery_images(n, SHOP.image_host)), F.size(H.gallery_images_cmp(n, SHOP.image_host))
    ).first()
    assert tuple(got) == (15, 10)


def test_many_cards_per_page_and_long_pages(spark):
    pages = spark.createDataFrame([(1, listing(500)), (2, "<p>" + "x " * 2_000_000 + "</p>" + listing(2))], "page_id long, html string")
    counts = H.listing_cards(pages, ["page_id"]).groupBy("page_id").count().collect()
    assert {r.page_id: r["count"] for r in counts} == {1: 500, 2: 2}


def test_links_survive_scripts_and_quotes(spark):
    html = "<script>'<a href=\"/no\">'</script><!-- <a href='/no2'> --><a class=x href='/p/a'>1</a><a href=/p/b?x=1&amp;y=2#f>2</a><a data-href='/no3'>"
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    rows = H.product_links(pages, ["page_id"], SHOP.base).orderBy("pos").collect()
    assert [r.url for r in rows] == ["https://shop.example/p/a", "https://shop.example/p/b?x=1&y=2"]


def test_a_huge_total_is_spread_over_tasks(spark):
    rows = [(1, "https://s/c", "Page 1 of 300001"), (2, "https://s/d", "Page 2 of 3"), (3, "https://s/e", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, position_text string").coalesce(1)
    found = H.page_frontier(pages, ["page_id"])
    assert found.count() == 300_000 + 1
    assert found.select("page_id", "page").distinct().count() == 300_001
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 200_000
    large = {r["page_id"]: (r["pages"], r["large"]) for r in H.large_totals(pages, ["page_id"]).collect()}
    assert large == {1: (300_001, True), 2: (3, False), 3: (None, None)}
