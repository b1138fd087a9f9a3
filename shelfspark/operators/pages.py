"""Records out of page nodes: listing cards and detail pages, both reader variants.

Every function takes a frame with a ``nodes`` column (``page_tree.page_nodes``) and returns
columns or a frame; no Python runs here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfspark import site as S
from shelfspark.functions import markup as M
from shelfspark.functions import nested as N
from shelfspark.functions import pricing as P
from shelfspark.functions import text as T
from shelfspark.functions.text import let
from shelfspark.operators.page_tree import page_nodes
from shelfspark.site import SiteProfile


# -- pieces -----------------------------------------------------------------------------------


def breadcrumb(nodes: Column, missing: str = "") -> Column:
    """Link texts of the breadcrumb container joined by `` > ``; three container fallbacks."""
    nav_test = M.tagged("nav", "aria-label", S.BREADCRUMB_LABEL)
    module = M.find(nodes, M.tagged("div", "data-module-type", S.BREADCRUMB_MODULE))
    labelled = let(
        module,
        lambda m: F.when(m.isNull(), M.find(nodes, nav_test)).otherwise(
            M.find(M.within(nodes, m), nav_test)
        ),
    )
    nav = F.coalesce(labelled, M.find(nodes, M.tagged("nav", "data-test", S.BREADCRUMB_NAV)))

    def joined(inside: Column) -> Column:
        marked = M.find_all(inside, M.tagged("a", "data-test", S.BREADCRUMB_LINK))
        links = F.when(F.size(marked) > 0, marked).otherwise(M.find_all(inside, M.tagged("a")))
        return F.array_join(F.filter(M.texts_of(nodes, links), lambda t: t != ""), " > ")

    path = let(let(nav, lambda n: M.within(nodes, n)), joined)
    return F.coalesce(T.blank_to_null(path), F.lit(missing))


def highlight_bullets(nodes: Column, section_id: str = S.HIGHLIGHTS_ID) -> Column:
    """Non-empty ``li`` texts of one section."""
    section = M.find(nodes, M.tagged("div", "id", section_id))
    items = let(
        let(section, lambda s: M.within(nodes, s)),
        lambda inside: F.filter(
            M.texts_of(nodes, M.find_all(inside, M.tagged("li"))), lambda t: t != ""
        ),
    )
    return F.coalesce(items, N.empty_list())


def _image_sources(inside: Column, image_host: str) -> Column:
    return F.filter(
        F.transform(M.find_all(inside, M.tagged("img", "src")), lambda n: M.attr(n, "src")),
        lambda s: F.contains(s, F.lit(image_host)),
    )


def gallery_images(nodes: Column, image_host: str, cap: int = S.IMAGE_CAP_ADV) -> Column:
    """Image-host sources of the gallery, ordered distinct, capped; gallery items as fallback."""
    gallery = M.find(nodes, M.tagged("section", "aria-label", S.GALLERY_LABEL))
    from_gallery = let(
        let(gallery, lambda g: M.within(nodes, g)), lambda i: _image_sources(i, image_host)
    )
    items = M.find_all(nodes, f"n.attrs['data-test'] rlike '{S.GALLERY_ITEM}'")
    first_image = F.transform(
        items, lambda e: M.find(M.within(nodes, e), M.tagged("img", "src"))
    )
    from_items = F.filter(
        F.transform(first_image, lambda n: M.attr(n, "src")),
        lambda s: s.isNotNull() & F.contains(s, F.lit(image_host)),
    )
    found = F.when(F.coalesce(F.size(from_gallery), F.lit(0)) > 0, from_gallery).otherwise(from_items)
    return F.slice(F.array_distinct(found), 1, cap)


def gallery_images_cmp(nodes: Column, image_host: str, cap: int = S.IMAGE_CAP_CMP) -> Column:
    """Gallery sources without their query, ordered distinct, capped."""
    gallery = M.find(nodes, M.tagged("section", "aria-label", S.GALLERY_LABEL))
    sources = let(
        let(gallery, lambda g: M.within(nodes, g)), lambda i: _image_sources(i, image_host)
    )
    bare = F.filter(F.transform(sources, T.drop_query), lambda u: u != "")
    return F.coalesce(F.slice(F.array_distinct(bare), 1, cap), N.empty_list())


def _spec_row(nodes: Column, block: Column) -> Column:
    """struct(key, value) of a row with a bold key, or null where the row rules fail."""

    def parts(key: Column, full: Column) -> Column:
        value = T.strip(F.substring(full, F.instr(full, ":") + 1, F.length(full)))
        ok = (key != "") & F.contains(full, F.lit(":")) & (value != "") & (F.length(value) <= 1000)
        return F.when(ok, F.struct(key.alias("key"), value.alias("value")))

    key = T.strip(F.rtrim(M.find_text(M.within(nodes, block), M.tagged("b")), F.lit(":")))
    return let(M.text_of(nodes, block, " "), lambda full: let(key, lambda k: parts(k, full)))


def _rows_to_map(nodes: Column, rows: Column) -> Column:
    kept = N.before_marker(rows, lambda n: M.attr(n, "data-test") == S.SPEC_DISCLAIMER)
    pairs = F.transform(kept, lambda n: _spec_row(nodes, n))
    return F.map_from_entries(F.filter(pairs, lambda p: p.isNotNull()))


def shortest_spec_block(nodes: Column) -> Column:
    """Of all blocks with a spec marker and two bold tags, the one with the shortest text."""
    divs = M.find_all(nodes, M.tagged("div"))

    def scored(n: Column) -> Column:
        inside = M.within(nodes, n)

        def score(body: Column) -> Column:
            marked = F.lit(False)
            for marker in S.SPEC_MARKERS:
                marked = marked | F.contains(body, F.lit(marker))
            bold = F.size(M.find_all(inside, M.tagged("b"))) >= 2
            return F.when(marked & bold, F.struct(F.length(body).alias("size"), n.alias("node")))

        return let(M.raw_text(inside), score)

    best = F.filter(F.transform(divs, scored), lambda s: s.isNotNull())
    # maps cannot be ordered, so pick by (size, pos) and look the node up again
    first = F.array_min(
        F.transform(best, lambda s: F.struct(s["size"].alias("size"), s["node"]["pos"].alias("pos")))
    )
    return let(first, lambda f: M.find(nodes, lambda n: n["pos"] == f["pos"]))


def specifications(nodes: Column) -> Column:
    """Spec section to a map: direct rows up to the disclaimer, nested rows if those gave nothing."""
    box = F.coalesce(
        M.find(nodes, M.tagged("div", "data-test", S.SPEC_BOX)), shortest_spec_block(nodes)
    )

    def rows(b: Column) -> Column:
        divs = M.find_all(M.within(nodes, b), M.tagged("div"))
        direct = F.filter(divs, lambda n: n["depth"] == b["depth"] + 1)
        return let(
            _rows_to_map(nodes, direct),
            lambda m: F.when(F.size(m) > 0, m).otherwise(_rows_to_map(nodes, divs)),
        )

    return F.coalesce(let(box, rows), N.empty_map())


def specifications_cmp(nodes: Column) -> Column:
    """Spec section, HTTP form: any inner block text with a colon splits at the first one."""
    button = M.find(nodes, M.tagged("button", "data-test", pattern=S.SPEC_SECTION))
    content = let(
        button,
        lambda b: M.find(M.after(nodes, b), M.tagged("div", "data-test", S.SPEC_CONTENT)),
    )
    rows = let(
        let(content, lambda c: M.within(nodes, c)),
        lambda inside: M.texts_of(nodes, M.find_all(inside, M.tagged("div"))),
    )
    return F.coalesce(N.spec_rows_to_map(rows, cap=None), N.empty_map())


def rating_adv(nodes: Column) -> Column:
    """struct(rating, count) of a card: first span number in 0..5 inside the rating box.

    Without a box the first hidden span counts, with no range check.
    """
    hidden = M.tagged("span", "aria-hidden", "true")
    counted = M.classed("span", S.RATING_COUNT_CLASS)
    labelled = M.tagged("span", "aria-label", pattern=r"(?i)\d+\s+ratings?")
    box = M.find(nodes, M.classed("div", S.RATING_BOX_CLASS))

    def in_box(inside: Column) -> Column:
        values = F.transform(
            M.texts_of(nodes, M.find_all(inside, hidden)), lambda t: P.to_float(t)
        )
        rating = N.first_of(F.filter(values, lambda v: v.isNotNull() & v.between(0, 5)))
        count = let(
            F.coalesce(M.find(inside, counted), M.find(inside, labelled)),
            lambda n: P.first_int(M.text_of(nodes, n)),
        )
        return F.struct(
            F.coalesce(rating, F.lit(0.0)).alias("rating"),
            F.coalesce(count, F.lit(0)).alias("count"),
        )

    loose = F.struct(
        F.coalesce(P.to_float(M.find_text(nodes, hidden)), F.lit(0.0)).alias("rating"),
        F.coalesce(P.first_int(M.find_text(nodes, counted)), F.lit(0)).alias("count"),
    )
    return let(
        box, lambda b: F.when(b.isNull(), loose).otherwise(let(M.within(nodes, b), in_box))
    )


def rating_from_label(nodes: Column) -> Column:
    """struct(rating, count) of a card label ``N ratings``: the first number is taken as rating."""
    label = let(
        M.find(nodes, M.tagged("span", "aria-label", pattern=r"\d+ ratings")),
        lambda n: M.attr(n, "aria-label"),
    )
    return let(
        label,
        lambda t: F.struct(
            F.coalesce(P.first_float(t), F.lit(0.0)).alias("rating"),
            F.coalesce(
                F.regexp_extract(t, r"(?i)(\d+)\s*ratings?", 1).try_cast("int"), F.lit(0)
            ).alias("count"),
        ),
    )


def rating_detail_cmp(nodes: Column) -> Column:
    """struct(rating, count) of ``X out of 5 stars`` and the whole-number text of the next span."""
    span = M.find(nodes, M.tagged("span", "aria-label", pattern=r"\d+ out of 5 stars"))
    return let(
        span,
        lambda n: F.struct(
            F.coalesce(
                F.regexp_extract(M.attr(n, "aria-label"), r"([\d.]+) out of 5", 1).try_cast("double"),
                F.lit(0.0),
            ).alias("rating"),
            F.coalesce(
                P.to_int(M.find_text(M.after(nodes, n), M.tagged("span"))), F.lit(0)
            ).alias("count"),
        ),
    )


def card_image(nodes: Column) -> Column:
    """Primary picture: its ``img`` at the fixed size, else the first ``srcset`` candidate."""
    picture = M.find(nodes, M.tagged("picture", "data-test", S.CARD_PICTURE))

    def url(inside: Column) -> Column:
        src = let(M.find(inside, M.tagged("img", "src")), lambda n: M.attr(n, "src"))
        srcset = let(M.find(inside, M.tagged("source", "srcset")), lambda n: M.attr(n, "srcset"))
        return F.coalesce(
            T.sized_image(T.blank_to_null(src)), T.blank_to_null(T.srcset_first(srcset))
        )

    return let(let(picture, lambda p: M.within(nodes, p)), url)


def swatch_colors(nodes: Column) -> Column:
    """Colours of the swatch label, split on commas."""
    label = let(
        M.find(nodes, M.tagged("span", "data-test", S.CARD_SWATCHES)),
        lambda n: T.blank_to_null(M.attr(n, "aria-label")),
    )
    return F.coalesce(T.split_trim(label), N.empty_list())


def button_colors(nodes: Column) -> Column:
    """Colours of the swatch buttons' titles."""
    titles = F.transform(
        M.find_all(nodes, M.tagged("button", "title", pattern="Color")),
        lambda n: T.strip(F.replace(M.attr(n, "title"), F.lit("Color: "), F.lit(""))),
    )
    return F.filter(titles, lambda t: t != "")


def variant_colors(nodes: Column) -> Column:
    """``Color, X, ...`` link labels to X, ordered distinct."""
    section = M.find(nodes, M.tagged("div", "data-test", pattern=S.VARIATION))

    def names(inside: Column) -> Column:
        labels = F.filter(
            F.transform(M.find_all(inside, M.tagged("a")), lambda n: M.attr(n, "aria-label")),
            lambda t: F.contains(t, F.lit("Color")),
        )
        return N.distinct_non_empty(
            F.transform(
                labels,
                lambda t: T.strip(
                    F.substring_index(F.replace(t, F.lit("Color, "), F.lit("")), ",", 1)
                ),
            )
        )

    return F.coalesce(let(let(section, lambda s: M.within(nodes, s)), names), N.empty_list())


def chip_colors(nodes: Column) -> Column:
    """Texts of the colour chips; an unlabelled chip gives an empty string."""
    carousel = M.find(nodes, M.classed("div", S.CAROUSEL_CLASS))
    texts = let(
        let(carousel, lambda c: M.within(nodes, c)),
        lambda inside: M.texts_of(
            nodes,
            M.find_all(inside, M.classed("a", S.CHIP_CLASS)),
        ),
    )
    return F.coalesce(texts, N.empty_list())


def visible_text(nodes: Column) -> Column:
    """All page text, pieces stripped and joined by a space."""
    return M.text(nodes, " ")


def fit_and_style(nodes: Column, highlights: Column) -> Column:
    """Text of the block under the description heading, without a mere copy of the bullets."""
    heading = M.find_all(nodes, M.tagged("h2"))
    first = N.first_of(
        F.filter(
            heading,
            lambda n: F.coalesce(
                F.contains(M.only_string(nodes, n), F.lit(N.DESCRIPTION_HEADING)), F.lit(False)
            ),
        )
    )
    body = let(
        let(first, lambda n: M.parent(nodes, n)),
        lambda p: F.left(M.text_of(nodes, p), F.lit(T.MAX_DOCUMENT_CHARS)),
    )
    return F.coalesce(N.description_without_bullets(body, highlights), F.lit(""))


# -- records ----------------------------------------------------------------------------------


def listing_cards(pages: DataFrame, keys: list[str], variant: str = "adv") -> DataFrame:
    """Listing pages to one row per card (keys, block, source, nodes), 0..n per page."""
    root = (
        (None, "data-focusid", S.CARD_FOCUS)
        if variant == "sim"
        else ("div", "data-test", f"^{S.CARD_WRAPPER}$")
    )
    return page_nodes(pages, keys, root=root, keep_source=True)


def title_link(nodes: Column) -> Column:
    return F.coalesce(
        M.find(nodes, M.tagged("a", "data-test", S.CARD_TITLE)),
        M.find(nodes, "n.tag = 'a' and contains(n.attrs['href'], '/p/') and contains(n.attrs['href'], '/A-')"),
        M.find(nodes, M.tagged("a", "href", pattern=r"/p/.*/A-\d+")),
        M.find(nodes, M.tagged("a", "href", pattern=r"/A-\d+")),
    )


def card_title(nodes: Column, link: Column) -> Column:
    """Link text, its label, its title, else the first text of 4 to 199 characters, no price."""
    blocks = M.find_all(nodes, "n.tag in ('h2', 'h3', 'span', 'div')")
    fallback = N.first_of(
        F.filter(
            M.texts_of(nodes, blocks),
            lambda t: F.length(t).between(4, 199) & ~t.rlike(r"^\$[0-9,.]+\n?$"),
        )
    )
    return M.or_else(
        M.text_of(nodes, link), M.attr(link, "aria-label"), M.attr(link, "title"), fallback
    )


def card_records(cards: DataFrame, profile: SiteProfile, keys: list[str]) -> DataFrame:
    """Cards to typed records; cards without a product link or a title give none."""
    n = F.col("nodes")
    source = F.lower(F.col("source"))
    brand = M.or_else(
        M.find_text(n, M.tagged("a", "data-test", S.CARD_BRAND)),
        M.find_text(n, M.tagged("a", "data-test", pattern="(?i)brand")),
    )
    comparison = M.find_text(n, M.tagged("span", "data-test", S.COMPARISON_PRICE))
    best = M.find(n, "contains(lower(n.attrs['aria-label']), 'bestseller')")
    best_text = F.exists(M.all_strings(n), lambda t: t.rlike("(?i)Bestseller"))
    ribbon = let(
        M.find(n, M.tagged("div", "class", pattern=S.RIBBON_CLASS)),
        lambda e: F.contains(F.lower(M.raw_text(M.within(n, e))), F.lit("new at")),
    )
    price_tag = M.find(n, M.tagged("span", "data-test", S.CURRENT_PRICE))
    # few, wide steps: each one is analysed anew, and rejects leave before the wide one
    linked = cards.select(*keys, "block", "source", "nodes", title_link(n).alias("_link")).filter(
        F.contains(M.attr(F.col("_link"), "href"), F.lit("/A-"))
    )
    read = linked.select(
        *keys,
        "block",
        T.strip(M.attr(F.col("_link"), "href")).alias("_url"),
        card_title(n, F.col("_link")).alias("title"),
        F.coalesce(brand, F.lit("")).alias("brand"),
        let(price_tag, lambda e: P.price_with_fallback(M.text_of(n, e), M.all_strings(n))).alias(
            "price_current"
        ),
        P.comparison_price(F.coalesce(comparison, F.lit(""))).alias("price_regular"),
        rating_adv(n).alias("_rating"),
        F.coalesce(M.find_text(n, M.tagged("strong")), F.lit("")).alias("bought_last_month"),
        swatch_colors(n).alias("colors"),
        card_image(n).alias("_image"),
        (price_tag.isNotNull() & F.contains(source, F.lit("sale"))).alias("_says_sale"),
        F.contains(source, F.lit("clearance")).alias("is_clearance"),
        (
            F.coalesce(ribbon, F.lit(False))
            | M.keyword_flag(F.col("source"), rf"New at\s+{profile.store_name}")
        ).alias("is_new"),
        (best.isNotNull() | best_text).alias("best_seller"),
    ).filter(F.col("title").isNotNull())
    current, regular = F.col("price_current"), F.col("price_regular")
    discount = P.discount_adv(current, regular)
    return read.select(
        *keys,
        "block",
        T.product_id_from_url(F.col("_url")).alias("product_id"),
        "title",
        T.prefix_host(F.col("_url"), profile.base).alias("url"),
        "brand",
        "price_current",
        "price_regular",
        discount["percent"].alias("discount_percent"),
        discount["amount"].alias("discount_amount"),
        F.col("_rating.rating").alias("rating"),
        F.col("_rating.count").alias("rating_count"),
        "bought_last_month",
        "colors",
        F.when(F.col("_image").isNotNull(), F.array("_image"))
        .otherwise(N.empty_list())
        .alias("images"),
        (F.col("_says_sale") | ((regular > 0) & (current < regular))).alias("is_sale"),
        "is_clearance",
        "is_new",
        "best_seller",
    )


def card_records_http(
    cards: DataFrame, profile: SiteProfile, keys: list[str], variant: str = "cmp"
) -> DataFrame:
    """Cards to the untyped HTTP record forms (``cmp``: 15 listing columns, ``sim``: 13)."""
    price = P.price_cmp if variant == "cmp" else P.price_sim
    n = F.col("nodes")
    focus = M.attr(F.get(n, F.lit(0)), "data-focusid")
    link = M.find(n, M.tagged("a", "data-test", pattern=S.CARD_TITLE))
    current = let(
        M.find(n, M.tagged("span", "data-test", S.CURRENT_PRICE)),
        lambda e: F.coalesce(M.raw_text(M.within(n, e)), F.lit("0")),
    )
    regular = let(
        M.find(n, M.tagged("span", "data-test", pattern=S.REGULAR_PRICE_PATTERN)),
        lambda e: M.raw_text(M.within(n, e)),
    )
    gone = F.exists(
        M.find_all(n, M.tagged("span")),
        lambda e: F.coalesce(
            M.only_string(n, e).rlike("Out of Stock|Unavailable"), F.lit(False)
        ),
    )
    image = let(M.find(n, M.tagged("img", "role", "presentation")), lambda e: M.attr(e, "src"))
    sale = M.find(n, M.tagged("span", "aria-label", pattern="(?i)Sale|Clearance"))
    new = M.find(n, M.tagged("span", "aria-label", pattern="(?i)new"))
    staged = cards.select(
        *keys,
        "block",
        F.coalesce(focus, F.lit("")).alias("_focus"),
        let(
            link,
            lambda a: F.when(
                a.isNotNull(),
                F.struct(
                    T.strip(M.raw_text(M.within(n, a))).alias("title"),
                    F.coalesce(M.attr(a, "href"), F.lit("")).alias("href"),
                ),
            ),
        ).alias("_link"),
        price(current).alias("current_price"),
        price(regular).alias("_regular"),
        rating_from_label(n).alias("_rating"),
        button_colors(n).alias("_colors"),
        F.coalesce(image, F.lit("")).alias("image_url"),
        (~gone).alias("in_stock"),
        sale.isNotNull().alias("is_sale"),
        new.isNotNull().alias("is_new"),
    )
    now = F.col("current_price")
    regular_price = P.regular_or_current(F.col("_regular"), now)
    discount = P.discount_rounded(now, regular_price)
    out = [
        T.product_id_from_focus(F.col("_focus")).alias("product_id"),
        F.coalesce(F.col("_link.title"), F.lit("N/A")).alias(
            "product_name" if variant == "cmp" else "title"
        ),
        F.coalesce(T.resolve_url(F.col("_link.href"), profile.category_url), F.lit("")).alias(
            "product_url" if variant == "cmp" else "url"
        ),
        "current_price",
        regular_price.alias("regular_price"),
        F.coalesce(discount["percent"], F.lit(0.0)).alias("discount_percent"),
        F.coalesce(discount["amount"], F.lit(0.0)).alias("discount_amount"),
        F.coalesce(F.col("_rating.rating"), F.lit(0.0)).alias("rating"),
        F.coalesce(F.col("_rating.count"), F.lit(0)).alias("review_count"),
        F.when(F.size("_colors") > 0, T.join_pipes(F.col("_colors")))
        .otherwise(F.lit("N/A"))
        .alias("colors"),
        "image_url",
        "in_stock",
        "is_sale",
    ]
    if variant == "cmp":
        out += [P.sale_price_cmp(now, F.col("is_sale")).alias("sale_price"), "is_new"]
    return staged.select(*keys, "block", *out)


def detail_records(details: DataFrame, profile: SiteProfile, url: str = "url") -> DataFrame:
    """Detail pages (``url``, ``nodes``) to the typed detail columns."""
    n = F.col("nodes")
    price = M.find_text(n, M.tagged("span", "data-test", S.DETAIL_PRICE))
    regular = M.find_text(n, M.tagged("span", "data-test", S.DETAIL_REGULAR_PRICE))
    read = details.select(
        F.col(url).alias("url"),
        "nodes",
        F.coalesce(M.find_text(n, M.tagged("h1", "data-test", S.DETAIL_TITLE)), F.lit("")).alias(
            "title"
        ),
        P.price_adv(F.coalesce(price, F.lit("0"))).alias("price_current"),
        P.comparison_price(F.coalesce(regular, F.lit(""))).alias("price_regular"),
        breadcrumb(n).alias("category_breadcrumb"),
        highlight_bullets(n).alias("highlights"),
        gallery_images(n, profile.image_host).alias("images"),
        specifications(n).alias("specifications"),
        F.coalesce(M.find_text(n, M.tagged("a", "data-test", S.SELLER_LINK)), F.lit("")).alias(
            "seller"
        ),
        chip_colors(n).alias("colors"),
    )
    highlights, specs = F.col("highlights"), F.col("specifications")
    return read.select(
        "url",
        T.product_id_from_url(F.col("url")).alias("product_id"),
        "title",
        "price_current",
        "price_regular",
        P.sale_price_adv(F.col("price_current"), F.col("price_regular")).alias("sale_price"),
        "category_breadcrumb",
        fit_and_style(n, highlights).alias("description"),
        N.material_of(specs).alias("material_text"),
        "highlights",
        highlights.alias("feature_bullets"),
        "images",
        N.dimensions_from(highlights, N.dimension_table(specs)).alias("dimensions"),
        N.dimension_table(specs).alias("dimensions_table"),
        "specifications",
        "seller",
        "colors",
        T.selected_color(F.col("url"), F.col("colors")).alias("color_selected"),
    )


def detail_records_http(details: DataFrame, profile: SiteProfile, url: str = "url") -> DataFrame:
    """Detail pages to the columns the HTTP merge reads."""
    n = F.col("nodes")

    def price_of(test) -> Column:
        return let(M.find(n, test), lambda e: P.price_cmp(M.raw_text(M.within(n, e))))

    read = details.select(
        F.col(url).alias("url"),
        F.coalesce(M.find_text(n, M.tagged("h1", "data-test", S.DETAIL_TITLE)), F.lit("N/A")).alias(
            "title"
        ),
        breadcrumb(n, "N/A").alias("category_breadcrumb"),
        price_of(M.tagged("span", "data-test", S.DETAIL_PRICE)).alias("current_price"),
        price_of(M.tagged("span", "data-test", pattern=S.REGULAR_PRICE_PATTERN)).alias("_regular"),
        rating_detail_cmp(n).alias("_rating"),
        gallery_images_cmp(n, profile.image_host).alias("images"),
        variant_colors(n).alias("colors"),
        specifications_cmp(n).alias("specifications"),
    )
    current = F.col("current_price")
    return read.select(
        "url",
        "title",
        "category_breadcrumb",
        "current_price",
        F.coalesce(F.col("_regular"), F.when(current != 0, current)).alias("regular_price"),
        F.coalesce(F.col("_rating.rating"), F.lit(0.0)).alias("rating"),
        F.coalesce(F.col("_rating.count"), F.lit(0)).alias("review_count"),
        "images",
        "colors",
        "specifications",
    )


def product_fields(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Six-column record of a page: embedded JSON first, then heading and page text."""
    # the JSON is read before the tree, so the page itself need not come back from Python
    docs = pages.select(url, html, M.embedded_json(F.col(html), S.PAGE_JSON_ID).alias("_doc"))

    def json(paths) -> Column:
        return N.variant_text(N.pick_first(F.col("_doc"), paths))

    read = docs.select(
        url,
        html,
        T.blank_to_null(json(S.JSON_TITLE)).alias("_title"),
        T.blank_to_null(json(S.JSON_PRICE)).alias("_price"),
        json(S.JSON_RATING).try_cast("double").alias("rating_avg"),
        json(S.JSON_RATING_COUNT).try_cast("int").alias("review_count"),
    )
    # only pages whose JSON left something open are read as markup
    open_ = F.col("_title").isNull() | F.col("_price").isNull()
    read = read.withColumn(html, F.when(open_, F.col(html)))
    trees = page_nodes(read, [url, "_title", "_price", "rating_avg", "review_count"], html=html)
    n = F.col("nodes")
    return trees.select(
        F.col(url).alias("url"),
        T.product_id_from_url(F.col(url), missing=None, strict=True).alias("tcin"),
        F.coalesce("_title", M.find_text(n, M.tagged("h1"))).alias("title"),
        F.coalesce("_price", P.first_dollar_text(visible_text(n))).alias("price"),
        "rating_avg",
        "review_count",
    )


# -- links and the page frontier --------------------------------------------------------------

RUN_OF_PAGES = 10_000


def product_links(
    pages: DataFrame, keys: list[str], base: str, accept=None, html: str = "html"
) -> DataFrame:
    """Accepted links of every page, each once per page, at its first position (keys, url, pos)."""
    links = pages.select(*keys, F.posexplode(M.link_hrefs(F.col(html))).alias("pos", "href"))
    urls = links.select(
        *keys, T.drop_fragment(T.resolve_url(F.col("href"), base)).alias("url"), "pos"
    )
    if accept is not None:
        urls = urls.filter(accept(F.col("url")))
    return urls.groupBy(*keys, "url").agg(F.min("pos").alias("pos"))


def page_frontier(
    pages: DataFrame, keys: list[str], url: str = "url", position: str = "position_text"
) -> DataFrame:
    """All pages still to come after ``page X of Y``: one offset URL each (keys, page, url).

    Runs of pages are dealt over as many tasks as a shuffle has, so a huge total is no task of its own.
    ``large_totals`` reports totals that no list can have.
    """
    staged = pages.withColumn("_at", M.page_position(F.col(position))).filter(
        F.col("_at.page") < F.col("_at.pages")
    )
    # runs of pages, then pages: no array is longer than a run or the number of runs
    runs = staged.select(
        *keys, url, "_at", F.explode(F.sequence(F.col("_at.page") + 1, F.col("_at.pages"), F.lit(RUN_OF_PAGES))).alias("_first")
    )
    # dealt before pages are made; a number of its own, as merging by size would undo it
    runs = runs.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_first")
    last = F.least(F.col("_first") + (RUN_OF_PAGES - 1), F.col("_at.pages"))
    numbered = runs.select(*keys, url, F.explode(F.sequence(F.col("_first"), last)).alias("page"))
    offset = (F.col("page") - 1) * S.PAGE_SIZE
    return numbered.select(
        *keys, "page", T.set_query_param(F.col(url), S.PAGE_OFFSET_PARAM, offset).alias("url")
    )


def large_totals(pages: DataFrame, keys: list[str], most: int = 100_000, position: str = "position_text") -> DataFrame:
    """Pages that speak of more than ``most`` pages in all (keys, pages, large); large is null without a position."""
    at = M.page_position(F.col(position))
    return pages.select(*keys, at.getField("pages").alias("pages"), (at.getField("pages") > most).alias("large"))


def next_offset_url(url: Column) -> Column:
    """Next listing URL by offset alone: raise an existing offset by a page, else start page two."""
    found = F.regexp_extract(url, rf"{S.PAGE_OFFSET_PARAM}=(\d+)", 1)
    raised = F.replace(
        url,
        F.concat(F.lit(f"{S.PAGE_OFFSET_PARAM}="), found),
        F.concat(
            F.lit(f"{S.PAGE_OFFSET_PARAM}="),
            (found.try_cast("bigint") + S.PAGE_SIZE).cast("string"),
        ),
    )
    sep = F.when(F.contains(url, F.lit("?")), "&").otherwise("?")
    first = F.concat(url, sep, F.lit(f"{S.PAGE_OFFSET_PARAM}={S.PAGE_SIZE}"))
    return F.when(F.contains(url, F.lit(f"{S.PAGE_OFFSET_PARAM}=")), raised).otherwise(first)


def next_page_link(nodes: Column, profile: SiteProfile) -> Column:
    """Absolute URL of the link labelled as the next page, null if there is none."""
    href = let(
        M.find(nodes, M.tagged("a", "aria-label", S.NEXT_PAGE_LABEL)),
        lambda n: F.when(n.isNotNull(), F.coalesce(M.attr(n, "href"), F.lit(""))),
    )
    return let(href, lambda h: F.when(h.isNotNull(), T.resolve_url(h, profile.category_url)))
