"""Queries over pages: links, cards, detail records, flags, frontier."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark import site as S
from shelfspark.functions import markup as M
from shelfspark.functions import nested as N
from shelfspark.functions import text as T
from shelfspark.operators import pages as H
from shelfspark.operators.page_tree import page_nodes
from shelfspark.plans.catalog import build_catalog, build_catalog_from_links, build_catalog_http
from shelfspark.plans.registry import query
from shelfspark.plans.text_queries import BASE, LINKS_SQL, WS_SQL
from shelfspark.plans.views import load, view
from shelfspark.site import SiteProfile

SHOP = SiteProfile()
_ENTITIES_SQL = (
    "replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&')"
)


def _decoded(sql: str) -> str:
    return _ENTITIES_SQL.replace("{x}", sql)


def _cards(spark, sf, *extra: str):
    return page_nodes(view(spark, sf, "cards"), ["p_partkey", *extra], keep_source=True)


def _details(spark, sf):
    return page_nodes(view(spark, sf, "detail_pages"), ["p_partkey", "url"])


@query(
    "h1_product_links",
    f"""select page_id, '{BASE}' || href as url, cast(min(pos) as integer) as pos from ({LINKS_SQL})
      where not contains(href, ',') group by page_id, href""",
)
def page_links(spark, sf):
    accept = lambda u: u.rlike(r"^https://shop\.example/[^,]+$")
    return H.product_links(load(spark, sf, "pages"), ["page_id"], BASE, accept)


@query(
    "h2_page_blocks",
    f"""with l as (select page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1) as l from pages),
      u as (select page_id, cast(generate_subscripts(l, 1) - 1 as integer) as block, unnest(l) as t from l)
      select page_id, block, {_decoded("regexp_replace(t, '<[^>]*>', '', 'g')")} as text from u""",
)
def page_blocks(spark, sf):
    blocks = page_nodes(load(spark, sf, "pages"), ["page_id"], root=("li", None, ""))
    return blocks.select("page_id", "block", M.text(F.col("nodes")).alias("text"))


@query(
    "h2_listing_cards",
    f"""select page_id, cast(n as integer) as block, cast(page_id as varchar) || '{S.CARD_FOCUS}' as focus
      from {{listing_pages}}, generate_series(0, 1) as g(n)
      where n < (page_id % 5 <> 0)::int + (page_id % 5 > 2)::int""",
)
def listing_cards(spark, sf):
    cards = H.listing_cards(view(spark, sf, "listing_pages"), ["page_id"])
    first = F.get("nodes", F.lit(0))
    return cards.select("page_id", "block", M.attr(first, "data-focusid").alias("focus"))


_TITLE = "case when p_partkey % 10 = 6 then p_name || 'x & y' else p_name end"
# without a number in the tagged text, the first "$" text counts: here the regular price
_CURRENT = "case p_partkey % 6 when 1 then cast(price + 10 as double) else cast(price as double) end"
_REGULAR = "case p_partkey % 3 when 0 then cast(price + 25 as double) else 0 end"
_RATING_SQL = "case p_partkey % 4 when 0 then rating when 1 then rating when 2 then cast(7.5 as double) else cast(0 as double) end"
_COUNT_SQL = "cast(case when p_partkey % 4 = 3 then 0 else p_size end as integer)"
_BRAND = "case when p_partkey % 7 = 1 then '' else p_brand end"

_CARD_SQL = f"""
  with c as (select *, {_CURRENT} as cur, {_REGULAR} as reg from {{cards}} where p_partkey % 10 not in (4, 5))
  select p_partkey, cast(0 as integer) as block, cast(p_partkey as varchar) as product_id, {_TITLE} as title,
    '{BASE}' || href as url, {_BRAND} as brand, cur as price_current, reg as price_regular,
    cast(case when reg > cur then trunc((reg - cur) / reg * 100) else 0 end as integer) as discount_percent,
    case when reg > cur then reg - cur else 0 end as discount_amount,
    {_RATING_SQL} as rating, {_COUNT_SQL} as rating_count,
    case when p_partkey % 5 = 0 then cast(p_size as varchar) || 'k+ bought' else '' end as bought_last_month,
    case when p_partkey % 2 = 0 then p_brand || '|' || p_type else '' end as colors,
    case p_partkey % 3 when 0 then 'https://images.shop.example/' || cast(p_partkey as varchar) || '.jpg{T.IMAGE_SIZE_QUERY}'
      when 1 then 'https://images.shop.example/s-' || cast(p_partkey as varchar) || '.jpg' else '' end as images,
    (p_partkey % 6 <> 0 and contains(lower(html), 'sale')) or (reg > 0 and cur < reg) as is_sale,
    p_partkey % 9 = 0 as is_clearance, p_partkey % 8 in (0, 1) as is_new,
    p_partkey % 11 = 0 or p_partkey % 13 = 0 as best_seller from c"""


@query("h3_card_records", _CARD_SQL)
def card_records(spark, sf):
    records = H.card_records(_cards(spark, sf), SHOP, ["p_partkey"])
    return records.withColumn("colors", F.array_join("colors", "|")).withColumn(
        "images", F.array_join("images", "|")
    )


def _http_sql(variant: str) -> str:
    tagged = "p_partkey % 10 not in (1, 4)"
    extra = (
        """, case when p_partkey % 10 = 8 then cur end as sale_price, p_partkey % 14 = 0 as is_new"""
        if variant == "cmp"
        else ""
    )
    # the text "See price in cart" has no number; a missing tag counts as 0
    return f"""
      with b as (select *, case p_partkey % 6 when 0 then cast(0 as double) when 1 then null else cast(price as double) end as cur from {{cards}}),
      c as (select *, case when p_partkey % 3 = 1 then cast(price + 10 as double) else cur end as reg from b),
      d as (select *, coalesce(cur <> 0 and reg <> 0 and reg > cur, false) as low from c)
      select p_partkey, cast(0 as integer) as block, cast(p_partkey as varchar) as product_id,
        case when not {tagged} then 'N/A' when p_partkey % 10 in (2, 3) then '' when p_partkey % 10 = 6 then p_name || ' x & y' else p_name end as {'product_name' if variant == 'cmp' else 'title'},
        case when not {tagged} then '' when p_partkey % 10 = 5 then '{BASE}/c/other' else '{BASE}' || href end as {'product_url' if variant == 'cmp' else 'url'},
        cur as current_price, reg as regular_price,
        case when low then cast(format('{{:.1f}}', (reg - cur) / reg * 100) as double) else cast(0 as double) end as discount_percent,
        case when low then reg - cur else cast(0 as double) end as discount_amount,
        cast(case when p_partkey % 4 = 1 then p_size else 0 end as double) as rating,
        cast(case when p_partkey % 4 = 1 then p_size else 0 end as integer) as review_count,
        case when p_partkey % 2 = 1 then p_brand else 'N/A' end as colors,
        case when p_partkey % 3 = 2 then 'https://images.shop.example/p-' || cast(p_partkey as varchar) || '.jpg' else '' end as image_url,
        p_partkey % 12 <> 0 as in_stock, p_partkey % 10 = 8 as is_sale {extra} from d"""


@query("h4_card_records_cmp", _http_sql("cmp"))
def card_records_cmp(spark, sf):
    return H.card_records_http(_cards(spark, sf), SHOP, ["p_partkey"])


@query("h4_card_records_sim", _http_sql("sim"))
def card_records_sim(spark, sf):
    return H.card_records_http(_cards(spark, sf), SHOP, ["p_partkey"], "sim")


@query(
    "h5_title_link",
    """select p_partkey, case p_partkey % 10 when 4 then null when 5 then '/c/other' else href end as href from {cards}""",
)
def title_link(spark, sf):
    link = T.let(H.title_link(F.col("nodes")), lambda a: T.strip(M.attr(a, "href")))
    return _cards(spark, sf).select("p_partkey", link.alias("href"))


@query(
    "h6_title_fallback",
    f"""select p_partkey, {_TITLE} as title from {{cards}} where p_partkey % 10 <> 4""",
)
def title_fallback(spark, sf):
    staged = _cards(spark, sf).withColumn("link", H.title_link(F.col("nodes")))
    return staged.filter(F.col("link").isNotNull()).select(
        "p_partkey", H.card_title(F.col("nodes"), F.col("link")).alias("title")
    )


@query(
    "h7_tagged_text",
    f"""select page_id, trim({_decoded("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")}, {WS_SQL}) as heading,
      trim({_decoded("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}, {WS_SQL}) as title, cast(null as varchar) as brand from pages""",
)
def tagged_text(spark, sf):
    n = F.col("nodes")
    return page_nodes(load(spark, sf, "pages"), ["page_id"]).select(
        "page_id",
        M.find_text(n, M.tagged("h1")).alias("heading"),
        M.find_text(n, M.tagged("title")).alias("title"),
        M.find_text(n, M.tagged("a", "data-test", pattern="(?i)brand")).alias("brand"),
    )


@query(
    "h8_breadcrumb",
    """select p_partkey, case p_partkey % 3 when 0 then 'Root > ' || p_type when 1 then 'Root > ' || p_brand else '' end as adv,
      case p_partkey % 3 when 0 then 'Root > ' || p_type when 1 then 'Root > ' || p_brand else 'N/A' end as cmp from {detail_pages}""",
)
def breadcrumb(spark, sf):
    n = F.col("nodes")
    return _details(spark, sf).select(
        "p_partkey", H.breadcrumb(n).alias("adv"), H.breadcrumb(n, "N/A").alias("cmp")
    )


@query(
    "h9_highlight_bullets",
    """select p_partkey, case when p_partkey % 3 = 1 then '' else 'Measurements: ' || cast(p_size as varchar) || ' in|Strap drop ' || cast(p_size as varchar) end as highlights from {detail_pages}""",
)
def highlight_bullets(spark, sf):
    return _details(spark, sf).select(
        "p_partkey", T.join_pipes(H.highlight_bullets(F.col("nodes"))).alias("highlights")
    )


@query(
    "h10_specifications",
    """select p_partkey, case when p_partkey % 4 = 2 then cast(p_size as varchar) || ' in' end as dimensions,
      case when p_partkey % 4 = 2 then p_name end as shell_material,
      case p_partkey % 4 when 1 then p_type || ': fine' when 3 then p_type end as material,
      case when p_partkey % 4 = 3 then cast(p_size as varchar) end as tcin,
      cast(case p_partkey % 4 when 1 then 1 else 2 end as integer) as n from {detail_pages}""",
)
def specifications(spark, sf):
    m = _details(spark, sf).select("p_partkey", H.specifications(F.col("nodes")).alias("m"))
    keys = {"dimensions": "Dimensions (Overall)", "shell_material": "Shell Material", "material": "Material", "tcin": "TCIN"}
    return m.select(
        "p_partkey", *[F.col("m")[k].alias(name) for name, k in keys.items()], F.size("m").alias("n")
    )


@query(
    "h11_specifications_cmp",
    """select p_partkey, case when p_partkey % 3 = 2 then p_type end as material,
      case when p_partkey % 3 = 2 then cast(p_partkey as varchar) end as upc,
      case when p_partkey % 3 = 2 then cast(p_size as varchar) || ':1' end as dimensions,
      cast(case when p_partkey % 3 = 2 then 4 else 0 end as integer) as n from {detail_pages}""",
)
def specifications_cmp(spark, sf):
    m = _details(spark, sf).select("p_partkey", H.specifications_cmp(F.col("nodes")).alias("m"))
    return m.select(
        "p_partkey",
        F.col("m")["Main Material"].alias("material"),
        F.col("m")["UPC"].alias("upc"),
        F.col("m")["Dimensions"].alias("dimensions"),
        F.size("m").alias("n"),
    )


@query(
    "h12_shortest_block",
    """select p_partkey, case p_partkey % 4 when 2 then 'Dimensions (Overall): ' || cast(p_size as varchar) || ' in Shell Material : ' || p_type || ' Shell Material: ' || p_name || ' no bold: x Empty: After : y Late : z'
      when 3 then 'TCIN: ' || cast(p_size as varchar) || ' Material : ' || p_type end as block from {detail_pages}""",
)
def shortest_block(spark, sf):
    n = F.col("nodes")
    block = T.let(H.shortest_spec_block(n), lambda b: M.text_of(n, b, " "))
    return _details(spark, sf).select("p_partkey", block.alias("block"))


_GALLERY_ADV = """case when p_partkey % 5 = 0 then 'https://images.shop.example/g-' || cast(p_partkey as varchar) || '.jpg?a=1'
  else 'https://images.shop.example/' || cast(p_partkey as varchar) || '.jpg?x=1|https://images.shop.example/' || cast(p_partkey as varchar) || '.jpg?x=2' end"""
_GALLERY_CMP = "case when p_partkey % 5 = 0 then '' else 'https://images.shop.example/' || cast(p_partkey as varchar) || '.jpg' end"


@query("h13_gallery_images", f"select p_partkey, {_GALLERY_ADV} as images from {{detail_pages}}")
def gallery_images(spark, sf):
    images = H.gallery_images(F.col("nodes"), SHOP.image_host)
    return _details(spark, sf).select("p_partkey", T.join_pipes(images).alias("images"))


@query("h14_gallery_images_cmp", f"select p_partkey, {_GALLERY_CMP} as images from {{detail_pages}}")
def gallery_images_cmp(spark, sf):
    images = H.gallery_images_cmp(F.col("nodes"), SHOP.image_host)
    return _details(spark, sf).select("p_partkey", T.join_pipes(images).alias("images"))


@query(
    "h13_capped_links",
    f"""with u as ({LINKS_SQL}), d as (select page_id, href, min(pos) as pos from u where contains(href, 'th') group by all),
      r as (select *, row_number() over (partition by page_id order by pos) as n from d)
      select page_id, coalesce(string_agg(href, '|' order by pos) filter (n <= 2), '') as hrefs
      from pages left join r using (page_id) group by page_id""",
)
def capped_links(spark, sf):
    hrefs = F.filter(M.link_hrefs(F.col("html")), lambda h: F.contains(h, F.lit("th")))
    return load(spark, sf, "pages").select(
        "page_id", T.join_pipes(N.distinct_non_empty(hrefs, 2)).alias("hrefs")
    )


@query(
    "h15_card_image",
    f"""select p_partkey, case p_partkey % 3 when 0 then 'https://images.shop.example/' || cast(p_partkey as varchar) || '.jpg{T.IMAGE_SIZE_QUERY}'
      when 1 then 'https://images.shop.example/s-' || cast(p_partkey as varchar) || '.jpg' end as image from {{cards}}""",
)
def card_image(spark, sf):
    return _cards(spark, sf).select("p_partkey", H.card_image(F.col("nodes")).alias("image"))


@query("h16_rating_block", f"select p_partkey, {_RATING_SQL} as rating, {_COUNT_SQL} as count from {{cards}}")
def rating_block(spark, sf):
    return _cards(spark, sf).select("p_partkey", H.rating_adv(F.col("nodes")).alias("r")).select("p_partkey", "r.*")


@query(
    "h17_rating_label",
    """select p_partkey, cast(case when p_partkey % 4 = 1 then p_size else 0 end as double) as rating,
      cast(case when p_partkey % 4 = 1 then p_size else 0 end as integer) as count from {cards}""",
)
def rating_label(spark, sf):
    return _cards(spark, sf).select("p_partkey", H.rating_from_label(F.col("nodes")).alias("r")).select(
        "p_partkey", "r.*"
    )


@query(
    "h17_rating_detail",
    """select p_partkey, case when p_partkey % 3 = 2 then cast(0 as double) else rating end as rating,
      cast(case when p_partkey % 3 = 0 then p_size else 0 end as integer) as count from {detail_pages}""",
)
def rating_detail(spark, sf):
    return _details(spark, sf).select("p_partkey", H.rating_detail_cmp(F.col("nodes")).alias("r")).select(
        "p_partkey", F.coalesce("r.rating", F.lit(0.0)).alias("rating"), F.coalesce("r.count", F.lit(0)).alias("count")
    )


@query(
    "h18_text_flags",
    f"""select l.p_partkey, l.is_sale, l.is_clearance, l.is_new, l.best_seller, h.in_stock, h.is_new as labelled_new
      from ({_CARD_SQL}) l join ({_http_sql("cmp")}) h using (p_partkey)""",
)
def text_flags(spark, sf):
    """The flags that both record forms take from a card's text and labels."""
    cards = _cards(spark, sf)
    listed = H.card_records(cards, SHOP, ["p_partkey"]).select("p_partkey", "is_sale", "is_clearance", "is_new", "best_seller")
    http = H.card_records_http(cards, SHOP, ["p_partkey"]).select("p_partkey", "in_stock", F.col("is_new").alias("labelled_new"))
    return listed.join(http, "p_partkey")


@query(
    "p7_listing_only",
    f"""with c as (select *, {_CURRENT} as cur, {_REGULAR} as reg from {{cards}} where p_partkey % 10 not in (4, 5)),
      n as (select c.*, g.n from c, generate_series(0, 1) as g(n) where g.n < (p_partkey % 5 <> 0)::int + (p_partkey % 5 > 2)::int)
      select p_partkey as page_id, cast(n as integer) as block, cast(p_partkey as varchar) as product_id, {_TITLE} as title,
        '{BASE}' || href as url, {_BRAND} as brand, cur as price_current, reg as price_regular, true as in_stock from n""",
)
def listing_only(spark, sf):
    built = build_catalog(view(spark, sf, "listing_pages").select("page_id", "html"), None, SHOP)
    return built.select("page_id", "block", "product_id", "title", "url", "brand", "price_current", "price_regular", "in_stock")


_DETAIL_SQL = f"""
  with d as (select *, case when p_partkey % 7 = 0 then cast(0 as double) else cast(price as double) end as cur,
      case when p_partkey % 2 = 1 then cast(price + 5 as double) else cast(0 as double) end as reg,
      case when p_partkey % 3 = 1 then '' else 'Measurements: ' || cast(p_size as varchar) || ' in|Strap drop ' || cast(p_size as varchar) end as hl
    from {{detail_pages}})
  select url, cast(p_partkey as varchar) as product_id, case when p_partkey % 17 = 0 then '' else p_name end as title,
    cur as price_current, reg as price_regular, case when reg > 0 and cur < reg then cur else cast(0 as double) end as sale_price,
    case p_partkey % 3 when 0 then 'Root > ' || p_type when 1 then 'Root > ' || p_brand else '' end as category_breadcrumb,
    case p_partkey % 3 when 0 then 'Fit & style' when 2 then 'Fit & styleRoomy ' || p_name else '' end as description,
    case p_partkey % 4 when 1 then p_type || ': fine' when 2 then p_name else p_type end as material_text,
    hl as highlights, hl as feature_bullets, {_GALLERY_ADV} as images,
    case when p_partkey % 3 <> 1 then 'Measurements: ' || cast(p_size as varchar) || ' in' end as measurements,
    case when p_partkey % 3 <> 1 then 'Strap drop ' || cast(p_size as varchar) end as handle_drop,
    case when p_partkey % 4 = 2 then cast(p_size as varchar) || ' in' end as dimensions_overall,
    case when p_partkey % 6 = 0 then '' else 'Sold by ' || p_brand end as seller,
    case when p_partkey % 5 = 2 then '' when p_partkey % 2 = 0 then upper(replace(p_name, ' ', '-')) || '|' else p_brand || '|' end as colors,
    case when p_partkey % 5 <> 2 and p_partkey % 2 = 0 then replace(p_name, ' ', '-') else '' end as color_selected from d"""


@query("h19_detail_records", _DETAIL_SQL)
def detail_records(spark, sf):
    d = H.detail_records(_details(spark, sf), SHOP)
    return d.select(
        *[
            F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c)
            for c, t in d.dtypes
            if not t.startswith("map")
        ],
        F.col("dimensions")["measurements"].alias("measurements"),
        F.col("dimensions")["handle_drop"].alias("handle_drop"),
        F.col("dimensions")["dimensions_overall"].alias("dimensions_overall"),
    )


@query(
    "h20_detail_records_cmp",
    f"""
  with d as (select *, case when p_partkey % 7 = 0 then null else cast(price as double) end as cur from {{detail_pages}})
  select url, case when p_partkey % 17 = 0 then 'N/A' else p_name end as title,
    case p_partkey % 3 when 0 then 'Root > ' || p_type when 1 then 'Root > ' || p_brand else 'N/A' end as category_breadcrumb,
    cur as current_price, case when p_partkey % 2 = 1 then cast(price + 5 as double) else cur end as regular_price,
    case when p_partkey % 3 = 2 then cast(0 as double) else rating end as rating,
    cast(case when p_partkey % 3 = 0 then p_size else 0 end as integer) as review_count, {_GALLERY_CMP} as images,
    case when p_partkey % 5 = 1 then p_brand else '' end as colors,
    cast(case when p_partkey % 3 = 2 then 4 else 0 end as integer) as n_specs from d""",
)
def detail_records_cmp(spark, sf):
    d = H.detail_records_http(_details(spark, sf), SHOP)
    return (
        d.withColumn("images", F.array_join("images", "|"))
        .withColumn("colors", F.array_join("colors", "|"))
        .withColumn("n_specs", F.size("specifications"))
        .drop("specifications")
    )


@query(
    "h21_bought_last_month",
    """select p_partkey, case when p_partkey % 5 = 0 then cast(p_size as varchar) || 'k+ bought' end as bought from {cards}""",
)
def bought_last_month(spark, sf):
    return _cards(spark, sf).select("p_partkey", M.find_text(F.col("nodes"), M.tagged("strong")).alias("bought"))


@query(
    "h22_card_colors",
    """select p_partkey, case when p_partkey % 2 = 0 then p_brand || '|' || p_type else '' end as swatches,
      case when p_partkey % 2 = 1 then p_brand else '' end as buttons from {cards}""",
)
def card_colors(spark, sf):
    n = F.col("nodes")
    return _cards(spark, sf).select(
        "p_partkey",
        T.join_pipes(H.swatch_colors(n)).alias("swatches"),
        T.join_pipes(H.button_colors(n)).alias("buttons"),
    )


@query(
    "h22_detail_colors",
    """select p_partkey, case when p_partkey % 5 = 1 then p_brand else '' end as variants,
      case when p_partkey % 5 = 2 then '' when p_partkey % 2 = 0 then upper(replace(p_name, ' ', '-')) || '|' else p_brand || '|' end as chips from {detail_pages}""",
)
def detail_colors(spark, sf):
    n = F.col("nodes")
    return _details(spark, sf).select(
        "p_partkey",
        T.join_pipes(H.variant_colors(n)).alias("variants"),
        T.join_pipes(H.chip_colors(n)).alias("chips"),
    )


@query(
    "h23_visible_text",
    f"""with t as (select page_id, string_split_regex(regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', '<>', 'g'), '<[^>]*>') as parts from pages)
      select page_id, array_to_string(list_filter(list_transform(parts, lambda p: trim({_decoded("p")}, {WS_SQL})), lambda p: p <> ''), ' ') as text from t""",
)
def visible_text(spark, sf):
    return page_nodes(load(spark, sf, "pages"), ["page_id"]).select(
        "page_id", H.visible_text(F.col("nodes")).alias("text")
    )


@query(
    "h24_embedded_json",
    """select event_id, event_id % 10 <> 0 as readable, case when event_id % 10 <> 0 then cast(props->>'$.k' as bigint) end as k from {json_pages}""",
)
def embedded_json(spark, sf):
    doc = M.embedded_json(F.col("html"), S.PAGE_JSON_ID)
    return (
        view(spark, sf, "json_pages")
        .select("event_id", doc.alias("doc"))
        .select(
            "event_id",
            F.col("doc").isNotNull().alias("readable"),
            F.try_variant_get("doc", "$.props.pageProps.raw.k", "bigint").alias("k"),
        )
    )


@query(
    "h25_product_fields",
    """select url, cast(user_id as varchar) as tcin,
      case when event_id % 10 in (0, 1, 2) then event_type else event_type || ' json' end as title,
      case when event_id % 3 = 0 and event_id % 10 <> 0 then '$' || cast(user_id as varchar)
        else '$' || cast(cast(value as decimal(10,2)) as varchar) end as price,
      cast(null as double) as rating_avg, cast(null as integer) as review_count from {json_pages}""",
)
def product_fields(spark, sf):
    return H.product_fields(view(spark, sf, "json_pages"))


@query(
    "h26_page_frontier",
    """with p as (select page_id, url, page_id % 5 + 1 as x, page_id % 5 + 1 + page_id % 3 as y from pages),
      n as (select page_id, url, unnest(generate_series(x + 1, y)) as page from p where x < y)
      select page_id, page,
        case when contains(url, '#') and not contains(url, '?') then url || '?Nao=' || cast((page - 1) * 24 as varchar)
          when contains(url, '?') then url || '&Nao=' || cast((page - 1) * 24 as varchar)
          else url || '?Nao=' || cast((page - 1) * 24 as varchar) end as url from n""",
)
def page_frontier(spark, sf):
    x = F.col("page_id") % 5 + 1
    text = F.concat(
        F.lit("Page "), x.cast("string"), F.lit(" of "), (x + F.col("page_id") % 3).cast("string")
    )
    pages = load(spark, sf, "pages").select("page_id", "url", text.alias("position_text"))
    return H.page_frontier(pages, ["page_id"])


@query(
    "h26_large_totals",
    """select page_id, case when page_id % 3 > 0 then page_id % 5 * 50000 + 1 end as pages,
      case when page_id % 3 > 0 then page_id % 5 * 50000 + 1 > 100000 end as large from pages""",
)
def large_totals(spark, sf):
    total = F.concat(F.lit("Page 1 of "), (F.col("page_id") % 5 * 50000 + 1).cast("string"))
    pages = load(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 3 > 0, total).alias("position_text"))
    return H.large_totals(pages, ["page_id"])


@query(
    "h27_next_page_urls",
    f"""select page_id, case when page_id % 4 + 1 > 1 then url || '?page=' || cast(page_id % 4 + 1 as varchar) else url end as by_number,
      case when page_id % 3 = 0 then url || '?Nao=48' when contains(url, '?') then url || '&Nao=24' else url || '?Nao=24' end as by_offset,
      case when page_id % 2 = 0 then '{BASE}/c/category?page=' || cast(page_id as varchar) end as by_link from pages""",
)
def next_page_urls(spark, sf):
    u = F.col("url")
    with_offset = F.when(F.col("page_id") % 3 == 0, F.concat(u, F.lit("?Nao=24"))).otherwise(u)
    html = F.concat(
        F.lit('<nav><a href="/x">1</a>'),
        F.when(
            F.col("page_id") % 2 == 0,
            F.concat(F.lit(f'<a aria-label="{S.NEXT_PAGE_LABEL}" href="?page='), F.col("page_id").cast("string"), F.lit('">Next</a>')),
        ).otherwise(F.lit("")),
        F.lit("</nav>"),
    )
    # the page tree keeps only its keys, so the other two forms go through it
    staged = load(spark, sf, "pages").select(
        "page_id",
        T.next_page_url(u, F.col("page_id") % 4 + 1).alias("by_number"),
        H.next_offset_url(with_offset).alias("by_offset"),
        html.alias("html"),
    )
    return page_nodes(staged, ["page_id", "by_number", "by_offset"]).select(
        "page_id", "by_number", "by_offset", H.next_page_link(F.col("nodes"), SHOP).alias("by_link")
    )


@query(
    "m1_pages_to_catalog",
    f"""
  with c as (select *, {_CURRENT} as cur from {{cards}} where p_partkey % 10 not in (4, 5)),
  n as (select c.*, g.n from c, generate_series(0, 1) as g(n) where g.n < (p_partkey % 5 <> 0)::int + (p_partkey % 5 > 2)::int)
  select p_partkey as page_id, cast(n as integer) as block, {_TITLE} as title,
    case when p_partkey % 4 <> 0 and p_partkey % 7 <> 0 then cast(price as double) else cur end as price_current,
    case when p_partkey % 4 <> 0 and p_partkey % 2 = 1 then cast(price + 5 as double)
      when p_partkey % 3 = 0 then cast(price + 25 as double) else cast(0 as double) end as price_regular,
    case when p_partkey % 4 = 0 then '' else case p_partkey % 3 when 0 then 'Root > ' || p_type when 1 then 'Root > ' || p_brand else '' end end as category_breadcrumb
  from n""",
)
def pages_to_catalog(spark, sf):
    built = build_catalog(
        view(spark, sf, "listing_pages").select("page_id", "html"),
        view(spark, sf, "detail_pages").select("url", "html"),
        SHOP,
    )
    return built.select("page_id", "block", "title", "price_current", "price_regular", "category_breadcrumb")


@query(
    "m2_pages_to_catalog_cmp",
    """
  with c as (select * from {cards}),
  n as (select c.*, g.n, p_partkey % 10 not in (1, 4, 5) and p_partkey % 4 <> 0 as found from c, generate_series(0, 1) as g(n)
    where g.n < (p_partkey % 5 <> 0)::int + (p_partkey % 5 > 2)::int)
  select p_partkey as page_id, cast(n as integer) as block,
    case when found then case when p_partkey % 17 = 0 then 'N/A' else p_name end
      when p_partkey % 10 in (1, 4) then 'N/A' when p_partkey % 10 in (2, 3) then '' when p_partkey % 10 = 6 then p_name || ' x & y' else p_name end as product_name,
    case when found and p_partkey % 3 = 2 then p_type else 'N/A' end as material_text,
    case when found and p_partkey % 3 = 2 then 'Closure Type: zip' else 'N/A' end as feature_bullets
  from n""",
)
def pages_to_catalog_cmp(spark, sf):
    built = build_catalog_http(
        view(spark, sf, "listing_pages").select("page_id", "html"),
        view(spark, sf, "detail_pages").select("url", "html"),
        SHOP,
    )
    return built.select("page_id", "block", "product_name", "material_text", "feature_bullets")


@query(
    "h25_links_to_products",
    """with f as (select *, row_number() over (partition by url order by event_id) as rn from {json_pages}),
      p as (select url, case when event_id % 10 in (0, 1, 2) then event_type else event_type || ' json' end as title,
        case when event_id % 3 = 0 and event_id % 10 <> 0 then '$' || cast(user_id as varchar)
          else '$' || cast(cast(value as decimal(10,2)) as varchar) end as price from f where rn = 1)
      select event_id as page_id, cast(1 as integer) as pos, cast(user_id as varchar) as tcin, url, title, price
      from events join p on p.url = 'https://shop.example/p/' || event_type || '/-/A-' || cast(user_id as varchar)""",
)
def links_to_products(spark, sf):
    products = view(spark, sf, "json_pages")
    link = F.concat(
        F.lit('<a href="/c/other">x</a><a class=p href="/p/'), "event_type", F.lit("/-/A-"),
        F.col("user_id").cast("string"), F.lit('#top">y</a>'),
    )
    listing = load(spark, sf, "events").select(F.col("event_id").alias("page_id"), link.alias("html"))
    built = build_catalog_from_links(
        listing, products.select("url", F.col("event_id").alias("page_id"), "html"), SHOP
    )
    return built.select("page_id", "pos", "tcin", "url", "title", "price")
