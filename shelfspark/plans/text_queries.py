"""Queries for strings, URLs, ids, prices and numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions import markup as M
from shelfspark.functions import pricing as P
from shelfspark.functions import text as T
from shelfspark.plans.registry import query
from shelfspark.plans.views import load, view

# the stripped characters as SQL
WS_SQL = "concat(" + ", ".join(f"chr({ord(c)})" for c in T.WHITESPACE) + ")"
CUT_SQL = (
    "case when length(t) > 500 then coalesce(nullif(regexp_replace(left(t, 500), '(?s) [^ ]*$', ''), ''), "
    "left(t, 500)) else t end"
)
BASE = "https://shop.example"
LINKS_SQL = (
    "select page_id, unnest(l) as href, generate_subscripts(l, 1) - 1 as pos from "
    "(select page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) as l from pages)"
)

_ID_URL = (
    "case ord % 9 when 0 then replace(url, '/-/A-', '/A-') when 1 then 'https://shop.example/p/x' "
    "when 2 then '/p/x/-/A-' when 3 then '/p/x/-/A-12x' else url end"
)


@query(
    "x1_product_id_from_url",
    f"""with u as (select ord, {_ID_URL} as u from {{catalog}})
    select ord, regexp_extract(u, '/A-([0-9]+)', 1) as adv,
      coalesce(nullif(regexp_extract(u, '/A-([0-9]+)', 1), ''), 'N/A') as cmp,
      nullif(regexp_extract(u, '/-/A-([0-9]+)', 1), '') as strict from u""",
)
def product_id_from_url(spark, sf):
    u = view(spark, sf, "catalog").select("ord", F.expr(_ID_URL).alias("u"))
    c = F.col("u")
    return u.select(
        "ord",
        T.product_id_from_url(c).alias("adv"),
        T.product_id_from_url(c, "N/A").alias("cmp"),
        T.product_id_from_url(c, None, strict=True).alias("strict"),
    )


_FOCUS = "case s_suppkey % 4 when 0 then '' when 1 then s_name else concat(cast(s_suppkey as string), '_product_card_', s_name) end"


@query(
    "x2_product_id_from_focus",
    f"""select s_suppkey, coalesce(nullif(split_part({_FOCUS}, '_', 1), ''), 'N/A') as product_id from supplier""",
)
def product_id_from_focus(spark, sf):
    s = load(spark, sf, "supplier")
    return s.select("s_suppkey", T.product_id_from_focus(F.expr(_FOCUS)).alias("product_id"))


@query(
    "x3_safe_string",
    f"""select event_id, cast(user_id as varchar) as id_text, cast(value as varchar) as value_text,
      case when event_id % 2 = 0 then 'true' else 'false' end as flag_text,
      case when event_id % 3 = 0 then '' else event_type end as type_text from events""",
)
def safe_string(spark, sf):
    padded = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("  "), "event_type", F.lit("\n")))
    return load(spark, sf, "events").select(
        "event_id",
        T.safe_str(F.col("user_id")).alias("id_text"),
        T.safe_str(F.col("value")).alias("value_text"),
        T.safe_str(F.col("event_id") % 2 == 0).alias("flag_text"),
        T.safe_str(padded).alias("type_text"),
    )


@query(
    "x4_unicode_strip",
    f"""select doc_id, trim(concat(chr(9), chr(160), text, chr(12288), chr(10)), {WS_SQL}) as stripped from documents""",
)
def unicode_strip(spark, sf):
    padded = F.concat(F.lit("\t "), "text", F.lit("　\n"))
    return load(spark, sf, "documents").select("doc_id", T.strip(padded).alias("stripped"))


DOCUMENT_SQL = f"""
  select ord, trim({CUT_SQL}, {WS_SQL}) as document from (
    select ord, array_to_string(list_filter([trim(title, {WS_SQL}), trim(brand, {WS_SQL}),
      trim(description, {WS_SQL}), trim(material_text, {WS_SQL})], lambda x: x is not null and x <> ''), ' ') as t
    from {{raw_products}})"""


@query("x5_document_text", DOCUMENT_SQL)
def document_text(spark, sf):
    none = F.lit(None).cast("string")
    return view(spark, sf, "raw_products").select(
        "ord",
        T.document_text(
            *[F.col(c) for c in ("title", "brand", "description", "material_text")], none, none
        ).alias("document"),
    )


@query("x6_cut_at_word", f"select doc_id, {CUT_SQL} as cut from (select doc_id, text as t from documents)")
def cut_at_word(spark, sf):
    return load(spark, sf, "documents").select("doc_id", T.cut_at_word(F.col("text")).alias("cut"))


@query("x7_hard_cut", "select doc_id, left(text, 500) as cut, cast(length(left(text, 500)) as integer) as n from documents")
def hard_cut(spark, sf):
    cut = T.hard_cut(F.col("text"), T.MAX_METADATA_CHARS)
    return load(spark, sf, "documents").select("doc_id", cut.alias("cut"), F.length(cut).alias("n"))


_IMAGES = (
    "case ord % 4 when 0 then concat(' https://images.shop.example/', product_id, '.jpg | https://b') "
    "when 1 then concat('/rel/', product_id, '.jpg|https://b') when 2 then '' end"
)


@query(
    "x8_first_image_url",
    f"""select ord, case when ord % 4 = 0 then concat('https://images.shop.example/', product_id, '.jpg') end as first_image_url from {{catalog}}""",
)
def first_image_url(spark, sf):
    return view(spark, sf, "catalog").select(
        "ord", T.first_image_url(F.expr(_IMAGES)).alias("first_image_url")
    )


@query(
    "x9_embed_text",
    f"""select doc_id, coalesce(nullif({CUT_SQL}, ''), ' ') as embed_text from
      (select doc_id, case doc_id % 5 when 0 then '' when 1 then null else text end as t from documents)""",
)
def embed_text(spark, sf):
    c = F.expr("case doc_id % 5 when 0 then '' when 1 then null else text end")
    return load(spark, sf, "documents").select("doc_id", T.embed_text(c).alias("embed_text"))


@query(
    "x11_image_url_forms",
    f"""select page_id, regexp_replace(url, '[?].*', '') as bare,
      concat(regexp_replace(url, '[?].*', ''), '{T.IMAGE_SIZE_QUERY}') as sized from pages""",
)
def image_url_forms(spark, sf):
    u = F.col("url")
    return load(spark, sf, "pages").select(
        "page_id", T.drop_query(u).alias("bare"), T.sized_image(u).alias("sized")
    )


@query(
    "x12_absolute_links",
    f"""with f as (select page_id, cast(pos as integer) as pos, href as abs, 'https:' || '/' || href as dbl,
        ltrim(href, '/') as rel, '?q=' || ltrim(href, '/') as q, '/a/./b/../' || ltrim(href, '/') as dots from ({LINKS_SQL}))
    select page_id, pos, '{BASE}' || abs as prefixed, '{BASE}' || abs as joined_abs, dbl as joined_scheme,
      '{BASE}/c/' || rel as joined_rel, '{BASE}/c/page' || q as joined_query, '{BASE}/a/' || rel as joined_dots from f""",
)
def absolute_links(spark, sf):
    pages = load(spark, sf, "pages")
    links = pages.select("page_id", F.posexplode(M.link_hrefs(F.col("html"))).alias("pos", "href"))
    rel = F.ltrim("href", F.lit("/"))
    page = BASE + "/c/page"
    return links.select(
        "page_id",
        "pos",
        T.prefix_host(F.col("href"), BASE).alias("prefixed"),
        T.resolve_url(F.col("href"), page).alias("joined_abs"),
        T.resolve_url(F.concat(F.lit("/"), "href"), page).alias("joined_scheme"),
        T.resolve_url(rel, page).alias("joined_rel"),
        T.resolve_url(F.concat(F.lit("?q="), rel), page).alias("joined_query"),
        T.resolve_url(F.concat(F.lit("/a/./b/../"), rel), page).alias("joined_dots"),
    )


@query("x13_drop_fragment", "select page_id, regexp_replace(url, '#.*$', '') as url from pages")
def drop_fragment(spark, sf):
    return load(spark, sf, "pages").select("page_id", T.drop_fragment(F.col("url")).alias("url"))


@query(
    "x14_url_parts",
    r"""select page_id, regexp_extract(url, '^([a-z]+):', 1) as scheme, regexp_extract(url, '//([^/?#]*)', 1) as host,
      regexp_extract(url, '//[^/?#]*([^?#]*)', 1) as path, regexp_extract(url, '[?]([^#]*)', 1) as query,
      regexp_extract(url, '#(.*)$', 1) as fragment from pages""",
)
def url_parts(spark, sf):
    return load(spark, sf, "pages").select("page_id", T.url_parts(F.col("url")).alias("p")).select(
        "page_id", "p.*"
    )


@query(
    "x15_srcset_first",
    """select ord, concat('https://images.shop.example/', product_id, '.jpg') as src from {catalog}""",
)
def srcset_first(spark, sf):
    srcset = F.concat(
        F.lit(" https://images.shop.example/"), "product_id", F.lit(".jpg 1x , https://b/"), "title", F.lit(" 2x")
    )
    return view(spark, sf, "catalog").select("ord", T.srcset_first(srcset).alias("src"))


_PARAM_URL = (
    "case page_id % 6 when 0 then url when 1 then 'https://s.example/c?Nao=24&x=&a=1&a=2' "
    "when 2 then 'https://s.example/c?x=a%20b&y=c%2Bd#top' when 3 then 'https://s.example/c?flag&k=v' "
    "when 4 then concat('https://s.example/c?p=', cast(page_id as string), '&Nao=0&q=1') else 'https://s.example/c' end"
)


@query(
    "x16_query_param",
    """select page_id, case page_id % 6
        when 0 then case when contains(url, '?') then concat(url, '&Nao=', n) else concat(url, '?Nao=', n) end
        when 1 then concat('https://s.example/c?Nao=', n, '&a=1&a=2')
        when 2 then concat('https://s.example/c?x=a+b&y=c%2Bd&Nao=', n, '#top')
        when 3 then concat('https://s.example/c?k=v&Nao=', n)
        when 4 then concat('https://s.example/c?p=', cast(page_id as varchar), '&Nao=', n, '&q=1')
        else concat('https://s.example/c?Nao=', n) end as url
      from (select page_id, url, cast((page_id % 50) * 24 as varchar) as n from pages)""",
)
def query_param(spark, sf):
    offset = (F.col("page_id") % 50) * 24
    return load(spark, sf, "pages").select(
        "page_id", T.set_query_param(F.expr(_PARAM_URL), "Nao", offset).alias("url")
    )


@query(
    "x17_selected_color",
    """select ord, case when ord % 2 = 0 then 'p' when ord % 3 = 0 then replace(title, ' ', '-') else '' end as color from {catalog}""",
)
def selected_color(spark, sf):
    c = view(spark, sf, "catalog")
    names = F.array(
        F.when(F.col("ord") % 3 == 0, F.upper(F.translate("title", " ", "-"))).otherwise(F.col("brand")),
        F.when(F.col("ord") % 2 == 0, F.lit("P")).otherwise(F.lit("")),
    )
    return c.select("ord", T.selected_color(F.col("url"), names).alias("color"))


@query(
    "x26_split_and_join",
    f"""select doc_id, array_to_string(list_transform(string_split(text, ','), lambda x: trim(x, {WS_SQL})), '|') as joined,
      cast(len(string_split(text, ',')) as integer) as n from documents""",
)
def split_and_join(spark, sf):
    parts = T.split_trim(F.col("text"))
    return load(spark, sf, "documents").select(
        "doc_id", T.join_pipes(parts).alias("joined"), F.size(parts).alias("n")
    )


# -- prices -----------------------------------------------------------------------------------

_PRICE_TEXT = (
    "case p_partkey % 8 when 0 then concat('$1,', cast(200 + p_size as string), '.50') when 1 then '$10.00 - $20.00' "
    "when 2 then '.5 off' when 3 then 'Inc. $5' when 4 then '1.2.3' when 5 then '' when 6 then null "
    "else concat('Now $', cast(p_retailprice as string), ' was $1,299.00') end"
)
_PLAIN = "replace(t, ',', '')"


def _price_query(name, sql, fn):
    @query(name, f"with p as (select p_partkey, {_PRICE_TEXT} as t from part) select p_partkey, {sql} as price from p")
    def run(spark, sf):
        return load(spark, sf, "part").select("p_partkey", fn(F.expr(_PRICE_TEXT)).alias("price"))


_price_query(
    "x18a_price_adv",
    f"coalesce(try_cast(nullif(regexp_extract({_PLAIN}, '[0-9.]+'), '') as double), cast(0 as double))",
    P.price_adv,
)
_price_query(
    "x18b_price_cmp", f"try_cast(nullif(regexp_extract({_PLAIN}, '[0-9.]+'), '') as double)", P.price_cmp
)
_price_query(
    "x18c_price_sim",
    f"try_cast(nullif(regexp_extract({_PLAIN}, '([0-9]+[.]?[0-9]*)', 1), '') as double)",
    P.price_sim,
)
_price_query("x18d_first_dollar_text", "nullif(regexp_extract(t, '[$][0-9]+([.][0-9][0-9])?'), '')", P.first_dollar_text)
_price_query(
    "x18e_comparison_price",
    "coalesce(try_cast(nullif(replace(regexp_extract(t, '[$]([0-9,.]+)', 1), ',', ''), '') as double), cast(0 as double))",
    P.comparison_price,
)


@query(
    "x18f_price_fallback",
    """select p_partkey, cast(case p_partkey % 3 when 0 then p_size when 1 then p_size + 1 else 0 end as double) as price from part""",
)
def price_fallback(spark, sf):
    p = load(spark, sf, "part")
    k = F.col("p_partkey") % 3
    tagged = F.when(k == 0, F.concat(F.lit("$"), F.col("p_size").cast("string"), F.lit(".00"))).when(
        k == 1, F.lit("See in cart")
    )
    texts = F.array(
        F.lit("no price"),
        F.when(k == 1, F.concat(F.lit("Only $ "), (F.col("p_size") + 1).cast("string"))).otherwise(F.lit("$-")),
        F.lit("USD 7"),
    )
    return p.select("p_partkey", P.price_with_fallback(tagged, texts).alias("price"))


_OFFER = "l_orderkey, l_linenumber, product_id, cast(price_current as double) as c, cast(price_regular as double) as r from {offers}"


def _offers(spark, sf):
    return view(spark, sf, "offers").select(
        "l_orderkey",
        "l_linenumber",
        "product_id",
        F.col("price_current").cast("double").alias("c"),
        F.col("price_regular").cast("double").alias("r"),
    )


@query(
    "x20a_discount_adv",
    f"""select l_orderkey, l_linenumber, product_id, case when r > c then r - c else 0 end as amount,
      cast(case when r > c then trunc((r - c) / r * 100) else 0 end as integer) as percent from (select {_OFFER})""",
)
def discount_adv(spark, sf):
    d = P.discount_adv(F.col("c"), F.col("r"))
    return _offers(spark, sf).select("l_orderkey", "l_linenumber", "product_id", d.alias("d")).select(
        "l_orderkey", "l_linenumber", "product_id", "d.amount", "d.percent"
    )


@query(
    "x20b_discount_rounded",
    f"""select l_orderkey, l_linenumber, product_id, case when c <> 0 and r <> 0 and r > c then r - c else 0 end as amount,
      case when c <> 0 and r <> 0 and r > c then cast(format('{{:.1f}}', (r - c) / r * 100) as double) else 0 end as percent
      from (select {_OFFER})""",
)
def discount_rounded(spark, sf):
    d = P.discount_rounded(F.col("c"), F.col("r"))
    return _offers(spark, sf).select("l_orderkey", "l_linenumber", "product_id", d.alias("d")).select(
        "l_orderkey", "l_linenumber", "product_id", "d.amount", "d.percent"
    )


@query(
    "x21_sale_price",
    f"""select l_orderkey, l_linenumber, product_id, case when r > 0 and c < r then c else 0 end as adv,
      case when s then c end as cmp from (select is_sale as s, {_OFFER})""",
)
def sale_price(spark, sf):
    o = view(spark, sf, "offers").withColumn("c", F.col("price_current").cast("double")).withColumn(
        "r", F.col("price_regular").cast("double")
    )
    return o.select(
        "l_orderkey",
        "l_linenumber",
        "product_id",
        P.sale_price_adv(F.col("c"), F.col("r")).alias("adv"),
        P.sale_price_cmp(F.col("c"), F.col("is_sale")).alias("cmp"),
    )


@query(
    "x22_regular_or_current",
    f"""select l_orderkey, l_linenumber, product_id, case l_linenumber % 3 when 0 then c when 1 then c else r end as regular from (select {_OFFER})""",
)
def regular_or_current(spark, sf):
    n = F.col("l_linenumber") % 3
    found = F.when(n == 0, F.lit(0.0)).when(n == 2, F.col("r"))
    return _offers(spark, sf).select(
        "l_orderkey", "l_linenumber", "product_id", P.regular_or_current(found, F.col("c")).alias("regular")
    )


_COUNT_TEXT = (
    "case p_partkey % 5 when 0 then concat('(', cast(p_size as string), ')') when 1 then concat('1,', cast(p_size as string)) "
    "when 2 then concat(' ', cast(p_size as string), ' ratings') when 3 then 'none' else cast(p_size as string) end"
)


@query(
    "x23_counts_in_text",
    """select p_partkey, cast(case p_partkey % 5 when 1 then 1 when 3 then null else p_size end as integer) as first_int,
      cast(case when p_partkey % 5 = 4 then p_size end as integer) as whole_int from part""",
)
def counts_in_text(spark, sf):
    t = F.expr(_COUNT_TEXT)
    return load(spark, sf, "part").select(
        "p_partkey", P.first_int(t).alias("first_int"), P.to_int(t).alias("whole_int")
    )
