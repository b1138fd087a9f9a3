"""Product-shaped views over the generic tables, as SQL both Spark and the checker can run.

``{name}`` stands for a table or another view. Markup is rendered per row, never collected.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from shelfspark import site as S
from shelfspark.session import configure

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_URL = (
    "concat('https://shop.example/p/', replace(p_name, ' ', '-'), '/-/A-', cast(p_partkey as string), "
    "'?preselect=', cast(p_size as string), '#lnk=same')"
)
_PRICE = "cast(p_retailprice as decimal(12,2))"
_RATING = "cast(cast(p_partkey % 51 as decimal(4,1)) / 10 as decimal(3,1))"


def _money(amount: str) -> str:
    """``$1,234.50`` text of a decimal expression."""
    text = f"cast({amount} as string)"
    return (
        f"case when {amount} >= 1000 then concat('$', left({text}, length({text}) - 6), ',', "
        f"right({text}, 6)) else concat('$', {text}) end"
    )


def _pieces(*parts: str) -> str:
    return "concat(" + ", ".join(parts) + ")"


_HREF = (
    "concat('/p/', replace(p_name, ' ', '-'), '/-/A-', cast(p_partkey as string), '?preselect=', "
    "cast(p_size as string), '#lnk=same')"
)
_ID = "cast(p_partkey as string)"
_SIZE = "cast(p_size as string)"

_CARD = _pieces(
    f"'<div data-test=\"{S.CARD_WRAPPER}\" data-focusid=\"', {_ID}, '{S.CARD_FOCUS}\">'",
    # picture
    f"""case p_partkey % 3
      when 0 then concat('<picture data-test="{S.CARD_PICTURE}"><source srcset="https://images.shop.example/s-', {_ID}, '.jpg 1x"><img src="https://images.shop.example/', {_ID}, '.jpg?wid=20"></picture>')
      when 1 then concat('<picture data-test="{S.CARD_PICTURE}"><source srcset="https://images.shop.example/s-', {_ID}, '.jpg 1x, https://images.shop.example/t-', {_ID}, '.jpg 2x"></picture>')
      else concat('<img role="presentation" src="https://images.shop.example/p-', {_ID}, '.jpg">') end""",
    # link and title
    f"""case p_partkey % 10
      when 1 then concat('<a href="', {_HREF}, '">', p_name, '</a>')
      when 2 then concat('<a data-test="{S.CARD_TITLE}" href="', {_HREF}, '" aria-label="', p_name, '"></a>')
      when 3 then concat('<a data-test="{S.CARD_TITLE}" href="', {_HREF}, '"></a><h3> ', p_name, ' </h3><p>', repeat('x', 200), '</p>')
      when 4 then ''
      when 5 then concat('<a data-test="{S.CARD_TITLE}" href="/c/other">', p_name, '</a>')
      when 6 then concat('<a data-test="{S.CARD_TITLE}" href=" ', {_HREF}, '"> ', p_name, ' <b>x &amp; y</b></a>')
      else concat('<a data-test="{S.CARD_TITLE}" href="', {_HREF}, '">', p_name, '</a>') end""",
    # brand
    f"""case when p_partkey % 7 = 0 then concat('<a data-test="cardBrandLink">', p_brand, '</a>')
      when p_partkey % 7 = 1 then ''
      else concat('<a data-test="{S.CARD_BRAND}"> ', p_brand, '</a>') end""",
    # prices
    f"""case when p_partkey % 6 = 0 then concat('<div>Now ', {_money(_PRICE)}, '</div>')
      when p_partkey % 6 = 1 then '<span data-test="{S.CURRENT_PRICE}">See price in cart</span>'
      else concat('<span data-test="{S.CURRENT_PRICE}">', {_money(_PRICE)}, '</span>') end""",
    f"""case p_partkey % 3
      when 0 then concat('<span data-test="{S.COMPARISON_PRICE}">reg ', {_money(f"cast({_PRICE} + 25 as decimal(12,2))")}, '</span>')
      when 1 then concat('<span data-test="regular-price">', {_money(f"cast({_PRICE} + 10 as decimal(12,2))")}, '</span>')
      else '' end""",
    # rating
    f"""case p_partkey % 4
      when 0 then concat('<div class="x {S.RATING_BOX_CLASS}"><span aria-hidden="true">n/a</span><span aria-hidden="true">7.5</span><span aria-hidden="true">', cast({_RATING} as string), '</span><span class="{S.RATING_COUNT_CLASS}">(', {_SIZE}, ')</span></div>')
      when 1 then concat('<div class="{S.RATING_BOX_CLASS}"><span aria-hidden="true">', cast({_RATING} as string), '</span><span aria-label="', {_SIZE}, ' ratings">', {_SIZE}, ' ratings</span></div>')
      when 2 then concat('<span aria-hidden="true">7.5</span><span class="{S.RATING_COUNT_CLASS}">', {_SIZE}, ' reviews</span>')
      else '' end""",
    f"case when p_partkey % 5 = 0 then concat('<strong>', {_SIZE}, 'k+ bought</strong>') else '' end",
    # colours
    f"""case when p_partkey % 2 = 0 then concat('<span data-test="{S.CARD_SWATCHES}" aria-label="', p_brand, ', ', p_type, '"></span>')
      else concat('<button title="Color: ', p_brand, '"></button><button title="Size"></button>') end""",
    # flags
    f"""case p_partkey % 8 when 0 then '<div class="q {S.RIBBON_CLASS}">New at last</div>' when 1 then '<p>New at  Shop</p>' else '' end""",
    """case when p_partkey % 9 = 0 then '<p>Clearance</p>' else '' end""",
    """case p_partkey % 10 when 8 then '<span aria-label="Sale"></span>' when 9 then '<p>On Sale</p>' else '' end""",
    """case when p_partkey % 11 = 0 then '<i aria-label="Top Bestseller"></i>' else '' end""",
    """case when p_partkey % 13 = 0 then '<i>our bestseller</i>' else '' end""",
    """case when p_partkey % 12 = 0 then '<span><b>Out of Stock</b></span>' else '' end""",
    """case when p_partkey % 28 = 0 then '<span aria-label="NEW arrival"></span>'
      when p_partkey % 14 = 0 then '<span aria-label="New arrival"></span>' else '' end""",
    "'</div>'",
)

_DETAIL = _pieces(
    f"""case p_partkey % 3
      when 0 then concat('<div data-module-type="{S.BREADCRUMB_MODULE}"><nav aria-label="{S.BREADCRUMB_LABEL}"><a data-test="{S.BREADCRUMB_LINK}">Root</a><a data-test="{S.BREADCRUMB_LINK}"> ', p_type, ' </a><a>skip</a></nav></div>')
      when 1 then concat('<nav data-test="{S.BREADCRUMB_NAV}"><a>Root</a><a> </a><a>', p_brand, '</a></nav>')
      else '' end""",
    f"""case when p_partkey % 17 = 0 then '' else concat('<h1 data-test="{S.DETAIL_TITLE}"> ', p_name, ' </h1>') end""",
    f"""case when p_partkey % 7 = 0 then '' else concat('<span data-test="{S.DETAIL_PRICE}">', {_money(_PRICE)}, ' - $9,999.00</span>') end""",
    f"""case when p_partkey % 2 = 1 then concat('<span data-test="{S.DETAIL_REGULAR_PRICE}">reg ', {_money(f"cast({_PRICE} + 5 as decimal(12,2))")}, '</span>') else '' end""",
    f"""case when p_partkey % 5 = 0 then concat('<div data-test="{S.GALLERY_ITEM}-0"><img src="https://images.shop.example/g-', {_ID}, '.jpg?a=1"></div>')
      else concat('<section aria-label="{S.GALLERY_LABEL}"><img src="https://images.shop.example/', {_ID}, '.jpg?x=1"><img src="https://images.shop.example/', {_ID}, '.jpg?x=2"><img src="https://images.shop.example/', {_ID}, '.jpg?x=1"><img src="https://other.example/z.jpg"></section>') end""",
    f"""case when p_partkey % 3 = 1 then '' else concat('<div id="{S.HIGHLIGHTS_ID}"><ul><li>Measurements: ', {_SIZE}, ' in</li><li> </li><li>Strap drop ', {_SIZE}, '</li></ul></div>') end""",
    f"""case p_partkey % 4
      when 1 then concat('<div data-test="{S.SPEC_BOX}"><section><div><b>Material:</b> ', p_type, ': fine</div><hr><div data-test="{S.SPEC_DISCLAIMER}"><b>After</b>: y</div></section></div>')
      when 3 then concat('<div><p>About</p><div><div><b>TCIN:</b> ', {_SIZE}, '</div><div><b>Material</b>: ', p_type, '</div></div></div>')
      else concat('<div data-test="{S.SPEC_BOX}"><div><b>Dimensions (Overall):</b> ', {_SIZE}, ' in</div><hr><div><b>Shell Material</b>: ', p_type, '</div><div><b>Shell Material:</b> ', p_name, '</div><div>no bold: x</div><div><b>Empty:</b></div><div data-test="{S.SPEC_DISCLAIMER}"><b>After</b>: y</div><div><b>Late</b>: z</div></div>') end""",
    f"""case p_partkey % 3
      when 0 then concat('<div><h2>Fit &amp; style</h2><p>Measurements: ', {_SIZE}, ' in Strap drop ', {_SIZE}, '</p></div>')
      when 2 then concat('<div><h2>Fit &amp; style</h2><p>Roomy ', p_name, '</p></div>')
      else '' end""",
    f"""case when p_partkey % 6 = 0 then '' else concat('<a data-test="{S.SELLER_LINK}">Sold by ', p_brand, '</a>') end""",
    f"""case when p_partkey % 5 = 2 then '' else concat('<div class="{S.CAROUSEL_CLASS} z"><a class="{S.CHIP_CLASS}">', case when p_partkey % 2 = 0 then upper(replace(p_name, ' ', '-')) else p_brand end, '</a><a class="y {S.CHIP_CLASS}"></a></div>') end""",
    f"""case p_partkey % 3
      when 0 then concat('<span aria-label="', cast({_RATING} as string), ' out of 5 stars"></span><span> ', {_SIZE}, ' </span>')
      when 1 then concat('<span aria-label="', cast({_RATING} as string), ' out of 5 stars"></span><span>', {_SIZE}, ' reviews</span>')
      else '' end""",
    f"""case when p_partkey % 3 = 2 then concat('<button data-test="@web/{S.SPEC_SECTION}">Specs</button><div data-test="{S.SPEC_CONTENT}"><div>Main Material: ', p_type, '</div><div>UPC: ', {_ID}, '</div><div>Dimensions:', {_SIZE}, ':1</div><div>plain</div><div>Closure Type: zip</div></div>') else '' end""",
    f"""case when p_partkey % 5 = 1 then concat('<div data-test="{S.VARIATION}-x"><a aria-label="Color, ', p_brand, ', x"></a><a aria-label="Color, ', p_brand, '"></a><a aria-label="Size, M"></a></div>') else '' end""",
)

VIEWS = {
    # 10% duplicate ids, 2% missing ids, 4% empty documents
    "raw_products": """
        select case when doc_id % 50 = 0 then '' when doc_id % 10 = 9 then cast(doc_id - 1 as string)
                 else cast(doc_id as string) end as product_id,
               case when doc_id % 25 = 3 then '' else left(text, 40) end as title,
               case when doc_id % 25 = 3 then '' else source end as brand,
               case when doc_id % 25 = 3 then null else text end as description,
               case when doc_id % 25 = 3 then '' else lang end as material_text,
               cast(doc_id % 97 as double) as price_current, doc_id % 3 <> 0 as in_stock,
               doc_id as ord
        from {documents}""",
    # one row per order line; times tie per product
    "offers": """
        select cast(l_partkey as string) as product_id,
               cast(l_extendedprice as decimal(12,2)) as price_regular,
               cast(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2)))
                 as decimal(12,2)) as price_current,
               l_discount > 0 as is_sale, l_shipdate as scraped_at, l_orderkey, l_linenumber
        from {lineitem}""",
    "snapshots": "select *, date_trunc('month', scraped_at) as run_ts from {offers}",
    "catalog": f"""
        select cast(p_partkey as string) as product_id, p_name as title, p_brand as brand,
               p_type as material_text, {_URL} as url, p_retailprice as price_current,
               {_RATING} as rating, p_size as rating_count, p_size <= 5 as is_new,
               concat('Root > ', p_type, ' > ', p_brand) as category_breadcrumb, p_partkey as ord
        from {{part}}""",
    # a quarter of the products missing; empty descriptions, zero prices, pipes-only colours
    "detail": f"""
        select {_URL} as url, case when p_partkey % 5 = 0 then '' else concat('About ', p_name) end as description,
               case when p_partkey % 7 = 0 then 0.0 else p_retailprice * 2 end as price_regular,
               case when p_partkey % 3 = 0 then '||' else concat(p_brand, '|', p_type) end as colors
        from {{part}} where p_partkey % 4 <> 0""",
    # a repeated key, and an empty value on even ids
    "specs": """
        select cast(p_partkey as string) as product_id,
               concat('Dimensions (Overall): ', cast(p_size as string), ' in', chr(10),
                 'Shell Material: ', p_type, chr(10), 'Closure Type: ', p_brand, chr(10),
                 'Material: ', case when p_partkey % 2 = 0 then '' else p_name end, chr(10),
                 'Shell Material: ', p_name, chr(10), 'TCIN: ', cast(p_partkey + 1000 as string)) as spec_text,
               p_name, p_brand, p_type, p_size, p_partkey
        from {part}""",
    "cards": f"""
        select p_partkey, p_name, p_brand, p_type, p_size, {_PRICE} as price,
               cast({_RATING} as double) as rating, {_HREF} as href, {_CARD} as html
        from {{part}}""",
    # no, one or two cards per page
    "listing_pages": """
        select p_partkey as page_id, p_name, p_brand, price,
               concat('<html><body><ul>', case when p_partkey % 5 = 0 then '' else html end, '<li>ad</li>',
                 case when p_partkey % 5 > 2 then html else '' end, '</ul></body></html>') as html
        from {cards}""",
    "detail_pages": f"""
        select p_partkey, p_name, p_brand, p_type, p_size, {_PRICE} as price,
               cast({_RATING} as double) as rating, {_URL} as url, {_DETAIL} as html
        from {{part}} where p_partkey % 4 <> 0""",
    # one in ten malformed, one in ten holding an explicit null
    "json_pages": f"""
        select event_id, user_id, event_type, value, props,
               concat('https://shop.example/p/', event_type, '/-/A-', cast(user_id as string)) as url,
               concat('<html><h1> ', event_type, ' </h1><p>Only $', cast(cast(value as decimal(10,2)) as string),
                 ' today</p><script id="{S.PAGE_JSON_ID}" type="application/json">',
                 case when event_id % 10 = 0 then chr(123) else '' end,
                 chr(123), '"props":', chr(123), '"pageProps":', chr(123), '"raw":', props, ',"product":', chr(123),
                 '"title":', case when event_id % 10 = 1 then 'null' when event_id % 10 = 2 then '""'
                   else concat('"', event_type, ' json"') end,
                 case when event_id % 3 = 0 then concat(',"price":', chr(123), '"formatted_current_price":"$', cast(user_id as string), '"', chr(125)) else '' end,
                 chr(125), chr(125), chr(125), chr(125), '</script></html>') as html
        from {{events}}""",
}


RENDERED = ("cards", "listing_pages", "detail_pages", "json_pages")


def _expand(text: str, table) -> str:
    def swap(match: re.Match) -> str:
        name = match.group(1)
        if name in VIEWS:
            return "(" + _expand(VIEWS[name], table) + ") as " + name
        return table(name)

    return re.sub(r"\{(\w+)\}", swap, text)


def view_sql(text: str) -> str:
    """SQL over the bare table names."""
    return _expand(text, lambda name: name)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the parquet tables of ``sf_dir``."""
    configure(spark)
    # markup is rendered row by row from narrow rows in few files: those are dealt out first
    deal = f"/*+ REPARTITION({spark.sparkContext.defaultParallelism}) */ " if name in RENDERED else None

    def table_sql(table: str) -> str:
        source = f"parquet.`{sf_dir}/{table}.parquet`"
        return f"(select {deal}* from {source})" if deal else source

    return spark.sql(_expand(VIEWS[name], table_sql))
