"""Queries for filters, joins, aggregates, dedup, limits, unions and quality checks."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from shelfspark import schema
from shelfspark.functions import nested as N
from shelfspark.functions import text as T
from shelfspark.operators import analytics as A
from shelfspark.operators import dedupe as D
from shelfspark.operators import merge as J
from shelfspark.operators import quality as Q
from shelfspark.operators.pages import product_links
from shelfspark.operators.ranged import with_rank
from shelfspark.plans.ingest import prepare
from shelfspark.plans.registry import query
from shelfspark.plans.text_queries import _ID_URL, DOCUMENT_SQL
from shelfspark.plans.views import load, view

# -- filters ----------------------------------------------------------------------------------


@query(
    "p1_product_cards",
    f"""select ord, u as url, t as title from (select ord, {_ID_URL} as u, case when ord % 6 = 0 then '' else title end as t from {{catalog}})
      where contains(u, '/A-') and t <> ''""",
)
def product_cards(spark, sf):
    title = F.when(F.col("ord") % 6 == 0, F.lit("")).otherwise(F.col("title"))
    c = view(spark, sf, "catalog").select("ord", F.expr(_ID_URL).alias("url"), title.alias("title"))
    return A.product_cards(c)


@query(
    "p2_product_urls",
    f"""select ord, u as url from (select ord, {_ID_URL} as u from {{catalog}})
      where regexp_matches(u, '^https?://shop[.]example/p/.+/-/A-[0-9]+')""",
)
def product_urls(spark, sf):
    c = view(spark, sf, "catalog").select("ord", F.expr(_ID_URL).alias("url"))
    return c.filter(T.is_product_url(F.col("url"), "shop.example"))


@query("p3_sale_items", "select product_id, price_current, price_regular from {offers} where is_sale")
def sale_items(spark, sf):
    return A.sale_items(view(spark, sf, "offers"), "product_id", "price_current", "price_regular")


@query("p4_high_rated", "select product_id, title, rating from {catalog} where rating >= 4.5")
def high_rated(spark, sf):
    return A.high_rated(view(spark, sf, "catalog")).select("product_id", "title", "rating")


@query("p5_new_items", "select product_id, title, rating_count from {catalog} where is_new")
def new_items(spark, sf):
    return A.new_items(view(spark, sf, "catalog")).select("product_id", "title", "rating_count")


FLAGGED_SQL = f"""
  with docs as ({DOCUMENT_SQL}),
  r as (select ord, product_id as id, document, row_number() over (partition by product_id order by ord) as rn
    from {{raw_products}} join docs using (ord))
  select ord, id, document, case when id = '' then '{D.MISSING}' when rn > 1 then '{D.DUPLICATE}'
    when document = '' then '{D.EMPTY}' end as reason from r"""


@query("p6_reject_reasons", f"select ord, id, reason from ({FLAGGED_SQL})")
def reject_reasons(spark, sf):
    return prepare(view(spark, sf, "raw_products"), "ord").select("ord", "id", "reason")


@query(
    "n1_canonical_columns",
    """select product_id, title, case when ord % 4 = 0 then null else url end as url, price_current,
      case when ord % 5 = 0 then null else rating_count end as rating_count,
      case when ord % 3 = 0 then null else brand || '/' || material_text end as images, cast(null as varchar) as brand,
      cast(31 as integer) as n_columns from {catalog}""",
)
def canonical_columns(spark, sf):
    o = F.col("ord")
    http = view(spark, sf, "catalog").select(
        F.col("product_id").alias("tcin"),
        F.concat(F.lit(" "), "title").alias("product_name"),
        F.when(o % 4 == 0, F.lit("N/A")).otherwise(F.col("url")).alias("product_url"),
        F.concat(F.lit("$"), F.col("price_current").cast("string")).alias("price"),
        F.when(o % 5 == 0, F.lit("N/A")).otherwise(F.col("rating_count").cast("string")).alias("review_count"),
        F.when(o % 3 == 0, F.lit("N/A")).otherwise(F.concat_ws("|", "brand", "material_text")).alias("all_images"),
        F.lit("ignored").alias("image_url"),
        F.lit("N/A").alias("brand"),
    )
    c = schema.to_canonical(http)
    return c.select(
        "product_id", "title", "url", "price_current", "rating_count",
        F.array_join("images", "/").alias("images"), "brand", F.lit(len(c.columns)).alias("n_columns"),
    )


# -- joins ------------------------------------------------------------------------------------


@query(
    "m1_merge_adv",
    """select c.product_id, c.title, case when d.description is not null and d.description <> '' then d.description else 'listed' end as description,
      case when d.price_regular > 0 then d.price_regular else cast(0 as double) end as price_regular, c.price_current,
      coalesce(d.colors, 'Blue') as colors, c.rating
      from (select * from {catalog}) as c left join (select * from {detail}) as d on c.url = d.url""",
)
def merge_adv(spark, sf):
    listing = view(spark, sf, "catalog").select(
        "product_id", "title", "url", "price_current", "rating",
        F.lit("listed").alias("description"), F.lit(0.0).alias("price_regular"), F.array(F.lit("Blue")).alias("colors"),
    )
    detail = view(spark, sf, "detail").withColumn("colors", F.split("colors", "[|]")).withColumn(
        "price_regular", F.col("price_regular").cast("double")
    )
    merged = J.merge_adv(listing, J.one_per_key(detail, "url"))
    return merged.withColumn("colors", F.array_join("colors", "|")).drop("url")


@query(
    "m2_merge_cmp",
    """with d as (select *, cast(regexp_extract(url, '/A-([0-9]+)', 1) as bigint) as k from {detail})
      select c.product_id, case when d.url is null then c.title when d.description = '' then 'N/A' else d.description end as product_name,
        case when d.price_regular > 0 then d.price_regular else c.price_current end as current_price,
        case when d.k % 2 = 0 then d.colors else 'N/A' end as colors,
        case when d.k % 3 = 0 then 'wool' when d.k % 3 = 1 then 'N/A' else 'listed' end as material_text,
        case when d.k % 3 = 0 then 'Care: wash' else 'N/A' end as feature_bullets, c.rating_count as review_count
      from (select * from {catalog}) as c left join d on c.url = d.url""",
)
def merge_cmp(spark, sf):
    listing = view(spark, sf, "catalog").select(
        "product_id", F.col("title").alias("product_name"), F.col("url").alias("product_url"),
        F.col("price_current").alias("current_price"), F.lit("N/A").alias("colors"),
        F.lit("listed").alias("material_text"), F.lit("N/A").alias("feature_bullets"), F.col("rating_count").alias("review_count"),
    )
    k = T.product_id_from_url(F.col("url")).cast("bigint")
    detail = view(spark, sf, "detail").select(
        F.col("url").alias("product_url"),
        F.coalesce(T.blank_to_null(F.col("description")), F.lit("N/A")).alias("title"),
        F.lit("N/A").alias("category_breadcrumb"),
        F.col("price_regular").cast("double").alias("current_price"),
        F.lit(None).cast("double").alias("regular_price"),
        F.lit(0.0).alias("rating"),
        F.lit(0).alias("review_count"),
        N.empty_list().alias("images"),
        F.when(k % 2 == 0, F.split("colors", "[|]")).otherwise(N.empty_list()).alias("colors"),
        F.when(k % 3 == 0, F.create_map(F.lit("Main Material"), F.lit("wool"), F.lit("Care"), F.lit("wash")))
        .when(k % 3 == 1, F.create_map(F.lit("TCIN"), F.lit("1")))
        .otherwise(N.empty_map())
        .alias("specifications"),
    )
    merged = J.merge_cmp(
        listing.select("*", *[F.lit("N/A").alias(c) for c in ("category_breadcrumb", "dimensions", "tcin", "upc", "all_images")],
                       F.lit(0.0).alias("regular_price"), F.lit(0.0).alias("rating")),
        detail,
    )
    return merged.select(
        "product_id", "product_name", "current_price", "colors", "material_text", "feature_bullets", "review_count"
    )


# -- aggregates -------------------------------------------------------------------------------


@query(
    "a1_mean_price_by_material",
    """select material_text, cast(sum(cast(price_current as decimal(12,2))) as double) / count(price_current) as mean_price from {catalog} group by material_text""",
)
def mean_price_by_material(spark, sf):
    return A.mean_price(view(spark, sf, "catalog"), by="material_text")


@query(
    "a2_mean_price",
    "select cast(sum(cast(price_current as decimal(12,2))) as double) / count(price_current) as mean_price from {catalog}",
)
def mean_price(spark, sf):
    return A.mean_price(view(spark, sf, "catalog"))


@query("a3_row_count", "select count(*) as n_rows from {offers}")
def row_count(spark, sf):
    return A.row_count(view(spark, sf, "offers"))


@query("a4_reject_counts", f"select coalesce(reason, 'accepted') as reason, count(*) as n from ({FLAGGED_SQL}) group by all")
def reject_counts(spark, sf):
    return D.reason_counts(prepare(view(spark, sf, "raw_products"), "ord"))


_FIELDS = ("product_id", "title", "brand", "description", "material_text", "price_current", "in_stock")


@query(
    "a5_completeness",
    " union all ".join(
        f"select '{c}' as field, count(*) as n_rows, cast(count_if({c} is not null{'' if c in ('price_current', 'in_stock') else f' and {c} <> chr(0) and length({c}) > 0'}) as bigint) as n_present, "
        f"cast(cast(count_if({c} is not null{'' if c in ('price_current', 'in_stock') else f' and length({c}) > 0'}) as bigint) as double) / count(*) as share from {{raw_products}}"
        for c in _FIELDS
    ),
)
def completeness(spark, sf):
    return A.completeness(view(spark, sf, "raw_products"), list(_FIELDS))


@query(
    "a6_shortest_text",
    """select conv_id, arg_min(text, (length(text), turn)) as text, cast(min(length(text)) as integer) as length from conversations group by conv_id""",
)
def shortest_text(spark, sf):
    return A.shortest(load(spark, sf, "conversations"), "conv_id", "text", "turn")


# -- dedup, history, limits -------------------------------------------------------------------


@query(
    "d1_keep_first",
    """select product_id, title, price_current, ord from (select *, row_number() over (partition by product_id order by ord) as rn
      from {raw_products} where product_id <> '') where rn = 1""",
)
def keep_first(spark, sf):
    r = view(spark, sf, "raw_products").filter("product_id <> ''")
    return D.keep_first(r.select("product_id", "title", "price_current", "ord"), "product_id", ["ord"])


@query(
    "d2_distinct_links",
    """with u as (select page_id, unnest(l) as href, generate_subscripts(l, 1) - 1 as pos from
        (select page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) as l from pages))
      select page_id, 'https://shop.example' || href as url, cast(min(pos) as integer) as pos from u group by page_id, href""",
)
def distinct_links(spark, sf):
    return product_links(load(spark, sf, "pages"), ["page_id"], "https://shop.example")


_TIES = ["l_orderkey", "l_linenumber", "price_regular", "price_current"]


@query(
    "d3_price_history",
    """select product_id, scraped_at, l_orderkey, l_linenumber, price_current,
      lag(price_current) over w as previous_price, cast(price_current - lag(price_current) over w as decimal(13,2)) as price_change
      from {snapshots} window w as (partition by product_id order by scraped_at, l_orderkey, l_linenumber, price_regular, price_current)""",
)
def price_history(spark, sf):
    columns = ["product_id", "scraped_at", "l_orderkey", "l_linenumber", "price_regular", "price_current"]
    s = view(spark, sf, "snapshots").select(*columns)
    return D.price_history(s, "product_id", "scraped_at", "price_current", _TIES).drop("price_regular")


@query(
    "d3_price_history_hot",
    """with s as (select *, case when l_orderkey % 3 = 0 then '0' else product_id end as id from {snapshots})
      select id, scraped_at, l_orderkey, l_linenumber, price_current, lag(price_current) over w as previous_price
      from s window w as (partition by id order by scraped_at, l_orderkey, l_linenumber, price_regular, price_current)""",
)
def price_history_hot(spark, sf):
    # one product holds a third of all rows
    s = view(spark, sf, "snapshots").select(
        F.when(F.col("l_orderkey") % 3 == 0, F.lit("0")).otherwise(F.col("product_id")).alias("id"),
        "scraped_at", "l_orderkey", "l_linenumber", "price_regular", "price_current",
    )
    h = D.price_history(s, "id", "scraped_at", "price_current", _TIES)
    return h.drop("price_regular", "price_change")


@query(
    "d3_price_history_null_ids",
    """with s as (select *, case when l_orderkey % 3 = 0 then null else product_id end as id from {snapshots})
      select id, scraped_at, l_orderkey, l_linenumber, price_current, lag(price_current) over w as previous_price
      from s window w as (partition by id order by scraped_at, l_orderkey, l_linenumber, price_regular, price_current)""",
)
def price_history_null_ids(spark, sf):
    # a third of all rows have no id
    s = view(spark, sf, "snapshots").select(
        F.when(F.col("l_orderkey") % 3 != 0, F.col("product_id")).alias("id"),
        "scraped_at", "l_orderkey", "l_linenumber", "price_regular", "price_current",
    )
    h = D.price_history(s, "id", "scraped_at", "price_current", _TIES)
    return h.drop("price_regular", "price_change")


_ORDERS_SQL = """
  with o as (select doc_id, 'k' || cast(doc_id % 40 as varchar) as id, case when doc_id % 40 < 15 then null when doc_id % 3 = 0 then null
      else doc_id // 120 end as ord, lang as document from documents)"""


def _open_orders(spark, sf):
    """Keys whose order values tie, are partly missing, or are all missing."""
    d = load(spark, sf, "documents")
    o = F.when((F.col("doc_id") % 40 < 15) | (F.col("doc_id") % 3 == 0), None).otherwise(F.floor(F.col("doc_id") / 120))
    return d.select("doc_id", F.concat(F.lit("k"), (F.col("doc_id") % 40).cast("string")).alias("id"), o.alias("ord"), F.col("lang").alias("document"))


@query(
    "p6_null_order",
    _ORDERS_SQL + """, f as (select id, min(ord) as first from o group by id)
      select id, cast(count(*) as bigint) as n, cast(1 as bigint) as accepted, first from o join f using (id) group by id, first""",
)
def null_order(spark, sf):
    flagged = D.with_reject_reason(_open_orders(spark, sf), "id", "ord", "document")
    return flagged.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("reason").isNull()) | (F.col("reason") == D.EMPTY)).alias("accepted"),
        F.min(F.when(F.col("reason").isNull(), F.col("ord"))).alias("first"),
    )


@query("p6_tied_order", """select reason, n from (select null as reason, count(distinct doc_id % 40) as n from documents
      union all select 'duplicate product_id', 2 * count(*) - count(distinct doc_id % 40) from documents) where n > 0""")
def tied_order(spark, sf):
    # every row comes twice, and all rows of an id tie
    rows = _open_orders(spark, sf).withColumn("ord", F.lit(1))
    flagged = D.with_reject_reason(rows.unionByName(rows), "id", "ord", "document")
    return flagged.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("d1_null_order", _ORDERS_SQL + " select id, min(ord) as ord, 1 as n_rows from o group by id")
def first_null_order(spark, sf):
    kept = D.keep_first(_open_orders(spark, sf), "id", ["ord"])
    return kept.groupBy("id").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).cast("int").alias("n_rows"))


@query("d4_null_order", _ORDERS_SQL + " select id, max(ord) as ord, 1 as n_rows from o group by id")
def latest_null_order(spark, sf):
    kept = D.keep_latest(_open_orders(spark, sf), "id", ["ord"])
    return kept.groupBy("id").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).cast("int").alias("n_rows"))


@query(
    "d4_latest_record",
    """select product_id, scraped_at, price_current, l_orderkey, l_linenumber from (
      select *, row_number() over (partition by product_id order by scraped_at desc, l_orderkey desc, l_linenumber desc, price_regular desc, price_current desc) as rn
      from {snapshots}) where rn = 1""",
)
def latest_record(spark, sf):
    s = view(spark, sf, "snapshots").select(
        "product_id", "scraped_at", "price_current", "l_orderkey", "l_linenumber", "price_regular"
    )
    return D.keep_latest(s, "product_id", ["scraped_at", *_TIES]).drop("price_regular")


@query(
    "d5_before_marker_rows",
    """with f as (select conv_id, min(turn) as stop from conversations where contains(text, 'thing') group by conv_id)
      select c.conv_id, turn, role from conversations c left join f using (conv_id) where stop is null or turn < stop""",
)
def before_marker_rows(spark, sf):
    c = load(spark, sf, "conversations")
    marked = D.before_marker_rows(c, "conv_id", "turn", F.contains("text", F.lit("thing")))
    return marked.select("conv_id", "turn", "role")


@query(
    "d5_before_marker_array",
    """with w as (select conv_id, turn, string_split(text, ' ') as ws from conversations),
      p as (select conv_id, turn, ws, list_position(list_transform(ws, lambda x: starts_with(x, 'on')), true) as stop from w)
      select conv_id, turn, array_to_string(case when stop > 0 then list_slice(ws, 1, stop - 1) else ws end, ' ') as kept from p""",
)
def before_marker_array(spark, sf):
    kept = N.before_marker(F.split("text", " "), lambda w: w.startswith("on"))
    return load(spark, sf, "conversations").select("conv_id", "turn", F.array_join(kept, " ").alias("kept"))


@query(
    "l1_first_products",
    """select n, product_id, ord from (select * from {catalog}) c, (select unnest(['none', 'ten', 'zero adv', 'all']) as n) m
      where n in ('zero adv', 'all') or (n = 'ten' and ord in (select ord from {catalog} order by ord limit 10))
      union all select 'most', cast(l_orderkey as varchar), l_linenumber from (
        select l_orderkey, l_linenumber from lineitem order by l_orderkey, l_linenumber limit (select count(*) * 6 // 10 from lineitem))""",
)
def first_products(spark, sf):
    c = view(spark, sf, "catalog").select("product_id", "ord")
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")

    def labelled(name, n, zero_means_all=True):
        return D.first_n(c, n, ["ord"], zero_means_all).select(F.lit(name).alias("n"), "product_id", "ord")

    return D.union_all(
        labelled("ten", 10), labelled("zero adv", 0), labelled("none", 0, False), labelled("all", None),
        D.first_n(lines, lines.count() * 6 // 10, ["l_orderkey", "l_linenumber"]).select(
            F.lit("most").alias("n"), F.col("l_orderkey").cast("string").alias("product_id"), F.col("l_linenumber").cast("bigint").alias("ord")
        ),
    )


@query("l2_first_pages", "select page_id, url from pages where page_id + 1 <= 30")
def first_pages(spark, sf):
    pages = load(spark, sf, "pages").withColumn("page_num", F.col("page_id") + 1)
    return D.first_pages(pages, 30).select("page_id", "url")


@query(
    "l3_encounter_order",
    """with u as (select page_id, unnest(l) as href, generate_subscripts(l, 1) - 1 as pos from
        (select page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) as l from pages)),
      f as (select page_id, href, min(pos) as pos from u group by page_id, href)
      select page_id, 'https://shop.example' || href as url, row_number() over (partition by page_id order by pos) as place from f""",
)
def encounter_order(spark, sf):
    # the places that the kept positions give are the order in which links were first met
    links = product_links(load(spark, sf, "pages"), ["page_id"], "https://shop.example")
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    return links.select("page_id", "url", place.alias("place"))


@query(
    "l3_global_rank",
    """with u as (select page_id, unnest(l) as href, generate_subscripts(l, 1) - 1 as pos from
        (select page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) as l from pages)),
      f as (select page_id, href, min(pos) as pos from u group by page_id, href)
      select page_id, 'https://shop.example' || href as url, row_number() over (order by page_id, pos) as place from f""",
)
def global_rank(spark, sf):
    links = product_links(load(spark, sf, "pages"), ["page_id"], "https://shop.example")
    return with_rank(links, ["page_id", "pos"], "place").select("page_id", "url", "place")


# -- unions -----------------------------------------------------------------------------------


@query("u1_union_pages", "select product_id, title, ord from {catalog} union all select product_id, title, ord from {catalog} where ord % 2 = 0")
def union_pages(spark, sf):
    c = view(spark, sf, "catalog").select("product_id", "title", "ord")
    even = c.filter("ord % 2 = 0")
    return D.union_all(even, c.filter("ord % 2 <> 0"), even)


@query(
    "u2_union_runs",
    """select product_id, title, case when ord % 2 = 1 then material_text end as material_text, case when ord % 2 = 1 then category_breadcrumb end as category_breadcrumb from {catalog}""",
)
def union_runs(spark, sf):
    c = view(spark, sf, "catalog").select("product_id", "title", "material_text", "category_breadcrumb", "ord")
    early = c.filter("ord % 2 = 0").drop("ord", *schema.LATER_COLUMNS)
    return D.union_runs(early, c.filter("ord % 2 = 1").drop("ord"))


@query(
    "u3_same_rows",
    """select product_id, 'only second' as side from {catalog} where ord % 40 = 1 union all
      select product_id, 'only first' as side from {catalog} where ord % 40 = 0""",
)
def same_rows(spark, sf):
    c = view(spark, sf, "catalog").select("product_id", "ord")
    first = c.filter("ord % 40 <> 1").select("product_id", F.when(F.col("ord") % 40 == 0, "only first").otherwise("both").alias("side"))
    second = c.filter("ord % 40 <> 0").select("product_id", F.when(F.col("ord") % 40 == 1, "only second").otherwise("both").alias("side"))
    return D.same_rows(first, second)


# -- quality ----------------------------------------------------------------------------------


@query(
    "q1_unique_ids",
    """select 'unique_ids' as "check", count(*) as n_rows, count(nullif(product_id, '')) - count(distinct nullif(product_id, '')) as n_bad from {raw_products}""",
)
def unique_ids(spark, sf):
    return Q.duplicate_ids(view(spark, sf, "raw_products"))


@query(
    "q2_q5_row_checks",
    """with r as (select case when ord % 7 = 0 then 'n/a' else cast(price_current as varchar) end as p, case when ord % 11 = 0 then title else '2024-01-02T03:04:05' end as t,
        ord % 60 / 10.0 as rating, case when ord % 5 = 0 then 'http://x' else 'https://x' end as u from {raw_products}),
      n as (select count(*) as n_rows, cast(count_if(coalesce(try_cast(p as double), 0) <= 0) as bigint) as price, cast(count_if(rating not between 0 and 5) as bigint) as rating,
        cast(count_if(not starts_with(u, 'https://')) as bigint) as url, cast(count_if(try_cast(t as timestamp) is null) as bigint) as time from r)
      select 'price' as "check", n_rows, price as n_bad from n union all select 'rating', n_rows, rating from n
      union all select 'url', n_rows, url from n union all select 'time', n_rows, time from n""",
)
def row_checks(spark, sf):
    o = F.col("ord")
    r = view(spark, sf, "raw_products").select(
        F.when(o % 7 == 0, F.lit("n/a")).otherwise(F.col("price_current").cast("string")).alias("p"),
        F.when(o % 11 == 0, F.col("title")).otherwise(F.lit("2024-01-02T03:04:05")).alias("t"),
        (o % 60 / 10).alias("rating"),
        F.when(o % 5 == 0, F.lit("http://x")).otherwise(F.lit("https://x")).alias("u"),
    )
    return Q.row_checks(
        r,
        {
            "price": Q.bad_price(F.col("p")),
            "rating": Q.bad_rating(F.col("rating")),
            "url": Q.bad_url(F.col("u")),
            "time": Q.bad_time(F.col("t")),
        },
    )


@query(
    "q2_positive_price",
    """select 'price' as "check", count(*) as n_rows, cast(count_if(price_current <= 0) as bigint) as n_bad from {raw_products}""",
)
def positive_price(spark, sf):
    return Q.row_checks(view(spark, sf, "raw_products"), {"price": Q.bad_price(F.col("price_current"))})


@query(
    "q2_finite_price",
    """with r as (select case when ord % 9 = 0 then 'NaN' when ord % 10 = 0 then 'Infinity' when ord % 11 = 0 then '-Infinity'
        else cast(price_current as varchar) end as p from {raw_products})
      select 'price' as "check", count(*) as n_rows, cast(count_if(not (coalesce(isfinite(try_cast(p as double)), false) and try_cast(p as double) > 0)) as bigint) as n_bad from r""",
)
def finite_price(spark, sf):
    o = F.col("ord")
    odd = F.when(o % 9 == 0, "NaN").when(o % 10 == 0, "Infinity").when(o % 11 == 0, "-Infinity")
    r = view(spark, sf, "raw_products").select(F.coalesce(odd, F.col("price_current").cast("string")).alias("p"))
    return Q.row_checks(r, {"price": Q.bad_price(F.col("p"))})


@query(
    "q3_rating_range",
    """select 'rating' as "check", count(*) as n_rows, cast(count_if(rating * 1.2 not between 0 and 5) as bigint) as n_bad from {catalog}""",
)
def rating_range(spark, sf):
    c = view(spark, sf, "catalog").withColumn("rating", F.col("rating") * F.lit(1.2).cast("decimal(2,1)"))
    return Q.row_checks(c, {"rating": Q.bad_rating(F.col("rating"))})


@query("q4_https_url", """select 'url' as "check", count(*) as n_rows, cast(count_if(not starts_with(url, 'https://')) as bigint) as n_bad from pages""")
def https_url(spark, sf):
    return Q.row_checks(load(spark, sf, "pages"), {"url": Q.bad_url(F.col("url"))})


@query(
    "q5_iso_time",
    """select 'time' as "check", count(*) as n_rows, cast(count_if(o_orderkey % 4 = 0) as bigint) as n_bad from orders""",
)
def iso_time(spark, sf):
    d = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(d, "MMM d yyyy")).otherwise(N.time_to_iso(d))
    return Q.row_checks(load(spark, sf, "orders"), {"time": Q.bad_time(text)})


@query(
    "q6_duplicate_rows",
    """with l as (select l_orderkey, l_linenumber from lineitem)
      select 'duplicate_rows' as "check", count(*) as n_rows, count(*) - (select count(*) from (select distinct * from l)) as n_bad from l""",
)
def duplicate_rows(spark, sf):
    return Q.duplicate_rows(load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"))


@query(
    "q6_duplicate_full_rows",
    """select 'duplicate_rows' as "check", count(*) as n_rows, count(*) - (select count(*) from (select distinct * from lineitem)) as n_bad from lineitem""",
)
def duplicate_full_rows(spark, sf):
    return Q.duplicate_rows(load(spark, sf, "lineitem"))


@query(
    "q7_breadcrumb_hierarchy",
    """with e as (select distinct 'Root' as node, '' as above from {catalog}
        union select material_text, 'Root' from {catalog} union select brand, 'Root > ' || material_text from {catalog}),
      n as (select node, count(*) as c from e group by node)
      select 'breadcrumb_hierarchy' as "check", count(*) as n_rows, cast(count_if(c > 1) as bigint) as n_bad from n""",
)
def breadcrumb_hierarchy(spark, sf):
    return Q.breadcrumb_hierarchy(view(spark, sf, "catalog"))


@query(
    "q7_region_hierarchy",
    """select 'breadcrumb_hierarchy' as "check", (select count(*) from region) + (select count(*) from nation) as n_rows, cast(0 as bigint) as n_bad""",
)
def region_hierarchy(spark, sf):
    # two fixed dimension tables; the customers make the paths
    nation, region = load(spark, sf, "nation"), load(spark, sf, "region")
    paths = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.concat_ws(" > ", "r_name", "n_name").alias("category_breadcrumb")
    )
    customers = load(spark, sf, "customer").join(paths, F.col("c_nationkey") == F.col("n_nationkey"))
    return Q.breadcrumb_hierarchy(customers)
