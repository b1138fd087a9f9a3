"""Queries for arrays, maps, variants, metadata and time."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions import nested as N
from shelfspark.plans.registry import query
from shelfspark.plans.text_queries import WS_SQL
from shelfspark.plans.views import load, view

_DOC = (
    "concat(chr(123), '\"a\":', chr(123), case event_id % 4 when 0 then concat('\"k\":', props, ',') "
    "when 1 then '\"k\":null,' else '' end, '\"z\":[', props, ']', chr(125), ',\"b\":', props, chr(125))"
)


@query(
    "x19_first_existing_path",
    """select event_id, case event_id % 4 when 0 then 'found' when 1 then 'null' else 'found' end as state,
      case event_id % 4 when 0 then cast(cast(props->>'$.k' as bigint) as varchar) when 1 then null
        else cast(cast(props->>'$.k' as bigint) as varchar) end as value, true as list_step_missing from events""",
)
def first_existing_path(spark, sf):
    # a.k.k or a.k (an explicit null in one of four rows), else b.k
    doc = F.try_parse_json(F.expr(_DOC))
    e = load(spark, sf, "events").select("event_id", doc.alias("doc"))
    picked = N.pick_first(F.col("doc"), [["a", "k", "k"], ["a", "k"], ["b", "k"]])
    missing = N.pick_first(F.col("doc"), [["a", "z", "0", "k"]])
    return e.select("event_id", picked.alias("v"), missing.isNull().alias("list_step_missing")).select(
        "event_id",
        F.when(F.col("v").isNull(), "missing").when(F.is_variant_null("v"), "null").otherwise("found").alias("state"),
        N.variant_text(F.col("v")).alias("value"),
        "list_step_missing",
    )


@query(
    "x24_description_without_bullets",
    f"""with l as (select conv_id, turn, text, trim(string_split(text, chr(10))[1], {WS_SQL}) as first_line from conversations)
    select conv_id, turn,
      case when turn % 3 = 2 then 'Fit & style' || 'Roomy and light'
           when length(lower(trim(first_line, {WS_SQL}))) > 15 then 'Fit & style'
           else 'Fit & style' || first_line end as description from l""",
)
def description_without_bullets(spark, sf):
    # the block repeats the first line, except in every third turn
    c = load(spark, sf, "conversations")
    first = N.strip(F.get(F.split("text", "\n"), F.lit(0)))
    body = F.when(F.col("turn") % 3 == 2, F.lit("Roomy and light")).otherwise(first)
    block = F.concat(F.lit(N.DESCRIPTION_HEADING), body)
    return c.select(
        "conv_id", "turn", N.description_without_bullets(block, F.array(first)).alias("description")
    )


@query(
    "x25_ordered_distinct",
    """with w as (select conv_id, turn, string_split(text, ' ') as ws from conversations),
    u as (select conv_id, turn, unnest(ws) as word, generate_subscripts(ws, 1) as pos from w),
    d as (select conv_id, turn, word, min(pos) as pos from u where word <> '' group by all),
    r as (select *, row_number() over (partition by conv_id, turn order by pos) as n from d)
    select conv_id, turn, coalesce(string_agg(word, '|' order by pos) filter (n <= 15), '') as words, cast(count(word) as integer) as n
    from (select conv_id, turn from conversations) c left join r using (conv_id, turn) group by conv_id, turn""",
)
def ordered_distinct(spark, sf):
    words = F.split("text", " ")
    return load(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.array_join(N.distinct_non_empty(words, 15), "|").alias("words"),
        F.size(N.distinct_non_empty(words)).alias("n"),
    )


def _specs(spark, sf):
    rows = F.split("spec_text", "\n")
    return view(spark, sf, "specs").withColumn("specs", N.spec_rows_to_map(rows))


@query(
    "x27_value_by_word",
    """select product_id, cast(p_size as varchar) || ' in' as dimensions, p_name as material,
      cast(p_partkey + 1000 as varchar) as tcin, cast(null as varchar) as upc from {specs}""",
)
def value_by_word(spark, sf):
    return _specs(spark, sf).select(
        "product_id",
        *[N.value_by_word(F.col("specs"), w).alias(w) for w in ("dimensions", "material", "tcin", "upc")],
    )


_DIMENSION_TEXT = (
    "concat('Overall Dimensions: ', cast(p_size as string), chr(10), 'Shell Height: 1', chr(10), 'Handle Height: ', p_name, "
    "chr(10), 'Width: ', p_type, chr(10), 'Strap Depth: 9', chr(10), case when p_partkey % 3 = 0 then 'Lining Material: silk' "
    "when p_partkey % 3 = 1 then 'Shell: felt' else 'Care: wash' end)"
)


@query(
    "x28_dimension_classes",
    """select product_id, cast(p_size as varchar) as dimensions_overall, p_name as height, p_type as width, '9' as depth,
      case p_partkey % 3 when 0 then 'silk' when 1 then 'felt' else '' end as material_text, cast(4 as integer) as n from {specs}""",
)
def dimension_classes(spark, sf):
    s = view(spark, sf, "specs").withColumn("m", N.spec_rows_to_map(F.split(F.expr(_DIMENSION_TEXT), "\n")))
    d = s.withColumn("d", N.dimension_table(F.col("m")))
    return d.select(
        "product_id",
        *[F.col("d")[k].alias(k) for k in ("dimensions_overall", "height", "width", "depth")],
        N.material_of(F.col("m")).alias("material_text"),
        F.size("d").alias("n"),
    )


_MATERIAL_TEXT = (
    "case p_partkey % 3 when 0 then concat('Material Height: ', p_type, chr(10), 'Material Width: x') "
    "when 1 then concat('Shell: ', p_name) else 'Care: wash' end"
)


@query(
    "x29_material_fallback",
    """select product_id, case p_partkey % 3 when 0 then p_type when 1 then p_name else '' end as material_text from {specs}""",
)
def material_fallback(spark, sf):
    s = view(spark, sf, "specs").withColumn("m", N.spec_rows_to_map(F.split(F.expr(_MATERIAL_TEXT), "\n")))
    return s.select("product_id", N.material_of(F.col("m")).alias("material_text"))


@query(
    "x30_dimensions_overlay",
    """select product_id, case when p_partkey % 2 = 0 then 'Measurements 2: ' || p_name end as measurements,
      'Strap DROP ' || cast(p_size as varchar) as handle_drop, cast(p_size as varchar) || ' in' as dimensions_overall from {specs}""",
)
def dimensions_overlay(spark, sf):
    bullets = F.array(
        F.when(F.col("p_partkey") % 2 == 0, F.lit("measurements 1")).otherwise(F.lit("soft")),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Measurements 2: "), "p_name")).otherwise(F.lit("light")),
        F.concat(F.lit("Strap DROP "), F.col("p_size").cast("string")),
    )
    d = _specs(spark, sf).withColumn("d", N.dimensions_from(bullets, N.dimension_table(F.col("specs"))))
    return d.select(
        "product_id", *[F.col("d")[k].alias(k) for k in ("measurements", "handle_drop", "dimensions_overall")]
    )


@query(
    "x31_spec_features",
    """select product_id, 'Closure Type: ' || p_brand as features from {specs}""",
)
def spec_features(spark, sf):
    return _specs(spark, sf).select(
        "product_id", F.array_join(N.spec_features(F.col("specs")), "|").alias("features")
    )


METADATA_SQL = f"""
  select ord, nullif(product_id, '') as product_id, case when title <> '' then left(trim(title, {WS_SQL}), 500) end as title,
    nullif(brand, '') as brand, price_current, in_stock,
    cast((product_id <> '')::int + (title <> '')::int + (brand <> '')::int + 2 as integer) as n_keys from {{raw_products}}"""


@query("x32_flat_metadata", METADATA_SQL)
def flat_metadata(spark, sf):
    r = view(spark, sf, "raw_products")
    m = r.select("ord", N.flat_metadata(r).alias("m"))
    parsed = F.from_json("m", "product_id string, title string, brand string, price_current double, in_stock boolean")
    return m.select("ord", F.size(F.json_object_keys("m")).alias("n_keys"), parsed.alias("p")).select("ord", "p.*", "n_keys")


@query(
    "x33_iso_time",
    """select o_orderkey, o_orderdate as t, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as iso, o_orderkey % 4 = 0 as rejected from orders""",
)
def iso_time(spark, sf):
    o = load(spark, sf, "orders").withColumn("iso", N.time_to_iso(F.col("o_orderdate")))
    odd = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.col("iso"))
    return o.select(
        "o_orderkey",
        N.iso_to_time(F.col("iso")).alias("t"),
        "iso",
        N.iso_to_time(odd).isNull().alias("rejected"),
    )


@query("x34_run_label", "select o_orderkey, strftime(o_orderdate, '%Y%m%d_%H%M%S') as run from orders")
def run_label(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", N.run_label(F.col("o_orderdate")).alias("run"))
