"""Queries for vectors: normalising, encoding, fusing, and the ingest job end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfspark.functions.vectors import l2_normalize, norm
from shelfspark.operators import embed as E
from shelfspark.operators.dedupe import accepted
from shelfspark.operators.merge import with_image_vectors
from shelfspark.plans.catalog_queries import FLAGGED_SQL
from shelfspark.plans.ingest import embed, prepare
from shelfspark.plans.registry import query
from shelfspark.plans.text_queries import CUT_SQL, WS_SQL
from shelfspark.plans.views import load, view


def _norm_sql(v: str) -> str:
    return f"sqrt(list_reduce(list_transform({v}, lambda x: cast(x as double) * cast(x as double)), lambda a, b: a + b, cast(0 as double)))"


@query(
    "v1_l2_normalize",
    f"""with s as (select vec_id, list_transform(embedding, lambda x: case when vec_id % 10 = 0 then cast(0 as float) else x * 3 end) as v from embeddings),
      n as (select vec_id, v, nullif({_norm_sql('v')}, 0) as n from s)
      select vec_id, cast(generate_subscripts(v, 1) - 1 as integer) as pos, unnest(list_transform(v, lambda x: cast(x as double) / n)) as value, n is null as no_direction from n""",
)
def v1(spark, sf):
    e = load(spark, sf, "embeddings")
    scaled = F.transform(
        "embedding", lambda x: F.when(F.col("vec_id") % 10 == 0, F.lit(0.0).cast("float")).otherwise(x * F.lit(3).cast("float"))
    )
    s = e.select("vec_id", scaled.alias("v"))
    u = l2_normalize(F.col("v"))
    # a vector without a direction has no unit vector: 64 missing elements
    unit = F.coalesce(u, F.array_repeat(F.lit(None).cast("double"), 64))
    return s.select("vec_id", F.posexplode(unit).alias("pos", "value"), (norm(F.col("v")) == 0).alias("no_direction"))


# words of the cut text by hashed bucket: the encoder's own definition as SQL
_WORDS_SQL = f"""
  with t as (select id, {CUT_SQL} as t from (select doc_id as id, text as t from documents)),
  w as (select id, list_filter(string_split_regex(t, '[ \\t\\r\\n]+'), lambda x: x <> '')[1:77] as ws from t),
  u as (select id, unnest(ws) as word from w),
  b as (select id, cast('0x' || left(md5(word), 6) as integer) % 64 as bucket, count(*) as c from u group by all),
  n as (select id, sqrt(sum(c * c)) as n from b group by id)"""


@query(
    "v2_text_vectors",
    _WORDS_SQL + "select id as doc_id, cast(bucket as integer) as bucket, c / n as weight from b join n using (id)",
)
def v2(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.col("text").alias("document"))
    v = E.text_vectors(d).select("doc_id", F.posexplode("text_vector").alias("bucket", "weight"))
    return v.filter(F.col("weight") > 0)


@query(
    "g1_pluggable_encoder",
    f"""with t as (select doc_id, coalesce(nullif({CUT_SQL}, ''), ' ') as t from (select doc_id, text as t from documents)),
      n as (select doc_id, cast(length(t) as double) as a, cast(length(t) - length(replace(t, ' ', '')) as double) as b from t)
      select doc_id, a / sqrt(0 + a * a + b * b) as first, b / sqrt(0 + a * a + b * b) as second from n""",
)
def pluggable_encoder(spark, sf):
    def factory():
        return lambda texts: [[len(t), t.count(" ")] for t in texts]

    d = load(spark, sf, "documents").select("doc_id", F.col("text").alias("document"))
    v = E.text_vectors(d, factory=factory)
    return v.select("doc_id", F.get("text_vector", F.lit(0)).alias("first"), F.get("text_vector", F.lit(1)).alias("second"))


_PAIRS_SQL = """(select t.vec_id as id, t.embedding as a, i.embedding as b from embeddings t
  left join embeddings i on i.vec_id = t.vec_id + 1 and t.vec_id % 2 = 0)"""


def _pairs(spark, sf):
    e = load(spark, sf, "embeddings")
    text = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("text_vector"))
    image = e.filter("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("image_vector"))
    return text, image


@query(
    "m3_image_vectors",
    f"""select id, b is not null as has_image, cast(p as integer) as pos, b[p + 1] as value
      from {_PAIRS_SQL}, (select unnest(range(64)) as p) where b is not null or p = 0""",
)
def m3(spark, sf):
    joined = with_image_vectors(*_pairs(spark, sf))
    return joined.select(
        "id",
        F.col("image_vector").isNotNull().alias("has_image"),
        F.posexplode(F.coalesce("image_vector", F.array(F.lit(None).cast("float")))).alias("pos", "value"),
    )


@query(
    "v3_fused_vectors",
    f"""with p as {_PAIRS_SQL},
      m as (select id, b is null as text_only, case when b is null then list_transform(a, lambda x: cast(x as double))
        else list_transform(list_zip(a, b), lambda z: (cast(z[1] as double) + cast(z[2] as double)) / 2) end as v from p),
      n as (select *, case when text_only then cast(1 as double) else {_norm_sql('v')} end as n from m)
      select id, cast(generate_subscripts(v, 1) - 1 as integer) as pos, unnest(list_transform(v, lambda x: cast(x / n as float))) as value from n""",
)
def v3(spark, sf):
    fused = E.fused_vectors(*_pairs(spark, sf), "id")
    return fused.select("id", F.posexplode("embedding").alias("pos", "value"))


@query("v4_text_only", "select vec_id as id, cast(generate_subscripts(embedding, 1) - 1 as integer) as pos, unnest(embedding) as value from embeddings")
def v4(spark, sf):
    text, _ = _pairs(spark, sf)
    f = E.fused_vectors(text, None)
    return f.select("id", F.posexplode("embedding").alias("pos", "value"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product rows to collection rows (id, embedding, document, metadata)."""
    return embed(accepted(prepare(view(spark, sf_dir, "raw_products"), "ord")))


@query(
    "ingest_pipeline",
    f"""select id, f.document, left(title, 40) as title, cast(64 as integer) as n_dims from ({FLAGGED_SQL}) f
      join (select ord, trim(title, {WS_SQL}) as title from {{raw_products}}) p using (ord) where reason is null""",
)
def ingest_pipeline(spark, sf):
    rows = flagship(spark, sf)
    return rows.select(
        "id", "document", F.get_json_object("metadata", "$.title").alias("title"), F.size("embedding").alias("n_dims")
    )
