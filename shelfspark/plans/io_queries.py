"""Queries that write to the shared folder and read back: sources, sinks, tables, arrivals."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from shelfspark import schema
from shelfspark.operators.dedupe import union_all
from shelfspark.plans.ingest import run_ingest
from shelfspark.plans.registry import query
from shelfspark.plans.catalog_queries import FLAGGED_SQL
from shelfspark.plans.views import load, view
from shelfspark.session import scratch
from shelfspark.sources import codec, readers, writers
from shelfspark.streaming.arrivals import ingest_arrivals

_BASIC = ("product_id", "title", "brand", "url", "price_current", "rating_count", "is_new")
_BASIC_SQL = "select " + ", ".join(_BASIC) + " from {catalog}"


def _rows(spark, sf):
    return view(spark, sf, "catalog").select(*_BASIC, F.concat(F.lit('say "hi", '), "title", F.lit("\nü ")).alias("description"))


def _subset(*names: str) -> StructType:
    return StructType([f for f in schema.FILE_SCHEMA if f.name in names])


@query("s1_json_documents", _BASIC_SQL)
def json_documents(spark, sf):
    # a third of the files hold {"products": [...]}, the others a plain list
    rows = _rows(spark, sf)
    path = scratch(spark, "documents")
    writers.write_json_documents(rows.filter("rating_count % 3 = 0"), f"{path}/wrapped", "products")
    writers.write_json_documents(rows.filter("rating_count % 3 <> 0"), f"{path}/list")
    return readers.read_json(spark, f"{path}/*").select(*_BASIC)


@query("s2_jsonl_scan", _BASIC_SQL)
def jsonl_scan(spark, sf):
    path = scratch(spark, "lines") + ".jsonl"
    writers.write_jsonl(_rows(spark, sf), path)
    return readers.read_jsonl(spark, path).select(*_BASIC)


@query(
    "s3_csv_scan",
    "select cast(doc_id as varchar) as doc_id, text, case when doc_id % 2 = 0 then '' else lang end as lang, '' as nothing from documents",
)
def csv_scan(spark, sf):
    d = load(spark, sf, "documents")
    path = scratch(spark, "texts") + ".csv"
    lang = F.when(F.col("doc_id") % 2 == 0, F.lit("")).otherwise(F.col("lang"))
    writers.write_csv(d.select("doc_id", "text", lang.alias("lang"), F.lit(None).cast("string").alias("nothing")), path)
    return readers.read_csv(spark, path)


@query(
    "s4_reader_by_suffix",
    " union all ".join(
        f"select '{kind}' as kind, product_id, title, cast(rating_count as varchar) as rating_count from {{catalog}}" for kind in ("json", "jsonl", "csv")
    ),
)
def reader_by_suffix(spark, sf):
    rows = _rows(spark, sf)
    path = scratch(spark, "suffix")
    writers.write_json_documents(rows, f"{path}.JSON")
    writers.write_jsonl(rows, f"{path}.jsonl")
    writers.write_csv(rows, f"{path}.Csv")
    return union_all(
        *[
            readers.read_products(spark, path + suffix).select(
                F.lit(suffix[1:].lower()).alias("kind"), "product_id", "title", F.col("rating_count").cast("string").alias("rating_count")
            )
            for suffix in (".JSON", ".jsonl", ".Csv")
        ]
    )


@query(
    "s5_snapshot_scan",
    """select product_id, title, case when ord % 3 = 0 then null else material_text end as material_text,
      case when ord % 3 = 0 then null else is_new end as best_seller, cast(32 as integer) as n_columns from {catalog}""",
)
def snapshot_scan(spark, sf):
    c = view(spark, sf, "catalog")
    path = scratch(spark, "drift")
    full = schema.to_canonical(c.withColumn("best_seller", F.col("is_new")).drop("ord"))
    keyed = codec.to_file_rows(full).withColumn("_early", F.col("product_id").cast("bigint") % 3 == 0)
    early = keyed.filter("_early").drop("_early", *schema.LATER_COLUMNS)
    writers.write_jsonl(early, f"{path}/run1")
    writers.write_jsonl(keyed.filter("not _early").drop("_early"), f"{path}/run2")
    s = readers.read_snapshots(spark, path)
    return s.select("product_id", "title", "material_text", "best_seller", F.lit(len(s.columns)).alias("n_columns"))


_DRIFTED_SQL = """(select product_id, case when ord % 3 = 0 then 'shelf ' || cast(ord as varchar) end as shelf,
  case when ord % 3 = 1 then 'about ' || cast(ord % 5 as varchar) end as rating from {catalog})"""


def _drifted(spark, sf):
    """Early runs know a key that the schema lacks, later ones write some ratings as words."""
    rows = view(spark, sf, "catalog").select("product_id", F.col("ord").cast("bigint").alias("ord"))
    path = scratch(spark, "drifted")
    shelf = F.when(F.col("ord") % 3 == 0, F.concat(F.lit("shelf "), F.col("ord").cast("string"))).alias("shelf_mark")
    early = rows.filter("ord % 3 <> 1").select("product_id", shelf, F.lit(4.5).alias("rating_avg"))
    words = F.concat(F.lit("about "), (F.col("ord") % 5).cast("string")).alias("rating_avg")
    writers.write_jsonl(early, f"{path}/early")
    writers.write_jsonl(rows.filter("ord % 3 = 1").select("product_id", words), f"{path}/late")
    return readers.read_drifting(spark, path, DRIFT_SCHEMA)


DRIFT_SCHEMA = StructType([StructField("product_id", StringType()), StructField("rating_avg", DoubleType())])


@query(
    "s5_rescued_values",
    f"""select product_id, shelf, rating, cast((shelf is not null)::int + (rating is not null)::int as integer) as n_rescued from {_DRIFTED_SQL}""",
)
def rescued_values(spark, sf):
    r = F.col("rescued")
    return _drifted(spark, sf).select(
        "product_id",
        F.try_element_at(r, F.lit("shelf_mark")).alias("shelf"),
        F.try_element_at(r, F.lit("rating_avg")).alias("rating"),
        F.size(r).alias("n_rescued"),
    )


@query(
    "u2_drift_report",
    f"""select 'shelf_mark' as key, 'unknown' as kind, cast(count(*) as bigint) as n_rows from {_DRIFTED_SQL} where shelf is not null having count(*) > 0
      union all select 'rating_avg', 'mistyped', cast(count(*) as bigint) from {_DRIFTED_SQL} where rating is not null having count(*) > 0""",
)
def drift_by_key(spark, sf):
    found = readers.drift_report(_drifted(spark, sf), DRIFT_SCHEMA)
    return found.groupBy("key", "kind").agg(F.sum("n_rows").alias("n_rows"))


@query("s6_page_scan", "select page_id, url, cast(length(html) as integer) as n_chars from pages")
def page_scan(spark, sf):
    load(spark, sf, "pages")
    return readers.read_pages(spark, f"{sf}/pages.parquet").select("page_id", "url", F.length("html").alias("n_chars"))


@query("s7_run_ingest", f"select id, document from ({FLAGGED_SQL}) where reason is null")
def ingest_job(spark, sf):
    path = scratch(spark, "input") + ".jsonl"
    r = view(spark, sf, "raw_products")
    writers.write_jsonl(r.withColumn("scraped_at", F.format_string("%012d", "ord")).drop("ord"), path)
    collection, _ = run_ingest(
        spark, path, collection="shelf", collection_root=scratch(spark, "roots"), use_images=False
    )
    return spark.read.parquet(collection).select("id", "document")


@query("s7_ingest_twice_by_name", f"select id, count(*) as n from ({FLAGGED_SQL}) where reason is null group by id")
def ingest_twice(spark, sf):
    """Two runs of one input into a collection that is found again by its name."""
    path = scratch(spark, "input") + ".jsonl"
    r = view(spark, sf, "raw_products")
    writers.write_jsonl(r.withColumn("scraped_at", F.format_string("%012d", "ord")).drop("ord"), path)
    root = scratch(spark, "roots")
    for _ in range(2):
        collection, _ = run_ingest(spark, path, collection="shelf", collection_root=root, use_images=False)
    return spark.read.parquet(collection).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("k1_json_sink", "select doc_id, text, lang from documents")
def json_sink(spark, sf):
    path = scratch(spark, "json")
    writers.write_json(load(spark, sf, "documents").select("doc_id", "text", "lang"), path)
    return spark.read.schema("doc_id bigint, text string, lang string").json(path)


@query("k2_jsonl_sink", "select conv_id, turn, role, text from conversations")
def jsonl_sink(spark, sf):
    path = scratch(spark, "jsonl")
    writers.write_jsonl(load(spark, sf, "conversations"), path)
    return readers.read_jsonl(spark, path, load(spark, sf, "conversations").schema)


@query(
    "k3_csv_sink",
    """select product_id, title, price_current, rating_count, is_new, false as empty_written from {catalog}""",
)
def csv_sink(spark, sf):
    rows = _rows(spark, sf)
    path = scratch(spark, "csv")
    writers.write_csv(rows, path)
    written = writers.write_csv(rows.filter("false"), path + "-empty")
    back = readers.as_typed(readers.read_csv(spark, path), _subset(*_BASIC))
    return back.select("product_id", "title", "price_current", "rating_count", "is_new", F.lit(written).alias("empty_written"))


@query(
    "k4_snapshot_sink",
    """with s as (select product_id, strftime(run_ts, '%Y%m%d_%H%M%S') as run_ts, price_current, l_orderkey, l_linenumber from {snapshots})
      select 'json' as kind, run_ts, product_id, l_orderkey, l_linenumber, cast(price_current as varchar) as price from s
      union all select 'csv', run_ts, product_id, l_orderkey, l_linenumber, cast(price_current as varchar) from s
      union all select 'latest', run_ts, product_id, l_orderkey, l_linenumber, cast(price_current as varchar) from s where run_ts = (select max(run_ts) from s)""",
)
def snapshot_sink(spark, sf):
    s = view(spark, sf, "snapshots").select("product_id", "run_ts", "price_current", "l_orderkey", "l_linenumber")
    path = scratch(spark, "runs")
    writers.write_snapshot(s, path)
    types = "product_id string, price_current decimal(12,2), l_orderkey bigint, l_linenumber int, run_ts string"

    def back(kind, df):
        return df.select(
            F.lit(kind).alias("kind"), "run_ts", "product_id", "l_orderkey", "l_linenumber", F.col("price_current").cast("string").alias("price")
        )

    csv = spark.read.schema(types).option("header", True).csv(f"{path}/csv")
    return union_all(
        back("json", spark.read.schema(types).json(f"{path}/json")),
        back("csv", csv),
        back("latest", spark.read.schema(types).json(f"{writers.latest_path(spark, path)}/json")),
    )


@query(
    "k4_rerun",
    """with s as (select product_id, strftime(run_ts, '%Y%m%d_%H%M%S') as run_ts, cast(price_current as varchar) as price from {snapshots})
      select 'json' as kind, run_ts, product_id, price from s union all select 'csv', run_ts, product_id, price from s""",
)
def snapshot_rerun(spark, sf):
    """All runs, then the last ones again: a run that is written again replaces itself."""
    s = view(spark, sf, "snapshots").select("product_id", "run_ts", "price_current")
    path = scratch(spark, "runs")
    writers.write_snapshot(s, path)
    writers.write_snapshot(s.filter(F.month("run_ts") > 6), path)
    types = "product_id string, price_current decimal(12,2), run_ts string"
    json, csv = spark.read.schema(types).json(f"{path}/json"), spark.read.schema(types).option("header", True).csv(f"{path}/csv")
    return union_all(
        *[
            rows.select(F.lit(kind).alias("kind"), "run_ts", "product_id", F.col("price_current").cast("string").alias("price"))
            for kind, rows in (("json", json), ("csv", csv))
        ]
    )


@query("k5_collection_sink", "select vec_id as id, case when vec_id % 3 = 0 then 'first' else 'second' end as document, cast(generate_subscripts(embedding, 1) - 1 as integer) as pos, unnest(embedding) as value from embeddings")
def collection_sink(spark, sf):
    e = load(spark, sf, "embeddings").withColumnRenamed("vec_id", "id").select("id", "embedding")
    path = scratch(spark, "collection")
    writers.add_to_collection(e.filter("id % 3 = 0").withColumn("document", F.lit("first")), path)
    second = e.withColumn("document", F.lit("second"))
    writers.add_to_collection(second, path)
    writers.add_to_collection(second, path)
    return spark.read.parquet(path).select("id", "document", F.posexplode("embedding").alias("pos", "value"))


@query("m4_absent_ids", "select vec_id as id, label from embeddings where vec_id % 3 <> 0")
def absent_ids(spark, sf):
    e = load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return writers.absent_from(e, e.filter("id % 3 = 0"))


@query(
    "k6_table_load",
    "select product_id, title, price_current, 'replaced' as step from {catalog} where ord % 2 = 0 union all select product_id, title, price_current, 'appended' from {catalog}",
)
def table_load(spark, sf):
    c = view(spark, sf, "catalog").select("product_id", "title", "price_current", "ord")
    table, path = f"products_{uuid.uuid4().hex[:12]}", scratch(spark, "table")
    keep = ("product_id", "title", "price_current", "step")
    writers.load_table(c.withColumn("step", F.lit("old")).select(*keep), table, replace=True, path=path)
    writers.load_table(c.filter("ord % 2 = 0").withColumn("step", F.lit("replaced")).select(*keep), table, replace=True, path=path)
    # columns are matched by name, not by place
    writers.load_table(c.withColumn("step", F.lit("appended")).select(*reversed(keep)), table)
    return spark.table(table)


def _typed(spark, sf):
    c = view(spark, sf, "catalog")
    return c.select(
        "product_id",
        F.when(F.col("ord") % 4 != 0, F.array("brand", "material_text")).alias("colors"),
        F.when(F.col("ord") % 3 != 0, F.create_map(F.lit("size"), F.col("rating_count").cast("string"), F.lit("näme"), F.col("title"))).alias("dimensions"),
        F.make_timestamp_ntz(F.lit(2024), F.lit(1), (F.col("ord") % 28 + 1).cast("int"), F.lit(3), F.lit(4), F.lit(5)).alias("scraped_at"),
    )


@query(
    "f1_serialise_nested",
    """select product_id, case when ord % 4 <> 0 then brand || '|' || material_text else '' end as colors, ord % 3 = 0 as empty_map,
      case when ord % 3 <> 0 then cast(rating_count as varchar) end as size, case when ord % 3 <> 0 then title end as name,
      strftime(make_timestamp(2024, 1, ord % 28 + 1, 3, 4, 5), '%Y-%m-%dT%H:%M:%S') as scraped_at from {catalog}""",
)
def serialise_nested(spark, sf):
    rows = codec.to_file_rows(_typed(spark, sf))
    d = F.col("dimensions")
    return rows.select(
        "product_id", "colors", (d == "{}").alias("empty_map"), F.get_json_object(d, "$.size").alias("size"),
        F.get_json_object(d, "$['näme']").alias("name"), "scraped_at",
    )


@query(
    "f2_parse_nested",
    """select product_id, cast(case when ord % 4 <> 0 then 2 else 0 end as integer) as n_colors, case when ord % 4 <> 0 then material_text end as second_color,
      case when ord % 3 <> 0 then title end as name, make_timestamp(2024, 1, ord % 28 + 1, 3, 4, 5) as scraped_at from {catalog}""",
)
def parse_nested(spark, sf):
    rows = codec.from_file_rows(codec.to_file_rows(_typed(spark, sf)), ("colors",), ("dimensions",))
    return rows.select(
        "product_id", F.size("colors").alias("n_colors"), F.get("colors", F.lit(1)).alias("second_color"),
        F.col("dimensions")["näme"].alias("name"), "scraped_at",
    )


@query(
    "t1_arriving_files",
    """with e as (select *, cast(ts as date) >= date '2024-01-03' as late from events),
      r as (select *, row_number() over (partition by user_id order by late, event_id) as rn from e)
      select cast(user_id as varchar) as id, event_type || ' ' || cast(event_id as varchar) as document from r where rn = 1""",
)
def arriving_files(spark, sf):
    e = load(spark, sf, "events")
    folder, checkpoint, collection = (scratch(spark, x) for x in ("arrivals", "progress", "collection"))
    rows = e.select(
        F.col("user_id").cast("string").alias("product_id"),
        F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("title"),
        F.format_string("%012d", "event_id").alias("scraped_at"),
        (F.to_date("ts") >= F.lit("2024-01-03").cast("date")).alias("late"),
    )
    schema_ = rows.drop("late").schema
    for late in (False, True):
        writers.write_jsonl(rows.filter(F.col("late") == late).drop("late"), f"{folder}/late-{late}")
        ingest_arrivals(spark, f"{folder}/*", schema_, collection, checkpoint).awaitTermination()
    # nothing new has arrived
    ingest_arrivals(spark, f"{folder}/*", schema_, collection, checkpoint).awaitTermination()
    return spark.read.parquet(collection).select("id", "document")
