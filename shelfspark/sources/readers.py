"""Readers of product files, snapshots and raw pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from shelfspark.schema import FILE_SCHEMA


def read_json(spark: SparkSession, path: str, schema: StructType = FILE_SCHEMA) -> DataFrame:
    """JSON documents: a top-level list, ``{"products": [...]}``, or one object as one row."""
    wide = StructType([*schema.fields, StructField("products", ArrayType(schema))])
    docs = spark.read.schema(wide).option("multiLine", True).option("mode", "FAILFAST").json(path)
    alone = F.array(F.struct(*schema.names))
    return docs.select(F.inline(F.coalesce("products", alone)))


def read_jsonl(spark: SparkSession, path: str, schema: StructType = FILE_SCHEMA) -> DataFrame:
    """JSON lines; blank lines are skipped, a bad line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header: every column is text, quoted newlines allowed, empty text stays empty."""
    raw = (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
    )
    return raw.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in raw.columns])


_READERS = {".json": read_json, ".jsonl": read_jsonl, ".csv": read_csv}


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """Choose the reader by the lower-cased suffix; other suffixes and missing files are errors."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    suffix = name[name.rfind(".") :].lower() if "." in name else ""
    if suffix not in _READERS:
        raise ValueError(f"Unsupported format: {suffix!r}. Use .json, .jsonl or .csv")
    return _READERS[suffix](spark, path)


def as_typed(df: DataFrame, schema: StructType = FILE_SCHEMA) -> DataFrame:
    """All-text rows (CSV) to the types of the file schema; text that is no such value is null."""
    return df.select(
        *[
            F.col(f.name) if f.dataType == StringType() else F.col(f.name).try_cast(f.dataType).alias(f.name)
            for f in schema
            if f.name in df.columns
        ]
    )


def read_snapshots(
    spark: SparkSession, path: str | list[str], schema: StructType = FILE_SCHEMA, multi_line: bool = False
) -> DataFrame:
    """Many runs with drifting columns under one schema; absent columns are null, plus ``file``."""
    reader = spark.read.schema(schema).option("recursiveFileLookup", True)
    if multi_line:
        reader = reader.option("multiLine", True)
    return reader.json(path).select("*", F.col("_metadata.file_name").alias("file"))


# Key of a line that is no JSON object, in the column of rescued values.
WHOLE_LINE = "_line"


def read_drifting(
    spark: SparkSession, path: str | list[str], schema: StructType = FILE_SCHEMA, rescue: str = "rescued"
) -> DataFrame:
    """Runs of JSON lines as ``read_snapshots`` gives them, with what the schema has no place for.

    ``rescue`` maps each key that the schema lacks, and each key whose value does not fit its type, to
    the value as text (nested ones as JSON). A line that is no object is held whole, under WHOLE_LINE.
    Nothing rescued is an empty map; nulls, and unknown keys inside nested values, are not rescued.
    Blank lines are skipped. Keys are told apart by case.
    """
    if rescue in schema.names:
        raise ValueError(f"the schema has a column {rescue!r} of its own")
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    parsed = lines.filter(F.trim("value") != "").select(
        F.from_json("value", schema).alias("row"),
        F.from_json("value", MapType(StringType(), StringType())).alias("raw"),
        F.col("value"),
        F.col("_metadata.file_name").alias("file"),
    )
    fits = F.map_from_arrays(
        F.array(*[F.lit(n) for n in schema.names]), F.array(*[F.col("row").getField(n).isNotNull() for n in schema.names])
    )
    lost = F.map_filter("raw", lambda k, v: v.isNotNull() & ~F.coalesce(F.try_element_at("fits", k), F.lit(False)))
    whole = F.create_map(F.lit(WHOLE_LINE), F.col("value"))
    return (
        parsed.withColumn("fits", fits)
        .withColumn("lost", F.when(F.col("raw").isNull(), whole).otherwise(lost))
        .select(*[F.col("row").getField(n).alias(n) for n in schema.names], F.col("lost").alias(rescue), "file")
    )


def drift_report(rows: DataFrame, schema: StructType = FILE_SCHEMA, rescue: str = "rescued") -> DataFrame:
    """(file, key, kind, n_rows) of what was rescued; kind is unknown, mistyped or unreadable."""
    keys = rows.select("file", F.explode(F.map_keys(rescue)).alias("key"))
    kind = F.when(F.col("key").isin(schema.names), "mistyped").when(F.col("key") == WHOLE_LINE, "unreadable").otherwise("unknown")
    return keys.groupBy("file", "key").agg(F.count("*").alias("n_rows")).select("file", "key", kind.alias("kind"), "n_rows")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw pages: a parquet table (page_id, url, html), or a folder of HTML files (url, html)."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("url"), F.col("value").alias("html")
    )
