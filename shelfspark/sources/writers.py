"""Sinks: product files, run snapshots, the keyed collection and tables."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameWriter, Row, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from shelfspark.functions.nested import run_label
from shelfspark.session import drop_scratch, scratch
from shelfspark.sources.codec import to_file_rows


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """UTF-8 JSON lines, one object per record; nulls are written so every row has every column."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


write_jsonl = write_json


def write_json_documents(df: DataFrame, path: str, wrapper: str | None = None) -> None:
    """Whole JSON documents, one per task: a list, or ``{"<wrapper>": [...]}``.

    A document can only be read by one task, so JSON lines are the form for large catalogs.
    """
    start = "[" if wrapper is None else f'{{"{wrapper}": ['
    end = "]" if wrapper is None else "]}"

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = start
        for batch in batches:
            lines = []
            for value in batch.column(0):
                lines.append(lead + value.as_py())
                lead = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        closing = end if lead == "," else start + end
        yield pa.RecordBatch.from_arrays([pa.array([closing])], names=["value"])

    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    rows.mapInArrow(framed, "value string").write.text(path)


def _csv(writer: DataFrameWriter) -> DataFrameWriter:
    # Spark's writer would otherwise trim blanks off the values
    return (
        writer.option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )


def write_csv(df: DataFrame, path: str, mode: str = "error") -> bool:
    """CSV with a header. An empty catalog writes nothing and only warns."""
    if df.isEmpty():
        warnings.warn("No products to save", stacklevel=2)
        return False
    _csv(df.write.mode(mode)).csv(path)
    return True


def write_snapshot(df: DataFrame, root: str, run: str = "run_ts", latest: bool = True) -> None:
    """Every format under its run (``root/json``, ``root/csv``), plus a ``latest`` copy.

    ``df`` has a time column ``run``. It is computed once into a staging table in the shared
    folder; the formats are written from there. Rebalancing by run keeps one file per small run
    and splits a run that is much larger than the others. The copy is a folder of its own below
    ``root/latest``; a small file that names it is replaced last, so a reader (``latest_path``) meets
    the copy before or this one, each whole, whenever the job ends.
    """
    spark = df.sparkSession
    staged = scratch(spark, "snapshot")
    labelled = to_file_rows(df.withColumn(run, run_label(F.col(run))))
    labelled.hint("rebalance", run).write.partitionBy(run).parquet(staged)
    # the label is digits and an underscore, and must stay text
    columns = StructType([f for f in labelled.schema if f.name != run] + [StructField(run, StringType())])
    rows = spark.read.schema(columns).parquet(staged)
    by_run = rows.hint("rebalance", run)
    # a run that is written again replaces itself; other runs stay
    def replacing() -> DataFrameWriter:
        return by_run.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run)

    replacing().option("ignoreNullFields", False).json(f"{root}/json")
    _csv(replacing()).csv(f"{root}/csv")
    if latest:
        last = rows.filter(F.col(run) == rows.agg(F.max(run)).scalar())
        version = uuid.uuid4().hex[:12]
        write_json(last, f"{root}/latest/{version}/json")
        _csv(last.write).csv(f"{root}/latest/{version}/csv")
        _publish(spark, f"{root}/latest", version)
    drop_scratch(spark, staged)


CURRENT = "_current"


def _hadoop_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _publish(spark: SparkSession, folder: str, version: str) -> None:
    """Name the version in the pointer file, in one step, and remove those that nobody reads any more.

    The version before stays for readers that have just looked it up.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    pointer, fresh = _hadoop_path(spark, f"{folder}/{CURRENT}"), _hadoop_path(spark, f"{folder}/_{version}")
    files = pointer.getFileSystem(conf)
    before = current_version(spark, folder)
    out = files.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf).rename(
        files.makeQualified(fresh), files.makeQualified(pointer), over
    )
    for entry in files.listStatus(_hadoop_path(spark, folder)):
        if entry.isDirectory() and entry.getPath().getName() not in (version, before):
            files.delete(entry.getPath(), True)


def current_version(spark: SparkSession, folder: str) -> str | None:
    """The version that the pointer file of a folder names; None where nothing was published."""
    pointer = _hadoop_path(spark, f"{folder}/{CURRENT}")
    files = pointer.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(pointer):
        return None
    stream = files.open(pointer)
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return text


def latest_path(spark: SparkSession, root: str) -> str:
    """The folder of the latest copy of a snapshot's last run (``json`` and ``csv`` below it)."""
    version = current_version(spark, f"{root}/latest")
    if version is None:
        raise FileNotFoundError(f"no snapshot was published under {root}")
    return f"{root}/latest/{version}"


BUCKET = "_bucket"
BUCKETS = 16
_BUCKET_FIELD = StructField(BUCKET, IntegerType())


def read_collection(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of a collection with their ``_bucket``; one that does not exist yet has none."""
    try:
        return spark.read.schema(StructType([*schema, _BUCKET_FIELD])).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], StructType([*schema, _BUCKET_FIELD]))


def absent_from(df: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key the collection does not hold. Reads only the key column of the collection."""
    return df.join(existing.select(key), key, "left_anti")


def add_to_collection(df: DataFrame, path: str, key: str = "id") -> None:
    """Insert-if-absent by ``key``; adding the same rows again changes nothing.

    A key that comes twice in ``df`` is stored once, whichever copy it is, so callers choose
    first (``with_reject_reason``). The collection is laid out by a hash bucket of the key, and only
    the buckets that ``df`` falls into are read. Two jobs that add to one collection at the same
    time may both insert a key: run one at a time.
    """
    placed = df.withColumn(BUCKET, F.pmod(F.xxhash64(F.col(key)), F.lit(BUCKETS)).cast("int"))
    # at most BUCKETS numbers
    touched = [r[0] for r in placed.select(BUCKET).distinct().collect()]
    existing = read_collection(df.sparkSession, path, df.schema).filter(F.col(BUCKET).isin(touched))
    fresh = absent_from(placed, existing, key).dropDuplicates([key])
    fresh.hint("rebalance", BUCKET).write.mode("append").partitionBy(BUCKET).parquet(path)


def send_in_slices(
    df: DataFrame, connect: Callable[[], Callable[[list[Row]], None]], batch_size: int = 32
) -> None:
    """Hand rows to an external store in slices, one connection per task.

    ``connect`` runs on the executor and returns the store's add function. A retried task sends
    its slices again, so the store's add must tolerate ids it already has.
    """

    def send(rows: Iterator[Row]) -> None:
        add = connect()
        part: list[Row] = []
        for row in rows:
            part.append(row)
            if len(part) == batch_size:
                add(part)
                part = []
        if part:
            add(part)

    df.foreachPartition(send)


def load_table(df: DataFrame, table: str, replace: bool = False, path: str | None = None) -> None:
    """Append to a table by column name, or replace it."""
    writer = df.write.mode("overwrite" if replace else "append")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
