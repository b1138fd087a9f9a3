"""Order over whole tables: neighbours and places in a global order, without a task for a whole key.

Rows are dealt to tasks by ranges of the order, sorted there and written once to the shared folder.
A key, or one instant of it, may hold any share of the rows: its last sort keys are a hash of the
row and the row's number in its input, so even equal rows are dealt over several ranges. What a
range needs of the one before it is its last row, so one small row a range goes through the driver.
(Spark samples the sort keys in a pass of its own before it deals the rows.)
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType, MapType, StructType, VariantType

from shelfspark.session import scratch


def _holds_map(kind: DataType) -> bool:
    if isinstance(kind, (MapType, VariantType)):
        return True
    if isinstance(kind, StructType):
        return any(_holds_map(f.dataType) for f in kind)
    return _holds_map(kind.elementType) if hasattr(kind, "elementType") else False


def content(df: DataFrame, seed: int = 0) -> Column:
    """A number that differs between rows that differ: the last tie-break of an order."""
    parts = [
        F.to_json(F.struct(F.col(f"`{f.name}`")), {"ignoreNullFields": "false"}) if _holds_map(f.dataType) else F.col(f"`{f.name}`")
        for f in df.schema
    ]
    # nulls leave a hash as it is, so their places are hashed too
    return F.xxhash64(F.lit(seed), *parts, *[F.col(f"`{f.name}`").isNull() for f in df.schema if f.nullable])


def fresh(df: DataFrame, name: str) -> str:
    """The name, or it and the first number, that no column has."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}{i}" for i in range(len(taken) + 1))) if n.lower() not in taken)


def _in_ranges(df: DataFrame, order: list[Column], more: dict[str, Column]) -> DataFrame:
    """(c0, c1, ..., ``more``, range) in ranges of the order, sorted; the input's columns go by number,
    so that none of their names clashes."""
    tie, number = fresh(df, "tie"), fresh(df, "number")
    rows = df.withColumns({tie: content(df), number: F.monotonically_increasing_id()})
    by = [*order, F.col(tie), F.col(number)]
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]
    sorted_rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    return sorted_rows.select(*own, *[c.alias(n) for n, c in more.items()], F.spark_partition_id().alias("range"))


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _rows(df: DataFrame, columns: list[str], *more: Column) -> DataFrame:
    return df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], *more)


def with_rank(df: DataFrame, order: list[str | Column], name: str = "rank") -> DataFrame:
    """Add each row's place (from 1) in the order over the whole table: equal to ``row_number``.

    Ranges are counted, and every row adds the rows of the ranges before its own.
    """
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    # rows are numbered in the order of their range
    at = F.monotonically_increasing_id() - F.shiftleft(F.col("range").cast("bigint"), 33)
    placed = _written(_in_ranges(df, by, {}).withColumn("at", at), "rank")
    counts = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a range
    before, offsets = 0, []
    for r in sorted(counts, key=lambda r: r["range"]):
        offsets.append((r["range"], before))
        before += r["n"]
    starts = df.sparkSession.createDataFrame(offsets, "range int, before long")
    found = placed.join(F.broadcast(starts), "range")
    return _rows(found, df.columns, (F.col("before") + F.col("at") + 1).alias(name))


def _shifted(column: pa.Array, first: pa.Array) -> pa.Array:
    """The column one place down, ``first`` on top."""
    return pa.concat_arrays([first, column.slice(0, len(column) - 1)])


def _same(a: pa.Array, b: pa.Array) -> pa.Array:
    """Whether values are equal, nulls counting as equal."""
    both = pc.and_(pc.is_null(a), pc.is_null(b))
    return pc.or_(both, pc.fill_null(pc.equal(a, b), False))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (..., key, value, range): add whether the row before has the key, its value, and
    what the first and last row of the range are. Key and value stay at those alone."""
    held, last = None, None

    def finished(parts: dict[str, pa.Array], tail: bool) -> pa.RecordBatch:
        n = len(parts["key"])
        tails = pa.array([False] * (n - 1) + [tail])
        edge = pc.or_(parts["head"], tails)
        for name in ("key", "value"):
            kind = parts[name].type
            if pc.any(edge).as_py():
                parts[name] = pc.if_else(edge, parts[name], pa.scalar(None, kind))
            else:
                parts[name] = pa.nulls(n, kind)
        return pa.RecordBatch.from_pydict(parts | {"tail": tails})

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        parts = dict(zip(batch.schema.names, batch.columns))
        key, value = parts["key"], parts["value"]
        parts["head"] = pa.array([last is None] + [False] * (n - 1))
        if last is None:
            last = pa.nulls(1, key.type), pa.nulls(1, value.type)
        parts["same"] = pc.and_(_same(key, _shifted(key, last[0])), pc.invert(parts["head"]))
        before = _shifted(value, last[1])
        parts["before"] = pc.if_else(parts["same"], before, pa.scalar(None, before.type))
        last = key.slice(n - 1), value.slice(n - 1)
        if held is not None:
            yield finished(held, False)
        held = parts
    if held is not None:
        yield finished(held, True)


def with_previous(df: DataFrame, key: Column, order: list[Column], value: Column, same: str, before: str) -> DataFrame:
    """Add whether the row before, in the order of key and ``order``, has the same key (``same``), and
    its value if it has (``before``). Missing keys are one key."""
    spark = df.sparkSession
    # read once, dealt once
    ranged = _in_ranges(df, [key, *order], {"key": key, "value": value})
    kind = ranged.schema["value"].dataType
    schema = StructType(list(ranged.schema.fields))
    for name, of in (("head", "boolean"), ("same", "boolean"), ("before", kind), ("tail", "boolean")):
        schema = schema.add(name, of)
    scanned = _written(ranged.mapInArrow(_scan, schema), "scan")
    # at most two rows a range
    edges = scanned.filter("head or tail").select("range", "head", "tail", "key", "value").collect()
    carried, last = [], None
    for r in sorted(edges, key=lambda r: (r["range"], r["tail"] and not r["head"])):
        if r["head"] and last is not None and last["key"] == r["key"]:
            carried.append((r["range"], last["value"]))
        if r["tail"]:
            last = r
    if not carried:
        return _rows(scanned, df.columns, F.col("same").alias(same), F.col("before").alias(before))
    over = spark.createDataFrame(carried, StructType().add("place", "integer").add("carried", kind))
    # at most one row a range
    joined = scanned.join(F.broadcast(over), F.col("head") & (F.col("range") == F.col("place")), "left")
    met = F.col("place").isNotNull()
    return _rows(
        joined,
        df.columns,
        (F.col("same") | met).alias(same),
        F.when(met, F.col("carried")).otherwise(F.col("before")).alias(before),
    )
