"""What the operators share: bounded slices of Arrow text, and tables written between steps."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfspark.session import configure, scratch

# Bytes of text that a Python task expands into numbers at a time.
SLICE_BYTES = 1 << 21


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table, with the library's session settings in force."""
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: later steps restart from files, not from lineage."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """The column as text; null counts as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of an Arrow string array without copying; null counts as empty."""
    array = pc.fill_null(array, "")
    if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = array.buffers()
    if len(array) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def give_back() -> None:
    """Return memory that a worker has freed to the system: workers live on through all stages of a job."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose text together stays near ``limit`` bytes; a longer text is a run of its own."""
    _, at = text_bytes(batch.column(batch.schema.get_field_index(column)))
    start, rows = 0, batch.num_rows
    while start < rows:
        end = int(np.searchsorted(at, at[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), rows)
        yield batch.slice(start, end - start)
        start = end
    give_back()


def segment_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of each run values[at[i]:at[i + 1]]; an empty run sums to 0."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    codes = np.arange(256, dtype=np.uint64)
    codes[65:91] += np.uint64(32)
    blank = np.zeros(256, bool)
    blank[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return mix64(codes + np.uint64(0x9E3779B97F4A7C15)), blank


_BYTE_CODES, _BLANK = _byte_tables()
_STEP = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, n + 1 word offsets) of the words of texts data[at[i]:at[i + 1]].

    A word is a run without x20 and x09 to x0D; A-Z count as a-z.
    """
    inside = ~_BLANK[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = at[:-1][at[:-1] < at[1:]]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, np.zeros(len(at), np.int64)
    where = np.flatnonzero(inside)
    run = np.searchsorted(where, starts)
    length = np.diff(np.append(run, len(where)))
    place = np.arange(len(where)) - np.repeat(run, length)
    powers = np.multiply.accumulate(np.full(int(length.max()), _STEP))
    sums = np.add.reduceat(_BYTE_CODES[data[where]] * powers[place], run)
    return mix64(sums + length.astype(np.uint64)), starts, np.searchsorted(starts, at)
