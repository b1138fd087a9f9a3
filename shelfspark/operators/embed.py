"""Text and image vectors: the pluggable encoder and the steps around it."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from shelfspark.functions.text import embed_text
from shelfspark.functions.vectors import fuse, l2_normalize
from shelfspark.operators.merge import with_image_vectors

# An encoder turns a list of texts into a (n, width) array. A factory builds one, once per worker.
Encoder = Callable[[list[str]], np.ndarray]
EncoderFactory = Callable[[], Encoder]

# Texts are cut to 77 tokens and encoded in slices of 32.
MAX_TOKENS = 77
BATCH_SIZE = 32
HASH_WIDTH = 64


def hashed_words(width: int = HASH_WIDTH) -> EncoderFactory:
    """Default encoder: counts of the first 77 words by hashed bucket. Needs no model."""

    def build() -> Encoder:
        buckets: dict[str, int] = {}

        def bucket(word: str) -> int:
            if len(buckets) > 200_000:
                buckets.clear()
            at = buckets.get(word)
            if at is None:
                at = int(hashlib.md5(word.encode()).hexdigest()[:6], 16) % width
                buckets[word] = at
            return at

        def encode(texts: list[str]) -> np.ndarray:
            # one count over (row, bucket) for the whole slice
            cells: list[int] = []
            for row, text in enumerate(texts):
                words = [w for w in re.split(r"[ \t\r\n]+", text) if w][:MAX_TOKENS]
                cells.extend([row * width + bucket(w) for w in words])
            counts = np.bincount(np.array(cells, dtype=np.int64), minlength=len(texts) * width)
            return counts.reshape(len(texts), width).astype(np.float64)

        return encode

    return build


def encode_column(c: Column, factory: EncoderFactory | None = None, batch_size: int = BATCH_SIZE) -> Column:
    """Raw vectors of a text column. The encoder is built once per worker and fed slices."""
    make = factory or hashed_words()

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make()
        for part in parts:
            texts = part.tolist()
            rows: list[np.ndarray] = []
            for at in range(0, len(texts), batch_size):
                rows.extend(np.asarray(encoder(texts[at : at + batch_size]), dtype=np.float64))
            yield pd.Series(rows, index=part.index, dtype=object)

    return run(c)


def text_vectors(
    df: DataFrame,
    document: str = "document",
    factory: EncoderFactory | None = None,
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Add ``text_vector``: cut text, encoded, unit length."""
    raw = encode_column(embed_text(F.col(document)), factory, batch_size)
    return df.withColumn("_raw", raw).withColumn("text_vector", l2_normalize(F.col("_raw"))).drop("_raw")


def fused_vectors(text: DataFrame, image: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Add ``embedding``: unit mean of text and image vector, text alone without an image.

    ``image`` (key, image_vector), one row per key; None switches images off. Image vectors of
    the wrong kind (a null) fall back to text.
    """
    if image is None:
        return text.withColumn("embedding", F.col("text_vector").cast("array<float>")).drop("text_vector")
    joined = with_image_vectors(text, image, key)
    return joined.withColumn(
        "embedding", fuse(F.col("text_vector"), F.col("image_vector")).cast("array<float>")
    ).drop("text_vector", "image_vector")


def image_vectors(
    df: DataFrame, key: str, image_url: str, encoder: EncoderFactory, batch_size: int = BATCH_SIZE
) -> DataFrame:
    """(key, image_vector) of records that have an image URL; failures must come back as NaN rows."""
    raw = df.filter(F.col(image_url).isNotNull()).select(
        key, encode_column(F.col(image_url), encoder, batch_size).alias("_raw")
    )
    whole = ~F.exists("_raw", lambda x: x.isNull() | F.isnan(x))
    return raw.filter(whole).select(key, l2_normalize(F.col("_raw")).alias("image_vector"))
