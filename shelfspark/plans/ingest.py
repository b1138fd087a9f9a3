"""The ingest job: product rows to unique, embedded rows of a collection."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfspark.functions import nested as N
from shelfspark.functions import text as T
from shelfspark.operators.dedupe import accepted, rejected, with_reject_reason
from shelfspark.operators.embed import (
    BATCH_SIZE,
    EncoderFactory,
    fused_vectors,
    image_vectors,
    text_vectors,
)
from shelfspark.session import configure, shared_dir
from shelfspark.sources.readers import read_products
from shelfspark.sources.writers import add_to_collection

log = logging.getLogger(__name__)
# Fixed value: the untimestamped latest copy of a run.
DEFAULT_INPUT = "output/products.json"
_TEXT_COLUMNS = ("title", "brand", "description", "material_text", "highlights", "feature_bullets")


def prepare(products: DataFrame, order: str | list[str]) -> DataFrame:
    """(order, id, document, metadata, first_image_url, reason) of every product row.

    ``order`` is the encounter order; ties and missing values are allowed. Rows with a ``reason``
    are rejects. ``products`` is read twice, once for ids and order alone: pass a stored table, not
    a plan that reads pages.
    """
    have = set(products.columns)
    parts = [F.col(c) if c in have else F.lit(None).cast("string") for c in _TEXT_COLUMNS]
    images = F.col("images") if "images" in have else F.lit(None).cast("string")
    rows = products.select(
        *([order] if isinstance(order, str) else order),
        T.safe_str(F.col("product_id")).alias("id"),
        T.document_text(*parts).alias("document"),
        N.flat_metadata(products).alias("metadata"),
        T.first_image_url(images).alias("first_image_url"),
    )
    return with_reject_reason(rows, key="id", order=order, document="document")


def embed(
    prepared: DataFrame,
    text_encoder: EncoderFactory | None = None,
    image_encoder: EncoderFactory | None = None,
    use_images: bool = True,
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Accepted rows as collection rows (id, embedding, document, metadata).

    Rejects are gone before any encoder runs. Without an image encoder, or with
    ``use_images=False``, vectors are text only and no join is planned.
    """
    if "reason" in prepared.columns:
        prepared = accepted(prepared)
    rows = prepared.select("id", "document", "metadata", "first_image_url")
    image = (
        image_vectors(rows, "id", "first_image_url", image_encoder, batch_size)
        if use_images and image_encoder
        else None
    )
    text = text_vectors(rows, "document", text_encoder, batch_size)
    vectors = fused_vectors(text, image, "id")
    return vectors.select("id", "embedding", "document", "metadata")


def run_ingest(
    spark: SparkSession,
    input_path: str = DEFAULT_INPUT,
    order: str | list[str] = "scraped_at",
    collection: str = "products",
    collection_root: str | None = None,
    batch_size: int = BATCH_SIZE,
    use_images: bool = True,
    text_encoder: EncoderFactory | None = None,
    image_encoder: EncoderFactory | None = None,
) -> tuple[str, DataFrame]:
    """Read, check, embed and add one file's products; returns (collection path, rejects).

    ``order`` may tie or be missing: one row per id is accepted, all others are rejects.
    ``batch_size`` is the encoder's slice. The collection lies under ``collection_root``, by default
    ``collections`` in the session's shared folder, where a later run finds it by its name. An input without a
    valid record adds nothing.
    """
    configure(spark)
    root = collection_root or f"{shared_dir(spark)}/collections"
    flagged = prepare(read_products(spark, input_path), order)
    path = f"{root}/{collection}"
    rows = embed(accepted(flagged), text_encoder, image_encoder, use_images, batch_size)
    add_to_collection(rows, path)
    log.info("Ingest complete. Collection '%s' at %s", collection, path)
    return path, rejected(flagged).select("id", "reason")
