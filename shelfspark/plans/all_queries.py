"""Importing this module registers every query."""

from __future__ import annotations

from shelfspark.plans import (  # noqa: F401
    catalog_queries,
    io_queries,
    nested_queries,
    page_queries,
    text_queries,
    vector_queries,
)

flagship = vector_queries.flagship
