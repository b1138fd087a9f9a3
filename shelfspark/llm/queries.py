"""Importing this module registers every query of the subpackage."""

from __future__ import annotations

from shelfspark.llm import (  # noqa: F401
    alignment,
    ann,
    exact_dedup,
    jaccard_join,
    license_scan,
    mixing,
    packing,
    quality,
    secrets,
    spelling,
    surrogates,
    url_filter,
    warc,
)
from shelfspark.llm.registry import ORACLES, QUERIES  # noqa: F401
