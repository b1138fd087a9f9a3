"""Typed catalog rows to file rows and back: lists as ``|`` text, maps as JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfspark.functions import nested as N


def to_file_rows(df: DataFrame) -> DataFrame:
    """Serialise nested columns; null lists become empty text and null maps ``{}``."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind.startswith("array"):
            c = N.list_to_text(c)
        elif kind.startswith("map"):
            c = N.map_to_text(c)
        elif kind == "timestamp_ntz":
            c = N.time_to_iso(c)
        out.append(c.alias(name))
    return df.select(*out)


def from_file_rows(df: DataFrame, lists: tuple[str, ...], maps: tuple[str, ...]) -> DataFrame:
    """Parse nested columns back; empty list entries carry nothing and are dropped."""
    out = []
    for name in df.columns:
        c = F.col(name)
        if name in lists:
            c = N.text_to_list(c)
        elif name in maps:
            c = N.text_to_map(c)
        elif name == "scraped_at":
            c = N.iso_to_time(c)
        out.append(c.alias(name))
    return df.select(*out)
