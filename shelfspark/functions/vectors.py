"""Vector arithmetic on ``array<float>`` / ``array<double>`` columns (JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelfspark.functions.text import let


def norm(v: Column) -> Column:
    """Euclidean length, summed in element order."""
    return F.sqrt(
        F.aggregate(
            v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
        )
    )


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector has none and gives nulls instead of raising."""
    return let(
        F.nullif(norm(v), F.lit(0.0)),
        lambda n: F.transform(v, lambda x: x.cast("double") / n),
    )


def fuse(text: Column, image: Column) -> Column:
    """Unit mean of two unit vectors; the text vector alone when there is no image."""
    mean = F.zip_with(text, image, lambda a, b: (a.cast("double") + b.cast("double")) / 2)
    return F.when(image.isNull(), text.cast("array<double>")).otherwise(l2_normalize(mean))
