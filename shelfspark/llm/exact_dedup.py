"""Exact dedup by skew-safe combining, in DataFrame functions only.

Copies are texts that are identical once blanks are deleted. They are combined three times, each
time by the digest *and* the whole normalised text:

1. locally: the partial aggregate inside each scan task leaves one row per text and salt;
2. by salt: what the tasks have left meets under (digest, salt), so a text that a third of all
   rows repeat is merged by ``salts`` tasks, not one;
3. globally: the salt winners, at most ``salts`` a text, give one winner per text.

Membership is then a lookup by digest. The global step has compared whole contents and counts the
different contents of each digest; where it is not one (never seen for SHA-256), the lookup raises
instead of mixing two texts up.

Defined cases: null text is empty text, and all empty texts are copies of each other; of equal
texts the one with the most code points stays, then the smallest doc_id, a null doc_id last. Rows
repeated under one doc_id share its verdict; ``survivors`` keeps one of them. An empty table gives
an empty result. Extra columns are ignored by ``verdicts`` and kept by ``survivors``.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from shelfspark.llm.common import read, text_of
from shelfspark.llm.registry import query

BLANKS = " \t\n\v\f\r"
SALTS = 16
_MAX_ID = (1 << 63) - 1

Digest = Callable[[Column], Column]


def normalised(text: Column) -> Column:
    """The text without the characters x20 and x09 to x0D."""
    return reduce(lambda c, blank: F.replace(c, F.lit(blank), F.lit("")), BLANKS, text)


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _lit(n: int) -> Column:
    return F.lit(Decimal(n)).cast("decimal(21,0)")


def _rank(points: Column, doc_id: Column) -> Column:
    """One number that orders by code points, then by smaller doc_id, null last.

    A decimal can be updated in place, so the maximum stays a hash aggregate.
    """
    below = F.lit(_MAX_ID).cast("decimal(20,0)") - doc_id.cast("decimal(20,0)")
    after = F.coalesce(below, F.lit(-1).cast("decimal(21,0)")).cast("decimal(21,0)")
    return (points.cast("decimal(12,0)") * _lit(10**20) + after).cast("decimal(38,0)")


def _id_of(rank: Column) -> Column:
    after = F.pmod(rank, _lit(10**20))
    # the null id counts as -1, so it borrows from the points
    missing = after == _lit(10**20 - 1)
    return F.when(~missing, (F.lit(_MAX_ID).cast("decimal(20,0)") - after).cast("bigint"))


def winners(
    docs: DataFrame, key: str = "doc_id", text: str = "text", digest: Digest = sha256, salts: int = SALTS
) -> DataFrame:
    """(digest, keep_id, group_size, contents): one row per different text.

    ``contents`` counts the different texts of the digest.
    """
    rows = docs.select(
        F.col(f"`{key}`").cast("bigint").alias("id"), text_of(text).alias("raw")
    ).select("id", F.length("raw").alias("points"), normalised(F.col("raw")).alias("content"))
    keyed = rows.select(
        digest(F.col("content")).alias("digest"),
        F.pmod(F.xxhash64("id", "points"), F.lit(salts)).alias("salt"),
        "content",
        _rank(F.col("points"), F.col("id")).alias("rank"),
    )
    by_salt = keyed.groupBy("digest", "salt", "content").agg(
        F.max("rank").alias("rank"), F.count(F.lit(1)).alias("rows")
    )
    whole = by_salt.groupBy("digest", "content").agg(
        F.max("rank").alias("rank"), F.sum("rows").alias("group_size")
    )
    found = whole.select("digest", "rank", "group_size")
    same = Window.partitionBy("digest")
    return found.select(
        "digest",
        _id_of(F.col("rank")).alias("keep_id"),
        "group_size",
        F.count(F.lit(1)).over(same).alias("contents"),
    )


def _checked(found: DataFrame) -> DataFrame:
    """The winners, or an error where one digest stands for two texts."""
    clash = F.when(
        F.col("contents") > 1, F.raise_error(F.lit("one digest stands for different texts: use a longer digest"))
    )
    return found.withColumn("keep_id", F.coalesce(clash.cast("bigint"), F.col("keep_id")))


def verdicts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", digest: Digest = sha256, salts: int = SALTS
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per document, dropped ones too."""
    found = _checked(winners(docs, key, text, digest, salts)).select(
        F.col("digest").alias("found"), "keep_id", "group_size"
    )
    rows = docs.select(
        F.col(f"`{key}`").cast("bigint").alias("doc_id"), digest(normalised(text_of(text))).alias("digest")
    )
    # the second condition asks for a shuffle of both sides, so that AQE may split a hot digest
    same = (F.col("digest") == F.col("found")) & (F.xxhash64("digest") == F.xxhash64("found"))
    return rows.join(found, same).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def survivors(
    docs: DataFrame, key: str = "doc_id", text: str = "text", digest: Digest = sha256, salts: int = SALTS
) -> DataFrame:
    """One whole row per different text, with the columns of ``docs``."""
    # digest and id as one key: the join and the choice of one row then need the same shuffle
    def one_key(digest_: Column, id_: Column) -> Column:
        return F.concat_ws(":", digest_, F.coalesce(id_.cast("string"), F.lit("none")))

    found = _checked(winners(docs, key, text, digest, salts)).select(
        one_key(F.col("digest"), F.col("keep_id")).alias("__keep")
    )
    row = one_key(digest(normalised(text_of(text))), F.col(f"`{key}`").cast("bigint"))
    rows = docs.withColumn("__row", row)
    first = Window.partitionBy("__row").orderBy("__keep")
    kept = rows.join(found, F.col("__row") == F.col("__keep")).withColumn("__place", F.row_number().over(first))
    return kept.filter(F.col("__place") == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


@query(
    "op2_exact_dedup",
    r"""
    with t as (
        select doc_id, coalesce(text, '') as raw,
               regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as content
        from documents
    ), g as (
        select doc_id, sha256(content) as text_sha256,
               first_value(doc_id) over (partition by content order by length(raw) desc, doc_id) as keep_id,
               count(*) over (partition by content) as group_size
        from t
    )
    select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from g
    """,
)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy that stands for it."""
    return verdicts(read(spark, sf_dir, "documents"))
