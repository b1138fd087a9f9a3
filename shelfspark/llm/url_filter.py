"""URL filters: host and path rules, and a blocked Bloom filter in front of an exact join.

A page that no rule fits is judged by a list of URLs. Listed canonical URLs are hashed into a
blocked Bloom filter: the hash picks one 512-bit block, and eight bits inside it. A page whose bits
are all set is a possible hit; only those go to an exact hash join with the list, which removes the
false positives. The filter takes ``bits_per_url`` for each listed URL but never more than
``max_bytes``, so what is broadcast is bounded; a fuller filter only sends more pages to the join.

Canonical URL: host in lower case without a leading ``www.``, path without trailing ``/`` or
``.html``; scheme, query and fragment are dropped.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and is
never listed (allow). Every row is judged, repeated ones too; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfspark.llm.common import mix64, read
from shelfspark.llm.registry import query

# Fixed values: (verdict, rule) as host and path.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
# First labels of the hosts whose pages make up the list.
LISTED_SITES = ("spam-farm", "cheap-pills")
BITS_PER_URL = 16
MAX_FILTER_BYTES = 64 << 20
_WORDS_PER_BLOCK = 8
_BITS_SET = 8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("url")))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("url")))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def with_parts(pages: DataFrame, key: str, url: str) -> DataFrame:
    """(page_id, host, path) of every row."""
    rows = pages.select(F.col(f"`{key}`").cast("bigint").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"))
    return rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))


def canonical(host: Column, path: Column) -> Column:
    """The form in which URLs are listed and compared; null without a host."""
    bare = F.regexp_replace(host, r"^www\.", "")
    short = F.regexp_replace(F.regexp_replace(path, r"/+$", ""), r"\.html$", "")
    return F.when(host != "", F.concat(bare, short))


def _longest_rule(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, name in sorted(rules, key=lambda r: len(r[1])):  # the longest is tried first
        site, _, start = name.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith("/" + start)
        rule = F.when(fits, F.lit(name)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, word in it, mask), with one row for each hash and bit."""
    mixed = mix64(hashes)
    block = (mixed >> np.uint64(20)) % np.uint64(blocks)
    words, masks = [], []
    for i in range(_BITS_SET):
        bit = mix64(mixed + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2**64)) & np.uint64(511)
        words.append(bit >> np.uint64(6))
        masks.append(np.uint64(1) << (bit & np.uint64(63)))
    return block, np.stack(words, 1), np.stack(masks, 1)


def bloom_filter(
    urls: DataFrame, bits_per_url: int = BITS_PER_URL, max_bytes: int = MAX_FILTER_BYTES
) -> np.ndarray:
    """Blocks of eight 64-bit words, built from a ``url`` column.

    Each task sets bits of its own; the words are then joined by OR. The driver receives the
    filter, at most ``max_bytes``, never the URLs.
    """
    n = urls.agg(F.approx_count_distinct("url")).first()[0]
    blocks = int(min(max(1, -(-n * bits_per_url // 512)), max_bytes // 64))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, int] = {}
        for batch in batches:
            block, word, mask = _places(np.asarray(batch.column(0)).view(np.uint64), blocks)
            at = (block[:, None] * np.uint64(_WORDS_PER_BLOCK) + word).ravel()
            places, which = np.unique(at, return_inverse=True)
            joined = np.zeros(len(places), np.uint64)
            np.bitwise_or.at(joined, which, mask.ravel())
            for place, value in zip(places.tolist(), joined.tolist()):
                own[place] = own.get(place, 0) | value
        yield pa.RecordBatch.from_pydict(
            {"place": pa.array(list(own), pa.int64()), "word": pa.array(np.array(list(own.values()), np.uint64).view(np.int64))}
        )

    words = (
        urls.select(F.xxhash64("url").alias("h"))
        .mapInArrow(bits, "place long, word long")
        .groupBy("place")
        .agg(F.bit_or("word").alias("word"))
        .toArrow()
    )
    out = np.zeros(blocks * _WORDS_PER_BLOCK, np.int64)
    out[np.asarray(words["place"])] = np.asarray(words["word"])
    return out.view(np.uint64).reshape(blocks, _WORDS_PER_BLOCK)


def possible_hits(rows: DataFrame, url: str, bloom: np.ndarray) -> DataFrame:
    """Add ``possible``: false only for URLs that are certainly not listed."""

    @F.pandas_udf("boolean")
    def hit(hashes):
        block, word, mask = _places(hashes.to_numpy().view(np.uint64), len(bloom))
        return type(hashes)(((bloom[block[:, None], word] & mask) == mask).all(axis=1))

    return rows.withColumn("possible", F.col(url).isNotNull() & hit(F.xxhash64(F.col(url))))


def listed_pages(pages: DataFrame, url: str = "url", sites: Sequence[str] = LISTED_SITES) -> DataFrame:
    """Canonical URLs of the pages of the listed sites (``url``)."""
    parts = with_parts(pages.select(F.lit(0).alias("none"), F.col(f"`{url}`")), "none", url)
    site = F.regexp_extract(F.regexp_replace("host", r"^(www|m|blog)\.", ""), r"^[^.]*", 0)
    return parts.filter(site.isin(*sites)).select(canonical(F.col("host"), F.col("path")).alias("url"))


def judge(
    pages: DataFrame,
    listed: DataFrame,
    key: str = "page_id",
    url: str = "url",
    rules: Sequence[tuple[str, str]] = RULES,
    bits_per_url: int = BITS_PER_URL,
    max_bytes: int = MAX_FILTER_BYTES,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed): the longest rule that fits, else the list."""
    bloom = bloom_filter(listed, bits_per_url, max_bytes)
    host, path = F.col("host"), F.col("path")
    rule, says = _longest_rule(rules, host, path)
    rows = with_parts(pages, key, url).select(
        "page_id", "host", "path", rule.alias("rule"), says.alias("says"), canonical(host, path).alias("canonical")
    )
    # where a rule decides, the list is not asked
    asked = rows.withColumn("asked", F.when(F.col("rule").isNull(), F.col("canonical")))
    flagged = possible_hits(asked, "asked", bloom)
    exact = listed.select(F.col("url").alias("hit")).distinct()
    # the second condition asks for a shuffle of both sides, so that AQE may split a hot URL
    same = F.col("possible") & (F.col("asked") == F.col("hit")) & (F.xxhash64("asked") == F.xxhash64("hit"))
    clean = flagged.filter(~F.col("possible")).withColumn("hit", F.lit(None).cast("string"))
    found = flagged.filter("possible").join(exact, same, "left")
    return (
        clean.unionByName(found)
        .withColumn("listed", F.col("hit").isNotNull())
        .select(
            "page_id",
            "host",
            "path",
            "rule",
            F.coalesce("says", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
            "listed",
        )
    )


_ORACLE = r"""
with u as (
    select page_id, case when url like '%://%' then substr(url, instr(url, '://') + 3) end as rest from pages
), p as (
    select page_id,
           coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                              'abcdefghijklmnopqrstuvwxyz'), '') as host,
           coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
    from u
), c as (
    select *, case when host <> '' then regexp_replace(host, '^www\.', '')
                  || regexp_replace(regexp_replace(path, '/+$', ''), '\.html$', '') end as canonical
    from p
), rules(verdict, rule) as (values {rules}
), r as (
    select page_id, host, path, canonical,
           (select max_by(rules.rule, length(rules.rule)) from rules
            where (host = split_part(rules.rule, '/', 1) or host like '%.' || split_part(rules.rule, '/', 1))
              and starts_with(path, substr(rules.rule, instr(rules.rule, '/')))) as rule
    from c
), listed as (
    select distinct canonical from c
    where regexp_extract(regexp_replace(host, '^(www|m|blog)\.', ''), '^[^.]*') in ({sites})
)
select page_id, host, path, r.rule,
       coalesce(rules.verdict, case when l.canonical is null then 'allow' else 'block' end) as verdict,
       r.rule is null and l.canonical is not null as listed
from r left join rules on r.rule = rules.rule left join listed l on r.canonical = l.canonical
""".format(
    rules=", ".join(f"('{v}', '{r}')" for v, r in RULES), sites=", ".join(f"'{s}'" for s in LISTED_SITES)
)


@query("op4_url_filter", _ORACLE)
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL, judged by the rules and the list of spam sites' pages."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, listed_pages(pages))
