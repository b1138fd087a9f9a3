"""Spelling variant grouping by sorted-list dynamic programming.

Words one edit apart agree outside the edited place. Each word is laid into blocks that leave open
one half of it and share the other, so that the two words of a pair meet where the edit is in the
open part; as the longer of a pair by its own length, as the shorter by the length of one letter
more. A block with more than ``BLOCK`` words is laid anew with the halves of its open part, until
the open part is one letter (then the alphabet bounds it): no block outgrows a task, and none is cut.

Within a block the open parts are a sorted list that each word scans. The rows of the banded edit
matrix belong to prefixes of the list's entry, so the rows of the prefix that an entry shares with
the one before it (their LCP) are used again. Where all of a row exceeds one edit, every entry with
that prefix is skipped.

A word's form is its near word of largest count, if that is at least ``LEAP`` times its own; ties
go to the smaller word. Counts grow along forms, so following them ends; roots are found by doubling
steps.

Defined cases: null text has no words, a missing doc_id counts as empty text where ``slip`` asks for
it, repeated rows count each, extra columns are ignored, an empty table gives an empty result. Words
of any length take part.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfspark.llm.common import read, stored, text_of
from shelfspark.llm.registry import query

WORD = "[A-Za-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_COUNT, LEAP = 5, 3, 2
# The contract drops a letter of the words whose checksum this number divides.
SLIP = 97
# Words of a block that one task scans.
BLOCK = 4096
# Bytes of counted words a task holds before it hands them over, and pairs it hands over at a time.
HELD_BYTES = 32 << 20
HANDED = 1 << 15

_LOWER = {c: c + 32 for c in range(65, 91)}
_LAST = chr(0x10FFFF)
_FAR = 9


def slipped(doc_id: str, words: Counter, slip: int) -> Counter:
    """The words with one letter dropped where ``slip`` divides the checksum of doc_id:word."""
    lead = zlib.crc32(f"{doc_id}:".encode())
    out: Counter = Counter()
    for word, n in words.items():
        h = zlib.crc32(word.encode(), lead)
        if h % slip == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        out[word] += n
    return out


def word_counts(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    letters: int = LEAST_LETTERS,
    least: int = LEAST_COUNT,
    slip: int | None = None,
) -> DataFrame:
    """(word, n) of the words of at least ``letters`` letters and ``least`` occurrences in all texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(WORD)
        held: Counter = Counter()

        def hand_over() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"]
            )
            held.clear()
            return out

        size = 0
        for batch in batches:
            for doc_id, value in zip(batch.column(0), batch.column(1)):
                found = Counter(word.findall(value.as_py().translate(_LOWER)))
                if slip:
                    found = slipped(doc_id.as_py(), found, slip)
                for w, n in found.items():
                    if len(w) >= letters:
                        if w not in held:
                            size += 150 + len(w)
                        held[w] += n
                if size > HELD_BYTES:
                    yield hand_over()
                    size = 0
        if held:
            yield hand_over()

    texts = docs.select(text_of(key).alias("doc_id"), text_of(text).alias("text"))
    counts = texts.mapInArrow(rows, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= least)


def _shared(word: Column, span: Column, lo: Column, hi: Column) -> Column:
    """What a block's words share: their letters before ``lo`` and, of ``span`` letters, from ``hi`` on."""
    tail = span - hi
    return F.concat(F.substring(word, F.lit(1), lo), F.substring(word, F.length(word) - tail + 1, tail))


def _keyed(open_parts: DataFrame) -> DataFrame:
    """Rows (word, n, span, lo, hi) with the key of their block."""
    shared = _shared(F.col("word"), F.col("span"), F.col("lo"), F.col("hi"))
    return open_parts.withColumn("block", F.concat_ws(":", "span", "lo", "hi", shared))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row twice, its open part lo to hi cut in two."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    parts = F.array(F.struct(F.col("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi")))
    return _keyed(rows.select("word", "n", "span", F.inline(parts)))


def blocks(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """Rows (word, n, span, lo, hi, block); words of a block may differ in lo to hi only."""
    length = F.length("word")
    whole = words.select("word", "n", F.explode(F.array(length, length + 1)).alias("span"))
    waiting = _halves(whole.withColumn("lo", F.lit(0)).withColumn("hi", F.col("span")))
    done = []
    while True:
        sizes = waiting.groupBy("block").agg(F.count(F.lit(1)).alias("size"), F.max(F.col("hi") - F.col("lo")).alias("open"))
        large = stored(sizes.filter((F.col("size") > most) & (F.col("open") > 1)).select("block"), "spelling-large")
        if large.isEmpty():
            break
        done.append(waiting.join(large, "block", "left_anti"))
        waiting = stored(_halves(waiting.join(large, "block", "left_semi")), "spelling-blocks")
    for part in done:
        waiting = waiting.unionByName(part)
    return waiting


def shared_lengths(entries: list[str]) -> list[int]:
    """LCP of each entry with the one before it (0 for the first)."""
    out = [0] * len(entries)
    for i in range(1, len(entries)):
        a, b = entries[i - 1], entries[i]
        k, most = 0, min(len(a), len(b))
        while k < most and a[k] == b[k]:
            k += 1
        out[i] = k
    return out


def within_one(word: str, entries: list[str], lcp: list[int], start: int = 0) -> list[int]:
    """Places, from ``start`` on, of the sorted entries at most one edit from ``word``.

    Entries have one length: the word's or one less. Row i of the matrix holds the edits between i
    letters of the entry and i - 1, i and i + 1 letters of the word.
    """
    m = len(word)
    out: list[int] = []
    rows = [(_FAR, 0, 1)]
    at, known = start, 0
    total = len(entries)
    while at < total:
        entry = entries[at]
        length = len(entry)
        del rows[known + 1 :]
        dead = 0
        low, mid, high = rows[-1]
        for i in range(known + 1, length + 1):
            letter = entry[i - 1]
            left = min(low + (word[i - 2] != letter) if i > 1 else _FAR, mid + 1)
            same = min(mid + (word[i - 1] != letter) if i <= m else _FAR, high + 1, left + 1)
            right = min(high + (word[i] != letter) if i < m else _FAR, same + 1)
            low, mid, high = left, same, right
            rows.append((low, mid, high))
            if low > 1 and mid > 1 and high > 1:
                dead = i
                break
        if dead:
            # all entries with these letters are too far
            at = bisect_right(entries, entry[:dead] + _LAST, at + 1)
        else:
            if (mid if length == m else high) <= 1:
                out.append(at)
            at += 1
        if at < total:
            known = min(lcp[at], len(rows) - 1)
    return out


def scan_block(span: int, lo: int, hi: int, words: list[tuple[str, int]]) -> Iterator[tuple[str, int, str, int]]:
    """(word, n, near word, its n) of a block's pairs, once each; words are sorted.

    Of one letter dropped from a run of equal ones, the last place counts, so a pair is found in one
    block only.
    """
    long = [(w, n) for w, n in words if len(w) == span]
    if not long:
        return
    short = [(w, n) for w, n in words if len(w) != span]
    open_long = [w[lo:hi] for w, _ in long]
    lcp_long = shared_lengths(open_long)
    open_short = [w[lo : hi - 1] for w, _ in short]
    lcp_short = shared_lengths(open_short)
    for i, (word, n) in enumerate(long):
        part = open_long[i]
        if i + 1 < len(long):
            for j in within_one(part, open_long, lcp_long, i + 1):
                yield word, n, *long[j]
        if short:
            last = hi < span and word[hi] == part[-1]
            for j in within_one(part, open_short, lcp_short):
                # dropping the open part's last letter is dropping the next one, if they are equal
                if not (last and open_short[j] == part[:-1]):
                    yield word, n, *short[j]


NEAR = "word string, n long, near string, near_n long"


def near_words(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """(word, n, near, near_n) of all pairs of words one edit apart, each way."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lines() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*[c.to_pylist() for c in batch.columns])

        def handed(found: list[tuple[str, int, str, int]]) -> pa.RecordBatch:
            both = found + [(b, m, a, n) for a, n, b, m in found]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*both), kinds)], names=["word", "n", "near", "near_n"]
            )

        found: list[tuple[str, int, str, int]] = []
        for _, block in groupby(lines(), key=lambda line: line[0]):
            members = list(block)
            if len(members) > 1:
                _, span, lo, hi = members[0][:4]
                for pair in scan_block(span, lo, hi, [line[4:] for line in members]):
                    found.append(pair)
                    if len(found) >= HANDED:
                        yield handed(found)
                        found = []
        if found:
            yield handed(found)

    laid = blocks(words, most).select("block", "span", "lo", "hi", "word", "n")
    return laid.repartition("block").sortWithinPartitions("block", "word").mapInArrow(rows, NEAR)


def forms(words: DataFrame, near: DataFrame, leap: int = LEAP) -> DataFrame:
    """Words (word, n) with ``n_near``, ``form`` and ``form_n``; no near word of ``leap`` times the
    count leaves the form null."""
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    around = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    form_n = -F.col("best.less")
    takes = form_n >= leap * F.col("n")
    return words.join(around, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(takes, F.col("best.form")).alias("form"),
        F.when(takes, form_n).alias("form_n"),
    )


def roots(formed: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: where following forms ends.

    Every round doubles the steps taken, and counts grow by ``LEAP`` a step, so a handful of rounds
    do. Many words may share a root: the right side has one row a word, and AQE may split the left.
    """
    now = stored(formed.filter("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = now.join(further, F.col("root") == F.col("at"), "left")
        now = stored(
            moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")),
            "spelling-roots",
        )
        if not now.agg(F.max("went")).first()[0]:
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(words: DataFrame, leap: int = LEAP, most: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of stored words (word, n)."""
    formed = stored(forms(words, near_words(words, most), leap), "spelling-forms")
    found = formed.join(roots(formed), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@query("op13_spelling_variants")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of all documents, each word with its variants' form."""
    words = stored(word_counts(read(spark, sf_dir, "documents"), slip=SLIP), "spelling-words")
    return variants(words)
