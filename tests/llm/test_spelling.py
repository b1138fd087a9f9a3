"""Spelling variants against all pairs of words, and the defined cases."""

import random
import re
import zlib
from collections import Counter

import pytest

from shelfspark.llm import spelling
from shelfspark.llm.queries import QUERIES

DOCS = "doc_id long, text string, word string, n long, block string"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(counts):
    """The rows of the contract from the distances of all pairs."""
    near = {w: [v for v in counts if v != w and abs(len(v) - len(w)) < 2 and edits(w, v) == 1] for w in counts}
    best = {w: min(near[w], key=lambda v: (-counts[v], v), default=None) for w in counts}
    form = {w: b if b is not None and counts[b] >= 2 * counts[w] else None for w, b in best.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items())


def rows_of(found):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in found.collect())


def vocabulary(seed, size):
    rng = random.Random(seed)
    words = {}
    while len(words) < size:
        if words and rng.random() < 0.7:
            w = rng.choice(list(words))
            at = rng.randrange(len(w) + 1)
            w = w[:at] + rng.choice(["", rng.choice("abéz")]) + w[at + rng.randint(0, 1) :]
        else:
            w = "".join(rng.choice("abÿ") for _ in range(rng.randint(1, 9)))
        if w:
            words[w] = rng.choice([1, 2, 3, 5, 8, 40, 300])
    return words


@pytest.mark.parametrize("most", [2, 5, 4096])
def test_variants_equal_all_pairs(spark, most):
    counts = vocabulary(3, 500)
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert rows_of(spelling.variants(words, most=most)) == brute(counts)


def test_blocks_stay_small_and_long_words_take_part(spark):
    rng = random.Random(7)
    long = "".join(rng.choice("abcd") for _ in range(400))
    counts = {"prefix" + "".join(rng.choice("abcdefghij") for _ in range(6)): 3 for _ in range(900)}
    counts |= {long: 9, long[:200] + long[201:]: 4, long + "a": 30, "z" * 300: 5, "z" * 299: 11}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    laid = spelling.blocks(words, 60)
    assert max(r["count"] for r in laid.groupBy("block").count().collect()) <= 60
    # every word still lies open at every letter, once
    for r in laid.groupBy("word", "span").agg({"lo": "collect_list", "hi": "collect_list"}).collect()[:200]:
        parts = sorted(zip(sorted(r["collect_list(lo)"]), sorted(r["collect_list(hi)"])))
        assert parts[0][0] == 0 and parts[-1][1] == r["span"] and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    assert rows_of(spelling.variants(words, most=60)) == brute(counts)


def test_rows_are_used_again_and_ranges_skipped():
    rng = random.Random(5)
    for _ in range(300):
        length = rng.randint(1, 6)
        entries = sorted({"".join(rng.choice("abc") for _ in range(length)) for _ in range(rng.randint(1, 60))})
        lcp = spelling.shared_lengths(entries)
        for word in ("".join(rng.choice("abc") for _ in range(length + k)) for k in (0, 1)):
            start = rng.randrange(len(entries))
            want = [i for i in range(start, len(entries)) if edits(word, entries[i]) <= 1]
            assert spelling.within_one(word, entries, lcp, start) == want


def test_pairs_come_once_each_way(spark):
    words = spark.createDataFrame([(w, 1) for w in ("aaaaa", "aaaa", "aaaaaa", "aabaa", "baaaa")], "word string, n long")
    found = [(r["word"], r["near"]) for r in spelling.near_words(words).collect()]
    assert len(set(found)) == len(found)
    assert set(found) == {(a, b) for a in ("aaaaa", "aaaa", "aaaaaa", "aabaa", "baaaa")
                          for b in ("aaaaa", "aaaa", "aaaaaa", "aabaa", "baaaa") if edits(a, b) == 1}


def counted(rows):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(low)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    return {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}


def test_words_are_counted_by_the_rule(spark, monkeypatch):
    rng = random.Random(9)
    words = ["apple", "Apple", "APPLES", "Über", "straße", "ÉCOLE", "école", "x×÷y", "naïve", "don't", "Kelvin", "1banana2", "four"]
    rows = [(rng.choice([None, 1, 2, 3, 700]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for _ in range(400)]
    rows += [(1, None), (2, ""), (3, "x" * 100_000), (3, "x" * 100_000), (3, "x" * 100_000), (4, "hello " * 50_000)]
    docs = spark.createDataFrame([(i, t, "w", 1, "b") for i, t in rows], DOCS).repartition(4)
    for held in (1, spelling.HELD_BYTES):
        monkeypatch.setattr(spelling, "HELD_BYTES", held)
        assert {r["word"]: r["n"] for r in spelling.word_counts(docs, slip=97).collect()} == counted(rows)
    assert spelling.variants(spelling.word_counts(docs.limit(0))).count() == 0


def test_query_equals_brute_force(spark, sf_dir):
    """Distances of all pairs are too many here; words that share what one deletion leaves are not."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    counts = counted(rows)
    near = {w: set() for w in counts}
    left = {}
    for w in counts:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            left.setdefault((i, rest), []).append(w)
            if rest in counts:
                near[w].add(rest)
                near[rest].add(w)
    for group in left.values():
        for w in group:
            near[w].update(v for v in group if v != w)
    form = {}
    for w, around in near.items():
        best = min(around, key=lambda v: (-counts[v], v), default=None)
        if best and counts[best] >= 2 * counts[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    want = sorted((w, form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items())
    assert rows_of(QUERIES["op13_spelling_variants"](spark, sf_dir)) == want
