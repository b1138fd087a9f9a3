"""Each operator against a brute-force version, and its defined cases."""

import base64
import gzip
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import Window, functions as F
from tokenizers import Tokenizer

from shelfspark.llm import (
    ann,
    exact_dedup,
    graph,
    jaccard_join,
    license_scan,
    mixing,
    packing,
    quality,
    surrogates,
    url_filter,
    warc,
)
from shelfspark.llm.common import slices, stored, text_bytes, word_hashes
from shelfspark.llm.shingles import shingle_sets

DOCS = "doc_id long, text string, kept string, id long, n long"
EDGES = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "Two words"), (5, "Two words"), (None, "no id"), (None, None),
    (6, "a b c d e"), (7, "A  B\tc d E"), (8, "x" * 300_000), (9, "word " * 60_000), (10, "é日本 🎉"),
]


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "k", -1, -2) for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(20, 120))) for _ in range(25)]
    out = []
    for text in base:
        for _ in range(rng.randint(1, 6)):
            parts = text.split()
            for _ in range(rng.randint(0, 3)):
                parts[rng.randrange(len(parts))] = rng.choice(words)
            out.append(" ".join(parts))
    return list(enumerate(out))


# shared pieces


def test_words_are_those_of_the_contract():
    odd = ["", " ", "A b", "a B", "\x1fx y", "é É", "a\x0bb\x0cc\rd", "end", "start "]
    column = pa.array(odd)
    hashes, _, own = word_hashes(*text_bytes(column))
    seen = {}
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for text, a, b in zip(odd, own[:-1], own[1:]):
        words = re.findall("[^\x20\x09-\x0d]+", text.translate(lower))
        assert len(words) == b - a
        for word, value in zip(words, hashes[a:b].tolist()):
            assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_slices_cover_all_rows_and_stay_small():
    batch = pa.RecordBatch.from_pydict({"i": list(range(9)), "text": ["a" * n for n in (0, 5, 5, 99, 1, 1, 0, 0, 3)]})
    parts = list(slices(batch, "text", 10))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(9))
    assert all(p.num_rows == 1 or sum(map(len, p.column(1).to_pylist())) <= 10 for p in parts)


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    up = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    found = dict(map(tuple, graph.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    alone = {a for a, b in edges if a == b} - {n for a, b in edges if a != b for n in (a, b)}
    assert found == {n: c for n, c in up.items() if n not in alone}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("chunk", [4, 1 << 18])
def test_components_take_few_rounds(spark, monkeypatch, chunk):
    rng = random.Random(5)
    n = 1500
    # a path, a node that many hang on, one that hangs on many, and copies of edges
    edges = [(i, i + 1) for i in range(-n, n)] + [(10**6, 10**6 + i) for i in range(1, n)] + [(3 * 10**6, 2 * 10**6 + i) for i in range(n)]
    edges = [e if rng.random() < 0.5 else e[::-1] for e in edges + edges[::3]]
    rng.shuffle(edges)
    want = {i: -n for i in range(-n, n + 1)} | {10**6 + i: 10**6 for i in range(n)}
    want |= {2 * 10**6 + i: 2 * 10**6 for i in range(n)} | {3 * 10**6: 2 * 10**6}
    written = []
    monkeypatch.setattr(graph, "CHUNK", chunk)
    monkeypatch.setattr(graph, "stored", lambda df, label: written.append(label) or stored(df, label))
    found = graph.components(spark.createDataFrame(edges, "u long, v long").repartition(8)).collect()
    assert len(found) == len(want) and dict(map(tuple, found)) == want
    # two tables a round; chunks that hold a task's edges leave no more than one tree a task
    assert len(written) <= (1 + 2 * 8 if chunk == 4 else 1 + 2 * 3)


# 1 nearest neighbours


def near_by_hand(rows, asked, n=10):
    x = {i: np.array(v, float) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    out = {}
    for q in asked:
        if q in x:
            d = sorted((float(np.sqrt(((x[i] - x[q]) ** 2).sum())), i) for i in x if i != q)
            out[q] = d[:n]
    return out


def test_search_finds_the_nearest(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = ann.search(rows, rows.filter("vec_id % 100 = 0")).toPandas()
    data = [(r.vec_id, r.embedding) for r in rows.collect()]
    want = near_by_hand(data, [i for i, _ in data if i % 100 == 0])
    hits = sum(len({i for _, i in near} & set(found[found.query_id == q].vec_id)) for q, near in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert set(found["query_id"]) == set(want) and (found.groupby("query_id")["rank"].max() == 10).all()


def test_search_in_many_cells_and_parts(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 12))
    x = centres[rng.integers(0, 8, 600)] + 0.2 * rng.normal(size=(600, 12))
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = ann.search(rows, rows.filter("vec_id % 20 = 0"), rows_per_cell=8, part_rows=5).toPandas()
    want = near_by_hand([(int(i), v.tolist()) for i, v in enumerate(x)], range(0, 600, 20))
    hits = sum(len({i for _, i in near} & set(found[found.query_id == q].vec_id)) for q, near in want.items())
    assert hits >= 0.9 * 300


def test_search_among_near_copies(spark):
    """Queries in groups of near copies do not shorten the search of the others."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 24))
    copies = rng.permutation(6000)[:3600]
    x[copies] = np.repeat(x[copies[:72]], 50, axis=0) + 0.003 * rng.normal(size=(3600, 24))
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = list(range(0, 6000, 60))
    found = ann.search(rows, rows.filter("vec_id % 60 = 0"), rows_per_cell=128).toPandas()
    near = found.groupby("query_id")["vec_id"].agg(set)
    want = near_by_hand([(int(i), v.tolist()) for i, v in enumerate(x)], asked)
    among = set(copies.tolist())
    for group in ([q for q in asked if q in among], [q for q in asked if q not in among]):
        hits = sum(len({i for _, i in want[q]} & near[q]) for q in group)
        assert hits >= 0.9 * 10 * len(group)


def test_search_far_from_all_others(spark):
    """A query whose first cells hold too few points, and one at a great distance, get their n nearest."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2000, 12))
    x[:3] *= [[12.0], [30.0], [60.0]]
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = ann.search(rows, rows.filter("vec_id < 3"), rows_per_cell=16).toPandas()
    want = near_by_hand([(int(i), v.tolist()) for i, v in enumerate(x)], range(3))
    assert {(q, i) for q, near in want.items() for _, i in near} == set(zip(found["query_id"], found["vec_id"]))


def test_search_ties_copies_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [
        (30, [0.0, 1.0]), (31, None), (32, [0.0, 0.0]), (33, [nan, 1.0]), (34, [inf, 1.0]), (35, [None, 1.0]),
        (None, [1.0, 1.0]), (30, [0.0, 1.0]),
    ]
    frame = spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id long, embedding array<double>, q int")
    found = ann.search(frame, frame.filter("vec_id in (0, 20, 30, 31, 32)"))
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == {0, 20, 30}
    assert [got[0][k][0] for k in range(1, 11)] == list(range(1, 11))
    assert [got[20][k][0] for k in range(1, 11)] == list(range(10))
    assert [got[30][k] for k in range(1, 11)] == [(i, pytest.approx(2**0.5)) for i in range(10)]
    few = frame.filter("vec_id in (0, 30)")
    assert {(r["query_id"], r["vec_id"]) for r in ann.search(few, few).collect()} == {(0, 30), (30, 0)}
    assert ann.search(frame.limit(0), frame.limit(0)).count() == 0


def test_probes_come_in_order_of_success():
    cells = ann._cells_by_success(np.array([0.1, 0.5]), 1.0, 1.0, 0.95)
    assert cells[0] == (0, 0) and len(set(cells)) == len(cells)


# 2 exact dedup


def dedup_by_hand(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((i, t or ""))
    out = []
    for content, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        digest = hashlib.sha256(content.encode()).hexdigest()
        out += [(i, keep, len(members), i == keep, digest) for i, _ in members]
    return sorted(out, key=repr)


@pytest.mark.parametrize("salts", [1, 16])
def test_exact_dedup(spark, salts):
    rows = EDGES + [(i, "same  text") for i in range(100, 130)] + [(99, "sametext"), (-(2**63), "e t"), (2**63 - 1, "et ")]
    found = exact_dedup.verdicts(docs_of(spark, rows), salts=salts)
    assert sorted(map(tuple, found.collect()), key=repr) == dedup_by_hand(rows)
    kept = exact_dedup.survivors(docs_of(spark, rows), salts=salts)
    assert kept.columns == ["doc_id", "text", "kept", "id", "n"]
    got = Counter(r["doc_id"] for r in kept.collect())
    want = {(keep, digest) for _, keep, _, _, digest in dedup_by_hand(rows)}
    assert got == Counter(keep for keep, _ in want)
    assert exact_dedup.verdicts(docs_of(spark, [])).count() == 0


def test_a_digest_of_two_texts_is_an_error(spark):
    with pytest.raises(Exception, match="one digest stands for different texts"):
        exact_dedup.verdicts(docs_of(spark, [(1, "a"), (2, "b")]), digest=lambda c: F.lit("same")).collect()


def test_exact_dedup_runs_no_python(spark):
    plan = exact_dedup.survivors(docs_of(spark, EDGES))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 3 licences


def test_license_scan(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    rows = EDGES + [
        (20, "Released under the MIT License. MIT-license! mit  license"), (21, f"foo {notice} bar"),
        (22, "licensed under CC BY-NC 4.0."), (23, "the license of mit"), (24, "GNU General Public License, version 3"),
        (25, "This work is licensed under the GNU General Public License, version 3."),
        (26, "word " * 30_000 + "apache license"), (27, "permission of this software"),
    ]
    got = {}
    for r in license_scan.scan(docs_of(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, text in rows:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        places = [(k, label) for p, label in license_scan.BASE_PHRASES for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in places]
        r = next(r for r in got[i] if r["n_words"] == len(words))
        assert (r["n_base"], r["first_word"], r["last_word"]) == (len(places), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert 0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
    assert got[21][0]["labels"] == "mit" and got[22][0]["labels"] == "cc-by-nc-4.0" and got[25][0]["labels"] == "gpl,gpl-3.0"
    assert got[23][0]["labels"] == got[27][0]["labels"] == ""
    assert license_scan.scan(docs_of(spark, [])).count() == 0


def test_license_scan_of_several_notices(spark):
    """Every notice of a file is found, however rare the words of the others are."""
    notice = {}
    for label, words, _ in license_scan.TEMPLATES:
        notice[label] = words  # the longer of the two of mit
    mixes = [("bsd", "cc-by-4.0"), ("mit", "cc-by-4.0"), ("gpl-2.0", "cc-by-4.0"), ("unlicense", "bsd", "apache-2.0"),
             ("isc", "mpl-2.0", "lgpl"), tuple(sorted(notice))]
    rows = [(i, " and so on ".join(notice[x] for x in mix)) for i, mix in enumerate(mixes)]
    # common words of short notices are rare words of no file here
    rows += [(100 + i, "licensed under cc by 4 0 to the version") for i in range(40)]
    got = {r["doc_id"]: r["labels"].split(",") for r in license_scan.scan(docs_of(spark, rows)).collect()}
    for i, mix in enumerate(mixes):
        assert set(mix) <= set(got[i])


def test_license_labels_depend_on_their_phrase_alone(spark):
    """At a file's start and end, cut before the phrase, and beside all of the template's words."""
    rng = random.Random(3)
    rows, want = [], {}

    def add(text, label):
        want[len(rows)] = label
        rows.append((len(rows), text))

    for label, words, phrase in license_scan.TEMPLATES:
        scattered = words.split() * 3
        rng.shuffle(scattered)
        for text in (words, f"so {words}", f"some words first {words}", phrase, f"{phrase} follows", f"{words} {' '.join(scattered)}",
                     f"{' '.join(scattered)} {phrase}", f"{phrase} and {words} and {phrase}"):
            add(text, label)
    vocabulary = sorted({w for _, words, _ in license_scan.TEMPLATES for w in words.split()})
    for _ in range(200):
        parts = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        parts += rng.choice(license_scan.TEMPLATES)[2].split()[rng.randint(0, 1) :]
        parts += [rng.choice(vocabulary) for _ in range(rng.randint(0, 3))]
        add(" ".join(parts), None)
    found = [
        {r["doc_id"]: r for r in license_scan.scan(docs_of(spark, rows), rare=rare).collect()} for rare in (1, license_scan.RARE_WORDS)
    ]
    for i, text in rows:
        labels = {label for label, _, phrase in license_scan.TEMPLATES if f" {phrase} " in f" {text} "}
        labels |= {label for phrase, label in license_scan.BASE_PHRASES if f" {phrase} " in f" {text} "}
        for got in found:
            assert got[i]["labels"] == ",".join(sorted(labels)), text
            assert want[i] is None or want[i] in labels and got[i]["score"] > 0
    assert min(r["score"] for i, r in found[0].items() if rows[i][1] in {words for _, words, _ in license_scan.TEMPLATES}) == 1


# 4 URLs


def test_url_filter_cases(spark):
    urls = [None, "", "no scheme/x", "http://A.Example.ORG/es/1?x", "https://b.example.org", "http://x.com/de/", "http://x.com/fr/a#b",
            "http://spam-farm.example.net/en/1/", "https://www.spam-farm.example.net/en/1.html?q=1", "http://ok.example.net/en/1",
            "http://notexample.org/es/", "x://y://z/p"]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)] + [(9, urls[9], "r")], "page_id long, url string, rule string")
    for size in (64, 1 << 20):
        found = url_filter.judge(pages, url_filter.listed_pages(pages), max_bytes=size)
        got = {r["page_id"]: r for r in found.collect()}
        assert found.count() == len(urls) + 1
        assert all((got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == ("", "", None, "allow") for i in (0, 1, 2))
        assert (got[3]["host"], got[3]["path"], got[3]["rule"], got[3]["verdict"]) == ("a.example.org", "/es/1", "example.org/es/", "block")
        assert (got[4]["rule"], got[5]["rule"], got[6]["rule"]) == (None, "com/de/", "com/fr/")
        assert [got[i]["verdict"] for i in (7, 8, 9)] == ["block", "block", "allow"]
        assert got[10]["rule"] == "org/" and (got[11]["host"], got[11]["path"]) == ("y:", "//z/p")
    assert url_filter.judge(pages.limit(0), url_filter.listed_pages(pages.limit(0))).count() == 0


def test_bloom_filter_has_no_false_negatives_and_few_false_positives(spark):
    urls = spark.range(3000).select(F.concat(F.lit("h/"), F.col("id")).alias("url"))
    bloom = url_filter.bloom_filter(urls.filter("url < 'h/2'"))
    seen = url_filter.possible_hits(urls, "url", bloom).toPandas()
    listed = seen["url"] < "h/2"
    assert seen[listed]["possible"].all() and seen[~listed]["possible"].mean() < 0.05


# 5 quality


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    per_text = np.array([1, 4, 3])
    emission, moves = rng.normal(size=8), rng.normal(size=4)
    ahead, behind = quality.forward_backward(emission, per_text, moves)
    start = 0
    for n in per_text:
        e = emission[start : start + n]
        total, good = 0.0, np.zeros(n)
        for labels in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(e[i] for i in range(n) if labels[i]) + sum(moves[2 * a + b] for a, b in zip(labels, labels[1:])))
            total += w
            good += w * np.array(labels)
        got = 1 / (1 + np.exp(-(ahead + behind)[start : start + n]))
        assert np.allclose(got, good / total)
        start += n


def test_quality_is_learnt(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet")
    labels = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/labels.parquet")
    scored = quality.classify(docs, quality.fit(docs, labels)).toPandas().merge(labels.toPandas(), on="doc_id")
    assert scored["held_out"].mean() == pytest.approx(0.2, abs=0.08)
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(scored["doc_id"], scored["held_out"]))
    held = scored[scored["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() >= 0.9


def test_quality_cases(spark):
    docs = docs_of(spark, EDGES)
    none = spark.createDataFrame([], "doc_id long, quality int")
    constant = quality.classify(docs, quality.fit(docs, none)).collect()
    assert len(constant) == len(EDGES) and {round(r["score"], 6) for r in constant} == {0.5}
    some = spark.createDataFrame([(i, i % 2) for i in range(1, 11)] + [(None, 1), (4, None)], "doc_id long, quality int")
    rows = quality.classify(docs, quality.fit(docs, some)).collect()
    assert len(rows) == len(EDGES) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert quality.classify(docs.limit(0), quality.fit(docs.limit(0), some)).count() == 0


def test_a_repeated_id_counts_once_in_the_fit(spark):
    once = [(i, f"line {i}\nmore words {'x' * i}") for i in range(1, 13)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 13)], "doc_id long, quality int")
    a = quality.fit(docs_of(spark, once), labels, steps=5)
    b = quality.fit(docs_of(spark, once + [once[2]] * 60), labels, steps=5)
    assert np.allclose(a.mean, b.mean) and np.allclose(a.weights, b.weights) and np.allclose(a.curve, b.curve)


# 6 Jaccard join


def components_by_hand(rows, percent=80):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(lower))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (i, _), a in zip(rows, sets):
        for (j, _), b in zip(rows, sets):
            both = len(a & b)
            if i != j and both and 100 * both >= percent * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for (i, _), s in zip(rows, sets)}


@pytest.mark.parametrize("hot, node", [(64, 512), (2, 3)])
def test_jaccard_join(spark, texts, monkeypatch, hot, node):
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    monkeypatch.setattr(jaccard_join, "BLOCK", hot)
    monkeypatch.setattr(jaccard_join, "NODE_ROWS", node)
    rows = [(i + 50, t) for i, t in texts] + [r for r in EDGES if r[0] is not None]
    found = jaccard_join.similar_documents(docs_of(spark, rows + [(None, "no id")]))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()}
    assert got == components_by_hand(rows)
    assert found.count() == len(rows)


def test_jaccard_join_writes_each_table_once_and_few_rounds(spark, monkeypatch):
    words = [f"w{i}" for i in range(160)]
    # each text is close to the next one only, so classes hang together over many links
    rows = [(7 * i % 41, " ".join(words[2 * i : 2 * i + 40])) for i in range(41)] + [(100, " ".join(words[:40])), (101, None)]
    written = []
    keep = lambda df, label: written.append(label) or stored(df, label)
    monkeypatch.setattr(jaccard_join, "stored", keep)
    monkeypatch.setattr(graph, "stored", keep)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = jaccard_join.similar_documents(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == components_by_hand(rows)
    once = ["frequent", "points", "shared", "met", "held", "crowd-members", "placed", "nodes"]
    rounds = [label for label in written if label in ("jaccard-crowd-edges", "jaccard-links")]
    assert [label for label in written if label not in rounds] == [f"jaccard-{label}" for label in once]
    assert len(rounds) <= 2 * (1 + 2 * 3)


def test_shingles_of_the_same_points_are_one_block(spark):
    held = {**{k: [1, 2] for k in range(20)}, 30: [1, 2, 3], 31: [3, 2, 1], 40: [2, 3], 41: [4, 7], 50: [5, 5, 6], 51: [5, 6], 60: [-9, 8]}
    rows = spark.createDataFrame([(i, k) for k, ids in held.items() for i in ids], "id long, key long").repartition(4)
    of_key = Window.partitionBy("key")
    shared = rows.withColumn("members", F.count(F.lit(1)).over(of_key)).withColumn("block", jaccard_join._block_of(of_key))
    blocks = {}
    for r in jaccard_join._blocks_of_points(shared).collect():
        blocks.setdefault(r["key"], []).append(r["id"])
    # one block for each set of points, which moves once however many shingles they share
    assert sorted(map(sorted, blocks.values())) == [[-9, 8], [1, 2], [1, 2, 3], [2, 3], [4, 7], [5, 6], [5, 6]]
    # more points than sums hold
    many = spark.range(200_000).select("id", F.lit(1).alias("key"))
    many = many.withColumn("members", F.count(F.lit(1)).over(of_key)).withColumn("block", jaccard_join._block_of(of_key))
    assert many.select("members", "block").distinct().count() == 1


def test_close_sets_share_as_many_of_their_rarest_as_needed():
    rng = np.random.default_rng(8)
    met = 0
    for _ in range(400):
        n = int(rng.integers(1, 120))
        a = rng.permutation(400)[:n]
        b = np.unique(np.append(a[rng.random(n) < rng.uniform(0.8, 1)], rng.integers(400, 800, int(rng.integers(0, 1 + n // 5)))))
        a, both = np.sort(a), len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 80 * (len(a) + len(b) - both):
            met += 1
            shared = np.intersect1d(a[: jaccard_join.rarest(len(a))], b[: jaccard_join.rarest(len(b))])
            assert len(shared) >= jaccard_join.needed_shared(len(a), len(b)) >= 1
    assert met > 50
    assert jaccard_join.needed_shared(np.array([1, 80, 900]), np.array([1, 100, 900])).tolist() == [1, 1, 81]


def test_fine_counts_of_many_points_bound_as_those_of_two():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64) << np.uint64(1)) for n in (1, 40, 300, 310, 700, 1500, 1600)]
    sets.append(np.arange(3000, dtype=np.uint64))  # all in one group
    packed = [jaccard_join.fine_counts(x) for x in sets]
    fine = jaccard_join.FineCounts(packed)
    for i in range(len(sets)):
        others = np.array([j for j in range(len(sets)) if j != i][::-1])
        assert fine.bounds(i, others).tolist() == [jaccard_join.fine_bound(packed[i], packed[j]) for j in others]
    assert fine.bounds(0, np.zeros(0, np.int64)).tolist() == []


@pytest.mark.parametrize("hot, block", [(64, 1024), (64, 8), (8, 1024)])
def test_long_texts_that_share_a_line_are_no_crowd(spark, monkeypatch, hot, block):
    """Count vectors of 64 groups do not tell long texts apart; what they share does."""
    rng = random.Random(11)
    line = " ".join(f"line{i}" for i in range(60))
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(2500 + 3 * i)) for i in range(40)]
    rows = [(i, f"{t}\n{line}") for i, t in enumerate(texts)]
    rows += [(50, f"{texts[7]}\nnew words at the end"), (51, "of its own")]
    held, keep = {}, jaccard_join.stored

    def watched(df, label):
        held[label] = keep(df, label)
        return held[label]

    monkeypatch.setattr(jaccard_join, "stored", watched)
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    known = jaccard_join.frequent_shingles
    if hot == 64:  # as in a table so large that the line's share of it is too small to be known
        monkeypatch.setattr(jaccard_join, "frequent_shingles", lambda *a: tuple(x[:0] for x in known(*a)))
    else:  # and where it is known, but so are all others
        every = np.unique(np.concatenate(shingle_sets(*text_bytes(pa.array([t for _, t in rows])))))
        monkeypatch.setattr(jaccard_join, "frequent_shingles", lambda *a: (every, np.full(len(every), 40)))
    found = jaccard_join.similar_documents(docs_of(spark, rows))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == components_by_hand(rows)
    # only the two near copies are verified on their sets, and only they were listed as a pair
    assert sorted(r.id for r in held["jaccard-crowd-members"].collect()) == [7, 50]
    assert held["jaccard-met"].filter("sure = 0").count() <= 1


def test_the_pipeline_sends_no_sets_of_long_texts_that_share_a_line(spark, monkeypatch):
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(2500 + 3 * i)) for i in range(40)]
    line = " ".join(f"line{i}" for i in range(60))
    rows = [(i, f"{t}\n{line}") for i, t in enumerate(texts)] + [(50, f"{texts[7]}\nnew words"), (None, texts[7])]
    held, keep, known = {}, jaccard_join.stored, jaccard_join.frequent_shingles
    monkeypatch.setattr(jaccard_join, "stored", lambda df, label: held.setdefault(label, keep(df, label)))
    # as in a table so large that the line's share of it is too small to be known
    monkeypatch.setattr(jaccard_join, "frequent_shingles", lambda *a: tuple(x[:0] for x in known(*a)))
    kept = corpus_pipeline.keep_dissimilar(spark, docs_of(spark, rows), "")
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([*range(40), None])
    assert sorted(r.id for r in held["jaccard-crowd-members"].collect()) == [7, 50]


def test_jaccard_join_keeps_one_of_each(spark, texts):
    rows = [(i, t) for i, t in texts] + [(None, "no id"), (3, texts[3][1])]
    kept = jaccard_join.one_of_each(docs_of(spark, rows))
    want = {c for _, c in components_by_hand(texts).values()}
    got = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == ["doc_id", "text", "kept", "id", "n"]
    assert Counter(got) == Counter([*want, None])
    assert jaccard_join.one_of_each(docs_of(spark, [])).count() == 0


def test_tree_bound_loses_no_close_pair():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(300) < 0.03, rng.integers(0, 2**63, 300).astype(np.uint64), base)) for _ in range(90)]
    sets += [np.unique(rng.integers(0, 2**63, 300).astype(np.uint64)) for _ in range(90)]
    packed = [jaccard_join.group_counts(s) for s in sets]
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    vectors = jaccard_join._vectors([packed[i][0].tobytes() for i in order], np.array([packed[i][1] for i in order]))
    tree = jaccard_join.CountTree(sizes[order], vectors)
    for i in range(0, 180, 7):
        near = set(tree.near(i).tolist())
        for j in range(180):
            if jaccard_join.linked(sets[order[i]], sets[order[j]]):
                assert j in near
    assert sum(len(tree.near(i)) for i in range(180)) < 180 * 120


def test_group_counts_bound_large_sets():
    many = np.arange(10**6, dtype=np.uint64) << np.uint64(44)
    counts, shift = jaccard_join.group_counts(many)
    exact = np.bincount((many >> np.uint64(58)).astype(int), minlength=64)
    assert ((counts.astype(int) << shift) >= exact).all()


def test_shingles_of_short_texts_differ():
    a, b, c, d = shingle_sets(*text_bytes(pa.array(["a b", "a b c", "", "a b c d e"])))
    assert len(a) == len(b) == len(d) == 1 and len(c) == 0 and len({int(x[0]) for x in (a, b, d)}) == 3


# 7 packing


def test_packing_equals_the_tokenizer(spark, sf_dir):

    whole = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    rows = EDGES + [(r["doc_id"] + 100, r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    rows += [(50, "<|endoftext|> it's\tÉté ΣΑΣ İ ́x 日本 WE'LL\x1c ½²"), (51, "a<b> c\n\n d")]
    got = packing.pieces(docs_of(spark, rows)).toPandas()
    assert got["sequence_id"].is_unique and (got["offset"] == 0).all()
    assert all(n & (n - 1) == 0 and n <= 2048 for n in got["length"])
    want = Counter()
    for i, text in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        start = 0
        for n in packing.cut(len(ids)):
            piece = np.array(ids[start : start + n], "<u4")
            want[i, start, n, zlib.crc32(piece.tobytes()), len(ids)] += 1
            start += n
        assert start == len(ids)
    cells = zip(got["doc_id"], got["start"], got["length"], got["ids_crc32"], got["doc_tokens"])
    assert Counter((None if i != i else int(i), *rest) for i, *rest in cells) == want
    assert all(zlib.crc32(np.array(x, "<u4").tobytes()) == c for x, c in zip(got["ids"], got["ids_crc32"]))
    assert packing.pieces(docs_of(spark, [])).count() == 0


def test_packing_with_another_tokenizer_takes_whole_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    assert not packing.ChunkTokenizer(path).by_chunk and packing.ChunkTokenizer(public_tokenizers.path(packing.TOKENIZER)).by_chunk
    got = packing.pieces(docs_of(spark, EDGES), tokenizer=path, end_id=50256).orderBy("doc_id", "start").collect()
    for i, text in [(7, "A  B\tc d E"), (10, "é日本 🎉"), (9, "word " * 60_000)]:
        assert [x for r in got if r["doc_id"] == i for x in r["ids"]] == [*whole.encode(text, add_special_tokens=False).ids, 50256]


def test_random_texts_are_packed_as_the_tokenizer_says():
    path = public_tokenizers.path(packing.TOKENIZER)
    whole, coder = Tokenizer.from_file(path), packing.ChunkTokenizer(path, kept=5000)
    rng = random.Random(7)
    parts = ["the", " ", " ", "\n", "\t", "é", "E\u0301", "\u0301", "ΣΑΣ", "ΑΣ.", "İ", "日本", "🎉", "it's", "WE'LL", "12", "½", "),", "<|endoftext|>",
             "<|startoftext|>", "<", "|", "\x1c", "\x85", "\u2028", "\u3000", "\u200b", "ﬁ", "ẞ", "가", "\u1100\u1161", "x" * 50, "...", "-"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    for i in range(0, 4000, 250):
        ids, at = coder.encode(texts[i : i + 250])
        for k, text in enumerate(texts[i : i + 250]):
            assert ids[at[k] : at[k + 1]].tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_full_chunk_table_changes_nothing():
    import public_tokenizers

    path = public_tokenizers.path(packing.TOKENIZER)
    texts = [f"word{i} and{i % 7}, The-END{i}" for i in range(200)]
    small, large = packing.ChunkTokenizer(path, kept=20), packing.ChunkTokenizer(path)
    for i in range(0, 200, 10):
        a, b = small.encode(texts[i : i + 10]), large.encode(texts[i : i + 10])
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()


def test_buckets_hold_one_length(spark, tmp_path):
    packed = packing.pieces(docs_of(spark, EDGES))
    packing.write_buckets(packed, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.count() == packed.count() and back.filter("length <> shiftleft(1, bucket)").count() == 0


# 8 mixing


def test_mixing_meets_its_targets(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(("abba cadab" if i % 4 else "xyxy zuzu").split()) for _ in range(rng.randint(5, 60))), "a" if i % 4 else "x") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.range(0, 400, 3).select(F.col("id").alias("doc_id"))
    domains = mixing.fit_domains(mixing.labelled_documents(docs, labels))
    members = mixing.memberships(docs, domains)
    mixture = mixing.fit_mixture(members, domains, {"a": 0.5, "x": 0.5})
    assert np.allclose(mixture.after, mixture.targets, rtol=1e-5)
    got = mixing.rates(members, mixture).toPandas()
    assert (got["rate"] >= 0).all() and (got["copies"] >= 1).all()
    expected = got.assign(t=got["tokens"] * got["rate"]).groupby("domain")["t"].sum()
    assert expected["a"] == pytest.approx(expected["x"], rel=0.02)
    mixed = mixing.mix(docs, mixture)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter(dict(zip(got["doc_id"], got["copies"])))


def test_rates_are_the_least_squares_solution(spark):
    """Against many plain projected gradient steps on the same problem, with rates held at 0."""
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3, 0.3, 0.3], 60)
    t = rng.integers(1, 50, 60).astype(float)
    members = spark.createDataFrame([(i, int(a), b.tolist()) for i, (a, b) in enumerate(zip(t, p))], "doc_id long, tokens long, p array<double>")
    domains = mixing.Domains(["a", "b", "c"], np.zeros(3), np.zeros((mixing.FEATURES, 3)))
    mixture = mixing.fit_mixture(members, domains, {"a": 0.9, "b": 0.05, "c": 0.05}, steps=60)
    rates = mixture.rates(p)
    gram = (p * t[:, None]).T @ p
    metric = np.linalg.inv(gram)
    loss = lambda r: (m := (r * t) @ p - mixture.targets) @ metric @ m
    plain = np.ones(60)
    for _ in range(4000):
        plain = np.maximum(0, plain - 0.5 * p @ metric @ ((plain * t) @ p - mixture.targets))
    assert (rates >= 0).all() and loss(rates) <= loss(plain) + 1e-3 * abs(loss(np.ones(60)))


def test_mixing_drops_no_short_or_ambiguous_text(spark):
    """Texts between domains press rates under 1; all stay, and the totals still meet their targets."""
    rng = random.Random(4)
    shared, rows = "abba xyxy momo dada".split(), []
    own = {"a": ["abba"], "x": ["xyxy"], "m": ["momo"]}
    for i in range(600):
        lang = "aaaaaxm"[i % 7]
        rows.append((i, " ".join(rng.choice(shared + own[lang]) for _ in range(3))[:20], lang, 7))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, __copies int").repartition(3)
    domains = mixing.fit_domains(mixing.labelled_documents(docs, docs.select("doc_id")))
    members = mixing.memberships(docs, domains)
    p = np.array([r["p"] for r in members.collect()])
    assert (p.max(axis=1) < 0.9).mean() > 0.1
    mixture = mixing.fit_mixture(members, domains)
    assert np.allclose(mixture.after, mixture.targets, rtol=1e-4)
    got = mixing.rates(members, mixture).toPandas()
    assert got["rate"].min() >= 1 and got["copies"].min() >= 1
    mixed = mixing.mix(docs, mixture)
    assert mixed.columns == docs.columns
    assert mixed.select("doc_id").distinct().count() == 600


def test_mixing_says_when_it_ends_off_target(spark):
    members = spark.createDataFrame([(i, 10, [0.5 + i / 100, 0.5 - i / 100]) for i in range(20)], "doc_id long, tokens long, p array<double>")
    domains = mixing.Domains(["a", "b"], np.zeros(2), np.zeros((mixing.FEATURES, 2)))
    with pytest.warns(UserWarning, match="off their targets"):
        mixing.fit_mixture(members, domains, {"a": 0.01, "b": 0.99})
    many = spark.range(mixing.MOST_DOMAINS + 1).select(F.col("id").cast("string").alias("domain"), F.lit("t").alias("text"))
    with pytest.raises(ValueError, match="domains"):
        mixing.fit_domains(many)


def test_mixing_cases(spark):
    docs = docs_of(spark, EDGES).withColumn("lang", F.lit("en"))
    none = spark.createDataFrame([], "doc_id long")
    domains = mixing.fit_domains(mixing.labelled_documents(docs, none))
    members = mixing.memberships(docs, domains)
    mixture = mixing.fit_mixture(members, domains)
    got = mixing.rates(members, mixture).collect()
    assert len(got) == len(EDGES) and {r["copies"] for r in got} == {1}
    assert mixing.mix(docs, mixture).count() == len(EDGES)
    empty = docs.limit(0)
    assert mixing.rates(mixing.memberships(empty, domains), mixing.fit_mixture(mixing.memberships(empty, domains), domains)).count() == 0


# 9 WARC


def test_warc_round_trip(spark, tmp_path):
    trap = "before\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nafter"
    rows = [(1, "u", "same"), (2, "u", "same"), (3, None, ""), (4, "u", None), (5, "u\r\nX: y", trap), (6, "u", "é" * 5000 + trap * 3),
            (7, "u", "é" * 5000 + trap * 3), (8, "u", "long" * 4000), (8, "u", "long" * 4000), (8, "u", "other"), (None, "u", "same"),
            (None, "u", "x" * 9000), (9, "u", "\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, record_type string").repartition(3)
    for least, folder in ((0, "a"), (5, "b")):
        found = warc.round_trip(pages, least_bytes=least, chunk_bytes=1000, path=str(tmp_path / folder))
        want = Counter()
        for i, _, html in rows:
            payload = (html or "").encode()
            same = [j for j, _, h in rows if j is not None and (h or "").encode() == payload]
            first = max(same) if i is not None and len(payload) >= least else i
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            want[i, len(payload), digest, "response" if first == i else "revisit", None if first == i else first] += 1
        assert Counter(map(tuple, found.collect())) == want
    table = warc.read_chunks(spark, str(tmp_path / "a"))
    assert table.agg(F.max(F.length("chunk"))).first()[0] <= 1000
    assert table.filter("record_type = 'continuation'").count() > 20
    assert warc.round_trip(pages.limit(0), path=str(tmp_path / "none")).count() == 0


def test_warc_finds_a_changed_payload(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string")
    warc.write_warc(pages, str(tmp_path / "w"))
    lines = spark.read.option("lineSep", "\n").text(str(tmp_path / "w"))
    lines.withColumn("value", F.regexp_replace("value", "^abc", "abd")).write.option("lineSep", "\n").text(str(tmp_path / "v"))
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_warc(spark, str(tmp_path / "v")).collect()


def test_warc_records_hold_the_fields_of_the_format(spark, tmp_path):
    big = "é\r\n" * 40_000
    pages = spark.createDataFrame([(1, "http://a/", "same"), (2, "http://b/", "same"), (3, "http://c/", big)], "page_id long, url string, html string")
    folder = str(tmp_path / "w")
    warc.write_warc(pages.coalesce(1), folder, date="2024-05-06T07:08:09Z")
    raw = b"".join(gzip.open(f).read() for f in sorted((tmp_path / "w").glob("*.gz")))
    records, seen = [], 0
    while seen < len(raw):  # by Content-Length, as any reader does
        head, _, rest = raw[seen:].partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines)
        assert version == "WARC/1.1"
        length = int(fields["Content-Length"])
        block, end = rest[:length], rest[length : length + 4]
        assert end == b"\r\n\r\n"
        records.append((fields, block))
        seen += len(head) + 4 + length + 4
    ids = [f["WARC-Record-ID"] for f, _ in records]
    assert len(set(ids)) == len(ids) and all(f["WARC-Date"] == "2024-05-06T07:08:09Z" for f, _ in records)
    kinds = {f["WARC-Record-ID"]: (f, b) for f, b in records}
    revisit = next(f for f, _ in records if f["WARC-Type"] == "revisit")
    assert revisit["WARC-Profile"].endswith("identical-payload-digest")
    assert kinds[revisit["WARC-Refers-To"]][0]["WARC-Target-URI"] == "http://b/"
    assert all(f["Content-Type"] == "application/http;msgtype=response" for f, _ in records if f["WARC-Type"] != "continuation")
    origin = next(i for i, (f, _) in kinds.items() if f["WARC-Target-URI"] == "http://c/" and f["WARC-Type"] == "response")
    parts = [(f, b) for i, (f, b) in kinds.items() if i == origin or f.get("WARC-Segment-Origin-ID") == origin]
    parts.sort(key=lambda p: int(p[0]["WARC-Segment-Number"]))
    assert len(parts) > 2 and [int(f["WARC-Segment-Number"]) for f, _ in parts] == list(range(1, len(parts) + 1))
    whole = b"".join(b for _, b in parts)
    assert whole.partition(b"\r\n\r\n")[2] == big.encode() and int(parts[-1][0]["WARC-Segment-Total-Length"]) == len(whole)
    assert warc.read_warc(spark, folder).filter("page_id = 3").first()["payload_bytes"] == len(big.encode())


def test_warc_reads_archives_of_others(spark, tmp_path):
    body = b"<p>body</p>"
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"

    def record(block: bytes, *lines: str) -> bytes:
        return "\r\n".join(["WARC/1.1", *lines, f"content-length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    made = [
        record(b"software: x\r\n", "WARC-Type: warcinfo", "WARC-Record-ID: <urn:uuid:1>", "Content-Type: application/warc-fields"),
        record(b"GET / HTTP/1.1\r\n\r\n", "WARC-Type: request", "WARC-Record-ID: <urn:uuid:2>", "Content-Type: application/http;msgtype=request"),
        record(http + body, "warc-type:response", "WARC-Record-ID: <urn:uuid:3>", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"),
        record(b"plain", "WARC-Type: resource", "WARC-Record-ID: <urn:uuid:4>", "Content-Type: text/plain"),
    ]
    (tmp_path / "other.warc.gz").write_bytes(b"".join(map(gzip.compress, made)))  # a member for each record
    found = warc.read_warc(spark, str(tmp_path / "other.warc.gz")).collect()
    plain = base64.b32encode(hashlib.sha1(b"plain").digest()).decode()
    assert {(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"]) for r in found} == {
        (None, len(body), digest, "response"), (None, 5, plain, "response")}
    assert len(found) == 2


def test_warc_misses_lost_segments(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "0123456789" * 10)], "page_id long, url string, html string")
    warc.write_warc(pages, str(tmp_path / "w"), chunk_bytes=40)
    table = warc.read_chunks(spark, str(tmp_path / "w"))
    for lost in (1, 2, 3):
        rows = table.filter(F.col("segment") != lost).coalesce(1).sortWithinPartitions("origin", "segment")
        with pytest.raises(Exception, match="missing"):
            warc._verify(rows).collect()


# 10 surrogates


def test_surrogates_keep_form_and_coreference(spark):
    rows = EDGES + [
        (20, "mail Bob.34@Mail7.example.com or call +1 (017) 555-7713!"), (21, "BOB.34@MAIL7.EXAMPLE.COM again"),
        (22, "card 4111 1111 1111 1111 and 4111111111111112 ip 10.20.30.40 ssn 123-45-6789"),
        (23, 'token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"'), (24, "Mrs. Anna Schmidt met Mr Peter Brown, Г-жа Анна Иванова"),
        (25, "v 1.2.3.4.5 and 12.34 and 2020"),
    ]
    found = surrogates.pseudonymise(docs_of(spark, rows))
    got = {}
    for r in found.collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, text in EDGES:
        assert text in [r["text"] for r in got[i]]
    mail = re.search(r"[A-Z][a-z]{2}\.\d\d@[A-Z][a-z]{3}\d\.[a-z]{7}\.com or call \+1 \(\d{3}\) \d{3}-\d{4}!", got[20][0]["text"])
    assert mail and "Bob.34" not in got[20][0]["text"]
    assert got[21][0]["text"].split()[0].lower() == got[20][0]["text"].split()[1].lower() and got[21][0]["text"].split()[0].isupper()
    card, other = re.search(r"card (\d{4} \d{4} \d{4} \d{4}) and (\d{16})", got[22][0]["text"]).groups()
    digits = [int(c) for c in card if c.isdigit()]
    assert surrogates._luhn(digits[:-1]) == digits[-1]
    assert surrogates._luhn([int(c) for c in other[:-1]]) != int(other[-1])
    assert got[22][0]["kinds"] == "card,ip,ssn" and got[22][0]["n_entities"] == 4
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', got[23][0]["text"])
    names = re.fullmatch(r"Mrs\. (\w+) (\w+) met Mr (\w+) (\w+), Г-жа (\w+) (\w+)", got[24][0]["text"]).groups()
    assert names[0] in surrogates.FIRST_NAMES["f", "latin"] and names[2] in surrogates.FIRST_NAMES["m", "latin"]
    assert names[4] in surrogates.FIRST_NAMES["f", "cyrillic"] and all("Ѐ" <= c <= "ӿ" for c in names[5])
    assert got[25][0]["text"] == rows[-1][1] and got[25][0]["n_entities"] == 0
    assert surrogates.pseudonymise(docs_of(spark, [])).count() == 0


def test_names_behind_titles_are_found_whole():
    texts = {
        "Mr and Mrs Smith": ["smith"], "Mr. & Mrs. John Smith": ["john", "smith"], "Mr. J. Brown": ["j", "brown"],
        "Mr J.R. Brown": ["j", "r", "brown"], "Dr Martin Luther King spoke": ["martin", "luther", "king"], "Mr  Brown": ["brown"],
        "Mr\nBrown": ["brown"], "Mr.\u00a0Brown": ["brown"], "Mr Peter\nBrown": ["peter", "brown"], "Mr Brown said": ["brown"],
        "Mr Brown's car": ["brown"], "Herr Dr. Müller": ["müller"], "Herr von Goethe": ["goethe"], "Señora de la Cruz": ["cruz"],
        "Mr Brown Mrs Green": ["brown", "green"], "Mr Brown. The end": ["brown"], "the Prof said": [], "Mr Jean-Luc O'Neil": ["jean-luc", "o'neil"],
    }
    for text, want in texts.items():
        found = [v for _, parts in surrogates.mentions(text) for _, _, _, v in parts]
        assert found == want, text


def test_names_keep_coreference(spark):
    rows = [
        (1, "Mr Peter Brown came. Mr Brown sat; later Peter Brown and P. Brown left, BROWN said. The brown dog of Brownsville stayed."),
        (2, "Mrs Brown met Dr Martin Luther King. Luther King spoke."), (3, "Brown is a colour and Peter Brown has no title here."),
    ]
    got = {r["doc_id"]: r for r in surrogates.pseudonymise(docs_of(spark, rows)).collect()}
    shape = r"Mr (\w+) (\w+) came\. Mr (\w+) sat; later (\w+) (\w+) and \w\. (\w+) left, (\w+) said\. The brown dog of Brownsville stayed\."
    given, surname, *others = re.fullmatch(shape, got[1]["text"]).groups()
    assert surname != "Brown" and given in surrogates.FIRST_NAMES["m", "latin"]
    assert others == [surname, given, surname, surname, surname.upper()] and got[1]["n_entities"] == 5
    other, *king = re.fullmatch(r"Mrs (\w+) met Dr (\w+) (\w+) (\w+)\. (\w+) (\w+) spoke\.", got[2]["text"]).groups()
    assert other == surname and king[1:3] == king[3:] and not {"Luther", "King"} & set(king)
    assert got[3]["text"] == rows[2][1]


def test_permutations_are_one_to_one():
    ssn = {surrogates.permute("k", "phone", f"555-{i:04d}") for i in range(3000)}
    assert len(ssn) == 3000
    octets = {tuple(surrogates.permute_digits("k", "t", [a, b], [7, 5])) for a in range(7) for b in range(5)}
    assert len(octets) == 35


def test_collisions_are_walked_out(spark):
    """A crowded space: surrogates of all real entities are unreal and different, on both paths."""
    real = [f"{i % 10}{i // 10 % 10}{i // 100}-11-11{i % 7}{i % 3}" for i in range(900)]
    entities = spark.createDataFrame([("ssn", v) for v in sorted(set(real))], "kind string, value string")
    moved = {r["value"]: r["surrogate"] for r in surrogates.collisions(entities, "k").collect()}
    final = [moved.get(v) or surrogates.permute("k", "ssn", v) for v in set(real)]
    assert len(set(final)) == len(final) and not set(final) & set(real)
    space = spark.createDataFrame([("ip2", c) for c in "aeiou"], "kind string, value string")
    walked = {r["value"]: r["surrogate"] for r in surrogates.collisions(space, "k").collect()}
    assert set(walked) == set("aeiou") and len(set(walked.values())) == 5 and all(v.startswith("[IP2-") for v in walked.values())


def test_many_exceptions_are_joined(spark, monkeypatch):
    rows = [(i, f"nr {i:03d}-11-1111 x") for i in range(0, 300)] + [(None, None)]
    monkeypatch.setattr(surrogates, "permute", lambda key, kind, v: f"{(int(v[:3]) + 7) % 1000:03d}-11-1111")
    few = {(r["doc_id"], r["text"]) for r in surrogates.pseudonymise(docs_of(spark, rows)).collect()}
    many = {(r["doc_id"], r["text"]) for r in surrogates.pseudonymise(docs_of(spark, rows), broadcast_rows=0).collect()}
    assert few == many and (0, "nr 301-11-1111 x") in few


def test_dense_blocks_hand_over_a_forest(spark, monkeypatch):
    """Near copies of one text: few links leave their blocks, and the components stay exact."""
    rng = random.Random(6)
    words = [f"v{i}" for i in range(80)]
    rows = []
    for i in range(60):
        parts = words[:]
        parts[rng.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(parts)))
    monkeypatch.setattr(jaccard_join, "HOT", 10**6)
    monkeypatch.setattr(jaccard_join, "DENSE", 2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_documents(docs_of(spark, rows)).collect()}
    assert got == components_by_hand(rows)
