"""The secret scan against a version that recounts every window, and its defined cases."""

import hashlib
import math
import random
import re
from collections import Counter

from shelfspark.llm import secrets
from shelfspark.llm.queries import QUERIES

DOCS = "doc_id long, text string, spans string, kind string, bits double"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "s", "k", 0.5) for i, t in rows], DOCS).repartition(3)


def spans_of(spark, rows, **options):
    found = secrets.secret_spans(docs_of(spark, rows), **options).collect()
    return sorted(((r["doc_id"], [tuple(s)[:3] for s in r["spans"]]) for r in found), key=repr)


def letters(word):
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


def base(text):
    """The contract's patterns, letter by letter."""
    names = "|".join(map(letters, ("password", "passwd", "secret", "token", "api"))) + "_?" + letters("key")
    pattern = rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [("assign", *m.span()) for m in re.finditer(pattern, text) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return out + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]


def windows(text, classes, allowed):
    """Every window counted anew."""
    out = []
    least = min(c.window for c in classes)
    for found in re.finditer(f"[{secrets.TOKEN}]+", text):
        if len(found[0]) < least:
            continue
        lead = text[: found.start()]
        if any(re.search(p, lead[-allowed.look_back :]) for p in allowed.before) or any(re.search(p, found[0]) for p in allowed.candidate):
            continue
        for c in classes:
            for run in re.finditer(f"[{c.characters}]+", found[0]):
                marked = [False] * len(run[0])
                starts = []
                for a in range(len(run[0]) - c.window + 1):
                    part = run[0][a : a + c.window]
                    counts = Counter(part)
                    bits = -sum(n / c.window * math.log2(n / c.window) for n in counts.values())
                    sorts = sum(any(re.match(p, x) for x in part) for p in ("[0-9]", "[A-Z]", "[a-z]"))
                    if bits >= c.bits - 1e-9 and sorts >= c.sorts:
                        starts.append(a)
                joined = []
                for a in starts:
                    if joined and a <= joined[-1][1]:
                        joined[-1][1] = a + c.window
                    else:
                        joined.append([a, a + c.window])
                shift = found.start() + run.start()
                spans = [(c.kind, shift + a, shift + b) for a, b in joined]
                out += [s for s in spans if not any(re.search(p, text[s[1] : s[2]]) for p in allowed.inside)]
    return out


def brute(text, classes=secrets.CLASSES, allowed=secrets.ALLOWED):
    order = [*secrets.BASE_KINDS, *[c.kind for c in classes]]
    return sorted(base(text) + windows(text, classes, allowed), key=lambda s: (s[1], order.index(s[0]), s[2]))


def noise(rng):
    """Texts of words, identifiers, random strings of several alphabets, assignments and joiners."""
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "aab1", "é日x",
                 "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"]
    parts = []
    for _ in range(rng.randint(0, 14)):
        kind = rng.randrange(6)
        if kind < 3:
            parts.append("".join(rng.choices(rng.choice(alphabets), k=rng.choice([3, 8, 19, 20, 24, 32, 33, 60]))))
        elif kind == 3:
            parts.append(rng.choice(["token", "API_KEY", "apikey'", "Passwd\"", "secret", "AKIA", "AKIA", "AKIA", "https://x.org/", "sha256-"]))
        elif kind == 4:
            parts.append(rng.choice([" = ", ": '", "=", ":  \"", " ", ".", "/", "\n", "ſK"]))
        else:
            parts.append(rng.choice(["the", "internationalisation", "getElementsByTagName", "0123456789abcdef" * 3]))
    return "".join(parts)


def test_spans_equal_windows_counted_anew(spark):
    rng = random.Random(11)
    rows = [(i, noise(rng)) for i in range(600)]
    found = dict(spans_of(spark, rows))
    assert found == {i: brute(t) for i, t in rows}
    kinds = Counter(s[0] for spans in found.values() for s in spans)
    assert all(kinds[k] > 10 for k in (*secrets.BASE_KINDS, *[c.kind for c in secrets.CLASSES])), kinds


def test_windows_slide_over_long_runs(spark):
    rng = random.Random(12)
    dull, live = "ab" * 4000, "".join(rng.choices("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k=3000))
    rows = [(1, f"é {dull}{live}{dull}"), (2, "x" * 2_000_000), (3, "word " * 100_000)]
    found = dict(spans_of(spark, rows))
    assert found == {1: brute(rows[0][1]), 2: [], 3: []}
    (kind, start, end), = [s for s in found[1] if s[0] == "entropy_base64"]
    assert 8002 - 24 < start <= 8002 and end >= 11002


def test_harmless_strings_are_left_out_and_fixed_patterns_stay(spark):
    key = "kJ8s0Qm2ZrT6uXv9LbNc4WdYf7Hg1Pa5"
    rows = [
        (1, key), (2, f"see https://example.org/files/{key}"), (3, f"sha256-{key}"), (4, "0f8fad5b-d9cb-469f-a165-70867728950e"),
        (5, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), (6, f"data:image/png;base64,{key}"),
        (7, f"token={key}EXAMPLE"), (8, "https://x/" + "deadbeef01" * 4), (9, "getElementsByTagNameInsideOfThisDocument"),
    ]
    found = {i: [s[0] for s in spans] for i, spans in spans_of(spark, rows)}
    assert found.pop(7)[0] == "assign"
    assert found == {1: ["entropy_base64"], 2: [], 3: [], 4: [], 5: [], 6: [], 8: ["hex"], 9: []}
    bare = secrets.AllowList((), (), ())
    assert spans_of(spark, rows[1:2], allowed=bare) == [(2, brute(rows[1][1], allowed=bare))] != [(2, [])]


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (None, "token: abcdefgh"), (5, "token: abcdefg"), (5, "token: abcdefgh"), (5, "token: abcdefgh"),
            (6, "password=token: abcdefghijk"), (7, "🎉 secret='12345678'")]
    assert spans_of(spark, rows) == sorted(
        [(1, []), (2, []), (None, [("assign", 0, 15)]), (5, []), (5, [("assign", 0, 15)]), (5, [("assign", 0, 15)]),
         (6, []), (7, [("assign", 2, 18)])], key=repr)
    assert secrets.secret_spans(docs_of(spark, rows).limit(0)).count() == 0


def test_query_digests_the_spans(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op11_secret_scan"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    order = secrets.BASE_KINDS
    for r in rows:
        mine = sorted(base(texts[r["doc_id"]]), key=lambda s: (s[1], order.index(s[0])))
        assert r["base_sha256"] == hashlib.sha256(",".join("%s:%d:%d" % s for s in mine).encode()).hexdigest()
        assert tuple(r[f"n_{k}"] for k in order) == tuple(sum(s[0] == k for s in mine) for k in order)
        assert r["spans"] == ",".join("%s:%d:%d" % s for s in brute(texts[r["doc_id"]]))
