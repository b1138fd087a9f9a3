"""License scans by a positional rare-token index.

Licence templates are short word sequences. Their index maps the words of a template's mandatory
phrase to their positions. Of these the ones with the highest inverse document frequency over all
files are looked up in a file, template by template, so several notices in one file do not crowd each
other out; a posting puts the template's first word at (word's place - position), and the places that
all looked-up words agree on are the alignments, which may begin before the file's first word. An
alignment counts when the whole phrase stands at its relative place; the template's other words only
tell how much of the notice is there (the score). So a label depends on its phrase alone, wherever it
stands and whatever other licence words the file holds.
Beside these, base phrases are found wherever their words stand in line.

Two passes over the texts: one counts in how many files each licence word occurs (a few dozen
words, added up per task and then over tasks), one scans. No text is shuffled.

Defined cases: null text is empty; a file without words has no places, no labels and score 0;
tables without rows give no rows; every occurrence in a long text is found. Extra columns are
ignored, repeated rows are scanned each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfspark.llm.common import read, slices
from shelfspark.llm.registry import query

# The phrases and labels of the base scan.
BASE_PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

# Fixed values: (label, words, mandatory phrase) of common licence notices.
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and"
     " associated documentation files", "permission is hereby granted free of charge"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3",
     "gnu general public license version 3"),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the"
     " gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("gpl-3.0", "it under the terms of the gnu general public license as published by the free software foundation"
     " either version 3 of the license",
     "gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2.0", "it under the terms of the gnu general public license as published by the free software foundation"
     " either version 2 of the license",
     "gnu general public license as published by the free software foundation either version 2 of the license"),
    ("agpl", "licensed under the gnu affero general public license version 3", "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     "redistribution and use in source and binary forms"),
    ("bsd-2-clause", "licensed under the bsd 2 clause license", "bsd 2 clause"),
    ("bsd-3-clause", "licensed under the bsd 3 clause license", "bsd 3 clause"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse"
     " or promote products derived from this software", "nor the names of its contributors may be used to endorse or promote"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("mpl-2.0", "licensed under the mozilla public license version 2 0", "mozilla public license version 2 0"),
    ("epl", "made available under the terms of the eclipse public license v 2 0", "eclipse public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is"
     " hereby granted", "permission to use copy modify and or distribute"),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     "free and unencumbered software released into the public domain"),
)

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
# Words of a template whose postings are intersected, the rarest first; more of them cost lookups and
# save comparisons, the result is the same.
RARE_WORDS = 3

RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string,"
    " score double"
)


def words_of(text: str) -> list[bytes]:
    """Words in order: letters and digits of ASCII, A-Z lower-cased, and everything beyond ASCII."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


class Index:
    """Word to position in the mandatory phrases of the few templates."""

    def __init__(self, templates=TEMPLATES, base=BASE_PHRASES) -> None:
        self.labels = [label for label, _, _ in templates]
        self.words = [words.encode().split() for _, words, _ in templates]
        self.keys = []
        for words, (_, _, phrase) in zip(self.words, templates):
            key = phrase.encode().split()
            at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
            self.keys.append((at, key))
        # word of the phrase to its positions in the template, for each template
        self.postings: list[dict[bytes, list[int]]] = []
        for at, key in self.keys:
            at_word: dict[bytes, list[int]] = {}
            for i, word in enumerate(key, at):
                at_word.setdefault(word, []).append(i)
            self.postings.append(at_word)
        self.base = [(phrase.encode().split(), label) for phrase, label in base]
        self.seen = {w for _, key in self.keys for w in key} | {w for phrase, _ in self.base for w in phrase}


def _columns(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(
        F.col(f"`{key}`").cast("bigint").alias("doc_id"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", index: Index | None = None) -> dict:
    """({word: files that hold it}, files) over all rows; the words are those of the templates."""
    index = index or Index()
    seen = index.seen

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, files = Counter(), 0
        for batch in batches:
            for value in batch.column(0):
                files += 1
                found.update(seen.intersection(words_of(value.as_py())))
        words = [""] + [w.decode() for w in found]
        yield pa.RecordBatch.from_pydict({"word": words, "files": [files, *found.values()]})

    rows = _columns(docs, key, text).select("text").mapInArrow(count, "word string, files long")
    # one row for each template word and the total: bounded by the templates
    totals = {r[0]: r[1] for r in rows.groupBy("word").agg(F.sum("files")).collect()}
    return {"files": totals.pop("", 0), "words": {w.encode(): n for w, n in totals.items()}}


def _alignments(postings: dict[bytes, list[int]], places: dict[bytes, list[int]], looked_up: list[bytes]) -> set[int]:
    """Places of the template's first word that all looked-up words agree on."""
    # a word that the phrase repeats offers several; the true one is in every word's set
    starts: set[int] | None = None
    for word in looked_up:
        if starts is None:
            starts = {place - position for place in places[word] for position in postings[word]}
        else:
            held = {place - position for place in places[word] for position in postings[word]}
            starts &= held
        if not starts:
            break
    return starts or set()


def _scan_one(words: list[bytes], index: Index, idf: dict[bytes, float], rare: int):
    """(base places as (start, label), {template label: agreement}) of one file."""
    base, scores = [], {}
    places: dict[bytes, list[int]] = {}
    for i, word in enumerate(words):
        if word in index.seen:
            places.setdefault(word, []).append(i)
    if not places:
        return base, scores
    for phrase, label in index.base:
        for start in places.get(phrase[0], ()):
            if words[start : start + len(phrase)] == phrase:
                base.append((start, label))
    for template, postings in enumerate(index.postings):
        at, phrase = index.keys[template]
        if not all(w in places for w in phrase):
            continue
        looked_up = sorted(postings, key=lambda w: (-idf.get(w, 0.0), w))[:rare]
        whole, label = index.words[template], index.labels[template]
        for start in _alignments(postings, places, looked_up):
            # the template may begin before the file does, its phrase may not
            if start + at >= 0 and words[start + at : start + at + len(phrase)] == phrase:
                there = words[max(start, 0) : start + len(whole)]
                same = sum(a == b for a, b in zip(whole[max(-start, 0) :], there)) / len(whole)
                scores[label] = max(scores.get(label, 0.0), same)
    return base, scores


def scan(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    templates=TEMPLATES,
    base=BASE_PHRASES,
    rare: int = RARE_WORDS,
) -> DataFrame:
    """One row per file: base places, base labels, all labels and the best agreement (0 to 1).

    ``rare`` words of a template are looked up, at least one.
    """
    index = Index(templates, base)
    counts = word_counts(docs, key, text, index)
    files = counts["files"]
    idf = {w: math.log((1 + files) / (1 + counts["words"].get(w, 0))) for w in index.seen}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out = {name: [] for name in names}
                for doc_id, value in zip(part.column(0), part.column(1)):
                    words = words_of(value.as_py())
                    places, scores = _scan_one(words, index, idf, rare)
                    starts = [s for s, _ in places]
                    base_labels = sorted({label for _, label in places})
                    out["doc_id"].append(doc_id.as_py())
                    out["n_words"].append(len(words))
                    out["n_base"].append(len(places))
                    out["first_word"].append(min(starts, default=None))
                    out["last_word"].append(max(starts, default=None))
                    out["base_labels"].append(",".join(base_labels))
                    out["labels"].append(",".join(sorted({*base_labels, *scores})))
                    out["score"].append(1.0 if base_labels else max(scores.values(), default=0.0))
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    names = [part.split()[0] for part in RESULT.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(n, kinds[part.split()[1]]) for n, part in zip(names, RESULT.split(", "))])
    return _columns(docs, key, text).mapInArrow(rows, RESULT)


@query("op3_license_scan")
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of every document."""
    return scan(read(spark, sf_dir, "documents"))
