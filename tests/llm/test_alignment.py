"""Token alignment against whole texts aligned byte by byte, and its defined cases."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from shelfspark.llm import alignment
from shelfspark.llm.common import stored
from shelfspark.llm.queries import QUERIES
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, links string, row long, n_a string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "l", 7, "n") for i, t in rows], DOCS).repartition(3)


class Plain:
    """Groups of a whole text from the bytes of its tokens alone."""

    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        letters = alignment.byte_letters()
        self.bytes_a = {i: bytes(letters[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items()}

    def bytes_b(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def groups(self, text):
        if not text:
            return []
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        said_a, said_b = [self.bytes_a[i] for i in a], [self.bytes_b(i) for i in b]
        if b"".join(said_a) != (" " + text).encode() or b"".join(said_b) != (" " + text).encode():
            return []
        ends_a, ends_b = np.cumsum([len(x) for x in said_a]), np.cumsum([len(x) for x in said_b])
        out, i, j = [], 0, 0
        for end in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
            k, m = int(np.searchsorted(ends_a, end)) + 1, int(np.searchsorted(ends_b, end)) + 1
            out.append((a[i:k], b[j:m]))
            i, j = k, m
        return out


@pytest.fixture(scope="module")
def plain():
    return Plain()


def brute(plain, texts):
    """The rows of the contract, texts being (doc_id, text)."""
    found = [(i, plain.groups(t)) for i, t in texts]
    held = Counter()
    for _, groups in found:
        held.update({(x, y) for a, b in groups for x in a for y in b})
    highest = defaultdict(int)
    for (x, _), n in held.items():
        highest[x] = max(highest[x], n)
    out = []
    for i, groups in found:
        links = [(x, y) for a, b in groups for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((
            i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
            sum(held[p] == highest[p[0]] for p in links), sum(held[p] for p in links),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=repr)


def rows_of(spark, rows, frequent=alignment.FREQUENT):
    found = alignment.aligned(docs_of(spark, rows)).withColumn("row", F.monotonically_increasing_id())
    scored = alignment.link_scores(stored(found.withColumn("groups", alignment._digest(F.col("groups"))), "test"), frequent)
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    return sorted((tuple(r[c] for c in names) for r in scored.collect()), key=repr)


PARTS = ["the", " ", "  ", "\n", "\n\n", "\t", "\r\n", " \n ", "é", "naïve", "日本語", "🎉", "𓀀", "👩‍👩‍👧", "á", " ", "　", " ",
         "\x00", "\x1c", "\x85", "▁", "<s>", "</s>", "<|endoftext|>", "<0x0A>", "<unk>", "don't", "we'll", "1234567", "==== ", "----------", "}\r",
         "internationalisation", "x" * 70, "ééé", "ßß", ",", ". ", "﻿", "᠎", "​", "Ω", "ـ", "हिन्दी", "ไทย", "한국어"]


def test_random_texts_equal_whole_texts(spark, plain):
    rng = random.Random(12)
    rows = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 30)))) for i in range(1500)]
    rows += [(5000 + i, t) for i, t in enumerate([" ", "  ", "\n", " \n", "a ", " a", "a\n", "▁", "a ▁b", "é", "\x00", "x" * 5000, "ab " * 3000])]
    want = brute(plain, rows)
    assert rows_of(spark, rows) == want
    # all pairs but the most frequent few by the shuffle
    assert rows_of(spark, rows, frequent=20) == want
    assert sum(r[1] == 0 for r in want) > 10


def test_spans_are_refined_inside_characters():
    begin, end = np.array([0, 2, 4, 4, 4, 4, 12, 14]), np.array([2, 4, 4, 4, 4, 12, 14, 15])
    sizes = np.array([2, 2, 1, 1, 1, 5, 2, 1])
    assert alignment.refined_ends(begin, end, sizes).tolist() == [2, 4, 5, 6, 7, 12, 14, 15]
    # three tokens of one character, the first of which begins in the character before
    assert alignment.refined_ends(np.array([0, 1, 1, 5]), np.array([5, 5, 5, 6]), np.array([2, 2, 1, 1])).tolist() == [2, 4, 5, 6]


def test_long_groups_are_linked_by_id():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 5, 300), rng.integers(0, 7, 200)
    of_a, of_b = np.repeat([0, 1, 2], 100), np.repeat([0, 1, 2], [1, 198, 1])
    group, pairs, times = alignment._linked(a, of_a, b, of_b, 3)
    got = Counter()
    for g, p, n in zip(group.tolist(), pairs.tolist(), times.tolist()):
        got[g, p >> alignment.PAIR, p & 0xFFFFFFFF] += n
    want = Counter((g, x, y) for g in range(3) for x in a[of_a == g].tolist() for y in b[of_b == g].tolist())
    assert got == want


def test_a_full_table_changes_nothing(plain):
    rng = random.Random(4)
    texts = ["".join(rng.choice(PARTS) for _ in range(40)) for _ in range(60)]
    small = alignment.ChunkAligner(*[public_tokenizers.path(f"{n}") for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")], kept=1)
    assert small.by_chunk
    for i in range(0, 60, 7):
        groups = small.align(texts[i : i + 7])[0]
        for text, found in zip(texts[i : i + 7], groups):
            want = plain.groups(text)
            assert found == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want)
        assert not any(len(c) > alignment.KEPT_CHUNK for c in small.code)


def test_files_that_join_over_blanks_are_not_cut():
    rules = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "use_regex": True, "add_prefix_space": False}}
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model.ParseFromString(file.read())
    safe = alignment.ChunkAligner._cuts_are_safe
    assert safe(rules, model)
    assert not safe(rules | {"normalizer": {"type": "NFC"}}, model)
    model.pieces.add(piece="of▁the", score=-1, type=1)
    assert not safe(rules, model)


def aligner(**given):
    names = ("byte_bpe_50k.json", "piece_bpe_32k.model")
    return alignment.ChunkAligner(*map(public_tokenizers.path, names), **given)


def said(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def test_marks_are_cut_off_letters(plain, monkeypatch):
    found = aligner()
    chunks, counts = found.chunks(["word*** word&&&, l'eau", "", "a\n\n b. ", "12.5 x\n"])
    assert chunks == [" word", "***", " word", "&&&,", " l", "'eau", " a", "\n\n b", ". ", " 12.5", " x\n"]
    assert counts.tolist() == [6, 0, 3, 2]
    rng = random.Random(8)
    parts = [*alignment.MARKS, *alignment.MARKS, "don", "s", "é", "straße", "ll", "7", " ", "\n", "日", "Ω", " the", "  ", "▁", "\u2028"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(1500)]
    assert found.align(texts)[0] == [said(plain.groups(t)) for t in texts]
    # texts longer than what is cut at a time
    whole = found.chunks(texts)
    monkeypatch.setattr(alignment, "WINDOW", 7)
    cut = found.chunks(texts)
    assert cut[0] == whole[0] and cut[1].tolist() == whole[1].tolist()


def test_frequent_chunks_outlive_a_full_table(plain):
    small, learnt = aligner(kept=20_000), []
    add = small._add
    small._add = lambda row: (learnt.extend(row), add(row))
    rare = iter(range(10_000))
    for _ in range(40):
        texts = [f"the same words again number{''.join(chr(97 + int(d)) for d in str(next(rare)))}" for _ in range(10)]
        groups, figures, *_ = small.align(texts)
        assert groups == [said(plain.groups(t)) for t in texts]
        assert figures[:, 2].tolist() == [len(plain.groups(t)) for t in texts]
    # chunks of every text are worked out once, although the table was full many times
    assert learnt.count(" same") == 1 and len(small.code) < 200
    # counts fade: what comes no more makes room
    for k in range(30):
        small.align([f"other {'x' * (k + 5)} chunks {'y' * (j + k + 5)}" for j in range(25) for _ in range(2)])
    assert " same" not in small.code and " chunks" in small.code


def test_marks_that_the_model_joins_stay():
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model.ParseFromString(file.read())
    assert alignment.ChunkAligner._free_marks(model) == alignment.MARKS
    model.pieces.add(piece="▁etc!.", score=-1, type=1)
    assert alignment.ChunkAligner._free_marks(model) == alignment.MARKS.replace("!", "")
    rules = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "use_regex": True, "add_prefix_space": False}}
    safe = alignment.ChunkAligner._cuts_are_safe
    assert safe(rules, model)
    assert not safe(rules | {"added_tokens": [{"content": "a b", "special": False}]}, model)


def test_defined_cases(spark, plain):
    rows = [(1, None), (2, ""), (None, "no id"), (5, "Two words"), (5, "Two words"), (6, "word " * 60_000), (7, "é日本 🎉" * 3)]
    assert rows_of(spark, rows) == brute(plain, rows)
    assert rows_of(spark, rows[:2]) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    assert alignment.aligned(docs_of(spark, rows).limit(0)).count() == 0


def test_query_equals_brute_force(spark, sf_dir, plain):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = QUERIES["op12_token_alignment"](spark, sf_dir).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(map(tuple, found.collect()), key=repr) == brute(plain, rows)
