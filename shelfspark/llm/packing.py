"""Packing by power-of-two decomposition.

A document's token ids, closed by an end id, are cut into pieces of binary lengths: as many of
``max_length`` as fit, then one piece for each set bit of the rest, longest first. Every piece is a
sequence of its own, of exactly its length, so nothing is padded and no sequence crosses documents.
Sequences of one length form a bucket (``bucket`` is the length's logarithm); batches are drawn from
one bucket at a time, and ``write_buckets`` lays the sequences out that way.

Every row is cut where it is read: nothing is shuffled, and a hot source or very long text needs no
care beyond its own task. Sequence ids number the pieces of a task in order, so a lost task gives
the same ids again.

The given tokenizer drops white space and joins nothing over it, so texts are cut at blanks and line
ends and each different chunk is tokenised once per task. Chunks of common scripts are cut into words
here, many at a time, and each different word goes through the vocabulary's merges once; all other
chunks go through the whole tokenizer. The tables are emptied when they have grown to ``KEPT_BYTES``.
A tokenizer file with other rules gets whole texts.

Defined cases: null text is empty, and an empty text is its end id alone (one piece of 1). Repeated
rows are packed each. A null doc_id stays null. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfspark.llm.common import give_back, read, slices
from shelfspark.llm.registry import query

MAX_LENGTH = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
# Bytes of chunks, words and their ids that a task keeps.
KEPT_BYTES = 80 << 20
# How the given tokenizer takes words out of a normalised text, as its file says: the pattern matches
# no white space, and what it leaves out is dropped.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL_STEPS = ("NFC", "Replace", "Lowercase")

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int, offset long, ids array<int>"
)


def cut(n: int, max_length: int = MAX_LENGTH) -> list[int]:
    """Lengths of the pieces of n tokens: powers of two, longest first."""
    whole, rest = divmod(n, max_length)
    return [max_length] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a printable byte as itself and the others as letters from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


# Chunks that are lower-cased and cut into words here, being in composed form; control characters,
# combining marks, letters with a canonical twin or two small forms, rarer scripts and the brackets
# of special tokens are left to the tokenizer.
_PLAIN = re.compile("[!-;=-~\u00c0-\u02af\u0370-\u0373\u0375-\u037d\u037f-\u0386\u0388-\u03a2\u03a4-\u0482\u048a-\u04ff]+")
# The word pattern over these characters, and the line end that stands between chunks.
_WORDS = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


class IdTable:
    """Ids of strings: a code for each, and one array of all ids."""

    def __init__(self) -> None:
        self.code: dict[str, int] = {}
        self.ids = array("I")
        self.start = array("q", [0])

    def gathered(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the strings in a row, n + 1 offsets)."""
        start, ids = np.frombuffer(self.start, np.int64), np.array([], np.uint32)
        if self.ids:
            ids = np.frombuffer(self.ids, np.uint32)
        first = start[codes]
        lengths = start[codes + 1] - first
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        return ids[np.arange(ends[-1]) + np.repeat(first - ends[:-1], lengths)], ends

    def add(self, strings: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        """Strings with their ids in a row and n + 1 offsets."""
        self.code.update(zip(strings, range(len(self.code), len(self.code) + len(strings))))
        self.start.frombytes((len(self.ids) + ends[1:]).astype(np.int64).tobytes())
        self.ids.frombytes(ids.astype(np.uint32).tobytes())

    def size(self) -> int:
        return 160 * len(self.code) + 4 * len(self.ids)


class ChunkTokenizer:
    """Token ids of texts, tokenising each different chunk between blanks and line ends once while
    it is kept."""

    def __init__(self, path: str, kept: int = KEPT_BYTES) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        with open(path, encoding="utf-8") as file:
            self.by_chunk = self._drops_white_space(json.load(file))
        self.kept = kept
        self.clear()

    @staticmethod
    def _drops_white_space(rules: dict) -> bool:
        """Whether the file's rules are the known ones, under which chunks stand alone."""
        normal, split = rules["normalizer"] or {}, rules["pre_tokenizer"] or {}
        steps = tuple(s["type"] for s in normal.get("normalizers", ()))
        first = (split.get("pretokenizers") or [{}])[0]
        taken = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
        plain = not any(t["lstrip"] or t["rstrip"] or any(map(str.isspace, t["content"])) for t in rules["added_tokens"])
        return bool(taken and plain and steps == NORMAL_STEPS and first["pattern"].get("Regex") == WORD_PATTERN)

    def clear(self) -> None:
        self.table = IdTable()

    def _word(self, word: str) -> list[int]:
        raw = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return [token.id for token in self.model.tokenize(raw)]

    def _learn(self, fresh: list[str]) -> None:
        """Words and chunks share one table: a word is also the chunk of that spelling."""
        code = self.table.code
        plain, odd = [], []
        for chunk in fresh:
            (plain if _PLAIN.fullmatch(chunk) else odd).append(chunk)
        row = _WORDS.findall("\n".join(plain).lower()) if plain else []
        words = list(set(row) - code.keys() - {"\n"})
        self._store(words, [self._word(w) for w in words])
        if plain:
            # the words of all plain chunks in a row; a line end ends a chunk
            codes = np.fromiter(map(code.get, row, repeat(-1)), np.int64, len(row))
            ids, ends = self.table.gathered(codes[codes >= 0])
            at = np.concatenate([np.zeros(1, np.int64), np.cumsum(codes >= 0)[codes < 0], np.array([(codes >= 0).sum()])])
            new = np.fromiter((c not in code for c in plain), bool, len(plain))
            sizes = np.diff(ends[at])
            self.table.add(
                [c for c, n in zip(plain, new.tolist()) if n],
                ids[np.repeat(new, sizes)],
                np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes[new])]),
            )
        odd = [c for c in odd if c not in code]
        self._store(odd, [self.tokenizer.encode(c, add_special_tokens=False).ids for c in odd])

    def _store(self, strings: list[str], ids: list[list[int]]) -> None:
        flat = np.array([i for x in ids for i in x], np.uint32)
        self.table.add(strings, flat, np.cumsum([0, *map(len, ids)]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, n + 1 offsets)."""
        if not self.by_chunk:
            found = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
            return np.array([i for ids in found for i in ids], np.uint32), np.cumsum([0, *map(len, found)])
        counts = np.array([text.count(" ") + text.count("\n") + 1 for text in texts], np.int64)
        chunks = " ".join(texts).replace("\n", " ").split(" ")
        if self.table.size() > self.kept:
            self.clear()
        self._learn(list(set(chunks) - self.table.code.keys()))
        codes = np.fromiter(map(self.table.code.__getitem__, chunks), np.int64, len(chunks))
        ids, ends = self.table.gathered(codes)
        return ids, ends[np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])]


def pieces(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    max_length: int = MAX_LENGTH,
    end_id: int = END_ID,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece, with its ids if asked for; ``max_length`` is a power of two.

    ``tokenizer`` is a tokenizer file that every executor can open; by default the public one.
    """
    if max_length & (max_length - 1):
        raise ValueError(f"max_length must be a power of two, not {max_length}")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        give_back()
        coder = ChunkTokenizer(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, at = coder.encode(part.column(1).to_pylist())
                yield _pieces_of(part.column(0).to_pylist(), ids, at)

    def _pieces_of(keys: list, ids: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        owner, start, length, crc, tokens, own = [], [], [], [], [], []
        for i, doc_id in enumerate(keys):
            whole = np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4")
            begin = 0
            for size in cut(len(whole), max_length):
                piece = whole[begin : begin + size]
                owner.append(doc_id)
                start.append(begin)
                length.append(size)
                crc.append(zlib.crc32(piece.tobytes()))
                tokens.append(len(whole))
                if with_ids:
                    own.append(piece.astype(np.int32))
                begin += size
        out = {
            "doc_id": pa.array(owner, pa.int64()),
            "start": pa.array(start, pa.int64()),
            "length": pa.array(length, pa.int64()),
            "ids_crc32": pa.array(crc, pa.int64()),
            "doc_tokens": pa.array(tokens, pa.int64()),
            "bucket": pa.array([n.bit_length() - 1 for n in length], pa.int32()),
            "offset": pa.array(np.zeros(len(length), np.int64)),
        }
        if with_ids:
            out["ids"] = pa.array(own, pa.list_(pa.int32()))
        return pa.RecordBatch.from_pydict(out)

    kind = PIECES if with_ids else PIECES.removesuffix(", ids array<int>")
    texts = docs.select(
        F.col(f"`{key}`").cast("bigint").alias("doc_id"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    return texts.mapInArrow(rows, kind).withColumn("sequence_id", F.monotonically_increasing_id())


def write_buckets(packed: DataFrame, path: str) -> None:
    """Sequences laid out by length; rebalancing splits a large bucket over many tasks."""
    packed.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)


@query("op7_power_packing")
def op7_power_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as sequences of binary lengths."""
    return pieces(read(spark, sf_dir, "documents"), with_ids=False).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"
    )
