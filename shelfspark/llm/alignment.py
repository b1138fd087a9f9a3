"""Cross-tokenizer alignment by tokenizer spans.

Both tokenizers say which characters (tokenizers) or bytes (sentencepiece) each token covers. These
spans are the coarse cuts: a token with a span of its own ends where the span does. Tokens that
share a character (the parts of a multibyte character, byte-fallback tokens, whose spans are empty)
are refined by the lengths of their decoded bytes. Where tokens of both sides end at one byte, a
group ends; all tokens of a group's two sides are linked.

The installed sentencepiece has no immutable proto any more; its offset mapping holds the same
spans.

Texts are cut into chunks at blanks and line ends after other characters, and at punctuation marks
after common letters, where neither tokenizer joins anything (both files are checked for that; marks
that the piece file joins to letters are not cut off, and with other rules a text is one chunk).
Tokens and groups of a chunk are worked out once and kept up to a bound in bytes; when it is reached,
chunks that came more than once stay, the most frequent ones first. Longer chunks are not kept.

Counts of linked id pairs are taken over all documents. The pairs held by most documents, at most
``FREQUENT`` of them, are broadcast to the stored links; the rest, by that choice rare, are joined
by a shuffle. Texts move through neither.

Defined cases: a null or empty text, and one whose tokens do not spell it, has no tokens: all its
figures are 0. Repeated rows are documents of their own. A null doc_id stays null. Extra columns
are ignored. A special token's string inside a text is plain text.
"""

from __future__ import annotations

import json
import os
import re
import string
from array import array
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfspark.llm.common import read, slices, stored, text_of
from shelfspark.llm.registry import query

BYTE_TOKENIZER = "byte_bpe_50k.json"
PIECE_TOKENIZER = "piece_bpe_32k.model"
# Bytes of chunk alignments that a task keeps, and the longest chunk it keeps.
KEPT_BYTES = 96 << 20
KEPT_CHUNK = 64
# Characters of chunks that are tokenised in a row, and of texts that are cut at a time.
ROW = 1 << 16
WINDOW = 1 << 20
# Letters after which marks are cut off; no mark is a letter, digit or blank to either tokenizer.
LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]"
MARKS = string.punctuation
# Kinds of pieces that no text is matched with: unknown, control and byte pieces.
UNMATCHED = {2, 3, 6}
# Groups with more links than this are linked id by id, not occurrence by occurrence.
SMALL_GROUP = 64
# Id pairs that are broadcast (long, long, boolean): 10 MB.
FREQUENT = 1 << 18
# Kinds of characters, as bits: blank or ▁; blank or line end; LETTER; mark.
SPACE, CUT_OFF, LETTERS, MARK = 1, 2, 4, 8
# An id pair as one number: a << PAIR | b.
PAIR = 32

ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string,"
    " links array<struct<pair: long, times: int>>"
)


def byte_letters() -> dict[str, int]:
    """Letters by which byte-level vocabularies write bytes: printable ones as such, others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def refined_ends(begin: np.ndarray, end: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends of tokens from their coarse byte spans, refined by the sizes of their decoded bytes.

    Tokens whose spans overlap, and tokens with an empty span together with the next one, form a
    run: it begins where its first span does, and its tokens follow one another by their sizes.
    """
    if not len(begin):
        return begin
    new = np.ones(len(begin), bool)
    new[1:] = (begin[1:] >= np.maximum.accumulate(end)[:-1]) & (begin[:-1] < end[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    total = np.cumsum(sizes)
    return begin[first] + total - (total - sizes)[first]


class Vocabulary:
    """Decoded bytes of every id, in one array."""

    def __init__(self, said: list[bytes]) -> None:
        self.sizes = np.array([len(x) for x in said], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(said), np.uint8)

    def spells(self, ids: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Whether each token's bytes are those before its end."""
        sizes = self.sizes[ids]
        runs = np.cumsum(sizes) - sizes
        step = np.arange(int(sizes.sum())) - np.repeat(runs, sizes)
        place = step + np.repeat(ends - sizes, sizes)
        good = np.zeros(len(place), bool)
        there = (place >= 0) & (place < len(data))
        own = (step + np.repeat(self.starts[ids], sizes))[there]
        good[there] = self.data[own] == data[place[there]]
        bad = np.concatenate([np.zeros(1, np.int64), np.cumsum(~good)])
        return bad[runs + sizes] == bad[runs]


def _byte_starts(text: str) -> np.ndarray:
    """Byte offset of each character's start, and of the end."""
    if text.isascii():
        return np.arange(len(text) + 1)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    width = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(width)])


def _pairs_of(spans: list[tuple[int, int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(spans), np.int64, 2 * len(spans)).reshape(-1, 2)


def _decimals(values: np.ndarray, after: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Decimal numbers, each followed by its separator, in a row; and where each begins, and the end."""
    width = len(str(int(values.max()))) if len(values) else 1
    powers = 10 ** np.arange(width - 1, -1, -1)
    digits = values[:, None] // powers
    shown = digits > 0
    shown[:, -1] = True
    table = np.empty((len(values), width + 1), np.uint8)
    table[:, :-1] = digits % 10 + 48
    table[:, -1] = after
    shown = np.concatenate([shown, np.ones((len(values), 1), bool)], axis=1)
    begins = np.concatenate([np.zeros(1, np.int64), np.cumsum(shown.sum(axis=1))])
    return table[shown].tobytes(), begins


def _summed(owner: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Times summed by owner and pair, in that order."""
    order = np.lexsort((pairs, owner))
    owner, pairs, times = owner[order], pairs[order], times[order]
    new = np.ones(len(pairs), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (pairs[1:] != pairs[:-1])
    where = np.flatnonzero(new)
    return owner[where], pairs[where], np.add.reduceat(times, where) if len(where) else times


def _linked(ids_a: np.ndarray, of_a: np.ndarray, ids_b: np.ndarray, of_b: np.ndarray, n: int) -> tuple:
    """(group, pair, times) of all linked occurrences; tokens of one group are in a row."""
    many_a, many_b = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)
    small = many_a * many_b <= SMALL_GROUP
    first_b = np.cumsum(many_b) - many_b
    left = np.flatnonzero(small[of_a])
    wide = many_b[of_a[left]]
    at_b = np.arange(int(wide.sum())) - np.repeat(np.cumsum(wide) - wide, wide) + np.repeat(first_b[of_a[left]], wide)
    group = np.repeat(of_a[left], wide)
    pairs = np.repeat(ids_a[left], wide) << PAIR | ids_b[at_b]
    times = np.ones(len(pairs), np.int64)
    first_a = np.cumsum(many_a) - many_a
    for g in np.flatnonzero(~small).tolist():
        # a long group without common ends mostly repeats few ids
        a, n_a = np.unique(ids_a[first_a[g] : first_a[g] + many_a[g]], return_counts=True)
        b, n_b = np.unique(ids_b[first_b[g] : first_b[g] + many_b[g]], return_counts=True)
        pairs = np.concatenate([pairs, np.repeat(a, len(b)) << PAIR | np.tile(b, len(a))])
        times = np.concatenate([times, np.repeat(n_a, len(b)) * np.tile(n_b, len(a))])
        group = np.concatenate([group, np.full(len(a) * len(b), g)])
    return group, pairs, times


class ChunkAligner:
    """Aligned tokens of chunks of text, each worked out once while it is kept."""

    def __init__(self, byte_file: str, piece_file: str, kept: int = KEPT_BYTES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_file)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=piece_file)
        self.kept = kept
        letters = byte_letters()
        said = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            said[i] = bytes(letters[c] for c in token) if set(token) <= letters.keys() else b""
        self.words_a = Vocabulary(said)
        self.words_b = Vocabulary(
            [
                bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
            ]
        )
        model = sentencepiece_model_pb2.ModelProto()
        with open(piece_file, "rb") as file:
            model.ParseFromString(file.read())
        with open(byte_file, encoding="utf-8") as file:
            rules = json.load(file)
        self.by_chunk = self._cuts_are_safe(rules, model)
        self.marks = self._free_marks(model)
        self.kinds = self._kinds(self.marks)
        self.clear()

    @staticmethod
    def _cuts_are_safe(rules: dict, model) -> bool:
        """Whether neither side joins anything over a blank or line end that follows another character."""
        step = rules["pre_tokenizer"] or {}
        plain_a = rules["normalizer"] is None and step.get("type") == "ByteLevel"
        plain_a = plain_a and step.get("use_regex", False) and not step.get("add_prefix_space", True)
        normal, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        plain_b = normal.name == "identity" and normal.add_dummy_prefix and not normal.remove_extra_whitespaces
        # added tokens that are not special are matched before texts are cut into words
        plain_a = plain_a and all(t["special"] for t in rules.get("added_tokens") or [])
        joined = re.compile("[^▁]▁|.\n|\n.", re.DOTALL)
        # 2: BPE; 4: pieces that the user defined are matched whatever stands around them
        plain_b = plain_b and model.trainer_spec.model_type == 2 and 4 not in kinds
        return plain_a and plain_b and not any(joined.search(p.piece) for p in model.pieces)

    @staticmethod
    def _free_marks(model) -> str:
        """The marks that no piece joins to a letter before them."""
        joined = re.compile(f"{LETTER}([{re.escape(MARKS)}])")
        met = {m for p in model.pieces if p.type not in UNMATCHED for m in joined.findall(p.piece)}
        return "".join(m for m in MARKS if m not in met)

    @staticmethod
    def _kinds(marks: str) -> np.ndarray:
        """What each character is, up to the last blank one: characters from there on are none of these."""
        kinds = np.zeros(0x3002, np.uint8)
        for i in range(len(kinds) - 1):
            c = chr(i)
            kinds[i] = (
                SPACE * (c.isspace() or c == "▁")
                | CUT_OFF * (c in " \n")
                | LETTERS * bool(re.fullmatch(LETTER, c))
                | MARK * (c in marks)
            )
        return kinds

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.groups: list[str] = []
        self.figures = array("q")
        self.pairs, self.times, self.start = array("q"), array("q"), array("q", [0])
        self.used = np.zeros(0, np.int64)
        self.held = 0

    def _thin(self) -> None:
        """Make room: of the chunks that came more than once, the most frequent ones stay, up to half
        of the bound. Their counts are halved, so that chunks that come no more go in the end."""
        chunks = list(self.code)
        codes = np.fromiter(self.code.values(), np.int64, len(chunks))
        start = np.array(self.start)
        links = np.diff(start)[codes]
        said = np.fromiter(map(len, self.groups), np.int64, len(self.groups))[codes]
        size = self._bytes(np.fromiter(map(len, chunks), np.int64, len(chunks)), links, said)
        used = self.used[codes]
        order = np.argsort(-used, kind="stable")
        order = order[(used[order] > 1) & (np.cumsum(size[order]) <= self.kept // 2)]
        codes, links = codes[order], links[order]
        at = np.arange(int(links.sum())) + np.repeat(start[codes] - (np.cumsum(links) - links), links)
        groups = [self.groups[c] for c in codes.tolist()]
        # copies, as the tables are about to go
        figures = np.array(self.figures).reshape(-1, 4)[codes]
        pairs, times = np.array(self.pairs)[at], np.array(self.times)[at]
        self.clear()
        self.code = {chunks[i]: code for code, i in enumerate(order.tolist())}
        self.groups = groups
        self.figures.frombytes(figures.tobytes())
        self.pairs.frombytes(pairs.tobytes())
        self.times.frombytes(times.tobytes())
        self.start.frombytes(np.cumsum(links).tobytes())
        self.used = used[order] // 2
        self.held = int(size[order].sum())

    @staticmethod
    def _bytes(length: np.ndarray, links: np.ndarray, said: np.ndarray) -> np.ndarray:
        """Bytes that chunks take, from their characters, links and characters of groups."""
        return 270 + length + 16 * links + said

    def chunks(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The pieces of blank + text that are aligned each on its own, of all texts; and how many each has.

        They are cut before a blank or line end that follows another character and is followed by any,
        and before a mark that follows a letter.
        """
        held = [" " + t for t in texts if t]
        counts = np.array([bool(t) for t in texts], np.int64)
        if not self.by_chunk or not held:
            return held, counts
        whole = "".join(held)
        ends = np.cumsum(np.fromiter(map(len, held), np.int64, len(held)))
        cut = np.zeros(len(whole) + 1, bool)
        for first in range(1, len(whole), WINDOW):
            # with the character before
            codes = np.frombuffer(whole[first - 1 : first + WINDOW].encode("utf-32-le"), np.uint32)
            kind = self.kinds[np.minimum(codes, len(self.kinds) - 1)]
            before, here = kind[:-1], kind[1:]
            blank = (here & CUT_OFF > 0) & (before & SPACE == 0)
            cut[first : first + len(here)] = blank | (before & LETTERS > 0) & (here & MARK > 0)
        # a blank at the end of a text stays with what is before it
        cut[[end - 1 for end in ends.tolist() if whole[end - 1] in " \n"]] = False
        cut[0] = True
        cut[ends] = True
        at = np.flatnonzero(cut)
        counts[counts > 0] = np.diff(np.searchsorted(at, ends), prepend=0)
        bounds = at.tolist()
        return [whole[a:b] for a, b in zip(bounds[:-1], bounds[1:])], counts

    def _learn(self, fresh: set[str]) -> None:
        """Chunks are tokenised in rows, where they are cut from one another as in their texts."""
        row, size = [], 0
        # a row begins with a blank or a line end, and a mark follows a letter
        for chunk in sorted(fresh):
            marked = self.by_chunk and chunk[0] in self.marks
            alone = not self.by_chunk or len(chunk) == 1 and not marked
            # nothing is cut off after a blank
            if row and (size + len(chunk) > ROW or alone or row[-1][-1].isspace() or row[-1][-1] == "▁"):
                self._add(row)
                row, size = [], 0
            if marked:
                row.append(" a")
            row.append(chunk)
            size += len(chunk)
        if row:
            self._add(row)

    def _tokens_a(self, text: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = self.a.encode(text, add_special_tokens=False)
        spans = starts[_pairs_of(found.offsets)]
        return np.array(found.ids, np.int64), spans[:, 0], spans[:, 1]

    def _tokens_b(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # sentencepiece adds the blank before the text; one before a line end is dropped again
        added = text[0] == " "
        found = self.b.encode(text[added:], return_type="offset_mapping", return_bytes=True)
        spans = _pairs_of(found["offsets"])
        ids = np.array(found["ids"], np.int64)
        if not added:
            return ids[1:], spans[1:, 0], spans[1:, 1]
        spans += 1
        spans[:1, 0] = 0
        return ids, spans[:, 0], spans[:, 1]

    def _add(self, chunks: list[str]) -> None:
        text = "".join(chunks)
        starts = _byte_starts(text)
        data = np.frombuffer(text.encode(), np.uint8)
        bounds = starts[np.cumsum([0, *map(len, chunks)])]
        sides, good = [], np.ones(len(chunks), bool)
        for vocabulary, (ids, begin, end) in ((self.words_a, self._tokens_a(text, starts)), (self.words_b, self._tokens_b(text))):
            sizes = vocabulary.sizes[ids]
            ends = refined_ends(begin, end, sizes)
            owner = np.searchsorted(bounds, begin, side="right") - 1
            owner[begin >= bounds[-1]] = len(chunks) - 1
            before = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
            fits = vocabulary.spells(ids, ends, data) & ((ends - sizes == before) | (ends - sizes == bounds[owner]))
            good[owner[~fits]] = False
            # the last token of a chunk ends where the chunk does
            reached = np.zeros(len(chunks), np.int64)
            np.maximum.at(reached, owner, ends)
            good &= reached == bounds[1:]
            sides.append((ids, ends, owner))
        (ids_a, ends_a, own_a), (ids_b, ends_b, own_b) = [
            tuple(x[good[side[2]]] for x in side) for side in sides
        ]
        # both rise, but over chunks that are left out
        common = ends_a[ends_b[np.minimum(np.searchsorted(ends_b, ends_a), len(ends_b) - 1)] == ends_a] if len(ends_b) else ends_b
        of_a, of_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        group_owner = np.searchsorted(bounds, common, side="left") - 1
        group, pairs, times = _linked(ids_a, of_a, ids_b, of_b, len(common))
        owner, pairs, times = _summed(group_owner[group], pairs, times)
        n = len(chunks)
        counts = [np.bincount(x, minlength=n) for x in (own_a, own_b, group_owner)]
        links = np.zeros(n, np.int64)
        np.add.at(links, owner, times)
        self.figures.frombytes(np.stack([*counts, links], axis=1).astype(np.int64).tobytes())
        said = self._said(ids_a, of_a, own_a, ids_b, of_b, own_b, n)
        self.code.update(zip(chunks, range(len(self.groups), len(self.groups) + n)))
        self.groups.extend(said)
        base = len(self.pairs)
        self.pairs.frombytes(pairs.tobytes())
        self.times.frombytes(times.tobytes())
        self.start.frombytes((base + np.searchsorted(owner, np.arange(1, n + 1))).tobytes())
        self.held += 270 * n + len(text) + 16 * len(pairs) + sum(map(len, said))

    @staticmethod
    def _said(ids_a, of_a, own_a, ids_b, of_b, own_b, n: int) -> list[str]:
        """The groups of each chunk as text; empty where its tokens do not spell it."""
        group = np.concatenate([of_a, of_b])
        side = np.concatenate([np.zeros(len(of_a), np.int64), np.ones(len(of_b), np.int64)])
        order = np.lexsort((side, group))
        ids, group, side = np.concatenate([ids_a, ids_b])[order], group[order], side[order]
        owner = np.concatenate([own_a, own_b])[order]
        last = np.ones(len(ids), bool)
        last[:-1] = (group[1:] != group[:-1]) | (side[1:] != side[:-1])
        after = np.where(last, np.where(side == 0, ord("|"), ord(";")), ord(","))
        text, begins = _decimals(ids, after)
        text = text.decode()
        at = begins[np.searchsorted(owner, np.arange(n + 1))].tolist()
        return [text[a : b - 1] if b > a else "" for a, b in zip(at[:-1], at[1:])]

    def align(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(groups, n x 4 figures, n + 1 offsets, pairs, times) of texts; the pairs of one differ."""
        if self.held > self.kept:
            self._thin()
        chunks, counts = self.chunks(texts)
        flat = np.fromiter(map(self.code.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(flat < 0)
        unknown = [chunks[i] for i in missing.tolist()]
        fresh = set(unknown)
        self._learn(fresh)
        flat[missing] = np.fromiter(map(self.code.__getitem__, unknown), np.int64, len(unknown))
        owner = np.repeat(np.arange(len(texts)), counts)
        table = np.frombuffer(self.figures, np.int64).reshape(-1, 4) if self.figures else np.zeros((0, 4), np.int64)
        # a chunk that is not spelt makes its text one without tokens
        odd = np.zeros(len(texts), bool)
        odd[owner[table[flat, 0] == 0]] = True
        flat, owner = flat[~odd[owner]], owner[~odd[owner]]
        used = np.bincount(flat, minlength=len(self.groups))
        used[: len(self.used)] += self.used
        self.used = used
        counts[odd] = 0
        codes, at = flat.tolist(), np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
        groups = [";".join([self.groups[c] for c in codes[i:j]]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
        total = np.zeros((len(flat) + 1, 4), np.int64)
        np.cumsum(table[flat], axis=0, out=total[1:])
        figures = total[at[1:]] - total[at[:-1]]
        links = self._links(owner, flat, len(texts))
        if any(len(c) > KEPT_CHUNK for c in fresh):
            self._forget_long()
        return groups, figures, *links

    def _links(self, owner: np.ndarray, flat: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start = np.array(self.start)
        # each text's different chunks, with how often they come
        key = np.sort(owner * len(start) + flat)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else key
        key, often = key[first], np.diff(np.append(first, len(key)))
        owner, flat = np.divmod(key, len(start))
        sizes = start[flat + 1] - start[flat]
        first = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        at = np.arange(first[-1]) + np.repeat(start[flat] - first[:-1], sizes)
        pairs, times = np.frombuffer(self.pairs, np.int64), np.frombuffer(self.times, np.int64)
        owner, pairs, times = _summed(np.repeat(owner, sizes), pairs[at], times[at] * np.repeat(often, sizes))
        return np.searchsorted(owner, np.arange(n + 1)), pairs, times

    def _forget_long(self) -> None:
        """Long chunks are found no more; their entries go with the table when it is emptied."""
        for chunk in [c for c in self.code if len(c) > KEPT_CHUNK]:
            del self.code[chunk]


def tokenizer_file(path: str | None, name: str) -> str:
    """A file that every executor can open; by default the public one of that name."""
    if path is None:
        import public_tokenizers

        return public_tokenizers.path(name)
    return path


def aligned(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    byte_file: str | None = None,
    piece_file: str | None = None,
) -> DataFrame:
    """One row per document: its token and group counts, its groups as ``a1,a2|b1;a3|b2,b3``, and its
    linked id pairs with the number of linked occurrences."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = ChunkAligner(tokenizer_file(byte_file, BYTE_TOKENIZER), tokenizer_file(piece_file, PIECE_TOKENIZER))
        for batch in batches:
            for part in slices(batch, "text"):
                groups, figures, offsets, pairs, times = aligner.align(part.column(1).to_pylist())
                links = pa.StructArray.from_arrays([pa.array(pairs), pa.array(times.astype(np.int32))], ["pair", "times"])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        *[pa.array(figures[:, k].copy()) for k in range(4)],
                        pa.array(groups, pa.string()),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), links),
                    ],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"],
                )

    texts = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), text_of(text).alias("text"))
    return texts.mapInArrow(rows, ALIGNED)


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n, best) of links (pair, ...), one row a document and pair: how many documents hold the
    pair, and whether no pair of its a id is held by more. Counts are combined before the shuffle."""
    counts = links.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    # a row for each id of the first vocabulary at most
    highest = counts.groupBy(F.shiftright("pair", PAIR).alias("a")).agg(F.max("n").alias("highest"))
    return counts.join(F.broadcast(highest), F.shiftright("pair", PAIR) == F.col("a")).select(
        "pair", "n", (F.col("n") == F.col("highest")).alias("best")
    )


def _frequent_from(counts: DataFrame, most: int) -> int:
    """The least power of two that at most ``most`` pairs reach in their count."""
    size = F.length(F.bin("n"))
    by_size = counts.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()  # 64 rows at most
    left = most
    for row in sorted(by_size, key=lambda r: -r["size"]):
        left -= row["n"]
        if left < 0:
            return 1 << row["size"]
    return 0


def link_scores(documents: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """Add ``n_best`` and ``count_sum`` to stored documents (row, links, ...), ``row`` being unique."""
    links = documents.select("row", F.inline("links"))
    counts = stored(pair_counts(links), "alignment-pairs")
    least = _frequent_from(counts, frequent)
    # at most ``frequent`` rows
    near = F.broadcast(counts.filter(F.col("n") >= least))

    def sums(scored: DataFrame) -> DataFrame:
        return scored.groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("bigint").alias("n_best"),
            F.sum(F.col("times") * F.col("n")).cast("bigint").alias("count_sum"),
        )

    found = sums(links.join(near, "pair"))
    if least:
        rare = links.join(near.select("pair"), "pair", "left_anti").join(counts.filter(F.col("n") < least), "pair")
        found = found.unionByName(sums(rare))
    kept = [c for c in documents.columns if c not in ("row", "links")]
    nothing = [F.lit(0).cast("bigint").alias(c) for c in ("n_best", "count_sum")]
    base = documents.select("row", *kept, *nothing)
    # each row has one base row, which brings its columns along
    return (
        base.unionByName(found, allowMissingColumns=True)
        .groupBy("row")
        .agg(*[F.max(c).alias(c) for c in kept], F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    )


def _digest(groups: Column) -> Column:
    return F.when(F.col("n_a") == 0, "").otherwise(F.sha2(groups, 256))


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, byte-level against piece tokens."""
    found = aligned(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", _digest(F.col("groups")).alias("groups_sha256"), "links"
    )
    documents = stored(found.withColumn("row", F.monotonically_increasing_id()), "alignment")
    return link_scores(documents).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
