"""Secret scan: sliding-window Shannon entropy by character class over candidate strings.

A candidate is a maximal run of token characters, long enough for the shortest window. Inside it,
each character class (hexadecimal, capitals with digits, base64) has its own runs, window length
and least entropy. A window slides over a run one character at a time: the counts of the entering
and the leaving character are changed and the sum of n * log2 n is kept, in whole numbers, so that
millions of steps add no rounding. Windows that are random enough and mix enough sorts of characters
are joined into spans. Spans an allow list knows (identifiers, alphabets, placeholders, addresses,
published checksums) are dropped. To these come the fixed patterns: assignments to a telling name,
access key ids and long hexadecimal runs; the allow list never touches them.

Texts are judged whole, where they are read: nothing is shuffled, and a hot source needs no care.
Patterns compiled to automata pass over a batch first; only texts that may hold something are
walked in Python.

Defined cases: null text is empty and has no spans. Repeated rows are judged each. A null doc_id
stays null. Extra columns are ignored. Spans count code points, the end is exclusive; they come by
start, then in the order of kinds. A span of a class may lie in a span of another kind.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfspark.llm.common import read, slices, text_of
from shelfspark.llm.registry import query

# Fixed patterns of the contract, their order, and the least length of group or match.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE_KINDS = ("assign", "access", "hex")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32

TOKEN = "A-Za-z0-9+/_=-"


@dataclass(frozen=True)
class CharClass:
    """Runs of ``characters`` are windowed; a window counts from ``bits`` of entropy a character on.

    ``sorts`` is how many of the sorts digit, capital and small letter a window must hold.
    """

    kind: str
    characters: str
    window: int
    bits: float
    sorts: int


# Random windows reach the least entropy nearly always, words and names do not: a window of n draws
# from k symbols has about log2 k - (k - 1) / (2 n ln 2) bits.
CLASSES = (
    CharClass("entropy_hex", "0-9A-Fa-f", 24, 3.0, 2),
    CharClass("entropy_capital", "A-Z0-9", 20, 3.5, 2),
    CharClass("entropy_base64", TOKEN, 24, 4.0, 3),
)


@dataclass(frozen=True)
class AllowList:
    """Harmless strings: ``inside`` is searched in the span's own text, ``candidate`` in the candidate
    that holds it, ``before`` in at most ``look_back`` characters that end where the candidate begins."""

    inside: tuple[str, ...] = (
        r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
        r"(?i)example|placeholder|changeme|your[_-]",
        r"(?i)abcdefghijkl|mnopqrstuvwx|0123456789",
    )
    candidate: tuple[str, ...] = (r"(?i)^(?:md5|sha1|sha256|sha384|sha512)[=-]",)
    before: tuple[str, ...] = (
        r"(?i)\b[a-z][a-z0-9+.-]*://\S*$",
        r"(?i)\bdata:[a-z0-9/+.-]*;base64,$",
        r"(?i)\b(?:md5|sha1|sha256|sha384|sha512):$",
    )
    look_back: int = 2048


ALLOWED = AllowList()
SPANS = "doc_id long, spans array<struct<kind: string, start: int, end: int, bits: double>>"

# n * log2 n in units of 2 ** -32, for counts in a window.
_UNIT = 1 << 32


def _weights(window: int) -> list[int]:
    return [0] + [round(n * math.log2(n) * _UNIT) for n in range(1, window + 2)]


class SecretScanner:
    """The spans of one text; patterns and tables are built once per task."""

    def __init__(self, classes: tuple[CharClass, ...] = CLASSES, allowed: AllowList = ALLOWED) -> None:
        self.assign = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
        # a run that is too short fails as a whole, so the least length may stand in the pattern
        self.access = re.compile(ACCESS.replace("+", f"{{{LEAST_ACCESS - 4},}}"))
        self.hex = re.compile(HEX.replace("+", f"{{{LEAST_HEX},}}"))
        self.classes = [
            (c, re.compile(f"[{c.characters}]{{{c.window},}}"), _weights(c.window), self._most(c)) for c in classes
        ]
        shortest = min((c.window for c in classes), default=1)
        self.candidate = re.compile(f"[{TOKEN}]{{{shortest},}}")
        self.inside = [re.compile(p) for p in allowed.inside]
        self.whole = [re.compile(p) for p in allowed.candidate]
        self.before = [re.compile(p) for p in allowed.before]
        self.look_back = allowed.look_back
        self.order = {k: i for i, k in enumerate([*BASE_KINDS, *[c.kind for c in classes]])}

    @staticmethod
    def _most(c: CharClass) -> int:
        """The largest sum of n * log2 n of a window that is random enough."""
        return math.floor((math.log2(c.window) - c.bits) * c.window * _UNIT)

    def prefilters(self) -> list[str]:
        """Patterns for automata: a text that none of them matches has no span."""
        return [
            r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
            f"{self.access.pattern}|{self.hex.pattern}|{self.candidate.pattern}",
        ]

    def spans(self, text: str) -> list[tuple[str, int, int, float | None]]:
        out = [("assign", *m.span(), None) for m in self.assign.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
        out += [("access", *m.span(), None) for m in self.access.finditer(text)]
        out += [("hex", *m.span(), None) for m in self.hex.finditer(text)]
        for found in self.candidate.finditer(text):
            mine = [
                (c.kind, run.start() + a, run.start() + b, bits)
                for c, pattern, weights, most in self.classes
                for run in pattern.finditer(text, *found.span())
                for a, b, bits in random_spans(run[0], c, weights, most)
            ]
            if mine and not self._known(text, found):
                out += [s for s in mine if not any(p.search(text[s[1] : s[2]]) for p in self.inside)]
        return sorted(out, key=lambda s: (s[1], self.order[s[0]], s[2]))

    def _known(self, text: str, candidate: re.Match) -> bool:
        lead = text[max(0, candidate.start() - self.look_back) : candidate.start()]
        return any(p.search(candidate[0]) for p in self.whole) or any(p.search(lead) for p in self.before)


def random_spans(run: str, c: CharClass, weights: list[int], most: int) -> list[tuple[int, int, float]]:
    """(start, end, most bits a character) of the joined windows of a run that are random enough."""
    window, counts, total = c.window, {}, 0
    sorts = [0, 0, 0]
    kinds = [0 if x.isdigit() else 1 if "A" <= x <= "Z" else 2 if "a" <= x <= "z" else -1 for x in run]
    out: list[list] = []
    for i, x in enumerate(run):
        n = counts.get(x, 0)
        counts[x] = n + 1
        total += weights[n + 1] - weights[n]
        if kinds[i] >= 0:
            sorts[kinds[i]] += 1
        if i >= window:
            old = run[i - window]
            n = counts[old]
            counts[old] = n - 1
            total += weights[n - 1] - weights[n]
            if kinds[i - window] >= 0:
                sorts[kinds[i - window]] -= 1
        if i >= window - 1 and total <= most and sum(map(bool, sorts)) >= c.sorts:
            a = i - window + 1
            if out and a <= out[-1][1]:
                out[-1][1] = i + 1
                out[-1][2] = min(out[-1][2], total)
            else:
                out.append([a, i + 1, total])
    return [(a, b, math.log2(window) - t / window / _UNIT) for a, b, t in out]


def secret_spans(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    classes: tuple[CharClass, ...] = CLASSES,
    allowed: AllowList = ALLOWED,
) -> DataFrame:
    """One row per document with its spans; ``bits`` is null for the fixed patterns."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = SecretScanner(classes, allowed)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("bits", pa.float64())]))
        for batch in batches:
            for part in slices(batch, "text"):
                column = part.column(1)
                maybe = [pc.match_substring_regex(column, p) for p in scanner.prefilters()]
                walk = maybe[0] if len(maybe) == 1 else pc.or_(*maybe)
                found = [
                    [dict(zip(("kind", "start", "end", "bits"), s)) for s in scanner.spans(t.as_py())] if w else []
                    for t, w in zip(column, walk.to_pylist())
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    texts = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), text_of(text).alias("text"))
    return texts.mapInArrow(rows, SPANS)


def span_list(spans: Column | str) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def span_count(kind: str, spans: str = "spans") -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


@query("op11_secret_scan")
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: counts of the fixed patterns, their digest, and all spans."""
    found = secret_spans(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *[span_count(kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(span_list(base), 256).alias("base_sha256"),
        span_list("spans").alias("spans"),
    )
