"""Personal data replaced by surrogates of the same type and form.

Entities (mail addresses, phone, card and social security numbers, IPv4 addresses, access tokens and
titled names) are found by pattern. An entity's surrogate is a keyed permutation of its own form:
digits become digits, vowels vowels, consonants consonants of the same script, hex stays hex, octets
octets, a card keeps its check-sum state, a known first name becomes one of the same gender and script; case
and separators stay. A name is replaced word by word, so a surname has one surrogate whatever stands before it, and
further mentions of a text's titled names, without title, are replaced too. Titles and particles (von, de la) stay.
Names are capitalised words behind titles, initials among them. A permutation sends different entities to different surrogates, and the same
entity always to the same one, in every document.

Collision check: a surrogate must not be a real entity of the corpus. All distinct entities are
joined with the surrogates (of names, the words but for listed first names and initials); those that hit a real one are permuted again until none does. Walking a
permutation's cycle out of the real ones keeps surrogates distinct. An entity whose whole cycle is
real gets a typed placeholder with a keyed digest instead.

The entities that needed more than one step are few. If there are at most ``broadcast_rows`` of
them (counted, not estimated), the tasks get them as a table; beyond that, they are joined to their
documents.

Defined cases: null text stays null, empty text empty; texts without entities are returned as they
are, whole texts are searched. Repeated rows are treated alike. A null doc_id is kept. Extra columns
are ignored. Mail addresses and names are compared without case.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfspark.llm.common import read, stored
from shelfspark.llm.registry import query

KEY = "surrogates"
BROADCAST_ROWS = 100_000
# A walk longer than this has left no real entity behind on a cycle of real ones.
MOST_STEPS = 64

# Titles that tell a gender, and first names by gender and script.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа"),
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Г-н"),
    "": ("Dr", "Prof"),
}
FIRST_NAMES = {
    ("f", "latin"): ("Anna", "Clara", "Elena", "Emma", "Laura", "Lucia", "Maria", "Nora", "Sarah", "Sofia"),
    ("m", "latin"): ("Adam", "Carlos", "David", "Felix", "Jonas", "Louis", "Martin", "Paul", "Peter", "Thomas"),
    ("f", "cyrillic"): ("Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Софья"),
    ("m", "cyrillic"): ("Антон", "Борис", "Иван", "Максим", "Олег", "Павел", "Пётр", "Сергей"),
}

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_TITLE = "|".join(sorted((t for group in TITLES.values() for t in group), key=len, reverse=True))
# Name words: capitalised, or of a script without case; combining marks belong to their letter.
_SMALL = "".join(chr(c) for c in range(0x2000) if chr(c).isalpha() and chr(c).islower())
_FIRST = rf"[^\W\d_{_SMALL}]"
_LETTER = r"[^\W\d_][\u0300-\u036f]*"
_WORD = rf"(?:[dlDL]['’])?{_FIRST}[\u0300-\u036f]*(?:{_LETTER})*(?:['’-](?![sS]\b)(?:{_LETTER})+)*"
_PARTICLES = (
    "von", "vom", "zu", "zum", "zur", "und zu", "van", "der", "den", "de", "del", "della", "di", "da", "dos", "das", "du", "la",
    "le", "las", "los", "ten", "ter", "te", "af", "av", "al", "el", "bin", "ibn", "ben",
)
# capitalised words of sentences that begin behind an initial or a line end
_OPENERS = "The|This|That|These|Those|They|Then|There|And|But|When|Und|Aber"
_INITIAL = rf"{_FIRST}\."
_PARTICLE = rf"(?:{'|'.join(_PARTICLES)})\s+"
_KNOWN = "|".join(name for names in FIRST_NAMES.values() for name in names)
_NOT = rf"(?!(?:{_TITLE}|{_OPENERS})\b)"
_NAME = (
    rf"(?:{_NOT}(?:{_INITIAL}\s*|{_PARTICLE}|(?:{_KNOWN})\s+|{_WORD}[^\S\r\n]+))*"
    rf"{_NOT}(?:{_INITIAL}|{_WORD})"
)
_TITLES = rf"(?:(?:{_TITLE})(?:\.\s*|\s+))+"
# In order: where two patterns find the same place, the first one takes it.
PATTERNS = (
    ("mail", r"(?<![\w.+-])[\w.+-]*\w@\w[\w-]*(?:\.\w[\w-]*)*\.[^\W\d_]{2,}"),
    ("token", r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])"),
    ("ip", rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)"),
    ("card", r"(?<!\d)(?:\d{16}|\d{4}([ -])\d{4}\1\d{4}\1\d{4})(?!\d)"),
    ("phone", r"(?<![\w(])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("name", rf"\b{_TITLES}{_NAME}"),
)
_ANY = re.compile("|".join(f"(?P<{name}>{pattern.replace(chr(92) + '1', '(?P=sep)').replace('([ -])', '(?P<sep>[ -])')})" for name, pattern in PATTERNS))
_MAYBE = re.compile(rf"[@0-9]|\b(?:{_TITLE})\b")

_ALPHABETS = tuple(
    {c: i for i, c in enumerate(letters)}
    for letters in (
        "0123456789",
        "aeiou",
        "bcdfghjklmnpqrstvwxyz",
        "äöüáàâéèêëíîïóôúûù",
        "ñßçœæ",
        "аеиоуыэюя",
        "бвгджзклмнпрстфхцчшщ",
        "αεηιουω",
        "βγδζθκλμνξπρστφχψ",
    )
)
_LETTERS = tuple("".join(a) for a in _ALPHABETS)
_HEX = "0123456789abcdef"


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of the entities of a text, in order."""
    if not _MAYBE.search(text):
        return []
    return [(m.start(), m.end(), m.lastgroup if m.lastgroup != "sep" else "card") for m in _ANY.finditer(text)]


def canonical(kind: str, value: str) -> str:
    """The form in which mentions of one entity are equal."""
    return value.lower() if kind in ("mail", "token", "name") else value


_NAME_WORD = re.compile(_WORD)
_HEAD = re.compile(_TITLES)
_KNOWN_FIRST = {name.lower(): kind for kind, names in FIRST_NAMES.items() for name in names}


def _name_words(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    """(start, end, canonical) of the words of a titled name, without titles and particles."""
    head = _HEAD.match(text, start, end)
    return [(m.start(), m.end(), canonical("name", m[0])) for m in _NAME_WORD.finditer(text, head.end(), end)]


def mentions(text: str) -> list[tuple[str, list[tuple[int, int, str, str]]]]:
    """(type, [(start, end, kind, canonical) of its parts]) of every mention of an entity, in order.

    A name's parts are its words. Further mentions of the text's titled names are found by their
    surnames (words behind the first, or the only one), with the name's other words and initials
    that stand before them.
    """
    found = find(text)
    spans = {(start, end): _name_words(text, start, end) for start, end, kind in found if kind == "name"}
    # first words by surname, and known first names that stand before a surname somewhere in the text
    before: dict[str, set[str]] = {}
    firsts = set()
    for words in spans.values():
        whole = [w for _, _, w in words]
        long = [w for w in whole if len(w) > 1]
        if len(whole) > 1 and whole[0] in _KNOWN_FIRST:
            firsts.add(whole[0])
        for w in long[1:] if len(whole) > 1 and len(long) > 1 else long:
            before.setdefault(w, set()).update(x for x in whole if x != w)

    def parts(words: list[tuple[int, int, str]]) -> list[tuple[int, int, str, str]]:
        out = []
        for i, (a, b, w) in enumerate(words):
            given = w in _KNOWN_FIRST and i == 0 and (len(words) > 1 or w in firsts)
            out.append((a, b, "given" if given else "initial" if len(w) == 1 else "name", w))
        return out

    out = [(kind, parts(spans[start, end]) if kind == "name" else [(start, end, kind, canonical(kind, text[start:end]))]) for start, end, kind in found]
    if not before:
        return out
    at = 0
    for start, end in [*((s, e) for s, e, _ in found), (len(text), len(text))]:
        run: list[tuple[int, int, str]] = []
        for m in _NAME_WORD.finditer(text, at, start):
            word = (m.start(), m.end(), canonical("name", m[0]))
            # not inside a longer word, and capitalised in the text
            if m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_"):
                run = []
                continue
            gap = text[run[-1][1] : m.start()] if run else None
            if run and not re.fullmatch(rf"\.?\s+(?:{_PARTICLE})*|\.", gap):
                run = []
            run.append(word)
            if word[2] in before and word[2] not in firsts:
                first = len(run) - 1
                while first and (run[first - 1][2] in before[word[2]] or len(run[first - 1][2]) == 1 and text[run[first - 1][1]] == "."):
                    first -= 1
                out.append(("name", parts(run[first:])))
                run = []
        at = end
    return sorted(out, key=lambda mention: mention[1][0])


def _shifts(key: str, kind: str, turn: int, fixed: list[int], n: int) -> list[int]:
    """n pseudo-random numbers that depend on the key, the turn and the other half."""
    seed = f"{key}|{kind}|{turn}|{','.join(map(str, fixed))}".encode()
    return [int.from_bytes(hashlib.blake2b(seed, digest_size=8, salt=i.to_bytes(8, "big")).digest(), "big") for i in range(n)]


def permute_digits(key: str, kind: str, digits: list[int], bases: list[int]) -> list[int]:
    """A keyed permutation of mixed-base numbers: halves are turned by functions of each other."""
    digits, half = list(digits), len(digits) // 2
    label = f"{kind}|{','.join(map(str, bases))}"
    for turn in range(6):
        own = range(half) if turn % 2 else range(half, len(digits))
        other = [digits[i] for i in (range(half, len(digits)) if turn % 2 else range(half))]
        for i, shift in zip(own, _shifts(key, label, turn, other, len(own))):
            digits[i] = (digits[i] + shift) % bases[i]
    return digits


def _permute_letters(key: str, kind: str, value: str) -> str:
    """Permute each character within its class; characters of no class stay."""
    places, digits, bases, classes = [], [], [], []
    for i, c in enumerate(value):
        for a, alphabet in enumerate(_ALPHABETS):
            if c in alphabet:
                places.append(i)
                digits.append(alphabet[c])
                bases.append(len(alphabet))
                classes.append(a)
                break
    out = list(value)
    for i, a, d in zip(places, classes, permute_digits(key, kind, digits, bases)):
        out[i] = _LETTERS[a][d]
    return "".join(out)


def _luhn(digits: list[int]) -> int:
    """The check digit after these digits."""
    doubled = [(2 * d - 9 if d > 4 else 2 * d) if i % 2 == 0 else d for i, d in enumerate(reversed(digits))]
    return -sum(doubled) % 10


def _permute_first_name(key: str, word: str) -> str:
    """A known first name: the list of its gender and script is permuted."""
    kind = _KNOWN_FIRST[word]
    names = [n.lower() for n in FIRST_NAMES[kind]]
    return names[permute_digits(key, f"name|{kind}", [names.index(word)], [len(names)])[0]]


def permute(key: str, kind: str, value: str) -> str:
    """One step of the type's permutation, on canonical values."""
    if kind == "ip":
        octets = [int(part) for part in value.split(".")]
        return ".".join(map(str, permute_digits(key, kind, octets, [256] * 4)))
    if kind == "token":
        return "".join(_HEX[d] for d in permute_digits(key, kind, [int(c, 16) for c in value], [16] * len(value)))
    if kind == "card":
        digits = [int(c) for c in value if c.isdigit()]
        off = (digits[-1] - _luhn(digits[:-1])) % 10
        body = permute_digits(key, kind, digits[:-1], [10] * (len(digits) - 1))
        fresh = iter([*body, (_luhn(body) + off) % 10])
        return "".join(str(next(fresh)) if c.isdigit() else c for c in value)
    if kind == "phone":
        # the country code stays
        code = re.match(r"\+\d{1,3}[ .-]?(?=\(|\d{3}[ .-])", value)
        start = code.end() if code else 0
        return value[:start] + _permute_letters(key, kind, value[start:])
    if kind == "mail":
        head, _, top = value.rpartition(".")
        return _permute_letters(key, kind, head) + "." + top
    if kind == "given":
        return _permute_first_name(key, value)
    return _permute_letters(key, kind, value)


def placeholder(key: str, kind: str, value: str) -> str:
    return f"[{kind.upper()}-{hashlib.blake2b(f'{key}|{kind}|{value}'.encode(), digest_size=10).hexdigest()}]"


def _cased(surrogate: str, mention: str) -> str:
    """The surrogate in the mention's case: by letters where they correspond, else by words."""
    if len(surrogate) == len(mention):
        return "".join(s.upper() if m.isupper() and len(s.upper()) == 1 else s for s, m in zip(surrogate, mention))
    fresh, old = surrogate.split(" "), mention.split(" ")
    if len(fresh) == len(old) > 1:
        return " ".join(_cased(s, m) for s, m in zip(fresh, old))
    if mention.isupper():
        return surrogate.upper()
    return surrogate[:1].upper() + surrogate[1:] if mention[:1].isupper() else surrogate


def _checked(text: str) -> list[tuple[str, str]]:
    """(kind, canonical) of the parts whose surrogates must not be real: all but first names of the lists and initials."""
    return [(kind, value) for _, parts in mentions(text) for _, _, kind, value in parts if kind not in ("given", "initial")]


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, value, mentions): the distinct entities of all texts; of names, the words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, values = [], []
            for cell in batch.column(0):
                value = cell.as_py()
                for kind, entity in _checked(value):
                    kinds.append(kind)
                    values.append(entity)
            yield pa.RecordBatch.from_pydict({"kind": pa.array(kinds, pa.string()), "value": pa.array(values, pa.string())})

    texts = docs.select(F.col(f"`{text}`").cast("string").alias("text")).filter("text is not null")
    found = texts.mapInArrow(rows, "kind string, value string")
    return found.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("mentions"))


def _stepper(key: str) -> Callable[[DataFrame, str], DataFrame]:
    def step(rows: DataFrame, column: str) -> DataFrame:
        """Replace ``column`` by its next value under the permutation of its kind."""

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.schema.get_field_index(column)
                kinds = batch.column(batch.schema.get_field_index("kind")).to_pylist()
                fresh = [permute(key, k, v) for k, v in zip(kinds, batch.column(at).to_pylist())]
                yield batch.set_column(at, column, pa.array(fresh, pa.string()))

        return rows.mapInArrow(walk, rows.schema)

    return step


def collisions(real: DataFrame, key: str = KEY, most_steps: int = MOST_STEPS) -> DataFrame:
    """(kind, value, surrogate) of the entities whose first surrogate is a real entity.

    ``real`` is (kind, value). Each round walks on those that still hit a real one.
    """
    spark = real.sparkSession
    step = _stepper(key)
    taken = real.select("kind", F.col("value").alias("surrogate"))
    walking = step(real.select("kind", "value", F.col("value").alias("surrogate")), "surrogate")
    walking = stored(walking.join(taken, ["kind", "surrogate"], "left_semi").select("kind", "value", "surrogate"), "surrogates-hit")
    done = spark.createDataFrame([], walking.schema)
    for _ in range(most_steps):
        if walking.isEmpty():
            return done
        moved = stored(step(walking, "surrogate"), "surrogates-moved")
        hit = moved.join(taken, ["kind", "surrogate"], "left_semi").select("kind", "value", "surrogate")
        free = moved.join(taken, ["kind", "surrogate"], "left_anti").select("kind", "value", "surrogate")
        done = done.unionByName(free)
        walking = stored(hit, "surrogates-hit")
    named = F.udf(lambda kind, value: placeholder(key, kind, value), "string")
    return done.unionByName(walking.withColumn("surrogate", named("kind", "value")))


def _replace(text: str, key: str, other: dict[tuple[str, str], str], known: dict[tuple[str, str], str]) -> tuple[str, list[str]]:
    found = mentions(text)
    parts, last = [], 0
    for start, end, *entity in (part for _, own in found for part in own):
        mention, entity = text[start:end], tuple(entity)
        surrogate = other.get(entity) or known.get(entity)
        if surrogate is None:
            if len(known) >= 100_000:
                known.clear()
            surrogate = known[entity] = permute(key, *entity)
        parts += [text[last:start], _cased(surrogate, mention)]
        last = end
    return ("".join([*parts, text[last:]]) if parts else text), [kind for kind, _ in found]


def pseudonymise(
    docs: DataFrame,
    key: str = KEY,
    doc_id: str = "doc_id",
    text: str = "text",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """(doc_id, text, n_entities, kinds): every document with its entities replaced."""
    real = stored(entities(docs, text).select("kind", "value"), "surrogates-entities")
    moved = stored(collisions(real, key), "surrogates-exceptions")
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    few = moved.count() <= broadcast_rows
    table = {(r["kind"], r["value"]): r["surrogate"] for r in moved.toLocalIterator()} if few else {}
    if not few:
        rows = _with_exceptions(rows, moved)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], str] = {}
        for batch in batches:
            texts, counts, kinds = [], [], []
            for i, cell in enumerate(batch.column(1)):
                value = cell.as_py()
                own = table if few else {(k, v): s for k, v, s in map(dict.values, batch.column(2)[i].as_py() or ())}
                fresh, found = _replace(value, key, own, known if few or not own else {}) if value is not None else (None, [])
                texts.append(fresh)
                counts.append(len(found))
                kinds.append(",".join(sorted(set(found))))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0), "text": pa.array(texts, pa.string()), "n_entities": pa.array(counts, pa.int64()),
                 "kinds": pa.array(kinds, pa.string())}
            )

    return rows.mapInArrow(work, "doc_id long, text string, n_entities long, kinds string")


def _with_exceptions(rows: DataFrame, moved: DataFrame) -> DataFrame:
    """Rows with the exceptions among their own entities: found by text digest, joined by entity."""

    def held_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"of": [], "kind": [], "value": []}
            for digest, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                value = cell.as_py()
                for kind, entity in sorted(set(_checked(value))):
                    out["of"].append(digest)
                    out["kind"].append(kind)
                    out["value"].append(entity)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.string()) for k, v in out.items()})

    digest = F.sha2("text", 256)
    held = rows.filter("text is not null").select(digest.alias("of"), "text").mapInArrow(held_in, "of string, kind string, value string")
    # one text holds no more exceptions than it has mentions
    own = (
        held.join(moved, ["kind", "value"])
        .distinct()
        .groupBy("of")
        .agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias("own"))
    )
    return rows.join(own, digest == F.col("of"), "left").select("doc_id", "text", "own")


@query("op10_surrogates")
def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for its personal data."""
    return pseudonymise(read(spark, sf_dir, "documents"))
