"""Strings, URLs and ids as column expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
# Documents are cut at 500 characters, metadata text too.
MAX_DOCUMENT_CHARS = 500
MAX_METADATA_CHARS = 500
# Fixed value: the fixed-size rendition asked of the image host.
IMAGE_SIZE_QUERY = "?wid=800&hei=800&qlt=80&fmt=pjpeg"

# Generic URI split (RFC 3986, appendix B): scheme, host, path, query, fragment.
_URL = r"(?s)^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside one expression.

    Without it, every mention in a branch of a ``when`` is evaluated again.
    """
    return F.get(F.transform(F.array(value), body), 0)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    """Unicode strip; Spark's plain ``trim`` removes spaces only."""
    return F.btrim(c, F.lit(WHITESPACE))


def safe_str(c: Column) -> Column:
    """Any scalar to stripped text; null gives the empty string, booleans true/false."""
    return F.coalesce(strip(c.cast("string")), F.lit(""))


def product_id_from_url(url: Column, missing: str | None = "", strict: bool = False) -> Column:
    """Digits after ``/A-`` (``strict``: after ``/-/A-``), else ``missing``."""
    found = blank_to_null(F.regexp_extract(url, r"/-/A-(\d+)" if strict else r"/A-(\d+)", 1))
    return found if missing is None else F.coalesce(found, F.lit(missing))


def product_id_from_focus(c: Column) -> Column:
    """Text before the first underscore of a focus attribute, else ``N/A``."""
    return F.coalesce(blank_to_null(F.substring_index(c, "_", 1)), F.lit("N/A"))


def is_product_url(url: Column, host: str) -> Column:
    return url.rlike(r"^https?://" + host.replace(".", r"\.") + r"/p/.+/-/A-\d+")


def hard_cut(c: Column, limit: int) -> Column:
    """The first ``limit`` characters."""
    return F.left(c, F.lit(limit))


def cut_at_word(c: Column, limit: int = MAX_DOCUMENT_CHARS) -> Column:
    """Cut text over ``limit`` code points back to its last space, or hard if that leaves nothing."""

    def cut(head: Column) -> Column:
        kept = F.length(head) - F.length(F.substring_index(head, " ", -1)) - 1
        return F.coalesce(blank_to_null(F.left(head, kept)), head)

    return let(
        c,
        lambda t: F.when(F.length(t) > limit, let(F.left(t, F.lit(limit)), cut)).otherwise(t),
    )


def embed_text(c: Column) -> Column:
    """What an encoder gets: cut text, and a single space for nothing at all."""
    return F.coalesce(blank_to_null(cut_at_word(c)), F.lit(" "))


def document_text(
    title: Column,
    brand: Column,
    description: Column,
    material: Column,
    highlights: Column,
    bullets: Column,
) -> Column:
    """One searchable string: non-empty parts joined by a space, cut at a word, stripped."""
    plain = [safe_str(c) for c in (title, brand, description, material)]
    listed = [F.translate(safe_str(c), "|", " ") for c in (highlights, bullets)]
    parts = F.filter(F.array(*plain, *listed), lambda part: part != "")
    return strip(cut_at_word(F.array_join(parts, " ")))


def first_image_url(images: Column) -> Column:
    """First entry of a ``|``-joined list if it starts with ``http``, else null."""
    first = strip(F.substring_index(strip(images), "|", 1))
    return F.when(first.startswith("http"), first)


def drop_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def sized_image(url: Column) -> Column:
    return F.concat(drop_query(url), F.lit(IMAGE_SIZE_QUERY))


def prefix_host(href: Column, base: str) -> Column:
    """Put scheme and host before a path that starts with a slash; leave the rest."""
    return F.when(href.startswith("/"), F.concat(F.lit(base), href)).otherwise(href)


def url_parts(url: Column) -> Column:
    """Lenient split into struct(scheme, host, path, query, fragment); absent parts are empty."""
    return F.struct(
        *[
            F.regexp_extract(url, _URL, i).alias(name)
            for i, name in enumerate(("scheme", "host", "path", "query", "fragment"), start=1)
        ]
    )


def _without_dot_segments(path: Column) -> Column:
    kept = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(
            seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))
        )
        .when(seg == ".", acc)
        .otherwise(F.array_append(acc, seg)),
    )
    tail = F.when(path.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    joined = F.concat(F.array_join(kept, "/"), tail)
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))


def resolve_url(href: Column, base: str) -> Column:
    """Resolve a link against a fixed base page (control characters around it go first)."""
    scheme, rest = base.split("://", 1)
    host, _, path = rest.partition("/")
    root = f"{scheme}://{host}"
    page = f"/{path}".split("#")[0].split("?")[0] if path else ""
    folder = page.rsplit("/", 1)[0] + "/"

    def resolved(full_path: Column) -> Column:
        # only paths with dot segments pay for the segment walk
        bare = F.regexp_extract(full_path, r"(?s)^[^?#]*", 0)
        rest_of = F.substring(full_path, F.length(bare) + 1, F.length(full_path))
        tidy = F.when(
            bare.rlike(r"(^|/)\.{1,2}(/|$)"), F.concat(_without_dot_segments(bare), rest_of)
        ).otherwise(full_path)
        return F.concat(F.lit(root), tidy)

    def by_form(h: Column) -> Column:
        return (
            F.when(h == "", F.lit(base))
            .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
            .when(h.startswith("//"), F.concat(F.lit(scheme + ":"), h))
            .when(h.startswith("/"), resolved(h))
            .when(h.startswith("?") | h.startswith("#"), F.concat(F.lit(root + page), h))
            .otherwise(resolved(F.concat(F.lit(folder), h)))
        )

    controls = F.lit("".join(map(chr, range(1, 33))))
    return let(F.ltrim(F.translate(href, "\t\r\n", ""), controls), by_form)


def drop_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def srcset_first(c: Column) -> Column:
    """URL of the first candidate of a ``srcset`` attribute."""
    first = strip(F.substring_index(c, ",", 1))
    return F.regexp_extract(first, r"^\S*", 0)


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), F.translate(c, "+", " "))


def _encode(c: Column) -> Column:
    # Java's form encoding and the web form rule differ in these two characters
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def set_query_param(url: Column, name: str, value: Column) -> Column:
    """Set one query parameter.

    With a query present: blank-valued parameters go, repeated ones stay in the place of the
    first, the new value replaces the old or comes last. Without one: plain append.
    """
    value = value.cast("string")
    query = F.regexp_extract(url, _URL, 4)
    fragment = F.regexp_extract(url, _URL, 5)

    def name_of(p: Column) -> Column:
        return _decode(F.substring_index(p, "=", 1))

    def value_of(p: Column) -> Column:
        return _decode(F.substring(p, F.instr(p, "=") + 1, F.length(p)))

    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p.rlike(r"(?s)=.")),
        lambda p: F.struct(name_of(p).alias("k"), value_of(p).alias("v")),
    )
    fresh = F.array(F.struct(F.lit(name).alias("k"), value.alias("v")))

    def rebuilt(ps: Column) -> Column:
        names = F.array_distinct(F.concat(F.transform(ps, lambda p: p["k"]), F.array(F.lit(name))))
        ordered = F.flatten(
            F.transform(
                names,
                lambda k: F.when(k == name, fresh).otherwise(F.filter(ps, lambda p: p["k"] == k)),
            )
        )
        return F.array_join(
            F.transform(ordered, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))),
            "&",
        )

    updated = F.concat(
        F.substring_index(url, "?", 1),
        F.lit("?"),
        let(pairs, rebuilt),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit("")),
    )
    plain = F.concat(url, F.lit(f"?{name}="), value)
    return F.when(F.contains(url, F.lit("?")), updated).otherwise(plain)


def selected_color(url: Column, colors: Column) -> Column:
    """First URL segment that equals a lower-cased colour name, else empty."""
    lowered = F.transform(colors, F.lower)
    hits = F.filter(F.split(url, "/"), lambda p: (p != "") & F.array_contains(lowered, p))
    return F.coalesce(F.get(hits, F.lit(0)), F.lit(""))


def split_trim(c: Column, sep: str = ",") -> Column:
    """Split on one character and strip every part."""
    return F.transform(F.split(c, f"[{sep}]"), strip)


def join_pipes(items: Column) -> Column:
    """``|``-joined list; null or empty gives the empty string."""
    return F.coalesce(F.array_join(items, "|"), F.lit(""))


def next_page_url(url: Column, page: Column) -> Column:
    """``?page=N`` form: page one is the bare category URL."""
    return F.when(page > 1, F.concat(url, F.lit("?page="), page.cast("string"))).otherwise(url)
