"""Queries over a node array (see ``operators.page_tree``) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelfspark.functions.text import WHITESPACE, blank_to_null, let, strip


def attr(node: Column, name: str) -> Column:
    return node["attrs"][name]


def is_string(node: Column) -> Column:
    return node["tag"].startswith("#")


def sql_text(value: str) -> str:
    """A string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _lambda(body: str) -> Column:
    """A lambda that uses nothing but its own ``n``; as SQL it is one step to build."""
    return F.expr(f"n -> {body}")


def find_all(nodes: Column, test) -> Column:
    """Nodes that pass; ``test`` is SQL over ``n`` (``tagged``) or a function of a node column."""
    if isinstance(test, str):
        return F.call_function("filter", nodes, _lambda(f"coalesce({test}, false)"))
    return F.filter(nodes, lambda n: F.coalesce(test(n), F.lit(False)))


def find(nodes: Column, test) -> Column:
    """First node that passes, else null."""
    return F.get(find_all(nodes, test), F.lit(0))


def tagged(tag: str, name: str | None = None, value: str | None = None, pattern: str | None = None) -> str:
    """Test: tag, and an attribute that equals ``value`` or holds ``pattern`` (or just exists)."""
    ok = f"n.tag = {sql_text(tag)}"
    if name is None:
        return ok
    found = f"n.attrs[{sql_text(name)}]"
    if value is not None:
        return f"{ok} and {found} = {sql_text(value)}"
    if pattern is not None:
        return f"{ok} and {found} rlike {sql_text(pattern)}"
    return f"{ok} and {found} is not null"


def classed(tag: str, token: str) -> str:
    """Test: tag with a class token."""
    classes = f"split(n.attrs['class'], {sql_text(chr(92) + 's+')})"
    return f"n.tag = {sql_text(tag)} and array_contains({classes}, {sql_text(token)})"


def within(nodes: Column, node: Column) -> Column:
    """Descendants of ``node``: one slice, as nodes lie in document order."""
    return F.slice(
        nodes, node["pos"] - F.get(nodes, F.lit(0))["pos"] + 2, node["last"] - node["pos"]
    )


def after(nodes: Column, node: Column) -> Column:
    """Everything after the start of ``node`` in document order, its descendants included."""
    start = node["pos"] - F.get(nodes, F.lit(0))["pos"] + 2
    return F.slice(nodes, start, F.size(nodes))


def parent(nodes: Column, node: Column) -> Column:
    return F.try_element_at(
        F.filter(
            nodes,
            lambda n: (n["pos"] < node["pos"])
            & (n["last"] >= node["last"])
            & (n["depth"] == node["depth"] - 1),
        ),
        F.lit(-1),
    )


def _mapped(items: Column, body: str) -> Column:
    return F.call_function("transform", items, _lambda(body))


def strings(part: Column) -> Column:
    """Raw page texts of a slice of nodes."""
    return _mapped(find_all(part, "n.tag = '#text'"), "n.text")


def all_strings(part: Column) -> Column:
    """Texts, scripts and comments alike, as a plain string search sees them."""
    return _mapped(find_all(part, "startswith(n.tag, '#')"), "n.text")


def raw_text(part: Column) -> Column:
    return F.array_join(strings(part), "")


def text(part: Column, sep: str = "") -> Column:
    """Stripped non-empty texts of a slice joined by ``sep``."""
    stripped = _mapped(find_all(part, "n.tag = '#text'"), f"btrim(n.text, {sql_text(WHITESPACE)})")
    return F.array_join(find_all(stripped, "n <> ''"), sep)


def text_of(nodes: Column, node: Column, sep: str = "") -> Column:
    """Stripped text inside one node; null when there is no such node."""
    return text(within(nodes, node), sep)


def find_text(nodes: Column, test, sep: str = "") -> Column:
    """Text of the first node that passes; null when there is none."""
    return let(find(nodes, test), lambda n: text_of(nodes, n, sep))


def only_string(nodes: Column, node: Column) -> Column:
    """The single string a node holds through single children, else null."""
    return let(
        within(nodes, node),
        lambda inside: let(
            F.try_element_at(inside, F.lit(-1)),
            lambda last: F.when(
                is_string(last) & F.forall(inside, lambda n: n["last"] == node["last"]),
                last["text"],
            ),
        ),
    )


def texts_of(nodes: Column, found: Column) -> Column:
    """Stripped text of every node of an array."""
    return F.transform(found, lambda n: text_of(nodes, n))


def or_else(*options: Column) -> Column:
    """First option that is neither null nor empty."""
    return F.coalesce(*[let(o, blank_to_null) for o in options])


# -- flat patterns straight on the HTML text: no tree, no Python ------------------------------

_NOT_CONTENT = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
# attributes before the wanted one, with quoted values taken whole
_BEFORE = r"""(?=[\s/])(?:[\s/]*(?!{name}\s*=)[^\s=>"'/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+))?)*+[\s/]*{name}\s*=\s*"""
_LINK = "(?is)<a" + _BEFORE.format(name="href") + r"""("[^"]*"|'[^']*'|[^\s>"']+)"""
# Predefined entities; the ampersand comes last, with its numbers.
_ENTITIES = (("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"))
_AMPERSAND = "&(?:amp|#0*38|#[xX]0*26);"


def _decode_numbers(c: Column) -> Column:
    """Decode character references by number, but for the ampersand's."""
    marks = F.array_distinct(F.regexp_extract_all(c, F.lit("&#([0-9]{1,9}|[xX][0-9a-fA-F]{1,8});"), 1))

    def swap(done: Column, mark: Column) -> Column:
        hexed = F.lower(F.left(mark, F.lit(1))) == "x"
        code = F.when(hexed, F.conv(F.substring(mark, 2, 9), 16, 10)).otherwise(mark).try_cast("bigint")
        fine = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF) & (code != 38)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(fine, F.replace(done, F.concat(F.lit("&#"), mark, F.lit(";")), char)).otherwise(done)

    return F.when(F.contains(c, F.lit("&#")), F.aggregate(marks, c, swap)).otherwise(c)


def decode_entities(c: Column) -> Column:
    """Decode the predefined entities and references by number; other names need the page tree."""
    for name, char in _ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return F.regexp_replace(_decode_numbers(c), _AMPERSAND, "&")


def link_hrefs(html: Column) -> Column:
    """``href`` of every ``<a>`` in page order, stripped, empty ones dropped."""
    found = F.regexp_extract_all(F.regexp_replace(html, _NOT_CONTENT, ""), F.lit(_LINK), 1)
    hrefs = F.transform(found, lambda h: strip(decode_entities(F.regexp_replace(h, "^[\"']|[\"']$", ""))))
    return F.filter(hrefs, lambda h: h != "")


def embedded_json(html: Column, script_id: str) -> Column:
    """JSON of ``<script id=...>``, with exactly that id, as a variant; null if absent or malformed.

    Comments and other scripts are passed over whole, so nothing inside them is taken.
    """
    wanted = rf"""(?:"{script_id}"|'{script_id}'|{script_id}(?=[\s>]))"""
    script = "<script" + _BEFORE.format(name="id") + wanted + r"[^>]*>(.*?)</script"
    passed = r"<!--.*?-->|" + script + r"|<script\b.*?</script"
    bodies = F.regexp_extract_all(html, F.lit("(?is)" + passed), 1)
    return F.try_parse_json(F.get(F.filter(bodies, lambda b: b != ""), F.lit(0)))


def keyword_flag(html: Column, pattern: str) -> Column:
    """Case-insensitive pattern anywhere in the text."""
    return html.rlike("(?i)" + pattern)


def page_position(text_: Column) -> Column:
    """struct(page, pages) of a ``page X of Y`` text, null if there is none; null numbers beyond 64 bits."""
    pattern = r"(?i)page\s+(\d+)\s+of\s+(\d+)"
    return F.when(
        text_.rlike(pattern),
        F.struct(
            F.regexp_extract(text_, pattern, 1).try_cast("bigint").alias("page"),
            F.regexp_extract(text_, pattern, 2).try_cast("bigint").alias("pages"),
        ),
    )
