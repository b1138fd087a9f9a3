"""Raw HTML rows to rows of nodes: the one place where Python reads markup.

A node array lists a page's elements and texts in document order with nested-set positions
(``pos`` of the node, ``last`` position inside it), so every later rule is a column expression:
descendants are a slice, children have ``depth + 1``, text is a filter and a join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame


# pos/last/depth: nested-set position; tag is '#text', '#raw' (script, style, template) or
# '#comment' for strings; attrs of elements, text of strings.
NODES_DDL = (
    "array<struct<pos:int,last:int,depth:int,tag:string,"
    "attrs:map<string,string>,text:string>>"
)
# HTML elements without content, and elements whose text is not page text.
_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_RAW = frozenset(("script", "style", "template"))
_CHARS_PER_BATCH = 2 << 20


# One token of markup. Possessive repeats: no input makes the match run long.
_ATTRIBUTES = r"""(?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+|=)*+"""
_TOKEN = re.compile(
    rf"""<!--(?P<comment>.*?)(?:-->|\Z)
      |<(?P<raw>script|style)(?P<raw_attrs>(?=[\s>]){_ATTRIBUTES})>(?P<body>.*?)(?=</(?P=raw)[\s/>]|\Z)
      |<(?P<open>[a-z][^\s/>]*+)(?P<attrs>{_ATTRIBUTES})>
      |</(?P<close>[a-z][^\s/>]*+)[^>]*+>
      |<[!?/][^>]*+>
      |(?P<text>[^<]++|<)""",
    re.S | re.I | re.X,
)
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")


def _attributes(source: str) -> list[tuple[str, str]]:
    found = {}
    for name, value in _ATTRIBUTE.findall(source):
        if value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1:
            value = value[1:-1]
        found[name.lower()] = unescape(value) if "&" in value else value
    return list(found.items())


def _self_closing(source: str) -> bool:
    ends = [m.end() for m in _ATTRIBUTE.finditer(source)]
    return source[ends[-1] if ends else 0 :].endswith("/")


def flatten(html: str) -> list[list]:
    """Nodes of a page: [pos, last, depth, tag, attrs, text, source_start, source_end].

    Elements left open end with their parent; an end tag closes up to the nearest element of its
    name, and nothing if there is none.
    """
    nodes: list[list] = []
    open_: list[list] = []
    texts: list[str] = []  # pieces of the text run being read

    def add(tag, attrs, text, start, end):
        node = [len(nodes), len(nodes), len(open_), tag, attrs, text, start, end]
        nodes.append(node)
        return node

    def end_text():
        run = "".join(texts)
        texts.clear()
        raw = open_ and open_[-1][3] in _RAW
        add("#raw" if raw else "#text", None, unescape(run) if "&" in run else run, 0, 0)

    def shut(end):
        node = open_.pop()
        node[1] = len(nodes) - 1
        node[7] = end

    for m in _TOKEN.finditer(html):
        kind = m.lastgroup
        if kind == "text":
            texts.append(m[0])
            continue
        if texts:
            end_text()
        if kind == "close":
            tag = m["close"].lower()
            if any(node[3] == tag for node in open_):
                while open_[-1][3] != tag:
                    shut(m.start())
                shut(m.end())
        elif kind == "attrs":
            tag, source = m["open"].lower(), m["attrs"]
            attrs = _attributes(source) if source else []
            node = add(tag, attrs, None, m.start(), m.end())
            if tag not in _VOID and not (source[-1:] == "/" and _self_closing(source)):
                open_.append(node)
        elif kind == "body":
            open_.append(add(m["raw"].lower(), _attributes(m["raw_attrs"]), None, m.start(), m.end()))
            if m["body"]:
                add("#raw", None, m["body"], 0, 0)
        elif kind == "comment":
            add("#comment", None, m["comment"], 0, 0)
    if texts:
        end_text()
    while open_:
        shut(len(html))
    return nodes


# (tag, attribute, pattern): an element with that tag whose attribute holds the pattern.
# No tag is any element; no attribute is any element of the tag.
Root = tuple[str | None, str | None, str]


def _blocks(html: str, root: Root | None) -> Iterator[tuple[str, list[list]]]:
    """(source, nodes) of the whole page, or of every element ``root`` accepts."""
    nodes = flatten(html)
    if root is None:
        yield html, nodes
        return
    tag, attr, pattern = root[0], root[1], re.compile(root[2])
    for node in nodes:
        if node[4] is None or (tag is not None and node[3] != tag):
            continue
        value = "" if attr is None else dict(node[4]).get(attr)
        if value is not None and pattern.search(value):
            yield html[node[6] : node[7]], nodes[node[0] : node[1] + 1]


def _node_arrays(trees: list[list[list]]) -> pa.Array:
    """Node lists as one Arrow list column, positions counted from each list's first node."""
    ends, pos, last, depth, tag, text = [0], [], [], [], [], []
    attr_ends, names, values = [0], [], []
    for tree in trees:
        base = tree[0][0] if tree else 0
        for node in tree:
            pos.append(node[0] - base)
            last.append(node[1] - base)
            depth.append(node[2])
            tag.append(node[3])
            for name, value in node[4] or ():
                names.append(name)
                values.append(value)
            attr_ends.append(len(names))
            text.append(node[5])
        ends.append(len(pos))
    attrs = pa.MapArray.from_arrays(
        pa.array(attr_ends, pa.int32()), pa.array(names, pa.string()), pa.array(values, pa.string())
    )
    struct = pa.StructArray.from_arrays(
        [
            pa.array(pos, pa.int32()),
            pa.array(last, pa.int32()),
            pa.array(depth, pa.int32()),
            pa.array(tag, pa.string()),
            attrs,
            pa.array(text, pa.string()),
        ],
        names=["pos", "last", "depth", "tag", "attrs", "text"],
    )
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)


def page_nodes(
    pages: DataFrame,
    keys: list[str],
    html: str = "html",
    root: Root | None = None,
    keep_source: bool = False,
) -> DataFrame:
    """One row per page (``root=None``) or 0..n rows per page, one per matching element.

    Output columns: the keys, ``block`` (ordinal within the page), ``source`` if kept, ``nodes``. Only keys and html
    travel to Python; narrow or filter the input first.
    """
    kept = [f for f in pages.schema if f.name in keys]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    names = [f.name for f in kept]
    ddl += ", block int" + (", source string" if keep_source else "") + f", nodes {NODES_DDL}"

    labels = names + ["block"] + (["source"] if keep_source else []) + ["nodes"]

    def packed(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        picked = pa.array([row for row, *_ in found], pa.int64())
        columns = [batch.column(name).take(picked) for name in names]
        columns.append(pa.array([block for _, block, *_ in found], pa.int32()))
        if keep_source:
            columns.append(pa.array([source for _, _, source, _ in found], pa.string()))
        columns.append(_node_arrays([tree for *_, tree in found]))
        return pa.RecordBatch.from_arrays(columns, names=labels)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            size = 0
            for row, text in enumerate(batch.column(html)):
                page = text.as_py() or ""
                for block, (source, tree) in enumerate(_blocks(page, root)):
                    found.append((row, block, source, tree))
                size += len(page)
                if size > _CHARS_PER_BATCH:  # trees outgrow their pages: hand over in small parts
                    yield packed(batch, found)
                    found, size = [], 0
            yield packed(batch, found)

    return pages.select(*names, html).mapInArrow(read, ddl)
