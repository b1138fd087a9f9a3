"""WARC archives as a chunked record table.

A record is a run of (record id, segment number) rows: a payload longer than ``chunk_bytes`` is cut
into WARC segments (``continuation`` records), each a row of its own, so neither writing nor reading
holds a whole large record in parts of its own. Digests are carried from chunk to chunk.

Records carry the fields that WARC 1.1 asks for. A response is an HTTP message whose body is the payload;
a revisit holds that message's header alone, so the payload's length is known without a private field.
Record ids name the page and its payload's digest; a continuation has an id of its own and names its origin.

Writing: one pass over the payloads gives each page's digests; the largest page_id of each digest is
the response, all others revisit it. A second pass writes the records, gzipped, with Spark's text
writer, one file per task. No segment contains the separator between records: where a payload holds
it, the payload is cut inside it, so archives can be read record by record.

Reading: archives of others can be read too (field names in any case, other record types skipped, page_id
null where the id does not name one, digests checked where stated), as long as no block of theirs holds
the separator between records; such a record fails the job by its length. Records of one segment are checked where they are read; only segmented ones are brought
together, by record id, and streamed in order of segments through one running digest. A length or a
digest that differs from its header fails the job.

Defined cases: null html is an empty payload; empty payloads are equal to each other. Rows of one
page_id with equal payload are captures with one verdict, each a record. A null page_id is written
as a response of its own and never stands for others. Extra columns are ignored. Of no pages an
empty archive is written and read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfspark.llm.common import read, text_of
from shelfspark.llm.registry import query
from shelfspark.session import scratch

CHUNK_BYTES = 1 << 16
_VERSION = b"WARC/1.1\r\n"
_SEPARATOR = b"\r\n\r\n" + _VERSION
_EMPTY_ID = "none"
# Fixed values of the format: what a revisit of an equal payload states, and what responses hold.
_SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "application/http;msgtype=response"
_READ = ("response", "resource", "revisit", "continuation")
_NAMED = re.compile(r"<urn:page:(-?\d+):\w+>")


class Digests:
    """SHA-1 (for the record) and SHA-256 (to tell payloads apart), fed chunk by chunk."""

    def __init__(self) -> None:
        self.short, self.long, self.length = hashlib.sha1(), hashlib.sha256(), 0

    def add(self, chunk: bytes | memoryview) -> None:
        self.short.update(chunk)
        self.long.update(chunk)
        self.length += len(chunk)

    def base32(self) -> str:
        return base64.b32encode(self.short.digest()).decode()


def chunks(payload: bytes | memoryview, limit: int = CHUNK_BYTES) -> Iterator[memoryview]:
    """The payload in order, cut at characters of UTF-8 and inside every record separator.

    No more than ``limit`` bytes are copied at a time; ``limit`` is at least 4, a character's bytes.
    """
    view, start, n = memoryview(payload).cast("B"), 0, len(payload)
    if n == 0:
        yield view
    while start < n:
        end = min(start + limit, n)
        while start < end < n and view[end] & 0xC0 == 0x80:
            end -= 1
        window = bytes(view[start : end + len(_SEPARATOR)])
        if window.startswith(_VERSION):
            # after the header's blank line, this would read as a separator
            end = min(end, start + 2)
        at = window.find(_SEPARATOR)
        if at >= 0 and start + at + 6 <= end:
            end = start + at + 6
        yield view[start:end]
        start = end


def _pages(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    return pages.select(
        F.col(f"`{key}`").cast("bigint").alias("page_id"),
        F.col(f"`{url}`").cast("string").alias("url"),
        text_of(html).cast("binary").alias("payload"),
    )


def page_digests(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, sha1, sha256) of rows with a binary ``payload``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, short, long = [], [], [], []
            for page_id, payload in zip(batch.column(0), batch.column(1)):
                state = Digests()
                for chunk in chunks(payload.as_buffer()):
                    state.add(chunk)
                ids.append(page_id.as_py())
                sizes.append(state.length)
                short.append(state.base32())
                long.append(state.long.digest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(short), pa.array(long, pa.binary())],
                names=["page_id", "payload_bytes", "sha1", "sha256"],
            )

    kind = "page_id long, payload_bytes long, sha1 string, sha256 binary"
    return pages.select("page_id", "payload").mapInArrow(rows, kind)


def plan_records(digests: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, sha256, refers_to): whom each page's record revisits, null for responses.

    One row for each page_id and payload. Payloads under ``least_bytes`` are always responses.
    """
    known = digests.filter(F.col("page_id").isNotNull() & (F.col("payload_bytes") >= least_bytes))
    # maxima are joined before the shuffle, so a payload that many pages share costs one row a task
    first = known.groupBy(F.col("sha256").alias("whole")).agg(F.max("page_id").alias("response"))
    # the second condition asks for a shuffle of both sides, so that AQE may split a hot payload
    same = (F.col("sha256") == F.col("whole")) & (F.xxhash64("sha256") == F.xxhash64("whole"))
    return (
        known.select("page_id", "sha256")
        .distinct()
        .join(first, same)
        .filter(F.col("page_id") != F.col("response"))
        .select(F.col("page_id").alias("revisitor"), F.col("sha256").alias("revisited"), F.col("response").alias("refers_to"))
    )


def _record(kind: str, fields: list[tuple[str, object]], *block: bytes | memoryview) -> bytes:
    lines = [f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in fields], f"Content-Length: {sum(map(len, block))}"]
    # the text writer ends the row with the last \n
    return b"".join([_VERSION, "\r\n".join(lines).encode(), b"\r\n\r\n", *block, b"\r\n\r"])


def _http_header(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def _fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-cased name."""
    found = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n"))
    return {name.strip().lower(): value.strip() for name, _, value in found}


def _one_line(url: str | None) -> str:
    return "" if url is None else "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def write_warc(
    pages: DataFrame,
    path: str,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    least_bytes: int = 0,
    chunk_bytes: int = CHUNK_BYTES,
    date: str | None = None,
) -> None:
    """Write one record (or run of segments) per row as gzipped WARC files under ``path``.

    ``date`` is the records' WARC-Date; by default the time of the call, the same for all its tasks.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = _pages(pages, key, url, html)
    revisits = plan_records(page_digests(rows), least_bytes)
    same = (F.col("page_id") == F.col("revisitor")) & (F.sha2("payload", 256) == F.lower(F.hex("revisited")))
    joined = rows.join(revisits, same, "left").select("page_id", "url", "payload", "refers_to")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for page_id, link, payload, refers in zip(*batch.columns):
                for record in _records_of(page_id.as_py(), link.as_py(), payload.as_buffer(), refers.as_py()):
                    out.append(record)
                    size += len(record)
                    if size >= 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                        out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    def _records_of(page_id, link, payload: pa.Buffer, refers) -> Iterator[bytes]:
        state, last = Digests(), 0
        for chunk in chunks(payload, chunk_bytes):
            state.add(chunk)
            last += 1
        digest, http = state.base32(), _http_header(state.length)
        # the id names the capture: equal rows of a page are equal records
        name = f"urn:page:{_EMPTY_ID if page_id is None else page_id}:{digest}"
        common = [("WARC-Date", date), ("WARC-Target-URI", _one_line(link))]
        own = [("WARC-Record-ID", f"<{name}>"), *common, ("Content-Type", _HTTP), ("WARC-Payload-Digest", f"sha1:{digest}")]
        if refers is not None:
            earlier = [("WARC-Profile", _SAME_PAYLOAD), ("WARC-Refers-To", f"<urn:page:{refers}:{digest}>")]
            yield _record("revisit", own + earlier, http)
            return
        for part, chunk in enumerate(chunks(payload, chunk_bytes), 1):
            if part == 1:
                yield _record("response", own + [("WARC-Segment-Number", 1)] * (last > 1), http, chunk)
                continue
            fields = [("WARC-Record-ID", f"<{name}:{part}>"), *common, ("WARC-Segment-Origin-ID", f"<{name}>")]
            fields += [("WARC-Segment-Number", part)]
            if part == last:
                fields += [("WARC-Segment-Total-Length", len(http) + state.length)]
            yield _record("continuation", fields, chunk)

    written = joined.mapInArrow(records, "value binary").select(F.col("value").cast("string").alias("value"))
    written.write.option("compression", "gzip").option("lineSep", "\n").text(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The record table: one row per WARC record that holds a payload or a part of one, or revisits one.

    (record_type, origin, record_id, refers_to, uri, segment, total, header_bytes, payload_bytes, digest,
    chunk): ``origin`` is the id of the record's first segment, ``chunk`` the payload's part without the HTTP
    header, ``payload_bytes`` what that header says of the whole.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in names}
            for value in batch.column(0):
                head, _, rest = value.as_py().removeprefix(_VERSION).partition(b"\r\n\r\n")
                fields = _fields(head)
                length = int(fields["content-length"])
                block = rest[:length]
                # the last record of a file still has its blank line
                if len(block) != length or rest[length:] not in (b"", b"\r\n\r\n"):
                    raise ValueError(f"record {fields.get('warc-record-id')} is not as long as its header says")
                kind, size, inner = fields["warc-type"], None, 0
                if kind not in _READ:
                    continue
                if fields.get("content-type", "").startswith("application/http"):
                    http, blank, block = block.partition(b"\r\n\r\n")
                    inner = len(http) + len(blank)
                    size = _fields(http).get("content-length")
                origin = fields.get("warc-segment-origin-id") or fields["warc-record-id"]
                named, refers = _NAMED.fullmatch(origin), _NAMED.fullmatch(fields.get("warc-refers-to", ""))
                segment, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
                digest = fields.get("warc-payload-digest", "")
                out["record_type"].append(kind)
                out["origin"].append(origin)
                out["record_id"].append(named and int(named[1]))
                out["refers_to"].append(refers and int(refers[1]))
                out["uri"].append(fields.get("warc-target-uri"))
                out["segment"].append(segment and int(segment))
                out["total"].append(total and int(total))
                out["header_bytes"].append(inner)
                out["payload_bytes"].append(size and int(size))
                out["digest"].append(digest.removeprefix("sha1:") if digest.startswith("sha1:") else None)
                out["chunk"].append(block)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    kind = (
        "record_type string, origin string, record_id long, refers_to long, uri string, segment long, total long,"
        " header_bytes long, payload_bytes long, digest string, chunk binary"
    )
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[of]) for name, of in (part.split() for part in kind.split(", "))])
    names = schema.names
    # a record starts after the end of the one before it
    lines = spark.read.option("lineSep", _SEPARATOR.decode()).text(path)
    return lines.select(F.col("value").cast("binary").alias("value")).mapInArrow(rows, kind)


_VERIFIED = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, copies long"
)


def _verify(chunk_rows: DataFrame) -> DataFrame:
    """Stream chunk rows, those of a record in line, into one verified row per record."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # repeated captures of a page hold the same segments: each number comes as often
        state, segment, copies, before, first = Digests(), 0, 1, None, None
        for batch in batches:
            out: dict[str, list] = {name: [] for name in names}
            for row in zip(*[batch.column(n) for n in wanted]):
                kind, origin, page, refers, number, total, inner, size, digest = (v.as_py() for v in row[:-1])
                if number is not None:
                    if (origin, number) == before:
                        copies += number == 1
                        continue
                    if number != segment + 1:
                        raise ValueError(f"segments of {origin} are missing before {number}")
                    before, segment = (origin, number), number
                if number is None or number == 1:
                    first = (kind, page, refers, inner, size, digest)
                state.add(row[-1].as_buffer())
                if number is not None and total is None:
                    continue
                kind, page, refers, inner, size, digest = first
                if kind != "revisit":
                    short = state.base32()
                    # the digest decides; crawlers copy the length in the HTTP header as servers state it
                    if digest not in (None, short) or (digest is None and size not in (None, state.length)):
                        raise ValueError(f"the payload of {origin} does not match its digest or length")
                    if total not in (None, inner + state.length):
                        raise ValueError(f"the segments of {origin} are not as long as the last one says")
                    size, digest = state.length, short
                out["page_id"].append(page)
                out["payload_bytes"].append(size)
                out["payload_digest"].append(digest)
                out["record_type"].append("revisit" if kind == "revisit" else "response")
                out["refers_to"].append(refers)
                out["copies"].append(copies)
                state, segment, copies = Digests(), 0, 1
            yield pa.RecordBatch.from_pydict(out, schema=schema)
        if segment:
            raise ValueError(f"the last segments of {before[0]} are missing")

    wanted = (
        "record_type", "origin", "record_id", "refers_to", "segment", "total", "header_bytes", "payload_bytes", "digest", "chunk"
    )
    names = [part.split()[0] for part in _VERIFIED.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(p.split()[0], kinds[p.split()[1]]) for p in _VERIFIED.split(", ")])
    return chunk_rows.select(*wanted).mapInArrow(rows, _VERIFIED)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), one row per record, verified."""
    table = read_chunks(spark, path)
    whole = _verify(table.filter(F.col("segment").isNull()))
    # only large payloads are brought together: by the first one's id, in order of their segments
    parts = table.filter(F.col("segment").isNotNull()).repartition("origin")
    large = _verify(parts.sortWithinPartitions("origin", "segment"))
    repeated = large.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    return whole.unionByName(repeated).drop("copies")


def round_trip(
    pages: DataFrame,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    least_bytes: int = 0,
    chunk_bytes: int = CHUNK_BYTES,
    path: str | None = None,
) -> DataFrame:
    """Write the archives (by default under the shared folder) and read them back."""
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_warc(pages, path, key, url, html, least_bytes, chunk_bytes)
    return read_warc(spark, path)


@query("op9_warc_round_trip")
def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as it is read back from the archives."""
    return round_trip(read(spark, sf_dir, "pages"))
