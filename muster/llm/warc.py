"""Derived web-archive records: metadata and plain-text conversion records of response records.

A response record is a row (record_id, target_uri, date, headers, block): its identifier, address and date, all its
archive headers as a map, and its block, an HTTP response as bytes. ``derive`` gives two linked records for
each: a ``metadata`` record whose JSON block holds the archive headers, the HTTP status and headers, title,
links, length and digest of the body, and a ``conversion`` record whose block is the text of the page. Both refer to
the response by ``refers_to``, keep its address and date, and carry the digest of its body; record identifiers follow
from the response's, so a rerun gives the same records.

``responses`` wraps pages (id, url, html) as response records; ``serialized`` adds the bytes of a record as a gzip
member, and ``read_records`` reads files of such members or of plain records back.

Defined results: a null block is empty; without a blank line after the head all of it is body. Headers of one name are joined by a
comma and blank, names compare without case. A body is decoded by its charset, else as UTF-8, with U+FFFD for what does
not fit. A body that is not HTML or text is converted to empty text. A null url gives records without address. Repeated
rows give repeated records with the same identifiers, a null id counts as empty. Links and text are whole.
Only the named columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import base64
import contextlib
import gzip
import hashlib
import html
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm.tables import bounded_batches

RESPONSES = "record_id string, target_uri string, date string, headers map<string,string>, block binary"
DERIVED = (
    "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, "
    "content_length bigint, block_digest string, source_digest string, body string"
)
DATE = "2024-01-01T00:00:00Z"

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
_BREAK = re.compile(
    r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|"
    r"section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^<>]*>", re.I
)
# a tag ends at its > and holds no <, so that pages of unclosed tags are read in one pass
_TAG = re.compile(r"<[/!?a-zA-Z][^<>]*>")
_BLANKS, _LINES = re.compile(r"[^\S\n]+"), re.compile(r"[^\S\n]*\n\s*")
_TITLE, _TITLE_END = re.compile(r"<title\b[^<>]*>", re.I), re.compile(r"</title\s*>", re.I)
_LINK = re.compile(r"""<a\b[^<>]*?\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def digest(data: bytes) -> str:
    """A labelled digest as archives write it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def plain_text(page: str) -> str:
    """The text of a page: no scripts, styles or comments, one line per block, single blanks."""
    text = _TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub("", page)))
    return _LINES.sub("\n", _BLANKS.sub(" ", html.unescape(text))).strip()


def title_and_links(page: str) -> tuple[str, list[str]]:
    visible = _HIDDEN.sub("", page)
    found = _TITLE.search(visible)
    end = _TITLE_END.search(visible, found.end()) if found else None
    title = " ".join(html.unescape(visible[found.end() : end.start()]).split()) if found and end else ""
    return title, [html.unescape(a or b or c) for a, b, c in _LINK.findall(visible)]


def parsed_response(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """Status line, headers by lower-case name, and body of an HTTP response."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"HTTP/"):
        return "", {}, block
    lines = head.decode("latin-1").split("\r\n")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            name, value = name.strip().lower(), value.strip()
            headers[name] = f"{headers[name]}, {value}" if name in headers else value
    return lines[0], headers, body


def decoded(body: bytes, content_type: str) -> str:
    charset = _CHARSET.search(content_type)
    try:
        return body.decode(charset[1] if charset else "utf-8", "replace")
    except (LookupError, UnicodeError):  # unknown, or a codec that does not decode pages
        return body.decode("utf-8", "replace")


def derived_records(record_id: str | None, uri: str | None, date: str | None, headers: dict[str, str], block: bytes) -> list[tuple]:
    """The metadata and the conversion record of one response, as rows of ``DERIVED``."""
    status, http, body = parsed_response(block)
    kind = http.get("content-type", "text/html")
    readable = kind.lower().startswith(("text/", "application/xhtml"))
    page = decoded(body, kind) if readable else ""
    marked_up = readable and not kind.lower().startswith("text/plain")
    title, links = title_and_links(page) if marked_up else ("", [])
    text = plain_text(page) if marked_up else page.strip()
    source = digest(body)
    about = {
        "source": {"record_id": record_id, "target_uri": uri, "date": date, "headers": dict(sorted(headers.items()))},
        "http": {"status": status, "headers": http},
        "body": {"length": len(body), "digest": source},
        "html": {"title": title, "links": links},
    }
    root = uuid.uuid5(uuid.NAMESPACE_URL, record_id or "")
    rows = []
    for name, content_type, own in (
        ("metadata", "application/json", json.dumps(about, ensure_ascii=False)),
        ("conversion", "text/plain; charset=utf-8", text),
    ):
        data = own.encode("utf-8", "replace")
        rows.append((
            name, f"<urn:uuid:{uuid.uuid5(root, name)}>", record_id, uri, date, content_type, len(data), digest(data), source, data.decode("utf-8"),
        ))
    return rows


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


_RESPONSE_NAMES = [c.split()[0] for c in RESPONSES.split(", ")]
_DERIVED_NAMES = [c.split()[0] for c in DERIVED.split(", ")]
_DERIVED_TYPES = [pa.int64() if c.endswith("bigint") else pa.string() for c in DERIVED.split(", ")]
_STEP = 256


def _derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, _STEP):
            part, rows = batch.slice(start, _STEP), []
            for r in part.select(_RESPONSE_NAMES).to_pylist():
                rows.extend(derived_records(r["record_id"], r["target_uri"], r["date"], dict(r["headers"] or {}), r["block"] or b""))
            out = _table(rows, _DERIVED_NAMES, _DERIVED_TYPES)
            key = part.column(part.num_columns - 1).take(pa.array([i // 2 for i in range(2 * part.num_rows)], pa.int64()))
            yield pa.RecordBatch.from_arrays([key, *out.columns], names=["_key", *_DERIVED_NAMES])


def derive(records: DataFrame, key: str = "record_id") -> DataFrame:
    """Metadata and conversion record of every response record, after the column ``key`` of the response."""
    bounded_batches(records.sparkSession)
    slim = records.select(*_RESPONSE_NAMES, F.col(key).alias("_key"))
    made = slim.mapInArrow(_derived, f"_key {records.schema[key].dataType.simpleString()}, {DERIVED}")
    return made.drop("_key") if key in _DERIVED_NAMES else made.withColumnRenamed("_key", key)


def responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", date: str = DATE) -> DataFrame:
    """Response records of pages, with the page's id as a further column of that name."""

    @F.arrow_udf("struct<record_id: string, block: binary, block_digest: string, payload_digest: string>")
    def wrap(ids: pa.Array, urls: pa.Array, bodies: pa.Array) -> pa.Array:
        out = []
        for i, u, b in zip(ids.to_pylist(), urls.to_pylist(), pc.fill_null(bodies, "").cast(pa.binary()).to_pylist()):
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(b)}\r\n\r\n".encode("ascii")
            out.append({
                "record_id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{i or str()} {u or str()}')}>",
                "block": head + b, "block_digest": digest(head + b), "payload_digest": digest(b),
            })
        kind = pa.struct([("record_id", pa.string()), ("block", pa.binary()), ("block_digest", pa.string()), ("payload_digest", pa.string())])
        return pa.array(out, kind)

    made = pages.select(F.col(page_id).alias("_id"), F.col(url).alias("target_uri"), wrap(F.col(page_id).cast("string"), F.col(url), F.col(page)).alias("w"))
    headers = F.map_filter(F.create_map(
        F.lit("WARC-Type"), F.lit("response"), F.lit("WARC-Record-ID"), F.col("w.record_id"), F.lit("WARC-Target-URI"), F.col("target_uri"),
        F.lit("WARC-Date"), F.lit(date), F.lit("Content-Type"), F.lit("application/http; msgtype=response"),
        F.lit("Content-Length"), F.octet_length("w.block").cast("string"), F.lit("WARC-Block-Digest"), F.col("w.block_digest"),
        F.lit("WARC-Payload-Digest"), F.col("w.payload_digest"),
    ), lambda _, value: value.isNotNull())
    return made.select(F.col("_id").alias(page_id), "w.record_id", "target_uri", F.lit(date).alias("date"), headers.alias("headers"), "w.block")


def record_bytes(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None) + "\r\n"
    return gzip.compress(head.encode("utf-8") + block + b"\r\n\r\n", mtime=0)


def serialized(derived: DataFrame) -> DataFrame:
    """Derived records with ``record``, their bytes; members may be put one after another into a file."""

    @F.arrow_udf("binary")
    def pack(rows: pa.Array) -> pa.Array:
        return pa.array([
            record_bytes([
                ("WARC-Type", r["record_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Refers-To", r["refers_to"]),
                ("WARC-Target-URI", r["target_uri"]), ("WARC-Date", r["date"]), ("Content-Type", r["content_type"]),
                ("Content-Length", str(r["content_length"])), ("WARC-Block-Digest", r["block_digest"]),
                ("WARC-Refers-To-Payload-Digest", r["source_digest"]),
            ], r["body"].encode("utf-8")) for r in rows.to_pylist()
        ], pa.binary())

    whole: Column = F.struct(*[F.col(c) for c in _DERIVED_NAMES])
    return derived.withColumn("record", pack(whole))


def _unzipped(data: bytes) -> bytes:
    """All of the members of a file, as far as they can be read."""
    out = []
    with contextlib.suppress(EOFError, OSError, zlib.error), gzip.GzipFile(fileobj=io.BytesIO(data)) as stream:
        while part := stream.read1(1 << 20):
            out.append(part)
    return b"".join(out)


def parsed_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of a file, compressed or not.

    A file that breaks off gives its whole records and what is there of the last block; a length that is no number counts as 0.
    """
    if data[:2] == b"\x1f\x8b":
        stream = io.BytesIO(_unzipped(data))
    else:
        stream = io.BytesIO(data)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        headers: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip()] = value.strip()
        length = headers.get("Content-Length", "0")
        yield headers, stream.read(int(length) if re.fullmatch("[0-9]{1,18}", length) else 0)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``RESPONSES`` from archive files, one task per file; every type of record is read."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
        for batch in batches:
            for data in batch.column(0):
                some: list[tuple] = []
                for headers, block in parsed_records(data.as_py()):
                    some.append((headers.get("WARC-Record-ID"), headers.get("WARC-Target-URI"), headers.get("WARC-Date"), list(headers.items()), block))
                    if len(some) == _STEP:
                        yield _table(some, _RESPONSE_NAMES, kinds)
                        some = []
                yield _table(some, _RESPONSE_NAMES, kinds)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, RESPONSES)
