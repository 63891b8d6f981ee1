"""WARC derivatives: for each response a metadata record and a plain-text conversion record, linked to it.

Responses come from WARC files (`read`) or from a table of pages (`responses`), and are written as records too.
Both name the response in WARC-Refers-To (with its target URI and date), carry its payload digest, and keep its HTTP
headers: the metadata record as fields of its block, the conversion record as WARC headers. Record ids are name-based
UUIDs over the response's id and the record's kind, so building again gives the same records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, slabs

DATE = "1970-01-01T00:00:00Z"
_DROPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_HIDDEN = re.compile(r"<(/?)(template|noscript|svg)(?=[\s/>])[^>]*>", re.I)
_HEAD_TITLE = re.compile(r"<title(?=[\s/>])[^>]*>(?:(?!<title[\s/>]).)*?(?:</title\s*>|(?=</head\b|<body\b))", re.S | re.I)
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*>")
_SPACE, _LINES = re.compile(r"[^\S\n]+"), re.compile(r" ?\n[ \n]*")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)


def _without_hidden(page: str) -> str:
    """Leaves out closed template, noscript and svg elements; one that is never closed loses only its tag."""
    if not _HIDDEN.search(page):
        return page
    opened: dict[str, list[int]] = {"template": [], "noscript": [], "svg": []}
    spans = []
    for m in _HIDDEN.finditer(page):
        starts = opened[m[2].lower()]
        if not m[1]:
            if m[2].lower() != "svg" or not m[0].endswith("/>"):
                starts.append(m.start())
        elif starts:
            spans.append((starts.pop(), m.end()))
    kept, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            kept.append(page[at:start])
        at = max(at, end)
    return " ".join([*kept, page[at:]])


def plain_text(page: str) -> str:
    """The text of an HTML page: a line for each block, without scripts, styles, comments, titles and tags.

    Only a script, a style and a comment run to the end of the page if they are not closed. Nothing but its title is
    text of a head, so a head need not be closed.
    """
    text = _without_hidden(_DROPPED.sub(" ", _SPACE.sub(" ", page.replace("\r", "\n").replace("\n", " "))))
    text = _TAG.sub("", _BREAK.sub("\n", _HEAD_TITLE.sub(" ", text)))
    return _LINES.sub("\n", _SPACE.sub(" ", html.unescape(text))).strip()


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


_CONTROL = re.compile(r"[\x00-\x1f\x7f]+")
_NOT_URI = re.compile(r"[\x00-\x20\x7f]")


def _value(x: str) -> str:
    """A header's value on one line: control characters would end it and begin another header."""
    return _CONTROL.sub(" ", x).strip()


def _uri(x: str) -> str:
    """A URI as a header may hold it, white space and control characters in percent notation."""
    return _NOT_URI.sub(lambda m: f"%{ord(m[0]):02X}", x)


def record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(names))}>"


def _one_line(x: str) -> str:
    return re.sub(r"\s+", " ", html.unescape(x)).strip()


def metadata_block(page: str, headers: str, payload_digest: str) -> str:
    """application/warc-fields: what the response was, its headers, its title, language and outlinks."""
    fields = [("source-payload-digest", payload_digest)]
    for line in headers.split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            fields.append((f"source-header-{_value(name).lower()}", value))
    if m := _LANG.search(page):
        fields.append(("language", m[1]))
    if m := _TITLE.search(page):
        fields.append(("title", _one_line(m[1])))
    fields += [("outlink", _one_line(a or b or c)) for a, b, c in _LINK.findall(page)]
    return "".join(f"{k}: {_value(v)}\r\n" for k, v in fields)


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records from pages (page_id, url, html): record_id, target_uri, date, headers, payload.

    A null page is an empty payload and a null URL an empty one; an empty table gives an empty result. Where pages
    were crawled their WARC files have the true headers and dates: `read` takes them from there. Here the crawl's date and
    headers are not in the table, so the date is a parameter and the headers are those that follow from the payload.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    size: Column = F.octet_length(payload)
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n"))
    return pages.select(
        "page_id", F.coalesce(F.col("url"), F.lit("")).alias("target_uri"), F.lit(date).alias("date"), headers.alias("headers"), payload.alias("payload")
    ).withColumn("record_id", F.concat(F.lit("response "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(" "), F.col("target_uri")))


_COLUMNS = ["record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "content_length", "block_digest", "source_payload_digest", "source_headers", "block"]


def derive(found: DataFrame, key: str = "page_id") -> DataFrame:
    """Two rows, metadata and conversion, for each response record, with `key` and the columns of the record.

    `found` has key, record_id (a name from which the URN is made, or a URN), target_uri, date, headers and payload.
    Repeated responses give repeated records with the same ids; an empty payload gives an empty conversion block, a
    null in any column counts as empty; a very long page is a slab of its own; an empty table gives an empty result.
    Other columns are not read, and a key may have any name but that of an output.
    """
    if key in _COLUMNS:
        raise ValueError(f"the key has the name of an output: {key}")
    kind = found.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches, "payload"):
            rows, of = [], []
            names = ("record_id", "target_uri", "date", "headers", "payload")
            for i, (name, uri, date, headers, page) in enumerate(zip(*(batch.column(c).to_pylist() for c in names), strict=True)):
                name, uri, date, headers, page = name or "", uri or "", date or "", headers or "", page or ""
                source = name if name.startswith("<urn:") else record_id(name)
                own = digest(page.encode())
                for what, content, block in (
                    ("metadata", "application/warc-fields", metadata_block(page, headers, own)),
                    ("conversion", "text/plain; charset=utf-8", plain_text(page)),
                ):
                    raw = block.encode()
                    of.append(i)
                    rows.append((what, record_id(source, what), source, uri, date, content, len(raw), digest(raw), own, headers, block))
            columns = [pa.array(c, pa.int64() if n == "content_length" else pa.string()) for n, c in zip(_COLUMNS, zip(*rows, strict=True), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(of)), *columns], [key, *_COLUMNS])

    schema = f"`{key}` {kind}, " + ", ".join(f"{c} {'long' if c == 'content_length' else 'string'}" for c in _COLUMNS)
    return map_arrow(found.select(key, "record_id", "target_uri", "date", "headers", "payload"), run, schema)


def _record(head: list[tuple[str, str]], block: bytes) -> bytes:
    head = [*head, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {_value(v)}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def serialize(row: dict) -> bytes:
    """A derived record in WARC/1.1 form."""
    head = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", row["record_id"]),
        ("WARC-Date", row["date"]),
        ("WARC-Target-URI", _uri(row["target_uri"])),
        ("WARC-Refers-To", row["refers_to"]),
        ("WARC-Refers-To-Target-URI", _uri(row["target_uri"])),
        ("WARC-Refers-To-Date", row["date"]),
        ("WARC-Source-Payload-Digest", row["source_payload_digest"]),
        *(("WARC-Source-Header", line) for line in row["source_headers"].split("\r\n") if line),
        ("WARC-Block-Digest", row["block_digest"]),
        ("Content-Type", row["content_type"]),
    ]
    return _record(head, row["block"].encode())


def serialize_response(row: dict) -> bytes:
    """The response record that derived records refer to: its HTTP headers and its payload."""
    name, payload = row["record_id"] or "", (row["payload"] or "").encode()
    block = (row["headers"] or "").rstrip("\r\n").encode() + b"\r\n\r\n" + payload
    head = [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", name if name.startswith("<urn:") else record_id(name)),
        ("WARC-Date", row["date"] or ""),
        ("WARC-Target-URI", _uri(row["target_uri"] or "")),
        ("WARC-Payload-Digest", digest(payload)),
        ("WARC-Block-Digest", digest(block)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return _record(head, block)


def _written(rows: DataFrame, key: str, columns: list[str], text: str, make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches, text):
            records = [make(r) for r in batch.select(columns).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("record_id"), pa.array(records, pa.binary())], [key, "record_id", "record"])

    return map_arrow(rows.select(key, *columns), run, f"`{key}` {rows.schema[key].dataType.simpleString()}, record_id string, record binary")


def serialized(derived: DataFrame, key: str = "page_id") -> DataFrame:
    """key, record_id and record (bytes of the WARC record) for every derived record: concatenated, they are a file."""
    return _written(derived, key, _COLUMNS, "block", serialize)


def serialized_responses(found: DataFrame, key: str = "page_id") -> DataFrame:
    """The same for the responses themselves."""
    return _written(found, key, ["record_id", "target_uri", "date", "headers", "payload"], "payload", serialize_response)


# --- reading ---------------------------------------------------------------------------------------------------------


def members(data: bytes) -> Iterator[bytes]:
    """The parts of a file: what each gzip member holds (a record, as a rule), or all of it if it is not compressed."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        one = zlib.decompressobj(wbits=31)
        yield one.decompress(data) + one.flush()
        data = one.unused_data


def parse(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Headers and block of each record of a WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head: list[tuple[str, str]] = []
        for line in lines[1:]:
            if line[:1] in " \t" and head:  # a header that goes on
                head[-1] = (head[-1][0], f"{head[-1][1]} {line.strip()}")
                continue
            name, _, value = line.partition(":")
            head.append((name, value.strip()))
        size = next(int(v) for k, v in head if k.lower() == "content-length")
        yield head, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    raise ValueError("not in chunks")


def http_payload(block: bytes) -> tuple[str, str]:
    """The headers of an HTTP response and its payload as text: chunks joined, gzip undone, decoded by its charset."""
    head, _, body = block.partition(b"\r\n\r\n")
    headers = head.decode("utf-8", "replace")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in headers.split("\r\n")[1:])}
    try:
        if fields.get("transfer-encoding", "").lower() == "chunked":
            body = _unchunked(body)
        if fields.get("content-encoding", "").lower() in ("gzip", "x-gzip"):
            body = gzip.decompress(body)
    except (ValueError, OSError, EOFError, zlib.error):  # crawlers often store what is already undone
        pass
    m = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", fields.get("content-type", ""), re.I)
    try:
        return headers + "\r\n", body.decode(m[1] if m else "utf-8", "replace")
    except LookupError:
        return headers + "\r\n", body.decode("utf-8", "replace")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The response records of WARC files (plain, or gzip by record), as `derive` takes them, and the file of each.

    A file is one row of Spark's binary source and is read by one task, so it must fit there (2 GB at most; crawls cut
    theirs at about 1 GB). Files that are not WARC are an error; a folder without files gives an empty result.
    """
    kinds = ("file", "record_id", "target_uri", "date", "headers", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path"), batch.column("content"), strict=True):
                rows: list[tuple] = []
                size = 0
                for part in members(data.as_py()):
                    for head, block in parse(part):
                        fields = {k.lower(): v for k, v in head}
                        if fields.get("warc-type") == "response" and fields.get("content-type", "").replace(" ", "").startswith("application/http"):
                            headers, payload = http_payload(block)
                            rows.append((name.as_py(), fields.get("warc-record-id", ""), fields.get("warc-target-uri", "").strip("<>"), fields.get("warc-date", ""), headers, payload))
                            size += len(payload)
                    if size > 16_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], list(kinds))
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], list(kinds))

    return map_arrow(spark.read.format("binaryFile").load(path).select("path", "content"), run, ", ".join(f"{k} string" for k in kinds))
