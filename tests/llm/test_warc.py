"""WARC derivatives: links, digests and the round trip through a file's bytes."""

import base64
import gzip
import hashlib
from html.parser import HTMLParser

import pytest

from tessera.llm import warc

HTML = """<!DOCTYPE html><html lang="en"><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head>
<body><!-- no --><p>One <b>two</b><br>three &lt;x&gt;</p><ul><li><a href='/a'>L</a></li><li><a href="/b?c=1&amp;d">M</a></ul> a < b</body></html>"""


def sha1(raw):
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def test_plain_text():
    assert warc.plain_text(HTML) == "One two\nthree <x>\nL\nM\na < b"
    assert warc.plain_text("") == warc.plain_text("<script>never ended") == ""


def test_records(spark):
    rows = [(1, "http://x/\r\ny", HTML), (2, None, "<p>é"), (3, "http://z", None), (4, "http://z", ""), (1, "http://x/\r\ny", HTML), (None, "u", "t")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, block string")
    found = warc.derive(warc.responses(pages)).collect()
    assert len(found) == 2 * len(rows)
    of = {r[0]: (r[2] or "").encode() for r in rows}
    for r in found:
        raw = r.block.encode()
        assert r.content_length == len(raw) and r.block_digest == sha1(raw) and r.source_payload_digest == sha1(of[r.page_id])
        assert r.refers_to != r.record_id and f"Content-Length: {len(of[r.page_id])}" in r.source_headers
    assert len({r.record_id for r in found}) == 10  # the repeated page gives the same records again
    assert len({r.refers_to for r in found}) == 5
    (meta,) = {r.block for r in found if r.page_id == 1 and r.record_type == "metadata"}
    assert "title: A & B\r\n" in meta and "outlink: /a\r\noutlink: /b?c=1&d\r\n" in meta and "language: en\r\n" in meta and "source-header-content-type: text/html; charset=utf-8\r\n" in meta
    assert warc.derive(warc.responses(pages.limit(0))).collect() == []


def test_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://x/\r\ny: z", HTML), (2, "http://z", None), (3, "http://q\nWARC-Type: evil", "<p>q")], "page_id long, url string, html string")
    derived = warc.derive(warc.responses(pages))
    data = b"".join(bytes(r.record) for r in warc.serialized(derived).collect())
    records = list(warc.parse(data))
    assert len(records) == 6
    by_id = {r.record_id: r for r in derived.collect()}
    for head, block in records:
        row = by_id[dict(head)["WARC-Record-ID"]]
        uri = row.target_uri.replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20")
        assert block.decode() == row.block
        assert head == [
            ("WARC-Type", row.record_type), ("WARC-Record-ID", row.record_id), ("WARC-Date", row.date), ("WARC-Target-URI", uri), ("WARC-Refers-To", row.refers_to), ("WARC-Refers-To-Target-URI", uri),
            ("WARC-Refers-To-Date", row.date), ("WARC-Source-Payload-Digest", row.source_payload_digest), *(("WARC-Source-Header", x) for x in row.source_headers.split("\r\n") if x),
            ("WARC-Block-Digest", row.block_digest), ("Content-Type", row.content_type), ("Content-Length", str(row.content_length)),
        ]


def test_headers_cannot_be_injected():
    row = {"record_id": "a", "date": "d", "target_uri": "u", "headers": "HTTP/1.1 200 OK\r\nX: 1\nWARC-Type: evil\r\n", "payload": "p"}
    ((head, block),) = warc.parse(warc.serialize_response(row))
    assert [k for k, _ in head] == ["WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Block-Digest", "Content-Type", "Content-Length"]
    block = warc.metadata_block("<html><title>a\r\nb</title>", row["headers"], "x")
    assert "source-header-x: 1 WARC-Type: evil\r\n" in block and "title: a b\r\n" in block and len(block.split("\r\n")) == 4


@pytest.mark.parametrize("compressed", [False, True])
def test_files_are_read_again(spark, tmp_path, compressed):
    pages = spark.createDataFrame([(i, f"http://x/{i}", None if i == 3 else f"<html lang='en'><p>text {i} é") for i in range(8)], "page_id long, url string, html string")
    found = warc.responses(pages, "2024-05-01T00:00:00Z")
    records = [bytes(r.record) for r in warc.serialized_responses(found).collect() + warc.serialized(warc.derive(found)).collect()]
    name = "a.warc.gz" if compressed else "a.warc"
    (tmp_path / name).write_bytes(b"".join(gzip.compress(r) for r in records) if compressed else b"".join(records))
    again = warc.read(spark, f"file://{tmp_path}/{name}")
    assert again.count() == 8  # the responses alone
    plain = lambda df: sorted(tuple(r) for r in df.select("record_id", "refers_to", "record_type", "target_uri", "date", "source_payload_digest", "source_headers", "block").collect())
    assert plain(warc.derive(again, "file")) == plain(warc.derive(found))


def test_payloads_are_decoded():
    body = "<p>süß".encode("latin-1")
    chunked = b"%x\r\n%s\r\n0\r\n\r\n" % (len(body), body)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\nTransfer-Encoding: chunked"
    assert warc.http_payload(head + b"\r\n\r\n" + chunked) == (head.decode() + "\r\n", "<p>süß")
    assert warc.http_payload(head + b"\r\n\r\n" + body)[1] == "<p>süß"  # already joined
    packed = gzip.compress("é".encode())
    assert warc.http_payload(b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + packed)[1] == "é"
    assert warc.http_payload(b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=none-such\r\n\r\nx")[1] == "x"


class Text(HTMLParser):
    """What a page says, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "title", "template", "noscript", "svg")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "title", "template", "noscript", "svg")

    def handle_data(self, data):
        if not self.hidden:
            self.words += data.split()


def test_text_is_that_of_a_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for page in pages:
        parser = Text()
        parser.feed(page.html)
        parser.close()
        assert "".join(warc.plain_text(page.html).split()) == "".join(parser.words)


def test_nulls_and_names(spark):
    found = spark.createDataFrame([(1, None, None, None, None, None)], "k long, record_id string, target_uri string, date string, headers string, payload string")
    rows = warc.derive(found, "k").collect()
    assert [r.record_type for r in rows] == ["metadata", "conversion"] and rows[1].block == ""
    with pytest.raises(ValueError):
        warc.derive(found.withColumnRenamed("k", "block"), "block")
