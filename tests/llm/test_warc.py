import base64
import gzip
import hashlib
import time
from html.parser import HTMLParser

from tessera.llm import warc


class Words(HTMLParser):
    """A second reader of pages, for their words."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "noscript", "template", "head")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "noscript", "template", "head")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def test_records_of_pages(spark):
    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    responses = {r.record_id: r for r in warc.responses_of_pages(pages).collect()}
    out = warc.op7(spark, sf).collect()
    assert len(responses) == pages.count() and len(out) == 2 * len(responses)
    html_of = {r.page_id: r.html for r in pages.collect()}
    for r in out:
        source = responses[r.refers_to]
        body = html_of[source.page_id].encode()
        sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
        assert (r.source_digest, r.block_digest, r.content_length) == (sha(body), sha(r.block.encode()), len(r.block.encode()))
        assert r.target_uri == source.target_uri and f"WARC-Refers-To: {r.refers_to}\r\n" in r.header and f"WARC-Block-Digest: {r.block_digest}\r\n" in r.header
        if r.type == "conversion":
            p = Words()
            p.feed(html_of[source.page_id])
            assert "".join(r.block.split()) == "".join("".join(p.out).split())
        else:
            assert f"source-digest: {r.source_digest}\r\n" in r.block and "source-header: Content-Type: text/html; charset=utf-8\r\n" in r.block
    pairs = {r.record_id: r.concurrent_to for r in out}
    assert all(pairs[b] == a for a, b in pairs.items())


def test_edges_and_files(spark, tmp_path):
    rows = [("<urn:a>", "http://x/\r\nEvil: 1", "d", b"HTTP/1.1 404 No\r\nContent-Type: text/html; charset=latin-1\r\nX: y\r\n\r\n<title>A &amp; b</title><p>caf\xe9<script>x<y</script> &lt;t&gt;<a href='u?a=1&amp;b=2'>l</a>", 1), (None, None, None, None, 2), ("<urn:b>", "u", "d", b"", 3), ("<urn:c>", "u", "d", b"no head \xff<br>x<!-- open", 4), ("<urn:c>", "u", "d", b"no head \xff<br>x<!-- open", 4), ("<urn:l>", "u", "d", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=nonsense\r\n\r\n" + b"<p>long text</p>" * 50_000, 5)]
    df = spark.createDataFrame(rows, "record_id string, target_uri string, date string, http binary, block int")
    out = warc.derivatives(df).collect()
    by = {(r.response_id, r.type): r for r in out}
    assert len(out) == 12 and bytes(by["<urn:a>", "conversion"].block).decode() == "A & b\ncafé <t>l"
    assert b"outlink: u?a=1&b=2\r\n" in bytes(by["<urn:a>", "metadata"].block) and b"source-status: HTTP/1.1 404 No\r\n" in bytes(by["<urn:a>", "metadata"].block)
    assert "\r\nEvil" not in by["<urn:a>", "metadata"].header
    assert bytes(by["", "conversion"].block) == b"" and bytes(by["<urn:c>", "conversion"].block).decode() == "no head �\nx"
    files = warc.write_files(warc.derivatives(df.repartition(2)), f"file://{tmp_path}/w").collect()
    read = b"".join(gzip.open(f.file).read() for f in files)
    assert sum(f.records for f in files) == 12 == read.count(b"WARC/1.1\r\nWARC-Type: ")
    at, seen = 0, 0
    while at < len(read):
        head, _, _ = read[at:].partition(b"\r\n\r\n")
        n = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
        assert read[at + len(head) + 4 + n :][:4] == b"\r\n\r\n"
        at, seen = at + len(head) + 8 + n, seen + 1
    assert seen == 12 and warc.derivatives(df.limit(0)).count() == 0


def test_unclosed_elements_keep_the_text_after_them():
    text = warc.text_of
    assert text("<html><head><title>t</title><body><p>text") == "text"
    assert text("<head><meta charset=x><script>'<body>'</script><link href=y><p>one<p>two") == "one\ntwo"
    assert text("<head><title>t</title><script>'<body>'</script></head><body>text") == "text"
    assert text("<p>a<template>b<p>c") == "ab\nc" and text("<p>a<noscript>b</noscript>c") == "a c"
    assert text("<p>a<script>b<p>c") == "a"


def test_hostile_pages_take_linear_time():
    for bad in ("<a ", "<a '", "<head>", "<title>", "<noscript>", "<!--", "<script>", "<a href ", "<", '</a "', "<a \"><a ''>"):
        began = time.process_time()
        warc.Page(bad * (1_000_000 // len(bad)))
        assert time.process_time() - began < 10, bad


def test_tags_and_links():
    p = warc.Page("<html><head><title>T <b>x</title></head><body><!-- <a href=no> --><a class='>' href=\"u>v\">l</a> 1 < 2 <script><a href=no></script><a\nHREF=w>m</a> end <b unclosed")
    assert (p.text, p.title, p.links) == ("l 1 < 2 m end", "T <b>x", ["u>v", "w"])


def test_files_are_read_again(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hello</p>"
    head = warc.header_of([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:1>"), ("WARC-Target-URI", "http://x"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("Content-Length", str(len(http)))])
    raw = head.encode() + http + b"\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(raw) + gzip.compress(raw))
    (tmp_path / "b.warc").write_bytes(raw + raw[:-20])
    (tmp_path / "c.warc").write_bytes(b"")
    found = warc.read_files(spark, str(tmp_path)).collect()
    assert len(found) == 3 and {(r.type, r.record_id, r.target_uri, bytes(r.http)) for r in found} == {("response", "<urn:1>", "http://x", http)}
    out = warc.derivatives(warc.read_files(spark, str(tmp_path)).filter("type = 'response'"))
    assert [bytes(r.block) for r in out.filter("type = 'conversion'").collect()] == [b"hello"] * 3
    warc.write_files(out, f"file://{tmp_path}/again").collect()
    again = warc.read_files(spark, f"{tmp_path}/again").collect()
    assert sorted(r.type for r in again) == ["conversion"] * 3 + ["metadata"] * 3 and {bytes(r.http) for r in again if r.type == "conversion"} == {b"hello"}
