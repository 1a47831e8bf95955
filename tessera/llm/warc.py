r"""WARC derivatives: metadata and plain-text conversion records of response records.

A response record (record_id, target_uri, date, http: the whole HTTP message) gives two derived records. The conversion
record holds the page's text; the metadata record holds the source's status line, content type, length and digest, its HTTP
headers, the page's title and its links. Both carry WARC-Refers-To with the response's id and name each other in WARC-Concurrent-To;
ids are UUIDs of version 5 made from the response's id, so that a run that is repeated gives the same records. Digests are
SHA-1 in base 32, as is usual in WARC files. Everything is made in one pass, without a shuffle.

Defined cases: a null or empty message gives empty text and a metadata record with an empty status; null ids, dates and addresses
become empty header values. A head that isn't closed ends at the body or the first thing that can't stand in a head; scripts, styles,
comments and tags that aren't closed go on to the end of the page. Quotes in a tag hide a `>` within QUOTED characters; a tag whose quotes don't
end there ends at its first `>`. Links in scripts and comments are none. A page is read once, in time that grows with its length. A message without an end of headers is taken as a body alone. Bytes that
the declared charset (UTF-8 if none or unknown) can't decode are replaced. Repeated responses give repeated records with the same ids. Other
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
BREAKS = frozenset("address article aside blockquote body br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())
IN_HEAD = frozenset("base link meta title script style noscript template".split())
CLOSE = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>?", re.I) for n in ("script", "style", "noscript", "template", "title")}
HEAD_END = re.compile(r"</head(?=[\s/>])[^>]*>?|<body(?=[\s/>])", re.I)
STOP = re.compile("[>\"']")
HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
QUOTED = 16_384
CHARSET = re.compile(rb"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
SCHEMA = "response_id string, type string, record_id string, refers_to string, concurrent_to string, target_uri string, date string, content_type string, content_length long, block_digest string, source_digest string, header string, block binary"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


class Page:
    """Text (blocks on lines of their own, runs of white space as one space, no empty lines), title and links of a page."""

    def __init__(self, page: str):
        self.page, self.title, self.links = page, None, []
        self.last, self.none = page.rfind(">"), {}
        text = html.unescape("".join(self.scan()))
        self.text = "\n".join(x for x in (" ".join(y.split()) for y in text.split("\n")) if x)

    def close(self, name: str, at: int) -> re.Match | None:
        """The closing tag of name after at; that there is none is remembered."""
        if self.none.get(name):
            return None
        found = CLOSE[name].search(self.page, at)
        self.none[name] = found is None
        return found

    def tag_end(self, at: int) -> int:
        """One past the end of the tag whose name ends at `at`."""
        page, p, far = self.page, at, at + QUOTED
        while m := STOP.search(page, p, far):
            if m[0] == ">":
                return m.end()
            if (p := page.find(m[0], m.end(), far) + 1) == 0:
                break
        return page.find(">", at) + 1

    def scan(self) -> Iterator[str]:
        page, p, head, ends = self.page, 0, False, (-1, False)
        while m := OPEN.search(page, p):
            between = page[p : m.start()]
            if head and between.strip():
                head = False
            if not head:
                yield re.sub(r"\s+", " ", between)
            if m[1]:
                yield " "
                p = (page.find("-->", m.end()) + 3) if page.find("-->", m.end()) >= 0 else len(page)
                continue
            if m.start() > self.last:  # never closed
                return
            if m[2]:
                yield " "
                p = page.find(">", m.end()) + 1
                continue
            name, p = m[4].lower(), self.tag_end(m.end())
            if name == "head":
                yield " "
                if not m[3]:
                    if ends[0] < p:
                        found = HEAD_END.search(page, p)
                        ends = (found.start(), found) if found else (len(page), None)
                    if ends[1] and ends[1][0][1] == "/":
                        self.titled(page[p : ends[0]])
                        p = ends[1].end()
                    else:
                        head = True
                else:
                    head = False
                continue
            if head and name not in IN_HEAD:
                head = False
            if name in CLOSE and not m[3]:
                found = self.close(name, p)
                if name == "title":
                    if found and self.title is None:
                        self.title = page[p : found.start()]
                    if not head or not found:
                        yield "\n"
                        continue
                if found or name in ("script", "style"):
                    yield " "
                    p = found.end() if found else len(page)
                    continue
            if name == "a" and not m[3] and (found := HREF.search(page, m.end(), p)):
                self.links.append(next((x for x in found.groups() if x is not None), ""))
            if name in BREAKS and not head:
                yield "\n"
        if not head or page[p:].strip():
            yield re.sub(r"\s+", " ", page[p:])

    def titled(self, head: str) -> None:
        """The title of a closed head."""
        at = 0
        while self.title is None and (m := OPEN.search(head, at)):
            if m[1]:
                at = head.find("-->", m.end()) + 3
                if at < 3:
                    return
                continue
            at = m.end()
            if m[4] and not m[3] and (name := m[4].lower()) in CLOSE:
                if not (found := CLOSE[name].search(head, at)):
                    return
                if name == "title":
                    self.title = head[head.find(">", at) + 1 : found.start()]
                at = found.end()


def text_of(page: str) -> str:
    return Page(page).text


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def one_line(value: str) -> str:
    """A header's value: line breaks would end it."""
    return " ".join(value.split())


def header_of(fields: list[tuple[str, str]]) -> str:
    return "WARC/1.1\r\n" + "".join(f"{k}: {one_line(v)}\r\n" for k, v in fields) + "\r\n"


def derived(record_id: str, uri: str, date: str, http: bytes) -> list[tuple]:
    """The metadata and the conversion record of one response."""
    head, mark, body = http.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"HTTP/"):
        head, body = b"", http
    status, *lines = head.decode("latin-1").split("\r\n")
    fields = [tuple(x.partition(":")[::2]) for x in lines if ":" in x]
    kind = next((v.strip() for k, v in fields if k.strip().lower() == "content-type"), "")
    found = CHARSET.search(kind.encode("latin-1")) or CHARSET.search(body[:1024])
    try:
        page = body.decode(found[1].decode() if found else "utf-8", "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    source = digest(body)
    ids = [f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record_id} {t}')}>" for t in ("metadata", "conversion")]
    read = Page(page)
    links = dict.fromkeys(one_line(html.unescape(x)) for x in read.links)
    about = [("source-status", status), ("source-content-type", kind), ("source-length", str(len(body))), ("source-digest", source), ("title", html.unescape(re.sub(r"<[^<>]*>", "", read.title or "")))]
    about += [("source-header", f"{k.strip()}: {v.strip()}") for k, v in fields] + [("outlink", x) for x in links if x]
    blocks = ["".join(f"{k}: {one_line(v)}\r\n" for k, v in about).encode("utf-8", "surrogatepass"), read.text.encode("utf-8", "replace")]
    out = []
    for i, (name, mime) in enumerate((("metadata", "application/warc-fields"), ("conversion", "text/plain; charset=utf-8"))):
        head_ = [("WARC-Type", name), ("WARC-Record-ID", ids[i]), ("WARC-Refers-To", record_id), ("WARC-Concurrent-To", ids[1 - i]), ("WARC-Target-URI", uri), ("WARC-Date", date)]
        head_ += [("WARC-Block-Digest", digest(blocks[i])), ("Content-Type", mime), ("Content-Length", str(len(blocks[i])))]
        out.append((record_id, name, ids[i], record_id, ids[1 - i], uri, date, mime, len(blocks[i]), digest(blocks[i]), source, header_of(head_), blocks[i]))
    return out


def derivatives(responses: DataFrame) -> DataFrame:
    """Two rows (SCHEMA) for each row of responses (record_id, target_uri, date, http)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = [r for x in zip(*(c.slice(at, 500).to_pylist() for c in batch.columns)) for r in derived(x[0] or "", x[1] or "", x[2] or "", x[3] or b"")]
                columns = list(zip(*rows))
                types = [pa.int64() if n == "content_length" else pa.binary() if n == "block" else pa.string() for n in NAMES]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], NAMES)

    return responses.select("record_id", "target_uri", "date", F.col("http").cast("binary")).mapInArrow(run, SCHEMA)


def responses_of_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of pages (page_id, url, html), by built-in expressions."""
    body = F.coalesce(F.col("html"), F.lit(""))
    h = F.sha1(F.concat_ws(" ", F.col("page_id").cast("string"), "url", body))
    part = lambda a, n: F.substring(h, a, n)
    ident = F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body)
    return pages.select("page_id", ident.alias("record_id"), F.coalesce("url", F.lit("")).alias("target_uri"), F.lit(date).alias("date"), http.cast("binary").alias("http"))


def write_files(records: DataFrame, path: str) -> DataFrame:
    """Records as gzip members in one .warc.gz file for each partition under path, a folder all executors share (file, hdfs, s3 or gs); returns
    (file, records, bytes). A file is written under a name of its own attempt and then renamed, so that tasks may be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        context = TaskContext.get()
        store, where = fs.FileSystem.from_uri(path)
        name, n, size = f"{where}/part-{context.partitionId():05d}.warc.gz", 0, 0
        store.create_dir(where)
        mine = f"{name}.{context.taskAttemptId()}"
        with store.open_output_stream(mine, compression=None) as f:
            for b in batches:
                for head, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    size += f.write(z.compress(head.encode("utf-8", "replace") + block + b"\r\n\r\n") + z.flush())
                    n += 1
        store.move(mine, name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n]), pa.array([size])], ["file", "records", "bytes"])

    return records.select("header", "block").mapInArrow(run, "file string, records long, bytes long")


def records_in(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record of a WARC file, plain or of gzip members; a cut last record is left out."""
    plain = bytearray()
    while data[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        plain += z.decompress(data)
        data = z.unused_data
    data, at = bytes(plain) or data, 0
    while (end := data.find(b"\r\n\r\n", at)) >= 0:
        version, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = fields.get("content-length", "0")
        n = int(size) if size.isdecimal() else 0
        if not version.startswith("WARC/") or end + 4 + n > len(data):
            return
        yield fields, data[end + 4 : end + 4 + n]
        at = end + 4 + n
        while data[at : at + 2] == b"\r\n":
            at += 2


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, type, record_id, target_uri, date, http) of the records of WARC files, each read by one task; derivatives() takes those of type response."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for f, block in records_in(data):
                    row = (name, *(f.get(k, "") for k in ("warc-type", "warc-record-id", "warc-target-uri", "warc-date")), block)
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["file", "type", "record_id", "target_uri", "date", "http"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, type string, record_id string, target_uri string, date string, http binary")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every derived record of every page, its block as text."""
    responses = responses_of_pages(table(spark, sf_dir, "pages"))
    return derivatives(responses).withColumn("block", F.col("block").cast("string"))
