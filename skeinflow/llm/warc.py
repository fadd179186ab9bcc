"""WARC derivatives: linked metadata and plain-text conversion records from response records.

Records are WARC/1.1, each a gzip member of its own, in columns as in files.  A response's payload is taken out of its HTTP block,
put together from chunks and decompressed as its headers say; the metadata record holds the source's URI, date, HTTP status line, every HTTP header, digests, title and links, as warc-fields;
the conversion record holds the text.  Both refer to the response by its record id and repeat its target URI, date and payload
digest.  Identifiers are name-based UUIDs of what a record is made from, so reruns give the same ones.
"""

from __future__ import annotations

import hashlib
import io
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Date of records made from pages, which have none of their own.
PAGE_DATE = "2024-01-01T00:00:00Z"
_DROPPED = {"script", "style", "template", "noscript", "head"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "footer", "form", "h1", "h2", "h3", "h4", "h5",
    "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "title", "tr", "ul",
}


class Record(NamedTuple):
    """Named fields in order, and the block."""

    fields: list[tuple[str, str]]
    block: bytes

    def get(self, name: str) -> str | None:
        low = name.lower()
        return next((v for k, v in self.fields if k == name or k.lower() == low), None)


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Ten bits as two characters of base 32, and where the sixteen pairs of a SHA-1 begin.
_PAIRS = [a + b for a in _BASE32 for b in _BASE32]
_SHIFTS = range(150, -1, -10)


def digest(data: bytes) -> str:
    n = int.from_bytes(hashlib.sha1(data).digest())
    return "sha1:" + "".join([_PAIRS[n >> s & 1023] for s in _SHIFTS])


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(map(str, parts)))}>"


def _line(value: str) -> str:
    """A field value on one line."""
    return re.sub(r"[\r\n]+", " ", value) if "\n" in value or "\r" in value else value


#: Level of the gzip members in columns, which are read again at once, and in files.
FAST, SMALL = 1, 6


def gzipped(data: bytes, level: int) -> bytes:
    """One gzip member without a time, so that equal data gives equal bytes."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def serialise(record: Record, compress: bool = True, level: int = FAST) -> bytes:
    head = "".join(f"{k}: {_line(v)}\r\n" for k, v in [*record.fields, ("Content-Length", str(len(record.block)))])
    data = b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + record.block + b"\r\n\r\n"
    return gzipped(data, level) if compress else data


class _Members(io.RawIOBase):
    """The bytes of gzip members one after the other, decompressed as they are read."""

    def __init__(self, data: bytes):
        self.data, self.at, self.inner, self.held = memoryview(data), 0, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.held:
            if self.inner.eof:
                rest = self.inner.unused_data
                self.at -= len(rest)
                if not bytes(self.data[self.at : self.at + 2]) == b"\x1f\x8b":
                    return 0  # padding after the last member
                self.inner = zlib.decompressobj(31)
            tail = self.inner.unconsumed_tail
            if tail:
                self.held = self.inner.decompress(tail, 1 << 18)
                continue
            if self.at >= len(self.data):
                if not self.inner.eof:
                    raise ValueError("a gzip member cut short")
                return 0
            part = self.data[self.at : self.at + (1 << 16)]
            self.at += len(part)
            self.held = self.inner.decompress(part, 1 << 18)
        n = min(len(buffer), len(self.held))
        buffer[:n], self.held = self.held[:n], self.held[n:]
        return n


#: Most bytes that a single gzip member decompresses to at once.
_AT_ONCE = 1 << 22


def _plain(data: bytes) -> io.BufferedIOBase:
    """The decompressed bytes: of one short member at once, else as they are read."""
    if len(data) < _AT_ONCE:
        inner = zlib.decompressobj(31)
        plain = inner.decompress(data, _AT_ONCE)
        if inner.eof and not inner.unused_data:
            return io.BytesIO(plain)
    return io.BufferedReader(_Members(data), 1 << 16)


def _fields(lines: list[str]) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            k, _, v = line.partition(":")
            out.append((k.strip(), v.strip()))
    return out


def parse(data: bytes) -> Iterator[Record]:
    """Every record of a WARC file's bytes, gzip members or plain, one at a time: memory for the bytes and one record."""
    f = _plain(data) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        lines: list[str] = []
        while (line := f.readline()) and line not in (b"\r\n", b"\n"):
            lines.append(line.decode("utf-8", "replace").rstrip("\r\n"))
        length, fields = None, []
        for k, v in _fields(lines):
            if k.lower() != "content-length":
                fields.append((k, v))
            elif length is None:
                length = int(v)
        if length is None:
            raise ValueError("a record without Content-Length")
        block = f.read(length)
        if len(block) < length:
            raise ValueError("a record cut short")
        yield Record(fields, block)


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response block; a block without a head is all payload."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *rest = head.decode("latin-1").split("\r\n")
    return status, _fields(rest), payload


def _unchunked(data: bytes) -> bytes:
    """A chunked body put together; what follows a broken size line is taken as it is."""
    out, at = [], 0
    while at < len(data):
        end = data.find(b"\r\n", at)
        size = re.match(rb"[ \t]*([0-9A-Fa-f]+)[ \t]*(?:;.*)?$", data[at:end]) if end >= 0 else None
        if size is None:
            out.append(data[at:])
            break
        n = int(size[1], 16)
        if n == 0:
            break
        out.append(data[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out)


def _inflated(data: bytes, wbits: int) -> bytes:
    """Decompressed members; of a stream cut short, what is there."""
    out = []
    while data:
        inner = zlib.decompressobj(wbits)
        out.append(inner.decompress(data))
        if not inner.eof:
            out.append(inner.flush())
            break
        data = inner.unused_data if wbits == 31 and inner.unused_data[:2] == b"\x1f\x8b" else b""
    return b"".join(out)


def body(headers: list[tuple[str, str]], payload: bytes) -> tuple[bytes, str]:
    """What the payload of an HTTP response stands for, and the name of a coding that can't be undone ("" if there is none).

    Transfer codings come off first, then content codings, last named first.  Bytes that are not in the coding that their header
    names (crawlers often store the body decoded, under the headers as sent) stay as they are.
    """
    codings = {name: [c.strip().lower() for k, v in headers if k.lower() == name for c in v.split(",") if c.strip()] for name in ("transfer-encoding", "content-encoding")}
    if "chunked" in codings["transfer-encoding"] and re.match(rb"[ \t]*[0-9A-Fa-f]+[ \t]*(?:;[^\r\n]*)?\r\n", payload):
        payload = _unchunked(payload)
    for coding in [*reversed(codings["transfer-encoding"]), *reversed(codings["content-encoding"])]:
        try:
            if coding in ("gzip", "x-gzip"):
                payload = _inflated(payload, 31) if payload[:2] == b"\x1f\x8b" else payload
            elif coding == "deflate":
                try:
                    payload = _inflated(payload, 15)
                except zlib.error:
                    payload = _inflated(payload, -15)
            elif coding not in ("chunked", "identity"):
                return b"", coding
        except zlib.error:
            continue
    return payload, ""


#: Text up to a tag, and that tag: an end tag, or a start tag without attributes or with one in double quotes.
_COMMON = re.compile(r'([^<]*+)<(?:/([a-zA-Z][a-zA-Z0-9]*)>|([a-zA-Z][a-zA-Z0-9]*)(?: ([a-zA-Z][a-zA-Z-]*)="([^"]*)")?>)')
#: Elements whose content may have rules of its own: their start tags are left to the library.
_OWN_RULES = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}


class _Text(HTMLParser):
    """The library's parser, with a shorter way through text and common tags; all else is parsed by its methods."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.title: list[str] = []
        self.links: list[str] = []
        self.hidden = 0
        self.in_title = False
        #: Text inside what is dropped: thrown away at its end, shown if that never comes.
        self.aside: list[str] = []

    def updatepos(self, i: int, j: int) -> int:
        """Nothing asks for lines and columns."""
        return j

    def goahead(self, end: bool) -> None:
        raw, at = self.rawdata, 0
        match, find, start, data = _COMMON.match, raw.find, raw.startswith, self.handle_data
        while True:
            if self.cdata_elem is not None:
                m = self.interesting.search(raw, at)
                if m is None or not start("</", m.start()):
                    break
                if at < m.start():
                    data(raw[at : m.start()])
                at = m.start()
                after = self.parse_endtag(at)
            elif (m := match(raw, at)) and not (m[3] and m[3].lower() in _OWN_RULES):
                text, ended, tag, name, value = m.groups()
                if text:
                    data(unescape(text))
                if ended:
                    self.handle_endtag(ended.lower())
                else:
                    self.lasttag = tag = tag.lower()
                    self.handle_starttag(tag, [(name.lower(), unescape(value))] if name else [])
                at = m.end()
                continue
            else:
                opened = find("<", at)
                if opened < 0:
                    break
                if at < opened:
                    data(unescape(raw[at:opened]))
                at = opened
                if start("<!--", at):
                    after = self.parse_comment(at)
                elif start("<!", at):
                    after = self.parse_html_declaration(at)
                elif start("</", at):
                    after = self.parse_endtag(at)
                elif raw[at + 1 : at + 2].isalpha() and raw[at + 1].isascii():
                    after = self.parse_starttag(at)
                else:
                    break
            if after < 0:
                break
            at = after
        self.rawdata = raw[at:]
        super().goahead(end)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "body":
            self.hidden, self.aside = 0, []
        if tag in _DROPPED:
            self.hidden += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "a":
            self.links += [v for k, v in attrs if k == "href" and v]
        if tag in _BLOCK:
            self._break()

    def handle_endtag(self, tag: str) -> None:
        if tag in _DROPPED:
            self.hidden = max(0, self.hidden - 1)
            self.aside = self.aside if self.hidden else []
        elif tag == "title":
            self.in_title = False
        if tag in _BLOCK:
            self._break()

    def _break(self) -> None:
        for x in (self.pieces, self.aside):
            if not x or x[-1] != "\n":
                x.append("\n")

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
        elif not self.hidden:
            self.pieces.append(data)
        elif self.lasttag not in ("script", "style"):
            self.aside.append(data)


def html_text(html: str) -> tuple[str, str, list[str]]:
    """Text (blocks on lines of their own, white space as one space), title and links of a page."""
    p = _Text()
    p.feed(html)
    p.close()
    p.pieces += p.aside
    lines = (" ".join(x.split()) for x in "".join(p.pieces).split("\n"))
    return "\n".join(x for x in lines if x), " ".join("".join(p.title).split()), p.links


def page_response(page_id: object, url: str | None, html: str | None, date: str = PAGE_DATE) -> Record:
    payload = (html or "").encode("utf-8", "surrogatepass")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = head.encode() + payload
    of_payload = digest(payload)
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", page_id, url, of_payload))]
    fields += [("WARC-Target-URI", url)] if url else []
    fields += [("WARC-Date", date), ("WARC-Payload-Digest", of_payload), ("WARC-Block-Digest", digest(block))]
    return Record([*fields, ("Content-Type", "application/http; msgtype=response")], block)


def derive(source: Record) -> tuple[Record, Record]:
    """The metadata and the conversion record of a response.

    A body in a coding that can't be undone here has an empty conversion, and its metadata name the coding.
    """
    status, headers, payload = http_parts(source.block)
    content, unknown = body(headers, payload)
    ident = source.get("WARC-Record-ID") or record_id("unnamed", digest(source.block))
    of_payload = source.get("WARC-Payload-Digest") or digest(payload)
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    charset = re.search(r"charset=\"?([\w.:-]+)", kind, re.I)
    try:
        html = content.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        html = content.decode("utf-8", "replace")
    text, title, links = html_text(html)
    shared = [(k, v) for k in ("WARC-Target-URI", "WARC-Date") if (v := source.get(k))]
    shared += [("WARC-Refers-To", ident), *((f"WARC-Refers-To-{k[5:]}", v) for k, v in shared)]
    notes = [("source-record-id", ident), ("source-block-digest", source.get("WARC-Block-Digest") or digest(source.block)), ("source-payload-digest", of_payload), ("source-payload-length", str(len(payload)))]
    notes += [(f"source-{k.lower()}", v) for k, v in source.fields if k not in ("WARC-Record-ID", "WARC-Block-Digest", "WARC-Payload-Digest")]
    notes += [("http-status", status), *((f"http-header-{k.lower()}", v) for k, v in headers), ("title", title), *(("outlink", x) for x in links)]
    notes += [("undecoded-content-encoding", unknown)] if unknown else []
    note_block = "".join(f"{k}: {_line(v)}\r\n" for k, v in notes).encode("utf-8", "surrogatepass")
    text_block = text.encode("utf-8", "replace")

    def made(what: str, content: str, block: bytes) -> Record:
        of_block = digest(block)
        fields = [("WARC-Type", what), ("WARC-Record-ID", record_id(what, ident, of_block)), *shared]
        fields += [("WARC-Block-Digest", of_block), ("WARC-Source-Payload-Digest", of_payload), ("Content-Type", content)]
        return Record(fields, block)

    return made("metadata", "application/warc-fields", note_block), made("conversion", "text/plain; charset=utf-8", text_block)


def _respond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, max(1, whole.num_rows), 256):
            batch = whole.slice(lo, 256)
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([serialise(page_response(*r)) for r in rows], pa.binary())], ["page_id", "warc"])


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, max(1, whole.num_rows), 256):
            batch = whole.slice(lo, 256)
            at: list[int] = []
            out: list[tuple] = []
            for i, data in enumerate(batch.column("warc").to_pylist()):
                for r in parse(data or b""):
                    if r.get("WARC-Type") == "response":
                        at.append(i)
                        out.append(tuple(serialise(d) for d in derive(r)))
            made = [pa.array([r[k] for r in out], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").take(pa.array(at, pa.int64())), *made], ["page_id", "metadata", "conversion"])


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, max(1, whole.num_rows), 256):
            batch = whole.slice(lo, 256)
            out = [_summary(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("page_id", "metadata", "conversion")), strict=True)]
            kinds = [pa.int64() if t == "long" else pa.string() for t in _SUMMARY.values()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], ["page_id", *_SUMMARY])


def _page_columns(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))


def _summary_schema(rows: DataFrame) -> str:
    return ", ".join([f"page_id {rows.schema['page_id'].dataType.simpleString()}", *(f"{k} {v}" for k, v in _SUMMARY.items())])


def page_responses(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> page_id, warc: a response record for each page, whatever the type of its id.

    Null html is an empty payload, a null url leaves the target URI out; repeated rows give equal records; very long pages are worked on
    whole; an empty table gives no rows; other columns, whatever their names, are not looked at.
    """
    return _page_columns(pages).mapInArrow(_respond, f"page_id {pages.schema['page_id'].dataType.simpleString()}, warc binary")


def derivatives(responses: DataFrame) -> DataFrame:
    """(page_id, warc) -> page_id, metadata, conversion for each response in ``warc``; what isn't a response gives no row.

    Null or empty bytes give none either; repeated rows give equal records; records are derived one at a time, whole; an empty table
    gives no rows; other columns, whatever their names, are not looked at.
    """
    kind = responses.schema["page_id"].dataType.simpleString()
    return responses.select("page_id", "warc").mapInArrow(_derive, f"page_id {kind}, metadata binary, conversion binary")


_SUMMARY = {
    "metadata_id": "string", "conversion_id": "string", "refers_to": "string", "conversion_refers_to": "string", "target_uri": "string", "warc_date": "string",
    "http_status": "string", "source_content_type": "string", "source_payload_digest": "string", "payload_length": "long", "n_outlinks": "long", "title": "string",
    "conversion_digest": "string", "text_sha256": "string", "text_chars": "long",
}


def _summary(page: object, metadata: bytes, conversion: bytes) -> tuple:
    (m,), (c,) = parse(metadata), parse(conversion)
    for r in (m, c):
        if r.get("WARC-Block-Digest") != digest(r.block):
            raise ValueError(f"page {page}: block and digest differ")
    notes = Record(_fields(m.block.decode("utf-8", "replace").split("\r\n")), b"")
    text = c.block.decode()
    return (
        m.get("WARC-Record-ID"), c.get("WARC-Record-ID"), m.get("WARC-Refers-To"), c.get("WARC-Refers-To"), c.get("WARC-Target-URI"), c.get("WARC-Date"),
        notes.get("http-status"), notes.get("http-header-content-type"), c.get("WARC-Source-Payload-Digest"), int(notes.get("source-payload-length") or 0),
        sum(k == "outlink" for k, _ in notes.fields), notes.get("title"), c.get("WARC-Block-Digest"), hashlib.sha256(c.block).hexdigest(), len(text),
    )


def summaries(records: DataFrame) -> DataFrame:
    """What the derived records (page_id, metadata, conversion) say, read back from their bytes, digests checked.

    Records must not be null, as ``derivatives`` makes none such; a block that differs from its digest is an error; repeated rows
    give equal rows; an empty table gives no rows; other columns, whatever their names, are not looked at.
    """
    return records.select("page_id", "metadata", "conversion").mapInArrow(_summarise, _summary_schema(records))


def page_derivatives(pages: DataFrame) -> DataFrame:
    """One row per page: identifiers, links, source headers and digests of its derived records, and of its text.

    These are ``page_responses``, ``derivatives`` and ``summaries`` in one pass of a worker, so records don't travel in between.
    A null url leaves out the target URI; null html gives an empty text; repeated rows give equal records with equal ids;
    an empty table gives no rows; other columns are not looked at.
    """
    return _page_columns(pages).mapInArrow(lambda batches: _summarise(_derive(_respond(batches))), _summary_schema(pages))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under ``path`` (any store Spark reads): file, type, record_id, target_uri, warc.

    A file comes to one worker as its bytes (less than 2 GB, as the source has it) and is decompressed record by record, so memory is
    for these bytes and some records.  Empty files give no rows; files and records that are cut short are errors.
    """
    names = ["file", "type", "record_id", "target_uri", "warc"]
    kinds = [pa.string()] * 4 + [pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(whole.num_rows):
                name, data = whole.column("path")[i].as_py(), whole.column("content")[i].as_py()
                held: list[tuple] = []
                size = 0
                for r in parse(data):
                    held.append((name, r.get("WARC-Type"), r.get("WARC-Record-ID"), r.get("WARC-Target-URI"), serialise(r)))
                    size += len(held[-1][-1])
                    if len(held) == 256 or size > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in held], t) for k, t in enumerate(kinds)], names)
                        held, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in held], t) for k, t in enumerate(kinds)], names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, type string, record_id string, target_uri string, warc binary")


def write_warc(records: DataFrame, folder: str, column: str = "warc") -> list[str]:
    """Write each partition's records, as gzip members, to a file of its own in a folder that all executors mount; gives the names.

    Files appear whole, by their renaming; a partition without records makes none; a null record is an error; other columns are not
    looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        name, written = f"part-{uuid.uuid4().hex}.warc.gz", 0
        with open(os.path.join(folder, f".{name}"), "wb") as f:
            for batch in batches:
                for data in batch.column("warc").to_pylist():
                    plain = io.BufferedReader(_Members(data)).read() if data[:2] == b"\x1f\x8b" else data
                    written += f.write(gzipped(plain, SMALL))
        if not written:
            os.remove(os.path.join(folder, f".{name}"))
            return
        os.replace(os.path.join(folder, f".{name}"), os.path.join(folder, name))
        yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    return sorted(r["name"] for r in records.select(F.col(column).alias("warc")).mapInArrow(run, "name string").collect())
