"""WARC derivatives: every response record becomes a linked metadata record and a plain-text conversion record.

Records are WARC/1.1 bytes: a version line, named fields, an empty line, the block, two empty lines. A derivative
* refers to its response by WARC-Refers-To, with the response's target URI and date in WARC-Refers-To-Target-URI and
  WARC-Refers-To-Date and as its own;
* keeps the response's other WARC fields as Source-<name>, its digests among them, and the HTTP header lines in the
  metadata block as http-<name>;
* has an id derived from the response's, so that a task that runs again makes the same record, and SHA-1 digests (base32)
  of its own block.
Files are rows (file, content), gzipped record by record, kept as Parquet in a folder that all executors see.

Defined results: a null URL gives no target URI, null or empty HTML an empty text; a record that is no response has no
derivatives; a response without an HTTP header is read as plain content; equal rows give equal records.
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
from typing import NamedTuple
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from llm.tables import new_path

RECORDS = "page_id long, record binary"
PARSED = "page_id long, type string, record_id string, refers_to string, target_uri string, date string, content_type string, block_digest string, source_payload_digest string, fields map<string,string>, content binary"
DATE, FILE_BYTES = "2020-01-01T00:00:00Z", 32 << 20
_CRLF = b"\r\n"
#: Where markup begins: a comment, a tag or a declaration. A `<` before anything else is text.
_OPEN = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)|[/!?])")
#: Elements whose contents are no text: to their closing tag or the end of the page, and those that hide only if they are closed.
_RAW, _CLOSABLE = frozenset(("script", "style")), frozenset(("noscript", "template"))
#: What HTML lets stand in a head. All else ends it, closed or not.
_IN_HEAD = frozenset(("title", "meta", "link", "base", "basefont", "bgsound", "noscript", "template", "noframes", "script", "style", "html", "head"))
_BREAKS = frozenset(("p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "article", "section", "nav", "header", "footer", "blockquote", "pre", "title", "main", "aside", "form", "dd", "dt", "dl", "hr"))
_CLOSED = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("noscript", "template", "script", "style", "title", "noframes")}
#: What such an element in a head cannot go beyond.
_HEAD_PART = {x: re.compile(rf"</?({x}|head|body)(?=[\s/>])", re.I) for x in ("noscript", "template", "title", "noframes")}
_LANG, _HREF = re.compile(r"\blang\s*=\s*[\"']?([\w-]+)", re.I), re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)|'([^']*)|([^\s>]+))", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '#'.join(map(str, parts)))}>"


def write_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {one_line(v)}" for k, v in [*fields, ("Content-Length", str(len(block)))])]
    return "\r\n".join(lines).encode() + _CRLF * 2 + block + _CRLF * 2


def one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def read_records(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(fields, block) of every record in the bytes of a WARC file, gzipped or not."""
    if data[:2] == b"\x1f\x8b":
        data = b"".join(unzipped(data))
    at = 0
    while at < len(data):
        if data.startswith(_CRLF, at):
            at += 2
            continue
        end = data.index(_CRLF * 2, at)
        version, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields: list[tuple[str, str]] = []
        for line in lines:
            if line[:1] in " \t" and fields:  # a folded line
                fields[-1] = fields[-1][0], f"{fields[-1][1]} {line.strip()}"
            else:
                name, _, value = line.partition(":")
                fields.append((name.strip(), value.strip()))
        size = int(field(fields, "Content-Length") or 0)
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def unzipped(data: bytes, step: int = 1 << 14) -> Iterator[bytes]:
    """The contents of all gzip members, fed in small steps: what follows a member is copied each time that one ends."""
    at, member = 0, zlib.decompressobj(31)
    while at < len(data):
        yield member.decompress(data[at : at + step])
        at += step
        if member.eof:
            at = min(at, len(data)) - len(member.unused_data)
            member = zlib.decompressobj(31)


def field(fields: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in fields if k.lower() == name.lower()), None)


def response_record(page_id: int | None, url: str | None, page: str | None) -> bytes:
    """A page as the response record that a crawler would have stored."""
    payload = (page or "").encode("utf-8", "replace")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", derived_id("response", page_id, url, digest(payload))), ("WARC-Date", DATE)]
    fields += [("WARC-Target-URI", url)] if url else []
    fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block))]
    return write_record(fields, block)


def split_http(block: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """HTTP header lines, the status line among them as `status`, and the payload."""
    if not block.startswith(b"HTTP/"):
        return [], block
    head, _, payload = block.partition(_CRLF * 2)
    status, *lines = head.decode("latin-1").split("\r\n")
    return [("status", status), *((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines))], payload


class Page(NamedTuple):
    """What a page holds: its visible text with marks taken out, title (or None), language (or None) and links as they stand."""

    text: str
    title: str | None
    language: str | None
    links: list[str]


def scanned(page: str) -> Page:
    """A single pass over the page, each search of which goes on where the last one ended.

    Comments, scripts and styles hide what they hold, to the page's end if they are not closed; noscript and template hide it
    if they are closed. A head hides what only a head can hold; what cannot stand in one ends it, closed or not.
    """
    out: list[str] = []
    links: list[str] = []
    title = language = None
    at, head, absent = 0, False, set()  # absent: elements that are not closed any more

    def closing(name: str, begin: int):
        found = None if name in absent else _CLOSED[name].search(page, begin)
        if found is None:
            absent.add(name)
        return found

    while found := _OPEN.search(page, at):
        before = page[at : found.start()]
        out.append(before)
        head = head and not before.strip()
        if found[0] == "<!--":
            end = page.find("-->", found.end())
            if end < 0:
                at = len(page)
                break
            out.append(" ")
            at = end + 3
            continue
        end = page.find(">", found.start() + 1)
        if end < 0:  # no tag is closed from here on: the rest is text
            at = found.start()
            break
        at, closes, name = end + 1, found[1] == "/", (found[2] or "").lower()
        if closes:
            if name == "head":
                head = False
            head = head and name in _IN_HEAD
            out.append("\n" if name in _BREAKS else "")
            continue
        if name == "head":
            head = True
        elif name and head and name not in _IN_HEAD:
            head = False
        if name in _RAW:
            closed = closing(name, at)
            out.append(" ")
            at = closed.end() if closed else len(page)
        elif head and name in _HEAD_PART:
            closed = closing(name, at) if name == "title" and title is None else None
            if closed:
                title = page[at : closed.start()]
            limit = _HEAD_PART[name].search(page, at)
            if limit and limit[0].lower() == f"</{name}":
                end = page.find(">", limit.end())
                at = end + 1 if end >= 0 else len(page)
            elif name == "title":
                end = page.find("<", at)
                at = end if end >= 0 else len(page)
            out.append("\n")
        elif name in _CLOSABLE:
            closed = closing(name, at)
            out.append(" ")
            at = closed.end() if closed else at
        elif name == "title" and title is None and (closed := closing(name, at)):
            title = page[at : closed.start()]
            out.append("\n")
        else:
            if name == "a" and (href := _HREF.search(page, found.end(), end)):
                links.append(href[href.lastindex])
            elif name == "html" and language is None and (lang := _LANG.search(page, found.end(), end)):
                language = lang[1]
            out.append("\n" if name in _BREAKS else "")
    out.append(page[at:])
    return Page("".join(out), title, language, links)


def visible(text: str) -> str:
    """One line for each block of the page, white space collapsed, without empty lines."""
    return "\n".join(line for raw in html.unescape(text).split("\n") if (line := " ".join(raw.split())))


def plain_text(page: str) -> str:
    return visible(scanned(page).text)


def derivatives(record: bytes) -> list[bytes]:
    """The metadata and conversion records of a response; none of another record."""
    out = []
    for fields, block in read_records(record):
        if field(fields, "WARC-Type") != "response":
            continue
        source, uri, date = field(fields, "WARC-Record-ID") or "", field(fields, "WARC-Target-URI"), field(fields, "WARC-Date") or DATE
        http, payload = split_http(block)
        charset = re.search(r"charset=([\w-]+)", field(http, "content-type") or "")
        try:
            page = payload.decode(charset[1] if charset else "utf-8", "replace")
        except LookupError:
            page = payload.decode("utf-8", "replace")
        found = scanned(page)
        links = [urljoined(uri or "", html.unescape(x)) for x in found.links]
        about = [("title", " ".join(html.unescape(found.title).split()))] if found.title is not None else []
        about += [("language", found.language)] if found.language else []
        about += [(f"http-{k}", v) for k, v in http] + [("outlink", link) for link in links]
        metadata = "".join(f"{k}: {one_line(v)}\r\n" for k, v in about).encode()
        text = visible(found.text).encode("utf-8", "replace")
        kept = [(f"Source-{k}", v) for k, v in fields if k.lower() not in ("content-length", "warc-record-id", "warc-target-uri", "warc-date")]
        for kind, content_type, content in (("metadata", "application/warc-fields", metadata), ("conversion", "text/plain; charset=utf-8", text)):
            own = [("WARC-Type", kind), ("WARC-Record-ID", derived_id(source, kind)), ("WARC-Date", date), ("WARC-Refers-To", source), ("WARC-Refers-To-Date", date)]
            own += [("WARC-Target-URI", uri), ("WARC-Refers-To-Target-URI", uri)] if uri else []
            out.append(write_record([*own, ("Content-Type", content_type), ("WARC-Block-Digest", digest(content)), *kept], content))
    return out


def urljoined(base: str, link: str) -> str:
    try:
        return urljoin(base, link.strip())
    except ValueError:  # a link that is no URL stays as it is
        return link.strip()


def responses(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """RECORDS: a response record for every row of pages."""

    def per_batch(batches):
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([response_record(*row) for row in rows], pa.binary())], ["page_id", "record"])

    return pages.select("page_id", url, page).mapInArrow(per_batch, RECORDS)


def derived(records: DataFrame) -> DataFrame:
    """RECORDS: the derivatives of every response in records(page_id, record)."""

    def per_batch(batches):
        for batch in batches:
            made = [(i, d) for i, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if r is not None for d in derivatives(r)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in made], pa.int64()), pa.array([d for _, d in made], pa.binary())], ["page_id", "record"])

    return records.select("page_id", "record").mapInArrow(per_batch, RECORDS)


def write_files(records: DataFrame, folder: str) -> DataFrame:
    """Writes records as WARC files of about FILE_BYTES to folder and returns them as (file, content)."""

    def per_partition(batches):
        from pyspark import TaskContext

        part, number, size = TaskContext.get().partitionId(), 0, 0
        held: list[bytes] = []

        def file():
            return pa.RecordBatch.from_arrays([pa.array([f"{part:08d}-{number:06d}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], ["file", "content"])

        for batch in batches:
            for page_id, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                named = record.replace(_CRLF, _CRLF + f"X-Page-ID: {page_id}\r\n".encode(), 1) if page_id is not None else record
                held.append(gzip.compress(named, 1, mtime=0))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    yield file()
                    held, number, size = [], number + 1, 0
        if held:
            yield file()

    files = records.mapInArrow(per_partition, "file string, content binary")
    files.write.option("compression", "uncompressed").parquet(folder)
    return records.sparkSession.read.schema(files.schema).parquet(folder)


def read_files(files: DataFrame) -> DataFrame:
    """PARSED: every record of files(file, content), checked against its own block digest."""

    def per_batch(batches):
        for batch in batches:
            for data in batch.column(1).to_pylist():
                rows = []
                for fields, block in read_records(data):
                    at = lambda name, fields=fields: field(fields, name)
                    if at("WARC-Block-Digest") not in (None, digest(block)):
                        raise ValueError(f"the block of {at('WARC-Record-ID')} does not have its digest")
                    page_id = at("X-Page-ID")
                    rows.append((page_id and int(page_id), at("WARC-Type"), at("WARC-Record-ID"), at("WARC-Refers-To"), at("WARC-Target-URI"), at("WARC-Date"), at("Content-Type"), at("WARC-Block-Digest"), at("Source-WARC-Payload-Digest"), list(dict(fields).items()), block))
                kinds = [pa.int64(), *[pa.string()] * 8, pa.map_(pa.string(), pa.string()), pa.binary()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PARSED.split(", ")])

    return files.select("file", "content").mapInArrow(per_batch, PARSED)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """PARSED records of WARC files, plain or gzipped, each of which must fit in a task's memory."""
    return read_files(spark.read.format("binaryFile").load(path).selectExpr("path AS file", "content"))


def derivative_records(pages: DataFrame) -> DataFrame:
    """pages through response records, their derivatives and files of these in the shared folder, read back."""
    spark = pages.sparkSession
    return read_files(write_files(derived(responses(pages)), new_path(spark, "warc")))
