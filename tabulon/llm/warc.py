"""WARC derivatives: metadata and plain-text conversion records from responses.

A response record gives two records that refer to it by id: `metadata` (application/warc-fields: HTTP
status and source headers, title, charset, links, the source's digests) and `conversion` (text/plain: the
page's visible text). Both keep the target URI and date of the response, carry digests of their own
block, and are linked to each other (WARC-Concurrent-To). Ids are name-based, so a task that runs again
makes the same records. Reader and writer of WARC/1.1 streams (plain, or one gzip member a record) are
here too; a record never leaves its task and a stream is read record by record.

Defined results: a null URL is the target URI `urn:unknown`, a null or empty page is a response of empty
body (its conversion has length 0); broken HTTP heads count as body; unknown charsets are read as UTF-8
with replacement. Missing end tags of hidden elements: see `_hidden`. Responses of other types than text get a metadata record only. Repeated rows give
repeated records of equal ids; an empty table gives an empty result. Other columns aren't read.
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
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

VERSION = "WARC/1.1"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "tabulon:warc")
#: Elements whose content isn't text, and elements that end a line. Fixed values.
_HIDDEN = "script|style|noscript|template|svg"
_BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"

_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.I | re.S)
_CHARSET = re.compile(rb"""<meta[^>]{0,200}charset\s*=\s*["']?\s*([A-Za-z0-9_:.-]+)""", re.I)
_LANG = re.compile(r"""<html\b[^>]*\blang\s*=\s*["']?([A-Za-z0-9-]+)""", re.I)
_LINK = re.compile(r"""<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_MARK = re.compile(rf"<!--|<(/?)({_HIDDEN}|title|head|body)(?=[\s/>])[^>]*>", re.I)
_ENDS = {"script": re.compile(r"</script\s*>|\Z", re.I), "style": re.compile(r"</style\s*>|\Z", re.I), "title": re.compile(r"</title\s*>|(?=</head\s*>|<body[\s/>])|\Z", re.I)}
_TAG = re.compile(rf"<(/?)({_BLOCKS})\b[^>]*>|</?[A-Za-z!?][^>]*>", re.I)
_BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")
_LINES = re.compile(r" ?\n[ \n]*")


@dataclass
class Record:
    headers: list[tuple[str, str]] = field(default_factory=list)
    block: bytes = b""

    def get(self, name: str, default: str = "") -> str:
        return next((v for k, v in self.headers if k.lower() == name.lower()), default)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(parts))}>"


def to_bytes(r: Record, compress: bool = False) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in r.headers if k.lower() != "content-length")
    raw = f"{VERSION}\r\n{head}Content-Length: {len(r.block)}\r\n\r\n".encode() + r.block + b"\r\n\r\n"
    return gzip.compress(raw, 6, mtime=0) if compress else raw


_READ = 1 << 16


def members(data: bytes) -> Iterator[bytes]:
    """The stream itself, or its gzip members one after another."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at = 0
    while at < len(data):
        d, out = zlib.decompressobj(31), []
        while not d.eof and at < len(data):
            out.append(d.decompress(data[at : at + _READ]))
            at += _READ
        if not d.eof:
            raise ValueError("gzip member cut off")
        at = min(at, len(data)) - len(d.unused_data)
        yield b"".join(out)


def read_records(data: bytes) -> Iterator[Record]:
    """Records of a WARC stream; raises ValueError at bytes that are no record."""
    for part in members(data):
        at = 0
        while at < len(part):
            if not part.startswith(b"WARC/", at):
                if not part[at:].strip():
                    break
                raise ValueError(f"no record at {at}")
            end = part.find(b"\r\n\r\n", at)
            if end < 0:
                raise ValueError(f"record head cut off at {at}")
            headers: list[tuple[str, str]] = []
            for line in part[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
                if line[:1] in " \t" and headers:  # folded
                    headers[-1] = (headers[-1][0], headers[-1][1] + " " + line.strip())
                elif ":" in line:
                    k, _, v = line.partition(":")
                    headers.append((k.strip(), v.strip()))
            r = Record(headers)
            n = r.get("Content-Length", "0")
            if not (n.isascii() and n.isdigit()):
                raise ValueError(f"Content-Length is no number at {at}")
            n = int(n)
            r.block = part[end + 4 : end + 4 + n]
            if len(r.block) < n:
                raise ValueError(f"record cut off at {at}")
            at = end + 4 + n
            while part[at : at + 2] == b"\r\n":
                at += 2
            yield r


def response(uri: str | None, body: bytes, date: str, content_type: str = "text/html; charset=utf-8") -> Record:
    """A response record around a page."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    uri = uri or "urn:unknown"
    whole = digest(block)
    return Record([("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", uri, date, whole)), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", whole), ("Content-Type", "application/http; msgtype=response")], block)


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and body of an HTTP response."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return "", [], block
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines if ":" in x)], body


def unwrapped(headers: list[tuple[str, str]], body: bytes) -> bytes:
    """The body without chunks and content coding (gzip, deflate); as it stands where that fails or the coding is another."""
    by = {k.lower(): v.lower() for k, v in headers}
    try:
        if "chunked" in by.get("transfer-encoding", ""):
            out, at = [], 0
            while size := int(body[at : (end := body.index(b"\r\n", at))].split(b";")[0], 16):
                out.append(body[end + 2 : end + 2 + size])
                at = end + 4 + size
            body = b"".join(out)
        for coding in by.get("content-encoding", "").split(",")[::-1]:
            if coding.strip() in ("gzip", "x-gzip"):
                body = b"".join(members(body))
            elif coding.strip() == "deflate":
                body = zlib.decompress(body, 15 if body[:1] == b"\x78" else -15)
    except (ValueError, zlib.error):
        pass
    return body


def decoded(body: bytes, content_type: str) -> tuple[str, str]:
    m = re.search(r"charset\s*=\s*[\"']?([\w:.-]+)", content_type, re.I)
    name = m[1] if m else (lambda x: x[1].decode() if x else "utf-8")(_CHARSET.search(body[:4096]))
    try:
        return body.decode(name, "replace"), name.lower()
    except LookupError:
        return body.decode("utf-8", "replace"), "utf-8"


def _hidden(page: str) -> list[tuple[int, int]]:
    """Spans of comments, hidden elements and the head's title, in order; spans inside others come too.

    A comment, script or style that isn't closed runs to the end. Others that aren't hide nothing, and
    `<x .../>` is empty. A head needs no end tag: what shows in it (stray text, body elements) is text.
    """
    out, at, head = [], 0, False
    opened: list[tuple[str, int]] = []
    depth = dict.fromkeys(_HIDDEN.split("|"), 0)
    while m := _MARK.search(page, at):
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
            out.append((m.start(), at))
        elif name in ("head", "body"):
            head = name == "head" and not m[1] and not m[0].endswith("/>")
        elif m[1]:
            if depth.get(name):
                inner = ""
                while inner != name:
                    inner, start = opened.pop()
                    depth[inner] -= 1
                out.append((start, at))
        elif m[0].endswith("/>"):
            continue
        elif name in ("script", "style") or name == "title" and head:
            end = _ENDS[name].search(page, at)
            if name != "title" or end.start() < len(page):
                at = end.end()
                out.append((m.start(), at))
            else:
                head = False
        elif name != "title":
            opened.append((name, m.start()))
            depth[name] += 1
    return sorted(out)


def visible_text(page: str) -> str:
    """Text outside hidden elements and comments, a line for each block, entities resolved."""
    parts, at = [], 0
    for start, end in _hidden(page):
        if end > at:
            parts.append(page[at : max(at, start)])
            at = end
    parts.append(page[at:])
    text = _TAG.sub(lambda m: "\n" if m[2] else "", " ".join(parts).replace("\n", " "))
    return _LINES.sub("\n", _BLANKS.sub(" ", html.unescape(text))).strip()


def derive(source: Record) -> list[Record]:
    """Metadata and, for texts, conversion of a response (or resource) record."""
    status, headers, body = split_http(source.block) if source.get("WARC-Type") == "response" else ("", [], source.block)
    kind = next((v for k, v in headers if k.lower() == "content-type"), source.get("Content-Type") if not headers else "")
    uri, date, refers = source.get("WARC-Target-URI", "urn:unknown"), source.get("WARC-Date"), source.get("WARC-Record-ID")
    textual = kind.lower().startswith("text/") or "html" in kind.lower() or "xml" in kind.lower()
    page, charset = decoded(unwrapped(headers, body), kind) if textual else ("", "")
    markup = "html" in kind.lower() or page.lstrip()[:1] == "<"
    title = _TITLE.search(page) if markup else None
    lang = _LANG.search(page) if markup else None
    links = [html.unescape(a or b or c) for a, b, c in _LINK.findall(page)] if markup else []
    fields = [("source-status", status), *((f"source-header-{k.lower()}", v) for k, v in headers), ("source-payload-digest", source.get("WARC-Payload-Digest") or digest(body)), ("source-block-digest", source.get("WARC-Block-Digest") or digest(source.block)), ("charset", charset)]
    fields += [("title", " ".join(html.unescape(title[1]).split()))] if title else []
    fields += [("language", lang[1])] if lang else []
    fields += [("link-count", str(len(links))), *(("outlink", " ".join(x.split())) for x in links)]
    out = []

    def add(type_: str, content_type: str, block: bytes) -> None:
        own = digest(block)
        out.append(Record([("WARC-Type", type_), ("WARC-Record-ID", record_id(type_, refers, own)), ("WARC-Refers-To", refers), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Block-Digest", own), ("Content-Type", content_type)], block))

    add("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields if v).encode("utf-8", "replace"))
    if textual:
        add("conversion", "text/plain; charset=utf-8", (visible_text(page) if markup else page).encode("utf-8", "replace"))
        a, b = out
        a.headers.append(("WARC-Concurrent-To", b.get("WARC-Record-ID")))
        b.headers.append(("WARC-Concurrent-To", a.get("WARC-Record-ID")))
    return out


_COLUMNS = "record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, source_payload_digest string, block binary, record binary"


def _rows(source: Record, compress: bool) -> list[tuple]:
    payload = source.get("WARC-Payload-Digest") or digest(split_http(source.block)[2])
    return [(r.get("WARC-Type"), r.get("WARC-Record-ID"), r.get("WARC-Refers-To"), r.get("WARC-Concurrent-To") or None, r.get("WARC-Target-URI"), r.get("WARC-Date"), r.get("Content-Type"), len(r.block), r.get("WARC-Block-Digest"), payload, r.block, to_bytes(r, compress)) for r in derive(source)]


_KINDS = (*(pa.string(),) * 7, pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary())


def _batch(ids: pa.Array, at: list[int], rows: list[tuple], name: str, keep: int) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 12
    names = [c.split()[0] for c in _COLUMNS.split(", ")][:keep]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int32())), *(pa.array(c, k) for c, k in zip(cols[:keep], _KINDS, strict=False))], names=[name, *names])


def _derive_pages(batches: Iterator[pa.RecordBatch], name: str, date: str, keep: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "html", 8 << 20):
            at, rows = [], []
            for i, (url, page) in enumerate(zip(batch.column("url"), batch.column("html"), strict=True)):
                stored = to_bytes(response(url.as_py(), (page.as_py() or "").encode(), date))
                own = [row for r in read_records(stored) for row in _rows(r, False)]
                at += [i] * len(own)
                rows += own
            yield _batch(batch.column(0), at, rows, name, keep)


def derivatives_of_pages(pages: DataFrame, id_column: str = "page_id", date: str = "2024-01-01T00:00:00Z", blocks: bool = True) -> DataFrame:
    """Pages as response records, and the records derived from them; one row a record."""
    kind = pages.schema[id_column].dataType.simpleString()
    columns = _COLUMNS if blocks else ", ".join(_COLUMNS.split(", ")[:10])
    keep = 12 if blocks else 10
    return pages.select(id_column, "url", "html").mapInArrow(lambda it: _derive_pages(it, id_column, date, keep), f"{id_column} {kind}, {columns}")


def _derive_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, content in enumerate(batch.column("content")):
            rows: list[tuple] = []
            try:
                for r in read_records(content.as_py() or b""):
                    if r.get("WARC-Type") in ("response", "resource"):
                        rows += _rows(r, True)
                    if len(rows) >= 500:
                        yield _batch(batch.column(0), [i] * len(rows), rows, "path", 12)
                        rows = []
            except (ValueError, zlib.error) as e:
                rows.append(("error", *(None,) * 5, "text/plain", None, None, None, str(e).encode(), None))
            yield _batch(batch.column(0), [i] * len(rows), rows, "path", 12)


def derivatives_of_files(files: DataFrame) -> DataFrame:
    """The same from WARC files read with `spark.read.format("binaryFile")` (columns path, content).

    Where a file's bytes stop being records, a row of record_type `error` says why (in `block`); what was
    read before is kept, what follows in this file isn't read, and other files aren't touched.
    """
    return files.select("path", "content").mapInArrow(_derive_files, f"path string, {_COLUMNS}")
