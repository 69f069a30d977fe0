"""Operator 1: derived WARC records.

From each *response* record come two records that refer to it:

* ``metadata`` (application/warc-fields): links to the source, the source's
  own WARC headers, HTTP status and header lines, and measurements of the body;
* ``conversion`` (text/plain): the body's text, of HTML in blocks, of other
  text as it is. The body is first freed of its transfer encoding (chunked) and
  content encodings (gzip, deflate) and read in its character set: by byte order
  mark, else the header's, else the one a ``meta`` element names, else UTF-8.
  A body that is not text has no conversion record; its metadata says why.

Both carry WARC-Refers-To with the response's record id, plus
WARC-Refers-To-Target-URI and WARC-Refers-To-Date, WARC-Block-Digest and
WARC-Payload-Digest (SHA-1, base 32), and the metadata the source's digests.
Ids are name-based UUIDs of (source id, type), so a run that is repeated after
a loss gives the same records. ``record_bytes`` serialises a record and
``parse_records`` reads a file of them back (exact round trip).

A map over rows: no shuffle, batches are worked through row by row; only the
record at hand is in memory twice.

Digests are those of the stored block and payload, encodings and all.

Defined results: a null body is an empty body (Content-Length 0 and the
digests of no bytes); undecodable bytes become U+FFFD; a character set that
nobody knows is passed over; a body said to be chunked that is not is taken as it
is (crawlers store it so); of a compressed body that breaks off, what came
before counts, if anything did; a body of an unknown content encoding, of a type
that is not text, or without type but with the marks of a binary file, or that
unpacks to more than MAX_BODY bytes, is not text; a null URL gives no target URI header; a null date gives none;
rows without record id get one from their URL and digest; repeated rows give
repeated records; an empty table gives an empty table; further columns do not
matter.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.llm.markup import text_blocks
from clusterlens.sources.tables import table

MAX_BODY = 1 << 28  # bytes that a compressed body may unpack to in one task

VERSION = "WARC/1.1"
FIELDS = "application/warc-fields"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc-derivative")
_RECORD = ("source_id long, record_id string, record_type string, refers_to string, target_uri string, date string, "
           "headers array<struct<name:string,value:string>>, block binary, block_digest string, payload_digest string, "
           "content_length long")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_urn(*parts: object) -> str:
    return "<urn:uuid:%s>" % uuid.uuid5(_SPACE, "\x1f".join("" if p is None else str(p) for p in parts))


def one_line(value: object) -> str:
    """A header value: line breaks would end the header."""
    return " ".join(str(value).split("\r\n")).replace("\r", " ").replace("\n", " ").strip()


def http_block(status: str, headers: list[tuple[str, str]], body: bytes) -> bytes:
    head = [status, *(f"{n}: {one_line(v)}" for n, v in headers)]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body


def split_http(block: bytes) -> tuple[list[str], bytes]:
    """Status and header lines, and the body, of an HTTP response block."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return [], block
    return head.decode("utf-8", "replace").split("\r\n"), body


class NotText(Exception):
    """Why a body has no text."""


def header_of(lines: list[str], name: str) -> str:
    """The values of a header, joined by commas; '' without."""
    pairs = (x.partition(":") for x in lines[1:])
    return ",".join(v.strip() for n, _, v in pairs if n.strip().lower() == name)


def dechunked(body: bytes) -> bytes:
    """The content of a chunked body, as far as its chunks go; a body that does
    not start with a chunk as it is."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = re.fullmatch(rb"([0-9A-Fa-f]{1,15})[ \t]*(;[^\r\n]*)?", body[at:end] if end >= 0 else b"")
        if not size:
            return b"".join(out) if out else body
        n = int(size[1], 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2:end + 2 + n])
        at = end + 2 + n + 2


def _inflated(body: bytes, window: int, limit: int) -> bytes:
    """The bytes of one or more zlib streams, as far as they go."""
    out, size, rest = [], 0, body
    while rest:
        stream, some = zlib.decompressobj(window), False
        while not stream.eof:
            try:
                part = stream.decompress(rest, 1 << 20)
            except zlib.error:
                if out or some:
                    return b"".join(out)
                raise
            rest = stream.unconsumed_tail
            if not part and not rest:
                break
            out.append(part)
            some, size = True, size + len(part)
            if size > limit:
                raise NotText(f"unpacks to more than {limit} bytes")
        if not stream.eof:
            break
        rest = stream.unused_data if window > 15 else b""  # only gzip has members
    return b"".join(out)


def unpacked(body: bytes, encodings: str, limit: int = MAX_BODY) -> bytes:
    """The body without its content encodings, the last one first."""
    for name in reversed([e.strip().lower() for e in encodings.split(",")]):
        if name in ("", "identity") or not body:
            continue
        if name not in ("gzip", "x-gzip", "deflate"):
            raise NotText(f"content encoding {name}")
        for window in (31,) if "gzip" in name else (15, -15):  # deflate: with a zlib head, or bare
            try:
                body = _inflated(body, window, limit)
                break
            except zlib.error:
                pass
        else:
            raise NotText(f"broken {name} body")
    return body


# First bytes of binary files that are served without a type.
_BINARY = (b"%PDF-", b"\x89PNG", b"GIF8", b"\xff\xd8\xff", b"PK\x03\x04", b"\x1f\x8b", b"RIFF", b"OggS", b"\x7fELF")
# Byte order marks, and codecs that are no character sets.
_MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
_NO_CHARSET = ("idna", "punycode", "undefined", "unicode-escape", "raw-unicode-escape", "utf-7")
_META = re.compile(rb"(?i)<meta[^>]{0,512}?charset\s*=\s*[\"']?\s*([a-z0-9_:.-]{1,40})")


def decoded(body: bytes, ctype: str) -> tuple[str, str]:
    """(text, character set) of an unpacked body."""
    for mark, name in _MARKS:
        if body.startswith(mark):
            return body[len(mark):].decode(name, "replace"), name
    named = re.search(r"(?i)charset\s*=\s*[\"']?\s*([^\s\"';,]+)", ctype)
    meta = _META.search(body[:4096])
    inside = meta[1].decode("ascii") if meta else ""
    if inside.lower().startswith("utf-16"):
        inside = "utf-8"  # it could not be read if it were UTF-16
    for label in (named[1] if named else "", inside):
        try:
            name = codecs.lookup(label).name
            if name in ("iso8859-1", "ascii"):
                name = "cp1252"  # what pages mean by these names
            if name not in _NO_CHARSET:
                return body.decode(name, "replace"), name
        except (LookupError, ValueError):
            continue
    return body.decode("utf-8", "replace"), "utf-8"


def plain_text(lines: list[str], body: bytes, limit: int = MAX_BODY) -> tuple[str, str]:
    """(text, character set) of a response's body; NotText where it has none."""
    if "chunked" in header_of(lines, "transfer-encoding").lower():
        body = dechunked(body)
    body = unpacked(body, header_of(lines, "content-encoding"), limit)
    ctype = header_of(lines, "content-type")
    kind = ctype.partition(";")[0].strip().lower()
    text_kind = kind.startswith("text/") or kind.endswith(("+xml", "+json", "/xml", "/json", "/javascript"))
    if kind and not text_kind:
        raise NotText(f"type {kind}")
    if not kind and (body.startswith(_BINARY) or (b"\0" in body[:1024] and not body.startswith(tuple(m for m, _ in _MARKS)))):
        raise NotText("binary body without a type")
    text, charset = decoded(body, ctype)
    if kind in ("", "text/html", "application/xhtml+xml"):
        text = "\n\n".join(b.text for b in text_blocks(text) if not any(e.tag == "head" for e in b.path))
    return text, charset


def derive(source: dict) -> list[dict]:
    """The metadata and (of text) conversion records of one response record: a dict with
    id, record_id, target_uri, date, headers [(name, value)], block."""
    block = source["block"] or b""
    lines, body = split_http(block)
    own = [(n, one_line(v)) for n, v in source["headers"] or []]
    block_digest, payload_digest = digest(block), digest(body)
    rid = source["record_id"] or record_urn(source["target_uri"], block_digest)
    text = charset = reason = None
    try:
        text, charset = plain_text(lines, body)
    except NotText as e:
        reason = str(e)
    fields = [("via", source["target_uri"]), ("refers-to", rid), ("source-block-digest", block_digest),
              ("source-payload-digest", payload_digest), ("source-block-length", len(block)),
              ("source-payload-length", len(body)), ("text-length", None if text is None else len(text)),
              ("text-charset", charset), ("no-text-reason", reason),
              *((f"source-header-{n.lower()}", v) for n, v in own),
              *((f"http-{'status' if i == 0 else 'header'}", v) for i, v in enumerate(lines))]
    meta = "".join(f"{n}: {one_line(v)}\r\n" for n, v in fields if v is not None).encode("utf-8", "surrogatepass")
    out = []
    made = [("metadata", FIELDS, meta)]
    if text is not None:
        made.append(("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "surrogatepass")))
    for kind, ctype, data in made:
        urn, dig = record_urn(rid, kind), digest(data)
        head = [("WARC-Type", kind), ("WARC-Record-ID", urn), ("WARC-Date", source["date"]),
                ("WARC-Target-URI", source["target_uri"]), ("WARC-Refers-To", rid),
                ("WARC-Refers-To-Target-URI", source["target_uri"]), ("WARC-Refers-To-Date", source["date"]),
                ("WARC-Block-Digest", dig), ("WARC-Payload-Digest", dig if kind == "conversion" else payload_digest),
                ("Content-Type", ctype), ("Content-Length", len(data))]
        out.append({"source_id": source["id"], "record_id": urn, "record_type": kind, "refers_to": rid,
                    "target_uri": source["target_uri"], "date": source["date"],
                    "headers": [{"name": n, "value": one_line(v)} for n, v in head if v is not None], "block": data,
                    "block_digest": dig, "payload_digest": dict(head)["WARC-Payload-Digest"],
                    "content_length": len(data)})
    return out


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{n}: {v}\r\n" for n, v in headers)
    return f"{VERSION}\r\n{head}\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_records(data: bytes) -> list[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of each record of a WARC file's bytes."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *rest = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = [(n, v.strip()) for n, _, v in (x.partition(":") for x in rest)]
        size = int(next(v for n, v in headers if n.lower() == "content-length"))
        out.append((headers, data[end + 4:end + 4 + size]))
        at = end + 4 + size + 4
    return out


def derivatives(responses: DataFrame) -> DataFrame:
    """Derived records of ``responses`` (id, record_id, target_uri, date,
    headers array<struct<name,value>>, block binary)."""
    rows = responses.select("id", "record_id", "target_uri", "date", "headers", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("source_id", pa.int64()), *((n, pa.string()) for n in (
            "record_id", "record_type", "refers_to", "target_uri", "date")), ("headers", pa.list_(pa.struct(
                [("name", pa.string()), ("value", pa.string())]))), ("block", pa.binary()),
            ("block_digest", pa.string()), ("payload_digest", pa.string()), ("content_length", pa.int64())])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for source in batch.slice(at, 256).to_pylist():
                    source["headers"] = [(h["name"], h["value"]) for h in source["headers"] or []]
                    out += derive(source)
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.mapInArrow(run, _RECORD)


def serialised(records: DataFrame) -> DataFrame:
    """(record_id, data): each record's bytes as they stand in a WARC file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [record_bytes([(h["name"], h["value"]) for h in heads.as_py()], block.as_py())
                    for heads, block in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["record_id", "data"])

    return records.select("record_id", "headers", "block").mapInArrow(run, "record_id string, data binary")


def page_responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of crawled ``pages`` (page_id, url, html), as a crawler
    would have stored them on ``date``."""
    body = F.coalesce(F.col("html"), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    rid = F.md5(F.concat_ws("\x1f", F.lit("page"), F.col("page_id").cast("string"), F.col("url")).cast("binary"))
    urn = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(rid, 1, 8), F.substring(rid, 9, 4), F.substring(
        rid, 13, 4), F.substring(rid, 17, 4), F.substring(rid, 21, 12)), F.lit(">"))
    return pages.select(
        F.col("page_id").alias("id"), urn.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"),
        F.array(pair("WARC-Type", F.lit("response")), pair("WARC-Record-ID", urn), pair("WARC-Date", F.lit(date)),
                pair("Content-Type", F.lit("application/http; msgtype=response"))).alias("headers"),
        F.concat(head, body).cast("binary").alias("block"))


def op1_warc_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every ``pages`` row."""
    out = derivatives(page_responses(table(spark, sf_dir, "pages")))
    return out.select(F.col("source_id").alias("page_id"), "record_id", "record_type", "refers_to", "target_uri", "date",
                      F.to_json("headers").alias("headers"), F.decode("block", "UTF-8").alias("block"), "block_digest",
                      "payload_digest", "content_length")
