"""Web archives: the legacy ARC format, its conversion to WARC, and reading WARC back.

``write_arc`` turns pages into ARC records (version 1 or 2 header line, then an HTTP response of
the declared length).  ``read_arc`` parses archives by their version line, header lines and
declared lengths; ``convert`` synthesises the WARC record of each: a record id derived from url,
date and content, the WARC form of the date, the type, and digests.  Of equal payloads of at
least ``min_bytes`` one is a response and the others become revisits of it.  ``write_warc`` and
``read_warc`` store and read the result.

Archives are files that Spark writes through its text writer (one gzip stream per file, records
ended by the format's own separator) into the folder it is given, so any store Spark can reach
works; they are read as binary files, decompressed and cut record by record.  ``FILE_RECORDS``
bounds a file, so one task holds one file at a time.  Payloads are only cut by declared length:
they may hold separators or text that looks like a header.

Which copy stays is decided on digests alone: the smallest page id per digest is an aggregate with
map-side combine, only digests that occur more than once are joined back, and Spark splits a
digest that many records share.

Defined results: null html is an empty payload; a null url is written as ``-``; white space and
control characters of a url are percent-encoded, since header lines are split at spaces; a null
page id is carried as an empty field and never chosen while an id exists; records that repeat
both payload and page id are all responses; empty tables give empty archives.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossrank.llm.common import ship
from crossrank.staging import stage

ship(__name__)

FILE_RECORDS = 4096
CHUNK = 1 << 20
RECORD = (
    "page_id long, url string, date string, content_type string, record_id string, "
    "payload_bytes long, payload_digest string, head_bytes long, block binary"
)
READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, ok boolean"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 4122


# ---- writing -------------------------------------------------------------------------------

def _bytes(parts: list) -> Column:
    return F.concat(*[p.cast("binary") if isinstance(p, Column) else F.lit(p).cast("binary") for p in parts])


def _line_url(url: Column) -> Column:
    encoded = F.coalesce(url, F.lit("-"))
    return F.when(encoded.rlike(r"[\x00-\x20\x7F]"), F.url_encode(encoded)).when(encoded == "", "-").otherwise(encoded)


def _save(records: DataFrame, path: str, separator: str) -> None:
    (
        records.select(F.col("record").cast("string").alias("value"))
        .write.option("lineSep", separator).option("compression", "gzip")
        .option("maxRecordsPerFile", FILE_RECORDS).mode("errorifexists").text(path)
    )


def write_arc(pages: DataFrame, path: str, version: int = 1, date: str = "20240101000000") -> None:
    """Write pages (page_id, url, html) as ARC files.  The page id travels as an HTTP header."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: "),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n\r\n"),
    )
    body = _bytes([head, html])
    size = F.octet_length(body).cast("string")
    if version == 1:  # url, address, date, type, length
        line = F.concat_ws(" ", _line_url(F.col("url")), F.lit("0.0.0.0"), F.lit(date), F.lit("text/html"), size)
    else:  # url, address, date, type, status, checksum, location, offset, file name, length
        line = F.concat_ws(
            " ", _line_url(F.col("url")), F.lit("0.0.0.0"), F.lit(date), F.lit("text/html"), F.lit("200"),
            F.md5(html), F.lit("-"), F.lit("0"), F.lit("pages.arc"), size,
        )
    # Every record repeats the version in a block of its own, so any split into files is valid.
    about = f"{version} 0 crossrank\n" + (
        "URL IP-address Archive-date Content-type Archive-length\n" if version == 1 else
        "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    )
    opening = f"filedesc://pages.arc 0.0.0.0 {date} text/plain {len(about)}\n{about}\n"
    _save(pages.select(_bytes([opening, line, "\n", body]).alias("record")), path, "\n")


def write_warc(records: DataFrame, path: str) -> None:
    """Write converted records (see ``convert``) as WARC files."""
    stamp = F.concat_ws(
        "", F.substring("date", 1, 4), F.lit("-"), F.substring("date", 5, 2), F.lit("-"), F.substring("date", 7, 2),
        F.lit("T"), F.substring("date", 9, 2), F.lit(":"), F.substring("date", 11, 2), F.lit(":"),
        F.substring("date", 13, 2), F.lit("Z"),
    )
    refers = F.when(
        F.col("record_type") == "revisit",
        F.concat(
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: "),
            F.col("refers_to_record"), F.lit("\r\nX-Refers-To-Page: "),
            F.coalesce(F.col("refers_to").cast("string"), F.lit("")), F.lit("\r\n"),
        ),
    ).otherwise("")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\nWARC-Record-ID: "), F.col("record_id"),
        F.lit("\r\nWARC-Date: "), stamp, F.lit("\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nWARC-Payload-Digest: sha256:"), F.col("payload_digest"),
        F.lit("\r\nX-Payload-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n"), refers,
        F.lit("Content-Length: "), F.octet_length("block").cast("string"), F.lit("\r\n\r\n"),
    )
    _save(records.select(_bytes([head, F.col("block")]).alias("record")), path, "\r\n\r\n")


# ---- reading -------------------------------------------------------------------------------

class _Stream:
    """Bytes of one gzip (or plain) file, read forward by line and by length."""

    def __init__(self, content: bytes):
        self.content = memoryview(content)
        self.at = 0
        self.buffer = bytearray()
        self.inflate = zlib.decompressobj(31) if content[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.at >= len(self.content):
            return False
        piece = self.content[self.at : self.at + CHUNK]
        self.at += len(piece)
        if self.inflate is None:
            self.buffer += piece
            return True
        self.buffer += self.inflate.decompress(piece)
        while self.inflate.eof and self.inflate.unused_data:  # the next gzip member
            rest = self.inflate.unused_data
            self.inflate = zlib.decompressobj(31)
            self.buffer += self.inflate.decompress(rest)
        return True

    def line(self) -> bytes | None:
        start = 0
        while (end := self.buffer.find(b"\n", start)) < 0:
            start = len(self.buffer)
            if not self._more():
                return None
        found = bytes(self.buffer[:end])
        del self.buffer[: end + 1]
        return found.rstrip(b"\r")

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self._more():
            pass
        if len(self.buffer) < n:
            raise ValueError("archive ends inside a record")
        found = bytes(self.buffer[:n])
        del self.buffer[:n]
        return found


def _http(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, header bytes and payload of an HTTP response."""
    end = block.find(b"\r\n\r\n")
    head, payload = (block[: end + 4], block[end + 4 :]) if end >= 0 else (b"", block)
    lines = head.decode("latin-1").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}, head, payload


def _arc_records(content: bytes):
    """(header fields by name, block) of each record, skipping version blocks.

    The version block's first line says the version, its second names the fields of every header
    line that follows; the last field is always the length.
    """
    stream, names = _Stream(content), []
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        fields = line.decode("utf-8", "surrogateescape").split(" ")
        block = stream.take(int(fields[-1]))
        if fields[0].startswith("filedesc:"):
            about = block.decode("latin-1").split("\n")
            if about[0].split(" ")[0] not in ("1", "2"):
                raise ValueError(f"ARC version {about[0]!r}")
            names = about[1].lower().split(" ")
        else:
            if len(fields) != len(names):
                raise ValueError(f"ARC header of {len(fields)} fields, {len(names)} declared")
            yield dict(zip(names, fields)), block


def _number(text: str):
    return int(text) if text else None


def read_arc(spark: SparkSession, path: str, keep: str = "all") -> DataFrame:
    """The WARC fields of every ARC record; ``keep="digest"`` leaves the blocks out."""

    def parse(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows: list[tuple] = []
                held = 0
                for fields, block in _arc_records(content.as_py()):
                    headers, head, payload = _http(block)
                    digest = hashlib.sha256(payload).hexdigest()
                    page = headers.get("x-page-id", "")
                    name = f"{fields['url']} {fields['archive-date']} {page} {digest}"
                    rows.append((
                        _number(page), fields["url"], fields["archive-date"], fields["content-type"],
                        f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>", len(payload), digest,
                        len(head), block if keep == "all" else None,
                    ))
                    held += len(block) if keep == "all" else 200
                    if held > 8 * CHUNK:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return _files(spark, path).mapInArrow(parse, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split(" ")[0] for x in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")


def convert(spark: SparkSession, path: str, min_bytes: int = 100) -> DataFrame:
    """ARC files -> WARC records: the fields of ``read_arc``, record_type, refers_to, refers_to_record."""
    large = F.col("payload_bytes") >= min_bytes
    # Staged, so that Spark knows its size: the records are shuffled only if it is large.
    first = stage(
        read_arc(spark, path, keep="digest").where(large).groupBy(F.col("payload_digest").alias("digest"))
        .agg(
            F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id")).alias("first"),
            F.count("*").alias("n"),
        )
        .where("n > 1")
        .select("digest", F.col("first.page_id").alias("first_page"), F.col("first.record_id").alias("first_record")),
        "repeated_payloads",
    )
    rows = read_arc(spark, path).join(first, (F.col("payload_digest") == F.col("digest")) & large, "left")
    revisit = F.col("digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    return rows.select(
        "page_id", "url", "date", "content_type", "record_id", "payload_bytes", "payload_digest",
        # a revisit keeps the response's headers only
        F.when(revisit, F.substring("block", F.lit(1), F.col("head_bytes").cast("int")))
        .otherwise(F.col("block")).alias("block"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_page")).alias("refers_to"),
        F.when(revisit, F.col("first_record")).alias("refers_to_record"),
    )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per WARC record; ``ok`` says a response's payload matches its declared digest."""

    def parse(batches):
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        names = [x.split(" ")[0] for x in READ.split(", ")]
        for batch in batches:
            for content in batch.column("content"):
                stream, rows = _Stream(content.as_py()), []
                while (line := stream.line()) is not None:
                    if not line:
                        continue
                    if not line.startswith(b"WARC/"):
                        raise ValueError(f"WARC record starts with {line[:40]!r}")
                    named = {}
                    while field := stream.line():
                        key, _, value = field.decode("utf-8", "surrogateescape").partition(":")
                        named[key.strip().lower()] = value.strip()
                    headers, _, payload = _http(stream.take(int(named["content-length"])))
                    digest = named["warc-payload-digest"].removeprefix("sha256:")
                    size, kind = int(named["x-payload-length"]), named["warc-type"]
                    ok = True
                    if kind == "response":
                        size, found = len(payload), hashlib.sha256(payload).hexdigest()
                        ok, digest = found == digest, found
                    rows.append((
                        _number(headers.get("x-page-id", "")), named["warc-target-uri"], kind,
                        _number(named.get("x-refers-to-page", "")), size, digest, ok,
                    ))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return _files(spark, path).mapInArrow(parse, READ)
