"""WARC archives: records of captures written, read back and assembled.

``write_warc`` turns each page into the records of one capture: the response
(or a revisit of an identical earlier payload), its request and its metadata,
the last two naming the first in ``WARC-Concurrent-To``.  Records are written
by Spark's text writer, whose line separator is the empty lines that end a
record, into gzipped files of at most ``FILE_RECORDS`` records.
``read_warc`` parses whole files record by record, by ``Content-Length``, and
checks each payload against its digest.  ``assemble`` joins the records
through the identifiers they name and emits one nested row per capture.

Of pages with equal payloads (of at least ``least_bytes`` bytes), that with
the smallest page_id is the response, the others are revisits; their blocks
keep the HTTP headers, which tell the payload's length, so that reading a
revisit needs no other record.

Defined results: a null html is an empty payload; a null page_id comes after
all others, and is written as an empty field; rows with equal page_id are
captures of their own, in the order of their digests; a null url has no
target URI; records that name no capture are left out of the nested rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from actlens.llm.common import table
from actlens.session import scratch_path

#: The pages have no time of capture.
DATE = "2020-01-01T00:00:00Z"
FILE_RECORDS = 60_000
SALTS = 16

# The end of a line and of a record, and the profile of a revisit.
_LINE = "\r\n"
_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"

_RECORD = pa.schema([
    ("type", pa.string()), ("id", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()),
    ("uri", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
    ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
_RECORD_DDL = ("type string, id string, concurrent_to string, refers_to string, uri string, date string, "
               "payload_digest string, payload_bytes long, fields map<string,string>, payload binary")
_TYPES = {"response", "revisit", "request", "metadata"}


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of a binary column in upper-case base32: eight digits for each ten of the hexadecimal form."""
    digest = F.upper(F.sha1(data))
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), _DIGITS32, _BASE32)


def _record_id(kind: str, page: str, copy: str) -> Column:
    h = F.md5(F.concat_ws(" ", F.lit(kind), F.col(page).cast("string"), F.col(copy).cast("string")).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """Header lines (null values left out), then the block; the separator after it is the writer's."""
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit(_LINE)) for name, value in headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(_END))
    return F.concat(F.lit("WARC/1.1" + _LINE), F.concat_ws("", *lines), length, block)


def captures(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages (page_id, url, html) with page (page_id, or the largest number), copy (to tell equal ids apart),
    digest, bytes and refers_to (the page and copy revisited, null for responses)."""
    base = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).select(
        "*", F.coalesce("page_id", F.lit((1 << 63) - 1)).alias("page"),
        base32_sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").cast("long").alias("bytes"))
    base = base.withColumn("copy", F.row_number().over(Window.partitionBy("page").orderBy("digest")))
    small = base.where(F.col("bytes") >= least_bytes).select("page", "copy", "digest")
    first = small.groupBy("digest").agg(F.min(F.struct("page", "copy")).alias("first"), F.count("*").alias("n")).where("n > 1")
    # a payload that a third of all pages have goes to SALTS tasks
    salted = small.withColumn("salt", F.pmod(F.xxhash64("page", "copy"), F.lit(SALTS)).cast("int"))
    spread = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    again = (salted.join(spread, ["digest", "salt"]).where(F.struct("page", "copy") != F.col("first"))
             .select(F.col("page").alias("again"), F.col("copy").alias("again_copy"), "first"))
    return base.join(again, (F.col("page") == F.col("again")) & (F.col("copy") - F.col("again_copy") == 0), "left").select(
        "page_id", "url", "html", "page", "copy", "digest", "bytes",
        F.col("first.page").alias("ref_page"), F.col("first.copy").alias("ref_copy"))


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The records of all captures, one string each (value)."""
    p = captures(pages, least_bytes)
    revisit = F.col("ref_page").isNotNull()
    own, none = _record_id("capture", "page", "copy"), F.lit(None).cast("string")
    # line breaks in a header would end it
    uri = F.regexp_replace("url", r"[\r\n]", " ")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_LINE}Content-Type: text/html; charset=utf-8{_LINE}Content-Length: "),
                    F.col("bytes").cast("string"), F.lit(_END))
    capture = _record([
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", own),
        ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        ("WARC-Profile", F.when(revisit, _PROFILE)),
        ("WARC-Refers-To", F.when(revisit, _record_id("capture", "ref_page", "ref_copy"))),
        ("Content-Type", F.lit("application/http;msgtype=response"))],
        F.when(revisit, http).otherwise(F.concat(http, "html")))
    request = _record([
        ("WARC-Type", F.lit("request")), ("WARC-Record-ID", _record_id("request", "page", "copy")),
        ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", own),
        ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{_END}")))
    shown = lambda c: F.when(F.col(c) < (1 << 63) - 1, F.col(c).cast("string")).otherwise("")
    metadata = _record([
        ("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _record_id("metadata", "page", "copy")),
        ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", own),
        ("Content-Type", F.lit("application/warc-fields"))],
        F.concat_ws("", F.concat(F.lit("page-id: "), shown("page"), F.lit(_LINE)),
                    F.when(revisit, F.concat(F.lit("refers-to-page-id: "), shown("ref_page"), F.lit(_LINE)))))
    return p.select(F.explode(F.array(capture, request, metadata)).alias("value"))


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """The pages as gzipped WARC files under ``path``."""
    (records(pages, least_bytes).write.option("lineSep", _END).option("compression", "gzip")
     .option("maxRecordsPerFile", FILE_RECORDS).text(path))


class _Stream:
    """A gzipped (one or more members) or plain byte string, read on."""

    def __init__(self, content: bytes):
        self.content, self.at, self.held = content, 0, bytearray()
        self.gzip = zlib.decompressobj(31) if content[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.gzip is None:
            piece = self.content[self.at:self.at + (1 << 20)]
            self.at += len(piece)
        else:
            while self.gzip.eof and self.at < len(self.content):
                self.gzip = zlib.decompressobj(31)
            piece = self.gzip.decompress(self.content[self.at:self.at + (1 << 18)])
            self.at = min(len(self.content), self.at + (1 << 18)) - len(self.gzip.unused_data)
        self.held += piece
        return bool(piece) or self.at < len(self.content)

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (k := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark))
            if not self._more():
                return None
        out = bytes(self.held[:k])
        del self.held[:k + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def _fields(block: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in block.decode("utf-8", "replace").split(_LINE) if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def parse(content: bytes, with_payload: bool = True) -> Iterator[dict]:
    """The records of one file."""
    stream = _Stream(content)
    while (head := stream.until(_END.encode())) is not None:
        lines = head.lstrip().split(_LINE.encode(), 1)
        if not lines[0].startswith(b"WARC/"):
            if not head.strip():
                continue
            raise ValueError(f"not a WARC record: {head[:60]!r}")
        header = _fields(lines[1] if len(lines) > 1 else b"")
        block = stream.take(int(header["content-length"]))
        kind = header.get("warc-type", "")
        digest = header.get("warc-payload-digest", "").removeprefix("sha1:") or None
        fields, payload, size = {}, None, None
        if kind in ("response", "revisit"):
            http, _, body = block.partition(_END.encode())
            fields = _fields(http)
            size = int(fields.get("content-length", len(body)))
            if kind == "response":
                payload, size = body, len(body)
                found = base64.b32encode(hashlib.sha1(body).digest()).decode()
                if digest not in (None, found):
                    raise ValueError(f"payload of {header.get('warc-record-id')} has another digest")
                digest = found
        elif kind == "metadata":
            fields = _fields(block)
        yield {"type": kind, "id": header.get("warc-record-id"), "concurrent_to": header.get("warc-concurrent-to"),
               "refers_to": header.get("warc-refers-to"), "uri": header.get("warc-target-uri"),
               "date": header.get("warc-date"), "payload_digest": digest, "payload_bytes": size,
               "fields": list(fields.items()), "payload": payload if with_payload else None}


def _parser(with_payload: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for content in batch.column(0):
                for record in parse(content.as_py(), with_payload):
                    held.append(record)
                    size += len(record["payload"] or b"") + 512
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=_RECORD)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=_RECORD)

    return run


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of the WARC files under ``path``."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_parser(with_payload), _RECORD_DDL).where(F.col("type").isin(*sorted(_TYPES)))


def assemble(found: DataFrame) -> DataFrame:
    """One row per capture: capture (struct), requests and metadata (arrays of structs), joined by identifiers."""
    body = F.struct(*[c for c in found.columns])
    is_capture = F.col("type").isin("response", "revisit")
    return (
        found.withColumn("key", F.when(is_capture, F.col("id")).otherwise(F.col("concurrent_to")))
        .where(F.col("key").isNotNull()).groupBy("key")
        .agg(F.first(F.when(is_capture, body), ignorenulls=True).alias("capture"),
             F.collect_list(F.when(F.col("type") == "request", body)).alias("requests"),
             F.collect_list(F.when(F.col("type") == "metadata", body)).alias("metadata"))
        .where(F.col("capture").isNotNull()).drop("key"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC files and assembled from them."""
    path = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    own = F.col("metadata")[0]["fields"]
    number = lambda name: F.nullif(F.try_element_at(own, F.lit(name)), F.lit("")).cast("long")
    return assemble(read_warc(spark, path, with_payload=False)).select(
        number("page-id").alias("page_id"), "capture.payload_bytes", "capture.payload_digest",
        F.col("capture.type").alias("record_type"), number("refers-to-page-id").alias("refers_to"))


ORACLE = f"""
WITH payload AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
digest AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
    substr('{_BASE32}', 1 + CAST((CAST('0x' || substr(h, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INT), 1)), '')
    AS payload_digest
  FROM payload),
first AS (SELECT payload_digest, min(page_id) AS first FROM digest GROUP BY ALL)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM digest JOIN first USING (payload_digest)
"""
