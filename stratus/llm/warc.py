"""WARC writing, and a salvage reader.

Writing: one record per page; pages with equal payloads (SHA-1 and length) are stored once, the
rest become revisit records.  Records are lines of Spark's text writer with the record end as
line separator, so any store that Spark writes to will do.

Salvage reading: every check of a record (version line, header, Content-Length, record end,
payload digest) or gzip member (CRC, length) that fails starts a search for the next valid member
or version line; later records are recovered, and the bytes in between are logged as a gap.

Scale: digests are grouped with pre-aggregation; the html itself is shuffled only if the list of
revisits is too large for Spark to broadcast (Spark knows its size, it is a written table).
Archives are read file by file, so the writer keeps files near ``FILE_BYTES``.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratus.llm.common import map_rows, shared_table, ship_by_value

ship_by_value(__name__)

FILE_BYTES = 8 << 20
MIN_PAYLOAD = 0
RECORD_END = "\r\n\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: fixed values: the digits of base 32 in positional notation, and in RFC 4648
POSITIONAL, RFC4648 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
VERSION = re.compile(rb"WARC/\d\.\d\r?\n")
GZIP = b"\x1f\x8b\x08"


def sha1_base32(payload: Column) -> Column:
    """RFC 4648 base 32 of the SHA-1 (20 bytes: four runs of five bytes, eight digits each)."""
    digest = F.sha1(payload)
    runs = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*runs), POSITIONAL, RFC4648)


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """``(page_id, url, html, payload_bytes, payload_digest, refers_to)``; a null ``refers_to`` means response.

    Of pages with equal payloads of ``min_payload`` bytes or more, the largest id is the response and
    the others refer to it; rows that repeat it are responses too.  A null html is an empty payload;
    pages without an id refer to the largest id, or are all responses where none has one.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")
    )
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", sha1_base32(F.col("html")))
    key = ["payload_digest", "payload_bytes"]
    found = shared_table(rows.select("page_id", *key), "payloads")
    largest = found.where(F.col("payload_bytes") >= min_payload).groupBy(*key).agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = found.join(largest, key).where("refers_to is not null and not (page_id <=> refers_to)").select("page_id", *key, "refers_to").distinct()
    named = shared_table(revisits, "revisits").select(F.col("page_id").alias("own_id"), F.col("payload_digest").alias("own_digest"), "refers_to")
    return rows.join(named, F.col("page_id").eqNullSafe(F.col("own_id")) & (F.col("payload_digest") == F.col("own_digest")), "left").drop("own_id", "own_digest")


def write_warc(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """Write :func:`plan_records` as WARC/1.1 files below ``path``."""
    size = records.agg(F.avg("payload_bytes")).first()[0] or 0
    revisit = F.col("refers_to").isNotNull()
    uri = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")

    def urn(c: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))

    length = F.lit(len(HTTP_HEAD)) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn("page_id")),
        F.concat(F.lit("WARC-Target-URI: "), uri),  # skipped where null
        F.lit(f"WARC-Date: {date}"),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: "), urn("refers_to"))),
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    )
    block = F.concat(F.lit(HTTP_HEAD), F.when(revisit, "").otherwise(F.col("html")))
    writer = records.select(F.concat(head, F.lit("\r\n\r\n"), block).alias("value")).write
    writer.option("lineSep", RECORD_END).option("maxRecordsPerFile", max(1, int(file_bytes / (size + 600)))).text(path)


def _parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int] | str:
    """Header, block and end of the record at ``at``, or why it fails."""
    version = VERSION.match(data, at)
    if not version:
        return "no version line"
    close = re.compile(rb"\r?\n\r?\n").search(data, version.end() - 1)
    if not close:
        return "header without end"
    header: dict[str, str] = {}
    for line in re.split(rb"\r?\n(?![ \t])", data[version.end() : close.start()]):
        name, colon, value = line.partition(b":")
        if not colon:
            return "broken header line"
        header[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    if not header.get("warc-type") or not header.get("warc-record-id"):
        return "no WARC-Type or WARC-Record-ID"
    if not header.get("content-length", "").isdecimal():
        return "no Content-Length"
    end = close.end() + int(header["content-length"])
    if end > len(data):
        return "block cut off"
    tail = re.compile(rb"\r?\n\r?\n").match(data, end)
    if not tail:
        return "no record end after the block"
    block = data[close.end() : end]
    said = header.get("warc-payload-digest", "")
    if header.get("warc-type") == "response" and said.startswith("sha1:"):
        if base64.b32encode(hashlib.sha1(http_payload(block)).digest()).decode() != said[5:]:
            return "payload digest differs"
    return header, block, tail.end()


def http_payload(block: bytes) -> bytes:
    head, end, payload = block.partition(b"\r\n\r\n")
    return payload if end and head.startswith(b"HTTP/") else block


def _next_start(data: bytes, at: int) -> int:
    """The first place from ``at`` on where a version or gzip member may begin; the line end before a
    version may be what is broken."""
    line = VERSION.search(data, at)
    member = data.find(GZIP, at)
    return min([len(data), *([line.start()] if line else []), *([member] if member >= 0 else [])])


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict[str, str], bytes, str]]:
    """``(kind, start, end, header, block, reason)`` for every record and gap of one archive, in order.

    Plain records and gzip members (of one or more records) may alternate.  Offsets are bytes of the
    archive; what fails inside a member is a gap with the member's offsets.  Bytes that a gap spans
    belong to no record.
    """
    at, bad, reason = 0, None, ""
    while at < len(data):
        if data.startswith(GZIP, at):
            inflate = zlib.decompressobj(31)
            try:
                member = inflate.decompress(memoryview(data)[at:])
                found = None if inflate.eof else "gzip member cut off"
            except zlib.error as e:
                found = f"gzip member: {e}"
            if found is None:
                end = len(data) - len(inflate.unused_data)
                if bad is not None:
                    yield "gap", bad, at, {}, b"", reason
                    bad = None
                for kind, _, _, header, block, why in salvage(member):
                    yield kind, at, end, header, block, why
                at = end
                continue
        else:
            record = _parse_record(data, at)
            if not isinstance(record, str):
                if bad is not None:
                    yield "gap", bad, at, {}, b"", reason
                    bad = None
                header, block, end = record
                yield "record", at, end, header, block, ""
                at = end
                continue
            found = record
        if bad is None:
            bad, reason = at, found
        at = _next_start(data, at + 1)
    if bad is not None:
        yield "gap", bad, len(data), {}, b"", reason


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``(kind, file, start, end, record_type, record_id, target_uri, refers_to, payload, payload_bytes,
    payload_digest, reason)``: a row per record, and a row of kind ``gap`` per quarantined byte range.

    Size and digest of a response are those of the payload read; a revisit has those it states.  An
    empty file or folder gives no rows.
    """

    def read(columns):
        out: list[list] = [[] for _ in range(12)]
        for file, data in zip(*columns, strict=True):
            for kind, start, end, header, block, reason in salvage(data):
                payload, size, digest = None, None, None
                if kind == "record":
                    payload = http_payload(block)
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    size = len(payload)
                    if header.get("warc-type") == "revisit":
                        digest = header.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        size = int(header["x-payload-length"]) if header.get("x-payload-length", "").isdecimal() else None
                row = (kind, file, start, end, header.get("warc-type"), header.get("warc-record-id"), header.get("warc-target-uri"))
                row += (header.get("warc-refers-to"), payload, size, digest, reason or None)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
        return out

    schema = (
        "kind string, file string, start long, end long, record_type string, record_id string, target_uri string, "
        "refers_to string, payload binary, payload_bytes long, payload_digest string, reason string"
    )
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("length > 0").select("path", "content")
    return map_rows(files, lambda: read, schema, slice_rows=1)


def page_number(urn: Column) -> Column:
    """``<urn:page:7>`` -> 7; null for anything else."""
    return F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
