"""Legacy web archives: ARC files to WARC files, and both read back.

An ARC file opens with a version block whose last line names the fields of the header lines that follow; versions 1
and 2 have different ones. The converter goes by these names and by the declared lengths, and makes for every record
what a WARC record needs: an identifier, an ISO time, a type, the server's address and SHA-1 digests. A payload that an earlier record
(one with a smaller id) holds already becomes a revisit record that refers to it.

Archives are read twice, once for what identifies each record and once to convert it; between them only these few
columns meet, and each file gets its own records' part of them back. Payloads are never shuffled by record.

Files are written by Spark's text sink, whose line separator is what ends a record in the format (a line feed in ARC,
two CRLF in WARC), and read as binary files. Each has at most ``RECORDS`` records, so a task reads files of bounded
number; archives lie in the shared folder.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, settle, text_of

#: Records in a file, besides the one that opens it.
RECORDS = 500
# Fixed values of the formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_END = "\r\n\r\n"


def _opened(opening: Callable[[], bytes], records: int):
    """Puts an opening record before every so many rows, where the sink begins a file."""
    schema = pa.schema([("value", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            column = batch.column(0)
            at = 0
            while at < len(column):
                if n % records == 0:
                    yield pa.RecordBatch.from_arrays([pa.array([opening()], pa.binary())], schema=schema)
                take = min(records - n % records, len(column) - at)
                yield pa.RecordBatch.from_arrays([column.slice(at, take)], schema=schema)
                n, at = n + take, at + take

    return run


def _write(records: DataFrame, opening: Callable[[], bytes], separator: str, kind: str) -> str:
    """Writes rows of one binary column, compressed as a whole, to a new folder."""
    path = scratch(records.sparkSession, kind)
    rows = records.mapInArrow(_opened(opening, RECORDS), "value binary").select(F.col("value").cast("string"))
    rows.write.option("lineSep", separator).option("compression", "gzip").option("maxRecordsPerFile", RECORDS + 1).text(path)
    return path


def _arc_opening(version: int) -> Callable[[], bytes]:
    def make() -> bytes:
        block = f"{version} 0 roadweave\n{ARC_FIELDS[version]}\n"
        if version == 1:
            head = f"filedesc://roadweave.arc 0.0.0.0 20240101000000 text/plain {len(block)}"
        else:
            head = f"filedesc://roadweave.arc 0.0.0.0 20240101000000 text/plain 200 - - 0 roadweave.arc {len(block)}"
        return f"{head}\n{block}".encode()

    return make


def write_arc(pages: DataFrame, version: int, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    """Pages as HTTP messages in ARC files of the given version; gives the folder.

    A null html is an empty payload. White space in an address is percent-encoded, as header lines are split by it;
    a null or empty address is about:blank. The id goes into the message's head (empty if null).
    """
    html = text_of(html_col)
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: "), F.coalesce(F.col(id_col).cast("string"), F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"),
    )
    address = F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\s\x00-\x1F]", "%20")
    address = F.when(address == "", F.lit("about:blank")).otherwise(address)
    date = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)), F.lit(86400 * 365))), "yyyyMMddHHmmss")
    message = F.concat(head, html)
    extra = F.lit("") if version == 1 else F.lit("200 - - 0 roadweave.arc ")
    line = F.concat(address, F.lit(" 0.0.0.0 "), date, F.lit(" text/html "), extra, F.octet_length(message).cast("string"), F.lit("\n"))
    records = pages.select(F.concat(line, message).cast("binary").alias("value"))
    return _write(records, _arc_opening(version), "\n", f"arc{version}")


def arc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and body of each record of an ARC file but the version block, which is the first and no other,
    whatever the addresses of later records look like."""
    at, fields = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "surrogateescape").rstrip("\r").split(" ")
        length = int(line[-1])
        body = data[end + 1 : end + 1 + length]
        at = end + 1 + length
        if fields is None and line[0].startswith("filedesc:"):
            fields = body.decode("latin-1").strip().splitlines()[-1].split(" ")
        elif fields is None or len(line) != len(fields) or len(body) != length:
            raise ValueError(f"not an ARC record: {line[:5]}")
        else:
            yield dict(zip(fields, line, strict=True)), body


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _http(body: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """Head with its empty line, payload, and the head's fields of an HTTP message."""
    head, mark, payload = body.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("latin-1").split("\r\n")[1:] if ": " in x)
    return head + mark, payload, fields


def _inflate(data: bytes) -> bytes:
    return zlib.decompress(data, 47) if data[:2] == b"\x1f\x8b" else data


_CONVERTED = [
    ("path", pa.string()), ("place", pa.int64()), ("id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("record_id", pa.string()), ("digest", pa.string()), ("length", pa.int64()), ("ip", pa.string()), ("head", pa.binary()), ("payload", pa.binary()),
]
_CONVERTED_DDL = "path string, place bigint, id bigint, url string, date string, record_id string, digest string, length bigint, ip string, head binary, payload binary"
#: Of these, what identifies a record.
_KNOWN = ["path", "place", "id", "url", "date", "record_id", "digest", "length"]


def _rows(found: list[tuple], fields: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*found, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def _iso(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def _from_arc(whole: bool):
    """Records of files (path, content); head and payload are left out unless whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                found = []
                for place, (fields, body) in enumerate(arc_records(_inflate(content.as_py()))):
                    head, payload, http = _http(body)
                    number, digest = http.get("X-Page-Id", ""), sha1_base32(payload)
                    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{fields['URL']} {fields['Archive-date']} {number} {digest}")
                    known = (path.as_py(), place, int(number) if number else None, fields["URL"], _iso(fields["Archive-date"]), f"<urn:uuid:{name}>", digest, len(payload))
                    found.append((*known, fields["IP-address"], head, payload) if whole else known)
                if found:
                    yield _rows(found, _CONVERTED if whole else _CONVERTED[: len(_KNOWN)])

    return run


def _files(spark, *paths: str) -> DataFrame:
    return spark.read.format("binaryFile").load(list(paths)).select("path", "content")


def read_arc(spark, *paths: str) -> DataFrame:
    """Records of ARC files with what WARC needs of each: file and place in it, record_id, ISO date, address, SHA-1 digest of the payload."""
    return _files(spark, *paths).mapInArrow(_from_arc(True), _CONVERTED_DDL)


def _warc_opening() -> bytes:
    body = b"software: roadweave\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'roadweave')}>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body


def _warc_record(url: str, date: str, record_id: str, digest: str, ip: str, head: bytes, payload: bytes, first: tuple[str, str, str] | None) -> bytes:
    """A response record, or a revisit of first (record id, address, date) without the payload."""
    block = head if first else head + payload
    about = (f"WARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: {first[0]}\r\nWARC-Refers-To-Target-URI: {first[1]}\r\nWARC-Refers-To-Date: {first[2]}\r\n") if first else ""
    lines = (
        f"WARC/1.1\r\nWARC-Type: {'revisit' if first else 'response'}\r\nWARC-Record-ID: {record_id}\r\nWARC-Date: {date}\r\nWARC-Target-URI: {url}\r\nWARC-IP-Address: {ip}\r\n"
        f"WARC-Payload-Digest: sha1:{digest}\r\nWARC-Block-Digest: sha1:{sha1_base32(block)}\r\n{about}Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    )
    return lines.encode("utf-8", "surrogateescape") + block


_MADE = pa.schema([("value", pa.binary())])


def _to_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """WARC records of rows (url, date, record_id, digest, ip, head, payload, first_id, first_url, first_date)."""
    for batch in batches:
        made = []
        for *record, first_id, first_url, first_date in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            made.append(_warc_record(*record, (first_id, first_url, first_date) if first_id else None))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], schema=_MADE)


def _files_to_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """WARC records of ARC files (content, told), told having (place, record_id, digest, first_id, first_url, first_date) of each record."""
    for batch in batches:
        for content, told in zip(batch.column(0), batch.column(1), strict=True):
            about = {t["place"]: t for t in told.as_py() or []}
            made, size = [], 0
            for place, (fields, body) in enumerate(arc_records(_inflate(content.as_py()))):
                t = about[place]
                head, payload, _ = _http(body)
                first = (t["first_id"], t["first_url"], t["first_date"]) if t["first_id"] else None
                made.append(_warc_record(fields["URL"], _iso(fields["Archive-date"]), t["record_id"], t["digest"], fields["IP-address"], head, payload, first))
                size += len(made[-1])
                if size > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], schema=_MADE)
                    made, size = [], 0
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], schema=_MADE)


def _revisits(narrow: DataFrame, least_bytes: int) -> DataFrame:
    """Rows (record_id, first_id, first_url, first_date) of the records whose payload one with a smaller id has (null after all; ties by record_id)."""
    rank = F.struct(F.col("id").isNull(), "id", "record_id")
    first = narrow.where(F.col("length") >= least_bytes).groupBy("digest", "length").agg(F.min(rank).alias("r"))
    first = first.select("digest", "length", F.col("r.record_id").alias("first_id"))
    known = narrow.select("record_id", "digest", "length").join(first, ["digest", "length"], "left")
    told = narrow.select(F.col("record_id").alias("first_id"), F.col("url").alias("first_url"), F.col("date").alias("first_date")).dropDuplicates(["first_id"])
    return known.where("first_id <> record_id").select("record_id", "first_id").distinct().join(told, "first_id")


def write_warc(records: DataFrame, least_bytes: int = 0) -> str:
    """Records of read_arc as WARC files; gives the folder.

    Of records with equal payloads of least_bytes or more, the one with the smallest id (null after all; ties by
    record_id) is a response, and the others are revisits of it without its payload.
    """
    narrow = settle(records.select("id", "url", "date", "record_id", "digest", "length"), "records")
    rows = records.join(_revisits(narrow, least_bytes), "record_id", "left")
    rows = rows.select("url", "date", "record_id", "digest", "ip", "head", "payload", "first_id", "first_url", "first_date")
    return _write(rows.mapInArrow(_to_warc, "value binary"), _warc_opening, WARC_END, "warc")


def convert_arc(spark, *paths: str, least_bytes: int = 0) -> str:
    """ARC files as WARC files, as write_warc makes them of their records; gives the folder. Records go file by file."""
    files = _files(spark, *paths)
    narrow = settle(files.mapInArrow(_from_arc(False), ", ".join(_CONVERTED_DDL.split(", ")[: len(_KNOWN)])), "records")
    told = narrow.select("path", "place", "record_id", "digest").join(_revisits(narrow, least_bytes), "record_id", "left")
    by_file = told.groupBy("path").agg(F.collect_list(F.struct("place", "record_id", "digest", "first_id", "first_url", "first_date")).alias("told"))
    named = files.join(settle(by_file, "told"), "path").select("content", "told")
    return _write(named.mapInArrow(_files_to_warc, "value binary"), _warc_opening, WARC_END, "warc")


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n")
        if not re.fullmatch(r"WARC/1\.\d", lines[0]):
            raise ValueError(f"not a WARC record: {lines[0][:40]}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        start = end + 4
        stop = start + int(fields["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError("a WARC record doesn't end where it says")
        yield fields, data[start:stop]
        at = stop + 4


_READ = [
    ("page_id", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("date", pa.string()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to_record", pa.string()), ("payload", pa.binary()),
]
_READ_DDL = "page_id bigint, record_id string, url string, date string, payload_bytes bigint, payload_digest string, record_type string, refers_to_record string, payload binary"


def _from_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            found = []
            for fields, block in warc_records(_inflate(content.as_py())):
                kind = fields["WARC-Type"]
                if kind == "warcinfo":
                    continue
                _, payload, http = _http(block)
                if sha1_base32(block) != fields["WARC-Block-Digest"].removeprefix("sha1:"):
                    raise ValueError(f"block of {fields['WARC-Record-ID']} doesn't match its digest")
                length, digest = int(http["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and (len(payload) != length or sha1_base32(payload) != digest):
                    raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
                number = http.get("X-Page-Id", "")
                found.append((int(number) if number else None, fields["WARC-Record-ID"], fields["WARC-Target-URI"], fields["WARC-Date"], length, digest, kind, fields.get("WARC-Refers-To"), payload if kind == "response" else None))
            if found:
                yield _rows(found, _READ)


def read_warc(spark, path: str) -> DataFrame:
    """Records of WARC files but warcinfo; a response's digest is held against its payload. Revisits have no payload."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_from_warc, _READ_DDL)


def convert_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages through ARC (even ids as version 1, odd and null ones as version 2) to WARC and back.

    Rows (page_id, payload_bytes, payload_digest, record_type, refers_to): refers_to is the response's page_id, null
    for responses. Rows equal in id, address and html have the same record id and are treated alike; others with an
    equal payload are revisits. Other columns are ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    odd = F.coalesce(F.pmod(F.col(id_col).cast("bigint"), F.lit(2)) == 1, F.lit(True))
    folders = [write_arc(pages.where(~odd), 1, id_col, url_col, html_col), write_arc(pages.where(odd), 2, id_col, url_col, html_col)]
    warc = read_warc(spark, convert_arc(spark, *folders)).drop("payload")
    names = warc.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to")).dropDuplicates(["refers_to_record"])
    found = warc.join(names, "refers_to_record", "left")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
