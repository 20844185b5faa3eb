"""Legacy archive converter: ARC files to WARC files, and a WARC reader.

ARC version 1 records start with a line of five fields (URL, IP, date, type,
length), version 2 records with ten (URL, IP, date, type, result code,
checksum, location, offset, file name, length); a file's first record, its
``filedesc`` block, names the version. Records are cut by their declared
lengths. The converter synthesises what WARC asks for and ARC lacks: a record
identifier (a name-based UUID of file and offset, so reruns agree), an ISO
timestamp from the 14-digit date, the record type (response for HTTP blocks,
resource for others) and SHA-1 digests of block and payload. Of records with equal payloads of at least ``min_revisit_bytes``
the one with the largest id is a response and the others become revisits that
refer to it.

Archives are text-sink files (one gzip stream per task, committed by Spark), so
any Hadoop file system works and a lost executor only repeats its tasks. Files
are read whole by ``binaryFile`` and unpacked as a stream, record by record;
``write_arc`` keeps them small by Spark's input splits.

A header line without the fields, date and length its version asks for is set
aside: reading goes on at the next line that is a header, and ``arc_faults``
lists file, offset and reason of every such place, of records that end before
their declared length and of unknown versions. Blanks in a url are no fault (the
other fields are counted from the right); they are percent-encoded.

Nulls: a null payload is empty, a null url is written ``-``, a null id is kept
as null and sorts below every id. Repeated rows get a record each, all but one
of them revisits if large enough. White space and control characters in urls
are percent-encoded. An empty table gives archives without records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import shared_path
from .common import stored

MIN_REVISIT_BYTES = 1000
ARC_DATE = "20240101000000"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_V1 = b"URL IP-address Archive-date Content-type Archive-length"
_V2 = (b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename "
       b"Archive-length")


# --- writing ARC ---------------------------------------------------------------------------

def _http_block(page_id, payload: bytes) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if page_id is not None:
        head += b"X-Page-Id: %d\r\n" % page_id
    return head + b"Content-Length: %d\r\n\r\n" % len(payload) + payload


def _arc_url(url) -> bytes:
    if not url:
        return b"-"
    return _arc_blanks(url.encode("utf-8", "replace"))


def _arc_blanks(url: bytes) -> bytes:
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url)


def arc_record(version: int, url, page_id, payload: bytes, date: str = ARC_DATE) -> bytes:
    """Header line and block; the file's line separator ends the record."""
    block = _http_block(page_id, payload)
    fields = [_arc_url(url), b"0.0.0.0", date.encode(), b"text/html"]
    if version == 2:
        fields += [b"200", b"-", b"-", b"0", b"pages.arc"]
    return b" ".join([*fields, b"%d" % len(block)]) + b"\n" + block


def arc_filedesc(version: int, date: str = ARC_DATE) -> bytes:
    body = (b"%d 0 chronofeat\n" % version) + (_V2 if version == 2 else _V1) + b"\n"
    fields = [b"filedesc://pages.arc", b"0.0.0.0", date.encode(), b"text/plain"]
    if version == 2:
        fields += [b"200", b"-", b"-", b"0", b"pages.arc"]
    return b" ".join([*fields, b"%d" % len(body)]) + b"\n" + body


def _strings(values: list[bytes]) -> pa.Array:
    """Raw bytes as a string column: payloads go to the sink byte for byte."""
    made = pa.array(values, pa.binary())
    return pa.StringArray.from_buffers(len(made), made.buffers()[1], made.buffers()[2])


def write_arc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url",
              payload: str = "html") -> str:
    """One ARC file per task, versions 1 and 2 in turn by task; returns ``path``."""
    rows = pages.select(F.spark_partition_id().alias("part"), F.col(key).cast("long").alias("id"),
                        F.col(url).alias("url"),
                        F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"))

    def run(batches):
        version = None
        for b in batches:
            out = []
            if version is None and b.num_rows:
                version = 1 + b.column("part")[0].as_py() % 2
                out.append(arc_filedesc(version))
            for i, u, p in zip(b.column("id").to_pylist(), b.column("url").to_pylist(),
                               b.column("payload")):
                out.append(arc_record(version, u, i, p.as_py()))
            yield pa.RecordBatch.from_arrays([_strings(out)], names=["value"])

    (rows.mapInArrow(run, "value string").write.option("lineSep", "\n")
     .option("compression", "gzip").text(path))
    return path


# --- reading archives ----------------------------------------------------------------------

class _Stream:
    """Lines and byte counts from a (gzipped) file's content, unpacked piece by piece."""

    def __init__(self, content: bytes, piece: int = 1 << 16):
        self.content, self.at, self.piece = content, 0, piece
        self.held, self.pos, self.offset = b"", 0, 0
        self.unzip = zlib.decompressobj(31) if content[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.unzip is not None and self.unzip.eof:
            rest = self.unzip.unused_data
            if not rest and self.at >= len(self.content):
                return False
            self.unzip = zlib.decompressobj(31)
            got = self.unzip.decompress(rest) if rest else b""
        elif self.at >= len(self.content):
            return False
        else:
            raw = self.content[self.at:self.at + self.piece]
            self.at += self.piece
            got = self.unzip.decompress(raw) if self.unzip is not None else raw
        self.held, self.pos = self.held[self.pos:] + got, 0
        return True

    def line(self):
        """The next line without its end, or None after the last."""
        seen = self.pos
        while (end := self.held.find(b"\n", seen)) < 0:
            seen = len(self.held) - self.pos
            if not self._more():
                if self.pos == len(self.held):
                    return None
                end = len(self.held)
                break
        got = self.held[self.pos:end]
        self.offset += end + 1 - self.pos
        self.pos = end + 1
        return got.rstrip(b"\r")

    def take(self, n: int) -> bytes:
        parts, need = [], n
        while len(self.held) - self.pos < need:
            part = self.held[self.pos:]
            parts.append(part)
            need -= len(part)
            self.pos = len(self.held)
            if not self._more():
                raise ValueError(f"archive ends {need} bytes before a record's declared length")
        parts.append(self.held[self.pos:self.pos + need])
        self.pos += need
        self.offset += n
        return b"".join(parts)


def _document(line: bytes, version: int):
    """The fields of a document record's header line; ValueError says what is wrong with it."""
    fields = line.rsplit(b" ", 9 if version == 2 else 4)
    if len(fields) != (10 if version == 2 else 5):
        raise ValueError(f"bad ARC version {version} header: {line[:200]!r}")
    _length(fields, line)
    try:
        _iso(fields[2])
    except ValueError:
        raise ValueError(f"bad date in header: {line[:200]!r}") from None
    return [_arc_blanks(fields[0]), *fields[1:]]


def _length(fields: list[bytes], line: bytes) -> int:
    if not fields[-1].isdigit():
        raise ValueError(f"bad length in header: {line[:200]!r}")
    return int(fields[-1])


def read_arc_records(content: bytes, fault=None):
    """Yield (offset, fields, block) of every document record, by the file's own version.

    ``fault(offset, reason)`` is called for what cannot be read, once per
    stretch of lines that are no headers; without it the first one raises.
    """
    s, version, lost = _Stream(content), 1, False
    while True:
        at = s.offset
        line = s.line()
        if line is None:
            return
        if not line:
            continue
        try:
            if line.startswith(b"filedesc:"):
                block = s.take(_length(line.split(b" "), line))
                named = block.split(b" ", 1)[0]
                if named not in (b"1", b"2"):
                    raise ValueError(f"unknown ARC version {named[:20]!r}")
                version, lost = int(named), False
                continue
            fields = _document(line, version)
            found = at, fields, s.take(int(fields[-1]))
        except ValueError as e:
            if fault is None:
                raise
            if not lost:
                fault(at, str(e))
            lost = True
            continue
        lost = False
        yield found


def _split_http(block: bytes):
    head, mark, payload = block.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"HTTP/"):
        return b"", block
    return head + mark, payload


def _header(head: bytes, name: bytes):
    m = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return m[1].strip() if m else None


def _sha1(data: bytes) -> str:
    return hashlib.sha1(data).hexdigest()


def _warc_digest(hexed: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexed)).decode()


def _record_id(path: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path}#{offset}')}>"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
            .where("length > 0").select("path", "content"))


def _map_files(files: DataFrame, records, schema: str, batch_bytes: int = 8 << 20) -> DataFrame:
    """``records(path, content)`` yields (row, bytes it holds); rows leave in bounded batches."""
    arrow = to_arrow_schema(files.sparkSession.createDataFrame([], schema).schema)
    raw = [f.name for f in arrow if f.name == "record"]

    def run(batches):
        def batch(rows):
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [_strings(list(c)) if f.name in raw else pa.array(c, f.type)
                 for c, f in zip(cols, arrow)], names=arrow.names)
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                rows, held = [], 0
                for row, size in records(path, content.as_py()):
                    rows.append(row)
                    held += size
                    if held > batch_bytes or len(rows) >= 4096:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    return files.mapInArrow(run, schema)


def _set_aside(offset: int, reason: str) -> None:
    """Faults are listed by :func:`arc_faults`; the converter goes on without them."""


def arc_faults(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, reason) of everything in the ARC files that is not converted."""
    def records(file, content):
        found = []
        for _ in read_arc_records(content, lambda at, why: found.append((at, why))):
            while found:
                yield (file, *found.pop(0)), 300
        for at, why in found:
            yield (file, at, why), 300
    return _map_files(_files(spark, path), records, "file string, offset long, reason string")


def arc_index(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, page_id, payload_bytes, digest, record_id, uri, date) per ARC record."""
    def records(file, content):
        for at, f, block in read_arc_records(content, _set_aside):
            head, payload = _split_http(block)
            page = _header(head, b"X-Page-Id")
            yield (file, at, int(page) if page else None, len(payload), _sha1(payload),
                   _record_id(file, at), f[0].decode("utf-8", "replace"), _iso(f[2])), 200
    return _map_files(_files(spark, path), records,
                      "file string, offset long, page_id long, payload_bytes long, digest string, "
                      "record_id string, uri string, date string")


def _iso(date: bytes) -> str:
    """ARC's 14 digits as a WARC timestamp; shorter dates count as their first instant."""
    digits = date.decode()
    full = digits + "00000101000000"[len(digits):]
    return datetime.strptime(full, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def revisits(index: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(file, offset, refers_id, refers_uri, refers_date) of the records that become revisits.

    The group of a payload is reduced map-side to its best record; only the
    narrow index meets it again, so a payload that very many pages share is
    a skewed join of small rows, which Spark splits.
    """
    large = index.where(F.col("payload_bytes") >= min_bytes)
    best = (large.groupBy("digest", "payload_bytes")
            .agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(
                "page_id", "file", "offset", "record_id", "uri", "date")).alias("best"))
            .where("n > 1"))
    same = (F.col("best.file") == F.col("file")) & (F.col("best.offset") == F.col("offset"))
    return (large.join(best, ["digest", "payload_bytes"]).where(~same)
            .select("file", "offset", F.col("best.record_id").alias("refers_id"),
                    F.col("best.page_id").alias("refers_page"),
                    F.col("best.uri").alias("refers_uri"), F.col("best.date").alias("refers_date")))


def warc_record(kind: str, record_id: str, uri: str, date: str, head: bytes, payload: bytes,
                digest: str, content_type: str, refers=None) -> bytes:
    """One WARC/1.1 record without its closing empty lines."""
    block = head if kind == "revisit" else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}",
             f"WARC-Date: {date}", f"WARC-Target-URI: {uri}",
             f"WARC-Payload-Digest: {_warc_digest(digest)}",
             f"WARC-Block-Digest: {_warc_digest(_sha1(block))}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers[0]}",
                  f"WARC-Refers-To-Target-URI: {refers[2]}", f"WARC-Refers-To-Date: {refers[3]}"]
        lines.append(f"X-Payload-Bytes: {len(payload)}")
        if refers[1] is not None:
            lines.append(f"X-Refers-To-Page-Id: {refers[1]}")
    lines += [f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def convert(spark: SparkSession, arc_path: str, warc_path: str,
            min_bytes: int = MIN_REVISIT_BYTES) -> str:
    """Convert every record of the ARC files under ``arc_path``; returns ``warc_path``."""
    index = stored(arc_index(spark, arc_path), "arc-index")
    repeats = stored(revisits(index, min_bytes), "arc-revisits")
    by_file = stored(repeats.groupBy("file").agg(F.collect_list(F.struct(
        "offset", "refers_id", "refers_page", "refers_uri", "refers_date")).alias("again")),
        "arc-revisits-by-file")  # a file holds a bounded number of records
    files = _files(spark, arc_path).join(by_file, F.col("path") == F.col("file"), "left").select(
        "path", "content", "again")

    def run(batches):
        for b in batches:
            for path, content, again in zip(b.column("path").to_pylist(), b.column("content"),
                                            b.column("again").to_pylist()):
                refers = {r["offset"]: (r["refers_id"], r["refers_page"], r["refers_uri"],
                                        r["refers_date"]) for r in again or ()}
                out, held = [], 0
                for at, f, block in read_arc_records(content.as_py(), _set_aside):
                    head, payload = _split_http(block)
                    kind = "revisit" if at in refers else "response" if head else "resource"
                    of = "application/http;msgtype=response" if head else f[3].decode()
                    out.append(warc_record(kind, _record_id(path, at), f[0].decode("utf-8", "replace"),
                                           _iso(f[2]), head, payload, _sha1(payload), of,
                                           refers.get(at)))
                    held += len(out[-1])
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([_strings(out)], names=["value"])
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([_strings(out)], names=["value"])

    (files.mapInArrow(run, "value string").write.option("lineSep", "\r\n\r\n")
     .option("compression", "gzip").text(warc_path))
    return warc_path


def read_warc_records(content: bytes):
    """Yield (headers, block) of every WARC record, cut by Content-Length."""
    s = _Stream(content)
    while True:
        line = s.line()
        if line is None:
            return
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:200]!r}")
        headers = {}
        while line := s.line():
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        yield headers, s.take(int(headers["content-length"]))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per WARC record, digests checked against the blocks."""
    def records(file, content):
        for h, block in read_warc_records(content):
            head, payload = _split_http(block)
            if h["warc-block-digest"] != _warc_digest(_sha1(block)):
                raise ValueError(f"block digest of {h['warc-record-id']} in {file} is wrong")
            digest = base64.b32decode(h["warc-payload-digest"].partition(":")[2]).hex()
            again = h["warc-type"] == "revisit"
            if not again and digest != _sha1(payload):
                raise ValueError(f"payload digest of {h['warc-record-id']} in {file} is wrong")
            page, refers = _header(head, b"X-Page-Id"), h.get("x-refers-to-page-id")
            yield (int(page) if page else None, int(h["x-payload-bytes"]) if again else len(payload), digest,
                   h["warc-type"], int(refers) if refers else None, h["warc-record-id"],
                   h["warc-target-uri"], h["warc-date"], h.get("warc-refers-to")), 300
    return _map_files(_files(spark, path), records,
                      "page_id long, payload_bytes long, payload_digest string, record_type string, "
                      "refers_to long, record_id string, uri string, date string, "
                      "refers_to_record string")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Pages to ARC files, those to WARC files, and the WARC records read back."""
    spark = pages.sparkSession
    arc = write_arc(pages, shared_path(spark, "arc"))
    return read_warc(spark, convert(spark, arc, shared_path(spark, "warc")))
