"""WARC archives (operator 13): a record writer and a salvage reader.

**Writing.** Each page is a record: of equal payloads of ``min_bytes`` or more, the row with the
smallest page id is a ``response`` and the others are ``revisit`` records that name it; smaller
payloads are all responses. Only payloads that repeat are shuffled: their digests are a bit
filter of bounded size, and all other rows go straight to their archive. A task writes its rows
to archives of its own (about ``archive_bytes`` each, a gzip member per record) under the shared
folder and returns their names; archives of lost or repeated attempts are in no index. The
index ``path, start, end`` cuts archives at record starts, so that each can be read by many tasks.

**Reading.** A range of an archive is read from a record start. Every record passes these
checks: the member inflates and its CRC and length hold, a version line and complete headers
are there, ``Content-Length`` bytes and the closing line ends follow, block and payload digest
match. After a failed check the reader searches for the next place from which a whole valid
member (or, in a plain archive, a record with its version line) can be read, goes on there, and
logs the bytes between as a quarantined gap with the reason. Archives are read in pieces of
``PIECE`` bytes; a task holds one record (of a plain or per-record gzip archive) at a time.

Defined results: a NULL ``html`` is an empty payload; a NULL ``page_id`` ranks last, and its
revisits have a NULL ``refers_to`` if no other row has an id; rows with the same id and payload are one
response and revisits of it; an empty table writes no archive. Other columns are ignored; a NULL
``url`` is written as ``about:blank``, control characters in it are percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import bit_filter, in_filter, written

MIN_BYTES = 100               # smaller payloads are never revisits
ARCHIVE_BYTES = 256 << 20     # an archive is closed once it is this long
RANGE_BYTES = 16 << 20        # an index entry covers about this much
PIECE = 1 << 20
LEVEL = 4                     # of gzip
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION = re.compile(rb"WARC/[01]\.[0-9]{1,2}\r\n")
_MAGIC = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]")
_VERSION_BYTES = 12           # of the longest version line
RECORD_SCHEMA = ("path string, offset bigint, length bigint, error string, warc_type string, record_id string, target_uri string, page_id bigint, "
                 "refers_to bigint, payload_bytes bigint, payload_digest string, payload binary")


def file_system(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or path, as a task sees it."""
    return pafs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")


# --- one record --------------------------------------------------------------------

def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """A ``response`` with the payload, or a ``revisit`` without it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date),
              ("WARC-Target-URI", uri), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"),
              ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Page-Payload-Bytes", str(size))]
    fields += [("Page-ID", str(page_id))] if page_id is not None else []
    if revisit:
        fields += [("WARC-Profile", PROFILE)] + ([("Page-Refers-To", str(refers_to))] if refers_to is not None else [])
    return record(fields, block)


class Fault(Exception):
    """A check that failed; the message is the reason in the log."""


def digest_holds(stated: str, data: bytes) -> bool:
    """Whether ``algorithm:value`` (hex or base32) is the digest of ``data``; unknown algorithms are not checked."""
    name, _, value = stated.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha512"):
        return True
    raw = hashlib.new(name, data).digest()
    return value.strip().lower() in (raw.hex(), base64.b32encode(raw).decode().lower(), base64.b32encode(raw).decode().rstrip("=").lower())


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers (names in lower case), block and end of the record at ``at``."""
    if not (v := _VERSION.match(data, at)):
        raise Fault("version")
    if (stop := data.find(b"\r\n\r\n", v.end() - 2)) < 0:
        raise Fault("headers")
    fields: dict[str, str] = {}
    name = None
    for line in data[v.end():stop].decode("utf-8", "replace").split("\r\n"):
        if line[:1] in " \t" and name:
            fields[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise Fault("headers")
        name = name.strip().lower()
        fields[name] = value.strip()
    size = fields.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", size):
        raise Fault("length")
    start = stop + 4
    end = start + int(size)
    if end + 4 > len(data):
        raise Fault("length")
    if data[end:end + 4] != b"\r\n\r\n":
        raise Fault("trailer")
    return fields, data[start:end], end + 4


def checked(fields: dict[str, str], block: bytes) -> bytes:
    """The payload, once the digests hold."""
    if "warc-block-digest" in fields and not digest_holds(fields["warc-block-digest"], block):
        raise Fault("block digest")
    http = fields.get("content-type", "").replace(" ", "").startswith("application/http")
    payload = block[stop + 4:] if http and (stop := block.find(b"\r\n\r\n")) >= 0 else block
    if fields.get("warc-type") == "response" and "warc-payload-digest" in fields and not digest_holds(fields["warc-payload-digest"], payload):
        raise Fault("payload digest")
    return payload


# --- reading a range with salvage ----------------------------------------------------

class Bytes:
    """Random access to an open file, a window of whole pieces at a time."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def get(self, start: int, n: int) -> bytes:
        n = max(0, min(n, self.size - start))
        if start < self.at or start + n > self.at + len(self.held):
            self.file.seek(start)
            self.at, self.held = start, self.file.read(min(max(n, PIECE), self.size - start))
        return self.held[start - self.at:start - self.at + n]


def inflate(src: Bytes, at: int) -> tuple[bytes, int]:
    """Contents and end of the gzip member at ``at``."""
    z, out, pos = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            piece = src.get(pos, 1 << 16)
            if not piece:
                raise Fault("truncated member")
            out.append(z.decompress(piece))
            pos += len(piece)
    except zlib.error as e:
        raise Fault("member: " + re.sub(r"^Error -?\d+ while decompressing data: ", "", str(e))) from None
    return b"".join(out), pos - len(z.unused_data)


def plain(src: Bytes, at: int) -> tuple[bytes, int]:
    """The bytes of the uncompressed record at ``at`` and its end, by its stated length."""
    n = 1 << 13
    while True:
        data = src.get(at, n)
        if not _VERSION.match(data):
            raise Fault("version")
        if (stop := data.find(b"\r\n\r\n")) >= 0 or len(data) < n:
            break
        n *= 4
    m = re.search(rb"\r\ncontent-length:[ \t]*([0-9]{1,18})[ \t]*\r\n", data[:stop + 2], re.I) if stop >= 0 else None
    if m is None:
        raise Fault("headers" if stop < 0 else "length")
    end = stop + 4 + int(m[1]) + 4
    if at + end > src.size:
        raise Fault("length")
    return src.get(at, end), at + end


def records_at(src: Bytes, at: int) -> tuple[list[tuple[dict, bytes]], int]:
    """All records of the member (or the one plain record) at ``at``, and where it ends."""
    if src.get(at, 2) == b"\x1f\x8b":
        data, end = inflate(src, at)
    else:
        data, end = plain(src, at)
    out, pos = [], 0
    while pos < len(data) or not out:
        fields, block, pos = parse(data, pos)
        out.append((fields, checked(fields, block)))
    return out, end


def next_start(src: Bytes, at: int, end: int) -> int:
    """The first place from ``at`` on, before ``end``, that looks like a member or a version line; ``end`` if there is none."""
    while at < end:
        piece = src.get(at, PIECE)
        found = [m.start() for p in (_MAGIC, _VERSION) if (m := p.search(piece))]
        if found:
            return min(end, at + min(found))
        if at + len(piece) >= src.size:
            return end
        at += len(piece) - _VERSION_BYTES
    return end


def salvage(src: Bytes, start: int, end: int) -> Iterator[tuple[int, int, str | None, dict, bytes]]:
    """``(offset, length, error, headers, payload)`` of each record that begins in ``[start,
    end)``; gaps have an error and no payload."""
    at, gap, reason = start, None, None
    while at < end:
        try:
            found, stop = records_at(src, at)
        except Fault as e:
            if gap is None:
                gap, reason = at, str(e)
            at = next_start(src, at + 1, end)
            continue
        if gap is not None:
            yield gap, at - gap, reason, {}, b""
            gap = None
        for fields, payload in found:
            yield at, stop - at, None, fields, payload
        at = stop
    if gap is not None:
        yield gap, end - gap, reason, {}, b""


def read_archives(spark: SparkSession, ranges: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record, and every quarantined gap (``error`` is set), of ``ranges(path, start, end)``;
    ``end`` NULL is the archive's end. Without an index, one range from 0 is a whole archive."""
    def run(batches):
        for b in batches:
            for path, start, end in zip(*(c.to_pylist() for c in b.columns)):
                fs, name = file_system(path)
                size = fs.get_file_info(name).size
                with fs.open_input_file(name) as f:
                    rows, held = [], 0
                    for offset, length, error, fields, payload in salvage(Bytes(f, size), start, size if end is None else min(end, size)):
                        rows.append(_row(path, offset, length, error, fields, payload, with_payload))
                        held += len(payload) if with_payload else 200
                        if held >= 4 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return ranges.select("path", F.col("start").cast("bigint"), F.col("end").cast("bigint")).repartition(tasks, "path", "start").mapInArrow(run, RECORD_SCHEMA)


def _number(x: str | None) -> int | None:
    return int(x) if x is not None and re.fullmatch(r"-?[0-9]{1,18}|-?[0-8][0-9]{18}|-?9[0-1][0-9]{17}|-?92[0-1][0-9]{16}", x) else None


def _row(path, offset, length, error, fields, payload, with_payload) -> tuple:
    if error is not None:
        return path, offset, length, error, None, None, None, None, None, None, None, None
    kind = fields.get("warc-type")
    if kind == "revisit":  # of the full payload, as the record states them
        digest = fields.get("warc-payload-digest", "")
        size, digest = _number(fields.get("page-payload-bytes")), digest.partition(":")[2] if digest.startswith("sha256:") else digest or None
    else:
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    return (path, offset, length, None, kind, fields.get("warc-record-id"), fields.get("warc-target-uri"), _number(fields.get("page-id")),
            _number(fields.get("page-refers-to")), size, digest, payload if with_payload and kind != "revisit" else None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[s.split()[1]]) for c, s in zip(zip(*rows), RECORD_SCHEMA.split(", "))], names=names)


# --- writing -------------------------------------------------------------------------

def assigned(spark: SparkSession, pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``page_id, url, html, digest, size, refers_to, revisit`` of every row."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"),
                     F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).cast("bigint").alias("size"))
    p = p.withColumn("h", F.shiftleft(F.conv(F.substring("digest", 1, 15), 16, 10).cast("bigint"), 4))  # 60 bits of the digest, from the top
    large = F.col("size") >= min_bytes
    repeated = written(spark, p.where(large).select("digest", "h").groupBy("digest").agg(F.first("h").alias("h"), F.count("*").alias("n"))
                       .where("n > 1").select("digest", "h"), "repeated-payloads")
    n = repeated.count()
    if not n:
        return p.select("page_id", "url", "html", "digest", "size", F.lit(None).cast("bigint").alias("refers_to"), F.lit(False).alias("revisit"))
    words = spark.sparkContext.broadcast(bit_filter(repeated, n))

    @F.arrow_udf("boolean")
    def may_repeat(h: pa.Array) -> pa.Array:
        return pa.array(in_filter(words.value, h.to_numpy(zero_copy_only=False).view(np.uint64)))
    once = p.where(~large | ~may_repeat("h"))
    # Written with a number, so that the choice of one row of each group holds for every read.
    again = written(spark, p.where(large & may_repeat("h")).withColumn("row", F.monotonically_increasing_id()), "repeated-pages")
    rank = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "row")
    first = written(spark, again.groupBy("digest").agg(F.min(rank).alias("first")), "first-pages")
    joined = again.join(first, "digest")
    revisit = F.col("row") != F.col("first.row")
    cols = ["page_id", "url", "html", "digest", "size"]
    return once.select(*cols, F.lit(None).cast("bigint").alias("refers_to"), F.lit(False).alias("revisit")).unionByName(
        joined.select(*cols, F.when(revisit, F.col("first.page_id")).alias("refers_to"), revisit.alias("revisit")))


def write_archives(spark: SparkSession, pages: DataFrame, root: str | None = None, min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES,
                   range_bytes: int = RANGE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archives of ``pages`` under ``root`` (a folder of the shared checkpoint folder by
    default); returns the written index ``path, start, end, records``. The default date keeps archives of the
    same table alike; ``pages`` has no capture time."""
    root = root or scratch_path(spark, "archives")

    def run(batches):
        fs, folder = file_system(root)
        fs.create_dir(folder, recursive=True)
        out = path = None
        size = start = count = 0
        index = []

        def entry():
            index.append((path, start, size, count))
        for b in batches:
            for page_id, url, html, digest, n, refers_to, revisit in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    path, out = f"{root}/{name}", fs.open_output_stream(f"{folder}/{name}", compression=None)
                    info = gzip_member(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date),
                                               ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                    out.write(info)
                    start, size, count = 0, len(info), 1
                member = gzip_member(page_record(page_id, url, html, digest, n, refers_to, revisit, date))
                out.write(member)
                size, count = size + len(member), count + 1
                if size - start >= range_bytes or size >= archive_bytes:
                    entry()
                    start, count = size, 0
                if size >= archive_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
            if count:
                entry()
        if index:  # only now are all archives closed
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in index]), *(pa.array([x[i] for x in index], pa.int64()) for i in (1, 2, 3))],
                                             names=["path", "start", "end", "records"])
    rows = assigned(spark, pages, min_bytes).select("page_id", "url", F.col("html").cast("binary"), "digest", "size", "refers_to", "revisit")
    return written(spark, rows.mapInArrow(run, "path string, start bigint, end bigint, records bigint"), "archive-index")


def page_records(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of what was read."""
    return records.where("error IS NULL AND warc_type IN ('response', 'revisit')").select(
        "page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to")


def gaps(records: DataFrame) -> DataFrame:
    """The quarantined bytes: ``path, offset, length, error``."""
    return records.where("error IS NOT NULL").select("path", "offset", "length", "error")
