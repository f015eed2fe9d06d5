"""WARC archives: writing with revisit records, and a salvage reader.

Every record is a gzip member of its own. Spark's text writer puts the members into
files in the shared folder; what it writes after each row, its line separator, is an
empty gzip member. So the files come from a plain Spark write, with its commit
protocol, and are ordinary ``.warc.gz`` data.

The reader checks each member and record. Where a check fails it searches for the
next gzip member or version line that begins a valid record, goes on from there, and
logs the bytes between as a quarantined gap. Inside a member it does so too, over what
can be unpacked of it; such a gap has the member's place, and its own in the reason.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import as_bytes, bound_batches, slices, small_side, staged
from tilewright.sources.paths import scratch

MAGIC = b"\x1f\x8b\x08"
#: A gzip member of nothing.
NOTHING = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
VERSION = b"WARC/1.1\r\n"
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
ID = "urn:tilewright:page:"
#: Records in a file at most.
FILE_RECORDS = 500
#: Bytes of a member unpacked at a time.
STEP = 1 << 16


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _field(value: str) -> str:
    """A header value without what would end its line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def quoted(page: str) -> str:
    """An id as part of a URN: with % for itself and for what would end the id or the line."""
    return re.sub(r"[\x00-\x20\x7f%<>]", lambda m: f"%{ord(m[0]):02X}", page)


def record(page: str, url: str, payload: bytes, refers_to: str | None = None, date: str = DATE) -> bytes:
    """A response record, or a revisit of the record of page ``refers_to``.

    The revisit holds the HTTP header alone, which still tells the payload's length.
    """
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{ID}{quoted(page)}>"), ("WARC-Date", date),
        ("WARC-Target-URI", _field(url) or "about:blank"), ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)), ("WARC-Block-Digest", "sha1:" + base32_sha1(block)),
    ]
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<{ID}{quoted(refers_to)}>"), ("WARC-Profile", PROFILE)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    """A gzip member; the same bytes give the same member."""
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


@dataclass
class Found:
    """A record, or a gap (``headers`` None) and why it was passed over."""

    begin: int
    end: int
    headers: dict[str, str] | None = None
    block: bytes = b""
    reason: str = ""


class Damaged(ValueError):
    """A check failed; ``found`` are the records that are whole all the same, ``end`` is where to go on, if that is known."""

    def __init__(self, reason: str, found: list[Found] | None = None, end: int | None = None):
        super().__init__(reason)
        self.found, self.end = found or [], end


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at a place; Damaged if a check fails.

    Where the record ends as its length says and only a digest differs, what it holds isn't searched: a record
    inside its payload is its payload.
    """
    if not VERSION_LINE.match(data, at):
        raise Damaged("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Damaged("headers without an end")
    headers = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("a header line without a colon")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Damaged("no content length")
    begin, end = stop + 4, stop + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("the record doesn't end where its length says")
    block, digest = data[begin:end], headers.get("warc-block-digest")
    if digest and digest.startswith("sha1:") and digest[5:] != base32_sha1(block):
        raise Damaged("the block digest differs", end=end + 4)
    payload = payload_of(headers, block)
    digest = headers.get("warc-payload-digest")
    if payload is not None and digest and digest.startswith("sha1:") and digest[5:] != base32_sha1(payload):
        raise Damaged("the payload digest differs", end=end + 4)
    return headers, block, end + 4


def payload_of(headers: dict[str, str], block: bytes) -> bytes | None:
    """A response's payload; None of other records."""
    if headers.get("warc-type") != "response":
        return None
    if not headers.get("content-type", "").startswith("application/http"):
        return block
    return block.partition(b"\r\n\r\n")[2]


def unpack(data: bytes, at: int) -> tuple[bytes, int]:
    """What the gzip member at a place holds, and its end; Damaged if a check fails."""
    pack, parts, view = zlib.decompressobj(31), [], memoryview(data)
    try:
        while not pack.eof:
            if at >= len(data):
                raise Damaged("a member is cut off")
            parts.append(pack.decompress(view[at : at + STEP]))
            at = min(at + STEP, len(data))
    except zlib.error as error:
        raise Damaged(f"a member is damaged: {error}") from None
    return b"".join(parts), at - len(pack.unused_data)


def inflated(data: bytes, at: int) -> tuple[bytes, list[tuple[int, int]]]:
    """What a damaged gzip member gives up to the place where it can't be read on.

    Also places in ``data`` and how much was unpacked until each, in order, ``STEP`` bytes apart but for the last ones.
    """
    pack, parts, view = zlib.decompressobj(31), [], memoryview(data)
    step, size, marks = STEP, 0, [(at, 0)]
    while at < len(data) and not pack.eof:
        before = pack.copy()
        try:
            parts.append(pack.decompress(view[at : at + step]))
        except zlib.error:
            if step == 1:
                break
            # what came of the failing piece is lost: once more, this piece byte by byte
            pack, step = before, 1
            continue
        at, size = min(at + step, len(data)), size + len(parts[-1])
        marks.append((at, size))
    return b"".join(parts), marks


def covered(data: bytes, marks: list[tuple[int, int]], size: int) -> int:
    """The place in ``data`` up to which a member was read when ``size`` bytes were unpacked of it."""
    k = bisect_left(marks, size, key=lambda m: m[1])
    if k == 0:
        return marks[0][0]
    at, done = marks[k - 1]
    if marks[k][0] - at == 1:
        return marks[k][0]
    pack, view = zlib.decompressobj(31), memoryview(data)
    for (a, _), (b, _) in zip(marks[: k - 1], marks[1:k]):
        pack.decompress(view[a:b])
    while done < size and at < marks[k][0]:
        done += len(pack.decompress(view[at : at + 1]))
        at += 1
    return at


def _in_member(plain: bytes, begin: int, end: int, sound: bool = True) -> tuple[list[Found], int]:
    """Records of a member's bytes and the gaps between them, and where the last record ends; of a damaged member, those that a digest confirms."""
    found, k, gap, reason, last = [], 0, None, "", 0
    while k < len(plain):
        try:
            headers, block, stop = parse_record(plain, k)
            if not sound and not headers.get("warc-block-digest", "").startswith("sha1:"):
                raise Damaged("no digest in a damaged member", end=stop)
        except Damaged as error:
            if gap is None:
                gap, reason = k, str(error)
            line = VERSION_LINE.search(plain, k + 1)
            k = error.end or (line.start() if line else len(plain))
            continue
        if gap is not None:
            found.append(Found(begin, end, reason=f"{reason}; bytes {gap} to {k} of the member"))
            gap = None
        found.append(Found(begin, end, headers, block))
        k = last = stop
    if gap is not None and sound:
        found.append(Found(begin, end, reason=f"{reason}; bytes {gap} to {len(plain)} of the member"))
    return found, last


def _at(data: bytes, at: int) -> tuple[list[Found], int]:
    """The records of the gzip member, or the plain record, at a place; gaps are those inside a sound member.

    Of a damaged member what its records cover is done with; the search goes on behind that.
    """
    if data.startswith(MAGIC, at):
        try:
            plain, end = unpack(data, at)
        except Damaged as error:
            plain, marks = inflated(data, at)
            found, last = _in_member(plain, at, at, False)
            if not last:
                raise
            end = covered(data, marks, last)
            for x in found:
                x.end = end
            raise Damaged(str(error), found, end) from None
        return _in_member(plain, at, end)[0], end
    headers, block, end = parse_record(data, at)
    return [Found(at, end, headers, block)], end


def salvage(data: bytes) -> Iterator[Found]:
    """Every valid record of an archive, in order, and the gaps between them."""
    at, gap, reason = 0, None, ""
    line, packed = -1, -1  # the next version line and member that were searched for; they hold until passed
    while at < len(data):
        try:
            found, end = _at(data, at)
        except Damaged as error:
            if error.found and gap is not None:
                yield Found(gap, at, reason=reason)
                gap = None
            yield from error.found
            if gap is None:
                gap, reason = (error.end if error.found else at), str(error)
            # from where the failed check says, that place included, or else from the next byte
            start = error.end or at + 1
            if line < start:
                line = m.start() if (m := VERSION_LINE.search(data, start)) else len(data)
            if packed < start:
                packed = p if (p := data.find(MAGIC, start)) >= 0 else len(data)
            at = min(packed, line)
            if gap == at:
                gap = None
            continue
        if gap is not None:
            yield Found(gap, at, reason=reason)
            gap = None
        yield from found
        at = end
    if gap is not None:
        yield Found(gap, len(data), reason=reason)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "payload"):
        columns = [batch.column(c).to_pylist() for c in ("page", "url", "payload", "first")]
        yield pa.RecordBatch.from_arrays([pa.array([member(record(p or "", u or "", x or b"", f)) for p, u, x, f in zip(*columns)], pa.binary())], ["member"])


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, file_records: int = FILE_RECORDS) -> None:
    """Archives of ``pages`` below ``path``, a record for each row.

    Of rows with equal payloads of ``least_bytes`` or more, those of the least id are
    responses and the others revisit it; a payload of null ids only is a response each
    time. Null payloads are empty, null urls ``about:blank``. Other columns don't matter.
    Payloads are shuffled only if the table of repeated ones is too large to send around.
    """
    payload = F.coalesce(as_bytes(payload_col, "payload"), F.lit(b""))
    key = F.when(F.length(payload) >= least_bytes, F.sha1(payload))
    seen = pages.select(F.col(id_col).alias("id"), key.alias("key")).where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    repeated = staged(seen.where("n > 1 AND first IS NOT NULL").select(F.col("key").alias("seen"), "first"), "repeated")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), key.alias("key"))
    rows = rows.join(small_side(repeated), F.col("key") == F.col("seen"), "left")
    other = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    rows = rows.select(F.col("id").cast("string").alias("page"), "url", "payload", F.when(other, F.col("first").cast("string")).alias("first"))
    members = bound_batches(rows).mapInArrow(_members, "member binary").select(F.col("member").cast("string").alias("value"))
    members.write.option("encoding", "ISO-8859-1").option("lineSep", NOTHING.decode("latin-1")).option("maxRecordsPerFile", file_records).text(path)


SCHEMA = "file string, begin long, end long, type string, record_id string, target_uri string, payload_bytes long, payload_digest string, refers_to string, payload binary, gap string"


def _records(with_payload: bool):
    names = ["file", "begin", "end", "type", "record_id", "target_uri", "payload_bytes", "payload_digest", "refers_to", "payload", "gap"]
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 3, pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]

    def row(name: str, x: Found) -> tuple:
        if x.headers is None:
            return name, x.begin, x.end, None, None, None, None, None, None, None, x.reason
        payload, kind = payload_of(x.headers, x.block), x.headers.get("warc-type")
        size = None if payload is None else len(payload)
        if kind == "revisit" and (m := re.search(rb"(?i)\r\nContent-Length:\s*(\d+)", x.block)):
            size = int(m[1])
        digest = x.headers.get("warc-payload-digest", "")
        return name, x.begin, x.end, kind, x.headers.get("warc-record-id"), x.headers.get("warc-target-uri"), size, digest.removeprefix("sha1:") or None, x.headers.get("warc-refers-to"), payload if with_payload else None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                rows, size = [], 0
                for x in salvage(content.as_py() or b""):
                    rows.append(row(name.as_py(), x))
                    size += len(rows[-1][9] or b"") + 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return run


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for every record and every quarantined gap of the archives below ``path``.

    Gaps have ``gap``, the reason, and nulls but for their place. Digests are checked
    against the bytes. A revisit's ``payload_bytes`` is that of the payload it stands
    for; its ``payload`` is null. Files without a byte give no row. A file is one value of Spark's
    binary reader and so under 2 GB: the usual size of archives is half of that.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return bound_batches(files).mapInArrow(_records(payloads), SCHEMA)


def page_id(uri: Column, kind: str) -> Column:
    """The id in a record's URN, unquoted; null where there is none."""
    found = F.regexp_extract(uri, f"{ID}([^>]*)", 1)
    return F.when(found != "", F.url_decode(F.regexp_replace(found, r"\+", "%2B"))).cast(kind)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """``pages`` written as archives in the shared folder and read back, ids from the records.

    A row for each row of ``pages``: what was just written has no gaps, so one is an error, not a row less. Ids
    come back as they were, whatever signs they have; an empty id, like a null one, as null.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    path = scratch(pages.sparkSession, "warc")
    write(pages, path, id_col, url_col, payload_col, least_bytes)
    found = read(pages.sparkSession, path, payloads=False)
    lost = F.raise_error(F.concat_ws(" ", F.lit("lost in an archive just written:"), "file", F.col("begin").cast("string"), "gap")).cast("string")
    whole = F.when(F.col("gap").isNotNull(), lost).otherwise(F.col("record_id"))
    return found.select(page_id(whole, kind).alias("id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page_id(F.col("refers_to"), kind).alias("refers_to"))
