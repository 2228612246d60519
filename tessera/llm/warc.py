"""WARC archives: a writer of gzip-per-record archives and a salvage reader.

The reader checks every gzip member (CRC and length), every record's frame (version line, header,
Content-Length, end) and, where the record states one, its payload's SHA-256. After a failed check it
searches for the next member or version line from which a record can be read, goes on there, and
logs the bytes between as a quarantined gap.

Archives are written by Spark's text writer, so they go to any store that Spark writes to and a lost
executor's files are replaced by the commit protocol: the last byte of a gzip member under 16 MiB is
0, and that byte is the writer's line separator.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import new_path

#: Bytes of payload from which equal payloads are stored once.
REVISIT_FROM = 100
#: Compressed bytes after which a task begins another archive.
ARCHIVE = 16 << 20
#: Raw bytes of a gzip member at most; a longer record has several.
MEMBER = 8 << 20
#: Bytes of records handed to Spark at once.
FLUSH = 4 << 20

_MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/1."
_URN = "urn:page:"
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.")


def member(raw: bytes) -> bytes:
    """raw as gzip members of at most MEMBER raw bytes each."""
    out = []
    for at in range(0, max(len(raw), 1), MEMBER):
        part = raw[at : at + MEMBER]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        out.append(b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + z.compress(part) + z.flush() + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit of the page refers_to, which keeps the HTTP header and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", "%0A", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_URN}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    start: int
    end: int
    headers: dict[str, str]
    block: bytes

    def payload(self) -> tuple[bytes, dict[str, str]]:
        """The block without its HTTP header, and that header; a block without one, or with one that can't be read, is all payload."""
        if not self.headers.get("content-type", "").startswith("application/http"):
            return self.block, {}
        head, mark, body = self.block.partition(b"\r\n\r\n")
        try:
            return (body, _fields(head.split(b"\r\n")[1:])) if mark else (self.block, {})
        except Damaged:
            return self.block, {}


@dataclass
class Gap:
    start: int
    end: int
    reason: str


class Damaged(ValueError):
    pass


def _number(text: str) -> int | None:
    """The number that text states in plain digits, if 64 bits hold it."""
    found = int(text) if re.fullmatch(r"-?[0-9]{1,19}", text) else None
    return found if found is not None and -(1 << 63) <= found < 1 << 63 else None


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, mark, value = line.partition(b":")
        if not mark:
            raise Damaged("a header line without a colon")
        out[name.strip().lower().decode("ascii", "replace")] = value.strip().decode("utf-8", "replace")
    return out


def _frame(raw: bytes, at: int) -> tuple[dict[str, str], int, int] | None:
    """Header, block's start and end of the record at raw[at:]; None if raw ends before the record does."""
    if not raw.startswith(_VERSION, at):
        if len(raw) - at < len(_VERSION) and _VERSION.startswith(raw[at:]):
            return None
        raise Damaged("no version line")
    stop = raw.find(b"\r\n\r\n", at)
    if stop < 0:
        return None
    headers = _fields(raw[at:stop].split(b"\r\n")[1:])
    length = _number(headers.get("content-length", ""))
    if length is None or length < 0:
        raise Damaged("no content length")
    end = stop + 4 + length
    if len(raw) < end + 4:
        return None
    if raw[end : end + 4] != b"\r\n\r\n":
        raise Damaged("the record does not end where its length says")
    return headers, stop + 4, end


def _checked(start: int, end: int, headers: dict[str, str], block: bytes) -> Record:
    found = Record(start, end, headers, block)
    kind, _, want = headers.get("warc-payload-digest", "").partition(":")
    if kind == "sha256" and headers.get("warc-type") != "revisit" and hashlib.sha256(found.payload()[0]).hexdigest() != want.lower():
        raise Damaged("the payload does not match its digest")
    return found


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str, bool]:
    """What the gzip member at data[at:] holds, where its reading ends, and why it stopped before the member's end (empty if it did not) and whether for want of data."""
    z, parts, step = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            if step >= len(data):
                return b"".join(parts), len(data), "the archive ends within a member", True
            # small pieces, so that little is lost before an error
            parts.append(z.decompress(data[step : step + (1 << 16)]))
            step += 1 << 16
    except zlib.error as e:
        z, stop = zlib.decompressobj(31), min(step + (1 << 16), len(data))
        parts, at_byte = [], at
        try:
            while at_byte < stop:
                size = 1 << 16 if at_byte + (1 << 16) <= step else 1
                parts.append(z.decompress(data[at_byte : at_byte + size]))
                at_byte += size
        except zlib.error:
            pass
        return b"".join(parts), at_byte, f"member: {e}", False
    return b"".join(parts), min(step, len(data)) - len(z.unused_data), "", False


def _read_on(data: bytes, at: int, raw: bytes, end: int) -> tuple[list[Record], int]:
    """The records of raw, the rest of members from data[at:end], and of the members after it as far as a record runs on, and where they end."""
    records: list[Record] = []
    while True:
        if not data.startswith(_MAGIC, end):
            raise Damaged("a record ends too early")
        more, end, why, _ = _inflate(data, end)
        if why:
            raise Damaged(why)
        raw += more
        place = 0
        while place < len(raw) and (frame := _frame(raw, place)):
            headers, a, b = frame
            records.append(_checked(at, end, headers, raw[a:b]))
            place = b + 4
        raw = raw[place:]
        if not raw:
            return records, end


def _search(raw: bytes, at: int, end: int, stated: bool) -> list[Record | Gap]:
    """The whole records in raw and gaps between them; stated: only those whose payload digest is stated and right."""
    out: list[Record | Gap] = []
    place = 0
    while place < len(raw):
        try:
            frame = _frame(raw, place)
            if frame is None:
                raise Damaged("a record ends too early")
            found = _checked(at, end, frame[0], raw[frame[1] : frame[2]])
            if stated and (not found.headers.get("warc-payload-digest", "").startswith("sha256:") or found.headers.get("warc-type") == "revisit"):
                raise Damaged("a record without a digest in a damaged member")
            out.append(found)
            place = frame[2] + 4
        except Damaged as e:
            if not out or isinstance(out[-1], Record):
                out.append(Gap(at, end, str(e)))
            nxt = raw.find(_VERSION, place + 1)
            place = nxt if nxt >= 0 else len(raw)
    return out


def _read_members(data: bytes, at: int) -> tuple[list[Record | Gap], int]:
    """The records and gaps of the gzip member at data[at:], and of those after it as far as a record runs on, and where they end.

    A gap within a member has the member's bytes.
    """
    raw, end, why, _ = _inflate(data, at)
    if why:
        raise Damaged(why)
    place, records = 0, []
    try:
        while place < len(raw) and (frame := _frame(raw, place)):
            headers, a, b = frame
            records.append(_checked(at, end, headers, raw[a:b]))
            place = b + 4
        if place < len(raw):
            more, stop = _read_on(data, at, raw[place:], end)
            return records + more, stop
    except Damaged:
        rest = _search(raw[place:], at, end, False)
        if not records and not any(isinstance(x, Record) for x in rest):
            raise
        return records + rest, end
    return records, end


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """The records and quarantined gaps of an archive, in order; together they cover all its bytes.

    Gzip members and plain records may be mixed. Empty data has neither. Whole records of a member
    that is damaged or cut have the range of the gap that it leaves; of a damaged one only records
    whose payload's SHA-256 is stated and right are taken, for its check sum can't be.
    """
    at, lost, why = 0, None, ""
    partial: list[tuple[int, Record]] = []

    def quarantined(stop: int) -> Iterator[Record | Gap]:
        for _, x in partial:
            yield Record(lost, stop, x.headers, x.block)
        partial.clear()
        yield Gap(lost, stop, why)

    while at < len(data):
        try:
            if data.startswith(_MAGIC, at):
                records, end = _read_members(data, at)
            elif data.startswith(_VERSION, at):
                frame = _frame(data, at)
                if frame is None:
                    raise Damaged("the archive ends within a record")
                records, end = [_checked(at, frame[2] + 4, frame[0], data[frame[1] : frame[2]])], frame[2] + 4
            else:
                raise Damaged("neither a member nor a version line")
        except Damaged as e:
            if lost is None:
                lost, why = at, str(e)
            if data.startswith(_MAGIC, at) and not any(at < stop for stop, _ in partial):
                raw, stop, failed, short = _inflate(data, at)
                if failed:
                    partial += [(stop, x) for x in _search(raw, at, stop, not short) if isinstance(x, Record)]
            nxt = _START.search(data, at + 1)
            at = nxt.start() if nxt else len(data)
            continue
        if lost is not None:
            # bytes that a damaged member stores as they are may be read again
            again = [(x.headers, x.block) for x in records if isinstance(x, Record)]
            partial = [(stop, x) for stop, x in partial if stop <= at or (x.headers, x.block) not in again]
            yield from quarantined(at)
            lost = None
        yield from records
        at = end
    if lost is not None:
        yield from quarantined(len(data))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = size = 0
    for batch in batches:
        ids, urls, htmls, digests, refers = (c.to_pylist() for c in batch.columns)
        values, parts = [], []
        for page_id, url, html, digest, refer in zip(ids, urls, htmls, digests, refers, strict=True):
            value = member(record(page_id, url, html or b"", digest, refer))
            if size and size + len(value) > ARCHIVE:
                part, size = part + 1, 0
            size += len(value)
            values.append(value[:-1])
            parts.append(part)
        yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary()), pa.array(parts, pa.int32())], ["value", "part"])


_READ = "archive string, kind string, start long, stop long, reason string, page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, payload binary"


def _page(ref: str | None) -> int | None:
    return _number((ref or "").strip("<>").removeprefix(_URN))


def _unpack(with_payload: bool):
    names = [x.split()[0] for x in _READ.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in _READ.split(", ")])

    def row(path: str, x: Record | Gap) -> dict:
        if isinstance(x, Gap):
            return {"archive": path, "kind": "gap", "start": x.start, "stop": x.end, "reason": x.reason}
        body, http = x.payload()
        revisit = x.headers.get("warc-type") == "revisit"
        length = http.get("content-length", "") if revisit else str(len(body))
        return {
            "archive": path, "kind": "record", "start": x.start, "stop": x.end, "page_id": _page(x.headers.get("warc-record-id")),
            "record_type": x.headers.get("warc-type"), "refers_to": _page(x.headers.get("warc-refers-to")), "url": x.headers.get("warc-target-uri"),
            "payload_bytes": _number(length),
            "payload_digest": x.headers.get("warc-payload-digest", "").rpartition(":")[2].lower() if revisit else hashlib.sha256(body).hexdigest(),
            "payload": None if revisit or not with_payload else body,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                path, rows, size = batch.column(0)[k].as_py(), [], 0
                for x in salvage(batch.column(1)[k].as_buffer().to_pybytes()):
                    rows.append(row(path, x))
                    size += 200 + len(rows[-1].get("payload") or b"")
                    if size > FLUSH:
                        yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], schema.field(n).type) for n in names], schema=schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], schema.field(n).type) for n in names], schema=schema)

    return run


def write_archives(pages: DataFrame, path: str) -> None:
    """Write a record per row of pages (page_id, url, html) into archives under path.

    Of rows with equal payloads of REVISIT_FROM bytes or more, those with the smallest page_id are
    responses and the others revisits of it; all other rows are responses. A null html is an empty
    payload. A row with a null page_id is a response without an id. A null url leaves the header
    out. Other columns aren't read. An empty table writes no record.
    """
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"))
    digest = F.sha2("html", 256)
    narrow = rows.where((F.length("html") >= REVISIT_FROM) & F.col("page_id").isNotNull()).select(digest.alias("d"), "page_id")
    first = narrow.groupBy("d").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("d", "first")
    rows = rows.withColumn("digest", digest).join(first, F.col("digest") == F.col("d"), "left")
    refers = F.when(F.col("page_id") > F.col("first"), F.col("first"))
    packed = rows.select("page_id", "url", "html", "digest", refers.alias("refers")).mapInArrow(_pack, "value binary, part int")
    packed.select(F.col("value").cast("string").alias("value"), "part").write.option("lineSep", "\0").partitionBy("part").text(path)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records and quarantined gaps of all archives under path, from any writer: gzip members, plain records or both.

    kind is record or gap; start and stop are byte offsets (of a compressed record, its member's).
    page_id and refers_to are null where the record names none of write_archives(). Archives are read
    whole, each in one task, so they should stay well under an executor's memory (ARCHIVE here).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where("length > 0").select("path", "content").mapInArrow(_unpack(with_payload), _READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) per page, as read back from archives in the shared folder."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path)
    back = read_archives(spark, path, with_payload=False).where("kind = 'record'")
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
with p as (select page_id, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as r from p where n >= {REVISIT_FROM} group by d)
select p.page_id, p.n as payload_bytes, p.d as payload_digest,
  case when p.page_id > f.r then 'revisit' else 'response' end as record_type,
  case when p.page_id > f.r then f.r end as refers_to
from p left join f on p.d = f.d and p.n >= {REVISIT_FROM}"""
