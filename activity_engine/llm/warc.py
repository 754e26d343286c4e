"""Web archives: one WARC/1.1 record a row, copies written as revisits, and a reader that salvages damaged files.

A file is a run of gzip members, each with one record, closed by an empty member, so that Spark's text writer can lay members
down as lines between those closers; its committer keeps files of lost tasks out. A response holds the HTTP header and the
payload, a revisit the HTTP header alone, whose ``Content-Length`` still is that of the payload.

The reader takes any bytes: members with one or more records, and records that are not compressed. What fails a check (the
member's checksum, header lines, length, closing blank lines, digest of block or payload) is left behind; the search goes on
at the next byte where a member or a version line could begin and a whole valid record follows. Bytes in between come out as gaps.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from activity_engine.llm.blocks import shuffle_partitions
from activity_engine.llm.hot import attach

#: Payloads of fewer bytes are written whole each time.
LEAST_SHARED = 100
#: Bytes of payload that a file is meant to hold at most. A single payload may be larger.
FILE_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"
LEVEL = 3
_STEP = 1 << 15
#: Fixed values of the formats: an empty gzip member, how a member begins, a version line, the revisit profile.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
_MEMBER = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
_BEGIN = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r?\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SAFE = "!#$%&'()*+,/:;=?@[]~"

RECORDS = ("path string, offset long, length long, problem string, record_id string, record_type string, target_uri string, "
           "refers_to string, payload_digest string, payload_bytes long, headers map<string,string>, payload binary")


def member(record: bytes, level: int = LEVEL) -> bytes:
    """One gzip member, without a date, so that a repeated task writes the same bytes."""
    press = zlib.compressobj(level, zlib.DEFLATED, 31)
    return press.compress(record) + press.flush()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record with its length and block digest."""
    lines = [*headers, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in lines), "\r\n"]).encode() + block + b"\r\n\r\n"


def page_record(row: str, uri: str | None, payload: bytes, digest: str, first: str | None, first_uri: str | None) -> bytes:
    """The response for a row, or, where ``first`` names another row, its revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = quote(uri, _SAFE) if uri else f"urn:row:{row}"
    headers = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", f"<urn:row:{row}>"), ("WARC-Date", DATE),
               ("WARC-Target-URI", target), ("Content-Type", "application/http; msgtype=response"),
               ("WARC-Payload-Digest", f"sha256:{digest}")]
    if first is None:
        return record(headers, http + payload)
    headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:row:{first}>"),
                ("WARC-Refers-To-Target-URI", quote(first_uri, _SAFE) if first_uri else f"urn:row:{first}")]
    return record(headers, http)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begun = False
    for batch in batches:
        columns = [batch.column(c) for c in ("row", "uri", "payload", "digest", "first", "first_uri")]
        for start in range(0, batch.num_rows, 256):
            rows = zip(*(c.slice(start, 256).to_pylist() for c in columns))
            members = [member(page_record(*row)) for row in rows]
            if not begun:
                about = b"software: a Spark job\r\nformat: WARC File Format 1.1\r\n"
                members.insert(0, member(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:row:about>"), ("WARC-Date", DATE),
                                                 ("Content-Type", "application/warc-fields")], about)))
                begun = True
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], names=["value"])


def write_warc(pages: DataFrame, where: str, id: str = "page_id", uri: str = "url", payload: str = "html",
               least_shared: int = LEAST_SHARED, file_bytes: int = FILE_BYTES) -> None:
    """Write a record for every row of ``pages`` to files in the new folder ``where``.

    Of rows with equal payloads of at least ``least_shared`` bytes, that with the smallest ``id`` is the response, and the others
    revisit it. A null payload is an empty one. Rows that repeat the smallest id with one payload are all responses; a null
    id counts as larger than any, and where all ids are null, all are responses. Other columns are not read.
    """
    rows = pages.select(F.col(id).cast("long").alias("id"), F.col(uri).cast("string").alias("uri"),
                        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    shared = F.col("size") >= least_shared
    groups = (rows.where(shared).groupBy("digest")
              .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uri")).alias("least"), F.count(F.lit(1)).alias("copies"))
              .where("copies > 1").select(F.col("digest").alias("key"), "copies", F.col("least.id").alias("first"), F.col("least.uri").alias("first_uri")))
    total = pages.agg(F.sum(F.octet_length(F.col(payload).cast("binary")))).first()[0] or 0
    told = attach(rows.withColumn("key", F.when(shared, F.col("digest"))), groups, "key", "copies",
                  F.xxhash64("id", "digest", "uri"), partitions=max(shuffle_partitions(pages), -(-total // file_bytes)))
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = lambda column: F.coalesce(column.cast("string"), F.lit(""))
    (told.select(name(F.col("id")).alias("row"), "uri", "payload", "digest",
                 F.when(again, name(F.col("first"))).alias("first"), F.when(again, F.col("first_uri")).alias("first_uri"))
     .mapInArrow(_write, "value binary").select(F.col("value").cast("string"))
     .write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("compression", "none").text(where))


@dataclass
class Found:
    """A valid record, or, with a ``problem``, bytes that belong to none."""

    offset: int
    length: int
    problem: str | None = None
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    payload: bytes = b""
    payload_bytes: int | None = None


class Damaged(ValueError):
    """What stands here is no whole valid record."""


def _lines(head: bytes) -> dict[str, str]:
    """Header fields by small names; a line that begins with a blank continues the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\n"):
        line = line.rstrip("\r")
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("header line without a colon")
        name = name.strip().lower()
        out[name] = value.strip()
    return out


def _split(data: bytes | memoryview, start: int, end: int) -> tuple[int, int]:
    """Where the header that begins at ``start`` ends, and where what follows its blank line begins."""
    size = 1 << 12
    while True:
        window = bytes(data[start: min(start + size, end)])
        found = re.search(rb"\r?\n\r?\n", window)
        if found and found.end() < len(window) or found and start + size >= end:
            return start + found.start(), start + found.end()
        if start + size >= end or size >= 1 << 20:
            raise Damaged("header without an end")
        size *= 4


def _matches(told: str, data: bytes | memoryview) -> bool:
    """Whether a labelled digest is that of the data; algorithms and spellings that are not known are not held against it."""
    name, _, value = told.partition(":")
    name = name.lower().replace("-", "")
    if name not in ("sha256", "sha1", "md5"):
        return True
    made = hashlib.new(name, data)
    if len(value) == 2 * made.digest_size:
        return value.lower() == made.hexdigest()
    import base64

    return value.upper().rstrip("=") == base64.b32encode(made.digest()).decode().rstrip("=")


def parse(data: bytes | memoryview, start: int) -> tuple[Found, int]:
    """The record that begins at ``start``, and where it ends; ``Damaged`` if any check fails."""
    view = memoryview(data)
    version = _VERSION.match(bytes(view[start: start + 16]))
    if not version:
        raise Damaged("no version line")
    stop, body = _split(view, start + version.end(), len(view))
    headers = _lines(bytes(view[start + version.end(): stop]))
    if not headers.get("content-length", "").isdigit():
        raise Damaged("no length")
    length = int(headers["content-length"])
    end = body + length
    if end > len(view):
        raise Damaged("cut short")
    block = bytes(view[body: end])
    closed = bytes(view[end: end + 4])
    if closed != b"\r\n\r\n" and closed[:2] != b"\n\n":
        raise Damaged("record not closed after its length")
    if not _matches(headers.get("warc-block-digest", ""), block):
        raise Damaged("block digest differs")
    payload, size = block, None
    if "msgtype=response" in headers.get("content-type", "").replace(" ", "") or block[:5] == b"HTTP/":
        try:
            stop, body = _split(block, 0, len(block))
            http = _lines(block[block.find(b"\n") + 1: stop])
            payload = block[body:]
            size = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
        except Damaged:
            payload = block
    whole = headers.get("warc-type") != "revisit"
    if whole and not _matches(headers.get("warc-payload-digest", ""), payload):
        raise Damaged("payload digest differs")
    return Found(start, 0, headers=headers, block=block, payload=payload, payload_bytes=len(payload) if whole else size), \
        end + (4 if closed == b"\r\n\r\n" else 2)


def _inflate(view: memoryview, start: int) -> tuple[bytes, int]:
    """The member that begins at ``start``, and where it ends."""
    press = zlib.decompressobj(31)
    out, at = [], start
    try:
        while not press.eof:
            if at >= len(view):
                raise Damaged("member cut short")
            out.append(press.decompress(view[at: at + _STEP]))
            at += _STEP
    except zlib.error as error:
        raise Damaged("member fails its checksum" if "check" in str(error) else "no valid member") from error
    return b"".join(out), min(at, len(view)) - len(press.unused_data)


def _one(view: memoryview, start: int) -> tuple[list[Found], int]:
    """The records of the member, or the record, that begins at ``start``, and where it ends."""
    if bytes(view[start: start + 3]) != _MEMBER:
        found, end = parse(view, start)
        found.length = end - start
        return [found], end
    data, end = _inflate(view, start)
    out, at = [], 0
    while at < len(data):
        found, at = parse(data, at)
        found.offset, found.length = start, end - start
        out.append(found)
    return out, end


def salvage(data: bytes | memoryview) -> Iterator[Found]:
    """All valid records of a file, and a gap with its problem for every run of bytes that belong to none, in order."""
    view, at, gap, problem = memoryview(data), 0, None, ""
    while at < len(data):
        try:
            found, end = _one(view, at)
        except Damaged as error:
            if gap is None:
                gap, problem = at, str(error)
            following = _BEGIN.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if gap is not None:
            if not found:  # an empty member closes a record but proves nothing: stay in the gap until a record follows
                at = end
                continue
            yield Found(gap, at - gap, problem)
            gap = None
        yield from found
        at = end
    if gap is not None:
        yield Found(gap, len(data) - gap, problem)


_SCHEMA = pa.schema([
    ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("problem", pa.string()), ("record_id", pa.string()),
    ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()),
    ("payload_bytes", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def _row(path: str, f: Found, payload: bool) -> tuple:
    h = f.headers
    bare = lambda name: h[name].strip("<>") if name in h else None
    return (path, f.offset, f.length, f.problem, bare("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"),
            bare("warc-refers-to"), h.get("warc-payload-digest"), f.payload_bytes, list(h.items()), f.payload if payload else None)


def _read(payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                held, size = [], 0
                for found in salvage(memoryview(content.as_buffer())):
                    held.append(_row(path.as_py(), found, payload))
                    size += len(found.payload) if payload else 1024
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _SCHEMA)], schema=_SCHEMA)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _SCHEMA)], schema=_SCHEMA)

    return run


def read_warc(spark: SparkSession, where: str, payload: bool = True) -> DataFrame:
    """Every record of the files in ``where``, and every quarantined gap: a row with ``problem`` and no record.

    A file is read by one task, as Spark reads binary files (2 GB at most); ``write_warc`` bounds its files. ``payload``
    false checks payloads as well, but does not return them. Records without the header a column shows have null there.
    """
    files = spark.read.format("binaryFile").load(where).where("length > 0").select("path", "content")
    return files.mapInArrow(_read(payload), RECORDS)


def gaps(read: DataFrame) -> DataFrame:
    """The log of quarantined bytes: (path, offset, length, problem)."""
    return read.where(F.col("problem").isNotNull()).select("path", "offset", "length", "problem")


def _row_id(column: str) -> Column:
    """The id in ``urn:row:<id>``; null where there is none."""
    return F.expr(f"try_cast(nullif(substring({column}, 9), '') as long)")


def digest(read: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the responses and revisits that were read."""
    return read.where("record_type in ('response', 'revisit')").select(
        _row_id("record_id").alias("page_id"), "payload_bytes",
        F.lower(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"), "record_type", _row_id("refers_to").alias("refers_to"))


SQL = f"""
with sized as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as told from pages),
firsts as (select told, min(page_id) as first from sized where n >= {LEAST_SHARED} group by told)
select page_id, n::bigint as payload_bytes, told as payload_digest,
       case when page_id is distinct from first and first is not null then 'revisit' else 'response' end as record_type,
       case when page_id is distinct from first then first end as refers_to
from (select s.*, f.first from sized s left join firsts f on s.told = f.told and s.n >= {LEAST_SHARED})
"""
