"""WARC archives: a writer with revisit records, and a salvage reader.

Writing is one Spark job: one record for each page, the payload inside an HTTP response; of pages with equal
payloads the smallest id is the response and the others are revisit records that name it. Every record is a
gzip member of its own, so damage costs the records that it touches. Spark's text sink writes the members,
so archives can lie in any store and a lost task leaves nothing behind: a row is a block of members without
its last byte, and that byte, always zero, is the sink's line separator (a member's last byte is the highest
of its length, zero below 16 MB; after a longer record an empty member follows, which ends in zeros). A file
holds at most FILE_BLOCKS blocks of BLOCK_BYTES or of one larger record.

Reading looks at each position for a gzip member or a version line, so plain and packed parts may follow each
other. Members are unpacked and parsed piece by piece: besides the file's own bytes, memory holds the
record at hand. After a failed check (a broken member, a record whose head, length, end or digest is wrong)
it searches for the next valid member or version line, recovers the records after it, and logs the bytes
between as a quarantined gap. Gaps of a packed part are in packed bytes; of a broken member, whatever comes
out before the damage is read, record by record.

Defined cases: null html is the empty payload; a null url leaves out the target; a null page id is a response
of its own that nothing revisits; rows that repeat a page id and its payload are written each time, all
responses if their id is the smallest; payloads under `least` bytes are never revisited; other columns of
the input stay out; round_trip() raises if its own archives come back with a gap.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import shared_dir
from textloom.session import ship_package

END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:page:"
#: Packed bytes of a block of members, and blocks of a file; one long record may be larger.
BLOCK_BYTES = 4 << 20
FILE_BLOCKS = 16
#: Plain bytes that are unpacked at a time, and of a piece when the place of damage is looked for.
PIECE, FINE = 1 << 16, 1 << 6
#: A head that has not ended after so many bytes is damaged.
HEAD_BYTES = 1 << 20
_LENGTH = re.compile(rb"(?i)\r\ncontent-length:[ \t]*(\d+)[ \t]*\r\n")
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"
RECORD_FIELDS = ["kind", "archive", "start", "stop", "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "reason"]
RECORD_SCHEMA = "kind string, archive string, start long, stop long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, reason string"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: each 10 hex digits are 40 bits, which are 8 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.lower(F.conv(F.substring(digest, at, 10), 16, 32)), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789abcdefghijklmnopqrstuv", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def packed(record: bytes) -> bytes:
    """A gzip member of a record that ends in a zero byte; a longer record has an empty member after it."""
    member = gzip.compress(record, 6, mtime=0)
    return member if member.endswith(b"\0") else member + gzip.compress(b"", 6, mtime=0)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of packed records, of a size or of one larger record each, without their last byte."""
    kind = pa.schema([("value", pa.binary())])
    out: list[bytes] = []
    held = 0
    for batch in batches:
        for head, body in zip(batch.column(0), batch.column(1), strict=True):
            member = packed(head.as_py() + body.as_py() + b"\r\n\r\n")
            if out and held + len(member) > size:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)[:-1]], pa.binary())], schema=kind)
                out, held = [], 0
            out.append(member)
            held += len(member)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)[:-1]], pa.binary())], schema=kind)


def write(pages: DataFrame, path: str, least: int = 0, block_bytes: int = BLOCK_BYTES) -> None:
    """WARC archives of pages (page_id, url, html) under path."""
    ship_package(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), F.regexp_replace(F.col("url"), r"[\s\p{Cntrl}]", "").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": base32_sha1(F.encode("html", "UTF-8")), "size": F.octet_length("html").cast("long")})
    slim = rows.where(F.col("page_id").isNotNull() & (F.col("size") >= least)).select("page_id", "digest")
    first = slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last").select("digest", "refers_to")
    again = slim.join(first, "digest").where("page_id <> refers_to").distinct()  # ids and digests only: page texts move once
    rows = rows.join(again, ["page_id", "digest"], "left")
    revisit = F.col("refers_to").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    body = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit(f"<{ID}"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", F.col("url"))).otherwise(F.lit("")),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", F.concat(F.lit(f"<{ID}"), F.col("refers_to").cast("string"), F.lit(">"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        F.lit("Content-Length: "),
        F.octet_length(body).cast("string"),
        F.lit(END),
    )
    parts = rows.select(F.encode(head, "UTF-8").alias("head"), F.encode(body, "UTF-8").alias("body"))
    blocks = parts.mapInArrow(lambda batches: _blocks(batches, block_bytes), "value binary")
    # the sink writes a string's bytes as they are
    blocks.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", FILE_BLOCKS).text(path)


def _gap(start: int, stop: int, reason: str) -> dict:
    return {"kind": "gap", "start": start, "stop": stop, "reason": reason}


def parse_record(data: bytes, at: int) -> tuple[dict | None, int, str]:
    """(record, end, "") of the record at a position; (None, end if known, else at, reason) if a check fails."""
    version = _VERSION.match(data, at)
    if not version:
        return None, at, "no version line"
    head_end = data.find(b"\r\n\r\n", at)
    if head_end < 0:
        return None, at, "head not ended"
    head: dict[str, str] = {}
    for text in data[version.end() : head_end].split(b"\r\n"):
        name, colon, value = text.partition(b":")
        if not colon:
            return None, at, "bad head line"
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = head.get("content-length", "")
    if not length.isdigit():
        return None, at, "no length"
    start, end = head_end + 4, head_end + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return None, at, "wrong length"
    body = data[start:end]
    http, mark, payload = body.partition(b"\r\n\r\n") if head.get("content-type", "").startswith("application/http") else (b"", b"", body)
    kind = head.get("warc-type", "")
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
    size = len(payload)
    if kind == "revisit":
        said = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        size = int(said[1]) if said else None
    elif digest and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        return None, end + 4, "wrong digest"
    number = lambda name: int(m[1]) if (m := re.fullmatch(rf"<{ID}(-?\d+)>", head.get(name, ""))) else None
    found = {"kind": "record", "start": at, "stop": end + 4, "page_id": number("warc-record-id"), "url": head.get("warc-target-uri"), "record_type": kind}
    found |= {"refers_to": number("warc-refers-to"), "payload_bytes": size, "payload_digest": digest or None, "payload": None if kind == "revisit" else payload}
    return found, end + 4, ""


def _heads(data: bytes, at: int) -> bool:
    """Whether a version line heads a sound record or, at the start of a line, one whose extent is sound."""
    record, end, _ = parse_record(data, at)
    return record is not None or (end > at and data[at - 1 : at] == b"\n")


def _wanted(data: bytes, at: int) -> int:
    """How long data must be for the record at a position to be judged."""
    if not _VERSION.match(data, at):
        return at + len(b"WARC/1.1\r\n")
    head_end = data.find(b"\r\n\r\n", at, at + HEAD_BYTES)
    if head_end < 0:
        return at + HEAD_BYTES
    length = _LENGTH.search(data, at, head_end + 2)
    return head_end + 8 + int(length[1]) if length else head_end


def _next_head(data: bytes, at: int, stop: int | None = None, whole: bool = True) -> int:
    """The next place from at to stop whose version line heads a record, or -1; unless data is whole, a record that goes on after it ends the search."""
    stop = len(data) if stop is None else stop
    follow = _VERSION.search(data, at, stop)
    while follow and not _heads(data, follow.start()):
        if not whole and _wanted(data, follow.start()) > len(data):
            return -1
        follow = _VERSION.search(data, follow.start() + 1, stop)
    return follow.start() if follow else -1


class Member:
    """A gzip member of data, unpacked in pieces; after the last piece, stop is where it ends, or reason says what is wrong."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.stop, self.reason = data, at, at, ""

    def pieces(self) -> Iterator[bytes]:
        """All plain bytes that can be had; the piece with the damage is taken again in finer steps."""
        view, unzip, pos, size = memoryview(self.data), zlib.decompressobj(31), self.at, PIECE
        while pos < len(view) and not unzip.eof:
            try:
                piece = unzip.decompress(view[pos : pos + size])
            except zlib.error as error:
                if size == 1:
                    self.reason = f"broken member: {error}"
                    return
                size = FINE if size == PIECE else 1
                unzip = zlib.decompressobj(31)  # a failed one is spent: unpack again up to here
                for back in range(self.at, pos, PIECE):
                    unzip.decompress(view[back : min(pos, back + PIECE)])
                continue
            pos += size
            if piece:
                yield piece
        if unzip.eof:
            self.stop = min(pos, len(view)) - len(unzip.unused_data)
        else:
            self.reason = "member cut short"

    def heads(self) -> bool:
        """Whether the member begins with a version line."""
        try:
            return _VERSION.match(zlib.decompressobj(31).decompress(memoryview(self.data)[self.at : self.at + PIECE], 64)) is not None
        except zlib.error:
            return False


def parse_pieces(pieces: Iterator[bytes]) -> Iterator[dict]:
    """Records and gaps of plain bytes that come in pieces; holds the record at hand, or a damaged stretch until the next record."""
    parts, size, base, need = [], 0, 0, 0
    for piece in pieces:
        parts.append(piece)
        size += len(piece)
        if size < need:
            continue
        data, at, need = b"".join(parts), 0, 0
        while at < size and not need:
            wanted = _wanted(data, at)
            if wanted > size:
                need = wanted
                break
            record, end, reason = parse_record(data, at)
            if end == at:
                end = _next_head(data, at + 1, whole=False)
                if end < 0:
                    need = size + max(PIECE, size - at)
                    break
            yield (record or _gap(at, end, reason)) | {"start": base + at, "stop": base + end}
            at = end
        parts, size, base, need = [data[at:]], size - at, base + at, need - at
    for x in parse_plain(b"".join(parts)):
        yield x | {"start": base + x["start"], "stop": base + x["stop"]}


def parse_plain(data: bytes) -> Iterator[dict]:
    """Records and gaps of plain bytes."""
    at = 0
    while at < len(data):
        record, end, reason = parse_record(data, at)
        if record:
            yield record
        else:
            if end == at:  # the length can't be trusted: the next version line that heads a record
                follow = _next_head(data, at + 1)
                end = follow if follow >= 0 else len(data)
            yield _gap(at, end, reason)
        at = end


def parse_archive(data: bytes) -> Iterator[dict]:
    """Records and gaps of an archive; whether a part is packed is seen at each position.

    Records and gaps inside a member start where it starts; the last of a sound member ends where it ends.
    """
    at = 0
    while at < len(data):
        if data.startswith(_MEMBER, at):
            member, last, gaps = Member(data, at), None, []
            for x in parse_pieces(member.pieces()):
                if x["kind"] == "gap":
                    gaps.append(x["reason"])
                    continue
                if last:
                    yield last
                last = x | {"start": at, "stop": at}
            if last:
                yield last | {"stop": member.stop}
            if not member.reason:
                yield from (_gap(at, member.stop, reason) for reason in gaps)
                at = member.stop
                continue
            reason = member.reason
        else:
            record, end, reason = parse_record(data, at)
            if end > at:
                yield record or _gap(at, end, reason)
                at = end
                continue
        stop = _next_part(data, at + 1)
        yield _gap(at, stop, reason)
        at = stop


def _next_part(data: bytes, at: int) -> int:
    """The next place from at on where a member with a record or a record itself begins, or the end."""
    packed_at = data.find(_MEMBER, at)
    while packed_at >= 0 and not Member(data, packed_at).heads():
        packed_at = data.find(_MEMBER, packed_at + 1)
    stop = packed_at if packed_at >= 0 else len(data)
    plain_at = _next_head(data, at, stop)
    return plain_at if plain_at >= 0 else stop


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps (kind) of all archives under path; payloads false leaves the payload column null."""
    ship_package(spark)
    schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in RECORD_SCHEMA.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows: list[dict] = []
                size = 0
                for x in parse_archive(content.as_py()):
                    size += len(x.get("payload") or b"")
                    rows.append(dict.fromkeys(RECORD_FIELDS) | x | {"archive": name} | ({} if payloads else {"payload": None}))
                    if len(rows) >= 2000 or size > 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(run, RECORD_SCHEMA)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of archives written to the shared folder and read back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, least)
    lost = F.concat_ws(" ", F.lit("quarantined:"), "archive", F.col("start").cast("string"), F.col("stop").cast("string"), "reason")
    records = read(spark, path, payloads=False).where(F.when(F.col("kind") == "gap", F.raise_error(lost).cast("boolean")).otherwise(F.lit(True)))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
