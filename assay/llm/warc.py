"""WARC archives: a writer with revisit records and a sequential reader.

Each record is one gzip member. The reader holds one record at a time: it inflates a
member piece by piece, frames the block by Content-Length and hashes it as it passes.

Archives are written and read by Spark's own sources, so they can be in any store that Spark reaches, and a task that is
lost leaves none behind. The text sink ends every row with a separator; here that is the byte 0, and a row is a number of
whole members without the last byte, which is 0: the high byte of the length that ends a gzip member.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, batches
from .sieve import sieved

CHUNK = 1 << 16
ROW, ROWS = 4 << 20, 8  # compressed bytes after which a row ends, and rows after which a new archive begins
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = "record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, valid boolean"


class WarcError(ValueError):
    """An archive that breaks the framing or a digest."""


def _b32(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def record(page_id, url: str | None, payload: bytes | None, size: int, sha1: str, refers_to=None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC record: a response, or without ``payload`` a revisit, which tells its length and digest only.

    A response's id is made of the page's id and the payload, so that revisits can name it; a revisit's is unique.
    """
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if payload is None else http + payload
    own = "" if payload is not None else f":{uuid.uuid4().hex}"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}:{sha1}{own}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}:{sha1}>"]
    head += [f"WARC-Payload-Digest: {_b32(bytes.fromhex(sha1))}", f"WARC-Block-Digest: {_b32(hashlib.sha1(block).digest())}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """One gzip member."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _members(level: int):
    """Rows of whole gzip members, one a record, without the last byte."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in it:
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "html", "size", "sha1", "refers_to"))
            for page, url, html, n, sha1, refers in zip(*columns, strict=True):
                payload = None if html is None else html.encode()
                held.append(member(record(page, url, payload, len(payload) if payload is not None else n, sha1 or hashlib.sha1(payload).hexdigest(), refers), level))
                size += len(held[-1])
                if size >= ROW:
                    yield _row(held)
                    held, size = [], 0
        if held:
            yield _row(held)

    return run


def _row(members: list[bytes]) -> pa.RecordBatch:
    if members[-1][-1]:  # a record of 16 MB and more: an empty member ends the row
        members.append(member(b""))
    return pa.RecordBatch.from_arrays([pa.array([b"".join(members)[:-1]], pa.binary())], names=["value"])


def write(pages: DataFrame, folder: str, least: int = 1000, level: int = 6) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) to archives in ``folder``.

    Of records with equal payloads of at least ``least`` bytes, those with the largest page_id
    are responses and the others revisits of it. A null html is an empty payload; a null page_id is the
    smallest; rows that repeat both page_id and payload are all responses, and as equal records share their record's id. A URL may be
    of any length.

    Which rows are revisits is told from lengths and digests; a revisit's payload is not moved, and of other
    payloads only those are whose page_id may be that of a revisit.
    """
    batches(pages.sparkSession)
    scratch = Scratch(pages.sparkSession, "warc-revisits")
    rows = pages.select("page_id", F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    light = rows.select("page_id", "url", F.octet_length("html").cast("long").alias("size"), F.sha1(F.col("html").cast("binary")).alias("sha1")).where(F.col("size") >= least)
    targets = scratch.save(light.groupBy("sha1").agg(F.max("page_id").alias("target"), F.count("*").alias("n")).where("n > 1 and target is not null").drop("n"), "targets")
    revisits = scratch.save(light.join(targets, "sha1").where(~F.col("page_id").eqNullSafe(F.col("target"))), "revisits")
    maybe, no = sieved(rows, "page_id", revisits, scratch, "revisited")
    pairs = revisits.select(F.col("page_id").alias("p"), F.col("sha1").alias("s"), "size").distinct()
    again = F.col("page_id").eqNullSafe(F.col("p")) & (F.octet_length("html") == F.col("size")) & (F.sha1(F.col("html").cast("binary")) == F.col("s"))
    responses = no.union(maybe.join(pairs, again, "left_anti")).select("page_id", "url", "html", F.lit(None).cast("long").alias("size"), F.lit(None).cast("string").alias("sha1"), F.lit(None).cast("string").alias("refers_to"))
    told = revisits.select("page_id", "url", F.lit(None).cast("string").alias("html"), "size", "sha1", F.col("target").cast("string").alias("refers_to"))
    packed = responses.union(told).mapInArrow(_members(level), "value binary")
    packed.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", ROWS).mode("overwrite").text(folder)
    scratch.drop("targets", "revisits", "revisited")


class Members:
    """The bytes of one archive, gzip member by gzip member."""

    def __init__(self, stream):
        self.stream, self.held = stream, b""

    def __iter__(self) -> Iterator[Inflated]:
        while True:
            if not self.held:
                self.held = self.stream.read(CHUNK)
            if not self.held:
                return
            part = Inflated(self)
            yield part
            part.finish()


class Inflated:
    """One member, inflated as it is read."""

    def __init__(self, members: Members):
        self.members, self.z, self.data, self.pending = members, zlib.decompressobj(31), b"", False

    def more(self) -> bool:
        if self.z.eof:
            return False
        m = self.members
        if not m.held and not self.pending:
            m.held = m.stream.read(CHUNK)
            if not m.held:
                raise WarcError("the archive ends inside a gzip member")
        try:
            new = self.z.decompress(m.held, CHUNK)
        except zlib.error as e:
            raise WarcError(f"not a gzip member: {e}") from e
        self.data += new
        self.pending = len(new) == CHUNK  # there may be more without more input
        m.held = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        """What comes before the mark, however long; the mark is looked for in what is new."""
        seen = 0
        while (at := self.data.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.data)
            if not self.more():
                raise WarcError("a header does not end")
        head, self.data = self.data[:at], self.data[at + len(mark) :]
        return head

    def take(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes, in pieces."""
        while n:
            if not self.data and not self.more():
                raise WarcError("a block is shorter than its Content-Length")
            piece, self.data = self.data[:n], self.data[n:]
            n -= len(piece)
            yield piece

    def finish(self) -> None:
        while self.more():
            pass
        if self.data:
            raise WarcError("a member holds more than its record")


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def records(stream, payload: bool = False) -> Iterator[dict]:
    """The records of an archive; raises :class:`WarcError` where framing breaks, and marks digests that differ as not valid."""
    for part in Members(stream):
        if not part.more() or (part.z.eof and not part.data):
            continue  # an empty member
        head = part.until(b"\r\n\r\n")
        if not head.startswith(b"WARC/"):
            raise WarcError("a record does not begin with WARC/")
        h = _headers(head)
        left = int(h["content-length"])
        block, body, kept, size = hashlib.sha1(), hashlib.sha1(), [], 0
        http: dict[str, str] | None = None
        start = b""
        for piece in part.take(left):
            block.update(piece)
            if http is None:
                start += piece
                if b"\r\n\r\n" not in start:
                    continue
                first, _, piece = start.partition(b"\r\n\r\n")
                http = _headers(first)
            body.update(piece)
            size += len(piece)
            if payload:
                kept.append(piece)
        if b"".join(part.take(4)) != b"\r\n\r\n":
            raise WarcError("a record does not end with two line ends")
        digest = h.get("warc-payload-digest", "")
        revisit = h["warc-type"] == "revisit"
        valid = h.get("warc-block-digest", _b32(block.digest())) == _b32(block.digest()) and (revisit or digest in ("", _b32(body.digest())))
        told = base64.b32decode(digest.removeprefix("sha1:")).hex() if digest else None
        yield {
            "record_type": h["warc-type"], "record_id": h.get("warc-record-id"), "target_uri": h.get("warc-target-uri"), "refers_to": h.get("warc-refers-to"),
            "payload_bytes": int((http or {}).get("content-length", size)) if revisit else size, "payload_digest": told if revisit else body.hexdigest(), "valid": valid,
        } | ({"payload": b"".join(kept)} if payload else {})


def _read(payload: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = (16 << 20) if payload else (1 << 62)
        for batch in it:
            for content in batch.column("content"):
                held, size = [], 0
                for r in records(pa.BufferReader(content.as_buffer()), payload):
                    held.append(r)
                    size += r["payload_bytes"]
                    if len(held) == 1000 or size > limit:
                        yield pa.RecordBatch.from_pylist(held, schema=_schema(payload))
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=_schema(payload))

    return run


def _schema(payload: bool) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [(n, kinds[t]) for n, t in (f.split() for f in FIELDS.split(", "))]
    return pa.schema(fields + ([("payload", pa.binary())] if payload else []))


def read(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """All records of the archives in ``folder``; no folder or an empty one: no records. An archive is one row while it is read, so one of 2 GB or more is an error; :func:`write` makes smaller ones."""
    batches(spark)
    archives = spark.read.format("binaryFile").load(folder).where("length > 0").select("content")
    return archives.mapInArrow(_read(payload), FIELDS + (", payload binary" if payload else ""))


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write ``pages`` as WARC archives in the shared folder and read them back.

    Returns a row per input row: page_id, payload_bytes and payload_digest (bare lower-case hex SHA-1) of the full
    payload, record_type (response or revisit), refers_to (for revisits the response's page_id).
    See :func:`write` for nulls and repeated rows; empty table: no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    folder = f"{scratch.path}/archives"
    write(pages, folder, least)
    scratch.names.append("archives")
    found = read(spark, folder)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:([^:]*):', 1) as bigint)")
    checked = F.when(F.col("valid"), F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("digest differs: "), "record_id")))
    return scratch.result(found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", checked.alias("record_type"), number("refers_to").alias("refers_to")))
