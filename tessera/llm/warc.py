"""WARC archives: a writer and a splittable reader.

Writing. Every page becomes one WARC/1.1 record in a gzip member of its own.
Tasks build archives of bounded size as single cells, which Spark's own file
writer stores, so a repeated or speculative task leaves one committed copy.
That writer ends every cell with a separator; here it is an empty gzip member,
which any reader of multi-member gzip skips.

Reading. Archives are cut into byte ranges without regard to records. A task
scans its range for the gzip magic. A candidate counts once its member
inflates to a record whose header decodes; then the task owns it, and reads on
past the end of its range to finish it. Magic bytes inside compressed data
fail that test and cost a few inflated bytes.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, shared_dir

MAGIC = b"\x1f\x8b\x08"
#: A gzip member without content.
EMPTY_MEMBER = MAGIC + bytes(6) + b"\x03" + b"\x03\x00" + bytes(8)
VERSION = b"WARC/1.1\r\n"
LEAST_PAYLOAD = 100


class Record(NamedTuple):
    offset: int
    headers: dict[str, str]
    block: bytes


def _member(text: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(text) + packer.flush()


def _line(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, response: int | None) -> bytes:
    """One record; ``response`` is the page that a revisit refers to."""
    fields = [
        ("WARC-Type", "response" if response is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Payload-Length", str(len(payload))),
        ("Content-Type", "text/html; charset=utf-8"),
    ]
    if url is not None:
        fields.insert(2, ("WARC-Target-URI", _line(url)))
    if response is not None:
        fields += [
            ("WARC-Refers-To", f"<urn:page:{response}>"),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ]
    block = payload if response is None else b""
    fields.append(("Content-Length", str(len(block))))
    head = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    return VERSION + head + b"\r\n" + block + b"\r\n\r\n"


def _archives(limit: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "response")]
            for page, url, html, digest, response in zip(*columns, strict=True):
                member = _member(record_bytes(page, url, html or b"", digest, response), level)
                held.append(member)
                size += len(member)
                if size >= limit:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])

    return run


def write_warc(pages: DataFrame, path: str, *, limit: int = 8 << 20, level: int = 1) -> None:
    """Write one record for each row of ``pages`` (page_id, url, html) below ``path``.

    The payload is the html in UTF-8, null as empty. Of records with equal
    payloads of at least 100 bytes the one with the smallest page_id is the
    response and the others are revisits of it; shorter payloads, rows without
    page_id and rows that repeat the smallest page_id are responses. Other
    columns are ignored. ``limit`` is the size of a cell, of which a file may
    hold several.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html")
    ).withColumn("digest", F.sha2("html", 256))
    keyed = rows.where((F.length("html") >= LEAST_PAYLOAD) & F.col("page_id").isNotNull()).select("page_id", "digest")
    # a digest's smallest page, with the few pages that have to refer to it
    least = keyed.groupBy("digest").agg(F.min("page_id").alias("response"), F.max("page_id").alias("most"))
    least = least.where("response <> most").drop("most")
    revisits = keyed.join(least, "digest").where("page_id <> response").distinct()
    joined = rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "response")
    cells = joined.mapInArrow(_archives(limit, level), "archive binary")
    # the text writer stores a string's bytes as they are
    (
        cells.select(F.col("archive").cast("string").alias("value")).write.mode("overwrite")
        .option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)
    )


# --- reading -----------------------------------------------------------------


def _parse(text: bytes) -> tuple[dict[str, str], int] | None:
    """Header fields of a record and where its block begins; None if this is no record."""
    if not text.startswith(VERSION):
        return None
    end = text.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in text[len(VERSION) : end].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    return (fields, end + 4) if fields.get("content-length", "").isdigit() else None


class _Window:
    """Bytes of a file from a moving position on, read in blocks; what lies behind goes now and then, not at each step."""

    def __init__(self, source, size: int, at: int, block: int):
        self.source, self.size, self.block = source, size, block
        self.at = self.base = at
        self.data = bytearray()

    @property
    def end(self) -> int:
        return self.base + len(self.data)

    def fill(self, upto: int) -> None:
        """Hold all bytes before ``upto``, as far as the file goes."""
        while self.end < min(upto, self.size):
            self.source.seek(self.end)
            more = self.source.read(min(self.block, self.size - self.end))
            if not more:
                break
            self.data += more

    def drop(self, before: int) -> None:
        self.at = before
        if before - self.base >= self.block:
            del self.data[: before - self.base]
            self.base = before

    def part(self, start: int, stop: int) -> bytes:
        """Bytes by their distance from the position."""
        lo = self.at - self.base
        return bytes(self.data[lo + start : lo + stop])


def scan_range(source, size: int, start: int, stop: int, block: int = 1 << 20) -> Iterator[Record]:
    """The records whose gzip member begins in [start, stop) of a seekable file."""
    window, at = _Window(source, size, start, block), start
    while at < stop:
        window.fill(at + len(MAGIC))
        found = window.data.find(MAGIC, at - window.base)
        if found < 0:
            at = max(at, window.end - len(MAGIC) + 1)
            if at + len(MAGIC) > size:
                return
            window.drop(at)
            window.fill(at + block)
            continue
        at = window.base + found
        if at >= stop:
            return
        window.drop(at)
        text, end = _inflate(window)
        parsed = _parse(text) if text is not None else None
        if parsed is None:
            at += 1 if end is None else end - at  # a member without a record is passed as a whole
            continue
        fields, body = parsed
        length = int(fields["content-length"])
        if end is None or len(text) < body + length:
            raise ValueError(f"record at {at} is cut off")
        yield Record(at, fields, text[body : body + length])
        at = end


def _inflate(window: _Window) -> tuple[bytes | None, int | None]:
    """The member at the window's position and the offset of its end; (None, None) if there is none.

    The first bytes decide: a member whose text can't begin a record is given
    up early, unless it ends at once. Pieces grow, so that what is read beyond
    the end of a member is no more than the member itself.
    """
    engine, parts, used, first, step = zlib.decompressobj(31), [], 0, True, 512
    while True:
        if window.at + used >= window.end:
            held = window.end
            window.fill(held + 1)
            if window.end == held:
                return b"".join(parts), None
        piece = window.part(used, used + step)
        try:
            parts.append(engine.decompress(piece))
        except zlib.error:
            return None, None
        used += len(piece) - len(engine.unused_data)
        if engine.eof:
            return b"".join(parts), window.at + used
        got = b"".join(parts)[: len(VERSION)] if first else VERSION
        if not VERSION.startswith(got):
            return None, None
        first = first and len(got) < len(VERSION)
        step = min(2 * step, window.block)


def _open(path: str):
    fs, name = pyarrow.fs.FileSystem.from_uri(path)
    return fs.open_input_file(name)


FOUND = "path string, offset long, headers map<string,string>, block binary"


def read_warc(spark: SparkSession, path: str, *, range_bytes: int = 4 << 20) -> DataFrame:
    """path, offset, headers and block of every record of the ``.warc``-like files below ``path``.

    Files are listed by Spark and read by ranges of ``range_bytes`` through
    pyarrow's file systems (local, HDFS, S3, GCS); the folder may live in any of these.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    ranges = files.where("length > 0").select(
        "path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start")
    )
    ranges = ranges.repartition(4 * partitions(spark), "path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _open(row["path"]) as source:
                    held, size = [], 0
                    for r in scan_range(source, row["length"], row["start"], row["start"] + range_bytes):
                        held.append((row["path"], r.offset, list(r.headers.items()), r.block))
                        size += len(r.block)
                        if size > 1 << 23:
                            yield _records(held)
                            held, size = [], 0
                    if held:
                        yield _records(held)

    return ranges.mapInArrow(run, FOUND)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    path, offset, headers, block = zip(*rows, strict=True)
    kinds = [pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip((path, offset, headers, block), kinds, strict=True)], ["path", "offset", "headers", "block"]
    )


def pages_of(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of WARC records.

    Length and digest of a response are taken from its block as read; a
    mismatch with its header raises. A revisit has them in its header.
    """
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string()}

    def number(value: str) -> int | None:
        inner = value.removeprefix("<urn:page:").removesuffix(">")
        return int(inner) if inner else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for headers, block in zip(batch.column("headers").to_pylist(), batch.column("block").to_pylist(), strict=True):
                h = dict(headers)
                digest, size, kind = h["warc-payload-digest"].removeprefix("sha256:"), int(h["warc-payload-length"]), h["warc-type"]
                if kind == "response" and (len(block) != size or hashlib.sha256(block).hexdigest() != digest):
                    raise ValueError(f"payload of {h['warc-record-id']} differs from its header")
                url = h.get("warc-target-uri")
                refers = number(h["warc-refers-to"]) if kind == "revisit" else None
                out.append((number(h["warc-record-id"]), size, digest, kind, refers, None if url is None else unquote(url)))
            columns = zip(*out, strict=True) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))

    spec = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    return records.mapInArrow(run, spec)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as WARC archives to the shared folder, and describe every record as read back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc"
    write_warc(pages, path)
    return pages_of(read_warc(spark, path)).drop("url")
