"""WARC archives: written with one gzip member for each record, read back sequentially.

Writing: payloads are addressed by SHA-1; of equal payloads the row with the smallest id is a response
record, the others revisit it. Which row that is gets settled on narrow rows, counted before they are
shuffled; the payloads then meet their decision by a join on the row's own id. Every task writes
archives of bounded size to the shared folder. Files have names of their own for each attempt, and the table
of the finished ones is written by Spark, which takes each task once: files of a lost or repeated
attempt are never read.

Reading: an archive is a stream of gzip members. The reader inflates it piece by piece, a new
decompressor for each member, takes header lines up to the empty line, then exactly Content-Length
bytes of block and the two line ends, and compares block and payload with their digests. Nothing but
the record at hand is in memory, and damage is reported with the place where it stands.

Defined results: a null payload is empty; a null target has no WARC-Target-URI; rows with equal ids and
payloads are one response and its revisits only once (equal rows stay equal records); a null id sorts
after all others; an empty table makes no archive; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, new_folder

# Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Bytes of compressed archive after which a task begins another one.
ARCHIVE_BYTES = 64 << 20
_READ_BYTES = 1 << 16


class DamagedArchive(ValueError):
    """The archive does not hold what its framing or digests say."""


def payload_digest(payload: bytes) -> str:
    """Base32 SHA-1, upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes = b""
    fields: dict[str, str] = field(default_factory=dict)

    @property
    def payload(self) -> bytes:
        """The block after its HTTP header."""
        return self.block.partition(b"\r\n\r\n")[2]


def _fields(lines: list[bytes]) -> dict[str, str]:
    found = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise DamagedArchive(f"no header field: {line[:60]!r}")
        found[name.strip().decode().lower()] = value.strip().decode()
    return found


def record_id(page_id: str) -> str:
    return f"<urn:page:{page_id}>"


def record_bytes(page_id: str, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One uncompressed record. A revisit keeps the HTTP header, with the payload's length, and no payload."""
    digest = payload_digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{payload_digest(block)}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        # Line ends cannot stand in a header.
        lines.append(f"WARC-Target-URI: {''.join(url.splitlines())}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


class SequentialReader:
    """Records of one archive in their order."""

    def __init__(self, stream: BinaryIO, verify: bool = True):
        self.stream = stream
        self.verify = verify
        self.at = 0  # compressed bytes taken by finished members
        self._ahead = b""

    def _inflated(self) -> Iterator[bytes]:
        """Pieces of the member that begins here; its end leaves the next one's bytes in ``_ahead``."""
        inflate = zlib.decompressobj(31)
        taken = 0
        while not inflate.eof:
            data = inflate.unconsumed_tail or self._ahead or self.stream.read(_READ_BYTES)
            if not inflate.unconsumed_tail:
                self._ahead = b""
                taken += len(data)
            if not data:
                raise DamagedArchive(f"the member at byte {self.at} is cut off")
            try:
                yield inflate.decompress(data, _READ_BYTES)
            except zlib.error as error:
                raise DamagedArchive(f"the member at byte {self.at} does not inflate: {error}") from error
        self._ahead = inflate.unused_data
        self.at += taken - len(inflate.unused_data)

    def __iter__(self) -> Iterator[Record]:
        while True:
            if not self._ahead:
                self._ahead = self.stream.read(_READ_BYTES)
            if not self._ahead:
                return
            yield self._record()

    def _record(self) -> Record:
        pieces, held = self._inflated(), bytearray()
        begun = self.at
        end = -1
        while end < 0:
            piece = next(pieces, None)
            if piece is None:
                raise DamagedArchive(f"the record at byte {begun} has no end of header")
            before = max(0, len(held) - 3)
            held += piece
            end = held.find(b"\r\n\r\n", before)
        first, *lines = bytes(held[:end]).split(b"\r\n")
        if first != VERSION:
            raise DamagedArchive(f"the record at byte {begun} begins with {first[:20]!r}")
        headers = _fields(lines)
        length = int(headers["content-length"])
        del held[: end + 4]
        for piece in pieces:
            held += piece
            if len(held) > length + 4:
                break
        if len(held) != length + 4 or held[length:] != b"\r\n\r\n":
            raise DamagedArchive(f"the record at byte {begun} does not have {length} bytes of content")
        for _ in pieces:  # the member's end, which holds its check sum
            raise DamagedArchive(f"the record at byte {begun} goes on after its end")
        record = Record(headers, bytes(held[:length]))
        header = record.block.partition(b"\r\n\r\n")[0].split(b"\r\n")
        record.fields = _fields(header[1:])
        if self.verify:
            self._compare(headers.get("warc-block-digest"), record.block, begun)
            if headers["warc-type"] == "response":
                self._compare(headers.get("warc-payload-digest"), record.payload, begun)
        return record

    @staticmethod
    def _compare(named: str | None, data: bytes, begun: int) -> None:
        if named is not None and named != f"sha1:{payload_digest(data)}":
            raise DamagedArchive(f"the record at byte {begun} does not have the digest {named}")


def _open(path: str, write: bool):
    """A stream of a file in the shared folder, which any task can open by its address."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    if write:
        system.create_dir(place.rsplit("/", 1)[0], recursive=True)
        return system.open_output_stream(place)
    return system.open_input_stream(place)


def _decided(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """id, url, html and refers_to: null for response records. Runs a job."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("id"),
        F.col(url_col).cast("string").alias("url"),
        html.alias("html"),
        F.unhex(F.sha1(html)).alias("digest"),
        F.octet_length(html).alias("n"),
    )
    # The rows that revisit: id and digest of all but the first of each digest.
    narrow = cut_lineage(rows.filter(F.col("n") >= least).select("id", "digest"))
    firsts = cut_lineage(narrow.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1"))
    revisits = narrow.join(firsts, "digest").filter(~F.col("id").eqNullSafe(F.col("first")))
    revisits = cut_lineage(revisits.select("id", "digest", "first").distinct())
    right = revisits.select(F.col("id").alias("own"), F.col("digest").alias("same"), F.col("first").alias("refers_to"))
    # A null id and an empty one are different rows.
    same_row = (F.col("digest") == F.col("same")) & F.col("id").eqNullSafe(F.col("own"))
    return rows.join(right, same_row, "left").select("id", "url", "html", "refers_to")


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme and host of the file system that Spark takes it to be in, so that every task opens the same one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write a record for every row and return the table of archives: path, n_records, n_bytes. Runs jobs.

    Payloads under ``least_bytes`` are responses whether or not they repeat. All records bear ``date``,
    so that equal rows make equal archives. A payload too large for a task's memory cannot be a row.
    """
    folder = _qualified(pages.sparkSession, folder or new_folder(pages.sparkSession, "warc"))
    decided = _decided(pages, id_col, url_col, html_col, least_bytes)
    return cut_lineage(decided.mapInArrow(_writer(folder, date, archive_bytes), "path string, n_records long, n_bytes long"))


def _writer(folder: str, date: str, limit: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, records, size = None, "", 0, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"path": path, "n_records": records, "n_bytes": size}])

        try:
            for batch in batches:
                for page, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None:
                        path, records, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = _open(path, write=True)
                    name = "" if page is None else str(page)
                    target = None if refers_to is None else str(refers_to)
                    member = gzip_member(record_bytes(name, url, html.encode(), target, date))
                    out.write(member)
                    records, size = records + 1, size + len(member)
                    if size >= limit:
                        out.close()
                        out = None
                        yield row()
        finally:
            if out is not None:
                out.close()
        if out is not None:
            yield row()

    return run


READ_SCHEMA = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def read_archives(archives: DataFrame, payloads: bool = False, verify: bool = True) -> DataFrame:
    """Every record of the archives, read one after the other: one archive is one row of a task's input.

    ``payload_bytes`` and ``payload_digest`` are those of the full payload; a revisit states them in its
    headers. With ``payloads`` the column ``payload`` follows (null for revisits).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with _open(path, write=False) as stream:
                    for record in SequentialReader(stream, verify):
                        row = _summary(record)
                        if payloads:
                            row["payload"] = record.payload if row["record_type"] == "response" else None
                            held += len(row["payload"] or b"")
                        rows.append(row)
                        if len(rows) >= 5000 or held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    fields = [(n, pa.int64() if n == "payload_bytes" else pa.string()) for n in names]
    schema = pa.schema([*fields, ("payload", pa.binary())] if payloads else fields)
    # Archives are few and large: each is dealt to a task of its own.
    paths = archives.select("path")
    spread = paths.repartition(max(1, archives.count()), "path")
    return spread.mapInArrow(run, READ_SCHEMA + (", payload binary" if payloads else ""))


def _summary(record: Record) -> dict:
    h = record.headers
    named = h["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")
    target = h.get("warc-refers-to")
    return {
        "page_id": named or None,
        "url": h.get("warc-target-uri"),
        "payload_bytes": len(record.payload) if h["warc-type"] == "response" else int(record.fields["content-length"]),
        "payload_digest": h["warc-payload-digest"].removeprefix("sha1:"),
        "record_type": h["warc-type"],
        "refers_to": target and target.removeprefix("<urn:page:").removesuffix(">"),
    }
