"""WARC: writing archives as one gzip stream a file, and the normaliser for such files.

``normalise`` inflates a monolithic archive once, as a stream, writes every record as a gzip member
of its own and, beside the archive, an offset index with a line a record. ``read`` gets records by
these offsets.

Files lie in a folder that all executors share and are opened through pyarrow's file systems, so
the folder may be local, HDFS or an object store. A task writes files of new names; only names that
reach the table of results count, so repeated tasks do no harm.

Cases: null payloads are empty, null URLs and ids are left out of the header and read as null;
control characters in URLs are percent-encoded; of records with equal payloads those with the
smallest id are responses, and all if every id is null; repeated rows of that id (ties) are all
responses; payloads of any length are written whole; an empty table gives no archives and no rows;
other columns of the pages, whatever their names, are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

_CHUNK = 1 << 20
#: Of a digest and an id in a broadcast table, with what holds them.
_COPY_BYTES = 128
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode().rstrip("=")


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if re.match(r"\w+:", uri) else (pafs.LocalFileSystem(), uri)


def record(page_id: int | None, url: str | None, payload: bytes, original: int | None, revisit: bool, date: str) -> tuple[bytes, bytes]:
    """Header and block of a response, or of a revisit that refers to the page ``original``. The
    HTTP header keeps the length of the whole payload in both."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{url}')}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_CONTROL.sub(lambda m: f'%{ord(m[0]):02X}', url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"X-Refers-To-Page-Id: {original}")
    head.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode(), block


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k.strip()}


def write_archives(pages: DataFrame, folder: str, level: int, rotate_mb: int, date: str) -> DataFrame:
    """(page_id, url, html binary, original, revisit) -> (archive, n_records), writing each
    archive as one gzip stream of at most about rotate_mb before compression."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        out = pack = name = None
        size = count = 0

        def close():
            out.write(pack.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], names=["archive", "n_records"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if out is None:
                    name, size, count = f"mono-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, pack = fs.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(level, zlib.DEFLATED, 31)
                page_id, url, html, original, revisit = row
                head, block = record(page_id, url, html or b"", original, revisit, date)
                for part in (head, block, b"\r\n\r\n"):
                    out.write(pack.compress(part))
                    size += len(part)
                count += 1
                if size >= rotate_mb << 20:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return pages.mapInArrow(run, "archive string, n_records long")


class Inflater:
    """A gzip file, of one member or many, read as one stream in bounded pieces."""

    def __init__(self, source):
        self.source, self.unpack, self.buffer = source, zlib.decompressobj(31), bytearray()
        self.rest = b""

    def more(self) -> bool:
        while True:
            if self.unpack.eof:
                self.rest = self.unpack.unused_data
                self.unpack = zlib.decompressobj(31)
            data = self.rest or self.source.read(_CHUNK)
            self.rest = b""
            got = self.unpack.decompress(data, _CHUNK)
            if not data and not got:
                return False
            self.rest = self.unpack.unconsumed_tail
            if self.unpack.eof:
                self.rest = b""
            if got:
                self.buffer += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with the mark; None at the end of the stream."""
        begin = 0
        while (at := self.buffer.find(mark, begin)) < 0:
            begin = max(0, len(self.buffer) - len(mark) + 1)
            if not self.more():
                if self.buffer.strip():
                    raise ValueError("the archive ends inside a header")
                return None
        got = bytes(self.buffer[: at + len(mark)])
        del self.buffer[: at + len(mark)]
        return got

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self.more():
                raise ValueError("the archive ends inside a record")
            got = bytes(self.buffer[: min(n, len(self.buffer))])
            del self.buffer[: len(got)]
            n -= len(got)
            yield got


def normalise_file(source, target, index, level: int) -> int:
    """One archive; returns its number of records. Index lines: offset, length, type, id, URI."""
    stream, offset, count = Inflater(source), 0, 0
    while (head := stream.until(b"\r\n\r\n")) is not None:
        head = head.lstrip(b"\r\n")
        f = fields(head)
        pack, size = zlib.compressobj(level, zlib.DEFLATED, 31), 0
        size += target.write(pack.compress(head))
        for part in stream.take(int(f["content-length"])):
            size += target.write(pack.compress(part))
        size += target.write(pack.compress(b"\r\n\r\n") + pack.flush())
        if b"".join(stream.take(4)) != b"\r\n\r\n":
            raise ValueError(f"no end of record {f.get('warc-record-id')}")
        line = (str(offset), str(size), f.get("warc-type", ""), f.get("warc-record-id", ""), f.get("warc-target-uri", ""))
        index.write(("\t".join(line) + "\n").encode())
        offset += size
        count += 1
    return count


def normalise(archives: DataFrame, source_folder: str, folder: str, level: int) -> DataFrame:
    """(archive, n_records) -> (archive, index, n_records) of the normalised files in folder."""

    def run(batches):
        fs, base = open_fs(folder)
        from_fs, from_base = open_fs(source_folder)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            for archive, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name = f"members-{uuid.uuid4().hex}.warc.gz"
                with from_fs.open_input_stream(f"{from_base}/{archive}", compression=None) as source, fs.open_output_stream(
                    f"{base}/{name}", compression=None
                ) as target, fs.open_output_stream(f"{base}/{name}.idx") as index:
                    count = normalise_file(source, target, index, level)
                if count != n:
                    raise ValueError(f"{archive} has {count} of {n} records")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([f"{name}.idx"]), pa.array([count], pa.int64())], names=["archive", "index", "n_records"]
                )

    return archives.mapInArrow(run, "archive string, index string, n_records long")


def read(archives: DataFrame, folder: str, rows: int = 200) -> DataFrame:
    """(archive, index) -> a row a record: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to. Every record is read at its offset, as a member of its own; the digest
    of a response is computed from its payload and must be that of its header."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def parse(member: bytes) -> tuple:
        data = zlib.decompress(member, 31)
        head, _, rest = data.partition(b"\r\n\r\n")
        f = fields(head)
        block = rest[: int(f["content-length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        kind, told = f["warc-type"], f["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and digest(payload) != told:
            raise ValueError(f"digest of {f.get('warc-record-id')}")
        size = int(fields(http)["content-length"])
        number = lambda k: int(f[k]) if k in f else None
        return number("x-page-id"), f.get("warc-target-uri"), size, told, kind, number("x-refers-to-page-id")

    def run(batches):
        fs, base = open_fs(folder)
        for batch in batches:
            for archive, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_stream(f"{base}/{index}") as lines:
                    at = [tuple(map(int, x.split(b"\t", 2)[:2])) for x in lines.read().split(b"\n") if x]
                with fs.open_input_file(f"{base}/{archive}") as f:
                    for i in range(0, len(at), rows):
                        got = [parse(f.read_at(size, offset)) for offset, size in at[i : i + rows]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got), kinds)], names=names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return archives.mapInArrow(run, schema)


def mark_revisits(pages: DataFrame, scratch: Scratch, least_bytes: int = 0, broadcast_mb: int = 64) -> DataFrame:
    """(page_id, url, html) -> with original, the smallest id of equal payloads, and revisit.

    Digests and ids alone are grouped. Payloads that occur more than once are few next to the pages;
    their table is sent to every task, so that html stays where it is read. Beyond broadcast_mb,
    the pages meet it by digest."""
    html = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit("").cast("binary"))
    pages = pages.select("page_id", "url", html.alias("html"), F.unhex(F.sha2(html, 256)).alias("sum"))
    groups = pages.where(F.octet_length("html") >= least_bytes).groupBy("sum")
    copies = groups.agg(F.min("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").select("sum", "original")
    copies = scratch.save(copies, "copies")
    if copies.count() * _COPY_BYTES <= broadcast_mb << 20:
        copies = F.broadcast(copies)
    joined = pages.join(copies, "sum", "left")
    revisit = F.coalesce(F.col("page_id").isNull() | (F.col("page_id") > F.col("original")), F.lit(False)) & F.col("original").isNotNull()
    return joined.select("page_id", "url", "html", "original", revisit.alias("revisit"))


def archive(
    pages: DataFrame, least_bytes: int = 0, level: int = 5, rotate_mb: int = 64, date: str = "2024-01-01T00:00:00Z"
) -> tuple[DataFrame, str]:
    """Write all pages and normalise the archives: the table of archives and their folder."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    mono, members = scratch.path("mono"), scratch.path("members")
    written = scratch.save(write_archives(mark_revisits(pages, scratch, least_bytes), mono, level, rotate_mb, date), "written")
    n = written.count()
    spread = written.repartition(max(1, n), "archive") if n else written
    done = scratch.save(normalise(spread, mono, members, level), "done")
    scratch.drop("mono")
    return done, members


def query(pages: DataFrame) -> DataFrame:
    done, folder = archive(pages)
    n = done.count()
    found = read(done.repartition(max(1, n), "archive"), folder)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (SELECT html, min(page_id) AS original FROM p GROUP BY html),
h AS (SELECT page_id, original, strlen(p.html) AS n, sha1(p.html) AS x FROM p JOIN m ON p.html = m.html),
d AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(x, CAST(5 * i + 1 AS INTEGER), 5) AS BIGINT)) AS v FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(v, lambda q: array_to_string(list_transform([15, 10, 5, 0],
         lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((q >> s) & 31) + 1 AS INTEGER), 1)), '')), '') AS payload_digest,
       CASE WHEN page_id > original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > original THEN original END AS refers_to
FROM d
"""
