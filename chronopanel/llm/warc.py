"""WARC archives, and a normaliser for those that are one gzip stream as a whole.

:func:`write_archives` writes pages as WARC records into files that are compressed as a whole, each by one task and of a
bounded size. :func:`normalise` inflates each such stream once, writes every record as a gzip member of its own and an index
of the members' offsets beside them; :func:`read_archives` seeks each member by the index and parses it. A stream that ends within a member or
a record raises, as does an archive of another number of records than was written. Files appear under their
names only when complete, and names don't depend on the attempt, so tasks can be run again. They go to a folder that all
executors share.

Of records with equal payloads of at least ``min_bytes``, the one with the largest id is a response and the others revisit
it; all others are responses.

Nulls, ties, and so on: a null text is an empty payload; a null URL leaves its header out; a null id never is the
response that others revisit, unless its group has no other; pages with equal ids and payloads are all responses or all
revisits; a text of any length is one record, which its task holds; an empty table gives no archives and an empty result; other columns
don't matter, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.shared import joined_by_group
from chronopanel.sources.files import remove
from chronopanel.sources.tables import shared_path, temporary, written

#: Uncompressed bytes of an archive, after which the next begins.
ARCHIVE_BYTES = 32_000_000
READ_BYTES = 1 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# Names of one kind of storage for another, as Spark and Arrow have them.
SCHEMES = {"s3a": "s3", "s3n": "s3", "s3": "s3", "gs": "gs", "hdfs": "hdfs", "viewfs": "viewfs", "abfs": "abfs", "abfss": "abfss"}


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """What holds a path or URI, and the path there. A scheme that isn't known raises: its files would land on a local disk."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    if scheme == "dbfs":  # mounted on every machine
        return fs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    if scheme not in SCHEMES:
        raise ValueError(f"no file system for {scheme}:")
    if not rest.startswith("//"):  # without an authority: the default one
        rest = f"//default/{rest.lstrip('/')}"
    return fs.FileSystem.from_uri(f"{SCHEMES[scheme]}:{rest}")


class Output:
    """A file that gets its name when it's closed."""

    def __init__(self, path: str):
        self.fs, self.path = file_system(path)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.unfinished = f"{self.path}.{uuid.uuid4().hex}.unfinished"
        self.stream = self.fs.open_output_stream(self.unfinished, compression=None)

    def close(self) -> None:
        self.stream.close()
        self.fs.move(self.unfinished, self.path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit where refers_to is given: it has the digest and length of the payload but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        *([] if url is None else [f"WARC-Target-URI: {quote(url, safe='%:/?#[]@!$&()*+,;=~')}"]),
        *([] if refers_to is None else [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    """Fields by lower-case name; continuation lines are joined."""
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if _}


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated stream, each with the blank lines that end it."""
    held = bytearray()
    ended = False

    def more() -> bool:
        nonlocal ended
        chunk = next(chunks, None)
        ended = chunk is None
        held.extend(chunk or b"")
        return not ended

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("the archive ends within a header")
                return
        need = end + 4 + int(headers(bytes(held[:end]))["content-length"]) + 4
        while len(held) < need:
            if not more():
                raise ValueError("the archive ends within a record")
        yield bytes(held[:need])
        del held[:need]


def inflate(stream) -> Iterator[bytes]:
    """What a gzip stream of one or more members holds, piece by piece. A stream that ends within a member raises."""
    member, begun = zlib.decompressobj(31), False
    while data := stream.read(READ_BYTES):
        while data:
            begun = True
            yield member.decompress(data, READ_BYTES * 4)
            while member.unconsumed_tail:
                yield member.decompress(member.unconsumed_tail, READ_BYTES * 4)
            data = member.unused_data
            if not member.eof:
                break
            member, begun = zlib.decompressobj(31), False
    if begun:
        raise ValueError("the archive ends within a gzip member")


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write rows (page_id, url, html, refers_to) as records into whole-file streams; per archive: path, records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), []
        out = packer = None
        size = count = 0

        def finish():
            out.stream.write(packer.flush())
            out.close()
            made.append((out_path, count))

        for batch in batches:
            for page_id, url, html, refers_to in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")], strict=True):
                if out is None:
                    out_path = f"{folder}/whole/part-{part:06d}-{len(made):06d}.warc.gz"
                    out, packer, size, count = Output(out_path), zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
                raw = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to)
                out.stream.write(packer.compress(raw))
                size += len(raw)
                count += 1
                if size >= archive_bytes:
                    finish()
                    out = None
        if out is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in made], pa.string()), pa.array([x for _, x in made], pa.int64())], ["path", "records"])

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, records long")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive (path, records) with a gzip member for each record, and an index; per archive: path, index, records.

    An archive that doesn't hold its number of records raises; where that number is null, any is right.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for path, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                where, at = file_system(path)
                to = f"{folder}/members/{path.rpartition('/')[2]}"
                out, index, offset, count = Output(to), Output(f"{to}.index"), 0, 0
                with where.open_input_stream(at, compression=None) as stream:
                    for raw in split_records(inflate(stream)):
                        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = packer.compress(raw) + packer.flush()
                        out.stream.write(member)
                        index.stream.write(b"%d %d %s\n" % (offset, len(member), headers(raw[: raw.index(b"\r\n\r\n")])["warc-record-id"].encode()))
                        offset += len(member)
                        count += 1
                if records not in (None, count):
                    raise ValueError(f"{path}: {count} records, {records} were written")
                out.close()
                index.close()
                made.append((to, f"{to}.index", count))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], pa.string()), pa.array([x[1] for x in made], pa.string()), pa.array([x[2] for x in made], pa.int64())], ["path", "index", "records"])

    return archives.select("path", "records").mapInArrow(run, "path string, index string, records long")


def parse(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload bytes, digest, type and what it refers to; a response's digest is checked."""
    end = raw.index(b"\r\n\r\n")
    fields = headers(raw[:end])
    block = raw[end + 4 : end + 4 + int(fields["content-length"])]
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(headers(head)["content-length"])
    claimed = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and (len(payload) != size or digest(payload) != claimed):
        raise ValueError(f"{fields['warc-record-id']}: the payload doesn't match its digest")
    number = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x or "")) else None
    return number(fields["warc-record-id"]), size, claimed, fields["warc-type"], number(fields.get("warc-refers-to"))


def read_archives(archives: DataFrame) -> DataFrame:
    """Per record of the archives (path, index, records): page_id, payload_bytes, payload_digest, record_type, refers_to."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index, records in zip(*[batch.column(c).to_pylist() for c in ("path", "index", "records")], strict=True):
                where, at = file_system(path)
                with where.open_input_file(at) as members, where.open_input_stream(file_system(index)[1], compression=None) as lines:
                    rows = []
                    for line in lines.read().splitlines():
                        offset, length, _ = line.split(b" ", 2)
                        members.seek(int(offset))
                        rows.append(parse(zlib.decompress(members.read(int(length)), 31)))
                    if len(rows) != records or members.seek(0, 2) != (int(offset) + int(length) if rows else 0):
                        raise ValueError(f"{path}: the index has {len(rows)} records, {records} were written")
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return archives.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages with refers_to: the largest id with the same payload, or null for that one and payloads below min_bytes."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    names = {c: f"_{i}" for i, c in enumerate(pages.columns)}
    keyed = pages.select(*[F.col(c).alias(n) for c, n in names.items()], F.when(F.octet_length(payload) >= min_bytes, F.sha1(payload)).alias("sha1"))
    own = F.col(names["page_id"])
    repeated = keyed.where("sha1 is not null").groupBy("sha1").agg(F.max(own).alias("last"), F.count("*").alias("n")).where("n > 1")
    joined = joined_by_group(keyed, repeated, "sha1", "n", max(1, pages.count()))
    return joined.select(*[F.col(n).alias(c) for c, n in names.items()], F.when(~own.eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))


def archive(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) into whole-file archives, normalise these and remove them; per archive: path, index, records."""
    with temporary(pages.sparkSession):
        whole = written(write_archives(with_revisits(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), min_bytes), folder, archive_bytes), "warc-whole")
        made = written(normalise(whole.repartition(max(1, min(whole.count(), 10_000))), folder), "warc-members", keep=True)
    remove(pages.sparkSession, f"{folder}/whole")
    return made


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """All pages written as archives, normalised, and read back."""
    made = archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), shared_path(spark, "warc"))
    return read_archives(made.repartition(max(1, min(made.count(), 10_000))))


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
       (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(('0b' || substr(bits, 1 + 5 * i, 5))::INTEGER AS INTEGER), 1), '' ORDER BY i)
        FROM (SELECT list_aggregate(list_transform(regexp_extract_all(sha1(html), '.'), lambda h: lpad(bin(('0x' || h)::INTEGER), 4, '0')), 'string_agg', '') AS bits), range(32) t(i)) AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM g
"""
