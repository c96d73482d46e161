"""WARC archives: a writer and a sequential reader.

An archive is a run of gzip members, one for every record. The reader inflates member after member
in bounded steps, takes header lines up to the blank line, then exactly Content-Length bytes, and
checks block and payload digests. Records of equal payloads are written once as a response; the
others are revisits that name it.

Archives are written by tasks straight to the shared folder through its file system. Their names carry
the attempt, so no repeated or speculative task touches another's files, and only the archives that the
list of the attempt that succeeded names are read: half archives of lost tasks count for nothing.

Defined results: a null html is an empty payload, a null url an empty one; of rows with equal payload
and page id one is the response; rows with a null page id are the last choice; payloads below
min_bytes are responses all; only page_id, url and html are read, so other columns can't clash; an empty
table gives no archive and an empty result. Payloads are equal if their SHA-256 is. A record that
breaks its framing or a digest raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_lookup, materialize, read, shared_folder

_STEP = 1 << 16
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def digest(data: bytes) -> str:
    """Base32 SHA-1, as WARC headers give it."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit's block ends after the HTTP header."""
    name, other = ("none" if i is None else str(i) for i in (page_id, refers_to))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {' '.join(url.split())}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{other}>"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n"
    packer = zlib.compressobj(2, zlib.DEFLATED, 31)
    return packer.compress(head) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


class _Members:
    """Bytes of a gzip file, member by member, inflated in bounded steps."""

    def __init__(self, stream):
        self.stream, self.raw, self.buffer, self.inflater = stream, b"", bytearray(), None

    def next_member(self) -> bool:
        if self.buffer or self.inflater and not self.inflater.eof:
            raise ValueError("a record does not end where its gzip member ends")
        if self.inflater:
            self.raw = self.inflater.unused_data
        self.raw = self.raw or self.stream.read(_STEP)
        self.inflater = zlib.decompressobj(31)
        return bool(self.raw)

    def _more(self) -> bool:
        if self.inflater.eof:
            return False
        if not self.raw:
            self.raw = self.stream.read(_STEP)
            if not self.raw:
                raise ValueError("the archive ends inside a record")
        self.buffer += self.inflater.decompress(self.raw, _STEP)
        self.raw = self.inflater.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        at = -1
        while (at := self.buffer.find(mark, max(0, at))) < 0:
            at = len(self.buffer) - len(mark)
            if not self._more():
                raise ValueError("a record has no end of header")
        out = bytes(self.buffer[:at])
        del self.buffer[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError("a record is shorter than its Content-Length")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def drain(self) -> None:
        while not self.inflater.eof:
            self._more()


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8").split("\r\n")[1:])}


def read_records(stream) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(WARC header, HTTP header, payload) of every record, in order, digests checked."""
    members = _Members(stream)
    while members.next_member():
        warc = _fields(members.until(b"\r\n\r\n"))
        block = members.take(int(warc["content-length"]))
        if members.take(4) != b"\r\n\r\n":
            raise ValueError("a record does not end with an empty line")
        members.drain()
        if warc["warc-block-digest"] != f"sha1:{digest(block)}":
            raise ValueError(f"block digest of {warc['warc-record-id']} does not hold")
        head, _, payload = block.partition(b"\r\n\r\n")
        http = _fields(head)
        if warc["warc-type"] == "response" and (warc["warc-payload-digest"] != f"sha1:{digest(payload)}" or len(payload) != int(http["content-length"])):
            raise ValueError(f"payload of {warc['warc-record-id']} does not hold")
        yield warc, http, payload


def plan_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with revisit and refers_to: the largest page id of equal payloads is the response."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    # the tie of equal rows is broken by a number that is written before anything depends on it
    rows = materialize(rows.select("*", F.sha2("html", 256).alias("sha"), F.monotonically_increasing_id().alias("row")), "warc-pages")
    groups = rows.where(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.max(F.struct("page_id", "row")).alias("best"), F.count("*").alias("copies"))
    shared = materialize(groups.where("copies > 1").select("sha", F.col("best.page_id").alias("response"), F.col("best.row").alias("best_row")), "warc-shared")
    revisit = F.coalesce((F.col("row") != F.col("best_row")) & (F.octet_length("html") >= min_bytes), F.lit(False))
    joined = join_lookup(rows, shared, ["sha"])
    return joined.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("response")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = 64 << 20) -> DataFrame:
    """Write pages as archives of about archive_bytes at most into folder; one row (path, records, bytes) for each archive."""

    def write(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        context = TaskContext.get()
        part, attempt, n, out, done = context.partitionId(), context.taskAttemptId(), 0, None, []

        def close():
            nonlocal out
            out.close()
            done.append((path, count, size))
            out = None

        for batch in batches:
            for page_id, url, html, revisit, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if out is None:
                    n, count, size = n + 1, 0, 0
                    path = f"{root}/part-{part:06d}-{attempt}-{n:04d}.warc.gz"
                    out = system.open_output_stream(path, compression=None)
                data = record(page_id, url or "", html.encode(), refers_to, revisit)
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= archive_bytes:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"path": [d[0] for d in done], "records": [d[1] for d in done], "bytes": [d[2] for d in done]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    written = plan_revisits(pages, min_bytes).select("page_id", "url", "html", "revisit", "refers_to").mapInArrow(write, "path string, records long, bytes long")
    return materialize(written, "warc-list")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Records (see RECORD) of the archives listed in the column path, one archive read at a time in a task."""

    def read(batches):
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with system.open_input_stream(path, compression=None) as stream:
                    rows = []
                    for warc, http, payload in read_records(stream):
                        number = lambda field: None if (x := warc.get(field, "none").rpartition(":")[2].rstrip(">")) == "none" else int(x)
                        revisit = warc["warc-type"] == "revisit"
                        rows.append((number("warc-record-id"), warc["warc-target-uri"], warc["warc-type"], number("warc-refers-to") if revisit else None, int(http["content-length"]) if revisit else len(payload), warc["warc-payload-digest"].removeprefix("sha1:")))
                        if len(rows) == 1000:
                            yield _batch(rows)
                            rows = []
                    yield _batch(rows)

    # an archive is the unit of work; the list is dealt anew, evenly, to a few tasks for each core at most
    tasks = min(archives.count(), 8 * archives.sparkSession.sparkContext.defaultParallelism)
    return archives.select("path").repartition(max(1, tasks)).mapInArrow(read, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in RECORD.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(6)], names=names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    archives = write_archives(read(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return read_archives(archives, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS m FROM pages
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> m THEN m END AS refers_to
FROM p
"""
