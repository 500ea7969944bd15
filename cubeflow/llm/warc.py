"""WARC archives: a writer with revisit records and a sequential, verifying reader.

Every record is one gzip member.  Tasks write their archives into a folder that all machines share
and report them in a manifest; only archives of successful attempts are in it.  The reader feeds
blocks of compressed bytes to an incremental inflater, frames records by Content-Length and checks
block and payload digests, so its memory does not depend on the size of an archive.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeflow.llm.common import broadcast_if_small, cut, shared_path, small_batches

REVISIT_FROM_BYTES = 1000
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 1 << 16
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX, ID_SUFFIX = "<urn:page:", ">"
RECORDS = "page_id long, url string, html string, payload_bytes long, payload_digest string, record_type string, refers_to long"


class WarcError(ValueError):
    """A record that is cut short, framed wrongly or fails its digest."""


def _label(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _record_id(page_id) -> str:
    return f"{ID_PREFIX}{'' if page_id is None else page_id}{ID_SUFFIX}"


def _page_id(value: str | None):
    inner = value[len(ID_PREFIX) : -len(ID_SUFFIX)] if value else ""
    return int(inner) if inner else None


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False, date: str = "2024-01-01T00:00:00Z", level: int = 6) -> bytes:
    """One gzip member with a response record, or a revisit record without the payload."""
    block = HTTP_HEAD if revisit else HTTP_HEAD + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c < " " or c == "%" else c for c in url))
    head += [f"WARC-Payload-Digest: {_label(hashlib.sha1(payload).digest())}", f"WARC-Block-Digest: {_label(hashlib.sha1(block).digest())}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += [f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


class _Members:
    """The inflated bytes of a stream of gzip members, member by member."""

    def __init__(self, stream: BinaryIO) -> None:
        self.stream, self.raw, self.have, self.inflate, self.ended = stream, b"", b"", None, False

    def open(self) -> bool:
        """Begins the next member; False at the end of the stream."""
        self.raw = self.raw or self.stream.read(READ_BYTES)
        self.inflate, self.ended, self.have = zlib.decompressobj(31), False, b""
        return bool(self.raw)

    def _more(self) -> None:
        if self.ended:
            raise WarcError("the record ends before its content")
        self.raw = self.raw or self.stream.read(READ_BYTES)
        if not self.raw:
            raise WarcError("the archive ends within a member")
        try:
            self.have += self.inflate.decompress(self.raw, READ_BYTES)
        except zlib.error as e:
            raise WarcError(str(e)) from e
        self.ended = self.inflate.eof
        self.raw = self.inflate.unused_data if self.ended else self.inflate.unconsumed_tail

    def until(self, mark: bytes) -> bytes:
        at = 0
        while (k := self.have.find(mark, at)) < 0:
            at = max(0, len(self.have) - len(mark) + 1)
            self._more()
        out, self.have = self.have[:k], self.have[k + len(mark) :]
        return out

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.have:
                self._more()
            part, self.have = self.have[:n], self.have[n:]
            n -= len(part)
            yield part

    def close(self) -> None:
        while not self.ended and not self.have:
            self._more()
        if self.have:
            raise WarcError("bytes after the record in its member")


def read_records(stream: BinaryIO, with_payload: bool = True) -> Iterator[tuple]:
    """The records of an archive in order, as RECORDS has them; raises WarcError on any that is damaged."""
    members = _Members(stream)
    while members.open():
        lines = members.until(b"\r\n\r\n").decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise WarcError("no WARC version line")
        head = dict(line.split(": ", 1) for line in lines[1:])
        block, payload, kept, lead = hashlib.sha1(), hashlib.sha1(), [], b""
        in_payload, n_payload = False, 0
        for part in members.exactly(int(head["Content-Length"])):
            block.update(part)
            if not in_payload:
                lead += part
                if (k := lead.find(b"\r\n\r\n")) < 0:
                    continue
                in_payload, part = True, lead[k + 4 :]
            payload.update(part)
            n_payload += len(part)
            if with_payload:
                kept.append(part)
        if b"".join(members.exactly(4)) != b"\r\n\r\n":
            raise WarcError("the record is not framed by its Content-Length")
        members.close()
        if _label(block.digest()) != head["WARC-Block-Digest"]:
            raise WarcError(f"block digest of {head['WARC-Record-ID']}")
        revisit = head["WARC-Type"] == "revisit"
        said = head["WARC-Payload-Digest"]
        if not revisit and (_label(payload.digest()) != said or n_payload != int(head["X-Payload-Length"])):
            raise WarcError(f"payload digest of {head['WARC-Record-ID']}")
        url = head.get("WARC-Target-URI")
        if url is not None and "%" in url:
            parts = url.split("%")
            url = parts[0] + "".join(chr(int(p[:2], 16)) + p[2:] for p in parts[1:])
        html = b"".join(kept).decode() if with_payload and not revisit else None
        yield _page_id(head["WARC-Record-ID"]), url, html, int(head["X-Payload-Length"]), base64.b32decode(said[5:]).hex(), head["WARC-Type"], _page_id(head.get("WARC-Refers-To"))


def write_archives(pages: DataFrame, folder: str | None = None, level: int = 6) -> DataFrame:
    """Writes a record for every row of ``pages`` (page_id, url, html); returns the manifest (path, records, bytes).

    Of equal payloads of at least REVISIT_FROM_BYTES, the row with the largest page_id is the
    response and the others revisit it.  A null html is an empty payload; a null url has no
    target line; rows with a null page_id revisit like others but are never revisited; rows that
    repeat the largest page_id are responses each.  An empty table writes no archive.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or shared_path(spark, "warc")
    html = F.coalesce("html", F.lit(""))
    pages = pages.select(F.col("page_id").cast("long"), "url", html.alias("html")).withColumn("digest", F.when(F.octet_length("html") >= REVISIT_FROM_BYTES, F.sha1("html")))
    groups = cut(pages.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1 and kept is not null").select("digest", "kept"), "warc-groups")
    marked = pages.join(broadcast_if_small(groups, 80), "digest", "left").select("page_id", "url", "html", "kept")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        task, out, made, n, size = TaskContext.get(), None, 0, 0, 0

        def done():
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [n], "bytes": [size]})

        for batch in batches:
            for page, url, text, kept in zip(*(batch.column(k) for k in range(4))):
                if out is None:
                    store.create_dir(root, recursive=True)
                    path, made, n, size = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{made}.warc.gz", made + 1, 0, 0
                    out = store.open_output_stream(f"{root}/{path.rpartition('/')[2]}", compression=None)
                page, kept = page.as_py(), kept.as_py()
                member = record(page, url.as_py(), text.as_py().encode(), kept, kept is not None and page != kept, level=level)
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= ARCHIVE_BYTES:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return cut(marked.mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives of a manifest; an archive is read from start to end by one task."""
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inner = fs.FileSystem.from_uri(path)
                with store.open_input_stream(inner, compression=None) as stream:
                    rows, weight = [], 0
                    for row in read_records(stream, with_payload):
                        rows.append(row)
                        weight += 200 + len(row[2] or "")
                        if weight > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows, weight = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=names)

    n = max(1, manifest.count())
    return manifest.select("path").repartition(n).mapInArrow(read, RECORDS)


def restored(records: DataFrame) -> DataFrame:
    """``records`` with the html of revisits taken from the records that they refer to."""
    whole = records.where("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest")).agg(F.first("html").alias("_html"))
    same = (records.refers_to == whole._id) & (records.payload_digest == whole._digest)
    return records.join(whole, same, "left").withColumn("html", F.coalesce("html", "_html")).select(*records.columns)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all pages, read back from their archives."""
    from cubeflow.llm.common import table

    manifest = write_archives(table(spark, sf_dir, "pages"))
    return read_archives(manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS kept FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest AS payload_digest,
       CASE WHEN kept IS NULL OR kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""
