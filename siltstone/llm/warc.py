"""WARC archives as a table of record chunks (operator 4).

A row (page_id, chunk, data, running_sha1) holds the next bytes of a record: chunk 0 its
header and, for a response, the HTTP header; later ones CHUNK_BYTES of the payload each; the
last one ends the record with two line ends. The data of a record's chunks in order are a
WARC/1.1 record, and all rows in order an archive. running_sha1 is the digest of the payload
up to that chunk, so a reader can stop at the first damaged chunk. Neither side holds more
of a payload than a chunk beside Spark's own row.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm._cluster import join_counted, shared_dir, stash

CHUNK_BYTES = 1 << 16

#: A table of repeated digests of up to so many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_DIGESTS = 200_000

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_CHUNKS = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("chunk", T.IntegerType()), T.StructField("data", T.BinaryType()), T.StructField("running_sha1", T.BinaryType()), T.StructField("copy", T.LongType())])
_SPACE = uuid.UUID("9f2b4c1e-5d1a-4a57-8a43-3f2f6f0a7c11")


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(page_id))}>"


def _target(url: str | None) -> bytes:
    """A header value can't hold line ends or other control characters; they are percent-encoded."""
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], (url or "").encode())


def _header(kind: str, page_id: int | None, url: str | None, date: str, digest: bytes, payload: int, refers: int | None) -> bytes:
    http = _HTTP % payload
    lines = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: " + record_id(page_id).encode(), b"WARC-Date: " + date.encode()]
    if url is not None:
        lines.append(b"WARC-Target-URI: " + _target(url))
    if page_id is not None:
        lines.append(b"X-Page-ID: %d" % page_id)
    lines += [b"WARC-Payload-Digest: sha1:" + base64.b32encode(digest), b"X-Payload-Length: %d" % payload]
    if refers is not None:
        lines += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: " + record_id(refers).encode(), b"X-Refers-To-Page-ID: %d" % refers]
    lines += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % (len(http) + (0 if refers is not None else payload))]
    return b"\r\n".join(lines) + b"\r\n\r\n" + http


def assign_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with refers_to: of equal payloads of least_bytes or more, all but the largest page_id revisit that one.

    Payloads are equal if their lengths, SHA-1 and SHA-256 are. Rows with the largest page_id
    are all responses, should it repeat; a null page_id is less than any other.
    """
    payload = F.coalesce("html", F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(payload).alias("_sha1"), F.sha2(payload, 256).alias("_sha2"), F.octet_length(payload).alias("_bytes"))
    keys = ["_sha1", "_sha2", "_bytes"]
    counted = keyed.filter(F.col("_bytes") >= least_bytes).groupBy(*keys).agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n"))
    repeated = stash(counted.filter(F.col("_n") > 1), "digests")
    if repeated.count() <= BROADCAST_DIGESTS:
        joined = keyed.join(F.broadcast(repeated), keys, "left")
    else:
        joined = join_counted(keyed, repeated, keys, "_n", keyed.count())
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_last")), F.col("_last"))
    return joined.select("page_id", "url", "html", refers.alias("refers_to"))


def chunk_records(assigned: DataFrame, date: str = "2024-01-01T00:00:00Z", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk rows of each page. copy tells repeated rows of one page apart. A null html is an empty payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64()))], names=[f.name for f in _CHUNKS])
            rows.clear()
            return out

        held = 0
        for batch in batches:
            for page_id, url, html, refers, copy in zip(*(batch.column(i) for i in range(5))):
                buffer = html.as_buffer() if html.is_valid else None
                view = memoryview(buffer) if buffer is not None else memoryview(b"")
                page_id, url, refers, copy = page_id.as_py(), url.as_py(), refers.as_py(), copy.as_py()
                digest = hashlib.sha1(view).digest()
                running = hashlib.sha1()
                kind = "response" if refers is None else "revisit"
                rows.append((page_id, 0, _header(kind, page_id, url, date, digest, len(view), refers), running.digest(), copy))
                held += 600
                n = 0
                for n, at in enumerate(range(0, len(view) if refers is None else 0, chunk_bytes), 1):
                    piece = view[at : at + chunk_bytes]
                    running.update(piece)
                    rows.append((page_id, n, bytes(piece), running.digest(), copy))
                    held += len(piece)
                    if held > 1 << 22:
                        yield flush()
                        held = 0
                rows.append((page_id, n + 1, b"\r\n\r\n", running.digest(), copy))
        if rows:
            yield flush()

    return assigned.select("page_id", "url", "html", "refers_to", F.monotonically_increasing_id().alias("copy")).mapInArrow(run, _CHUNKS)


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write a record for each row of pages (page_id, url, html) to the chunk table at path. Other columns aren't read."""
    chunk_records(assign_revisits(pages, least_bytes), chunk_bytes=chunk_bytes).write.option("compression", "zstd").parquet(path)


_RECORDS = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("record_id", T.StringType()), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("intact", T.BooleanType())])


class _Reader:
    """Parses one record from its chunks; keeps the header and a running digest only."""

    def __init__(self, head: bytes):
        text, _, self.http = head.partition(b"\r\n\r\n")
        self.fields = dict(line.split(b": ", 1) for line in text.split(b"\r\n")[1:])
        self.digest, self.size, self.intact, self.ended = hashlib.sha1(), 0, True, False

    def add(self, data: bytes, running: bytes, last: bool) -> None:
        if last:
            self.ended = data == b"\r\n\r\n"
        else:
            self.digest.update(data)
            self.size += len(data)
        self.intact &= self.digest.digest() == running

    def record(self) -> dict:
        get = lambda k: self.fields[k].decode() if k in self.fields else None
        kind, stated = get(b"WARC-Type"), get(b"WARC-Payload-Digest").removeprefix("sha1:")
        size, digest = int(get(b"X-Payload-Length")), stated
        intact = self.intact and self.ended and int(get(b"Content-Length")) == len(self.http) + self.size
        if kind == "response":
            digest = base64.b32encode(self.digest.digest()).decode()
            intact &= digest == stated and self.size == size
            size = self.size
        page, refers = get(b"X-Page-ID"), get(b"X-Refers-To-Page-ID")
        return {"page_id": page and int(page), "record_id": get(b"WARC-Record-ID"), "url": get(b"WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": refers and int(refers), "intact": intact}


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record at path; what a response says of its payload is computed from its chunks. intact is false for damaged records."""
    chunks = spark.read.schema(_CHUNKS).parquet(path)
    ordered = chunks.repartition("copy").sortWithinPartitions("copy", "chunk")
    names = [(f.name, {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[f.dataType.typeName()]) for f in _RECORDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, reader, waiting = None, None, None
        done: list[dict] = []
        for batch in batches:
            for copy, chunk, data, running in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                if copy != held:
                    if reader:
                        reader.add(*waiting, True)
                        done.append(reader.record())
                    held, reader, waiting = copy, _Reader(data.as_py()), (b"", b"")
                    continue
                if chunk > 1:
                    reader.add(*waiting, False)
                waiting = (data.as_py(), running)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=pa.schema(names))
                done = []
        if reader:
            reader.add(*waiting, True)
            yield pa.RecordBatch.from_pylist([reader.record()], schema=pa.schema(names))

    return ordered.select("copy", "chunk", "data", "running_sha1").mapInArrow(run, _RECORDS)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages to an archive in the shared folder and read it back."""
    path = shared_dir(pages.sparkSession, "warc")
    write_archive(pages, path, least_bytes)
    return read_archive(pages.sparkSession, path)
