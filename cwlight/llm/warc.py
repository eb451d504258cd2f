"""WARC archives of web pages: one gzip member per record, written and read one after the other.

Writing: the payload digest of every page is taken in Spark; the first page (by
page_id) of each payload of at least ``REVISIT_BYTES`` is a response record and
later ones are revisit records without payload.  Each task packs its records
into archives of about ``ARCHIVE_BYTES``.  An archive is a row holding its bytes
in a table of the shared folder, so that it lives in any store Spark writes to;
``export`` puts archives out as ``.warc.gz`` files.

Reading: one archive at a time, front to back.  Compressed bytes go through
zlib in chunks, each member ends where zlib says so, a header block ends at its
empty line, Content-Length frames the block, and the digests are compared with
the bytes read; a revisit's with those of the response it refers to.

Defined cases: null html is an empty payload; a null page_id is written as
``urn:page:null`` and read back as null; repeated rows of one page_id are all
responses unless a smaller page_id holds the same payload; a page is held whole
in memory, so a very large one costs its size.  Columns other than
page_id, url and html are ignored.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cwlight.llm.common import cut, small

ARCHIVE_BYTES, CHUNK, REVISIT_BYTES = 8 << 20, 1 << 16, 100
#: Digests of shared payloads (some 100 bytes each) that are broadcast at most.
FEW = 1 << 16
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def with_types(pages: DataFrame) -> DataFrame:
    """Pages with payload digest, size, record type and the page a revisit refers to."""
    body = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.encode(F.lit(""), "UTF-8"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    firsts = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # Few enough digests go to the pages, so that no payload is shuffled for them; beyond that a payload shared by many
    # pages is a large key of a plain join, which Spark can split.
    rows = rows.join(small(cut(firsts), FEW), "digest", "left")
    again = F.col("page_id") > F.col("first")
    return rows.select("page_id", "url", "payload", "digest", "size", F.when(again, F.col("first")).alias("refers_to"))


def _clean(value: str) -> str:
    return "".join(ch if ch.isprintable() else "%%%02X" % ord(ch) for ch in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """The bytes of one record, before compression."""
    revisit = refers_to is not None
    block = HTTP if revisit else HTTP + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_clean(url or '')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    """``data`` as one gzip member."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def archives(pages: DataFrame) -> DataFrame:
    """(records, body): archives of the pages, each a run of gzip members."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for at in range(batch.num_rows):
                page, url, payload, digest, _, first = (batch.column(i)[at].as_py() for i in range(6))
                held.append(member(record(page, url, payload, digest, first)))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64()), pa.array([b"".join(held)], pa.binary())], names=["records", "body"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64()), pa.array([b"".join(held)], pa.binary())], names=["records", "body"])

    return with_types(pages).mapInArrow(run, "records long, body binary")


def members(source: Iterator[bytes]) -> Iterator[bytes]:
    """The uncompressed members of a gzip stream, fed chunk by chunk."""
    z, out, begun = zlib.decompressobj(31), [], False
    for chunk in source:
        while chunk:
            out.append(z.decompress(chunk))
            begun = True
            chunk = b""
            if z.eof:
                chunk = z.unused_data
                yield b"".join(out)
                z, out, begun = zlib.decompressobj(31), [], False
    if begun:
        raise ValueError("the archive ends inside a gzip member")


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; checks version, framing and block digest."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not frame the record")
    block = rest[:size]
    if headers.get("warc-block-digest", "sha256:").removeprefix("sha256:") not in ("", hashlib.sha256(block).hexdigest()):
        raise ValueError("block digest differs")
    return headers, block


def _page(value: str | None) -> int | None:
    number = (value or "").strip("<>").rpartition(":")[2]
    return int(number) if number.lstrip("-").isdigit() else None


def read_record(data: bytes) -> tuple:
    """One record as a row of ``RECORD``; a response's payload is checked against its digest."""
    headers, block = parsed(data)
    digest = headers["warc-payload-digest"].removeprefix("sha256:")
    revisit = headers["warc-type"] == "revisit"
    payload = None if revisit else block.partition(b"\r\n\r\n")[2]
    if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("payload digest differs")
    size = int(headers["x-payload-length"]) if revisit else len(payload)
    return _page(headers["warc-record-id"]), size, digest, headers["warc-type"], _page(headers.get("warc-refers-to")), headers["warc-target-uri"], payload


def read_archives(rows: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of archives given as rows with a ``body``; damage raises an error."""
    names = [x.split()[0] for x in RECORD.split(", ")][: 7 if with_payload else 6]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def chunks(body: memoryview) -> Iterator[bytes]:
        for at in range(0, len(body), CHUNK):
            yield bytes(body[at : at + CHUNK])

    def out(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], types[i]) for i in range(len(names))], names=names)

    def run(batches):
        for batch in batches:
            for body in batch.column(0):
                held = []
                for data in members(chunks(memoryview(body.as_buffer()))):
                    held.append(read_record(data))
                    if len(held) == 256:
                        yield out(held)
                        held = []
                yield out(held)

    schema = ", ".join(RECORD.split(", ")[: len(names)])
    return rows.select("body").mapInArrow(run, schema)


def resolved(records: DataFrame) -> DataFrame:
    """``records``, an error where a revisit has no response of its digest and length under the page it refers to.

    Only ids, digests and lengths are joined.
    """
    keys = ["payload_digest", "payload_bytes", "refers_to"]
    is_response = F.col("record_type") == "response"
    told = records.where(is_response).select("payload_digest", "payload_bytes", F.col("page_id").alias("refers_to"), F.lit(True).alias("found")).distinct()
    revisits = records.where(~is_response).join(told, keys, "left")
    wrong = F.raise_error(F.lit("a revisit refers to no response with its payload")).cast("string")
    revisits = revisits.withColumn("record_type", F.when(F.col("found"), F.col("record_type")).otherwise(wrong))
    return records.where(is_response).unionByName(revisits.select(*records.columns))


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written as archives into the shared folder and read back."""
    return resolved(cut(read_archives(cut(archives(pages)), with_payload=False)))


def export(rows: DataFrame, folder: str) -> DataFrame:
    """Archives as ``.warc.gz`` files of a folder that all workers mount; (name, bytes) of each.

    A file gets its name once it is whole, and the name is the digest of its
    bytes, so a task that runs twice leaves one file.
    """

    def run(batches):
        for batch in batches:
            for body in batch.column(0).to_pylist():
                name = f"{hashlib.sha256(body).hexdigest()[:32]}.warc.gz"
                part = os.path.join(folder, f".{name}.{os.getpid()}")
                with open(part, "wb") as f:
                    f.write(body)
                os.replace(part, os.path.join(folder, name))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(body)], pa.int64())], names=["name", "bytes"])

    return rows.select("body").mapInArrow(run, "name string, bytes long")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of ``.warc.gz`` files in any store that Spark reads."""
    return read_archives(spark.read.format("binaryFile").load(path).select(F.col("content").alias("body")))
