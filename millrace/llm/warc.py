"""WARC archives: one gzip member per record, written and read back by tasks.

A task writes an archive of its own and names it in its result, so the files of
lost or repeated attempts are never read. The reader goes through an archive once, with
incremental decompression, and checks framing and digests of each record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import shared_folder, written

#: Payloads of so many bytes and more are stored once; records that repeat one refer to it.
LEAST_BYTES = 1000
#: An archive is closed at this size; bytes read at a time; zlib's level.
ARCHIVE_BYTES, CHUNK, LEVEL = 1 << 30, 1 << 18, 4
DATE = "2024-01-01T00:00:00Z"
# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = 16 + zlib.MAX_WBITS


def _urn(page: int | None) -> str:
    return f"<urn:millrace:page:{'none' if page is None else page}>"


def _page(urn: str) -> int | None:
    name = urn.strip("<>").rpartition(":")[2]
    return None if name == "none" else int(name)


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page: int, url: str | None, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    """A gzip member: a response, or a revisit that holds the HTTP header only."""
    size = f"Content-Length: {len(payload)}\r\n"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + size.encode() + b"\r\n"
    fields = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": _urn(page), "WARC-Date": DATE}
    if url:
        fields["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    fields["WARC-Payload-Digest"] = "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()
    if refers_to is None:
        block += payload
    else:
        fields |= {"WARC-Refers-To": _urn(refers_to), "WARC-Profile": PROFILE}
    fields |= {"WARC-Block-Digest": _digest(block), "Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    head = VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def _members(stream: BinaryIO) -> Iterator[bytes]:
    """The decompressed members of a gzip file, one at a time."""
    unpacker, out, data = zlib.decompressobj(GZIP), bytearray(), b""
    while data or (data := stream.read(CHUNK)):
        out += unpacker.decompress(data)
        data = unpacker.unused_data
        if unpacker.eof:
            yield bytes(out)
            unpacker, out = zlib.decompressobj(GZIP), bytearray()
    if out:
        raise ValueError("the archive ends within a record")


def _fields(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in lines.decode("utf-8").split("\r\n") if line)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def read_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(WARC fields, HTTP fields, payload) of each record; a broken record raises ValueError."""
    for raw in _members(stream):
        head, blank, rest = raw.partition(b"\r\n\r\n")
        if not blank or not head.startswith(VERSION):
            raise ValueError("not a WARC record")
        fields = _fields(head[len(VERSION) :])
        length = int(fields["content-length"])
        block, end = rest[:length], rest[length:]
        if len(block) != length or end != b"\r\n\r\n":
            raise ValueError(f"{fields['warc-record-id']}: its length isn't {length}")
        if _digest(block) != fields["warc-block-digest"]:
            raise ValueError(f"{fields['warc-record-id']}: its block has another digest")
        http, _, payload = block.partition(b"\r\n\r\n")
        if fields["warc-type"] == "response" and _digest(payload) != fields["warc-payload-digest"]:
            raise ValueError(f"{fields['warc-record-id']}: its payload has another digest")
        yield fields, _fields(http.partition(b"\r\n")[2]), payload


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, sha1 and refers_to, null for responses.

    Among equal payloads of LEAST_BYTES and more, that of the largest page_id is kept; rows that repeat this
    id are responses too. Null ids are smaller than others; among null ids alone all are responses.
    A payload with very many copies is one hot key of the join; the side with the pages can be split.
    """
    plain = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    named = plain.select("*", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("size"))
    large = named.where(F.col("size") >= LEAST_BYTES).groupBy("sha1", "size")
    kept = large.agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    return named.join(written(kept), ["sha1", "size"], "left").select(
        "page_id", "url", "payload", "sha1", first.alias("refers_to")
    )


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes .warc.gz archives and returns (archive, records, bytes) of those that are whole."""
    folder = folder or shared_folder(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = pafs.FileSystem.from_uri(folder)
        files.create_dir(at, recursive=True)
        task, made, stream, size, count = TaskContext.get(), [], None, 0, 0
        name = ""
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "sha1", "refers_to"))):
                if stream is None:
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(made):03d}.warc.gz"
                    stream, size, count = files.open_output_stream(f"{at}/{name}", compression=None), 0, 0
                data = record(*(x.as_py() for x in row))
                stream.write(data)
                size, count = size + len(data), count + 1
                if size >= ARCHIVE_BYTES:
                    stream.close()
                    made.append((f"{folder}/{name}", count, size))
                    stream = None
        if stream is not None:
            stream.close()
            made.append((f"{folder}/{name}", count, size))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], names=["archive", "records", "bytes"])

    return written(revisits(pages).mapInArrow(run, "archive string, records bigint, bytes bigint"))


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each record of the archives, digests verified; each archive is one task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                files, at = pafs.FileSystem.from_uri(archive)
                rows = []
                with files.open_input_stream(at, compression=None) as stream:
                    for fields, http, _ in read_records(stream):
                        again = fields.get("warc-refers-to")
                        rows.append(
                            (
                                _page(fields["warc-record-id"]), int(http["content-length"]),
                                base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex(),
                                fields["warc-type"], _page(again) if again else None, fields.get("warc-target-uri"),
                            )
                        )
                        if len(rows) == 10_000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    count = archives.count()
    spread = archives.select("archive").repartition(max(1, min(count, 20_000)), "archive")
    return spread.mapInArrow(run, ", ".join(f"{n} {t}" for n, t, _ in _COLUMNS))


_COLUMNS = [
    ("page_id", "bigint", pa.int64()), ("payload_bytes", "bigint", pa.int64()), ("payload_digest", "string", pa.string()),
    ("record_type", "string", pa.string()), ("refers_to", "bigint", pa.int64()), ("url", "string", pa.string()),
]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    arrays = [pa.array(c, t) for c, (_, _, t) in zip(zip(*rows), _COLUMNS)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _, _ in _COLUMNS])


def archive_and_read(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """What the archives of all pages hold, read back.

    Null html is an empty payload; null or blank urls give records without a target.
    Repeated and null page_ids give a record each and are read back as they were. Other columns are not read; an empty
    table gives no archive and no rows. A page of any size is one record, whose payload a task holds at once.
    """
    return read_archives(write_archives(pages, folder))
