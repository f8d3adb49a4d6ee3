"""WARC archives: writing pages as records, and a sequential reader with digest checks.

Each record is one gzip member. The reader decompresses a file piece by piece, finds the record by its headers, takes as many
bytes as ``Content-Length`` says, and checks block and payload digests on the way; it holds one piece and one record's payload.
Of pages with equal payloads of at least ``least_revisit`` bytes, the one with the largest page id is written whole and the
others as revisits without a body, which name its record.

Files are written by their own tasks under names that no other attempt uses; only files listed in the manifest that Spark
commits are read, so a lost or repeated task leaves nothing wrong behind. Paths are reached through pyarrow's file systems
(local, HDFS, S3, GCS); files found by Spark alone can be read with ``read_binary``.

Cases: null html is an empty payload; a null url gives an empty target; null page ids are smaller than others and come back
as null; rows that repeat the largest page id of a payload, the only ties, are all responses; payloads of any length are written and
read whole, a piece at a time; an empty table gives no archive; other columns are not written. A damaged
member ends its file's reading with one row of type ``damaged``; wrong digests give ``digest_ok`` false.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import Any, BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptledger.llm.common import scratch

LEAST_REVISIT = 1000
#: A file is closed after the record with which it reaches this many compressed bytes.
FILE_BYTES = 64 << 20
PIECE = 1 << 16
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_RECORD = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()), ("refers_to", pa.int64()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_ok", pa.bool_()), ("payload", pa.binary()), ("problem", pa.string()),
])
RECORD_SCHEMA = (
    "record_id string, record_type string, page_id long, target_uri string, refers_to long, payload_bytes long, payload_digest string, "
    "digest_ok boolean, payload binary, problem string"
)


def plan_records(pages: DataFrame, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``digest`` and ``refers_to`` (null for responses) of each page.

    Digests are grouped with their largest page id before rows meet, so one payload on a third of all pages is one row.
    """
    payload = F.coalesce(F.encode("html", "utf-8"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    kept = (
        rows.filter(F.length("payload") >= least_revisit).groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
        .filter("n > 1").select(F.col("digest").alias("of"), "original")
    )
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return rows.join(kept, F.col("digest") == F.col("of"), "left").select(
        "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), F.length("payload").cast("long").alias("size"), "digest",
        F.when(revisit, F.col("original")).alias("refers_to"))


def _record_uri(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}')}>"


def _base32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _clean(value: str) -> str:
    """A header value on one line."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if any(c in value for c in "\r\n") else value


def record_bytes(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One record as one gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": _record_uri(page_id, digest), "WARC-Date": DATE,
        "WARC-Target-URI": _clean(url or ""), "Content-Type": "application/http; msgtype=response", "X-Page-ID": "" if page_id is None else str(page_id),
        "WARC-Payload-Digest": _base32(digest), "WARC-Block-Digest": _base32(hashlib.sha1(block).hexdigest()),
    }
    if refers_to is not None:
        headers |= {"WARC-Refers-To": _record_uri(refers_to, digest), "WARC-Profile": _PROFILE, "X-Refers-To-Page-ID": str(refers_to)}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress(head.encode("utf-8", "surrogatepass")) + made.compress(block + b"\r\n\r\n") + made.flush()


def _file_system(path: str) -> tuple[Any, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_archives(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the records of ``plan_records`` below ``folder``; returns the committed manifest (``path``, ``records``, ``bytes``)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _file_system(folder)
        system.create_dir(f"{base}/warc", recursive=True)
        out, name, count, size, done = None, "", 0, 0, []
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                page_id, url, payload, full, digest, refers = (c[i].as_py() for c in columns)
                if out is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{base}/warc/{name}", compression=None)
                member = record_bytes(page_id, url, payload or b"", full, digest, refers)
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= file_bytes:
                    out.close()
                    done.append((f"{folder}/warc/{name}", count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/warc/{name}", count, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["path", "records", "bytes"])

    manifest = f"{folder}/manifest"
    kind = "path string, records long, bytes long"
    records.select("page_id", "url", "payload", "size", "digest", "refers_to").mapInArrow(write, kind).write.parquet(manifest)
    return records.sparkSession.read.schema(kind).parquet(manifest)


class _Members:
    """Bytes of one gzip member after another, decompressed piece by piece."""

    def __init__(self, stream: BinaryIO) -> None:
        self.stream, self.rest, self.out, self.zip = stream, b"", bytearray(), None

    def next_member(self) -> bool:
        self.out.clear()
        self.rest = self.rest or self.stream.read(PIECE)
        self.zip = zlib.decompressobj(31)
        return bool(self.rest)

    def more(self) -> bool:
        """Decompress one piece; False at the member's end."""
        if self.zip.eof:
            return False
        if not (data := self.zip.unconsumed_tail or self.rest):
            data = self.stream.read(PIECE)
            if not data:
                raise ValueError("the file ends inside a record")
        self.rest = b""
        self.out += self.zip.decompress(data, PIECE)
        if self.zip.eof:
            self.rest = self.zip.unused_data
        return True

    def upto(self, mark: bytes) -> bytes:
        start = 0
        while (at := self.out.find(mark, start)) < 0:
            start = max(0, len(self.out) - len(mark))
            if not self.more():
                raise ValueError("a record without end of headers")
        found = bytes(self.out[:at])
        del self.out[: at + len(mark)]
        return found

    def take(self, size: int) -> bytes:
        while not self.out:
            if not self.more():
                raise ValueError("a block shorter than its content length")
        found = bytes(self.out[:size])
        del self.out[:size]
        return found


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def _digest_hex(value: str) -> str:
    """Bare lower-case hex of a ``sha1:`` digest in base 32 or hex."""
    bare = value.rpartition(":")[2]
    return bare.lower() if len(bare) == 40 else base64.b32decode(bare).hex() if bare else ""


def _number(value: str | None) -> int | None:
    return int(value) if value else None


def read_records(stream: BinaryIO, with_payload: bool) -> Iterator[dict[str, Any]]:
    """Records of one archive in order; a damaged member gives a last row with its ``problem``."""
    members = _Members(stream)
    while members.next_member():
        try:
            head = members.upto(b"\r\n\r\n")
            if not head.lstrip().startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            head = _headers(head.lstrip())
            left = length = int(head["content-length"])
            block, http, http_raw = hashlib.sha1(), {}, b""
            if head.get("content-type", "").startswith("application/http"):
                http_raw = members.upto(b"\r\n\r\n")
                http = _headers(http_raw)
                block.update(http_raw + b"\r\n\r\n")
                left -= len(http_raw) + 4
            payload, body, size = hashlib.sha1(), [], 0
            while left > 0:
                data = members.take(left)
                left -= len(data)
                size += len(data)
                block.update(data)
                payload.update(data)
                if with_payload:
                    body.append(data)
            while members.more():
                pass
            if left or bytes(members.out) != b"\r\n\r\n":
                raise ValueError(f"content length {length} does not frame the block")
            revisit = head.get("warc-type") == "revisit"
            told, full = _digest_hex(head.get("warc-payload-digest", "")), payload.hexdigest()
            yield {
                "record_id": head.get("warc-record-id"), "record_type": head.get("warc-type"), "page_id": _number(head.get("x-page-id")),
                "target_uri": head.get("warc-target-uri"), "refers_to": _number(head.get("x-refers-to-page-id")),
                "payload_bytes": _number(http.get("content-length")) if revisit else size, "payload_digest": told if revisit else full,
                "digest_ok": _digest_hex(head.get("warc-block-digest", "")) in ("", block.hexdigest()) and (revisit or told in ("", full)),
                "payload": b"".join(body) if with_payload and not revisit else None, "problem": None,
            }
        except (ValueError, KeyError, zlib.error) as e:
            yield dict.fromkeys(_RECORD.names) | {"record_type": "damaged", "digest_ok": False, "problem": f"{type(e).__name__}: {e}"}
            return


def _batched(rows: Iterator[dict[str, Any]], most: int = 1000, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    part: list[dict[str, Any]] = []
    size = 0
    for row in rows:
        part.append(row)
        size += len(row["payload"] or b"")
        if len(part) >= most or size >= most_bytes:
            yield pa.RecordBatch.from_pylist(part, _RECORD)
            part, size = [], 0
    if part:
        yield pa.RecordBatch.from_pylist(part, _RECORD)


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of the archives listed in ``manifest`` (column ``path``), each file read by one task from its start to its end."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, name = _file_system(path)
                with system.open_input_stream(name, compression=None, buffer_size=PIECE) as stream:
                    yield from _batched(read_records(stream, with_payload))

    files = manifest.select("path")
    return files.repartition(max(1, files.count()), "path").mapInArrow(read, RECORD_SCHEMA)


def read_binary(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of archives in any store that Spark reads; a file must fit into one value (2 GB)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                yield from _batched(read_records(pa.BufferReader(content.as_buffer()), with_payload))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, RECORD_SCHEMA)


def round_trip(pages: DataFrame, folder: str | None = None, least_revisit: int = LEAST_REVISIT, with_payload: bool = True) -> DataFrame:
    """Write all ``pages`` (page_id, url, html) as archives below ``folder`` and read them back."""
    folder = folder or scratch(pages.sparkSession, "warc")
    return read_archives(write_archives(plan_records(pages, least_revisit), folder), with_payload)
