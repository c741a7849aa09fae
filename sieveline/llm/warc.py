"""WARC archives as seekable Zstandard bundles, with an index from records to frames."""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import stage, staged_path

#: Uncompressed bytes after which a frame is closed: what one random read decompresses.
FRAME_BYTES = 1 << 20
#: Compressed bytes after which a bundle is closed and the next begun.
BUNDLE_BYTES = 256 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"

# --- fixed values: the seekable format and base32 -------------------------------
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

INDEX = "id string, file string, frame int, offset long, length long"


def base32_sha1(data: Column) -> Column:
    """SHA-1 of bytes in upper-case base32 without padding: four letters for each five hex digits."""
    h = F.sha1(data)
    out = []
    for i in range(8):
        v = F.conv(F.substring(h, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            out.append(F.substring(F.lit(BASE32), F.shiftright(v, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*out)


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """(id, url, payload, bytes, digest, type, refers_to): what each row's record says.

    Of rows with equal payloads of ``least_bytes`` or more, the one with the
    smallest id is the response and the others revisit it. Rows that share the
    smallest id are responses each; a null id never is the smallest unless all
    are null. A null body is an empty payload.

    Digests with more than one row are counted first and written, so that the
    join has plain exchanges on both sides and adaptive execution can split a
    payload that very many rows share.
    """
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(body_col), F.lit("")), "UTF-8").alias("payload")
    )
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", base32_sha1(F.col("payload")))
    groups = rows.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    shared = stage(groups.where("n > 1").select("digest", "bytes", "first"), "payloads")
    tied = rows.join(shared, ["digest", "bytes"], "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return tied.select(
        "id", "url", F.when(~again, F.col("payload")).alias("payload"), "bytes", "digest",
        F.when(again, "revisit").otherwise("response").alias("type"), F.when(again, F.col("first")).alias("refers_to"),
    )


def record(page: str | None, url: str | None, payload: bytes | None, size: int, digest: str, kind: str, refers_to: str | None, date: str = DATE) -> bytes:
    """One WARC record; a revisit has no payload."""
    block = HTTP + (payload or b"")
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Bytes: {size}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, payload) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    return fields, block.partition(b"\r\n\r\n")[2]


class BundleWriter:
    """Appends records to frames of a bundle; the seek table is the last, skippable frame."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.out, self.frame_bytes = out, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.buffer = io.BytesIO()
        self.written = 0

    def add(self, data: bytes) -> tuple[int, int, int]:
        """(frame, offset in the frame, length) of a record."""
        if self.buffer.tell() and self.buffer.tell() + len(data) > self.frame_bytes:
            self.flush()
        place = (len(self.frames), self.buffer.tell(), len(data))
        self.buffer.write(data)
        return place

    def flush(self) -> None:
        raw = self.buffer.getvalue()
        if raw:
            packed = self.compressor.compress(raw)
            self.out.write(packed)
            self.frames.append((len(packed), len(raw)))
            self.written += len(packed)
            self.buffer = io.BytesIO()

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        table = entries + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class BundleReader:
    """Reads single frames of a bundle by its seek table."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        source.seek(end - 9)
        count, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table at the end of the file")
        source.seek(end - 9 - 8 * count)
        sizes = struct.iter_unpack("<II", source.read(8 * count))
        self.starts, at = [], 0
        for packed, raw in sizes:
            self.starts.append((at, packed, raw))
            at += packed
        self.current: tuple[int, bytes] = (-1, b"")

    def read(self, frame: int, offset: int, length: int) -> bytes:
        if self.current[0] != frame:
            at, packed, raw = self.starts[frame]
            self.source.seek(at)
            self.current = (frame, zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=raw))
        return self.current[1][offset : offset + length]


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder all executors share: local, HDFS or an object store."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_bundles(records: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write the records of :func:`plan_records` to bundles in ``folder``; the index, (id, file, frame, offset, length).

    Each task streams its rows to bundles of its own, holding one frame at a
    time. A file's name has the number of the task's attempt, and the index,
    written before this returns, names the files of the attempts that
    counted, so repeated and abandoned attempts do no harm.
    """

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        task, writer, name, n = TaskContext.get(), None, "", 0
        for part in parts:
            rows = []
            for r in part.itertuples(index=False):
                if writer is None:
                    name = f"bundle-{task.partitionId():06d}-{task.taskAttemptId()}-{n}.warc.zst"
                    writer, n = BundleWriter(store.open_output_stream(f"{path}/{name}", compression=None), frame_bytes), n + 1
                data = record(r.id, r.url, r.payload, int(r.bytes), r.digest, r.type, r.refers_to)
                rows.append((r.id, name, *writer.add(data)))
                if writer.written >= bundle_bytes:
                    writer.close()
                    writer = None
            yield pd.DataFrame(rows, columns=["id", "file", "frame", "offset", "length"])
        if writer is not None:
            writer.close()

    text = records.withColumn("id", F.col("id").cast("string")).withColumn("refers_to", F.col("refers_to").cast("string"))
    return stage(text.mapInPandas(write, INDEX), "warc-index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """(id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of the indexed records, read by seeking.

    Frames are dealt to tasks whole and read once each. The digest of a
    response is taken from the payload read, and must be the one its header
    states; a revisit has the header's and a null payload.
    """

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = open_store(folder)
        name, reader = None, None
        none = lambda urn: urn.removeprefix("<urn:page:").removesuffix(">") or None
        for part in parts:
            rows = []
            for r in part.itertuples(index=False):
                if r.file != name:
                    name, reader = r.file, BundleReader(store.open_input_file(f"{path}/{r.file}"))
                head, payload = parse_record(reader.read(r.frame, r.offset, r.length))
                digest, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
                size, refers = int(head["x-payload-bytes"]), None
                if kind == "response":
                    if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != size:
                        raise ValueError(f"{name}: record {r.id} differs from its digest")
                else:
                    payload, refers = None, none(head["warc-refers-to"])
                rows.append((none(head["warc-record-id"]), head.get("warc-target-uri"), payload, size, digest, kind, refers))
            yield pd.DataFrame(rows, columns=["id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    dealt = index.repartition("file", "frame").sortWithinPartitions("file", "frame", "offset")
    schema = "id string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string"
    return dealt.mapInPandas(read, schema)


def archive(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to bundles and read them back: (id, payload_bytes, payload_digest, record_type, refers_to).

    One record per row, repeated rows and null ids included; other columns are
    ignored. An empty table gives no bundle and an empty result.
    """
    folder = folder or staged_path(pages.sparkSession, "warc")
    kind = pages.schema[id_col].dataType
    index = write_bundles(plan_records(pages, id_col, url_col, body_col, least_bytes), folder)
    back = read_records(index, folder)
    return back.select(
        F.col("id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )
