"""WARC archives as seekable Zstandard bundles.

Each task writes bundles of its own: records are grouped into independent Zstandard frames, and a footer, a skippable
frame, holds the seek table of the public seekable format (compressed and decompressed size of each frame). An index maps record
identifiers to bundle, frame and offset within the frame, so one record costs one frame. Of equal long payloads one
record is a response and the others revisit it, found by pre-aggregated digests; payloads are shuffled only if the
table of repeated digests is too large to broadcast.

A bundle's name holds the attempt that wrote it, and only bundles of attempts that Spark committed are in the index, so
lost executors and second attempts leave stray files at worst, which nobody reads.

Defined results: null html is an empty payload; a null url writes no target; rows with a null page_id are records without
a number, never the one referred to while another has one; rows that repeat the largest page_id of a payload are all
responses; an empty table gives no bundles and an empty result; other columns are not touched.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, written

#: Payloads from LEAST bytes on are revisited. A frame closes at FRAME bytes of records, a bundle at BUNDLE bytes.
LEAST, FRAME, BUNDLE = 1000, 1 << 18, 1 << 25
#: Tasks that read bundles, at most; beyond that a task reads several.
READERS = 100_000
#: Fixed values of the formats.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_ID = "urn:x-page:"


def roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is null for responses, else the page_id of the response."""
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    p = p.withColumn("_long", F.octet_length("html") >= least)
    sums = p.filter("_long").select("page_id", F.sha2("html", 256).alias("_sha"))
    same = sums.groupBy("_sha").agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1 and _first is not null")
    same = written(same.select(F.unhex("_sha").alias("_sha"), "_first"), "repeats")
    p = p.withColumn("_key", F.when(F.col("_long"), F.unhex(F.sha2("html", 256))))
    p = p.join(same, p["_key"] == same["_sha"], "left")
    return p.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record: HTTP head and payload, or the head alone in a revisit."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind, block = ("response", head + payload) if refers_to is None else ("revisit", head)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(url.split()))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode())
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{_ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The record at an offset of a frame: its fields, its block, and where the next one starts."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no record at {at}: {first[:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines)
    stop = end + 4 + int(fields["Content-Length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} doesn't end at {stop}")
    return fields, data[end + 4 : stop], stop + 4


class Bundle:
    """A seekable Zstandard file that is being written."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.out, self.zip = store.open_output_stream(path, compression=None), zstandard.ZstdCompressor(level=3)
        self.frames: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.size = self.bytes = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Where the record stands: frame and offset within it."""
        if self.held and self.size + len(data) > FRAME:
            self.flush()
        at = len(self.frames), self.size
        self.held.append(data)
        self.size += len(data)
        return at

    def flush(self) -> None:
        if self.held:
            packed = self.zip.compress(b"".join(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.bytes += len(packed)
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


def seek_table(file) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of each frame, from the footer."""
    size = file.size()
    n, flags, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table")
    sizes, out, at = struct.iter_unpack("<II", file.read_at(8 * n, size - 9 - 8 * n)), [], 0
    for packed, plain in sizes:
        out.append((at, packed, plain))
        at += packed
    return out


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


INDEX = "bundle string, page_id bigint, frame int, at bigint, n bigint"


def write_bundles(records: DataFrame, folder: str | None = None) -> tuple[str, DataFrame]:
    """Writes the rows of roles() as bundles; returns their folder and the index (bundle, page_id, frame, at, n)."""
    folder = folder or f"{shared_dir(records.sparkSession)}/warc-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        task, bundle, k = TaskContext.get(), None, 0
        name = ""
        for batch in batches:
            rows: list[tuple] = []
            for x in (r for i in range(0, batch.num_rows, 64) for r in batch.slice(i, 64).to_pylist()):
                if bundle is None:
                    name = f"{task.stageId():05d}-{task.partitionId():05d}-{task.taskAttemptId()}-{k:05d}.warc.zst"
                    bundle, k = Bundle(store, f"{path}/{name}"), k + 1
                data = record(x["page_id"], x["url"], x["html"].encode(), x["refers_to"])
                rows.append((name, x["page_id"], *bundle.add(data), len(data)))
                if bundle.bytes + bundle.size >= BUNDLE:
                    bundle.close()
                    bundle = None
            yield pa.RecordBatch.from_pylist([dict(zip(("bundle", "page_id", "frame", "at", "n"), r, strict=True)) for r in rows], schema=pa.schema([("bundle", pa.string()), ("page_id", pa.int64()), ("frame", pa.int32()), ("at", pa.int64()), ("n", pa.int64())]))
        if bundle is not None:
            bundle.close()

    return folder, written(records.mapInArrow(run, INDEX), "warc-index")


def _read(store: fs.FileSystem, path: str, payloads: bool) -> Iterator[dict]:
    with store.open_input_file(path) as file:
        for at, packed, plain in seek_table(file):
            data, next_ = zstandard.ZstdDecompressor().decompress(file.read_at(packed, at), max_output_size=plain), 0
            while next_ < len(data):
                fields, block, next_ = parse(data, next_)
                head, _, payload = block.partition(b"\r\n\r\n")
                size = int(head.decode().rsplit("Content-Length: ", 1)[1])
                digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
                if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).digest() != digest):
                    raise ValueError(f"{path}: damaged payload in {fields['WARC-Record-ID']}")
                number = lambda x: int(y) if x and (y := x.strip("<>").removeprefix(_ID)) else None
                out = {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To")), "payload_bytes": size, "payload_digest": digest.hex()}
                yield out | ({"payload": payload if fields["WARC-Type"] == "response" else None} if payloads else {})


def read_bundles(folder: str, index: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the index's bundles, frame by frame; each response is checked against its digest. payload is null in a revisit."""
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())] + [("payload", pa.binary())] * payloads
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held: list[dict] = []
                for x in _read(store, f"{path}/{name}", payloads):
                    held.append(x)
                    if len(held) >= (64 if payloads else 4096):
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    ddl = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string" + ", payload binary" * payloads
    bundles = index.select("bundle").distinct()
    tasks = max(1, min(bundles.count(), READERS))  # names are short: dealt by size, all would go to one task
    return bundles.repartition(tasks).mapInArrow(run, ddl)


def read_record(folder: str, bundle: str, frame: int, at: int) -> tuple[dict[str, str], bytes]:
    """One record through the index: reads the footer and one frame."""
    store, path = _store(folder)
    with store.open_input_file(f"{path}/{bundle}") as file:
        start, packed, plain = seek_table(file)[frame]
        data = zstandard.ZstdDecompressor().decompress(file.read_at(packed, start), max_output_size=plain)
    fields, block, _ = parse(data, at)
    return fields, block


ORACLE = """
SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
       CASE WHEN strlen(coalesce(html, '')) >= 1000 AND page_id IS DISTINCT FROM max(page_id) OVER w
            AND max(page_id) OVER w IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(coalesce(html, '')) >= 1000 AND page_id IS DISTINCT FROM max(page_id) OVER w
            THEN max(page_id) OVER w END AS refers_to
FROM pages WINDOW w AS (PARTITION BY coalesce(html, ''))
"""
