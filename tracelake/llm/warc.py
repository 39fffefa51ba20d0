"""WARC archives in seekable Zstandard bundles.

A bundle is a run of independent frames, each holding a group of records, then two skippable frames: the
record map (identifier -> frame, offset in the frame, length) and the seek table of the public seekable
format (compressed and plain size of each frame, footer).  A record is found by its identifier and costs
one frame to read.  Bundles are written by the tasks that scan the pages; nothing but the digests of equal
payloads is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import materialize, small_side, slices, workspace
from tracelake.llm.files import new_file, open_file

#: Plain bytes of records a frame, frames' plain bytes a bundle.
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 256 << 20
#: Fixed values of the Zstandard and seekable formats.
MAP_MAGIC, SEEK_MAGIC, FOOT_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
_FOOT = struct.Struct("<IBI")
_ENTRY = np.dtype([("frame", "<u4"), ("offset", "<u4"), ("length", "<u4")])
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'-' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", record)
    return int(found[1]) if found else None


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit of the page ``refers_to``; control characters of a url are percent-encoded."""
    revisit = refers_to is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f-\x9f  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url))
    body = _HTTP if revisit else _HTTP + payload
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to)}",
            f"X-Payload-Length: {len(payload)}",
        ]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = block[: int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


class BundleWriter:
    def __init__(self, stream, frame_bytes: int = FRAME_BYTES):
        self.stream, self.frame_bytes = stream, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=3)
        self.pending, self.filled, self.plain = [], 0, 0
        self.sizes: list[tuple[int, int]] = []
        self.ids: list[str] = []
        self.entries: list[tuple[int, int, int]] = []

    def add(self, identifier: str, record: bytes) -> None:
        self.ids.append(identifier)
        self.entries.append((len(self.sizes), self.filled, len(record)))
        self.pending.append(record)
        self.filled += len(record)
        self.plain += len(record)
        if self.filled >= self.frame_bytes:
            self._frame()

    def _frame(self) -> None:
        if self.pending:
            packed = self.zstd.compress(b"".join(self.pending))
            self.stream.write(packed)
            self.sizes.append((len(packed), self.filled))
            self.pending, self.filled = [], 0

    def close(self) -> None:
        self._frame()
        ids = json.dumps(self.ids).encode()
        entries = np.array(self.entries, _ENTRY).tobytes()
        records = self.zstd.compress(struct.pack("<QQ", len(self.ids), len(ids)) + ids + entries)
        table = np.array(self.sizes, "<u4").tobytes() + _FOOT.pack(len(self.sizes), 0, FOOT_MAGIC)
        self.stream.write(struct.pack("<II", MAP_MAGIC, len(records)) + records)
        self.stream.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)
        self.stream.close()


class Bundle:
    """Reads a bundle by its seek table; ``record`` fetches one identifier."""

    def __init__(self, source):
        self.source, size = source, source.size()
        source.seek(size - _FOOT.size)
        frames, flags, magic = _FOOT.unpack(source.read(_FOOT.size))
        if magic != FOOT_MAGIC:
            raise ValueError("no seek table")
        table = size - _FOOT.size - 8 * frames
        source.seek(table)
        self.sizes = np.frombuffer(source.read(8 * frames), "<u4").reshape(frames, 2).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes[:, 0])))
        source.seek(int(self.starts[-1]))
        magic, length = struct.unpack("<II", source.read(8))
        if magic != MAP_MAGIC:
            raise ValueError("no record map")
        self.zstd = zstandard.ZstdDecompressor()
        raw = self.zstd.decompress(source.read(length))
        n, named = struct.unpack_from("<QQ", raw)
        self.ids = json.loads(raw[16 : 16 + named])
        self.entries = np.frombuffer(raw, _ENTRY, n, 16 + named)
        self.places: dict[str, int] | None = None

    def frame(self, k: int) -> bytes:
        self.source.seek(int(self.starts[k]))
        return self.zstd.decompress(self.source.read(int(self.sizes[k, 0])), max_output_size=int(self.sizes[k, 1]))

    def records(self) -> Iterator[list[tuple[str, bytes]]]:
        """(identifier, record) pairs, a frame at a time."""
        cuts = np.searchsorted(self.entries["frame"], np.arange(len(self.sizes) + 1))
        for k, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
            plain = self.frame(k)
            yield [(self.ids[i], plain[o : o + n]) for i, (_, o, n) in zip(range(a, b), self.entries[a:b].tolist())]

    def record(self, identifier: str) -> bytes:
        if self.places is None:
            self.places = {x: i for i, x in enumerate(self.ids)}
        k, offset, length = self.entries[self.places[identifier]].tolist()
        return self.frame(k)[offset : offset + length]


# ---------------------------------------------------------------- Spark
_MANIFEST = "path string, records long, plain_bytes long"
_RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def write_bundles(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """A record for each row of ``pages`` (page_id, url, html); the manifest has one row a bundle.

    Of rows with equal payloads of at least ``min_revisit_bytes`` that with the largest page_id is the
    response, the others revisit it; a null html is an empty payload.  Rows without page_id are responses,
    and so are all rows that repeat the largest page_id.
    """
    folder = folder or workspace(pages.sparkSession) + "/warc"
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    shared = (
        rows.where(F.octet_length("html") >= min_revisit_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and first is not null")
        .select("digest", "first")
    )
    linked = rows.join(small_side(shared, "shared"), "digest", "left").select(
        "page_id", "url", "html", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, writer, done = TaskContext.get().partitionId(), None, []

        def close() -> None:
            writer.close()
            done.append((path, len(writer.ids), writer.plain))

        for batch in slices(batches, "html", 2 << 20):
            for page_id, url, text, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if writer is None:
                    path, stream = new_file(folder, f"bundle-{number:06d}-{len(done):04d}", ".warc.zst")
                    writer = BundleWriter(stream, frame_bytes)
                payload = text.encode()
                writer.add(record_id(page_id), build_record(page_id, url, payload, payload_digest(payload), refers_to))
                if writer.plain >= bundle_bytes:
                    close()
                    writer = None
        if writer is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["path", "records", "plain_bytes"])

    return materialize(linked.mapInArrow(write, _MANIFEST), "bundles")


def read_bundles(manifest: DataFrame) -> DataFrame:
    """One row a record, from the archives alone; digests of responses are computed from their payloads."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _RECORDS.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with open_file(path) as source:
                    for group in Bundle(source).records():
                        rows = []
                        for identifier, raw in group:
                            fields, payload = parse_record(raw)
                            kind = fields["WARC-Type"]
                            if kind == "revisit":
                                size, digest = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                            else:
                                size, digest = len(payload), payload_digest(payload)
                            rows.append((page_of(identifier), size, digest, kind, page_of(fields.get("WARC-Refers-To", ""))))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(read, _RECORDS)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    return read_bundles(write_bundles(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))
