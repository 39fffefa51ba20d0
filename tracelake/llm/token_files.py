"""Token ids in files of patched frame-of-reference blocks, in ascending doc_id order.

A file is a magic, blocks of BLOCK ids, and a footer.  In a block the minimum is subtracted, what is left
is packed at the width that covers a given share of the ids, and the ids that need more bits (the patches)
follow as positions and values.  The footer holds the start of each block and the ids of each document:

    magic | blocks | block starts u8[] | doc ids i8[] | null flags u1[] | ids per doc u8[] | tail
    block: minimum u4, width u1, patches u2, packed bits, positions u2[], values u4[]
    tail:  blocks u8, documents u8, ids u8, footer start u8, magic
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import materialize, slices, workspace
from tracelake.llm.encoding import encoder
from tracelake.llm.files import new_file, open_file

MAGIC = b"TLPFOR1\n"
BLOCK = 512
#: Share of a block's ids that the packed width must cover.
COVERED = 0.9
_HEAD, _TAIL = np.dtype([("low", "<u4"), ("width", "u1"), ("patches", "<u2")]), struct.Struct("<QQQQ8s")


# ---------------------------------------------------------------- blocks
_BITS = np.concatenate([np.full(max(1, 1 << b >> 1), b, np.uint8) for b in range(17)])  # of each number below 65536


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    high = values >> np.uint32(16)
    return np.where(high > 0, _BITS[high] + np.uint8(16), _BITS[values & np.uint32(0xFFFF)])


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values (a multiple of 8 each) as rows of bytes, ``width`` bits a value, low bits first."""
    eights = values.reshape(-1, 8).astype(np.uint64)
    words = np.zeros((len(eights), width // 8 + 2), np.uint64)
    for j in range(8):  # eight values fill ``width`` bytes
        k, shift = divmod(width * j, 64)
        words[:, k] |= eights[:, j] << np.uint64(shift)
        if shift + width > 64:
            words[:, k + 1] |= eights[:, j] >> np.uint64(64 - shift)
    return words.view(np.uint8)[:, :width].reshape(len(values), -1)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    """Rows of values from rows of bytes (a multiple of ``width`` each)."""
    n = packed.size // width if width else 0
    words = np.zeros((n, width // 8 + 2), np.uint64)
    words.view(np.uint8)[:, :width] = packed.reshape(n, width)
    out, mask = np.empty((n, 8), np.uint32), np.uint64((1 << width) - 1)
    for j in range(8):
        k, shift = divmod(width * j, 64)
        value = words[:, k] >> np.uint64(shift)
        if shift + width > 64:
            value |= words[:, k + 1] << np.uint64(64 - shift)
        out[:, j] = value & mask
    return out.reshape(len(packed), -1)


def _spread(starts: np.ndarray, length: int) -> np.ndarray:
    return starts[:, None] + np.arange(length)


def encode_blocks(ids: np.ndarray, covered: float = COVERED) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, start of each block) of ``ids`` in blocks of BLOCK; the last may be shorter."""
    parts, starts, at = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)], 0
    whole = ids.size // BLOCK * BLOCK
    for rows in (ids[:whole].reshape(-1, BLOCK), ids[whole:].reshape(1, -1)):
        if not rows.size:
            continue
        size = rows.shape[1]
        low = rows.min(axis=1)
        left = (rows - low[:, None]).astype(np.uint32)
        bits = _bit_lengths(left)
        nth = max(0, -(-int(covered * 1000) * size // 1000) - 1)
        width = np.partition(bits, nth, axis=1)[:, nth].astype(np.int64)
        row, place = np.nonzero(bits > width[:, None])
        patches = np.bincount(row, minlength=len(rows))
        plain = (width * size + 7) // 8
        length = _HEAD.itemsize + plain + 6 * patches
        begin = np.cumsum(length) - length
        out = np.zeros(int(length.sum()), np.uint8)
        head = np.empty(len(rows), _HEAD)
        head["low"], head["width"], head["patches"] = low, width, patches
        out[_spread(begin, _HEAD.itemsize)] = head.view(np.uint8).reshape(len(rows), -1)
        for w in np.unique(width[width > 0]).tolist():
            of = np.flatnonzero(width == w)
            values = np.zeros((len(of), -(-size // 8) * 8), np.uint32)
            values[:, :size] = left[of] & np.uint32((1 << w) - 1)
            n = (w * size + 7) // 8
            out[_spread(begin[of] + _HEAD.itemsize, n)] = _pack(values, w)[:, :n]
        if row.size:
            rank = np.arange(row.size) - (np.cumsum(patches) - patches)[row]
            tail = (begin + _HEAD.itemsize + plain)[row]
            out[_spread(tail + 2 * rank, 2)] = place.astype("<u2").view(np.uint8).reshape(-1, 2)
            out[_spread(tail + 2 * patches[row] + 4 * rank, 4)] = left[row, place].astype("<u4").view(np.uint8).reshape(-1, 4)
        parts.append(out)
        starts.append(begin + at)
        at += out.size
    return np.concatenate(parts), np.concatenate(starts)


def decode_blocks(data: bytes, starts: np.ndarray, total: int) -> np.ndarray:
    """The ids of consecutive blocks; starts are relative to data, total is the number of ids in them."""
    raw, out = np.frombuffer(data, np.uint8), np.empty(total, np.uint32)
    head = np.ascontiguousarray(raw[_spread(starts, _HEAD.itemsize)]).view(_HEAD).reshape(-1)
    width, patches = head["width"].astype(np.int64), head["patches"].astype(np.int64)
    size = np.minimum(BLOCK, total - np.arange(starts.size) * BLOCK)
    body, plain = starts + _HEAD.itemsize, (width * size + 7) // 8
    for w, n in {(w, n) for w, n in zip(width.tolist(), size.tolist())}:
        of = np.flatnonzero((width == w) & (size == n))
        eights, stored = -(-n // 8), (w * n + 7) // 8
        packed = np.zeros((of.size, w * eights), np.uint8)
        packed[:, :stored] = raw[_spread(body[of], stored)]
        values = _unpack(packed, w)[:, :n] if w else np.zeros((of.size, n), np.uint32)
        out[_spread(of * BLOCK, n)] = values + head["low"][of][:, None]
    if patches.any():
        block = np.repeat(np.arange(starts.size), patches)
        rank = np.arange(block.size) - (np.cumsum(patches) - patches)[block]
        tail = (body + plain)[block]
        place = np.ascontiguousarray(raw[_spread(tail + 2 * rank, 2)]).view("<u2").reshape(-1)
        value = np.ascontiguousarray(raw[_spread(tail + 2 * patches[block] + 4 * rank, 4)]).view("<u4").reshape(-1)
        out[block * BLOCK + place] = value + head["low"][block]
    return out


class TokenFileWriter:
    """Appends documents; memory stays at a few hundred blocks and 17 bytes a document."""

    def __init__(self, stream, covered: float = COVERED):
        self.stream, self.covered = stream, covered
        self.stream.write(MAGIC)
        self.at, self.ids, self.blocks, self.starts = len(MAGIC), 0, 0, [np.zeros(0, np.int64)]
        self.doc_ids, self.sizes, self.waiting, self.n_waiting = [], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.sizes.append(ids.size)
        self.waiting.append(ids.astype(np.int64))
        self.n_waiting += ids.size
        if self.n_waiting >= 256 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate([*self.waiting, np.zeros(0, np.int64)])
        cut = ids.size if last else ids.size // BLOCK * BLOCK
        for a in range(0, cut, 256 * BLOCK):
            data, starts = encode_blocks(ids[a : min(cut, a + 256 * BLOCK)], self.covered)
            self.starts.append(starts + self.at)
            self.stream.write(data.tobytes())
            self.at += data.size
        self.blocks += -(-cut // BLOCK)
        self.ids += cut
        self.waiting, self.n_waiting = [ids[cut:]], ids.size - cut

    def close(self) -> None:
        self._flush(True)
        null = [d is None for d in self.doc_ids]
        for part in (np.concatenate(self.starts).astype("<u8"), np.array([d or 0 for d in self.doc_ids], "<i8"), np.array(null, "u1"), np.array(self.sizes, "<u8")):
            self.stream.write(part.tobytes())
        self.stream.write(_TAIL.pack(self.blocks, len(self.doc_ids), self.ids, self.at, MAGIC))
        self.stream.close()


class TokenFile:
    """Random access to the ids of a file: only the blocks that hold a range are read."""

    def __init__(self, source):
        self.source, size = source, source.size()
        source.seek(size - _TAIL.size)
        blocks, docs, self.ids, self.footer, magic = _TAIL.unpack(source.read(_TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        source.seek(self.footer)
        raw = source.read(size - _TAIL.size - self.footer)
        self.starts = np.append(np.frombuffer(raw, "<u8", blocks), np.uint64(self.footer)).astype(np.int64)
        at = 8 * blocks
        self.doc_ids = np.frombuffer(raw, "<i8", docs, at)
        self.null = np.frombuffer(raw, "u1", docs, at + 8 * docs).astype(bool)
        self.sizes = np.frombuffer(raw, "<u8", docs, at + 9 * docs).astype(np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.sizes)))

    def read(self, begin: int, end: int) -> np.ndarray:
        if end <= begin:
            return np.zeros(0, np.uint32)
        first, last = begin // BLOCK, -(-end // BLOCK)
        lo, hi = int(self.starts[first]), int(self.starts[last])
        self.source.seek(lo)
        ids = decode_blocks(self.source.read(hi - lo), self.starts[first:last] - lo, min(last * BLOCK, self.ids) - first * BLOCK)
        return ids[begin - first * BLOCK : end - first * BLOCK]


# ---------------------------------------------------------------- Spark
_MANIFEST = "file_no int, path string, docs long, ids long, bytes long"
_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int = 0, folder: str | None = None, covered: float = COVERED) -> DataFrame:
    """Encode every text of ``docs`` and write the ids; the manifest has one row a file.

    Documents are range-partitioned and sorted by doc_id, so the files in order of file_no hold them in
    ascending order (null ids first, equal ids in any order).  A null or empty text gives the end id alone.
    """
    folder = folder or workspace(docs.sparkSession) + "/tokens"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number, writer = encoder(vocabulary), TaskContext.get().partitionId(), None
        for batch in slices(batches, limit=2 << 20):
            if writer is None:
                path, stream = new_file(folder, f"part-{number:06d}", ".tok")
                writer = TokenFileWriter(stream, covered)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode.encode(batch.column("text").to_pylist())):
                writer.add(doc_id, np.append(ids, ids.dtype.type(end_id)))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"file_no": pa.array([number], pa.int32()), "path": [path], "docs": [len(writer.doc_ids)], "ids": [writer.ids], "bytes": [writer.at]})

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return materialize(ordered.mapInArrow(write, _MANIFEST), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read from the files; start counts all files before."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                with open_file(path) as source:
                    file = TokenFile(source)
                    group = file.begin[:-1] // (1 << 18)
                    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)] if len(group) else [0]
                    for a, b in zip(cuts, cuts[1:]):
                        at = file.begin[a : b + 1]
                        ids = file.read(int(at[0]), int(at[-1])).astype("<u4")
                        crc = [zlib.crc32(ids[x - at[0] : y - at[0]].tobytes()) for x, y in zip(at, at[1:])]
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array(file.doc_ids[a:b], pa.int64(), mask=file.null[a:b]), "start": at[:-1] + base,
                            "n_tokens": file.sizes[a:b], "ids_crc32": pa.array(crc, pa.int64()),
                        })

    files = manifest.count()
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    placed = manifest.select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return placed.repartition(max(1, files)).mapInArrow(read, _READ)


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json")))
