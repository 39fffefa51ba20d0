"""Fixed-size summaries of all hashes of a corpus: a Bloom bitmap and a count table.

Both are built by tasks, chunk by chunk, and broadcast; their size is bounded by a constant, whatever the
input.  They only steer work (which rows travel, in which order tokens are indexed): a hash that they pass
wrongly costs time, and none that matters is ever lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import TEXT_ROWS, arrow_rows, frugal

#: Bits of one chunk of a bitmap (256 KB); a bitmap has at most MAX_CHUNKS of them (128 MB).
CHUNK_BITS, MAX_CHUNKS = 21, 512
#: Bits that a hash sets at most, and bits of the bitmap for each hash below the bound.
PROBES, BITS_PER_HASH = 5, 16
#: Counters of a count table (one byte each when broadcast), and pieces in which it is added up.
COUNT_BITS, COUNT_PIECES = 21, 16


def _chunk(hashes: np.ndarray, chunks: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) & np.uint64(chunks - 1)).astype(np.int64)


def _bit(hashes: np.ndarray, i: int) -> np.ndarray:
    """The i-th bit of each hash within its chunk."""
    step = (hashes >> np.uint64(21)) | np.uint64(1)
    return ((hashes + np.uint64(i) * step + np.uint64(i * i)) & np.uint64((1 << CHUNK_BITS) - 1)).astype(np.int64)


class Bitmap:
    """Some bits a hash within one chunk."""

    def __init__(self, bits: np.ndarray, probes: int):
        self.bits, self.probes = bits, probes  # bits: uint8 [chunks, bytes]

    def has(self, hashes: np.ndarray) -> np.ndarray:
        flat, out = self.bits.reshape(-1), np.zeros(hashes.size, bool)
        at = np.arange(hashes.size)
        for i in range(self.probes):  # each probe looks only at what the probes before have left
            h = hashes[at]
            bit = _bit(h, i)
            at = at[(flat[(_chunk(h, len(self.bits)) << (CHUNK_BITS - 3)) + (bit >> 3)] >> (bit & 7).astype(np.uint8)) & 1 > 0]
        out[at] = True
        return out


def bitmap(hashes: DataFrame, column: str, rows: int, max_chunks: int = MAX_CHUNKS):
    """Broadcast Bitmap of a long column of hashes; sized by ``rows`` up to the fixed bound.

    Each hash sets as many bits as let through the fewest others at the size it got.
    """
    chunks = 1
    while chunks < max_chunks and chunks << CHUNK_BITS < BITS_PER_HASH * rows:
        chunks *= 2
    probes = min(PROBES, max(1, round(0.69 * (chunks << CHUNK_BITS) / max(1, rows))))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            chunk = _chunk(h, chunks)
            for c in np.unique(chunk).tolist():
                bits = parts.setdefault(c, np.zeros(1 << CHUNK_BITS, bool))
                for i in range(probes):
                    bits[_bit(h[chunk == c], i)] = True
        for c, bits in parts.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([c], pa.int32()), "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    key = F.shiftright(F.col(column), 40).bitwiseAND(F.lit(chunks - 1)).cast("int")
    dealt = hashes.select(F.col(column).alias("h"), key.alias("chunk")).repartition("chunk").select("h")
    out = np.zeros((chunks, 1 << (CHUNK_BITS - 3)), np.uint8)
    for row in dealt.mapInArrow(fill, "chunk int, bits binary").toLocalIterator():  # 256 KB a chunk
        out[row.chunk] |= np.frombuffer(row.bits, np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(Bitmap(out, probes))


def count_places(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def count_table(batches_of_hashes, source: DataFrame):
    """Broadcast table of rough counts, one byte a counter: 16 * log2(1 + count), at most 255.

    ``batches_of_hashes`` turns an iterator of record batches of ``source`` into arrays of hashes.
    """
    size = 1 << (COUNT_BITS - COUNT_PIECES.bit_length() + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, np.uint32)
        for h in batches_of_hashes(batches):
            total += np.bincount(count_places(h), minlength=total.size).astype(np.uint32)
        for k in range(COUNT_PIECES):
            part = total[k * size : (k + 1) * size]
            if part.any():
                yield pa.RecordBatch.from_pydict({"piece": pa.array([k], pa.int32()), "counts": [zstandard.compress(part.tobytes(), 1)]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(zstandard.decompress(raw, 4 * size), np.uint32)
                sums[k] = part.astype(np.uint64) if k not in sums else sums[k] + part
        for k, part in sums.items():
            level = np.minimum(255, np.round(16 * np.log2(1 + part.astype(np.float64)))).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"piece": pa.array([k], pa.int32()), "counts": [level.tobytes()]})

    counted = source.mapInArrow(frugal(count), "piece int, counts binary").repartition(COUNT_PIECES, "piece")
    table = np.zeros(1 << COUNT_BITS, np.uint8)
    with arrow_rows(source.sparkSession, TEXT_ROWS):
        for row in counted.mapInArrow(frugal(add), "piece int, counts binary").toLocalIterator():
            table[row.piece * size : (row.piece + 1) * size] = np.frombuffer(row.counts, np.uint8)
    return source.sparkSession.sparkContext.broadcast(table)
