"""Packing token ids into windows by best-fit decreasing.

Each task packs the documents of its own partition, so nothing is shuffled: documents longer than a window
are first cut into full windows, the remainders are placed from the longest to the shortest, each into the
open window whose free space is the least that holds it.  A segment tree over the free space finds that
window.  A partition leaves its last few windows part-filled, so padding is a matter of windows per
partition, not of rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import frugal, give_back, slices
from tracelake.llm.encoding import encoder

WINDOW = 4096
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class FreeSpace:
    """Segment tree over free space 0..capacity: is a window open with that much, and which is the tightest?"""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _count(self, free: int, by: int) -> None:
        node = self.leaves + free
        while node:
            self.open[node] += by
            node >>= 1

    def put(self, window: int, free: int) -> None:
        if free:
            self.windows[free].append(window)
            self._count(free, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(window, free space) of the open window with the least free space of at least ``need``."""
        node = self.leaves + need
        if not self.open[node]:
            while node > 1 and (node & 1 or not self.open[node + 1]):  # up until a right neighbour has one
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.open[2 * node] else 2 * node + 1
        free = node - self.leaves
        self._count(free, -1)
        return self.windows[free].pop(), free


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(window, offset) for each length of 1..capacity, and the number of windows."""
    window, offset = np.zeros(lengths.size, np.int64), np.zeros(lengths.size, np.int64)
    space, n = FreeSpace(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        found = space.take(length)
        if found is None:
            found, n = (n, capacity), n + 1
        window[i], offset[i] = found[0], capacity - found[1]
        space.put(found[0], found[1] - length)
    return window, offset, n


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """One row a piece: where it lies in its document and in its sequence, and the crc32 of its ids.

    A null or empty text is its end id alone.  Repeated rows are packed each on its own, null ids stay null;
    only doc_id and text are read, so further columns can't clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, high = encoder(vocabulary), TaskContext.get().partitionId() << 36
        full = 0
        doc_ids, rests, crcs, sizes = [], [], [], []
        for batch in slices(batches, limit=2 << 20):
            pieces = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode.encode(batch.column("text").to_pylist())):
                ids = np.append(ids, ids.dtype.type(end_id)).astype("<u4")
                whole = ids.size // window
                for k in range(whole):
                    pieces.append((doc_id, k * window, window, zlib.crc32(ids[k * window : (k + 1) * window].tobytes()), ids.size, high + 2 * full, 0))
                    full += 1
                if ids.size > whole * window:
                    doc_ids.append(doc_id)
                    rests.append(ids.size - whole * window)
                    crcs.append(zlib.crc32(ids[whole * window :].tobytes()))
                    sizes.append(ids.size)
            if pieces:
                yield _batch(*zip(*pieces))
            give_back()
        if doc_ids:
            rest, size = np.array(rests, np.int64), np.array(sizes, np.int64)
            place, offset, _ = best_fit(rest, window)
            yield _batch(doc_ids, size - rest, rest, crcs, size, high + 2 * place + 1, offset)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(run, keeps=True), _PIECES)


def _batch(*columns) -> pa.RecordBatch:
    names = [c.split()[0] for c in _PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def op6_pack(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
