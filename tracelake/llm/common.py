"""Shared helpers: the shared work folder, checked broadcasts and vectorised word hashing."""

from __future__ import annotations

import ctypes
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of anything but blank, tab, line feed, vertical tab, form feed, carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Rows up to which a side is broadcast; its size is read from the written table first.
BROADCAST_ROWS = 400_000
#: Rows with whole texts that go to Python at once, in jobs that run inside an operator.
TEXT_ROWS = 1000
#: Files a core, at most, of a table of ids or counts.
FILES_A_CORE = 2


# ---------------------------------------------------------------- shared folder
_own: list[str] = []  # this machine's folder, made once, for local sessions without a shared one (tests)


def workspace(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; only where that is unset, and all runs on this machine, one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="tracelake-"))
        base = _own[0]
    path = f"{base.rstrip('/')}/tracelake-{uuid.uuid4().hex}"
    for made in getattr(_made, "lists", []):
        made.append(path)
    return path


def materialize(df: DataFrame, name: str = "step", narrow: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage, survives lost executors.

    A ``narrow`` table, of ids or counts, is written in a few files a core, however many partitions it comes in.
    """
    spark = df.sparkSession
    path = f"{workspace(spark)}/{name}"
    if narrow:
        df = df.coalesce(FILES_A_CORE * max(1, spark.sparkContext.defaultParallelism))
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.written_at = path
    return kept


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def release(*written: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing that is still to run reads it."""
    for df in written:
        _delete(df.sparkSession, df.written_at.rpartition("/")[0])


_made = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end all folders that were made in it by this thread, but those of frames given to its value.

    All that reads the others has to run inside.
    """
    lists = _made.__dict__.setdefault("lists", [])
    made: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.written_at.rpartition("/")[0])
        return df

    lists.append(made)
    try:
        yield keep
    finally:
        lists.remove(made)
        for path in made:
            if path not in kept:
                _delete(spark, path)


def small_side(df: DataFrame, name: str = "side", rows: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """``df`` written to the shared folder, marked for broadcast only if its counted rows allow it.

    ``weight`` is what one row counts, for rows that hold arrays.  Beyond ``rows`` the same join runs as a
    shuffle join, so nothing depends on the side being small.
    """
    kept = materialize(df, name, narrow=True)
    size = kept.count() if weight is None else kept.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    return F.broadcast(kept) if size <= rows else kept


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows of wide values go to Python in batches of ``rows`` at most, in jobs that run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


# ---------------------------------------------------------------- Python workers
_kept: list[dict] = []
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def kept_in_worker(cache: dict) -> dict:
    """``cache``, which tasks leave to the next ones of their kind in the same Python worker."""
    _kept.append(cache)
    return cache


def forget() -> None:
    for cache in _kept:
        cache.clear()


def give_back() -> None:
    """Memory that Arrow's pool and the C library keep unused, some tens of MB, goes to the system; takes a few ms."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


_Batches = Iterator[pa.RecordBatch]


def frugal(run: Callable[[_Batches], _Batches], keeps: bool = False) -> Callable[[_Batches], _Batches]:
    """``run``, for mapInArrow, in workers that Spark goes on using for other stages.

    Its start drops the caches of other operators' tasks, unless it ``keeps`` them because they are its own.
    Unused memory is handed back at its start, when the last task's batches are gone, and at its end.
    """

    def task(batches: _Batches) -> _Batches:
        if not keeps:
            forget()
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


# ---------------------------------------------------------------- text batches
def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its row offsets (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    body = np.frombuffer(data, np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
    return body, offsets - lo


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text, so that work arrays stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(text_bytes(batch.column(column))[1])
        group = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


# ---------------------------------------------------------------- hashing
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, or those of its inverse."""
    got = _powers.get((base, inverse))
    if got is None or got.size < n:
        step = pow(base, -1, 2**64) if inverse else base
        got = np.full(max(n, 1 << 16), step, np.uint64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        if n <= 1 << 22:
            _powers[(base, inverse)] = got
    return got[:n]


def ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:end], the same wherever the range lies."""
    total = np.zeros(values.size + 1, np.uint64)
    np.cumsum(values * powers(base, values.size), out=total[1:])
    return (total[ends] - total[starts]) * powers(base, values.size + 1, True)[starts]


class Words:
    """The words of a batch of texts as arrays: byte spans, row of each word, words of each row.

    ``separator`` says which bytes stand between words, ``fold`` what each byte is read as.
    """

    def __init__(self, column: pa.Array, separator: np.ndarray = _SEPARATOR, fold: np.ndarray | None = None):
        self.data, self.offsets = text_bytes(column)
        if fold is not None:
            self.data = fold[self.data]
        data, n = self.data, self.data.size
        inside = ~separator[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        if n:
            at = self.offsets[:-1][self.offsets[:-1] < n]
            first[at] = inside[at]
            at = self.offsets[1:][self.offsets[1:] > 0] - 1
            last[at] = inside[at]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.rows = np.searchsorted(self.offsets, self.starts, "right") - 1
        self.counts = np.bincount(self.rows, minlength=self.offsets.size - 1).astype(np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.counts)))

    def hashes(self, seed: int = 0, block: int = 1 << 20) -> np.ndarray:
        """A 64-bit hash of each word; bytes are taken in blocks, so a long text needs no long arrays."""
        out = np.empty(self.starts.size, np.uint64)
        i = 0
        while i < self.starts.size:
            lo = int(self.starts[i])
            j = max(i + 1, int(np.searchsorted(self.starts, lo + block)))
            part = _BYTE[self.data[lo : int(self.ends[j - 1])]]
            if seed:
                part = mix(part + np.uint64(seed))
            s, e = self.starts[i:j] - lo, self.ends[i:j] - lo
            out[i:j] = mix(ranges(part, s, e, _BASES[0]) + (e - s).astype(np.uint64) * np.uint64(_BASES[1]))
            i = j
        return out

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Word index at which each k-word window starts, and its row."""
        if self.starts.size < k:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.rows[: self.rows.size - k + 1] == self.rows[k - 1 :])
        return at, self.rows[at]


def window_hashes(words: np.ndarray, at: np.ndarray, k: int, base: int = _BASES[1]) -> np.ndarray:
    """Hash of words[i : i+k] for each i of ``at``; rolling, so the cost doesn't grow with k."""
    if not at.size:
        return np.zeros(0, np.uint64)
    return mix(ranges(words, at, at + k, base) + np.uint64(k))
