"""Substring deduplication by fixed-block anchors.

Half a window is a block.  The non-overlapping blocks of every document are the index; every rolling
block-long window of every document probes it.  Any two equal windows contain an indexed block of one that
the other meets at some offset, so the blocks that two documents share lead to every repeat.  Around those
anchors the full windows are hashed and grouped: runs of repeated windows are the maximal exact repeats,
and a word goes if a window over it starts in a document with a smaller id as well.

Index and probes meet in hash ranges: a task sends each range the distinct hashes that it has for it as one
array of 32-bit numbers, so a passage that a third of all documents share is sent once a task, and no summary
of the whole index is broadcast.  The anchors found, far fewer, go into a bitmap; where it fills up, more
windows travel, with the same result.  Windows that occur very often are dealt to several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import BROADCAST_ROWS, Words, materialize, mix, release, slices, small_side, window_hashes
from tracelake.llm.sketches import bitmap

WINDOW = 50
#: Hash ranges in which index and probes meet (a power of two): by rows of the corpus, between these bounds.
ROWS_PER_RANGE, RANGE_BITS = 256, (6, 16)
#: Hashes that a task gathers before it sends them.
GATHERED = 1 << 20
#: Occurrences of a window for each task that it is dealt to.
OFTEN = 10_000
INDEX, PROBE, SHARED = range(3)


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64), pa.int64())


def _place(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Range and 32 bits of each hash as one number."""
    return hashes >> np.uint64(32 - bits)


def _distinct(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values, which of them came more than once)."""
    values = np.concatenate(arrays)
    values.sort()
    first = np.flatnonzero(np.concatenate((np.ones(min(1, values.size), bool), values[1:] != values[:-1])))
    return values[first], np.diff(first, append=values.size) > 1


def _among(places: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Which of ``places`` are in ``index`` (sorted)."""
    if not index.size:
        return np.zeros(places.size, bool)
    return index[np.minimum(np.searchsorted(index, places), index.size - 1)] == places


def _ranges(places: np.ndarray, kind: int) -> pa.RecordBatch:
    """Sorted places as a row for each range that they have."""
    part = (places >> np.uint64(32)).astype(np.int32)
    cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if part.size else np.zeros(0, np.int64)
    low = places.astype("<u4")
    blobs = [low[a:b].tobytes() for a, b in zip(cut.tolist(), [*cut[1:].tolist(), part.size])]
    return pa.RecordBatch.from_arrays([pa.array(part[cut], pa.int32()), pa.array(np.full(cut.size, kind), pa.int32()), pa.array(blobs, pa.binary())], names=["part", "kind", "places"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the places of the index that a probe or another block has too; rows come by range, its index first."""
    part, waiting, index, shared = None, [], np.zeros(0, np.uint32), []

    def done() -> Iterator[pa.RecordBatch]:
        if part is not None and shared:
            found = _distinct(shared)[0].astype(np.uint64) + np.uint64(part << 32)
            yield pa.RecordBatch.from_arrays([_long(mix(found))], names=["h"])

    for batch in batches:
        for p, kind, blob in zip(batch.column("part").to_pylist(), batch.column("kind").to_pylist(), batch.column("places")):
            if p != part:
                yield from done()
                part, waiting, index, shared = p, [], np.zeros(0, np.uint32), []
            places = np.frombuffer(blob.as_buffer(), "<u4")
            if kind == INDEX:
                waiting.append(places.copy())
                continue
            if waiting:
                index, again = _distinct(waiting)
                shared.append(index[again])
                waiting = []
            if kind == SHARED:
                shared.append(places.copy())
            else:
                shared.append(places[_among(places, index)])
        if len(shared) > 64:
            shared = [_distinct(shared)[0]]
    if waiting:
        index, again = _distinct(waiting)
        shared.append(index[again])
    yield from done()


def _tagged(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, text): the tag tells rows apart that repeat a doc_id with another text; it is 0 for all others."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    repeated = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("again"))
    return rows.join(small_side(repeated, "repeated"), "doc_id", "left").select("doc_id", F.when(F.col("again"), F.hash("text")).otherwise(0).alias("tag"), "text")


def repeated_windows(docs: DataFrame, window: int = WINDOW, range_bits: tuple[int, int] = RANGE_BITS, often: int = OFTEN) -> DataFrame:
    """(doc_id, tag, at): the starts of windows whose words also start in a document with a smaller doc_id.

    ``docs`` are (doc_id, tag, text).  Windows lie within one row.  Texts that are null, empty or shorter than
    a window have none; rows with a null doc_id take no part.
    """
    block, gathered = window // 2, GATHERED
    rows = docs.where("doc_id is not null and text is not null")
    least, most = range_bits
    bits = min(most, max(least, (docs.count() // ROWS_PER_RANGE).bit_length()))

    def parts(batches):
        for batch in slices(batches):
            words = Words(batch.column("text"))
            if words.counts.size and words.counts.max() >= window:
                yield batch, words, words.hashes()

    def rolling(words, hashes):
        at, row = words.windows(block)
        long_enough = words.counts[row] >= window
        at, row = at[long_enough], row[long_enough]
        return at, window_hashes(hashes, at, block), (at - words.begin[row]) % block == 0

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, other, size = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if size:
                index, again = _distinct(own)
                probes, _ = _distinct(other)
                met = _among(probes, index)
                yield _ranges(index, INDEX)
                yield _ranges(probes[~met], PROBE)  # those of the index are known already
                yield _ranges(_distinct([index[again], probes[met]])[0], SHARED)

        for _, words, hashes in parts(batches):
            _, h, aligned = rolling(words, hashes)
            places = _place(h, bits)
            own.append(places[aligned])
            other.append(places[~aligned])
            size += places.size
            if size >= gathered:
                yield from flush()
                own, other, size = [], [], 0
        yield from flush()

    sent = rows.select("text").mapInArrow(send, "part int, kind int, places binary")
    shared = materialize(sent.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(_meet, "h long"), "anchors")
    anchors = bitmap(shared, "h", shared.count())
    release(shared)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words, hashes in parts(batches):
            at, h, _ = rolling(words, hashes)
            anchored = np.zeros(words.starts.size + window + 1, np.int64)
            anchored[at[anchors.value.has(mix(_place(h, bits)))] + 1] = 1
            np.cumsum(anchored, out=anchored)
            start, row = words.windows(window)
            near = anchored[start + window - block + 1] > anchored[start]
            start, row = start[near], row[near]
            second = window_hashes(mix(hashes + np.uint64(0x5851F42D4C957F2D)), start, window)
            ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tag"))
            yield pa.RecordBatch.from_arrays(
                [
                    _long(window_hashes(hashes, start, window)),
                    pa.array((second >> np.uint64(32)).astype(np.uint32).view(np.int32), pa.int32()),
                    pa.array(ids[row], pa.int64()),
                    pa.array(tags[row], pa.int32()),
                    pa.array((start - words.begin[row]).astype(np.int32), pa.int32()),
                ],
                names=["k1", "k2", "doc_id", "tag", "at"],
            )

    windows = rows.mapInArrow(extend, "k1 long, k2 int, doc_id long, tag int, at int")
    found = windows.groupBy("k1", "k2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
    firsts = materialize(found.select("k1", "k2", "low", (F.col("n") / often).cast("int").alias("more")), "firsts")
    # the most frequent windows are dealt to several tasks; of these keys at most BROADCAST_ROWS are told to all
    hot = F.broadcast(firsts.where("more > 0").orderBy(F.desc("more"), "k1", "k2").limit(BROADCAST_ROWS).select("k1", "k2", F.col("more").alias("deal")))
    salt = F.coalesce(F.pmod(F.xxhash64("doc_id", "at"), F.col("deal") + 1), F.lit(0)).cast("int")
    dealt = windows.join(hot, ["k1", "k2"], "left").select("k1", "k2", salt.alias("salt"), "doc_id", "tag", "at")
    spread = firsts.join(hot, ["k1", "k2"], "left").select("k1", "k2", "low", F.explode(F.sequence(F.lit(0), F.coalesce("deal", F.lit(0)))).alias("salt"))
    return dealt.join(spread, ["k1", "k2", "salt"]).where("doc_id > low").select("doc_id", "tag", "at")


def remove_repeats(docs: DataFrame, window: int = WINDOW, range_bits: tuple[int, int] = RANGE_BITS, often: int = OFTEN) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept is what stays of each row's text, words joined by one blank.

    A null or empty text has no words and an empty kept text; a row without doc_id keeps all its words.  Rows
    that repeat a doc_id are judged each by its own text, and never against each other.  A long text is hashed
    whole: memory for it is some fifteen times its size.  Only doc_id and text are read.
    """
    rows = _tagged(docs)
    starts = repeated_windows(rows, window, range_bits, often)
    sets = starts.groupBy("doc_id", "tag").agg(F.array_sort(F.collect_set("at")).alias("at"))
    # runs of repeated windows, by their first and last starts: the maximal repeats
    begins = F.filter("at", lambda x, i: F.coalesce(F.get("at", i - 1) != x - 1, F.lit(True)))
    ends = F.filter("at", lambda x, i: F.coalesce(F.get("at", i + 1) != x + 1, F.lit(True)))
    spans = sets.select("doc_id", "tag", begins.alias("begins"), ends.alias("ends"))
    joined = rows.join(small_side(spans, "spans", weight=1 + F.size("begins")), ["doc_id", "tag"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept, total, removed = [], [], []
            for text, begins, ends in zip(batch.column("text"), batch.column("begins"), batch.column("ends")):
                words = (text.as_py() or "").encode().split()  # bytes.split cuts at exactly those six characters
                total.append(len(words))
                gone = 0
                if begins.is_valid:
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, np.minimum(begins.values.to_numpy(zero_copy_only=False), len(words)), 1)
                    np.add.at(cover, np.minimum(ends.values.to_numpy(zero_copy_only=False) + window, len(words)), -1)
                    stay = np.cumsum(cover)[: len(words)] == 0
                    gone = len(words) - int(stay.sum())
                    words = [w for w, s in zip(words, stay.tolist()) if s]
                removed.append(gone)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return joined.select("doc_id", "text", "begins", "ends").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    cut = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Windows of 50 words as text; the words are cut exactly as the operator cuts them.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
k AS (SELECT doc_id, i, sha256(array_to_string(w[i:i+49], ' ')) AS h FROM s),
f AS (SELECT h, min(doc_id) AS low FROM k GROUP BY h),
hit AS (SELECT k.doc_id, k.i FROM k JOIN f USING (h) WHERE k.doc_id > f.low),
g AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS gone FROM hit GROUP BY doc_id),
r AS (SELECT d.doc_id, d.w, coalesce(g.gone, []::BIGINT[]) AS gone FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i)), ' '), '')) AS kept_sha256
FROM r
"""
