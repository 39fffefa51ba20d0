"""Captures in splits: records found from the middle of a file, checked from its start, with counts and times.

A split's task guesses the first record that begins in its range: a header counts only if a chain of lengths and
times holds from it (PCAPNG: block lengths and their trailers).  A payload can imitate that, so a guess is only
believed where the split before it ends: splits that don't meet are read again from the right place.  The index
that comes of it has, for each split, the place and number of its first record and its first and last time; with
it, a file is read in many tasks as one reader would have read it, and what a filter excludes isn't opened.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHB, IDB, SPB, EPB = 0x0A0D0D0A, 1, 3, 6
ORDER_MAGIC, CLASSIC_MAGIC = 0x1A2B3C4D, 0xA1B2C3D4
MAX_BLOCK, MAX_PACKET = 64 << 20, 16 << 20
#: Bytes of a split, of a read, records or blocks of a chain, seconds between two records of one.
SPLIT_BYTES, CHUNK, CHAIN, APART = 128 << 20, 4 << 20, 8, 30 * 86_400
#: Bytes read beyond a small split, for its last record and for a chain that begins in it.
EDGE = 256 << 10
#: Tasks over the splits of a read: more small splits than these share tasks, up to SPLIT_BYTES each.
SPLIT_TASKS = 1000
#: Records of a batch at most, and their bytes.
BATCH_ROWS, BATCH_BYTES = 10_000, 8 << 20
MICROS = 1_000_000


class CaptureError(ValueError):
    """A capture breaks its format."""


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


# ---------------------------------------------------------------- layout
@dataclass(frozen=True)
class Layout:
    """Format, byte order and place of the first record of a file."""

    ng: bool
    order: str
    first: int


def layout(source) -> Layout:
    """Told by the magic of an open file."""
    source.seek(0)
    head = source.read(24)
    if len(head) < 4:
        raise CaptureError("no capture")
    if struct.unpack_from("<I", head)[0] == SHB:
        if len(head) < 12:
            raise CaptureError("section cut short")
        order = next((o for o in "<>" if struct.unpack_from(o + "I", head, 8)[0] == ORDER_MAGIC), None)
        if order is None:
            raise CaptureError("unknown byte order")
        (size,) = struct.unpack_from(order + "I", head, 4)
        if not 28 <= size <= MAX_BLOCK:
            raise CaptureError(f"implausible section length {size}")
        source.seek(0)
        if len(source.read(size)) < size:
            raise CaptureError("section cut short")
        return Layout(True, order, size)
    for order in "<>":
        if struct.unpack_from(order + "I", head)[0] == CLASSIC_MAGIC:
            if len(head) < 24:
                raise CaptureError("file header cut short")
            return Layout(False, order, 24)
    raise CaptureError(f"unknown magic {head[:4].hex()}")


def resolution(options: bytes, order: str) -> int:
    """Ticks a second of an interface: option 9, a power of ten or of two; a million without it."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(order + "HH", options, at)
        if code == 0:
            break
        if code == 9 and size >= 1 and at + 4 < len(options):
            v = options[at + 4]
            return 1 << (v & 0x7F) if v & 0x80 else 10**v
        at += 4 + (size + 3) // 4 * 4
    return MICROS


# ---------------------------------------------------------------- reading in order
@dataclass
class Records:
    """A run of records: header values, and where their bytes lie in ``buffer``."""

    buffer: bytes = b""
    secs: list[int] = field(default_factory=list)
    usecs: list[int] = field(default_factory=list)
    original: list[int] = field(default_factory=list)
    begin: list[int] = field(default_factory=list)
    stop: list[int] = field(default_factory=list)


class Walk:
    """Iterates over the records that begin in [start, end); ``at`` is then the place of the next one.

    ``ticks`` holds the resolutions of the interfaces seen so far, and grows.  Damage raises CaptureError after
    the sound records before it were given.
    """

    def __init__(self, source, layout: Layout, start: int, end: int, ticks: list[int] | None = None):
        self.source, self.layout, self.at, self.end = source, layout, start, end
        self.ticks = [] if ticks is None else ticks

    def __iter__(self) -> Iterator[Records]:
        step = self._block if self.layout.ng else self._record
        buffer, base, want = b"", self.at, self._room()
        while self.at < self.end:
            self.source.seek(self.at)
            buffer, base = self.source.read(want), self.at
            run, ended, damage = Records(buffer), len(buffer) < want, None
            position, size = 0, len(buffer)
            try:
                while base + position < self.end:
                    after = step(buffer, position, size, run)
                    if after > size:
                        break
                    position = after
            except CaptureError as e:
                damage = e
            self.at = base + position
            if run.secs:
                yield run
            if damage:
                raise damage
            if base + position >= self.end:
                return
            if ended:
                self._last(size - position)
                return
            want = max(self._room(), after - position + EDGE)

    def _room(self) -> int:
        """Bytes to read next: not much more than a small split has left."""
        return max(1, min(CHUNK, self.end - self.at + EDGE))

    def _last(self, left: int) -> None:
        """What is left at the end of the file is no whole record."""
        if left >= (1 if self.layout.ng else 16):
            raise CaptureError("block cut short" if self.layout.ng else "packet cut short")
        self.at += left
        self.end = min(self.end, self.at)

    def _record(self, buffer: bytes, at: int, size: int, run: Records) -> int:
        """Adds a whole record; where it ends, beyond ``size`` if it isn't all there."""
        if at + 16 > size:
            return at + 16
        secs, usecs, captured, original = struct.unpack_from(self.layout.order + "IIII", buffer, at)
        if captured > MAX_PACKET:
            raise CaptureError(f"implausible packet length {captured}")
        stop = at + 16 + captured
        if stop <= size:
            self._add(run, secs, usecs, original, at + 16, stop)
        return stop

    @staticmethod
    def _add(run: Records, secs: int, usecs: int, original: int, begin: int, stop: int) -> None:
        run.secs.append(secs)
        run.usecs.append(usecs)
        run.original.append(original)
        run.begin.append(begin)
        run.stop.append(stop)

    def _block(self, buffer: bytes, at: int, size: int, run: Records) -> int:
        if at + 8 > size:
            return at + 8
        order = self.layout.order
        kind, length = struct.unpack_from(order + "II", buffer, at)
        if length < 12 or length > MAX_BLOCK or length % 4:
            raise CaptureError(f"implausible block length {length}")
        stop = at + length
        if stop > size:
            return stop
        if struct.unpack_from(order + "I", buffer, stop - 4)[0] != length:
            raise CaptureError("block lengths differ")
        body, room = at + 8, length - 12
        if kind == IDB and room >= 8:
            self.ticks.append(resolution(buffer[body + 8 : stop - 4], order))
        elif kind == EPB:
            if room < 20:
                raise CaptureError("packet block cut short")
            interface, high, low, captured, original = struct.unpack_from(order + "IIIII", buffer, body)
            if captured > MAX_PACKET or captured > room - 20:
                raise CaptureError(f"implausible packet length {captured}")
            per_second = self.ticks[interface] if interface < len(self.ticks) else MICROS
            secs, rest = divmod(high << 32 | low, per_second)
            self._add(run, secs, rest * MICROS // per_second, original, body + 20, body + 20 + captured)
        elif kind == SPB:
            if room < 4:
                raise CaptureError("simple packet block cut short")
            (original,) = struct.unpack_from(order + "I", buffer, body)
            self._add(run, 0, 0, original, body + 4, body + 4 + min(original, room - 4))
        return stop


# ---------------------------------------------------------------- finding a record
def _numbers(buffer: bytes, order: str, step: int) -> np.ndarray:
    """The 32-bit number at each ``step``-th place."""
    n = max(0, (len(buffer) - 4) // step + 1)
    return np.ndarray((n,), order + "u4", buffer, 0, (step,)).astype(np.int64)


def candidates(buffer: bytes, base: int, size: int, of: Layout) -> np.ndarray:
    """Places in ``buffer`` (read at ``base`` of a file of ``size`` bytes) from which a chain of CHAIN records holds.

    What lies beyond the buffer is taken to hold.
    """
    step = 4 if of.ng else 1
    skip = (of.first - base) % step
    words = _numbers(buffer[skip:], of.order, step)
    n = words.size - (1 if of.ng else 12)
    if n <= 0:
        return np.zeros(0, np.int64)
    here = np.arange(n)
    if of.ng:
        length = words[1 : n + 1]
        sound = (words[:n] != 0) & (length >= 12) & (length <= MAX_BLOCK) & (length % 4 == 0) & (base + skip + 4 * here + length <= size)
        after = here + np.maximum(length, 4) // 4
        inside = sound & (after - 1 < words.size)
        sound[inside] &= words[after[inside] - 1] == length[inside]
    else:
        secs, length = words[:n], words[8 : n + 8]
        sound = (secs > 0) & (words[4 : n + 4] < MICROS) & (length > 0) & (length <= words[12 : n + 12]) & (words[12 : n + 12] <= MAX_PACKET)
        sound &= base + here + 16 + length <= size
        after = here + 16 + length
    chain, at = sound.copy(), after
    for _ in range(CHAIN - 1):
        places = np.minimum(at, n - 1)
        known = at < n
        chain &= ~known | sound[places]
        if not of.ng:
            chain &= ~known | (np.abs(secs[places] - secs) <= APART)
        at = np.where(known, after[places], at)
    return np.flatnonzero(chain) * step + skip


def guess(source, of: Layout, begin: int, end: int, size: int) -> int | None:
    """The first place in [begin, end) that looks like a record."""
    at = begin
    while at < end:
        source.seek(at)
        buffer = source.read(min(CHUNK, size - at, end - at + EDGE))
        found = candidates(buffer, at, size, of)
        if found.size and at + int(found[0]) < end:
            return at + int(found[0])
        if len(buffer) <= 64:
            return None
        at += len(buffer) - 64
    return None


# ---------------------------------------------------------------- index
def split_tasks(splits: int, size: int) -> int:
    """Tasks for so many splits of ``size`` bytes together."""
    return max(1, min(splits, max(SPLIT_TASKS, size // SPLIT_BYTES)))


_SPLIT = "path string, file_ord int, begin long, end long, size long, start long"
INDEX = f"{_SPLIT}, reached long, records long, first_us long, last_us long, ticks array<long>, damaged boolean"
#: What the index holds in the end: only splits with records (or damage), numbered.
NUMBERED = "path string, file_ord int, start long, end long, before long, records long, first_us long, last_us long, ticks array<long>, damaged boolean"
_NAMES = [c.split()[0] for c in INDEX.split(", ")]


def _measured(split: dict) -> dict:
    """A split's records from its ``start``; without one, from a guess that holds to its end."""
    found = {"reached": None, "records": 0, "first_us": None, "last_us": None, "ticks": [], "damaged": False}
    system, at = filesystem(split["path"])
    with system.open_input_file(at) as source:
        try:
            of = layout(source)
        except CaptureError:
            return split | found | {"start": split["begin"], "reached": split["size"], "damaged": True}
        start, sure = split["start"], split["start"] is not None
        if split["begin"] == 0:
            start, sure = of.first, True
        low = split["begin"]
        for _ in range(CHAIN):
            if not sure and (start := guess(source, of, low, split["end"], split["size"])) is None:
                return split | found
            walk, n, first, last, damaged = Walk(source, of, start, split["end"]), 0, None, None, False
            try:
                for run in walk:
                    us = [s * MICROS + u for s, u in zip(run.secs, run.usecs)]
                    n, first, last = n + len(us), min(us) if first is None else min(first, *us), max(us) if last is None else max(last, *us)
            except CaptureError:
                damaged = True
            if sure or not damaged or walk.at + MAX_PACKET >= split["size"]:
                return split | {"start": start, "reached": walk.at, "records": n, "first_us": first, "last_us": last, "ticks": walk.ticks, "damaged": damaged}
            low = start + 1
        return split | found


def _measure(splits: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"path": pa.string(), "file_ord": pa.int32(), "ticks": pa.list_(pa.int64()), "damaged": pa.bool_()}
        for batch in batches:
            for split in batch.to_pylist():
                row = _measured(split)
                yield pa.RecordBatch.from_arrays([pa.array([row[n]], kinds.get(n, pa.int64())) for n in _NAMES], names=_NAMES)

    return splits.mapInArrow(run, INDEX)


def _judged(splits: pd.DataFrame) -> pd.DataFrame:
    """Of one file's splits in order: where each has to start (``expected``), and whether it has to be measured again.

    Nothing follows damage.  A split that does not start where the one before it has ended is measured again from
    there.  What comes after a wrong one is judged as if that one had ended where it should, which it mostly has; so
    the wrong ones of a file are measured together, and the first of them is right for sure after that.
    """
    splits = splits.sort_values("begin").reset_index(drop=True)
    expected, again, void, reached, sure, broken = [], [], [], 0, True, False
    for s in splits.itertuples():
        there = s.start is not None and s.start == s.start
        passed = s.begin != 0 and reached is not None and reached >= s.end
        right = passed or s.begin == 0 or (there and reached is not None and int(s.start) == reached)
        void.append(broken or (sure and passed))
        expected.append(reached)
        again.append(not broken and not right and reached is not None)
        if broken or passed:
            continue
        broken = sure and right and bool(s.damaged)
        reached = int(s.reached) if right or (there and not s.damaged) else None
        sure = sure and right
    splits["expected"], splits["again"], splits["void"] = expected, again, void
    return splits


def index_captures(spark: SparkSession, files: list[tuple[str, int, int]], folder: str, split_bytes: int = SPLIT_BYTES) -> str:
    """Writes the index of ``files`` (path, number, size) under ``folder``, and returns its place.

    One job over all splits, and one more over those whose guess was wrong, again while some are; very small splits share
    tasks.  Only rows a split large go to the driver, as a listing of the files does.
    """
    splits = [(p, o, a, min(a + split_bytes, size), size, None) for p, o, size in files for a in range(0, max(size, 1), split_bytes)]
    state = _measure(spark.createDataFrame(splits, _SPLIT).repartition(split_tasks(len(splits), sum(s for *_, s in files)), "path", "begin"))
    judged_type = f"{INDEX}, expected long, again boolean, void boolean"
    while True:
        at = f"{folder.rstrip('/')}/index-{uuid.uuid4().hex}"
        state.write.parquet(at)
        judged = spark.read.schema(INDEX).parquet(at).groupBy("path", "file_ord").applyInPandas(_judged, judged_type)
        wrong = judged.where("again").select(*[c.split()[0] for c in _SPLIT.split(", ")][:-1], F.col("expected").alias("start"))
        n = wrong.count()
        if not n:
            break
        state = judged.where("not again").select(*_NAMES).unionByName(_measure(wrong.repartition(split_tasks(n, n * split_bytes), "path", "begin")))
    final = f"{folder.rstrip('/')}/index-{uuid.uuid4().hex}"
    kept = judged.where("not void and (records > 0 or damaged or size(ticks) > 0)")
    kept.groupBy("path", "file_ord").applyInPandas(_numbered, NUMBERED).write.parquet(final)
    return final


def _numbered(splits: pd.DataFrame) -> pd.DataFrame:
    splits = splits.sort_values("begin").reset_index(drop=True)
    splits["before"] = splits.records.cumsum() - splits.records
    seen, ticks = [], []
    for own in splits.ticks:
        ticks.append(list(seen))
        seen += [int(t) for t in own]
    splits["ticks"] = ticks
    return splits[[c.split()[0] for c in NUMBERED.split(", ")]]
