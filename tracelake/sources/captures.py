"""PCAP and PCAPNG captures as a Spark data source: batch and stream, read and written.

``spark.read.format("capture").load(folder or file)`` yields FRAME rows, a task a file.  ``read_capture`` cuts large
files into splits by an index (sources/splits.py), so that one file is read in many tasks, with the same rows and
numbers.  Filters on times, lengths and numbers are pushed into the source: records are judged by their headers
before their bytes are taken, and splits whose times lie outside a filter are not opened.  ``option("lenient",
"true")`` ends a damaged file at its last sound record instead of failing.  Paths may be any URI that pyarrow's file
systems know.
"""

from __future__ import annotations

import io
import operator
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from tracelake.schema import FRAME
from tracelake.sources.batch_files import BatchFiles, write_stream
from tracelake.sources.folders import shared_folder
from tracelake.sources.splits import BATCH_BYTES, BATCH_ROWS, CHUNK, EPB, IDB, MICROS, ORDER_MAGIC, SHB, SPLIT_BYTES, CLASSIC_MAGIC, CaptureError, Layout, Records, Walk, SPLIT_TASKS, filesystem, index_captures, layout, split_tasks

ETHERNET = 1


# ---------------------------------------------------------------- reading
def read_frames(stream) -> Iterator[tuple[int, int, int, bytes]]:
    """(seconds, microseconds, original length, bytes) of each packet of an open file; the format is told by the magic."""
    of = layout(stream)
    for run in Walk(stream, of, of.first, 1 << 62):
        for secs, usecs, original, begin, stop in zip(run.secs, run.usecs, run.original, run.begin, run.stop):
            yield secs, usecs, original, run.buffer[begin:stop]


# ---------------------------------------------------------------- writing
class FrameWriter:
    """Appends packets to a stream: classic little-endian with microseconds, or PCAPNG."""

    def __init__(self, stream, ng: bool):
        self.stream, self.ng = stream, ng
        if ng:
            self._block(SHB, struct.pack("<IHHq", ORDER_MAGIC, 1, 0, -1))
            self._block(IDB, struct.pack("<HHI", ETHERNET, 0, 65535))
        else:
            stream.write(struct.pack("<IHHiIII", CLASSIC_MAGIC, 2, 4, 0, 0, 65535, ETHERNET))

    def _block(self, kind: int, body: bytes) -> None:
        body += bytes(-len(body) % 4)
        size = struct.pack("<I", len(body) + 12)
        self.stream.write(struct.pack("<I", kind) + size + body + size)

    def write(self, secs: int, usecs: int, original: int, data: bytes) -> None:
        if self.ng:
            ticks = secs * 1_000_000 + usecs
            self._block(EPB, struct.pack("<IIIII", 0, ticks >> 32, ticks & 0xFFFFFFFF, len(data), original) + data)
        else:
            self.stream.write(struct.pack("<IIII", secs, usecs, len(data), original) + data)


def is_pcapng(path: str) -> bool:
    return path.lower().endswith(".pcapng")


# ---------------------------------------------------------------- data source
def listed(path: str) -> list[tuple[str, int]]:
    """The capture files at a path with their sizes, in order of name."""
    from pyarrow import fs

    system, at = filesystem(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.Directory:
        found = system.get_file_info(fs.FileSelector(at))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))
        prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
        return [(prefix + n, size) for n, size in files]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return [(path, info.size)]


@dataclass
class _Split(InputPartition):
    """Records that begin in [start, end) of a file; ``before`` of them precede.  Without a start, the whole file."""

    path: str
    number: int
    start: int | None = None
    end: int = 1 << 62
    before: int = 0
    ticks: list[int] = field(default_factory=list)


_COMPARED: dict[type, Callable] = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
#: Columns that are judged from a record's header, and how.
_JUDGED: dict[str, Callable] = {
    "file_ord": lambda run, i, split, n: split.number, "frame_no": lambda run, i, split, n: n, "ts_secs": lambda run, i, split, n: run.secs[i], "ts_usecs": lambda run, i, split, n: run.usecs[i],
    "orig_len": lambda run, i, split, n: run.original[i], "frame_len": lambda run, i, split, n: run.stop[i] - run.begin[i],
}


@dataclass
class Pushed:
    """Comparisons of header columns with constants, all of which have to hold."""

    tests: list[tuple[str, Callable, object]] = field(default_factory=list)

    def take(self, f: Filter) -> bool:
        """Whether the source answers for the filter; no column of a record is null."""
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if name not in _JUDGED:
            return isinstance(f, IsNotNull) and name == "data"
        if isinstance(f, IsNotNull):
            return True
        if isinstance(f, In) and None not in f.value:
            self.tests.append((name, lambda x, values: x in values, frozenset(f.value)))
        elif type(f) in _COMPARED and f.value is not None:
            self.tests.append((name, _COMPARED[type(f)], f.value))
        else:
            return False
        return True

    def may_hold(self, name: str, low: int, high: int) -> bool:
        """Whether some value in [low, high] of a column passes."""
        for column, test, value in self.tests:
            if column != name:
                continue
            if test is operator.eq:
                passes = low <= value <= high
            elif test in (operator.gt, operator.ge):
                passes = test(high, value)
            elif test in (operator.lt, operator.le):
                passes = test(low, value)
            else:
                passes = any(low <= v <= high for v in value)
            if not passes:
                return False
        return True

    def chosen(self, run: Records, split: _Split, before: int) -> list[int]:
        """Places in a run of the records that pass."""
        n = len(run.secs)
        if not self.tests:
            return list(range(n))
        return [i for i in range(n) if all(test(_JUDGED[c](run, i, split, before + i + 1), v) for c, test, v in self.tests)]


def _batches(split: _Split, pushed: Pushed, lenient: bool, lengths: bool) -> Iterator[pa.RecordBatch]:
    """The frames of a split, a batch a few megabytes."""
    names = [c.split()[0] for c in FRAME.split(", ")] + ["frame_len"] * lengths

    def batch(run: Records, places: list[int], before: int) -> pa.RecordBatch:
        arrays = [
            pa.array([split.number] * len(places), pa.int32()), pa.array([before + i + 1 for i in places], pa.int64()), pa.array([run.secs[i] for i in places], pa.int64()),
            pa.array([run.usecs[i] for i in places], pa.int32()), pa.array([run.original[i] for i in places], pa.int64()), pa.array([run.buffer[run.begin[i] : run.stop[i]] for i in places], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(arrays + [pa.array([run.stop[i] - run.begin[i] for i in places], pa.int32())] * lengths, names=names)

    system, at = filesystem(split.path)
    with system.open_input_file(at) as source:
        before = split.before
        try:
            of = layout(source)
            for run in Walk(source, of, of.first if split.start is None else split.start, split.end, list(split.ticks)):
                places, held, size = pushed.chosen(run, split, before), [], 0
                for i in places:
                    held.append(i)
                    size += run.stop[i] - run.begin[i]
                    if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield batch(run, held, before)
                        held, size = [], 0
                if held:
                    yield batch(run, held, before)
                before += len(run.secs)
        except CaptureError:
            if not lenient:
                raise


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("paths", "").split("\n") if p] or ([options["path"]] if "path" in options else [])
        self.lenient, self.lengths = (options.get(k, "false").lower() == "true" for k in ("lenient", "lengths"))
        self.index, self.pushed = options.get("index"), Pushed()

    def pushFilters(self, filters):
        for f in filters:
            if not self.pushed.take(f):
                yield f

    def partitions(self):
        """Splits of the index, or files, that may hold what the filters ask for."""
        if self.index:
            splits = self._joined([(self._wanted(r), _Split(r["path"], r["file_ord"], r["start"], r["end"], r["before"], r["ticks"])) for r in self._indexed()])
        else:
            files = [f for p in self.paths for f, _ in listed(p)]
            splits = [_Split(f, i) for i, f in enumerate(files) if self.pushed.may_hold("file_ord", i, i)]
        return splits or [_Split("", -1)]

    @staticmethod
    def _joined(splits: list[tuple[bool, _Split]]) -> list[_Split]:
        """The wanted ones; where they are very many, those that follow each other in a file are read as one."""
        wanted = [s for yes, s in splits if yes]
        most = -(-sum(s.end - s.start for s in wanted) // split_tasks(len(wanted), sum(s.end - s.start for s in wanted)))
        if len(wanted) <= SPLIT_TASKS:
            return wanted
        out: list[_Split] = []
        follows = False
        for yes, s in splits:
            if yes and follows and out[-1].number == s.number and s.end - out[-1].start <= max(most, 1):
                out[-1].end = s.end
            elif yes:
                out.append(s)
            follows = yes
        return out

    def _indexed(self) -> Iterator[dict]:
        from pyarrow import dataset, fs

        system, at = filesystem(self.index)
        files = [f.path for f in system.get_file_info(fs.FileSelector(at)) if f.path.endswith(".parquet")]
        rows = dataset.dataset(files, filesystem=system, format="parquet").to_table().sort_by([("file_ord", "ascending"), ("start", "ascending")]) if files else None
        for batch in rows.to_batches() if files else ():
            yield from batch.to_pylist()

    def _wanted(self, r: dict) -> bool:
        if r["damaged"]:
            return True  # read to its damage, so that it is not passed over
        if not r["records"]:
            return False
        spans = {"file_ord": (r["file_ord"], r["file_ord"]), "frame_no": (r["before"] + 1, r["before"] + r["records"]), "ts_secs": (r["first_us"] // MICROS, r["last_us"] // MICROS)}
        return all(self.pushed.may_hold(c, low, high) for c, (low, high) in spans.items())

    def read(self, partition):
        if partition.number >= 0:
            yield from _batches(partition, self.pushed, self.lenient, self.lengths)


class _Stream(DataSourceStreamReader):
    """Files that have come into a folder since the last batch; a task reads each.

    They are told by modification time, then name, so a file may have any name.  Move files in when complete.
    """

    def __init__(self, options):
        self.path, self.lenient = options["path"], options.get("lenient", "false").lower() == "true"
        self.lengths = options.get("lengths", "false").lower() == "true"
        self.listing: list[tuple[int, str]] = []  # of the last offset

    def initialOffset(self):
        return {"time": -1, "last": "", "files": 0}

    def _stamped(self) -> list[tuple[int, str]]:
        """(modification time in ns, path) of the capture files, the oldest first: one listing."""
        from pyarrow import fs

        system, at = filesystem(self.path)
        prefix = self.path[: len(self.path) - len(at)] if self.path.endswith(at) else ""
        found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
        return sorted((f.mtime_ns or 0, prefix + f.path) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))

    def latestOffset(self):
        self.listing = self._stamped()
        time, last = self.listing[-1] if self.listing else (-1, "")
        return {"time": time, "last": last, "files": len(self.listing)}

    def partitions(self, start, end):
        after, until = (start["time"], start["last"]), (end["time"], end["last"])
        if not self.listing or self.listing[-1] < until:  # a restarted query plans the batch that it had begun
            self.listing = self._stamped()
        files = [f for f in self.listing if after < f <= until]
        return [_Split(f, start["files"] + i) for i, (_, f) in enumerate(files)]

    def read(self, partition):
        yield from _batches(partition, Pushed(), self.lenient, self.lengths)


@dataclass
class _Written(WriterCommitMessage):
    temporary: str
    final: str
    packets: int


class _Writer(DataSourceWriter):
    """One file a partition; files get their names when all tasks have ended."""

    def __init__(self, options, overwrite: bool):
        self.path, self.ng = options["path"], options.get("variant", "pcap") == "pcapng"

    def write(self, rows):
        from pyspark import TaskContext

        system, at = filesystem(self.path)
        system.create_dir(at, recursive=True)
        number, ending = TaskContext.get().partitionId(), ".pcapng" if self.ng else ".pcap"
        temporary, n = f"{at}/.part-{number:05d}-{uuid.uuid4().hex}", 0
        with system.open_output_stream(temporary, compression=None) as stream:
            writer = FrameWriter(stream, self.ng)
            for r in rows:
                writer.write(r.ts_secs, r.ts_usecs, r.orig_len, bytes(r.data))
                n += 1
        return _Written(temporary, f"{at}/part-{number:05d}{ending}", n)

    def commit(self, messages):
        system, _ = filesystem(self.path)
        for m in messages:
            if m is not None:
                system.move(m.temporary, m.final)

    def abort(self, messages):
        system, _ = filesystem(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.temporary)


class CaptureSource(DataSource):
    @classmethod
    def name(cls):
        return "capture"

    def schema(self):
        return FRAME + (", frame_len int" if self.options.get("lengths", "false").lower() == "true" else "")

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)

    def streamWriter(self, schema, overwrite):
        ng = self.options.get("variant", "pcap") == "pcapng"
        return BatchFiles(self.options["path"], ".pcapng" if ng else ".pcap", partial(_encode_frames, ng))


def _encode_frames(ng: bool, stream, rows) -> None:
    writer = FrameWriter(stream, ng)
    for r in rows:
        writer.write(r.ts_secs, r.ts_usecs, r.orig_len, bytes(r.data))


def register(spark: SparkSession) -> None:
    """Makes the format known; filters are pushed into it only where the session allows it, so it is allowed."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaptureSource)


def capture_index(spark: SparkSession, *paths: str, folder: str | None = None, split_bytes: int = SPLIT_BYTES) -> str:
    """Writes the index of all files at ``paths``, numbered in the order given, for ``read_capture``."""
    files = [f for p in paths for f in listed(p)]
    return index_captures(spark, [(f, i, size) for i, (f, size) in enumerate(files)], folder or shared_folder(spark, "captures"), split_bytes)


def read_capture(spark: SparkSession, *paths: str, lenient: bool = False, index: str | None = None, split_bytes: int = SPLIT_BYTES, lengths: bool = False) -> DataFrame:
    """Frames (FRAME) of files or folders, numbered in the order given.

    ``index`` is one that ``capture_index`` wrote, over the same files: they are read by their splits, and splits
    outside a filter's times are not opened.  Without it, one is made where a file is larger than ``split_bytes``;
    smaller files are read whole.  ``lengths`` adds frame_len, the bytes captured, to filter by.
    """
    register(spark)
    if index is None and any(size > split_bytes for p in paths for _, size in listed(p)):
        index = capture_index(spark, *paths, split_bytes=split_bytes)
    reader = spark.read.format("capture").option("lenient", str(lenient).lower()).option("lengths", str(lengths).lower())
    return reader.option("index", index).load() if index else reader.option("paths", "\n".join(paths)).load()


def write_capture(frames: DataFrame, path: str, variant: str | None = None, single: bool = False) -> None:
    """Frames in order of time to a folder: a file for each range of time, or a ``single`` one.

    Files are named by range, so that in order of name they hold the frames in order.  A single file is written in
    ranges too, by all tasks; one task then puts their bytes together.
    """
    spark = frames.sparkSession
    register(spark)
    order = ["ts_secs", "ts_usecs", "file_ord", "frame_no"]
    variant = variant or ("pcapng" if is_pcapng(path) else "pcap")
    ordered = frames.repartitionByRange(*order).sortWithinPartitions(*order).select("file_ord", "frame_no", "ts_secs", "ts_usecs", "orig_len", "data")
    folder = shared_folder(spark, "ranges") if single else path
    ordered.write.format("capture").option("variant", variant).mode("append").save(folder)
    if single:
        _concatenate(spark, folder, path, variant == "pcapng")


def _concatenate(spark: SparkSession, folder: str, path: str, ng: bool) -> None:
    """Makes one file at ``path`` of the files in ``folder``, in order of name, which go then."""
    head = io.BytesIO()
    FrameWriter(head, ng)
    head = head.getvalue()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _ in range(batch.num_rows):
                system, at = filesystem(path)
                system.create_dir(at, recursive=True)
                temporary = f"{at}/.part-00000-{uuid.uuid4().hex}"
                with system.open_output_stream(temporary, compression=None) as out:
                    out.write(head)
                    for name, _ in listed(folder):
                        source, place = filesystem(name)
                        with source.open_input_file(place) as part:
                            part.seek(len(head))
                            while piece := part.read(CHUNK):
                                out.write(piece)
                yield pa.RecordBatch.from_pydict({"temporary": [temporary]})

    (row,) = spark.range(0, 1, 1, 1).mapInArrow(run, "temporary string").collect()
    system, at = filesystem(path)
    system.move(row.temporary, f"{at}/part-00000{'.pcapng' if ng else '.pcap'}")
    source, place = filesystem(folder)
    source.delete_dir(place)


def write_capture_stream(frames: DataFrame, path: str, checkpoint: str, variant: str = "pcap", **trigger):
    """Starts a query that writes the frames of a stream to a folder, each once, a file a task and batch.

    The columns of FRAME are taken; frames of a file come in the order in which they come in their task.
    """
    register(frames.sparkSession)
    rows = frames.select("file_ord", "frame_no", "ts_secs", "ts_usecs", "orig_len", "data")
    return write_stream(rows, "capture", path, checkpoint, {"variant": variant}, **trigger)
