"""Captures cut into splits against the reader that goes from the start, and filters pushed into the source."""

import io
import os
import random
import struct

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracelake.operators.captures import slice_capture
from tracelake.sources import captures, splits
from tracelake.sources.captures import _Split, CaptureError, FrameWriter, capture_index, read_capture, read_frames


def _capture(ng: bool, packets) -> bytes:
    out = io.BytesIO()
    writer = FrameWriter(out, ng)
    for p in packets:
        writer.write(*p)
    return out.getvalue()


def _packets(n: int, seed: int, largest: int = 400):
    r = random.Random(seed)
    return [(1_700_000_000 + i // 7, r.randrange(10**6), 2000, r.randbytes(r.randrange(1, largest))) for i in range(n)]


def _imitations(n: int):
    """Packets whose payloads are captures themselves, longer than a chain, so that guesses go wrong."""
    inner = _capture(False, _packets(40, 5, 60))[24:]
    blocks = _capture(True, _packets(40, 6, 60))[28:]
    return [(1_700_000_000 + i, 5, 90_000, (inner, blocks, bytes(3000), b"x" * 7)[i % 4] * (1 + i % 3)) for i in range(n)]


def _sequential(raw: bytes, lenient: bool = False):
    rows = []
    try:
        for n, (secs, usecs, original, data) in enumerate(read_frames(io.BytesIO(raw)), 1):
            rows.append((n, secs, usecs, original, data))
    except CaptureError:
        if not lenient:
            raise
    return rows


def _rows(df):
    return [(r.file_ord, r.frame_no, r.ts_secs, r.ts_usecs, r.orig_len, bytes(r.data)) for r in df.orderBy("file_ord", "frame_no").collect()]


def _big_endian(packets) -> bytes:
    head = struct.pack(">IHHiIII", splits.CLASSIC_MAGIC, 2, 4, 0, 0, 65535, 1)
    return head + b"".join(struct.pack(">IIII", s, u, len(d), o) + d for s, u, o, d in packets)


def _sections(packets) -> bytes:
    """PCAPNG whose interfaces, of several resolutions, come between the packets, with blocks to be passed over."""
    block = lambda kind, body: (lambda b, n: struct.pack("<II", kind, n) + b + struct.pack("<I", n))(body + bytes(-len(body) % 4), 12 + len(body) + -len(body) % 4)
    out, ticks = [block(splits.SHB, struct.pack("<IHHq", splits.ORDER_MAGIC, 1, 0, -1) + bytes(8))], []
    for i, (secs, usecs, original, data) in enumerate(packets):
        if i % 50 == 0:
            code = (6, 9, 0x80 | 20, 3)[i // 50 % 4]
            ticks.append(1 << (code & 0x7F) if code & 0x80 else 10**code)
            out.append(block(splits.IDB, struct.pack("<HHI", 1, 0, 65535) + struct.pack("<HHB3x", 9, 1, code) + struct.pack("<HH", 0, 0)))
        at = secs * ticks[-1] + usecs * ticks[-1] // 10**6
        out.append(block(splits.EPB, struct.pack("<IIIII", len(ticks) - 1, at >> 32, at & 0xFFFFFFFF, len(data), original) + data))
        if i % 9 == 0:
            out.append(block(splits.SPB, struct.pack("<I", len(data)) + data))
            out.append(block(5, bytes(8)))
    return b"".join(out)


CASES = {
    "classic": _capture(False, _packets(900, 1)),
    "big_endian": _big_endian(_packets(300, 2)),
    "blocks": _capture(True, _packets(900, 3)),
    "sections": _sections(_packets(400, 4)),
    "imitating": _capture(False, _imitations(60)),
    "imitating_blocks": _capture(True, _imitations(60)),
    "one_large": _capture(False, [(5, 6, 7, bytes(range(256)) * 400), *_packets(20, 7)]),
    "empty": _capture(False, []),
    "ended_in_header": _capture(False, _packets(50, 8)) + bytes(11),
}


def test_files_in_splits_read_as_from_the_start(spark, tmp_path):
    expected = []
    for number, (name, raw) in enumerate(sorted(CASES.items())):
        (tmp_path / f"{number}-{name}.cap").write_bytes(raw)
        expected += [(number, *row) for row in _sequential(raw)]
    for size in (3000, 17_001):
        df = read_capture(spark, str(tmp_path), split_bytes=size)
        assert df.rdd.getNumPartitions() > sum(map(len, CASES.values())) / size / 3
        assert _rows(df) == expected
    assert _rows(read_capture(spark, str(tmp_path))) == expected


def test_a_wrong_guess_is_measured_again():
    """The payload's chain is taken for records, until the split before shows that it is not."""
    raw = CASES["imitating"]
    source = io.BytesIO(raw)
    of = splits.layout(source)
    starts, at = set(), of.first
    while at < len(raw):
        starts.add(at)
        at += 16 + struct.unpack_from("<I", raw, at + 8)[0]
    guesses = [splits.guess(source, of, a, a + 3000, len(raw)) for a in range(3000, len(raw), 3000)]
    assert any(g is not None and g not in starts for g in guesses)
    sound = io.BytesIO(CASES["classic"])
    at = splits.guess(sound, splits.layout(sound), 50_000, 60_000, len(CASES["classic"]))
    assert at is not None and list(splits.Walk(sound, splits.layout(sound), at, 1 << 62))


@pytest.mark.parametrize("ng", [False, True])
def test_damaged_files(spark, tmp_path, ng):
    whole = _capture(ng, _packets(400, 9))
    damaged = {"cut": whole[:-7], "middle": whole[: len(whole) // 2] + b"\xff" * 40 + whole[len(whole) // 2 + 40 :]}
    if ng:
        damaged["trailer"] = whole[:-2] + b"\xff\xff"
    for name, raw in damaged.items():
        (tmp_path / f"{ng}-{name}").mkdir()
        (tmp_path / f"{ng}-{name}" / "a.cap").write_bytes(raw)
        (tmp_path / f"{ng}-{name}" / "b.cap").write_bytes(whole)
        expected = [(0, *r) for r in _sequential(raw, lenient=True)] + [(1, *r) for r in _sequential(whole)]
        read = lambda **kw: read_capture(spark, str(tmp_path / f"{ng}-{name}"), **kw)  # noqa: E731, B023
        for size in (4000, 1 << 30):
            try:
                assert _rows(read(lenient=True, split_bytes=size)) == expected
            except AssertionError:
                raise AssertionError(f"{name} {size}") from None
            if len(expected) < 800:
                with pytest.raises(PySparkException):
                    read(split_bytes=size).count()


def _pushed(df, capsys) -> str:
    df.explain("formatted")
    plan = capsys.readouterr().out
    assert "Filter" not in plan.replace("PushedFilters", "")
    return next(x for x in plan.splitlines() if x.startswith("PushedFilters"))


def test_filters_are_pushed_and_splits_outside_are_not_opened(spark, tmp_path, capsys):
    folder = tmp_path / "captures"
    folder.mkdir()
    for k in range(6):
        packets = [(1000 * k + i, i, 60 + i, bytes(i + 1)) for i in range(100)]
        (folder / f"{k}.cap").write_bytes(_capture(k % 2 == 0, packets))
    index = capture_index(spark, str(folder), folder=str(tmp_path / "index"), split_bytes=2000)
    for k in (0, 1, 4, 5):  # a file that is not there can't be opened
        os.rename(folder / f"{k}.cap", tmp_path / f"{k}.away")
    df = slice_capture(read_capture(spark, index=index, lengths=True), 2010, 3050)
    assert "GreaterThanOrEqual(ts_secs,2010), LessThan(ts_secs,3050)" in _pushed(df, capsys)
    assert [(r.file_ord, r.frame_no) for r in df.orderBy("file_ord", "frame_no").select("file_ord", "frame_no").collect()] == [(2, n) for n in range(11, 101)] + [(3, n) for n in range(1, 51)]
    some = df.rdd.getNumPartitions()
    assert 2 <= some < read_capture(spark, index=index).rdd.getNumPartitions() / 2
    long = df.where("frame_len > 90 and orig_len <= 155 and frame_no in (96, 97, 20)")
    assert "GreaterThan(frame_len,90)" in _pushed(long, capsys)
    assert [(r.frame_no, r.frame_len, r.orig_len) for r in long.collect()] == [(96, 96, 155)]
    assert df.where(F.col("ts_usecs") == 7).count() == 1 and df.where(F.col("frame_no").isNull()).count() == 0
    assert df.where("orig_len = 100 or ts_secs = 2020").count() == 2 + 1
    with pytest.raises(PySparkException):
        read_capture(spark, index=index).count()


def test_empty_files_and_folders(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert read_capture(spark, str(tmp_path / "none")).count() == 0
    assert read_capture(spark, index=capture_index(spark, str(tmp_path / "none"), folder=str(tmp_path / "i"))).count() == 0
    (tmp_path / "zero.cap").write_bytes(b"")
    with pytest.raises(PySparkException):
        read_capture(spark, str(tmp_path / "zero.cap")).count()
    assert read_capture(spark, str(tmp_path / "zero.cap"), lenient=True).count() == 0
    with pytest.raises(FileNotFoundError):
        read_capture(spark, str(tmp_path / "gone.cap"))


def _plain_index(tmp_path, size: int):
    """A capture of one file with the splits that an index would have."""
    path = tmp_path / "a.pcapng"
    path.write_bytes(_capture(True, _packets(3000, 3)))
    with open(path, "rb") as source:
        of = splits.layout(source)
        (run,) = splits.Walk(source, of, of.first, 1 << 62)
    starts, out = [of.first + b - 28 for b in run.begin], []
    for a in range(0, path.stat().st_size, size):
        if own := [i for i, x in enumerate(starts) if a <= x < a + size]:
            out.append(_Split(str(path), 0, starts[own[0]] if out else of.first, a + size, own[0], [splits.MICROS] * bool(out)))
    return path, out


def test_small_splits_share_tasks(tmp_path, monkeypatch):
    path, each = _plain_index(tmp_path, 4096)
    monkeypatch.setattr(captures, "SPLIT_TASKS", 20)
    monkeypatch.setattr(splits, "SPLIT_TASKS", 20)  # both names are of one number
    rows = lambda parts: [r for s in parts for b in captures._batches(s, captures.Pushed(), False, False) for r in b.to_pylist()]
    wanted = [(i % 50 != 49, s) for i, s in enumerate(each)]
    expected = rows(s for yes, s in wanted if yes)
    joined = captures._Reader._joined([(yes, _Split(**vars(s))) for yes, s in wanted])
    assert len(each) > 150 and 20 <= len(joined) < 45 and rows(joined) == expected
    assert splits.split_tasks(55_000, 55_000 << 16) == 26 and splits.split_tasks(9, 10**6) == 9


def test_small_splits_read_little(tmp_path, monkeypatch):
    monkeypatch.setattr(splits, "EDGE", 8192)
    path, each = _plain_index(tmp_path, 4096)
    taken = []

    class Counted(io.BytesIO):
        def read(self, n=-1):
            got = super().read(n)
            taken.append(len(got))
            return got

    source = Counted(path.read_bytes())
    of = splits.layout(source)
    for s in each:
        splits.guess(source, of, s.start, s.end, path.stat().st_size)
        assert sum(len(run.secs) for run in splits.Walk(source, of, s.start, s.end, list(s.ticks)))
    assert sum(taken) < 8 * path.stat().st_size


def test_wrong_guesses_are_measured_again_together():
    row = lambda i, start, reached: {"path": "a", "file_ord": 0, "begin": 100 * i, "end": 100 * i + 100, "size": 1000, "start": start, "reached": reached, "records": 3, "damaged": False}
    given = [row(0, 24, 110), row(1, 150, 205), row(2, 205, 320), row(3, 360, 410), row(4, None, None), row(5, 508, 700), row(6, 640, 700), row(7, 700, 800)]
    judged = splits._judged(pd.DataFrame(given))
    assert [(int(b), int(e)) for b, e, again in zip(judged["begin"], judged["expected"], judged["again"]) if again] == [(100, 110), (300, 320), (400, 410)]
    right = {1: (110, 205), 3: (320, 410), 4: (410, 508)}
    judged = splits._judged(pd.DataFrame([g | dict(zip(("start", "reached"), right.get(i, (g["start"], g["reached"])))) for i, g in enumerate(given)]))
    assert not judged["again"].any() and judged["void"].tolist() == [False] * 6 + [True, False]


def test_an_interface_number_is_no_block(tmp_path):
    """Interface 0 and the upper half of a time look like a block that ends beyond what is read."""
    raw = _capture(True, [(1_705_000_000 + i, 5, 60, bytes([i % 251]) * 60) for i in range(12_000)])
    source, size = io.BytesIO(raw), len(raw)
    of = splits.layout(source)
    for begin in range(1 << 16, 6 << 16, 1 << 16):
        at = splits.guess(source, of, begin, begin + (1 << 16), size)
        assert struct.unpack_from("<II", raw, at) == (splits.EPB, 92) and at - begin < 92
