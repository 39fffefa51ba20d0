"""Stream sinks: each row once, over restarts and commits that broke off."""

import json

import pytest

from tests import frames as f
from tests.test_decode import table
from tracelake.operators.siem import export_stream, siem_lines
from tracelake.schema import ALERT
from tracelake.sources.batch_files import COMMITTED, BatchFiles, _encode_lines, _Part
from tracelake.sources.captures import read_capture, write_capture_stream


def _run(start):
    query = start()
    query.awaitTermination(120)
    assert query.exception() is None


def _forget_last_commit(checkpoint):
    """What a crash leaves between a sink's commit and Spark's own."""
    last = max((p for p in (checkpoint / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    for crc in (checkpoint / "commits").glob(f".{last.name}.crc"):
        crc.unlink()


@pytest.mark.parametrize("variant", ["pcap", "pcapng"])
def test_captures_once(spark, tmp_path, variant):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    frames = table(spark, f.syn_scan(20))
    stream = lambda: spark.readStream.schema(frames.schema).parquet(source)
    run = lambda: _run(lambda: write_capture_stream(stream(), out, checkpoint, variant, availableNow=True))
    frames.where("frame_no <= 12").repartition(3).write.mode("append").parquet(source)
    run()
    frames.where("frame_no > 12").repartition(2).write.mode("append").parquet(source)
    run()
    rows = lambda df: sorted((r.ts_secs, r.ts_usecs, r.orig_len, bytes(r.data)) for r in df.collect())
    assert rows(read_capture(spark, out)) == rows(frames)
    _forget_last_commit(tmp_path / "ck")
    run()  # the last batch again: it was complete
    assert rows(read_capture(spark, out)) == rows(frames)
    _forget_last_commit(tmp_path / "ck")
    (tmp_path / "out" / COMMITTED / "1").unlink()  # and again, after a commit that broke off before its marker
    run()
    assert rows(read_capture(spark, out)) == rows(frames)


def test_captures_of_tasks_without_rows(spark, tmp_path):
    frames = table(spark, f.syn_scan(6))
    frames.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in"))
    for name, rows in (("some", stream.where("frame_no = 2")), ("none", stream.where("frame_no > 99"))):
        out = str(tmp_path / name)
        _run(lambda: write_capture_stream(rows.repartition(4), out, str(tmp_path / f"ck-{name}"), "pcapng", availableNow=True))
        assert read_capture(spark, out).count() == (name == "some")


def test_lines_once(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    alerts = spark.createDataFrame([(1000 + i, "rare_port", "low", f"10.0.0.{i}", f"ü {i}\n") for i in range(9)], ALERT)
    for part in ("ts_unix_ms < 1004", "ts_unix_ms >= 1004"):
        alerts.where(part).repartition(2).write.mode("append").parquet(source)
        _run(lambda: export_stream(spark.readStream.schema(alerts.schema).parquet(source), out, checkpoint, "jsonl", availableNow=True))
    want = sorted(r.value for r in siem_lines(alerts, "jsonl").collect())
    assert sorted(r.value for r in spark.read.text(out + "/*.log").collect()) == want and json.loads(want[0])["src"] == "10.0.0.0"
    _forget_last_commit(tmp_path / "ck")
    _run(lambda: export_stream(spark.readStream.schema(alerts.schema).parquet(source), out, checkpoint, "jsonl", availableNow=True))
    assert sorted(r.value for r in spark.read.text(out + "/*.log").collect()) == want


def test_lines_of_tasks_without_rows(spark, tmp_path):
    alerts = spark.createDataFrame([(1000, "rare_port", "low", "10.0.0.1", "x")], ALERT)
    alerts.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(alerts.schema).parquet(str(tmp_path / "in")).repartition(3)
    _run(lambda: export_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"), "cef", availableNow=True))
    assert [r.value for r in spark.read.text(f"{tmp_path}/out/*.log").collect()] == [r.value for r in siem_lines(alerts, "cef").collect()]


def test_commit_replaces_what_broke_off(tmp_path):
    sink = BatchFiles(str(tmp_path), ".log", _encode_lines)
    (tmp_path / "batch-0000000003-00007.log").write_text("half\n")  # of a commit of batch 3 that broke off
    (tmp_path / "batch-0000000002-00000.log").write_text("two\n")
    for n in (0, 1):
        (tmp_path / f".t{n}").write_text(f"{n}\n")
    sink.commit([_Part(str(tmp_path / ".t0"), 0), None, _Part(str(tmp_path / ".t1"), 1)], 3)
    assert {p.name: p.read_text() for p in tmp_path.glob("batch-*")} == {"batch-0000000002-00000.log": "two\n", "batch-0000000003-00000.log": "0\n", "batch-0000000003-00001.log": "1\n"}
    (tmp_path / ".t2").write_text("again\n")
    sink.commit([_Part(str(tmp_path / ".t2"), 0)], 3)
    assert not (tmp_path / ".t2").exists() and (tmp_path / "batch-0000000003-00000.log").read_text() == "0\n"
    (tmp_path / ".t3").write_text("x\n")
    sink.abort([_Part(str(tmp_path / ".t3"), 0), None], 4)
    assert not (tmp_path / ".t3").exists()


def test_lines_want_one_text_column(spark, tmp_path):
    from tracelake.sources.batch_files import register_lines, write_stream

    register_lines(spark)
    rows = spark.readStream.format("rate").load()
    with pytest.raises(Exception, match="one string column"):
        query = write_stream(rows, "lines", str(tmp_path / "out"), str(tmp_path / "ck"), availableNow=True)
        query.awaitTermination(60)
