"""Queries that run a table through Structured Streaming to its end, so that a stream can be held against SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.rule_language import DetectConfig
from tracelake.operators.siem import SiemMeta, export_stream
from tracelake.plans.frames import event_frames
from tracelake.schema import ALERT, packet_view
from tracelake.sources.captures import read_capture, write_capture_stream
from tracelake.sources.folders import shared_folder
from tracelake.streaming.detect import detect_stream

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that timers need, for queries that start inside."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _finished(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def streamed(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table of the folder as a stream of all its rows."""
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")  # a pattern, as a stream of files wants a folder or one


def captures(spark: SparkSession, d: str) -> DataFrame:
    """What the captures hold that a stream of frames wrote."""
    folder = shared_folder(spark, "stream")
    _finished(write_capture_stream(event_frames(streamed(spark, d, "events")), f"{folder}/out", f"{folder}/checkpoint", "pcapng", availableNow=True))
    return read_capture(spark, f"{folder}/out").groupBy(F.expr("ts_secs div 3600").alias("hour")).agg(
        F.count(F.lit(1)).alias("frames"), F.sum("orig_len").alias("original"), F.sum(F.octet_length("data")).cast("long").alias("captured"), F.sum("ts_usecs").alias("micros")
    )


def lines(spark: SparkSession, d: str, alerts: Callable[[DataFrame], DataFrame], fmt: str, meta: SiemMeta) -> DataFrame:
    """The collector lines that a stream of alerts wrote."""
    folder = shared_folder(spark, "stream")
    _finished(export_stream(alerts(streamed(spark, d, "events")), f"{folder}/out", f"{folder}/checkpoint", fmt, meta, availableNow=True))
    return spark.read.text(f"{folder}/out", pathGlobFilter="*.log")


def event_time(spark: SparkSession, d: str, cfg: DetectConfig) -> DataFrame:
    """Alerts of a stream of packets in event time, judged to the end: a last echo reply, long after, is no signal
    but moves the watermark past all others."""
    folder = shared_folder(spark, "stream")
    events = spark.read.parquet(f"{d}/events.parquet")
    last = events.agg(F.max("event_id").alias("event_id"), F.max("ts").alias("ts")).select((F.col("event_id") + 1).alias("event_id"), (F.col("ts") + F.expr("interval 90 days")).alias("ts"))
    fixed = {"user_id": F.lit(0), "event_type": F.lit("purchase"), "value": F.lit(0.0), "props": F.lit('{"k": 1}')}
    last.select(*[(fixed[f.name] if f.name in fixed else F.col(f.name)).cast(f.dataType).alias(f.name) for f in events.schema]).write.parquet(f"{folder}/last")
    rows = streamed(spark, d, "events").unionByName(spark.readStream.schema(events.schema).parquet(f"{folder}/last"))
    with _state_store(spark):
        alerts = detect_stream(packet_view(rows), cfg, lateness="1 hour")
        _finished(alerts.writeStream.format("parquet").option("path", f"{folder}/alerts").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    return spark.read.schema(ALERT).parquet(f"{folder}/alerts")
