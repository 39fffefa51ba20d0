"""Traffic counters, top lists, time histograms and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators.ordered import ranged, with_previous

APPS = ("dns", "http", "ssh", "tls", "arp", "dhcp")
TOP = 10


def traffic_stats(packets: DataFrame) -> DataFrame:
    """One row of counters.  ``other`` holds what is no TCP, UDP or ICMP, undecoded frames included."""
    kind = F.when(F.col("decode_ok"), F.col("tkind"))
    known = F.coalesce(kind.isin("tcp", "udp", "icmp"), F.lit(False))
    return packets.agg(
        F.count(F.lit(1)).alias("packets"),
        F.coalesce(F.sum("frame_len"), F.lit(0)).cast("long").alias("bytes"),
        *[F.count_if(kind == t).alias(t) for t in ("tcp", "udp", "icmp")],
        F.count_if(~known).alias("other"),
        *[F.count_if(F.col("decode_ok") & (F.col("app") == a)).alias(a) for a in APPS],
    )


def _top(keys: DataFrame, limit: int | None) -> DataFrame:
    counted = keys.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("count"))
    return counted if limit is None else counted.orderBy(F.desc("count"), F.asc("key")).limit(limit)


def top_addresses(packets: DataFrame, side: str = "src", limit: int | None = TOP) -> DataFrame:
    """Most frequent addresses: count descending, then address as text."""
    return _top(packets.where("decode_ok").select(F.col(f"ip.{side}").alias("key")), limit)


def top_ports(packets: DataFrame, side: str = "dst", limit: int | None = TOP) -> DataFrame:
    """Most frequent TCP and UDP ports: count descending, then port."""
    port = F.coalesce(f"tcp.{side}_port", f"udp.{side}_port")
    return _top(packets.where("decode_ok").select(port.alias("key")), limit)


def capture_summary(packets: DataFrame) -> DataFrame:
    """Counts, decode failures, first and last time of a capture in one row."""
    return packets.agg(
        F.count(F.lit(1)).alias("packets"),
        F.coalesce(F.sum("frame_len"), F.lit(0)).cast("long").alias("bytes"),
        F.count_if("decode_ok").alias("decoded"),
        F.count_if(~F.col("decode_ok")).alias("failed"),
        F.min("ts_ms").alias("first_ts"),
        F.max("ts_ms").alias("last_ts"),
        (F.max("ts_ms") - F.min("ts_ms")).alias("duration_ms"),
    )


def time_histogram(packets: DataFrame, buckets: int = 24) -> DataFrame:
    """(bucket, ts_unix_ms, packets, tcp, udp, app) with the empty buckets; none for an empty input.

    A bucket starts at first + span * i / n; a packet's bucket is (ts - first) * n / (span + 1).
    """
    n = min(128, max(1, buckets))
    ends = packets.agg(F.min("ts_ms").alias("first"), F.max("ts_ms").alias("last")).where("first is not null")
    span = F.col("last") - F.col("first")
    index = F.expr(f"least(cast((cast(ts_ms - first as decimal(20,0)) * {n}) div (last - first + 1) as int), {n - 1})")
    placed = packets.select("ts_ms", "tkind", "app").join(F.broadcast(ends))  # one row
    counted = placed.withColumn("bucket", F.when(span > 0, index).otherwise(0)).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("packets"), F.count_if(F.col("tkind") == "tcp").alias("tcp"), F.count_if(F.col("tkind") == "udp").alias("udp"), F.count_if(F.col("app").isNotNull()).alias("app")
    )
    frame = ends.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bucket"), F.expr(f"first + (greatest(last - first, 1) * bucket) div {n}").alias("ts_unix_ms"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return frame.join(F.broadcast(counted), "bucket", "left").select("bucket", "ts_unix_ms", *map(zero, ("packets", "tcp", "udp", "app")))


def peak_bucket(histogram: DataFrame) -> DataFrame:
    """The fullest bucket, the last of several."""
    row = F.struct("bucket", "ts_unix_ms", "packets", "tcp", "udp", "app")
    return histogram.agg(F.max_by(row, F.struct("packets", "bucket")).alias("r")).where("r is not null").select("r.*")


def alerts_by(alerts: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Alert counts by severity or rule, most first."""
    counted = alerts.groupBy(F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.asc("key"))
    return counted if limit is None else counted.limit(limit)


def alert_metrics(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count(F.lit(1)).alias("alerts"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")])


def kpis(alerts: DataFrame | None = None, open_ports: DataFrame | None = None, services: DataFrame | None = None, packets: DataFrame | None = None, audit: DataFrame | None = None) -> DataFrame:
    """The headline figures in one row; what is not given counts 0."""
    spark = next(d for d in (alerts, open_ports, services, packets, audit) if d is not None).sparkSession
    out = spark.range(1).select()
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name)) if df is not None else spark.range(1).select(F.lit(0).cast("long").alias(name))
    opened = services.where("state = 'open'") if services is not None else None
    metrics = alert_metrics(alerts) if alerts is not None else spark.range(1).select(*[F.lit(0).cast("long").alias(c) for c in ("alerts", "high", "medium", "low")])
    for one in (count(open_ports, "open_ports"), count(opened, "enum_hits"), metrics, count(packets, "packets"), count(audit, "audit_events")):
        out = out.join(F.broadcast(one))  # rows of one aggregate each
    return out


def packet_rate(packets: DataFrame, every_ms: int = 1000) -> DataFrame:
    """(ts_ms, packets, pps) of equal time slices that hold packets."""
    counted = packets.groupBy(F.expr(f"(ts_ms div {every_ms}) * {every_ms}").alias("ts_ms")).agg(F.count(F.lit(1)).alias("packets"))
    return counted.select("ts_ms", "packets", (F.col("packets") * 1000.0 / every_ms).alias("pps"))


def delta_time(packets: DataFrame) -> DataFrame:
    """Microseconds since the packet before, never below 0; null for the first.

    Packets are ranged by time; only the first one of a range looks at another range's last.
    """
    rows = ranged(packets.select("frame_no", "file_ord", "ts_us"), ["ts_us", "file_ord", "frame_no"])
    since = F.col("ts_us") - F.col("before")
    return with_previous(rows, "ts_us", "before").select("frame_no", "file_ord", F.when(since.isNotNull(), F.greatest(since, F.lit(0))).alias("delta_us"))


def session_presence(members: DataFrame, now_ms: int, stale_ms: int = 120_000) -> DataFrame:
    """Members (name, joined_ms, last_seen_ms, left) with a live label, active first, then by name."""
    label = F.when(F.col("left"), "left").when(F.lit(now_ms) - F.col("last_seen_ms") > stale_ms, "stale").otherwise("active")
    rank = F.when(F.col("live") == "active", 0).when(F.col("live") == "stale", 1).otherwise(2)
    return members.withColumn("live", label).orderBy(rank, "name")
