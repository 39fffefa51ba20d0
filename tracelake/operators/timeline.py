"""Timelines, key findings and recent rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.text import severity_rank

MAX_EVENTS = 200
_EVENT = "ts_unix_ms long, kind string, title string, detail string"


def _or(column: str, default: str) -> Column:
    return F.coalesce(column, F.lit(default))


def alert_events(alerts: DataFrame) -> DataFrame:
    detail = F.trim(F.concat(F.lit("src="), _or("src", "-"), F.lit(" "), _or("detail", "")))
    return alerts.select(F.coalesce("ts_unix_ms", F.lit(0)).alias("ts_unix_ms"), F.lit("alert").alias("kind"), F.concat(_or("severity", "-"), F.lit(": "), _or("rule", "alert")).alias("title"), detail.alias("detail"))


def audit_events(audit: DataFrame) -> DataFrame:
    title = F.concat(_or("module", "audit"), F.lit(" / "), _or("action", "-"))
    return audit.select(F.coalesce("ts_unix_ms", F.lit(0)).cast("long").alias("ts_unix_ms"), F.lit("audit").alias("kind"), title.alias("title"), F.concat(F.lit("result="), _or("result", "-")).alias("detail"))


def _one(ts: Column, kind: str, title: str, detail: Column) -> list[Column]:
    return [ts.cast("long").alias("ts_unix_ms"), F.lit(kind).alias("kind"), F.lit(title).alias("title"), detail.alias("detail")]


def capture_events(summary: DataFrame, peak: DataFrame, path: str, generated_ms: int) -> DataFrame:
    """Start, peak and end of a capture, from one-row frames."""
    s = summary
    start = s.where("first_ts is not null").select(*_one(F.col("first_ts"), "capture", "PCAP window start", F.lit(f"{path} (first packet)")))
    text = F.concat(F.col("packets").cast("string"), F.lit(" packets in bucket (tcp="), F.col("tcp").cast("string"), F.lit(" udp="), F.col("udp").cast("string"), F.lit(" app="), F.col("app").cast("string"), F.lit(")"))
    top = peak.where("packets > 0").select(*_one(F.col("ts_unix_ms"), "capture", "PCAP traffic peak", text))
    total = F.concat(F.lit(f"{path} ("), F.col("packets").cast("string"))
    end = s.where("last_ts is not null").select(*_one(F.col("last_ts"), "capture", "PCAP window end", F.concat(total, F.lit(" packets total)"))))
    empty = s.where("last_ts is null").select(*_one(F.lit(generated_ms - 4), "capture", "PCAP summarized", F.concat(total, F.lit(" packets)"))))
    return start.unionByName(top).unionByName(end).unionByName(empty)


def build_timeline(spark, generated_ms: int, *, alerts: DataFrame | None = None, audit: DataFrame | None = None, packets_processed: int | None = None, scan: DataFrame | None = None, closed: int = 0, services: DataFrame | None = None, capture: DataFrame | None = None, notes: list[str] = (), limit: int | None = MAX_EVENTS) -> DataFrame:
    """The union of all inputs' events in order of time, kind and title; the earliest ``limit`` stay."""
    parts = []
    if audit is not None:
        parts.append(audit_events(audit))
    if alerts is not None:
        parts.append(alert_events(alerts))
    if scan is not None:
        text = F.concat(F.lit("open="), F.count(F.lit(1)).cast("string"), F.lit(f" closed_or_filtered={closed}"))
        parts.append(scan.agg(text.alias("d")).select(*_one(F.lit(generated_ms - 3), "scan", "Connect scan results ingested", F.col("d"))))
    if services is not None:
        text = F.concat(F.count(F.lit(1)).cast("string"), F.lit(" results"))
        parts.append(services.agg(text.alias("d")).select(*_one(F.lit(generated_ms - 2), "enum", "Service enumeration ingested", F.col("d"))))
    if capture is not None:
        parts.append(capture)
    fixed = [(generated_ms - 1 + i, "note", "Operator note", n) for i, n in enumerate(notes)]
    if packets_processed is not None:
        fixed.append((generated_ms - 2, "system", "IDS-lite detection complete", f"{packets_processed} packets processed"))
    fixed.append((generated_ms, "system", "Evidence pack assembled", "Markdown/HTML/JSON report generated"))
    out = spark.createDataFrame(fixed, _EVENT)
    for p in parts:
        out = out.unionByName(p)
    ordered = out.orderBy("ts_unix_ms", "kind", "title", "detail")
    return ordered if limit is None else ordered.limit(limit)


def key_findings(alerts: DataFrame, open_ports: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """(section, rank, label, detail): open ports first, then alerts by severity, in their order."""
    order = ["ts_unix_ms", "rule", "src", "detail"]
    text = F.trim(F.concat(_or("rule", "alert"), F.lit(" src="), _or("src", "-"), F.lit(" "), _or("detail", "")))
    found = alerts.select(F.lit(1).alias("section"), severity_rank(F.col("severity")).alias("rank"), F.struct(*order).alias("ord"), F.concat(F.lit("Alert ("), _or("severity", "-"), F.lit(")")).alias("label"), text.alias("detail"))
    if open_ports is not None:
        none = F.struct(F.lit(0).cast("long").alias("ts_unix_ms"), F.lit("").alias("rule"), F.col("ip").alias("src"), F.lpad(F.col("port").cast("string"), 6, "0").alias("detail"))
        ports = open_ports.select(F.lit(0).alias("section"), F.lit(0).alias("rank"), none.alias("ord"), F.lit("Open port").alias("label"), F.concat(_or("ip", "?"), F.lit(":"), F.coalesce(F.col("port").cast("string"), F.lit("?"))).alias("detail"))
        found = ports.unionByName(found)
    return found.orderBy("section", "rank", "ord").limit(limit).select("section", "rank", "label", "detail")


def recent(rows: DataFrame, n: int, by: list[str]) -> DataFrame:
    """The last ``n`` rows by ``by``, oldest first (a top-n, then a sort of n rows)."""
    return rows.orderBy(*[F.desc(c) for c in by]).limit(n).orderBy(*by)
