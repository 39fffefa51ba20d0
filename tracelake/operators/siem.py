"""Alerts as lines for log collectors, and the exporters."""

from __future__ import annotations

import socket
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.text import rfc3339
from tracelake.sources.batch_files import register_lines, write_stream

PRODUCT, VERSION = "tracelake", "0.1.0"
UDP_BYTES = 1200
_FORMATS = {"jsonl": "jsonl", "json": "jsonl", "ndjson": "jsonl", "cef": "cef", "syslog": "syslog", "rfc5424": "syslog"}


@dataclass(frozen=True)
class SiemMeta:
    module: str = "detect"
    ticket_id: str = "-"
    operator: str = "-"
    hostname: str = "localhost"


def parse_format(name: str) -> str:
    try:
        return _FORMATS[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown format {name!r}") from None


def _cef(column: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("|", "\\|"), ("=", "\\="), ("\n", " "), ("\r", " ")):
        column = F.replace(column, F.lit(a), F.lit(b))
    return column


def _token(column: Column) -> Column:
    out = F.translate(column, " \t\n\r", "____")
    return F.when(out == "", F.lit("-")).otherwise(out)


def jsonl_line(meta: SiemMeta) -> Column:
    fixed = lambda v, n: F.lit(v).alias(n)
    return F.to_json(
        F.struct("ts_unix_ms", fixed(PRODUCT, "product"), fixed(VERSION, "version"), fixed(meta.module, "module"), fixed(meta.ticket_id, "ticket_id"), fixed(meta.operator, "operator"), "rule", "severity", "src", "detail", fixed(meta.hostname, "hostname"))
    )


def cef_line(meta: SiemMeta) -> Column:
    level = F.lower("severity")
    number = F.when(level == "info", "2").when(level == "low", "3").when(level == "high", "7").when(level == "critical", "9").otherwise("5")
    lit = lambda v: _cef(F.lit(v))
    rule = _cef(F.col("rule"))
    return F.concat(
        F.lit(f"CEF:0|Tracelake|{PRODUCT}|{VERSION}|"), rule, F.lit("|"), rule, F.lit("|"), number, F.lit("|rt="), F.col("ts_unix_ms").cast("string"), F.lit(" src="), _cef(F.col("src")), F.lit(" msg="), _cef(F.col("detail")),
        F.lit(" cs1Label=ticket cs1="), lit(meta.ticket_id), F.lit(" cs2Label=operator cs2="), lit(meta.operator), F.lit(" cs3Label=module cs3="), lit(meta.module),
    )


def syslog_line(meta: SiemMeta) -> Column:
    level = F.lower("severity")
    number = F.when(level == "critical", 2).when(level == "high", 3).when(level == "medium", 4).when(level == "low", 5).otherwise(6) + 128
    token = lambda v: _token(F.lit(v))
    message = F.translate("detail", "\n\r", "  ")
    return F.concat(
        F.lit("<"), number.cast("string"), F.lit(">1 "), rfc3339(F.col("ts_unix_ms")), F.lit(" "), token(meta.hostname), F.lit(f" {PRODUCT} "), token(meta.module), F.lit(" - - rule="), _token(F.col("rule")), F.lit(" severity="), _token(F.col("severity")),
        F.lit(" src="), _token(F.col("src")), F.lit(" ticket="), token(meta.ticket_id), F.lit(" operator="), token(meta.operator), F.lit(" detail="), message,
    )


def siem_lines(alerts: DataFrame, fmt: str = "jsonl", meta: SiemMeta | None = None) -> DataFrame:
    """(value): one line an alert."""
    line = {"jsonl": jsonl_line, "cef": cef_line, "syslog": syslog_line}[parse_format(fmt)]
    return alerts.select(line(meta or SiemMeta()).alias("value"))


def export_file(alerts: DataFrame, path: str, fmt: str = "jsonl", meta: SiemMeta | None = None, mode: str = "append") -> None:
    siem_lines(alerts, fmt, meta).write.mode(mode).text(path)


def export_stream(alerts: DataFrame, path: str, checkpoint: str, fmt: str = "jsonl", meta: SiemMeta | None = None, **trigger):
    """Starts a query that appends the lines of a stream of alerts to a folder, each once, also over restarts."""
    register_lines(alerts.sparkSession)
    return write_stream(siem_lines(alerts, fmt, meta), "lines", path, checkpoint, **trigger)


def export_udp(alerts: DataFrame, host: str, port: int, fmt: str = "jsonl", meta: SiemMeta | None = None) -> int:
    """Send each line, cut to UDP_BYTES, from the tasks; the number sent.  A retried task sends again."""

    def send(batches):
        import pyarrow as pa

        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as out:
            for batch in batches:
                for line in batch.column(0).to_pylist():
                    out.sendto(line.encode()[:UDP_BYTES], (host, port))
                yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return siem_lines(alerts, fmt, meta).mapInArrow(send, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
