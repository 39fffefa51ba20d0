"""JSON reports and logs of other tools and of earlier runs as DataFrames."""

from __future__ import annotations

import json
import time
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.schema import ALERT, ALERT_COLUMNS

SCAN = "open array<struct<ip:string,port:int,proto:string,state:string,latency_ms:bigint>>, closed_or_filtered bigint, hosts_scanned bigint, ports_per_host bigint"
ENUM = "results array<struct<ip:string,port:int,state:string,service_guess:string,banner:string,http_server:string,error:string>>"
AUDIT = "ts_unix_ms bigint, action string, module string, operator string, ticket_id string, detail string, result string"


def _flat(struct: str) -> str:
    return ", ".join(p.replace(" ", ":", 1) for p in struct.split(", "))


def read_alerts(spark, path: str) -> DataFrame:
    """Alerts of a report object with ``alerts``, or of a bare array; one document a file."""
    text = spark.read.text(path, wholetext=True)
    kind = f"array<struct<{_flat(ALERT)}>>"
    bare = F.startswith(F.ltrim("value"), F.lit("["))
    found = F.when(bare, F.from_json("value", kind)).otherwise(F.from_json("value", f"struct<alerts:{kind}>")["alerts"])
    return text.select(F.posexplode(found).alias("ord", "a")).select("ord", *[F.col(f"a.{c}").alias(c) for c in ALERT_COLUMNS])


def read_report_alerts(spark, path: str) -> DataFrame:
    """Alerts of report objects alone."""
    return spark.read.schema(f"alerts array<struct<{_flat(ALERT)}>>").json(path, multiLine=True).select(F.posexplode("alerts").alias("ord", "a")).select("ord", "a.*")


def read_scan(spark, path: str) -> DataFrame:
    """Open ports of a port-probe report."""
    return spark.read.schema(SCAN).json(path, multiLine=True).select("closed_or_filtered", F.explode("open").alias("o")).select("closed_or_filtered", "o.*")


def read_services(spark, path: str) -> DataFrame:
    """Results of a service-enumeration report."""
    return spark.read.schema(ENUM).json(path, multiLine=True).select(F.explode("results").alias("r")).select("r.*")


def read_audit(spark, path: str) -> DataFrame:
    """Audit lines; those that are no JSON object are passed over, ``detail`` stays JSON text."""
    lines = spark.read.text(path)
    sound = F.startswith(F.schema_of_variant(F.try_parse_json("value")), F.lit("OBJECT"))
    return lines.where(sound).select(F.from_json("value", AUDIT).alias("a")).select("a.*")


def audit_record(path: str, action: str, module: str, operator: str, ticket_id: str, detail: dict, result: str) -> None:
    """Append one line to an audit log on the driver."""
    line = {"ts_unix_ms": int(time.time() * 1000), "action": action, "module": module, "operator": operator, "ticket_id": ticket_id, "detail": detail, "result": result}
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "a") as f:
        f.write(json.dumps(line) + "\n")


def count_lines(spark, path: str) -> int:
    return spark.read.text(path).where(F.trim("value") != "").count()


def read_notes(spark, path: str, n: int | None = None) -> DataFrame:
    """Session notes, the last ``n`` in order; bad lines are passed over."""
    kind = "ts_unix_ms bigint, operator string, ticket_id string, text string"
    notes = spark.read.schema(kind).option("mode", "DROPMALFORMED").json(path)
    return notes if n is None else notes.orderBy(F.desc("ts_unix_ms")).limit(n).orderBy("ts_unix_ms")


def report_lines(header: DataFrame, rows: DataFrame, key: str, order: list[str] = (), hidden: list[str] = ()) -> DataFrame:
    """(value): a report as JSON lines, the one row of ``header`` first and then each of ``rows`` under ``key``.

    Rows come by ``order``, or as their columns stand; ``hidden`` columns only order them.  They are turned into
    text where they are, so a report may have any number of them.
    """
    order = list(order) or rows.columns
    shown = [c for c in rows.columns if c not in hidden]
    place = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    body = rows.select(F.lit(1).alias("part"), place.alias("place"), F.to_json(F.struct(F.struct(*shown).alias(key))).alias("value"))
    head = header.select(F.lit(0).alias("part"), F.lit(None).cast(body.schema["place"].dataType).alias("place"), F.to_json(F.struct(*header.columns)).alias("value"))
    return head.unionByName(body).orderBy("part", "place", "value").select("value")


def read_report_lines(spark, path: str, key: str, schema: str) -> DataFrame:
    """The rows of a report written by ``report_lines``."""
    return spark.read.text(path).select(F.from_json("value", f"struct<{key}:struct<{_flat(schema)}>>")[key].alias("r")).where("r is not null").select("r.*")


def detect_report(alerts: DataFrame, packets: int, pack: str | None = None, cooldown_ms: int = 0) -> DataFrame:
    """A detection's report as lines: what was read and held back, then the alerts that the cooldown lets through.

    ``alerts`` come before any cooldown, so that what it holds back can be counted.
    """
    from tracelake.operators import detect

    placed = detect.ordered_alerts(alerts)
    through = detect.cooldown(placed, cooldown_ms).select(*ALERT_COLUMNS)
    count = lambda rows, name: rows.agg(F.count(F.lit(1)).alias(name))
    sizes = count(alerts, "before").join(F.broadcast(count(through, "kept")))  # one row each
    header = sizes.select(F.lit("detect").alias("module"), F.lit(packets).cast("long").alias("packets"), F.lit(pack).cast("string").alias("rules_pack"), "kept", (F.col("before") - F.col("kept")).alias("suppressed_by_cooldown"))
    return report_lines(header.withColumnRenamed("kept", "alerts_raised"), through, "alert", ALERT_COLUMNS)


def import_report(converted: DataFrame, source: str, max_alerts: int | None = None, order: list[str] = ()) -> DataFrame:
    """An import's report as lines: its counters, then its alerts."""
    from tracelake.sources.eve import import_counters, kept_alerts

    counters = import_counters(converted, max_alerts, order)
    header = counters.select(F.lit("import").alias("module"), F.lit(source).alias("source"), *counters.columns)
    return report_lines(header, kept_alerts(converted, max_alerts, order), "alert", ALERT_COLUMNS)


def diff_report(before: DataFrame, after: DataFrame, mode: str = "full") -> DataFrame:
    """The difference of two alert sets as lines: the totals, then the keys of each side."""
    from tracelake.operators.diff import diff_alerts

    parts = diff_alerts(before, after, mode)
    sides = [parts[name].select(F.lit(name).alias("side"), "key", "count", "sample") for name in ("only_before", "only_after")]
    header = parts["totals"].select(F.lit("diff").alias("module"), F.lit(mode).alias("key_mode"), "*")
    return report_lines(header, sides[0].unionByName(sides[1]), "change", ["side", "key"])
