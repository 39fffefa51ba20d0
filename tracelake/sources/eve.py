"""Suricata EVE JSON lines as alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.text import suricata_severity, truncated, with_eve_millis
from tracelake.schema import ALERT_COLUMNS

DETAIL = 400


#: The keys that matter, each as the value it has: one walk over an event, and one over its alert object.
_EVENT = ("event_type", "src_ip", "src_port", "dest_ip", "dest_port", "proto", "app_proto", "timestamp", "alert", "anomaly")
_ALERT = ("signature", "category", "action", "signature_id", "gid", "severity")


def _keys(value: Column, names: tuple[str, ...]) -> Column:
    """A struct of an object's values; null for anything that is no object."""
    return F.try_variant_get(value, "$", f"struct<{','.join(f'{n}:variant' for n in names)}>")


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _text(value: Column) -> Column:
    """A text; null for a value of any other kind."""
    return F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _whole(value: Column) -> Column:
    return F.when(_kind(value) == "BIGINT", F.try_variant_get(value, "$", "bigint"))


def _port(value: Column) -> Column:
    """``:port`` of a whole number, or of a text that is one; else nothing."""
    number = F.coalesce(_whole(value), _text(value).try_cast("bigint"))
    return F.coalesce(F.concat(F.lit(":"), number.cast("string")), F.lit(""))


def convert_eve(lines: DataFrame, event_types: list[str] = ("alert",)) -> DataFrame:
    """``lines`` (value and any other column) with outcome (kept, skipped, error) and an alert struct.

    A line that is no JSON is an error, and so is an alert event without a well-typed alert object.  An event
    of another type than asked for is skipped.
    """
    wanted = [t.strip().lower() for t in event_types if t.strip()]
    if not wanted:
        raise ValueError("at least one event type is needed")
    lit, c = F.lit, F.col
    # each step names what the next one reads, so that nothing is computed twice
    rows = lines.where(F.trim("value") != "").select(F.struct(*lines.columns).alias("row"), F.try_parse_json("value").alias("v"))
    rows = rows.select("row", c("v").isNotNull().alias("json"), _keys(c("v"), _EVENT).alias("e"))
    rows = rows.select("row", "json", "e", F.coalesce(F.lower(_text(c("e.event_type"))), lit("")).alias("kind"))
    rows = rows.select("row", "json", "e", "kind", F.when(c("kind") == "alert", _keys(c("e.alert"), _ALERT)).alias("a"))
    typed = lambda name, kind: _kind(c(f"a.{name}")).isin(kind, "VOID")
    sound = c("a").isNotNull()
    for name, kind in (*((n, "STRING") for n in ("signature", "category", "action")), *((n, "BIGINT") for n in ("signature_id", "gid", "severity"))):
        sound = sound & typed(name, kind)
    outcome = F.when(~c("json"), "error").when(~c("kind").isin(wanted), "skipped").when((c("kind") == "alert") & ~sound, "error").otherwise("kept")
    rows = rows.select("row", "e", "kind", "a", outcome.alias("outcome"))
    dash = lambda value: F.coalesce(_text(value), lit("-"))
    odd = _keys(c("e.anomaly"), ("type", "event"))
    rows = rows.select(
        "row", "outcome", "kind", "e.timestamp", "e.src_port", "e.dest_port", F.coalesce(_text(c("e.src_ip")), lit("unknown")).alias("src"), dash(c("e.dest_ip")).alias("dst"),
        dash(c("e.proto")).alias("proto"), dash(c("e.app_proto")).alias("app"), "a", F.coalesce(_whole(c("a.signature_id")), lit(0)).cast("string").alias("sid"),
        F.when(c("kind") == "anomaly", F.coalesce(_text(odd["type"]), _text(odd["event"]), lit("anomaly"))).alias("odd"),
    )
    alert = F.concat(
        F.coalesce(_text(c("a.signature")), F.concat(lit("suricata signature "), "sid")), lit(" | cat="), dash(c("a.category")), lit(" action="), dash(c("a.action")), lit(" "), "proto", lit(" "), "src",
        _port(c("src_port")), lit(" -> "), "dst", _port(c("dest_port")), lit(" app="), "app",
    )
    anomaly = F.concat(lit("Suricata anomaly type="), "odd", lit(" "), "proto", lit(" "), "src", lit(" -> "), "dst")
    rule = F.concat(lit("suricata:"), F.coalesce(_whole(c("a.gid")), lit(1)).cast("string"), lit(":"), "sid")
    by_kind = lambda a, b, other: F.when(c("kind") == "alert", a).when(c("kind") == "anomaly", b).otherwise(other)
    rows = rows.select(
        "row", "outcome", F.coalesce(_text(c("timestamp")), lit("")).alias("timestamp"), by_kind(rule, F.concat(lit("suricata:anomaly:"), "odd"), F.concat(lit("suricata:event:"), "kind")).alias("rule"),
        by_kind(suricata_severity(_whole(c("a.severity"))), lit("low"), lit("info")).alias("severity"), "src", by_kind(alert, anomaly, F.concat(lit("Suricata event_type="), "kind")).alias("detail"),
    )
    rows = with_eve_millis(rows, "timestamp", "ts_unix_ms")
    made = F.struct("ts_unix_ms", "rule", "severity", "src", truncated(c("detail"), DETAIL).alias("detail"))
    return rows.select(*[c("row").getField(n).alias(n) for n in lines.columns], "outcome", F.when(c("outcome") == "kept", made).alias("alert"))


#: Where a line stands: its file, the start of its split in it, and its number in the task.
PLACE = ["file", "block", "line"]


def read_eve(spark, path: str) -> DataFrame:
    """Lines (value) with their PLACE, whose order is that of the files by name and of the lines in them."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")]
    return spark.read.text(path).select("value", *place)


def stopping_line(converted: DataFrame, max_alerts: int) -> Column | None:
    """Whether a line stands at or before the first alert beyond the cap; None if there are no more alerts.

    Splits' counts are added up, a row a split, and only the split in which the cap falls is looked through.
    """
    kept = converted.where("outcome = 'kept'")
    counts = kept.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    so_far = counts.withColumn("upto", F.sum("n").over(Window.orderBy("file", "block")))
    split = so_far.where(F.col("upto") > max_alerts).orderBy("file", "block").first()
    if split is None:
        return None
    within = kept.where((F.col("file") == split.file) & (F.col("block") == split.block)).select("line")
    line = within.orderBy("line").offset(max_alerts - (split.upto - split.n)).first().line
    return F.struct(*PLACE) <= F.struct(F.lit(split.file).alias("file"), F.lit(split.block).alias("block"), F.lit(line).alias("line"))


def _placed(converted: DataFrame) -> bool:
    return set(PLACE) <= set(converted.columns)


def kept_alerts(converted: DataFrame, max_alerts: int | None = None, order: list[str] = ()) -> DataFrame:
    """The alerts (ALERT); with a cap, the first by ``order``, or as the lines stand in their files."""
    kept = converted.where("outcome = 'kept'")
    if max_alerts is not None:
        if max_alerts < 1:
            raise ValueError("the cap must be above 0")
        if not order and _placed(converted):
            stop = stopping_line(converted, max_alerts)
            # the stopping line is an alert, the first that is not kept
            kept = kept if stop is None else kept.where(stop).orderBy(*PLACE).limit(max_alerts)
        else:
            kept = kept.orderBy(*(order or ["value"])).limit(max_alerts)
    return kept.select(*[F.col(f"alert.{c}").alias(c) for c in ALERT_COLUMNS])


def import_counters(converted: DataFrame, max_alerts: int | None = None, order: list[str] = ()) -> DataFrame:
    """(lines_read, alerts_kept, skipped, parse_errors, truncated) in one row.

    With a cap, reading stops at the first alert beyond it: that line is read, and what follows is not counted.
    """
    kept = F.col("outcome") == "kept"
    rows = converted
    if max_alerts is not None and not order and _placed(converted):
        stop = stopping_line(converted, max_alerts)
        rows = converted if stop is None else converted.where(stop)
    elif max_alerts is not None:
        beyond = converted.where(kept).select(*order).orderBy(*order).offset(max_alerts).limit(1)
        stop = beyond.select(F.struct(*order).alias("__stop"))
        rows = converted.join(F.broadcast(stop), F.lit(True), "left").where(F.col("__stop").isNull() | (F.struct(*order) <= F.col("__stop")))
    n = F.count_if(kept)
    cap = F.lit(max_alerts if max_alerts is not None else 1 << 62)
    return rows.agg(
        F.count(F.lit(1)).alias("lines_read"), F.least(n, cap).cast("long").alias("alerts_kept"), F.count_if(F.col("outcome") == "skipped").alias("skipped"),
        F.count_if(F.col("outcome") == "error").alias("parse_errors"), (n > cap).alias("truncated"),
    )


def import_eve(spark, path: str, event_types: list[str] = ("alert",), max_alerts: int | None = None) -> DataFrame:
    """The alerts of a log, at most ``max_alerts``, the first in its files."""
    return kept_alerts(convert_eve(read_eve(spark, path), event_types), max_alerts)
