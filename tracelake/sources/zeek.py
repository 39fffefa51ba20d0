"""Zeek notice and weird logs (TSV with a header, or JSON lines) as alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.text import notice_severity, truncated, weird_severity, zeek_millis
from tracelake.sources.eve import kept_alerts

DETAIL = 400


def sniff(lines: DataFrame) -> str:
    """``jsonl`` if the first line that is no comment starts with a brace, else ``tsv``."""
    first = lines.where((F.trim("value") != "") & ~F.startswith("value", F.lit("#"))).head(1)
    return "jsonl" if first and first[0]["value"].lstrip().startswith("{") else "tsv"


def header(lines: DataFrame) -> tuple[list[str] | None, str]:
    """Field names and the unset mark of a TSV log, from its directive lines."""
    fields, unset = None, "-"
    for (line,) in lines.where(F.col("value").rlike("^#(fields|unset_field)\\b")).distinct().collect():  # a few lines a log
        parts = line.split("\t") if "\t" in line else line.split()
        if parts[0] == "#fields":
            fields = parts[1:]
        elif len(parts) > 1:
            unset = parts[1]
    return fields, unset


def tsv_maps(lines: DataFrame, fields: list[str] | None, unset: str = "-") -> DataFrame:
    """``lines`` with m, a map of the columns that are set; null (an error) without field names."""
    rows = lines.where((F.trim("value") != "") & ~F.startswith("value", F.lit("#")))
    if fields is None:
        return rows.withColumn("m", F.lit(None).cast("map<string,string>"))
    values = F.split("value", "\t")
    n = F.least(F.size(values), F.lit(len(fields)))
    whole = F.map_from_arrays(F.slice(F.array(*map(F.lit, fields)), F.lit(1), n), F.slice(values, F.lit(1), n))
    return rows.withColumn("m", F.map_filter(whole, lambda k, v: v != unset))


def json_maps(lines: DataFrame) -> DataFrame:
    """The same from JSON objects: values as text, nulls left out; null where a line is none."""
    rows = lines.where((F.trim("value") != "") & ~F.startswith(F.trim("value"), F.lit("#")))
    sound = F.startswith(F.schema_of_variant(F.try_parse_json("value")), F.lit("OBJECT"))
    return rows.withColumn("m", F.when(sound, F.map_filter(F.from_json("value", "map<string,string>"), lambda k, v: v.isNotNull())))


def _set(*names: str) -> Column:
    """The first of several fields that is neither blank nor a dash."""
    tries = []
    for n in names:
        text = F.trim(F.try_element_at("m", F.lit(n)))
        tries.append(F.when((text != "") & (text != "-"), text))
    return F.coalesce(*tries)


def _or(name: str, default: str) -> Column:
    return F.coalesce(F.try_element_at("m", F.lit(name)), F.lit(default))


def _port(*names: str) -> Column:
    return F.coalesce(F.concat(F.lit(":"), _set(*names)), F.lit(""))


def convert_zeek(maps: DataFrame, kind: str = "notice", allowed: list[str] = ()) -> DataFrame:
    """``maps`` with outcome and an alert struct; an empty ``allowed`` lets every note or name pass."""
    names = [a.strip().lower() for a in allowed if a.strip()]
    field, default = {"notice": ("note", "Notice::Unknown"), "weird": ("name", "unknown_weird")}[kind]
    raw = F.trim(F.try_element_at("m", F.lit(field)))
    name = F.when(raw != "", raw).otherwise(F.lit(default))
    if kind == "notice":
        src, dst = F.coalesce(_set("src", "id.orig_h"), F.lit("unknown")), F.coalesce(_set("dst", "id.resp_h"), F.lit("-"))
        msg = F.try_element_at("m", F.lit("msg"))
        text = F.concat(F.when(msg != "", msg).otherwise("Zeek notice"), F.lit(" | note="), name, F.lit(" "), _or("proto", "-"), F.lit(" "), src, _port("id.orig_p"), F.lit(" -> "), dst, _port("p", "id.resp_p"), F.lit(" sub="), _or("sub", "-"), F.lit(" n="), _or("n", "-"))
        severity = notice_severity(name)
    else:
        src, dst = F.coalesce(_set("id.orig_h", "src"), F.lit("unknown")), F.coalesce(_set("id.resp_h", "dst"), F.lit("-"))
        text = F.concat(F.lit("weird name="), name, F.lit(" "), src, _port("id.orig_p"), F.lit(" -> "), dst, _port("id.resp_p"), F.lit(" addl="), _or("addl", "-"), F.lit(" source="), _or("source", "-"), F.lit(" notice="), _or("notice", "F"))
        severity = weird_severity(name)
    alert = F.struct(zeek_millis(_or("ts", "")).alias("ts_unix_ms"), F.concat(F.lit(f"zeek:{kind}:"), name).alias("rule"), severity.alias("severity"), src.alias("src"), truncated(text, DETAIL).alias("detail"))
    passes = F.lower(name).isin(names) if names else F.lit(True)
    outcome = F.when(F.col("m").isNull(), "error").when(passes, "kept").otherwise("skipped")
    rows = maps.withColumn("outcome", outcome)
    return rows.withColumn("alert", F.when(F.col("outcome") == "kept", alert)).drop("m")


def import_zeek(spark, path: str, kind: str = "notice", allowed: list[str] = ()) -> DataFrame:
    lines = spark.read.text(path)
    maps = json_maps(lines) if sniff(lines) == "jsonl" else tsv_maps(lines, *header(lines))
    return kept_alerts(convert_zeek(maps, kind, allowed))
