"""Times, severities, truncation and escaping as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def truncated(text: Column, most: int) -> Column:
    """Cut after ``most`` characters, with an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def utc_text(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def rfc3339(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


_EVE = r"^\s*(\d{1,4})-(\d{1,2})-(\d{1,2})[T ](\d{1,2}):(\d{1,2}):(\d{1,2})[^.+\-Zz]*(?:\.(\d*)[^+\-Zz]*)?([Zz]|[+-]\d{2}:\d{2}|[+-]\d{4}|[+-]\d{2})\s*$"


def with_eve_millis(rows: DataFrame, text: str, out: str) -> DataFrame:
    """``rows`` with epoch ms of ``2017-04-07T22:24:37.251547+0100`` and its kin; 0 without a valid time and zone.

    Step by step, so that each part is computed once and the generated code stays small.
    """
    c, names = F.col, rows.columns
    part = lambda i: F.get("__p", F.lit(i - 1))
    n = lambda i: c(f"__{i}")
    rows = rows.select("*", F.when(c(text).rlike(_EVE), F.split(F.regexp_replace(text, _EVE, "$1|$2|$3|$4|$5|$6|$7|$8"), r"\|")).alias("__p"))
    rows = rows.select(*names, *[part(i).cast("int").alias(f"__{i}") for i in range(1, 7)], F.rpad(F.substring(part(7), 1, 3), 3, "0").try_cast("int").alias("__ms"), F.replace(part(8), F.lit(":"), F.lit("")).alias("__z"))
    month = F.try_make_timestamp_ntz(n(1), n(2), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("date")  # null for no month
    # +hhmm as a number; Z has none
    zone = F.rpad(F.substring("__z", 2, 4), 4, "0").try_cast("int")
    shift = F.when(F.startswith("__z", F.lit("-")), -1).otherwise(1) * (F.floor(zone / 100) * 3600 + zone % 100 * 60)
    rows = rows.select(*names, "__ms", F.unix_date(month).alias("__m"), *[f"__{i}" for i in range(3, 7)], F.coalesce(shift, F.lit(0)).alias("__s"))
    valid = n(3).between(1, 31) & (n(4) <= 23) & (n(5) <= 59) & (n(6) <= 60)
    seconds = F.when(valid, (c("__m") + n(3) - 1).cast("long") * 86400 + n(4) * 3600 + n(5) * 60 + n(6) - c("__s"))
    rows = rows.select(*names, "__ms", seconds.alias("__secs"))
    return rows.select(*names, F.when(c("__secs") >= 0, c("__secs") * 1000 + F.coalesce("__ms", F.lit(0))).otherwise(F.lit(0)).cast("long").alias(out))


def zeek_millis(text: Column) -> Column:
    """Epoch ms of an epoch in seconds with a fraction; 0 where it is none."""
    f = F.trim(text).try_cast("double")
    whole = F.floor(f)
    millis = F.least(F.round((f - whole) * 1000), F.lit(999))
    return F.coalesce(F.when((f >= 0) & (f < 1e15), whole * 1000 + millis.cast("long")), F.lit(0)).cast("long")


def suricata_severity(number: Column) -> Column:
    return F.when(number == 1, "high").when(number == 3, "low").otherwise("medium")


#: Parts of notice and weird names that set a severity.
NOTICE_HIGH = ("password", "bruteforc", "port_scan", "address_scan", "scan::", "attack", "exploit", "trw::")
NOTICE_LOW = ("nxdomain", "weird", "sensitive", "content_gap")
WEIRD_MEDIUM = ("overflow", "underflow", "bad_icmp", "truncated_header", "possible_split_routing", "active_http_proxy")


def _has(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | F.lower(text).contains(p)
    return found


def notice_severity(note: Column) -> Column:
    return F.when(_has(note, NOTICE_HIGH), "high").when(_has(note, NOTICE_LOW), "low").otherwise("medium")


def weird_severity(name: Column) -> Column:
    return F.when(_has(name, WEIRD_MEDIUM), "medium").otherwise("low")


def severity_rank(severity: Column) -> Column:
    """0 high, 1 medium, 2 low, 3 any other."""
    return F.when(severity == "high", 0).when(severity == "medium", 1).when(severity == "low", 2).otherwise(3)


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_cell(text: Column) -> Column:
    """For a cell of a Markdown table."""
    return F.replace(F.regexp_replace(text, r"[\r\n]+", " "), F.lit("|"), F.lit(r"\|"))


def printable(text: Column, most: int = 200) -> Column:
    """Control characters as ``\\xNN``, at most ``most`` characters."""
    out = text
    for code in [*range(32), 127]:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\x{code:02x}"))
    return F.substring(out, 1, most)
