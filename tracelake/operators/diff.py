"""Comparing two alert sets as multisets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.schema import ALERT_COLUMNS

KEYS = {"full": ("rule", "src", "detail"), "rule_src": ("rule", "src"), "rule": ("rule",)}


def fingerprint(mode: str = "full") -> Column:
    if mode not in KEYS:
        raise ValueError(f"the key mode is one of {', '.join(KEYS)}")
    return F.concat_ws("|", *KEYS[mode])


def _counted(alerts: DataFrame, mode: str, name: str) -> DataFrame:
    order = [c for c in ("ord",) if c in alerts.columns] or list(ALERT_COLUMNS)
    sample = F.min_by(F.struct(*ALERT_COLUMNS), F.struct(*order))
    return alerts.groupBy(fingerprint(mode).alias("key")).agg(F.count(F.lit(1)).alias(name), sample.alias(f"{name}_sample"))


def diff_buckets(before: DataFrame, after: DataFrame, mode: str = "full") -> DataFrame:
    """(key, before, after, unchanged, gone, new, sample) for each fingerprint; counts are occurrences.

    The sample is the first alert of its side: by column ``ord`` where there is one, else the smallest.
    """
    both = _counted(before, mode, "before").join(_counted(after, mode, "after"), "key", "full_outer")
    b, a = F.coalesce("before", F.lit(0)), F.coalesce("after", F.lit(0))
    return both.select(
        "key", b.alias("before"), a.alias("after"), F.least(b, a).alias("unchanged"), F.greatest(b - a, F.lit(0)).alias("gone"),
        F.greatest(a - b, F.lit(0)).alias("new"), F.when(b >= a, F.col("before_sample")).otherwise(F.col("after_sample")).alias("sample"),
    )


def diff_alerts(before: DataFrame, after: DataFrame, mode: str = "full") -> dict[str, DataFrame]:
    """totals (one row), only_before and only_after."""
    buckets = diff_buckets(before, after, mode)
    totals = buckets.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("before", "after", "unchanged", "gone", "new")])
    side = lambda c: buckets.where(F.col(c) > 0).select("key", F.col(c).alias("count"), "sample")
    return {"totals": totals, "only_before": side("gone"), "only_after": side("new")}


def format_diff(totals: dict, only_before: list[dict], only_after: list[dict]) -> str:
    """The difference as text; takes collected rows."""
    lines = [f"alerts: before={totals['before']} after={totals['after']} unchanged={totals['unchanged']} gone={totals['gone']} new={totals['new']}"]
    for sign, rows in (("-", only_before), ("+", only_after)):
        lines += [f"{sign} {r['count']}x {r['key']}" for r in sorted(rows, key=lambda r: r["key"])]
    return "\n".join(lines)
