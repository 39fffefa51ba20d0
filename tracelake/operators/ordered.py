"""Places and neighbours in a global order, without a group or a day in one task.

Rows are dealt by ranges of their order and written once, since the bounds of ranges come from samples.  Each range
numbers its own rows; the ranges' counts and last values, a row each, are added up and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.sources.folders import written

#: Rows up to which a summary of ranges is broadcast; its size is counted first.
BROADCAST_ROWS = 400_000


def checked_broadcast(side: DataFrame, name: str) -> DataFrame:
    """``side`` written, and marked for broadcast if it has few enough rows."""
    kept = written(side, name)
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def ranged(rows: DataFrame, order: list[str | Column], ranges: int | None = None) -> DataFrame:
    """``rows`` written in ranges of ``order``, with __row: the range in its upper bits, the place in it in the lower 33.

    Rows that are equal in ``order`` are spread too, in any order among themselves.
    """
    keys = [*order, "__nth"]
    spread = rows.withColumn("__nth", F.monotonically_increasing_id())
    dealt = spread.repartitionByRange(ranges, *keys) if ranges else spread.repartitionByRange(*keys)
    return written(dealt.sortWithinPartitions(*keys).drop("__nth").withColumn("__row", F.monotonically_increasing_id()), "ranged")


def range_of() -> Column:
    return F.shiftright("__row", 33)


def placed(ranges: DataFrame, group: list[str] | None = None) -> DataFrame:
    """``ranged`` rows with ``place``, from 0, within each ``group``; the order has to begin with the group."""
    group = group or []
    counts = ranges.groupBy(*group, range_of().alias("__range")).agg(F.count(F.lit(1)).alias("n"), F.min("__row").alias("first"))
    before = F.sum("n").over(Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    shifts = checked_broadcast(counts.select(*group, "__range", (before - F.col("first")).alias("__shift")), "shifts")
    on = F.col("r.__range") == F.col("s.__range")
    for g in group:
        on &= F.col(f"r.{g}").eqNullSafe(F.col(f"s.{g}"))
    joined = ranges.withColumn("__range", range_of()).alias("r").join(shifts.alias("s"), on)
    return joined.select(*[F.col(f"r.`{c}`") for c in ranges.columns], (F.col("r.__row") + F.col("s.__shift")).alias("place"))


def with_previous(ranges: DataFrame, column: str, name: str) -> DataFrame:
    """``ranged`` rows with the ``column`` of the row before, across ranges; null for the first of all."""
    at = range_of().alias("__range")
    lasts = ranges.groupBy(at).agg(F.max_by(column, "__row").alias("last"))
    # one row a range: the last value of the range before it that has rows
    carried = checked_broadcast(lasts.select("__range", F.lag("last").over(Window.orderBy("__range")).alias("__carried")), "carried")
    inside = F.lag(F.struct(column)).over(Window.partitionBy("__range").orderBy("__row"))
    rows = ranges.withColumn("__range", range_of()).withColumn("__before", inside).join(carried, "__range")
    value = F.when(F.col("__before").isNotNull(), F.col(f"__before.{column}")).otherwise(F.col("__carried"))
    return rows.withColumn(name, value).drop("__before", "__carried", "__range")
