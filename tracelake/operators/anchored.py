"""Anchored windows: per key, a window opens at its first event and closes when an event lies beyond it.

All stateful rules reduce to them.  Rows are dealt by key, sorted by time, and folded a batch at a time;
the fold jumps from window to window by binary search, and its memory is one open window's counters and
distinct values, whatever the number of rows of a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.operators.ordered import checked_broadcast
from tracelake.operators.segments import EVERY, FIRST, REARM, anchored_in_segments

#: Rows of a group from which it is cut into segments.
HOT_ROWS = 1_000_000
FOREVER = (1 << 62) - 1


@dataclass
class Window:
    """What is known of a key's open window."""

    first: int | None = None
    count: int = 0
    values: set = field(default_factory=set)
    opening: object = None
    fired: bool = False


def advance(state: Window, ts: np.ndarray, values: list, ends: np.ndarray, window: int, least: int, least_unique: int, mode: int):
    """Fold a key's next events (sorted) into ``state``; yields (event, count, unique, opening value).

    An event fires while its window holds at least ``least`` events and ``least_unique`` distinct values.
    FIRST fires once a window, EVERY at each such event, REARM once and closes the window.  Only events
    with ``ends`` fire: several rows of one packet count before it is judged.  Null values are no value.
    """
    i, n = 0, len(ts)
    while i < n:
        if state.first is None or ts[i] - state.first > window or ts[i] < state.first:
            state.first, state.count, state.fired, state.opening = int(ts[i]), 0, False, values[i]
            state.values.clear()
        j = i + int(np.searchsorted(ts[i:], state.first + window, "right"))
        if state.fired and mode == FIRST:
            i = j
            continue
        stop = j
        if not least_unique and mode != EVERY:  # jump to the event that completes the count
            at = i + max(1, least - state.count) - 1
            while at < j and not ends[at]:
                at += 1
            if at < j:
                state.count += at - i + 1
                state.fired = True
                yield at, state.count, 0, state.opening
                stop = at + 1
            else:
                state.count += j - i
        else:
            for at in range(i, j):
                state.count += 1
                if least_unique and values[at] is not None:
                    state.values.add(values[at])
                if ends[at] and state.count >= least and len(state.values) >= least_unique:
                    state.fired = True
                    yield at, state.count, len(state.values), state.opening
                    if mode != EVERY:
                        stop = at + 1
                        break
        if mode == REARM and state.fired:
            state.first = None
        if mode == FIRST and state.fired:
            stop = j
        i = stop


def anchored(rows: DataFrame, *, group: list[str], order: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows that fire, with n, uniq and opening.

    ``rows`` has ``ts`` (long), ``val`` (string), ``fires`` (boolean), ``window``, ``least``, ``least_unique`` (long) and
    ``mode`` (int); the last four are the same within a group.  ``order`` sorts the events of a group, by ``ts`` first.
    Groups of more than ``hot_rows`` rows are cut into segments and answered in many tasks, with the same rows.  There are
    as many segments as a shuffle has partitions, or more, so that none has many more than ``HOT_ROWS`` rows.
    """
    counts = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("__rows"), F.min("fires").alias("__steady"), *[F.first(c).alias(f"__{c}") for c in ("least", "least_unique", "mode")])
    able = (F.col("__mode") != REARM) | (F.col("__steady") & ((F.col("__least") <= 1) | (F.col("__least_unique") <= 0)))
    found = counts.where(F.col("__rows") > hot_rows).where(able).select(*[F.col(g).alias(f"__{g}") for g in group], "__rows")
    hot = checked_broadcast(found, "hot")
    size = hot.agg(F.sum("__rows")).first()[0] or 0
    if not size:
        return folded(rows, group=group, order=order)
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group])
    cold = folded(rows.join(hot, same, "left_anti"), group=group, order=order)
    many = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // HOT_ROWS)
    return cold.unionByName(anchored_in_segments(rows.join(hot, same, "left_semi"), group=group, order=order, segments=max(2, min(many, size // hot_rows))))


def folded(rows: DataFrame, *, group: list[str], order: list[str]) -> DataFrame:
    """``anchored`` by a fold, a group a task."""
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("n", T.LongType()), T.StructField("uniq", T.LongType()), T.StructField("opening", T.StringType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, Window()
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {c: batch.column(c) for c in names}
            keys = list(zip(*(columns[g].to_pylist() for g in group)))
            ts, ends = columns["ts"].to_numpy(zero_copy_only=False), columns["fires"].to_numpy(zero_copy_only=False)
            values = columns["val"].to_pylist()
            limits = [columns[c].to_pylist() for c in ("window", "least", "least_unique", "mode")]
            at, counts, uniques, openings = [], [], [], []
            begin = 0
            while begin < len(keys):
                end = begin + 1
                while end < len(keys) and keys[end] == keys[begin]:
                    end += 1
                if keys[begin] != key:
                    key, state = keys[begin], Window()
                for i, n, u, o in advance(state, ts[begin:end], values[begin:end], ends[begin:end], *(x[begin] for x in limits)):
                    at.append(begin + i)
                    counts.append(n)
                    uniques.append(u)
                    openings.append(o)
                begin = end
            fired = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(fired.column(c) for c in names), pa.array(counts, pa.int64()), pa.array(uniques, pa.int64()), pa.array(openings, pa.string())], names=[*names, "n", "uniq", "opening"]
            )

    dealt = rows.repartition(*group).sortWithinPartitions(*group, *order)
    return dealt.mapInArrow(fold, schema)


def first_per_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: one grouped minimum, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    picked = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*[F.col(c) if c in key else F.col("__row").getField(c).alias(c) for c in rows.columns])
