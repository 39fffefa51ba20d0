"""Merging, slicing and limiting captures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators.ordered import placed, ranged

MERGE_ORDER = ["ts_secs", "ts_usecs", "file_ord", "frame_no"]


def concatenate(captures: list[DataFrame]) -> DataFrame:
    """All frames, with file_ord from the place of a capture in the list."""
    out = None
    for i, c in enumerate(captures):
        c = c.withColumn("file_ord", F.lit(i))
        out = c if out is None else out.unionByName(c)
    if out is None:
        raise ValueError("no captures")
    return out


def merge_captures(captures: list[DataFrame]) -> DataFrame:
    """Chronological: equal times keep the order of the captures, then of their frames (a range sort)."""
    if len(captures) < 2:
        raise ValueError("merging needs two captures or more")
    return concatenate(captures).orderBy(*MERGE_ORDER)


def merge_places(captures: list[DataFrame]) -> DataFrame:
    """The frames of ``merge_captures`` with ``place``, from 1, in the merged capture; no range of time is one task's alone."""
    if len(captures) < 2:
        raise ValueError("merging needs two captures or more")
    return placed(ranged(concatenate(captures), MERGE_ORDER)).drop("__row").withColumn("place", F.col("place") + 1)


def slice_capture(frames: DataFrame, after: int | None = None, before: int | None = None) -> DataFrame:
    """Frames with after <= whole seconds < before."""
    if after is None and before is None:
        raise ValueError("give after, before or both")
    if after is not None and before is not None and after >= before:
        raise ValueError("after must lie before before")
    out = frames
    if after is not None:
        out = out.where(F.col("ts_secs") >= after)
    return out if before is None else out.where(F.col("ts_secs") < before)


def first_frames(packets: DataFrame, n: int) -> DataFrame:
    return packets.orderBy("file_ord", "frame_no").limit(n)
