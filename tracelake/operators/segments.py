"""Anchored windows of keys with very many events, in parallel and equal to the fold.

A window opens at an event, and the next one at the first event after it that has a certain rank (REARM: after the
event that fired) or lies beyond its time, whichever comes first: a pair of bounds, and both only grow with the
opening.  So a key's events are cut into segments, and each segment tells, in steps, with which bounds it is left
for every event at which it may be entered.  One walk over a key's segments, through these steps alone, finds how
each is really entered; then all segments find their openings, and what fires, by themselves.

Distinct values need no set that grows: a window of FIRST or REARM ends at a given number of them, so of what
follows a segment only the first so many distinct values matter, which are put together from the segments' heads.
In EVERY an event is new in its window if its value occurred last before the window's opening; counts are running
sums of that.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.ordered import checked_broadcast, placed, range_of, ranged, with_previous
from tracelake.sources.folders import written

FIRST, EVERY, REARM = 0, 1, 2
NEVER = 1 << 62


def boundless(window: int) -> bool:
    return window >= NEVER - 1


def reached(values: np.ndarray, ranks: np.ndarray, least: int, after: list[tuple[object, int]]) -> np.ndarray:
    """For each event the rank at which ``least`` distinct values have come since it, it included; NEVER if none.

    ``values`` has -1 for none; ``after`` are the first distinct values behind the segment with their ranks.
    """
    out = np.full(len(values), NEVER, np.int64)
    nearest: OrderedDict = OrderedDict()  # by first occurrence, the nearest last
    for value, rank in reversed(after[:least]):
        nearest[value] = rank
    for i in range(len(values) - 1, -1, -1):
        if values[i] is not None:
            nearest[values[i]] = ranks[i]
            nearest.move_to_end(values[i])
            if len(nearest) > least:
                nearest.popitem(last=False)
        if len(nearest) == least:
            out[i] = next(iter(nearest.values()))
    return out


def following(ts: np.ndarray, fires_at: np.ndarray, first: int, window: int, mode: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(next opening in the segment, or its length; rank and time bound of the next opening) of a window opened at each event.

    ``first`` is the rank of the segment's first event.
    """
    late = np.full(len(ts), NEVER, np.int64) if boundless(window) else ts + window
    rank = np.where(fires_at < NEVER, fires_at + 1, NEVER) if mode == REARM else np.full(len(ts), NEVER, np.int64)
    nearest = np.searchsorted(ts, late, "right")
    return np.minimum(nearest, np.clip(rank - first, 0, len(ts))), rank, late


def last_opening(nexts: np.ndarray) -> np.ndarray:
    """The last opening in the segment of the chain that begins at each event: doubled jumps."""
    jump = np.where(nexts < len(nexts), nexts, np.arange(len(nexts)))
    while True:
        twice = jump[jump]
        if np.array_equal(twice, jump):
            return jump
        jump = twice


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole segments, a group's rows in one range each, of rows sorted by range, group and place."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, groups = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__segment", "__g"))
        cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]) | (groups[1:] != groups[:-1])) + 1).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:]):
            if held and (ids[a], groups[a]) != key:
                yield pa.Table.from_batches(held)
                held = []
            key = ids[a], groups[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _read(segment: pa.Table) -> tuple[dict, np.ndarray, np.ndarray, list, int]:
    limits = {c: segment.column(c)[0].as_py() for c in ("__g", "__segment", "window", "least", "least_unique", "mode")}
    ts, ranks = (segment.column(c).to_numpy() for c in ("ts", "place"))
    return limits, ts, ranks, segment.column("val").to_pylist(), int(ranks[0])


def _firing(limits: dict, ranks: np.ndarray, values: list, after: list) -> np.ndarray:
    """Rank of the event that fires for a window opened at each event, whatever the time."""
    if limits["least_unique"] > 0 and limits["mode"] != EVERY:
        return reached(values, ranks, limits["least_unique"], after)
    return ranks + max(1, limits["least"]) - 1


_BY = "__g long, __segment long"
_HEAD = f"{_BY}, value string, rank long, least int"
_AFTER = f"{_BY}, after array<struct<value:string,rank:long>>"
_STEP = f"{_BY}, entry long, entry_ts long, rank long, late long, opened long, opening string"
_ENTRY = f"{_BY}, rank long, late long, opened long, opening string"
_FIRED = "__g long, place long, deadline long, n long, uniq long, opening string"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first distinct values of each segment, as many as its rule asks for."""
    for segment in _segments(batches):
        limits, _, ranks, values, _ = _read(segment)
        if limits["least_unique"] <= 0 or limits["mode"] == EVERY:
            continue
        codes, names = pd.factorize(np.array(values, object))
        _, at = np.unique(codes, return_index=True)
        at = np.sort(at[codes[at] >= 0])[: limits["least_unique"]]
        if at.size:
            yield _batch([(limits["__g"], limits["__segment"], values[i], int(ranks[i]), limits["least_unique"]) for i in at.tolist()], _HEAD)


def _afters(heads: pd.DataFrame) -> pd.DataFrame:
    """For each segment of a group, the first distinct values of all that follows it."""
    out, known = [], []
    for segment, own in sorted(heads.groupby("__segment"), reverse=True, key=lambda x: x[0]):
        out.append((heads["__g"].iloc[0], segment, [{"value": v, "rank": r} for v, r in known]))
        mine = list(zip(own.sort_values("rank")["value"], own.sort_values("rank")["rank"]))
        seen = {v for v, _ in mine}
        known = (mine + [x for x in known if x[0] not in seen])[: int(own["least"].iloc[0])]
    return pd.DataFrame(out, columns=["__g", "__segment", "after"])


def _after(segment: pa.Table) -> list[tuple]:
    return [(x["value"], x["rank"]) for x in segment.column("after")[0].as_py() or []]


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How each segment is left: a row for a run of entries whose chains have one last opening.

    A segment is entered no later than the chain of its first event opens again.
    """
    for segment in _segments(batches):
        limits, ts, ranks, values, first = _read(segment)
        nexts, rank, late = following(ts, _firing(limits, ranks, values, _after(segment)), first, limits["window"], limits["mode"])
        last = last_opening(nexts)[: int(nexts[0]) + 1]
        ends = np.flatnonzero(np.append(last[1:] != last[:-1], True))
        if boundless(limits["window"]) and limits["mode"] != REARM:
            ends = np.zeros(1, np.int64)  # it opens once, at the group's first event
        for a in range(0, len(ends), 10_000):
            part = ends[a : a + 10_000]
            rows = [(limits["__g"], limits["__segment"], int(ranks[i]), int(ts[i]), int(rank[j]), int(late[j]), int(ranks[j]), values[j]) for i, j in zip(part.tolist(), last[part].tolist())]
            yield _batch(rows, _STEP)


def _walk(steps: pd.DataFrame) -> pd.DataFrame:
    """With which bounds each segment of a group is entered, and the window that is open there."""
    out, rank, late, opened, opening = [], 0, -NEVER, -1, None
    for segment, own in sorted(steps.groupby("__segment"), key=lambda x: x[0]):
        own = own.sort_values("entry")
        out.append((own["__g"].iloc[0], segment, rank, late, opened, opening))
        j = min(int(np.searchsorted(own["entry"].to_numpy(), rank)), int(np.searchsorted(own["entry_ts"].to_numpy(), late, "right")))
        if j < len(own):
            found = own.iloc[j]
            rank, late, opened, opening = int(found["rank"]), int(found["late"]), int(found["opened"]), found["opening"]
    return pd.DataFrame(out, columns=[c.split()[0] for c in _ENTRY.split(", ")])


def _fired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What fires for the windows opened in each segment; in EVERY, the events of the segment that fire."""
    for segment in _segments(batches):
        limits, ts, ranks, values, first = _read(segment)
        fires_at = _firing(limits, ranks, values, _after(segment))
        nexts, _, late = following(ts, fires_at, first, limits["window"], limits["mode"])
        entry = {c: segment.column(f"in_{c}")[0].as_py() for c in ("rank", "late", "opened", "opening")}
        at = min(max(0, entry["rank"] - first), int(np.searchsorted(ts, entry["late"], "right")), len(ts))
        opens, chain = at, []
        while opens < len(ts):
            chain.append(opens)
            opens = int(nexts[opens])
        g = limits["__g"]
        if limits["mode"] == EVERY:
            bounds = [*([(0, at, entry["opened"], entry["opening"])] if entry["opened"] >= 0 else []), *((a, b, first + a, values[a]) for a, b in zip(chain, [*chain[1:], len(ts)]))]
            size = np.array([b - a for a, b, _, _ in bounds], np.int64)
            place = first + np.concatenate([np.arange(a, b) for a, b, _, _ in bounds] or [np.zeros(0, np.int64)])
            n = place - np.repeat(np.array([opened for _, _, opened, _ in bounds], np.int64), size) + 1
            opening = pa.array([x for *_, x in bounds], pa.string()).take(pa.array(np.repeat(np.arange(len(bounds)), size)))
            until, unique = np.full(len(place), NEVER, np.int64), np.zeros(len(place), np.int64)
        else:
            fires = np.array([i for i in chain if fires_at[i] < NEVER], np.int64)
            place, until = fires_at[fires], late[fires]
            n, unique = place - first - fires + 1, np.full(len(fires), max(0, limits["least_unique"]), np.int64)
            opening = pa.array([values[i] for i in fires.tolist()], pa.string())
        arrays = [pa.array(np.full(len(place), g, np.int64)), *(pa.array(x.astype(np.int64)) for x in (place, until, n, unique)), opening]
        fired = pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _FIRED.split(", ")])
        for a in range(0, fired.num_rows, 10_000):
            yield fired.slice(a, 10_000)


def _distinct(events: DataFrame, fired: DataFrame) -> DataFrame:
    """``fired`` (__g, place, n, ...) with uniq: how many distinct values its window has had.

    An event counts if its value occurred last before the window's opening; segments' sums are added up.
    """
    seen = events.where("val is not null").select("__g", "val", "place", F.struct("__g", "val", "place").alias("me"))
    before = with_previous(ranged(seen, ["__g", "val", "place"]), "me", "p")
    last = before.select("__g", "place", F.when((F.col("p.__g") == F.col("__g")) & (F.col("p.val") == F.col("val")), F.col("p.place")).alias("last"), F.lit(1).alias("valued"))
    opened = fired.drop("uniq").withColumn("opened", F.col("place") - F.col("n") + 1).join(last, ["__g", "place"], "left")
    new = F.when(F.col("valued").isNull(), 0).when(F.col("last").isNull() | (F.col("last") < F.col("opened")), 1).otherwise(0)
    flagged = written(opened.withColumn("new", new).drop("last", "valued"), "flagged")
    parts = flagged.groupBy("__g", "opened", "__segment").agg(F.sum("new").alias("s"))
    earlier = Window.partitionBy("__g", "opened").orderBy("__segment").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__g", "opened", "__segment", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("carried"))
    inside = F.sum("new").over(Window.partitionBy("__g", "opened", "__segment").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return flagged.withColumn("inside", inside).join(parts, ["__g", "opened", "__segment"]).withColumn("uniq", F.col("inside") + F.col("carried")).drop("inside", "carried", "new")


def anchored_in_segments(rows: DataFrame, *, group: list[str], order: list[str], segments: int) -> DataFrame:
    """As ``anchored.anchored``, for groups with very many rows each, in ``segments`` ranges of rows.

    ``ts`` must not fall along ``order``.  A REARM rule may ask for a number of events or of distinct values, not for
    both, and all its rows have to fire.
    """
    names = rows.columns
    keyed = rows.withColumn("__g", F.xxhash64(F.to_json(F.struct(*group))))
    # FIRST rules whose firing event depends on more than one number take the first of what EVERY would give
    both = (F.col("mode") == FIRST) & (F.col("least_unique") > 0) & ((F.col("least") > 1) | ~F.col("steady"))
    both |= (F.col("mode") == FIRST) & (F.col("least_unique") <= 0) & ~F.col("steady")
    steady = keyed.groupBy("__g").agg(F.min("fires").alias("steady"))
    keyed = keyed.join(checked_broadcast(steady, "steady"), "__g").withColumn("__once", both).withColumn("__mode", F.when(both, EVERY).otherwise(F.col("mode"))).drop("steady")
    events = written(placed(ranged(keyed, ["__g", *order], segments), ["__g"]).withColumn("__segment", range_of()), "events")
    narrow = events.select("__g", "__segment", "place", "ts", "val", "window", "least", "least_unique", F.col("__mode").alias("mode"))
    dealt = lambda df: df.repartition(segments, "__segment", "__g").sortWithinPartitions("__segment", "__g", "place")
    heads = dealt(narrow.where(f"least_unique > 0 and mode <> {EVERY}")).mapInArrow(_heads, _HEAD)
    after = written(heads.groupBy("__g").applyInPandas(_afters, _AFTER), "after")
    known = narrow.join(after, ["__g", "__segment"], "left")
    entries = dealt(known).mapInArrow(_steps, _STEP).groupBy("__g").applyInPandas(_walk, _ENTRY)
    named = written(entries.select("__g", "__segment", *[F.col(c).alias(f"in_{c}") for c in ("rank", "late", "opened", "opening")]), "entries")
    fired = written(dealt(known.join(named, ["__g", "__segment"])).mapInArrow(_fired, _FIRED), "fired")
    found = events.join(fired, ["__g", "place"]).where("ts <= deadline").withColumn("opened", F.col("place") - F.col("n") + 1)
    plain = found.where(f"__mode <> {EVERY} or least_unique <= 0")
    counted = _distinct(events.where(f"__mode = {EVERY} and least_unique > 0"), found.where(f"__mode = {EVERY} and least_unique > 0"))
    both_ways = plain.select(*names, "n", "uniq", "opening", "__g", "place", "opened", "__once").unionByName(counted.select(*names, "n", "uniq", "opening", "__g", "place", "opened", "__once"))
    judged = both_ways.where("fires and n >= least and uniq >= least_unique")
    firsts = judged.where("__once").groupBy("__g", "opened").agg(F.min("place").alias("place"))
    once = judged.where("__once").join(firsts, ["__g", "opened", "place"])
    return judged.where("not __once").select(*names, "n", "uniq", "opening").unionByName(once.select(*names, "n", "uniq", "opening"))
