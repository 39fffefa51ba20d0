"""Windows of keys with very many events, in segments, against one event at a time; places and neighbours."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_detect import model
from tracelake.operators import anchored as module
from tracelake.operators import ordered
from tracelake.operators.anchored import EVERY, FIRST, FOREVER, REARM, anchored
from tracelake.operators.segments import anchored_in_segments

SCHEMA = "rule string, key string, ts long, i long, val string, fires boolean, window long, least long, least_unique long, mode int"
RULES = [
    (mode, window, least, unique, steady)
    for mode in (FIRST, EVERY, REARM) for window in (0, 7, 40, FOREVER) for least, unique in ((1, 0), (4, 0), (25, 0), (0, 2), (1, 5), (3, 2)) for steady in (True, False)
    if not (mode == REARM and (not steady or least > 1 and unique))
]


def _events(seed: int, n: int, spread: int, values: int, steady: bool):
    r = random.Random(seed)
    ts = sorted(r.randrange(spread) for _ in range(n))
    return [(t, None if r.random() < 0.1 else f"v{min(r.randrange(values), r.randrange(values))}", steady or r.random() < 0.6) for t in ts]


@pytest.mark.parametrize("segments", [1, 5])
def test_segments_equal_the_fold(spark, segments):
    rows, expected = [], []
    for number, (mode, window, least, unique, steady) in enumerate(RULES):
        events = _events(number, 60 + number % 50, (30, 200, 1000)[number % 3], (3, 12)[number % 2], steady)
        key = None if number % 11 == 0 else f"k{number}"
        rows += [(f"r{number}", key, t, i, v, f, window, least, unique, mode) for i, (t, v, f) in enumerate(events)]
        expected += [(f"r{number}", i, n, u if unique else 0, o) for i, n, u, o in model(events, window, least, unique, mode)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = anchored_in_segments(df, group=["rule", "key"], order=["ts", "i"], segments=segments).collect()
    assert sorted(map(str, ((r.rule, r.i, r.n, r.uniq, r.opening) for r in got))) == sorted(map(str, expected))


def test_hot_keys_go_in_segments_and_the_rest_is_folded(spark):
    events = [("hot", i // 3, i, f"v{i % 9}") for i in range(3000)] + [(f"k{k}", t, t, "v") for k in range(20) for t in range(10)]
    df = spark.createDataFrame([("r", k, t, i, v, True, 50, 1, 6, REARM) for k, t, i, v in events], SCHEMA)
    plain = anchored(df, group=["rule", "key"], order=["ts", "i"])
    split = anchored(df, group=["rule", "key"], order=["ts", "i"], hot_rows=500)
    assert "MapInArrow" in plain._jdf.queryExecution().toString()
    assert sorted(map(tuple, split.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    assert split.count() > 300


def test_places_and_neighbours(spark):
    r = random.Random(2)
    rows = [(r.choice([None, "a", "b"]), r.randrange(40), i) for i in range(500)]
    ranges = ordered.ranged(spark.createDataFrame(rows, "g string, x int, id long").repartition(4), ["g", "x"], 6)
    got = ordered.placed(ranges, ["g"]).collect()
    for g in (None, "a", "b"):
        of = sorted((x.place, x.x) for x in got if x.g == g)
        assert [p for p, _ in of] == list(range(len(of))) and [x for _, x in of] == sorted(x for _, x in of)
    assert sorted(x.place for x in ordered.placed(ranges).collect()) == list(range(500))
    chain = {x.id: x.before for x in ordered.with_previous(ordered.ranged(spark.createDataFrame(rows, "g string, x int, id long"), ["id"], 7), "id", "before").collect()}
    assert chain == {i: i - 1 if i else None for i in range(500)}
    assert ordered.placed(ordered.ranged(spark.createDataFrame([], "x int"), ["x"])).count() == 0


@pytest.mark.parametrize("rows,segments", [(8, 2), (500, 4), (5000, 5)])
def test_segments_follow_partitions_and_size(spark, monkeypatch, rows, segments):
    asked = []
    monkeypatch.setattr(module, "HOT_ROWS", 1000)
    monkeypatch.setattr(module, "anchored_in_segments", lambda df, *, segments, **_: asked.append(segments) or anchored_in_segments(df, segments=segments, **_))
    df = spark.range(rows).selectExpr("'r' AS rule", "'k' AS key", "id AS ts", "id AS i", "'v' AS val", "true AS fires", "50L AS window", "3L AS least", "0L AS least_unique", f"{REARM} AS mode")
    assert anchored(df, group=["rule", "key"], order=["ts", "i"], hot_rows=3).count() == rows // 3
    assert asked == [segments]  # not a segment for each three rows
