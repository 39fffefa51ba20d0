"""Caps in the order of files, scopes of IPv6, and the order of report lines."""

import ipaddress
import json
import random

import pytest
from pyspark.sql import functions as F

from tracelake.plans.engagement import Scope, ScopeError, remaining
from tracelake.sources import eve, reports


def _line(i: int) -> str:
    kind = ("alert", "dns", "alert", "junk")[i % 4]
    return "{" if kind == "junk" else json.dumps({"event_type": kind, "src_ip": f"10.0.0.{i % 200}", "timestamp": "2024-01-01T00:00:00Z", "alert": {"signature": f"s{9999 - i}", "signature_id": i}})


def test_cap_as_a_sequential_reader_has_it(spark, tmp_path):
    files = {"b.json": range(300, 700), "a.json": range(300), "c.json": range(700, 705)}
    for name, ids in files.items():
        (tmp_path / name).write_text("\n".join(_line(i) + ("\n" if i % 50 == 0 else "") for i in ids))
    lines = [x for name in sorted(files) for x in (tmp_path / name).read_text().split("\n") if x]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        converted = eve.convert_eve(eve.read_eve(spark, str(tmp_path)))
        assert converted.rdd.getNumPartitions() > 6
        for cap in (1, 2, 77, 150, 349, 350, 351, 352, 353, 10_000):
            read = kept = skipped = errors = 0
            details, truncated = [], False
            for x in lines:
                read += 1
                kind = "junk" if x == "{" else json.loads(x)["event_type"]
                if kind == "alert":
                    if kept == cap:
                        truncated = True
                        break
                    kept += 1
                    details.append(json.loads(x)["alert"]["signature"])
                skipped, errors = skipped + (kind == "dns"), errors + (kind == "junk")
            assert tuple(eve.import_counters(converted, cap).first()) == (read, kept, skipped, errors, truncated), cap
            got = eve.import_eve(spark, str(tmp_path), max_alerts=cap)
            assert [r.detail.split(" |")[0] for r in got.collect()] == details or not truncated and got.count() == kept, cap
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(ValueError):
        eve.import_eve(spark, str(tmp_path), max_alerts=0)


def test_scope_of_ipv6_with_large_exclusions(spark):
    make = lambda targets, exclude: Scope("t", "o", authorized=True, targets=tuple(targets), exclude=tuple(exclude), max_hosts=10)
    hosts = lambda s: [r.host for r in s.hosts(spark).collect()]
    left = ipaddress.ip_network("2001:db8::ffff:ffff:ffff:fff0/126")
    rest = [str(n) for n in remaining(ipaddress.ip_network("2001:db8::/64"), [left])]  # all of 2 ** 64 hosts but four
    assert hosts(make(["2001:db8::/64"], rest)) == [str(a) for a in left]
    assert hosts(make(["2001:db8::/126", "10.0.0.0/30"], ["10.0.0.1"])) == ["10.0.0.2", "2001:db8::1", "2001:db8::2", "2001:db8::3"]
    assert hosts(make(["2001:db8::4/127", "2001:db8::4/128"], ["2001:db8::5"])) == ["2001:db8::4"]
    with pytest.raises(ScopeError):
        make(["2001:db8::/64"], ["2001:db8::/63"]).hosts(spark)
    with pytest.raises(ValueError):
        make(["2001:db8::/64"], ["2001:db8::/65"]).hosts(spark)
    whole = ipaddress.ip_network("2001:db8::/120")
    gone = [ipaddress.ip_network(x) for x in ("2001:db8::10/124", "2001:db8::18/125", "2001:db8::80/121", "::/0")]
    assert {a for n in remaining(whole, gone[:3]) for a in n} == {a for a in whole if not any(a in g for g in gone[:3])} and remaining(whole, gone) == []


def test_ranges_of_both_versions(spark):
    from tracelake.operators.lookup import address_prefixes, in_address_ranges, network_ranges

    r = random.Random(6)
    ends = [(a, a + r.randrange(3 ** r.randrange(1, 40))) for a in (r.randrange(2**100) << r.randrange(28) for _ in range(40))]
    ranges = [(str(ipaddress.IPv6Address(a)), str(ipaddress.IPv6Address(min(b, 2**128 - 1)))) for a, b in ends]
    ranges += [("10.0.0.7", "10.0.3.200"), ("0.0.0.0", "0.0.0.0"), ("255.255.255.250", "255.255.255.255"), ("::", "::3"), ("10.9.0.5", "10.9.0.1"), ("10.0.0.0", "::1"), ("x", "y"), (None, "::5")]
    sound = [(ipaddress.ip_address(a), ipaddress.ip_address(b)) for a, b in ranges[:44]]
    near = [x for a, b in sound for e in (a, b) for x in (e, *(type(e)(int(e) + k) for k in (-1, 1) if 0 <= int(e) + k < 2 ** e.max_prefixlen))]
    texts = [str(x) for x in near] + [x.exploded.upper() for x in near if x.version == 6][:30] + ["", "none", "10.0.1", None, "0000:0::2"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, address string")
    table = spark.createDataFrame(ranges, "low string, high string")

    def inside(text):
        try:
            x = ipaddress.ip_address(text)
        except ValueError:
            return False
        return any(x.version == a.version and a <= x <= b for a, b in sound)

    want = {i for i, t in enumerate(texts) if inside(t)}
    assert {x.id for x in in_address_ranges(rows, "address", table).collect()} == want and 40 < len(want) < len(texts)
    assert {x.id for x in in_address_ranges(rows, "address", table, "left_anti").collect()} == set(range(len(texts))) - want
    assert in_address_ranges(rows, "address", table.limit(0)).count() == 0 and in_address_ranges(rows, "address", table.limit(0), "left_anti").count() == len(texts)
    assert address_prefixes(table).groupBy("size").count().count() <= 162
    nets = network_ranges(spark, ["10.0.0.0/30", "2001:db8::/127"]).collect()
    assert [tuple(n) for n in nets] == [("10.0.0.0/30", "10.0.0.0", "10.0.0.3"), ("2001:db8::/127", "2001:db8::", "2001:db8::1")]


def test_report_lines_in_order(spark):
    rows = spark.createDataFrame([(30, "z"), (4, "b"), (100, "a"), (4, "a")], "ts long, detail string")
    header = spark.createDataFrame([("m",)], "module string")
    told = [json.loads(r.value) for r in reports.report_lines(header, rows, "alert").collect()]
    assert told[0] == {"module": "m"} and [(x["alert"]["ts"], x["alert"]["detail"]) for x in told[1:]] == [(4, "a"), (4, "b"), (30, "z"), (100, "a")]
    hidden = reports.report_lines(header, rows.withColumn("place", -F.col("ts")), "alert", ["place", "detail"], hidden=["place"]).collect()
    assert [json.loads(r.value)["alert"] for r in hidden[1:]] == [{"ts": 100, "detail": "a"}, {"ts": 30, "detail": "z"}, {"ts": 4, "detail": "a"}, {"ts": 4, "detail": "b"}]
