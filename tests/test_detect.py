"""Rules against a sequential model, and the stream against the batch."""

import random
import time
from collections import defaultdict

import numpy as np
import pytest
import yaml

from tests import frames as f
from tests.test_decode import table
from tracelake.functions import rule_language as rl
from tracelake.operators.anchored import EVERY, FIRST, FOREVER, REARM, Window, advance, first_per_key
from tracelake.operators.detect import BUILT_IN, cooldown, detect, ordered_alerts
from tracelake.schema import ALERT, packet_view
from tracelake.sources.decode import decode


def model(events, window, least, unique, mode):
    """One event at a time."""
    first, count, seen, fired, opening, out = None, 0, set(), False, None, []
    for i, (ts, value, fires) in enumerate(events):
        if first is None or ts < first or ts - first > window:
            first, count, seen, fired, opening = ts, 0, set(), False, value
        count += 1
        if value is not None and unique:
            seen.add(value)
        if fires and count >= least and len(seen) >= unique and not (mode == FIRST and fired):
            out.append((i, count, len(seen), opening))
            fired = True
            if mode == REARM:
                first = None
    return out


def test_advance_in_any_batches():
    rng = random.Random(5)
    for _ in range(400):
        n, window = rng.randint(0, 40), rng.choice([0, 3, 10, FOREVER])
        ts = sorted(rng.randint(0, 60) for _ in range(n))
        events = [(t, rng.choice([None, "a", "b", "c", "d"]), rng.random() < 0.8) for t in ts]
        least, unique, mode = rng.randint(0, 5), rng.choice([0, 0, 1, 2, 3]), rng.choice([FIRST, EVERY, REARM])
        state, got, at = Window(), [], 0
        while at < n:
            part = events[at : at + rng.randint(1, 9)]
            t, v, e = zip(*part)
            got += [(at + i, c, u, o) for i, c, u, o in advance(state, np.array(t), list(v), np.array(e), window, least, unique, mode)]
            at += len(part)
        assert got == model(events, window, least, unique, mode), (events, window, least, unique, mode)


def alerts_of(spark, raws, cfg, t0=1_700_000_000):
    return detect(decode(table(spark, raws, t0)), cfg)


def test_built_in_rules_on_frames(spark):
    raws = [
        *f.syn_scan(20), f.eth(f.ip4(f.tcp(flags=0), 6)), f.eth(f.ip4(f.tcp(flags=0x29), 6)), f.eth(f.ip4(f.tcp(flags=1), 6)), f.eth(f.ip4(f.tcp(sport=9, dport=31337, flags=2), 6, "9.9.9.9")),
        f.eth(f.arp(2)), f.eth(f.arp(2), 0x0806), f.eth(f.arp(2, b"\xcc" * 6), 0x0806), f.eth(f.ip4(f.udp(f.dns("x" * 61 + ".org")), 17)),
    ]
    got = alerts_of(spark, raws, rl.DetectConfig(syn_scan_ports=10, window_ms=None)).collect()
    by = {a.rule: a for a in got}
    assert set(by) == {"tcp_syn_scan", "tcp_null_scan", "tcp_xmas_scan", "tcp_fin_scan", "rare_port", "arp_mac_conflict", "dns_long_name"}
    assert by["tcp_syn_scan"].detail == "SYN to 10 distinct destination ports within the input" and by["tcp_syn_scan"].src == "10.0.0.9" and by["tcp_syn_scan"].ts_unix_ms == 1_700_000_009_123
    assert by["arp_mac_conflict"].detail == "IP 10.0.0.1 claimed by MAC cc:cc:cc:cc:cc:cc (previously aa:aa:aa:aa:aa:aa)"
    assert by["rare_port"].detail == "traffic toward uncommon port 31337 (dst 10.0.0.2)" and by["tcp_xmas_scan"].detail == "stealth TCP flags [FIN,PSH,URG] toward 10.0.0.2:80"
    assert by["dns_long_name"].detail.startswith("long DNS QNAME len=65 (")
    quiet = alerts_of(spark, raws, rl.DetectConfig(syn_scan_ports=10, window_ms=None, disabled=frozenset(BUILT_IN))).count()
    assert quiet == 0


def test_cooldown(spark):
    rows = [(t, "r", "low", "s", "d") for t in (1000, 2000, 7000)] + [(1500, "r", "low", "other", "d"), (1600, "q", "low", "s", "d")]
    kept = cooldown(ordered_alerts(spark.createDataFrame(rows, ALERT)), 5000)
    assert sorted((r.ts_unix_ms, r.rule, r.src) for r in kept.collect()) == [(1000, "r", "s"), (1500, "r", "other"), (1600, "q", "s"), (7000, "r", "s")]


PACK = """
name: lab
window_secs: 20
alert_cooldown_ms: 7
thresholds: {syn_scan_ports: 8, dns_long_name: 50}
rare_ports_mode: merge
rare_ports: [42]
disabled_rules: [TLS_Legacy_Version]
custom_rules:
  - id: spray
    severity: HIGH
    once: none
    detail: "{unique} ports by {ip.src} in {window_secs}s, {tcp.dst_port} {nope} {tls.sni}"
    correlate: {window_secs: 30, track: by_src, unique_field: tcp.dst_port, unique_count: 3}
    when: {and: [{field: TCP.flags.syn, eq: true}, {field: tcp.dst_port, in: [1, 2, "3", 4, 5, 6]}]}
"""


def test_pack(spark):
    cfg = rl.apply_pack(yaml.safe_load(PACK))
    assert cfg.window_ms == 20_000 and cfg.syn_scan_ports == 8 and cfg.dns_long_name == 50 and {42, 4444} <= cfg.rare_ports and cfg.cooldown_ms == 7 and cfg.disabled == {"tls_legacy_version"}
    only = rl.DetectConfig(disabled=frozenset(BUILT_IN), custom_rules=cfg.custom_rules)
    got = alerts_of(spark, f.syn_scan(20), only).orderBy("ts_unix_ms").collect()
    assert [a.detail for a in got] == [f"3 ports by 10.0.0.9 in 30s, {p} {{nope}} -" for p in (3, 6)] and got[0].severity == "high"


@pytest.mark.parametrize("change", [
    {"id": "bad id"}, {"id": ""}, {"severity": "worst"}, {"once": "twice"}, {"when": {"and": []}}, {"when": {"field": "app"}}, {"when": {"field": "app", "eq": 1, "ne": 2}},
    {"when": {"field": "", "eq": 1}}, {"when": {"field": "ip.src", "in_cidr": ["1.2.3/8"]}}, {"correlate": {"window_secs": 0, "count": 1}}, {"correlate": {"window_secs": 1}},
    {"correlate": {"window_secs": 1, "count": 0}}, {"correlate": {"window_secs": 1, "unique_field": "app"}}, {"correlate": {"window_secs": 99999, "count": 1}}, {"correlate": {"window_secs": 1, "count": 1, "track": "up"}},
    {"when": {"or": [{"field": "app", "eq": "x"}] * 64}},
])
def test_bad_rules(spark, change):
    with pytest.raises(rl.RuleError):
        rl.compile_rule({"id": "r", "when": {"field": "app", "eq": "dns"}} | change)


def test_duplicate_ids(spark):
    rule = {"id": "r", "when": {"field": "app", "eq": "dns"}}
    with pytest.raises(rl.RuleError):
        rl.compile_rules([rule, rule | {"id": "R"}])
    with pytest.raises(rl.RuleError):
        rl.compile_rules([rule | {"id": f"r{i}"} for i in range(65)])


def test_first_per_key(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "k string, t int, v string")
    assert sorted(map(tuple, first_per_key(rows, ["k"], ["t"]).collect())) == [("a", 1, "y"), ("b", 3, "z")]


def test_stream_equals_batch(spark, sf, tmp_path):
    from tracelake.streaming.detect import detect_stream

    packets = packet_view(spark.read.parquet(f"{sf}/events.parquet")).where("frame_no < 400")
    for i in range(3):  # three files in order of time make three batches
        packets.where(f"frame_no % 400 >= {i * 134} and frame_no % 400 < {(i + 1) * 134}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    custom = rl.compile_rules([{"id": "pairs", "once": "none", "detail": "{count} {unique}", "when": {"field": "tcp.flags.syn", "eq": True}, "correlate": {"window_secs": 86400, "unique_field": "tcp.dst_port", "unique_count": 2}}])
    cfg = rl.DetectConfig(syn_scan_ports=2, host_sweep_hosts=2, dns_unique_names=2, icmp_echo_count=1, tcp_rst_count=2, dhcp_discover_count=2, dns_nxdomain_count=1, window_ms=5 * 86_400_000, custom_rules=tuple(custom))
    stream = detect_stream(spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), cfg)
    query = stream.writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    count = lambda df: sorted(map(tuple, df.collect()))
    want = count(detect(packets, cfg))
    assert count(spark.table("found")) == want and len(want) > 100 and len({r[1] for r in want}) > 8


def test_watch(spark, sf, tmp_path):
    from tracelake.streaming.detect import watch

    packets = packet_view(spark.read.parquet(f"{sf}/events.parquet")).where("frame_no < 200")
    packets.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    query = watch(spark.readStream.schema(packets.schema).parquet(str(tmp_path / "in")), seen.append, checkpoint=str(tmp_path / "ck"), availableNow=True)
    query.awaitTermination(120)
    assert seen[0]["traffic"]["packets"] == packets.count() and seen[0]["recent"] and defaultdict(int, {r["key"]: r["count"] for r in seen[0]["by_rule"]})["rare_port"] > 0


@pytest.mark.parametrize("limits", [False, True])
def test_watch_carries_over(spark, sf, tmp_path, limits):
    from tracelake.operators.stats import alerts_by, traffic_stats
    from tracelake.streaming.detect import watch

    packets = packet_view(spark.read.parquet(f"{sf}/events.parquet")).where("frame_no < 400")
    rule = {"id": "pairs", "once": "per_src" if limits else "none", "when": {"field": "tcp.flags.syn", "eq": True}, "correlate": {"window_secs": 86400, "unique_field": "tcp.dst_port", "unique_count": 2}}
    cfg = rl.DetectConfig(syn_scan_ports=2, host_sweep_hosts=2, dns_unique_names=2, tcp_rst_count=2, dhcp_discover_count=2, window_ms=5 * 86_400_000, cooldown_ms=86_400_000 if limits else 0, custom_rules=tuple(rl.compile_rules([rule])))
    seen, source = [], spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", 1).parquet
    (tmp_path / "in").mkdir()
    for parts in ((0, 1), (2,)):  # two batches, and a third after a restart
        for i in parts:
            packets.where(f"frame_no >= {i * 134} and frame_no < {(i + 1) * 134}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = watch(source(str(tmp_path / "in")), seen.append, cfg, checkpoint=str(tmp_path / "ck"), availableNow=True)
        query.awaitTermination(240)
        assert query.exception() is None
    want = detect(packets, cfg)
    assert [s["batch"] for s in seen] == [0, 1, 2] and seen[-1]["traffic"] == traffic_stats(packets).first().asDict()
    assert seen[-1]["by_severity"] == [r.asDict() for r in alerts_by(want, "severity").collect()]
    assert seen[-1]["by_rule"] == [r.asDict() for r in alerts_by(want, "rule", 8).collect()]


def test_frequent_keys_within_their_error():
    from tracelake.streaming.detect import Frequent

    rng = random.Random(4)
    for size in (1, 3, 10, 1000):
        keys = [min(int(rng.expovariate(0.2)), 60) for _ in range(3000)]
        parts, whole = [Frequent(size=size) for _ in range(4)], Frequent(size=size)
        for i, k in enumerate(keys):
            parts[i % 4].add({k: 1})
        for p in parts:
            whole.add(p.counts, p.error)
        assert len(whole.counts) <= size and (whole.error == 0) == (size > 60)
        assert all(0 <= keys.count(k) - whole.counts.get(k, 0) <= whole.error for k in set(keys))


@pytest.mark.parametrize("size", [1024, 6])
def test_watch_tells_frequent_keys(spark, sf, tmp_path, size):
    from tracelake.operators.stats import top_addresses, top_ports
    from tracelake.streaming.detect import watch

    packets = packet_view(spark.read.parquet(f"{sf}/events.parquet")).where("frame_no < 400")
    for i in range(3):
        packets.where(f"frame_no >= {i * 134} and frame_no < {(i + 1) * 134}").coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
    seen, beats = [], []
    cfg = rl.DetectConfig(disabled=frozenset(BUILT_IN) - {"rare_port"})
    stream = spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    query = watch(stream, seen.append, cfg, checkpoint=str(tmp_path / "ck"), heartbeat=lambda: beats.append(1), summary_keys=size, availableNow=True)
    query.awaitTermination(240)
    assert query.exception() is None and len(beats) == len(seen) >= 2 and all(s["pps"] > 0 for s in seen)
    ports, sources = ({r["key"]: r["count"] for r in top.collect()} for top in (top_ports(packets, limit=None), top_addresses(packets, limit=None)))
    for name, of in (("ports", ports), ("sources", sources)):
        told, error = seen[-1][f"top_{name}"], seen[-1]["top_error"][name]
        assert all(0 <= of[r["key"]] - r["count"] <= error for r in told) and (error == 0) == (len(of) <= size)
    if size > len(ports):
        assert seen[-1]["top_ports"] == [r.asDict() for r in top_ports(packets).collect()]
        assert seen[-1]["top_sources"] == [r.asDict() for r in top_addresses(packets).collect()]


def test_capture_stream(spark, tmp_path):
    from tracelake.sources.captures import register, write_capture

    register(spark)
    folder = tmp_path / "caps"
    write_capture(table(spark, f.syn_scan(5)), str(folder), single=True)
    query = spark.readStream.format("capture").load(str(folder)).writeStream.format("memory").queryName("caps").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    (early,) = folder.glob("*.pcap")
    early.with_name("a-" + early.name).write_bytes(early.read_bytes())  # a file whose name comes before what was read
    query.processAllAvailable()
    query.stop()
    assert spark.table("caps").count() == 10


def test_no_rule(spark, sf):
    from tracelake.streaming.detect import detect_stream

    packets, none = packet_view(spark.read.parquet(f"{sf}/events.parquet")), rl.DetectConfig(disabled=frozenset(BUILT_IN))
    assert detect(packets, none).count() == 0
    with pytest.raises(ValueError):
        detect_stream(packets, none)


def test_state_expires(spark, sf, tmp_path):
    from tracelake.streaming.detect import detect_stream

    packets = packet_view(spark.read.parquet(f"{sf}/events.parquet")).where("frame_no < 100")
    packets.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = detect_stream(spark.readStream.schema(packets.schema).parquet(str(tmp_path / "in")), state_ttl_ms=3_600_000)
    query = stream.writeStream.format("memory").queryName("brief").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None and sorted(map(tuple, spark.table("brief").collect())) == sorted(map(tuple, detect(packets).collect()))


@pytest.mark.parametrize("limits", [False, True])
def test_event_time(spark, sf, tmp_path, limits):
    """Packets out of order over batches give the alerts of the batch; late ones are counted and left out."""
    from pyspark.sql import functions as F

    from tracelake.streaming.detect import LateRows, detect_stream

    packets = packet_view(spark.read.parquet(f"{sf}/events.parquet")).where("frame_no < 400").cache()
    first, last = packets.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    cut = [first + (last - first) * i // 4 for i in range(5)]
    ages = (last - first) // 4  # a quarter: what comes a batch late is within it
    part = F.when(F.col("ts_ms") < cut[1], 0).when(F.col("ts_ms") < cut[2], 1).when(F.col("ts_ms") < cut[3], 2).otherwise(3)
    swapped = F.when((part < 3) & (F.col("frame_no") % 5 == 0) & (F.col("ts_ms") >= F.lit(cut[0]) + (part + 0.5) * ages), part + 1).otherwise(part)
    harmless = packets.where("tkind = 'icmp' and icmp.type = 0").orderBy("frame_no").limit(1)  # an answer to an echo: no rule asks for it
    flush = harmless.withColumn("ts_ms", F.lit(last + 90 * 86_400_000))
    late = packets.where("app = 'http' or tcp.flags.syn").withColumn("ts_ms", F.lit(first))
    for i in range(4):
        packets.where(swapped == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for more in (flush, late, flush.withColumn("ts_ms", F.col("ts_ms") + 1)):
        more.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rule = {"id": "pairs", "once": "per_src" if limits else "none", "detail": "{count} {unique}", "when": {"field": "tcp.flags.syn", "eq": True}, "correlate": {"window_secs": 86400, "unique_field": "tcp.dst_port", "unique_count": 2}}
    cfg = rl.DetectConfig(syn_scan_ports=2, host_sweep_hosts=2, dns_unique_names=2, icmp_echo_count=1, tcp_rst_count=2, dhcp_discover_count=2, dns_nxdomain_count=1, window_ms=5 * 86_400_000, cooldown_ms=86_400_000 if limits else 0, custom_rules=tuple(rl.compile_rules([rule])))
    missed = LateRows()
    spark.streams.addListener(missed)
    name = f"timed_{limits}"
    stream = detect_stream(spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), cfg, lateness=f"{ages + 1} milliseconds")
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(400)
    assert query.exception() is None
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(detect(packets, cfg))
    assert rows(spark.table(name)) == want and len(want) > 50
    for _ in range(50):  # progress is told a moment later
        if missed.counts.get(name):
            break
        time.sleep(0.2)
    spark.streams.removeListener(missed)
    assert missed.counts[name] >= late.count()


def test_event_time_state_ends(spark, tmp_path):
    """An idle key's window goes when the watermark has passed it."""
    from tracelake.streaming.detect import detect_stream

    def scan(at, src):
        return decode(table(spark, f.syn_scan(3, src), at)).withColumn("frame_no", F.col("frame_no") + at)

    from pyspark.sql import functions as F

    cfg = rl.DetectConfig(syn_scan_ports=3, window_ms=10_000, disabled=frozenset(BUILT_IN) - {"tcp_syn_scan"})
    parts = [scan(100, "10.0.0.9"), scan(200, "10.0.0.8"), scan(300, "10.0.0.7"), scan(400, "10.0.0.6")]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = detect_stream(spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), cfg, lateness="1 second")
    query = stream.writeStream.format("memory").queryName("ended").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None and [r.ts_unix_ms for r in spark.table("ended").orderBy("ts_unix_ms").collect()] == [102_123, 202_123, 302_123]
    windows = spark.read.format("statestore").option("stateVarName", "window").load(str(tmp_path / "ck"))
    held = spark.read.format("statestore").option("stateVarName", "held").load(str(tmp_path / "ck"))
    assert {r.key.key for r in windows.collect()} == {r.key.key for r in held.collect()} == {"10.0.0.6"}
