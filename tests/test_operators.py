"""Imports, sinks, comparison, lookups, reports and the registered queries."""

import json
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tracelake.functions import text
from tracelake.operators import captures, diff, lookup, siem, stats, timeline
from tracelake.plans import engagement, report
from tracelake.schema import ALERT, packet_view
from tracelake.sources import eve, reports, zeek

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def alerts(spark):
    rows = [(1_720_000_000_000, "rare_port", "medium", "10.0.0.5", "dst port 4444"), (1_720_000_001_000, "x", "high", "a b", "a|b=c\\\nd"), (1, "y", "odd", "s", "d")]
    return spark.createDataFrame(rows, ALERT)


def one(df):
    return df.first()[0]


def test_siem(alerts):
    meta = siem.SiemMeta("detect", "T-1", "me", "host 1")
    lines = {f: [r[0] for r in siem.siem_lines(alerts, f, meta).collect()] for f in ("json", "CEF", "syslog")}
    assert json.loads(lines["json"][1]) == {"ts_unix_ms": 1_720_000_001_000, "product": "tracelake", "version": "0.1.0", "module": "detect", "ticket_id": "T-1", "operator": "me", "rule": "x", "severity": "high", "src": "a b", "detail": "a|b=c\\\nd", "hostname": "host 1"}
    assert "msg=a\\|b\\=c\\\\ d cs1Label" in lines["CEF"][1] and lines["CEF"][0].startswith("CEF:0|Tracelake|tracelake|0.1.0|rare_port|rare_port|5|rt=1720000000000 src=10.0.0.5 ")
    assert lines["syslog"][0].startswith("<132>1 2024-07-03T09:46:40.000Z host_1 tracelake detect - - rule=rare_port severity=medium src=10.0.0.5 ticket=T-1 operator=me detail=dst port 4444")
    assert lines["syslog"][1].startswith("<131>") and "src=a_b" in lines["syslog"][1] and lines["syslog"][2].startswith("<134>")
    with pytest.raises(ValueError):
        siem.parse_format("xml")


def test_udp_and_file(spark, alerts, tmp_path):
    import socket

    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        s.settimeout(10)
        assert siem.export_udp(alerts, "127.0.0.1", s.getsockname()[1]) == 3
        assert json.loads(s.recv(4096))["product"] == "tracelake"
    siem.export_file(alerts, str(tmp_path / "x"), "cef")
    siem.export_file(alerts, str(tmp_path / "x"), "cef")
    assert reports.count_lines(spark, str(tmp_path / "x")) == 6


def test_eve(spark, tmp_path):
    rows = [
        {"timestamp": "2017-04-07T22:24:37.251547+0100", "event_type": "alert", "src_ip": "1.1.1.1", "src_port": "77", "dest_ip": "2.2.2.2", "dest_port": 80, "proto": "TCP", "alert": {"signature": "S", "signature_id": 5, "gid": 2, "severity": 1, "category": "C", "action": "blocked"}, "app_proto": "http"},
        {"timestamp": "2017-04-07T22:24:37", "event_type": "ALERT", "alert": {}}, {"event_type": "alert"}, {"event_type": "alert", "alert": {"severity": "high"}}, {"event_type": "anomaly", "anomaly": {"event": "E"}},
        {"event_type": "dns"}, [1], {"event_type": 7},
    ]
    (tmp_path / "e").write_text("\n".join(map(json.dumps, rows)) + "\n\nnot json\n")
    lines = eve.read_eve(spark, str(tmp_path / "e"))
    made = eve.convert_eve(lines, ["alert", " Anomaly "])
    got = {a.rule: a for a in eve.kept_alerts(made).collect()}
    assert tuple(got["suricata:2:5"]) == (1491600277251, "suricata:2:5", "high", "1.1.1.1", "S | cat=C action=blocked TCP 1.1.1.1:77 -> 2.2.2.2:80 app=http")
    assert tuple(got["suricata:1:0"]) == (0, "suricata:1:0", "medium", "unknown", "suricata signature 0 | cat=- action=- - unknown -> - app=-")
    assert got["suricata:anomaly:E"].severity == "low"
    c = eve.import_counters(made).first()
    assert (c.lines_read, c.alerts_kept, c.skipped, c.parse_errors, c.truncated) == (9, 3, 3, 3, False)
    with pytest.raises(ValueError):
        eve.convert_eve(lines, [" "])


def test_eve_times(spark):
    cases = {
        "2023-09-18T05:53:41.532140+0000": 1695016421532, "2023-09-18T06:53:41.532140+01:00": 1695016421532, "2023-09-18 06:53:41.5+01": 1695016421500, "2023-09-18T05:53:41Z": 1695016421000,
        "2023-09-18T05:53:41": 0, "2023-13-18T05:53:41Z": 0, "2023-09-18T25:53:41Z": 0, "": 0, "1960-01-01T00:00:00Z": 0, "x": 0, "2023-02-31T00:00:00Z": 1677801600000,
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want long")
    from pyspark.sql import functions as F

    assert text.with_eve_millis(df, "t", "got").where("got <> want").collect() == []
    z = spark.createDataFrame([("1695016221.532140", 1695016221532), ("-", 0), ("", 0), ("nan", 0), ("-5", 0), ("7.9999", 7999), (" 5 ", 5000)], "t string, want long")
    assert z.where(text.zeek_millis(F.col("t")) != F.col("want")).collect() == []


def test_zeek(spark, tmp_path):
    fields = "ts id.orig_h id.orig_p id.resp_h id.resp_p note msg sub".split()
    (tmp_path / "n").write_text("#separator \\x09\n#unset_field\t-\n#fields\t" + "\t".join(fields) + "\n" + "\t".join("1695016221.5 10.0.0.1 - 9.9.9.9 22 SSH::Password_Guessing hello -".split()) + "\n1.0\t1.1.1.1\n")
    got = zeek.import_zeek(spark, str(tmp_path / "n")).orderBy("ts_unix_ms").collect()
    assert tuple(got[1]) == (1695016221500, "zeek:notice:SSH::Password_Guessing", "high", "10.0.0.1", "hello | note=SSH::Password_Guessing - 10.0.0.1 -> 9.9.9.9:22 sub=- n=-")
    assert got[0].rule == "zeek:notice:Notice::Unknown"
    (tmp_path / "w").write_text('{"ts":1695016221.532140,"id.orig_h":"1.1.1.1","id.orig_p":5,"name":"bad_TCP_checksum","notice":false,"addl":null}\n{bad\n')
    got = zeek.import_zeek(spark, str(tmp_path / "w"), "weird").collect()
    assert tuple(got[0])[1:] == ("zeek:weird:bad_TCP_checksum", "low", "1.1.1.1", "weird name=bad_TCP_checksum 1.1.1.1:5 -> - addl=- source=- notice=false")
    assert zeek.import_zeek(spark, str(tmp_path / "w"), "weird", ["other"]).count() == 0


def test_diff(spark):
    a = spark.createDataFrame([(1, "rare_port", "m", "1.1.1.1", "4444"), (1, "rare_port", "m", "1.1.1.1", "4444"), (2, "scan", "h", "2.2.2.2", "p")], ALERT)
    b = spark.createDataFrame([(9, "rare_port", "m", "1.1.1.1", "4444"), (9, "nx", "m", "3.3.3.3", "n")], ALERT)
    d = diff.diff_alerts(a, b)
    totals = d["totals"].first().asDict()
    assert totals == {"before": 3, "after": 2, "unchanged": 1, "gone": 2, "new": 1}
    out = diff.format_diff(totals, [r.asDict() for r in d["only_before"].collect()], [r.asDict() for r in d["only_after"].collect()])
    assert "- 1x scan|2.2.2.2|p" in out and "+ 1x nx|3.3.3.3|n" in out
    assert diff.diff_alerts(a, a.where("false"), "rule")["totals"].first().gone == 3
    with pytest.raises(ValueError):
        diff.fingerprint("x")


def test_captures(spark):
    from tests.test_decode import table

    a, b = table(spark, [b"a0", b"a1"], 100), table(spark, [b"b0"], 100)
    assert [bytes(r.data) for r in captures.merge_captures([a, b]).collect()] == [b"a0", b"b0", b"a1"]
    assert captures.slice_capture(a, 101).count() == 1 and captures.slice_capture(a, None, 101).count() == 1
    for bad in (lambda: captures.slice_capture(a), lambda: captures.slice_capture(a, 5, 5), lambda: captures.merge_captures([a])):
        with pytest.raises(ValueError):
            bad()


def test_lookup(spark):
    ips = spark.createDataFrame([("10.0.0.5",), ("10.1.0.0",), ("2001:db8::1",), ("nope",), (None,)], "ip string")
    from pyspark.sql import functions as F

    ok = lookup.allowed_addresses(["10.0.0.0/8", "2001:db8::/32"], ["10.1.0.0/16"])
    assert [r[0] for r in ips.where(ok(F.col("ip"))).collect()] == ["10.0.0.5", "2001:db8::1"]
    wide = lookup.cidr_ranges(spark, ["10.0.0.0/8", "10.0.0.0/9"])
    assert [r[0] for r in lookup.in_ranges(ips, "ip", wide).collect()] == ["10.0.0.5", "10.1.0.0"]
    hosts = lookup.expand_hosts(lookup.cidr_ranges(spark, ["10.0.0.0/29", "10.0.0.4/30", "10.9.9.9/32"]), lookup.cidr_ranges(spark, ["10.0.0.2/32"]))
    assert sorted(r.host for r in hosts.collect()) == ["10.0.0.1", "10.0.0.3", "10.0.0.4", "10.0.0.5", "10.0.0.6", "10.9.9.9"]


def test_histogram_edges(spark, sf):
    p = packet_view(spark.read.parquet(f"{sf}/events.parquet"))
    assert stats.time_histogram(p.where("false")).count() == 0 and stats.peak_bucket(stats.time_histogram(p.where("false"))).count() == 0
    single = stats.time_histogram(p.where("frame_no = 0"), 500).collect()
    assert len(single) == 128 and sum(r.packets for r in single) == 1 and max(single, key=lambda r: r.packets).bucket == 0


def test_reports_and_session(spark, alerts, tmp_path):
    rows = [{"ts_unix_ms": 5, "rule": "r", "severity": "low", "src": "s", "detail": "d"}]
    for name, doc in (("a", {"alerts": rows}), ("b", rows)):
        (tmp_path / name).write_text(json.dumps(doc))
        assert reports.read_alerts(spark, str(tmp_path / name)).first().rule == "r"
    (tmp_path / "scan").write_text(json.dumps({"open": [{"ip": "1.1.1.1", "port": 22, "proto": "tcp", "state": "open", "latency_ms": 1}], "closed_or_filtered": 3}))
    (tmp_path / "enum").write_text(json.dumps({"results": [{"ip": "1.1.1.1", "port": 22, "state": "open"}, {"ip": "1.1.1.1", "port": 23, "state": "closed"}]}))
    reports.audit_record(str(tmp_path / "audit"), "start", "scan", "me", "T", {"n": 1}, "ok")
    with open(tmp_path / "audit", "a") as f:
        f.write("bad line\n[1]\n")
    scan, enum, audit = reports.read_scan(spark, str(tmp_path / "scan")), reports.read_services(spark, str(tmp_path / "enum")), reports.read_audit(spark, str(tmp_path / "audit"))
    k = stats.kpis(alerts, scan, enum, None, audit).first()
    assert (k.open_ports, k.enum_hits, k.alerts, k.high, k.medium, k.low, k.packets, k.audit_events) == (1, 1, 3, 1, 1, 0, 0, 1)
    found = timeline.key_findings(alerts, scan, 3).collect()
    assert [f.label for f in found] == ["Open port", "Alert (high)", "Alert (medium)"] and found[0].detail == "1.1.1.1:22"
    pack = report.assemble("T <1>", 1_800_000_000_000, alerts, open_ports=scan, services=enum, audit=audit, notes=["n|1"])
    assert "# T <1>" in report.to_markdown(pack) and "n\\|1" in report.to_markdown(pack) and "Timeline" not in report.to_markdown(pack, "short") and "&lt;1&gt;" in report.to_html(pack, "exec")
    assert json.loads(report.to_json(pack))["kpis"]["alerts"] == 3 and pack.timeline[-1]["kind"] == "system"
    s = engagement.Session.create(str(tmp_path / "s"), "T", "ann", ["ann", "bob"])
    s.join("bob", "T", 1000)
    s.leave("bob")
    s.add_note("ann", "hello")
    again = engagement.Session.load(str(tmp_path / "s"))
    live = stats.session_presence(again.table(spark), again.members["ann"]["last_seen_ms"] + 130_000).collect()
    assert [(r.name, r.live) for r in live] == [("ann", "stale"), ("bob", "left")] and reports.read_notes(spark, str(tmp_path / "s" / "notes.jsonl")).first().text == "hello"
    for bad in (lambda: s.join("eve", "T"), lambda: s.join("bob", "U"), lambda: s.heartbeat("cy", "T")):
        with pytest.raises(ValueError):
            bad()
    scope = {"ticket_id": "T", "operator": "o", "authorized": True, "targets": ["10.0.0.0/30"], "exclude": ["10.0.0.1"], "ports": [1]}
    (tmp_path / "scope").write_text(json.dumps(scope))
    assert [r.host for r in engagement.Scope.load(str(tmp_path / "scope")).hosts(spark).collect()] == ["10.0.0.2"]
    for change in ({"authorized": False}, {"targets": []}, {"targets": ["x"]}, {"valid_until_unix": 5}):
        (tmp_path / "scope").write_text(json.dumps(scope | change))
        with pytest.raises(engagement.ScopeError):
            engagement.Scope.load(str(tmp_path / "scope"))


def _norm(value):
    if isinstance(value, float):
        return round(value, 6) if math.isfinite(value) else str(value)
    return value


CHECKED = sorted(n for n in entry.oracle_sql() if not n.startswith("op"))


@pytest.mark.parametrize("name", CHECKED)
def test_queries_match_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = entry.queries()[name](spark, sf)
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = sorted((tuple(_norm(r[n]) for n in names) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(map(_norm, r)) for r in want.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).columns == ["ts_unix_ms", "rule", "severity", "src", "detail"] and os.path.exists(os.path.dirname(entry.__file__))


def test_report_lines(spark, alerts, tmp_path):
    lines = lambda df: [json.loads(r.value) for r in df.collect()]
    head, *rows = lines(reports.diff_report(alerts, alerts.where("rule = 'x'")))
    assert (head["module"], head["gone"], head["new"]) == ("diff", 2, 0) and [r["change"]["side"] for r in rows] == ["only_before"] * 2
    eves = spark.createDataFrame([('{"event_type":"alert","alert":{}}',), ("x",)], "value string")
    head, *rows = lines(reports.import_report(eve.convert_eve(eves), "eve", 1, ["value"]))
    assert (head["alerts_kept"], head["parse_errors"], head["truncated"], len(rows)) == (1, 1, False, 1)
    twice = alerts.union(alerts.selectExpr("ts_unix_ms + 5", "rule", "severity", "src", "detail"))
    report_ = reports.detect_report(twice, 9, cooldown_ms=1000)
    head, *rows = lines(report_)
    assert (head["packets"], head["suppressed_by_cooldown"], len(rows)) == (9, 3, 3)
    report_.write.text(str(tmp_path / "r"))
    assert sorted(map(tuple, reports.read_report_lines(spark, str(tmp_path / "r"), "alert", ALERT).collect())) == sorted(map(tuple, alerts.collect()))


def test_rendering(alerts):
    text = "# T <b>\n\n- **a** and `b`\n- c\n\n| h | i |\n|---|---|\n| 1 | <2> |\ntext\n---\n```json\n{<}\n```\n## S"
    html = report.markdown_to_html(text)
    assert html == (
        "<h1>T &lt;b&gt;</h1>\n<ul>\n<li><strong>a</strong> and <code>b</code></li>\n<li>c</li>\n</ul>\n<table>\n<tr><th>h</th><th>i</th></tr>\n<tr><td>1</td><td>&lt;2&gt;</td></tr>\n</table>\n"
        '<p class="meta">text</p>\n<hr/>\n<pre><code>\n{&lt;}\n</code></pre>\n<h2>S</h2>\n'
    )
    assert "_Not provided._" in report.section("Scan", None) and "**1** (openish **1**)" in report.section("Enum", {"results": [{"state": "open"}]})
    assert report.preview(alerts, 2)[0].startswith("[odd] y src=s") and report.preview(alerts, 2)[-1] == "... 1 more alerts"
    snapshot = {"traffic": {"packets": 10, "tcp": 4}, "by_severity": [{"key": "high", "count": 2}], "by_rule": [{"key": "x", "count": 2}], "recent": []}
    shown = report.board(snapshot, "a.pcap", elapsed_secs=2)
    assert "pps=5.0" in shown and "alerts=2" in shown and "severity: high=2" in shown and "(none yet)" in shown
    assert report.event_rail([]).count("circle") == 0 and report.packet_chart([{"ts_unix_ms": 1, "packets": 3}]).count("<rect") == 1


def test_scope_hosts_of_ipv6(spark):
    scope = lambda **kw: engagement.Scope("T", "o", authorized=True, **kw).hosts(spark)
    assert [r.host for r in scope(targets=("2001:db8::/126", "10.0.0.0/30"), exclude=("2001:db8::2", "10.0.0.1")).collect()] == ["10.0.0.2", "2001:db8::1", "2001:db8::3"]
    with pytest.raises(ValueError, match="more than 4"):
        scope(targets=("10.0.0.0/29",), max_hosts=4)
    assert scope(targets=("10.0.0.0/29",), exclude=("10.0.0.1", "10.0.0.2"), max_hosts=4).count() == 4
    with pytest.raises(engagement.ScopeError, match="no hosts"):
        scope(targets=("10.0.0.1",), exclude=("10.0.0.0/24",))
    with pytest.raises(ValueError, match="IPv6"):
        lookup.cidr_ranges(spark, ["2001:db8::/32"])
