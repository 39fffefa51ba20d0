"""Detection: packets to alerts.

Each packet is turned into the signals of the enabled rules, in one pass whose narrow result is written, and
then judged by three ways.  Rules without state fire by themselves, without a shuffle; rules that fire at the
first packet of a key take a grouped minimum, combined before the shuffle; the others are dealt by (rule, key)
and folded, or cut into segments where a key has very many.  A further step, over the few alerts, applies
once-per-source limits of correlated rules and the cooldown.  Rules are judged in event time, and nothing is
capped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.network import flag_label, question_text
from tracelake.functions.rule_language import CustomRule, DetectConfig, compile_predicate, detail_column, display, field_column, limited_detail
from tracelake.operators.anchored import EVERY, FIRST, FOREVER, HOT_ROWS, REARM, anchored, first_per_key
from tracelake.schema import ALERT, ALERT_COLUMNS
from tracelake.sources.folders import written

#: Built-in rules in the order in which one packet's alerts come.
BUILT_IN = (
    "tcp_syn_scan", "tcp_host_sweep", "tcp_null_scan", "tcp_fin_scan", "tcp_xmas_scan", "rare_port", "dns_long_name", "dns_query_volume",
    "icmp_echo_flood", "tcp_rst_burst", "arp_mac_conflict", "http_cleartext_auth", "tls_legacy_version", "dhcp_discover_flood", "dns_nxdomain_burst",
)
LEGACY_TLS = ("SSL3", "TLS1.0", "TLS1.1")

#: How a rule is judged.
ALONE, ONCE, FOLDED = "alone", "once", "folded"

_SIGNAL = "struct<rule_ord:int,sub_ord:int,rule:string,severity:string,src:string,key:string,val:string,fires:boolean,window:bigint,least:bigint,least_unique:bigint,mode:int,detail:string>"


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _signal(order: int, rule: str, severity: str, *, src: Column, key: Column, detail: Column, val=None, fires=True, window=FOREVER, least=0, least_unique=0, mode=FIRST, sub=0) -> Column:
    col = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
    return F.struct(
        F.lit(order).alias("rule_ord"), col(sub, "int").alias("sub_ord"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), src.alias("src"), col(key, "string").alias("key"),
        col(val, "string").alias("val"), col(fires, "boolean").alias("fires"), col(window, "bigint").alias("window"), col(least, "bigint").alias("least"), col(least_unique, "bigint").alias("least_unique"),
        col(mode, "int").alias("mode"), detail.alias("detail"),
    ).cast(_SIGNAL)


def _window_text(window_ms: int | None) -> str:
    if window_ms is None:
        return "the input"
    return f"{window_ms // 1000}s" if window_ms % 1000 == 0 else f"{window_ms}ms" if window_ms < 1000 else f"{window_ms / 1000:g}s"


def _way(window=FOREVER, least=0, least_unique=0, mode=FIRST, **_) -> str:
    if mode == EVERY and least <= 1 and not least_unique:
        return ALONE
    return ONCE if mode == FIRST and window == FOREVER and least == 1 and not least_unique else FOLDED


def _way_column() -> Column:
    """``_way`` of signals."""
    c = F.col
    once = (c("mode") == FIRST) & (c("window") == FOREVER) & (c("least") == 1) & (c("least_unique") == 0)
    return F.when((c("mode") == EVERY) & (c("least") <= 1) & (c("least_unique") == 0), ALONE).when(once, ONCE).otherwise(FOLDED)


def signals(cfg: DetectConfig, *ways: str) -> Column | None:
    """An array of the signals that one packet gives to the enabled rules (judged in one of ``ways``, if given).

    None where there is no such rule.
    """
    ways = ways or (ALONE, ONCE, FOLDED)
    c = F.col
    src, dst, flags = c("ip.src"), c("ip.dst"), c("tcp.flags")
    window, within = FOREVER if cfg.window_ms is None else cfg.window_ms, _window_text(cfg.window_ms)
    probe = (c("tkind") == "tcp") & flags["syn"] & ~flags["ack"] & src.isNotNull()
    quiet = (c("tkind") == "tcp") & ~flags["syn"] & ~flags["ack"] & ~flags["rst"] & src.isNotNull()
    port = F.coalesce("tcp.dst_port", "udp.dst_port")
    dns, query = c("app") == "dns", (c("app") == "dns") & c("dns.is_query") & src.isNotNull()
    echo = ((c("icmp.version") == 4) & (c("icmp.type") == 8)) | ((c("icmp.version") == 6) & (c("icmp.type") == 128))
    arp_ip, arp_mac = c("arp.sender_ip"), c("arp.sender_mac")
    real = (arp_ip != "0.0.0.0") & (arp_mac != "00:00:00:00:00:00")
    client = F.coalesce("dhcp.client_mac", "ip.src", F.lit("unknown"))
    n = {rule: i for i, rule in enumerate(BUILT_IN)}
    one: list[tuple[str, Column, Column]] = []  # rule, condition, signal

    def add(rule: str, severity: str, when: Column, **kw) -> None:
        kw.setdefault("src", src)
        kw.setdefault("key", kw["src"])
        if _way(**kw) in ways:
            one.append((rule, when, _signal(n[rule], rule, severity, **kw)))

    add("tcp_syn_scan", "high", probe, val=port, window=window, least_unique=cfg.syn_scan_ports, detail=_text("SYN to {unique} distinct destination ports within ", within))
    add("tcp_host_sweep", "high", probe, val=dst, window=window, least_unique=cfg.host_sweep_hosts, detail=_text("SYN to {unique} distinct hosts within ", within))
    fin, psh, urg = flags["fin"], flags["psh"], flags["urg"]
    toward = _text("stealth TCP flags [", flag_label(flags), "] toward ", dst, ":", c("tcp.dst_port").cast("string"))
    add("tcp_null_scan", "high", quiet & ~fin & ~psh & ~urg, least=1, detail=toward)
    add("tcp_fin_scan", "high", quiet & fin & ~psh & ~urg, least=1, detail=toward)
    add("tcp_xmas_scan", "high", quiet & fin & psh & urg, least=1, detail=toward)
    rare = (probe | ((c("tkind") == "udp") & src.isNotNull())) & port.isin(sorted(cfg.rare_ports))
    add("rare_port", "medium", rare, key=_text(src, "|", port.cast("string")), least=1, detail=_text("traffic toward uncommon port ", port.cast("string"), " (dst ", dst, ")"))
    add("icmp_echo_flood", "medium", (c("tkind") == "icmp") & echo & src.isNotNull(), window=window, least=cfg.icmp_echo_count, detail=_text("{count} ICMP echo requests within ", within))
    add("tcp_rst_burst", "medium", (c("tkind") == "tcp") & flags["rst"] & src.isNotNull(), window=window, least=cfg.tcp_rst_count, detail=_text("{count} TCP RST packets within ", within))
    add("arp_mac_conflict", "high", (c("app") == "arp") & real, src=arp_mac, key=arp_ip, val=arp_mac, least_unique=2, detail=_text("IP ", arp_ip, " claimed by MAC ", arp_mac, " (previously {opening})"))
    add("http_cleartext_auth", "high", (c("app") == "http") & c("http.has_authorization") & src.isNotNull(), least=1, detail=_text("plaintext HTTP Authorization header toward ", dst, " (", F.coalesce("http.host", F.lit("-")), ")"))
    add("tls_legacy_version", "medium", (c("app") == "tls") & c("tls.version").isin(*LEGACY_TLS) & src.isNotNull(), least=1, detail=_text(c("tls.handshake"), " ", c("tls.version"), " toward ", dst, " (sni=", F.coalesce("tls.sni", F.lit("-")), " ja3=", F.coalesce("tls.ja3_hash", F.lit("-")), ")"))
    add("dhcp_discover_flood", "medium", (c("app") == "dhcp") & (c("dhcp.message_type") == "discover"), src=client, window=window, least=cfg.dhcp_discover_count, detail=_text("{count} DHCP discovers within ", within))
    add("dns_nxdomain_burst", "medium", dns & ~c("dns.is_query") & (c("dns.rcode") == 3) & dst.isNotNull(), src=dst, window=window, least=cfg.dns_nxdomain_count, detail=_text("{count} NXDOMAIN responses within ", within))
    for i, rule in enumerate(cfg.custom_rules):
        way, signal = _custom(len(BUILT_IN) + i, rule)
        if way in ways:
            one.append((rule.id, compile_predicate(rule.when), signal))
    enabled = [F.when(when, signal) for rule, when, signal in one if rule.lower() not in cfg.disabled]
    out = [F.array_compact(F.array(*enabled))] if enabled else []

    def questions(rule: str, way: str, make) -> list[Column]:
        each = F.transform(c("dns.questions"), lambda q, i: F.when(make(q, i)[0], make(q, i)[1]))
        found = F.coalesce(F.when(query, F.array_compact(each)), F.array().cast(f"array<{_SIGNAL}>"))
        return [] if rule in cfg.disabled or way not in ways else [found]

    long_name = lambda q, i: (
        F.octet_length(q["name"]) >= cfg.dns_long_name,
        _signal(n["dns_long_name"], "dns_long_name", "medium", src=src, key=src, sub=i, mode=EVERY, detail=_text("long DNS QNAME len=", F.octet_length(q["name"]).cast("string"), " (", q["name"], ")")),
    )
    volume = lambda q, i: (
        F.lit(True),
        _signal(n["dns_query_volume"], "dns_query_volume", "high", src=src, key=src, sub=i, val=q["name"], fires=i == F.size("dns.questions") - 1, least_unique=cfg.dns_unique_names, detail=F.lit("{unique} unique DNS query names observed (possible enumeration/tunneling)")),
    )
    out += questions("dns_long_name", ALONE, long_name) + questions("dns_query_volume", FOLDED, volume)
    return F.concat(*out) if out else None


def _source() -> Column:
    return F.coalesce("ip.src", "eth.src", F.lit("unknown"))


def _custom(order: int, rule: CustomRule) -> tuple[str, Column]:
    """How the rule is judged, and its signal."""
    src, detail = _source(), detail_column(rule.detail)
    if rule.correlate is None:
        key = {"none": src, "once": F.lit("*"), "per_src": src}[rule.once]
        limits = {"least": 1, "mode": EVERY if rule.once == "none" else FIRST}
        return _way(**limits), _signal(order, rule.id, rule.severity, src=src, key=key, detail=detail, **limits)
    corr = rule.correlate
    a, b = F.coalesce("ip.src", F.lit("unknown")), F.coalesce("ip.dst", F.lit("unknown"))
    key = {"src": a, "dst": b, "pair": _text(a, "->", b), "all": F.lit("*")}[corr.track]
    val = display(*field_column(corr.unique_field)) if corr.unique_field else None
    limits = {"window": corr.window_secs * 1000, "least": corr.count or 1, "least_unique": corr.unique_count or 0, "mode": REARM if rule.once == "none" else EVERY}
    detail = F.replace(detail, F.lit("{window_secs}"), F.lit(str(corr.window_secs)))
    return _way(**limits), _signal(order, rule.id, rule.severity, src=src, key=key, val=val, detail=detail, **limits)


ORDER = ["ts", "file_ord", "frame_no", "rule_ord", "sub_ord"]
_PLACE = "ts long, file_ord int, frame_no long, rule_ord int, sub_ord int"


def detect(packets: DataFrame, cfg: DetectConfig | None = None, with_order: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Alerts (ALERT) of decoded packets; ``with_order`` keeps the columns that order them.

    Keys with more than ``hot_rows`` signals of a rule are answered in segments.
    """
    cfg = cfg or DetectConfig()
    ways = [way for way in (ALONE, ONCE, FOLDED) if signals(cfg, way) is not None]
    first = lambda rows: rows.select("*", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("uniq"), F.col("val").alias("opening"))
    order = ["ts", "file_ord", "frame_no", "sub_ord"]
    judged = {
        ALONE: first,
        ONCE: lambda rows: first(first_per_key(rows, ["rule", "key"], order)),
        FOLDED: lambda rows: anchored(rows, group=["rule", "key"], order=order, hot_rows=hot_rows),
    }
    parts = []
    if ways:
        found = packets.where("decode_ok").select(F.col("ts_ms").alias("ts"), "file_ord", "frame_no", F.explode(signals(cfg)).alias("s"))
        found = found.select("ts", "file_ord", "frame_no", "s.*").withColumn("way", _way_column())
        if ways != [ALONE] and ways != [ONCE]:
            found = written(found, "signals")  # packets are read and decoded once, whatever the ways
        parts = [judged[way](found.where(F.col("way") == way).drop("way")) for way in ways]
    if not parts:
        return packets.sparkSession.createDataFrame([], ALERT if not with_order else f"{_PLACE}, {ALERT}")
    fired = parts[0]
    for part in parts[1:]:
        fired = fired.unionByName(part)
    dynamic = F.col("detail").contains("{")
    counted = F.replace(F.replace(F.col("detail"), F.lit("{count}"), F.col("n").cast("string")), F.lit("{unique}"), F.col("uniq").cast("string"))
    counted = F.replace(counted, F.lit("{opening}"), F.coalesce("opening", F.lit("-")))
    plain = [i for i, r in enumerate(BUILT_IN) if r in ("dns_long_name", "rare_port", "http_cleartext_auth", "tls_legacy_version")]
    uncorrelated = [len(BUILT_IN) + i for i, r in enumerate(cfg.custom_rules) if r.correlate is None]
    detail = F.when(dynamic & ~F.col("rule_ord").isin(*plain, *uncorrelated, -1), counted).otherwise(F.col("detail"))
    alerts = fired.select(*ORDER, F.col("ts").alias("ts_unix_ms"), "rule", "severity", "src", F.when(F.col("rule_ord") >= len(BUILT_IN), limited_detail(detail)).otherwise(detail).alias("detail"))
    once = {r.once: [x.id for x in cfg.custom_rules if x.correlate and x.once == r.once] for r in cfg.custom_rules if r.correlate and r.once != "none"}
    if once:  # correlated rules that may fire once, or once a source
        limited = [x for ids in once.values() for x in ids]
        free = alerts.where(~F.col("rule").isin(limited))
        for mode, ids in once.items():
            key = F.lit("*") if mode == "once" else F.col("src")
            free = free.unionByName(_first(alerts.where(F.col("rule").isin(ids)), key))
        alerts = free
    if cfg.cooldown_ms > 0:
        alerts = cooldown(alerts, cfg.cooldown_ms)
    return alerts if with_order else alerts.select(*ALERT_COLUMNS)


def _judged(alerts: DataFrame, key: Column, window: int) -> DataFrame:
    names = alerts.columns
    rows = alerts.select(
        *names, key.alias("__key"), F.lit(None).cast("string").alias("val"), F.lit(True).alias("fires"), F.lit(window).cast("long").alias("window"),
        F.lit(1).cast("long").alias("least"), F.lit(0).cast("long").alias("least_unique"), F.lit(FIRST).alias("mode"),
    )
    return anchored(written(rows, "alerts"), group=["rule", "__key"], order=ORDER).select(*names)


def _first(alerts: DataFrame, key: Column) -> DataFrame:
    rows = alerts.withColumn("__key", key)
    return first_per_key(rows, ["rule", "__key"], ORDER).select(*alerts.columns)


def cooldown(alerts: DataFrame, cooldown_ms: int) -> DataFrame:
    """Alerts at least ``cooldown_ms`` after the last one let through of the same rule and source."""
    return _judged(alerts, F.col("src"), cooldown_ms - 1) if cooldown_ms > 0 else alerts


def suppressed(alerts: DataFrame, cooldown_ms: int) -> DataFrame:
    """(rule, src, kept, suppressed): how many alerts the cooldown lets through and how many it holds back."""
    before = alerts.groupBy("rule", "src").agg(F.count(F.lit(1)).alias("n"))
    after = cooldown(alerts, cooldown_ms).groupBy("rule", "src").agg(F.count(F.lit(1)).alias("kept"))
    return before.join(after, ["rule", "src"]).select("rule", "src", "kept", (F.col("n") - F.col("kept")).alias("suppressed"))


def ordered_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts without packet order (imports, files) given one: time, then text."""
    return alerts.select(F.col("ts_unix_ms").alias("ts"), F.lit(0).alias("file_ord"), F.lit(0).cast("long").alias("frame_no"), F.lit(0).alias("rule_ord"), F.lit(0).alias("sub_ord"), *ALERT_COLUMNS)
