"""Schemas of frames, decoded packets and alerts, and a packet view over the ``events`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAME = "file_ord int, frame_no long, ts_secs long, ts_usecs int, orig_len long, data binary"

ALERT = "ts_unix_ms long, rule string, severity string, src string, detail string"
ALERT_COLUMNS = ["ts_unix_ms", "rule", "severity", "src", "detail"]

FLAGS = ("syn", "ack", "fin", "rst", "psh", "urg")

PACKET_BODY = """decode_ok boolean,
eth struct<src:string,dst:string,ethertype:int>, vlan int,
ip struct<src:string,dst:string,version:int,protocol:int,ttl:int,total_len:int>, tkind string,
tcp struct<src_port:int,dst_port:int,seq:bigint,ack:bigint,window:int,payload_len:int,flags:struct<syn:boolean,ack:boolean,fin:boolean,rst:boolean,psh:boolean,urg:boolean>>,
udp struct<src_port:int,dst_port:int,length:int,payload_len:int>,
icmp struct<version:int,type:int,code:int,summary:string>, other_protocol int, app string,
dns struct<is_query:boolean,id:int,questions:array<struct<name:string,type:string>>,answers:array<string>,rcode:int>,
http struct<summary:string,host:string,method_or_status:string,has_authorization:boolean>,
ssh struct<banner:string,proto:string>,
tls struct<handshake:string,version:string,sni:string,cipher_suite:string,ja3:string,ja3_hash:string,ja3s:string,ja3s_hash:string>,
arp struct<operation:string,sender_mac:string,sender_ip:string,target_mac:string,target_ip:string>,
dhcp struct<message_type:string,xid:bigint,client_mac:string,client_ip:string,your_ip:string,server_ip:string,requested_ip:string,server_id:string,client_hostname:string>,
payload_len int"""

PACKET = "frame_no long, file_ord int, ts_ms long, ts_us long, frame_len int, orig_len long, " + PACKET_BODY


def _typed(df: DataFrame) -> DataFrame:
    """Columns of PACKET in order, cast to its types, null where missing."""
    want = T.StructType.fromDDL(PACKET)
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])


def packet_view(events: DataFrame) -> DataFrame:
    """Packets made from rows of ``events`` by a fixed rule; the oracle SQL states the same rule.

    view: UDP (DNS query, DNS response or DHCP discover by k % 3); click: TCP SYN (with HTTP or TLS on some);
    signup: TCP with FIN alone, PSH and URG too, or no flag; purchase: ICMP echo, or ARP if k % 5 = 0; error: TCP RST.
    """
    kind = F.col("event_type")
    k = F.regexp_extract("props", "([0-9]+)", 1).try_cast("int")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    base = events.select("event_id", "user_id", "event_type", k.alias("k"), us.alias("us"))
    k = F.col("k")
    arp = (kind == "purchase") & (k % 5 == 0)
    udp, tcp, icmp = kind == "view", kind.isin("click", "signup", "error"), (kind == "purchase") & ~arp
    src = F.concat(F.lit("10.0."), F.expr("user_id div 256").cast("string"), F.lit("."), (F.col("user_id") % 256).cast("string"))
    dst = F.concat(F.lit("192.168."), (k % 4).cast("string"), F.lit("."), k.cast("string"))
    mac = F.concat(F.lit("02:00:00:00:00:"), F.lpad(F.lower(F.hex(F.col("user_id") % 16)), 2, "0"))
    ports = F.array(*[F.lit(p) for p in (22, 23, 53, 80, 443, 1337, 3306, 4444, 8080, 31337)])
    port = F.get(ports, k % 10)
    query, answer, dhcp = udp & (k % 3 == 0), udp & (k % 3 == 1), udp & (k % 3 == 2)
    stealth = kind == "signup"
    flags = {
        "syn": kind == "click",
        "ack": F.lit(False),
        "fin": stealth & (k % 3 != 2),
        "rst": kind == "error",
        "psh": stealth & (k % 3 == 1),
        "urg": stealth & (k % 3 == 1),
    }
    udp_src = F.when(query, 40000 + k).when(answer, F.lit(53)).otherwise(F.lit(68))
    udp_dst = F.when(query, F.lit(53)).when(answer, 40000 + k).otherwise(F.lit(67))
    http, tls = (kind == "click") & (k % 7 == 0), (kind == "click") & (k % 7 == 1)
    name = F.concat(F.lit("host"), k.cast("string"), F.lit(".example"))
    long_name = F.concat(F.repeat(F.lit("x"), 60), F.lit("."), name)
    s = lambda cond, **fields: F.when(cond, F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in fields.items()]))
    none = F.lit(None).cast("string")
    return _typed(
        base.select(
            F.col("event_id").alias("frame_no"),
            F.lit(0).alias("file_ord"),
            F.expr("us div 1000").alias("ts_ms"),
            F.col("us").alias("ts_us"),
            (60 + k).alias("frame_len"),
            (60 + k).alias("orig_len"),
            F.lit(True).alias("decode_ok"),
            s(F.lit(True), src=mac, dst="02:00:00:00:ff:ff", ethertype=F.when(arp, 0x0806).otherwise(0x0800)).alias("eth"),
            F.when(k % 10 == 9, k).alias("vlan"),
            s(~arp, src=src, dst=dst, version=4, protocol=F.when(udp, 17).when(tcp, 6).otherwise(1), ttl=64, total_len=46 + k).alias("ip"),
            F.when(udp, "udp").when(tcp, "tcp").when(icmp, "icmp").alias("tkind"),
            s(tcp, src_port=50000 + k, dst_port=port, seq=F.col("event_id"), ack=0, window=64240, payload_len=k, flags=F.struct(*[v.alias(n) for n, v in flags.items()])).alias("tcp"),
            s(udp, src_port=udp_src, dst_port=udp_dst, length=8 + k, payload_len=k).alias("udp"),
            s(icmp, version=4, type=F.when(k % 2 == 0, 8).otherwise(0), code=0, summary=F.when(k % 2 == 0, "echo request").otherwise("echo reply")).alias("icmp"),
            F.when(query | answer, "dns").when(dhcp, "dhcp").when(http, "http").when(tls, "tls").when(arp, "arp").alias("app"),
            s(query | answer, is_query=query, id=k, questions=F.array(F.struct(F.when(k % 12 == 0, long_name).otherwise(name).alias("name"), F.lit("A").alias("type"))), answers=F.array().cast("array<string>"), rcode=F.when(answer, k % 4).otherwise(0)).alias("dns"),
            s(http, summary="GET /", host=F.concat(F.lit("www."), name), method_or_status="GET", has_authorization=k % 2 == 0).alias("http"),
            s(tls, handshake="client_hello", version=F.when(k % 3 == 0, "TLS1.0").when(k % 3 == 1, "TLS1.2").otherwise("SSL3"), sni=F.concat(F.lit("admin."), name), cipher_suite=none, ja3="771,47,0,23,0", ja3_hash=F.md5(F.lit("771,47,0,23,0")), ja3s=none, ja3s_hash=none).alias("tls"),
            s(arp, operation="reply", sender_mac=mac, sender_ip=F.concat(F.lit("10.9.0."), k.cast("string")), target_mac="00:00:00:00:00:00", target_ip="10.9.0.1").alias("arp"),
            s(dhcp, message_type="discover", xid=F.col("event_id"), client_mac=mac, client_ip=none, your_ip=none, server_ip=none, requested_ip=none, server_id=none, client_hostname=F.concat(F.lit("pc"), k.cast("string"))).alias("dhcp"),
            k.alias("payload_len"),
        )
    )


#: The same view for DuckDB, flat.
PACKET_SQL = r"""b AS (
  SELECT event_id AS frame_no, user_id, event_type AS et, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
    epoch_us(ts) // 1000 AS ts_ms, epoch_us(ts) AS ts_us FROM events),
pkt AS (
  SELECT frame_no, ts_ms, ts_us, k, user_id, et, 60 + k AS frame_len,
    (et = 'purchase' AND k % 5 = 0) AS is_arp,
    '02:00:00:00:00:' || lpad(lower(to_hex(user_id % 16)), 2, '0') AS mac,
    CASE WHEN k % 10 = 9 THEN k END AS vlan,
    CASE WHEN NOT (et = 'purchase' AND k % 5 = 0) THEN '10.0.' || (user_id // 256) || '.' || (user_id % 256) END AS src,
    CASE WHEN NOT (et = 'purchase' AND k % 5 = 0) THEN '192.168.' || (k % 4) || '.' || k END AS dst,
    CASE WHEN et = 'view' THEN 'udp' WHEN et IN ('click', 'signup', 'error') THEN 'tcp' WHEN k % 5 <> 0 THEN 'icmp' END AS tkind,
    CASE WHEN et = 'view' THEN CASE k % 3 WHEN 0 THEN 40000 + k WHEN 1 THEN 53 ELSE 68 END WHEN et <> 'purchase' THEN 50000 + k END AS sport,
    CASE WHEN et = 'view' THEN CASE k % 3 WHEN 0 THEN 53 WHEN 1 THEN 40000 + k ELSE 67 END
      WHEN et <> 'purchase' THEN [22, 23, 53, 80, 443, 1337, 3306, 4444, 8080, 31337][k % 10 + 1] END AS dport,
    et = 'click' AS syn, et = 'signup' AND k % 3 <> 2 AS fin, et = 'error' AS rst, et = 'signup' AND k % 3 = 1 AS psh,
    CASE WHEN et = 'view' AND k % 3 IN (0, 1) THEN 'dns' WHEN et = 'view' THEN 'dhcp' WHEN et = 'click' AND k % 7 = 0 THEN 'http'
      WHEN et = 'click' AND k % 7 = 1 THEN 'tls' WHEN et = 'purchase' AND k % 5 = 0 THEN 'arp' END AS app,
    CASE WHEN k % 12 = 0 THEN repeat('x', 60) || '.' ELSE '' END || 'host' || k || '.example' AS qname,
    CASE WHEN k % 3 = 0 THEN 'TLS1.0' WHEN k % 3 = 1 THEN 'TLS1.2' ELSE 'SSL3' END AS tls_version
  FROM b)"""


def raw_packets(frames: DataFrame) -> DataFrame:
    """Time columns of frames (FRAME) as packets have them."""
    ms = F.col("ts_secs") * 1000 + F.expr("ts_usecs div 1000")
    length = F.col("frame_len") if "frame_len" in frames.columns else F.length("data").alias("frame_len")
    return frames.select(*[c for c in frames.columns if c != "frame_len"], ms.alias("ts_ms"), (F.col("ts_secs") * 1000000 + F.col("ts_usecs")).alias("ts_us"), length)
