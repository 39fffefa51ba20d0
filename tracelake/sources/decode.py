"""Frames to packets: link to transport layer as column expressions, applications in a map over Arrow batches.

Headers lie at offsets that other header fields give, so they are read from a hex text of the frame's first
bytes by expressions that Spark compiles.  Only payloads that can hold a known application, and IPv6
addresses, reach Python.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tracelake.functions.filter_language import capture_filter, header_filter, length_filter
from tracelake.schema import PACKET, raw_packets
from tracelake.sources.columnar import Found, Payloads, dns_columns, texts_of

#: Bytes of a frame in which headers are looked for.
HEADER_BYTES = 192
VLAN_TYPES = (0x8100, 0x88A8, 0x9100)
EXTENSIONS = (0, 43, 60, 135)  # IPv6 headers of length field + 1 units of 8 bytes
_ICMP4 = {0: "echo-reply", 3: "dest-unreach", 8: "echo-request", 11: "time-exceeded"}
_ICMP6 = {1: "dest-unreach", 128: "echo-request", 129: "echo-reply", 133: "router-solicit", 134: "router-advert", 135: "neighbor-solicit", 136: "neighbor-advert"}

APP = """dns struct<is_query:boolean,id:int,questions:array<struct<name:string,type:string>>,answers:array<string>,rcode:int>,
http struct<summary:string,host:string,method_or_status:string,has_authorization:boolean>, ssh struct<banner:string,proto:string>,
tls struct<handshake:string,version:string,sni:string,cipher_suite:string,ja3:string,ja3_hash:string,ja3s:string,ja3s_hash:string>,
dhcp struct<message_type:string,xid:bigint,client_mac:string,client_ip:string,your_ip:string,server_ip:string,requested_ip:string,server_id:string,client_hostname:string>,
app string, src string, dst string"""


# ---------------------------------------------------------------- applications
class _Short(Exception):
    """A message ends before its fields do."""


def _name(m: bytes, at: int) -> tuple[str, int]:
    """A DNS name at ``at`` and the place after it; follows compression pointers backwards only."""
    labels, after, size = [], None, 0
    while True:
        if at >= len(m):
            raise _Short
        n = m[at]
        if n & 0xC0 == 0xC0:
            if at + 1 >= len(m):
                raise _Short
            to = (n & 0x3F) << 8 | m[at + 1]
            after = at + 2 if after is None else after
            if to >= at:
                raise _Short
            at = to
        elif n & 0xC0:
            raise _Short
        elif n == 0:
            return ".".join(labels), at + 1 if after is None else after
        else:
            size += n + 1
            if at + 1 + n > len(m) or size > 255:
                raise _Short
            labels.append(m[at + 1 : at + 1 + n].decode("utf-8", "replace"))
            at += 1 + n


_TYPES = {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV", 41: "OPT", 43: "DS", 46: "RRSIG", 48: "DNSKEY", 64: "SVCB", 65: "HTTPS", 252: "AXFR", 255: "ANY", 257: "CAA"}


def dns_info(m: bytes) -> dict | None:
    """Header, first 8 questions and answers of a message; None where it is none."""
    if len(m) < 12:
        return None
    number, flags, questions, answers, authority, extra = struct.unpack_from(">6H", m)
    asked, told, at = [], [], 12
    try:
        for _ in range(questions):
            name, at = _name(m, at)
            if at + 4 > len(m):
                raise _Short
            kind = int.from_bytes(m[at : at + 2])
            asked.append({"name": name, "type": _TYPES.get(kind, f"TYPE{kind}")})
            at += 4
        for i in range(answers + authority + extra):
            name, at = _name(m, at)
            if at + 10 > len(m):
                raise _Short
            kind, _, _, size = struct.unpack_from(">HHIH", m, at)
            at += 10
            if at + size > len(m):
                raise _Short
            data = m[at : at + size]
            if i < min(answers, 8):
                text = str(ipaddress.ip_address(data)) if (kind, size) in ((1, 4), (28, 16)) else _name(m, at)[0] if kind in (2, 5, 12) else data.hex()
                text = f"{_TYPES.get(kind, f'TYPE{kind}')} {text}"
                told.append(f"{name} {text if len(text) <= 80 else text[:77] + '…'}")
            at += size
    except _Short:
        return None
    return {"is_query": not flags & 0x8000, "id": number, "questions": asked[:8], "answers": told, "rcode": flags & 0xF}


def _v4(raw: bytes) -> str:
    return ".".join(map(str, raw))


_DHCP = ("unknown", "discover", "offer", "request", "decline", "ack", "nak", "release", "inform")


def dhcp_info(m: bytes) -> dict | None:
    if len(m) < 240 or m[0] not in (1, 2) or m[236:240] != b"\x63\x82\x53\x63":
        return None
    options: dict[int, bytes] = {}
    at = 240
    while at < len(m) and m[at] != 255:
        if m[at] == 0:
            at += 1
            continue
        if at + 1 >= len(m) or at + 2 + m[at + 1] > len(m):
            break
        options[m[at]] = m[at + 2 : at + 2 + m[at + 1]]
        at += 2 + m[at + 1]
    kind = options.get(53, b"")[:1]
    address = lambda raw: _v4(raw) if len(raw) == 4 else None
    given = lambda a: _v4(m[a : a + 4]) if any(m[a : a + 4]) else None
    try:
        host = options.get(12, b"").decode().strip("\0").strip() or None
    except UnicodeDecodeError:
        host = None
    return {
        "message_type": _DHCP[kind[0]] if kind and kind[0] < len(_DHCP) else "unknown", "xid": int.from_bytes(m[4:8]), "client_mac": m[28 : 28 + min(m[2], 16)].hex(":"),
        "client_ip": given(12), "your_ip": given(16), "server_ip": given(20), "requested_ip": address(options.get(50, b"")), "server_id": address(options.get(54, b"")), "client_hostname": host,
    }


_REQUEST = re.compile(r"(?:GET|POST|PUT|HEAD|DELETE|OPTIONS|PATCH|CONNECT|TRACE) .*HTTP/")
_STATUS = re.compile(r"HTTP/(?:1\.|2)")


def _shown(text: str) -> str:
    """Control characters escaped, 200 characters at most."""
    plain = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}
    out = "".join(plain.get(c) or (f"\\x{ord(c):02x}" if ord(c) < 32 or 127 <= ord(c) < 160 else c) for c in text[:200])
    return out + "…" if len(text) > 200 else out


def http_info(m: bytes) -> dict | None:
    """Start line, Host, and whether credentials are sent; their values are never kept."""
    try:
        text = m.decode()[:4096]
    except UnicodeDecodeError:
        return None
    lines = text.split("\r\n") if "\r\n" in text else [x.rstrip("\r") for x in text.split("\n")]
    start, host, secret = lines[0], None, False
    if not (_REQUEST.match(start) or _STATUS.match(start)):
        return None
    for line in lines[1:65]:
        if not line:
            break
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if colon and name == "host":
            host = _shown(value.strip())
        secret |= bool(colon) and name in ("authorization", "proxy-authorization")
    words = start.split()
    at = 1 if _STATUS.match(start) else 0
    return {"summary": _shown(start), "host": host, "method_or_status": words[at] if len(words) > at else "?", "has_authorization": secret}


def ssh_info(m: bytes) -> dict | None:
    if not m.startswith((b"SSH-1.", b"SSH-2.")):
        return None
    try:
        line = m.decode().split("\n", 1)[0].rstrip("\r")
    except UnicodeDecodeError:
        return None
    return {"banner": line, "proto": "1.x" if line.startswith("SSH-1.") else "2.0"} if 7 <= len(line.encode()) <= 255 else None


def _grease(v: int) -> bool:
    return v >> 8 == v & 0xFF and v & 0xF == 0xA


def _u16s(raw: bytes) -> list[int]:
    return [v for (v,) in struct.iter_unpack(">H", raw[: len(raw) // 2 * 2]) if not _grease(v)]


def _tls_version(v: int, fallback: str = "unknown") -> str:
    return {0x300: "SSL3", 0x301: "TLS1.0", 0x302: "TLS1.1", 0x303: "TLS1.2", 0x304: "TLS1.3"}.get(v, fallback)


def _extensions(raw: bytes) -> list[tuple[int, bytes]]:
    out, at = [], 0
    while at + 4 <= len(raw):
        kind, size = struct.unpack_from(">HH", raw, at)
        if at + 4 + size > len(raw):
            break
        out.append((kind, raw[at + 4 : at + 4 + size]))
        at += 4 + size
    return out


def _server_name(data: bytes) -> str | None:
    size = int.from_bytes(data[3:5])
    if len(data) < 5 or data[2] or len(data) < 5 + size:
        return None
    try:
        return (data[5 : 5 + size].decode() or None) if size <= 253 else None
    except UnicodeDecodeError:
        return None


def _joined(values) -> str:
    return "-".join(map(str, values))


def tls_info(m: bytes) -> dict | None:
    """Hello messages at the start of a segment, with JA3 and JA3S."""
    if len(m) < 11 or m[0] != 0x16 or m[1] != 3 or m[2] > 4:
        return None
    out = dict.fromkeys(("handshake", "version", "sni", "cipher_suite", "ja3", "ja3_hash", "ja3s", "ja3s_hash"))
    kind, body, record = m[5], m[9:], _tls_version(int.from_bytes(m[1:3]))
    if kind not in (1, 2):
        return out | {"handshake": f"handshake_type_{kind}", "version": record}
    if len(body) < 35:
        return None
    number = int.from_bytes(body[:2])
    out |= {"handshake": "client_hello" if kind == 1 else "server_hello", "version": _tls_version(number, record)}
    at = 35 + body[34]
    if len(body) < at + 2:
        return out
    if kind == 1:
        size = int.from_bytes(body[at : at + 2])
        if len(body) < at + 2 + size + 1:
            return out
        ciphers, at = _u16s(body[at + 2 : at + 2 + size]), at + 2 + size
        at += 1 + body[at]
    else:
        cipher, at = int.from_bytes(body[at : at + 2]), at + 3
        out["cipher_suite"] = f"0x{cipher:04x}"
        if len(body) < at:
            return out
    found = _extensions(body[at + 2 : at + 2 + int.from_bytes(body[at : at + 2])])
    kinds = _joined(k for k, _ in found if not _grease(k))
    if kind == 2:
        text = f"{number},{cipher},{kinds}"
        return out | {"ja3s": text, "ja3s_hash": hashlib.md5(text.encode()).hexdigest()}
    groups = [g for k, d in found if k == 10 and len(d) >= 2 for g in _u16s(d[2 : 2 + int.from_bytes(d[:2])])]
    points = [p for k, d in found if k == 11 and d for p in d[1 : 1 + d[0]]]
    names = (_server_name(d) for k, d in found if k == 0)
    text = f"{number},{_joined(ciphers)},{kinds},{_joined(groups)},{_joined(points)}"
    return out | {"sni": next((n for n in names if n), None), "ja3": text, "ja3_hash": hashlib.md5(text.encode()).hexdigest()}


_TLS_PORTS = {443, 8443, 9443, 993, 995, 465, 636}


_HTTP_STARTS = frozenset(b"GPHDOCT")  # first bytes of the methods and of a status line


def applications(payload: pa.Array, kind: pa.Array, sport: pa.Array, dport: pa.Array, out: pa.StructType) -> dict[str, Found]:
    """The first application that each payload is, by port and look: a row is in one of them at most."""
    p = Payloads(payload)
    held = p.ends > p.starts
    is_kind = lambda k: pc.fill_null(pc.equal(kind, k), False).to_numpy(zero_copy_only=False)
    ports = [x.fill_null(-1).to_numpy(zero_copy_only=False) for x in (sport, dport)]
    between = lambda *wanted: np.isin(ports[0], wanted) | np.isin(ports[1], wanted)
    udp, tcp, first = held & is_kind("udp"), held & is_kind("tcp"), p.first()
    found = {name: Found(out.field(name).type) for name in ("dns", "dhcp", "ssh", "tls", "http")}

    rows = np.flatnonzero(udp & between(53))
    common, structs = dns_columns(p, rows, found["dns"].kind, lambda k: _TYPES.get(k, f"TYPE{k}"))
    found["dns"].add(common, structs)
    found["dns"].add_rows(np.setdiff1d(rows, common), lambda i: dns_info(p.bytes(i)))
    asked = udp & between(67, 68)
    asked[found["dns"].places()] = False
    found["dhcp"].add_rows(np.flatnonzero(asked), lambda i: dhcp_info(p.bytes(i)))
    for name, starts, parse in (("ssh", b"S", ssh_info), ("tls", b"\x16", tls_info), ("http", bytes(_HTTP_STARTS), http_info)):  # their first bytes differ
        found[name].add_rows(np.flatnonzero(tcp & np.isin(first, list(starts))), lambda i, parse=parse: parse(p.bytes(i)))
    return found


def _with_applications(headers: DataFrame) -> DataFrame:
    """``headers`` with a (APP) in place of the columns it is made from.

    A map over batches rather than a UDF, so that no filter from above is pushed into the header expressions
    and repeats them.
    """
    inputs = ["payload", "tkind", "sp", "dp", "src6", "dst6", "is_arp"]
    kept = [f for f in headers.schema if f.name not in inputs or f.name == "tkind"]
    out = T.StructType.fromDDL(APP)
    arrow, names = to_arrow_type(out), [f.name for f in kept]  # made here: workers have no session to read DDL with

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        address = lambda raw: str(ipaddress.ip_address(raw))
        for batch in batches:
            n, column = batch.num_rows, batch.column
            found = applications(column("payload"), column("tkind"), column("sp"), column("dp"), arrow)
            app = np.full(n, -1)
            app[np.flatnonzero(column("is_arp").fill_null(False).to_numpy(zero_copy_only=False))] = len(found)
            for i, x in enumerate(found.values()):
                app[x.places()] = i
            parts = {name: x.column(n) for name, x in found.items()}
            parts |= {"app": pa.array([*found, "arp"]).take(pa.array(app, mask=app < 0)), "src": texts_of(column("src6"), address), "dst": texts_of(column("dst6"), address)}
            fields = [arrow.field(i) for i in range(arrow.num_fields)]
            whole = pa.StructArray.from_arrays([parts[x.name] for x in fields], fields=fields)
            yield pa.RecordBatch.from_arrays([*(column(c) for c in names), whole], names=[*names, "a"])

    return headers.mapInArrow(run, T.StructType([*kept, T.StructField("a", out)]))


# ---------------------------------------------------------------- headers
def _u(offset: Column | int, size: int) -> Column:
    """An unsigned number of ``size`` bytes at a byte offset of the frame; null beyond its end."""
    at = offset if isinstance(offset, Column) else F.lit(offset)
    text = F.col("h").substr((at * 2 + 1).cast("int"), F.lit(2 * size))
    return F.when(F.length(text) == 2 * size, F.conv(text, 16, 10).cast("long"))


def _bytes(offset: Column, size: Column | int) -> Column:
    return F.col("data").substr((offset + 1).cast("int"), size.cast("int") if isinstance(size, Column) else F.lit(size))


def _mac(offset: int | Column) -> Column:
    return F.regexp_replace(F.lower(F.hex(_bytes(offset if isinstance(offset, Column) else F.lit(offset), 6))), "(..)(?!$)", "$1:")


def _dotted(offset: Column) -> Column:
    return F.concat_ws(".", *[_u(offset + i, 1).cast("string") for i in range(4)])


def _summary(kind: Column, code: Column, names: dict[int, str], other: str) -> Column:
    name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), kind.cast("int")), F.lit(other))
    return F.concat(name, F.lit(" type="), kind.cast("string"), F.lit(" code="), code.cast("string"))


def decode(frames: DataFrame, where: str | None = None) -> DataFrame:
    """Packets (PACKET) of frames (FRAME), one each; decode_ok is false for those that are damaged.

    ``where`` is a capture filter.  What it can't match by the headers alone is left out before applications are
    parsed, and its limits of length reach the source of the frames.
    """
    c = F.col
    raw = raw_packets(frames)
    df = (raw if where is None else raw.where(length_filter(where))).select("frame_no", "file_ord", "ts_ms", "ts_us", "frame_len", "orig_len", "data", F.hex(F.substring("data", 1, HEADER_BYTES)).alias("h"))
    df = df.withColumn("t0", _u(12, 2))
    df = df.withColumn("tags", F.when(c("t0").isin(*VLAN_TYPES), F.when(_u(16, 2).isin(*VLAN_TYPES), 2).otherwise(1)).otherwise(0))
    df = df.withColumns({"l3": 14 + 4 * c("tags"), "vlan": F.when(c("tags") > 0, _u(14, 2).bitwiseAND(F.lit(0xFFF)))})
    df = df.withColumn("ether", _u(c("l3") - 2, 2))
    v4, v6 = c("ether") == 0x0800, c("ether") == 0x86DD
    df = df.withColumns({"first": _u(c("l3"), 1), "room": c("frame_len") - c("l3"), "total": F.when(v4, _u(c("l3") + 2, 2)).when(v6, _u(c("l3") + 4, 2) + 40)})
    df = df.withColumns({
        "ihl": F.when(v4, c("first").bitwiseAND(F.lit(15)) * 4).when(v6, 40),
        "proto": F.when(v4, _u(c("l3") + 9, 1)).when(v6, _u(c("l3") + 6, 1)),
    })
    version = F.shiftright("first", 4)
    sound4 = (version == 4) & (c("ihl") >= 20) & (c("total") >= c("ihl")) & (c("total") <= c("room"))
    sound6 = (version == 6) & (c("total") <= c("room"))
    df = df.withColumn("ip_ok", F.coalesce(F.when(v4, sound4).when(v6, sound6), F.lit(False)))
    # up to three IPv6 extension headers of the common form
    df = df.withColumns({"l4": c("l3") + c("ihl"), "next": c("proto")})
    for _ in range(3):
        more = v6 & c("next").isin(*EXTENSIONS)
        df = df.withColumns({"l4": F.when(more, c("l4") + (_u(c("l4") + 1, 1) + 1) * 8).otherwise(c("l4")), "next": F.when(more, _u(c("l4"), 1)).otherwise(c("next"))})
    fragment = F.coalesce(F.when(v4, _u(c("l3") + 6, 2).bitwiseAND(F.lit(0x3FFF)) != 0).when(v6, c("next") == 44), F.lit(False))
    kind = F.when(fragment, "other").when(c("next") == 6, "tcp").when(c("next") == 17, "udp").when((v4 & (c("next") == 1)) | (v6 & (c("next") == 58)), "icmp").otherwise("other")
    df = df.withColumns({"tk": F.when(c("ip_ok"), kind), "rest": c("l3") + c("total") - c("l4")})
    df = df.withColumns({"thl": F.when(c("tk") == "tcp", F.shiftright(_u(c("l4") + 12, 1), 4) * 4).when(c("tk") == "udp", 8), "ulen": F.when(c("tk") == "udp", _u(c("l4") + 4, 2))})
    whole = F.coalesce(
        F.when(c("tk") == "tcp", (c("thl") >= 20) & (c("rest") >= c("thl")))
        .when(c("tk") == "udp", (c("rest") >= 8) & ((c("ulen") == 0) | c("ulen").between(8, c("rest"))))
        .when(c("tk") == "icmp", c("rest") >= F.when(v4, 8).otherwise(4))
        .otherwise(True),
        F.lit(False),
    )
    ok = (c("frame_len") >= 14 + 4 * c("tags")) & ((~(v4 | v6)) | (c("ip_ok") & whole))
    size = F.when(c("tk") == "udp", F.when(c("ulen") == 0, c("rest")).otherwise(c("ulen")) - 8).when(c("tk") == "tcp", c("rest") - c("thl"))
    df = df.withColumn("ok", F.coalesce(ok, F.lit(False)))
    df = df.withColumns({"tk": F.when(c("ok"), c("tk")), "size": F.when(c("ok"), size)})
    df = df.withColumns({"sp": F.when(c("thl").isNotNull() & c("ok"), _u(c("l4"), 2)).cast("int"), "dp": F.when(c("thl").isNotNull() & c("ok"), _u(c("l4") + 2, 2)).cast("int")})
    payload = F.when(c("size") > 0, _bytes(c("l4") + c("thl"), c("size")))
    six = lambda at: F.when(v6 & c("ok"), _bytes(c("l3") + at, 16))
    arp_at = F.when(c("t0") == 0x8100, 18).otherwise(14)
    is_arp = c("ok") & (F.when(c("t0") == 0x8100, _u(16, 2)).otherwise(c("t0")) == 0x0806) & (c("frame_len") >= arp_at + 28)
    is_arp = F.coalesce(is_arp & (_u(arp_at, 2) == 1) & (_u(arp_at + 2, 2) == 0x0800) & (_u(arp_at + 4, 2) == 0x0604), F.lit(False))
    operation = F.when(_u(arp_at + 6, 2) == 1, "request").when(_u(arp_at + 6, 2) == 2, "reply").otherwise(F.concat(F.lit("op-"), _u(arp_at + 6, 2).cast("string")))
    flag = lambda bit: F.shiftright(_u(c("l4") + 13, 1), bit).bitwiseAND(F.lit(1)) == 1
    flags = F.struct(flag(1).alias("syn"), flag(4).alias("ack"), flag(0).alias("fin"), flag(2).alias("rst"), flag(3).alias("psh"), flag(5).alias("urg"))
    kind, code = _u(c("l4"), 1), _u(c("l4") + 1, 1)
    s = lambda when, **f: F.when(when, F.struct(*[v.alias(n) for n, v in f.items()]))
    ip = s(
        c("ok") & c("ip_ok"), src=_dotted(c("l3") + 12), dst=_dotted(c("l3") + 16), version=F.when(v6, 6).otherwise(4), protocol=c("proto"),
        ttl=F.when(v6, _u(c("l3") + 7, 1)).otherwise(_u(c("l3") + 8, 1)), total_len=F.least("total", F.lit(65535)),
    )
    headers = df.select(
        "frame_no", "file_ord", "ts_ms", "ts_us", "frame_len", "orig_len", c("ok").alias("decode_ok"),
        s(c("ok"), src=_mac(6), dst=_mac(0), ethertype=c("t0")).alias("eth"), F.when(c("ok"), c("vlan")).alias("vlan"), ip.alias("ip"), c("tk").alias("tkind"),
        s(c("tk") == "tcp", src_port=c("sp"), dst_port=c("dp"), seq=_u(c("l4") + 4, 4), ack=_u(c("l4") + 8, 4), window=_u(c("l4") + 14, 2), payload_len=c("size"), flags=flags).alias("tcp"),
        s(c("tk") == "udp", src_port=c("sp"), dst_port=c("dp"), length=c("ulen"), payload_len=c("size")).alias("udp"),
        s(c("tk") == "icmp", version=F.when(v6, 6).otherwise(4), type=kind, code=code, summary=F.when(v6, _summary(kind, code, _ICMP6, "icmp6")).otherwise(_summary(kind, code, _ICMP4, "icmp"))).alias("icmp"),
        F.when(c("tk") == "other", c("proto")).alias("other_protocol"),
        s(is_arp, operation=operation, sender_mac=_mac(arp_at + 8), sender_ip=_dotted(arp_at + 14), target_mac=_mac(arp_at + 18), target_ip=_dotted(arp_at + 24)).alias("arp"),
        F.coalesce("size", F.lit(0)).alias("size"), payload.alias("payload"), "sp", "dp", six(8).alias("src6"), six(24).alias("dst6"), is_arp.alias("is_arp"),
    )
    if where is not None:
        # a field that is made anew keeps the filter from being pushed into the header expressions, which would repeat them
        headers = headers.withColumn("made", F.monotonically_increasing_id()).where((F.col("made") >= 0) & header_filter(where)).drop("made")
    found = _with_applications(headers)
    address = F.when(c("a.src").isNull(), c("ip")).otherwise(c("ip").withField("src", c("a.src")).withField("dst", c("a.dst")))
    arp = c("a.app") == "arp"
    made = found.select(
        "frame_no", "file_ord", "ts_ms", "ts_us", "frame_len", "orig_len", "decode_ok", "eth", "vlan", address.alias("ip"), "tkind", "tcp", "udp", "icmp", "other_protocol",
        c("a.app").alias("app"), "a.dns", "a.http", "a.ssh", "a.tls", F.when(arp, c("arp")).alias("arp"), "a.dhcp", F.when(arp, F.greatest("size", F.lit(28))).otherwise(c("size")).alias("payload_len"),
    )
    want = T.StructType.fromDDL(PACKET)
    packets = made.select(*[c(f.name).cast(f.dataType).alias(f.name) for f in want])
    return packets if where is None else packets.where(capture_filter(where))
