"""Addresses, ports, flags and packet lines as Spark columns."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from tracelake.schema import FLAGS

#: Well-known ports.
SERVICES = {
    20: "ftp-data", 21: "ftp", 22: "ssh", 23: "telnet", 25: "smtp", 53: "domain", 67: "bootps", 68: "bootpc", 69: "tftp", 80: "http",
    110: "pop3", 123: "ntp", 143: "imap", 161: "snmp", 162: "snmptrap", 179: "bgp", 389: "ldap", 443: "https", 445: "microsoft-ds", 465: "smtps",
    500: "isakmp", 514: "syslog", 520: "route", 587: "submission", 636: "ldaps", 853: "domain-s", 989: "ftps-data", 990: "ftps", 993: "imaps", 995: "pop3s",
    1080: "socks", 1194: "openvpn", 1433: "ms-sql-s", 1521: "oracle", 1883: "mqtt", 2049: "nfs", 3306: "mysql", 3389: "ms-wbt-server", 5432: "postgresql", 5900: "vnc",
    6379: "redis", 6443: "https-alt", 8080: "http-alt", 8443: "https-alt", 8888: "http-alt", 9200: "wap-wsp", 9443: "https-alt", 11211: "memcache", 27017: "mongodb",
}

_V4 = r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$"


def v4_number(address: Column) -> Column:
    """IPv4 text as a number; null for anything else."""
    part = lambda i: F.split_part(address, F.lit("."), F.lit(i)).try_cast("long")
    return F.when(address.rlike(_V4), ((part(1) * 256 + part(2)) * 256 + part(3)) * 256 + part(4))


@F.pandas_udf(BinaryType())
def _packed(address: pd.Series) -> pd.Series:
    def one(text):
        try:
            return ipaddress.ip_address(text).packed
        except ValueError:
            return None

    return address.map(one, na_action="ignore")


def in_network(address: Column, networks: list[str]) -> Column:
    """Whether an address text lies in one of the networks; false for null and for other text.

    IPv4 networks compare numbers; only IPv6 networks need the address parsed in Python.
    """
    nets = [ipaddress.ip_network(n, strict=False) for n in networks]
    found = F.lit(False)
    for net in (n for n in nets if n.version == 4):
        found = found | v4_number(address).between(F.lit(int(net.network_address)), F.lit(int(net.broadcast_address)))
    for net in (n for n in nets if n.version == 6):
        six = F.when(address.contains(":"), _packed(address))
        found = found | six.between(F.lit(bytearray(net.network_address.packed)), F.lit(bytearray(net.broadcast_address.packed)))
    return F.coalesce(found, F.lit(False))


def service_name(port: Column) -> Column:
    """Service of a well-known port, else null: one literal map in the plan, no join."""
    table = F.create_map(*[x for p, n in SERVICES.items() for x in (F.lit(p), F.lit(n))])
    return F.try_element_at(table, port.cast("int"))


def port_text(port: Column, numeric: bool = False) -> Column:
    text = port.cast("string")
    return text if numeric else F.coalesce(service_name(port), text)


def services(spark) -> DataFrame:
    """The port dimension; its size is fixed."""
    return spark.createDataFrame(list(SERVICES.items()), "port int, service string")


def flag_label(flags: Column) -> Column:
    """``SYN,ACK`` or ``.`` for a struct of flags."""
    names = F.array_compact(F.array(*[F.when(flags[f], F.lit(f.upper())) for f in FLAGS]))
    return F.when(flags.isNotNull(), F.when(F.size(names) == 0, F.lit(".")).otherwise(F.array_join(names, ",")))


def mac_text(mac: Column) -> Column:
    return F.regexp_replace(F.lower(F.hex(mac)), "(..)(?!$)", "$1:")


def ethertype_name(ethertype: Column) -> Column:
    known = F.when(ethertype == 0x0800, "IPv4").when(ethertype == 0x0806, "ARP").when(ethertype == 0x86DD, "IPv6").when(ethertype == 0x8100, "802.1Q")
    return known.otherwise(F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(ethertype.cast("long"))), 4, "0")))


def question_text(question: Column) -> Column:
    return F.concat_ws(" ", question["name"], question["type"])


def endpoint(address: Column, port: Column, numeric: bool) -> Column:
    return F.when(port.isNull(), address).otherwise(F.concat(address, F.lit("."), port_text(port, numeric)))


def packet_line(numeric: bool = False) -> Column:
    """A tcpdump-like line of a packet row."""
    c = F.col
    sport, dport = F.coalesce("tcp.src_port", "udp.src_port"), F.coalesce("tcp.dst_port", "udp.dst_port")
    version = F.when(c("ip.version") == 6, "IP6").otherwise("IP")
    ends = F.concat(version, F.lit(" "), endpoint(c("ip.src"), sport, numeric), F.lit(" > "), endpoint(c("ip.dst"), dport, numeric), F.lit(": "))
    dns = F.concat(F.lit("DNS "), F.when(c("dns.is_query"), "query ").otherwise("response "), F.coalesce(F.array_join(F.transform("dns.questions", question_text), ", "), F.lit("")))
    app = (
        F.when(c("app") == "dns", dns)
        .when(c("app") == "http", F.concat(F.lit("HTTP "), c("http.summary")))
        .when(c("app") == "tls", F.concat_ws(" ", F.lit("TLS"), c("tls.version"), c("tls.handshake"), c("tls.sni")))
        .when(c("app") == "ssh", F.concat(F.lit("SSH "), c("ssh.banner")))
        .when(c("app") == "dhcp", F.concat(F.lit("DHCP "), c("dhcp.message_type")))
    )
    transport = (
        F.when(c("tkind") == "tcp", F.concat(F.lit("TCP Flags ["), flag_label(c("tcp.flags")), F.lit("], seq "), c("tcp.seq").cast("string"), F.lit(", length "), c("tcp.payload_len").cast("string")))
        .when(c("tkind") == "udp", F.concat(F.lit("UDP, length "), c("udp.payload_len").cast("string")))
        .when(c("tkind") == "icmp", F.concat(F.lit("ICMP "), c("icmp.summary")))
        .otherwise(F.concat(F.lit("proto "), F.coalesce(c("ip.protocol").cast("string"), F.lit("?"))))
    )
    arp = F.concat(F.lit("ARP "), c("arp.operation"), F.lit(" "), c("arp.sender_ip"), F.lit(" > "), c("arp.target_ip"))
    return F.when(c("app") == "arp", arp).when(c("ip").isNotNull(), F.concat(ends, F.concat_ws(" | ", transport, app))).otherwise(
        F.concat(F.lit("frame, length "), c("frame_len").cast("string"))
    )


@F.pandas_udf(StringType())
def hex_dump(data: pd.Series) -> pd.Series:
    """Offsets, hex bytes and ASCII, 16 bytes a line (for display)."""

    def one(raw: bytes) -> str:
        lines = []
        for at in range(0, len(raw), 16):
            part = raw[at : at + 16]
            ascii_ = "".join(chr(b) if 32 <= b < 127 else "." for b in part)
            lines.append(f"0x{at:04x}:  {part.hex(' ', 2):<40}  {ascii_}")
        return "\n".join(lines)

    return data.map(one, na_action="ignore")


@F.pandas_udf(StringType())
def ascii_dump(data: pd.Series) -> pd.Series:
    """Printable ASCII, 72 columns a line (for display)."""

    def one(raw: bytes) -> str:
        text = "".join(chr(b) if 32 <= b < 127 else "." for b in raw)
        return "\n".join(text[i : i + 72] for i in range(0, len(text), 72))

    return data.map(one, na_action="ignore")
