"""Columnar application parsing against the row parsers, on sound, damaged and random messages."""

import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tests import frames as f
from tracelake.sources import decode as d
from tracelake.sources.columnar import Payloads, dns_columns


def one_by_one(kind, sport, dport, m):
    """The first application that a payload is."""
    ports = {sport, dport}
    tries = []
    if kind == "udp":
        tries = [("dns", d.dns_info)] * (53 in ports) + [("dhcp", d.dhcp_info)] * bool(ports & {67, 68})
    elif kind == "tcp":
        tries = [("ssh", d.ssh_info), ("tls", d.tls_info), ("http", d.http_info)]
    return next(((name, found) for name, parse in tries if m and (found := parse(m))), (None, None))


def message(rng):
    """A DNS message of some shape."""
    name = lambda: b"".join(bytes([len(x)]) + x for x in (bytes(rng.choices(b"abc-.\xc3\xa9" if rng.random() < 0.1 else b"abcxyz09", k=rng.choice([1, 3, 63]))) for _ in range(rng.choice([0, 1, 2, 3, 5])))) + b"\0"
    asked = rng.choice([1, 1, 1, 1, 0, 2])
    body = b"".join(name() + struct.pack(">HH", rng.choice([1, 28, 65, 999]), 1) for _ in range(asked))
    counts = [rng.choice([0, 0, 1, 2, 3, 9]), rng.choice([0, 0, 0, 1]), rng.choice([0, 0, 1])]
    for i in range(sum(counts)):
        owner = rng.choice([b"\xc0\x0c"] * 6 + [b"\0", name(), b"\xc0\x0e", b"\xc0\xff"])
        kind, data = rng.choice([(1, bytes(rng.choices(range(256), k=4)))] * 6 + [(28, bytes(16)), (5, b"\xc0\x0c"), (16, b"\x04text"), (1, b"abc"), (41, b"")])
        body += owner + struct.pack(">HHIH", kind, 1, 60, len(data)) + data
    m = struct.pack(">6H", rng.randrange(1 << 16), rng.choice([0x0100, 0x8180, 0x8183]), asked, *counts) + body
    if rng.random() < 0.2:
        m = m[: rng.randrange(len(m) + 1)]
    if rng.random() < 0.2 and m:
        at = rng.randrange(len(m))
        m = m[:at] + bytes([rng.randrange(256)]) + m[at + 1 :]
    return m


@pytest.fixture(scope="module")
def out(spark):
    return to_arrow_type(T.StructType.fromDDL(d.APP))


def held_against(out, rows, cut=0):
    payload, kind, sport, dport = (pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.string(), pa.int64(), pa.int64())))
    found = d.applications(*(c.slice(cut) for c in (payload, kind, sport, dport)), out)
    columns = {name: x.column(len(rows) - cut).to_pylist() for name, x in found.items()}
    seen = set()
    for i, (m, k, s, t) in enumerate(rows[cut:]):
        name, want = one_by_one(k, s, t, m)
        got = {n: c[i] for n, c in columns.items() if c[i] is not None}
        assert got == ({name: want} if name else {}), (m, k, s, t)
        seen.add(name)
    for x in found.values():
        assert x.column(len(rows) - cut).type == x.kind
    return seen


def test_dns_shapes(out):
    rng = random.Random(11)
    for _ in range(30):
        rows = [(message(rng), "udp", 53, 40000) for _ in range(200)]
        held_against(out, rows, cut=rng.choice([0, 7]))


def test_common_dns_goes_by_columns(out):
    kind = out.field("dns").type
    sound = [f.dns(), f.dns(response=True, answer="1.2.3.4"), f.dns("a." * 60 + "b"), f.dns(response=True, rcode=3)]
    many = struct.pack(">6H", 7, 0x8180, 1, 3, 0, 1) + f.dns()[12:] + b"".join(b"\xc0\x0c" + struct.pack(">HHIH", 1, 1, 60, 4) + bytes([10, 0, 0, i]) for i in range(3)) + b"\0" + struct.pack(">HHIH", 41, 4096, 0, 0)
    p = Payloads(pa.array([None, *sound, many, b"", b"short"], pa.binary()))
    rows, structs = dns_columns(p, pa.array(range(8)).to_numpy(), kind, lambda k: d._TYPES.get(k, f"TYPE{k}"))
    assert rows.tolist() == [1, 2, 3, 4, 5] and structs.to_pylist() == [d.dns_info(m) for m in [*sound, many]]


def test_all_applications(out):
    rng = random.Random(12)
    http = b"GET /x HTTP/1.1\r\nHost: a.example\r\nAuthorization: s\r\n\r\n"
    base = [("udp", 53, f.dns()), ("udp", 68, f.dhcp()), ("udp", 53, f.dhcp()), ("tcp", 443, f.client_hello()), ("tcp", 80, f.server_hello()), ("tcp", 80, http), ("tcp", 22, b"SSH-2.0-x\r\n"), ("tcp", 80, b"HTTP/1.1 200 OK\r\n\r\n"), ("icmp", 0, http), (None, None, b"x"), ("tcp", 80, None), ("udp", 53, b""), ("udp", 53, None)]
    rows = []
    for _ in range(1500):
        kind, port, m = rng.choice(base)
        if m and rng.random() < 0.4:
            at = rng.randrange(len(m))
            m = m[:at] + bytes([rng.randrange(256)]) + m[at + 1 :] if rng.random() < 0.5 else m[:at]
        rows.append((m, kind, port, rng.choice([40000, 53, 67, None])))
    assert held_against(out, rows) == {"dns", "dhcp", "ssh", "tls", "http", None}
    held_against(out, [(None, None, None, None)] * 3)
    found = d.applications(*(pa.array([], t) for t in (pa.binary(), pa.string(), pa.int64(), pa.int64())), out)
    assert all(len(x.column(0)) == 0 for x in found.values())
