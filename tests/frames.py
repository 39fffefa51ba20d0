"""Hand-built frames."""

import struct


def eth(payload, ethertype=0x0800, tags=()):
    head = b"\xbb" * 6 + b"\xaa" * 6
    for vid in tags:
        head += struct.pack(">HH", 0x8100, vid)
    return head + struct.pack(">H", ethertype) + payload


def ip4(payload, proto, src="10.0.0.1", dst="10.0.0.2", flags=0):
    pack = lambda a: bytes(map(int, a.split(".")))
    return struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(payload), 1, flags, 64, proto, 0) + pack(src) + pack(dst) + payload


def ip6(payload, proto):
    return struct.pack(">IHBB", 6 << 28, len(payload), proto, 63) + bytes(15) + b"\x01" + b"\x20\x01\x0d\xb8" + bytes(11) + b"\x02" + payload


def tcp(payload=b"", sport=1000, dport=80, flags=0x10):
    return struct.pack(">HHIIBBHHH", sport, dport, 1, 0, 5 << 4, flags, 64240, 0, 0) + payload


def udp(payload=b"", sport=53000, dport=53):
    return struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload


def dns(name="example.com", response=False, rcode=0, answer=None):
    q = b"".join(bytes([len(x)]) + x.encode() for x in name.split(".")) + b"\0" + struct.pack(">HH", 1, 1)
    a = b"\xc0\x0c" + struct.pack(">HHIH", 1, 1, 60, 4) + bytes(map(int, answer.split("."))) if answer else b""
    return struct.pack(">6H", 0x42, (0x8000 if response else 0x0100) | rcode, 1, 1 if answer else 0, 0, 0) + q + a


def client_hello(sni="lab.example", grease=False):
    name = sni.encode()
    ext = lambda t, d: struct.pack(">HH", t, len(d)) + d
    exts = (ext(0x0A0A, b"") if grease else b"") + ext(0, struct.pack(">HBH", len(name) + 3, 0, len(name)) + name) + ext(10, struct.pack(">HH", 2, 23)) + ext(11, b"\x01\x00")
    ciphers = (b"\x1a\x1a" if grease else b"") + b"\x00\x2f"
    body = b"\x03\x03" + bytes(32) + b"\0" + struct.pack(">H", len(ciphers)) + ciphers + b"\x01\x00" + struct.pack(">H", len(exts)) + exts
    hs = b"\x01" + len(body).to_bytes(3) + body
    return b"\x16\x03\x01" + struct.pack(">H", len(hs)) + hs


def server_hello():
    exts = struct.pack(">HH", 0xFF01, 1) + b"\0" + struct.pack(">HH", 11, 2) + b"\x01\x00"
    body = b"\x03\x03" + bytes(32) + b"\0" + b"\xc0\x2f" + b"\0" + struct.pack(">H", len(exts)) + exts
    hs = b"\x02" + len(body).to_bytes(3) + body
    return b"\x16\x03\x03" + struct.pack(">H", len(hs)) + hs


def arp(op=1, mac=b"\xaa" * 6):
    return struct.pack(">HHBBH", 1, 0x0800, 6, 4, op) + mac + bytes([10, 0, 0, 1]) + bytes(6) + bytes([10, 0, 0, 2])


def dhcp(kind=1, host=b"pc1"):
    head = bytes([1, 1, 6, 0]) + b"\x11\x11\x22\x22" + bytes(20) + b"\xaa" * 6 + bytes(10) + bytes(192) + b"\x63\x82\x53\x63"
    return head + bytes([53, 1, kind, 12, len(host)]) + host + bytes([50, 4, 10, 0, 0, 9, 255])


def syn_scan(n=20, src="10.0.0.9"):
    return [eth(ip4(tcp(sport=4000, dport=p, flags=2), 6, src)) for p in range(1, n + 1)]
