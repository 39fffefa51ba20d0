import hashlib
import struct

import pytest

from tests import frames as f
from tracelake.functions.filter_language import FilterError, capture_filter
from tracelake.functions.network import ascii_dump, hex_dump, packet_line
from tracelake.schema import FRAME
from tracelake.sources.captures import CaptureError, FrameWriter, read_capture, read_frames, write_capture
from tracelake.sources.decode import decode

HTTP = b"GET / HTTP/1.1\r\nHost: example.com\r\nAuthorization: Basic c2VjcmV0\r\n\r\n"


def table(spark, raws, t0=1_700_000_000):
    return spark.createDataFrame([(0, i + 1, t0 + i, 123456, len(r), bytearray(r)) for i, r in enumerate(raws)], FRAME)


@pytest.fixture(scope="module")
def mixed(spark):
    raws = {
        "dns": f.eth(f.ip4(f.udp(f.dns()), 17)),
        "reply": f.eth(f.ip4(f.udp(f.dns(response=True, rcode=3, answer="1.2.3.4"), 53, 53000), 17)),
        "http": f.eth(f.ip4(f.tcp(HTTP, 49152, 80), 6)),
        "ssh": f.eth(f.ip4(f.tcp(b"SSH-2.0-OpenSSH_9.6\r\n", 22, 49200), 6)),
        "tls": f.eth(f.ip4(f.tcp(f.client_hello(), 49300, 443), 6)),
        "grease": f.eth(f.ip4(f.tcp(f.client_hello(grease=True), 49300, 443), 6)),
        "server": f.eth(f.ip4(f.tcp(f.server_hello(), 443, 49300), 6)),
        "arp": f.eth(f.arp(), 0x0806),
        "dhcp": f.eth(f.ip4(f.udp(f.dhcp(), 68, 67), 17)),
        "vlan": f.eth(f.ip4(f.udp(b"x", 53, 53000), 17), tags=(100,)),
        "double": f.eth(f.ip4(f.tcp(), 6), tags=(7, 8)),
        "six": f.eth(f.ip6(f.udp(f.dns("a.b")), 17), 0x86DD),
        "six_ext": f.eth(f.ip6(bytes([6, 0]) + bytes(6) + f.tcp(dport=99), 0), 0x86DD),
        "icmp": f.eth(f.ip4(bytes([8, 0]) + bytes(6), 1)),
        "fragment": f.eth(f.ip4(f.tcp(), 6, flags=0x2000)),
        "gre": f.eth(f.ip4(b"abc", 47)),
        "short": b"\xff" * 8,
        "lying": f.eth(f.ip4(f.tcp(), 6))[:40],
        "udp_long": f.eth(f.ip4(struct.pack(">HHHH", 1, 2, 99, 0), 17)),
        "empty": b"",
    }
    rows = {r.frame_no: r for r in decode(table(spark, raws.values())).collect()}
    return {name: rows[i + 1] for i, name in enumerate(raws)}


def test_applications(mixed):
    assert mixed["dns"].app == "dns" and mixed["dns"].dns.is_query and mixed["dns"].dns.questions[0].name == "example.com" and mixed["dns"].dns.id == 0x42
    assert not mixed["reply"].dns.is_query and mixed["reply"].dns.rcode == 3 and "1.2.3.4" in mixed["reply"].dns.answers[0]
    h = mixed["http"].http
    assert (h.method_or_status, h.host, h.has_authorization) == ("GET", "example.com", True) and "c2VjcmV0" not in str(mixed["http"])
    assert mixed["ssh"].ssh.proto == "2.0" and mixed["ssh"].ssh.banner == "SSH-2.0-OpenSSH_9.6"
    assert mixed["arp"].arp.operation == "request" and mixed["arp"].payload_len == 28 and mixed["arp"].ip is None and mixed["arp"].tkind is None
    d = mixed["dhcp"].dhcp
    assert (d.message_type, d.xid, d.client_hostname, d.requested_ip, d.client_mac, d.client_ip) == ("discover", 0x11112222, "pc1", "10.0.0.9", "aa:aa:aa:aa:aa:aa", None)


def test_tls_fingerprints(mixed):
    t = mixed["tls"].tls
    assert t.sni == "lab.example" and t.ja3 == "771,47,0-10-11,23,0" and t.version == "TLS1.2"
    assert t.ja3_hash == hashlib.md5(t.ja3.encode()).hexdigest()
    assert mixed["grease"].tls.ja3 == t.ja3
    assert mixed["server"].tls.ja3s == "771,49199,65281-11" and mixed["server"].tls.cipher_suite == "0xc02f"


def test_layers(mixed):
    assert mixed["http"].ip.src == "10.0.0.1" and mixed["http"].ip.ttl == 64 and mixed["http"].tcp.flags.ack and not mixed["http"].tcp.flags.syn
    assert mixed["vlan"].vlan == 100 and mixed["vlan"].eth.ethertype == 0x8100 and mixed["double"].vlan == 7 and mixed["double"].tkind == "tcp"
    assert mixed["six"].ip.src == "::1" and mixed["six"].ip.dst == "2001:db8::2" and mixed["six"].app == "dns" and mixed["six"].ip.ttl == 63
    assert mixed["six_ext"].tkind == "tcp" and mixed["six_ext"].tcp.dst_port == 99 and mixed["six_ext"].ip.protocol == 0
    assert mixed["icmp"].icmp.summary == "echo-request type=8 code=0"
    assert mixed["fragment"].tkind == "other" and mixed["fragment"].other_protocol == 6 and mixed["gre"].other_protocol == 47
    for bad in ("short", "lying", "udp_long", "empty"):
        assert not mixed[bad].decode_ok and mixed[bad].ip is None and mixed[bad].app is None, bad


def test_filters_on_frames(spark):
    p = decode(table(spark, [f.eth(f.ip4(f.udp(b"x", 53, 53000), 17), tags=(100,)), f.eth(f.ip6(f.tcp(dport=443), 6), 0x86DD), b"\xff" * 8])).cache()
    hits = lambda t: [r[0] for r in p.where(capture_filter(t)).orderBy("frame_no").select("frame_no").collect()]
    assert hits("vlan 100 and udp") == [1] and hits("vlan") == [1] and hits("not vlan") == [2]
    assert hits("ip6 dst net 2001:db8::/32") == [2] and hits("host ::1") == [2] and hits("TCP PORT 443") == [2]
    assert hits("") == [1, 2] and hits("not udp") == [2] and hits("udp src port 53 or (tcp && greater 1000)") == [1]
    assert hits("ip and udp dst portrange 53000-53001") == [1] and hits("less 60") == [1]


def test_a_filter_given_to_the_decoder(spark):
    """Headers leave out only what the whole filter leaves out, and leave it out before applications are parsed."""
    raws = [
        f.eth(f.ip4(f.udp(f.dns()), 17), tags=(100,)), f.eth(f.ip6(f.tcp(dport=443), 6), 0x86DD), b"\xff" * 8, f.eth(f.arp(), 0x0806), f.eth(f.arp()), f.eth(f.arp(), 0x0806, (5,)), f.eth(f.ip4(f.tcp(f.client_hello()), 6)),
        f.eth(f.ip6(f.udp(f.dns()), 17), 0x86DD), f.eth(f.ip4(bytes(8), 1)), f.eth(f.ip4(f.tcp(flags=2), 6, "9.9.9.9")), f.eth(f.ip4(f.udp(f.dhcp(), 68, 67), 17)), f.eth(bytes(60), 0x88CC),
    ]
    frames = table(spark, raws)
    packets = decode(frames)
    texts = ["", "arp", "not arp", "host ::1", "not host ::1", "src host 9.9.9.9 or arp", "not (net 10.0.0.0/8 or arp)", "not (arp and less 60)", "ip6 and not dst net 2001:db8::/32", "! vlan && !(src host ::1 or tcp)", "udp port 53 and greater 70", "tcp-syn or not ip"]
    for text in texts:
        want = sorted(r.frame_no for r in packets.where(capture_filter(text)).collect())
        assert sorted(r.frame_no for r in decode(frames, text).collect()) == want, text
    plan = decode(frames, "udp port 53 and greater 70")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" in plan.split("MapInArrow")[-1]
    with pytest.raises(FilterError):
        decode(frames, "udp or")


@pytest.mark.parametrize("text", ["port", "port x", "port 70000", "udp or", "(udp", "udp)", "portrange 9-3", "vlan 5000", "host 1.2.3", "net 1.2.3.4/99", "bogus", "less", "&"])
def test_bad_filters(spark, text):
    with pytest.raises(FilterError):
        capture_filter(text)


def test_round_trip(spark, tmp_path):
    raws = [f.eth(f.ip4(f.udp(f.dns()), 17)), b"abc", f.eth(f.arp(), 0x0806)]
    frames = table(spark, raws)
    for variant in ("pcap", "pcapng"):
        path = str(tmp_path / variant)
        write_capture(frames, path, variant, single=True)
        back = read_capture(spark, path).orderBy("frame_no").collect()
        assert [(r.ts_secs, r.ts_usecs, r.orig_len, bytes(r.data)) for r in back] == [(1_700_000_000 + i, 123456, len(x), x) for i, x in enumerate(raws)]


def test_formats(tmp_path):
    ng = tmp_path / "x.pcapng"
    with open(ng, "wb") as out:
        w = FrameWriter(out, True)
        w._block(1, struct.pack("<HHI", 1, 0, 0) + struct.pack("<HHBBBB", 9, 1, 9, 0, 0, 0))  # interface 1 counts nanoseconds
        w._block(6, struct.pack("<IIIII", 1, *divmod(5_000_000_700_000, 1 << 32), 2, 9) + b"hi")
        w._block(3, struct.pack("<I", 2) + b"yo")
        w._block(99, b"skip")
    with open(ng, "rb") as s:
        assert list(read_frames(s)) == [(5000, 700, 9, b"hi"), (0, 0, 2, b"yo")]
    big = tmp_path / "big.pcap"
    big.write_bytes(struct.pack(">IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + struct.pack(">IIII", 7, 8, 2, 3) + b"ab" + b"\0" * 5)
    with open(big, "rb") as s:
        assert list(read_frames(s)) == [(7, 8, 3, b"ab")]
    for bad in (b"", b"\x4d\x3c\xb2\xa1" + b"\0" * 20, struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 1, 1) + struct.pack("<IIII", 1, 1, 9, 9) + b"x"):
        p = tmp_path / "bad"
        p.write_bytes(bad)
        with open(p, "rb") as s, pytest.raises(CaptureError):
            list(read_frames(s))


def test_lenient_and_ordinals(spark, tmp_path):
    for name, extra in (("a", b""), ("b", struct.pack("<IIII", 1, 1, 9, 9) + b"x")):
        with open(tmp_path / f"{name}.pcap", "wb") as out:
            FrameWriter(out, False).write(1, 2, 3, b"abc")
            out.write(extra)
    rows = read_capture(spark, str(tmp_path), lenient=True).collect()
    assert sorted((r.file_ord, r.frame_no, bytes(r.data)) for r in rows) == [(0, 1, b"abc"), (1, 1, b"abc")]


def test_lines_and_dumps(spark):
    p = decode(table(spark, [f.eth(f.ip4(f.udp(f.dns()), 17)), f.eth(f.arp(), 0x0806), b"zz"]))
    lines = [r[0] for r in p.orderBy("frame_no").select(packet_line()).collect()]
    assert lines[0].startswith("IP 10.0.0.1.53000 > 10.0.0.2.domain: UDP") and "example.com" in lines[0] and lines[1].startswith("ARP request")
    d = table(spark, [b"Hello\x00World" * 2]).select(hex_dump("data"), ascii_dump("data")).first()
    assert d[0].splitlines()[0].startswith("0x0000:  4865 6c6c 6f00") and d[1].startswith("Hello.World")
