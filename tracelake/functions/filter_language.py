"""The capture filter language (a tcpdump subset) compiled to a Column over packets."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions.network import in_network

_TOKEN = re.compile(r"\s*(&&|\|\||[()!]|[^\s()!&|]+)")
_PROTOCOLS = {"ip": "ip", "ip6": "ip6", "ipv6": "ip6", "arp": "arp", "tcp": "tcp", "udp": "udp", "icmp": "icmp", "icmp6": "icmp6", "icmpv6": "icmp6"}
_FLAG_WORDS = {
    "tcp-syn": {"syn": True, "ack": False}, "tcp[syn]": {"syn": True, "ack": False}, "tcp-synack": {"syn": True, "ack": True}, "tcp-syn-ack": {"syn": True, "ack": True},
    "tcp-ack": {"ack": True}, "tcp-fin": {"fin": True}, "tcp-rst": {"rst": True}, "tcp-psh": {"psh": True}, "tcp-urg": {"urg": True},
}


class FilterError(ValueError):
    """The text is no filter."""


def _sure(predicate: Column) -> Column:
    """Two-valued: what is missing does not match, so that its negation does."""
    return F.coalesce(predicate, F.lit(False))


def _protocol(name: str) -> Column:
    version, number = F.col("ip.version"), F.col("ip.protocol")
    icmp = lambda v, p: ((F.col("tkind") == "icmp") & (F.col("icmp.version") == v)) | (number == p)
    if name in ("tcp", "udp"):
        return _sure(F.col("tkind") == name)
    if name == "arp":
        return _sure(F.col("eth.ethertype") == 0x0806) | _sure(F.col("app") == "arp")
    return _sure({"ip": version == 4, "ip6": version == 6, "icmp": icmp(4, 1), "icmp6": icmp(6, 58)}[name])


def _either(side: str | None, src: Column, dst: Column) -> Column:
    return _sure(src) | _sure(dst) if side is None else _sure(src if side == "src" else dst)


@dataclass(frozen=True)
class _Bounds:
    """What surely matches and what may match, where a packet's headers alone are known."""

    low: Column
    high: Column

    def __and__(self, other: _Bounds) -> _Bounds:
        return _Bounds(self.low & other.low, self.high & other.high)

    def __or__(self, other: _Bounds) -> _Bounds:
        return _Bounds(self.low | other.low, self.high | other.high)

    def __invert__(self) -> _Bounds:
        return _Bounds(~self.high, ~self.low)


def _by_length(predicate: Column, length: bool = False, **_) -> _Bounds:
    """Bounds of a primitive where only the length is known."""
    return _Bounds(predicate, predicate) if length else _Bounds(F.lit(False), F.lit(True))


def _by_headers(predicate: Column, app: bool = False, address: bool = False, **_) -> _Bounds:
    """Bounds of a primitive: an application isn't known yet, nor the text of an IPv6 address."""
    if app:
        return _Bounds(_sure(F.col("eth.ethertype") == 0x0806), _sure(F.col("eth.ethertype") == 0x0806) | _sure(F.col("is_arp")))
    if address:
        four = _sure(F.col("ip.version") == 4) & predicate
        return _Bounds(four, four | _sure(F.col("ip.version") == 6))
    return _Bounds(predicate, predicate)


class _Reader:
    """Recursive descent over the tokens; ``or`` binds least, then ``and``, then ``not``.

    ``leaf`` turns the predicate of a primitive into what is put together.
    """

    def __init__(self, text: str, leaf: Callable = lambda predicate, **_: predicate):
        self.leaf = leaf
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            found = _TOKEN.match(text, at)
            if not found:
                raise FilterError(f"unexpected character {text[at]!r}")
            self.tokens.append(found[1])
            at = found.end()
        self.tokens.reverse()

    @property
    def next(self) -> str:
        return self.tokens[-1].lower() if self.tokens else ""

    def take(self, what: str = "") -> str:
        if not self.tokens:
            raise FilterError(f"expected {what or 'more'}")
        return self.tokens.pop()

    def number(self, what: str, most: int | None = None) -> int:
        word = self.take(what)
        if not re.fullmatch(r"\+?\d+", word) or most is not None and int(word) > most:
            raise FilterError(f"invalid {what} {word!r}")
        return int(word)

    def any_of(self) -> Column:
        parts = [self.all_of()]
        while self.next in ("or", "||"):
            self.take()
            parts.append(self.all_of())
        return reduce(lambda a, b: a | b, parts)

    def all_of(self) -> Column:
        parts = [self.negated()]
        while self.next in ("and", "&&"):
            self.take()
            parts.append(self.negated())
        return reduce(lambda a, b: a & b, parts)

    def negated(self) -> Column:
        if self.next in ("not", "!"):
            self.take()
            return ~self.negated()
        if self.next == "(":
            self.take()
            inner = self.any_of()
            if self.take("')'") != ")":
                raise FilterError("expected ')'")
            return inner
        return self.primitive()

    def primitive(self) -> Column:
        word = self.next
        if word in ("less", "greater"):
            self.take()
            n = self.number("length")
            return self.leaf(F.col("frame_len") < n if word == "less" else F.col("frame_len") > n, length=True)
        if word in _FLAG_WORDS:
            self.take()
            wanted = [F.col(f"tcp.flags.{f}") == v for f, v in _FLAG_WORDS[word].items()]
            return self.leaf(_sure(reduce(lambda a, b: a & b, wanted)))
        if word == "vlan":
            self.take()
            if self.next.isascii() and self.next.isdigit() and int(self.next) < 1 << 16:
                return self.leaf(_sure(F.col("vlan") == self.number("VLAN id", 4095)))
            return self.leaf(F.col("vlan").isNotNull())
        parts = []
        while self.next in _PROTOCOLS:
            name = _PROTOCOLS[self.take().lower()]
            parts.append(self.leaf(_protocol(name), app=name == "arp"))
        side = self.take().lower() if self.next in ("src", "dst") else None
        if self.next in ("port", "portrange", "host", "net"):
            parts.append(self.keyed(self.take().lower(), side))
        elif not parts:
            raise FilterError(f"expected a primitive near {self.next or 'the end'!r}")
        return reduce(lambda a, b: a & b, parts)

    def keyed(self, word: str, side: str | None) -> Column:
        if word in ("port", "portrange"):
            if word == "port":
                low = high = self.number("port", 65535)
            else:
                low_, dash, high_ = self.take("portrange").partition("-")
                if not (dash and low_.isdigit() and high_.isdigit() and int(low_) <= int(high_) <= 65535):
                    raise FilterError("a portrange is N-M with N <= M")
                low, high = int(low_), int(high_)
            src, dst = F.coalesce("tcp.src_port", "udp.src_port"), F.coalesce("tcp.dst_port", "udp.dst_port")
            return self.leaf(_either(side, src.between(low, high), dst.between(low, high)))
        raw = self.take(word)
        try:
            if word == "host":
                text = str(ipaddress.ip_address(raw))
                return self.leaf(_either(side, F.col("ip.src") == text, F.col("ip.dst") == text), address=True)
            ipaddress.ip_network(raw, strict=False)
        except ValueError as e:
            raise FilterError(f"invalid {word} {raw!r}") from e
        return self.leaf(_either(side, in_network(F.col("ip.src"), [raw]), in_network(F.col("ip.dst"), [raw])), address=True)


def _parsed(text: str, *leaf: Callable):
    reader = _Reader(text, *leaf)
    found = reader.any_of()
    if reader.tokens:
        raise FilterError(f"unexpected {reader.tokens[-1]!r}")
    return found


def capture_filter(text: str) -> Column:
    """A predicate over packets; a frame that could not be decoded never matches, not even the empty filter."""
    decoded = F.coalesce(F.col("decode_ok"), F.lit(False))
    return decoded & _parsed(text) if text.strip() else decoded


def length_filter(text: str) -> Column:
    """What may match ``capture_filter(text)``, by the length (frame_len) alone."""
    return _parsed(text, _by_length).high if text.strip() else F.lit(True)


def header_filter(text: str) -> Column:
    """What may match ``capture_filter(text)``, by the headers of a packet whose application isn't parsed yet."""
    decoded = F.coalesce(F.col("decode_ok"), F.lit(False))
    return decoded & _parsed(text, _by_headers).high if text.strip() else decoded
