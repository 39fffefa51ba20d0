"""The YAML rule language: predicates over packet fields compiled to Columns, and rule packs."""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass, field, replace
from functools import reduce
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions.network import in_network, question_text
from tracelake.functions.text import truncated

#: Limits of a pack.
MAX_RULES, MAX_NODES, MAX_DETAIL, MAX_WINDOW_SECS = 64, 64, 240, 86_400
SEVERITIES = ("low", "medium", "high", "info", "critical")
#: Operators of a predicate.
OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "not_in", "contains", "starts_with", "ends_with", "exists", "in_cidr", "not_in_cidr")


class RuleError(ValueError):
    """A rule or pack breaks the language."""


# ---------------------------------------------------------------- fields
def _field_table() -> dict[str, tuple[str, Column]]:
    """Field -> (type, column); types are bool, number and string."""
    question = question_text(F.get("dns.questions", 0))
    numbers = ("payload_len", "ip.version", "ip.protocol", "ip.ttl", "tcp.src_port", "tcp.dst_port", "tcp.payload_len", "udp.src_port", "udp.dst_port", "udp.payload_len", "icmp.type", "icmp.code", "dns.rcode")
    strings = ("app", "eth.src", "eth.dst", "ip.src", "ip.dst", "http.host", "ssh.proto", "ssh.banner", "tls.version", "tls.handshake", "tls.sni", "tls.ja3", "tls.ja3_hash", "tls.ja3s", "tls.ja3s_hash", "arp.operation", "arp.sender_ip", "dhcp.message_type")
    flags = [f"tcp.flags.{f}" for f in ("syn", "ack", "fin", "rst", "psh", "urg")]
    table = {n: ("number", F.col(n)) for n in numbers} | {n: ("string", F.col(n)) for n in strings}
    table |= {n: ("bool", F.col(n)) for n in (*flags, "dns.is_query", "http.has_authorization")}
    table |= {
        "dns.qname": ("string", question),
        "dns.qname_len": ("number", F.octet_length(question)),
        "http.method": ("string", F.col("http.method_or_status")),
        "http.method_or_status": ("string", F.col("http.method_or_status")),
        "dhcp.hostname": ("string", F.col("dhcp.client_hostname")),
    }
    return table


def field_column(name: str) -> tuple[str, Column]:
    """(type, column) of a dotted path; an unknown one is a missing string."""
    return _field_table().get(name.strip().lower(), ("string", F.lit(None).cast("string")))


def display(kind: str, column: Column) -> Column:
    """A field's text: all fields that are numbers are whole."""
    return column if kind == "string" else column.cast("bigint").cast("string") if kind == "number" else column.cast("string")


# ---------------------------------------------------------------- scalars
def _scalar_number(value) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def _scalar_bool(value) -> bool | None:
    if isinstance(value, str):
        return {"true": True, "yes": True, "1": True, "false": False, "no": False, "0": False}.get(value.lower())
    return bool(value)


def _scalar_text(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)) and float(value).is_integer():
        return str(int(value))
    return str(value)


def _ascii_lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _equals(kind: str, column: Column, value) -> Column:
    if kind == "bool":
        wanted = _scalar_bool(value)
        return F.lit(False) if wanted is None else column == F.lit(wanted)
    if kind == "number":
        wanted = _scalar_number(value)
        return F.lit(False) if wanted is None else F.abs(column.cast("double") - F.lit(wanted)) < F.lit(2.0**-52)
    return _ascii_lower(column) == F.lit(_fold(_scalar_text(value)))


def _fold(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def _predicate(node: dict) -> Column:
    name = str(node.get("field") or "").strip()
    if not name:
        raise RuleError("a predicate needs a field")
    used = [o for o in OPERATORS if node.get(o) is not None]
    if len(used) != 1:
        raise RuleError(f"field {name!r} needs exactly one operator, found {len(used)}")
    op, value = used[0], node[used[0]]
    kind, column = field_column(name)
    if op == "exists":
        return column.isNotNull() == F.lit(bool(value))
    if op in ("in_cidr", "not_in_cidr"):
        try:
            nets = [str(ipaddress.ip_network(n)) for n in value]
        except ValueError:
            try:  # host bits may be set
                nets = [str(ipaddress.ip_network(n, strict=False)) for n in value if "/" in str(n)]
                if len(nets) != len(value):
                    raise ValueError(value)
            except ValueError as e:
                raise RuleError(f"invalid {op} of {name!r}: {e}") from e
        inside = in_network(column, nets) if kind == "string" else F.lit(False)
        found = inside if op == "in_cidr" else ~inside & column.isNotNull()
    elif op in ("gt", "gte", "lt", "lte"):
        number = column.cast("int").cast("double") if kind == "bool" else column.try_cast("double")
        limit = F.lit(float(value))
        found = {"gt": number > limit, "gte": number >= limit, "lt": number < limit, "lte": number <= limit}[op]
    elif op in ("contains", "starts_with", "ends_with"):
        text, part = _ascii_lower(display(kind, column)), F.lit(_fold(str(value)))
        found = {"contains": F.contains, "starts_with": F.startswith, "ends_with": F.endswith}[op](text, part)
    else:
        values = value if op in ("in", "not_in") else [value]
        found = reduce(lambda a, b: a | b, [_equals(kind, column, v) for v in values], F.lit(False))
        if op in ("ne", "not_in"):
            found = ~found
    return F.coalesce(found, F.lit(False))  # a missing field fails every operator


def compile_predicate(node: dict) -> Column:
    """A tree of and/or/not and predicates as a two-valued Column."""
    if not isinstance(node, dict):
        raise RuleError("a rule condition is a mapping")
    for word in ("and", "or"):
        if word in node:
            if not node[word]:
                raise RuleError("and/or needs at least one predicate")
            parts = [compile_predicate(x) for x in node[word]]
            return reduce((lambda a, b: a & b) if word == "and" else (lambda a, b: a | b), parts)
    return ~compile_predicate(node["not"]) if "not" in node else _predicate(node)


def count_nodes(node: dict) -> int:
    for word in ("and", "or"):
        if word in node:
            return 1 + sum(map(count_nodes, node[word]))
    return 1 + count_nodes(node["not"]) if "not" in node else 1


# ---------------------------------------------------------------- detail templates
#: Fields that a template expands.
TEMPLATE_FIELDS = ("ip.src", "ip.dst", "tcp.src_port", "tcp.dst_port", "udp.src_port", "udp.dst_port", "app", "dns.qname", "http.host", "http.method", "tls.sni", "tls.version", "tls.ja3", "tls.ja3_hash", "tls.ja3s", "tls.ja3s_hash", "ssh.banner", "dhcp.message_type")


def detail_column(template: str) -> Column:
    """The template with its fields filled in, ``-`` where one is missing; counts stay as they are."""
    parts = re.split("(" + "|".join(re.escape("{" + f + "}") for f in TEMPLATE_FIELDS) + ")", template)
    columns = []
    for part in parts:
        name = part[1:-1]
        if part.startswith("{") and name in TEMPLATE_FIELDS:
            columns.append(F.coalesce(display(*field_column(name)), F.lit("-")))
        elif part:
            columns.append(F.lit(part))
    return F.concat(*columns) if columns else F.lit("")


def limited_detail(detail: Column) -> Column:
    return truncated(detail, MAX_DETAIL)


# ---------------------------------------------------------------- rules and packs
_ONCE = {"none": "none", "every": "none", "always": "none", "once": "once", "global": "once", "per_src": "per_src", "persrc": "per_src", "src": "per_src"}
_TRACK = {"by_src": "src", "src": "src", "source": "src", "by_dst": "dst", "dst": "dst", "dest": "dst", "destination": "dst", "by_pair": "pair", "pair": "pair", "flow": "pair", "global": "all", "all": "all"}


@dataclass(frozen=True)
class Correlation:
    window_secs: int
    track: str = "src"
    count: int | None = None
    unique_field: str | None = None
    unique_count: int | None = None


@dataclass(frozen=True)
class CustomRule:
    id: str
    severity: str
    detail: str
    once: str
    when: dict
    correlate: Correlation | None = None


def _correlation(rule: str, raw: dict) -> Correlation:
    window, count = int(raw.get("window_secs", 0)), raw.get("count")
    unique, least = (raw.get("unique_field") or "").strip().lower() or None, raw.get("unique_count")
    track = _TRACK.get(str(raw.get("track", "by_src")).strip().lower())
    if not 0 < window <= MAX_WINDOW_SECS:
        raise RuleError(f"{rule}: window_secs must be 1 to {MAX_WINDOW_SECS}")
    if track is None:
        raise RuleError(f"{rule}: unknown track")
    if count is None and unique is None or count is not None and int(count) < 1:
        raise RuleError(f"{rule}: correlate needs count > 0 or unique_field")
    if (unique is None) != (least is None) or least is not None and int(least) < 1:
        raise RuleError(f"{rule}: unique_field and unique_count > 0 go together")
    return Correlation(window, track, count and int(count), unique, least and int(least))


def compile_rule(raw: dict) -> CustomRule:
    rule = str(raw.get("id") or "").strip()
    if not re.fullmatch(r"[A-Za-z0-9_-]{1,64}", rule):
        raise RuleError(f"invalid rule id {rule!r}")
    severity = str(raw.get("severity", "medium")).strip().lower()
    if severity not in SEVERITIES:
        raise RuleError(f"{rule}: unknown severity {severity!r}")
    once = _ONCE.get(str(raw.get("once", "per_src")).strip().lower())
    if once is None:
        raise RuleError(f"{rule}: once is none, once or per_src")
    when = raw.get("when")
    if not isinstance(when, dict) or not 0 < count_nodes(when) <= MAX_NODES:
        raise RuleError(f"{rule}: the condition is empty or has more than {MAX_NODES} nodes")
    compile_predicate(when)  # checks it
    detail = next((x for x in (raw.get("detail"), raw.get("description")) if x and str(x).strip()), f"custom rule {rule} matched")
    return CustomRule(rule, severity, str(detail), once, when, _correlation(rule, raw["correlate"]) if raw.get("correlate") else None)


def compile_rules(raws: list[dict]) -> list[CustomRule]:
    if len(raws) > MAX_RULES:
        raise RuleError(f"more than {MAX_RULES} custom rules")
    rules = [compile_rule(r) for r in raws]
    if len({r.id.lower() for r in rules}) < len(rules):
        raise RuleError("duplicate rule id")
    return rules


#: Ports that are rarely used in earnest.
RARE_PORTS = frozenset((1337, 4443, 4444, 5555, 6666, 8888, 9999, 12345, 31337, 65000))


@dataclass(frozen=True)
class DetectConfig:
    """Thresholds; ``window_ms`` None is one window over the whole input."""

    syn_scan_ports: int = 15
    host_sweep_hosts: int = 20
    dns_unique_names: int = 40
    dns_long_name: int = 60
    icmp_echo_count: int = 50
    tcp_rst_count: int = 40
    dhcp_discover_count: int = 20
    dns_nxdomain_count: int = 30
    window_ms: int | None = 30_000
    rare_ports: frozenset[int] = RARE_PORTS
    disabled: frozenset[str] = frozenset()
    custom_rules: tuple[CustomRule, ...] = field(default_factory=tuple)
    cooldown_ms: int = 0


def apply_pack(raw: dict, base: DetectConfig | None = None) -> DetectConfig:
    """A rule pack over the defaults."""
    base = base or DetectConfig()
    if not isinstance(raw, dict) or not str(raw.get("name") or "").strip():
        raise RuleError("a pack needs a name")
    thresholds = {k: v for k, v in (raw.get("thresholds") or {}).items() if v is not None}
    unknown = set(thresholds) - {f for f in DetectConfig.__dataclass_fields__ if f.split("_")[-1] in ("ports", "hosts", "names", "name", "count")}
    if unknown or any(int(v) < 1 for v in thresholds.values()):
        raise RuleError(f"invalid thresholds {sorted(unknown) or thresholds}")
    changed: dict = {k: int(v) for k, v in thresholds.items()}
    if raw.get("window_secs") is not None:
        if int(raw["window_secs"]) < 1:
            raise RuleError("window_secs must be above 0")
        changed["window_ms"] = int(raw["window_secs"]) * 1000
    if raw.get("alert_cooldown_ms") is not None:
        changed["cooldown_ms"] = int(raw["alert_cooldown_ms"])
    ports = frozenset(int(p) for p in raw.get("rare_ports") or ())
    if ports:
        mode = str(raw.get("rare_ports_mode") or "replace").lower()
        if mode not in ("replace", "merge"):
            raise RuleError("rare_ports_mode is replace or merge")
        changed["rare_ports"] = ports if mode == "replace" else base.rare_ports | ports
    if raw.get("disabled_rules"):
        changed["disabled"] = base.disabled | {str(r).strip().lower() for r in raw["disabled_rules"]}
    if raw.get("custom_rules"):
        changed["custom_rules"] = tuple(compile_rules(raw["custom_rules"]))
    return replace(base, **changed)


def load_pack(path: str, base: DetectConfig | None = None) -> DetectConfig:
    import yaml

    return apply_pack(yaml.safe_load(Path(path).read_text()), base)
