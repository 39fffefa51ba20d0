"""Scope files and shared sessions: small JSON state that a driver keeps."""

from __future__ import annotations

import ipaddress
import itertools
import json
import time
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators.lookup import allowed_addresses, cidr_ranges, expand_hosts


class ScopeError(ValueError):
    """A scope does not allow what is asked."""


@dataclass(frozen=True)
class Scope:
    ticket_id: str
    operator: str
    organization: str = ""
    authorized: bool = False
    targets: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    ports: tuple[int, ...] = ()
    max_hosts: int = 256
    valid_until_unix: int | None = None

    @classmethod
    def load(cls, path: str, now: float | None = None) -> Scope:
        raw = json.loads(Path(path).read_text())
        fields = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in cls.__dataclass_fields__}
        scope = cls(**fields)
        scope.validate(now)
        return scope

    def validate(self, now: float | None = None) -> None:
        if not self.authorized:
            raise ScopeError("the scope is not authorized")
        if not self.ticket_id.strip() or not self.operator.strip() or not self.targets:
            raise ScopeError("a scope needs a ticket, an operator and targets")
        if self.valid_until_unix is not None and (time.time() if now is None else now) > self.valid_until_unix:
            raise ScopeError("the scope has expired")
        for n in (*self.targets, *self.exclude):
            try:
                ipaddress.ip_network(n, strict=False)
            except ValueError as e:
                raise ScopeError(str(e)) from e

    def allows(self):
        """A predicate over an address column."""
        return allowed_addresses(list(self.targets), list(self.exclude))

    def hosts(self, spark) -> DataFrame:
        """The scope's hosts (host, number), IPv4 first; number is null for an IPv6 host.

        More than ``max_hosts`` after the exclusions, or none, is an error.
        """
        four, six = ([t for t in names if ipaddress.ip_network(t, strict=False).version == v] for names, v in ((self.targets, 4), (self.targets, 6)))
        out4, out6 = ([t for t in self.exclude if ipaddress.ip_network(t, strict=False).version == v] for v in (4, 6))
        hosts = expand_hosts(cidr_ranges(spark, four), cidr_ranges(spark, out4), self.max_hosts)
        # IPv6 networks can't be filed as ranges of longs; exclusions are cut out of them first, and the cap bounds what is listed
        gone = [ipaddress.ip_network(n, strict=False) for n in out6]
        few: set = set()
        for target in (ipaddress.ip_network(t, strict=False) for t in six):
            anycast = target.network_address if target.prefixlen < 127 else None  # a router's, no host's
            listed = (a for n in remaining(target, gone) for a in n if a != anycast and a not in few)
            few.update(itertools.islice(listed, self.max_hosts + 1 - len(few)))
        few = sorted(few)
        total = len(few) + hosts.count()
        if total > self.max_hosts:
            raise ValueError(f"the scope has more than {self.max_hosts} hosts")
        if not total:
            raise ScopeError("no hosts remain after the exclusions")
        more = spark.createDataFrame([(i, str(a)) for i, a in enumerate(few)], "place int, host string")
        both = hosts.select("host", "number", F.lit(-1).alias("place")).unionByName(more.select("host", F.lit(None).cast("long").alias("number"), "place"))
        return both.orderBy("place", "number").select("host", "number")



def remaining(network, gone: list) -> list:
    """What is left of a network without others, as networks in order."""
    left = [network]
    for g in gone:
        left = [part for n in left if not n.subnet_of(g) for part in (n.address_exclude(g) if g.subnet_of(n) else [n])]
    return sorted(left)


@dataclass
class Session:
    """Members of an engagement, and its notes and alerts as JSON lines, in one folder."""

    folder: str
    ticket_id: str
    allowed: list[str] = field(default_factory=list)
    members: dict[str, dict] = field(default_factory=dict)

    @classmethod
    def create(cls, folder: str, ticket_id: str, operator: str, allowed: list[str] = ()) -> Session:
        if (Path(folder) / "session.json").exists():
            raise ValueError("a session is there already")
        session = cls(folder, ticket_id, list(allowed))
        session.join(operator, ticket_id)
        return session

    @classmethod
    def load(cls, folder: str) -> Session:
        return cls(folder, **json.loads((Path(folder) / "session.json").read_text()))

    def _save(self) -> None:
        Path(self.folder).mkdir(parents=True, exist_ok=True)
        state = {k: v for k, v in asdict(self).items() if k != "folder"}
        (Path(self.folder) / "session.json").write_text(json.dumps(state, indent=2))

    def _check(self, ticket_id: str) -> None:
        if ticket_id != self.ticket_id:
            raise ValueError("the ticket differs from the session's")

    def join(self, operator: str, ticket_id: str, now_ms: int | None = None) -> None:
        self._check(ticket_id)
        if self.allowed and operator not in self.allowed:
            raise ValueError(f"{operator} is not on the session's list")
        now = int(time.time() * 1000) if now_ms is None else now_ms
        self.members[operator] = {"joined_ms": self.members.get(operator, {}).get("joined_ms", now), "last_seen_ms": now, "left": False}
        self._save()

    def heartbeat(self, operator: str, ticket_id: str, now_ms: int | None = None) -> None:
        self._check(ticket_id)
        if operator not in self.members:
            raise ValueError(f"{operator} has not joined")
        self.members[operator] |= {"last_seen_ms": int(time.time() * 1000) if now_ms is None else now_ms, "left": False}
        self._save()

    def leave(self, operator: str) -> None:
        self.members[operator]["left"] = True
        self._save()

    def _append(self, name: str, row: dict) -> None:
        Path(self.folder).mkdir(parents=True, exist_ok=True)
        with open(Path(self.folder) / name, "a") as f:
            f.write(json.dumps(row) + "\n")

    def add_note(self, operator: str, text: str) -> None:
        self._append("notes.jsonl", {"ts_unix_ms": int(time.time() * 1000), "operator": operator, "ticket_id": self.ticket_id, "text": text})

    def add_alert(self, operator: str, module: str, alert: dict) -> None:
        self._append("alerts.jsonl", {"ts_unix_ms": int(time.time() * 1000), "operator": operator, "module": module, "alert": alert})

    def table(self, spark) -> DataFrame:
        """(name, joined_ms, last_seen_ms, left), for session_presence."""
        rows = [(n, m["joined_ms"], m["last_seen_ms"], m["left"]) for n, m in self.members.items()]
        return spark.createDataFrame(rows, "name string, joined_ms long, last_seen_ms long, left boolean")
