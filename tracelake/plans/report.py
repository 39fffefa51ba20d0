"""Evidence packs: small results of the operators rendered as JSON, Markdown or HTML on the driver."""

from __future__ import annotations

import html
import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame

from tracelake.operators import stats, timeline

TEMPLATES = {"full": "full", "technical": "full", "executive": "executive", "exec": "executive", "summary": "executive", "compact": "compact", "short": "compact"}
TOP_RULES, EXECUTIVE_EVENTS = 8, 8


@dataclass
class Pack:
    """What a report shows; every part is bounded by the operator that made it."""

    title: str
    kpis: dict
    findings: list[dict]
    timeline: list[dict]
    by_severity: list[dict]
    by_rule: list[dict]
    histogram: list[dict] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def assemble(title: str, generated_ms: int, alerts: DataFrame, packets: DataFrame | None = None, *, open_ports: DataFrame | None = None, services: DataFrame | None = None, audit: DataFrame | None = None, notes: list[str] = (), path: str = "capture", findings: int = 12) -> Pack:
    """Run the aggregates (each returns a few rows) and gather them."""
    spark, histogram, capture = alerts.sparkSession, [], None
    if packets is not None:
        shown = stats.time_histogram(packets)
        histogram = _rows(shown.orderBy("bucket"))
        capture = timeline.capture_events(stats.capture_summary(packets), stats.peak_bucket(shown), path, generated_ms)
    events = timeline.build_timeline(spark, generated_ms, alerts=alerts, audit=audit, scan=open_ports, services=services, capture=capture, notes=list(notes))
    return Pack(
        title, stats.kpis(alerts, open_ports, services, packets, audit).first().asDict(), _rows(timeline.key_findings(alerts, open_ports, findings)), _rows(events),
        _rows(stats.alerts_by(alerts, "severity")), _rows(stats.alerts_by(alerts, "rule", TOP_RULES)), histogram, list(notes),
    )


def to_json(pack: Pack) -> str:
    return json.dumps(asdict(pack), indent=2)


def _sections(pack: Pack, template: str) -> list[tuple[str, list[str], list[list]]]:
    kind = TEMPLATES.get(template.strip().lower())
    if kind is None:
        raise ValueError(f"unknown template {template!r}")
    events = pack.timeline if kind == "full" else pack.timeline[-EXECUTIVE_EVENTS:]
    out = [("Key figures", ["figure", "value"], [[k, v] for k, v in pack.kpis.items()]), ("Findings", ["label", "detail"], [[f["label"], f["detail"]] for f in pack.findings])]
    if kind != "compact":
        out.append(("Alerts by severity", ["severity", "count"], [[r["key"], r["count"]] for r in pack.by_severity]))
        out.append(("Alerts by rule", ["rule", "count"], [[r["key"], r["count"]] for r in pack.by_rule]))
        out.append(("Timeline", ["ts_unix_ms", "kind", "title", "detail"], [[e["ts_unix_ms"], e["kind"], e["title"], e["detail"]] for e in events]))
    if kind == "full":
        out.append(("Notes", ["note"], [[n] for n in pack.notes]))
    return out


def _cell(value) -> str:
    return " ".join(str(value).splitlines()).replace("|", "\\|")


def to_markdown(pack: Pack, template: str = "full") -> str:
    lines = [f"# {pack.title}"]
    for name, head, rows in _sections(pack, template):
        lines += ["", f"## {name}", "", "| " + " | ".join(head) + " |", "|" + "-|" * len(head)]
        lines += ["| " + " | ".join(map(_cell, r)) + " |" for r in rows]
    return "\n".join(lines) + "\n"


def bar_chart(rows: list[tuple[str, int]], width: int = 480) -> str:
    """Horizontal bars as SVG."""
    most = max((n for _, n in rows), default=0) or 1
    bars = "".join(
        f'<text x="0" y="{20 * i + 14}">{html.escape(str(k))}</text><rect x="160" y="{20 * i + 3}" width="{(width - 220) * n // most}" height="14"/><text x="{165 + (width - 220) * n // most}" y="{20 * i + 14}">{n}</text>'
        for i, (k, n) in enumerate(rows)
    )
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{20 * len(rows) + 4}" font-size="12">{bars}</svg>'


def to_html(pack: Pack, template: str = "full") -> str:
    body = [f"<h1>{html.escape(pack.title)}</h1>"]
    if pack.histogram:
        body.append(packet_chart(pack.histogram))
    if pack.by_severity:
        body.append(bar_chart([(r["key"], r["count"]) for r in pack.by_severity]))
    if pack.timeline:
        body.append(event_rail(pack.timeline))
    for name, head, rows in _sections(pack, template):
        cells = lambda tag, r: "".join(f"<{tag}>{html.escape(str(x))}</{tag}>" for x in r)
        body.append(f"<h2>{html.escape(name)}</h2><table><tr>{cells('th', head)}</tr>" + "".join(f"<tr>{cells('td', r)}</tr>" for r in rows) + "</table>")
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(pack.title)}</title></head><body>{"".join(body)}</body></html>'


def packet_chart(histogram: list[dict], width: int = 640, height: int = 120) -> str:
    """A column for each time bucket (ts_unix_ms, packets) as SVG."""
    most = max((h["packets"] for h in histogram), default=0) or 1
    step = width / max(1, len(histogram))
    columns = []
    for i, h in enumerate(histogram):
        tall = max(1, (height - 20) * h["packets"] / most)
        columns.append(f'<rect x="{i * step:.1f}" y="{height - 10 - tall:.1f}" width="{max(2, step - 2):.1f}" height="{tall:.1f}"><title>{h["ts_unix_ms"]}: {h["packets"]} packets</title></rect>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}" role="img" aria-label="Packets over time">{"".join(columns)}</svg>'


def event_rail(events: list[dict], width: int = 640) -> str:
    """A dot for each event (ts_unix_ms, kind, title) at its place in time, as SVG."""
    times = [e["ts_unix_ms"] for e in events]
    span = max(1, max(times, default=0) - min(times, default=0))
    dots = "".join(
        f'<circle class="{html.escape(str(e["kind"]))}" cx="{10 + (width - 20) * (e["ts_unix_ms"] - min(times)) / span:.1f}" cy="20" r="4"><title>{html.escape(str(e["title"]))}</title></circle>' for e in events
    )
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} 40" role="img" aria-label="Events"><line x1="10" y1="20" x2="{width - 10}" y2="20"/>{dots}</svg>'


def section(title: str, value: dict | None) -> str:
    """A Markdown section with a value as JSON, and how much is in its usual lists."""
    if value is None:
        return f"## {title}\n\n_Not provided._\n\n"
    out = f"## {title}\n\n```json\n{json.dumps(value, indent=2)}\n```\n\n"
    for key, label in (("open", "Open ports reported"), ("alerts", "Alerts raised")):
        if isinstance(value.get(key), list):
            out += f"- {label}: **{len(value[key])}**\n\n"
    if isinstance(found := value.get("results"), list):
        is_open = sum(isinstance(r, dict) and r.get("state") == "open" for r in found)
        out += f"- Enum results: **{len(found)}** (openish **{is_open}**)\n\n"
    return out


def _inline(text: str) -> str:
    bold = re.sub(r"\*\*(.*?)\*\*", r"<strong>\1</strong>", html.escape(text, quote=False).replace('"', "&quot;"))
    parts = bold.split("`")
    return "".join(f"<code>{p}</code>" if i % 2 else p for i, p in enumerate(parts))


def markdown_to_html(text: str) -> str:
    """The part of Markdown that reports use: two heads, lists, tables, code blocks, rules, bold and code."""
    plain = lambda x: html.escape(x, quote=False).replace('"', "&quot;")
    closing = {"list": "</ul>", "table": "</table>", "code": "</code></pre>"}
    out: list[str] = []
    block: str | None = None

    def enter(kind: str | None, opening: str = "") -> bool:
        """Close the open block unless it is ``kind``; whether a new one was opened."""
        nonlocal block
        if block == kind:
            return False
        if block:
            out.append(closing[block])
        if kind:
            out.append(opening)
        block = kind
        return True

    for line in text.splitlines():
        if line.startswith("```"):
            enter(None) if block == "code" else enter("code", "<pre><code>")
        elif block == "code":
            out.append(plain(line))
        elif line.startswith("|"):
            if "---" not in line:
                tag = "th" if enter("table", "<table>") else "td"
                out.append("<tr>" + "".join(f"<{tag}>{plain(c.strip())}</{tag}>" for c in line.strip().strip("|").split("|")) + "</tr>")
        elif line.startswith("- "):
            enter("list", "<ul>")
            out.append(f"<li>{_inline(line[2:])}</li>")
        else:
            enter(None)
            head = re.match(r"(##?) (.*)", line)
            if head:
                out.append(f"<h{len(head[1])}>{plain(head[2])}</h{len(head[1])}>")
            elif line.startswith("---"):
                out.append("<hr/>")
            elif line.strip():
                out.append(f'<p class="meta">{_inline(line)}</p>')
    enter(None)
    return "\n".join(out) + "\n"


def board(snapshot: dict, source: str = "-", pack: str | None = None, elapsed_secs: float = 0.0, status: str = "running", top_ports: list[dict] = (), session: dict | None = None) -> str:
    """A snapshot of ``streaming.detect.watch`` as text for a terminal."""
    t = snapshot["traffic"]
    rate = snapshot.get("pps", t.get("packets", 0) / elapsed_secs if elapsed_secs > 0 else 0.0)
    top_ports = top_ports or snapshot.get("top_ports", ())
    counts = lambda rows: "  ".join(f"{r['key']}={r['count']}" for r in rows)
    lines = [
        "Tracelake live board",
        f"status={status:<10} source={source}  pack={pack or '-'}",
        f"elapsed={elapsed_secs:.1f}s  pps={rate:.1f}  packets={t.get('packets', 0)}  bytes={t.get('bytes', 0)}  alerts={sum(r['count'] for r in snapshot['by_severity'])}",
        "proto  " + " ".join(f"{p}={t.get(p, 0)}" for p in ("tcp", "udp", "icmp", *stats.APPS)),
    ]
    if snapshot["by_severity"]:
        lines.append("severity: " + counts(snapshot["by_severity"]))
    if snapshot["by_rule"]:
        lines.append("rules: " + counts(snapshot["by_rule"][:8]))
    if top_ports:
        lines.append("top dst ports: " + "  ".join(f"{r['key']}:{r['count']}" for r in top_ports[:6]))
    if session:
        lines.append(f"session ticket={session.get('ticket_id', '-')}  notes={len(session.get('notes', []))}  operators={', '.join(session.get('operators', []))}")
    lines.append("recent alerts:")
    lines += [f"  [{a['severity']:<8}] {a['rule']:<22} src={a['src']} — {a['detail']}" for a in snapshot["recent"]] or ["  (none yet)"]
    return "\n".join(lines) + "\n"


def preview(alerts: DataFrame, n: int = 20) -> list[str]:
    """The first ``n`` alerts in time as lines, and how many more there are."""
    rows = alerts.orderBy("ts_unix_ms", "rule", "src", "detail").limit(n).collect()
    more = alerts.count() - len(rows)
    return [f"[{r.severity}] {r.rule} src={r.src} — {r.detail}" for r in rows] + ([f"... {more} more alerts"] if more > 0 else [])


def stats_text(row: dict) -> str:
    """A traffic_stats row as text."""
    return "\n".join(f"{k:>8}: {v}" for k, v in row.items())


#: The calls of this library by the task they serve.
CATALOG = {
    "capture": "tracelake.sources.captures.read_capture, tracelake.functions.filter_language.capture_filter",
    "detect": "tracelake.operators.detect.detect",
    "watch": "tracelake.streaming.detect.watch, detect_stream",
    "export": "tracelake.operators.siem.siem_lines, export_file, export_udp",
    "import": "tracelake.sources.eve.import_eve, tracelake.sources.zeek.import_zeek",
    "diff": "tracelake.operators.diff.diff_alerts",
    "merge": "tracelake.operators.captures.merge_captures",
    "slice": "tracelake.operators.captures.slice_capture",
    "report": "tracelake.plans.report.assemble",
    "session": "tracelake.plans.engagement.Session",
}
