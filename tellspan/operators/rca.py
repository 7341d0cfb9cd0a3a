"""Incident write-ups whose citations are counted again before anything is rendered."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.documents import DocumentError, Search, bounds, flag, instant, known, load, search, trace
from ..schema import LOGS, attributes, kv
from .alerts import rule, shown
from .predicate import predicate
from .search import window

_LISTS = ("impact", "ruled_out", "contributing", "remediation", "verification")


@dataclass(frozen=True)
class Fact:
    claim: str
    query: Search
    label: str
    found: int | None = None


@dataclass(frozen=True)
class WriteUp:
    title: str
    start: int
    end: int
    summary: str
    root_cause: str
    timeline: tuple[tuple[int, str], ...]
    evidence: tuple[Fact, ...]
    lists: dict[str, tuple[str, ...]]
    prevention: dict | None
    emit: bool


def _text(doc: dict, key: str, where: str) -> str:
    v = doc.get(key)
    if not isinstance(v, str) or not v.strip():
        raise DocumentError(f"{where} needs `{key}`")
    return v


def _items(doc: dict, key: str) -> list:
    v = doc.get(key)
    if v is None:
        return []
    if not isinstance(v, list):
        raise DocumentError(f"`{key}` must be a list")
    return v


def _fact(doc: dict, now: int, start: int, end: int) -> Fact:
    known(doc, ("claim", "trace_id", "query"))
    claim = _text(doc, "claim", "an evidence item")
    cited, asked = doc.get("trace_id"), doc.get("query")
    if (cited is None) == (asked is None):
        raise DocumentError(f"evidence {claim!r} must cite either `trace_id` or `query`")
    if cited is not None:
        return Fact(claim, trace(cited), f"trace `{cited.strip()}`")
    q = search(asked, now)
    if asked.get("from") is None and asked.get("to") is None:
        q = replace(q, start=start, end=end)
    return Fact(claim, q, f"{q.signal} where `{shown(q)}`" if q.terms else f"all {q.signal}")


def write_up(doc: dict | str, now: int) -> WriteUp:
    doc = load(doc) if isinstance(doc, str) else doc
    known(doc, ("title", "from", "to", "summary", "root_cause", "timeline", "evidence", "prevention", "emit", *_LISTS))
    start, end = bounds(doc, now)
    timeline = []
    for e in _items(doc, "timeline"):
        known(e, ("at", "what"))
        if e.get("at") is None:
            raise DocumentError("each timeline entry needs `at`")
        timeline.append((instant(e["at"], now, 0), _text(e, "what", "a timeline entry")))
    lists = {}
    for k in _LISTS:
        lists[k] = tuple(_items(doc, k))
        if any(not isinstance(x, str) for x in lists[k]):
            raise DocumentError(f"`{k}` must be a list of strings")
    if doc.get("prevention") is not None:
        rule(doc["prevention"])
    evidence = tuple(_fact(e, now, start, end) for e in _items(doc, "evidence"))
    return WriteUp(_text(doc, "title", "a write-up"), start, end, _text(doc, "summary", "a write-up"), _text(doc, "root_cause", "a write-up"), tuple(sorted(timeline, key=lambda x: x[0])), evidence, lists, doc.get("prevention"), flag(doc, "emit"))


def verify(found: WriteUp, tables: dict[str, DataFrame]) -> WriteUp:
    """The write-up with every citation counted: one scan for all citations of a signal."""
    counts: dict[int, int] = {}
    for signal, t in tables.items():
        own = [i for i, f in enumerate(found.evidence) if f.query.signal == signal]
        if own:
            cited = [found.evidence[i].query for i in own]
            low, high = min(q.start for q in cited), max(q.end for q in cited)
            tests = [F.coalesce(window(q.start, q.end, t.columns) & predicate(q.terms, q.signal, t.columns), F.lit(False)) for q in cited]
            row = t.where(window(low, high, t.columns)).agg(*(F.count_if(x).alias(f"n{i}") for i, x in zip(own, tests))).first()
            counts |= {i: row[f"n{i}"] for i in own}
    out = replace(found, evidence=tuple(replace(f, found=counts.get(i)) for i, f in enumerate(found.evidence)))
    dead = [f"{f.claim} ({f.label}) {'has no table' if f.found is None else 'is found nowhere'}" for f in out.evidence if not f.found]
    if dead:
        raise DocumentError(f"evidence without records, {len(dead)} of {len(out.evidence)}: " + "; ".join(dead))
    return out


def utc(ns: int) -> str:
    return datetime.fromtimestamp(ns // 1_000_000_000, timezone.utc).strftime("%Y-%m-%d %H:%M:%S")


def span(ns: int) -> str:
    """A length of time in its two largest units."""
    s = ns // 1_000_000_000
    parts = [(s // 86_400, "d"), (s % 86_400 // 3_600, "h"), (s % 3_600 // 60, "m"), (s % 60, "s")]
    parts = [f"{n}{u}" for n, u in parts if n]
    return " ".join(parts[:2]) or "0s"


def render(found: WriteUp) -> str:
    """Markdown of a verified write-up."""
    if any(f.found is None for f in found.evidence):
        raise ValueError("verify the citations first")
    bullets = lambda head, items: [f"## {head}", "", *(f"- {x}" for x in items), ""] if items else []
    cell = lambda x: x.replace("|", "\\|").replace("\n", " ")
    out = [f"# {found.title}", "", f"*{utc(found.start)} to {utc(found.end)} UTC ({span(found.end - found.start)}). Each citation was counted again when this was rendered.*", "", "## Summary", "", found.summary, ""]
    out += bullets("Impact", found.lists["impact"])
    if found.timeline:
        out += ["## Timeline", "", "| When (UTC) | What |", "| --- | --- |", *(f"| {utc(at)} | {cell(what)} |" for at, what in found.timeline), ""]
    out += ["## Root cause", "", found.root_cause, ""]
    out += bullets("Evidence", [f"{f.claim}: {f.label}, {f.found} records" for f in found.evidence])
    out += bullets("Ruled out", found.lists["ruled_out"]) + bullets("Contributing factors", found.lists["contributing"])
    if found.lists["remediation"]:
        out += [*bullets("Remediation", found.lists["remediation"]), "> None of this has been applied.", ""]
    out += bullets("Verification", found.lists["verification"])
    if found.prevention:
        out += ["## Prevention", "", "```json", json.dumps({"rules": [found.prevention]}, indent=2), "```", ""]
    return "\n".join(out)


def record(spark, found: WriteUp, now: int) -> DataFrame:
    """The write-up as a log record, to be appended to the logs."""
    one = spark.range(1).select(F.lit(now).alias("ts_ns"), F.lit(9).alias("severity_number"), F.lit("INFO").alias("severity_text"), F.lit("rca").alias("event_name"), F.lit(render(found)).alias("body"), attributes(kv("otel.scope.name", F.lit("tellspan.rca"), "str")).alias("scope"), attributes(kv("rca.title", F.lit(found.title), "str")).alias("attrs"))
    return one.select(*((F.col(f.name) if f.name in one.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in LOGS))
