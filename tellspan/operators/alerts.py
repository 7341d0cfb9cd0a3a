"""Alert rules: count and ratio over a lookback window, held for a while before they fire."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import as_float
from ..plans.documents import DocumentError, Search, bar_text, duration, known, load, windowless
from .predicate import predicate
from .search import window

_COMPARE = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}


@dataclass(frozen=True)
class Rule:
    name: str
    query: Search
    of: Search | None
    over: int
    metric: str
    op: str
    threshold: float
    hold: int = 0
    severity: str = "warning"
    notify: tuple[str, ...] = ()

    def breaches(self, matched: int, total: int | None) -> bool:
        """An empty window never breaches a ratio, nor does a count of nothing."""
        if self.metric == "ratio" and not total:
            return False
        return _COMPARE[self.op](self.value(matched, total), self.threshold)

    def value(self, matched: int, total: int | None) -> float:
        if self.metric == "count":
            return float(matched)
        return matched / total if total else 0.0


@dataclass(frozen=True)
class State:
    since: int | None = None
    firing: int | None = None

    @property
    def phase(self) -> str:
        return "firing" if self.firing is not None else "pending" if self.since is not None else "ok"


def advance(state: State, breaching: bool, now: int, hold: int) -> tuple[State, str | None]:
    """The state after one evaluation, and ``fired`` or ``resolved`` if that is news. A breach must last ``hold`` unbroken."""
    if not breaching:
        return State(), "resolved" if state.firing is not None else None
    since = now if state.since is None else state.since
    if state.firing is None and now - since >= hold:
        return State(since, now), "fired"
    return State(since, state.firing), None


def condition(text: str) -> tuple[str, str, float]:
    """``count > 100``, ``ratio >= 5%``."""
    m = re.fullmatch(r"\s*(count|ratio)\s*(>=|<=|>|<)\s*(.+?)\s*(%)?\s*", text or "")
    number = as_float(m[3].strip()) if m else None
    if number is None:
        raise DocumentError(f"when: expected `count <op> <number>` or `ratio <op> <number>`, got {text!r}")
    return m[1], m[2], number * (0.01 if m[4] else 1.0)


def rule(doc: dict, targets: tuple[str, ...] = ()) -> Rule:
    known(doc, ("name", "query", "of", "over", "when", "for", "severity", "notify"))
    name = doc.get("name")
    if not isinstance(name, str):
        raise DocumentError("every rule has a `name`, which is text")
    try:
        query = windowless(doc.get("query"), "query")
        of = windowless(doc["of"], "of") if doc.get("of") is not None else None
        metric, op, threshold = condition(doc.get("when", ""))
        if metric == "ratio" and of is None:
            raise DocumentError("a ratio is taken of something: give `of`")
        if metric == "count" and of is not None:
            raise DocumentError("`count` has no denominator; drop `of`")
        notify = doc.get("notify") or []
        if not isinstance(notify, list) or any(not isinstance(n, str) for n in notify):
            raise DocumentError("`notify` lists names of targets")
        for n in notify:
            if n not in targets:
                raise DocumentError(f"no target is called {n!r}")
        return Rule(name, query, of, duration(doc.get("over", "1m")), metric, op, threshold, duration(doc.get("for", "0s")), doc.get("severity", "warning"), tuple(notify))
    except DocumentError as e:
        raise DocumentError(f"rule {name!r}: {e}") from e


@dataclass(frozen=True)
class Rules:
    rules: tuple[Rule, ...]
    every: int = 15_000_000_000
    targets: dict = field(default_factory=dict)


def rules(text: str) -> Rules:
    """A file of rules: ``every``, ``notify`` targets by name, and ``rules`` with unique names."""
    doc = load(text)
    known(doc, ("every", "notify", "rules"))
    targets = {t["name"]: t for t in doc.get("notify") or []}
    every = tuple(rule(r, tuple(targets)) for r in doc.get("rules") or [])
    names = [r.name for r in every]
    for n in names:
        if names.count(n) > 1:
            raise DocumentError(f"rule {n!r} is defined twice")
    return Rules(every, duration(doc.get("every", "15s")), targets)


def measure(tables: dict[str, DataFrame], found: Rule, now: int) -> DataFrame:
    """One row (matched, total) of the rule's inclusive lookback window. Both counts come from one scan if they can."""
    start = now - found.over
    own = replace(found.query, start=start, end=now)
    test = lambda q, t: F.coalesce(window(start, now, t.columns) & predicate(q.terms, q.signal, t.columns), F.lit(False))
    t = tables[own.signal]
    if found.of is None:
        return t.where(test(own, t)).agg(F.count("*").alias("matched"), F.lit(None).cast("long").alias("total"))
    if found.of.signal == own.signal:
        return t.where(window(start, now, t.columns)).agg(F.count_if(test(own, t)).alias("matched"), F.count_if(test(found.of, t)).alias("total"))
    other = tables[found.of.signal]
    return t.where(test(own, t)).agg(F.count("*").alias("matched")).crossJoin(other.where(test(found.of, other)).agg(F.count("*").alias("total")))  # one row each


def _whole(past: str, every: int) -> Column:
    """How many whole ticks fit into ``past``, rounded down, in integers: decimals and doubles round times beside a tick to it."""
    return F.expr(f"({past} - pmod({past}, {every}L)) div {every}L")


def ticks(table: DataFrame, found: Rule, start: int, end: int, every: int) -> DataFrame:
    """(at_ns, matched, total) at every tick from ``start`` to ``end``: each row counts in all ticks whose inclusive window holds it.

    A tick without rows has zeros. One scan serves all ticks.
    """
    n = (end - start) // every
    if found.over % every == 0 and found.over // every > 8:
        return _tick_buckets(table, found, start, n, every)
    test = F.coalesce(predicate(found.query.terms, found.query.signal, table.columns), F.lit(False))
    base = F.coalesce(predicate(found.of.terms, found.of.signal, table.columns), F.lit(False)) if found.of else F.lit(True)
    own = table.where(window(start - found.over, end, table.columns) & (test | base) if found.of else window(start - found.over, end, table.columns) & test)
    first = F.greatest(F.lit(0), -_whole(f"({start}L - ts_ns)", every))
    last = F.least(F.lit(n), _whole(f"(ts_ns - {start - found.over}L)", every))
    hits = own.select(test.alias("m"), base.alias("b"), first.alias("f"), last.alias("l")).where("f <= l")
    counted = hits.select("m", "b", F.explode(F.sequence("f", "l")).alias("k")).groupBy("k").agg(F.count_if("m").alias("matched"), F.count_if("b").alias("total"))
    grid = table.sparkSession.range(0, n + 1).withColumnRenamed("id", "k")
    out = grid.join(counted, "k", "left").select((F.lit(start) + F.col("k") * every).alias("at_ns"), F.coalesce("matched", F.lit(0)).alias("matched"), F.coalesce("total", F.lit(0)).alias("total"))
    return out if found.of else out.withColumn("total", F.lit(None).cast("long"))


def _tick_buckets(table: DataFrame, found: Rule, start: int, n: int, every: int) -> DataFrame:
    """``ticks`` where the window is many ticks long: rows are counted by the first tick that sees them, and a running sum of
    counts minus those that have left gives each tick, so that no row is copied. Rows exactly on the edge of a window are seen one tick longer."""
    test = F.coalesce(predicate(found.query.terms, found.query.signal, table.columns), F.lit(False))
    base = F.coalesce(predicate(found.of.terms, found.of.signal, table.columns), F.lit(False)) if found.of else F.lit(True)
    width = found.over // every
    own = table.where(window(start - found.over, start + n * every, table.columns) & ((test | base) if found.of else test))
    first = -_whole(f"({start}L - ts_ns)", every)
    # in at its first tick, out after the last whose inclusive window holds it
    moves = F.array(F.struct(F.greatest(first, F.lit(0)).alias("k"), F.lit(1).alias("sign")), F.struct((_whole(f"(ts_ns - {start}L)", every) + width + 1).alias("k"), F.lit(-1).alias("sign")))
    moved = own.select(test.cast("int").alias("m"), base.cast("int").alias("b"), F.explode(moves).alias("x")).groupBy(F.col("x.k").alias("k")).agg(F.sum(F.col("m") * F.col("x.sign")).alias("m"), F.sum(F.col("b") * F.col("x.sign")).alias("b"))
    grid = table.sparkSession.range(0, n + 1).withColumnRenamed("id", "k")
    so_far = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # a row for each tick
    sums = grid.join(moved, "k", "left").select("k", F.sum(F.coalesce("m", F.lit(0))).over(so_far).alias("matched"), F.sum(F.coalesce("b", F.lit(0))).over(so_far).alias("total"))
    out = sums.select((F.lit(start) + F.col("k") * every).alias("at_ns"), "matched", "total")
    return out if found.of else out.withColumn("total", F.lit(None).cast("long"))


def replay(rows: list, found: Rule) -> list[tuple[int, str, str | None]]:
    """(at, phase, news) of each tick in order."""
    state, out = State(), []
    for r in rows:
        state, news = advance(state, found.breaches(r["matched"], r["total"]), r["at_ns"], found.hold)
        out.append((r["at_ns"], state.phase, news))
    return out


class Engine:
    """Rules and their states. ``tick`` evaluates each against the tables; a rule that fails says so and keeps its state."""

    def __init__(self, found: Rules, tables: dict[str, DataFrame]):
        self.found, self.tables = found, tables
        self.states = {r.name: State() for r in found.rules}
        self.report: dict[str, dict] = {}

    def tick(self, now: int) -> list[tuple[Rule, str, float]]:
        news = []
        for r in self.found.rules:
            try:
                row = measure(self.tables, r, now).first()
            except Exception as e:  # noqa: BLE001 reported with the rule
                self.report[r.name] = {"state": self.states[r.name].phase, "error": str(e), "at": now}
                continue
            self.states[r.name], event = advance(self.states[r.name], r.breaches(row["matched"], row["total"]), now, r.hold)
            value = r.value(row["matched"], row["total"])
            self.report[r.name] = {"state": self.states[r.name].phase, "matched": row["matched"], "total": row["total"], "value": value, "at": now, "error": None}
            if event:
                news.append((r, event, value))
        return news


def shown(query: Search) -> str:
    """A query as a filter bar line."""
    return bar_text(query.terms) or f"all {query.signal}"


def payload(kind: str, found: Rule, event: str, value: float, at: int, key: str = "") -> str:
    """The body of a notification to slack, discord, pagerduty or a plain JSON receiver."""
    limit = f"{found.metric} {found.op} {found.threshold:g}"
    text = f"{'FIRING' if event == 'fired' else 'RESOLVED'} {found.name}: {found.metric} is {value:g} ({limit}), {shown(found.query)}"
    if kind == "slack":
        body: dict = {"text": text}
    elif kind == "discord":
        body = {"content": text[:2000]}
    elif kind == "pagerduty":
        severity = found.severity if found.severity in ("critical", "error", "warning", "info") else "warning"
        body = {"routing_key": key, "event_action": "trigger" if event == "fired" else "resolve", "dedup_key": f"tellspan/{found.name}", "payload": {"summary": text, "source": "tellspan", "severity": severity}}
    elif kind == "json":
        body = {"rule": found.name, "state": "firing" if event == "fired" else "resolved", "value": value, "threshold": found.threshold, "metric": found.metric, "severity": found.severity, "at": str(at), "query": shown(found.query)}
    else:
        raise DocumentError(f"unknown kind of target {kind!r}")
    return json.dumps(body)
