"""Correlation frames: what a search touched, widened step by step."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import MAX, MIN
from ..functions.identity import entity_key
from ..plans.documents import Correlate, Search, Step
from ..schema import text_of
from .predicate import predicate
from .search import matching, window

MAX_TRACES, MAX_ENTITIES = 1_000, 256


@dataclass(frozen=True)
class Frame:
    start: int
    end: int
    entities: tuple[str, ...] = ()
    traces: tuple[str, ...] = ()
    truncated: bool = False
    matched: int | None = None
    scanned: int | None = None


def anchor_traces(records: DataFrame, query: Search) -> DataFrame:
    """The distinct trace ids of all matches, by when each was first seen."""
    return matching(records, query).where("trace_id is not null").groupBy("trace_id").agg(F.min("ts_ns").alias("first_ns"))


def anchor_entities(records: DataFrame, query: Search) -> DataFrame:
    """The distinct entities of all matches, by when each was first seen."""
    found = matching(records, query).select(entity_key("resource").alias("entity"), "ts_ns")
    return found.where("entity is not null").groupBy("entity").agg(F.min("ts_ns").alias("first_ns"))


def _first(found: DataFrame, key: str, most: int) -> tuple[list[str], bool]:
    rows = [r[key] for r in found.orderBy("first_ns", key).limit(most + 1).collect()]
    return rows[:most], len(rows) > most


def anchor(records: DataFrame, query: Search, stats: bool = False) -> Frame:
    """The frame of a search: its own window, its first traces and entities. Limit and cursor don't matter.

    ``stats``: with the numbers of rows that match, and that the window holds.
    """
    traces, a = _first(anchor_traces(records, query), "trace_id", MAX_TRACES)
    entities, b = _first(anchor_entities(records, query), "entity", MAX_ENTITIES)
    test = F.coalesce(window(query.start, query.end, records.columns) & predicate(query.terms, query.signal, records.columns), F.lit(False))
    seen = records.where(window(query.start, query.end, records.columns)).agg(F.count_if(test).alias("matched"), F.count("*").alias("scanned")).first() if stats else {"matched": None, "scanned": None}
    return Frame(query.start, query.end, tuple(entities), tuple(traces), a or b, seen["matched"], seen["scanned"])


def trace_extent(spans: DataFrame, traces: DataFrame) -> DataFrame:
    """One row: first start and last end of all spans of these traces, at any time."""
    return spans.join(traces.select("trace_id"), "trace_id", "left_semi").agg(F.min("ts_ns").alias("from_ns"), F.max(F.col("ts_ns") + F.col("duration_ns")).alias("to_ns"))


def trace_peers(spans: DataFrame, traces: DataFrame, start: int = MIN, end: int = MAX) -> DataFrame:
    """The distinct entities of these traces' spans that overlap the window."""
    own = spans.where((F.col("ts_ns") <= end) & (F.col("ts_ns") + F.col("duration_ns") >= start)).join(traces.select("trace_id"), "trace_id", "left_semi")
    return own.select(entity_key("resource").alias("entity"), "ts_ns").where("entity is not null").groupBy("entity").agg(F.min("ts_ns").alias("first_ns"))


def expand(frame: Frame, step: Step, spans: DataFrame) -> Frame:
    """One step. Steps don't commute; without traces, ``traces`` and ``peers`` change nothing."""
    if step.kind == "around":
        return replace(frame, start=max(MIN, frame.start - step.by), end=min(MAX, frame.end + step.by))
    if not frame.traces:
        return frame
    ids = spans.sparkSession.createDataFrame([(t,) for t in frame.traces], "trace_id string")  # at most MAX_TRACES
    if step.kind == "traces":
        r = trace_extent(spans, F.broadcast(ids)).first()
        return frame if r["from_ns"] is None else replace(frame, start=min(frame.start, r["from_ns"]), end=max(frame.end, r["to_ns"]))
    found, over = _first(trace_peers(spans, F.broadcast(ids), frame.start, frame.end), "entity", MAX_ENTITIES)
    every = list(dict.fromkeys([*frame.entities, *found]))
    return replace(frame, entities=tuple(every[:MAX_ENTITIES]), truncated=frame.truncated or over or len(every) > MAX_ENTITIES)


def correlate(records: DataFrame, spans: DataFrame, query: Correlate) -> Frame:
    frame = anchor(records, query.search)
    for step in query.steps:
        frame = expand(frame, step, spans)
    return frame


def names_of(frame: Frame, tables: list[DataFrame]) -> dict[str, str]:
    """Names of the frame's entities, from records in its window; ``unknown`` where none says."""
    out = dict.fromkeys(frame.entities, "unknown")
    for t in tables:
        own = t.where(window(frame.start, frame.end, t.columns)).select(entity_key("resource").alias("entity"), text_of("resource", "service.name").alias("name"), "ts_ns")
        found = own.where(F.col("entity").isin(*frame.entities) & F.col("name").isNotNull()).groupBy("entity").agg(F.min_by("name", F.struct("ts_ns", "name")).alias("name"))
        for r in found.collect() if frame.entities else []:  # at most MAX_ENTITIES
            if out[r["entity"]] == "unknown":
                out[r["entity"]] = r["name"]
    return out


def frame_json(frame: Frame, names: dict[str, str]) -> str:
    entities = [{"key": k, "name": names.get(k, "unknown")} for k in frame.entities]
    return json.dumps({"from": str(frame.start), "to": str(frame.end), "entities": entities, "traces": list(frame.traces), "truncated": frame.truncated})
