"""Trace trees, and the shape of a service map."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trace_tree(spans: DataFrame, paths: bool = True) -> DataFrame:
    """Each span of each trace with its depth and, unless ``paths`` is off, its path, children by start time.

    A span whose parent isn't in its trace is a root. Spans on a cycle, and those below one, which no
    root leads to, have depth null. Each round doubles the way up that a span knows, over a table
    written under ``spark.checkpoint.dir``, so the rounds grow with the logarithm of the depth. A path
    names all spans above its own, so paths take as much room as all depths together.
    """
    spark = spans.sparkSession
    root = f"{(spark.conf.get('spark.checkpoint.dir', None) or os.path.join(tempfile.gettempdir(), 'tellspan-scratch')).rstrip('/')}/tree-{uuid.uuid4().hex[:12]}"
    s = spans.where("trace_id is not null and span_id is not null").select("trace_id", "span_id", "parent_span_id", "ts_ns", "row")
    s = s.groupBy("trace_id", "span_id").agg(F.max_by(F.struct("parent_span_id", "ts_ns"), F.struct("ts_ns", "row")).alias("x")).select("trace_id", "span_id", "x.*")
    s = _written(s, f"{root}/spans")
    above = s.select("trace_id", F.col("span_id").alias("up"))
    own = s.select("trace_id", "span_id", "ts_ns", F.when(F.col("parent_span_id") != F.col("span_id"), F.col("parent_span_id")).alias("up"))
    # up: the span that is d steps above, null if the way ends at a root, d steps above
    first = own.join(above.withColumn("known", F.lit(True)), ["trace_id", "up"], "left").select("trace_id", "span_id", "ts_ns", F.when(F.col("known"), F.col("up")).alias("up"), F.when(F.col("known"), 1).otherwise(0).cast("long").alias("d"))
    now = _doubled(_written(first, f"{root}/first"), f"{root}/depth")
    out = now.select("trace_id", "span_id", "ts_ns", F.when(F.col("up").isNull(), F.col("d")).cast("int").alias("depth"))
    if not paths:
        return out
    known = _written(out.where("depth is not null"), f"{root}/known")
    step = known.join(s.select("trace_id", "span_id", F.col("parent_span_id").alias("p")), ["trace_id", "span_id"])
    step = step.select("trace_id", "span_id", "ts_ns", F.when(F.col("depth") > 0, F.col("p")).alias("up"), F.least("depth", F.lit(1)).cast("long").alias("d"), F.array(F.struct(F.col("ts_ns").alias("t"), F.col("span_id").alias("s"))).alias("path"))
    path = _doubled(_written(step, f"{root}/step"), f"{root}/path")
    return out.join(path.select("trace_id", "span_id", "path"), ["trace_id", "span_id"], "left")


def _doubled(now: DataFrame, path: str) -> DataFrame:
    """(trace_id, span_id, ts_ns, up, d, maybe path) after as many rounds as let ways end at a root; others lead to cycles."""
    open_rows, i = now.where("up is not null").count(), 0
    while open_rows:
        far = now.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("next"), F.col("d").alias("more"), *([F.col("path").alias("before")] if "path" in now.columns else []))
        longer = now.where("up is not null").join(far, ["trace_id", "up"])
        columns = ["trace_id", "span_id", "ts_ns", F.col("next").alias("up"), (F.col("d") + F.col("more")).alias("d"), *([F.concat("before", "path").alias("path")] if "path" in now.columns else [])]
        now = _written(now.where("up is null").unionByName(longer.select(*columns)), f"{path}-{i}")
        left, i = now.where("up is not null").count(), i + 1
        if left == open_rows:  # depths have no gaps, so no later round would end a way
            break
        open_rows = left
    return now


def tree_rows(rows: list[dict]) -> list[tuple[int, dict]]:
    """(depth, span) of one trace's spans in the order of a walk: roots and children by start, spans on cycles flat at the end."""
    by_id = {r["span_id"]: r for r in rows}
    children: dict = {}
    roots = []
    for r in sorted(rows, key=lambda r: (r["ts_ns"], r["span_id"])):
        parent = r.get("parent_span_id")
        if parent in by_id and parent != r["span_id"]:
            children.setdefault(parent, []).append(r)
        else:
            roots.append(r)
    out, seen, todo = [], set(), [(0, r) for r in reversed(roots)]
    while todo:
        depth, r = todo.pop()
        if id(r) in seen:
            continue
        seen.add(id(r))
        out.append((depth, r))
        todo += [(depth + 1, c) for c in reversed(children.get(r["span_id"], []))]
    return out + [(0, r) for r in rows if id(r) not in seen]


def root_spans(spans: DataFrame) -> DataFrame:
    """Spans whose parent isn't among these spans."""
    parents = spans.select(F.col("trace_id").alias("t"), F.col("span_id").alias("p"))
    return spans.join(parents, (F.col("trace_id") == F.col("t")) & (F.col("parent_span_id") == F.col("p")), "left_anti")


def extent(spans: DataFrame) -> DataFrame:
    """Start, end and size of each trace."""
    return spans.groupBy("trace_id").agg(F.min("ts_ns").alias("start_ns"), F.max(F.col("ts_ns") + F.col("duration_ns")).alias("end_ns"), F.count("*").alias("spans"))


def severity_name(number: str = "severity_number", text: str = "severity_text"):
    """The text where there is one, else the band of four numbers."""
    band = F.get(F.array(*map(F.lit, SEVERITIES)), F.floor((F.col(number) - 1) / 4).cast("int"))
    return F.coalesce(F.nullif(F.col(text), F.lit("")), F.when(F.col(number).between(1, 24), band))


def map_tree(edges: list[tuple[str, str, int]], entry: str = "entry") -> list[tuple[int, str]]:
    """(depth, node) of a service map walked from ``entry``, busiest callee first; nodes it doesn't reach follow flat."""
    out, seen = [], {entry}
    by: dict[str, list] = {}
    for a, b, calls in edges:
        by.setdefault(a, []).append((-calls, b))
    todo = [(0, b) for _, b in sorted(by.get(entry, []), reverse=True)]
    while todo:
        depth, node = todo.pop()
        if node not in seen:
            seen.add(node)
            out.append((depth, node))
            todo += [(depth + 1, b) for _, b in sorted(by.get(node, []), reverse=True)]
    return out + [(0, n) for n in sorted({x for a, b, _ in edges for x in (a, b)} - seen)]


def map_layers(edges: list[tuple[str, str]]) -> dict[str, int]:
    """A layer for each node: the longest way to it, cycles cut after as many relaxations as there are nodes."""
    layer = {n: 0 for e in edges for n in e}
    for _ in range(len(layer)):
        changed = False
        for a, b in edges:
            if a != b and layer[b] < layer[a] + 1 < len(layer):
                layer[b], changed = layer[a] + 1, True
        if not changed:
            break
    return layer
