"""Record search: filter, newest first, keyset pages."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Row, Window
from pyspark.sql import functions as F

from ..functions.coerce import MAX, MIN
from ..plans.documents import Cursor, Search, trace
from ..schema import FIELDS
from .predicate import predicate

KEY = ("ts_ns", "node", "seq", "row")
HOUR_NS = 3_600_000_000_000


def window(start: int, end: int, columns, ts: str = "ts_ns") -> Column:
    """``start <= ts <= end``, with the partition hour as well where the table has it, so that files are skipped."""
    out = F.lit(True)
    if start > MIN:
        out = out & (F.col(ts) >= start)
    if end < MAX:
        out = out & (F.col(ts) <= end)
    if "p" in columns and start > MIN:
        out = out & (F.col("p") >= start // HOUR_NS)
    if "p" in columns and end < MAX:
        out = out & (F.col("p") <= end // HOUR_NS)
    return out


def matching(records: DataFrame, query: Search) -> DataFrame:
    """Rows in the window that satisfy every term, whatever the cursor."""
    return records.where(window(query.start, query.end, records.columns) & predicate(query.terms, query.signal, records.columns))


def behind(cursor: Cursor | None) -> Column:
    """Rows that come after the cursor in newest-first order. The bound on the time alone can be pushed down."""
    if cursor is None:
        return F.lit(True)
    key = (cursor.ts, cursor.node, cursor.seq, cursor.row)
    return (F.col("ts_ns") <= cursor.ts) & (F.struct(*KEY) < F.struct(*(F.lit(v).cast("long").alias(c) for v, c in zip(key, KEY))))


def search(records: DataFrame, query: Search) -> DataFrame:
    """A page: rows after the cursor, newest first, as a top-k plan."""
    page = matching(records, query).where(behind(query.after)).orderBy(*(F.desc(c) for c in KEY)).limit(query.limit)
    return page.withColumn("cursor", F.concat_ws(".", *KEY)) if query.cursors else page


def count(records: DataFrame, query: Search) -> DataFrame:
    """One row: exact number of matches behind the cursor."""
    return matching(records, query).where(behind(query.after)).agg(F.count("*").alias("matched"))


@dataclass
class Page:
    rows: list[Row]
    next: str | None
    matched: int | None = None
    scanned: int | None = None
    elapsed_us: int | None = None


def page(records: DataFrame, query: Search, stats: bool = False) -> Page:
    """Rows of a page, and the next page's cursor if this one is full (the page after an exactly full last one is empty)."""
    seen = None
    if stats:  # counted on the way, in the scan that finds the rows
        test = F.coalesce(window(query.start, query.end, records.columns) & predicate(query.terms, query.signal, records.columns) & behind(query.after), F.lit(False))
        seen = Observation()
        records = records.observe(seen, F.count("*").alias("scanned"), F.count_if(test).alias("matched"))
    began = time.monotonic_ns()
    rows = search(records, query).collect() if query.limit else records.agg(F.count("*")).collect()[1:]
    elapsed = (time.monotonic_ns() - began) // 1_000
    following = None
    if query.limit and len(rows) == query.limit:
        following = str(Cursor(*(rows[-1][c] for c in KEY)))
    if seen is None:
        return Page(rows, following)
    return Page(rows, following, seen.get["matched"], seen.get["scanned"], elapsed)


def pages(records: DataFrame, query: Search) -> DataFrame:
    """Every page from the cursor on, as ``page`` tells them one after the other: (page, rows, matched, scanned, next).

    Matches get their places at once: minutes are counted, then rows are numbered inside them. What is read doesn't grow with the number of pages.
    """
    test = F.coalesce(window(query.start, query.end, records.columns) & predicate(query.terms, query.signal, records.columns) & behind(query.after), F.lit(False))
    minute = F.expr("ts_ns - pmod(ts_ns, 60000000000L)")
    sizes = records.groupBy(minute.alias("minute")).agg(F.count("*").alias("scanned"), F.count_if(test).alias("n"))
    whole = sizes.agg(F.coalesce(F.sum("scanned"), F.lit(0)).alias("scanned"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    if not query.limit:
        return whole.select(F.lit(0).alias("page"), F.lit(0).alias("rows"), F.col("n").alias("matched"), "scanned", F.lit(None).cast("string").alias("next"))
    newer = F.sum("n").over(Window.orderBy(F.desc("minute")).rowsBetween(Window.unboundedPreceding, -1))  # a row for each minute
    before = sizes.where("n > 0").select("minute", F.coalesce(newer, F.lit(0)).alias("before"))
    found = records.where(test).select(*KEY, minute.alias("minute"))
    placed = found.withColumn("i", F.row_number().over(Window.partitionBy("minute").orderBy(*(F.desc(c) for c in KEY)))).join(before, "minute")
    place = F.col("before") + F.col("i")
    last = placed.where(place % query.limit == 0).select((place / query.limit - 1).cast("long").alias("page"), F.concat_ws(".", *KEY).alias("next"))
    every = whole.select("scanned", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / query.limit).cast("long"))).alias("page"))
    left = F.col("n") - F.col("page") * query.limit
    return every.join(last, "page", "left").select(F.col("page").cast("int").alias("page"), F.least(left, F.lit(query.limit)).cast("int").alias("rows"), left.alias("matched"), "scanned", "next")


def recent_first(records: DataFrame, query: Search, first_hours: int = 1) -> list[Row]:
    """A page of an hour-partitioned table, reading the newest hours first and twice as many each time until it is full."""
    if "p" not in records.columns:
        return search(records, query).collect()
    end, hours, rows = query.end, first_hours, []
    span = records.agg(F.min("p"), F.max("p")).first()
    if span[1] is None:
        return rows
    end = min(end, (span[1] + 1) * HOUR_NS - 1)
    low = max(query.start, span[0] * HOUR_NS)
    while len(rows) < query.limit and end >= low:
        start = max(low, (end // HOUR_NS - hours + 1) * HOUR_NS)
        part = Search(query.signal, start, end, query.terms, query.limit - len(rows), query.after, query.cursors)
        rows += search(records, part).collect()
        end, hours = start - 1, hours * 2
    return rows


def get_trace(spans: DataFrame, trace_id: str, limit: int = 1_000) -> DataFrame:
    return search(spans, trace(trace_id, limit))


def any_value(x: Column) -> Column:
    """An attribute's value as JSON text: 64-bit integers as strings, ids and bytes as hex, NaN and infinities as null."""
    return (
        F.when(x["type"] == 1, F.to_json(F.named_struct(F.lit("v"), x["s"])))
        .when(x["type"] == 2, F.to_json(F.named_struct(F.lit("v"), x["i"].cast("string"))))
        .when(x["type"] == 3, F.when(F.isnan(x["d"]) | (F.abs(x["d"]) == float("inf")), F.lit('{"v":null}')).otherwise(F.to_json(F.named_struct(F.lit("v"), x["d"]))))
        .when(x["type"] == 4, F.to_json(F.named_struct(F.lit("v"), x["b"])))
        .when(x["type"] == 5, F.to_json(F.named_struct(F.lit("v"), F.lower(F.hex(x["bytes"])))))
        .when(x["type"].isin(6, 7), F.concat(F.lit('{"v":'), F.coalesce(x["json"], F.lit("null")), F.lit("}")))
        .otherwise(F.lit('{"v":null}'))
    )


def _object(attrs: Column) -> Column:
    """Attributes as a JSON object, keys sorted, the last of a repeated key."""
    last = F.filter(attrs, lambda x, i: ~F.exists(F.slice(attrs, i + 2, F.size(attrs)), lambda y: y["key"] == x["key"]))
    entries = F.array_sort(F.transform(last, lambda x: F.named_struct(F.lit("k"), x["key"], F.lit("v"), F.regexp_extract(any_value(x), r'(?s)^\{"v":(.*)\}$', 1))))
    quoted = F.transform(entries, lambda e: F.concat(F.regexp_extract(F.to_json(F.named_struct(F.lit("k"), e["k"])), r'(?s)^\{"k":(.*)\}$', 1), F.lit(":"), e["v"]))
    return F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}"))


def merged(columns) -> Column:
    """Attributes of resource, scope and record as one JSON object; the innermost level wins."""
    levels = [F.coalesce(F.col(c), F.array().cast("array<struct<key:string,type:tinyint,s:string,i:bigint,d:double,b:boolean,bytes:binary,json:string>>")) for c in ("resource", "scope", "attrs") if c in columns]
    return _object(F.concat(*levels))


def _child(names: tuple[str, ...]):
    """A span's event or link as a JSON object with its own attributes."""

    def one(e: Column) -> Column:
        own = F.to_json(F.named_struct(*(x for n in names for x in (F.lit(n), e[n].cast("string") if n in ("ts_ns", "flags") else e[n]))))
        return F.concat(F.regexp_replace(own, r"\}$", ""), F.lit(',"attributes":'), _object(e["attrs"]), F.lit("}"))

    return one


def render(records: DataFrame, signal: str) -> DataFrame:
    """(cursor, json): each row as the object that searches return. Absent values and empty lists are left out."""
    parts = []
    for name, (col, kind) in FIELDS[signal].items():
        if col in records.columns:
            big = col.endswith("_ns") or col.endswith("count") or col == "flags"
            parts.append((F.col(col).cast("string") if big and kind == "int" else F.col(col)).alias(name))
    if "body_json" in records.columns:
        parts[-1:] = [parts[-1], F.parse_json("body_json").alias("body_value")]
    base = F.to_json(F.struct(*parts))
    extra = [F.concat(F.lit('"attributes":'), merged(records.columns))]
    for c in ("events", "links"):
        if c in records.columns:
            child = F.transform(F.col(c), _child(("ts_ns", "name") if c == "events" else ("trace_id", "span_id", "trace_state", "flags")))
            extra.append(F.when(F.size(F.col(c)) > 0, F.concat(F.lit(f'"{c}":['), F.array_join(child, ","), F.lit("]"))))
    body = F.concat(F.regexp_replace(base, r"\}$", ""), F.when(base != "{}", F.lit(",")).otherwise(F.lit("")), F.concat_ws(",", *extra), F.lit("}"))
    return records.select(F.concat_ws(".", *KEY).alias("cursor"), body.alias("json"))


def merge_pages(pages: list[DataFrame], limit: int) -> DataFrame:
    """One page of several replicas': equal cursors once, newest first."""
    out = pages[0]
    for p in pages[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(list(KEY)).orderBy(*(F.desc(c) for c in KEY)).limit(limit)


def route(records: DataFrame, slots: int, entity: str = "entity_key", position: str = "row") -> DataFrame:
    """``records`` with the writer that each goes to: by entity, or by position where there is none."""
    return records.withColumn("slot", F.when(F.col(entity).isNotNull(), F.pmod(F.conv(F.substring(F.md5(F.col(entity).cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(slots))).otherwise(F.pmod(F.col(position), F.lit(slots))))
