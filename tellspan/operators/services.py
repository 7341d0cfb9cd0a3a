"""Service map, entities and their names, metric names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import entity_key
from ..schema import text_of
from .search import window

ENTRY, UNKNOWN = "entry", "unknown"


def _key() -> Column:
    return F.coalesce(entity_key("resource"), F.lit("0"))


def _name() -> Column:
    return F.coalesce(text_of("resource", "service.name"), F.lit(UNKNOWN))


def _hops(spans: DataFrame, start: int, end: int, max_spans: int | None) -> DataFrame:
    """Spans that start in the window, with the entity of each one's parent, which may start at any time."""
    own = spans.where(window(start, end, spans.columns))
    if max_spans is not None:
        own = own.orderBy(F.desc("ts_ns"), F.desc("row")).limit(max_spans)
    own = own.select(_key().alias("entity"), _name().alias("name"), "parent_span_id", "duration_ns", (F.col("status_code") == 2).cast("long").alias("error"))
    # of all spans of all time, only those that a span of the window names are aggregated
    named = own.select(F.col("parent_span_id").alias("span_id")).where("span_id is not null").distinct()
    parents = spans.select("span_id", "resource", "node", "seq", "row").join(named, "span_id", "left_semi").groupBy(F.col("span_id").alias("parent_span_id")).agg(F.max_by(_key(), F.struct("node", "seq", "row")).alias("caller"))
    return own.join(parents, "parent_span_id", "left")


def _total(c: str) -> Column:
    """An exact sum of longs, which may need more than 64 bits; halves are added apart."""
    high, low = F.sum(F.shiftright(c, 32)).cast("decimal(20,0)"), F.sum(F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))).cast("decimal(20,0)")
    return (high * F.lit(1 << 32).cast("decimal(10,0)") + low).cast("decimal(38,0)")


def map_nodes(spans: DataFrame, start: int, end: int, max_spans: int | None = None) -> DataFrame:
    """Of each entity: spans, errors and time (a decimal). Resources without identity are one node, ``0``."""
    own = spans.where(window(start, end, spans.columns))
    if max_spans is not None:
        own = own.orderBy(F.desc("ts_ns"), F.desc("row")).limit(max_spans)
    own = own.select(_key().alias("entity"), _name().alias("name"), "duration_ns", F.when(F.col("status_code") == 2, 1).otherwise(0).alias("error"))
    return own.groupBy("entity").agg(F.min("name").alias("name"), F.count("*").alias("spans"), F.sum("error").alias("errors"), _total("duration_ns").alias("total_ns")).withColumn("mean_ns", F.expr("total_ns div spans"))


def map_edges(spans: DataFrame, start: int, end: int, max_spans: int | None = None) -> DataFrame:
    """Of each pair of different entities: calls, errors, total (a decimal) and longest time. A span without a parent is called by ``entry``."""
    hops = _hops(spans, start, end, max_spans).withColumn("caller", F.when(F.col("parent_span_id").isNull(), ENTRY).otherwise(F.col("caller")))
    calls = hops.where("caller is not null and caller <> entity")
    return calls.groupBy("caller", F.col("entity").alias("callee")).agg(F.count("*").alias("calls"), F.sum(F.coalesce("error", F.lit(0))).alias("errors"), _total("duration_ns").alias("total_ns"), F.max("duration_ns").alias("max_ns"))


def map_unresolved(spans: DataFrame, start: int, end: int, max_spans: int | None = None) -> DataFrame:
    """One row: spans in the window, and those whose parent is nowhere."""
    hops = _hops(spans, start, end, max_spans)
    return hops.agg(F.count("*").alias("spans"), F.count_if(F.col("parent_span_id").isNotNull() & F.col("caller").isNull()).alias("unresolved"))


def entities(tables: list[DataFrame], start: int, end: int) -> DataFrame:
    """Every identified entity of several signals: name, and the number of hours of a signal in which it was seen."""
    parts = []
    for i, t in enumerate(tables):
        own = t.where(window(start, end, t.columns)).select(entity_key("resource").alias("entity"), text_of("resource", "service.name").alias("name"), F.struct(F.lit(i), F.floor(F.col("ts_ns") / 3_600_000_000_000)).alias("block"), "ts_ns")
        parts.append(own.where("entity is not null").groupBy("entity", "block").agg(F.min_by("name", F.when(F.col("name").isNotNull(), F.struct("ts_ns", "name"))).alias("name"), F.min("ts_ns").alias("ts_ns")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("entity").agg(F.coalesce(F.min_by("name", F.when(F.col("name").isNotNull(), F.struct("ts_ns", "name"))), F.lit(UNKNOWN)).alias("name"), F.count("*").alias("blocks"))


def metric_names(points: DataFrame, start: int, end: int) -> DataFrame:
    """Each metric name with the unit and kind it was first seen with."""
    own = points.where(window(start, end, points.columns)).select(F.coalesce("name", F.lit("")).alias("name"), "unit", "kind", "ts_ns")
    return own.groupBy("name").agg(F.min_by(F.struct("unit", "kind"), F.struct("ts_ns", "unit", "kind")).alias("x")).select("name", "x.unit", "x.kind")


def rollup(frame_entities: DataFrame) -> DataFrame:
    """Services of a frame with the number of their entities."""
    return frame_entities.groupBy("name").agg(F.count("*").alias("entities"))


def scale_decision(free: DataFrame, low: float, high: float) -> DataFrame:
    """One row: ``up`` if any free share is below ``low``, ``down`` if all are above ``high``, else (or if any is unknown) ``hold``."""
    known = F.count("*") == F.count("free")
    return free.agg(F.when((F.count("*") == 0) | ~known, "hold").when(F.bool_or(F.col("free") < low), "up").when(F.bool_and(F.col("free") > high), "down").otherwise("hold").alias("decision"))
