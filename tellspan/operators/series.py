"""Metric series: grouping, derived series, caps and exemplars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.documents import SeriesQuery
from .predicate import point_predicate
from .search import _object, window

_TWO = ("histogram", "exponential_histogram", "summary")


def _chosen(points: DataFrame, query: SeriesQuery) -> DataFrame:
    """Points of the named metric, with ``half``: which derived series of it are asked for (null: all).

    An exact name comes first; only if no point has it, ``x.count`` and ``x.sum`` name a half of ``x``.
    """
    own = points.where(window(query.start, query.end, points.columns) & point_predicate(query.terms)).withColumn("half", F.lit(None).cast("string"))
    if query.name is None:
        return own
    exact = own.where(F.col("name") == query.name)
    base, dot, half = query.name.rpartition(".")
    if not dot or half not in ("count", "sum"):
        return exact
    there = points.where(window(query.start, query.end, points.columns) & (F.col("name") == query.name)).select(F.lit(1).alias("x")).limit(1)
    derived = own.where((F.col("name") == base) & F.col("kind").isin(*_TWO)).withColumn("half", F.lit(half))
    return exact.unionByName(derived.join(F.broadcast(there), F.lit(True), "left_anti"))


def values(points: DataFrame, query: SeriesQuery) -> DataFrame:
    """A row for each value: series key columns, time, integer or double. Distributions give ``.count`` and ``.sum``."""
    two = F.col("kind").isin(*_TWO)
    count = F.when(F.col("half").isNull() | (F.col("half") == "count"), F.struct(F.lit(".count").alias("suffix"), F.col("count").alias("i"), F.lit(None).cast("double").alias("d")))
    total = F.when(F.col("sum").isNotNull() & (F.col("half").isNull() | (F.col("half") == "sum")), F.struct(F.lit(".sum").alias("suffix"), F.lit(None).cast("long").alias("i"), F.col("sum").alias("d")))
    plain = F.struct(F.lit("").alias("suffix"), F.when(F.col("v_dbl").isNull(), F.col("v_int")).alias("i"), F.col("v_dbl").alias("d"))
    parts = F.when(two, F.filter(F.array(count, total), lambda x: x.isNotNull())).otherwise(F.array(plain))
    attrs = _object(F.concat(*(F.coalesce(F.col(c), F.array().cast(points.schema["attrs"].dataType)) for c in ("resource", "scope", "metric_attrs", "attrs"))))
    out = _chosen(points, query).select("ts_ns", "name", "unit", "kind", "temporality", "monotonic", attrs.alias("attributes"), "exemplars", "node", "seq", "row", F.explode(parts).alias("v"))
    key = F.to_json(F.struct("name", "unit", "kind", "temporality", "monotonic"))
    return out.select(F.concat(key, "v.suffix", "attributes").alias("series"), F.concat("name", "v.suffix").alias("name"), "unit", "kind", "temporality", "monotonic", "attributes", "ts_ns", F.col("v.i").alias("v_int"), F.col("v.d").alias("v_dbl"), "exemplars", "node", "seq", "row")


def newest(found: DataFrame, most: int) -> DataFrame:
    """The newest ``most`` values of each series, with ``dropped_points``, the number of others in it."""
    by = Window.partitionBy("series")
    ranked = found.withColumn("rank", F.row_number().over(by.orderBy(F.desc("ts_ns"), F.desc("node"), F.desc("seq"), F.desc("row"))))
    sized = ranked.withColumn("dropped_points", F.greatest(F.count("*").over(by) - most, F.lit(0)))
    return sized.where(F.col("rank") <= most).drop("rank")


def first_series(found: DataFrame, most: int) -> DataFrame:
    """The rows of the ``most`` smallest series keys."""
    keys = found.drop("exemplars").select("series").distinct().orderBy("series").limit(most)
    return found.join(F.broadcast(keys), "series", "left_semi")


def series_points(points: DataFrame, query: SeriesQuery) -> DataFrame:
    """(series, name, …, ts_ns, v_int, v_dbl, dropped_points) of the series and points that the caps let through."""
    return newest(first_series(values(points, query).drop("exemplars"), query.max_series), query.max_points)


def series(points: DataFrame, query: SeriesQuery, max_exemplars: int = 64) -> DataFrame:
    """A row for each series: points in order of time, and its earliest exemplars."""
    kept = newest(first_series(values(points, query), query.max_series), query.max_points)
    heads = kept.groupBy("series", "name", "unit", "kind", "temporality", "monotonic", "attributes", "dropped_points").agg(
        F.array_sort(F.collect_list(F.struct("ts_ns", "node", "seq", "row", "v_int", "v_dbl"))).alias("points")
    )
    shown = kept.select("series", F.explode("exemplars").alias("e")).withColumn("at", F.row_number().over(Window.partitionBy("series").orderBy("e.ts_ns", "e.span_id"))).where(F.col("at") <= max_exemplars)
    shown = shown.groupBy("series").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "e"))), lambda x: x["e"]).alias("exemplars"))
    out = heads.join(shown, "series", "left")
    return out.withColumn("points", F.transform("points", lambda p: F.struct(p["ts_ns"].alias("ts_ns"), p["v_int"].alias("v_int"), p["v_dbl"].alias("v_dbl")))).orderBy("series")


def charts(found: DataFrame) -> DataFrame:
    """Number of series of each name: one chart each."""
    return found.groupBy("name").agg(F.count_distinct("series").alias("series"))


def sparkline(values_: list[float], buckets: int) -> str:
    """A line of at most ``buckets`` bars: the peak of each bucket, scaled from the least to the largest."""
    if not values_ or buckets <= 0:
        return ""
    n = min(buckets, len(values_))
    peaks = [max(values_[i * len(values_) // n : (i + 1) * len(values_) // n]) for i in range(n)]
    low, high = min(peaks), max(peaks)
    return "".join("▁▂▃▄▅▆▇█"[0 if high == low else min(7, int((p - low) / (high - low) * 7 + 0.5))] for p in peaks)
