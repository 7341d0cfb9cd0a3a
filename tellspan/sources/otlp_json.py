"""OTLP/JSON export requests to canonical tables.

Every scalar is read as text, since 64-bit integers come as numbers or strings and enums as numbers
or names; names come in camelCase or snake_case. Requests stay columns of the plan throughout.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import ATTRS, KV, LOGS, POINTS, SPANS

_S = T.StringType()
#: Fixed names of enum values, in the order of their numbers.
SPAN_KINDS = tuple(f"SPAN_KIND_{x}" for x in ("UNSPECIFIED", "INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER"))
STATUS = tuple(f"STATUS_CODE_{x}" for x in ("UNSET", "OK", "ERROR"))
TEMPORALITY = tuple(f"AGGREGATION_TEMPORALITY_{x}" for x in ("UNSPECIFIED", "DELTA", "CUMULATIVE"))
_LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
SEVERITY = ("SEVERITY_NUMBER_UNSPECIFIED", *(f"SEVERITY_NUMBER_{n}{'' if i == 1 else i}" for n in _LEVELS for i in (1, 2, 3, 4)))
TOP = {"logs": "resourceLogs", "traces": "resourceSpans", "metrics": "resourceMetrics"}


def _snake(name: str) -> str:
    return re.sub(r"(?<!^)([A-Z])", lambda m: "_" + m[1].lower(), name)


def _struct(**fields: T.DataType) -> T.StructType:
    """A struct with both spellings of each name."""
    out = []
    for n, t in fields.items():
        out.append(T.StructField(n, t))
        if _snake(n) != n:
            out.append(T.StructField(_snake(n), t))
    return T.StructType(out)


def _list(t: T.DataType) -> T.ArrayType:
    return T.ArrayType(t)


_VALUE = _struct(stringValue=_S, boolValue=_S, intValue=_S, doubleValue=_S, arrayValue=_S, kvlistValue=_S, bytesValue=_S)
_ATTRS = _list(_struct(key=_S, value=_VALUE))
_RESOURCE = _struct(attributes=_ATTRS, droppedAttributesCount=_S)
_SCOPE = _struct(name=_S, version=_S, attributes=_ATTRS, droppedAttributesCount=_S)
_LOG = _struct(timeUnixNano=_S, observedTimeUnixNano=_S, severityNumber=_S, severityText=_S, eventName=_S, body=_VALUE, attributes=_ATTRS, droppedAttributesCount=_S, flags=_S, traceId=_S, spanId=_S)
_EVENT = _struct(timeUnixNano=_S, name=_S, attributes=_ATTRS, droppedAttributesCount=_S)
_LINK = _struct(traceId=_S, spanId=_S, traceState=_S, flags=_S, attributes=_ATTRS, droppedAttributesCount=_S)
_SPAN = _struct(
    traceId=_S, spanId=_S, parentSpanId=_S, traceState=_S, flags=_S, name=_S, kind=_S, startTimeUnixNano=_S, endTimeUnixNano=_S, attributes=_ATTRS, droppedAttributesCount=_S,
    events=_list(_EVENT), droppedEventsCount=_S, links=_list(_LINK), droppedLinksCount=_S, status=_struct(code=_S, message=_S),
)
_EXEMPLAR = _struct(timeUnixNano=_S, asInt=_S, asDouble=_S, traceId=_S, spanId=_S, filteredAttributes=_ATTRS)
_POINT = _struct(
    attributes=_ATTRS, startTimeUnixNano=_S, timeUnixNano=_S, asInt=_S, asDouble=_S, exemplars=_list(_EXEMPLAR), count=_S, sum=_S, min=_S, max=_S, bucketCounts=_list(_S), explicitBounds=_list(_S),
    scale=_S, zeroCount=_S, zeroThreshold=_S, positive=_S, negative=_S, quantileValues=_list(_struct(quantile=_S, value=_S)), flags=_S,
)
_DATA = _struct(dataPoints=_list(_POINT), aggregationTemporality=_S, isMonotonic=_S)
_METRIC = _struct(name=_S, description=_S, unit=_S, metadata=_ATTRS, gauge=_DATA, sum=_DATA, histogram=_DATA, exponentialHistogram=_DATA, summary=_DATA)
_REQUESTS = {
    "logs": _struct(resourceLogs=_list(_struct(resource=_RESOURCE, scopeLogs=_list(_struct(scope=_SCOPE, logRecords=_list(_LOG)))))),
    "traces": _struct(resourceSpans=_list(_struct(resource=_RESOURCE, scopeSpans=_list(_struct(scope=_SCOPE, spans=_list(_SPAN)))))),
    "metrics": _struct(resourceMetrics=_list(_struct(resource=_RESOURCE, scopeMetrics=_list(_struct(scope=_SCOPE, metrics=_list(_METRIC)))))),
}


def _get(x: Column, name: str) -> Column:
    return F.coalesce(x[name], x[_snake(name)]) if _snake(name) != name else x[name]


def _long(x: Column) -> Column:
    return x.try_cast("bigint")


def _ns(x: Column) -> Column:
    """A timestamp; zero and what doesn't fit into 63 bits read as unset."""
    return F.nullif(x.try_cast("bigint"), F.lit(0).cast("long"))


def _double(x: Column) -> Column:
    return x.try_cast("double")


def _enum(x: Column, names: tuple[str, ...], most: int) -> Column:
    """A number or a name; negative ones and those beyond a byte are 0, others at most ``most``."""
    by_name = F.array_position(F.array(*map(F.lit, names)), x) - 1
    n = F.coalesce(_long(x), F.when(by_name >= 0, by_name), F.lit(0))
    return F.when((n < 0) | (n > 255), 0).otherwise(F.least(n, F.lit(most))).cast("int")


def _id(x: Column, size: int) -> Column:
    """Lower-case hex of exactly ``size`` bytes, else null. All zeros means no id."""
    low = F.lower(x)
    return F.when(low.rlike(f"^[0-9a-f]{{{2 * size}}}$") & (low != "0" * (2 * size)), low)


def value(v: Column, key: Column) -> Column:
    """An attribute from an AnyValue. Of several members the first of string, bool, int, double, array, list, bytes counts."""
    g = {k: _get(v, k) for k in ("stringValue", "boolValue", "intValue", "doubleValue", "arrayValue", "kvlistValue", "bytesValue")}
    kinds = (("stringValue", 1), ("boolValue", 4), ("intValue", 2), ("doubleValue", 3), ("arrayValue", 6), ("kvlistValue", 7), ("bytesValue", 5))
    kind = F.coalesce(*(F.when(g[n].isNotNull(), F.lit(k)) for n, k in kinds), F.lit(0))
    on = lambda k, x: F.when(kind == k, x)
    return F.struct(
        key.alias("key"),
        kind.cast("tinyint").alias("type"),
        on(1, g["stringValue"]).alias("s"),
        on(2, _long(g["intValue"])).alias("i"),
        on(3, _double(g["doubleValue"])).alias("d"),
        on(4, g["boolValue"].try_cast("boolean")).alias("b"),
        on(5, F.try_to_binary(g["bytesValue"], F.lit("base64"))).alias("bytes"),
        F.coalesce(on(6, g["arrayValue"]), on(7, g["kvlistValue"])).alias("json"),
    ).cast(KV)


def _attrs(x: Column) -> Column:
    return F.coalesce(F.transform(x, lambda a: value(a["value"], a["key"])), F.array().cast(ATTRS))


def _text_kv(key: str, x: Column) -> Column:
    null = lambda t: F.lit(None).cast(t)
    return F.struct(F.lit(key).alias("key"), F.lit(1).cast("tinyint").alias("type"), x.alias("s"), null("bigint").alias("i"), null("double").alias("d"), null("boolean").alias("b"), null("binary").alias("bytes"), null("string").alias("json")).cast(KV)


def _scope(x: Column) -> Column:
    """A scope's attributes, then its name and version where they are not empty."""
    own = F.filter(F.array(F.when(x["name"] != "", _text_kv("otel.scope.name", x["name"])), F.when(x["version"] != "", _text_kv("otel.scope.version", x["version"]))), lambda a: a.isNotNull())
    return F.concat(_attrs(x["attributes"]), F.coalesce(own, F.array().cast(ATTRS)))


def valid(requests: DataFrame, signal: str, column: str = "value") -> DataFrame:
    """``requests`` with ``error``: null for a JSON object that has the signal's top member (null counts as empty) or is empty."""
    v = F.try_parse_json(column)
    kind = F.schema_of_variant(v)
    names = [TOP[signal], _snake(TOP[signal])]
    has = F.lit(False)
    for n in names:
        has = has | kind.rlike(rf"(<|, ){n}: ")
    return requests.withColumn("error", F.when(v.isNull(), "not JSON").when(~kind.startswith("OBJECT"), "not an object").when((kind != "OBJECT<>") & ~has, F.concat(F.lit(f"no {TOP[signal]} in "), kind)))


def _records(requests: DataFrame, signal: str, scopes: str, items: str, column: str) -> DataFrame:
    """(resource, scope, r): a row for each record of each request."""
    r = requests.select(F.from_json(column, _REQUESTS[signal], {"mode": "PERMISSIVE"}).alias("q"))
    r = r.select(F.explode(_get(F.col("q"), TOP[signal])).alias("x"))
    r = r.select(F.col("x.resource.attributes").alias("ra"), F.explode(_get(F.col("x"), scopes)).alias("y"))
    return r.select(_attrs(F.col("ra")).alias("resource"), _scope(F.col("y.scope")).alias("scope"), F.explode(_get(F.col("y"), items)).alias("r"))


def _finish(rows: DataFrame, schema: T.StructType) -> DataFrame:
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def logs(requests: DataFrame, now_ns: int, column: str = "value") -> DataFrame:
    """Log records. Time is the record's, else the observed one, else ``now_ns``."""
    d = _records(requests, "logs", "scopeLogs", "logRecords", column)
    g = lambda n: _get(F.col("r"), n)
    body = value(F.col("r.body"), F.lit(""))
    observed = _ns(g("observedTimeUnixNano"))
    out = d.select(
        F.coalesce(_ns(g("timeUnixNano")), observed, F.lit(now_ns)).alias("ts_ns"),
        observed.alias("observed_ns"),
        F.coalesce(_long(g("severityNumber")), F.array_position(F.array(*map(F.lit, SEVERITY)), g("severityNumber")) - 1, F.lit(0)).alias("severity_number"),
        F.nullif(g("severityText"), F.lit("")).alias("severity_text"),
        F.nullif(g("eventName"), F.lit("")).alias("event_name"),
        body["s"].alias("body"),
        F.when(F.col("r.body").isNotNull() & (body["type"] > 1), F.to_json(F.col("r.body"))).alias("body_json"),
        _id(g("traceId"), 16).alias("trace_id"),
        _id(g("spanId"), 8).alias("span_id"),
        F.coalesce(_long(g("flags")), F.lit(0)).alias("flags"),
        F.coalesce(_long(g("droppedAttributesCount")), F.lit(0)).alias("dropped_attributes_count"),
        "resource",
        "scope",
        _attrs(F.col("r.attributes")).alias("attrs"),
    )
    return _finish(out, LOGS)


def spans(requests: DataFrame, column: str = "value") -> DataFrame:
    """Spans with their events and links. A span that ends before it starts lasts no time."""
    d = _records(requests, "traces", "scopeSpans", "spans", column)
    g = lambda n: _get(F.col("r"), n)
    count = lambda x, n: F.coalesce(_long(_get(x, n)), F.lit(0))
    start, end = F.coalesce(_ns(g("startTimeUnixNano")), F.lit(0)), F.coalesce(_ns(g("endTimeUnixNano")), F.lit(0))
    event = lambda e: F.struct(F.coalesce(_ns(_get(e, "timeUnixNano")), F.lit(0)).alias("ts_ns"), e["name"].alias("name"), count(e, "droppedAttributesCount").alias("dropped_attributes_count"), _attrs(e["attributes"]).alias("attrs"))
    link = lambda e: F.struct(_id(_get(e, "traceId"), 16).alias("trace_id"), _id(_get(e, "spanId"), 8).alias("span_id"), _get(e, "traceState").alias("trace_state"), count(e, "flags").alias("flags"), count(e, "droppedAttributesCount").alias("dropped_attributes_count"), _attrs(e["attributes"]).alias("attrs"))
    out = d.select(
        start.alias("ts_ns"),
        F.greatest(end - start, F.lit(0)).alias("duration_ns"),
        _id(g("traceId"), 16).alias("trace_id"),
        _id(g("spanId"), 8).alias("span_id"),
        _id(g("parentSpanId"), 8).alias("parent_span_id"),
        g("traceState").alias("trace_state"),
        count(F.col("r"), "flags").alias("flags"),
        F.nullif(g("name"), F.lit("")).alias("name"),
        _enum(g("kind"), SPAN_KINDS, 5).alias("kind"),
        _enum(F.col("r.status.code"), STATUS, 2).alias("status_code"),
        F.nullif(F.col("r.status.message"), F.lit("")).alias("status_message"),
        count(F.col("r"), "droppedAttributesCount").alias("dropped_attributes_count"),
        count(F.col("r"), "droppedEventsCount").alias("dropped_events_count"),
        count(F.col("r"), "droppedLinksCount").alias("dropped_links_count"),
        F.transform("r.events", event).alias("events"),
        F.transform("r.links", link).alias("links"),
        "resource",
        "scope",
        _attrs(F.col("r.attributes")).alias("attrs"),
    )
    return _finish(out, SPANS)


def points(requests: DataFrame, column: str = "value") -> DataFrame:
    """Data points of all five kinds of metrics, each with its descriptor. A double wins over an integer."""
    d = _records(requests, "metrics", "scopeMetrics", "metrics", column)
    m = F.col("r")
    kinds = (("gauge", "gauge"), ("sum", "sum"), ("histogram", "histogram"), ("exponentialHistogram", "exponential_histogram"), ("summary", "summary"))
    found = F.filter(F.array(*(F.when(_get(m, n).isNotNull(), F.struct(F.lit(k).alias("kind"), _get(m, n).alias("data"))) for n, k in kinds)), lambda x: x.isNotNull())
    d = d.select("resource", "scope", m["name"].alias("name"), m["description"].alias("description"), m["unit"].alias("unit"), _attrs(m["metadata"]).alias("metric_attrs"), F.explode(found).alias("k"))
    d = d.select("*", F.explode(_get(F.col("k.data"), "dataPoints")).alias("p"))
    g = lambda n: _get(F.col("p"), n)
    exemplar = lambda e: F.struct(_ns(_get(e, "timeUnixNano")).alias("ts_ns"), F.when(_get(e, "asDouble").isNull(), _long(_get(e, "asInt"))).alias("i"), _double(_get(e, "asDouble")).alias("d"), _id(_get(e, "traceId"), 16).alias("trace_id"), _id(_get(e, "spanId"), 8).alias("span_id"), _attrs(_get(e, "filteredAttributes")).alias("attrs"))
    real = _double(g("asDouble"))
    out = d.select(
        F.coalesce(_ns(g("timeUnixNano")), F.lit(0)).alias("ts_ns"),
        _ns(g("startTimeUnixNano")).alias("start_ns"),
        F.nullif("name", F.lit("")).alias("name"),
        "description",
        F.nullif("unit", F.lit("")).alias("unit"),
        F.col("k.kind").alias("kind"),
        F.when(F.col("k.kind").isin("sum", "histogram", "exponential_histogram"), _enum(_get(F.col("k.data"), "aggregationTemporality"), TEMPORALITY, 2)).otherwise(0).alias("temporality"),
        ((F.col("k.kind") == "sum") & F.coalesce(_get(F.col("k.data"), "isMonotonic").try_cast("boolean"), F.lit(False))).alias("monotonic"),
        F.when(real.isNull(), _long(g("asInt"))).alias("v_int"),
        real.alias("v_dbl"),
        _long(g("count")).alias("count"),
        _double(g("sum")).alias("sum"),
        _double(g("min")).alias("min"),
        _double(g("max")).alias("max"),
        F.transform(g("bucketCounts"), _long).alias("bucket_counts"),
        F.transform(g("explicitBounds"), _double).alias("bounds"),
        F.transform(g("quantileValues"), lambda q: F.struct(_double(q["quantile"]).alias("q"), _double(q["value"]).alias("v"))).alias("quantiles"),
        F.when(F.col("k.kind") == "exponential_histogram", F.to_json(F.struct(g("scale").alias("scale"), g("zeroCount").alias("zero_count"), g("zeroThreshold").alias("zero_threshold"), g("positive").alias("positive"), g("negative").alias("negative")))).alias("exp_json"),
        "metric_attrs",
        F.coalesce(F.transform(g("exemplars"), exemplar), F.array().cast(POINTS["exemplars"].dataType)).alias("exemplars"),
        "resource",
        "scope",
        _attrs(F.col("p.attributes")).alias("attrs"),
    )
    return _finish(out, POINTS)
