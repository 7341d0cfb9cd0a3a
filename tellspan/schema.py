"""Canonical tables: one row per record, attributes nested in it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds of attribute values, by the number that ``KV.type`` holds.
KINDS = ("empty", "str", "int", "double", "bool", "bytes", "array", "map")
EMPTY, STR, INT, DOUBLE, BOOL, BYTES, ARRAY, MAP = range(8)

KV = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("type", T.ByteType()),
        T.StructField("s", T.StringType()),
        T.StructField("i", T.LongType()),
        T.StructField("d", T.DoubleType()),
        T.StructField("b", T.BooleanType()),
        T.StructField("bytes", T.BinaryType()),
        T.StructField("json", T.StringType()),
    ]
)
ATTRS = T.ArrayType(KV)


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
_TAIL = (("resource", ATTRS), ("scope", ATTRS), ("attrs", ATTRS), ("node", _L), ("seq", _L), ("row", _L))

EVENT = _table(("ts_ns", _L), ("name", _S), ("dropped_attributes_count", _L), ("attrs", ATTRS))
LINK = _table(("trace_id", _S), ("span_id", _S), ("trace_state", _S), ("flags", _L), ("dropped_attributes_count", _L), ("attrs", ATTRS))
EXEMPLAR = _table(("ts_ns", _L), ("i", _L), ("d", _D), ("trace_id", _S), ("span_id", _S), ("attrs", ATTRS))

LOGS = _table(
    ("ts_ns", _L), ("observed_ns", _L), ("severity_number", _I), ("severity_text", _S), ("event_name", _S), ("body", _S), ("body_json", _S),
    ("trace_id", _S), ("span_id", _S), ("flags", _L), ("dropped_attributes_count", _L), *_TAIL,
)
SPANS = _table(
    ("ts_ns", _L), ("duration_ns", _L), ("trace_id", _S), ("span_id", _S), ("parent_span_id", _S), ("trace_state", _S), ("flags", _L), ("name", _S),
    ("kind", _I), ("status_code", _I), ("status_message", _S), ("dropped_attributes_count", _L), ("dropped_events_count", _L), ("dropped_links_count", _L),
    ("events", T.ArrayType(EVENT)), ("links", T.ArrayType(LINK)), *_TAIL,
)
POINTS = _table(
    ("ts_ns", _L), ("start_ns", _L), ("name", _S), ("description", _S), ("unit", _S), ("kind", _S), ("temporality", _I), ("monotonic", _B),
    ("v_int", _L), ("v_dbl", _D), ("count", _L), ("sum", _D), ("min", _D), ("max", _D), ("bucket_counts", T.ArrayType(_L)), ("bounds", T.ArrayType(_D)),
    ("quantiles", T.ArrayType(_table(("q", _D), ("v", _D)))), ("exp_json", _S), ("metric_attrs", ATTRS), ("exemplars", T.ArrayType(EXEMPLAR)), *_TAIL,
)

#: What root columns are called in documents, by the column that holds them, with the type that decides how they compare.
LOG_FIELDS = {
    "time_unix_nano": ("ts_ns", "int"), "observed_time_unix_nano": ("observed_ns", "int"), "severity_number": ("severity_number", "int"),
    "severity_text": ("severity_text", "str"), "event_name": ("event_name", "str"), "body": ("body", "str"), "trace_id": ("trace_id", "id"),
    "span_id": ("span_id", "id"), "flags": ("flags", "int"), "dropped_attributes_count": ("dropped_attributes_count", "int"),
}
SPAN_FIELDS = {
    "start_time_unix_nano": ("ts_ns", "int"), "duration_nano": ("duration_ns", "int"), "trace_id": ("trace_id", "id"), "span_id": ("span_id", "id"),
    "parent_span_id": ("parent_span_id", "id"), "trace_state": ("trace_state", "str"), "flags": ("flags", "int"), "name": ("name", "str"), "kind": ("kind", "int"),
    "status_code": ("status_code", "int"), "status_message": ("status_message", "str"), "dropped_attributes_count": ("dropped_attributes_count", "int"),
    "dropped_events_count": ("dropped_events_count", "int"), "dropped_links_count": ("dropped_links_count", "int"),
}
FIELDS = {"logs": LOG_FIELDS, "traces": SPAN_FIELDS}


def kv(key: str, value: Column, kind: str) -> Column:
    """An attribute from a column of one kind (str, int, double, bool); null where the value is null."""
    null = {"s": "string", "i": "bigint", "d": "double", "b": "boolean"}
    slot = {"str": "s", "int": "i", "double": "d", "bool": "b"}[kind]
    parts = [F.lit(key).alias("key"), F.lit(KINDS.index(kind)).cast("tinyint").alias("type")]
    parts += [(value if n == slot else F.lit(None)).cast(t).alias(n) for n, t in null.items()]
    parts += [F.lit(None).cast("binary").alias("bytes"), F.lit(None).cast("string").alias("json")]
    return F.when(value.isNotNull(), F.struct(*parts))


def attributes(*entries: Column) -> Column:
    """An attribute list of those entries that are not null."""
    if not entries:
        return F.array().cast(ATTRS)
    return F.filter(F.array(*entries), lambda x: x.isNotNull())


def text_of(attrs: str, key: str) -> Column:
    """The last string value of ``key`` in an attribute list, or null."""
    return F.expr(f"try_element_at(filter({attrs}, x -> x.key = '{key}' AND x.type = {STR}), -1).s")
