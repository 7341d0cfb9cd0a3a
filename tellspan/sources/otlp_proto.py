"""OTLP/protobuf export requests: the wire format to OTLP/JSON text, from where ``otlp_json`` goes on."""

from __future__ import annotations

import base64
import json
import struct

import pyarrow as pa
from pyspark.sql import DataFrame

# Field numbers of the public OTLP messages: number to (name, type). A list in brackets is repeated.
_KV: dict = {1: ("key", "str"), 2: ("value", "any")}
_RESOURCE = {1: ("attributes", [_KV]), 2: ("droppedAttributesCount", "int")}
_SCOPE = {1: ("name", "str"), 2: ("version", "str"), 3: ("attributes", [_KV]), 4: ("droppedAttributesCount", "int")}
_LOG = {1: ("timeUnixNano", "fixed"), 11: ("observedTimeUnixNano", "fixed"), 2: ("severityNumber", "int"), 3: ("severityText", "str"), 5: ("body", "any"), 6: ("attributes", [_KV]), 7: ("droppedAttributesCount", "int"), 8: ("flags", "fixed32"), 9: ("traceId", "hex"), 10: ("spanId", "hex"), 12: ("eventName", "str")}
_EVENT = {1: ("timeUnixNano", "fixed"), 2: ("name", "str"), 3: ("attributes", [_KV]), 4: ("droppedAttributesCount", "int")}
_LINK = {1: ("traceId", "hex"), 2: ("spanId", "hex"), 3: ("traceState", "str"), 4: ("attributes", [_KV]), 5: ("droppedAttributesCount", "int"), 6: ("flags", "fixed32")}
_SPAN = {
    1: ("traceId", "hex"), 2: ("spanId", "hex"), 3: ("traceState", "str"), 4: ("parentSpanId", "hex"), 5: ("name", "str"), 6: ("kind", "int"), 7: ("startTimeUnixNano", "fixed"), 8: ("endTimeUnixNano", "fixed"), 9: ("attributes", [_KV]),
    10: ("droppedAttributesCount", "int"), 11: ("events", [_EVENT]), 12: ("droppedEventsCount", "int"), 13: ("links", [_LINK]), 14: ("droppedLinksCount", "int"), 15: ("status", {2: ("message", "str"), 3: ("code", "int")}), 16: ("flags", "fixed32"),
}
_EXEMPLAR = {7: ("filteredAttributes", [_KV]), 2: ("timeUnixNano", "fixed"), 3: ("asDouble", "double"), 6: ("asInt", "sfixed"), 4: ("spanId", "hex"), 5: ("traceId", "hex")}
_NUMBER = {7: ("attributes", [_KV]), 2: ("startTimeUnixNano", "fixed"), 3: ("timeUnixNano", "fixed"), 4: ("asDouble", "double"), 6: ("asInt", "sfixed"), 5: ("exemplars", [_EXEMPLAR]), 8: ("flags", "int")}
_HISTOGRAM = {9: ("attributes", [_KV]), 2: ("startTimeUnixNano", "fixed"), 3: ("timeUnixNano", "fixed"), 4: ("count", "fixed"), 5: ("sum", "double"), 6: ("bucketCounts", ["fixed"]), 7: ("explicitBounds", ["double"]), 8: ("exemplars", [_EXEMPLAR]), 10: ("flags", "int"), 11: ("min", "double"), 12: ("max", "double")}
_BUCKETS = {1: ("offset", "sint"), 2: ("bucketCounts", ["int"])}
_EXPONENTIAL = {
    1: ("attributes", [_KV]), 2: ("startTimeUnixNano", "fixed"), 3: ("timeUnixNano", "fixed"), 4: ("count", "fixed"), 5: ("sum", "double"), 6: ("scale", "sint"), 7: ("zeroCount", "fixed"), 8: ("positive", _BUCKETS), 9: ("negative", _BUCKETS),
    10: ("flags", "int"), 11: ("exemplars", [_EXEMPLAR]), 12: ("min", "double"), 13: ("max", "double"), 14: ("zeroThreshold", "double"),
}
_SUMMARY = {7: ("attributes", [_KV]), 2: ("startTimeUnixNano", "fixed"), 3: ("timeUnixNano", "fixed"), 4: ("count", "fixed"), 5: ("sum", "double"), 6: ("quantileValues", [{1: ("quantile", "double"), 2: ("value", "double")}]), 8: ("flags", "int")}


def _data(point: dict) -> dict:
    return {1: ("dataPoints", [point]), 2: ("aggregationTemporality", "int"), 3: ("isMonotonic", "bool")}


_METRIC = {1: ("name", "str"), 2: ("description", "str"), 3: ("unit", "str"), 5: ("gauge", _data(_NUMBER)), 7: ("sum", _data(_NUMBER)), 9: ("histogram", _data(_HISTOGRAM)), 10: ("exponentialHistogram", _data(_EXPONENTIAL)), 11: ("summary", _data(_SUMMARY)), 12: ("metadata", [_KV])}


def _request(top: str, scopes: str, items: str, item: dict) -> dict:
    return {1: (top, [{1: ("resource", _RESOURCE), 2: (scopes, [{1: ("scope", _SCOPE), 2: (items, [item])}])}])}


REQUESTS = {"logs": _request("resourceLogs", "scopeLogs", "logRecords", _LOG), "traces": _request("resourceSpans", "scopeSpans", "spans", _SPAN), "metrics": _request("resourceMetrics", "scopeMetrics", "metrics", _METRIC)}
_ANY = {1: ("stringValue", "str"), 2: ("boolValue", "bool"), 3: ("intValue", "long"), 4: ("doubleValue", "double"), 5: ("arrayValue", {1: ("values", ["any"])}), 6: ("kvlistValue", {1: ("values", [_KV])}), 7: ("bytesValue", "b64")}


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        out |= (b & 127) << shift
        at += 1
        if b < 128:
            return out, at
        shift += 7
        if shift > 63:
            raise ValueError("varint too long")


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _scalar(kind: str, wire: int, raw):
    if kind == "str":
        return raw.decode()
    if kind == "hex":
        return raw.hex()
    if kind == "b64":
        return base64.b64encode(raw).decode()
    if kind == "bool":
        return bool(raw)
    if kind == "double":
        v = struct.unpack("<d", struct.pack("<Q", raw))[0]
        return v if v == v and abs(v) != float("inf") else "NaN" if v != v else "Infinity" if v > 0 else "-Infinity"
    if kind == "sint":
        return (raw >> 1) ^ -(raw & 1)
    if kind in ("long", "sfixed"):
        return str(_signed(raw))
    return str(raw) if kind == "fixed" else raw


def decode(data: bytes, message: dict) -> dict:
    """A message as OTLP/JSON has it. Unknown fields are skipped; of a repeated singular field the last counts."""
    out: dict = {}
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            raw, at = _varint(data, at)
        elif wire == 1:
            raw, at = int.from_bytes(data[at : at + 8], "little"), at + 8
        elif wire == 5:
            raw, at = int.from_bytes(data[at : at + 4], "little"), at + 4
        elif wire == 2:
            size, at = _varint(data, at)
            if at + size > len(data):
                raise ValueError("truncated message")
            raw, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {wire}")
        if number not in message:
            continue
        name, kind = message[number]
        many = isinstance(kind, list)
        kind = kind[0] if many else kind
        if isinstance(kind, dict):
            got = [decode(raw, kind)]
        elif kind == "any":
            got = [decode(raw, _ANY)]
        elif many and wire == 2:  # packed
            got, i = [], 0
            while i < len(raw):
                if kind == "int":
                    n, i = _varint(raw, i)
                else:
                    n, i = int.from_bytes(raw[i : i + 8], "little"), i + 8
                got.append(_scalar(kind, 0, n))
        else:
            got = [_scalar(kind, wire, raw)]
        if many:
            out.setdefault(name, []).extend(got)
        else:
            out[name] = got[-1]
    return out


def to_json(requests: DataFrame, signal: str, column: str = "content") -> DataFrame:
    """(value, error): each binary request as OTLP/JSON text, or why it can't be read."""
    message, top = REQUESTS[signal], REQUESTS[signal][1][0]

    def run(batches):
        for batch in batches:
            values, errors = [], []
            for raw in batch.column(0).to_pylist():
                try:
                    values.append(json.dumps({top: []} | decode(raw or b"", message)))
                    errors.append(None)
                except (ValueError, IndexError) as e:
                    values.append(None)
                    errors.append(f"not a request: {e}")
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array(errors, pa.string())], ["value", "error"])

    return requests.select(column).mapInArrow(run, "value string, error string")
