"""Deterministic synthetic requests and records, for demonstrations and tests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import attributes, kv


def logs_request(service: str, base: int, n: int) -> str:
    """An export request of n records: even ones are errors of POST, odd ones information of GET."""
    text = lambda k, v: {"key": k, "value": {"stringValue": v}}
    records = [
        {"timeUnixNano": str(base + i), "severityNumber": 9 if i % 2 else 17, "severityText": "INFO" if i % 2 else "ERROR", "body": {"stringValue": f"{service} handled request {i}"}, "attributes": [text("http.request.method", "GET" if i % 2 else "POST")], "traceId": "ab" * 16, "spanId": "cd" * 8}
        for i in range(n)
    ]
    return json.dumps({"resourceLogs": [{"resource": {"attributes": [text("service.name", service), text("deployment.env", "prod")]}, "scopeLogs": [{"scope": {"name": "demo"}, "logRecords": records}]}]})


def spans_request(hops: list[tuple[str, str | None]], trace_id: str, base: int, length: int = 1_000) -> str:
    """An export request of one trace: a span for each (service, caller), callers named before those they call; the last one fails."""
    text = lambda k, v: {"key": k, "value": {"stringValue": v}}
    ids = {service: f"{n + 1:016x}" for n, (service, _) in enumerate(hops)}
    groups = []
    for n, (service, caller) in enumerate(hops):
        span = {"traceId": trace_id, "spanId": ids[service], "parentSpanId": ids.get(caller, ""), "name": f"call {service}", "kind": 2, "startTimeUnixNano": str(base + 50 * n), "endTimeUnixNano": str(base + length - 50 * n), "status": {"code": 2 if n == len(hops) - 1 else 1}}
        groups.append({"resource": {"attributes": [text("service.name", service)]}, "scopeSpans": [{"scope": {"name": "demo"}, "spans": [span]}]})
    return json.dumps({"resourceSpans": groups})


def metrics_request(service: str, base: int, n: int, bounds: tuple[float, ...] = (2.0, 20.0, 200.0)) -> str:
    """An export request of n points each of a gauge, a growing sum, and a histogram whose counts fall by half from bucket to bucket."""
    shares = [2 ** (len(bounds) - k) for k in range(len(bounds) + 1)]
    at = [str(base + i) for i in range(n)]
    gauge = {"name": "queue.depth", "unit": "1", "gauge": {"dataPoints": [{"timeUnixNano": t, "asDouble": i % 7 / 2} for i, t in enumerate(at)]}}
    total = {"name": "requests", "sum": {"isMonotonic": True, "aggregationTemporality": 2, "dataPoints": [{"timeUnixNano": t, "asInt": str(3 * i)} for i, t in enumerate(at)]}}
    points = [{"timeUnixNano": t, "count": str(sum(shares) * (i + 1)), "sum": 10.0 * (i + 1), "bucketCounts": [str(s * (i + 1)) for s in shares], "explicitBounds": list(bounds)} for i, t in enumerate(at)]
    spread = {"name": "latency", "unit": "ms", "histogram": {"aggregationTemporality": 2, "dataPoints": points}}
    resource = {"attributes": [{"key": "service.name", "value": {"stringValue": service}}]}
    return json.dumps({"resourceMetrics": [{"resource": resource, "scopeMetrics": [{"scope": {"name": "demo"}, "metrics": [gauge, total, spread]}]}]})


def load(spark: SparkSession, rows: int, start_ns: int, services: int = 5) -> DataFrame:
    """Log records made from a range: one in 100 an error, one in a thousand slow."""
    i = F.col("id")
    return spark.range(rows).select(
        (F.lit(start_ns) + i * 1_000_000).alias("ts_ns"),
        F.when(i % 100 == 0, 17).otherwise(9).alias("severity_number"),
        F.when(i % 100 == 0, "ERROR").otherwise("INFO").alias("severity_text"),
        F.concat(F.lit("request "), i.cast("string")).alias("body"),
        F.md5((i / 8).cast("long").cast("string").cast("binary")).alias("trace_id"),
        attributes(kv("service.name", F.concat(F.lit("svc-"), (i % services).cast("string")), "str")).alias("resource"),
        attributes().alias("scope"),
        attributes(kv("http.status_code", F.when(i % 100 == 0, 500).otherwise(200), "int"), kv("slow", i % 1000 == 0, "bool")).alias("attrs"),
        F.lit(0).cast("long").alias("node"),
        F.lit(0).cast("long").alias("seq"),
        i.alias("row"),
    )
