"""More of the engine's operators over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import alerts, frame, rca, search, series, services, trace
from .operators.predicate import compare, predicate
from .plans import documents as D
from .queries import DAY, NOW, START, _page, _with
from .schema import LOGS
from .sources import adapters, kubernetes, otlp_json, storage

ALL = (-(1 << 63), (1 << 63) - 1)


def _counts(table: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """(term, matched): how many rows satisfy each test, in one scan."""
    one = table.agg(*(F.count_if(F.coalesce(t, F.lit(False))).alias(f"n{i}") for i, t in enumerate(tests.values())))
    return one.select(F.expr(f"stack({len(tests)}, {', '.join(f'''{chr(39)}{k}{chr(39)}, n{i}''' for i, k in enumerate(tests))}) as (term, matched)"))


def _sql_counts(view: str, tests: dict[str, str]) -> str:
    return _with(view, " UNION ALL ".join(f"SELECT '{k}' AS term, count_if({v})::BIGINT AS matched FROM {view}" for k, v in tests.items()))


def _terms(table: DataFrame, signal: str, found: dict[str, D.Term]) -> dict[str, Column]:
    return {k: predicate([t], signal, table.columns) for k, t in found.items()}


_A = lambda name, op, value: D.Term("attr", name, op, value)
_F = lambda name, op, value: D.Term("field", name, op, value)

#: Tests of root columns: of a term, and the same in SQL.
_COLUMNS = {
    "int": (_F("severity_number", "lte", "9"), "severity_number <= 9"),
    "time": (_F("time_unix_nano", "gt", 1_700_000_000_500_000_000), "ts_ns > 1700000000500000000"),
    "text order": (_F("body", "gte", "m"), "body >= 'm'"),
    "text part": (_F("body", "contains", "ring"), "contains(body, 'ring')"),
    "id order": (_F("span_id", "lt", f"{0x4000:016X}"), f"span_id < '{0x4000:016x}'"),
    "id ne": (_F("span_id", "ne", f"{26:016x}"), f"span_id <> '{26:016x}'"),
    "null text": (_F("event_name", "ne", "x"), "FALSE"),
}
#: Tests of stored text.
_TEXT = {
    "eq": (_A("status", "eq", 200), "status = '200'"),
    "eq truth": (_A("status", "eq", True), "status = 'true'"),
    "ne": (_A("label", "ne", 8.0), "label <> '8'"),
    "contains number": (_A("label", "contains", 4), "contains(label, '4')"),
    "order by number": (_A("label", "gt", 9), "CASE WHEN regexp_full_match(label, '[0-9]+') THEN label::DOUBLE > 9 ELSE label > '9' END"),
    "order by text": (_A("label", "gt", "9"), "label > '9'"),
    "any level": (_A("tier", "eq", 1), "tier = 1"),
    "scope": (_A("otel.scope.name", "lt", "Brand#3"), "scope_name < 'Brand#3'"),
    "both levels": (_A("tier", "ne", "x"), "TRUE"),
}
#: Tests of other kinds.
_TYPED = {
    "double lt": (_A("price", "lt", 1000), "price < 1000 AND NOT isnan(price)"),
    "double ne": (_A("price", "ne", 901.0), "price <> 901.0 AND NOT isnan(price)"),
    "int of whole": (_A("size", "gte", 100.0), "size2 >= 100"),
    "int of text": (_A("size", "eq", "7"), "size = 7"),
    "int of fraction": (_A("size", "ne", 7.5), "FALSE"),
    "ne some": (_A("size", "ne", 7), "size <> 7 OR size2 <> 7"),
    "bool": (_A("large", "eq", "true"), "large"),
    "bool order": (_A("large", "lt", True), "NOT large"),
    "bool of number": (_A("large", "eq", 1), "FALSE"),
    "bytes": (_A("raw", "ne", "x"), "FALSE"),
    "list": (_A("list", "contains", "1"), "FALSE"),
    "none": (_A("none", "ne", 1), "FALSE"),
    "missing": (_A("nowhere", "ne", 1), "FALSE"),
}


def _part_terms(spark, sf_dir, found):
    t = adapters.parts(spark, sf_dir).withColumn("event_name", F.lit(None).cast("string"))
    return _counts(t, _terms(t, "logs", {k: v[0] for k, v in found.items()}))


def predicates_columns(spark, sf_dir):
    return _part_terms(spark, sf_dir, _COLUMNS)


def predicates_text(spark, sf_dir):
    return _part_terms(spark, sf_dir, _TEXT)


def predicates_typed(spark, sf_dir):
    return _part_terms(spark, sf_dir, _TYPED)


def predicates_kinds(spark, sf_dir):
    """Columns of doubles and truth values: NaN and null match nothing, and a value of another kind neither."""
    p = adapters.prices(spark, sf_dir).withColumn("x", F.when(F.col("row") % 5 == 0, float("nan")).otherwise(F.col("sum")))
    odd = F.col("row") % 2 == 1
    tests = {"ne": compare(F.col("x"), "double", "ne", "100000.5"), "gt": compare(F.col("x"), "double", "gt", 100000.5), "double of truth": compare(F.col("x"), "double", "ne", True), "part of double": compare(F.col("x"), "double", "contains", "1"), "false first": compare(odd, "bool", "lt", True), "truth of text": compare(odd, "bool", "ne", "true"), "truth of number": compare(odd, "bool", "eq", 1)}
    return _counts(p, tests)


def predicates_children(spark, sf_dir):
    """Attributes of a span's events and links select the span; its own and theirs add up."""
    t = adapters.calls(spark, sf_dir)
    return _counts(t, _terms(t, "traces", {k: v[0] for k, v in _CHILDREN.items()}))


_CHILDREN = {
    "event": (_A("level", "eq", 2), "level = 2"),
    "event text": (_A("state", "ne", "F"), "state <> 'F'"),
    "link": (_A("customer", "lt", 40), "customer < 40"),
    "own or event": (_A("level", "gte", 5), "TRUE"),
}


def search_yaml(spark, sf_dir):
    """A search as YAML, with times relative to now, a cursor, and a limit above the cap."""
    text = f"""
where:
  - {{field: severity_number, gte: 13}}
  - {{attr: service.name, ne: svc-1}}
from: -8d
to: "-2d"
limit: 50000
after: {D.Cursor(NOW - 3 * DAY, 0, 0, 0)!s:s}
cursors: true
"""
    q = D.search(text.replace("after: ", "after: '").replace("\ncursors", "'\ncursors"), NOW)
    return search.search(adapters.logs(spark, sf_dir), q).select("row", "ts_ns", "cursor")


def search_defaults(spark, sf_dir):
    """An empty document: the last hour, at most a hundred rows."""
    end = NOW - DAY
    return search.search(adapters.logs(spark, sf_dir), D.search("{}", end)).select("row", "ts_ns")


def filter_bar_search(spark, sf_dir):
    """A filter bar's line to terms, to text, and to terms again; the service is replaced, and a term added twice counts once."""
    from .schema import LOG_FIELDS

    line = 'severity_number>=13 service.name=svc-9 attr:k<50 purchase half= value!=25.5'
    found = D.filter_bar(line, LOG_FIELDS)
    found = D.add_term(D.with_service(found, "svc-2"), found[0])
    found = D.filter_bar(D.bar_text(found, LOG_FIELDS), LOG_FIELDS, strict=True)
    return search.matching(adapters.logs(spark, sf_dir), D.Search("logs", START, NOW, tuple(found))).select("row", "ts_ns")


def search_pages(spark, sf_dir):
    """Page after page until none follows: rows of each, matches behind its cursor, rows scanned, and the next cursor."""
    q = D.search({"where": [{"field": "severity_number", "gte": 17}], "from": START, "to": NOW, "limit": 700}, NOW)
    return search.pages(adapters.logs(spark, sf_dir), q)


def attributes_rendered(spark, sf_dir):
    """Every attribute of parts as JSON, by kind."""
    p = adapters.parts(spark, sf_dir).select("row", F.explode("attrs").alias("x"))
    return p.select("row", F.col("x.key").alias("key"), F.regexp_extract(search.any_value(F.col("x")), r'(?s)^\{"v":(.*)\}$', 1).alias("json"))


def attributes_merged(spark, sf_dir):
    """Resource, scope and record attributes of a part as one object; the innermost level wins, and the last of a repeated key."""
    p = adapters.parts(spark, sf_dir)
    keep = p.withColumn("attrs", F.filter("attrs", lambda x: x["key"].isin("size", "large", "label")))
    return keep.select("row", search.merged(p.columns).alias("json"))


def render_turns(spark, sf_dir):
    return search.render(adapters.convo(spark, sf_dir), "traces")


def render_calls(spark, sf_dir):
    """Spans with their events and links as the objects that searches return."""
    return search.render(adapters.calls(spark, sf_dir), "traces")


def map_budget(spark, sf_dir):
    """The service map of the newest 5,000 spans."""
    q = D.service_map({"from": 0, "to": NOW, "max_spans": 5_000}, NOW)
    return services.map_nodes(adapters.spans(spark, sf_dir), q.start, q.end, q.max_spans).select("name", "spans", "errors", F.col("total_ns").cast("long").alias("total_ns"))


def series_derived(spark, sf_dir):
    """A histogram's two series by priority, newest points first."""
    q = replace(D.series({"from": 0, "to": NOW, "where": [{"field": "priority", "ne": "5-LOW"}], "max_points": 40}, NOW), name=None)
    return series.series_points(adapters.prices(spark, sf_dir), q).select("name", "attributes", "ts_ns", "v_int", "v_dbl", "dropped_points")


def series_half(spark, sf_dir):
    """``x.sum`` asks for a half of ``x`` where no metric has that name."""
    q = D.series({"name": "order.price.sum", "from": 0, "to": NOW}, NOW)
    return series.values(adapters.prices(spark, sf_dir), q).groupBy("name", "attributes").agg(F.count("*").alias("points"), F.min("v_dbl").alias("least"), F.max("v_dbl").alias("most"))


def series_exemplars(spark, sf_dir):
    """The earliest exemplars of each series, among those of the points that are kept."""
    q = D.series({"name": "order.price.count", "from": 0, "to": NOW, "max_points": 500}, NOW)
    return series.series(adapters.prices(spark, sf_dir), q, 10).select("attributes", F.posexplode("exemplars").alias("place", "e")).select("attributes", "place", F.col("e.ts_ns").alias("ts_ns"), F.col("e.span_id").alias("span_id"), F.col("e.d").alias("value"))


def series_charts(spark, sf_dir):
    return series.charts(series.values(adapters.prices(spark, sf_dir).unionByName(adapters.points(spark, sf_dir)), D.SeriesQuery(None, 0, NOW)))


def alert_slow_share(spark, sf_dir):
    """A percentile rule as a ratio: more than five percent of spans over 45 ms means that the 95th percentile is over it."""
    found = alerts.rule({"name": "p95", "query": {"signal": "traces", "where": [{"field": "name", "eq": "line"}, {"field": "duration_nano", "gt": 45_000_000}]}, "of": {"signal": "traces", "where": [{"field": "name", "eq": "line"}]}, "when": "ratio > 5%", "over": "3650d"})
    spans = adapters.spans(spark, sf_dir)
    return alerts.measure({"traces": spans}, found, 946_684_800_000_000_000).select("matched", "total", (F.col("matched") / F.col("total") > found.threshold).alias("breach"))


_STEADY = alerts.rule({"name": "steady", "query": {"where": [{"field": "severity_number", "gte": 17}]}, "of": {}, "when": "ratio > 20%", "over": "6h", "for": "2h"})


def alert_states(spark, sf_dir):
    """A rule's phase at every tick of five days, and what it told."""
    rows = alerts.ticks(adapters.logs(spark, sf_dir), _STEADY, NOW - 5 * DAY, NOW, D.HOUR).orderBy("at_ns").collect()  # a row for each tick
    return spark.createDataFrame(alerts.replay(rows, _STEADY), "at_ns long, phase string, news string")


def scale_decisions(spark, sf_dir):
    """Of each nation's suppliers, what their balances as free shares decide."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_nationkey", (F.col("s_acctbal") / 10_000).alias("free"))
    out = None
    for low, high in ((0.0, 0.05), (0.05, 0.9), (0.95, 0.99)):
        one = services.scale_decision(s, low, high).withColumn("low", F.lit(low))
        out = one if out is None else out.unionByName(one)
    return out.unionByName(services.scale_decision(s.limit(0), 0.1, 0.2).withColumn("low", F.lit(-1.0)))


_SLOW = {"signal": "traces", "from": 800_000_000_000_000_000, "to": 830_000_000_000_000_000, "where": [{"field": "duration_nano", "gte": 50_000_000}, {"field": "status_code", "eq": 2}], "expand": ["around:2h", "traces", "peers"]}


def frame_anchor(spark, sf_dir):
    """A frame that has more traces than it may hold, with its statistics."""
    f = frame.anchor(adapters.logs(spark, sf_dir), D.search({"from": START, "to": NOW}, NOW), stats=True)
    return spark.createDataFrame([(f.start, f.end, len(f.traces), len(f.entities), f.truncated, f.matched, f.scanned)], "start long, end long, traces long, entities long, truncated boolean, matched long, scanned long")


def frame_walk(spark, sf_dir):
    """A walk of three steps: the window, and each entity with its name."""
    spans = adapters.spans(spark, sf_dir)
    f = frame.correlate(spans, spans, D.correlate(_SLOW, NOW))
    names = frame.names_of(f, [spans])
    return spark.createDataFrame([(k, names[k], f.start, f.end) for k in f.entities], "entity string, name string, start long, end long")


def frame_rollup(spark, sf_dir):
    """Services of a frame with the number of their entities."""
    logs = adapters.logs(spark, sf_dir)
    found = frame.anchor_entities(logs, D.search({"from": NOW - 2 * DAY, "to": NOW}, NOW))
    return services.rollup(found.select(F.regexp_extract("entity", r"service\.name=1:([^|]*)", 1).alias("name")))


def write_up_counts(spark, sf_dir):
    """The citations of a write-up, counted: one inherits the incident's window, one cites a trace."""
    doc = {"title": "Errors", "from": NOW - 3 * DAY, "to": NOW - 2 * DAY, "summary": "s", "root_cause": "r", "timeline": [], "evidence": [{"claim": "errors", "query": {"where": [{"field": "severity_number", "gte": 17}]}}, {"claim": "clicks", "query": {"from": START, "to": NOW, "where": [{"field": "body", "contains": "click"}]}}, {"claim": "trace", "trace_id": f"{1:032x}"}]}
    found = rca.verify(rca.write_up(doc, NOW), {"logs": adapters.logs(spark, sf_dir), "traces": adapters.spans(spark, sf_dir)})
    return spark.createDataFrame([(f.claim, f.found) for f in found.evidence], "claim string, found long")


def _text(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), F.struct(value.alias("stringValue")).alias("value"))


def otlp_logs(spark, sf_dir):
    """Events as OTLP/JSON requests, decoded: times as text, an observed time where the own one is missing, ids in upper case, values of several kinds."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ns", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string"))
    value = lambda n, v: F.struct(F.lit(n).alias("key"), v.alias("value"))
    record = F.struct(
        F.when(F.col("event_id") % 4 > 0, F.col("ns")).alias("timeUnixNano"), F.col("ns").alias("observedTimeUnixNano"), F.when(F.col("event_type") == "error", F.lit("SEVERITY_NUMBER_ERROR")).otherwise(F.lit("SEVERITY_NUMBER_INFO")).alias("severityNumber"),
        F.struct(F.col("event_type").alias("stringValue")).alias("body"), F.upper(F.lpad(F.hex("event_id"), 32, "0")).alias("traceId"), F.lit("zz").alias("spanId"),
        F.to_json(F.array(F.to_json(value("user", F.struct(F.col("user_id").cast("string").alias("intValue")))), F.to_json(value("big", F.struct((F.col("user_id") > 50).alias("boolValue")))))).alias("x"),
    )
    attrs = F.concat(F.lit("["), F.to_json(value("user", F.struct(F.col("user_id").cast("string").alias("intValue")))), F.lit(","), F.to_json(value("big", F.struct((F.col("user_id") > 50).alias("boolValue")))), F.lit("]"))
    body = F.concat(F.regexp_replace(F.to_json(record.dropFields("x")), r"\}$", ""), F.lit(',"attributes":'), attrs, F.lit("}"))
    resource = F.to_json(F.struct(F.array(_text("service.name", F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")))).alias("attributes")))
    request = F.concat(F.lit('{"resourceLogs":[{"resource":'), resource, F.lit(',"scopeLogs":[{"scope":{"name":"web"},"logRecords":['), body, F.lit("]}]}]}"))
    rows = otlp_json.logs(e.select(request.alias("value")), 7)
    pick = lambda key, slot: F.expr(f"try_element_at(filter(attrs, x -> x.key = '{key}'), 1).{slot}")
    return rows.select("ts_ns", "severity_number", "body", "trace_id", "span_id", pick("user", "i").alias("user"), pick("big", "b").alias("big"), F.col("resource")[0]["s"].alias("service"), F.col("scope")[0]["s"].alias("scope"))


def otlp_spans(spark, sf_dir):
    """Orders as snake-case OTLP/JSON spans, decoded: an end before the start, kinds out of range, an event each."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000
    event = F.array(F.struct((at + 5).cast("string").alias("time_unix_nano"), F.col("o_orderstatus").alias("name")))
    span = F.struct(F.lpad(F.lower(F.hex("o_orderkey")), 32, "0").alias("trace_id"), F.lpad(F.lower(F.hex("o_orderkey")), 16, "0").alias("span_id"), F.col("o_orderpriority").alias("name"), ((F.col("o_orderkey") % 9) - 1).cast("int").alias("kind"), at.cast("string").alias("start_time_unix_nano"), (at + F.col("o_orderkey") % 100 - 20).cast("string").alias("end_time_unix_nano"), F.struct((F.col("o_custkey") % 4).cast("int").alias("code")).alias("status"), event.alias("events"))
    request = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.array(span).alias("spans"))).alias("scope_spans"))).alias("resource_spans")))
    return otlp_json.spans(o.select(request.alias("value"))).select("ts_ns", "duration_ns", "trace_id", "name", "kind", "status_code", F.col("events")[0]["name"].alias("event"), F.col("events")[0]["ts_ns"].alias("event_ns"))


def otlp_points(spark, sf_dir):
    """Orders as OTLP/JSON points of a gauge, a sum and a histogram, decoded."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    at, key = (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000).cast("string"), F.col("o_orderkey")
    one = lambda *cols: F.struct(F.array(F.struct(at.alias("timeUnixNano"), *cols)).alias("dataPoints"))
    gauge = F.struct(F.lit("price").alias("name"), F.lit("").alias("unit"), one(F.col("o_totalprice").alias("asDouble"), F.lit("1").alias("asInt")).alias("gauge"))
    total = F.struct(F.lit("orders").alias("name"), F.lit("{order}").alias("unit"), one(key.cast("string").alias("asInt")).withField("isMonotonic", F.lit(True)).withField("aggregationTemporality", F.lit(2)).alias("sum"))
    spread = F.struct(F.lit("lines").alias("name"), one((key % 7).cast("string").alias("count"), F.when(key % 2 == 0, F.col("o_totalprice")).alias("sum"), F.array((key % 3).cast("string"), F.lit("4")).alias("bucketCounts"), F.array(F.lit(10.0)).alias("explicitBounds")).alias("histogram"))
    metrics = F.concat(F.lit("["), F.concat_ws(",", F.to_json(gauge), F.to_json(total), F.to_json(spread)), F.lit("]"))
    request = F.concat(F.lit('{"resourceMetrics":[{"scopeMetrics":[{"metrics":'), metrics, F.lit("}]}]}"))
    return otlp_json.points(o.select(request.alias("value"))).select("ts_ns", "name", "unit", "kind", "temporality", "monotonic", "v_int", "v_dbl", "count", "sum", F.col("bucket_counts")[1].alias("second"), F.col("bounds")[0].alias("bound"))


def otlp_refused(spark, sf_dir):
    """Requests by whether they have the member that they must have."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr("element_at(array('{\"resourceLogs\":[]}', '{\"resource_logs\":null}', '{}', '{\"resource_log\":[]}', props, '[1]', 'nonsense'), cast(event_id % 7 as int) + 1)").alias("value"), (F.col("event_id") % 7).alias("form"))
    return otlp_json.valid(e, "logs").groupBy("form").agg(F.count_if(F.col("error").isNotNull()).alias("refused"), F.count("*").alias("requests"))


def _objects(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    time = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    k = F.col("event_id")
    involved = F.struct(F.when(k % 3 == 0, "Pod").when(k % 3 == 1, "Job").otherwise("Widget").alias("kind"), F.concat(F.lit("o-"), (F.col("user_id") % 20).cast("string")).alias("name"), F.concat(F.lit("u-"), F.col("user_id").cast("string")).alias("uid"), F.lit("shop").alias("namespace"))
    event = F.struct(F.when(F.col("event_type") == "error", "Warning").otherwise("Normal").alias("type"), F.col("event_type").alias("reason"), F.col("props").alias("message"), F.when(k % 4 == 1, time).alias("eventTime"), F.when(k % 4 == 2, time).alias("lastTimestamp"), F.when(k % 4 == 3, time).alias("firstTimestamp"), (k % 3).alias("count"), involved.alias("involvedObject"))
    return e.select(F.to_json(event).alias("value"))


def kubernetes_events(spark, sf_dir):
    """Cluster events made of ``events``, as records; those without any time are none."""
    got = kubernetes.events(_objects(spark, sf_dir), 7)
    of = lambda level, key: F.expr(f"try_element_at(filter({level}, x -> x.key = '{key}'), 1).s")
    return got.select("ts_ns", "severity_number", "event_name", "body", of("attrs", "k8s.event.count").alias("repeats"), of("resource", "k8s.pod.name").alias("pod"), of("resource", "k8s.job.name").alias("job"), of("resource", "k8s.object.name").alias("other"), of("resource", "k8s.pod.uid").alias("uid"))


def kubernetes_groups(spark, sf_dir):
    """Records grouped by their resource: number of groups, and of records in them."""
    return kubernetes.by_resource(kubernetes.events(_objects(spark, sf_dir), 7)).agg(F.count("*").alias("resources"), F.sum(F.size("records")).alias("records"))


def kubernetes_pods(spark, sf_dir):
    """Pod states made of ``orders``, each delivered twice, as records."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey")
    ended = F.struct(F.struct((key % 3).alias("exitCode"), F.lit("Ended").alias("reason"), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("finishedAt")).alias("terminated"))
    waits = F.struct(F.struct(F.when(key % 2 == 0, "ErrImagePull").otherwise("ContainerCreating").alias("reason")).alias("waiting"))
    one = F.struct(F.lit("main").alias("name"), (key % 5).alias("restartCount"), waits.alias("state"), F.when(key % 4 == 0, ended).alias("lastState"))
    pod = F.struct(F.struct(F.concat(F.lit("pod-"), key.cast("string")).alias("uid")).alias("metadata"), F.struct(F.when(key % 10 > 0, F.array(one)).alias("containerStatuses"), F.when(key % 10 == 0, F.array(one)).alias("initContainerStatuses")).alias("status"))
    text = o.select(F.to_json(pod).alias("value"))
    got = kubernetes.pod_status(text.unionByName(text), 7)
    return got.select("ts_ns", "severity_number", "event_name", "body", F.expr("try_element_at(filter(resource, x -> x.key = 'k8s.pod.uid'), 1).s").alias("uid"))


def _stored(spark: SparkSession, table: DataFrame, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), "tellspan-scratch")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    half = START + 15 * DAY
    for seq, part in ((0, table.where(F.col("ts_ns") <= half)), (1, table.where(F.col("ts_ns") > half)), (1, table.where(F.col("ts_ns") > half))):  # the last batch runs twice
        storage.publish(part.drop("node", "seq"), path, seq)
    return path


def stored_window(spark, sf_dir):
    """A day of logs from hour-partitioned files; a batch that ran twice is there once."""
    logs = adapters.logs(spark, sf_dir)
    full = logs.select(*((F.col(f.name) if f.name in logs.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in LOGS))
    table = storage.read(spark, _stored(spark, full.withColumn("flags", F.col("row")), "stored"), LOGS)
    q = D.search({"from": NOW - 6 * DAY, "to": NOW - 5 * DAY, "where": [{"field": "severity_number", "lte": 13}]}, NOW)
    return search.matching(table, q).select(F.col("flags").alias("row"), "ts_ns", "seq", F.col("p").alias("hour"))


def trace_chain(spark, sf_dir):
    """Of each conversation, its deepest turn's way from the root as names would show it: depth, length and last span."""
    spans = adapters.convo(spark, sf_dir)
    t = trace.trace_tree(spans, paths=False)
    last = Window.partitionBy("trace_id").orderBy(F.desc("depth"), "span_id")
    return t.withColumn("n", F.row_number().over(last)).where("n = 1").select("trace_id", "depth", "span_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        predicates_columns, predicates_text, predicates_typed, predicates_kinds, predicates_children, search_yaml, search_defaults, filter_bar_search, search_pages, attributes_rendered, attributes_merged,
        render_turns, render_calls, map_budget, series_derived, series_half, series_exemplars, series_charts, alert_slow_share, alert_states, scale_decisions, frame_anchor, frame_walk, frame_rollup,
        write_up_counts, otlp_logs, otlp_spans, otlp_points, otlp_refused, kubernetes_events, kubernetes_groups, kubernetes_pods, stored_window, trace_chain,
    )
}

_NS = "epoch_us(ts)*1000"
_PRIORITY = "concat('{\"priority\":\"', priority, '\"}')"
_TIMES = {1: "eventTime", 2: "lastTimestamp", 3: "firstTimestamp"}
_LEVELS = """concat('[{"ts_ns":"', ts_ns + 1, '","name":"priority","attributes":{"level":"', level, '"}},{"ts_ns":"', ts_ns + 2, '","name":"state","attributes":{"state":"', state, '"}}]')"""

ORACLES: dict[str, str] = {
    "predicates_columns": _sql_counts("parts", {k: ("row IS NOT NULL" if v[1].startswith("severity") else v[1]) for k, v in _COLUMNS.items()}),
    "predicates_text": _sql_counts("parts", {k: v[1] for k, v in _TEXT.items()}),
    "predicates_typed": _sql_counts("parts", {k: v[1] for k, v in _TYPED.items()}),
    "predicates_kinds": _with("prices", ", p AS (SELECT *, CASE WHEN \"row\" % 5 = 0 THEN 'NaN'::DOUBLE ELSE total END AS x, \"row\" % 2 = 1 AS odd FROM prices) ") + " UNION ALL ".join(f"SELECT '{k}' AS term, count_if({v})::BIGINT AS matched FROM p" for k, v in {"ne": "x <> 100000.5 AND NOT isnan(x)", "gt": "x > 100000.5 AND NOT isnan(x)", "double of truth": "FALSE", "part of double": "FALSE", "false first": "NOT odd", "truth of text": "NOT odd", "truth of number": "FALSE"}.items()),
    "predicates_children": _sql_counts("calls", {k: v[1] for k, v in _CHILDREN.items()}),
    "search_yaml": _with("logs", f"SELECT \"row\", ts_ns, concat(ts_ns, '.0.0.', \"row\") AS cursor FROM logs WHERE severity_number >= 13 AND service <> 'svc-1' AND ts_ns BETWEEN {NOW - 8 * DAY} AND {NOW - 2 * DAY} AND ts_ns < {NOW - 3 * DAY} ORDER BY ts_ns DESC, \"row\" DESC LIMIT 10000"),
    "search_defaults": _with("logs", f'SELECT "row", ts_ns FROM logs WHERE ts_ns BETWEEN {NOW - DAY - D.HOUR} AND {NOW - DAY} ORDER BY ts_ns DESC, "row" DESC LIMIT 100'),
    "filter_bar_search": _with("logs", f"SELECT \"row\", ts_ns FROM logs WHERE severity_number >= 13 AND service = 'svc-2' AND k < 50 AND contains(body, 'purchase') AND value <> 25.5 AND ts_ns BETWEEN {START} AND {NOW}"),
    "search_pages": _with("logs", f""", m AS (SELECT *, row_number() OVER (ORDER BY ts_ns DESC, "row" DESC) - 1 AS i, count(*) OVER () AS c FROM logs WHERE severity_number >= 17 AND ts_ns BETWEEN {START} AND {NOW}),
      n AS (SELECT max(c) AS c FROM m), p AS (SELECT k::INTEGER AS page, c FROM n, range(0, (SELECT c // 700 + 1 FROM n)) t(k))
      SELECT page, least(700, c - 700 * page)::INTEGER AS rows, (c - 700 * page)::BIGINT AS matched, (SELECT count(*) FROM logs) AS scanned, (SELECT concat(ts_ns, '.0.0.', "row") FROM m WHERE i = 700 * page + 699) AS next FROM p"""),
    "attributes_rendered": _with("parts", """, x AS (SELECT "row", unnest([{'key': 'price', 'json': CASE WHEN isnan(price) THEN 'null' ELSE price::VARCHAR END}, {'key': 'size', 'json': concat('"', size, '"')}, {'key': 'large', 'json': large::VARCHAR},
      {'key': 'label', 'json': concat('"', label, '"')}, {'key': 'status', 'json': concat('"', status, '"')}, {'key': 'raw', 'json': concat('"', lower(hex(encode(scope_name))), '"')}, {'key': 'list', 'json': concat('[', size, ']')}, {'key': 'none', 'json': 'null'},
      {'key': 'size', 'json': CASE WHEN size2 IS NOT NULL THEN concat('"', size2, '"') END}]) AS a FROM parts) SELECT "row", a.key AS key, a.json AS json FROM x WHERE a.json IS NOT NULL"""),
    "attributes_merged": _with("parts", """SELECT "row", concat('{"label":"', label, '","large":', large::VARCHAR, ',"otel.scope.name":"', scope_name, '","service.name":"', service, '","size":"', coalesce(size2, size), '","tier":"scope"}') AS json FROM parts"""),
    "render_turns": _with("convo", """SELECT concat(ts_ns, '.0.0.', "row") AS cursor, concat('{"start_time_unix_nano":"', ts_ns, '","duration_nano":"', duration_ns, '","trace_id":"', trace_id, '","span_id":"', span_id, '"', CASE WHEN parent_span_id IS NOT NULL THEN concat(',"parent_span_id":"', parent_span_id, '"') ELSE '' END,
      ',"name":"turn","kind":1,"status_code":0,"attributes":{"service.name":"', service, '"}}') AS json FROM convo"""),
    "render_calls": _with("calls", f"""SELECT concat(ts_ns, '.0.0.', "row") AS cursor, concat('{{"start_time_unix_nano":"', ts_ns, '","duration_nano":"1000","trace_id":"', trace_id, '","span_id":"', span_id, '","name":"order","attributes":{{"level":"99","service.name":"orders"}},"events":', {_LEVELS},
      CASE WHEN customer IS NOT NULL THEN concat(',"links":[{{"trace_id":"', lpad(lower(to_hex(customer)),32,'0'), '","span_id":"', lpad(lower(to_hex(customer)),16,'0'), '","attributes":{{"customer":"', customer, '"}}}}]') ELSE '' END, '}}') AS json FROM calls"""),
    "map_budget": _with("spans", f', b AS (SELECT * FROM spans WHERE ts_ns BETWEEN 0 AND {NOW} ORDER BY ts_ns DESC, "row" DESC LIMIT 5000) SELECT service AS name, count(*) AS spans, count_if(status_code = 2)::BIGINT AS errors, sum(duration_ns)::BIGINT AS total_ns FROM b GROUP BY 1'),
    "series_derived": _with("prices", f""", v AS (SELECT 'order.price.count' AS name, {_PRIORITY} AS attributes, ts_ns, n AS v_int, NULL::DOUBLE AS v_dbl, "row" FROM prices WHERE priority <> '5-LOW' UNION ALL SELECT 'order.price.sum', {_PRIORITY}, ts_ns, NULL, total, "row" FROM prices WHERE priority <> '5-LOW' AND total IS NOT NULL),
      r AS (SELECT *, row_number() OVER (PARTITION BY name, attributes ORDER BY ts_ns DESC, "row" DESC) AS i, count(*) OVER (PARTITION BY name, attributes) AS c FROM v) SELECT name, attributes, ts_ns, v_int, v_dbl, greatest(c - 40, 0)::BIGINT AS dropped_points FROM r WHERE i <= 40"""),
    "series_half": _with("prices", f"SELECT 'order.price.sum' AS name, {_PRIORITY} AS attributes, count(*) AS points, min(total) AS least, max(total) AS most FROM prices WHERE total IS NOT NULL GROUP BY 2"),
    "series_exemplars": _with("prices", f""", k AS (SELECT *, {_PRIORITY} AS attributes, row_number() OVER (PARTITION BY priority ORDER BY ts_ns DESC, "row" DESC) AS i FROM prices), e AS (SELECT *, row_number() OVER (PARTITION BY attributes ORDER BY ts_ns, span_id) AS j FROM k WHERE i <= 500)
      SELECT attributes, (j - 1)::INTEGER AS place, ts_ns - 1 AS ts_ns, span_id, price AS value FROM e WHERE j <= 10"""),
    "series_charts": "SELECT * FROM (SELECT 'order.price.count' AS name, count(DISTINCT o_orderpriority) AS series FROM orders UNION ALL SELECT 'order.price.sum', count(DISTINCT o_orderpriority) FROM orders WHERE o_orderkey % 3 > 0 UNION ALL SELECT 'event.value', count(DISTINCT (event_type, user_id % 5)) FROM events UNION ALL SELECT 'event.count', count(DISTINCT user_id % 5) FROM events)",
    "alert_slow_share": _with("spans", f"SELECT count_if(duration_ns > 45000000)::BIGINT AS matched, count(*) AS total, count_if(duration_ns > 45000000) / count(*) > 0.05 AS breach FROM spans WHERE name = 'line' AND ts_ns BETWEEN {946_684_800_000_000_000 - 3650 * DAY} AND 946684800000000000"),
    "alert_states": _with("logs", f""", g AS (SELECT {NOW - 5 * DAY} + k * {D.HOUR} AS at_ns FROM range(0, 121) t(k)), v AS (SELECT at_ns, count_if(severity_number >= 17) > 0.2 * count(ts_ns) AND count(ts_ns) > 0 AS breach FROM g LEFT JOIN logs ON ts_ns BETWEEN at_ns - {6 * D.HOUR} AND at_ns GROUP BY at_ns),
      r AS (SELECT *, sum(CASE WHEN breach THEN 0 ELSE 1 END) OVER (ORDER BY at_ns) AS run FROM v), s AS (SELECT *, min(CASE WHEN breach THEN at_ns END) OVER (PARTITION BY run) AS since FROM r),
      p AS (SELECT at_ns, CASE WHEN NOT breach THEN 'ok' WHEN at_ns - since >= {2 * D.HOUR} THEN 'firing' ELSE 'pending' END AS phase FROM s), q AS (SELECT *, lag(phase, 1, 'ok') OVER (ORDER BY at_ns) AS before FROM p)
      SELECT at_ns, phase, CASE WHEN phase = 'firing' AND before <> 'firing' THEN 'fired' WHEN phase = 'ok' AND before = 'firing' THEN 'resolved' END AS news FROM q"""),
    "scale_decisions": " UNION ALL ".join(f"SELECT CASE WHEN min(s_acctbal / 10000) < {low} THEN 'up' WHEN min(s_acctbal / 10000) > {high} THEN 'down' ELSE 'hold' END AS decision, {low}::DOUBLE AS low FROM supplier" for low, high in ((0.0, 0.05), (0.05, 0.9), (0.95, 0.99))) + " UNION ALL SELECT CASE WHEN count(*) = 0 THEN 'hold' END, -1.0 FROM supplier WHERE FALSE",
    "frame_anchor": _with("logs", f"SELECT {START} AS start, {NOW} AS \"end\", least(1000, count(DISTINCT trace_id)) AS traces, least(256, count(DISTINCT (service, instance))) AS entities, count(DISTINCT trace_id) > 1000 OR count(DISTINCT (service, instance)) > 256 AS truncated, count(*) AS matched, count(*) AS scanned FROM logs WHERE ts_ns BETWEEN {START} AND {NOW}"),
    "frame_walk": _with("spans", f""", m AS (SELECT * FROM spans WHERE duration_ns >= 50000000 AND status_code = 2 AND ts_ns BETWEEN {_SLOW['from']} AND {_SLOW['to']}), t AS (SELECT trace_id FROM m GROUP BY 1 ORDER BY min(ts_ns), trace_id LIMIT 1000),
      own AS (SELECT * FROM spans WHERE trace_id IN (SELECT trace_id FROM t)), w AS (SELECT least({_SLOW['from'] - 2 * D.HOUR}, min(ts_ns)) AS a, greatest({_SLOW['to'] + 2 * D.HOUR}, max(ts_ns + duration_ns)) AS z FROM own)
      SELECT DISTINCT concat('6|service.name=1:', service) AS entity, service AS name, a::BIGINT AS start, z::BIGINT AS "end" FROM (SELECT service FROM own UNION SELECT service FROM m), w"""),
    "frame_rollup": _with("logs", f"SELECT service AS name, count(DISTINCT instance) AS entities FROM logs WHERE ts_ns BETWEEN {NOW - 2 * DAY} AND {NOW} GROUP BY 1"),
    "write_up_counts": "WITH " + adapters.SQL["logs"] + ", " + adapters.SQL["spans"] + f" SELECT 'errors' AS claim, count(*) AS found FROM logs WHERE severity_number >= 17 AND ts_ns BETWEEN {NOW - 3 * DAY} AND {NOW - 2 * DAY} UNION ALL SELECT 'clicks', count(*) FROM logs WHERE contains(body, 'click') AND ts_ns BETWEEN {START} AND {NOW} UNION ALL SELECT 'trace', count(*) FROM spans WHERE trace_id = '{1:032x}'",
    "otlp_logs": f"SELECT {_NS} AS ts_ns, CASE WHEN event_type = 'error' THEN 17 ELSE 9 END AS severity_number, event_type AS body, CASE WHEN event_id <> 0 THEN lpad(lower(to_hex(event_id)),32,'0') END AS trace_id, NULL::VARCHAR AS span_id, user_id AS \"user\", user_id > 50 AS big, concat('svc-', user_id % 5) AS service, 'web' AS scope FROM events",
    "otlp_spans": "SELECT epoch_us(o_orderdate)*1000 AS ts_ns, greatest(o_orderkey % 100 - 20, 0) AS duration_ns, CASE WHEN o_orderkey <> 0 THEN lpad(lower(to_hex(o_orderkey)),32,'0') END AS trace_id, o_orderpriority AS name, least(greatest(o_orderkey % 9 - 1, 0), 5)::INTEGER AS kind, least(o_custkey % 4, 2)::INTEGER AS status_code, o_orderstatus AS event, epoch_us(o_orderdate)*1000 + 5 AS event_ns FROM orders",
    "otlp_points": """WITH o AS (SELECT *, epoch_us(o_orderdate)*1000 AS ts_ns FROM orders) SELECT ts_ns, 'price' AS name, NULL::VARCHAR AS unit, 'gauge' AS kind, 0::INTEGER AS temporality, FALSE AS monotonic, NULL::BIGINT AS v_int, o_totalprice AS v_dbl, NULL::BIGINT AS count, NULL::DOUBLE AS sum, NULL::BIGINT AS second, NULL::DOUBLE AS bound FROM o
      UNION ALL SELECT ts_ns, 'orders', '{order}', 'sum', 2, TRUE, o_orderkey, NULL, NULL, NULL, NULL, NULL FROM o UNION ALL SELECT ts_ns, 'lines', NULL, 'histogram', 0, FALSE, NULL, NULL, o_orderkey % 7, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END, 4, 10.0 FROM o""",
    "otlp_refused": "SELECT event_id % 7 AS form, CASE WHEN event_id % 7 < 3 THEN 0 ELSE count(*) END::BIGINT AS refused, count(*) AS requests FROM events GROUP BY event_id % 7",
    "kubernetes_events": f"""SELECT {_NS} AS ts_ns, CASE WHEN event_type = 'error' THEN 13 ELSE 9 END AS severity_number, event_type AS event_name, props AS body, CASE WHEN event_id % 3 > 1 THEN (event_id % 3)::VARCHAR END AS repeats, CASE WHEN event_id % 3 = 0 THEN concat('o-', user_id % 20) END AS pod,
      CASE WHEN event_id % 3 = 1 THEN concat('o-', user_id % 20) END AS job, CASE WHEN event_id % 3 = 2 THEN concat('o-', user_id % 20) END AS other, CASE WHEN event_id % 3 = 0 THEN concat('u-', user_id) END AS uid FROM events WHERE event_id % 4 > 0""",
    "kubernetes_groups": "SELECT count(DISTINCT (event_id % 3, user_id % 20, CASE WHEN event_id % 3 = 0 THEN user_id ELSE -1 END)) AS resources, count(*) AS records FROM events WHERE event_id % 4 > 0",
    "kubernetes_pods": """SELECT CASE WHEN o_orderkey % 4 = 0 THEN epoch_us(o_orderdate)*1000 ELSE 7 END AS ts_ns, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 3 = 0 THEN 9 ELSE 17 END AS severity_number, CASE WHEN o_orderkey % 4 = 0 THEN 'Ended' ELSE 'ErrImagePull' END AS event_name,
      CASE WHEN o_orderkey % 4 = 0 THEN concat('container main last terminated: exit code ', o_orderkey % 3) ELSE 'container main is not starting: ErrImagePull' END AS body, concat('pod-', o_orderkey) AS uid FROM orders WHERE o_orderkey % 2 = 0""",
    "stored_window": _with("logs", f'SELECT "row", ts_ns, 1::BIGINT AS seq, ts_ns // 3600000000000 AS hour FROM logs WHERE ts_ns BETWEEN {NOW - 6 * DAY} AND {NOW - 5 * DAY} AND severity_number <= 13'),
    "trace_chain": _with("convo", "SELECT trace_id, max(\"row\" % 100)::INTEGER AS depth, max(span_id) AS span_id FROM convo GROUP BY 1"),
}
