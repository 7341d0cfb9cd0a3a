"""Alerts, write-ups, frames, maps, series, OTLP, storage and streams on small inputs."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from tellspan.operators import alerts, frame, rca, search, series, services, trace
from tellspan.plans import documents as D
from tellspan.schema import LOGS, SPANS
from tellspan.sources import generator, kubernetes, otlp_json, otlp_proto, storage
from tellspan.streaming import alerts as alert_streams
from tellspan.streaming import ingest

S = 10**9


def text_attr(k, v):
    return {"key": k, "value": {"stringValue": v}}


@pytest.fixture(scope="module")
def records(spark):
    requests = [(generator.logs_request("tickets", 1_000, 10),), (generator.logs_request("refunds", 2_000, 4),)]
    rows = otlp_json.logs(spark.createDataFrame(requests, "value string"), 7).withColumns({"node": F.lit(0).cast("long"), "seq": F.lit(0).cast("long"), "row": F.monotonically_increasing_id()})
    return rows.persist()


@pytest.fixture(scope="module")
def chain(spark):
    def span(service, sid, parent, at):
        return {"resource": {"attributes": [text_attr("service.name", service)]}, "scopeSpans": [{"spans": [{"trace_id": "7e" * 16, "spanId": sid * 16, "parent_span_id": parent * 16 if parent else "", "name": service, "kind": "SPAN_KIND_SERVER", "startTimeUnixNano": at, "endTimeUnixNano": str(at + 500), "status": {"code": "STATUS_CODE_ERROR" if service == "stock" else 0}}]}]}

    doc = {"resourceSpans": [span("edge", "1", "", 1_000), span("cart", "2", "1", 1_100), span("stock", "3", "2", 1_200)]}
    return otlp_json.spans(spark.createDataFrame([(json.dumps(doc),)], "value string")).withColumns({"node": F.lit(0).cast("long"), "seq": F.lit(0).cast("long"), "row": F.monotonically_increasing_id()}).persist()


def test_otlp_json_logs(records):
    assert records.columns == [f.name for f in LOGS]
    r = records.orderBy("ts_ns").first()
    assert (r["ts_ns"], r["severity_number"], r["body"], r["trace_id"]) == (1_000, 17, "tickets handled request 0", "ab" * 16)
    assert r["scope"][0]["s"] == "demo" and records.count() == 14


def test_otlp_json_values_and_odd_ids(spark):
    kinds = [("i", {"intValue": "9007199254740993"}), ("j", {"int_value": 200}), ("b", {"boolValue": True}), ("d", {"doubleValue": 1.5}), ("y", {"bytesValue": "AQI="}), ("e", {}), ("l", {"arrayValue": {"values": [{"intValue": "1"}]}}), ("both", {"intValue": 1, "stringValue": "s"})]
    rec = {"observedTimeUnixNano": "5", "timeUnixNano": str(1 << 63), "traceId": "abc", "spanId": "CD" * 8, "severityNumber": "SEVERITY_NUMBER_WARN2", "body": {"kvlistValue": {"values": []}}, "attributes": [{"key": k, "value": v} for k, v in kinds]}
    r = otlp_json.logs(spark.createDataFrame([(json.dumps({"resource_logs": [{"scope_logs": [{"log_records": [rec]}]}]}),)], "value string"), 7).first()
    assert (r["ts_ns"], r["trace_id"], r["span_id"], r["severity_number"], r["body"]) == (5, None, "cd" * 8, 14, None) and r["body_json"]
    a = {x["key"]: x for x in r["attrs"]}
    assert (a["i"]["i"], a["j"]["i"], a["b"]["b"], a["d"]["d"], bytes(a["y"]["bytes"]), a["e"]["type"], a["l"]["type"], a["both"]["s"]) == (9007199254740993, 200, True, 1.5, b"\x01\x02", 0, 6, "s")


def test_requests_that_are_refused(spark):
    rows = [('{"resourceLogs": []}',), ('{"resource_logs": null}',), ("{}",), ('{"resource_log": []}',), ("[1]",), ("nonsense",)]
    got = [r["error"] for r in otlp_json.valid(spark.createDataFrame(rows, "value string"), "logs").collect()]
    assert got[:3] == [None] * 3 and all(got[3:])


def _field(n, wire, data):
    out = bytes([n << 3 | wire]) if n < 16 else bytes([(n << 3 | wire) & 127 | 128, n >> 4])
    return out + (bytes([len(data)]) + data if wire == 2 else data)


def test_otlp_protobuf(spark):
    value = _field(2, 2, _field(3, 0, b"\xc8\x01"))
    log = _field(1, 1, struct.pack("<Q", 42)) + _field(2, 0, b"\x11") + _field(5, 2, _field(1, 2, b"hello")) + _field(6, 2, _field(1, 2, b"code") + value) + _field(9, 2, b"\xab" * 16)
    request = _field(1, 2, _field(1, 2, _field(1, 2, _field(1, 2, b"service.name") + _field(2, 2, _field(1, 2, b"s")))) + _field(2, 2, _field(2, 2, log)))
    got = otlp_proto.to_json(spark.createDataFrame([(request,), (b"\x0a\xff",), (b"",)], "content binary"), "logs").collect()
    assert [bool(r["error"]) for r in got] == [False, True, False]
    r = otlp_json.logs(spark.createDataFrame([(got[0]["value"],)], "value string"), 7).first()
    assert (r["ts_ns"], r["severity_number"], r["body"], r["trace_id"], r["attrs"][0]["i"]) == (42, 17, "hello", "ab" * 16, 200)


def test_frame_walk_and_service_map(spark, records, chain):
    assert chain.columns == [f.name for f in SPANS]
    q = D.Search("traces", 1_150, 1_250, (D.Term("field", "name", "eq", "stock"),))
    f = frame.anchor(chain, q)
    assert f.traces == ("7e" * 16,) and len(f.entities) == 1
    wide = frame.expand(frame.expand(f, D.Step("traces"), chain), D.Step("peers"), chain)
    assert (wide.start, wide.end, len(wide.entities), wide.truncated) == (1_000, 1_700, 3, False)
    first = frame.correlate(chain, chain, D.Correlate(q, (D.Step("around", 100), D.Step("traces"))))
    second = frame.correlate(chain, chain, D.Correlate(q, (D.Step("traces"), D.Step("around", 100))))
    assert (first.start, second.start) == (1_000, 900)
    names = frame.names_of(wide, [chain])
    assert sorted(names.values()) == ["cart", "edge", "stock"] and json.loads(frame.frame_json(wide, names))["from"] == "1000"
    edges = {(r["caller"].rpartition(":")[2], r["callee"].rpartition(":")[2]): r["errors"] for r in services.map_edges(chain, 0, 10**6).collect()}
    assert edges[("entry", "edge")] == 0 and len(edges) == 3
    assert tuple(services.map_unresolved(chain, 0, 10**6).first()) == (3, 0)
    rows = [r.asDict() for r in chain.collect()]
    assert [(d, r["name"]) for d, r in trace.tree_rows(rows)] == [(0, "edge"), (1, "cart"), (2, "stock")]
    loop = [{"span_id": "a", "parent_span_id": "b", "ts_ns": 1}, {"span_id": "b", "parent_span_id": "a", "ts_ns": 2}]
    assert [d for d, _ in trace.tree_rows(loop)] == [0, 0]
    assert trace.map_layers([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")])["c"] >= 1
    assert trace.map_tree([("entry", "a", 5), ("a", "b", 1), ("x", "y", 1)]) == [(0, "a"), (1, "b"), (0, "x"), (0, "y")]


def test_series_of_all_kinds(spark):
    attrs = [text_attr("m", "GET")]
    ex = [{"timeUnixNano": 6_400, "asDouble": 17.25, "traceId": "ab" * 16, "spanId": "cd" * 8}]
    hist = {"dataPoints": [{"timeUnixNano": "6500", "count": "31", "sum": 808.75, "bucketCounts": ["11", "20"], "explicitBounds": [3.0], "attributes": attrs, "exemplars": ex}], "aggregationTemporality": 2}
    total = {"dataPoints": [{"timeUnixNano": str(t), "asInt": str(t), "attributes": attrs} for t in (1_000, 1_001, 5_000, 5_001)], "isMonotonic": True, "aggregationTemporality": "AGGREGATION_TEMPORALITY_CUMULATIVE"}
    doc = {"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": "h", "unit": "ms", "histogram": hist}, {"name": "c", "sum": total}, {"name": "h.count2", "gauge": {"dataPoints": [{"timeUnixNano": 1, "asDouble": 2.0}]}}]}]}]}
    p = otlp_json.points(spark.createDataFrame([(json.dumps(doc),)], "value string")).withColumns({c: F.lit(0).cast("long") for c in ("node", "seq", "row")}).persist()
    got = {r["name"]: r for r in series.series(p, D.SeriesQuery()).collect()}
    assert set(got) == {"h.count", "h.sum", "c", "h.count2"}
    assert got["h.count"]["points"][0]["v_int"] == 31 and got["h.sum"]["points"][0]["v_dbl"] == 808.75
    assert [e["d"] for e in got["h.sum"]["exemplars"]] == [17.25] == [e["d"] for e in got["h.count"]["exemplars"]]
    one = series.series(p, D.SeriesQuery("c", max_points=2)).first()
    assert [x["ts_ns"] for x in one["points"]] == [5_000, 5_001] and one["dropped_points"] == 2 and one["monotonic"] and one["temporality"] == 2
    assert [r["name"] for r in series.series(p, D.SeriesQuery("h.sum")).collect()] == ["h.sum"]
    assert [r["name"] for r in series.series(p, D.SeriesQuery(terms=(D.Term("field", "m", "eq", "GET"),), max_series=2)).collect()] == ["c", "h.count"]
    assert series.sparkline([1, 5, 2, 9], 2) == "▁█" and series.sparkline([], 3) == ""


def test_alert_rules(spark, records):
    tables = {"logs": records}
    r = alerts.rule({"name": "x", "query": {"where": [{"attr": "service.name", "eq": "tickets"}, {"field": "severity_number", "gte": 17}]}, "of": {"where": [{"attr": "service.name", "eq": "tickets"}]}, "when": "ratio > 5%", "over": "1s"})
    row = alerts.measure(tables, r, 1_009).first()
    assert (row["matched"], row["total"], r.value(*row), r.breaches(*row)) == (5, 10, 0.5, True)
    assert not r.breaches(0, 0) and alerts.measure(tables, r, -5 * S).first()["total"] == 0
    assert alerts.condition("count>=5") == ("count", ">=", 5.0) and alerts.condition("ratio < 5 %")[2] == pytest.approx(0.05)
    for bad in ({"name": "x", "query": {}, "when": "ratio > 1"}, {"name": "x", "query": {}, "of": {}, "when": "count > 1"}, {"name": "x", "query": {"limit": 3}, "when": "count > 1"}, {"name": "x", "query": {}, "when": "p95 > 1"}, {"name": "x", "query": {}, "when": "count > 1", "notify": ["nobody"]}):
        with pytest.raises(D.DocumentError):
            alerts.rule(bad)
    state, seen = alerts.State(), []
    for now, breach in [(0, True), (5, True), (10, True), (11, False), (12, True), (30, True)]:
        state, event = alerts.advance(state, breach, now, 10)
        seen.append((state.phase, event))
    assert seen == [("pending", None), ("pending", None), ("firing", "fired"), ("ok", "resolved"), ("pending", None), ("firing", "fired")]
    engine = alerts.Engine(alerts.rules(json.dumps({"rules": [{"name": "five", "query": {"where": [{"field": "severity_number", "gte": 17}]}, "when": "count > 6", "over": "2s"}]})), tables)
    assert [e for _, e, _ in engine.tick(2_005)] == ["fired"] and engine.report["five"]["matched"] == 7
    for kind in ("slack", "discord", "pagerduty", "json"):
        assert "five" in alerts.payload(kind, engine.found.rules[0], "fired", 7.0, 1)


def test_write_ups(spark, records, chain):
    doc = {"title": "Outage", "from": 0, "to": 90 * S, "summary": "It broke.", "root_cause": "A | bug", "timeline": [{"at": 50 * S, "what": "b"}, {"at": 1, "what": "a|b"}], "evidence": [{"claim": "errors", "query": {"where": [{"field": "severity_number", "gte": 17}]}}, {"claim": "trace", "trace_id": "7e" * 16}], "prevention": {"name": "r", "query": {}, "when": "count > 1"}}
    w = rca.verify(rca.write_up(json.dumps(doc), 100 * S), {"logs": records, "traces": chain})
    assert [f.found for f in w.evidence] == [7, 3] and [t[1] for t in w.timeline] == ["a|b", "b"]
    text = rca.render(w)
    assert "a\\|b" in text and "(1m 30s)" in text and "7 records" in text
    assert rca.record(spark, w, 5).first()["event_name"] == "rca"
    doc["evidence"][0]["query"]["where"][0]["gte"] = 25
    with pytest.raises(D.DocumentError, match="errors"):
        rca.verify(rca.write_up(doc, 100 * S), {"logs": records, "traces": chain})
    with pytest.raises(D.DocumentError):
        rca.write_up({**doc, "evidence": [{"claim": "x"}]}, 1)


def _frame(spark, *docs):
    return spark.createDataFrame([(json.dumps(d),) for d in docs], "value string")


def _attrs(row, level="attrs"):
    return {x["key"]: x["s"] for x in row[level]}


def test_kubernetes_events(spark):
    pod = {"kind": "Pod", "name": "p", "uid": "pu"}
    event = {"metadata": {"uid": "u", "namespace": "n", "creationTimestamp": "2024-01-01T00:00:00Z"}, "type": "Warning", "reason": "BackOff", "message": "m", "involvedObject": {**pod, "namespace": "n"}, "count": 4, "action": "Pulling", "source": {"component": "kubelet", "host": "node-7"}}
    r = kubernetes.events(_frame(spark, event), 7).first()
    assert (r["ts_ns"], r["severity_number"], r["body"], r["event_name"]) == (1_704_067_200 * S, 13, "m", "BackOff")
    assert _attrs(r) == {"k8s.event.reason": "BackOff", "k8s.event.action": "Pulling", "k8s.event.count": "4", "k8s.event.reporting_controller": "kubelet", "k8s.node.name": "node-7"}
    assert _attrs(r, "resource") == {"k8s.namespace.name": "n", "k8s.object.kind": "Pod", "k8s.pod.name": "p", "k8s.pod.uid": "pu"}
    later = {"lastTimestamp": "2024-01-01T00:00:05Z", "firstTimestamp": "2024-01-01T00:00:02Z", "count": 1, "type": "Normal", "reportingComponent": "sched", "source": {"component": "other"}, "involvedObject": {"kind": "Gateway", "name": "g"}}
    r = kubernetes.events(_frame(spark, later), 7).first()
    assert (r["ts_ns"], r["severity_number"], r["event_name"], r["body"]) == (1_704_067_205 * S, 9, None, "")
    assert _attrs(r) == {"k8s.event.reporting_controller": "sched"} and _attrs(r, "resource") == {"k8s.object.kind": "Gateway", "k8s.object.name": "g"}
    assert kubernetes.events(_frame(spark, {"reason": "timeless", "involvedObject": pod}), 7).count() == 0


def test_kubernetes_pod_status(spark):
    ended = lambda code, **k: {"lastState": {"terminated": {"exitCode": code, "finishedAt": "2024-01-01T00:00:01Z", **k}}}
    waits = lambda reason: {"state": {"waiting": {"reason": reason}}}
    containers = [
        {"name": "killed", "restartCount": 3, "image": "i:1", **waits("CrashLoopBackOff"), **ended(137, reason="OOMKilled", signal=9)},
        {"name": "fine", "restartCount": 1, "state": {"running": {}}, **ended(0, reason="Completed")},
        {"name": "now", "state": {"terminated": {"exitCode": 1}}},  # not restarted yet
        {"name": "stuck", **waits("ImagePullBackOff")},
        {"name": "starting", **waits("ContainerCreating")},
    ]
    pod = {"metadata": {"uid": "pu", "name": "p", "namespace": "n"}, "status": {"hostIP": "10.0.0.1", "containerStatuses": containers, "initContainerStatuses": [{"name": "init", **ended(2)}]}}
    got = kubernetes.pod_status(_frame(spark, pod, pod), 7)
    rows = {_attrs(r)["k8s.container.name"]: r for r in got.collect()}
    assert set(rows) == {"killed", "fine", "stuck", "init"} and got.count() == 4
    assert (rows["killed"]["event_name"], rows["killed"]["severity_number"], rows["killed"]["ts_ns"]) == ("OOMKilled", 17, 1_704_067_201 * S)
    assert "137, signal 9" in rows["killed"]["body"] and _attrs(rows["killed"])["container.image.name"] == "i:1" and _attrs(rows["killed"])["k8s.container.restart_count"] == "3"
    assert rows["fine"]["severity_number"] == 9 and (rows["stuck"]["ts_ns"], rows["stuck"]["event_name"]) == (7, "ImagePullBackOff")
    assert rows["init"]["event_name"] == "Terminated" and _attrs(rows["init"])["k8s.pod.host_ip"] == "10.0.0.1"
    assert kubernetes.by_resource(got).count() == 1


def test_storage(spark, tmp_path):
    path, store = str(tmp_path / "logs"), str(tmp_path / "store")
    hour = storage.HOUR_NS
    storage.publish(generator.load(spark, 3_000, 0).select([c for c in generator.load(spark, 1, 0).columns]).withColumn("ts_ns", F.col("row") * (hour // 1_000)), path, 1)
    assert storage.hours(spark, path) == [0, 1, 2]
    t = storage.read(spark, path, LOGS)
    q = D.Search("logs", hour, 2 * hour - 1, limit=5)
    assert search.count(t, q).first()[0] == 1_000
    plan = t.where(search.window(q.start, q.end, t.columns))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(p" in plan
    newest = D.Search("logs", limit=1_500)
    assert [r["ts_ns"] for r in search.recent_first(t, newest)] == [r["ts_ns"] for r in search.search(t, newest).collect()]
    assert storage.compact(spark, path, 2 * hour) == [0, 1] and storage.compact(spark, path, 2 * hour) == []
    assert storage.read(spark, path, LOGS).count() == 3_000
    # a crash between the two renames, and one before the last step
    (tmp_path / "logs" / "p=0").rename(tmp_path / "logs" / "_old-0")
    (tmp_path / "logs" / "_compact-0").mkdir()
    assert storage.recover(spark, path) == [0] and storage.hours(spark, path) == [0, 1, 2] and not (tmp_path / "logs" / "_compact-0").exists()
    assert storage.read(spark, path, LOGS).count() == 3_000 and storage.read(spark, path, LOGS).columns[-1] == "p"
    storage.offload(spark, path, 0, store)
    with pytest.raises(FileExistsError):
        storage.offload(spark, path, 0, store)
    assert storage.retain(spark, path, hour) == [0] and storage.hours(spark, path) == [1, 2]
    assert storage.reclaim(spark, [path], 1, 100) == (path, 1) and storage.reclaim(spark, [path], 50, 100) is None


def test_ingest_stream(spark, tmp_path):
    land, path = tmp_path / "in", str(tmp_path / "logs")
    land.mkdir()
    (land / "a.json").write_text(generator.logs_request("s", 1_000, 4) + "\nnonsense\n")
    q = ingest.ingest(ingest.requests(spark, str(land)), "logs", path, str(tmp_path / "cp"), lambda: 7, str(tmp_path / "bad"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert storage.read(spark, path, LOGS).count() == 4 and spark.read.json(str(tmp_path / "bad")).count() == 1


def test_alert_stream(spark, tmp_path):
    land = str(tmp_path / "ticks")
    rows = [("r", t, b, 10) for t, b in [(0, True), (5, True), (10, True), (11, False)]]
    spark.createDataFrame(rows, "rule string, at_ns long, breaching boolean, hold_ns long").write.parquet(land)
    stream = spark.readStream.schema("rule string, at_ns long, breaching boolean, hold_ns long").parquet(land)
    q = alert_streams.transitions(stream).writeStream.format("memory").queryName("transitions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted((r["at_ns"], r["event"]) for r in spark.table("transitions").collect()) == [(10, "fired"), (11, "resolved")]


def test_trace_tree_of_long_chains_and_cycles(spark):
    span = lambda t, i, p: (t, f"s{i}", None if p is None else f"s{p}", 1_000 + i, i)
    rows = [span("a", i, i - 1 if i else None) for i in range(300)]  # a chain
    rows += [span("b", 0, 2), span("b", 1, 0), span("b", 2, 1), span("b", 3, 2), span("b", 4, 4), span("b", 5, 99), span("b", 6, 5)]  # a cycle, one below it, its own parent, an orphan and its child
    got = {(r["trace_id"], r["span_id"]): r for r in trace.trace_tree(spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, ts_ns long, row long")).collect()}
    assert len(got) == len(rows) and all(got["a", f"s{i}"]["depth"] == i for i in range(300))
    assert [x["s"] for x in got["a", "s299"]["path"]] == [f"s{i}" for i in range(300)]
    assert [got["b", f"s{i}"]["depth"] for i in range(7)] == [None, None, None, None, 0, 0, 1]
    assert got["b", "s3"]["path"] is None and [tuple(x) for x in got["b", "s6"]["path"]] == [(1_005, "s5"), (1_006, "s6")]


def test_a_batch_that_runs_again_takes_the_place_of_its_first_run(spark, tmp_path):
    path, rows = str(tmp_path / "logs"), generator.load(spark, 500, 0)
    for seq in (1, 2, 1):
        storage.publish(rows, path, seq)
    assert storage.read(spark, path, LOGS).groupBy("seq").count().orderBy("seq").collect() == [(1, 500), (2, 500)]


def test_protobuf_lands_in_tables_too(spark, tmp_path):
    import gzip

    log = _field(1, 1, struct.pack("<Q", 42)) + _field(5, 2, _field(1, 2, b"hello"))
    request = _field(1, 2, _field(2, 2, _field(2, 2, log)))
    land, path = tmp_path / "in", str(tmp_path / "logs")
    land.mkdir()
    for name, data in (("a", request), ("b", gzip.compress(request)), ("c", b"\x0a\xff"), ("d", gzip.compress(bytes(5000)))):
        (land / name).write_bytes(data)
    q = ingest.ingest(ingest.binary_requests(spark, str(land)), "logs", path, str(tmp_path / "cp"), lambda: 7, str(tmp_path / "bad"), most_bytes=1000, once=("ts_ns", "body"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [r["body"] for r in storage.read(spark, path, LOGS).collect()] == ["hello"]
    assert sorted(r["error"][:9] for r in spark.read.json(str(tmp_path / "bad")).collect()) == ["not a req", "too large"]


def test_generated_spans_and_metrics(spark):
    hops = [("edge", None), ("cart", "edge"), ("stock", "cart")]
    rows = otlp_json.spans(spark.createDataFrame([(generator.spans_request(hops, "5a" * 16, 100),)], "value string"))
    assert [(r["name"], r["parent_span_id"], r["duration_ns"], r["status_code"]) for r in rows.orderBy("ts_ns").collect()] == [("call edge", None, 1000, 1), ("call cart", f"{1:016x}", 900, 1), ("call stock", f"{2:016x}", 800, 2)]
    points = otlp_json.points(spark.createDataFrame([(generator.metrics_request("s", 10, 4),)], "value string"))
    assert {r["name"]: r["count"] for r in points.groupBy("name").count().collect()} == {"queue.depth": 4, "requests": 4, "latency": 4}


def test_stream_figures_as_a_table(spark):
    figures = ingest.Figures()
    figures._add(("q", "stream.rows", 5.0), ("q", "stream.batch_ms", 2.0))
    table = figures.table(spark).withColumns({c: F.lit(0).cast("long") for c in ("node", "seq", "row")})
    assert {r["name"] for r in services.metric_names(table, 0, 1 << 62).collect()} == {"stream.rows", "stream.batch_ms"}


def test_statistics_of_searches_and_frames(spark, records):
    q = D.Search("logs", 1_000, 3_000, (D.Term("field", "severity_number", "gte", 17),), 2)
    p = search.page(records, q, stats=True)
    assert (len(p.rows), p.matched, p.scanned) == (2, 7, 14) and p.elapsed_us > 0 and p.next
    f = frame.anchor(records, q, stats=True)
    assert (f.matched, f.scanned) == (7, 14)


def test_ticks_of_long_windows_are_counted_without_copies(spark, records):
    r = alerts.rule({"name": "x", "query": {"where": [{"field": "severity_number", "gte": 17}]}, "of": {}, "when": "ratio > 5%", "over": "1s"})
    from dataclasses import replace

    for over, every in ((200, 10), (1_000, 100), (90, 10)):
        long_ = replace(r, over=over)
        got = [tuple(x) for x in alerts.ticks(records, long_, 900, 2_150, every).orderBy("at_ns").collect()]
        at = [x["ts_ns"] for x in records.collect()]
        bad = [x["ts_ns"] for x in records.where("severity_number >= 17").collect()]
        want = [(t, sum(t - over <= x <= t for x in bad), sum(t - over <= x <= t for x in at)) for t in range(900, 2_151, every)]
        assert got == want
