"""Kubernetes Events and Pod status as log records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ATTRS, LOGS, attributes, kv

_EVENT = (
    "metadata struct<uid string, name string, namespace string, creationTimestamp string>, type string, reason string, action string, message string, eventTime string, firstTimestamp string, "
    "lastTimestamp string, count bigint, reportingComponent string, source struct<component string, host string>, involvedObject struct<kind string, name string, namespace string, uid string>"
)
_ENDED = "terminated: struct<exitCode: bigint, signal: bigint, reason: string, message: string, finishedAt: string>"
_STATUS = f"array<struct<name: string, image: string, restartCount: bigint, state: struct<waiting: struct<reason: string, message: string>>, lastState: struct<{_ENDED}>>>"
_POD = f"metadata struct<uid string, name string, namespace string>, status struct<hostIP string, containerStatuses {_STATUS}, initContainerStatuses {_STATUS}>"
#: Fixed reasons for which a waiting container counts as stuck.
STUCK = ("CrashLoopBackOff", "ImagePullBackOff", "ErrImagePull", "CreateContainerConfigError", "CreateContainerError", "InvalidImageName", "ErrImageNeverPull")
#: Fixed names of the attribute that names an object, by kind; other kinds have ``k8s.object.name``.
NAME_KEYS = {k: f"k8s.{k.lower()}.name" for k in ("Pod", "Deployment", "StatefulSet", "DaemonSet", "ReplicaSet", "Job", "CronJob", "Node")}


def _ns(text: Column) -> Column:
    return F.unix_micros(F.try_to_timestamp(text)) * 1000


def _finish(rows: DataFrame) -> DataFrame:
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in LOGS))


def _some(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def _object(kind: Column, name: Column, uid: Column, namespace: Column) -> Column:
    """The resource of an object: namespace, kind, name under its kind's key, and a pod's uid; empty ones are left out."""
    known = kind.isin(*NAME_KEYS)
    names = [F.when(kind == k, kv(key, _some(name), "str")) for k, key in NAME_KEYS.items()]
    other = F.when(F.coalesce(~known, F.lit(True)), kv("k8s.object.name", _some(name), "str"))
    return attributes(kv("k8s.namespace.name", _some(namespace), "str"), kv("k8s.object.kind", _some(kind), "str"), *names, other, F.when(kind == "Pod", kv("k8s.pod.uid", _some(uid), "str")))


def events(objects: DataFrame, now_ns: int, column: str = "value") -> DataFrame:
    """A log record for each Event: warnings are 13, all else 9; its reason is the event's name.

    Time is the first there is of event time, last and first time seen, and creation; an Event without any is no record.
    A count is kept only of an Event that was repeated.
    """
    e = objects.select(F.from_json(column, _EVENT).alias("e")).where("e is not null").select("e.*")
    when = F.coalesce(_ns(F.col("eventTime")), _ns(F.col("lastTimestamp")), _ns(F.col("firstTimestamp")), _ns(F.col("metadata.creationTimestamp")))
    warning = F.col("type") == "Warning"
    o = F.col("involvedObject")
    out = e.select(
        when.alias("ts_ns"),
        F.lit(now_ns).alias("observed_ns"),
        F.when(warning, 13).otherwise(9).alias("severity_number"),
        F.when(warning, "WARN").otherwise("INFO").alias("severity_text"),
        _some(F.col("reason")).alias("event_name"),
        F.coalesce("message", F.lit("")).alias("body"),
        _object(o["kind"], o["name"], o["uid"], o["namespace"]).alias("resource"),
        attributes(
            kv("k8s.event.reason", _some(F.col("reason")), "str"),
            kv("k8s.event.action", _some(F.col("action")), "str"),
            kv("k8s.event.count", F.when(F.col("count") > 1, F.col("count").cast("string")), "str"),
            kv("k8s.event.reporting_controller", F.coalesce(_some(F.col("reportingComponent")), F.col("source.component")), "str"),
            kv("k8s.node.name", F.col("source.host"), "str"),
        ).alias("attrs"),
    )
    return _finish(out.where("ts_ns >= 0"))


def pod_status(objects: DataFrame, now_ns: int, column: str = "value") -> DataFrame:
    """A log record for each container, init containers among them, that has ended before or is stuck, once for each such state.

    How a container last ended comes before what it waits for; one that ended well is information. A state that
    was delivered before has the same token, by pod, container and state. Stuck containers have no time of their own but ``now_ns``.
    """
    p = objects.select(F.from_json(column, _POD).alias("p")).where("p is not null").select("p.metadata", "p.status.hostIP", "p.status.containerStatuses", "p.status.initContainerStatuses")
    none = F.array().cast(p.schema["containerStatuses"].dataType)
    s = p.select("metadata", "hostIP", F.explode(F.concat(F.coalesce("containerStatuses", none), F.coalesce("initContainerStatuses", none))).alias("c"))
    t, w = F.col("c.lastState.terminated"), F.col("c.state.waiting")
    said = lambda x: F.coalesce(F.concat(F.lit(" — "), x["message"]), F.lit(""))
    why = F.coalesce(t["reason"], F.lit("Terminated"))
    signal = F.coalesce(F.concat(F.lit(", signal "), t["signal"].cast("string")), F.lit(""))
    ended = F.struct(
        why.alias("reason"),
        F.when(t["exitCode"] == 0, 9).otherwise(17).alias("severity"),
        F.concat(F.lit("container "), "c.name", F.lit(" last terminated: exit code "), t["exitCode"].cast("string"), signal, said(t)).alias("text"),
        _ns(t["finishedAt"]).alias("at"),
        F.concat_ws("/", "c.name", F.concat_ws(":", F.lit("last"), why, t["exitCode"].cast("string"), F.coalesce(F.floor(_ns(t["finishedAt"]) / 1_000_000_000), F.lit(0)).cast("string"))).alias("token"),
    )
    stuck = F.struct(
        w["reason"].alias("reason"),
        F.lit(17).alias("severity"),
        F.concat(F.lit("container "), "c.name", F.lit(" is not starting: "), w["reason"], said(w)).alias("text"),
        F.lit(None).cast("bigint").alias("at"),
        F.concat_ws("/", "c.name", F.concat(F.lit("waiting:"), w["reason"])).alias("token"),
    )
    s = s.withColumn("s", F.when(t.isNotNull(), ended).when(w["reason"].isin(*STUCK), stuck)).where("s is not null")
    out = s.withColumns({"uid": F.coalesce("metadata.uid", F.lit("")), "token": F.col("s.token")}).dropDuplicates(["uid", "token"]).select(
        F.coalesce("s.at", F.lit(now_ns)).alias("ts_ns"),
        F.lit(now_ns).alias("observed_ns"),
        F.col("s.severity").alias("severity_number"),
        F.when(F.col("s.severity") == 17, "ERROR").otherwise("INFO").alias("severity_text"),
        _some(F.col("s.reason")).alias("event_name"),
        F.col("s.text").alias("body"),
        _object(F.lit("Pod"), F.col("metadata.name"), F.col("metadata.uid"), F.col("metadata.namespace")).alias("resource"),
        attributes(
            kv("k8s.container.name", F.col("c.name"), "str"),
            kv("k8s.container.restart_count", F.coalesce("c.restartCount", F.lit(0)).cast("string"), "str"),
            kv("k8s.event.reason", F.col("s.reason"), "str"),
            kv("container.image.name", _some(F.col("c.image")), "str"),
            kv("k8s.pod.host_ip", _some(F.col("hostIP")), "str"),
        ).alias("attrs"),
    )
    return _finish(out)


def by_resource(records: DataFrame) -> DataFrame:
    """Records grouped as an export request groups them: one row (resource, records) for each distinct resource."""
    rest = [c for c in records.columns if c != "resource"]
    return records.withColumn("resource", F.coalesce("resource", F.array().cast(ATTRS))).groupBy("resource").agg(F.collect_list(F.struct(*rest)).alias("records"))
