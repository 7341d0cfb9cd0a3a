"""Streams of export requests into stored tables, live tails, and the stream's own figures."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..plans.documents import Search
from ..schema import POINTS, attributes, kv
from ..sources import otlp_json, otlp_proto, storage


def requests(spark: SparkSession, path: str, files_per_trigger: int = 128) -> DataFrame:
    """Requests, one JSON text a line, as files land. Compressed files are read by their suffix; what a trigger takes is bounded."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(path)


def binary_requests(spark: SparkSession, path: str, files_per_trigger: int = 128) -> DataFrame:
    """Protobuf requests, one a file. What is compressed by gzip is inflated when it is decoded, up to the size that ``ingest`` takes."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", files_per_trigger).load(path).select("content")


def messages(spark: SparkSession, servers: str, topic: str, per_trigger: int = 100_000) -> DataFrame:
    """Protobuf requests, one a message of a Kafka topic, where the connector is on the class path."""
    source = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("maxOffsetsPerTrigger", per_trigger).load()
    return source.select(F.col("value").alias("content"))


def inflated(batch: DataFrame, most_bytes: int) -> DataFrame:
    """(content, error): each request as its bytes, gzip told by its first two and inflated no further than ``most_bytes``."""

    def run(batches):
        for b in batches:
            out, errors = [], []
            for raw in b.column(0).to_pylist():
                raw, error = raw or b"", None
                if raw[:2] == b"\x1f\x8b":
                    try:
                        raw = zlib.decompressobj(31).decompress(raw, most_bytes + 1)
                    except zlib.error as e:
                        raw, error = None, f"not gzip: {e}"
                if raw is not None and len(raw) > most_bytes:
                    raw, error = None, "too large"
                out.append(raw)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(errors, pa.string())], ["content", "error"])

    return batch.select("content").mapInArrow(run, "content binary, error string")


def _decoded(batch: DataFrame, signal: str, most_bytes: int) -> DataFrame:
    """(value, error) of requests in either form, by the column that they come in."""
    if "content" in batch.columns:
        raw = inflated(batch, most_bytes).persist()
        read = otlp_proto.to_json(raw.where("error is null"), signal)
        return read.unionByName(raw.where("error is not null").select(F.lit(None).cast("string").alias("value"), "error"))
    found = otlp_json.valid(batch, signal)
    return found.withColumn("error", F.when(F.octet_length("value") > most_bytes, "too large").otherwise(F.col("error")))


def ingest(stream: DataFrame, signal: str, path: str, checkpoint: str, now_ns: Callable[[], int], errors: str | None = None, every: str = "2 seconds", node: int = 0, most_bytes: int = 16 << 20, once: tuple[str, ...] = (), keep_batches: int = 100) -> StreamingQuery:
    """Decode, check and store each micro-batch; requests that can't be read, or are larger than ``most_bytes``, go to ``errors`` with the reason.

    Requests are JSON text in ``value``, or protobuf in ``content``. A batch's number is its rows' ``seq``. A batch that is run
    again takes the place of its first run in the table. No watermark is set, so late rows are kept. ``once``: columns by which
    repeated rows of a batch are dropped; none by default. The checkpoint keeps its last ``keep_batches`` batches.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.minBatchesToRetain", keep_batches)

    def put(batch: DataFrame, seq: int) -> None:
        found = _decoded(batch, signal, most_bytes).persist()
        good = found.where("error is null")
        rows = {"logs": lambda: otlp_json.logs(good, now_ns()), "traces": lambda: otlp_json.spans(good), "metrics": lambda: otlp_json.points(good)}[signal]()
        storage.publish(rows.dropDuplicates(list(once)) if once else rows, path, seq, node)
        if errors:
            found.where("error is not null").select("error", F.length("value").alias("size"), F.lit(seq).alias("seq")).write.mode("append").json(errors)
        found.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def tail(stream: DataFrame, query: Search, show: Callable[[list], None], checkpoint: str, every: str = "3 seconds", most: int = 1_000) -> StreamingQuery:
    """Hand the newest matches of each micro-batch, at most ``most``, to ``show``."""
    from ..operators.search import KEY, matching

    def put(batch: DataFrame, _: int) -> None:
        show(matching(batch, query).orderBy(*(F.desc(c) for c in KEY)).limit(most).collect())

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


class Figures(StreamingQueryListener):
    """A stream's own metrics: the latest progress of each query, as rows of a metrics table."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str, float]] = []
        self.times: list[int] = []

    def _add(self, *rows: tuple[str, str, float]) -> None:
        self.rows += rows
        self.times += [time.time_ns()] * len(rows)
        del self.rows[:-10_000], self.times[:-10_000]

    def table(self, spark: SparkSession) -> DataFrame:
        """The figures so far as points of gauges, one metric each, to be stored and asked like any other."""
        given = [(t, m, v, n) for (n, m, v), t in zip(self.rows, self.times)]
        rows = spark.createDataFrame(given, "ts_ns long, name string, v_dbl double, query string")
        rows = rows.withColumns({"kind": F.lit("gauge"), "attrs": attributes(kv("stream.query", F.col("query"), "str")), "resource": attributes(kv("service.name", F.lit("tellspan"), "str"))})
        return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in POINTS))

    def onQueryStarted(self, event) -> None:
        self._add((str(event.id), "stream.started", 1.0))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        name = p.name or str(p.id)
        self._add(
            (name, "stream.rows", float(p.numInputRows)),
            (name, "stream.rows_per_second", float(p.processedRowsPerSecond or 0)),
            (name, "stream.arriving_per_second", float(p.inputRowsPerSecond or 0)),
            (name, "stream.batch_ms", float(p.batchDuration)),
            *((name, f"stream.{k}_ms", float(v)) for k, v in p.durationMs.items()),
        )

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._add((str(event.id), "stream.stopped", 1.0))
