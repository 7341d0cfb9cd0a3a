"""Hour-partitioned Parquet: publish, read, retain, compact, offload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOUR_NS = 3_600_000_000_000


def stamped(records: DataFrame) -> DataFrame:
    """``records`` with ``p``, the hour of each one's own time. Late rows go to their hour; nothing is too late."""
    return records.withColumn("p", F.expr(f"(ts_ns - pmod(ts_ns, {HOUR_NS}L)) div {HOUR_NS}L") if "p" not in records.columns else F.col("p"))


def publish(records: DataFrame, path: str, seq: int, node: int = 0, expected_ids: int = 1_000_000) -> None:
    """Store a batch. Rows get their place in it (``row``), so that their order is total and stays.

    A batch has a folder of its own in each hour, so one that is run again takes the place of its first run. An hour that most
    rows belong to is split over tasks. Trace ids get Bloom filters; rows are sorted by time, so that statistics skip row groups.
    """
    out = stamped(records).hint("rebalance", "p").sortWithinPartitions("p", "ts_ns")
    out = out.withColumns({"node": F.lit(node).cast("long"), "seq": F.lit(seq).cast("long"), "row": F.monotonically_increasing_id(), "batch": F.lit(f"{node}-{seq}")})
    writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("p", "batch")
    for c in ("trace_id", "span_id"):
        if c in records.columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(expected_ids))
    writer.parquet(path)


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table under ``path``. Columns that older files lack are null."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("p", T.LongType()), T.StructField("batch", T.StringType())])).parquet(path).drop("batch")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def hours(spark: SparkSession, path: str) -> list[int]:
    """The hours that a table has, oldest first."""
    fs, p = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []
    return sorted(int(n[2:]) for n in names if n.startswith("p=") and n[2:].lstrip("-").isdigit())


def retain(spark: SparkSession, path: str, cutoff_ns: int) -> list[int]:
    """Drop the hours all of whose rows are older than ``cutoff_ns``."""
    gone = [h for h in hours(spark, path) if (h + 1) * HOUR_NS - 1 < cutoff_ns]
    for h in gone:
        fs, p = _fs(spark, f"{path}/p={h}")
        fs.delete(p, True)
    return gone


def reclaim(spark: SparkSession, paths: list[str], free: int, total: int, least_share: float = 0.1, least_bytes: int = 8 << 30) -> tuple[str, int] | None:
    """When free space is short by share and by bytes, drop the oldest hour of any table."""
    if free >= least_share * total or free >= least_bytes:
        return None
    oldest = min(((h, p) for p in paths for h in hours(spark, p)[:1]), default=None)
    if oldest is None:
        return None
    fs, p = _fs(spark, f"{oldest[1]}/p={oldest[0]}")
    fs.delete(p, True)
    return oldest[1], oldest[0]


def compact(spark: SparkSession, path: str, before_ns: int, most: int = 8) -> list[int]:
    """Rewrite up to ``most`` hours that ended before ``before_ns`` as one sorted zstd file set each.

    A marker file says that an hour is done. The new files are written beside the old ones and swapped by rename; what a
    crash between the renames leaves is set right by ``recover``, which runs first.
    """
    recover(spark, path)
    done = []
    for h in hours(spark, path):
        if (h + 1) * HOUR_NS > before_ns or len(done) == most:
            continue
        fs, marker = _fs(spark, f"{path}/p={h}/_compacted")
        if fs.exists(marker):
            continue
        new, old = f"{path}/_compact-{h}", f"{path}/p={h}"
        whole = spark.read.parquet(old).withColumn("batch", F.lit("compacted"))
        whole.repartitionByRange("ts_ns").sortWithinPartitions("ts_ns").write.mode("overwrite").option("compression", "zstd").partitionBy("batch").parquet(new)
        path_of = spark._jvm.org.apache.hadoop.fs.Path
        aside = path_of(f"{path}/_old-{h}")
        fs.rename(path_of(old), aside)
        fs.rename(path_of(new), path_of(old))
        fs.create(marker).close()
        fs.delete(aside, True)
        done.append(h)
    return done


def recover(spark: SparkSession, path: str) -> list[int]:
    """Hours whose compaction was cut short, put back: the old files where the new ones hadn't come yet, else the old ones go."""
    fs, root = _fs(spark, path)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    back = []
    for n in names:
        if n.startswith("_old-"):
            hour = path_of(f"{path}/p={n[5:]}")
            if fs.exists(hour):
                fs.delete(path_of(f"{path}/{n}"), True)
            else:
                fs.rename(path_of(f"{path}/{n}"), hour)
                back.append(int(n[5:]))
        elif n.startswith("_compact-"):
            fs.delete(path_of(f"{path}/{n}"), True)
    return sorted(back)


def offload(spark: SparkSession, path: str, hour: int, store: str) -> str:
    """Copy an hour to another store, through a temporary name. An hour that is there already is refused."""
    source, p = _fs(spark, f"{path}/p={hour}")
    there, q = _fs(spark, f"{store}/p={hour}")
    if there.exists(q):
        raise FileExistsError(f"{store} has hour {hour}")
    jvm = spark._jvm
    part = jvm.org.apache.hadoop.fs.Path(f"{store}/_part-{hour}")
    jvm.org.apache.hadoop.fs.FileUtil.copy(source, p, there, part, False, True, spark._jsc.hadoopConfiguration())
    there.rename(part, q)
    return q.toString()


def fetch(spark: SparkSession, store: str, hour: int, path: str) -> str:
    """The reverse of ``offload``."""
    return offload(spark, store, hour, path)
