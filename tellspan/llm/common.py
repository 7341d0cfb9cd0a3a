"""What the training-data operators share: scratch tables, workers' memory, whole texts as bytes, hashed words."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch, where the session doesn't say otherwise: whole texts are long, and a worker holds some copies of a batch.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of a session that has Spark's own default."""
    key, default, size = BATCH
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, size)


class Scratch:
    """A folder of intermediate tables under ``spark.checkpoint.dir``.

    Written tables cut lineage and survive the loss of executors. The setting is read from the
    session; a temporary folder stands in only where it is unset and all tasks run in the driver's process, as in tests.
    """

    def __init__(self, spark: SparkSession, label: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = os.path.join(tempfile.gettempdir(), "tellspan-scratch")
            spark.conf.set("spark.checkpoint.dir", base)
        small_batches(spark)
        self.spark = spark
        self.root = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write ``df`` and return the written table."""
        df.write.options(**options).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def settle(self) -> None:
        """Let Spark's cleaner remove the shuffle files of steps whose results are written tables by now."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Remove tables that no later step reads; without names, the whole folder."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for path in map(self.path, names) if names else [self.root]:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


_resident: dict[Any, Any] = {}


def resident(key: Any, make: Callable[[], Any]) -> Any:
    """One large object for each Python worker: it serves later tasks of its kind, and goes when a task of another kind begins.

    Workers are used again by all steps of a session, so whatever each of them kept would add up.
    """
    if key not in _resident:
        release()
        _resident[key] = make()
    return _resident[key]


def release() -> None:
    """Let go of what earlier tasks of this worker have kept, and give its memory back."""
    if not _resident:
        return
    _resident.clear()
    gc.unfreeze()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not with this C library


def utf8(text: Column | str) -> Column:
    """The whole text as UTF-8 bytes; null reads as empty, invalid sequences as U+FFFD."""
    col = F.col(text) if isinstance(text, str) else text
    return F.make_valid_utf8(F.coalesce(col, F.lit(""))).cast("binary")


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary Arrow array without copying its values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    big = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    n, kind = len(column), np.int64 if big else np.int32
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 19):
    """Slices of a batch whose texts hold about ``most`` bytes each (a longer text is a slice of its own)."""
    offsets = flat_bytes(batch.column(column))[1]
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


_rng = np.random.Generator(np.random.PCG64(20240229))
_LONG = 64  # bytes of a word that are hashed at once
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, _LONG, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCK = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BYTE[_SPACE] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hashed_words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of many texts at once: (64-bit hashes, starts, ends, index of the first word of each text).

    The last array has one more entry than there are texts. ``lower`` folds A-Z only. A word's
    hash depends on its bytes alone, so equal words have equal hashes on every executor.
    """
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(offsets), np.int64)
    inside = np.empty(n + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[data], out=inside[1:-1])
    change = inside[1:] != inside[:-1]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    cut = edges[inside[edges] & inside[edges + 1]]  # a text ends where the next begins, both inside a word
    starts = np.flatnonzero(change & inside[1:])
    ends = np.flatnonzero(change & inside[:-1])
    if len(cut):
        cut = np.unique(cut)
        starts = np.sort(np.concatenate([starts, cut]))
        ends = np.sort(np.concatenate([ends, cut]))
    blocks = (ends - starts + (_LONG - 1)) // _LONG
    long_words = len(blocks) and int(blocks.max()) > 1
    if long_words:
        heads = np.cumsum(blocks) - blocks
        nth = np.arange(int(blocks.sum())) - np.repeat(heads, blocks)
        at = np.repeat(starts, blocks) + nth * _LONG
    else:
        at = starts
    if not len(at):
        return np.zeros(0, np.uint64), starts, ends, np.searchsorted(starts, offsets)
    # a byte counts by its value and its place in the block; spaces count nothing
    place = np.arange(n, dtype=np.int32)
    place[at[0] :] -= np.repeat(at, np.diff(np.append(at, n))).astype(np.int32)
    place &= _LONG - 1
    value = (_BYTE[_LOWER] if lower else _BYTE)[data]
    value *= _PLACE[place]
    h = np.add.reduceat(value, at)
    if long_words:  # blocks by number, each well mixed before they are summed; a word of one block hashes as it would alone
        h = np.where(blocks > 1, np.add.reduceat(mix(mix(h) + (nth + 1).astype(np.uint64) * _BLOCK), heads), h[heads])
    h += (ends - starts).astype(np.uint64)
    return mix(h), starts, ends, np.searchsorted(starts, offsets)


def bitmap(names: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bits by the low ``bits`` bits of a column of longs: 2 ** bits of them, however many rows there are."""
    low = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    rows = names.select(F.shiftright(low, 15).alias("k"), low.bitwiseAND(F.lit((1 << 15) - 1)).alias("bit")).groupBy("k").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros((1 << (bits - 15), 1 << 12), np.uint8)
    for r in rows.toLocalIterator():
        out[r["k"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def marked(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which 64-bit values have their bit in a bitmap."""
    x = values & np.uint64(8 * len(bits) - 1)
    return (bits[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 == 1
