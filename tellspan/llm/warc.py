"""WARC archives with a two-level capture index.

Archives hold one gzip member per record. The index sorts captures by reversed-host URL key,
packs runs of lines into compressed blocks, and keeps a sparse directory of each block's first
key. A look-up bisects the shards, then a shard's directory, reads one block, bisects its lines
and so learns which range of which archive to read.

Tasks write files of their own, named so that no two attempts share one, and hand on rows that
name them; rows of a failed attempt are never seen, so what is read is always whole. Files are
reached through ``pyarrow.fs``, so the folder must be one that all executors see.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, release, utf8

#: Payloads of fewer bytes are always stored.
LEAST_SHARED = 1000
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NO_ID = -(1 << 63)
_URN = "urn:tellspan:page:"


def url_key(url: Column) -> Column:
    """``https://a.example.com/p?q#f`` as ``com,example,a)/p?q``. Null reads as ``-``; what has no host stays as it is."""
    clean = F.regexp_replace(F.coalesce(url, F.lit("-")), r"[\x00-\x20]", "%20")
    host = F.regexp_extract(clean, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    rest = F.regexp_replace(F.regexp_replace(clean, r"^[^:]*://[^/?#]*", ""), r"#.*$", "")
    return F.when(host == "", clean).otherwise(F.concat(F.array_join(F.reverse(F.split(F.lower(host), r"\.")), ","), F.lit(")"), rest))


def _files(uri: str):
    return pyarrow.fs.FileSystem.from_uri(uri)


def _attempt() -> str:
    context = TaskContext.get()
    return f"{context.partitionId() if context else 0:05d}-{uuid.uuid4().hex}"


def _record(page: int | None, url: str, digest: str, refers: int | None, payload: bytes, date: str) -> bytes:
    kind = "response" if refers is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers is None else http
    name = f"{_URN}{page}" if page is not None else f"{_URN}none:{uuid.uuid5(uuid.NAMESPACE_URL, url + digest)}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if refers is not None:
        head += [f"WARC-Refers-To: <{_URN}{refers}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(record: bytes) -> dict:
    """Headers by lower-case name, and ``block``, of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    out: dict = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
    out["block"] = rest[: int(out["content-length"])]
    return out


def write_archive(pages: DataFrame, scratch: Scratch, date: str = "2024-01-01T00:00:00Z", roll: int = 1 << 28) -> DataFrame:
    """Write a record for each row of (page_id, url, html); (key, page_id, file, offset, length) of each.

    Of rows with equal payloads of ``LEAST_SHARED`` bytes or more, those with the largest page_id
    are responses and the others revisits of it. Null html is an empty payload. Rows without a
    page_id are responses, and no revisit refers to them.
    """
    payload = utf8("html")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce("url", F.lit("-")), r"[\x00-\x20]", "%20").alias("url"), url_key(F.col("url")).alias("key"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    large = pages.where(F.octet_length(payload) >= LEAST_SHARED).select(F.col("page_id").cast("long").alias("page_id"), F.sha1(payload).alias("digest"))
    top = large.groupBy("digest").agg(F.max("page_id").alias("top"), F.min("page_id").alias("low")).where("low < top").select("digest", "top")
    revisits = large.join(top, "digest").where("page_id < top").dropDuplicates(["page_id", "digest"])
    root = scratch.path("warc")

    def run(batches):
        release()
        fs, folder = _files(root)
        fs.create_dir(folder, recursive=True)
        out = name = None
        at = 0
        try:
            for batch in batches:
                rows = []
                for i in range(batch.num_rows):
                    page, url, key, body, digest, refers = (batch.column(k)[i].as_py() for k in range(6))
                    if out is None or at > roll:
                        if out is not None:
                            out.close()
                        name, at = f"{_attempt()}.warc.gz", 0
                        out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = z.compress(_record(page, url, digest, refers, body, date)) + z.flush()
                    out.write(data)
                    rows.append((key, page, name, at, len(data)))
                    at += len(data)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["key", "page_id", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    rows = base.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "key", "payload", "digest", "top")
    return scratch.put(rows.mapInArrow(run, "key string, page_id bigint, file string, offset bigint, length bigint"), "captures")


def build_index(captures: DataFrame, scratch: Scratch, shards: int = 32, lines: int = 512) -> list[tuple[str, int, str]]:
    """Write the index; (first key, first id, name) of each shard, in order. ``shards`` bounds what the driver gets."""
    root = scratch.path("index")

    def run(batches):
        fs, folder = _files(root)
        fs.create_dir(folder, recursive=True)
        name, first, block, directory, at, out = _attempt(), None, [], [], 0, None

        def flush():
            nonlocal at
            data = zlib.compress("".join(f"{k}\t{p}\t{f}\t{o}\t{n}\n" for k, p, f, o, n in block).encode(), 6)
            out.write(data)
            directory.append(f"{block[0][0]}\t{block[0][1]}\t{at}\t{len(data)}\n")
            at += len(data)
            block.clear()

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if out is None:
                    out, first = fs.open_output_stream(f"{folder}/{name}.blocks"), row[:2]
                block.append(row)
                if len(block) == lines:
                    flush()
        if out is not None:
            if block:
                flush()
            out.close()
            with fs.open_output_stream(f"{folder}/{name}.directory") as d:
                d.write("".join(directory).encode())
            yield pa.RecordBatch.from_arrays([pa.array([first[0]]), pa.array([first[1]], pa.int64()), pa.array([name])], ["key", "page_id", "name"])

    rows = captures.select("key", F.coalesce("page_id", F.lit(_NO_ID)).alias("page_id"), "file", "offset", "length")
    rows = rows.repartitionByRange(shards, "key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")
    made = scratch.put(rows.mapInArrow(run, "key string, page_id bigint, name string"), "shards")
    return sorted((r["key"], r["page_id"], r["name"]) for r in made.collect())


class IndexReader:
    """Look-ups in one task. Holds the directory of one shard and the lines of one block at a time."""

    def __init__(self, root: str, shards: list[tuple[str, int, str]]):
        self.fs, self.folder = _files(root)
        self.names = [s[2] for s in shards]
        self.firsts = [s[:2] for s in shards]
        self.shard = self.block = -1

    def _open(self, shard: int) -> None:
        if shard != self.shard:
            with self.fs.open_input_stream(f"{self.folder}/{self.names[shard]}.directory") as f:
                rows = [line.split("\t") for line in f.read().decode().split("\n") if line]
            self.directory = [(r[0], int(r[1])) for r in rows]
            self.ranges = [(int(r[2]), int(r[3])) for r in rows]
            self.file = self.fs.open_input_file(f"{self.folder}/{self.names[shard]}.blocks")
            self.shard, self.block = shard, -1

    def _load(self, block: int) -> None:
        if block != self.block:
            at, size = self.ranges[block]
            self.file.seek(at)
            rows = [line.split("\t") for line in zlib.decompress(self.file.read(size)).decode().split("\n") if line]
            self.keys = [(r[0], int(r[1])) for r in rows]
            self.rows, self.block = rows, block

    def find(self, key: str, page: int):
        """(file, offset, length) of each capture of this key and id."""
        want = (key, page)
        shard = bisect_right(self.firsts, want) - 1
        if shard < 0:
            return
        self._open(shard)
        block = max(0, bisect_left(self.directory, want) - 1)
        while block < len(self.directory) and self.directory[block] <= want:
            self._load(block)
            i = bisect_left(self.keys, want)
            while i < len(self.keys) and self.keys[i] == want:
                r = self.rows[i]
                yield r[2], int(r[3]), int(r[4])
                i += 1
            block += 1


def locate(wanted: DataFrame, scratch: Scratch, shards: list[tuple[str, int, str]], partitions: int = 32) -> DataFrame:
    """(file, offset, length) of the captures of each distinct (key, page_id) in ``wanted``."""
    root = scratch.path("index")

    def run(batches):
        reader = IndexReader(root, shards)
        for batch in batches:
            got = [hit for key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for hit in reader.find(key, page)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())], ["file", "offset", "length"])

    keys = wanted.select("key", F.coalesce(F.col("page_id").cast("long"), F.lit(_NO_ID)).alias("page_id")).distinct()
    return keys.repartitionByRange(partitions, "key", "page_id").sortWithinPartitions("key", "page_id").mapInArrow(run, "file string, offset bigint, length bigint")


def fetch(located: DataFrame, scratch: Scratch, partitions: int = 32, gap: int = 1 << 16, most: int = 1 << 22) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of the records at these places.

    Places are read in the order of the archives, near ones together. ``payload`` is null for
    revisits, whose length and digest are those of the payload they stand for.
    """
    root = scratch.path("warc")

    def rows(places):
        fs, folder = _files(root)
        name = file = None
        i = 0
        while i < len(places):
            if places[i][0] != name:
                name = places[i][0]
                file = fs.open_input_file(f"{folder}/{name}")
            start, j, end = places[i][1], i, places[i][1] + places[i][2]
            while j + 1 < len(places) and places[j + 1][0] == name and places[j + 1][1] <= end + gap and places[j + 1][1] + places[j + 1][2] - start <= most:
                j += 1
                end = places[j][1] + places[j][2]
            file.seek(start)
            data = file.read(end - start)
            for _, at, size in places[i : j + 1]:
                yield parse(zlib.decompress(data[at - start : at - start + size], 31))
            i = j + 1

    def run(batches):
        for batch in batches:
            places = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            out = []
            for r in rows(places):
                head, _, body = r["block"].partition(b"\r\n\r\n")
                own = r["warc-record-id"][len(_URN) + 1 : -1]
                page = None if own.startswith("none") else int(own)
                said = base64.b32decode(r["warc-payload-digest"][5:]).hex()
                if r["warc-type"] == "response":
                    digest = hashlib.sha1(body).hexdigest()
                    if digest != said:
                        raise ValueError(f"record {own}: payload and digest differ")
                    out.append((page, r["warc-target-uri"], body, len(body), digest, "response", None))
                else:
                    size = next(int(h[15:]) for h in head.split(b"\r\n") if h.lower().startswith(b"content-length:"))
                    out.append((page, r["warc-target-uri"], None, size, said, "revisit", int(r["warc-refers-to"][len(_URN) + 1 : -1])))
                if len(out) == 256:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def _batch(out):
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names)

    ordered = located.repartitionByRange(partitions, "file", "offset").sortWithinPartitions("file", "offset").select("file", "offset", "length")
    return ordered.mapInArrow(run, "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def archive_and_read(pages: DataFrame, shards: int | None = None, shard_lines: int = 500_000, part_bytes: int = 1 << 28) -> DataFrame:
    """Write ``pages`` to archives, index them, look every page up and read its record back, as ``fetch`` returns it.

    A row for each row of ``pages``: null html is an empty payload, null urls have the key ``-``, and rows that repeat a
    page_id and url, or lack an id, have a record each. Other columns are not read; an empty table gives no rows.
    ``shards`` defaults to one for each ``shard_lines`` captures, and reads are dealt into parts of ``part_bytes`` of
    archive, both the session's number of partitions at least.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    captures = write_archive(pages, scratch)
    size = captures.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("b")).first()
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = build_index(captures, scratch, shards or max(usual, -(-size["n"] // shard_lines)))
    wanted = pages.select(url_key(F.col("url")).alias("key"), "page_id")
    located = scratch.put(locate(wanted, scratch, index, shards or max(usual, len(index))), "located")
    scratch.drop("captures", "shards")
    return fetch(located, scratch, max(usual, -(-size["b"] // part_bytes)))


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM p),
t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM t
"""
