"""Set-similarity join of word shingles with a token-group matrix.

Documents with equal sets are one class. Likely copies are first linked to one representative of
their min-hash bucket, verified exactly; what hangs together then is cut into groups of bounded
size, and the matrix holds each group's union of tokens. A query document can be as similar as
asked only to members of groups whose union holds that share of its own tokens: groups without a
common rare token are never looked at, those whose union holds too few are not opened, and members
of opened groups are verified exactly. Documents already connected need no further links, so large
groups of near copies cost one comparison a document, not one a pair.

Rare tokens: sets with a similarity of at least ``least`` percent share k tokens among the first
n - ceil(least n / 100) + k of either in any common order. Here k grows with n, and the order puts
tokens of many documents last, so common passages bring few candidates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bitmap, flat_bytes, hashed_words, marked, mix, pieces, release, utf8
from .components import components

_STEP = [np.uint64(x) for x in (0xD1B54A32D192ED03, 0xABC98388FB8FAC03, 0x8CB92BA72F3D8DD7, 0xE7037ED1A0B428DB, 0x9FB21C651E98DF25)]
_KEYS = 6  # min-hash keys of a document
_GROUP = 64  # members of a group, about
_MANY = (24, 2000)  # documents from which the order puts a token late, and last
_BITS = 26  # of the bitmap of either: 8 MB; tokens that share a bit share their place in the order
_HELD = 1 << 21  # tokens that a task counts together
_SEEN = 100_000  # sets that a task remembers
_SEND = 400_000  # rows of ids that may be broadcast
_EACH = 20  # a set of n tokens must share 1 + n // _EACH of its first tokens
_BLOCK = 1 << 16  # pairs of groups that one token brings to one task, about


def token_sets(batch: pa.RecordBatch, column: str, width: int = 5):
    """(row, sorted distinct 64-bit shingles) of each text of a batch; rows without words have none.

    Texts of fewer than ``width`` words have their whole sequence as their one shingle.
    """
    done = 0
    for part in pieces(batch, column):
        data, offsets = flat_bytes(part.column(column))
        h, _, _, first = hashed_words(data, offsets, True)
        n = len(h) - width + 1
        if n > 0:
            s = h[:n] * _STEP[0]
            for k in range(1, width):
                s += h[k : k + n] * _STEP[k % len(_STEP)] ^ (h[k : k + n] >> np.uint64(29 + k))
            s = mix(s)
        for i in range(part.num_rows):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= width:
                yield done + i, np.unique(s[a : b - width + 1])
            elif b > a:
                x = np.array([b - a], np.uint64)
                for k in range(a, b):
                    x = mix(x * _STEP[0] + h[k : k + 1])
                yield done + i, x
            else:
                yield done + i, np.zeros(0, np.uint64)
        done += part.num_rows


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


_SEEDS = [np.uint64(mix(np.array([k + 1], np.uint64))[0]) for k in range(_KEYS)]


def _digest(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits of a set; equal sets are one class."""
    return mix(s).sum(dtype=np.uint64), mix(s ^ _SEEDS[0]).sum(dtype=np.uint64)


def profiles(docs: DataFrame, width: int = 5) -> DataFrame:
    """Of each document (doc, n, c1, c2, keys): set size, 128-bit digest of the set, min-hash keys. Rows with keys null:
    (token, seen), tokens that several of the documents a task read together have."""

    def run(batches):
        release()
        held, size = [], 0

        def frequent():
            t = np.concatenate(held)
            t.sort()
            heads = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            c = np.diff(np.append(heads, len(t)))
            ok = c >= 2
            k = int(ok.sum())
            return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64())] * 4 + [pa.nulls(k, pa.list_(pa.int64())), pa.array(_signed(t[heads[ok]])), pa.array(c[ok].astype(np.int64))], names)

        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            c = np.zeros((2, batch.num_rows), np.uint64)
            keys = np.zeros((batch.num_rows, _KEYS), np.uint64)
            for i, s in token_sets(batch, "t", width):
                n[i] = len(s)
                if len(s):
                    c[:, i] = _digest(s)
                    keys[i] = [mix(s ^ seed).min() for seed in _SEEDS]
                    held.append(s)
                    size += len(s)
                if size > _HELD:
                    yield frequent()
                    held, size = [], 0
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * _KEYS), pa.array(_signed(keys.ravel())))
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(_signed(c[0])), pa.array(_signed(c[1])), lists, none, none], names)
        if held:
            yield frequent()

    names = ["doc", "n", "c1", "c2", "keys", "token", "seen"]
    return docs.select("doc", "t").mapInArrow(run, "doc bigint, n bigint, c1 bigint, c2 bigint, keys array<bigint>, token bigint, seen bigint")


def prefixes(docs: DataFrame, late, least: int, width: int) -> DataFrame:
    """(t, c1): the first tokens of each set, in the order that puts the tokens of the bitmaps ``late`` (a broadcast) last,
    and half of the set's digest. Of equal sets that a task meets, one stands for all."""

    def run(batches):
        release()
        seen = set()
        for batch in batches:
            tokens, classes = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for _, s in token_sets(batch, "t", width):
                if not len(s):
                    continue
                c1, c2 = _digest(s)
                if (key := (int(c1), int(c2))) in seen:
                    continue
                if len(seen) > _SEEN:
                    seen.clear()
                seen.add(key)
                p = len(s) - -(-least * len(s) // 100) + 1 + len(s) // _EACH
                rank = sum(marked(bits, s).astype(np.int8) for bits in late.value)
                if rank.any():
                    s = s[np.argsort(rank, kind="stable")]
                tokens.append(s[:p])
                classes.append(np.full(min(p, len(s)), c1))
            yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(tokens))), pa.array(_signed(np.concatenate(classes)))], ["t", "c1"])

    return docs.select("t").mapInArrow(run, "t bigint, c1 bigint")


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc, c1, c2, tokens) of the documents in ``ids``, a written table. Its size decides how it meets the texts."""

    def run(batches):
        release()
        for batch in batches:
            got = [s for _, s in token_sets(batch, "t", width)]
            c = np.array([_digest(s) for s in got], np.uint64).reshape(-1, 2)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in got])]).astype(np.int32)), pa.array(_signed(np.concatenate([np.zeros(0, np.uint64), *got]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_signed(c[:, 0].copy())), pa.array(_signed(c[:, 1].copy())), lists], ["doc", "c1", "c2", "tokens"])

    ids = F.broadcast(ids) if ids.count() <= _SEND else ids
    return docs.select("doc", "t").join(ids, "doc").mapInArrow(run, "doc bigint, c1 bigint, c2 bigint, tokens array<bigint>").dropDuplicates(["doc", "c1", "c2"])


def _groups(sets: DataFrame, place: DataFrame) -> DataFrame:
    """(g, members): a row of the matrix, with each member's id, component and tokens."""
    return sets.join(place.select("doc", "c1", "c2", "g", "comp"), ["doc", "c1", "c2"]).groupBy("g").agg(F.collect_list(F.struct(F.col("doc").alias("d"), F.col("comp").alias("k"), F.col("tokens").alias("s"))).alias("members"))


class _Members:
    """The members of a column of groups, without copies of their tokens."""

    def __init__(self, column: pa.Array):
        ends = lambda x: np.concatenate([[0], np.cumsum(pa.compute.list_value_length(x).to_numpy(zero_copy_only=False))]).astype(np.int64)
        flat = column.flatten()
        self.rows = ends(column)
        self.ids, self.comps = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        tokens = flat.field(2)
        self.ends = ends(tokens)
        self.tokens = tokens.flatten().to_numpy(zero_copy_only=False).view(np.uint64)

    def of(self, row: int) -> range:
        return range(self.rows[row], self.rows[row + 1])

    def set(self, i: int) -> np.ndarray:
        return self.tokens[self.ends[i] : self.ends[i + 1]]

    def union(self, row: int) -> np.ndarray:
        return np.unique(self.tokens[self.ends[self.rows[row]] : self.ends[self.rows[row + 1]]])


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    both = np.concatenate([x, y])
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _verify(pairs: DataFrame, groups: DataFrame, least: int) -> DataFrame:
    """(a, b) of the links between members of different components, for pairs of groups (a, b).

    Each member of the one group is a query against the other: the bound by the union comes first,
    and only groups that pass it are opened.
    """

    def run(batches):
        release()
        for batch in batches:
            left, right = _Members(batch.column(0)), _Members(batch.column(1))
            same = batch.column(2).to_pylist()
            a, b = [], []
            for row in range(batch.num_rows):
                union = right.union(row) if len(right.of(row)) > 1 else None
                for i in left.of(row):
                    own = left.set(i)
                    if union is not None and 100 * _common(own, union) < least * len(own):
                        continue
                    for j in right.of(row):
                        if left.comps[i] == right.comps[j] or same[row] and left.ids[i] >= right.ids[j]:
                            continue
                        other = right.set(j)
                        if 100 * min(len(own), len(other)) < least * max(len(own), len(other)):
                            continue
                        n = _common(own, other)
                        if 100 * n >= least * (len(own) + len(other) - n):
                            a.append(min(left.ids[i], right.ids[j]))
                            b.append(max(left.ids[i], right.ids[j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    full = pairs.join(groups.select(F.col("g").alias("a"), F.col("members").alias("x")), "a").join(groups.select(F.col("g").alias("b"), F.col("members").alias("y")), "b")
    return full.select("x", "y", (F.col("a") == F.col("b")).alias("same")).mapInArrow(run, "a bigint, b bigint").distinct()


def _meetings(cells: DataFrame, least: int) -> DataFrame:
    """(a, b, least): pairs of groups for each token that both have and that members of several components have.

    Within a token, groups of the component that holds most of them meet only the others, and
    tokens of many groups are dealt over many tasks.
    """
    mixed = cells.groupBy("t").agg(F.min("c0").alias("x"), F.max("c1").alias("y")).where("x < y").select("t")
    cells = cells.join(mixed, "t")
    most = cells.groupBy("t", "c0").agg(F.sum(F.when(F.col("c0") == F.col("c1"), 1).otherwise(0)).alias("m"), F.count("*").alias("every"))
    most = most.groupBy("t").agg(F.max_by("c0", F.struct("m", "c0")).alias("main"), F.sum("every").alias("every"), F.max("m").alias("m"))
    cells = cells.join(most, "t").withColumn("own", (F.col("c0") == F.col("main")) & (F.col("c1") == F.col("main")))
    parts = F.ceil((F.col("every") - F.col("m")) * F.col("every") / F.lit(_BLOCK))
    cells = cells.withColumn("parts", F.greatest(parts, F.lit(1)).cast("int"))
    side = lambda k: ["t", "part", *(F.col(c).alias(k + c) for c in ("g", "lo", "hi", "c0", "c1", "own"))]
    one = cells.where("not own").withColumn("part", F.pmod(F.xxhash64("g"), "parts").cast("int")).select(*side("a"))
    other = cells.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*side("b"))
    meet = one.join(other, ["t", "part"]).where(f"(bown or ag <= bg) and 100 * ahi >= {least} * blo and 100 * bhi >= {least} * alo and least(ac0, bc0) < greatest(ac1, bc1)")
    return meet.select(F.least("ag", "bg").alias("a"), F.greatest("ag", "bg").alias("b"), F.least("alo", "blo").alias("least"))


def near_documents(documents: DataFrame, least: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id), a row for each row of ``documents``.

    Two documents link if 100 * |intersection| >= ``least`` * |union| of their shingle sets; a
    component's id is the smallest of its documents'. Texts that are null or without words have
    empty sets and link with nothing, as do rows without an id, whose component is null. Rows that
    repeat an id are one document each, whatever their texts, and share a component unless they have no words. Ids are read as long
    integers; other columns aren't read.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "jaccard")
    if documents.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{id_col} must be an integer")
    docs = documents.select(F.col(id_col).cast("long").alias("doc"), utf8(text_col).alias("t"))
    profile = scratch.put(profiles(docs, width), "profiles")
    rows = profile.where("keys is not null")
    usable = rows.where("doc is not null and n > 0")
    # equal sets are one class, which its smallest id stands for; (doc, c1, c2) names it even where ids repeat
    reps = scratch.put(usable.groupBy("n", "c1", "c2").agg(F.min("doc").alias("doc"), F.max("doc").alias("top"), F.first("keys").alias("keys")), "reps")
    member = scratch.put(usable.select("doc", "n", "c1", "c2").join(reps.select("n", "c1", "c2", F.col("doc").alias("rep")), ["n", "c1", "c2"]).select("doc", "rep").distinct(), "member")
    ids = member.groupBy("doc").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b")
    ids = ids.select("doc", "a").join(member, "doc").where("a < rep").select("a", F.col("rep").alias("b"))  # classes that a repeated id joins

    # Stars: each class looks at the smallest of its min-hash buckets, where it shares two keys or more.
    keyed = reps.select("doc", "keys", F.posexplode("keys").alias("k", "key"))
    leader = keyed.groupBy("k", "key").agg(F.min("doc").alias("g"), F.max("doc").alias("top")).where("g < top").select("k", "key", "g")
    shared = keyed.join(leader, ["k", "key"]).where("doc <> g").groupBy(F.col("doc").alias("q"), "g").agg(F.count("*").alias("c"))
    star = scratch.put(shared.where("c >= 2").select("q", "g"), "star")  # at most half as many as there are keys
    ends = scratch.put(star.select(F.col("q").alias("doc")).union(star.select("g")).distinct(), "star_ids")
    sets = scratch.put(_sets(docs, ends, width), "star_sets")
    alone = _groups(sets, reps.select("doc", "c1", "c2", F.col("doc").alias("g"), F.col("doc").alias("comp")))
    first = scratch.put(_verify(star.select(F.col("q").alias("a"), F.col("g").alias("b")), alone, least).unionByName(ids), "star_links")
    scratch.drop("star_sets")
    near = components(first, scratch, "near")

    # The matrix: groups of what hangs together, and of single documents with a min-hash key in common.
    place = reps.select("doc", "c1", "c2", "n", F.col("keys")[0].alias("key")).join(near.withColumnRenamed("id", "doc"), "doc", "left").select("doc", "c1", "c2", "n", "key", F.coalesce("component", "doc").alias("comp"))
    members = place.groupBy("comp").agg(F.count("*").alias("m"))
    place = place.join(members, "comp").withColumn("key", F.when(F.col("m") > 1, F.xxhash64(F.lit(1), "comp")).otherwise(F.xxhash64(F.lit(2), "key")))
    parts_of = place.groupBy("key").agg(F.ceil(F.count("*") / F.lit(_GROUP)).alias("parts"))
    place = scratch.put(place.join(parts_of, "key").select("doc", "c1", "c2", "n", "comp", F.xxhash64("key", F.pmod(F.xxhash64("c1"), "parts")).alias("g")), "place")
    common = scratch.put(profile.where("token is not null").groupBy("token").agg(F.sum("seen").alias("c")).where(F.col("c") >= _MANY[0]), "common")
    late = spark.sparkContext.broadcast([bitmap(common.where(F.col("c") >= many), "token", _BITS) for many in _MANY])  # of fixed size
    scratch.settle()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = prefixes(docs.where("doc is not null"), late, least, width).repartition(parts, "t")
    open_lists = listed.groupBy("t").agg(F.min("c1").alias("lo"), F.max("c1").alias("hi")).where("lo < hi").select("t")
    lists = scratch.put(listed.join(open_lists.hint("shuffle_merge"), "t"), "lists")
    # classes that agree in c1 alone are taken for each other here: more groups are opened then, none fewer
    lists = lists.join(place.select("c1", "g", "n", "comp"), "c1")
    cells = scratch.put(lists.groupBy("t", "g").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("comp").alias("c0"), F.max("comp").alias("c1")), "cells")
    enough = _meetings(cells, least).groupBy("a", "b").agg(F.count("*").alias("c"), F.min("least").alias("least")).where(f"c > least div {_EACH}")
    pairs = scratch.put(enough.select("a", "b"), "pairs")
    wanted = place.join(pairs.select(F.col("a").alias("g")).union(pairs.select("b")).distinct(), "g").select("doc").distinct()
    sets = scratch.put(_sets(docs, scratch.put(wanted, "wanted"), width), "sets")
    second = _verify(pairs, _groups(sets, place), least)
    links = scratch.put(first.unionByName(second), "links")
    scratch.drop("sets", "lists", "cells", "common")
    whole = components(links, scratch, "whole")
    known = member.join(whole.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.groupBy("doc").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    out = rows.select("doc", "n").join(known, "doc", "left")
    component = F.when(F.col("n") > 0, F.col("component"))
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce(component, "doc").alias("component_id"))


def keep_one(documents: DataFrame, least: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, unchanged: that with the smallest id, and of rows that repeat this id, that with the least hashed text.

    Rows without an id and rows without words (null and empty texts among them) all stay, whatever they repeat.
    """
    scratch = Scratch(documents.sparkSession, "keep")
    sent = lambda ids: F.broadcast(ids) if ids.count() <= _SEND else ids
    found = scratch.put(near_documents(documents, least, width, id_col, text_col).where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("__gone")).distinct(), "drop")
    worded = F.col(text_col).rlike(r"[^\x20\x09-\x0D]")
    left = documents.join(sent(found), (F.col(id_col) == F.col("__gone")) & worded, "left_anti")
    again = documents.where(worded & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__again")).agg(F.count("*").alias("__n")).where("__n > 1").select("__again")
    again = scratch.put(again, "again")
    if not again.count():
        return left
    repeats = (F.col(id_col) == F.col("__again")) & worded
    one = left.join(sent(again), repeats, "left_semi").groupBy(F.col(id_col).alias("__id")).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in documents.columns)), F.xxhash64(text_col)).alias("__row"))
    return left.join(sent(again), repeats, "left_anti").unionByName(one.select("__row.*"))
