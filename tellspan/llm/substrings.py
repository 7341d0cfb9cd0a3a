"""Long repeats across documents, found by recompression.

Rounds rewrite every document's words: a run of one symbol becomes a symbol, then each pair of a
left and a right symbol does (a hash of the symbol and the round decides which it is). Names are
hashes of what they replace, so equal strings get equal names on every executor without a
dictionary. A symbol depends on the words of its own span and on the neighbours that its rounds
looked at; inside a repeat, all symbols whose span of dependence the repeat holds are the same in
both places.

Of the symbols whose dependence a window of words holds, the longest (of these, the one with the least hashed name) speaks
for the window: the same one in every place where the window repeats. So a window can repeat only
if its symbol speaks for windows of two documents. Windows that pass (or hold no whole symbol) are verified by a
64-bit hash of their words, made apart from the symbols' names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bitmap, flat_bytes, hashed_words, marked, mix, pieces, release, utf8

_RUN, _PAIR = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_BITS = 27  # of the bitmap of names that occur in two documents: 16 MB
_SEND_IDS = 400_000  # ids that may be broadcast
_SEND = 1 << 23  # names up to which a bitmap stands for them; beyond, each document meets its own


def _seed(k: int) -> np.uint64:
    return mix(np.array([k + 101], np.uint64))[0]


def symbols(words: np.ndarray, first: np.ndarray, rounds: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(names, from, to, words) of the symbols of many texts after so many rounds, in order.

    ``first``: index of each text's first word, and the end. From and to bound the words on which
    a symbol depends; they reach out of the text where a neighbour was looked for and not there.
    """
    name = words.copy()
    n = len(name)
    low, high, place = np.arange(n), np.arange(1, n + 1), np.arange(n)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    begins, ends = first[:-1] - 1, first[1:] + 1
    for r in range(rounds):
        if not len(name):
            break
        joined = text[1:] == text[:-1]
        before = np.concatenate([[False], joined])
        after = np.concatenate([joined, [False]])
        # runs: whether a symbol belongs to one, both neighbours tell
        left = np.where(before, np.concatenate([[0], low[:-1]]), begins[text])
        right = np.where(after, np.concatenate([high[1:], [0]]), ends[text])
        same = joined & (name[1:] == name[:-1])
        if same.any():
            heads = np.flatnonzero(np.concatenate([[True], ~same]))
            size = np.diff(np.concatenate([heads, [len(name)]]))
            name = np.where(size > 1, mix(name[heads] * _RUN + size.astype(np.uint64)), name[heads])
            low, high, text, place = left[heads], right[heads + size - 1], text[heads], place[heads]
            joined = text[1:] == text[:-1]
            before = np.concatenate([[False], joined])
            after = np.concatenate([joined, [False]])
        else:
            low, high = left, right
        # pairs: a left symbol asks its right neighbour, a right symbol its left one
        is_left = (mix(name ^ _seed(r)) & np.uint64(1)).astype(bool)
        pair = joined & is_left[:-1] & ~is_left[1:]
        high_ = np.where(is_left, np.where(after, np.concatenate([high[1:], [0]]), ends[text]), high)
        low_ = np.where(is_left, low, np.where(before, np.concatenate([[0], low[:-1]]), begins[text]))
        heads = np.flatnonzero(pair)
        high_[heads] = high[heads + 1]
        merged = name.copy()
        merged[heads] = mix(name[heads] * _PAIR + mix(name[heads + 1]) + np.uint64(r))
        stay = np.ones(len(name), bool)
        stay[heads + 1] = False
        name, low, high, text, place = merged[stay], low_[stay], high_[stay], text[stay], place[stay]
    return name, low, high, np.diff(np.append(place, n))


def ranked(name: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Hashed names that put symbols of more words first: the longest symbol is the least likely to occur elsewhere by chance."""
    return mix(name ^ _RUN) >> np.uint64(4) | (15 - np.minimum(count, 15)).astype(np.uint64) << np.uint64(60)


def speakers(words: np.ndarray, first: np.ndarray, size: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, text, symbol, whether there is one) of each window of ``size`` words inside a text."""
    name, low, high, count = symbols(words, first, rounds)
    score = ranked(name, count)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    p = np.arange(max(0, len(words) - size + 1))
    p = p[text[p] == text[p + size - 1]]
    j, k = np.searchsorted(low, p, "left"), np.searchsorted(high, p + size, "right")
    held = np.maximum(k - j, 0)
    out, level, least = np.zeros(len(p), np.uint64), 0, score
    while (1 << level) <= int(held.max(initial=0)):  # ``least``: of 2 ** level symbols from each on
        now = np.flatnonzero((held >> level) == 1)
        out[now] = np.minimum(least[j[now]], least[k[now] - (1 << level)])
        least = np.minimum(least[: len(least) - (1 << level)], least[1 << level :])
        level += 1
    return p, text[p], out, held > 0


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words, by doubling."""
    n = len(words) - size + 1
    out = np.zeros(n, np.uint64)
    block, width, at = words, 1, 0
    rest = size
    while rest:
        if rest & 1:
            out = mix(out * _PAIR + block[at : at + n])
            at += width
        rest >>= 1
        if rest:
            block = mix(block[:-width] * _RUN + block[width:] + np.uint64(width))
            width *= 2
    return out


def repeats(documents: DataFrame, size: int = 50, rounds: int = 4, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, Scratch]:
    """(facts, starts): (doc, k, n_words, whole_sha256) of every row with its words' digest and, where ids repeat, its text's hash (else 0), and (doc, k, starts), the sorted
    places of the windows of ``size`` words that also start in a document with a smaller id. Both are written tables."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "repeats")
    docs = documents.select(F.col(id_col).cast("long").alias("doc"), utf8(text_col).alias("t")).withColumn("k", F.xxhash64("t"))

    def name(batches):
        release()
        for batch in batches:
            n, digests, names, sizes = [], [], [np.zeros(0, np.uint64)], []
            for part in pieces(batch, "t"):
                data, offsets = flat_bytes(part.column("t"))
                h, _, _, first = hashed_words(data, offsets, False)
                n.append(np.diff(first))
                digests += [hashlib.sha256(b" ".join(t.split())).hexdigest() for t in part.column("t").to_pylist()]
                _, text, symbol, some = speakers(h, first, size, rounds)
                text, symbol = text[some], symbol[some]
                heads = np.flatnonzero(np.concatenate([[True], (symbol[1:] != symbol[:-1]) | (text[1:] != text[:-1])])) if len(text) else np.zeros(0, np.int64)
                names.append(symbol[heads])
                sizes.append(np.bincount(text[heads], minlength=part.num_rows))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)), pa.array(np.concatenate(names).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.concatenate(n).astype(np.int64)), pa.array(digests), lists], ["doc", "k", "n_words", "whole_sha256", "names"])

    facts = scratch.put(docs.mapInArrow(name, "doc bigint, k bigint, n_words bigint, whole_sha256 string, names array<bigint>"), "facts")
    seen = facts.where(F.col("doc").isNotNull() & (F.col("n_words") >= size)).select("doc", "k", F.explode(F.array_distinct("names")).alias("name"))
    twice = seen.groupBy("name").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("name")
    twice = scratch.put(twice, "twice")
    scratch.settle()
    again = scratch.put(facts.where(F.col("doc").isNotNull()).groupBy(F.col("doc").alias("twin")).agg(F.count("*").alias("c")).where("c > 1").select("twin"), "again")
    again = F.broadcast(again) if again.count() <= _SEND_IDS else again
    own_text = lambda df: df.join(again, F.col("doc") == F.col("twin"), "left").withColumn("k", F.when(F.col("twin").isNotNull(), F.col("k")).otherwise(F.lit(0))).drop("twin")
    known = own_text(docs.where(F.col("doc").isNotNull()))
    if twice.count() <= _SEND:
        # A false bit lets a window through that is then compared like any other.
        shared = spark.sparkContext.broadcast(bitmap(twice, "name", _BITS))
        texts = known.select("doc", "t", "k", F.lit(None).cast("array<bigint>").alias("names"))
    else:
        shared = None
        own = own_text(seen).join(twice, "name").groupBy("doc", "k").agg(F.collect_set("name").alias("names"))
        texts = known.join(own, ["doc", "k"], "left").select("doc", "t", "k", "names")

    def hash_(batches):
        release()
        bits = shared.value if shared is not None else None
        for batch in batches:
            for part in pieces(batch, "t"):
                data, offsets = flat_bytes(part.column("t"))
                h, _, _, first = hashed_words(data, offsets, False)
                p, text, symbol, some = speakers(h, first, size, rounds)
                if bits is not None:
                    ok = marked(bits, symbol)
                else:
                    ok, at = np.zeros(len(p), bool), np.searchsorted(text, np.arange(part.num_rows + 1))
                    for i in range(part.num_rows):
                        held = part.column(3)[i].values
                        if held is not None and len(held):
                            ok[at[i] : at[i + 1]] = np.isin(symbol[at[i] : at[i + 1]], held.to_numpy().view(np.uint64))
                ok |= ~some
                p, text = p[ok], text[ok]
                if len(p):
                    ids, keys = (part.column(c).to_numpy(zero_copy_only=False)[text] for c in (0, 2))
                    yield pa.RecordBatch.from_arrays([pa.array(windows(h, size)[p].view(np.int64)), pa.array(ids), pa.array(keys), pa.array((p - first[text]).astype(np.int32))], ["h", "doc", "k", "p"])

    found = scratch.put(texts.mapInArrow(hash_, "h bigint, doc bigint, k bigint, p int"), "windows")
    scratch.settle()
    least = found.groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("h", "lo")
    least = scratch.put(least, "least")
    scratch.settle()
    later = found.join(least, "h").where("doc > lo").groupBy("doc", "k").agg(F.array_sort(F.collect_set("p")).alias("starts"))
    starts = scratch.put(later, "starts")
    scratch.drop("windows", "least", "twice")
    scratch.settle()
    return own_text(facts.drop("names")), starts, scratch


def covered(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of n words the windows at these starts cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + size, n), -1)
    return np.cumsum(edge[:-1]) > 0


def removed(documents: DataFrame, size: int = 50, rounds: int = 4, texts: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept_text): what is left without repeats of documents with smaller ids.

    Words covered by a window of ``size`` words that also starts in a document with a smaller id
    are removed; the rest is joined by one space. Windows are judged on the input. ``kept_text`` is
    null where nothing is removed, and everywhere without ``texts``. Null and empty texts have no words; rows without an id lose
    nothing and nothing is removed on their account. A row for each row of ``documents``; rows that
    repeat an id are judged each by its own text, and never lose words on each other's account.
    """
    facts, starts, _ = repeats(documents, size, rounds, id_col, text_col)

    def cut(batches):
        release()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                gone, left, digests = [], [], []
                for t, s in zip(part.column(1), part.column(2)):
                    words = t.as_py().split()
                    s = s.values.to_numpy()
                    out = covered(len(words), s[s < len(words)], size)
                    kept = b" ".join([w for w, x in zip(words, out.tolist()) if not x])
                    gone.append(int(out.sum()))
                    left.append(kept if texts else None)
                    digests.append(hashlib.sha256(kept).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), pa.array(gone, pa.int64()), pa.array(left, pa.binary()).cast(pa.string()), pa.array(digests)], ["doc", "k", "gone", "kept_text", "sha"])

    docs = documents.select(F.col(id_col).cast("long").alias("doc"), utf8(text_col).alias("t"))
    less = docs.join(starts, "doc").where((F.col("k") == 0) | (F.col("k") == F.xxhash64("t"))).select("doc", "t", "starts", "k").mapInArrow(cut, "doc bigint, k bigint, gone bigint, kept_text string, sha string").dropDuplicates(["doc", "k"])
    return facts.join(less, ["doc", "k"], "left").select(F.col("doc").alias(id_col), "n_words", F.coalesce("gone", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("sha", "whole_sha256").alias("kept_sha256"), "kept_text")
