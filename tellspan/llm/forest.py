"""Near-duplicate vectors by a forest of random-projection trees.

A tree cuts the vectors along random projections, again and again, where few of them lie near the
cut; those near it go to both sides. A node whose vectors lie too close together for any cut stays
whole, however large. Near vectors share a leaf of some tree almost surely, and only leaves are
compared, exactly and in blocks. Trees are fitted on a bounded sample and place every vector.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix, release
from .components import components

_QUANTILES = np.linspace(0.1, 0.9, 17)  # where a node may be cut
_DIRECTIONS = 8  # projections tried for a node
_DENSE = 0.5  # share of a node near the best cut from which it stays whole
_FEWEST = 16  # sample rows that a cut is judged by


class Tree:
    """Normals and cuts of the inner nodes, node 0 at the root; ``left`` is -1 at leaves."""

    def __init__(self, sample: np.ndarray, leaf_rows: float, spill: float, least: float, seed: int):
        """``leaf_rows``: rows of the sample that make a leaf."""
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        # a link's ends differ by about so much along a normal of length one
        near = math.sqrt(max(0.0, 2 - 2 * least) / dim)
        normals, low, high, left, right = [], [], [], [], []
        todo = [(np.arange(len(sample)), -1, False)]
        while todo:
            rows, parent, second = todo.pop()
            i = len(left)
            if parent >= 0:
                (right if second else left)[parent] = i
            normals.append(np.zeros(dim, np.float32))
            low.append(0.0), high.append(0.0), left.append(-1), right.append(-1)
            if len(rows) <= max(leaf_rows, _FEWEST):
                continue
            best = _DENSE
            for _ in range(_DIRECTIONS):
                normal = rng.standard_normal(dim).astype(np.float32)
                normal /= np.linalg.norm(normal)
                x = sample[rows] @ normal
                order = np.sort(x)
                cuts = np.quantile(order, _QUANTILES)
                inside = (np.searchsorted(order, cuts + near, "right") - np.searchsorted(order, cuts - near)) / len(x)
                cost = inside / (4 * _QUANTILES * (1 - _QUANTILES))
                k = int(np.argmin(cost))
                if cost[k] < best and (x <= cuts[k]).any() and (x > cuts[k]).any():
                    best, q, cut, own, values = cost[k], _QUANTILES[k], cuts[k], normal, x
            if best < _DENSE:
                normals[i] = own
                low[i], high[i] = np.quantile(values, [max(0.0, q - spill / 2), min(1.0, q + spill / 2)])
                todo += [(rows[values <= cut], i, False), (rows[values > cut], i, True)]
        self.normals, self.low, self.high = np.array(normals), np.array(low, np.float32), np.array(high, np.float32)
        self.left, self.right = np.array(left), np.array(right)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf), a row as often as leaves hold it."""
        row, node, done = np.arange(len(x)), np.zeros(len(x), np.int64), []
        while len(row):
            leaf = self.left[node] < 0
            done.append((row[leaf], node[leaf]))
            row, node = row[~leaf], node[~leaf]
            p = np.einsum("ij,ij->i", x[row], self.normals[node])
            left, right = p <= self.high[node], p >= self.low[node]
            left |= ~right
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([self.left[node[left]], self.right[node[right]]])
        return (np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])) if done else (row, node)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _pairs(x: np.ndarray, y: np.ndarray, least: float, step: int = 256):
    """(i, j) of the rows of ``x`` and ``y``, both of length one, with cosine of at least ``least`` in double precision, block by block."""
    quick, other = x.astype(np.float32), y.astype(np.float32).T
    for lo in range(0, len(x), step):
        c = quick[lo : lo + step] @ other
        i, j = np.nonzero(c >= least - 1e-4)
        ok = c[i, j] >= least + 1e-4
        close = np.flatnonzero(~ok)  # only these need all digits
        for at in range(0, len(close), 1 << 18):
            some = close[at : at + (1 << 18)]
            ok[some] = np.einsum("ij,ij->i", x[i[some] + lo], y[j[some]]) >= least
        yield i[ok] + lo, j[ok]


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Let ends of the links (a, b) have the same label, that of the first row of their component."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label[:] = label[label]


def _earlier(codes: pa.ListArray, own: int) -> np.ndarray:
    """A bitmap [rows, words] of the leaves before ``own`` that hold each row."""
    flat, row = codes.flatten().to_numpy(), np.repeat(np.arange(len(codes)), np.diff(codes.offsets.to_numpy()))
    row, flat = row[flat < own], flat[flat < own]
    names, at = np.unique(flat, return_inverse=True)
    bits = np.zeros((len(codes), max(1, -(-len(names) // 64))), np.uint64)
    np.bitwise_or.at(bits, (row, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
    return bits


def _met(bits: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.zeros(len(i), bool)
    for w in range(bits.shape[1]):
        out |= (bits[i, w] & bits[j, w]) != 0
    return out


def count_links(unit: np.ndarray, n: np.ndarray, bits: np.ndarray, first: np.ndarray, second: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of each row, label) of a block: pairs of ``first`` and ``second``, or of ``first`` alone if they are the same.

    A pair that shares an earlier leaf counts there and not here. Labels are equal within components.
    """
    m, label = np.zeros(len(unit), np.int64), np.arange(len(unit))
    alone = first is second
    # the earlier leaf that holds most rows: pairs within it met there and aren't compared
    held = np.zeros(len(unit), bool)
    if len(unit):
        sums = [np.unpackbits(np.ascontiguousarray(bits[:, w : w + 1]).view(np.uint8), axis=1, bitorder="little").sum(0) for w in range(bits.shape[1])]
        w = int(np.argmax([s.max() for s in sums]))
        held = bits[:, w] >> np.uint64(int(np.argmax(sums[w]))) & np.uint64(1) == 1
    a, c = first[~held[first]], first[held[first]]
    for x, y in ((a, second), (c, second[~held[second]])) if not alone else ((a, a), (a, c)):
        for i, j in _pairs(unit[x], unit[y], least):
            i, j = x[i], y[j]
            if alone and y is a:
                i, j = i[i < j], j[i < j]
            fresh = ~_met(bits, i, j)
            i, j = i[fresh], j[fresh]
            np.add.at(m, i, n[j])
            np.add.at(m, j, n[i])
            _join(label, i, j)
    return m, label


def near_vectors(vectors: DataFrame, least: float = 0.95, trees: int = 5, leaf_rows: int = 4096, spill: float = 0.1, sample: int = 20_000, seed: int = 7, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept), a row for each row of ``vectors``.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without an
    id, link with nothing. Equal vectors are one class, compared once; a row counts all others of
    its class and of linked classes. Repeated rows count once. Vectors of different lengths don't
    link. ``sample`` bounds the rows that trees are fitted on and that come to the driver.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "forest")
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    good = rows.where(F.col("id").isNotNull() & F.coalesce(finite, F.lit(False))).withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(1), "v")})
    member = scratch.put(good.select("id", "h", "g").distinct(), "member")
    classes = scratch.put(member.groupBy("h", "g").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "classes")
    reps = scratch.put(good.join(classes.select(F.col("rep").alias("id"), "h", "g", "n"), ["id", "h", "g"]).dropDuplicates(["id", "h", "g"]).select("id", "n", "v", F.size("v").alias("dim")), "reps")
    total = reps.count()
    first = reps.orderBy(F.xxhash64("id"), "id").limit(sample).select("dim", "v").collect()
    by_dim: dict[int, list] = {}
    for r in first:
        by_dim.setdefault(r["dim"], []).append(r["v"])
    part = leaf_rows * len(first) / max(1, total)
    forest = {d: [Tree(_units(np.array(x)).astype(np.float32), part, spill, least, seed + t) for t in range(trees)] for d, x in by_dim.items()}
    shared = spark.sparkContext.broadcast(forest)

    def leaves(own, d, column):
        """(row, leaf) of all trees, by row and tree: leaves of tree t are numbered from t << 40."""
        x = _units(_matrix(column)).astype(np.float32)
        # a length so rare that the sample has none: one leaf
        got = [own[d][t].place(x) if d in own else (np.arange(len(x)), np.zeros(len(x), np.int64)) for t in range(trees)]
        row, leaf = np.concatenate([g[0] for g in got]), np.concatenate([g[1] + (t << 40) for t, g in enumerate(got)])
        order = np.lexsort([leaf, row])
        return row[order], leaf[order]

    def measure(batches):
        release()
        for batch in batches:
            dims = np.asarray(batch.column(1))
            for d in np.unique(dims):
                leaf, c = np.unique(leaves(shared.value, d, batch.filter(pa.array(dims == d)).column(0))[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), d, np.int32)), pa.array(leaf), pa.array(c)], ["dim", "leaf", "c"])

    block = 2 * leaf_rows
    large = reps.select("v", "dim").mapInArrow(measure, "dim int, leaf bigint, c bigint").groupBy("dim", "leaf").agg(F.sum("c").alias("c")).where(F.col("c") > block).collect()
    salts = spark.sparkContext.broadcast({(r["dim"], r["leaf"]): -(-r["c"] // block) for r in large})

    def place(batches):
        release()
        for batch in batches:
            dims = np.asarray(batch.column(3))
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                row, leaf = leaves(shared.value, d, part.column(2))
                codes = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)), pa.array(leaf))
                deal = mix(part.column(0).to_numpy().view(np.uint64))
                names, at = np.unique(leaf, return_inverse=True)
                of = np.array([salts.value.get((int(d), int(x)), 1) for x in names], np.int64)[at]
                salt = (deal[row] % of.astype(np.uint64)).astype(np.int64)
                # once for each salt of the leaf, so that any two salts meet in one block
                k = np.repeat(np.arange(len(row)), of)
                other = np.arange(len(k)) - np.repeat(np.cumsum(of) - of, of)
                for lo in range(0, len(k), 20_000):
                    r, o = k[lo : lo + 20_000], other[lo : lo + 20_000]
                    at = pa.array(row[r])
                    low, high = np.minimum(salt[r], o), np.maximum(salt[r], o)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), d, np.int32)), pa.array(leaf[r]), pa.array(low), pa.array(high), pa.array(salt[r]), part.column(0).take(at), part.column(1).take(at), part.column(2).take(at), codes.take(at)], ["dim", "leaf", "low", "high", "salt", "id", "n", "v", "codes"])

    placed = reps.select("id", "n", "v", "dim").mapInArrow(place, "dim int, leaf bigint, low bigint, high bigint, salt bigint, id bigint, n bigint, v array<double>, codes array<bigint>")

    def compare(key, table):
        table = table.combine_chunks()
        column = lambda c: table.column(c).combine_chunks()
        _, leaf, low, high = (k.as_py() for k in key)
        ids, salt = column("id").to_numpy(), column("salt").to_numpy()
        one = np.flatnonzero(salt == low)
        m, label = count_links(_units(_matrix(column("v"))), column("n").to_numpy(), _earlier(column("codes"), leaf), one, one if low == high else np.flatnonzero(salt == high), least)
        some = np.flatnonzero(m)
        return pa.table({"a": ids[some], "b": ids[label[some]], "m": m[some]})

    # of each block, the links a row has there, and one way to the rows that it is linked with
    links = scratch.put(placed.groupBy("dim", "leaf", "low", "high").applyInArrow(compare, "a bigint, b bigint, m bigint"), "links")
    linked = links.groupBy("a").agg(F.sum("m").alias("m"))
    whole = components(links.select("a", "b"), scratch)
    found = classes.join(linked, F.col("rep") == F.col("a"), "left").join(whole, F.col("rep") == F.col("id"), "left")
    found = found.select("h", "g", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    marks = scratch.put(member.join(found, ["h", "g"]).select("id", "h", "g", "n_links", "component_id"), "marks")
    keyed = rows.withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(1), "v")}).select("id", "h", "g")
    return keyed.join(marks, ["id", "h", "g"], "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").cast("long").alias("component_id"),
        (F.col("id").isNull() | (F.coalesce("component_id", "id") == F.col("id"))).alias("kept"),
    )
