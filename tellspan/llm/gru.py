"""Document log-likelihood under a gated recurrent language model, in numpy.

The output softmax is factored: first the class of the next word, then the word in its class.
Frequent words have a softmax over their class; all other words belong to a class by their first
letters, in which they share out the probability by their counts in the whole training corpus,
a word never seen having the share of one more word. The state is carried from window to window,
so a text is scored as a whole, however long.

Training is local: the training documents are dealt into parts by their hashes, every part runs
truncated backpropagation from common weights, and the weights are averaged, round after round.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, flat_bytes, hashed_words, pieces, release, utf8

SIDE, TAIL = 32, 32  # least number of classes of frequent words, and of words in each; classes of other words
HEAD = SIDE * SIDE
END = HEAD + TAIL  # id of a text's end and of its start, in the least vocabulary; ids below HEAD are words, then classes of other words
_BIG = 150_000  # counts that go to every task; the others are joined
_ROWS = 256  # whose scores are held at once
_AHEAD = 512  # inputs that are prepared at once
_PIECE = 1 << 18  # bytes of texts whose words are hashed at once
_BLOCK = 1 << 14  # parameters that Adam takes at once, which stay in a core's own cache
_END_HASH = 1  # stands for the end among word hashes


def _first_letters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    a = data[starts].astype(np.int64)
    b = data[np.minimum(starts + 1, ends - 1)].astype(np.int64)
    a += 32 * ((a >= 65) & (a <= 90))
    b += 32 * ((b >= 65) & (b <= 90))
    return (a * 7919 + b * 104_729) % 65_537 % TAIL


def _equal(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, heads): places in rising order of values, and where in it each value begins."""
    order = np.argsort(h)
    sorted_h = h[order]
    return order, np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), sorted_h[1:] != sorted_h[:-1]]))


def _added(h: np.ndarray, k: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same words by rising hash, each once, with its counts added up."""
    order, heads = _equal(h)
    at = order[heads]
    return h[at], k[at], np.add.reduceat(c[order], heads) if len(h) else c


def count_words(docs: DataFrame, window: int = 1 << 21) -> DataFrame:
    """(h, k, c): of each word its hash, class by letters, and count; ends are words of class -1. ``window``: words that are held before they are counted together.

    Tasks send their counts packed, a row for each of as many ranges of hashes as there are shuffle partitions; hashes are evenly spread."""
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        release()
        held, kinds, counts, size, n_docs = [], [], [], 0, 0

        def flush():
            given = (np.concatenate([np.array([x], kind), *xs]) for x, kind, xs in ((_END_HASH, np.uint64, held), (-1, np.int32, kinds), (n_docs, np.int64, counts)))
            columns = _added(*given)
            edges = np.searchsorted((columns[0] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1))
            packed = [pa.Array.from_buffers(pa.large_binary(), ranges, [None, pa.py_buffer((edges * x.itemsize).astype(np.int64)), pa.py_buffer(x)]) for x in columns]
            filled = pa.array(np.diff(edges) > 0)
            return pa.RecordBatch.from_arrays([pa.array(np.arange(ranges, dtype=np.int32)), *(x.cast(pa.binary()) for x in packed)], ["part", "h", "k", "c"]).filter(filled)

        for batch in batches:
            for part in pieces(batch, "t", _PIECE):
                data, offsets = flat_bytes(part.column("t"))
                h, s, e, _ = hashed_words(data, offsets, True)
                order, heads = _equal(h)
                at = order[heads]
                held.append(h[at])
                kinds.append(_first_letters(data, s[at], e[at]).astype(np.int32))
                counts.append(np.diff(np.append(heads, len(h))))
                size += len(at)
                n_docs += part.num_rows
                if size > window:
                    yield flush()
                    held, kinds, counts, size, n_docs = [], [], [], 0, 0
        if n_docs:
            yield flush()

    def merge(table):
        h, k, c = _added(*(flat_bytes(table.column(name))[0].view(kind) for name, kind in (("h", np.uint64), ("k", np.int32), ("c", np.int64))))
        return pa.table({"h": pa.array(h.view(np.int64)), "k": pa.array(k), "c": pa.array(c)})

    packed = docs.select("t").mapInArrow(run, "part int, h binary, k binary, c binary")
    return packed.groupBy("part").applyInArrow(merge, "h bigint, k int, c bigint")


def side_for(tokens: int) -> int:
    """Classes of frequent words, and words in each: the fourth root of the corpus, so that its square root is known by word."""
    return max(SIDE, int(tokens**0.25))


class Vocabulary:
    """Ids of frequent words, and what the corpus counts say about all others.

    ``words`` and ``counts``: the words whose counts go to every task, by falling count; the first ones have ids of their own.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, tail_total: np.ndarray, tail_kinds: np.ndarray, tokens: int, distinct: int, ends: int):
        self.tokens, self.distinct, self.ends = tokens, distinct, ends
        self.side = side_for(tokens)
        self.size = self.side**2
        self.end = self.size + TAIL
        order = np.argsort(words)
        self.known = len(words)
        # one more entry stands for all words that aren't here
        self.words = np.append(words[order], np.uint64(2**64 - 1))
        self.ids = np.append(np.where(order < self.size, order, -1), -1)
        self.logs = np.append(np.log10(counts[order] + 1.0), 0.0)
        self.tail_log = np.log10(tail_total + tail_kinds + 1.0)
        # hashes are evenly spread, so their first bits say nearly where they stand
        bits = max(1, len(words).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.heads = np.searchsorted(self.words[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each word, ``known`` if it isn't here."""
        at = self.heads[(h >> self.shift).astype(np.int64)]
        late = np.flatnonzero(self.words[at] < h)
        while len(late):
            at[late] += 1
            late = late[self.words[at[late]] < h[late]]
        at[self.words[at] != h] = self.known
        return at


def class_of(ids: np.ndarray, side: int = SIDE) -> np.ndarray:
    return np.where(ids < side * side, ids // side, ids - side * side + side)


def _order(x: np.ndarray, most: int) -> np.ndarray:
    """Places of ``x``, whose values are ``most`` at most, in rising order; numbers of 16 bits are sorted by their digits."""
    return np.argsort(x.astype(np.uint16) if most < 1 << 16 else x, kind="stable")


class Gru:
    """The network. Parameters are float32 arrays in ``p``."""

    def __init__(self, hidden: int = 24, embed: int = 16, seed: int = 3, side: int = SIDE):
        rng = np.random.default_rng(seed)
        draw = lambda *s, scale=0.1: (rng.standard_normal(s) * scale).astype(np.float32)
        self.hidden, self.side, self.end = hidden, side, side * side + TAIL
        classes = side + TAIL + 1  # the last holds the end of the text
        self.p = {
            "E": draw(self.end + 1, embed, scale=0.3),
            "W": draw(embed, 3 * hidden, scale=embed**-0.5),
            "U": draw(hidden, 3 * hidden, scale=hidden**-0.5),
            "b": np.zeros(3 * hidden, np.float32),
            "C": draw(hidden, classes),
            "c": np.zeros(classes, np.float32),
            "H": draw(side, hidden, side),
            "d": np.zeros((side, side), np.float32),
        }

    def _gated(self, weights: np.ndarray) -> np.ndarray:
        """``weights``, transposed, whose rows for the gates change their signs, as ``step`` takes them."""
        out = np.ascontiguousarray(weights.T)
        np.negative(out[: 2 * self.hidden], out=out[: 2 * self.hidden])
        return out

    def step(self, g: np.ndarray, h: np.ndarray, across: np.ndarray):
        """(new state, r, z, n, a): one step for input projections ``g``, which is used up. Lanes are columns here, so that gates are whole
        blocks; in ``g`` and ``across``, the states' weights, gates have the other sign (see ``_gated``)."""
        k = self.hidden
        a = across @ h
        rz = g[: 2 * k]
        rz += a[: 2 * k]
        np.exp(rz, out=rz)
        rz += 1
        np.reciprocal(rz, out=rz)
        r, z = rz[:k], rz[k:]
        n = g[2 * k :]
        n += r * a[2 * k :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, r, z, n, a[2 * k :]

    def _output(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of classes, and of words in each, with a last row of biases."""
        return np.concatenate([self.p["C"], self.p["c"][None]]), np.concatenate([self.p["H"], self.p["d"][:, None]], 1)

    def _exponentials(self, x: np.ndarray, most: float | None, total: np.ndarray) -> None:
        """Scores to their exponentials, in place, and to ``total`` the sums of rows. ``most``: bound of scores, if they need one."""
        if most is not None:
            np.minimum(x, most, out=x)
        np.exp(x, out=x)
        np.matmul(x, np.ones(x.shape[1], x.dtype), out=total)

    def _by_class(self, kinds: np.ndarray):
        """(order, blocks): places of frequent words by class, and blocks (from, to, spans) of them, spans being (class, from, to).

        Most classes have few words at a time, so a block holds words of many."""
        order = _order(kinds, self.side + TAIL)
        own = kinds[order]
        edges = np.searchsorted(own, np.arange(self.side + 1)).tolist()
        order = order[: edges[-1]]
        blocks = []
        for lo in range(0, len(order), _ROWS):
            hi = min(lo + _ROWS, len(order))
            blocks.append((lo, hi, [(c, max(edges[c], lo), min(edges[c + 1], hi)) for c in range(own[lo], own[hi - 1] + 1) if edges[c] < edges[c + 1]]))
        return order, blocks

    def log_likelihood(self, h: np.ndarray, ids: np.ndarray, most: float | None = None) -> np.ndarray:
        """Natural log probability of the next ids' classes, and of frequent words in theirs. ``h`` may end with a column of ones."""
        classes, words = self._output()
        if h.shape[1] == self.hidden:
            h = np.concatenate([h, np.ones((len(h), 1), h.dtype)], 1)
        states, kinds = h, class_of(ids, self.side)
        sums, out = np.empty(len(ids), h.dtype), np.empty(len(ids), h.dtype)
        wide, cells = np.empty((_ROWS, classes.shape[1]), h.dtype), np.arange(len(ids)) % _ROWS * classes.shape[1] + kinds
        for lo in range(0, len(ids), _ROWS):
            part = slice(lo, min(lo + _ROWS, len(ids)))
            x = wide[: part.stop - lo]
            np.matmul(h[part], classes, out=x)
            self._exponentials(x, most, sums[part])
            np.take(x.reshape(-1), cells[part], out=out[part])
        out /= sums
        np.log(out + 1e-30, out=out)
        order, blocks = self._by_class(kinds)
        h, own_sums, got = h[order], np.empty(len(order), h.dtype), np.empty(len(order), h.dtype)
        wide, cells = np.empty((_ROWS, self.side), h.dtype), np.arange(len(order)) % _ROWS * self.side + ids[order] % self.side
        for lo, hi, spans in blocks:
            x = wide[: hi - lo]
            for c, a, b in spans:
                np.matmul(h[a:b], words[c], out=x[a - lo : b - lo])
            self._exponentials(x, most, own_sums[lo:hi])
            np.take(x.reshape(-1), cells[lo:hi], out=got[lo:hi])
        if most is None and not np.isfinite(sums.sum(dtype=np.float64) + own_sums.sum(dtype=np.float64)):  # states are within (-1, 1), so scores stay small as a rule
            return self.log_likelihood(states, ids, 60)
        got /= own_sums
        out[order] += np.log(got + 1e-30)
        return out

    def gradients(self, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray, most: float | None = None):
        """(gradients, last state, loss) of a window [T, B], the state before it taken as given. ``most``: bound of scores, if they need one."""
        p, k = self.p, self.hidden
        T, B = inputs.shape
        kind = p["C"].dtype
        embed = p["E"].shape[1]
        words_in = np.ones((T, B, embed + 1), kind)
        words_in[:, :, :embed] = p["E"][inputs]
        new_text = [np.flatnonzero(x) for x in inputs == self.end]
        kept, states = [], np.ones((T, B, k + 1), kind)
        across, into = self._gated(p["U"]), self._gated(np.concatenate([p["W"], p["b"][None]]))
        h = np.array(h.T, order="C")
        for t in range(T):
            h[:, new_text[t]] = 0
            new, r, z, n, a = self.step(into @ words_in[t].T, h, across)
            kept.append((h, r, z, n, a))
            states[t, :, :k] = new.T
            h = new
        H = states.reshape(T * B, k + 1)
        ids = targets.ravel()
        kinds = class_of(ids, self.side)
        scale = kind.type(1 / len(ids))
        classes, words = self._output()
        # gradients of scores are (x - total at the target) * scale / total; the factor goes to the narrow side of each product
        sums, hits, top, dH = np.empty(len(ids), kind), np.empty(len(ids), kind), np.zeros_like(classes), np.empty((len(ids), k), kind)
        wide, back = np.empty((_ROWS, classes.shape[1]), kind), np.ascontiguousarray(p["C"].T)
        cells = np.arange(len(ids)) % _ROWS * classes.shape[1] + kinds
        for lo in range(0, len(ids), _ROWS):
            part = slice(lo, min(lo + _ROWS, len(ids)))
            rows, at, total, x = H[part], cells[part], sums[part], wide[: part.stop - lo]
            np.matmul(rows, classes, out=x)
            self._exponentials(x, most, total)
            flat = x.reshape(-1)
            hits[part] = hit = flat[at]
            flat[at] = hit - total
            top += (rows * (scale / total)[:, None]).T @ x
            np.matmul(x, back, out=dH[part])
        dH *= (scale / sums)[:, None]
        grad = {"C": top[:k], "c": top[k]}
        order, blocks = self._by_class(kinds)
        own_h, down, inner = H[order], np.empty((len(order), k), kind), np.zeros_like(words)
        own_sums, own_hits = np.empty(len(order), kind), np.empty(len(order), kind)
        wide, back = np.empty((_ROWS, self.side), kind), p["H"].transpose(0, 2, 1)
        cells = np.arange(len(order)) % _ROWS * self.side + ids[order] % self.side
        for lo, hi, spans in blocks:
            rows, at, total, x = own_h[lo:hi], cells[lo:hi], own_sums[lo:hi], wide[: hi - lo]
            for c, a, b in spans:
                np.matmul(own_h[a:b], words[c], out=x[a - lo : b - lo])
            self._exponentials(x, most, total)
            flat = x.reshape(-1)
            own_hits[lo:hi] = hit = flat[at]
            flat[at] = hit - total
            rows = (rows * (scale / total)[:, None]).T
            for c, a, b in spans:
                y = x[a - lo : b - lo]
                inner[c] += rows[:, a - lo : b - lo] @ y
                np.matmul(y, back[c], out=down[a:b])
        if most is None and not np.isfinite(sums.sum(dtype=np.float64) + own_sums.sum(dtype=np.float64)):  # states are within (-1, 1), so scores stay small as a rule
            return self.gradients(inputs, targets, kept[0][0].T, 60)
        loss = (np.log(sums) - np.log(hits + 1e-30)).sum() + (np.log(own_sums) - np.log(own_hits + 1e-30)).sum()
        grad["H"], grad["d"] = inner[:, :k], inner[:, k]
        down *= (scale / own_sums)[:, None]
        dH[order] += down
        dH = np.ascontiguousarray(dH.reshape(T, B, k).transpose(0, 2, 1))
        dh = np.zeros((k, B), kind)
        # gradients of the products of states for n, of both for r and z, of the products of inputs for n
        gates, down, turn = np.empty((4 * k, B), kind), np.empty((T, B, embed), kind), np.empty((k, B), kind)
        through, reads, dn = gates[: 3 * k], gates[k:], gates[3 * k :]
        dU, dW, U, W = np.zeros((3 * k, k), kind), np.zeros_like(into), np.roll(p["U"], k, 1), np.ascontiguousarray(p["W"].T)
        for t in range(T - 1, -1, -1):
            before, r, z, n, a = kept[t]
            dh += dH[t]
            rest = np.subtract(1, z)
            rest *= dh
            np.multiply(n, n, out=turn)
            np.subtract(1, turn, out=turn)
            np.multiply(rest, turn, out=dn)
            np.multiply(dn, r, out=gates[:k])
            np.subtract(1, r, out=turn)
            turn *= a
            np.multiply(turn, gates[:k], out=gates[k : 2 * k])
            np.subtract(before, n, out=turn)
            turn *= z
            np.multiply(turn, rest, out=gates[2 * k : 3 * k])
            dh *= z
            dh += U @ through
            dh[:, new_text[t]] = 0
            dU += through @ before.T
            dW += reads @ words_in[t]
            np.matmul(reads.T, W, out=down[t])
        down = down.reshape(T * B, -1)
        order = _order(inputs.ravel(), self.end)
        read = inputs.ravel()[order]
        heads = np.flatnonzero(np.concatenate([[True], read[1:] != read[:-1]]))
        dE = np.zeros_like(p["E"])
        dE[read[heads]] = np.add.reduceat(down[order], heads)
        grad |= {"U": np.roll(dU, -k, 0).T, "E": dE, "W": dW[:, :embed].T, "b": dW[:, embed]}
        return grad, h.T, float(loss) / len(ids)

    def fit(self, ids: np.ndarray, lanes: int = 512, length: int = 4096, window: int = 16, rate: float = 0.01) -> None:
        """One pass over a flat row of ids, cut into lanes, fewer if they would be shorter than ``length``. Adam, with gradients clipped."""
        if not len(ids):
            return
        lanes = max(1, min(lanes, len(ids) // length))
        n = -(-len(ids) // lanes)
        ids = np.resize(ids, n * lanes)  # the last lane is filled up from the start
        grid = ids[: n * lanes].reshape(lanes, n).T
        inputs = np.concatenate([np.full((1, lanes), self.end, grid.dtype), grid[:-1]])
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        h = np.zeros((lanes, self.hidden), np.float32)
        for i, lo in enumerate(range(0, n, window), 1):
            grad, h, _ = self.gradients(inputs[lo : lo + window], grid[lo : lo + window], h)
            # a group's weights stand apart from their biases, so those of words in classes aren't in one block
            flat = [g.reshape(len(g), -1) for g in grad.values()]
            norm = np.sqrt(sum(float(np.einsum("ij,ij->", g, g)) for g in flat))
            step = rate * np.sqrt(1 - 0.999**i) / (1 - 0.9**i) / max(1.0, i / 100) ** 0.5
            clip = min(1.0, 1.0 / (norm + 1e-9))
            # sums of gradients are kept 10 times, those of squares 1000 times as large as their means
            step, least = np.float32(step * 0.1 / 0.001**0.5), np.float32(1e-8 / 0.001**0.5)
            for k, whole in grad.items():
                if clip < 1:
                    whole *= np.float32(clip)
                rows = max(1, _BLOCK * len(whole) // whole.size)
                for a in range(0, len(whole), rows):
                    part = slice(a, a + rows)
                    g, first, second, own = whole[part], m[k][part], v[k][part], self.p[k][part]
                    first *= np.float32(0.9)
                    first += g
                    g = g * g
                    second *= np.float32(0.999)
                    second += g
                    np.sqrt(second, out=g)
                    g += least
                    np.divide(first, g, out=g)
                    g *= step
                    own -= g

    def score(self, ids: np.ndarray, ends: np.ndarray, lanes: int = 512, window: int = 32) -> np.ndarray:
        """Sum of natural logs for each text; ``ends``: where each one's ids (its end included) stop.

        Texts are dealt to lanes, longest first, and follow each other there; a new text starts from the zero state.
        States of ``window`` full steps are compared with their words at once.
        """
        if not len(ends):
            return np.zeros(0)
        sizes = np.diff(ends, prepend=0)
        most, lanes = window * lanes, max(1, min(lanes, len(sizes)))
        load = [(0, i) for i in range(lanes)]
        rows: list[list[int]] = [[] for _ in range(lanes)]
        for d in np.argsort(-sizes, kind="stable").tolist():
            n, i = load[0]
            rows[i].append(d)
            heapq.heapreplace(load, (n + int(sizes[d]), i))
        load.sort(key=lambda x: -x[0])  # longest lanes first
        texts = np.concatenate([rows[i] for _, i in load])
        long = np.array([n for n, _ in load])
        # ids lane by lane: those of a step stand as far from the first ones of their lanes, and before each one stands what is read for it
        heads, stops = np.cumsum(long) - long, np.cumsum(sizes[texts])
        ids = ids[np.arange(len(ids)) + np.repeat((ends - sizes)[texts] - (stops - sizes[texts]), sizes[texts])]
        last = np.concatenate([[self.end], ids[:-1]])
        steps = int(long[0])
        across, into = self._gated(self.p["U"]), self._gated(np.concatenate([self.p["W"], self.p["b"][None]]))
        words_in = np.concatenate([self.p["E"], np.ones((self.end + 1, 1), np.float32)], 1)
        out = np.zeros(len(ids), np.float32)
        h = np.zeros((self.hidden, lanes), np.float32)
        states, wanted, held = np.ones((most + lanes, self.hidden + 1), np.float32), np.empty(most + lanes, np.int64), 0

        def settle():  # where few lanes are left, a step gives few rows: they are kept until there are many
            at = wanted[:held]
            out[at] = self.log_likelihood(states[:held], ids[at])

        counts = (lanes - np.searchsorted(long[::-1], np.arange(steps), "right")).tolist()  # lanes that are live at each step: the first ones
        lo = 0
        while lo < steps:  # what is read is known before, so some steps are prepared at once, many where few lanes are left
            live = counts[lo]
            hi = min(steps, lo + max(1, _AHEAD // live))
            place = np.arange(lo, hi)[:, None] + heads[:live]
            before = last[np.minimum(place, len(ids) - 1).ravel()]  # lanes that end meanwhile are left out below
            going = (before != self.end).reshape(place.shape)
            kept = going.all(1).tolist()
            read = into @ words_in[before].T
            for step in range(lo, hi):
                n, at = counts[step], (step - lo) * live
                if n < h.shape[1]:
                    h = h[:, :n]
                if not kept[step - lo]:
                    h = h * going[step - lo, :n]
                h = self.step(read[:, at : at + n], h, across)[0]
                states[held : held + n, : self.hidden], wanted[held : held + n] = h.T, place[step - lo, :n]
                held += n
                if held >= most:
                    settle()
                    held = 0
            lo = hi
        if held:
            settle()
        sums = np.empty(len(ends))
        sums[texts] = np.add.reduceat(out.astype(np.float64), stops - sizes[texts])
        return sums


def numbered(docs: DataFrame, vocabulary, doc_type: str) -> DataFrame:
    """(row, key, doc, held, n, known, base, extra, ids, rare): the rows (key, doc, held, t) as ids with an end, n of them.

    ``base`` sums log10(count + 1) of words whose counts are here, ``known`` counts them, and ``rare`` has the hashes of all others;
    ``extra`` sums the shares of words without an id in their classes. ``row`` names a row once the table is written, as ids may repeat or be null.
    """

    def run(batches):
        release()
        own = vocabulary.value
        kind = np.dtype(np.uint16 if own.end < 1 << 16 else np.uint32)
        end_log = np.log10(own.ends + 1.0)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in pieces(batch, "t", _PIECE):
                rows = part.num_rows
                data, offsets = flat_bytes(part.column("t"))
                h, s, e, first = hashed_words(data, offsets, True)
                at = own.find(h)
                known, logs, words = at < own.known, own.logs[at], own.ids[at]
                tail = np.flatnonzero(words < 0)
                kinds = _first_letters(data, s[tail], e[tail])
                words[tail] = kinds + own.size
                extra = np.zeros(len(h))
                extra[tail] = logs[tail] - own.tail_log[kinds]
                ids = np.full(len(words) + rows, own.end, kind)
                ids[np.arange(len(words)) + np.repeat(np.arange(rows), np.diff(first))] = words
                edges = (first + np.arange(rows + 1)) * kind.itemsize
                add = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[first])
                lists = np.concatenate([[0], np.cumsum(~known)])[first]
                columns = {
                    "row": pa.array(row + np.arange(rows)),
                    "key": part.column("key"),
                    "doc": part.column("doc"),
                    "held": part.column("held"),
                    "n": pa.array(np.diff(first) + 1),
                    "known": pa.array(add(known.astype(np.int64)) + int(own.ends > 0)),
                    "base": pa.array(add(logs).astype(np.float64) + end_log),
                    "extra": pa.array(add(extra).astype(np.float64)),
                    "ids": pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(edges.astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())]),
                    "rare": pa.ListArray.from_arrays(pa.array(lists.astype(np.int32)), pa.array(h[~known].view(np.int64))),
                }
                row += rows
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select("key", "doc", "held", "t").mapInArrow(run, f"row bigint, key bigint, doc {doc_type}, held boolean, n bigint, known bigint, base double, extra double, ids binary, rare array<bigint>")


def _summed(trained: DataFrame, into: int) -> DataFrame:
    """(part, n, w): sums of weights, a row for each of ``into`` tasks, each of which holds one sum at a time."""

    def run(batches):
        total, out, first = 0, None, 0
        for batch in batches:
            for part, n, w in zip(*(batch.column(i).to_pylist() for i in range(3))):
                p = pickle.loads(w)
                if out is None:
                    out, first = {k: v.astype(np.float64) for k, v in p.items()}, part
                else:
                    for k in p:
                        out[k] += p[k]
                total += n
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([total], pa.int64()), pa.array([pickle.dumps(out)], pa.binary())], ["part", "n", "w"])

    dealt = trained.repartition(1) if into == 1 else trained.repartition(into, F.pmod("part", F.lit(into)))
    return dealt.sortWithinPartitions("part").mapInArrow(run, "part int, n bigint, w binary")


def train(rows: DataFrame, vocabulary, rounds: int = 2, merge: int = 16, part_tokens: int = 1 << 21, scratch: Scratch | None = None) -> Gru:
    """Weights learnt from all ``rows`` (key, ids) in one pass: each row belongs to one part of one round by its key, a hash. A part learns from its
    rows in the order of their keys, and at the end of a round weights are averaged by tokens. Parts hold about ``part_tokens``
    tokens, so their number grows with the corpus, and a small corpus is one part that all rounds read; nothing depends on how the
    rows lie. ``merge``: tasks that add weights up before one does; the driver gets one sum."""
    side = vocabulary.value.side
    model = Gru(side=side)
    spark = rows.sparkSession
    parts = round(vocabulary.value.tokens / part_tokens / rounds)
    keyed = rows.select("key", "ids", F.pmod("key", F.lit(max(1, parts * rounds))).cast("int").alias("part"))
    kind = np.uint16 if vocabulary.value.end < 1 << 16 else np.uint32
    for r in range(rounds):
        given = keyed.where(F.col("part") % rounds == r) if parts else keyed
        shared = spark.sparkContext.broadcast(model.p)

        def learn(table):
            order = np.argsort(table.column("key").to_numpy(), kind="stable")
            data, at = flat_bytes(table.column("ids"))
            ids = np.concatenate([data[at[i] : at[i + 1]] for i in order]).view(kind).astype(np.int64)
            own = Gru(side=side)
            own.p = {k: v.copy() for k, v in shared.value.items()}
            own.fit(ids)
            weights = {k: v * np.float32(len(ids)) for k, v in own.p.items()}
            return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "n": pa.array([len(ids)], pa.int64()), "w": pa.array([pickle.dumps(weights)], pa.binary())})

        trained = given.groupBy("part").applyInArrow(learn, "part int, n bigint, w binary")
        got = _summed(_summed(trained, merge) if parts > merge else trained, 1).collect()
        if scratch is not None:
            scratch.settle()
        if not got:
            continue
        model.p = {k: (v / got[0]["n"]).astype(np.float32) for k, v in pickle.loads(got[0]["w"]).items()}
    return model


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the most frequent words, ``most`` at most, by falling count, then hash.

    A histogram of counts says from which count on words are few enough; only those are collected.
    """
    words = counts.where("k >= 0")
    step = F.floor(16 * F.log2(F.col("c").cast("double"))).cast("int")
    held, least = 0, None
    for r in words.groupBy(step.alias("s")).agg(F.count("*").alias("n")).orderBy(F.desc("s")).collect():
        if held + r["n"] > most:
            break
        held, least = held + r["n"], r["s"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    got = words.where(step >= least).select("h", "c").toArrow()
    h, c = (got.column(i).to_numpy().astype(np.int64) for i in range(2))
    order = np.lexsort([h, -c])
    return h[order], c[order]


def score_documents(documents: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of ``documents``.

    ``held_out``: condition on the row; all other rows are counted and trained on, whether their ids repeat or are null. Null texts
    count as empty and consist of an end. Scores are log10 probabilities: ``base_score`` under add-one unigrams, ``score`` under
    the model; rows with equal texts have equal scores but for rounding, however the rows lie. An empty table gives no rows.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "gru")
    docs = documents.select(F.col(id_col).alias("doc"), held_out.alias("held"), utf8(text_col).alias("t")).withColumn("key", F.xxhash64("doc", "t"))
    counts = scratch.put(count_words(docs.where("not held")), "counts")
    scratch.settle()
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    size = side_for(int(total["n"] or 0)) ** 2
    top_h, top_c = _frequent(counts, max(_BIG, 2 * size))
    in_head = spark.createDataFrame(pa.table({"h": pa.array(top_h[:size])}))
    tails = counts.where("k >= 0").join(F.broadcast(in_head), "h", "left_anti").groupBy("k").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    tail_total, tail_kinds = np.zeros(TAIL), np.zeros(TAIL)
    for r in tails:
        tail_total[r["k"]], tail_kinds[r["k"]] = r["c"], r["v"]
    ends = counts.where("k < 0").first()
    vocabulary = Vocabulary(top_h.view(np.uint64), top_c, tail_total, tail_kinds, int(total["n"] or 0), int(total["v"]), int(ends["c"]) if ends else 0)
    shared = spark.sparkContext.broadcast(vocabulary)
    kind = documents.schema[id_col].dataType.simpleString()
    part = scratch.put(numbered(docs, shared, kind), "ids")
    scratch.settle()
    model = spark.sparkContext.broadcast(train(part.where("not held"), shared, scratch=scratch).p)

    def run(batches):
        release()
        net = Gru(side=shared.value.side)
        net.p = model.value
        size = 2 if net.end < 1 << 16 else 4
        for batch in batches:
            data, edges = flat_bytes(batch.column("ids"))
            if len(edges) > 1:
                neural = net.score(data.view(f"u{size}").astype(np.int64), edges[1:] // size) / np.log(10)
                yield pa.RecordBatch.from_arrays([*map(batch.column, own), pa.array(neural)], [*own, "neural"])

    own = ["row", "doc", "held", "n", "known", "base", "extra"]
    taken = part.select(*own, "ids")
    scored = scratch.put(taken.mapInArrow(run, f"row bigint, doc {kind}, held boolean, n bigint, known bigint, base double, extra double, neural double"), "scored")
    scratch.settle()
    # counts are hashed, evenly dealt as they are, and words stream past them, so a word that fills a text costs no more than others
    words = part.select("row", F.explode("rare").alias("h"))
    rest = words.join(counts.select("h", "c").hint("shuffle_hash"), "h").groupBy("row").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("more"), F.count("*").alias("seen"))
    out = scored.join(rest, "row", "left")
    n_all, v_all = vocabulary.tokens, vocabulary.distinct
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        F.col("doc").alias(id_col),
        F.col("held").alias("held_out"),
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n") * F.lit(float(np.log10(n_all + v_all + 1.0)))).alias("base_score"),
        (F.col("neural") + F.col("extra") + more).alias("score"),
    )
