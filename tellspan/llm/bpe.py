"""Byte-level BPE as a lazily determinised finite-state transducer, and its streaming decoder.

A token sequence is the BPE encoding of its bytes exactly if each neighbouring pair is the BPE
encoding of that pair's bytes (merges inside a pair happen in the same order whatever stands
around it). Valid encodings are thus a language that pairs decide, and of each length of input
there is one. The automaton that reads it is non-deterministic: at any byte a token may begin.
The transducer is its subset construction, built state by state as input asks for it: a state is
the set of tokens still open, a transition names the tokens that end, and the compiled merges
(lives of the symbols at a token's borders) tell which of these follows what stands before it.
Hypotheses differ only from where the longest open token began, so all before that which they
share is settled: no more is held back than the longest vocabulary entry reaches. Short pieces of
many texts are read together, a byte of each at a time, with the steps and the pairs in arrays.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import resident, small_batches, utf8

#: Unicode White_Space, as the pattern's \s has it.
_WS = r"\t-\r \x85\xa0  -     　"
_LATIN = "A-Za-zÀ-ÖØ-öø-ʯ"
#: No match of the pattern crosses the border of such a chunk, so chunks can be looked up whole.
_UNSPACED = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Nor, with the public pattern, of these: Latin letters that a chunk begins with end it before any other character of ASCII.
_CHUNK = re.compile(f" ?(?:[{_LATIN}]++(?:[^\\x00-\\x7f{_WS}][^{_WS}]*+)?|[^{_WS}]++)|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: The public pattern. Chunks of Latin letters, with a space before them or not, are matched whole by it.
_PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD = re.compile(f" ?[{_LATIN}]+").fullmatch


_PENDING = 256  # bytes after which tokens that all hypotheses share are emitted
_SHORT = 64  # characters up to which a chunk or a word is remembered
_TOGETHER = 1 << 20  # characters of texts whose new words are encoded together
_MANY = 1 << 18  # chunks of a text that are looked up together
_LANES = 1 << 15  # pieces that take their steps together


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Lookup:
    """Keys from 0 on to numbers of 32 bits from 0 on, many at a time: open addressing in two arrays, half full at most."""

    def __init__(self, bits: int = 12):
        self.bits, self.used = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        at = self._slots(keys)
        held = self.keys[at]
        same = held == keys
        out = np.where(same, self.values[at], np.int32(-1))
        rest = np.flatnonzero(~same & (held >= 0))
        at = at[rest]
        while len(rest):
            at = at + 1 & len(self.keys) - 1
            held = self.keys[at]
            same = held == keys[rest]
            out[rest[same]] = self.values[at[same]]
            on = ~same & (held >= 0)
            rest, at = rest[on], at[on]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys must be distinct and not held."""
        self.used += len(keys)
        if 2 * self.used > len(self.keys):
            old = self.keys >= 0
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            self.__init__(max(self.bits, int(2 * len(keys)).bit_length()))
            self.used = len(keys)
        at = self._slots(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of keys that meet in a slot, one stays
            mine = self.keys[at] == keys
            self.values[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], at[~mine] + 1 & len(self.keys) - 1


def _extended(array: np.ndarray, used: int, rows: list) -> np.ndarray:
    """``array`` with ``rows`` after its first ``used`` ones, made twice as long where they don't fit."""
    if used + len(rows) > len(array):
        array = np.concatenate([array, np.zeros((max(len(array), len(rows)), *array.shape[1:]), array.dtype)])
    if rows:
        array[used : used + len(rows)] = rows
    return array


class Transducer:
    """Encodes the bytes of one pre-token, or of many together. ``most`` bounds the pairs remembered; states are at most the vocabulary's prefixes."""

    def __init__(self, ranks: dict[bytes, int], most: int = 300_000):
        self.ranks, self.most = ranks, most
        self.bytes_of = {i: t for t, i in ranks.items()}
        self._size = {i: len(t) for t, i in ranks.items()}
        prefixes = {t[:k] for t in ranks for k in range(1, len(t))}
        #: Token and whether longer entries begin so, of all that an entry can begin with: 2 * token + (0 or 1).
        self._known = {p: 2 * ranks.get(p, -1) + 1 for p in prefixes} | {t: 2 * i for t, i in ranks.items() if t not in prefixes}
        self._names, self._ids = [b""], {b"": 0}
        self._go: dict[int, tuple[int, tuple[tuple[int, int], ...], int]] = {}  # by state << 8 | byte
        self._pair: dict[int, bool] = {}
        self._split: dict[int, tuple[bytes, ...]] = {}
        self._spines: dict[tuple[int, bool], tuple | None] = {}
        #: The same steps and pairs in arrays: rows of (state, last token, first end, after the last end), ends as (length, token).
        self._step_of, self._pair_of = Lookup(), Lookup()
        self._steps, self._ends, self._n_ends = np.zeros((256, 4), np.int32), np.zeros((256, 2), np.int32), 0
        self._lengths = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        self._lengths[list(self._size)] = list(self._size.values())
        #: Every entry ranks after some pair of entries that it consists of, so merges run in the order of ranks.
        self.proper = all(len(t) == 1 or any(ranks.get(t[:k], i) < i and ranks.get(t[k:], i) < i for k in range(1, len(t))) for t, i in ranks.items())

    def _merge(self, text: bytes, until: int = 1) -> list[bytes]:
        """The merges by definition: lowest rank first, leftmost first, until so many parts are left."""
        parts = [text[i : i + 1] for i in range(len(text))]
        get = self.ranks.get
        while len(parts) > until:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _spine(self, token: int, right: bool) -> tuple[tuple[int, float], ...] | None:
        """Symbols that border the token's right (or left) end while it is built, last first, each with the
        rank of the merge that ends it; None where merges by definition never build the token."""
        key = (token, right)
        if key not in self._spines:
            text, out, death = self.bytes_of[token], [], float("inf")
            while True:
                rank = self.ranks[text]
                out.append((rank, death))
                if len(text) == 1:
                    break
                halves = self._split.get(rank)
                if halves is None:
                    halves = self._split[rank] = tuple(self._merge(text, 2))
                if len(halves) != 2:
                    out = None
                    break
                text, death = halves[right], rank
            self._spines[key] = out and tuple(out)
        return self._spines[key]

    def _follows(self, a: int, b: int) -> bool:
        """Whether a, b is the encoding of its own bytes. a < 0: whether b alone is."""
        key = a << 32 | b
        ok = self._pair.get(key)
        if ok is None:
            if len(self._pair) > self.most:
                self._pair.clear()
            ok = self._pair[key] = self._decide(a, b)
        return ok

    def _decide(self, a: int, b: int) -> bool:
        if a < 0:
            return self._merge(self.bytes_of[b]) == [self.bytes_of[b]]
        if not self.proper:
            return self._merge(self.bytes_of[a] + self.bytes_of[b]) == [self.bytes_of[a], self.bytes_of[b]]
        lefts, rights = self._spine(a, True), self._spine(b, False)
        if lefts is None or rights is None:
            return False
        # Merges run in the order of their ranks, so two symbols meet at the border if their lives overlap; they
        # merge if their rank comes before either's end (at equal ranks, the leftmost merge goes first).
        for x, x_end in lefts:
            for y, y_end in rights:
                if x < y_end and y < x_end:
                    r = self.ranks.get(self.bytes_of[x] + self.bytes_of[y])
                    if r is not None and r < x_end and r <= y_end:
                        return False
        return True

    def _build(self, at: int, byte: int) -> tuple[int, tuple[tuple[int, int], ...], int]:
        """One step of the subset construction: where the tokens still open after this byte leave the machine,
        (length, token) of those that end here, longest first, and the last of these, which needs no test:
        one of them does end the encoding.

        Open tokens are all suffixes of the input that begin some entry. The longest determines the others, so it
        names the subset.
        """
        text = self._names[at] + bytes((byte,))
        known, ends, onward = self._known.get, [], b""
        for k in range(len(text)):
            code = known(text[k:])
            if code is not None:
                if code >> 1 >= 0:
                    ends.append((len(text) - k, code >> 1))
                if code & 1 and not onward:
                    onward = text[k:]
        if not ends:
            raise ValueError(f"no entry ends with the byte {byte}")
        state = self._ids.get(onward)
        if state is None:
            state = self._ids[onward] = len(self._names)
            self._names.append(onward)
        go = self._go[at << 8 | byte] = (state, tuple(ends[:-1]), ends[-1][1])
        return go

    def _back(self, tokens: list[int], at: int) -> list[int]:
        """The encoding of the first ``at`` bytes held, last token first."""
        out, size = [], self._size
        while at > 0:
            out.append(tokens[at])
            at -= size[tokens[at]]
        return out

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        done: list[int] = []
        limit = _PENDING
        tokens = [-1]  # for each length, the last token of that many bytes' encoding
        at, machine, pairs = 0, self._go.get, self._pair.get
        for byte in piece:
            at, ends, last = machine(at << 8 | byte) or self._build(at, byte)
            for size, token in ends:
                ok = pairs(tokens[-size] << 32 | token)
                if ok or ok is None and self._follows(tokens[-size], token):
                    last = token
                    break
            tokens.append(last)
            if len(tokens) > limit:
                tokens = self._flush(tokens, len(self._names[at]), done)
                limit = len(tokens) + _PENDING
        done.extend(reversed(self._back(tokens, len(tokens) - 1)))
        return done

    def _step_rows(self, keys: np.ndarray) -> np.ndarray:
        """Numbers in ``_steps`` of state << 8 | byte."""
        found = self._step_of.get(keys)
        if (found < 0).any():
            new, used, steps, ends = np.unique(keys[found < 0]), self._step_of.used, [], []
            for key in new.tolist():
                to, some, last = self._go.get(key) or self._build(key >> 8, key & 255)
                lo = self._n_ends + len(ends)
                steps.append((to, last, lo, lo + len(some)))
                ends.extend(some)
            self._steps, self._ends = _extended(self._steps, used, steps), _extended(self._ends, self._n_ends, ends)
            self._n_ends += len(ends)
            self._step_of.put(new, np.arange(used, used + len(new), dtype=np.int32))
            found = self._step_of.get(keys)
        return found

    def _follow_rows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_follows`` of each pair."""
        keys = a.astype(np.int64) + 1 << 32 | b
        ok = self._pair_of.get(keys)
        unknown = np.flatnonzero(ok < 0)
        if len(unknown):
            new, which = np.unique(keys[unknown], return_inverse=True)
            decided = np.array([self._decide((key >> 32) - 1, key & 0xFFFFFFFF) for key in new.tolist()], np.int32)
            ok[unknown] = decided[which]
            if self._pair_of.used > self.most:
                self._pair_of = Lookup()
            else:
                self._pair_of.put(new, decided)
        return ok > 0

    def encode_many(self, pieces: list[bytes]) -> list[bytes]:
        """The encoding of each piece, as little-endian 32-bit integers: ``encode``, with a step of all pieces at a time.

        Nothing is emitted before a piece ends, so pieces should be short."""
        out: list[bytes] = []
        for lo in range(0, len(pieces), _LANES):
            out.extend(self._encode_lanes(pieces[lo : lo + _LANES]))
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = struct.pack("<I", whole)
        return out

    def _encode_lanes(self, pieces: list[bytes]) -> Iterator[bytes]:
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        order = np.argsort(-sizes, kind="stable")  # those that still run stand in front
        starts, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
        data = np.frombuffer(b"".join(pieces), np.uint8)
        tokens = np.full((int(sizes[0]) + 1, n), -1, np.int32)  # as in encode, a column for each piece
        flat, state = tokens.reshape(-1), np.zeros(n, np.int64)
        for k in range(int(sizes[0])):
            m = int(np.searchsorted(-sizes, -k))
            numbers = self._step_rows(state[:m] << 8 | data[starts[:m] + k])
            steps = self._steps[numbers]
            state[:m] = steps[:, 0]
            last = tokens[k + 1, :m]
            last[:] = steps[:, 1]
            rows = np.flatnonzero(steps[:, 3] > steps[:, 2])
            at, until = steps[rows, 2], steps[rows, 3]
            while len(rows):
                ends = self._ends[at]
                ok = self._follow_rows(flat[(k + 1 - ends[:, 0].astype(np.int64)) * n + rows], ends[:, 1])
                last[rows[ok]] = ends[ok, 1]
                at = at + 1
                on = ~ok & (at < until)
                rows, at, until = rows[on], at[on], until[on]
        back, counts, rows, at = [], np.zeros(n, np.int64), np.flatnonzero(sizes), sizes[sizes > 0]
        while len(rows):
            ids = flat[at * n + rows]
            back.append((rows, ids))
            counts[rows] += 1
            at = at - self._lengths[ids]
            rows, at = rows[at > 0], at[at > 0]
        ends = np.cumsum(counts)
        encoded = np.empty(int(ends[-1]), "<u4")
        for i, (rows, ids) in enumerate(back):
            encoded[ends[rows] - 1 - i] = ids
        whole, bounds = encoded.tobytes(), np.empty((n, 2), np.int64)
        bounds[order, 0], bounds[order, 1] = 4 * (ends - counts), 4 * ends
        return (whole[lo:hi] for lo, hi in bounds.tolist())

    def _flush(self, tokens: list[int], opened: int, done: list[int]) -> list[int]:
        """Emit what all hypotheses share: those that begin where a token still open began, or later."""
        end = len(tokens) - 1
        shared = None
        for start in range(max(0, end - opened), end + 1):
            cuts, at = set(), start
            while at > 0:
                cuts.add(at)
                at -= self._size[tokens[at]]
            shared = cuts if shared is None else shared & cuts
        cut = max(shared, default=0)
        if not cut:
            return tokens
        done.extend(reversed(self._back(tokens, cut)))
        return tokens[cut:]


class Utf8Stream:
    """An incremental UTF-8 state machine over chunks cut anywhere.

    The state is the bytes of a character begun and not ended. Whole characters of a chunk are
    decoded at once; the machine itself walks only over a chunk's last bytes. Ill-formed
    sequences become U+FFFD.
    """

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def _open(tail: bytes) -> int:
        """How many of the last bytes begin a character that the chunk does not end."""
        for back in range(1, min(3, len(tail)) + 1):
            b = tail[-back]
            if b & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 1
            if need <= back:
                return 0
            if back > 1:  # the second byte's range decides whether this can still become a character
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(b, (0x80, 0xBF))
                if not low <= tail[len(tail) - back + 1] <= high:
                    return 0
            return back
        return 0

    def feed(self, chunk: bytes) -> str:
        data = self.held + chunk
        n = self._open(data[-3:])
        self.held = data[len(data) - n :] if n else b""
        return (data[: len(data) - n] if n else data).decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Codec(dict):
    """Whole texts to ids and back. As a mapping: a chunk of text to its ids as little-endian 32-bit integers.

    ``most`` bounds the chunks and words remembered, and as many that were used before them; long ones are not. Those
    that are looked up together (``_TOGETHER``, ``_MANY``) are held until then, even if they are more.
    """

    def __init__(self, path: str, pattern: str, most: int = 150_000):
        super().__init__()
        ranks = load_ranks(path)
        self.most, self.machine = most, Transducer(ranks)
        self.older: dict[str, bytes] = {}
        self.find = regex.compile(pattern).findall
        #: Whether the pattern takes words whole, and matches each of its matches whole where it stands alone.
        self.whole = pattern == _PLAIN
        self.chunks = (_CHUNK if self.whole else _UNSPACED).findall
        table = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            table[i] = t
        self.token = table.__getitem__

    def _piece(self, piece: str) -> bytes:
        ids = self.machine.encode(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, chunk: str) -> bytes:
        out = self.older.get(chunk)
        if out is None:
            pieces = (chunk,) if self.whole and _WORD(chunk) else self.find(chunk)
            if len(pieces) > 1 and self.whole:
                out = b"".join(map(self.__getitem__, pieces))
            else:
                out = b"".join(map(self._piece, pieces))
        if len(chunk) <= _SHORT:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[chunk] = out
        return out

    def _learn(self, chunks: set[str]) -> None:
        """Remember the short ones of these chunks; their pieces that are new are encoded together."""
        new = [c for c in chunks if c not in self and len(c) <= _SHORT]
        if len(self) + len(new) > self.most:
            self.older = dict(self)
            self.clear()
            new = [c for c in chunks if len(c) <= _SHORT]
        known = list(map(self.older.get, new))
        self.update((c, out) for c, out in zip(new, known) if out is not None)
        new = [c for c, out in zip(new, known) if out is None]
        pieces = dict.fromkeys(filter(_WORD, new))
        others = [c for c in new if c not in pieces]
        parts = list(map(self.find, others))
        pieces.update(dict.fromkeys(p for part in parts for p in part if p not in self))
        self.update(zip(pieces, self.machine.encode_many([p.encode() for p in pieces])))
        self.update([(c, b"".join(map(self.__getitem__, part))) for c, part in zip(others, parts) if len(part) > 1])

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.chunks(text)))

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """``encode`` of each text, in order. New words are met by about a million characters of texts at a time."""
        held: list[str] = []
        size = 0
        for text in texts:
            if held and size + len(text) > _TOGETHER:
                yield from self._encode_held(held)
                held, size = [], 0
            held.append(text)
            size += len(text)
        yield from self._encode_held(held)

    def _encode_held(self, texts: list[str]) -> Iterator[bytes]:
        found = list(map(self.chunks, texts))
        if self.whole:
            self._learn(set().union(*(chunks[:_MANY] for chunks in found)))
        for chunks in found:
            out = [b"".join(map(self.__getitem__, chunks[:_MANY]))]
            for lo in range(_MANY, len(chunks), _MANY):
                part = chunks[lo : lo + _MANY]
                if self.whole:
                    self._learn(set(part))
                out.append(b"".join(map(self.__getitem__, part)))
            yield b"".join(out)

    def decode(self, ids: np.ndarray, step: int = 8192):
        """The text in parts, as it would be read from a stream of ids."""
        stream = Utf8Stream()
        for lo in range(0, len(ids), step):
            yield stream.feed(b"".join(map(self.token, ids[lo : lo + step].tolist())))
        yield stream.close()


def codec(path: str, pattern: str) -> Codec:
    """One codec for each Python worker, so that what it has learnt serves later tasks."""

    def make():
        out = Codec(path, pattern)
        gc.freeze()  # its tables hold no cycles
        gc.set_threshold(200_000, 50, 100)
        return out

    return resident(("codec", path, pattern), make)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids): the tokens of each whole text as ``array<int>``.

    Null and empty texts have no tokens. One row out for each row in, repeated or null ids
    included; other columns are not read. No shuffle: rows are independent.
    """

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in own.encode_all(t.decode() for t in part.column(1).to_pylist())]
                sizes = np.array([len(x) for x in ids], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), values)], [id_col, "n_tokens", "ids"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), utf8(text_col).alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids array<int>")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of what they decode to.

    Both directions in one pass, so ids never leave the worker. Rules for nulls and repeats as in
    ``encode_documents``; an empty text has the digests of no bytes.
    """

    def run(batches):
        own = codec(path, pattern)
        sha = hashlib.sha256
        for batch in batches:
            counts, first, second = [], [], []
            for ids in own.encode_all(t.as_py().decode() for t in batch.column(1)):
                counts.append(len(ids) // 4)
                first.append(sha(ids).hexdigest())
                digest = sha()
                for part in own.decode(np.frombuffer(ids, "<u4")):
                    digest.update(part.encode())
                second.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), utf8(text_col).alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
