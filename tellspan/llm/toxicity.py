"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton over folded text.

Folding maps homoglyphs and digits that stand for letters to one form, in texts and lexicon alike,
so ``1d10t`` or a Cyrillic look-alike is found as the word it imitates. The lexicon holds stems
learnt from labelled rows with their log odds; a hit inside an exception phrase doesn't count.
Hits are set against the length of the text, and a logistic curve turns both into a score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hashed_words, mix, release, small_batches, utf8

#: Look-alikes by the letter they imitate.
LOOKALIKES = {
    "a": "4@аα", "b": "8вβ", "c": "сϲ", "e": "3еєε", "g": "9ɡ", "h": "һн", "i": "1!|lіιı", "j": "ј", "k": "кκ", "m": "м",
    "n": "п", "o": "0оοσ", "p": "рρ", "r": "г", "s": "5$ѕ", "t": "7тτ", "u": "υ", "v": "ν", "x": "хχ", "y": "уγ", "z": "2ᴢ",
}
#: Harmless phrases around words that are often insults.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "scum line", "pond scum", "loser bracket", "pathetic fallacy")


def _table() -> dict[int, str]:
    table = {ord(c): letter for letter, others in LOOKALIKES.items() for c in others}
    for code in range(0xFF21, 0xFF3B):  # full-width letters
        for c in (code, code + 32):
            plain = chr((c - 0xFF21) % 32 + 97)
            table[c] = "i" if plain == "l" else plain
    for code in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF):  # invisible
        table[code] = ""
    for c in "\t\n\x0b\f\r.,;:?\"'()[]{}<>*_~#+=/\\-&%":
        table[ord(c)] = " "
    return table


_TABLE = _table()


def fold(text: str) -> str:
    """Lower case, look-alikes as the letters they imitate (i, l and 1 are one letter), punctuation as spaces."""
    return f" {text.lower().translate(_TABLE)} "


@dataclass(frozen=True)
class Lexicon:
    """Folded stems with weights, exception phrases, and the curve (intercept, weight of hits, weight of hits per word)."""

    stems: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    curve: tuple[float, float, float]

    def matcher(self) -> Matcher:
        return Matcher(self)


class Matcher:
    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.curve = lexicon.curve
        self.automaton = ahocorasick.Automaton()
        for stem, weight in lexicon.stems:
            self.automaton.add_word(" " + stem, (len(stem), weight))
        for phrase in lexicon.exceptions:
            words = " " + fold(phrase).strip()
            self.automaton.add_word(words, (len(words), None))
        self.some = len(self.automaton) > 0
        if self.some:
            self.automaton.make_automaton()

    def hits(self, folded: str) -> float:
        """Summed weights of the stems that begin a word, once for each word, outside exception phrases."""
        if not self.some:
            return 0.0
        found: dict[int, float] = {}
        shut = []
        for end, (size, weight) in self.automaton.iter(folded):
            if weight is None:
                shut.append((end - size + 1, end))
            else:
                start = end - size + 1
                found[start] = max(weight, found.get(start, 0.0))
        if shut and found:
            found = {p: w for p, w in found.items() if not any(a <= p <= b for a, b in shut)}
        return math.fsum(found.values())

    def features(self, text: str) -> tuple[float, int]:
        folded = fold(text)
        return self.hits(folded), len(folded.split())

    def score(self, text: str) -> float:
        hits, words = self.features(text)
        return _curve(self.curve, hits, words)


def _curve(curve: tuple[float, float, float], hits: float, words: int) -> float:
    z = curve[0] + curve[1] * math.log1p(hits) + curve[2] * math.log1p(100 * hits / (words + 10))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def training_rows(docs: DataFrame, labels: DataFrame, use: Column, most: int = 5000, clean_most: int = 10000, label: str = "toxic") -> DataFrame:
    """(doc_id, text, y): at most ``most`` toxic and ``clean_most`` clean labelled rows, those with the least hashed id.

    ``use``: condition on doc_id that says which rows labels may be learnt from. An id that has both labels counts as toxic.
    """
    own = labels.where(use & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    order = (F.xxhash64("doc_id"), "doc_id")
    chosen = own.where("y = 1").orderBy(*order).limit(most).unionByName(own.where("y = 0").orderBy(*order).limit(clean_most))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by the two limits


def _copies(batches):
    """(t, y, copy): texts with a mark that copies have in common, near ones mostly: three min-hashes of runs of five folded words."""
    seeds = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7)]
    release()
    for batch in batches:
        marks = []
        for t in batch.column(0).to_pylist():
            words = " ".join(fold(t.decode()).split()).encode()
            h, _, _, _ = hashed_words(np.frombuffer(words, np.uint8), np.array([0, len(words)]), False)
            runs = mix(sum((h[k : max(k, len(h) - 4 + k)] * np.uint64(2 * k + 3) for k in range(1, 5)), h[: max(0, len(h) - 4)].copy())) if len(h) > 4 else h
            marks.append(b"".join(mix(runs ^ s).min().tobytes() if len(runs) else b"" for s in seeds))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.binary())], ["t", "y", "copy"])


def learn(rows: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS, least_odds: float = 3.0, least_gain: float = 30.0, longest: int = 24) -> Lexicon:
    """A lexicon from (text, y) rows; their number bounds what comes to the driver. The order of rows makes no difference.

    A stem is the shortest beginning of three or more letters that sets the classes apart by
    ``least_odds`` (natural log odds) beyond chance (twice the log likelihood gained is at least
    ``least_gain``), carried on for as long as one letter follows it always, or mostly and with higher odds, up to ``longest`` letters.
    Rows of one label that agree in three min-hashes of their five-word runs are copies of one text and count once, so that a text
    copied often doesn't lend its words weight. Neighbours that only clean rows have at a stem become exception phrases. Without rows of both
    classes nothing is learnt, and all scores are low. Null texts count as empty.
    """

    spark = rows.sparkSession

    def words(batches):
        for batch in batches:
            tokens, ys = [], []
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {w[:longest] for w in fold(t.decode()).split()}
                tokens.extend(own)
                ys.extend([y] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(ys, pa.int32())], ["w", "y"])

    rows = rows.select(utf8("text").alias("t"), F.col("y").cast("int").alias("y"))
    single = rows.mapInArrow(_copies, "t binary, y int, copy binary").groupBy("copy", "y").agg(F.min_by("t", F.struct(F.xxhash64("t"), "t")).alias("t"))
    scratch = Scratch(spark, "toxicity")
    source = scratch.put(single.select("t", "y"), "rows")
    totals = {r["y"]: r["n"] for r in source.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    empty = Lexicon((), (), (-3.0, 1.0, 1.0))
    if not pos or not neg:
        scratch.drop()
        return empty
    table = source.mapInArrow(words, "w string, y int").groupBy("w").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    begun = table.select(F.explode(F.expr("transform(sequence(3, greatest(length(w), 3)), k -> substring(w, 1, k))")).alias("s"), "p", "n").groupBy("s").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    apart = F.log((F.col("p") + 0.1) / (pos + 1)) - F.log((F.col("n") + 0.1) / (neg + 1))
    by = {r["s"]: (float(r["p"]), float(r["n"])) for r in begun.where((F.length("s") >= 3) & (F.col("p") >= least_gain / 4) & (apart >= least_odds - 0.1)).collect()}
    follows: dict[str, dict[str, float]] = {}
    for s, c in by.items():
        follows.setdefault(s[:-1], {})[s[-1]] = c[0]
    odds = lambda c: math.log((c[0] + 0.1) / (pos + 1)) - math.log((c[1] + 0.1) / (neg + 1))
    share = pos / (pos + neg)

    def gain(c):
        n = c[0] + c[1]
        return 2 * (c[0] * math.log(c[0] / n / share) + (c[1] * math.log(c[1] / n / (1 - share)) if c[1] else 0.0))

    good = {s for s, c in by.items() if c[0] and odds(c) >= least_odds and gain(c) >= least_gain}
    stems: dict[str, float] = {}
    for s in sorted(good):
        if any(s[:k] in good for k in range(3, len(s))):
            continue
        while True:
            letter, mass = max(follows.get(s, {"": 0.0}).items(), key=lambda x: (x[1], x[0]))
            if mass < 0.98 * by[s][0] and (mass < 0.7 * by[s][0] or odds(by[s + letter]) < odds(by[s]) + 0.5):
                break
            s += letter
        stems[s] = round(odds(by[s]), 3)
    lexicon = Lexicon(tuple(sorted(stems.items())), tuple(exceptions), (0.0, 0.0, 0.0))
    learnt = _phrases(source, lexicon)
    lexicon = Lexicon(lexicon.stems, (*lexicon.exceptions, *learnt), lexicon.curve)

    def features(batches):
        release()
        matcher = lexicon.matcher()
        for batch in batches:
            got = [matcher.features(t.decode()) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64()), batch.column(1)], ["h", "n", "y"])

    pdf = source.mapInArrow(features, "h double, n bigint, y int").toPandas()
    pdf = pdf.sort_values(["h", "n", "y"])
    scratch.drop()
    return Lexicon(lexicon.stems, lexicon.exceptions, _fit(pdf["h"].to_numpy(), pdf["n"].to_numpy(), pdf["y"].to_numpy(float)))


def _phrases(source: DataFrame, lexicon: Lexicon, least: int = 3) -> list[str]:
    """Two-word phrases at a stem that ``least`` clean rows have and no toxic row."""

    def pairs(batches):
        stems = tuple(s for s, _ in lexicon.stems)
        for batch in batches:
            out, ys = [], []
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = fold(t.decode()).split()
                own = {f"{words[j]} {words[j + 1]}" for i, w in enumerate(words) if stems and w.startswith(stems) for j in (i - 1, i) if 0 <= j < len(words) - 1}
                out.extend(own)
                ys.extend([y] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(ys, pa.int32())], ["w", "y"])

    found = source.mapInArrow(pairs, "w string, y int").groupBy("w").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    return [r["w"] for r in found.where((F.col("p") == 0) & (F.col("n") >= least)).orderBy("w").collect()]


def _fit(hits: np.ndarray, words: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float, float]:
    """Logistic regression by Newton steps, with a ridge that keeps separable classes finite."""
    x = np.stack([np.ones(len(y)), np.log1p(hits), np.log1p(100 * hits / (words + 10))], 1)
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - ridge * w * [0, 1, 1]
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-6, ridge, ridge])
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def score_documents(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted), a row for each row of ``docs``.

    Null texts count as empty; empty texts have the score of no hits. No shuffle.
    """

    def run(batches):
        release()
        matcher = lexicon.matcher()
        for batch in batches:
            scores = np.array([matcher.score(t.as_py().decode()) for t in batch.column(1)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], [id_col, "score", "predicted"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), utf8(text_col).alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")


def keep_clean(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, unchanged. Null and empty texts have the score of no hits; repeated rows all count."""

    def run(batches):
        release()
        matcher = lexicon.matcher()
        for batch in batches:
            keep = [matcher.score(t.as_py() or "") < threshold for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    return docs.withColumn(text_col, F.make_valid_utf8(F.col(text_col))).mapInArrow(run, docs.schema)
