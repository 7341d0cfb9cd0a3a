"""Secrets in texts: three fixed patterns, and strings that a tokenizer's vocabulary can't compress.

Prose and code spend four or more characters on a token; keys and passwords drawn at random spend
about two, whatever their alphabet. A run of key characters with few characters per token is
reported unless its shape is that of a digest or an identifier, which look random and are public.
Words of rare languages come near that ratio, so runs without digits have a stricter one.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import resident, small_batches, utf8

KINDS = ("assign", "access", "hex", "random")
#: Fixed patterns of the base kinds; the least length is of group 2 for assign, else of the match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/=_-]{16,}")
#: Shapes of digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512) and of identifiers.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
IDENTIFIER = re.compile(
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"  # UUID
    r"|[0-9A-Fa-f]{2}([-_][0-9A-Fa-f]{2})+"  # hardware address
    r"|\d{4}-\d\d-\d\d[T_-]?[\dTZ_-]*"  # date, time
    r"|[\d=+/_-]+"  # number
    r"|[A-Z]{2,5}[-_]?\d{4,}[-_\d]*"  # ticket, catalogue number
)
_NO_LETTER = re.compile(r"[^A-Za-z]+")
_HEX_ANY = re.compile(r"[0-9a-f]+|[0-9A-F]+")


class Scanner:
    """``max_ratio``: characters per token from which a run counts as readable; ``letters_ratio``: the same for runs without digits."""

    def __init__(self, vocabulary: str, pattern: str, max_ratio: float = 2.3, letters_ratio: float = 2.0):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encode = tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.max_ratio, self.letters_ratio = max_ratio, min(max_ratio, letters_ratio)

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the fixed patterns, in order."""
        out = []
        low = text.lower()
        if "passw" in low or "token" in low or "secret" in low or "api" in low:
            out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        if "AKIA" in text:
            out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        out.sort()
        return out

    def opaque(self, run: str) -> bool:
        """Whether a run of key characters is random: no known shape, few characters per token.

        Without digits, short words between separators don't count as a run.
        """
        if IDENTIFIER.fullmatch(run) or len(run) in DIGEST_LENGTHS and _HEX_ANY.fullmatch(run):
            return False
        if any(map(str.isdigit, run)):
            return len(run) < self.max_ratio * len(self.encode(run))
        return max(map(len, _NO_LETTER.split(run))) >= 8 and len(run) < self.letters_ratio * len(self.encode(run))

    def scan(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """The base spans, and all spans: added ones never overlap base ones."""
        base = self.base(text)
        added = []
        for m in CANDIDATE.finditer(text):
            a, b = m.span()
            if self.opaque(m[0]) and not any(s < b and a < e for s, _, e in base):
                added.append((a, 3, b))
        return base, sorted(base + added) if added else base


def _scanner(*key) -> Scanner:
    return resident(("scanner", *key), lambda: Scanner(*key))


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_documents(docs: DataFrame, vocabulary: str, pattern: str, max_ratio: float = 2.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_random, base_sha256, spans), a row for each row of ``docs``.

    Null and empty texts have no spans and the digest of no bytes. Offsets are code points, ends
    exclusive. No shuffle; other columns are not read.
    """

    def run(batches):
        scanner = _scanner(vocabulary, pattern, max_ratio)
        for batch in batches:
            counts, digests, spans = [[], [], [], []], [], []
            for t in batch.column(1):
                base, every = scanner.scan(t.as_py().decode())
                for k in range(4):
                    counts[k].append(sum(1 for _, kind, _ in every if kind == k))
                digests.append(hashlib.sha256(_written(base).encode()).hexdigest())
                spans.append(_written(every))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names)

    small_batches(docs.sparkSession)
    names = [id_col, "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"]
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), utf8(text_col).alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base_sha256 string, spans string")


def redact(docs: DataFrame, vocabulary: str, pattern: str, mark: str = "[secret]", max_ratio: float = 2.3, text_col: str = "text") -> DataFrame:
    """``docs`` with every span found replaced by ``mark``; overlapping spans become one mark. Nulls stay null."""

    def run(batches):
        scanner = _scanner(vocabulary, pattern, max_ratio)
        for batch in batches:
            out = []
            for t in batch.column(at):
                text = t.as_py()
                if text is None:
                    out.append(None)
                    continue
                done, parts = 0, []
                for s, _, e in scanner.scan(text)[1]:
                    if s >= done:
                        parts += [text[done:s], mark]
                    done = max(done, e)
                out.append("".join([*parts, text[done:]]) if parts else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    clean = docs.withColumn(text_col, F.make_valid_utf8(F.col(text_col)))
    return clean.mapInArrow(run, docs.schema)
