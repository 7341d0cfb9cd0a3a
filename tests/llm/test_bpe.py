import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from tellspan.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = bpe.load_ranks(PATH)
    return bpe.codec(PATH, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encodes_as_tiktoken_does(both):
    own, theirs = both
    rnd = random.Random(5)
    alphabet = " \n\t\x1c\x85\xa0 'sldaábñ漢字🙂éàAEITn.,;0123٣_-= ing thé"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(40))) for _ in range(600)]
    texts += ["", " ", "a" * 9000, " " * 700, "ab" * 5000, "naïve café—déjà vu", "can't I'LL we've", "\U0010ffff\x00"]
    for t in texts:
        ids = np.frombuffer(own.encode(t), "<u4")
        assert ids.tolist() == theirs.encode_ordinary(t)
        assert "".join(own.decode(ids, 3)) == t


def test_vocabularies_without_an_order_of_merges():
    ranks = {bytes([i]): i + 10 for i in range(256)} | {b"ab": 3, b"bc": 1, b"abc": 0, b"cd": 2, b"abcd": 5}
    machine = bpe.Transducer(ranks)
    theirs = tiktoken.Encoding("x", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(1)
    for _ in range(400):
        t = "".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 14)))
        assert machine.encode(t.encode()) == theirs.encode_ordinary(t)


def test_utf8_machine_matches_python_on_any_bytes_cut_anywhere():
    rnd = random.Random(2)
    for _ in range(3000):
        data = bytes(rnd.choice([0x41, 0x80, 0xBF, 0xC3, 0xE0, 0xA0, 0xED, 0xF0, 0x90, 0xF4, 0x8F, 0xC0, 0xFF]) for _ in range(rnd.randrange(9)))
        stream, out, i = bpe.Utf8Stream(), "", 0
        while i < len(data):
            j = i + rnd.randrange(1, 4)
            out, i = out + stream.feed(data[i:j]), j
        assert out + stream.close() == data.decode("utf-8", "replace")


def test_rows(spark):
    rows = [(1, "the cat", 9), (2, None, 9), (3, "", None), (None, "x", 1), (1, "the cat", 9), (4, "é" * 50_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = bpe.round_trip(docs, PATH, P.PATTERN).collect()
    assert len(got) == 6
    empty = hashlib.sha256(b"").hexdigest()
    by = {r["doc_id"]: r for r in got}
    assert (by[2]["n_tokens"], by[2]["ids_sha256"], by[2]["decoded_sha256"]) == (0, empty, empty)
    assert by[4]["decoded_sha256"] == hashlib.sha256(("é" * 50_000).encode()).hexdigest()
    ids = {r["doc_id"]: r["ids"] for r in bpe.encode_documents(docs, PATH, P.PATTERN).collect()}
    assert hashlib.sha256(np.array(ids[1], "<u4").tobytes()).hexdigest() == by[1]["ids_sha256"] and ids[3] == []
    assert bpe.round_trip(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_words_in_use_outlive_rare_ones(both):
    _, theirs = both
    own, seen = bpe.Codec(PATH, P.PATTERN, most=50), []
    encode = own.machine.encode
    own.machine.encode = lambda piece: seen.append(piece) or encode(piece)
    rare = [f"q{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(600)]
    for w in rare:
        text = f"{w} étaient, {w} étaient's\r\n  thé %%{w}%%"
        assert np.frombuffer(own.encode(text), "<u4").tolist() == theirs.encode_ordinary(text)
    assert seen.count(" étaient".encode()) == 1 and len(own) + len(own.older) <= 100


def test_new_words_of_many_texts_are_encoded_together(both, monkeypatch):
    _, theirs = both
    own, seen = bpe.Codec(PATH, P.PATTERN, most=400), []
    encode = own.machine.encode
    own.machine.encode = lambda piece: seen.append(piece) or encode(piece)
    rnd = random.Random(6)
    alphabet = " \n\t\x1c\x85\xa0 'sldaábñ漢字🙂éàAEITn.,;0123٣_-= ing thé́д"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(900)]
    texts += ["", " ", "a" * 9000, "can't I'LL we've 'sabc 'd漢", "naïve, café—déjà (vu) abc漢字.", "a漢's b́c x\x1cy"]
    got = list(own.encode_all(texts[:60]))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == list(map(theirs.encode_ordinary, texts[:60])) and not seen
    for together, many, lanes in ((1, 3, 2), (500, 1 << 18, 7), (1 << 20, 50, 1 << 15)):
        monkeypatch.setattr(bpe, "_TOGETHER", together)
        monkeypatch.setattr(bpe, "_MANY", many)
        monkeypatch.setattr(bpe, "_LANES", lanes)
        for t, ids in zip(texts, own.encode_all(iter(texts)), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(t)


def test_pieces_taken_together_are_encoded_as_alone():
    rnd = random.Random(8)
    ranks = {bytes([i]): i + 10 for i in range(256)} | {b"ab": 3, b"bc": 1, b"abc": 0, b"cd": 2, b"abcd": 5}
    for machine in (bpe.Transducer(ranks, most=20), bpe.Transducer(bpe.load_ranks(PATH), most=300)):
        pieces = [bytes(rnd.choice(b"abcd\xc3\xa9") for _ in range(rnd.randrange(30))) for _ in range(500)]
        for part in (pieces, pieces[:1], [b""], []):
            got = [np.frombuffer(x, "<u4").tolist() for x in machine.encode_many(part)]
            assert got == [machine.encode(p) if p else [] for p in part]


def test_lookup_holds_what_meets_in_a_slot():
    table, keys = bpe.Lookup(2), np.random.default_rng(3).permutation(20_000).astype(np.int64) * 65_536
    for lo in range(0, 10_000, 77):
        part = keys[lo : min(lo + 77, 10_000)]
        table.put(part, np.arange(lo, lo + len(part), dtype=np.int32))
    assert table.get(keys).tolist() == [*range(10_000), *[-1] * 10_000] and table.used == 10_000
