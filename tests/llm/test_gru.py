import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tellspan.llm import gru

SCHEMA = "doc_id long, text string, extra int"


def test_gradients_are_those_of_the_loss():
    net = gru.Gru(hidden=5, embed=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    ids = rng.choice([3, 40, 41, 1000, gru.HEAD + 2, gru.END], (7, 3))
    inputs, h = np.concatenate([np.full((1, 3), gru.END), ids[:-1]]), np.zeros((3, 5))
    grad, _, _ = net.gradients(inputs, ids, h)
    for name in net.p:
        flat = net.p[name].ravel()
        for i in np.argsort(-np.abs(grad[name].ravel()))[:3]:
            old, out = flat[i], []
            for d in (1e-3, -1e-3):
                flat[i] = old + d
                out.append(net.gradients(inputs, ids, h)[2])
            flat[i] = old
            assert abs((out[0] - out[1]) / 2e-3 - grad[name].ravel()[i]) < 1e-4


def test_scores_don_t_depend_on_windows_and_add_up_to_one():
    net = gru.Gru()
    rng = np.random.default_rng(1)
    sizes = [1, 90, 3, 40]
    ids = np.concatenate([np.append(rng.integers(0, gru.END, n - 1), gru.END) for n in sizes])
    ends = np.cumsum(sizes)
    whole = net.score(ids, ends, lanes=4, window=200)
    assert np.allclose(whole, net.score(ids, ends, lanes=2, window=7), atol=1e-3)
    h = rng.standard_normal((1, net.hidden)).astype(np.float32) * 0.1
    every = np.arange(gru.END + 1)
    assert abs(np.exp(net.log_likelihood(np.repeat(h, len(every), 0), every)).sum() - 1) < 1e-4


@pytest.mark.parametrize("known", [gru._BIG, 5])
def test_base_scores_by_definition_and_odd_rows(spark, monkeypatch, known):
    """``known``: counts that go to every task; the others are joined, and ids repeat with other texts or are null."""
    monkeypatch.setattr(gru, "_BIG", known)
    monkeypatch.setattr(gru, "SIDE", 2)
    monkeypatch.setattr(gru, "HEAD", 4)
    words = "the cat sat on THE mat É é x".split(" ")
    texts = [" ".join(words[(i * k) % len(words)] for k in range(1, 5 + i % 30)) for i in range(120)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(200, None, 1), (201, "", 1), (202, " \n\t", None), (203, "unseen" * 3000, 1), (None, "the cat", 1), (5, texts[5], 1), (3, "mat mat rare", 1), (None, "x É sat the other", 1)]
    rows = [(i, t, k) for k, (i, t, _) in enumerate(rows)]
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    docs = spark.createDataFrame([(i, t, k) for i, t, k in rows], SCHEMA)
    got = gru.score_documents(docs, held).collect()
    assert len(got) == len(rows)
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    counts = collections.Counter()
    for i, t, _ in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t, _ in rows:
        own = tokens(t)
        want.append((str(i), len(own), sum(counts[w] > 0 for w in own), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), 6)))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == sorted(want)
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in got)


def test_scores_don_t_depend_on_how_rows_lie(spark, monkeypatch):
    from tellspan.llm import common

    rnd = np.random.default_rng(5)
    rows = [(i if i % 9 else None, " ".join(f"w{int(x)}" for x in rnd.zipf(1.5, 30) % 500), 1) for i in range(300)]
    score = lambda n: sorted((str(r["doc_id"]), round(r["score"], 2)) for r in gru.score_documents(spark.createDataFrame(rows, SCHEMA).repartition(n, F.rand(n)), F.lit(False)).collect())
    train = gru.train
    monkeypatch.setattr(gru, "train", lambda *a, **k: train(*a, **k, part_tokens=1500))
    one, eight = score(1), score(8)
    assert [x[0] for x in one] == [x[0] for x in eight] and np.allclose([x[1] for x in one], [x[1] for x in eight], atol=0.05)
    assert common.resident("x", dict) is common.resident("x", dict)
    common.release()


def test_empty_table(spark):
    assert gru.score_documents(spark.createDataFrame([], SCHEMA), F.lit(False)).count() == 0


def test_every_training_row_trains_and_few_rows_do(spark):
    # words follow each other in one way only; rows without an id, or few of them, train all the same
    text = " ".join(["one two three four"] * 40)
    score = lambda rows: {r["doc_id"]: r["score"] for r in gru.score_documents(spark.createDataFrame(rows, SCHEMA).coalesce(1), F.coalesce(F.col("doc_id") == 1, F.lit(False))).collect()}
    for i in (None, *range(2, 6)):
        got = score([(1, text, 1), (i, " ".join([text] * 10), 1)])
        assert got[1] > 160 * -0.5


def test_short_rows_of_ids_train_to_the_last_one():
    for n in (1, 5, 63, 700):
        net = gru.Gru()
        before = {k: v.copy() for k, v in net.p.items()}
        ids = np.full(n, 7)
        ids[-1] = 1001
        net.fit(ids)
        assert (net.p["d"][1001 // 32, 1001 % 32] > before["d"][1001 // 32, 1001 % 32]).all()


def test_the_vocabulary_grows_with_the_corpus():
    assert gru.side_for(0) == gru.side_for(10**6) == gru.SIDE and gru.side_for(10**8) == 100
    net = gru.Gru(side=40)
    h, every = np.zeros((1, net.hidden), np.float32), np.arange(net.end + 1)
    assert net.end == 1632 and abs(np.exp(net.log_likelihood(np.repeat(h, len(every), 0), every)).sum() - 1) < 1e-4


def test_scores_don_t_depend_on_how_far_inputs_are_prepared(monkeypatch):
    net, rng = gru.Gru(), np.random.default_rng(4)
    sizes = [1, 300, 2, 2, 45, 1, 80]
    ids = np.concatenate([np.append(rng.integers(0, gru.END, n - 1), gru.END) for n in sizes])
    got = []
    for ahead, rows in ((1, 1024), (7, 3), (1024, 256)):
        monkeypatch.setattr(gru, "_AHEAD", ahead)
        monkeypatch.setattr(gru, "_ROWS", rows)
        got.append(net.score(ids, np.cumsum(sizes), lanes=3))
    alone = [net.score(ids[e - n : e], np.array([n]))[0] for n, e in zip(sizes, np.cumsum(sizes))]
    assert np.allclose(got, [alone] * 3, atol=1e-3)


def test_words_of_many_classes_share_a_block(monkeypatch):
    net, rng = gru.Gru(), np.random.default_rng(6)
    ids = rng.permutation(np.arange(0, gru.HEAD, 8))[:, None]
    calls, exp = [], np.exp
    monkeypatch.setattr(np, "exp", lambda *a, **k: (calls.append(a[0].shape), exp(*a, **k))[1])
    grad, _, loss = net.gradients(np.full_like(ids, gru.END), ids, np.zeros((1, net.hidden), np.float32))
    # 128 words of 32 classes: each step's gates, then one block of classes and one of words
    assert len(calls) == len(ids) + 2
    calls.clear()
    one = net.step(net._gated(np.concatenate([net.p["W"], net.p["b"][None]])) @ np.append(net.p["E"][gru.END], np.float32(1))[:, None], np.zeros((net.hidden, 1), np.float32), net._gated(net.p["U"]))[0]
    calls.clear()
    got = net.log_likelihood(np.repeat(one.T, len(ids), 0), ids.ravel())
    assert len(calls) == 2 and abs(got.mean() + loss) < 1e-4


def test_one_long_text_among_many_takes_no_table_of_steps_and_lanes():
    import tracemalloc

    net, sizes = gru.Gru(), [20_000] + [2] * 600
    ids = np.concatenate([np.append(np.full(n - 1, 7), gru.END) for n in sizes])
    tracemalloc.start()
    got = net.score(ids, np.cumsum(sizes))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000 * 512 and np.allclose(got[1:], got[1], atol=1e-3)


def test_scores_too_large_for_exponentials_are_bounded():
    net = gru.Gru()
    net.p = {k: v * np.float32(3000) if k in "CH" else v for k, v in net.p.items()}
    ids = np.arange(0, gru.END, 3)[:, None]
    with np.errstate(all="ignore"):
        grad, _, loss = net.gradients(np.full_like(ids, 9), ids, np.full((1, net.hidden), 0.9, np.float32))
        got = net.log_likelihood(np.full((len(ids), net.hidden), 0.9, np.float32), ids.ravel())
    assert np.isfinite(loss) and np.isfinite(got).all() and all(np.isfinite(g).all() for g in grad.values())


def test_counts_are_the_same_however_many_words_are_held(spark):
    texts = [" ".join(f"W{i * k % 37}" for k in range(i % 50)) for i in range(90)] + ["", None, "x " * 500]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], SCHEMA).select(gru.utf8("text").alias("t")).coalesce(2)
    count = lambda n: {r["h"]: (r["k"], r["c"]) for r in gru.count_words(docs, n).collect()}
    got = count(1 << 21)
    assert got == count(3) and len(got) == 39 and got[gru._END_HASH] == (-1, len(texts))
    want = collections.Counter(w for t in texts for w in (t or "").lower().split())
    assert sorted(c for k, c in got.values() if k >= 0) == sorted(want.values())


def test_counts_are_sent_packed_by_ranges_of_hashes(spark, monkeypatch):
    texts = [" ".join(f"w{i * k}" for k in range(40)) for i in range(60)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], SCHEMA).select(gru.utf8("text").alias("t")).repartition(3)
    want = collections.Counter(w for t in texts for w in t.split())
    old, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (1, 7, 1000):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            counts = gru.count_words(docs)
            assert "Aggregate" not in counts._jdf.queryExecution().toString()
            rows = counts.collect()
            assert len(rows) == len({r["h"] for r in rows}) == len(want) + 1 and sum(r["c"] for r in rows) == 60 * 41
            got.append({r["h"]: (r["k"], r["c"]) for r in rows})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got[0] == got[1] == got[2] and got[0][gru._END_HASH] == (-1, 60)


def test_a_rare_word_that_fills_a_text_counts_each_time(spark, monkeypatch):
    monkeypatch.setattr(gru, "_BIG", 1)
    monkeypatch.setattr(gru, "SIDE", 1)
    rows = [(1, "a a a b", 1), (2, "b " * 5000, 1), (3, "c " * 7000 + "never", 1), (4, "c", 1)]
    got = {r["doc_id"]: r for r in gru.score_documents(spark.createDataFrame(rows, SCHEMA), F.col("doc_id") == 3).collect()}
    n, v = 4 + 5000 + 1 + 3, 4
    base = lambda *counts: sum(m * math.log10((c + 1) / (n + v + 1)) for c, m in counts)
    assert got[3]["n_known"] == 7001 and got[2]["n_known"] == 5001 and got[2]["train_tokens"] == n
    assert abs(got[3]["base_score"] - base((1, 7000), (0, 1), (3, 1))) < 1e-6 and abs(got[2]["base_score"] - base((5001, 5000), (3, 1))) < 1e-6
