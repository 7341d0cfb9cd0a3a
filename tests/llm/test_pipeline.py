"""The pipeline on a small corpus, against its stages by definition."""

import random

import numpy as np
import public_tokenizers as P

import corpus_pipeline
from tellspan.llm import bpe, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_keep_what_they_should(spark, tmp_path):
    rnd = random.Random(8)
    words = [f"plain{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    texts = {}
    for i in range(160):
        w = [rnd.choice(words) for _ in range(60)]
        if i % 4 == 1:
            w[rnd.randrange(60)] = "idiot"
        texts[i] = w
    for i in range(160, 170):
        texts[i] = list(texts[(i - 160) * 4])  # copies of clean documents, one word changed in half of them
        if i % 2:
            texts[i][30] = "changed"
    texts[170] = [*texts[0][:20], "password=hunter2hunter2", *[rnd.choice(words) for _ in range(40)]]
    rows = [(i, " ".join(w), "en", f"s{i % 3}", 1) for i, w in texts.items()] + [(171, None, None, None, None), (172, "", "en", "s1", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int("idiot" in w)) for i, w in texts.items() if i < 160]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    out = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, out, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"out{k}"))
        out = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k == 0:
            assert {r["doc_id"] for r in out.collect()} == {i for i, w in texts.items() if "idiot" not in w} | {171, 172}

    def sim(a, b):
        x, y = ({tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in (texts[a], texts[b]))
        return 100 * len(x & y) >= 80 * len(x | y)

    clean = [i for i, w in texts.items() if "idiot" not in w]
    first = [i for k, i in enumerate(clean) if not any(sim(i, j) for j in clean[:k])]
    got = {r["doc_id"]: r for r in out.collect()}
    assert set(got) == set(first) | {171, 172} and len(first) < len(clean)
    own = bpe.codec(P.path(queries.VOCABULARY), P.PATTERN)
    for i in first:
        text = " ".join(texts[i]).replace("password=hunter2hunter2", "[secret]")
        assert "".join(own.decode(np.array(got[i]["ids"], np.uint32))) == text and got[i]["n_tokens"] == len(got[i]["ids"])
    assert got[171]["ids"] == got[172]["ids"] == []
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(got)
