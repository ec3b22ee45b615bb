"""The byte network: chunks, gradients by finite differences, held-out accuracy, odd rows."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import quality


@given(st.integers(0, 6000))
@settings(max_examples=100, deadline=None)
def test_chunks_cover_everything(n):
    raw = bytes(i % 251 for i in range(n))
    parts = quality.chunks(raw)
    assert all(len(p) <= quality.CHUNK for p in parts)
    joined = parts[0] + b"".join(p[quality.CHUNK - quality.STEP :] for p in parts[1:])
    assert joined == raw


def test_gradients():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in quality.start_params(rng).items()}
    x, length = quality._matrix([b"some bytes " * 40, b"short", b"x" * 512])
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        z = quality.forward(p, x, length)["logit"]
        return float(np.sum(np.log1p(np.exp(z)) - y * z))

    f = quality.forward(p, x, length)
    grads = quality.backward(p, x, f, quality._sigmoid(f["logit"]) - y)
    for name in p:
        spots = list(np.ndindex(p[name].shape))
        if name == "embed":
            spots = [(b, k) for b in b"some" for k in range(quality.EMBED)]
        for at in random.Random(2).sample(spots, min(6, len(spots))):
            keep, h = p[name][at], 1e-4
            p[name][at] = keep + h
            up = loss()
            p[name][at] = keep - h
            down = loss()
            p[name][at] = keep
            assert abs((up - down) / (2 * h) - grads[name][at]) < 2e-3, (name, at)


def corpus(n=500, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(rng.randrange(20, 200))]
        good = i % 5 > 0
        rows.append((i, " ".join(words) if good else "*** ".join(words), int(good)))
    return rows


def test_fit_and_score(spark):
    rows = corpus()
    edge = [(None, "null id"), (900, None), (901, ""), (902, "abc def " * 20_000)]
    schema = "quality_score string, text string, y int, doc_id long"
    docs = spark.createDataFrame([("x", t, 5, d) for d, t in [(d, t) for d, t, _ in rows] + edge], schema)
    labels = spark.createDataFrame(
        [(d, y) for d, _, y in rows] + [(None, 1), (7, None), (99_999, 0)], "doc_id long, quality int"
    )
    model = quality.fit(docs, labels, F.col("doc_id") % 4 != 0)
    out = quality.score_quality(docs, model).collect()
    assert len(out) == len(rows) + 4 and all(0 <= r.quality_score <= 1 for r in out)
    got = {r.doc_id: r.quality_score for r in out}
    held = [(got[d] >= 0.3) == bool(y) for d, _, y in rows if d % 4 == 0]
    assert np.mean(held) > 0.95
    assert got[900] == got[901]
    one = quality.score_texts(model, [rows[3][1], "abc def " * 20_000])
    assert np.allclose(one, [got[3], got[902]], atol=1e-6)


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, none, F.lit(True))
    assert 0 <= quality.score_quality(docs, model).first().quality_score <= 1
    assert not quality.score_quality(docs.filter("false"), model).collect()
