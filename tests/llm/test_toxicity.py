"""Segment search against a definition by brute force; the model on made-up labels."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import toxicity


def maximal(scores, a, b):
    """Recursive definition: the best segment, then the same left and right of it."""
    best = None
    for i in range(a, b):
        total = 0.0
        for j in range(i, b):
            total += scores[j]
            if total > 0 and (best is None or total > best[2] or (total == best[2] and j + 1 - i < best[1] - best[0])):
                best = (i, j + 1, total)
    if best is None:
        return []
    return maximal(scores, a, best[0]) + [best] + maximal(scores, best[1], b)


@given(st.lists(st.integers(-1_000_003, 1_000_003).map(lambda x: x / 7919), max_size=25))
@settings(max_examples=300, deadline=None)
def test_segments(scores):
    got = toxicity.segments(np.array(scores, float))
    want = maximal(scores, 0, len(scores))
    assert [round(x[2], 6) for x in got] == [round(x[2], 6) for x in want]


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    clean = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randrange(5, 120))]
        toxic = i % 8 == 0
        for _ in range(2 + len(words) // 30 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["Vile", "FOUL", "nasty"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def frames(spark, rows, labels):
    docs = spark.createDataFrame(
        [(t, "x", d, "y") for d, t in rows], "text string, passages string, doc_id long, toxicity string"
    )
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_fit_and_score(spark):
    rows = corpus()
    labels = [(d, y) for d, _, y in rows] + [(None, 1), (5, None), (99_999, 1)]
    edge = [(None, "null id"), (1000, None), (1001, ""), (1002, "word1 " * 5000 + "vile foul nasty foul " + "word2 " * 5000)]
    docs, lab = frames(spark, [(d, t) for d, t, _ in rows] + edge, labels)
    model = toxicity.fit(docs, lab, F.col("doc_id") % 3 != 1)
    assert set(model.scores) == {"vile", "foul", "nasty"}
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert len(got) == len(rows) + 4
    for d, _, y in rows:
        assert (got[d].toxicity >= 0.7) == bool(y)
    for d in (None, 1000, 1001):
        assert got[d].toxicity < 0.1 and got[d].passages == []
    (span,) = got[1002].passages
    text = dict(edge)[1002]
    assert text[span.start : span.end] == "vile foul nasty foul" and span.chance < 0.05


def test_no_labels_and_no_rows(spark):
    docs, lab = frames(spark, [(1, "a b c")], [])
    model = toxicity.fit(docs, lab, F.lit(True))
    assert toxicity.score_toxicity(docs, model).first().toxicity < 0.1
    docs, lab = frames(spark, [], [(1, 1)])
    assert not toxicity.score_toxicity(docs, toxicity.fit(docs, lab, F.lit(True))).collect()
