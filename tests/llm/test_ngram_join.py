"""Near duplicates against all pairs."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import ngram_join as nj
from tidemark.llm.links import components


def exact(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    nodes = sorted({d for d, _ in rows if d is not None})
    sets = [(d, exact(t)) for d, t in rows if d is not None]
    up = {d: d for d in nodes}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x & y and 100 * len(x & y) >= 80 * len(x | y):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return sorted(((d is None, d or 0, len(exact(t)), None if d is None else root(d)) for d, t in rows), key=str)


def corpus(rng, n):
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz") + str(rng.randrange(20))
    prose = lambda k: [word() for _ in range(k)]
    common, base = prose(40), prose(100)
    rows = []
    for d in range(n):
        kind = d % 6
        if kind == 0:
            words = prose(rng.randrange(0, 60))
        elif kind == 1:
            words = prose(rng.randrange(3, 60)) + common
        elif kind in (2, 3):  # a large family with few changes
            words = list(base)
            for _ in range(rng.randrange(0, 5)):
                words[rng.randrange(len(words))] = word()
        elif kind == 4 and rows:
            words = (rng.choice(rows)[1] or "").split()
            if words and rng.random() < 0.7:
                words[rng.randrange(len(words))] = word()
        else:
            words = base[: rng.randrange(1, 100)]
        sep = rng.choice([" ", "\n", "\t "])
        rows.append((d, sep.join(words)))
    return rows


@given(st.integers(0, 10**9))
@settings(max_examples=200, deadline=None)
def test_similar_sets_share_a_signature(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 120))
    x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
    lost = int(rng.integers(0, nj.spare(len(x)) + 1))
    y = np.setdiff1d(x, rng.choice(x, lost, replace=False))
    grow = int(rng.integers(0, nj.spare(len(x)) + 2))
    y = np.unique(np.concatenate([y, rng.integers(0, 2**63, grow, dtype=np.uint64)]))
    if not len(y) or not nj.similar(x, y) or len(x) == 1 or len(y) == 1:
        return
    share = rng.random()
    frequent = lambda t: (nj._mix(t) >> np.uint64(11)).astype(float) / 2**53 < share
    assert np.intersect1d(nj.signatures(x, frequent(x)), nj.signatures(y, frequent(y))).size


def frame(spark, rows):
    schema = "n long, text string, doc_id long, shingles string, node int, bucket string"
    return spark.createDataFrame([(1, t, d, "s", 2, "b") for d, t in rows], schema)


EDGE = [
    (None, "a null id of five words"), (900, "a null id of five words"), (901, None), (902, ""), (903, " \n"),
    (904, "one"), (905, "ONE"), (906, "two words"), (907, "two words"), (907, "two words"), (908, "Two\x0bwords"),
    (909, "w " * 3000), (910, " ".join(f"w{i}" for i in range(9000))), (911, " ".join(f"w{i}" for i in range(8990))),
]


@pytest.mark.parametrize("rare", [2, 16])
def test_near_duplicates(spark, monkeypatch, rare):
    monkeypatch.setattr(nj, "FAMILY_BLOCK", 16)
    monkeypatch.setattr(nj, "RARE", rare)
    rows = corpus(random.Random(8), 240) + EDGE
    got = nj.near_duplicates(frame(spark, rows)).collect()
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in got), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    assert not nj.near_duplicates(frame(spark, [])).collect()


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, 2000 + i) for i in range(300)]
    links += [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(300)] + [(7, None), (5000, 5000)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if b is not None and a != b:
            up[max(root(a), root(b))] = min(root(a), root(b))
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, root(x)) for x in up)


@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=400), st.data())
@settings(max_examples=150, deadline=None)
def test_profiles_never_hide_a_similar_pair(tokens, data):
    x = np.array(sorted(tokens), np.uint64)
    gone = data.draw(st.sets(st.integers(0, len(x) - 1), max_size=len(x) // 5))
    more = data.draw(st.sets(st.integers(0, 2**64 - 1), max_size=len(x) // 5))
    y = np.unique(np.concatenate([np.delete(x, list(gone)), np.array(sorted(more), np.uint64)]))
    if len(y) and nj.similar(x, y):
        assert nj.may_be_similar(nj.profile(x), nj.profile(y), len(x), len(y))


def test_profiles_tell_other_sets_apart():
    rng = np.random.default_rng(1)
    far = 0
    for n in (30, 100, 1000, 5000):
        for _ in range(50):
            x, y = (np.unique(rng.integers(0, 2**64, n, np.uint64)) for _ in "ab")
            far += not nj.may_be_similar(nj.profile(x), nj.profile(y), len(x), len(y))
    assert far > 190
    # counts that do not fit a byte decide nothing
    crowded = np.arange(2000, dtype=np.uint64)
    assert nj.may_be_similar(nj.profile(crowded), nj.profile(crowded[:500]), 2000, 500)
