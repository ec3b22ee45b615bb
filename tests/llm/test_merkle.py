"""Merkle manifest against plain lists, over several sizes, repeated and null ids."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def brute(rows, change):
    groups = {}
    for row in rows:
        doc_id, text, lang, source, n_chars = row
        leaf, other = (h(*map(field, (doc_id, source, lang, n_chars, t))) for t in (text, change(doc_id, text)))
        groups.setdefault(lang, []).append(((doc_id is not None, doc_id or 0, leaf), doc_id, leaf, other))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([leaf for _, _, leaf, _ in sorted(groups[g], key=lambda x: x[0])]) for g in order}
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for place, g in enumerate(order):
        for k, (_, doc_id, leaf, other) in enumerate(sorted(groups[g], key=lambda x: x[0])):
            proof, digest = "", other
            for rows_, at in ((trees[g], k), (top, place)):
                for row in rows_[:-1]:
                    start = at - at % 8
                    run = row[start : start + 8]
                    own = at - start
                    proof += "".join(run[:own] + run[own + 1 :])
                    digest = h(*run[:own], digest, *run[own + 1 :])
                    at //= 8
            root = top[-1][0]
            out.append((doc_id, leaf, trees[g][-1][0], root, h(proof), digest, digest == root))
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string, leaf string, idx int"


def check(spark, rows, parts=3):
    frame = spark.createDataFrame([(*r, "g", "l", 1) for r in rows], SCHEMA).repartition(parts)
    touched = F.col("doc_id") % 3 == 0
    got = merkle.verify_documents(frame, F.when(touched, F.lower("text"))).collect()
    want = brute(rows, lambda i, t: t.lower() if t is not None and i is not None and i % 3 == 0 else t)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_nulls_repeats_and_groups(spark):
    rng = random.Random(5)
    rows = [(i, f"Text {i}", rng.choice(["en", "de", None, "é"]), "s", i) for i in rng.sample(range(-9000, 90000), 300)]
    rows += [(7, "Same", "en", "s", 4)] * 9 + [(7, "Other", "en", None, None), (8, None, None, None, None)]
    rows += [(None, f"Null {i % 4}", "en", "s", 1) for i in range(20)] + [(None, "", None, "s", 0)]
    rows += [(2**62, "Far away", "xx", "s", 8), (-(2**62), "long " * 200_000, "yy", "s", 1_000_000)]
    check(spark, rows)


@pytest.mark.parametrize("sizes", [[], [1], [1, 2, 8, 9, 65]])
def test_small_trees(spark, sizes):
    check(spark, [(i * 5, f"T{i}", f"l{k}", "s", 2) for k, n in enumerate(sizes) for i in range(n)])


def test_several_rounds(spark, monkeypatch):
    """Arrays of 64 nodes, so that trees need more than one round up and down."""
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "SLOT_BITS", 6)
    monkeypatch.setattr(merkle, "SLOTS", 64)
    monkeypatch.setattr(merkle, "MAP_BITS", 6)
    rows = [(i, f"T{i}", "en" if i % 10 else f"l{i}", "s", 2) for i in range(1000)]
    check(spark, rows, 4)
