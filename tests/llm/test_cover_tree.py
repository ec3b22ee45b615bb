"""Cover trees: their invariants, and links against all pairs."""

import numpy as np
import pytest
from pyspark.sql import types as T

from tidemark.llm import cover_tree as ct


def clustered(rng, n, dim=16):
    centers = rng.standard_normal((max(2, n // 20), dim))
    x = centers[rng.integers(0, len(centers), n)] + rng.standard_normal((n, dim)) * rng.choice([0.01, 0.1, 0.2], (n, 1))
    return x


@pytest.mark.parametrize("n", [1, 2, 40, 700])
def test_tree_covers_and_separates(n):
    rng = np.random.default_rng(n)
    x = clustered(rng, n)
    x = np.concatenate([x, x[: n // 3]])
    unit = x / np.linalg.norm(x, axis=1)[:, None]

    def visit(node):
        far = ct._distance(unit[node.members], unit[node.center])
        assert far.max() <= node.radius + 1e-12
        if not node.children:
            return node.members.tolist()
        centers = unit[[c.center for c in node.children]]
        apart = np.sqrt(((centers[:, None] - centers[None]) ** 2).sum(-1))[~np.eye(len(centers), dtype=bool)]
        assert apart.min() > max(c.radius for c in node.children) - 1e-9
        assert max(c.radius for c in node.children) <= node.radius
        return [m for c in node.children for m in visit(c)]

    assert sorted(visit(ct.build(unit))) == list(range(len(x)))


@pytest.mark.parametrize("same", [True, False])
def test_match_is_exact(same):
    rng = np.random.default_rng(4)
    x = clustered(rng, 500)
    y = x if same else np.concatenate([clustered(rng, 300), x[:100] * 3])
    ids = np.arange(len(x)), np.arange(len(y)) + (0 if same else 1000)
    many = rng.integers(1, 4, len(x)), rng.integers(1, 4, len(y))
    many = many if not same else (many[0], many[0])
    cx, cy, links = ct.match(x, y, *ids, *many, 0.98, same)
    cos = (x @ y.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(y, axis=1)
    near = cos >= 0.98
    if same:
        np.fill_diagonal(near, False)
    assert (cx == near @ many[1]).all()
    assert same or (cy == many[0] @ near).all()
    assert near.sum() > 500 and len(links) < len(x) + len(y)
    assert all(near[np.where(ids[0] == a)[0][0], np.where(ids[1] == b)[0][0]] for a, b in links)


def brute(rows):
    sound = [
        (v, np.array(e, float), lab)
        for v, e, lab in rows
        if v is not None and lab is not None and e and all(c is not None and np.isfinite(c) for c in e) and any(e)
    ]
    up = {v: v for v, _, _ in rows if v is not None}
    n = dict.fromkeys(up, 0)

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for i, (a, x, la) in enumerate(sound):
        for b, y, lb in sound[:i]:
            if la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                n[a] += 1
                n[b] += 1
                up[max(root(a), root(b))] = min(root(a), root(b))
    return sorted((v, n[v], root(v), root(v) == v) for v in up)


SCHEMA = T.StructType(
    [
        T.StructField("first", T.StringType()),
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
        T.StructField("cell", T.IntegerType()),
    ]
)


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(ct, "BLOCK", 40)
    rng = np.random.default_rng(9)
    x = clustered(rng, 330, 8).astype(np.float32)
    rows = [(i, [float(c) for c in e], int(i % 3 == 0)) for i, e in enumerate(x)]
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(60)]  # copies
    rows += [(1100, [float(2 * c) for c in rows[5][1]], rows[5][2]), (1101, rows[5][1], None), (1102, None, 0)]
    rows += [(1103, [0.0] * 8, 0), (1104, [None] * 8, 0), (1105, [float("nan")] * 8, 0), (1106, [float("inf")] * 8, 0)]
    rows += [(1107, [], 0), (1108, [1e-30] * 8, 0), (1109, [1e30] * 8, 0), (1110, [1.0] * 4, 0)]
    frame = spark.createDataFrame([("f", *r, 3) for r in rows + [(None, [1.0] * 8, 0)]], SCHEMA)
    out = ct.near_vectors(frame).collect()
    got = sorted(tuple(r) for r in out if r.vec_id is not None)
    assert got == brute(rows)
    assert [tuple(r) for r in out if r.vec_id is None] == [(None, 0, None, None)]
    assert not ct.near_vectors(frame.filter("false")).collect()
