"""Whitening against a dense eigensolver and whole-number sums."""

import math

import numpy as np
import pytest

from tidemark.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<double>, label int, n long, whitened string, x int"


def frame(spark, vectors, parts=3):
    rows = [(i if i != 13 else None, v, 1, 2, "w", 3) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def brute(vectors, k):
    kept = {}
    for i, v in enumerate(vectors):
        if v and all(c is not None and math.isfinite(c) for c in v):
            kept[i] = tuple(math.floor(256 * c) for c in v)
    fit = sorted(set(kept.values()))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    x = np.array(fit, float) - np.array([s / n for s in sums])
    cov = x.T @ x / n
    values, vectors_ = np.linalg.eigh(cov)
    values, vectors_ = values[::-1][:k], vectors_[:, ::-1][:, :k]
    far = {i: sum((n * c - s) ** 2 for c, s in zip(v, sums)) for i, v in kept.items()}
    place = {i: (np.array(v) - np.array([s / n for s in sums])) @ vectors_ / np.sqrt(values) for i, v in kept.items()}
    return n, far, place, values / np.trace(cov)


def compare(spark, vectors, k=4):
    df = frame(spark, vectors)
    got = wh.whiten(df, wh.fit(df, k)).collect()
    n, far, place, explained = brute(vectors, k)
    assert len(got) == k * len(far)
    sign = {}
    for r in got:
        i = 13 if r.vec_id is None else r.vec_id
        want = place[i][r.component - 1]
        if abs(want) > 1e-6:
            sign.setdefault(r.component, np.sign(want * r.whitened))
        assert r.whitened * sign.get(r.component, 1) == pytest.approx(want, abs=1e-9)
        assert (r.n, r.deviation) == (n, far[i])
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        assert r.identity_error < 1e-10


def test_close_spectrum_with_copies_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((700, 40)) / 6
    vectors = x.tolist() + x[:50].tolist() * 5
    vectors += [None, [], [1.0] * 39 + [None], [1.0] * 39 + [float("nan")], [float("-inf")] * 40, [-0.0] * 40]
    compare(spark, vectors)


def test_leading_pairs_on_hard_spectra():
    rng = np.random.default_rng(2)
    for spectrum in ([5, 4, 3, 2] + [1] * 60, list(range(64, 0, -1)), [9, 8] + [0] * 62, [1] * 8, [1e9, 1e3, 1e2, 10, 1]):
        d = len(spectrum)
        turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
        cov = (turn * np.array(spectrum, float)) @ turn.T
        q, values = wh.leading_pairs(lambda b: cov @ b, d, float(np.trace(cov)), 4)
        want = [v for v in spectrum[:4] if v > wh.ZERO * spectrum[0]]
        assert np.allclose(values, want, rtol=1e-9)
        assert np.allclose(cov @ q, q * values, atol=1e-9 * spectrum[0])


def test_a_start_without_the_leading_direction_is_found_out():
    class Poor:
        """First a block that lacks direction 0, then good ones."""

        def __init__(self):
            self.rng, self.calls = np.random.default_rng(3), 0

        def standard_normal(self, shape):
            out = self.rng.standard_normal(shape)
            self.calls += 1
            if self.calls == 1:
                out[0] = 0
            return out

    cov = np.diag([50.0, *np.linspace(10, 9, 99)])
    _, values = wh.leading_pairs(lambda b: cov @ b, 100, float(np.trace(cov)), 4, Poor())
    assert values[0] == pytest.approx(50)


def test_few_rows_large_numbers_and_empty_tables(spark):
    # two distinct vectors: one direction
    df = frame(spark, [[0.0, 0.0, 1.0], [1.0, 2.0, 1.0], [1.0, 2.0, 1.0], [3.0, 3.0]])
    got = wh.whiten(df, wh.fit(df)).collect()
    assert len(got) == 3 and {r.component for r in got} == {1}
    assert all(r.explained == pytest.approx(1) for r in got)
    far = frame(spark, [[1e9, 5.0], [-1e9, 2.0], [3.0, 4.0]])
    assert sorted(r.deviation is None for r in wh.whiten(far, wh.fit(far, 1)).collect()) == [False, True, True]
    for vectors in ([], [None], [[]], [[1.0, 2.0]]):
        df = frame(spark, vectors)
        assert not wh.whiten(df, wh.fit(df)).collect()
