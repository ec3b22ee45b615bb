"""Streamed Holt-Winters against a plain loop over one window."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import forecast as fc
from tidemark.operators.smoothing import SMOOTHING, candidates, hw_configs, smooth_cv, smooth_fitted, smooth_folds, window_extremes
from tidemark.operators.splits import lengths, weekly_folds
from tidemark.session import durable

KEYS = ["series_id"]
M, H, N = 6, 7, 110


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(11)
    rows = []
    for k, s in enumerate(("a", None)):
        t = np.arange(N - 30 * k)
        y = 15 + 0.05 * t + 4 * np.sin(2 * np.pi * t / M) + rng.normal(size=len(t)) * 0.5
        rows += [(s, int(i), float(v)) for i, v in zip(t, y)]
    rows += [("short", i, 1.0 + i) for i in range(10)]
    rows += [("hole", i, float(i % M + i / 9)) for i in range(60) if i != 20]
    return durable(spark.createDataFrame(rows, "series_id string, pos bigint, value double"))


def plain(y, trend, seasonal, damped, horizon):
    """One window, one candidate after the other, scalars only."""
    y = np.asarray(y, float)
    if len(y) < 2 * M:
        return None
    lo, span = 0.0, 1.0
    if "mul" in (trend, seasonal):
        lo, span = y.min(), (y.max() - y.min()) or 1.0
        y = 1 + (y - lo) / span
    best = None
    for alpha, beta, gamma, phi in candidates(trend, seasonal, damped, SMOOTHING).T:
        level, after = y[:M].mean(), y[M : 2 * M].mean()
        slope = {"add": (after - level) / M, "mul": (after / level) ** (1 / M), None: 0.0}[trend]
        season = [(v - level if seasonal == "add" else v / level) if seasonal else 0.0 for v in y[:M]]
        sse, fitted = 0.0, []
        for t, obs in enumerate(y):
            base = {"add": level + phi * slope, "mul": level * slope**phi if trend == "mul" else 0, None: level}[trend]
            s = season[t % M]
            guess = base + s if seasonal == "add" else base * s if seasonal else base
            inner = obs - s if seasonal == "add" else obs / s if seasonal else obs
            new = alpha * inner + (1 - alpha) * base
            if trend == "add":
                slope = beta * (new - level) + (1 - beta) * phi * slope
            elif trend:
                slope = beta * new / level + (1 - beta) * slope**phi
            if seasonal:
                season[t % M] = gamma * (obs - base if seasonal == "add" else obs / base) + (1 - gamma) * s
            level = new
            sse += (obs - guess) ** 2
            fitted.append((guess - 1) * span + lo if span != 1 or lo else guess)
        if best is None or sse < best[0]:
            told = []
            for i in range(1, horizon + 1):
                damp = sum(phi**k for k in range(1, i + 1))
                v = level + damp * slope if trend == "add" else level * slope**damp if trend else level
                s = season[(len(y) + i - 1) % M]
                v = v + s if seasonal == "add" else v * s if seasonal else v
                told.append((v - 1) * span + lo if "mul" in (trend, seasonal) else v)
            best = sse, told, fitted
    return best


@pytest.mark.parametrize("mode", ["expanding", "sliding", "reverse"])
def test_every_form_and_fold(spark, df, mode):
    folds = durable(weekly_folds(lengths(df, KEYS, "pos"), KEYS, mode, 25, H))
    configs = hw_configs(spark)
    got = {}
    for r in smooth_folds(df, folds, KEYS, "pos", "value", M, configs, chunk=16).collect():
        got.setdefault((r.series_id, r.fold, r.config_id), []).append((r.pos, r.y_pred))
    rows = {}
    for r in df.collect():
        rows.setdefault(r.series_id, {})[r.pos] = r.value
    n = 0
    for f in folds.collect():
        window = [rows[f.series_id].get(t) for t in range(f.train_start, f.train_end)]
        for c in configs.collect():
            told = [v for _, v in sorted(got[f.series_id, f.fold, c.config_id])]
            want = None if None in window else plain(window, c.trend, c.seasonal, c.damped, H)
            if want is None:
                assert told == [None] * H
            else:
                n += 1
                assert np.allclose(told, want[1], rtol=1e-7)
    assert n >= 15 and len(got) == folds.count() * 15


def test_fitted_values_and_residuals(spark, df):
    folds = durable(fc.last_day_fold(lengths(df, KEYS, "pos"), KEYS, H))
    configs = hw_configs(spark).filter("config_id in (0, 6, 14)")
    got = smooth_fitted(df, folds, KEYS, "pos", "value", M, configs).filter("series_id = 'a'").collect()
    y = [r.value for r in df.filter("series_id = 'a'").orderBy("pos").collect()]
    for c in configs.collect():
        mine = sorted((r.pos, r.fitted, r.resid) for r in got if r.config_id == c.config_id)
        assert [p for p, _, _ in mine] == list(range(N - H))
        want = plain(y[: N - H], c.trend, c.seasonal, c.damped, H)[2]
        assert np.allclose([f for _, f, _ in mine], want)
        assert np.allclose([f + r for _, f, r in mine], y[: N - H])


@pytest.mark.parametrize("chunk", [7, 10_000])
def test_window_extremes(spark, df, chunk):
    folds = durable(weekly_folds(lengths(df, KEYS, "pos"), KEYS, "sliding", 25, H))
    rows = df.toPandas()
    for r in window_extremes(df, folds, KEYS, "pos", "value", chunk).collect():
        mine = rows[(rows.series_id.isna() if r.series_id is None else rows.series_id == r.series_id)]
        mine = mine[(mine.pos >= r.train_start) & (mine.pos < r.train_end)].value
        assert (r._lo, r._hi, r._whole) == (mine.min(), mine.max(), len(mine) == r.train_end - r.train_start)
    empty = smooth_folds(df.limit(0), folds.limit(0), KEYS, "pos", "value", M, hw_configs(spark))
    assert not empty.collect()
