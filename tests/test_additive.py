"""Additive models from moments against designs built row by row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.calendar import changepoints
from tidemark.operators import additive as ad
from tidemark.operators.splits import lengths, rolling_origin_folds, weekly_folds
from tidemark.session import durable

KEYS = ["series_id"]
TERMS = {"daily": (1.0, 2), "weekly": (7.0, 1)}
N, DAY = 160, 6


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(9)
    rows = []
    for k, s in enumerate(("a", None)):
        t = np.arange(N)
        level = 20 + 0.1 * t - 0.15 * np.maximum(0, t - 80)
        y = level * (1 + 0.2 * np.sin(2 * np.pi * t / DAY)) + rng.normal(size=N) + 8 * (rng.random(N) > 0.93)
        rows += [(s, int(i) + 40_000 * k, float(v) if i % 37 else None) for i, v in zip(t, y)]
    base = spark.createDataFrame(rows, "series_id string, pos bigint, value double")
    return durable(base.withColumn("ts", F.timestamp_seconds(F.col("pos") * 14_400).cast("timestamp_ntz")))


def plain(pos, value, level, start, end, tests, config):
    """The same model with every column written out."""

    def columns(p, event):
        t = (p - start) / (end - start)
        trend = [np.ones(len(p)), t, *[np.maximum(0, t - c) for c in changepoints(config["n_changepoints"], config["changepoint_range"])]]
        day = p * 14_400 / 86_400
        angles = [2 * np.pi * k * day / period for period, order in TERMS.values() for k in range(1, order + 1)]
        return np.column_stack(trend), np.column_stack([*map(np.sin, angles), *map(np.cos, angles), event])

    use = (pos >= start) & (pos < end) & ~np.isnan(value)
    y = np.log1p(value[use])
    trend, season = columns(pos[use], (value[use] > level).astype(float))
    more, again = columns(tests, np.zeros(len(tests)))
    weight = np.full(trend.shape[1], 1 / config["changepoint_prior_scale"])
    weight[:2] = ad.FREE
    prior = np.full(season.shape[1], 1 / config["seasonality_prior_scale"] ** 2)
    fit = lambda x, y, w: np.linalg.lstsq(np.vstack([x, np.diag(np.sqrt(w))]), np.append(y, np.zeros(len(w))), rcond=None)[0]
    if config["seasonality_mode"] == "additive":
        coef = fit(np.hstack([trend, season]), y, np.append(weight, prior))
        return np.expm1(np.hstack([more, again]) @ coef)
    gamma = np.zeros(season.shape[1])
    for _ in range(ad.SWEEPS):
        beta = fit(trend * (1 + season @ gamma)[:, None], y, weight)
        g = trend @ beta
        gamma = fit(season * g[:, None], y - g, prior)
    return np.expm1((more @ beta) * (1 + again @ gamma))


CONFIGS = ad.grid_configs(
    {
        "changepoint_prior_scale": [0.01, 0.5],
        "seasonality_prior_scale": [5.0],
        "seasonality_mode": ["additive", "multiplicative"],
        "changepoint_range": [0.8, 0.95],
        "n_changepoints": [3, 10],
    }
)


@pytest.mark.parametrize("mode, chunk", [("rolling", 10_000), ("sliding", 300), ("reverse", 300)])
def test_every_fold_and_configuration(spark, df, mode, chunk):
    local = df.withColumn("pos", F.col("pos") % 40_000)
    sizes = lengths(local, KEYS, "pos")
    if mode == "rolling":
        folds = durable(rolling_origin_folds(sizes, KEYS, 60, 30, DAY))
    else:
        folds = durable(weekly_folds(sizes, KEYS, mode, 60, DAY))
    got = {}
    for r in ad.additive_forecast(local, folds, KEYS, "pos", "ts", "value", CONFIGS, TERMS, chunk).collect():
        got.setdefault((r.series_id, r.fold, r.config_id), []).append((r.pos, r.y_pred))
    rows, count = local.toPandas(), 0
    shift = {"a": 0, None: 40_000}
    for f in folds.collect():
        mine = rows[rows.series_id.isna() if f.series_id is None else rows.series_id == f.series_id].sort_values("pos")
        pos, value = mine.pos.to_numpy(), mine.value.to_numpy()
        until = max(x.train_end for x in folds.collect() if x.series_id == f.series_id)
        level = np.nanquantile(value[pos < until], ad.SPIKE_QUANTILE)
        tests = np.arange(f.test_start, f.test_end)
        for c in CONFIGS:
            count += 1
            told = [v for _, v in sorted(got[f.series_id, f.fold, c["config_id"]])]
            off = shift[f.series_id]  # calendar and trend both move with the position
            assert np.allclose(told, plain(pos + off, value, level, f.train_start + off, f.train_end + off, tests + off, c), rtol=1e-5)
    assert count == len(got) and count >= 4 * len(CONFIGS)


def test_grid_has_all_configurations(spark, df):
    grid = ad.grid_configs()
    assert len(grid) == 216 and len({tuple(c.values())[1:] for c in grid}) == 216
    folds = durable(rolling_origin_folds(lengths(df.filter("series_id = 'a'"), KEYS, "pos"), KEYS, 100, 40, DAY))
    ranked = ad.additive_grid_search(df, folds, KEYS, "pos", "ts", "value", CONFIGS, TERMS).collect()
    assert len(ranked) == len(CONFIGS) and len({round(r.mean_rmse, 9) for r in ranked}) == len(CONFIGS)
    assert [r.mean_rmse for r in ranked] == sorted(r.mean_rmse for r in ranked)
