"""Fitted states: saved, loaded, and forecasting the same."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import additive, forecast, rolling, smoothing, trees
from tidemark.operators.splits import lengths
from tidemark.session import durable
from tidemark.sources import models

KEYS = ["series_id"]
M, H, N = 6, 6, 120
CONFIG = {
    "config_id": 3, "changepoint_prior_scale": 0.1, "seasonality_prior_scale": 10.0,
    "seasonality_mode": "multiplicative", "changepoint_range": 0.8, "n_changepoints": 4,
}


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(4)
    rows = [(s, i, float(12 + 3 * np.sin(2 * np.pi * i / M) + rng.normal() * 0.3)) for s in "ab" for i in range(N)]
    base = spark.createDataFrame(rows, "series_id string, pos bigint, value double")
    return durable(base.withColumn("ts", F.timestamp_seconds(F.col("pos") * 14_400).cast("timestamp_ntz")))


def told(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_states_forecast_the_same_after_loading(spark, df, tmp_path):
    path = str(tmp_path / "models")
    folds = durable(forecast.last_day_fold(lengths(df, KEYS, "pos"), KEYS, H))
    terms = {"daily": (1.0, 2)}
    tests = rolling.fold_tests(df, folds, KEYS, "pos")
    families = {
        "arma": (
            rolling.arma_fit(df, folds, KEYS, "pos", "value", M),
            lambda s: rolling.arma_forecast(s, KEYS, "pos", M),
            rolling.arma_folds(df, folds, KEYS, "pos", "value", M),
        ),
        "holt_winters": (
            smoothing.smooth_fit(df, folds, KEYS, "pos", "value", M, smoothing.hw_configs(spark)),
            lambda s: smoothing.smooth_forecast(s, KEYS, "pos"),
            smoothing.smooth_folds(df, folds, KEYS, "pos", "value", M, smoothing.hw_configs(spark)),
        ),
        "additive": (
            additive.additive_fit(df, folds, KEYS, "pos", "ts", "value", [CONFIG], terms),
            lambda s: additive.additive_predict(s, tests, KEYS, "pos", "ts", terms),
            additive.additive_forecast(df, folds, KEYS, "pos", "ts", "value", [CONFIG], terms),
        ),
    }
    for name, (states, predict, direct) in families.items():
        models.save_state(states.limit(1), path, name, 1)
        models.save_state(states, path, name, 2)
        loaded = models.load_state(spark, path, name)
        assert loaded.schema.names == states.schema.names and loaded.count() == states.count()
        assert models.load_state(spark, path, name, 1).count() == 1
        got, want = told(predict(loaded)), told(direct)
        assert len(got) == len(want) > 0 and [r[:-1] for r in got] == [r[:-1] for r in want]
        assert np.allclose([r[-1] for r in got], [r[-1] for r in want])
        with pytest.raises(Exception, match="exists"):
            models.save_state(states, path, name, 2)


def test_trees_forecast_the_same_after_loading(spark, df, tmp_path):
    rows = df.withColumn("x", F.col("value") * 2)
    model = trees.fit_trees(rows.filter("pos < 100"), ["x"], "value", {"n_estimators": 2, "max_depth": 2})
    models.save_trees(model, str(tmp_path), 1)
    again = models.load_trees(str(tmp_path), 1)
    ask = rows.filter("pos >= 100").select("series_id", "pos", "x")
    assert told(trees.predict_trees(again, ask, ["x"])) == told(trees.predict_trees(model, ask, ["x"]))
