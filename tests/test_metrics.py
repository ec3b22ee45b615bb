import math

import numpy as np
import pytest

from tidemark.operators import metrics

SCHEMA = "model string, y_true double, y_pred double"


@pytest.fixture(scope="module")
def loss_rows(spark):
    truth = [1.0, 2.0, 3.0]
    rows = [("A", t, p) for t, p in zip(truth, [0.0, 2.0, 4.0], strict=True)]
    rows += [("B", t, 2.0) for t in truth]
    return spark.createDataFrame(rows, SCHEMA)


def test_worked_example(loss_rows):
    for r in metrics.evaluate(loss_rows, ["model"]).collect():
        assert r.mae == pytest.approx(0.6667, abs=1e-4)
        assert r.std_diff == pytest.approx(0.8165, abs=1e-4)
        assert r.dev_error == pytest.approx(0.6667, abs=1e-4)
        assert r.custom_loss == pytest.approx(2.1498, abs=1e-4)
        assert r.custom_loss == pytest.approx(r.mae + r.std_diff + r.dev_error)


def test_weights_and_rounding(loss_rows):
    r = metrics.evaluate(loss_rows, ["model"], 0.0, 0.0, digits=4).first()
    assert r.custom_loss == r.mae == 0.6667
    with pytest.raises(ValueError):
        metrics.evaluate(loss_rows, ["model"], None, 1.0)


def test_holes_score_null_and_missing_column_fails(spark, loss_rows):
    holed = loss_rows.unionByName(spark.createDataFrame([("A", 4.0, None)], SCHEMA))
    got = {r.model: r.custom_loss for r in metrics.evaluate(holed, ["model"]).collect()}
    assert got["A"] is None and got["B"] is not None
    with pytest.raises(ValueError, match="missing"):
        metrics.evaluate(loss_rows.drop("y_pred"), ["model"])


def test_zero_truth(spark):
    df = spark.createDataFrame([("s", 0.0, 0.0), ("s", 2.0, 1.0)], "series_id string, y_true double, y_pred double")
    assert metrics.per_series_metrics(df).first().MAPE is None
    assert math.isfinite(metrics.evaluate(df, ["series_id"]).first().mape)


def test_per_series(spark):
    data = {"s1": ([1, 2, 3, 4], [1.1, 2.1, 2.9, 4.0]), "s2": ([2, 4, 6, 8], [2.1, 3.9, 6.1, 7.8])}
    rows = [(k, float(t), float(p)) for k, (ts, ps) in data.items() for t, p in zip(ts, ps, strict=True)]
    df = spark.createDataFrame(rows, "series_id string, y_true double, y_pred double")
    out = metrics.per_series_metrics(df).collect()
    assert [r.series_id for r in out] == sorted(data, key=lambda k: dict((x.series_id, x.custom_loss) for x in out)[k])
    for r in out:
        t, p = (np.array(x, dtype=float) for x in data[r.series_id])
        e = p - t
        want = np.abs(e).mean() + abs(p.std() - t.std()) + np.abs(e - e.mean()).mean()
        assert r.custom_loss == pytest.approx(want)
        assert r.MAPE == pytest.approx(np.abs(e / t).mean())
    one = metrics.per_series_metrics(spark.createDataFrame([("x", 5.0, 5.0)], df.schema)).first()
    assert one.MAE == 0.0


def test_training_loss(spark):
    rng = np.random.default_rng(0)
    t, p = rng.normal(size=12), rng.normal(size=12)
    df = spark.createDataFrame([("w", float(a), float(b)) for a, b in zip(t, p, strict=True)], "w string, y_true double, y_pred double")
    base, e = np.abs(p - t), p - t
    sp = abs(p.std(ddof=1) - t.std(ddof=1))
    dev = np.abs(e - e.mean())
    w_std = min(base.mean() / (sp + 1e-8), 10)
    w_dev = np.minimum(base / (dev + 1e-8), 10)
    want = (base + w_std * sp + w_dev * dev).mean()
    assert metrics.training_loss(df, ["w"]).first().loss == pytest.approx(want)


def test_failed_fold_drops_configuration(spark):
    cols = "config_id int, fold int, custom_loss double, std_diff double, dev_error double, mae double, mape double, rmse double"
    rows = [(1, 1, 2.0, 0.0, 0.0, 2.0, 0.0, 2.0), (1, 2, 4.0, 0.0, 0.0, 4.0, 0.0, 4.0), (2, 1, 0.1, 0.0, 0.0, 0.1, 0.0, 0.1), (2, 2, None, None, None, None, None, None)]
    scores = metrics.cv_scores(spark.createDataFrame(rows, cols), ["config_id"])
    assert [(r.config_id, r.avg_custom_score) for r in scores.collect()] == [(1, 3.0)]


def test_best_config_tie_takes_first(spark):
    df = spark.createDataFrame([(3, 1.0), (1, 1.0), (2, 5.0), (0, None)], "config_id int, s double")
    assert metrics.best_config(df, [], "s", "config_id").first().config_id == 1


def test_matrix_leaderboard_improvement(loss_rows):
    scored = metrics.evaluate(loss_rows.filter("model = 'A'").unionByName(loss_rows.filter("model = 'B'")), ["model"])
    m = {r.metric: (r.A, r.B) for r in metrics.metric_matrix(scored, ["A", "B"]).collect()}
    assert len(m) == 6 and m["mae"][0] == pytest.approx(2 / 3)
    assert {r.rank for r in metrics.leaderboard(scored).collect()} <= {1, 2}
    gains = {r.model: r.improvement_pct for r in metrics.improvement(scored, ["B"]).collect()}
    assert gains["B"] == pytest.approx(0.0)
