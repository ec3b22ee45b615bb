import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import forecast as fc
from tidemark.operators.additive import additive_forecast, additive_grid_search
from tidemark.operators.reshape import assign_folds
from tidemark.operators.smoothing import hw_configs, smooth_cv, smooth_fitted, smooth_folds
from tidemark.operators.splits import lengths, weekly_folds
from tidemark.operators.trees import tree_random_search
from tidemark.session import durable

KEYS = ["series_id"]
M, H, N = 6, 6, 90


@pytest.fixture(scope="module")
def wave():
    rng = np.random.default_rng(1)
    t = np.arange(N)
    return 20 + 0.05 * t + 4 * np.sin(2 * np.pi * t / M) + rng.normal(size=N) * 0.1


@pytest.fixture(scope="module")
def df(spark, wave):
    rows = [("a", i, float(v)) for i, v in enumerate(wave)]
    rows += [("short", i, 1.0 + i) for i in range(10)]
    base = spark.createDataFrame(rows, "series_id string, pos bigint, value double")
    ts = F.timestamp_seconds(F.col("pos") * 14_400).cast("timestamp_ntz")
    return durable(base.withColumn("ts", ts))


@pytest.fixture(scope="module")
def assigned(df):
    folds = fc.last_day_fold(lengths(df, KEYS, "pos"), KEYS, H)
    return durable(assign_folds(df, folds, KEYS, "pos"))


def config(spark, trend, seasonal, damped=False):
    return spark.createDataFrame(
        [(7, trend, seasonal, damped)], "config_id int, trend string, seasonal string, damped boolean"
    )


def one(out, series="a"):
    rows = out.filter(F.col("series_id") == series).orderBy("pos").collect()
    return np.array([np.nan if r.y_pred is None else r.y_pred for r in rows])


def test_naive_and_median(assigned, wave):
    naive = one(fc.seasonal_naive(assigned, KEYS, "pos", "value", M))
    assert np.allclose(naive, wave[N - H - M : N - H])
    median = one(fc.median_forecast(assigned, KEYS, "pos", "value"))
    assert np.allclose(median, np.median(wave[: N - H]))


def plain_holt_winters(y, m, alpha, beta, gamma, phi, h):
    level, slope = y[:m].mean(), (y[m : 2 * m].mean() - y[:m].mean()) / m
    season = list(y[:m] - level)
    for t, obs in enumerate(y):
        base, s = level + phi * slope, season[t % m]
        new = alpha * (obs - s) + (1 - alpha) * base
        slope = beta * (new - level) + (1 - beta) * phi * slope
        season[t % m] = gamma * (obs - base) + (1 - gamma) * s
        level = new
    return [level + slope * sum(phi**j for j in range(1, i + 1)) + season[(len(y) + i - 1) % m] for i in range(1, h + 1)]


def last_folds(df):
    return fc.last_day_fold(lengths(df, KEYS, "pos"), KEYS, H)


def test_holt_winters_recursion(spark, df, wave):
    fixed = {"alpha": [0.3], "beta": [0.1], "gamma": [0.2], "phi": [0.9]}
    out = smooth_folds(df, last_folds(df), KEYS, "pos", "value", M, config(spark, "add", "add", True), fixed)
    want = plain_holt_winters(wave[: N - H], M, 0.3, 0.1, 0.2, 0.9, H)
    assert np.allclose(one(out), want)
    assert np.isnan(one(out, "short")).all()  # fewer than two seasons: a failed fit, not a guess


def test_holt_winters_every_form(spark, df, wave):
    configs = hw_configs(spark)
    assert configs.count() == 15
    out = smooth_folds(df, last_folds(df), KEYS, "pos", "value", M, configs).toPandas()
    out = out[out.series_id == "a"]
    assert len(out) == 15 * H and out["y_pred"].notna().all()
    seasonal = out.merge(configs.toPandas(), on="config_id").dropna(subset=["seasonal"])
    seasonal = seasonal.assign(err=np.abs(seasonal["y_pred"] - wave[seasonal["pos"]]))
    assert seasonal["err"].mean() < 1.0
    fit = smooth_fitted(df, last_folds(df), KEYS, "pos", "value", M, config(spark, "add", "mul"))
    fit = fit.toPandas().sort_values("pos")
    assert np.allclose(fit["fitted"] + fit["resid"], wave[: N - H])


def test_holt_winters_cv_ranks_and_drops_failures(spark, df):
    folds = weekly_folds(lengths(df, KEYS, "pos"), KEYS, "sliding", 30, H)
    got = smooth_cv(df, folds, KEYS, "pos", "value", M, hw_configs(spark)).collect()
    scores = [r.avg_custom_score for r in got]
    assert len(got) == 15 and scores == sorted(scores) and got[0].seasonal is not None


@pytest.mark.parametrize("chunk", [9, 10_000])
def test_seasonal_arma_follows_the_season(assigned, wave, chunk):
    got = one(fc.seasonal_arma(assigned, KEYS, "pos", "value", M, chunk))
    assert len(got) == H and np.abs(got - wave[-H:]).mean() < 1.0


BASE = {
    "config_id": 1, "changepoint_prior_scale": 0.1, "seasonality_prior_scale": 10.0,
    "seasonality_mode": "multiplicative", "changepoint_range": 0.8, "n_changepoints": 3,
}


def test_additive_model(df, wave):
    terms = {"daily": (1.0, 2)}
    configs = [BASE, {**BASE, "config_id": 2, "seasonality_mode": "additive"}, {**BASE, "config_id": 3, "n_changepoints": 1}]
    folds = fc.last_day_fold(lengths(df, KEYS, "pos"), KEYS, H)
    out = additive_forecast(df, folds, KEYS, "pos", "ts", "value", configs, terms).toPandas()
    out = out[out.series_id == "a"]
    assert len(out) == 3 * H
    assert np.abs(out["y_pred"] - wave[out["pos"]]).mean() < 1.0
    search = additive_grid_search(df, folds, KEYS, "pos", "ts", "value", configs, terms).collect()
    assert {r.config_id for r in search} == {1, 2, 3} and all(r.mean_rmse >= 0 for r in search)


def test_backtest_scores_and_skips_failed_folds(spark, df):
    folds = weekly_folds(lengths(df, KEYS, "pos"), KEYS, "expanding", 30, H)
    naive = fc.backtest(df, folds, lambda a: fc.seasonal_naive(a, KEYS, "pos", "value", M)).collect()
    assert [(r.series_id, r.fold) for r in sorted(naive, key=lambda r: r.fold)] == [("a", 1), ("a", 2)]
    assert all(r.custom_loss >= r.mae for r in naive)
    fc_none = fc.backtest(
        df, folds, lambda a: fc.median_forecast(a, KEYS, "pos", "value").withColumn("y_pred", F.when(F.col("fold") > 1, F.col("y_pred")))
    )
    assert [r.fold for r in fc_none.collect()] == [2]


def test_tree_search_skips_invalid(spark, df):
    rows = df.withColumn("x", F.col("value") * 2).filter("series_id = 'a'")
    folds = fc.last_day_fold(lengths(rows, KEYS, "pos"), KEYS, H)
    a = durable(assign_folds(rows, folds, KEYS, "pos"))
    configs = [{"config_id": 1, "estimator__n_estimators": 2, "max_depth": 2}, {"config_id": 2, "max_depth": 99}]
    scores, best = tree_random_search(a, KEYS, "pos", "value", ["x"], configs)
    assert [r.config_id for r in scores.collect()] == [1] and best.first().config_id == 1
    with pytest.raises(RuntimeError):
        tree_random_search(a, KEYS, "pos", "value", ["x"], configs[1:])


def test_a_part_of_a_horizon_scores_null(spark, assigned, df):
    naive = fc.seasonal_naive(assigned, KEYS, "pos", "value", M)
    part = naive.filter((F.col("series_id") != "a") | (F.col("pos") < N - H + 4))
    scored = {r.series_id: r.custom_loss for r in fc.score_folds(assigned, part, KEYS, "pos", "value").collect()}
    assert scored["a"] is None
    whole = {r.series_id: r.custom_loss for r in fc.score_folds(assigned, naive, KEYS, "pos", "value").collect()}
    assert whole["a"] is not None
    folds = fc.last_day_fold(lengths(df, KEYS, "pos"), KEYS, H)
    models = {"whole": lambda a: naive, "part": lambda a: part}
    both = fc.compare_models(df, folds, models).filter("series_id = 'a'")
    from tidemark.operators.metrics import evaluate, leaderboard

    ranks = {r.model: (r.rank, r.custom_loss) for r in leaderboard(evaluate(both, ["model"])).collect()}
    assert ranks["whole"][0] == 1 and ranks["part"] == (2, None)


def test_search_refits_the_winner_and_falls_back(spark, df):
    from tidemark.operators.trees import predict_trees, search_and_refit

    rows = df.withColumn("x", F.col("value") * 2).filter("series_id = 'a'")
    a = durable(assign_folds(rows, weekly_folds(lengths(rows, KEYS, "pos"), KEYS, "expanding", 30, H), KEYS, "pos"))
    good = {"config_id": 4, "n_estimators": 3, "max_depth": 4}
    configs = [{"config_id": 1, "n_estimators": 1, "max_depth": 1, "learning_rate": 0.01}, good, {"config_id": 2, "max_depth": 99}]
    params, model = search_and_refit(a, rows, KEYS, "pos", "value", ["x"], configs)
    assert params == good
    holes = rows.withColumn("x", F.when(F.col("pos") != 3, F.col("x")))
    told = {r.pos: r.y_pred for r in predict_trees(model, holes, ["x"]).collect()}
    assert len(told) == N and told[3] is None and abs(told[50] - rows.filter("pos = 50").first().value) < 1.5
    saved = {"n_estimators": 1, "max_depth": 1}
    assert search_and_refit(a, rows, KEYS, "pos", "value", ["x"], configs[2:], saved)[0] == saved
    with pytest.raises(RuntimeError):
        search_and_refit(a, rows, KEYS, "pos", "value", ["x"], configs[2:])
