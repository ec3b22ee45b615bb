"""Gradient-boosted trees on lagged features (MLlib), and their random-search cross-validation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

from pyspark import inheritable_thread_target
from pyspark.errors import IllegalArgumentException
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.metrics import best_config, evaluate
from tidemark.operators.scoring import with_actuals

# The search grid. MLlib has no counterpart for reg_lambda, reg_alpha and max_delta_step.
TREE_GRID = {
    "n_estimators": [50, 100, 150, 200],
    "max_depth": [2, 3, 4, 5, 6],
    "learning_rate": [0.005, 0.01, 0.05, 0.1],
    "subsample": [0.6, 0.8, 1.0],
    "colsample_bytree": [0.6, 0.8, 1.0],
    "gamma": [0, 1, 3, 5],
    "reg_lambda": [1, 5, 10, 20],
    "reg_alpha": [0, 1, 5, 10],
    "min_child_weight": [1, 3, 5],
    "max_delta_step": [0, 1, 3],
}


def _regressor(params: dict, label: str, seed: int) -> GBTRegressor:
    get = {k.replace("estimator__", ""): v for k, v in params.items()}.get
    return GBTRegressor(
        featuresCol="_features",
        labelCol=label,
        maxIter=int(get("n_estimators", 50)),
        maxDepth=int(get("max_depth", 4)),
        stepSize=float(get("learning_rate", 0.1)),
        subsamplingRate=float(get("subsample", 1.0)),
        featureSubsetStrategy=str(float(get("colsample_bytree", 1.0))),
        minInfoGain=float(get("gamma", 0.0)),
        minInstancesPerNode=max(1, int(get("min_child_weight", 1))),
        seed=seed,
    )


def fit_trees(
    train: DataFrame, features: Sequence[str], target: str, params: dict, seed: int = 42
) -> GBTRegressionModel:
    """One model pooled over all series. Features are already shifted by the horizon, so a
    prediction needs no recursion."""
    assembled = VectorAssembler(
        inputCols=list(features), outputCol="_features", handleInvalid="skip"
    ).transform(train.filter(F.col(target).isNotNull()))
    return _regressor(params, target, seed).fit(assembled.select("_features", target))


def predict_trees(
    model: GBTRegressionModel, rows: DataFrame, features: Sequence[str]
) -> DataFrame:
    """Every row with ``y_pred``, null where a feature is missing."""
    whole = F.lit(True)
    for f in features:
        whole = whole & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    ready = VectorAssembler(inputCols=list(features), outputCol="_features").transform(rows.filter(whole))
    told = model.transform(ready).withColumnRenamed("prediction", "y_pred").drop("_features")
    return told.unionByName(rows.filter(~whole).withColumn("y_pred", F.lit(None).cast("double")))


def _at_once(spark: SparkSession, tasks: Sequence[Callable], threads: int) -> list:
    """Results of tasks that each run Spark jobs, a bounded number of them side by side, in a pool of their own
    so that a fair scheduler shares the executors between them."""

    def pooled(number: int, task: Callable):
        def run():
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fits-{number % threads}")
            return task()

        return inheritable_thread_target(spark)(run)

    with ThreadPoolExecutor(threads) as pool:
        futures = [pool.submit(pooled(k, task)) for k, task in enumerate(tasks)]
        return [f.result() for f in futures]


def tree_forecast(
    assigned: DataFrame,
    keys: Sequence[str],
    pos: str,
    target: str,
    features: Sequence[str],
    params: dict,
    seed: int = 42,
    threads: int = 4,
) -> DataFrame:
    """Forecasts per (series, fold); one distributed fit per fold number, several at a time."""
    return _forecasts(assigned, keys, pos, target, features, [params], seed, threads)[0]


def _forecasts(assigned, keys, pos, target, features, configs, seed, threads) -> list[DataFrame | None]:
    """Forecasts of every configuration; None for one that MLlib refuses in any fold."""
    by = [*keys, "fold"]
    n_folds = assigned.agg(F.max("fold")).first()[0] or 0

    def fit(params: dict, fold: int):
        rows = assigned.filter(F.col("fold") == fold)
        try:
            model = fit_trees(rows.filter(F.col("part") == "train"), features, target, params, seed)
        except IllegalArgumentException:  # only what MLlib refuses; lost executors still fail
            return None
        return predict_trees(model, rows.filter(F.col("part") == "test"), features).select(*by, pos, "y_pred")

    tasks = [partial(fit, params, fold) for params in configs for fold in range(1, n_folds + 1)]
    done = _at_once(assigned.sparkSession, tasks, threads)
    out: list[DataFrame | None] = []
    for k in range(len(configs)):
        parts = done[k * n_folds : (k + 1) * n_folds]
        out.append(None if None in parts or not parts else reduce(DataFrame.unionByName, parts))
    return out


def tree_random_search(
    assigned: DataFrame,
    keys: Sequence[str],
    pos: str,
    target: str,
    features: Sequence[str],
    configs: Sequence[dict],
    seed: int = 42,
    threads: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """(scores, best): mean composite loss of each configuration over the folds.

    The fits of all configurations and folds share a bounded pool of threads. A configuration MLlib refuses is
    skipped, one with a step that has no forecast scores null."""
    told = _forecasts(assigned, keys, pos, target, features, configs, seed, threads)
    fitted = [(c, f) for c, f in zip(configs, told) if f is not None]
    if not fitted:
        raise RuntimeError("no configuration could be fitted")
    every = reduce(DataFrame.unionByName, [f.withColumn("config_id", F.lit(int(c["config_id"]))) for c, f in fitted])
    whole = with_actuals(assigned, every, keys, pos, target, ["config_id"])
    scored = evaluate(whole, ["config_id", "fold"])
    mean = F.when(F.count("custom_loss") == F.count(F.lit(1)), F.avg("custom_loss"))
    scores = scored.groupBy("config_id").agg(mean.alias("avg_custom_score"), F.count("custom_loss").alias("n_folds"))
    return scores, best_config(scores, [], "avg_custom_score", "config_id")


def search_and_refit(
    assigned: DataFrame,
    train: DataFrame,
    keys: Sequence[str],
    pos: str,
    target: str,
    features: Sequence[str],
    configs: Sequence[dict],
    saved: dict | None = None,
    seed: int = 42,
    threads: int = 4,
) -> tuple[dict, GBTRegressionModel]:
    """The best configuration of the search and a model of it fitted on all of ``train``.

    Where no configuration can be fitted or scored, the ``saved`` parameters of an earlier search are used.
    """
    best = None
    try:
        _, ranked = tree_random_search(assigned, keys, pos, target, features, configs, seed, threads)
        best = ranked.first()
    except RuntimeError:
        if saved is None:
            raise
    if best is None and saved is None:
        raise RuntimeError("no configuration could be scored")
    params = saved if best is None else next(c for c in configs if c["config_id"] == best["config_id"])
    return params, fit_trees(train, features, target, params, seed)
