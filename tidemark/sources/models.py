"""Fitted models as versioned tables: saved once, loaded to forecast without the training rows."""

from __future__ import annotations

from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_state(states: DataFrame, path: str, model: str, version: int) -> str:
    """Coefficients or smoothing states of one model family; a version that is there already is an error."""
    target = f"{path}/model={model}/version={version}"
    states.write.mode("error").parquet(target)
    return target


def load_state(spark: SparkSession, path: str, model: str, version: int | None = None) -> DataFrame:
    """The states of a version, the latest by default."""
    every = spark.read.parquet(f"{path}/model={model}")
    wanted = every.select(F.max("version")).first()[0] if version is None else version
    return every.filter(F.col("version") == wanted).drop("version")


def save_trees(model: GBTRegressionModel, path: str, version: int) -> str:
    target = f"{path}/trees/version={version}"
    model.write().save(target)
    return target


def load_trees(path: str, version: int) -> GBTRegressionModel:
    return GBTRegressionModel.load(f"{path}/trees/version={version}")
