"""Forecasts next to the actuals of their folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.chunks import null_safe_join
from tidemark.session import durable


def with_actuals(
    assigned: DataFrame,
    forecast: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: str,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Every test row of every fold, for each value of ``extra`` that the forecasts have, with
    ``y_true`` and ``y_pred``; a step nobody forecast has a null ``y_pred``, so a part of a horizon
    never scores as a whole one.

    The forecasts are written once: scoring reads them more than once, and models must not run again."""
    by, extra = [*keys, "fold", pos], list(extra)
    forecast = durable(forecast.select(*by, *extra, "y_pred"))
    actual = assigned.filter(F.col("part") == "test").select(*by, F.col(value).alias("y_true"))
    if extra:
        # configurations or models: literal lists, unfolded next to each test row
        each = forecast.select(F.collect_set(F.struct(*extra)).alias("_each")).scalar()
        actual = actual.withColumn("_one", F.explode(each))
        actual = actual.select(*by, "y_true", *[F.col(f"_one.{c}").alias(c) for c in extra])
    return null_safe_join(actual, forecast, [*by, *extra], "left")
