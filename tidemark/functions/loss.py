"""Forecast-quality measures as aggregate columns.

The composite loss is ``mae + std_weight * std_diff + dev_weight * dev_error``. Every part is a
plain aggregate once each row carries the mean error of its group, because
``(p - mean p) - (t - mean t) = (p - t) - mean(p - t)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: machine epsilon, the smallest denominator of the clamped MAPE.
EPS = 2.220446049250313e-16

METRICS = ["custom_loss", "std_diff", "dev_error", "mae", "mape", "rmse"]


def error(y_true: str = "y_true", y_pred: str = "y_pred") -> Column:
    return F.col(y_pred) - F.col(y_true)


def mae(y_true: str = "y_true", y_pred: str = "y_pred") -> Column:
    return F.avg(F.abs(error(y_true, y_pred)))


def rmse(y_true: str = "y_true", y_pred: str = "y_pred") -> Column:
    e = error(y_true, y_pred)
    return F.sqrt(F.avg(e * e))


def mape_clamped(y_true: str = "y_true", y_pred: str = "y_pred") -> Column:
    e = F.abs(error(y_true, y_pred))
    return F.avg(e / F.greatest(F.abs(F.col(y_true)), F.lit(EPS)))


def mape_plain(y_true: str = "y_true", y_pred: str = "y_pred") -> Column:
    """Null as soon as one actual is zero (the undefined case)."""
    ratio = F.try_divide(F.abs(error(y_true, y_pred)), F.abs(F.col(y_true)))
    undefined = F.max((F.col(y_true) == 0).cast("int")) == 1
    return F.when(~undefined, F.avg(ratio))


def std_diff(y_true: str = "y_true", y_pred: str = "y_pred") -> Column:
    return F.abs(F.stddev_pop(y_pred) - F.stddev_pop(y_true))


def dev_error(mean_error: str, y_true: str = "y_true", y_pred: str = "y_pred") -> Column:
    return F.avg(F.abs(error(y_true, y_pred) - F.col(mean_error)))


def composite(mae_c: Column, std_c: Column, dev_c: Column, std_weight: float, dev_weight: float):
    if std_weight is None or dev_weight is None:
        raise ValueError("std_weight and dev_weight must be numbers")
    return mae_c + F.lit(float(std_weight)) * std_c + F.lit(float(dev_weight)) * dev_c
