"""Forecasters over (series x fold x configuration) tables, back-tests and the leaderboard.

A forecaster is a function of the fold-assigned rows (``assign_folds``) that returns
``(series keys, fold, [config_id,] pos, y_pred)``. Folds and configurations are rows, so
parallelism comes from partitions and not from a driver loop.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.metrics import evaluate
from tidemark.operators.reshape import assign_folds
from tidemark.operators.scoring import with_actuals
from tidemark.plans.chunks import CHUNK, over_halo
from tidemark.plans.gram import gram, key_ddl, matrix, packed, solve
from tidemark.plans.lookup import attach
from tidemark.plans.order import quantiles
from tidemark.session import durable

Forecaster = Callable[[DataFrame], DataFrame]


def _test_rows(assigned: DataFrame) -> DataFrame:
    return assigned.filter(F.col("part") == "test")


def _train_rows(assigned: DataFrame) -> DataFrame:
    return assigned.filter(F.col("part") == "train")


def seasonal_naive(
    assigned: DataFrame, keys: Sequence[str], pos: str, value: str, period: int
) -> DataFrame:
    """The value of the same phase in the last training season."""
    by = [*keys, "fold"]
    ahead = F.col(pos) - F.col("train_end")
    back = F.col(pos) - (F.floor(ahead / period) + 1) * period
    want = _test_rows(assigned).select(*by, pos, back.cast("bigint").alias("_src"))
    have = _train_rows(assigned).select(
        *by, F.col(pos).alias("_src"), F.col(value).alias("y_pred")
    )
    return want.join(have, [*by, "_src"], "left").select(*by, pos, "y_pred")


def median_forecast(
    assigned: DataFrame, keys: Sequence[str], pos: str, value: str
) -> DataFrame:
    """Constant median of the training rows."""
    by = [*keys, "fold"]
    level = quantiles(_train_rows(assigned), by, value, {"y_pred": 0.5})
    return attach(_test_rows(assigned).select(*by, pos), level, by, [pos])


# ---------------------------------------------------------------- seasonal ARMA


def seasonal_arma(
    assigned: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: str,
    period: int,
    chunk: int = CHUNK,
) -> DataFrame:
    """(1,0,1)(1,0,1) with season on log1p, by two-stage least squares.

    Stage one, a long autoregression, gives residuals that stand in for the shocks; stage two
    regresses on value and shock lags {1, m, m+1}. Both fits come from distributed cross products;
    lags are window columns over halo chunks. Only the last m+1 values and shocks of each
    (series, fold) meet for the forecast recursion.
    """
    keys = list(keys)
    by = [*keys, "fold"]
    lags = sorted({1, period, period + 1})
    long_lags = sorted({1, 2, 3, period, period + 1})
    reach = period + 1
    train = _train_rows(assigned).select(
        *by, pos, F.log1p(value).alias("_z"), F.lit(1.0).alias("_one")
    )
    wide = over_halo(
        train,
        by,
        pos,
        lambda w: {f"_z{k}": F.lag("_z", k).over(w) for k in long_lags},
        before=reach,
        chunk=chunk,
    )
    x1 = ["_one", *[f"_z{k}" for k in long_lags]]
    first = _coefficients(gram(wide, by, [*x1, "_z"]), by, len(x1))
    guess = F.lit(0.0)
    for i, c in enumerate(x1):
        guess = guess + F.col("_coef")[i] * F.col(c)
    shocks = attach(wide, first, by, [pos]).withColumn("_e", F.col("_z") - guess).drop("_coef")
    shocks = durable(shocks)
    second = over_halo(
        shocks.select(*by, pos, "_one", "_z", *[f"_z{k}" for k in lags], "_e"),
        by,
        pos,
        lambda w: {f"_e{k}": F.lag("_e", k).over(w) for k in lags},
        before=reach,
        chunk=chunk,
    )
    x2 = ["_one", *[f"_z{k}" for k in lags], *[f"_e{k}" for k in lags]]
    coef = _coefficients(gram(second, by, [*x2, "_z"]), by, len(x2))
    window = assigned.select(*by, "train_end", "test_start", "test_end").distinct()
    tail = (
        attach(shocks.select(*by, pos, "_z", "_e"), window, by, [pos])
        .filter(F.col(pos) >= F.col("train_end") - reach)
        .groupBy(*by, "train_end")
        .agg(
            F.array_sort(F.collect_list(F.struct(pos, "_z", "_e"))).alias("_t"),
            F.max(F.col("test_end") - F.col("test_start")).cast("int").alias("horizon"),
        )
        .join(coef, by)
        .select(
            *by,
            "train_end",
            "horizon",
            F.transform("_t", lambda r: r["_z"]).alias("z"),
            F.transform("_t", lambda r: F.coalesce(r["_e"], F.lit(0.0))).alias("e"),
            F.col("_coef").alias("coef"),
        )
    )
    k = len(lags)

    def roll(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                z, e, c = list(row.z), list(row.e), row.coef
                if len(z) < reach or c is None:
                    continue
                lo, hi = min(z), max(z)
                for _ in range(row.horizon):
                    nxt = c[0]
                    for i, lag in enumerate(lags):
                        nxt += c[1 + i] * z[-lag] + c[1 + k + i] * e[-lag]
                    # keep an explosive fit from leaving the range it was fitted on by far
                    z.append(min(max(nxt, lo - (hi - lo)), hi + (hi - lo)))
                    e.append(0.0)
                out = pd.DataFrame({n: [getattr(row, n)] * row.horizon for n in keys})
                out["fold"] = np.int32(row.fold)
                out[pos] = np.arange(row.train_end, row.train_end + row.horizon)
                out["y_pred"] = np.expm1(z[-row.horizon :])
                yield out

    return tail.mapInPandas(
        roll, f"{key_ddl(assigned, keys)}, fold int, {pos} bigint, y_pred double"
    )


def _coefficients(
    grams: DataFrame, by: Sequence[str], n_x: int, penalty: Sequence[float] | None = None
) -> DataFrame:
    """Solve each group's normal equations; the target is the last column of the Gram matrix."""
    by = list(by)
    ridge = np.asarray(penalty if penalty is not None else 1e-9)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[by].copy()
            out["_coef"] = [
                solve(matrix(np.asarray(g), n_x + 1), range(n_x), n_x, ridge)[0].tolist()
                for g in batch["gram"]
            ]
            yield out

    tables = packed(grams, by)
    return tables.mapInPandas(run, f"{key_ddl(tables, by)}, _coef array<double>")


# ---------------------------------------------------------------- scoring and back-tests


def score_folds(
    assigned: DataFrame,
    forecast: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: str,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Six metrics per (series, fold[, configuration]); null where a step has no forecast."""
    joined = with_actuals(assigned, forecast, keys, pos, value, extra)
    return evaluate(joined, [*keys, "fold", *extra])


def backtest(
    df: DataFrame,
    folds: DataFrame,
    model: Forecaster,
    keys: Sequence[str] = ("series_id",),
    pos: str = "pos",
    value: str = "value",
    chunk: int = CHUNK,
) -> DataFrame:
    """Fit and score one forecaster on every fold; a failed fold is left out."""
    assigned = durable(assign_folds(df, folds, keys, pos, chunk))
    scored = score_folds(assigned, model(assigned), keys, pos, value)
    return scored.filter(F.col("custom_loss").isNotNull())


def compare_models(
    df: DataFrame,
    folds: DataFrame,
    models: dict[str, Forecaster],
    keys: Sequence[str] = ("series_id",),
    pos: str = "pos",
    value: str = "value",
) -> DataFrame:
    """All models' forecasts on the same folds in one table with the actuals.

    The fold-assigned rows are written once; every model and the scoring read that table."""
    assigned = durable(assign_folds(df, folds, keys, pos))
    by = [*keys, "fold", pos]
    tables = None
    for name, model in models.items():
        one = model(assigned).select(*by, "y_pred").withColumn("model", F.lit(name))
        tables = one if tables is None else tables.unionByName(one)
    return with_actuals(assigned, tables, keys, pos, value, ["model"])


def last_day_fold(sizes: DataFrame, keys: Sequence[str], horizon: int) -> DataFrame:
    """A single fold: everything before the last ``horizon`` steps trains, those test."""
    n = F.col("n")
    return sizes.filter(n > horizon).select(
        *keys,
        F.lit(1).alias("fold"),
        F.lit(0).cast("bigint").alias("train_start"),
        (n - horizon).cast("bigint").alias("train_end"),
        (n - horizon).cast("bigint").alias("test_start"),
        n.cast("bigint").alias("test_end"),
    )
