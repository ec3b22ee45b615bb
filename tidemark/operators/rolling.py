"""Back-tests that read a series once, however many folds hold a row.

``assign_folds`` copies the history into every fold, which is quadratic in the length of a series for
expanding and reverse folds. The forecasters here take the rows and the fold boundaries apart: fits come
from running sums at the boundaries (``plans.prefix``), and only test rows and the last seasons before a
cut-off are copied.
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
from tidemark.plans.chunks import CHUNK, null_safe_join
from tidemark.plans.gram import key_ddl, matrix, solve
from tidemark.plans.prefix import at_marks, lag_by_position, pair_terms, sums_before
from tidemark.session import durable

#: A forecaster of rows and fold boundaries: ``(keys, fold, pos, y_pred)``.
FoldForecaster = Callable[[DataFrame, DataFrame], DataFrame]


def fold_tests(
    df: DataFrame, folds: DataFrame, keys: Sequence[str], pos: str, chunk: int = CHUNK
) -> DataFrame:
    """The test rows of every fold, in the shape of ``assign_folds`` without training rows."""
    start = F.col("test_start")
    return assign_folds(
        df, folds.withColumn("train_start", start).withColumn("train_end", start), keys, pos, chunk
    )


def fold_tails(
    df: DataFrame, folds: DataFrame, keys: Sequence[str], pos: str, steps: int, chunk: int = CHUNK
) -> DataFrame:
    """The last ``steps`` training positions of every fold."""
    end = F.col("train_end")
    cut = folds.withColumn("train_start", F.greatest(F.col("train_start"), end - steps))
    cut = cut.withColumn("test_start", end).withColumn("test_end", end)
    return assign_folds(df, cut, keys, pos, chunk)


def naive_folds(
    df: DataFrame, folds: DataFrame, keys: Sequence[str], pos: str, value: str, period: int, chunk: int = CHUNK
) -> DataFrame:
    """The value of the same phase in the last training season."""
    by = [*keys, "fold"]
    tests = fold_tests(df, folds.withColumn("_end", F.col("train_end")), keys, pos, chunk)
    back = F.col(pos) - (F.floor((F.col(pos) - F.col("_end")) / period) + 1) * period
    tails = fold_tails(df, folds, keys, pos, period, chunk)
    have = tails.select(*by, F.col(pos).alias("_src"), F.col(value).alias("y_pred"))
    want = tests.select(*by, pos, back.cast("bigint").alias("_src"))
    return null_safe_join(want, have, [*by, "_src"], "left").select(*by, pos, "y_pred")


# ---------------------------------------------------------------- seasonal ARMA


def reflections(ar: np.ndarray) -> np.ndarray:
    """Reflection coefficients of x_t = sum ar_k x_{t-k}, last first; all inside (-1, 1) if it is stable."""
    out, a = [], np.asarray(ar, float)
    while len(a):
        k = a[-1]
        out.append(k)
        if abs(k) >= 1:
            break
        a = (a[:-1] + k * a[-2::-1]) / (1 - k * k)
    return np.array(out)


def stable(ar: np.ndarray, margin: float = 1e-6) -> np.ndarray:
    """``ar`` with its roots drawn in (lag k times r^k) by the largest r that makes it stable."""
    lags = np.arange(1, len(ar) + 1)
    inside = lambda r: (np.abs(reflections(ar * r**lags)) < 1 - margin).all()
    if inside(1.0):
        return ar
    low, high = 0.0, 1.0
    for _ in range(40):
        middle = (low + high) / 2
        low, high = (middle, high) if inside(middle) else (low, middle)
    return ar * low**lags


class _Arma:
    """Lags and moment layout of the (1,0,1)(1,0,1) model with one season."""

    def __init__(self, period: int, keep_stable: bool):
        self.keep_stable = keep_stable
        self.reach = period + 1
        self.lags = sorted({1, period, period + 1})
        self.long = sorted({1, 2, 3, period, period + 1})
        # a lagged shock is a combination of values, so its products follow from products of values
        self.far = sorted({0, *self.lags} | {j + k for j in self.lags for k in (0, *self.long)})
        self.pairs = [np.triu_indices(n) for n in (len(self.long) + 2, len(self.far) + 1)]
        self.sizes = [len(i) for i, _ in self.pairs]

    def terms(self, at: np.ndarray, columns: dict[str, np.ndarray]) -> np.ndarray:
        with np.errstate(all="ignore"):
            z = np.log1p(columns["_v"])
        one = np.ones(len(z))
        lag = {k: lag_by_position(at, z, k) if k else z for k in {0, *self.long, *self.far}}
        near = np.column_stack([one, *[lag[k] for k in self.long], z])
        wide = np.column_stack([one, *[lag[k] for k in self.far]])
        return np.hstack([pair_terms(near, self.pairs[0]), pair_terms(wide, self.pairs[1])])

    def fit(self, first: np.ndarray, second: np.ndarray):
        """Coefficients of the long autoregression and of the model, None without rows."""
        p, q = len(self.long) + 1, len(self.lags)
        g = matrix(first, p + 1)
        h = matrix(second, len(self.far) + 1)
        if g[0, 0] <= 0 or h[0, 0] <= 0:
            return None
        auto, _ = solve(g, range(p), p, 1e-9)
        place = {k: 1 + i for i, k in enumerate(self.far)}
        turn = np.zeros((2 * q + 2, len(h)))
        turn[0, 0] = turn[-1, place[0]] = 1
        for i, k in enumerate(self.lags):
            turn[1 + i, place[k]] = 1
            turn[1 + q + i, place[k]] += 1
            turn[1 + q + i, 0] -= auto[0]
            for j, c in zip(self.long, auto[1:]):
                turn[1 + q + i, place[k + j]] -= c
        model, _ = solve(turn @ h @ turn.T, range(2 * q + 1), 2 * q + 1, 1e-9)
        ar = np.zeros(self.reach)
        ar[np.array(self.lags) - 1] = model[1 : 1 + q]
        drawn = stable(ar) if self.keep_stable else ar
        # the mean stays where the training values have it
        model[0] += (ar.sum() - drawn.sum()) * g[0, -1] / g[0, 0]
        model[1 : 1 + q] = drawn[np.array(self.lags) - 1]
        return auto, model

    def forecast(self, tail: np.ndarray, start: int, end: int, auto, model, horizon: int) -> np.ndarray:
        """``tail``: values of the positions before ``end``; the model starts at ``start``."""
        q, first = len(self.lags), end - len(tail)
        shocks = []
        for t in range(max(start + self.reach, end - self.reach), end):
            x = [1.0, *[tail[t - k - first] for k in self.long]]
            shocks.append(tail[t - first] - float(np.dot(auto, x)))
        e = [0.0] * (self.reach - len(shocks)) + [0.0 if np.isnan(s) else s for s in shocks]
        z = tail.tolist()
        for _ in range(horizon):
            z.append(
                model[0]
                + sum(model[1 + i] * z[-k] + model[1 + q + i] * e[-k] for i, k in enumerate(self.lags))
            )
            e.append(0.0)
        with np.errstate(all="ignore"):
            return np.expm1(np.array(z[len(tail) :]))


def arma_fit(
    df: DataFrame,
    folds: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: str,
    period: int,
    chunk: int = CHUNK,
    keep_stable: bool = True,
) -> DataFrame:
    """Fitted (1,0,1)(1,0,1) models with season on log1p, by two-stage least squares, of every fold at once.

    Stage one, a long autoregression, gives residuals that stand in for the shocks; stage two regresses on
    value and shock lags {1, m, m+1}. Shocks are linear in the values, so the second stage's cross products
    follow from products of values too, and both are differences of running sums at the fold's boundaries.
    With ``keep_stable`` autoregressive parts outside the stable region are drawn into it. A fold without a
    whole row for the fit, or shorter than a season and a step, has no row.

    A row holds all a forecast needs: ``auto`` and ``model`` (coefficients) and ``tail`` (the last values of
    the transformed series up to ``train_end``, null where one is missing).
    """
    keys, arma = list(keys), _Arma(period, keep_stable)
    by, reach = [*keys, "fold"], arma.reach
    start, end = F.col("train_start"), F.col("train_end")
    ranges = folds.select(
        *by,
        "train_start",
        "train_end",
        (F.col("test_end") - F.col("test_start")).cast("int").alias("horizon"),
        F.least(start + reach, end).alias("_near"),
        F.least(start + 2 * reach, end).alias("_far"),
    ).filter(end - start >= reach)
    ranges = durable(ranges)
    marks = ranges.select(*keys, F.explode(F.array("train_end", "_near", "_far")).alias("x"))
    rows = df.select(*keys, pos, F.col(value).alias("_v"))
    sums = sums_before(rows, keys, pos, ["_v"], marks, arma.terms, sum(arma.sizes), 2 * reach, chunk)
    fits = at_marks(ranges, keys, durable(sums), {"_s_end": "train_end", "_s_near": "_near", "_s_far": "_far"})
    tails = fold_tails(rows, ranges.withColumn("test_start", end).withColumn("test_end", end), keys, pos, 2 * reach, chunk)
    entry = F.struct(F.col(pos).alias("p"), F.log1p("_v").alias("z"))
    tails = tails.groupBy(*by).agg(F.collect_list(entry).alias("_e"))
    cut = arma.sizes[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                top = np.asarray(row.s_end)
                fit = arma.fit((top - np.asarray(row.s_near))[:cut], (top - np.asarray(row.s_far))[cut:])
                if fit is None:
                    continue
                tail: list[float | None] = [None] * min(2 * reach, row.train_end - row.train_start)
                for p, z in zip(row.at, row.z):
                    tail[p - (row.train_end - len(tail))] = None if z is None or np.isnan(z) else float(z)
                known = [getattr(row, k) for k in (*by, "train_start", "train_end", "horizon")]
                out.append((*known, *(c.tolist() for c in fit), tail))
            names = [*by, "train_start", "train_end", "horizon", "auto", "model", "tail"]
            yield pd.DataFrame(out, columns=names)

    ready = null_safe_join(fits, tails, by).select(
        *by,
        "train_start",
        "train_end",
        "horizon",
        F.col("_s_end").alias("s_end"),
        F.col("_s_near").alias("s_near"),
        F.col("_s_far").alias("s_far"),
        F.transform("_e", lambda e: e["p"]).alias("at"),
        F.transform("_e", lambda e: e["z"]).alias("z"),
    )
    ddl = (
        f"{key_ddl(df, keys)}, fold int, train_start bigint, train_end bigint, horizon int, "
        "auto array<double>, model array<double>, tail array<double>"
    )
    return ready.mapInPandas(run, ddl)


def arma_forecast(states: DataFrame, keys: Sequence[str], pos: str, period: int) -> DataFrame:
    """``(keys, fold, pos, y_pred)`` for the ``horizon`` steps after each fitted model's ``train_end``.

    A missing value among the last ones it needs gives null forecasts.
    """
    keys, arma = list(keys), _Arma(period, True)
    by = [*keys, "fold"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                out = pd.DataFrame({k: [getattr(row, k)] * row.horizon for k in by})
                out[pos] = np.arange(row.train_end, row.train_end + row.horizon)
                tail = np.array([np.nan if z is None else z for z in row.tail])
                told = arma.forecast(tail, row.train_start, row.train_end, row.auto, row.model, row.horizon)
                out["y_pred"] = np.where(np.isfinite(told), told, np.nan)
                yield out

    ddl = f"{key_ddl(states, keys)}, fold int, {pos} bigint, y_pred double"
    return states.mapInPandas(run, ddl).withColumn("y_pred", F.nanvl("y_pred", F.lit(None)))


def arma_folds(
    df: DataFrame,
    folds: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: str,
    period: int,
    chunk: int = CHUNK,
    keep_stable: bool = True,
) -> DataFrame:
    """Forecasts of ``arma_fit`` models over the test steps of every fold."""
    return arma_forecast(arma_fit(df, folds, keys, pos, value, period, chunk, keep_stable), keys, pos, period)


# ---------------------------------------------------------------- scoring


def score_fold_forecast(
    df: DataFrame,
    folds: DataFrame,
    forecast: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: str,
    extra: Sequence[str] = (),
    chunk: int = CHUNK,
) -> DataFrame:
    """Six metrics per (series, fold[, configuration]); null where a step has no forecast."""
    tests = durable(fold_tests(df, folds, keys, pos, chunk).select(*keys, "fold", pos, "part", value))
    return evaluate(with_actuals(tests, forecast, keys, pos, value, extra), [*keys, "fold", *extra])


def backtest_folds(
    df: DataFrame,
    folds: DataFrame,
    model: FoldForecaster,
    keys: Sequence[str] = ("series_id",),
    pos: str = "pos",
    value: str = "value",
    chunk: int = CHUNK,
) -> DataFrame:
    """Fit and score one forecaster on every fold; a failed fold is left out."""
    scored = score_fold_forecast(df, folds, model(df, folds), keys, pos, value, (), chunk)
    return scored.filter(F.col("custom_loss").isNotNull())


def compare_fold_models(
    df: DataFrame,
    folds: DataFrame,
    models: dict[str, FoldForecaster],
    keys: Sequence[str] = ("series_id",),
    pos: str = "pos",
    value: str = "value",
) -> DataFrame:
    """All models' forecasts on the same folds in one table with the actuals."""
    by = [*keys, "fold", pos]
    tables = None
    for name, model in models.items():
        one = model(df, folds).select(*by, "y_pred").withColumn("model", F.lit(name))
        tables = one if tables is None else tables.unionByName(one)
    tests = durable(fold_tests(df, folds, keys, pos).select(*by, "part", value))
    return with_actuals(tests, tables, keys, pos, value, ["model"])
