"""Trend, Fourier terms and events on log1p: one model, or a whole grid over many folds, from moments.

No design matrix is ever built from rows. Running sums of products of the seasonal terms with 1, t and t²
are kept at the fold boundaries and at every changepoint; a hinge column max(0, t - c) is t - c on the rows
from c on, so all its products follow from the sums behind c. One pass over the rows serves every fold and
every configuration, and what is stored is linear in the length of a series.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import SEASONAL_TERMS, changepoints, days
from tidemark.operators.rolling import fold_tests, score_fold_forecast
from tidemark.plans.chunks import CHUNK, spread
from tidemark.plans.gram import key_ddl
from tidemark.plans.lookup import attach
from tidemark.plans.order import quantiles
from tidemark.plans.prefix import at_marks, sums_before
from tidemark.session import durable

# The search grid of the additive model.
ADDITIVE_GRID = {
    "changepoint_prior_scale": [0.01, 0.1, 0.3, 0.5],
    "seasonality_prior_scale": [5.0, 10.0, 20.0],
    "seasonality_mode": ["additive", "multiplicative"],
    "changepoint_range": [0.8, 0.9, 0.95],
    "n_changepoints": [25, 50, 100],
}
SPIKE_QUANTILE = 0.9
#: Alternations between trend and season of the multiplicative form.
SWEEPS = 5
#: Numbers a task holds for the running sums of one chunk.
CHUNK_NUMBERS = 8_000_000
FREE = 1e-8


class _Design:
    """Seasonal base (1, Fourier terms, event) and the layout of its moments."""

    def __init__(self, terms: dict[str, tuple[float, int]]):
        self.turns = np.array([2 * math.pi * k / period for period, order in terms.values() for k in range(1, order + 1)])
        self.q = 2 + 2 * len(self.turns)
        self.pairs = np.triu_indices(self.q)
        self.n_pairs = len(self.pairs[0])
        self.size = 3 * self.n_pairs + 2 * self.q

    def base(self, day: np.ndarray, event: np.ndarray) -> np.ndarray:
        angle = day[:, None] * self.turns
        return np.column_stack([np.ones(len(day)), np.sin(angle), np.cos(angle), event])

    def terms(self, at: np.ndarray, columns: dict[str, np.ndarray]) -> np.ndarray:
        with np.errstate(all="ignore"):
            y = np.log1p(columns["_v"])
        b, t = self.base(columns["_day"], columns["_event"]), at[:, None].astype(float)
        whole = (np.isfinite(b).all(axis=1) & np.isfinite(y))[:, None]
        products, targets = b[:, self.pairs[0]] * b[:, self.pairs[1]], b * y[:, None]
        rows = np.hstack([products, products * t, products * t * t, targets, targets * t])
        return np.where(whole, rows, 0.0)


class _Moments:
    """Sums over the rows behind each knot of one fold, on the fold's own time from 0 to 1."""

    def __init__(self, design: _Design, sums: np.ndarray, start: int, span: int):
        self.design = design
        n, q = design.n_pairs, design.q
        behind = sums[-1] - sums  # sums are those before each knot, the last one before the end
        m0, m1, m2 = (behind[:, k * n : (k + 1) * n] for k in range(3))
        y0, y1 = behind[:, 3 * n : 3 * n + q], behind[:, 3 * n + q :]
        self.powers = (m0, (m1 - start * m0) / span, (m2 - 2 * start * m1 + start * start * m0) / span**2)
        self.targets = (y0, (y1 - start * y0) / span)

    def pick(self, rows: np.ndarray, knots: np.ndarray) -> _Moments:
        """Only the given places, which are the knots of a trend."""
        out = object.__new__(_Moments)
        out.design, out.knots = self.design, knots
        out.powers, out.targets = (tuple(a[rows] for a in part) for part in (self.powers, self.targets))
        return out

    @functools.cached_property
    def between(self) -> list[np.ndarray]:
        """The sums over the rows between two knots."""
        return [np.vstack([p[:-1] - p[1:], p[-1:]]) for p in (*self.powers, *self.targets)]

    @functools.cached_property
    def added(self) -> tuple[np.ndarray, np.ndarray]:
        """Normal equations of trend and season side by side."""
        q, knots = self.design.q, self.knots
        powers = [p[:, :q] for p in self.powers]  # pairs (1, b)
        k = len(knots) + 1
        a = np.zeros((k + q - 1, k + q - 1))
        a[:k, :k] = _trend_products(knots, [p[:, 0] for p in powers])
        a[:k, k:] = _hinged(knots, powers[0][:, 1:], powers[1][:, 1:])
        a[k:, :k] = a[:k, k:].T
        a[k:, k:] = self.square(self.powers[0][0])[1:, 1:]
        towards = _hinged(knots, self.targets[0][:, :1], self.targets[1][:, :1]).ravel()
        return a, np.concatenate([towards, self.targets[0][0, 1:]])

    def square(self, row: np.ndarray) -> np.ndarray:
        """Symmetric q x q matrix from pair sums."""
        full = np.zeros((self.design.q, self.design.q))
        full[self.design.pairs] = row
        return full + np.triu(full, 1).T

    def weighted(self, weight: np.ndarray) -> list[np.ndarray]:
        """Sums of t^p w² behind each knot, w the combination of the base by ``weight``."""
        i, j = self.design.pairs
        both = weight[i] * weight[j] * np.where(i == j, 1.0, 2.0)
        return [p @ both for p in self.powers]


def _trend_products(knots: np.ndarray, powers) -> np.ndarray:
    """Products of 1 and the hinges at ``knots`` (the first is 0: time itself), from sums behind them."""
    n0, n1, n2 = powers
    last = np.maximum.outer(np.arange(len(knots)), np.arange(len(knots)))
    inner = n2[last] - np.add.outer(knots, knots) * n1[last] + np.multiply.outer(knots, knots) * n0[last]
    out = np.empty((len(knots) + 1, len(knots) + 1))
    out[1:, 1:] = inner
    out[0, 0] = n0[0]
    out[0, 1:] = out[1:, 0] = n1 - knots * n0
    return out


def _hinged(knots: np.ndarray, s0: np.ndarray, s1: np.ndarray) -> np.ndarray:
    """Products of 1 and the hinges with columns whose sums (times 1 and t) behind the knots are given."""
    return np.vstack([s0[:1], s1 - knots[:, None] * s0])


def _ridge(a: np.ndarray, rhs: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    a = a + np.diag(penalty)
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    try:
        return np.linalg.solve(a / np.outer(scale, scale), rhs / scale) / scale
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a / np.outer(scale, scale), rhs / scale, rcond=1e-12)[0] / scale


def _fit_additive(m: _Moments, trend: np.ndarray, season: float) -> tuple[np.ndarray, np.ndarray]:
    a, rhs = m.added
    coef = _ridge(a, rhs, np.concatenate([trend, np.full(m.design.q - 1, season)]))
    return coef[: len(trend)], coef[len(trend) :]


def _fit_multiplicative(m: _Moments, trend: np.ndarray, season: float) -> tuple[np.ndarray, np.ndarray]:
    """trend (1 + season) by turns: each part is linear while the other stands."""
    q, knots = m.design.q, m.knots
    gamma = np.zeros(q - 1)
    between = m.between
    for _ in range(SWEEPS):
        weight = np.concatenate([[1.0], gamma])
        rhs = _hinged(knots, (m.targets[0] @ weight)[:, None], (m.targets[1] @ weight)[:, None]).ravel()
        beta = _ridge(_trend_products(knots, m.weighted(weight)), rhs, trend)
        # between two knots the trend is level + slope * t
        slope = np.cumsum(beta[1:])
        level = beta[0] - np.cumsum(beta[1:] * knots)
        squares = m.square(level**2 @ between[0] + 2 * (level * slope) @ between[1] + slope**2 @ between[2])
        towards = level @ between[3] + slope @ between[4]
        gamma = _ridge(squares[1:, 1:], towards[1:] - squares[0, 1:], np.full(q - 1, season))
    return beta, gamma


def _shape(config: dict):
    return config["n_changepoints"], config["changepoint_range"]


def additive_fit(
    df: DataFrame,
    folds: DataFrame,
    keys: Sequence[str],
    pos: str,
    ts: str,
    value: str,
    configs: Sequence[dict],
    terms: dict[str, tuple[float, int]] | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """Fitted models per (series, fold, config_id) for all ``configs``: ``knots``, ``trend`` and ``season``.

    The target is log1p of the value. ``additive`` adds trend, season and event effect, ``multiplicative``
    lets season and event scale the trend; both are ridge fits with the configuration's priors. Spikes
    (above the 0.9 quantile of a series' history before its last cut-off) are an event regressor, which is
    0 in the future. Rows without a value count in no sum; a fold without a training row has no model.
    """
    keys, design = list(keys), _Design(terms or SEASONAL_TERMS)
    by = [*keys, "fold"]
    configs = sorted(configs, key=_shape)
    ends = folds.groupBy(*keys).agg(F.max("train_end").alias("_until"))
    history = attach(df.select(*keys, pos, value), ends, keys, [pos], how="inner").filter(F.col(pos) < F.col("_until"))
    level = quantiles(history, keys, value, {"_level": SPIKE_QUANTILE})
    rows = attach(df, level, keys, [pos]).select(
        *keys,
        pos,
        F.col(value).alias("_v"),
        days(ts).alias("_day"),
        F.when(F.col(value) > F.col("_level"), 1.0).otherwise(0.0).alias("_event"),
    )
    shapes = {_shape(c): np.array([0.0, *changepoints(*_shape(c))]) for c in configs}
    places = sorted({0.0, 1.0, *[float(c) for knots in shapes.values() for c in knots]})
    start, end = F.col("train_start"), F.col("train_end")
    marks = folds.filter(end > start).withColumn("_c", F.explode(F.array(*[F.lit(c) for c in places])))
    marks = durable(
        marks.select(*by, "train_start", "train_end", "_c", F.least(F.ceil(start + (end - start) * F.col("_c")), end).alias("x"))
    )
    width = max(256, min(chunk, CHUNK_NUMBERS // design.size))
    sums = sums_before(rows, keys, pos, ["_v", "_day", "_event"], marks, design.terms, design.size, 0, width)
    met = at_marks(marks, keys, durable(sums), {"_s": "x"})
    columns = [*by, "config_id", "train_start", "train_end", "mode", "knots", "trend", "season"]

    def run(key: tuple, fit: pd.DataFrame) -> pd.DataFrame:
        fit = fit.sort_values("_c")
        first, last = int(fit["train_start"].iloc[0]), int(fit["train_end"].iloc[0])
        whole = _Moments(design, np.vstack(fit["_s"].to_list()), first, last - first)
        out = []
        at = fit["_c"].to_numpy()
        for shape, members in groupby(configs if whole.powers[0][0, 0] > 0 else [], key=_shape):
            knots = shapes[shape]
            m = whole.pick(np.searchsorted(at, knots), knots)
            for c in members:
                trend = np.full(len(knots) + 1, 1.0 / c["changepoint_prior_scale"])
                trend[:2] = FREE
                solve = _fit_additive if c["seasonality_mode"] == "additive" else _fit_multiplicative
                beta, gamma = solve(m, trend, 1.0 / c["seasonality_prior_scale"] ** 2)
                known = [None if pd.isna(k) else k for k in key]
                out.append((*known, c["config_id"], first, last, c["seasonality_mode"], knots.tolist(), beta.tolist(), gamma.tolist()))
        return pd.DataFrame(out, columns=columns)

    ddl = (
        f"{key_ddl(df, keys)}, fold int, config_id int, train_start bigint, train_end bigint, mode string, "
        "knots array<double>, trend array<double>, season array<double>"
    )
    return spread(met, *by).groupBy(*by).applyInPandas(run, ddl)


def additive_predict(
    states: DataFrame,
    rows: DataFrame,
    keys: Sequence[str],
    pos: str,
    ts: str,
    terms: dict[str, tuple[float, int]] | None = None,
) -> DataFrame:
    """``(keys, fold, config_id, pos, y_pred)`` of fitted models for ``rows`` (keys, fold, pos, ts)."""
    keys, design = list(keys), _Design(terms or SEASONAL_TERMS)
    by = [*keys, "fold"]
    names = [*by, "config_id", pos, "y_pred"]
    asked = rows.select(*by, F.col(pos).alias("_p"), days(ts).alias("_day"))

    def run(key: tuple, models: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if models.empty or ask.empty:
            return pd.DataFrame(columns=names)
        at = ask["_p"].to_numpy()
        base = design.base(ask["_day"].to_numpy(dtype="float64"), np.zeros(len(ask)))[:, 1:]
        out = []
        for m in models.itertuples(index=False):
            t = (at - m.train_start) / (m.train_end - m.train_start)
            trend = np.column_stack([np.ones(len(t)), np.maximum(0.0, t[:, None] - np.asarray(m.knots))]) @ m.trend
            season = base @ m.season
            with np.errstate(over="ignore"):
                told = np.expm1(trend + season if m.mode == "additive" else trend * (1 + season))
            out.append(pd.DataFrame({"config_id": m.config_id, pos: at, "y_pred": told}))
        out = pd.concat(out)
        for name, k in zip(by, key, strict=True):
            out[name] = None if pd.isna(k) else k
        return out[names]

    ddl = f"{key_ddl(states, keys)}, fold int, config_id int, {pos} bigint, y_pred double"
    return states.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(run, ddl)


def additive_forecast(
    df: DataFrame,
    folds: DataFrame,
    keys: Sequence[str],
    pos: str,
    ts: str,
    value: str,
    configs: Sequence[dict],
    terms: dict[str, tuple[float, int]] | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """Forecasts of ``additive_fit`` models over the test steps of every fold."""
    states = additive_fit(df, folds, keys, pos, ts, value, configs, terms, chunk)
    return additive_predict(states, fold_tests(df, folds, keys, pos, chunk), keys, pos, ts, terms)


def grid_configs(grid: dict[str, list] | None = None) -> list[dict]:
    """All combinations of a grid with a ``config_id``."""
    names, rows = list(grid or ADDITIVE_GRID), [()]
    for values in (grid or ADDITIVE_GRID).values():
        rows = [(*r, v) for r in rows for v in values]
    return [{"config_id": i, **dict(zip(names, r, strict=True))} for i, r in enumerate(rows)]


def additive_grid_search(
    df: DataFrame,
    folds: DataFrame,
    keys: Sequence[str],
    pos: str,
    ts: str,
    value: str,
    configs: Sequence[dict],
    terms=None,
    chunk: int = CHUNK,
) -> DataFrame:
    """Mean RMSE over the folds per (series, config_id), best first; a step without forecast makes it null."""
    forecast = additive_forecast(df, folds, keys, pos, ts, value, configs, terms, chunk)
    scored = score_fold_forecast(df, folds, forecast, keys, pos, value, ["config_id"], chunk)
    mean = scored.groupBy(*keys, "config_id").agg(
        F.avg("rmse").alias("_mean"), F.count("rmse").alias("n_folds"), F.count(F.lit(1)).alias("_all")
    )
    mean_rmse = F.when(F.col("n_folds") == F.col("_all"), F.col("_mean")).alias("mean_rmse")
    return mean.select(*keys, "config_id", mean_rmse, "n_folds").orderBy(
        *keys, F.col("mean_rmse").asc_nulls_last(), "config_id"
    )
