"""Additive smoothing of long series as a parallel scan.

Without a product the state of Holt-Winters (level, slope, season) changes by an affine map, s -> A s + b y,
whose matrix depends on the smoothing only. So a stretch of rows acts on any state as A^len s + v, and v is
what the stretch makes of the zero state: chunks of a series find their v side by side, the few maps are
composed along the series, and a second pass runs every chunk from its true state for the errors. The rows of
a long series thus spread over all tasks, and a fold is a composition of stretches it shares with others.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.reshape import assign_folds
from tidemark.plans.chunks import CHUNK, chunk_id, null_safe_join, spread
from tidemark.plans.gram import key_ddl
from tidemark.session import durable


class Form:
    """One additive form with all its candidates as columns; a state is a matrix of numbers x columns."""

    def __init__(self, trend: str | None, seasonal: str | None, period: int, grids: dict[int, np.ndarray]):
        self.trend, self.seasonal, self.period = trend, seasonal, period
        self.ranges, at = {}, 0
        for config, grid in grids.items():
            self.ranges[config] = (at, at + grid.shape[1])
            at += grid.shape[1]
        self.grid = np.hstack(list(grids.values()))
        self.size = 2 + (period if seasonal else 0)
        self.width = at
        self._powers: dict[int, np.ndarray] = {}

    def run(self, state: np.ndarray, y: np.ndarray, times: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """State after the rows ``y`` and the sum of squared one-step errors of every column.

        ``state`` holds the candidates ``times`` over; its season begins with the next step's phase.
        """
        alpha, beta, gamma, phi = np.tile(self.grid, times)
        level, slope, season = state[0], state[1], state[2:].copy()
        sse = np.zeros(state.shape[1])
        for i, obs in enumerate(y):
            base = level + phi * slope if self.trend else level
            if self.seasonal:
                cycle = season[i % self.period]
                guess, inner = base + cycle, obs - cycle
                season[i % self.period] = gamma * (obs - base) + (1 - gamma) * cycle
            else:
                guess, inner = base, obs
            fresh = alpha * inner + (1 - alpha) * base
            if self.trend:
                slope = beta * (fresh - level) + (1 - beta) * phi * slope
            level = fresh
            sse += (obs - guess) ** 2
        if self.seasonal:
            season = np.roll(season, -(len(y) % self.period), axis=0)
        return np.vstack([level, slope, season]), sse

    def first(self, y: np.ndarray) -> np.ndarray:
        """State before the first row, from the first two seasons."""
        m = self.period
        level, after = y[:m].mean(), y[m : 2 * m].mean()
        season = y[:m] - level if self.seasonal else []
        column = np.array([level, (after - level) / m if self.trend else 0.0, *season])
        return np.repeat(column[:, None], self.width, axis=1)

    def matrix(self) -> np.ndarray:
        """A of every candidate: what one step without data makes of the unit states."""
        units = np.repeat(np.eye(self.size)[:, :, None], self.width, axis=2).reshape(self.size, -1)
        # columns are (unit, candidate)
        after, _ = self.run(units, np.zeros(1), self.size)
        return after.reshape(self.size, self.size, self.width).transpose(2, 0, 1)

    def power(self, steps: int) -> np.ndarray:
        if steps not in self._powers:
            self._powers[steps] = np.linalg.matrix_power(self.matrix(), steps)
        return self._powers[steps]

    def carry(self, state: np.ndarray, steps: int, v: np.ndarray) -> np.ndarray:
        """A^steps s + v of every candidate."""
        return np.einsum("cij,jc->ic", self.power(steps), state) + v


def _stretches(at: np.ndarray, edges, start: int) -> list[tuple[int, int, int]]:
    """(position, first row, end row) of the stretches that the edges cut a chunk's rows into."""
    cuts = sorted({start, *edges})
    rows = np.searchsorted(at, [*cuts, np.iinfo(np.int64).max])
    return [(c, int(a), int(b)) for c, a, b in zip(cuts, rows[:-1], rows[1:]) if b > a]


def scan_fit(
    df: DataFrame, folds: DataFrame, keys: Sequence[str], pos: str, value: str, forms: Sequence[Form], chunk: int = CHUNK
) -> DataFrame:
    """Fitted states per (series, fold, config_id) of the additive ``forms``, in the columns of ``smooth_fit``.

    ``folds`` are training windows of at least two seasons that hold a value at every position.
    """
    keys = list(keys)
    by, home = [*keys, "fold"], [*keys, "_home"]
    period = forms[0].period
    folds = folds.select(*by, "train_start", "train_end", (F.col("test_end") - F.col("test_start")).cast("int").alias("horizon"))
    folds = durable(folds)
    rows = df.select(*keys, F.col(pos).alias("_p"), F.col(value).cast("double").alias("_v"))
    rows = durable(rows.withColumn("_home", chunk_id("_p", chunk)))
    edges = folds.select(*keys, F.explode(F.array("train_start", "train_end")).alias("_x")).distinct()
    edges = edges.withColumn("_home", chunk_id("_x", chunk))

    def nothing(key: tuple, part: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        """What every stretch of a chunk makes of the zero state."""
        part = part.sort_values("_p")
        y, out = part["_v"].to_numpy(dtype="float64"), []
        known = [None if pd.isna(k) else k for k in key[:-1]]
        for c, a, b in _stretches(part["_p"].to_numpy(), ask["_x"].tolist(), key[-1] * chunk):
            for f, form in enumerate(forms):
                v, _ = form.run(np.zeros((form.size, form.width)), y[a:b])
                out.append((*known, f, c, b - a, v.ravel().tolist()))
        return pd.DataFrame(out, columns=[*keys, "_form", "_from", "_len", "_v"])

    ddl = f"{key_ddl(df, keys)}, _form int, _from bigint, _len int, _v array<double>"
    maps = spread(rows, *home).groupBy(*home).cogroup(spread(edges, *home).groupBy(*home)).applyInPandas(nothing, ddl)

    head = folds.withColumn("train_end", F.col("train_start") + 2 * period)
    head = head.withColumn("test_start", F.col("train_end")).withColumn("test_end", F.col("train_end"))
    heads = assign_folds(rows.drop("_home"), head, keys, "_p", chunk).groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_p", "_v"))), lambda e: e["_v"]).alias("_head")
    )
    asked = null_safe_join(folds, heads, by)

    def compose(key: tuple, parts: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        """States of every start at every stretch on its way, and of every fold at its cut-off."""
        names = [*keys, "_form", "_start", "_from", "_len", "_state", "fold", "horizon"]
        known, out = [None if pd.isna(k) else k for k in key], []
        for f, mine in parts.sort_values("_from").groupby("_form"):
            form = forms[f]
            steps = list(zip(mine["_from"].tolist(), mine["_len"].tolist(), mine["_v"].tolist()))
            for start, same in ask.groupby("train_start"):
                ends: dict[int, list] = {}
                for r in same.itertuples(index=False):
                    ends.setdefault(r.train_end, []).append((r.fold, r.horizon))
                state, last = form.first(np.asarray(same["_head"].iloc[0], float)), max(ends)
                for c, n, v in steps:
                    if c < start or c >= last:
                        continue
                    out.append((*known, f, start, c, n, state.ravel().tolist(), None, None))
                    state = form.carry(state, n, np.asarray(v).reshape(form.size, form.width))
                    for fold, horizon in ends.get(c + n, []):
                        out.append((*known, f, start, c + n, None, state.ravel().tolist(), fold, horizon))
        told = pd.DataFrame(out, columns=names)
        return told.astype({"fold": "Int32", "horizon": "Int32", "_len": "Int32"})

    ddl = f"{key_ddl(df, keys)}, _form int, _start bigint, _from bigint, _len int, _state array<double>, fold int, horizon int"
    states = durable(maps.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(compose, ddl))
    begun = states.filter("fold is null").withColumn("_home", chunk_id("_from", chunk))

    def errors(key: tuple, part: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        """Sums of squared errors of every stretch from its true states, all starts side by side."""
        part = part.sort_values("_p")
        at, y, out = part["_p"].to_numpy(), part["_v"].to_numpy(dtype="float64"), []
        known = [None if pd.isna(k) else k for k in key[:-1]]
        for (f, c), mine in ask.groupby(["_form", "_from"]):
            form, a = forms[f], int(np.searchsorted(at, c))
            state = np.hstack([np.asarray(s).reshape(form.size, form.width) for s in mine["_state"]])
            _, sse = form.run(state, y[a : a + int(mine["_len"].iloc[0])], len(mine))
            for start, own in zip(mine["_start"].tolist(), np.split(sse, len(mine))):
                out.append((*known, f, start, c, own.tolist()))
        return pd.DataFrame(out, columns=[*keys, "_form", "_start", "_from", "_sse"])

    ddl = f"{key_ddl(df, keys)}, _form int, _start bigint, _from bigint, _sse array<double>"
    sums = spread(rows, *home).groupBy(*home).cogroup(spread(begun, *home).groupBy(*home)).applyInPandas(errors, ddl)

    columns = [
        *by, "config_id", "train_end", "horizon", "trend", "seasonal",
        "alpha", "beta", "gamma", "phi", "level", "slope", "lo", "span", "sse", "season",
    ]

    def pick(key: tuple, parts: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        """The candidate with the least error of every fold and configuration."""
        form, out = forms[key[-2]], []
        known = [None if pd.isna(k) else k for k in key[:-2]]
        parts = parts.sort_values("_from")
        running = np.cumsum(np.vstack(parts["_sse"].to_list()), axis=0)
        for end in ends.itertuples(index=False):
            total = running[np.searchsorted(parts["_from"].to_numpy(), end.at) - 1]
            state = np.asarray(end.state).reshape(form.size, form.width)
            for config, (a, b) in form.ranges.items():
                if not np.isfinite(total[a:b]).any():
                    continue
                best = a + int(np.nanargmin(np.where(np.isfinite(total[a:b]), total[a:b], np.nan)))
                chosen = [*form.grid[:, best].tolist(), *state[:2, best].tolist(), 0.0, 1.0, float(total[best])]
                row = (*known, end.fold, config, end.at, end.horizon, form.trend, form.seasonal)
                out.append((*row, *chosen, state[2:, best].tolist()))
        return pd.DataFrame(out, columns=columns)

    finals = states.filter("fold is not null").select(
        *keys, "_form", "_start", "fold", "horizon", F.col("_from").alias("at"), F.col("_state").alias("state")
    )
    group = [*keys, "_form", "_start"]
    numbers = ", ".join(f"{c} double" for c in columns[-10:-1])
    ddl = (
        f"{key_ddl(df, keys)}, fold int, config_id int, train_end bigint, horizon int, trend string, "
        f"seasonal string, {numbers}, season array<double>"
    )
    return sums.groupBy(*group).cogroup(finals.groupBy(*group)).applyInPandas(pick, ddl)
