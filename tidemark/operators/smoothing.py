"""Holt-Winters smoothing over folds and configurations without gathering a training window.

Forms without a product are fitted by a parallel scan over chunks (``smoothing_scan``). For the others the rows
of a series stream through one task in order, once for each form (trend x season); every fold and every
candidate of the form is a column of the same state arrays, so the history is read once however many folds
hold it, and memory depends on columns and season length, not on the length of the series. A fold joins when
its first two seasons have passed and leaves at its cut-off with the best candidate's state.
"""

from __future__ import annotations

import collections
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.metrics import cv_scores
from tidemark.operators.reshape import parameter_grid, with_configs
from tidemark.operators.rolling import score_fold_forecast
from tidemark.operators.smoothing_scan import Form, scan_fit
from tidemark.plans.chunks import CHUNK, chunk_id, null_safe_join, spread
from tidemark.plans.gram import key_ddl
from tidemark.session import durable


SMOOTHING = {
    "alpha": [0.05, 0.2, 0.5, 0.8],
    "beta": [0.01, 0.1],
    "gamma": [0.05, 0.2],
    "phi": [0.9, 0.98],
}


def hw_configs(spark) -> DataFrame:
    """Trend x seasonal x damped, without damping where there is no trend (15 rows)."""
    return parameter_grid(
        spark,
        {
            "trend": ["add", "mul", None],
            "seasonal": ["add", "mul", None],
            "damped": [True, False],
        },
        "trend string, seasonal string, damped boolean",
        keep=lambda c: not (c["trend"] is None and c["damped"]),
    )


def candidates(trend, seasonal, damped, smoothing) -> np.ndarray:
    axes = [
        smoothing["alpha"],
        smoothing["beta"] if trend else [0.0],
        smoothing["gamma"] if seasonal else [0.0],
        smoothing["phi"] if damped else [1.0],
    ]
    return np.array(np.meshgrid(*axes, indexing="ij")).reshape(4, -1)


def window_extremes(
    df: DataFrame, folds: DataFrame, keys: Sequence[str], pos: str, value: str, chunk: int = CHUNK
) -> DataFrame:
    """``folds`` with ``_lo``, ``_hi`` and ``_whole`` (no position of the training window lacks a value).

    Rows are summed up once per stretch between fold boundaries; folds meet the stretches, not the rows.
    """
    keys = list(keys)
    edges = folds.select(*keys, F.explode(F.array("train_start", "train_end")).alias("_x")).distinct()
    edges = edges.groupBy(*keys, chunk_id("_x", chunk).alias("_home")).agg(F.array_sort(F.collect_set("_x")).alias("_xs"))
    rows = df.select(*keys, F.col(pos).alias("_p"), F.col(value).cast("double").alias("_v"))
    rows = null_safe_join(rows.withColumn("_home", chunk_id("_p", chunk)), edges, [*keys, "_home"], "left")
    cut = F.coalesce(F.array_max(F.filter("_xs", lambda x: x <= F.col("_p"))), F.col("_home") * chunk)
    sound = F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs(F.col("_v")) != float("inf"))
    parts = rows.groupBy(*keys, cut.alias("_from")).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count_if(sound).alias("_n")
    )
    span = F.col("train_end") - F.col("train_start")
    named = durable(parts).withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    inside = (F.col("_from") >= F.col("train_start")) & (F.col("_from") < F.col("train_end"))
    met = folds.join(named, [*same, inside], "left")
    return met.groupBy(*folds.columns).agg(
        F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), (F.coalesce(F.sum("_n"), F.lit(0)) == span).alias("_whole")
    )


#: Numbers of a fitted state besides its season.
NUMBERS = ("alpha", "beta", "gamma", "phi", "level", "slope", "lo", "span", "sse")


class _Stream:
    """State arrays of all folds and candidates of one form along one series."""

    def __init__(self, trend: str | None, seasonal: str | None, m: int, jobs: list[dict]):
        self.trend, self.seasonal, self.m = trend, seasonal, m
        self.scaled = "mul" in (trend, seasonal)
        long = [j for j in jobs if j["usable"] and j["end"] - j["start"] >= 2 * m]
        self.waiting = sorted(long, key=lambda j: j["start"], reverse=True)
        self.past: collections.deque = collections.deque(maxlen=2 * m)
        self.jobs: list[dict] = []
        self.state: dict[str, np.ndarray] = {}
        self.next_change = -1

    def feed(self, t: int, obs: float) -> list[tuple]:
        """The next value; returns fitted values as (job, position, value) where jobs ask for them."""
        if t >= self.next_change:
            self._change(t)
        self.past.append(obs)
        if not self.jobs:
            return []
        guess = self._step(self.state, t, obs)
        return [(j, t, guess[j["at"]]) for j in self.jobs if j["fitted"]]

    def _change(self, t: int) -> None:
        """Let folds in whose first two seasons have just passed, and out at their cut-off."""
        while self.waiting and self.waiting[-1]["start"] + 2 * self.m <= t:
            self._begin(self.waiting.pop())
        done = [j for j in self.jobs if j["end"] <= t]
        if done:
            self._finish(done)
        ends = [j["end"] for j in self.jobs]
        starts = [self.waiting[-1]["start"] + 2 * self.m] if self.waiting else []
        self.next_change = min([*ends, *starts], default=1 << 62)

    def _begin(self, job: dict) -> None:
        m, first = self.m, job["start"]
        y = np.array(self.past)[-2 * m :]
        lo, span = (job["lo"], (job["hi"] - job["lo"]) or 1.0) if self.scaled else (0.0, 1.0)
        if self.scaled:  # ratios need positive data: 1..2 and back
            y = 1.0 + (y - lo) / span
        grid = np.array([job[k] for k in ("alpha", "beta", "gamma", "phi")], float)
        width = grid.shape[1]
        level, after = y[:m].mean(), y[m:].mean()
        slope = 0.0 if self.trend is None else (after - level) / m if self.trend == "add" else (after / level) ** (1.0 / m)
        season = np.zeros((m, width))
        if self.seasonal:
            cycle = y[:m] - level if self.seasonal == "add" else y[:m] / level
            season[(first + np.arange(m)) % m] = cycle[:, None]
        new = {
            "alpha": grid[0], "beta": grid[1], "gamma": grid[2], "phi": grid[3],
            "level": np.full(width, level), "slope": np.full(width, slope), "season": season,
            "sse": np.zeros(width), "lo": np.full(width, lo), "span": np.full(width, span),
        }
        job["early"] = []
        for k, obs in enumerate(list(self.past)[-2 * m :]):
            guess = self._step(new, first + k, obs)
            if job["fitted"]:
                job["early"].append((first + k, guess[0]))
        held = sum(j["width"] for j in self.jobs)
        job["at"], job["width"] = held, width
        self.jobs.append(job)
        self.state = {k: np.concatenate([self.state[k], v], axis=-1) for k, v in new.items()} if held else new

    def _step(self, s: dict[str, np.ndarray], t: int, obs: float) -> np.ndarray:
        """One observation in all columns; returns the one-step forecasts on the original scale."""
        y = 1.0 + (obs - s["lo"]) / s["span"] if self.scaled else obs
        level, slope, phi = s["level"], s["slope"], s["phi"]
        base = level + phi * slope if self.trend == "add" else level * slope**phi if self.trend else level
        phase = t % self.m
        if self.seasonal == "add":
            season = s["season"][phase]
            guess, inner, fresh = base + season, y - season, y - base
        elif self.seasonal:
            season = s["season"][phase]
            guess, inner, fresh = base * season, y / season, y / base
        else:
            guess, inner = base, y
        new = s["alpha"] * inner + (1 - s["alpha"]) * base
        if self.trend == "add":
            s["slope"] = s["beta"] * (new - level) + (1 - s["beta"]) * phi * slope
        elif self.trend:
            s["slope"] = s["beta"] * (new / level) + (1 - s["beta"]) * slope**phi
        if self.seasonal:
            s["season"][phase] = s["gamma"] * fresh + (1 - s["gamma"]) * season
        s["level"] = new
        s["sse"] = s["sse"] + (y - guess) ** 2
        return (guess - 1.0) * s["span"] + s["lo"] if self.scaled else guess

    def _finish(self, done: list[dict]) -> None:
        s, m = self.state, self.m
        for job in done:
            cols = slice(job["at"], job["at"] + job["width"])
            sse = s["sse"][cols]
            if not np.isfinite(sse).any():
                continue
            best = job["at"] + int(np.nanargmin(np.where(np.isfinite(sse), sse, np.nan)))
            state = {k: float(s[k][best]) for k in ("alpha", "beta", "gamma", "phi", "level", "slope", "lo", "span", "sse")}
            state["sse"] *= state["span"] ** 2
            # the season from the first step after the cut-off on
            state["season"] = s["season"][(job["end"] + np.arange(m)) % m, best].tolist() if self.seasonal else []
            job["state"] = state
        stay = [j for j in self.jobs if j not in done]
        keep = np.concatenate([np.arange(j["at"], j["at"] + j["width"]) for j in stay]) if stay else np.zeros(0, int)
        self.state = {k: v[..., keep] for k, v in s.items()}
        at = 0
        for j in stay:
            j["at"], at = at, at + j["width"]
        self.jobs = stay

    def close(self, t: int) -> None:
        """After the last value, at position ``t - 1``."""
        if t >= self.next_change:
            self._change(t)


def _jobs_and_rows(df, jobs, keys, pos, value, chunk) -> DataFrame:
    """One table of two kinds of rows, jobs (fold x configuration) ahead of values, for every form in use."""
    keys = list(keys)
    text = lambda c: F.coalesce(F.col(c), F.lit("none"))
    job = F.struct(
        "fold", "config_id", F.col("train_start").alias("start"), F.col("train_end").alias("end"),
        (F.col("test_end") - F.col("test_start")).cast("int").alias("horizon"),
        F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col("_whole").alias("usable"),
        "alpha", "beta", "gamma", "phi",
    )
    jobs = jobs.select(*keys, F.concat_ws(" ", text("trend"), text("seasonal")).alias("_form"), job.alias("_job"))
    jobs = durable(jobs)
    forms = jobs.groupBy(*keys).agg(F.collect_set("_form").alias("_forms"))
    rows = df.select(*keys, F.col(pos).alias("_p"), F.col(value).cast("double").alias("_v"))
    rows = null_safe_join(rows, forms, keys).withColumn("_form", F.explode("_forms")).drop("_forms")
    nothing = F.lit(None).cast(jobs.schema["_job"].dataType)
    rows = rows.select(*keys, "_form", "_p", "_v", nothing.alias("_job"))
    heads = jobs.select(*keys, "_form", F.lit(None).cast("bigint").alias("_p"), F.lit(None).cast("double").alias("_v"), "_job")
    both = spread(heads.unionByName(rows), *keys, "_form")
    return both.sortWithinPartitions(*keys, "_form", F.col("_p").asc_nulls_first())


def _run(streamed: DataFrame, keys: Sequence[str], pos: str, period: int, fitted: bool) -> DataFrame:
    keys = list(keys)
    by = [*keys, "_form"]

    def told(key: tuple, job: dict) -> pd.DataFrame:
        known = dict(zip(keys, key[:-1]))
        trend, seasonal = (None if x == "none" else x for x in key[-1].split(" "))
        row = {**known, "fold": job["fold"], "config_id": job["config_id"], "train_end": job["end"], "horizon": job["horizon"]}
        row |= {"trend": trend, "seasonal": seasonal}
        return pd.DataFrame([row | (job.get("state") or dict.fromkeys((*NUMBERS, "season")))])

    def seen(key: tuple, points: list[tuple]) -> pd.DataFrame:
        out = {k: [v] * len(points) for k, v in zip(keys, key)}
        out |= {"fold": [j["fold"] for j, _, _ in points], "config_id": [j["config_id"] for j, _, _ in points]}
        out |= {pos: [t for _, t, _ in points], "fitted": [float(v) for _, _, v in points]}
        return pd.DataFrame(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, jobs, stream, last, points = None, [], None, -1, []

        def start():
            nonlocal stream
            trend, seasonal = (None if x == "none" else x for x in key[-1].split(" "))
            stream = _Stream(trend, seasonal, period, jobs)

        def drain():
            nonlocal points
            if fitted and points:
                yield seen(key[:-1], points)
                points = []

        def finish():
            if key is None:
                return
            if stream is None:
                start()
            with np.errstate(all="ignore"):
                stream.close(last + 1)
            if fitted:
                # the first two seasons were replayed when a fold joined
                points.extend((j, t, v) for j in jobs for t, v in j.get("early", []))
                yield from drain()
            else:
                for job in jobs:
                    yield told(key, job)

        for batch in batches:
            names = batch[by].astype(object).where(batch[by].notna(), None)
            columns = [names[c].tolist() for c in by]
            for *this, p, v, job in zip(*columns, batch["_p"].tolist(), batch["_v"].tolist(), batch["_job"].tolist()):
                this = tuple(this)
                if this != key:
                    yield from finish()
                    key, jobs, stream, last, points = this, [], None, -1, []
                if job is not None:
                    job = job if isinstance(job, dict) else job.asDict()
                    whole = {k: int(job[k]) for k in ("fold", "config_id", "start", "end", "horizon")}
                    jobs.append({**job, **whole, "fitted": fitted})
                    continue
                if stream is None:
                    start()
                last = int(p)
                with np.errstate(all="ignore"):
                    points.extend(stream.feed(last, v))
                if len(points) > 50_000:
                    yield from drain()
        yield from finish()

    if fitted:
        return streamed.mapInPandas(run, f"{key_ddl(streamed, keys)}, fold int, config_id int, {pos} bigint, fitted double")
    numbers = ", ".join(f"{c} double" for c in NUMBERS)
    return streamed.mapInPandas(
        run,
        f"{key_ddl(streamed, keys)}, fold int, config_id int, train_end bigint, horizon int, trend string, "
        f"seasonal string, {numbers}, season array<double>",
    )


def _with_candidates(configs: DataFrame, smoothing: dict[str, list[float]]) -> DataFrame:
    rows = []
    for r in configs.collect():  # a literal grid
        grid = candidates(r["trend"], r["seasonal"], r["damped"], smoothing).tolist()
        rows.append((r["config_id"], r["trend"], r["seasonal"], r["damped"], *grid))
    arrays = ", ".join(f"{c} array<double>" for c in ("alpha", "beta", "gamma", "phi"))
    return configs.sparkSession.createDataFrame(
        rows, f"config_id int, trend string, seasonal string, damped boolean, {arrays}"
    )


def _additive_forms(configs: DataFrame, period: int, smoothing: dict[str, list[float]]) -> list[Form]:
    """The forms without a product, each with the candidates of its configurations."""
    grids: dict[tuple, dict[int, np.ndarray]] = {}
    for r in configs.orderBy("config_id").collect():  # a literal grid
        grid = candidates(r["trend"], r["seasonal"], r["damped"], smoothing)
        grids.setdefault((r["trend"], r["seasonal"]), {})[r["config_id"]] = grid
    return [Form(trend, seasonal, period, g) for (trend, seasonal), g in grids.items()]


def smooth_fit(
    df: DataFrame,
    folds: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: str,
    period: int,
    configs: DataFrame,
    smoothing: dict[str, list[float]] | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """Fitted states per (series, fold, config_id): level, slope and season at the cut-off, the smoothing chosen
    by in-sample error, that error, and the scale of forms with a product.

    A window shorter than two seasons, or with a position that lacks a value, gives a row of nulls. Null keys
    are keys like any other; an empty table gives no rows.
    """
    keys, smoothing = list(keys), smoothing or SMOOTHING
    windows = durable(window_extremes(df, folds, keys, pos, value, chunk))
    product = F.coalesce(F.col("trend") == "mul", F.lit(False)) | F.coalesce(F.col("seasonal") == "mul", F.lit(False))
    streamed, forms = configs.filter(product), _additive_forms(configs.filter(~product), period, smoothing)
    out = None
    if not streamed.isEmpty():
        jobs = with_configs(windows, _with_candidates(streamed, smoothing))
        out = _run(_jobs_and_rows(df, jobs, keys, pos, value, chunk), keys, pos, period, False)
    if forms:
        long = windows.filter(F.col("_whole") & (F.col("train_end") - F.col("train_start") >= 2 * period))
        told = scan_fit(df, long, keys, pos, value, forms, chunk)
        # windows without a fit keep a row of nulls
        every = with_configs(windows, configs.filter(~product)).select(
            *keys, "fold", "config_id", "train_end",
            (F.col("test_end") - F.col("test_start")).cast("int").alias("horizon"), "trend", "seasonal",
        )
        fitted = told.drop("train_end", "horizon", "trend", "seasonal")
        told = null_safe_join(every, fitted, [*keys, "fold", "config_id"], "left")
        out = told if out is None else out.unionByName(told)
    return out


def smooth_forecast(states: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """``(keys, fold, config_id, pos, y_pred)`` for the ``horizon`` steps after each state's ``train_end``; null
    where there is no state or a step is not finite."""
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                steps = np.arange(1, row.horizon + 1)
                told = np.full(row.horizon, np.nan)
                if row.season is not None:
                    damp = np.cumsum(row.phi**steps)
                    with np.errstate(all="ignore"):
                        told = np.full(row.horizon, row.level)
                        if row.trend == "add":
                            told = told + damp * row.slope
                        elif row.trend:
                            told = told * row.slope**damp
                        if row.seasonal:
                            cycle = np.asarray(row.season)[(steps - 1) % len(row.season)]
                            told = told + cycle if row.seasonal == "add" else told * cycle
                        if "mul" in (row.trend, row.seasonal):
                            told = (told - 1.0) * row.span + row.lo
                out = pd.DataFrame({k: [getattr(row, k)] * row.horizon for k in (*keys, "fold", "config_id")})
                out[pos] = np.arange(row.train_end, row.train_end + row.horizon)
                out["y_pred"] = told if np.isfinite(told).all() else np.nan
                yield out

    ddl = f"{key_ddl(states, keys)}, fold int, config_id int, {pos} bigint, y_pred double"
    return states.mapInPandas(run, ddl).withColumn("y_pred", F.nanvl("y_pred", F.lit(None)))


def smooth_folds(
    df: DataFrame,
    folds: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: str,
    period: int,
    configs: DataFrame,
    smoothing: dict[str, list[float]] | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """Forecasts of ``smooth_fit`` states over the test steps of every fold, null where a window has no fit."""
    return smooth_forecast(smooth_fit(df, folds, keys, pos, value, period, configs, smoothing, chunk), keys, pos)


def smooth_fitted(
    df: DataFrame,
    folds: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: str,
    period: int,
    configs: DataFrame,
    smoothing: dict[str, list[float]] | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """In-sample one-step forecasts ``fitted`` and residuals of every fold's training window.

    A first pass picks the smoothing, a second one streams the rows with it.
    """
    keys = list(keys)
    by = [*keys, "fold"]
    best = smooth_fit(df, folds, keys, pos, value, period, configs, smoothing, chunk).filter("season is not null")
    best = best.select(*by, "config_id", "trend", "seasonal", *[F.array(c).alias(c) for c in ("alpha", "beta", "gamma", "phi")])
    jobs = null_safe_join(window_extremes(df, folds, keys, pos, value, chunk), best, by)
    told = _run(_jobs_and_rows(df, jobs, keys, pos, value, chunk), keys, pos, period, True)
    rows = df.select(*keys, pos, F.col(value).cast("double").alias("_v"))
    return null_safe_join(told, rows, [*keys, pos]).select(
        *by, "config_id", pos, "fitted", (F.col("_v") - F.col("fitted")).alias("resid")
    )


def smooth_cv(
    df: DataFrame,
    folds: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: str,
    period: int,
    configs: DataFrame,
    smoothing: dict[str, list[float]] | None = None,
) -> DataFrame:
    """Every configuration on every fold, averaged per (series, configuration), best first."""
    forecast = smooth_folds(df, folds, keys, pos, value, period, configs, smoothing)
    scored = score_fold_forecast(df, folds, forecast, keys, pos, value, ["config_id"])
    ranking = cv_scores(scored, [*keys, "config_id"])
    return ranking.join(configs, "config_id").orderBy(*keys, "avg_custom_score", "config_id")
