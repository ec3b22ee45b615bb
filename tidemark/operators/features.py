"""Lag, shift, rolling, calendar and supervised-matrix features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import cyclic, micros, time_index
from tidemark.functions.columns import require_columns
from tidemark.functions.histogram import HISTOGRAM_PREFIX
from tidemark.operators.clean import drop_null_rows, trim_last
from tidemark.operators.reshape import to_long
from tidemark.plans.chunks import CHUNK, over_halo, row_numbers
from tidemark.plans.lookup import attach
from tidemark.plans.order import over_rows

WEEK_SECONDS = 7 * 86_400

# The five fee tiers that become separate series.
FEE_COLUMNS = [
    "recommended_fee_fastestFee",
    "recommended_fee_hourFee",
    "recommended_fee_halfHourFee",
    "recommended_fee_economyFee",
    "recommended_fee_minimumFee",
]


def lag_features(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    target: str,
    lags: Sequence[int],
    chunk: int = CHUNK,
) -> DataFrame:
    """``{target}_lag_{k}`` for every lag, in one pass; nulls at the start stay."""
    return over_halo(
        df,
        keys,
        pos,
        lambda w: {f"{target}_lag_{k}": F.lag(target, k).over(w) for k in lags},
        before=max(lags),
        chunk=chunk,
    )


def shift_features(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    features: Sequence[str],
    steps: int,
    chunk: int = CHUNK,
) -> DataFrame:
    """Every feature as it was ``steps`` earlier; the first ``steps`` rows of a series go away."""
    shifted = over_halo(
        df,
        keys,
        pos,
        lambda w: {
            **{f: F.lag(f, steps).over(w) for f in features},
            "_has": F.lag(F.lit(1), steps).over(w),
        },
        before=steps,
        chunk=chunk,
    )
    return shifted.filter(F.col("_has") == 1).drop("_has").select(*df.columns)


def time_since_previous(
    df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str] = (), out: str = "gap_us"
) -> DataFrame:
    """Microseconds since the previous row of the same series."""
    order = [ts, *tie]
    return over_rows(
        df, keys, order, lambda w: {out: micros(ts) - F.lag(micros(ts)).over(w)}, before=1
    )


def days_since_previous(df: DataFrame, keys: Sequence[str], day: str, out: str) -> DataFrame:
    return over_rows(
        df, keys, [day], lambda w: {out: F.datediff(F.col(day), F.lag(day).over(w))}, before=1
    )


def rolling_stats(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: str,
    window: int,
    chunk: int = CHUNK,
) -> DataFrame:
    """Trailing mean and sample deviation over ``window`` rows; null until the window is full."""

    def make(w):
        frame = w.rowsBetween(-(window - 1), 0)
        full = F.count(value).over(frame) == window
        return {
            "roll_mean": F.when(full, F.avg(value).over(frame)),
            "roll_std": F.when(full, F.stddev_samp(value).over(frame)),
        }

    return over_halo(df, keys, pos, make, before=window - 1, chunk=chunk)


def rolling_stats_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, window: int
) -> DataFrame:
    """The same over raw, irregular rows."""

    def make(w):
        frame = w.rowsBetween(-(window - 1), 0)
        full = F.count(value).over(frame) == window
        return {
            "roll_mean": F.when(full, F.avg(value).over(frame)),
            "roll_std": F.when(full, F.stddev_samp(value).over(frame)),
        }

    return over_rows(df, keys, order, make, before=window - 1)


def centered_average(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: str,
    period: int,
    out: str = "trend",
    chunk: int = CHUNK,
) -> DataFrame:
    """Centred moving average; an even period gives half weight to both ends."""
    half = period // 2

    def make(w):
        frame = w.rowsBetween(-half, half)
        total = F.sum(value).over(frame)
        width = 2 * half + 1
        if period % 2 == 0:
            edges = F.lag(value, half).over(w) + F.lead(value, half).over(w)
            total = total - edges / 2.0
        return {out: F.when(F.count(value).over(frame) == width, total / F.lit(float(period)))}

    return over_halo(df, keys, pos, make, before=half, after=half, chunk=chunk)


def week_index(df: DataFrame, ts: str, keys: Sequence[str] = (), out: str = "week") -> DataFrame:
    """Elapsed week since the first instant, from 1."""
    keys = list(keys)
    first = F.min(micros(ts)).alias("_t0")
    stats = df.groupBy(*keys).agg(first) if keys else df.agg(first)
    with_start = attach(df, stats, keys, [ts])
    week = F.floor((micros(ts) - F.col("_t0")) / F.lit(WEEK_SECONDS * 1_000_000)) + 1
    return with_start.withColumn(out, week.cast("bigint")).drop("_t0")


def fee_features(
    df: DataFrame,
    targets: Sequence[str] = tuple(FEE_COLUMNS),
    ts: str = "timestamp",
    reference: str = "2025-03-05 02:00:00",
    step_seconds: int = 900,
) -> DataFrame:
    """Wide regular frame to the long multi-series feature table: targets unpivoted with all other
    columns as covariates, time index, cyclic calendar, log1p of the histogram bins."""
    require_columns(df, [*targets, ts])
    if not dict(df.dtypes)[ts].startswith("timestamp"):
        raise ValueError(f"{ts} must be a timestamp column")
    index = time_index(ts, reference, step_seconds)
    covariates = [c for c in df.columns if c not in targets and c != ts]
    long = to_long(df, [ts, *covariates], targets)
    kept = [
        F.log1p(F.col(c)).alias(c) if c.startswith(HISTOGRAM_PREFIX) else F.col(c)
        for c in covariates
    ]
    return long.select(
        ts,
        "series_id",
        "target",
        *kept,
        index.alias("time_idx"),
        *[v.alias(k) for k, v in cyclic(ts).items()],
    )


def supervised_matrix(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    target: str,
    lags: Sequence[int],
    horizon: int,
    trim: int | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """Features for direct forecasting ``horizon`` steps ahead: drop incomplete rows, add target
    lags, trim the held-back tail, shift every feature by the horizon, label train / test.

    Lags, trimming and shifts count the rows that are left, so gaps change nothing but ``pos``."""
    complete = row_numbers(drop_null_rows(df), keys, pos, "_row", chunk)
    lagged = lag_features(complete, keys, "_row", target, lags, chunk)
    trimmed = trim_last(lagged, keys, "_row", horizon if trim is None else trim)
    features = [
        c
        for c, t in trimmed.dtypes
        if c not in (*keys, pos, "_row", target) and t in ("double", "float", "bigint", "int")
    ]
    shifted = shift_features(trimmed, keys, "_row", features, horizon, chunk)
    top = shifted.groupBy(*keys).agg(F.max("_row").alias("_top"))
    split = F.when(F.col("_row") > F.col("_top") - horizon, F.lit("test")).otherwise(F.lit("train"))
    return attach(shifted, top, keys, [pos]).withColumn("split", split).drop("_top", "_row")
