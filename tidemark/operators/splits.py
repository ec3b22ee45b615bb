"""Splits, scaling, fold boundaries and encoder/decoder windows.

Folds are rows of boundaries ``(series, fold, train_start, train_end, test_start, test_end)`` on
the integer position axis, half-open; index lists never exist.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import double_columns
from tidemark.plans.chunks import CHUNK, with_halo
from tidemark.plans.lookup import attach

FOLD_COLUMNS = ["fold", "train_start", "train_end", "test_start", "test_end"]

# Columns the scaler leaves alone.
UNSCALED = [
    "target", "time_idx", "hour", "minute", "day_of_week", "month", "series_id", "timestamp",
    "price_USD", "hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos", "month_sin",
    "month_cos", "minute_sin", "minute_cos",
]
UNSCALED_PREFIXES = ["mempool_fee_histogram_bin"]


def split_by_index(df: DataFrame, horizon: int, index: str = "time_idx"):
    """(train, valid): train ends ``horizon`` steps before the last index, valid includes train."""
    top = df.agg(F.max(index).alias("_top"))
    rows = attach(df, top, [], [index])
    train = rows.filter(F.col(index) <= F.col("_top") - horizon).drop("_top")
    valid = rows.filter(F.col(index) <= F.col("_top")).drop("_top")
    return train, valid


def tail_split(df: DataFrame, keys: Sequence[str], pos: str, horizon: int) -> DataFrame:
    """Label the last ``horizon`` steps of each series as test."""
    top = F.max(pos).alias("_top")
    stats = df.groupBy(*keys).agg(top) if keys else df.agg(top)
    label = F.when(F.col(pos) > F.col("_top") - horizon, F.lit("test")).otherwise(F.lit("train"))
    return attach(df, stats, keys, [pos]).withColumn("split", label).drop("_top")


def scaled_columns(df: DataFrame) -> list[str]:
    return double_columns(df, UNSCALED, UNSCALED_PREFIXES)


def standard_scale(
    train: DataFrame, others: Sequence[DataFrame], columns: Sequence[str] | None = None
) -> list[DataFrame]:
    """Z-scores with the mean and population deviation of ``train``; a zero deviation counts 1."""
    columns = list(columns or scaled_columns(train))
    stats = train.agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns],
    )
    out = []
    for df in [train, *others]:
        rows = attach(df, stats, [], columns)
        z = {
            c: (F.col(c) - F.col(f"_m_{c}"))
            / F.when(F.col(f"_s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_s_{c}"))
            for c in columns
        }
        out.append(rows.select(*[z[c].alias(c) if c in z else c for c in df.columns]))
    return out


def min_max_scale(
    df: DataFrame, by: Sequence[str], value: str, lo: float = 1.0, hi: float = 2.0
) -> DataFrame:
    """Scale each group to ``[lo, hi]``, shifted up where that would not be positive. Keeps
    ``scale_min``, ``scale_range`` and ``scale_shift`` for the way back."""
    stats = df.groupBy(*by).agg(F.min(value).alias("scale_min"), F.max(value).alias("_max"))
    span = F.col("_max") - F.col("scale_min")
    stats = stats.select(
        *by,
        "scale_min",
        F.when(span == 0, F.lit(1.0)).otherwise(span).alias("scale_range"),
        F.lit(abs(lo) + 1e-3 if lo <= 0 else 0.0).alias("scale_shift"),
    )
    rows = attach(df, stats, by)
    unit = (F.col(value) - F.col("scale_min")) / F.col("scale_range")
    return rows.withColumn("scaled", unit * F.lit(hi - lo) + F.lit(lo) + F.col("scale_shift"))


def normalise_target(
    train: DataFrame, df: DataFrame, value: str, keys: Sequence[str] = ("series_id",)
) -> DataFrame:
    """Per-series centre and scale from the training rows, kept as columns."""
    keys = list(keys)
    stats = train.groupBy(*keys).agg(
        F.avg(value).alias("target_center"), F.stddev_samp(value).alias("target_scale")
    )
    rows = attach(df, stats, keys)
    return rows.withColumn(
        "target_norm",
        F.try_divide(F.col(value) - F.col("target_center"), F.col("target_scale")),
    )


def lengths(df: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """Number of grid steps per series."""
    return df.groupBy(*keys).agg((F.max(pos) + 1).cast("bigint").alias("n"))


def _unfold(sizes: DataFrame, keys: Sequence[str], first: int, last: Column, edges) -> DataFrame:
    """One row per fold number ``first..last``; series too short for one fold give none."""
    folds = sizes.withColumn("_last", last.cast("int")).filter(F.col("_last") >= first)
    folds = folds.withColumn("_i", F.explode(F.sequence(F.lit(first), F.col("_last"))))
    cols = {k: v.cast("bigint") for k, v in edges(F.col("_i"), F.col("n")).items()}
    number = (F.col("_i") - F.lit(first) + 1).cast("int").alias("fold")
    return folds.select(*keys, number, *[v.alias(k) for k, v in cols.items()])


def weekly_folds(
    sizes: DataFrame, keys: Sequence[str], mode: str, week: int, horizon: int
) -> DataFrame:
    """Weekly back-test folds: ``expanding``, ``sliding`` or ``reverse`` (last day fixed, training
    grows backwards)."""
    n = F.col("n")
    if mode == "expanding":
        return _unfold(
            sizes,
            keys,
            1,
            F.floor((n - horizon) / week),
            lambda i, n: {
                "train_start": F.lit(0),
                "train_end": i * week,
                "test_start": i * week,
                "test_end": i * week + horizon,
            },
        )
    if mode == "sliding":
        return _unfold(
            sizes,
            keys,
            0,
            F.floor((n - week - horizon) / week),
            lambda i, n: {
                "train_start": i * week,
                "train_end": (i + 1) * week,
                "test_start": (i + 1) * week,
                "test_end": (i + 1) * week + horizon,
            },
        )
    if mode == "reverse":
        return _unfold(
            sizes,
            keys,
            1,
            F.floor((n - horizon) / week),
            lambda i, n: {
                "train_start": F.greatest(F.lit(0), n - horizon - i * week),
                "train_end": n - horizon,
                "test_start": n - horizon,
                "test_end": n,
            },
        )
    raise ValueError("mode must be one of reverse, expanding, sliding")


def counted_folds(
    sizes: DataFrame, keys: Sequence[str], n_folds: int, horizon: int
) -> DataFrame:
    """``n_folds`` expanding folds at even spacing."""
    enough = sizes.filter(F.col("n") >= horizon + n_folds + 1)
    spacing = F.floor((F.col("n") - horizon) / (n_folds + 1))
    return _unfold(
        enough,
        keys,
        1,
        F.lit(n_folds),
        lambda i, n: {
            "train_start": F.lit(0),
            "train_end": spacing * i,
            "test_start": spacing * i,
            "test_end": spacing * i + horizon,
        },
    )


def window_folds(
    sizes: DataFrame, keys: Sequence[str], window: int, step: int, horizon: int
) -> DataFrame:
    """Training window of fixed length moved by ``step``."""
    return _unfold(
        sizes,
        keys,
        0,
        F.floor((F.col("n") - window - horizon) / step),
        lambda i, n: {
            "train_start": i * step,
            "train_end": i * step + window,
            "test_start": i * step + window,
            "test_end": i * step + window + horizon,
        },
    )


def rolling_origin_folds(
    sizes: DataFrame, keys: Sequence[str], initial: int, period: int, horizon: int
) -> DataFrame:
    """Cutoffs every ``period`` steps counted back from the end, each with at least ``initial``
    steps of history before it; oldest cutoff is fold 1."""
    last_k = F.floor((F.col("n") - 1 - horizon - initial) / period)

    def edges(i, n):
        cutoff = n - 1 - horizon - (F.floor((n - 1 - horizon - initial) / period) - i) * period
        return {
            "train_start": F.lit(0),
            "train_end": cutoff + 1,
            "test_start": cutoff + 1,
            "test_end": cutoff + 1 + horizon,
        }

    return _unfold(sizes, keys, 0, last_k, edges)


def sample_configs(configs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Repeatable random choice of ``n`` configurations (the search's sampling operator)."""
    return configs.orderBy(F.xxhash64("config_id", F.lit(seed)), "config_id").limit(n)


def encoder_windows(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: str,
    max_encoder: int,
    min_encoder: int,
    horizon: int,
    stride: int = 1,
    covariates: Sequence[str] = (),
    last_only: bool = False,
    chunk: int = CHUNK,
) -> DataFrame:
    """One row per (series, origin): encoder history, decoder future, as arrays.

    The origin is the first decoder step. Rows gather once per chunk, with a halo of one encoder
    and one decoder length, and every window is a slice of its chunk's array, so neither a series
    nor its overlapping windows are shuffled. ``pos`` must be dense. ``last_only`` keeps the final
    window of each series (the validation set) and gathers only the rows it needs.
    """
    keys = list(keys)
    top = df.groupBy(*keys).agg(F.max(pos).alias("_top"))
    rows = attach(df.select(*keys, pos, value, *covariates), top, keys, [pos])
    if last_only:
        rows = rows.filter(F.col(pos) > F.col("_top") - horizon - max_encoder)
    wide, size = with_halo(rows, pos, before=max_encoder, after=horizon - 1, chunk=chunk)
    names = {value: "", **{c: f"_{c}" for c in covariates}}
    packed = (
        wide.groupBy(*keys, "_chunk")
        .agg(
            F.max("_top").alias("_top"),
            F.array_sort(F.collect_list(F.struct(pos, *names))).alias("_rows"),
        )
        .withColumn("_first", F.element_at("_rows", 1)[pos])
    )
    packed = packed.select(
        *keys,
        "_chunk",
        "_top",
        "_first",
        *[F.col("_rows")[c].alias(f"_all{s}") for c, s in names.items()],
    )
    if last_only:
        origins = F.array(F.col("_top") - horizon + 1)
    else:
        begin = F.greatest(F.col("_chunk") * size, F.lit(min_encoder))
        begin = begin + F.pmod(F.lit(min_encoder) - begin, F.lit(stride))
        end = F.least((F.col("_chunk") + 1) * size - 1, F.col("_top") - horizon + 1)
        origins = F.when(begin <= end, F.sequence(begin, end, F.lit(stride).cast("bigint")))
    at = packed.withColumn("origin", F.explode(origins)).filter(
        F.floor(F.col("origin") / size) == F.col("_chunk")
    )
    start = F.greatest(F.col("origin") - max_encoder, F.col("_first"))
    length = F.col("origin") - start
    decoder = F.slice("_all", F.col("origin") - F.col("_first") + 1, F.lit(horizon))
    encoders = [
        F.slice(f"_all{s}", start - F.col("_first") + 1, length).alias(f"encoder{s}")
        for s in names.values()
    ]
    return at.filter((length >= min_encoder) & (F.col("origin") >= F.col("_first"))).select(
        *keys,
        "origin",
        *encoders,
        decoder.alias("decoder"),
        length.cast("int").alias("encoder_length"),
        F.size(decoder).alias("decoder_length"),
    )
