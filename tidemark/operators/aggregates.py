"""Descriptive aggregates: resample sweeps, describe, quantiles, shares, histograms, KDE, boxes."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import slot
from tidemark.functions.histogram import HISTOGRAM_PREFIX, bin_label, bin_labels, bin_start
from tidemark.operators.features import time_since_previous
from tidemark.plans.chunks import null_safe_join
from tidemark.plans.lookup import attach
from tidemark.plans.order import quantiles, value_counts
from tidemark.session import durable

# Sampling steps of the resample sweep, in seconds.
SWEEP_SECONDS = [300, 600, 900, 1200, 1800, 3600]


def resample_sweep(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    steps: Sequence[int] = tuple(SWEEP_SECONDS),
) -> DataFrame:
    """Bin means at several steps in one job.

    Sums and counts are first collapsed to the greatest common step; only those partial bins are
    unfolded to the coarser steps, so raw rows shuffle once and are never multiplied.
    """
    keys = list(keys)
    base = math.gcd(*steps)
    fine = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, slot(ts, base).alias("_fine"))
        .agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    )
    wide = fine.withColumn("step", F.explode(F.array(*[F.lit(s) for s in steps])))
    return (
        wide.groupBy(
            *keys,
            "step",
            F.floor(F.col("_fine") * F.lit(base) / F.col("step")).cast("bigint").alias("slot"),
        )
        .agg((F.sum("_s") / F.sum("_c")).alias(value))
    )


def describe(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles, max per column (and group), one row per column."""
    keys = list(keys)
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        keys, list(columns), "column", "x"
    )
    by = [*keys, "column"]
    moments = long.groupBy(*by).agg(
        F.count("x").alias("count"),
        F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
    )
    quart = quantiles(long, by, "x", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return moments.join(quart, by, "left")


def group_moments(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def peak_levels(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, median and upper quantiles per series."""
    qs = {"median": 0.5, "q90": 0.9, "q95": 0.95, "q99": 0.99}
    means = df.groupBy(*keys).agg(F.avg(value).alias("mean"))
    return means.join(quantiles(df, keys, value, qs), list(keys))


def above_group_quantile(
    df: DataFrame, by: Sequence[str], value: str, q: float, flag: str = "spike"
) -> DataFrame:
    """Flag rows above their own group's quantile."""
    levels = quantiles(df, by, value, {"_level": q})
    return (
        attach(df, levels, by)
        .withColumn(flag, F.coalesce(F.col(value) > F.col("_level"), F.lit(False)))
        .drop("_level")
    )


def bin_totals(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Totals per histogram column, their share in percent, the running share by bin start, and
    log1p of the totals. After the first aggregate only one row per column is left."""
    sums = df.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).cast("double").alias(c) for c in columns])
    long = sums.unpivot([], list(columns), "bin", "total").withColumn(
        "start", bin_start(F.col("bin"))
    )
    every = Window.partitionBy()
    upto = Window.orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum("total").over(every)
    return long.select(
        "bin",
        "start",
        "total",
        F.try_divide(F.lit(100.0) * F.col("total"), whole).alias("share"),
        F.try_divide(F.lit(100.0) * F.sum("total").over(upto), whole).alias("cum_share"),
        F.log1p("total").alias("log_total"),
    )


def equal_width_histogram(
    df: DataFrame, keys: Sequence[str], value: str, bins: int | str = 30
) -> DataFrame:
    """Equal-width counts with the right edge closed and empty bins present.

    ``bins="auto"`` takes the larger of the Sturges and Freedman-Diaconis bin counts per series.
    """
    keys = list(keys)
    # equal values are counted first, so a value that fills a third of the rows is one row here
    counted = durable(value_counts(df, keys, value))
    stats = counted.groupBy(*keys).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum("_w").alias("_n")
    )
    if bins == "auto":
        q = quantiles(df, keys, value, {"_q1": 0.25, "_q3": 0.75})
        stats = stats.join(q, keys)
        span = F.col("_hi") - F.col("_lo")
        sturges = span / (F.log2(F.col("_n").cast("double")) + 1)
        fd = 2.0 * (F.col("_q3") - F.col("_q1")) / F.pow(F.col("_n").cast("double"), F.lit(1 / 3))
        width = F.when(fd > 0, F.least(fd, sturges)).otherwise(sturges)
        count = F.coalesce(F.ceil(F.try_divide(span, width)), F.lit(1))
        stats = stats.withColumn("_k", F.greatest(count, F.lit(1)).cast("int")).drop("_q1", "_q3")
    else:
        stats = stats.withColumn("_k", F.lit(int(bins)))
    stats = stats.withColumn("_width", (F.col("_hi") - F.col("_lo")) / F.col("_k"))
    raw_bin = F.coalesce(
        F.floor(F.try_divide(F.col(value) - F.col("_lo"), F.col("_width"))), F.lit(0)
    )
    placed = attach(counted, stats, keys, [value]).withColumn(
        "bin", F.least(raw_bin, F.col("_k") - 1).cast("int")
    )
    counts = placed.groupBy(*keys, "bin").agg(F.sum("_w").alias("n"))
    frame = stats.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    return frame.join(counts, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        (F.col("_lo") + F.col("_width") * F.col("bin")).alias("left_edge"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def kde_curve(
    df: DataFrame, keys: Sequence[str], value: str, points: int = 200
) -> DataFrame:
    """Gaussian kernel density (Scott bandwidth) on an even grid from minimum to maximum.

    Equal values are merged first. Each task adds its values' kernels into one vector of
    ``points`` sums per series and ships only those; a second aggregate adds the vectors.
    """
    keys = list(keys)
    stats = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(
            F.min(value).alias("_lo"),
            F.max(value).alias("_hi"),
            F.count(value).alias("_n"),
            F.stddev_samp(value).alias("_sd"),
        )
        .filter(F.col("_sd") > 0)
        .withColumn("_bw", F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    )
    weighted = attach(value_counts(df, keys, value), stats, keys, [value], how="inner")
    first = {k: df.schema[k].dataType.simpleString() for k in keys}
    schema = ", ".join([*[f"{k} {t}" for k, t in first.items()], "point int, part double"])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, g in batch.groupby(keys, sort=False, dropna=False):
                key = [None if pd.isna(k) else k for k in key]
                lo, hi, bw = g["_lo"].iloc[0], g["_hi"].iloc[0], g["_bw"].iloc[0]
                grid = np.linspace(lo, hi, points)
                z = (grid[:, None] - g[value].to_numpy()[None, :]) / bw
                total = np.exp(-0.5 * z * z) @ g["_w"].to_numpy()
                yield pd.DataFrame(
                    {
                        **dict(zip(keys, key, strict=True)),
                        "point": np.arange(points, dtype="int32"),
                        "part": total,
                    }
                )

    sums = (
        weighted.select(*keys, value, "_w", "_lo", "_hi", "_bw")
        .mapInPandas(partial, schema)
        .groupBy(*keys, "point")
        .agg(F.sum("part").alias("_sum"))
    )
    norm = F.col("_n") * F.col("_bw") * F.lit(math.sqrt(2 * math.pi))
    at = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("point") / F.lit(points - 1)
    return null_safe_join(sums, stats, keys).select(
        *keys, "point", at.alias("x"), (F.col("_sum") / norm).alias("density")
    )


def box_stats(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whiskers at the last values within 1.5 IQR, number of outliers."""
    by = list(by)
    q = quantiles(df, by, value, {"q1": 0.25, "med": 0.5, "q3": 0.75})
    v = F.col(value)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    return (
        attach(value_counts(df, by, value), q, by, [value])
        .groupBy(*by)
        .agg(
            F.max("q1").alias("q1"),
            F.max("med").alias("med"),
            F.max("q3").alias("q3"),
            F.min(F.when(inside, v)).alias("whisker_lo"),
            F.max(F.when(inside, v)).alias("whisker_hi"),
            F.sum(F.when(~inside, F.col("_w")).otherwise(0)).alias("n_outliers"),
        )
    )


def modal_gap(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str] = ()) -> DataFrame:
    """First and last instant and the most frequent sampling interval (every tied value a row)."""
    keys = list(keys)
    gaps = time_since_previous(df, keys, ts, tie, "gap_us").filter(F.col("gap_us").isNotNull())
    counts = gaps.groupBy(*keys, "gap_us").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*keys).agg(F.max("n").alias("_top"))
    span = df.groupBy(*keys).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    return (
        attach(counts, best, keys, ["gap_us"])
        .filter(F.col("n") == F.col("_top"))
        .drop("_top")
        .join(span, keys)
    )


def sample_median(
    df: DataFrame, keys: Sequence[str], value: str, out: str = "y_pred"
) -> DataFrame:
    """Median over sample paths per (series, step)."""
    return quantiles(df, keys, value, {out: 0.5})


def fee_histogram(
    df: DataFrame, keys: Sequence[str], fee: str, count: str
) -> DataFrame:
    """Fee/count rows to one column per histogram bin; bins without rows are 0."""
    labels = bin_labels()
    binned = df.select(*keys, bin_label(F.col(fee)).alias("_bin"), F.col(count).alias("_c"))
    small = binned.groupBy(*keys, "_bin").agg(F.sum("_c").cast("double").alias("_c"))
    return small.groupBy(*keys).agg(
        *[
            F.sum(F.when(F.col("_bin") == b, F.col("_c")).otherwise(0.0)).alias(
                HISTOGRAM_PREFIX + b
            )
            for b in labels
        ]
    )
