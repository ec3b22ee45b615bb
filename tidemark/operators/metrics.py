"""Scoring forecasts and ranking models and configurations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import loss
from tidemark.functions.columns import require_columns
from tidemark.operators.reshape import to_wide, transpose_metrics
from tidemark.plans.lookup import attach, attach_agg


def _scored_rows(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Only the needed columns, and which of them tell the rows of one group apart."""
    require_columns(df, [*by, "y_true", "y_pred"])
    apart = [c for c in ("pos", "slot", "ts", "step") if c in df.columns and c not in by][:1]
    return df.select(*by, *apart, "y_true", "y_pred"), [*apart, "y_true", "y_pred"]


def _with_mean_error(df: DataFrame, by: Sequence[str]) -> DataFrame:
    rows, apart = _scored_rows(df, by)
    means = F.avg(loss.error()).alias("_me")
    stats = rows.groupBy(*by).agg(means) if by else rows.agg(means)
    return attach(rows, stats, by, apart)


def evaluate(
    df: DataFrame,
    by: Sequence[str],
    std_weight: float = 1.0,
    dev_weight: float = 1.0,
    digits: int | None = None,
) -> DataFrame:
    """Six metrics per group. A group with a missing actual or forecast scores null, the table
    form of two arrays of unequal length."""
    by = list(by)
    rows = _with_mean_error(df, by)
    aggs = [
        loss.std_diff().alias("std_diff"),
        loss.dev_error("_me").alias("dev_error"),
        loss.mae().alias("mae"),
        loss.mape_clamped().alias("mape"),
        loss.rmse().alias("rmse"),
        F.count_if(F.col("y_true").isNull() | F.col("y_pred").isNull()).alias("_holes"),
    ]
    scored = rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)
    total = loss.composite(
        F.col("mae"), F.col("std_diff"), F.col("dev_error"), std_weight, dev_weight
    )
    scored = scored.withColumn("custom_loss", total)
    out = []
    for m in loss.METRICS:
        c = F.when(F.col("_holes") == 0, F.col(m))
        out.append((F.bround(c, digits) if digits is not None else c).alias(m))
    return scored.select(*by, *out)


def per_series_metrics(df: DataFrame, key: str = "series_id") -> DataFrame:
    """MAE, RMSE, plain MAPE and composite loss per series, best first."""
    rows = _with_mean_error(df, [key])
    scored = rows.groupBy(key).agg(
        loss.mae().alias("MAE"),
        loss.rmse().alias("RMSE"),
        loss.mape_plain().alias("MAPE"),
        loss.std_diff().alias("_sd"),
        loss.dev_error("_me").alias("_dev"),
    )
    total = loss.composite(F.col("MAE"), F.col("_sd"), F.col("_dev"), 1.0, 1.0)
    return (
        scored.withColumn("custom_loss", total).drop("_sd", "_dev").orderBy("custom_loss", key)
    )


def deviation_errors(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Element-wise deviation error of every forecast row."""
    require_columns(df, [*by, "y_true", "y_pred"])
    rows = attach_agg(df, by, None, F.avg(loss.error()).alias("_me"))
    return rows.withColumn("dev_error", F.abs(loss.error() - F.col("_me"))).drop("_me")


def training_loss(
    df: DataFrame,
    by: Sequence[str],
    std_weight: float = 1.0,
    dev_weight: float = 1.0,
    clip_std: float | None = 10.0,
    clip_dev: float | None = 10.0,
) -> DataFrame:
    """Adaptive window loss: penalties weighted by how small they are next to the base error, the
    weights clipped; mean over the window's steps. Sample deviations."""
    by = list(by)
    tiny = F.lit(1e-8)
    stats = df.groupBy(*by).agg(
        F.avg(loss.error()).alias("_me"),
        F.avg(F.abs(loss.error())).alias("_mae"),
        F.abs(F.stddev_samp("y_pred") - F.stddev_samp("y_true")).alias("_sp"),
    )
    rows, apart = _scored_rows(df, by)
    rows = attach(rows, stats, by, apart)

    def clipped(w, limit):
        return w if limit is None else F.least(w, F.lit(float(limit)))

    base = F.abs(loss.error())
    dev = F.abs(loss.error() - F.col("_me"))
    w_std = clipped(F.col("_mae") / (F.col("_sp") + tiny), clip_std)
    w_dev = clipped(base / (dev + tiny), clip_dev)
    total = base + std_weight * w_std * F.col("_sp") + dev_weight * w_dev * dev
    return rows.groupBy(*by).agg(F.avg(total).alias("loss"))


def cv_scores(
    fold_metrics: DataFrame, config: Sequence[str], fold: str = "fold"
) -> DataFrame:
    """Mean score of each configuration; one with any failed (null) fold is dropped."""
    return (
        fold_metrics.groupBy(*config)
        .agg(
            F.avg("mae").alias("avg_mae"),
            F.avg("mape").alias("avg_mape"),
            F.avg("rmse").alias("avg_rmse"),
            F.avg("std_diff").alias("avg_std_penalty"),
            F.avg("dev_error").alias("avg_dev_error"),
            F.avg("custom_loss").alias("avg_custom_score"),
            F.count(F.lit(1)).alias("_all"),
            F.count("custom_loss").alias("_ok"),
        )
        .filter(F.col("_all") == F.col("_ok"))
        .drop("_all", "_ok")
    )


def best_config(scores: DataFrame, keys: Sequence[str], score: str, config: str) -> DataFrame:
    """Lowest score per series; the smaller configuration id wins a tie."""
    best = F.min_by(F.struct(config, score), F.struct(score, config)).alias("_b")
    out = scores.filter(F.col(score).isNotNull())
    out = out.groupBy(*keys).agg(best) if keys else out.agg(best)
    return out.select(*keys, f"_b.{config}", f"_b.{score}")


def metric_matrix(scores: DataFrame, models: Sequence[str], metrics=None) -> DataFrame:
    """Metric x model matrix from one row per model."""
    long = transpose_metrics(scores, metrics or loss.METRICS, ["model"])
    return to_wide(long, ["metric"], "model", "value", models)


def leaderboard(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Models ranked by composite loss with the three headline metrics. One row per model."""
    w = Window.partitionBy(*keys).orderBy(F.col("custom_loss").asc_nulls_last())
    return scores.select(
        *keys,
        "model",
        "custom_loss",
        "std_diff",
        "rmse",
        F.rank().over(w).cast("int").alias("rank"),
    )


def improvement(
    scores: DataFrame, baselines: Sequence[str], metric: str = "custom_loss"
) -> DataFrame:
    """Percent by which each model beats the best of the baseline models."""
    base = scores.filter(F.col("model").isin(*baselines)).agg(F.min(metric).alias("_base"))
    out = attach(scores.select("model", metric), base, [], ["model"])
    gain = F.try_divide(F.lit(100.0) * (F.col("_base") - F.col(metric)), F.col("_base"))
    return out.withColumn("improvement_pct", gain).drop("_base")
