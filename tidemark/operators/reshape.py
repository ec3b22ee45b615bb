"""Wide <-> long, joins on keys, fold ranges, parameter grids."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import require_columns
from tidemark.plans.chunks import CHUNK, chunk_id, null_safe_join


def to_long(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], name="series_id", value="target"
) -> DataFrame:
    """Unpivot; other columns ride along as ids, which saves the join back on time."""
    require_columns(df, [*ids, *values])
    cast = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in values])
    return cast.unpivot(list(ids), list(values), name, value)


def to_wide(
    df: DataFrame, ids: Sequence[str], name: str, value: str, names: Sequence[str]
) -> DataFrame:
    """Pivot to the declared names with plain conditional aggregates (one pass)."""
    return df.groupBy(*ids).agg(
        *[F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names]
    )


def transpose_metrics(df: DataFrame, metrics: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """One-row-per-key metric columns to ``(ids, metric, value)`` rows."""
    return to_long(df, ids, metrics, "metric", "value")


def add_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Append many derived columns in one projection."""
    return df.select("*", *[c.alias(n) for n, c in columns.items()])


def join_features(long: DataFrame, features: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left equi join of features to long rows."""
    return long.join(features, list(on), "left")


def complete_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows where both columns are known (index intersection of the two non-null series)."""
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())


def align_forecast(
    forecast: DataFrame, actual: DataFrame, on: Sequence[str] = ("series_id", "ts")
) -> DataFrame:
    """Forecasts next to actuals by key, never by position."""
    return forecast.join(actual, list(on), "inner")


def compare_forecasts(a: DataFrame, b: DataFrame, series: str | None = None) -> DataFrame:
    """Two models side by side: ``series_id, ts, y_true, y_pred_1, y_pred_2``."""
    need = ["series_id", "ts", "y_true", "y_pred"]
    require_columns(a, need)
    require_columns(b, need)
    if series is not None:
        from tidemark.operators.clean import one_series

        a, b = one_series(a, series), one_series(b, series)
    left = a.select("series_id", "ts", "y_true", F.col("y_pred").alias("y_pred_1"))
    right = b.select("series_id", "ts", F.col("y_pred").alias("y_pred_2"))
    return left.join(right, ["series_id", "ts"], "inner")


def assign_folds(
    df: DataFrame,
    folds: DataFrame,
    keys: Sequence[str],
    pos: str,
    chunk: int = CHUNK,
) -> DataFrame:
    """Rows x folds: each row once per fold that covers it, labelled train or test.

    A range join made an equi join: fold ranges unfold to the chunks of positions they touch, so
    the join key is ``(series, chunk)`` and a long series spreads over many tasks.
    """
    keys = list(keys)
    lo = F.least("train_start", "test_start")
    hi = F.greatest("train_end", "test_end") - 1
    touched = folds.withColumn(
        "_home", F.explode(F.sequence(chunk_id(lo, chunk), chunk_id(hi, chunk)))
    )
    rows = df.withColumn("_home", chunk_id(pos, chunk))
    p = F.col(pos)
    part = F.when((p >= F.col("train_start")) & (p < F.col("train_end")), F.lit("train")).when(
        (p >= F.col("test_start")) & (p < F.col("test_end")), F.lit("test")
    )
    return (
        null_safe_join(rows, touched, [*keys, "_home"])
        .withColumn("part", part)
        .filter(F.col("part").isNotNull())
        .drop("_home")
    )


def parameter_grid(
    spark: SparkSession, options: dict[str, list], schema: str, keep=None
) -> DataFrame:
    """All combinations of a parameter grid as rows with a ``config_id``.

    The grid is literal configuration (tens of rows); ``keep`` filters combinations in Python.
    """
    combos = [dict(zip(options, values, strict=True)) for values in product(*options.values())]
    kept = [c for c in combos if keep is None or keep(c)]
    rows = [(i, *c.values()) for i, c in enumerate(kept)]
    fields = T.StructType().add("config_id", T.IntegerType())
    for field in T.StructType.fromDDL(schema).fields:
        fields = fields.add(field)
    return spark.createDataFrame(rows, fields)


def with_configs(df: DataFrame, configs: DataFrame) -> DataFrame:
    """Every row with every configuration. The grid is held as one literal array and unfolded,
    a narrow step without a join."""
    rows = [r.asDict() for r in configs.collect()]  # literal grid, size fixed by the caller
    dtypes = dict(configs.dtypes)
    lit = F.array(
        *[
            F.struct(*[F.lit(v).cast(dtypes[k]).alias(k) for k, v in r.items()])
            for r in rows
        ]
    )
    return df.withColumn("_cfg", F.explode(lit)).select(*df.columns, "_cfg.*")


def future_grid(
    df: DataFrame, keys: Sequence[str], slot: str, horizon: int
) -> DataFrame:
    """The next ``horizon`` slots after the last one of each series, with ``step`` 1..h."""
    last = df.groupBy(*keys).agg(F.max(slot).alias("_last"))
    return last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).select(
        *keys, "step", (F.col("_last") + F.col("step")).cast("bigint").alias(slot)
    )
