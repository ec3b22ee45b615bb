"""Cleaning: selection, trimming, resampling, gap filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import slot, slot_start
from tidemark.functions.columns import NoDataError, require_columns
from tidemark.functions.histogram import high_bin_columns
from tidemark.plans.chunks import CHUNK, nearest_known
from tidemark.plans.lookup import attach
from tidemark.session import durable


def drop_present(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


def keep_one_of_prefix(df: DataFrame, prefix: str, keep: str) -> DataFrame:
    """Drop the columns of a prefix group except ``keep``."""
    return df.select(*[c for c in df.columns if not c.startswith(prefix) or c == keep])


def epoch_to_timestamp(df: DataFrame, col: str) -> DataFrame:
    """Epoch seconds (integer or floating) to a zone-less timestamp."""
    return df.withColumn(col, F.timestamp_seconds(F.col(col)).cast("timestamp_ntz"))


def _max_pos(df: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    top = F.max(pos).alias("_top")
    stats = df.groupBy(*keys).agg(top) if keys else df.agg(top)
    return attach(df, stats, keys, [pos])


def trim_last(df: DataFrame, keys: Sequence[str], pos: str, k: int) -> DataFrame:
    """Drop the last ``k`` steps of each series."""
    return _max_pos(df, keys, pos).filter(F.col(pos) <= F.col("_top") - k).drop("_top")


def take_last(df: DataFrame, keys: Sequence[str], pos: str, k: int) -> DataFrame:
    """Keep the last ``k`` steps of each series (``keys=[]``: relative to the overall last)."""
    return _max_pos(df, keys, pos).filter(F.col(pos) > F.col("_top") - k).drop("_top")


def drop_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Drop the first row of each series without sorting it."""
    first = F.min(F.struct(*order)).alias("_first")
    stats = df.groupBy(*keys).agg(first) if keys else df.agg(first)
    return attach(df, stats, keys, order).filter(F.struct(*order) > F.col("_first")).drop("_first")


def drop_null_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(subset) if subset else None)


def one_series(df: DataFrame, series: str, key: str = "series_id") -> DataFrame:
    """Rows of one series; an unknown series is an error."""
    require_columns(df, [key])
    out = df.filter(F.col(key) == F.lit(series))
    if out.isEmpty():
        raise NoDataError(f"No data found for {key}={series!r}")
    return out


def sentinel_rows(df: DataFrame, col: str, sentinel: float, keys: Sequence[str]) -> DataFrame:
    """Where the sentinel that stands for a missing value occurs."""
    return df.filter(F.col(col) == F.lit(sentinel)).select(*keys)


def sentinel_to_null(df: DataFrame, col: str, sentinel: float) -> DataFrame:
    return df.withColumn(col, F.when(F.col(col) != F.lit(sentinel), F.col(col)))


def all_zero_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Flag columns whose every row is zero; a null row is not zero."""
    flags = df.agg(
        *[F.bool_and(F.coalesce(F.col(c) == 0.0, F.lit(False))).alias(c) for c in columns]
    )
    return flags.unpivot([], list(columns), "column", "all_zero")


def resample(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    step_seconds: int,
    aggs: dict[str, Column],
) -> DataFrame:
    """Aggregate to fixed bins. Partial aggregation collapses hot series before the shuffle."""
    return df.groupBy(*keys, slot(ts, step_seconds).alias("slot")).agg(
        *[a.alias(n) for n, a in aggs.items()]
    )


def regular_grid(binned: DataFrame, keys: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """Every (series, slot) between the first and the last slot of the whole frame.

    A long grid is unfolded in two steps, chunks then slots, so that a single long series is
    generated by many tasks and never held as one array. ``binned`` is read for its two end slots
    first; pass a written table.
    """
    lo, hi = binned.agg(F.min("slot"), F.max("slot")).first()
    series = binned.select(*keys).distinct()
    if lo is None:
        return series.select(
            *keys, F.lit(0).cast("bigint").alias("slot"), F.lit(0).cast("bigint").alias("pos")
        )
    first_part, last_part = lo // chunk, hi // chunk
    if first_part == last_part:
        slots = F.sequence(F.lit(lo).cast("bigint"), F.lit(hi).cast("bigint"))
        unfolded = series.select(*keys, F.explode(slots).alias("slot"))
    else:
        parts = F.sequence(F.lit(first_part).cast("bigint"), F.lit(last_part).cast("bigint"))
        spread = series.withColumn("_part", F.explode(parts)).repartition(*keys, "_part")
        begin = F.greatest(F.lit(lo).cast("bigint"), F.col("_part") * chunk)
        end = F.least(F.lit(hi).cast("bigint"), F.col("_part") * chunk + F.lit(chunk - 1))
        unfolded = spread.select(*keys, F.explode(F.sequence(begin, end)).alias("slot"))
    slot = F.col("slot").cast("bigint")
    return unfolded.select(*keys, slot.alias("slot"), (slot - F.lit(lo)).cast("bigint").alias("pos"))


def onto_grid(
    binned: DataFrame, keys: Sequence[str], step_seconds: int, chunk: int = CHUNK
) -> DataFrame:
    """Re-index binned series to the regular grid; empty bins are null rows.

    The bins are written once: the span, the list of series and the join all read that small table
    and not the raw rows again.
    """
    binned = durable(binned)
    grid = regular_grid(binned, keys, chunk)
    values = [c for c in binned.columns if c not in (*keys, "slot")]
    return grid.join(binned, [*keys, "slot"], "left").select(
        *keys, "slot", "pos", slot_start("slot", step_seconds).alias("ts"), *values
    )


def interpolate(
    df: DataFrame, keys: Sequence[str], pos: str, columns: Sequence[str], chunk: int = CHUNK
) -> DataFrame:
    """Linear by position inside gaps, last value after the end, null before the start."""
    known = nearest_known(df, keys, pos, columns, chunk)
    filled = {}
    for c in columns:
        p, n = F.col(f"_prev_{c}"), F.col(f"_next_{c}")
        share = (F.col(pos) - p["p"]) / (n["p"] - p["p"])
        filled[c] = (
            F.when(F.col(c).isNotNull(), F.col(c))
            .when(p.isNotNull() & n.isNotNull(), p["v"] + (n["v"] - p["v"]) * share)
            .otherwise(p["v"])
        )
    return known.select(*[filled[c].alias(c) if c in filled else c for c in df.columns])


def clean_series(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    columns: Sequence[str],
    step_seconds: int = 900,
    chunk: int = CHUNK,
) -> DataFrame:
    """Resample to the step, put on the regular grid, interpolate."""
    binned = resample(df, keys, ts, step_seconds, {c: F.avg(c) for c in columns})
    return interpolate(onto_grid(binned, keys, step_seconds, chunk), keys, "pos", columns, chunk)


def clean_snapshots(
    df: DataFrame, ts: str = "timestamp", step_seconds: int = 900, chunk: int = CHUNK
) -> DataFrame:
    """Raw wide snapshots to a regular wide series: drop the high bins and all prices but USD,
    turn the epoch into a timestamp, average per step, interpolate."""
    require_columns(df, [ts])
    df = keep_one_of_prefix(drop_present(df, high_bin_columns()), "price_", "price_USD")
    if dict(df.dtypes)[ts] in ("bigint", "double", "int"):
        df = epoch_to_timestamp(df, ts)
    columns = [c for c in df.columns if c != ts]
    flat = df.withColumn("series_id", F.lit("all"))
    return clean_series(flat, ["series_id"], ts, columns, step_seconds, chunk).drop("series_id")

