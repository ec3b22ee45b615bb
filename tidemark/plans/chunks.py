"""Windows over one long series.

A series on a regular grid has a dense integer position. Cutting it in chunks of consecutive
positions and copying only the edge rows ("halo") a frame reaches for lets a single series use
the whole cluster: rows shuffle by ``(keys, chunk)`` and no task ever sorts a whole series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


CHUNK = 16384


def chunk_id(pos: str | Column, chunk: int) -> Column:
    p = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(p / F.lit(chunk)).cast("bigint")


def with_halo(
    df: DataFrame, pos: str, before: int = 0, after: int = 0, chunk: int = CHUNK
) -> tuple[DataFrame, int]:
    """Add ``_home`` (own chunk) and ``_chunk`` (chunk this copy serves)."""
    size = max(chunk, 4 * (before + after), 1)
    df = df.withColumn("_home", chunk_id(pos, size))
    if before == 0 and after == 0:
        return df.withColumn("_chunk", F.col("_home")), size
    lo = chunk_id(F.col(pos) - F.lit(after), size)
    hi = chunk_id(F.col(pos) + F.lit(before), size)
    return df.withColumn("_chunk", F.explode(F.sequence(lo, hi))), size


def over_halo(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    make: Callable[[WindowSpec], dict[str, Column]],
    before: int = 0,
    after: int = 0,
    chunk: int = CHUNK,
) -> DataFrame:
    """Add columns computed over a window that looks ``before``/``after`` rows around each row.

    ``pos`` must be dense inside each series. ``make`` gets the window spec and returns the new
    columns; all share one exchange and one sort and are added in a single projection.
    """
    wide, _ = with_halo(df, pos, before, after, chunk)
    spec = Window.partitionBy(*keys, "_chunk").orderBy(pos)
    added = make(spec)
    keep = [c for c in df.columns if c not in added]
    return (
        wide.select(*keep, "_home", "_chunk", *[v.alias(k) for k, v in added.items()])
        .filter(F.col("_home") == F.col("_chunk"))
        .drop("_home", "_chunk")
    )


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt by columns over all shuffle partitions. Small tables whose rows are costly to work on would
    otherwise be merged into few tasks by their bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def null_safe_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join by columns of both sides where null meets null, as in a grouping; ``on`` appears once."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in on})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in on]
    return left.join(named, same, how).drop(*[f"_right_{k}" for k in on])


def running_sum(
    df: DataFrame, keys: Sequence[str], pos: str, value: Column, out: str, chunk: int = CHUNK
) -> DataFrame:
    """Inclusive running total: inside each chunk, plus the totals of earlier chunks."""
    keys = list(keys)
    rows = df.withColumn("_home", chunk_id(pos, chunk)).withColumn("_v", value)
    totals = rows.groupBy(*keys, "_home").agg(F.sum("_v").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_home").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_home", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = (
        Window.partitionBy(*keys, "_home").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        rows.withColumn(out, F.sum("_v").over(inside))
        .join(offsets, [*keys, "_home"], "left")
        .withColumn(out, F.col(out) + F.col("_offset"))
        .drop("_home", "_v", "_offset")
    )


def row_numbers(
    df: DataFrame, keys: Sequence[str], pos: str, out: str, chunk: int = CHUNK
) -> DataFrame:
    """Dense 0-based number of each row of a series by ``pos``, whatever positions are missing.

    Frames that count rows need it wherever rows were dropped; ``over_halo`` counts positions.
    """
    counted = running_sum(df, keys, pos, F.lit(1).cast("bigint"), out, chunk)
    return counted.withColumn(out, (F.col(out) - 1).cast("bigint"))


def _edge_aggs(pos: str, c: str) -> dict[str, Column]:
    """Position and value of the first and last non-null (fixed-width buffers: hash aggregation)."""
    at = F.when(F.col(c).isNotNull(), F.col(pos))
    return {
        f"_lp_{c}": F.max(at),
        f"_lv_{c}": F.max_by(c, at),
        f"_fp_{c}": F.min(at),
        f"_fv_{c}": F.min_by(c, at),
    }


def nearest_known(
    df: DataFrame, keys: Sequence[str], pos: str, values: Sequence[str], chunk: int = CHUNK
) -> DataFrame:
    """Per value column add ``_prev_<c>`` and ``_next_<c>``: structs (p, v) of the nearest non-null
    at or before / at or after each row, however long the gap. Gaps that cross chunks take their
    ends from a summary of one row per chunk. All columns share the exchange and the sorts."""
    keys, values = list(keys), list(values)
    rows = df.select(
        *df.columns,
        chunk_id(pos, chunk).alias("_home"),
        *[
            F.when(
                F.col(c).isNotNull(), F.struct(F.col(pos).alias("p"), F.col(c).alias("v"))
            ).alias(f"_known_{c}")
            for c in values
        ],
    )
    edges = df.withColumn("_home", chunk_id(pos, chunk)).groupBy(*keys, "_home")
    edges = edges.agg(*[agg.alias(n) for c in values for n, agg in _edge_aggs(pos, c).items()])
    edges = edges.select(
        *keys,
        "_home",
        *[
            F.when(
                F.col(f"_{side}p_{c}").isNotNull(),
                F.struct(F.col(f"_{side}p_{c}").alias("p"), F.col(f"_{side}v_{c}").alias("v")),
            ).alias(f"_{name}_{c}")
            for c in values
            for side, name in (("l", "last"), ("f", "first"))
        ],
    )
    by_chunk = Window.partitionBy(*keys)
    before = (Window.unboundedPreceding, -1)
    fwd = by_chunk.orderBy("_home").rowsBetween(*before)
    bwd = by_chunk.orderBy(F.col("_home").desc()).rowsBetween(*before)
    edges = edges.select(
        *keys,
        "_home",
        *[F.last(f"_last_{c}", ignorenulls=True).over(fwd).alias(f"_cp_{c}") for c in values],
        *[F.last(f"_first_{c}", ignorenulls=True).over(bwd).alias(f"_cn_{c}") for c in values],
    )
    inside = Window.partitionBy(*keys, "_home")
    so_far = (Window.unboundedPreceding, 0)
    up = inside.orderBy(pos).rowsBetween(*so_far)
    down = inside.orderBy(F.col(pos).desc()).rowsBetween(*so_far)
    filled = rows.select(
        *df.columns,
        "_home",
        *[F.last(f"_known_{c}", ignorenulls=True).over(up).alias(f"_up_{c}") for c in values],
        *[F.last(f"_known_{c}", ignorenulls=True).over(down).alias(f"_down_{c}") for c in values],
    )
    return filled.join(edges, [*keys, "_home"], "left").select(
        *df.columns,
        *[F.coalesce(f"_up_{c}", f"_cp_{c}").alias(f"_prev_{c}") for c in values],
        *[F.coalesce(f"_down_{c}", f"_cn_{c}").alias(f"_next_{c}") for c in values],
    )


__all__ = [
    "CHUNK",
    "chunk_id",
    "nearest_known",
    "null_safe_join",
    "over_halo",
    "row_numbers",
    "running_sum",
    "spread",
    "with_halo",
]
