"""Running sums along series at chosen positions.

Sums over many overlapping ranges of one series (the folds of a back-test, the history behind every
changepoint) are differences of running sums, so each row is read once however many ranges hold it.
Chunks add up their rows on their own; only one vector of totals per chunk is summed across chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.chunks import CHUNK, chunk_id, with_halo
from tidemark.plans.gram import key_ddl
from tidemark.session import durable

#: From the rows of a chunk and its halo (columns by name, by position) the vectors to sum, one per row.
Terms = Callable[[np.ndarray, dict[str, np.ndarray]], np.ndarray]


def sums_before(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    columns: Sequence[str],
    marks: DataFrame,
    terms: Terms,
    size: int,
    before: int = 0,
    chunk: int = CHUNK,
) -> DataFrame:
    """``(keys, x, sums)``: for every distinct mark the sums of the terms of all rows with ``pos`` below x.

    ``terms`` gets the positions and the columns (double, nulls as NaN) of a chunk's own rows and of the
    ``before`` positions ahead of it, and returns a matrix of ``size`` columns. ``marks`` holds the keys
    and ``x``; a mark of a series without rows has zero sums, null keys are keys like any other.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(pos).alias("_p"), *[F.col(c).cast("double").alias(c) for c in columns])
    rows, width = with_halo(rows, "_p", before, 0, chunk)
    rows = rows.withColumn("_own", F.col("_home") == F.col("_chunk")).drop("_home")
    wanted = marks.select(*keys, "x").distinct().withColumn("_chunk", chunk_id("x", width))
    names = list(columns)

    def run(key: tuple, part: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_p")
        own = part["_own"].to_numpy(dtype=bool)
        at = part["_p"].to_numpy()
        values = terms(at, {c: part[c].to_numpy(dtype="float64") for c in names})[own]
        running = np.vstack([np.zeros((1, size)), np.cumsum(values, axis=0)])
        x = ask["x"].to_numpy()
        found = np.searchsorted(at[own], x, "left")
        out = pd.DataFrame({"x": [*x.tolist(), None], "sums": [*running[found].tolist(), running[-1].tolist()]})
        out["x"] = out["x"].astype("Int64")
        for name, k in zip((*keys, "_chunk"), key, strict=True):
            out[name] = None if pd.isna(k) else k
        return out[[*keys, "_chunk", "x", "sums"]]

    group = [*keys, "_chunk"]
    ddl = f"{key_ddl(df, keys)}, _chunk bigint, x bigint, sums array<double>"
    local = durable(rows.groupBy(*group).cogroup(wanted.groupBy(*group)).applyInPandas(run, ddl))
    cells = local.filter("x is null").select(*group, F.posexplode("sums").alias("_cell", "_s"))
    earlier = Window.partitionBy(*keys, "_cell").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_o", F.coalesce(F.sum("_s").over(earlier), F.lit(0.0)))
    offsets = cells.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_cell", "_o"))).alias("_os"))
    offsets = offsets.withColumn("_os", F.transform("_os", lambda e: e["_o"]))
    at = local.filter("x is not null").withColumnRenamed("_chunk", "_c").withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    met = at.join(offsets, [*same, F.col("_c") == F.col("_chunk")])
    return met.select(*keys, "x", F.zip_with("sums", "_os", lambda a, b: a + b).alias("sums"))


def at_marks(
    ranges: DataFrame, keys: Sequence[str], sums: DataFrame, places: dict[str, str]
) -> DataFrame:
    """``ranges`` with one more column per entry of ``places``: the sums before the mark in that column."""
    for out, x in places.items():
        named = sums.withColumnsRenamed({**{k: f"_k_{k}" for k in keys}, "x": "_x", "sums": out})
        same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
        ranges = ranges.join(named, [*same, F.col(x) == F.col("_x")]).drop("_x", *[f"_k_{k}" for k in keys])
    return ranges


def pair_terms(x: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Products of pairs of columns; a row with a missing value counts as no row."""
    whole = np.isfinite(x).all(axis=1)
    return np.where(whole[:, None], x[:, pairs[0]] * x[:, pairs[1]], 0.0)


def lag_by_position(at: np.ndarray, values: np.ndarray, steps: int) -> np.ndarray:
    """The value ``steps`` positions earlier, NaN where that position has no row."""
    found = np.searchsorted(at, at - steps)
    hit = at[np.minimum(found, len(at) - 1)] == at - steps if len(at) else np.zeros(0, bool)
    return np.where(hit, values[np.minimum(found, max(len(at) - 1, 0))] if len(at) else values, np.nan)
