"""Least squares on distributed rows.

Tasks turn their Arrow batches into small cross-product matrices per group, Spark adds them up, and
only the p x p sums of a group reach the solver. No group's rows ever meet in one place.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_ddl(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def gram(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Upper triangle ``(keys, _i, _j, _s)`` of X'X over the rows with no null in ``columns``."""
    keys, columns = list(keys), list(columns)
    upper_i, upper_j = np.triu_indices(len(columns))
    schema = f"{key_ddl(df, keys)}, _i int, _j int, _s double"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            for key, part in batch.groupby(keys, sort=False, dropna=False):
                x = part[columns].to_numpy(dtype="float64")
                x = x[~np.isnan(x).any(axis=1)]
                cross = x.T @ x
                out = pd.DataFrame(
                    {
                        "_i": upper_i.astype("int32"),
                        "_j": upper_j.astype("int32"),
                        "_s": cross[upper_i, upper_j],
                    }
                )
                for name, k in zip(keys, key, strict=True):
                    out.insert(0, name, None if pd.isna(k) else k)
                yield out[[*keys, "_i", "_j", "_s"]]

    rows = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return rows.mapInPandas(partial, schema).groupBy(*keys, "_i", "_j").agg(F.sum("_s").alias("_s"))


def packed(grams: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per group with its triangle as an array of p*(p+1)/2 numbers in (i, j) order."""
    entry = F.struct("_i", "_j", "_s")
    return grams.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["_s"]).alias("gram")
    )


def matrix(entries: np.ndarray, p: int) -> np.ndarray:
    """Symmetric matrix from the packed triangle."""
    full = np.zeros((p, p))
    full[np.triu_indices(p)] = entries
    return full + np.triu(full, 1).T


def solve(
    g: np.ndarray, x: Sequence[int], y: int, penalty: np.ndarray | float = 0.0
) -> tuple[np.ndarray, float]:
    """Coefficients of the regression of column ``y`` on columns ``x`` and its residual square sum."""
    x = list(x)
    a = g[np.ix_(x, x)] + np.diag(np.broadcast_to(penalty, len(x)).astype(float))
    b = g[x, y]
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    coef = np.linalg.lstsq(a / np.outer(scale, scale), b / scale, rcond=1e-12)[0] / scale
    xx = g[np.ix_(x, x)]
    ssr = float(g[y, y] - 2 * coef @ b + coef @ xx @ coef)
    return coef, max(ssr, 0.0)
