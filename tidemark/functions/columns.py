"""Choosing and checking columns by name and type at plan-building time."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame


class MissingColumnsError(ValueError):
    """A required column is absent."""


class NoDataError(ValueError):
    """A filter that must match something matched nothing."""


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise MissingColumnsError(f"missing required columns: {missing}")
    return df


def with_prefix(df: DataFrame, prefix: str, exclude: Sequence[str] = ()) -> list[str]:
    """Column names that start with ``prefix`` but with none of the ``exclude`` prefixes."""
    return [
        c for c in df.columns if c.startswith(prefix) and not any(c.startswith(e) for e in exclude)
    ]


def double_columns(
    df: DataFrame, exclude: Sequence[str] = (), exclude_prefixes: Sequence[str] = ()
) -> list[str]:
    """Columns of type double that are not excluded by name or prefix."""
    return [
        name
        for name, dtype in df.dtypes
        if dtype == "double"
        and name not in set(exclude)
        and not any(name.startswith(p) for p in exclude_prefixes)
    ]
