"""Bring per-group results back to rows without letting a hot group land in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.chunks import null_safe_join
from tidemark.session import durable

SALTS = 16
MAX_SALTS = 4096
GIB = 1 << 30
LARGE_BYTES = GIB
BROADCAST_BYTES = 32 << 20


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables a plan reads, as Spark's statistics state them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def attach(
    df: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str | Column] | None = None,
    how: str = "left",
    large: int | None = None,
    broadcast_limit: int | None = None,
) -> DataFrame:
    """Join one row per group (``stats``) to the rows of ``df``.

    When ``df`` is large the group table is written first, so its size is known: if it is small
    it is broadcast and the rows do not shuffle at all. Otherwise, and for small inputs where
    Spark's own choice is good, rows are spread over several join keys per group by a hash of
    ``spread_by`` (default: all columns) and the group table is repeated that often, because one
    group may hold a third of the rows. The salt depends on row content only, so a recomputed task
    sends its rows to the same place. Null keys meet null keys.
    """
    keys = list(keys)
    if not keys:
        names = stats.columns
        row = stats.select(F.struct(*names).alias("_one")).scalar()
        out = df.withColumn("_one", row).select(
            *df.columns, *[F.col(f"_one.{c}").alias(c) for c in names]
        )
        return out
    large = LARGE_BYTES if large is None else large
    limit = BROADCAST_BYTES if broadcast_limit is None else broadcast_limit
    salts = SALTS
    size = input_bytes(df)
    if size > large:
        stats = durable(stats)
        if input_bytes(stats) <= limit:
            return null_safe_join(df, F.broadcast(stats), keys, how)
        salts = max(SALTS, min(MAX_SALTS, size // GIB))
    spread = list(spread_by) if spread_by else [F.col(c) for c in df.columns]
    left = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return null_safe_join(left, right, [*keys, "_salt"], how).drop("_salt")


def attach_counted(
    df: DataFrame, table: DataFrame, keys: Sequence[str], weight: str, heavy_keys: int = 1000
) -> DataFrame:
    """Inner join of rows with a table that holds in ``weight`` how many rows each key has (null keys too).

    A key with more than 1/``heavy_keys`` of all rows is heavy, so there are at most that many of them: they
    are broadcast and their rows stay where they are. The other keys join once, with nothing repeated.
    ``df`` is read twice; pass a stored table where it is costly.
    """
    keys = list(keys)
    limit = table.select(F.sum(weight) / F.lit(heavy_keys)).scalar()
    heavy = table.filter(F.col(weight) > limit)
    known = F.broadcast(heavy)
    rest = null_safe_join(df, F.broadcast(heavy.select(*keys)), keys, "left_anti")
    light = null_safe_join(rest, table.filter(F.col(weight) <= limit), keys)
    return null_safe_join(df, known, keys).unionByName(light)


def attach_agg(
    df: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str | Column] | None,
    *aggs: Column,
) -> DataFrame:
    """Group aggregate joined back to every row; the scalable form of ``agg() over (partition)``."""
    keys = list(keys)
    stats = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    return attach(df, stats, keys, spread_by)
