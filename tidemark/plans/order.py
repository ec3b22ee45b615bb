"""Exact order statistics, ranks and row positions on one path, whatever the size or skew of a group.

Values are merged to ``(group, value, count)`` and mapped to 64-bit integers in the same order. Their digits
form a tree of counts: the values below one are those under smaller first digits, plus those under the same
first and a smaller second digit, and so on. Every sum runs over the digits under one node, of which there are
at most as many as digit values, so no task sorts a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.chunks import over_halo
from tidemark.session import durable

#: Bits of the three digits of a key, the first signed.
DIGITS = (22, 21, 21)
_BEFORE = (Window.unboundedPreceding, -1)


def order_key(df: DataFrame, col: str) -> Column:
    """A long that orders like ``col``: numbers (decimals by their double), times and dates."""
    dtype, c = df.schema[col].dataType, F.col(col)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(dtype, T.DateType):
        return F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long")
    if isinstance(dtype, T.IntegralType):
        return c.cast("long")
    if not isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        raise TypeError(f"no order key for {dtype.simpleString()}")
    # adding zero makes -0.0 and 0.0 one value, as a grouping does
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), c.cast("double") + F.lit(0.0))
    bits = bits.cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)


def _digits(key: Column) -> list[Column]:
    _, middle, low = DIGITS
    return [
        F.shiftright(key, middle + low),
        F.shiftright(key, low).bitwiseAND(F.lit((1 << middle) - 1)),
        key.bitwiseAND(F.lit((1 << low) - 1)),
    ]


def running_counts(
    counts: DataFrame, keys: Sequence[str], value: str, weight: str = "_w", total: str | None = None
) -> DataFrame:
    """Per distinct value add ``_before``: total weight of smaller values of the same group, and with
    ``total`` a column of that name with the group's whole weight.

    ``counts`` holds one row per (keys, value), no value null.
    """
    keys = list(keys)
    names = ["_d1", "_d2", "_d3"]
    rows = counts.select("*", *[d.alias(n) for n, d in zip(names, _digits(order_key(counts, value)))])
    tables = [rows]
    for k in (2, 1):
        tables.append(tables[-1].groupBy(*keys, *names[:k]).agg(F.sum(weight).alias(weight)))
    # from the top down: what stands before a node enters its children's window as their first row
    done = None
    for k, table in enumerate(reversed(tables)):
        node, digit = [*keys, *names[:k]], names[k]
        ordered = Window.partitionBy(*node).orderBy(F.col(digit).asc_nulls_first())
        if done is None:
            size = F.sum(weight).over(Window.partitionBy(*node))
        else:
            heads = done.select(*node, F.col("_before").alias(weight), "_size")
            table = table.unionByName(heads, allowMissingColumns=True)
            size = F.first("_size").over(ordered)
        kept = [c for c in table.columns if c != "_size"]
        before = F.coalesce(F.sum(weight).over(ordered.rowsBetween(*_BEFORE)), F.lit(0))
        done = table.select(*kept, before.cast("long").alias("_before"), size.cast("long").alias("_size"))
        done = done.filter(F.col(digit).isNotNull())
    return done.select(*counts.columns, "_before", *([F.col("_size").alias(total)] if total else []))


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_w"))
    )


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "pos") -> DataFrame:
    """0-based row position of each row inside its group, ordered by ``order`` (unique per row).

    Rows are dealt by ranges of keys and order, so a large group is many tasks; each counts its own rows
    and starts at the count of the ranges before it.
    """
    keys, order = list(keys), list(order)
    cut = df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    cut = durable(cut)
    sizes = cut.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_w"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(*_BEFORE)
    starts = sizes.select(
        *keys, "_part", F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_w"), F.lit(0).alias("_kind")
    )
    rows = cut.select("*", F.lit(1).cast("long").alias("_w"), F.lit(1).alias("_kind"))
    both = rows.unionByName(starts, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_part").orderBy("_kind", *order).rowsBetween(*_BEFORE)
    placed = both.select("*", F.sum("_w").over(inside).cast("bigint").alias("_place")).filter("_kind = 1")
    return placed.select(*df.columns, F.col("_place").alias(out))


def over_rows(df, keys, order, make, before=0, after=0):
    """Like ``over_halo`` for rows without a grid position (irregular snapshots)."""
    placed = positions(df, list(keys), list(order), "_pos")
    return over_halo(placed, list(keys), "_pos", make, before, after).drop("_pos")


def average_ranks(counts: DataFrame, keys: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """Average rank (1-based, ties share their mean rank) of each distinct value."""
    ranked = running_counts(counts, keys, value)
    return ranked.withColumn(out, F.col("_before") + (F.col("_w") + 1) / 2.0).drop("_before")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles; one column per entry of ``qs``."""
    keys, names = list(keys), list(qs)
    rows = running_counts(value_counts(df.select(*keys, value), keys, value), keys, value, total="_size")
    aggs: list[Column] = []
    hits = F.lit(False)
    for q in names:
        at = F.lit(float(qs[q])) * (F.col("_size") - 1)
        end = F.col("_before") + F.col("_w")
        for side, idx in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("_before") <= idx) & (idx < end)
            hits = hits | hit
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{side}_{q}"))
    found = rows.filter(hits)
    aggs.append(F.max("_size").alias("_size"))
    found = found.groupBy(*keys).agg(*aggs) if keys else found.agg(*aggs)
    out = []
    for q in names:
        at = F.lit(float(qs[q])) * (F.col("_size") - 1)
        lo, hi = F.col(f"_lo_{q}").cast("double"), F.col(f"_hi_{q}").cast("double")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(q))
    return found.select(*keys, *out)
