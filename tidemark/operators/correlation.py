"""Pearson and Spearman matrices, p-values and the target summary."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import require_columns, with_prefix
from tidemark.functions.special import correlation_p
from tidemark.functions.text import pretty_label
from tidemark.plans.lookup import attach_counted
from tidemark.plans.order import average_ranks, value_counts
from tidemark.session import durable


def _both_ways(upper: DataFrame) -> DataFrame:
    """Complete an upper triangle (x, y, r, n) to the full matrix without a join."""
    sides = F.when(
        F.col("x") == F.col("y"), F.array(F.struct("x", "y"))
    ).otherwise(
        F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))
    )
    return upper.select(F.explode(sides).alias("_p"), "r", "n").select("_p.x", "_p.y", "r", "n")


SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def _sums_of(x: np.ndarray) -> np.ndarray:
    """For all pairs i <= j of columns the six sums over rows where both are known; shape (pairs, 6)."""
    known = (~np.isnan(x)).astype(float)
    x = np.nan_to_num(x)
    counts, first, second, cross = known.T @ known, x.T @ known, (x * x).T @ known, x.T @ x
    i, j = np.triu_indices(x.shape[1])
    return np.column_stack([counts[i, j], first[i, j], first[j, i], second[i, j], second[j, i], cross[i, j]])


def _correlated(sums: DataFrame) -> DataFrame:
    """``r`` of each row of the six sums, null where no more than two rows or no spread are left."""
    n = F.col("n")
    var_x, var_y = (F.col(f"s{v}{v}") - F.col(f"s{v}") * F.col(f"s{v}") / n for v in "xy")
    spread = (var_x > 1e-13 * F.col("sxx")) & (var_y > 1e-13 * F.col("syy"))
    r = (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(var_x * var_y)
    bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))
    same = F.when(F.col("x") == F.col("y"), F.lit(1.0)).otherwise(bounded)
    return sums.select("x", "y", F.when((n > 2) & spread, same).alias("r"), n.cast("long").alias("n"))


def _named(sums: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pair numbers replaced by column names."""
    i, j = np.triu_indices(len(columns))
    x, y = (F.array(*[F.lit(columns[k]) for k in side.tolist()]) for side in (i, j))
    return sums.select(F.get(x, F.col("pair")).alias("x"), F.get(y, F.col("pair")).alias("y"), *SUMS)


def pair_sums(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``x, y`` and the six sums of all pairs of columns, each taken from its smallest value, in one pass.

    Tasks add up small matrices, so the plan does not grow with the number of pairs. Nulls and NaN are missing.
    """
    columns = list(columns)
    low = df.agg(*[F.min(F.col(c).cast("double")).alias(c) for c in columns]).first()
    shift = np.array([0.0 if low[c] is None or not np.isfinite(low[c]) else low[c] for c in columns])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0.0
        for batch in batches:
            total = total + _sums_of(batch.to_numpy(dtype="float64", na_value=np.nan) - shift)
        if np.ndim(total):
            yield pd.DataFrame(total, columns=SUMS).assign(pair=np.arange(len(total), dtype="int32"))

    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    parts = rows.mapInPandas(run, ", ".join(f"{s} double" for s in SUMS) + ", pair int")
    return _named(parts.groupBy("pair").agg(*[F.sum(s).alias(s) for s in SUMS]), columns)


def pearson_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson correlations of all columns in one pass; null where no more than two
    complete pairs exist."""
    require_columns(df, columns)
    return _both_ways(_correlated(pair_sums(df, columns)))


def _patterns(df: DataFrame, columns: Sequence[str]) -> list[list[str]]:
    """Columns that are missing in the same rows, from counts of rows where two are known."""
    known = {(r["x"], r["y"]): r["n"] for r in pair_sums(df, columns).collect()}  # one row per pair of columns
    groups: list[list[str]] = []
    for c in columns:
        for g in groups:
            if known.get((g[0], c)) == known.get((c, c)) == known.get((g[0], g[0])):
                g.append(c)
                break
        else:
            groups.append([c])
    return groups


def _rank_sums(df: DataFrame, columns: Sequence[str], pairs: set[tuple[str, str]] | None) -> DataFrame:
    """Six sums of average ranks for pairs of columns, over the rows where both are known.

    Ranks of a column depend on the other one only through the rows it is missing in. So columns are put into
    groups that are missing together, and ranked once for each pair of groups: rows are copied once per pair
    of groups, in long form, and all columns are ranked by one plan.
    """
    columns = list(columns)
    groups = _patterns(df, columns)
    joint = []
    for a in range(len(groups)):
        for b in range(a, len(groups)):
            members = groups[a] + (groups[b] if b > a else [])
            across = [(x, y) for x in groups[a] for y in groups[b]]
            if pairs is None or any((x, y) in pairs or (y, x) in pairs for x, y in across):
                used = members if pairs is None else [c for c in members if any(c in p for p in across if p in pairs or p[::-1] in pairs)]
                joint.append((groups[a][0], groups[b][0], used, a == b))
    rows = durable(df.select(*[F.col(c).cast("double").alias(c) for c in columns], F.monotonically_increasing_id().alias("_row")))
    cells = F.array(
        *[
            F.when(
                F.col(a).isNotNull() & ~F.isnan(a) & F.col(b).isNotNull() & ~F.isnan(b),
                F.array(*[F.struct(F.lit(k).alias("_g"), F.lit(columns.index(c)).alias("_c"), F.col(c).alias("_v")) for c in used]),
            ).otherwise(F.array())
            for k, (a, b, used, _) in enumerate(joint)
        ]
    )
    long = durable(rows.select("_row", F.explode(F.flatten(cells)).alias("_e")).select("_row", "_e.*"))
    ranks = durable(average_ranks(value_counts(long, ["_g", "_c"], "_v"), ["_g", "_c"], "_v", "_rank"))
    ranked = attach_counted(long, ranks, ["_g", "_c", "_v"], "_w")
    entry = F.struct(F.col("_c").alias("c"), F.col("_rank").alias("r"))
    wide = ranked.groupBy("_g", "_row").agg(F.collect_list(entry).alias("_e"))
    wide = wide.select("_g", F.transform("_e", lambda e: e["c"]).alias("c"), F.transform("_e", lambda e: e["r"]).alias("r"))
    # a mean rank, exact or not, keeps the sums small
    middle = ranks.groupBy("_g", "_c").agg((F.sum("_w") / 2.0).alias("m")).groupBy("_g").agg(F.max("m").alias("_m"))
    wide = wide.join(F.broadcast(middle), "_g")  # one row per pair of groups
    k = len(columns)
    i, j = np.triu_indices(k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for g, part in batch.groupby("_g"):
                x = np.full((len(part), k), np.nan)
                at = np.repeat(np.arange(len(part)), part["c"].map(len))
                x[at, np.concatenate(part["c"].to_list())] = np.concatenate(part["r"].to_list()) - part["_m"].iloc[0]
                total[g] = total.get(g, 0.0) + _sums_of(x)
        for g, sums in total.items():
            yield pd.DataFrame(sums, columns=SUMS).assign(pair=np.arange(len(sums), dtype="int32"), _g=g)

    parts = wide.mapInPandas(run, ", ".join(f"{s} double" for s in SUMS) + ", pair int, _g int")
    mine = [
        {(min(columns.index(x), columns.index(y)), max(columns.index(x), columns.index(y))) for x in groups_a for y in groups_b}
        for groups_a, groups_b in (
            (next(g for g in groups if g[0] == a), next(g for g in groups if g[0] == b)) for a, b, _, _ in joint
        )
    ]
    number = {p: n for n, p in enumerate(zip(i.tolist(), j.tolist()))}
    wanted = [(g, number[p]) for g, members in enumerate(mine) for p in members]
    keep = F.array(*[F.lit(g * len(i) + p) for g, p in sorted(wanted)])
    sums = parts.filter(F.array_contains(keep, F.col("_g") * F.lit(len(i)) + F.col("pair")) & (F.col("n") > 0))
    return _named(sums.groupBy("pair").agg(*[F.sum(s).alias(s) for s in SUMS]), columns)


def spearman_matrix(
    df: DataFrame, columns: Sequence[str], complete: str = "pairwise", target: str | None = None
) -> DataFrame:
    """Spearman correlations: ``pairwise`` keeps each pair's complete rows, ``listwise`` only rows complete in
    every column. With ``target`` only the pairs of that column are ranked and returned."""
    require_columns(df, columns)
    if complete not in ("pairwise", "listwise"):
        raise ValueError("complete must be 'pairwise' or 'listwise'")
    rows = df.select(*columns)
    if complete == "listwise":
        rows = rows.na.drop("any")
    pairs = None if target is None else {(target, c) for c in columns}
    sums = _rank_sums(durable(rows), columns, pairs)
    if target is not None:
        sums = sums.filter((F.col("x") == target) | (F.col("y") == target))
    full = _both_ways(_correlated(sums))
    known = {c: F.count(F.when(~F.isnan(F.col(c).cast("double")), F.col(c))).alias(c) for c in columns}
    # a column without a value is in no pair's sums
    sizes = rows.agg(*known.values())
    each = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in columns for y in columns])
    every = sizes.select(F.explode(each).alias("_p")).select("_p.*")
    if target is not None:
        every = every.filter((F.col("x") == target) | (F.col("y") == target))
    return every.join(full, ["x", "y"], "left").select("x", "y", "r", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def group_spearman(
    df: DataFrame,
    prefix: str,
    exclude_prefixes: Sequence[str] = (),
    labels: dict[str, str] | None = None,
) -> DataFrame:
    """Listwise Spearman table of one prefix group with readable labels."""
    columns = with_prefix(df, prefix, exclude_prefixes)
    if len(columns) < 2:
        raise ValueError(f"fewer than two columns start with {prefix!r}")
    matrix = spearman_matrix(df, columns, "listwise")
    return matrix.select(
        pretty_label(F.col("x"), prefix, labels).alias("x_label"),
        pretty_label(F.col("y"), prefix, labels).alias("y_label"),
        "r",
        "n",
    )


@F.pandas_udf(T.DoubleType())
def _p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(a) else correlation_p(float(a), int(b)) for a, b in zip(r, n, strict=True)]
    )


def correlation_summary(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Pearson and Spearman of the target with each feature, both with p-values."""
    columns = [target, *features]
    pear = pearson_matrix(df, columns).filter(
        (F.col("x") == target) & (F.col("y") != target)
    )
    spear = spearman_matrix(df, columns, target=target).filter(
        (F.col("x") == target) & (F.col("y") != target)
    )
    return (
        pear.select(F.col("y").alias("feature"), F.col("r").alias("pearson_r"), "n")
        .join(spear.select(F.col("y").alias("feature"), F.col("r").alias("spearman_r")), "feature")
        .withColumn("pearson_p", _p_value("pearson_r", "n"))
        .withColumn("spearman_p", _p_value("spearman_r", "n"))
    )
