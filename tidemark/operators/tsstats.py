"""Seasonal decomposition, autocorrelation, unit-root and residual tests, spikes."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import special
from tidemark.operators.aggregates import above_group_quantile, resample_sweep
from tidemark.operators.features import centered_average, days_since_previous, week_index
from tidemark.plans.chunks import CHUNK, null_safe_join, over_halo, row_numbers, with_halo
from tidemark.plans.gram import gram, key_ddl, matrix, packed, solve
from tidemark.plans.lookup import attach, attach_agg
from tidemark.plans.order import positions, quantiles, running_counts, value_counts
from tidemark.session import durable

Z95 = 1.959963984540054


def decompose(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: str,
    period: int,
    model: str = "additive",
    chunk: int = CHUNK,
) -> DataFrame:
    """Classical decomposition: columns ``trend``, ``seasonal``, ``resid``."""
    if model not in ("additive", "multiplicative"):
        raise ValueError("model must be additive or multiplicative")
    keys = list(keys)
    additive = model == "additive"
    v = F.col(value)
    rows = centered_average(df, keys, pos, value, period, "trend", chunk)
    rows = rows.withColumn("_phase", F.pmod(F.col(pos), F.lit(period)).cast("int")).withColumn(
        "_detrended", v - F.col("trend") if additive else F.try_divide(v, F.col("trend"))
    )
    phases = rows.groupBy(*keys, "_phase").agg(F.avg("_detrended").alias("_avg"))
    level = F.avg("_avg").over(Window.partitionBy(*keys))  # at most ``period`` rows per series
    seasonal = F.col("_avg") - level if additive else F.try_divide(F.col("_avg"), level)
    phases = phases.select(*keys, "_phase", seasonal.alias("seasonal"))
    out = attach(rows, phases, [*keys, "_phase"], [pos])
    resid = (
        F.col("_detrended") - F.col("seasonal")
        if additive
        else F.try_divide(F.col("_detrended"), F.col("seasonal"))
    )
    return out.withColumn("resid", resid).drop("_phase", "_detrended")


def lag_products(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: str,
    nlags: int,
    chunk: int = CHUNK,
) -> DataFrame:
    """``(keys, lag, _s, n)``: sums of products of centred values ``lag`` apart, and series length.

    Each chunk with a halo of ``nlags`` earlier rows gives its share of every lag as vector
    products; memory is one chunk and the shuffle carries each row about once, not once per lag.
    """
    keys = list(keys)
    known = df.select(*keys, pos, value).filter(F.col(value).isNotNull())
    rows = attach_agg(
        known, keys, [pos], F.avg(value).alias("_mean"), F.count(F.lit(1)).alias("_n")
    ).select(*keys, pos, (F.col(value) - F.col("_mean")).alias("_x"), "_n")
    wide, _ = with_halo(rows, pos, before=nlags, chunk=chunk)

    def products(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(pos)
        first = int(part[pos].iloc[0])
        at = (part[pos] - first).to_numpy()
        x = np.zeros(int(at[-1]) + 1)
        x[at] = part["_x"].to_numpy()
        own = (part["_home"] == part["_chunk"]).to_numpy()
        mine = np.zeros_like(x)
        mine[at[own]] = x[at[own]]
        s = np.zeros(nlags + 1)
        for k in range(min(nlags, len(x) - 1) + 1):
            s[k] = mine[k:] @ x[: len(x) - k]
        out = pd.DataFrame({"lag": np.arange(nlags + 1, dtype="int32"), "_s": s})
        for k in keys:
            out[k] = part[k].iloc[0]
        out["n"] = int(part["_n"].iloc[0])
        return out[[*keys, "lag", "_s", "n"]]

    schema = f"{key_ddl(df, keys)}, lag int, _s double, n bigint"
    return (
        wide.groupBy(*keys, "_chunk")
        .applyInPandas(products, schema)
        .groupBy(*keys, "lag")
        .agg(F.sum("_s").alias("_s"), F.max("n").alias("n"))
        .filter(F.col("lag") < F.col("n"))
    )


def acf(
    df: DataFrame, keys: Sequence[str], pos: str, value: str, nlags: int, chunk: int = CHUNK
) -> DataFrame:
    """Autocorrelations with the 95 % Bartlett band."""
    sums = lag_products(df, keys, pos, value, nlags, chunk)
    by = Window.partitionBy(*keys)  # nlags + 1 rows per series from here on
    zero = F.max(F.when(F.col("lag") == 0, F.col("_s"))).over(by)
    r = sums.withColumn("acf", F.try_divide(F.col("_s"), zero))
    earlier = by.orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)
    past = F.sum(F.when(F.col("lag") > 0, F.col("acf") * F.col("acf")).otherwise(0.0)).over(earlier)
    var = F.when(F.col("lag") == 0, 0.0).otherwise((1 + 2 * F.coalesce(past, F.lit(0.0))) / F.col("n"))
    return r.select(*keys, "lag", "acf", (F.lit(Z95) * F.sqrt(var)).alias("band"), "n")


def _levinson(r: np.ndarray) -> np.ndarray:
    """Partial autocorrelations from autocovariances r[0..K]."""
    out = np.ones(len(r))
    phi = np.zeros(0)
    err = r[0]
    for k in range(1, len(r)):
        if not abs(err) > 0:
            out[k:] = np.nan
            break
        new = (r[k] - phi @ r[1:k][::-1]) / err
        phi = np.append(phi - new * phi[::-1], new)
        err *= 1.0 - new * new
        out[k] = new
    return out


def pacf(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: str,
    nlags: int,
    adjusted: bool = True,
    chunk: int = CHUNK,
) -> DataFrame:
    """Yule-Walker partial autocorrelations; ``adjusted`` divides lag k by n - k, not n."""
    keys = list(keys)
    sums = lag_products(df, keys, pos, value, nlags, chunk)

    def finish(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("lag")
        lags, n = part["lag"].to_numpy(), float(part["n"].iloc[0])
        r = part["_s"].to_numpy() / ((n - lags) if adjusted else n)
        out = part[[*keys, "lag"]].copy()
        out["pacf"] = _levinson(r)
        out["band"] = Z95 / math.sqrt(n)
        return out

    return sums.groupBy(*keys).applyInPandas(
        finish, f"{key_ddl(df, keys)}, lag int, pacf double, band double"
    )


def decay_ratios(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, steps: Sequence[int] | None = None
) -> DataFrame:
    """|pacf1| / |pacf2| per sampling step (empty bins skipped), best step first per series."""
    keys = list(keys)
    swept = durable(resample_sweep(df, keys, ts, value, *([steps] if steps else [])))
    by = [*keys, "step"]
    dense = positions(swept, by, ["slot"], "pos")
    sums = lag_products(dense, by, "pos", value, 2)
    wide = sums.groupBy(*by).agg(
        *[F.max(F.when(F.col("lag") == k, F.col("_s"))).alias(f"_s{k}") for k in (0, 1, 2)],
        F.max("n").alias("n"),
    )
    n = F.col("n").cast("double")
    r1 = F.try_divide(F.col("_s1") / (n - 1), F.col("_s0") / n)
    r2 = F.try_divide(F.col("_s2") / (n - 2), F.col("_s0") / n)
    rows = wide.filter(F.col("n") > 2).select(*by, "n", r1.alias("_r1"), r2.alias("_r2"))
    p1 = F.col("_r1")
    p2 = F.try_divide(F.col("_r2") - p1 * p1, 1 - p1 * p1)
    ratio = F.when(p2 == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.abs(p1), F.abs(p2)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("decay_ratio"), "step"))
    return rows.select(
        *by, "n", p1.alias("pacf1"), p2.alias("pacf2"), ratio.alias("decay_ratio")
    ).withColumn("best_rank", rank)


def _adf_finish(g: np.ndarray, head: np.ndarray, n: int, top: int, p: int):
    """Lag choice by AIC on the common sample, then the statistic on all rows the lag allows.

    ``g``: cross products of [1, level, d1..dP, d0] (P = ``top``) over rows pos > p;
    ``head``: the first p + 1 values, which the final fit may use."""
    y = top + 2
    nobs = n - 1 - p
    best, best_aic = 0, math.inf
    for lag in range(p + 1):
        x = [0, 1, *range(2, 2 + lag)]
        _, ssr = solve(g, x, y)
        if ssr <= 0:
            continue
        aic = nobs * math.log(ssr / nobs) + 2 * len(x)
        if aic < best_aic - 1e-12:
            best, best_aic = lag, aic
    x = [0, 1, *range(2, 2 + best)]
    full = g.copy()
    diff = np.diff(head)
    for t in range(best + 1, p + 1):
        row = np.zeros(y + 1)
        row[0], row[1], row[y] = 1.0, head[t - 1], diff[t - 1]
        for j in range(1, best + 1):
            row[1 + j] = diff[t - 1 - j]
        full += np.outer(row, row)
    rows = n - 1 - best
    coef, ssr = solve(full, x, y)
    dof = rows - len(x)
    inv = np.linalg.pinv(full[np.ix_(x, x)])
    se = math.sqrt(max(ssr / dof * inv[1, 1], 0.0)) if dof > 0 else math.nan
    return (coef[1] / se if se else math.nan), best, rows


def _adf_sums(
    known: DataFrame, sizes: DataFrame, keys: list[str], pos: str, value: str, top: int, chunk: int
) -> DataFrame:
    """``sizes`` with the packed cross products of level and ``top`` lagged differences, and the first values."""
    rows = attach(known, sizes, keys, [pos], how="inner").select(
        *keys,
        "_t",
        (F.col(value) - F.col("_mean")).alias("_x"),
        "_p",
    )

    def lagged(w):
        out = {"_level": F.lag("_x", 1).over(w)}
        for j in range(top + 1):
            out[f"_d{j}"] = F.lag("_x", j).over(w) - F.lag("_x", j + 1).over(w)
        return out

    wide = over_halo(rows, keys, "_t", lagged, before=top + 1, chunk=chunk)
    design = wide.filter(F.col("_t") > F.col("_p")).select(
        *keys,
        F.lit(1.0).alias("_one"),
        "_level",
        *[F.coalesce(f"_d{j}", F.lit(0.0)).alias(f"_d{j}") for j in range(1, top + 1)],
        "_d0",
    )
    columns = ["_one", "_level", *[f"_d{j}" for j in range(1, top + 1)], "_d0"]
    sums = packed(gram(design, keys, columns), keys)
    heads = (
        rows.filter(F.col("_t") <= F.col("_p"))  # lag + 1 rows per group
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_t", "_x"))).alias("_h"))
        .select(*keys, F.transform("_h", lambda e: e["_x"]).alias("head"))
    )
    met = null_safe_join(null_safe_join(sizes, sums, keys, "left"), heads, keys, "left")
    return met.select(*keys, "n", "_p", "gram", "head", F.lit(top).alias("top"))


def adf_test(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: str,
    min_points: int = 50,
    chunk: int = CHUNK,
) -> DataFrame:
    """Augmented Dickey-Fuller test with constant and AIC lag choice, one row per group.

    Lagged differences are window columns over halo chunks; the regression for every lag order
    comes from one distributed cross-product matrix. Groups under ``min_points`` give nulls.
    Differences are taken between the known values that follow each other, whatever ``pos`` skips.
    """
    keys = list(keys)
    known = df.select(*keys, pos, value).filter(F.col(value).isNotNull())
    known = row_numbers(known, keys, pos, "_t", chunk)
    sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("_mean"))
    lag_of_n = F.greatest(
        F.lit(0),
        F.least(
            F.floor(F.col("n") / 2) - 2,
            F.ceil(12.0 * F.pow(F.col("n") / F.lit(100.0), F.lit(0.25))),
        ),
    ).cast("int")
    sizes = durable(sizes.withColumn("_p", lag_of_n))
    # groups of similar lag order share a design, so short series do not carry the columns of long ones
    order = F.length(F.bin("_p"))
    classes = sizes.filter(F.col("n") >= min_points).groupBy(order.alias("class")).agg(F.max("_p").alias("top"))
    ready = sizes.filter(F.col("n") < min_points).select(
        *keys, "n", "_p", F.lit(None).cast("array<double>").alias("gram"), F.lit(None).cast("array<double>").alias("head"), F.lit(0).alias("top")
    )
    for c in classes.orderBy("class").collect():  # one row per power of two of the order
        mine = sizes.filter((F.col("n") >= min_points) & (order == c["class"]))
        ready = ready.unionByName(_adf_sums(known, mine, keys, pos, value, c["top"], chunk))

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                rec = {k: getattr(row, k) for k in keys} | {"n": row.n}
                if row.gram is not None and row.n >= min_points:
                    g = matrix(np.asarray(row.gram), row.top + 3)
                    stat, lag, nobs = _adf_finish(
                        g, np.asarray(row.head), int(row.n), int(row.top), int(row.p)
                    )
                    rec |= {
                        "adf_stat": stat,
                        "p_value": special.adf_p_value(stat),
                        "used_lag": lag,
                        "nobs": nobs,
                        "crit_1": special.adf_critical("1%", nobs),
                        "crit_5": special.adf_critical("5%", nobs),
                        "crit_10": special.adf_critical("10%", nobs),
                    }
                out.append(rec)
            names = [*keys, "n", "adf_stat", "p_value", "used_lag", "nobs"]
            names += ["crit_1", "crit_5", "crit_10"]
            res = pd.DataFrame(out, columns=names)
            for c in ("used_lag", "nobs"):
                res[c] = res[c].astype("Int32")
            yield res

    schema = (
        f"{key_ddl(df, keys)}, n bigint, adf_stat double, p_value double, used_lag int, nobs int, "
        "crit_1 double, crit_5 double, crit_10 double"
    )
    return ready.select(*keys, "n", F.col("_p").alias("p"), "gram", "head", "top").mapInPandas(
        finish, schema
    )


def adf_by_week(
    df: DataFrame, keys: Sequence[str], pos: str, ts: str, value: str, chunk: int = CHUNK
) -> DataFrame:
    """ADF inside every elapsed week; the last, partial week is left out."""
    keys = list(keys)
    weeks = week_index(df.filter(F.col(value).isNotNull()), ts)
    last = weeks.agg(F.max("week").alias("_last"))
    full = attach(weeks, last, [], [pos]).filter(F.col("week") < F.col("_last")).drop("_last")
    return adf_test(full, [*keys, "week"], pos, value, chunk=chunk)


@F.pandas_udf(T.DoubleType())
def _chi2(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None if pd.isna(a) else special.chi2_sf(float(a), float(b))
            for a, b in zip(x, dof, strict=True)
        ]
    )


def ljung_box(
    df: DataFrame, keys: Sequence[str], pos: str, value: str, lag: int = 96, chunk: int = CHUNK
) -> DataFrame:
    """Ljung-Box Q of the first ``lag`` autocorrelations."""
    r = acf(df, keys, pos, value, lag, chunk).filter(F.col("lag") > 0)
    n = F.col("n").cast("double")
    q = r.groupBy(*keys).agg(
        F.sum(F.col("acf") * F.col("acf") / (n - F.col("lag"))).alias("_s"), F.max("n").alias("n")
    )
    q = q.select(*keys, "n", (n * (n + 2) * F.col("_s")).alias("q_stat"))
    return q.withColumn("p_value", _chi2("q_stat", F.lit(float(lag))))


def arch_lm(
    df: DataFrame, keys: Sequence[str], pos: str, value: str, chunk: int = CHUNK
) -> DataFrame:
    """Engle's LM test: squared residuals regressed on their own lags."""
    keys = list(keys)
    known = df.select(*keys, pos, value).filter(F.col(value).isNotNull())
    known = row_numbers(known, keys, pos, "_t", chunk)
    sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("_l", F.least(F.lit(10), F.floor(F.col("n") / 5)).cast("int")).filter(
        F.col("_l") > 0
    )
    rows = attach(known, sizes, keys, [pos], how="inner").select(
        *keys, "_t", (F.col(value) ** 2).alias("_e"), "_l"
    )
    wide = over_halo(
        rows,
        keys,
        "_t",
        lambda w: {f"_e{j}": F.lag("_e", j).over(w) for j in range(1, 11)},
        before=10,
        chunk=chunk,
    )
    lags = [f"_e{j}" for j in range(1, 11)]
    design = wide.filter(F.col("_t") >= F.col("_l")).select(
        *keys, F.lit(1.0).alias("_one"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in lags], "_e"
    )
    sums = packed(gram(design, keys, ["_one", *lags, "_e"]), keys).join(sizes, keys)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[[*keys, "n"]].copy()
            lm, lags_used = [], []
            for row in batch.itertuples(index=False):
                used = int(row.lags)
                g = matrix(np.asarray(row.gram), 12)
                _, ssr = solve(g, range(used + 1), 11)
                nobs = g[0, 0]
                sst = g[11, 11] - g[0, 11] ** 2 / nobs
                lm.append(nobs * (1.0 - ssr / sst) if sst > 0 else math.nan)
                lags_used.append(used)
            out["lm_stat"] = lm
            out["lags"] = np.asarray(lags_used, dtype="int32")
            out["p_value"] = [special.chi2_sf(v, k) for v, k in zip(lm, lags_used, strict=True)]
            yield out

    schema = f"{key_ddl(df, keys)}, n bigint, lm_stat double, lags int, p_value double"
    return sums.select(*keys, "n", F.col("_l").alias("lags"), "gram").mapInPandas(finish, schema)


@F.pandas_udf(T.DoubleType())
def _normal_quantile(p: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else special.normal_ppf(x) for x in p])


def qq_pairs(df: DataFrame, keys: Sequence[str], pos: str, value: str) -> DataFrame:
    """Ordered values against normal order-statistic medians, with the fitted line and r."""
    keys = list(keys)
    known = df.select(*keys, pos, value).filter(F.col(value).isNotNull())
    placed = positions(known, keys, [value, pos], "_i")
    sized = attach_agg(placed, keys, [pos], F.count(F.lit(1)).alias("_n"))
    i, n = F.col("_i") + 1, F.col("_n")
    edge = F.pow(F.lit(0.5), 1.0 / n)
    share = (
        F.when(i == n, edge).when(i == 1, 1 - edge).otherwise((i - 0.3175) / (n + F.lit(0.365)))
    )
    pairs = sized.select(*keys, pos, value, share.alias("_p")).withColumn(
        "theoretical", _normal_quantile("_p")
    )
    line = pairs.groupBy(*keys).agg(
        F.regr_slope(value, "theoretical").alias("slope"),
        F.regr_intercept(value, "theoretical").alias("intercept"),
        F.corr("theoretical", value).alias("r"),
    )
    return attach(pairs.drop("_p"), line, keys, [pos])


@F.pandas_udf(T.DoubleType())
def _ks_p(d: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None if pd.isna(a) else special.kolmogorov_sf(float(a), int(b))
            for a, b in zip(d, n, strict=True)
        ]
    )


def exponential_ks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Exponential rate by maximum likelihood and the one-sample Kolmogorov-Smirnov distance,
    from counts of distinct values."""
    keys = list(keys)
    counts = durable(value_counts(df, keys, value))
    totals = counts.groupBy(*keys).agg(
        F.sum("_w").alias("n"),
        (F.sum("_w") / F.sum(F.col(value) * F.col("_w"))).alias("rate"),
    )
    rows = attach(running_counts(counts, keys, value), totals, keys, [value])
    cdf = F.greatest(1 - F.exp(-F.col("rate") * F.col(value)), F.lit(0.0))
    above = (F.col("_before") + F.col("_w")) / F.col("n") - cdf
    below = cdf - F.col("_before") / F.col("n")
    out = rows.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.max("rate").alias("rate"),
        F.max(F.greatest(above, below)).alias("ks_stat"),
    )
    return out.withColumn("p_value", _ks_p("ks_stat", "n"))


def yearly_spikes(df: DataFrame, day: str, value: str, q: float = 0.95) -> DataFrame:
    """Days above their own year's quantile and the days since the spike before."""
    flagged = above_group_quantile(df.withColumn("year", F.year(day)), ["year"], value, q)
    spikes = flagged.filter("spike").drop("spike").withColumn("_all", F.lit(1))
    return days_since_previous(spikes, ["_all"], day, "days_since").drop("_all")


def spike_events(
    train: DataFrame, keys: Sequence[str], ts: str, value: str, q: float = 0.9
) -> DataFrame:
    """Calendar of instants above the training quantile, one row per instant."""
    flagged = above_group_quantile(train, keys, value, q).filter("spike")
    return (
        flagged.select(*keys, F.col(ts).alias("ds"))
        .dropDuplicates([*keys, "ds"])
        .withColumn("holiday", F.lit("congestion_spike"))
    )


def spike_thresholds(
    train: DataFrame, keys: Sequence[str], value: str, qs: dict[str, float]
) -> DataFrame:
    return quantiles(train, keys, value, qs)
