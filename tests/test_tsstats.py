import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import special
from tidemark.operators import aggregates, tsstats
from tidemark.session import durable

KEYS = ["s"]


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(11)
    n = 160
    e = rng.normal(size=n)
    ar = np.zeros(n)
    for t in range(1, n):
        ar[t] = 0.6 * ar[t - 1] + e[t]
    season = 10 + 3 * np.sin(2 * np.pi * np.arange(n) / 8) + 0.02 * np.arange(n) + ar * 0.3
    return {"ar": ar, "seasonal": season}


@pytest.fixture(scope="module")
def df(spark, series):
    rows = [(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)]
    return durable(spark.createDataFrame(rows, "s string, pos bigint, v double"))


@pytest.mark.parametrize("model", ["additive", "multiplicative"])
def test_decomposition(df, series, model):
    got = tsstats.decompose(df.filter("s = 'seasonal'"), KEYS, "pos", "v", 8, model, chunk=10)
    got = got.toPandas().sort_values("pos")
    x = series["seasonal"]
    w = np.r_[0.5, np.ones(7), 0.5] / 8
    trend = np.full(len(x), np.nan)
    trend[4:-4] = np.convolve(x, w, "valid")
    rest = x - trend if model == "additive" else x / trend
    phase = np.array([np.nanmean(rest[p::8]) for p in range(8)])
    phase = phase - phase.mean() if model == "additive" else phase / phase.mean()
    tiled = np.resize(phase, len(x))
    assert np.allclose(got["trend"], trend, equal_nan=True)
    assert np.allclose(got["seasonal"], tiled)
    back = got.trend + got.seasonal + got.resid if model == "additive" else got.trend * got.seasonal * got.resid
    assert np.allclose(back.dropna(), x[4:-4])


def test_decomposition_rejects_model(df):
    with pytest.raises(ValueError):
        tsstats.decompose(df, KEYS, "pos", "v", 8, "other")


def plain_acf(x, k):
    c = x - x.mean()
    return np.array([(c[j:] @ c[: len(c) - j]) / (c @ c) for j in range(k + 1)])


@pytest.mark.parametrize("chunk", [5, 10_000])
def test_acf_and_band(df, series, chunk):
    got = tsstats.acf(df, KEYS, "pos", "v", 20, chunk).toPandas()
    for k, x in series.items():
        part = got[got.s == k].sort_values("lag")
        want = plain_acf(x, 20)
        assert np.allclose(part["acf"], want)
        var = np.r_[0, (1 + 2 * np.r_[0, np.cumsum(want[1:-1] ** 2)]) / len(x)]
        assert np.allclose(part["band"], 1.959963984540054 * np.sqrt(var))


@pytest.mark.parametrize("adjusted", [True, False])
def test_pacf_is_last_yule_walker_coefficient(df, series, adjusted):
    got = tsstats.pacf(df, KEYS, "pos", "v", 6, adjusted).toPandas()
    for name, x in series.items():
        n, c = len(x), x - x.mean()
        r = np.array([(c[j:] @ c[: n - j]) / ((n - j) if adjusted else n) for j in range(7)])
        part = got[got.s == name].sort_values("lag")["pacf"].to_numpy()
        for k in range(1, 7):
            m = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
            assert part[k] == pytest.approx(np.linalg.solve(m, r[1 : k + 1])[-1])


def plain_adf(x):
    n, d = len(x), np.diff(x)
    p = min(n // 2 - 2, math.ceil(12 * (n / 100) ** 0.25))

    def fit(lag, start):
        rows = range(start, n)
        a = np.array([[1, x[t - 1], *[d[t - 1 - j] for j in range(1, lag + 1)]] for t in rows])
        y = d[start - 1 :]
        b = np.linalg.lstsq(a, y, rcond=None)[0]
        return a, y, b, ((y - a @ b) ** 2).sum()

    def aic(lag):
        a, y, _, ssr = fit(lag, p + 1)
        return len(y) * math.log(ssr / len(y)) + 2 * a.shape[1]

    best = min(range(p + 1), key=aic)
    a, y, b, ssr = fit(best, best + 1)
    se = math.sqrt(ssr / (len(y) - a.shape[1]) * np.linalg.inv(a.T @ a)[1, 1])
    return b[1] / se, best, len(y)


@pytest.mark.parametrize("chunk", [8, 10_000])
def test_adf_matches_direct_regressions(df, series, chunk):
    for r in tsstats.adf_test(df, KEYS, "pos", "v", chunk=chunk).collect():
        stat, lag, nobs = plain_adf(series[r.s])
        assert (r.used_lag, r.nobs) == (lag, nobs)
        assert r.adf_stat == pytest.approx(stat, rel=1e-6)
        assert r.p_value == pytest.approx(special.adf_p_value(stat), rel=1e-5)
        assert r.crit_1 < r.crit_5 < r.crit_10


def test_adf_short_group_has_no_result(df):
    r = tsstats.adf_test(df.filter("s = 'ar' AND pos < 20"), KEYS, "pos", "v").first()
    assert r.n == 20 and r.adf_stat is None


def test_ljung_box_and_arch(df, series):
    got = {r.s: r for r in tsstats.ljung_box(df, KEYS, "pos", "v", 12).collect()}
    arch = {r.s: r for r in tsstats.arch_lm(df, KEYS, "pos", "v", chunk=16).collect()}
    for k, x in series.items():
        n, r = len(x), plain_acf(x, 12)[1:]
        q = n * (n + 2) * (r**2 / (n - np.arange(1, 13))).sum()
        assert got[k].q_stat == pytest.approx(q)
        assert got[k].p_value == pytest.approx(special.chi2_sf(q, 12))
        e2 = x**2
        a = np.array([[1, *e2[t - 10 : t][::-1]] for t in range(10, n)])
        y = e2[10:]
        b = np.linalg.lstsq(a, y, rcond=None)[0]
        lm = len(y) * (1 - ((y - a @ b) ** 2).sum() / ((y - y.mean()) ** 2).sum())
        assert arch[k].lm_stat == pytest.approx(lm, rel=1e-6) and arch[k].lags == 10


def test_qq_line(df, series):
    got = tsstats.qq_pairs(df.filter("s = 'ar'"), KEYS, "pos", "v").toPandas().sort_values("theoretical")
    x = np.sort(series["ar"])
    assert np.allclose(got["v"], x)
    n = len(x)
    assert got["theoretical"].iloc[-1] == pytest.approx(special.normal_ppf(0.5 ** (1 / n)))
    slope, intercept = np.polyfit(got["theoretical"], x, 1)
    assert got["slope"].iloc[0] == pytest.approx(slope)
    assert got["intercept"].iloc[0] == pytest.approx(intercept)


def test_exponential_ks(spark):
    x = np.sort(np.random.default_rng(4).exponential(3, 50).round(1))
    sdf = spark.createDataFrame([("a", float(v)) for v in x], "s string, v double")
    r = tsstats.exponential_ks(sdf, KEYS, "v").first()
    cdf = 1 - np.exp(-x / x.mean())
    i = np.arange(50)
    assert r.ks_stat == pytest.approx(max((np.arange(1, 51) / 50 - cdf).max(), (cdf - i / 50).max()))
    assert r.rate == pytest.approx(1 / x.mean())


def test_histograms_and_kde_match_numpy(spark):
    x = np.random.default_rng(6).normal(size=200).round(2)
    sdf = spark.createDataFrame([("a", float(v)) for v in x], "s string, v double")
    for bins in (12, "auto"):
        got = aggregates.equal_width_histogram(sdf, KEYS, "v", bins).toPandas().sort_values("bin")
        counts, edges = np.histogram(x, bins)
        assert got["n"].sum() == 200 and len(got) == len(counts)
        assert np.allclose(got["left_edge"], edges[:-1])
        assert np.abs(got["n"].to_numpy() - counts).sum() <= 4  # values on an edge
    k = aggregates.kde_curve(sdf, KEYS, "v").toPandas().sort_values("point")
    bw = x.std(ddof=1) * 200**-0.2
    z = (k["x"].to_numpy()[:, None] - x) / bw
    assert np.allclose(k["density"], np.exp(-0.5 * z**2).sum(1) / (200 * bw * math.sqrt(2 * math.pi)))


def test_modal_gap_keeps_ties(spark):
    base = pd.Timestamp("2025-01-01")
    at = [base + pd.Timedelta(seconds=s) for s in (0, 1, 2, 4, 6, 9)]
    sdf = spark.createDataFrame([("a", t.to_pydatetime()) for t in at], "s string, ts timestamp_ntz")
    got = sorted((r.gap_us, r.n) for r in aggregates.modal_gap(sdf, KEYS, "ts").collect())
    assert got == [(1_000_000, 2), (2_000_000, 2)]


def test_spikes(spark):
    days = pd.date_range("2024-01-01", periods=40).date
    rows = [(d, 100.0 if i in (3, 10) else float(i % 5)) for i, d in enumerate(days)]
    sdf = spark.createDataFrame(rows, "day date, v double")
    got = tsstats.yearly_spikes(sdf, "day", "v", 0.95).orderBy("day").collect()
    assert [r.days_since for r in got] == [None, 7]
    cal = tsstats.spike_events(sdf.withColumn("s", F.lit("x")), KEYS, "day", "v", 0.95)
    assert {r.holiday for r in cal.collect()} == {"congestion_spike"} and cal.count() == 2
