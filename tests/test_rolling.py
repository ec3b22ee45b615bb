"""Fold forecasters from running sums against the ones that copy the history into each fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import forecast as fc
from tidemark.operators import rolling
from tidemark.operators.reshape import assign_folds
from tidemark.operators.splits import lengths, weekly_folds
from tidemark.plans.prefix import sums_before
from tidemark.session import durable

KEYS = ["series_id"]
M, WEEK, H, N = 6, 30, 6, 200


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(7)
    rows = []
    for k, s in enumerate(("a", "b", None)):
        t = np.arange(N - 20 * k)
        y = 20 + 0.02 * t + 4 * np.sin(2 * np.pi * t / M) + rng.normal(size=len(t))
        rows += [(s, int(i), float(v)) for i, v in zip(t, y)]
    rows += [("short", i, 1.0 + i) for i in range(10)]
    return durable(spark.createDataFrame(rows, "series_id string, pos bigint, value double"))


@pytest.mark.parametrize("chunk", [16, 10_000])
def test_sums_before_any_mark(spark, df, chunk):
    marks = df.filter("pos % 7 = 0").select("series_id", F.col("pos").alias("x"))
    marks = marks.union(spark.createDataFrame([("a", 10_000), ("none", 3)], "series_id string, x bigint"))
    got = sums_before(df, KEYS, "pos", ["value"], marks, lambda at, c: np.column_stack([c["value"], at]), 2, 3, chunk)
    rows = df.toPandas()
    for r in got.collect():
        mine = rows[(rows.series_id.isna() if r.series_id is None else rows.series_id == r.series_id) & (rows.pos < r.x)]
        assert np.allclose(r.sums, [mine.value.sum(), mine.pos.sum()])
    assert got.count() == marks.distinct().count()


@pytest.mark.parametrize("mode", ["expanding", "sliding", "reverse"])
def test_arma_and_naive_equal_the_copying_forms(spark, df, mode):
    named = df.filter("series_id is not null")
    folds = durable(weekly_folds(lengths(named, KEYS, "pos"), KEYS, mode, WEEK * 2, H))
    assigned = durable(assign_folds(named, folds, KEYS, "pos"))
    pairs = [
        (fc.seasonal_arma(assigned, KEYS, "pos", "value", M), rolling.arma_folds(named, folds, KEYS, "pos", "value", M, 40, False)),
        (fc.seasonal_naive(assigned, KEYS, "pos", "value", M), rolling.naive_folds(named, folds, KEYS, "pos", "value", M)),
    ]
    for old, new in pairs:
        want = {(r.series_id, r.fold, r.pos): r.y_pred for r in old.collect()}
        got = {(r.series_id, r.fold, r.pos): r.y_pred for r in new.collect()}
        assert want.keys() == got.keys() and len(want) > 0
        assert np.allclose([got[k] for k in want], list(want.values()), rtol=1e-6)


def test_null_series_and_missing_values(spark, df):
    sizes = lengths(df, KEYS, "pos")
    folds = durable(fc.last_day_fold(sizes, KEYS, H))
    holes = df.withColumn("value", F.when((F.col("series_id") == "b") & (F.col("pos") % 50 == 3), None).otherwise(F.col("value")))
    got = rolling.arma_folds(holes, folds, KEYS, "pos", "value", M).collect()
    told = {s: [r.y_pred for r in got if r.series_id == s] for s in ("a", "b", None)}
    assert all(len(v) == H and None not in v for v in told.values())
    late = df.withColumn("value", F.when(F.col("pos") == N - H - 1, None).otherwise(F.col("value")))
    got = [r.y_pred for r in rolling.arma_folds(late, folds, KEYS, "pos", "value", M).filter("series_id = 'a'").collect()]
    assert got == [None] * H
    assert not rolling.arma_folds(df.limit(0), folds, KEYS, "pos", "value", M).collect()


def test_history_is_read_once(spark, df):
    """Rows that leave the scan do not grow with the number of folds."""
    counts = []
    for week in (60, 12):
        folds = durable(weekly_folds(lengths(df, KEYS, "pos"), KEYS, "expanding", week, H))
        tails = rolling.fold_tails(df, folds, KEYS, "pos", 2 * (M + 1))
        counts.append((folds.count(), tails.count()))
    assert counts[1][1] <= counts[1][0] * 2 * (M + 1)


def plain_roots_inside(ar):
    return (np.abs(np.roots([1.0, *(-np.asarray(ar))])) < 1).all()


def test_stable_region_by_reflections():
    rng = np.random.default_rng(8)
    for _ in range(200):
        ar = rng.normal(size=rng.integers(1, 9)) * 0.8
        inside = (np.abs(rolling.reflections(ar)) < 1).all()
        assert inside == plain_roots_inside(ar)
        drawn = rolling.stable(ar)
        assert plain_roots_inside(drawn)
        if inside and (np.abs(rolling.reflections(ar)) < 1 - 1e-6).all():
            assert (drawn == ar).all()


def test_explosive_series_stay_bounded(spark):
    rows = [("x", i, float(np.expm1(1.05 ** (i / 2)))) for i in range(120)]
    df = spark.createDataFrame(rows, "series_id string, pos bigint, value double")
    folds = fc.last_day_fold(lengths(df, KEYS, "pos"), KEYS, H)
    got = rolling.arma_folds(df, folds, KEYS, "pos", "value", M).collect()
    assert len(got) == H and all(r.y_pred is not None and np.isfinite(r.y_pred) for r in got)
