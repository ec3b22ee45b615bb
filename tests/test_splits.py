import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import splits
from tidemark.operators.reshape import assign_folds, future_grid, parameter_grid, with_configs

KEYS = ["series_id"]


def sizes(spark, *lengths):
    return spark.createDataFrame([(f"s{n}", n) for n in lengths], "series_id string, n bigint")


def edges(df, series):
    rows = df.filter(F.col("series_id") == series).orderBy("fold").collect()
    assert [r.fold for r in rows] == list(range(1, len(rows) + 1))
    return [(r.train_start, r.train_end, r.test_start, r.test_end) for r in rows]


@pytest.mark.parametrize("n", [20, 31, 34, 35, 64, 100])
def test_weekly_folds(spark, n):
    week, h = 28, 4
    made = {
        m: edges(splits.weekly_folds(sizes(spark, n), KEYS, m, week, h), f"s{n}")
        for m in ("expanding", "sliding", "reverse")
    }
    expanding, sliding, reverse = [], [], []
    i = 1
    while i * week + h <= n:
        expanding.append((0, i * week, i * week, i * week + h))
        sliding.append(((i - 1) * week, i * week, i * week, i * week + h))
        i += 1
    for k in range(1, (n - h) // week + 1):
        reverse.append((n - h - k * week, n - h, n - h, n))
    assert made == {"expanding": expanding, "sliding": sliding, "reverse": reverse}


def test_unknown_mode(spark):
    with pytest.raises(ValueError, match="mode"):
        splits.weekly_folds(sizes(spark, 50), KEYS, "sideways", 28, 4)


def test_other_folds(spark):
    s = sizes(spark, 100, 5)
    assert edges(splits.counted_folds(s, KEYS, 3, 10), "s100") == [
        (0, 22 * i, 22 * i, 22 * i + 10) for i in (1, 2, 3)
    ]
    assert edges(splits.window_folds(s, KEYS, 50, 15, 10), "s100") == [
        (15 * i, 15 * i + 50, 15 * i + 50, 15 * i + 60) for i in (0, 1, 2)
    ]
    cutoffs = [c for c in range(99 - 10, -1, -20) if c >= 30][::-1]
    assert edges(splits.rolling_origin_folds(s, KEYS, 30, 20, 10), "s100") == [
        (0, c + 1, c + 1, c + 11) for c in cutoffs
    ]
    for folds in (
        splits.counted_folds(s, KEYS, 3, 10),
        splits.window_folds(s, KEYS, 50, 15, 10),
        splits.rolling_origin_folds(s, KEYS, 30, 20, 10),
    ):
        assert edges(folds, "s5") == []


@pytest.mark.parametrize("chunk", [7, 1000])
def test_fold_assignment(spark, chunk):
    rows = spark.createDataFrame([("s100", i) for i in range(100)], "series_id string, pos bigint")
    folds = splits.weekly_folds(sizes(spark, 100), KEYS, "sliding", 28, 4)
    got = assign_folds(rows, folds, KEYS, "pos", chunk).toPandas()
    for fold, (a, b, c, d) in enumerate(edges(folds, "s100"), 1):
        part = got[got.fold == fold]
        assert sorted(part[part.part == "train"].pos) == list(range(a, b))
        assert sorted(part[part.part == "test"].pos) == list(range(c, d))


@pytest.mark.parametrize("n,h,train,valid", [(100, 10, 90, 100), (10, 0, 10, 10), (1, 1, 0, 1)])
def test_split_by_index(spark, n, h, train, valid):
    df = spark.range(n).withColumnRenamed("id", "time_idx")
    a, b = splits.split_by_index(df, h)
    assert (a.count(), b.count()) == (train, valid)


def test_scaling(spark):
    df = spark.createDataFrame(
        [(1.0, 5.0, 1.0), (3.0, 5.0, 2.0)], "x double, const double, price_USD double"
    )
    assert splits.scaled_columns(df) == ["x", "const"]
    other = spark.createDataFrame([(5.0, 6.0, 9.0)], df.schema)
    train, valid = splits.standard_scale(df, [other])
    assert [tuple(r) for r in train.orderBy("x").collect()] == [(-1, 0, 1), (1, 0, 2)]
    assert tuple(valid.first()) == (3.0, 1.0, 9.0)
    keyed = df.withColumn("g", F.lit("a"))
    got = splits.min_max_scale(keyed, ["g"], "x").orderBy("x").collect()
    assert [r.scaled for r in got] == [1.0, 2.0]
    shifted = splits.min_max_scale(keyed, ["g"], "x", 0.0, 1.0).agg(F.min("scaled")).first()[0]
    assert shifted == pytest.approx(1e-3)


@pytest.mark.parametrize("chunk,stride", [(1, 1), (16, 3), (10_000, 5)])
def test_encoder_windows(spark, chunk, stride):
    enc, low, h = 6, 3, 2
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"series_id": ["a"] * 70 + ["b"] * 4, "pos": [*range(70), *range(4)]})
    pdf["v"] = rng.normal(size=74)
    pdf["x"] = rng.normal(size=74)
    sdf = spark.createDataFrame(pdf)
    got = splits.encoder_windows(
        sdf, KEYS, "pos", "v", enc, low, h, stride, ["x"], chunk=chunk
    ).toPandas()
    v, x = pdf[pdf.series_id == "a"]["v"].to_numpy(), pdf[pdf.series_id == "a"]["x"].to_numpy()
    want = list(range(low, 70 - h + 1, stride))
    assert sorted(got["origin"]) == want and set(got["series_id"]) == {"a"}
    for r in got.itertuples():
        start = max(0, r.origin - enc)
        assert np.allclose(r.encoder, v[start : r.origin])
        assert np.allclose(r.encoder_x, x[start : r.origin])
        assert np.allclose(r.decoder, v[r.origin : r.origin + h])
    last = splits.encoder_windows(sdf, KEYS, "pos", "v", enc, low, h, last_only=True, chunk=chunk)
    assert [(r.series_id, r.origin) for r in last.collect()] == [("a", 68)]


def test_grids(spark):
    grid = parameter_grid(
        spark, {"a": [1, 2], "b": ["x", None]}, "a int, b string", keep=lambda c: c["a"] == 1 or c["b"]
    )
    assert grid.count() == 3
    rows = spark.createDataFrame([("s", 1)], "series_id string, n int")
    assert sorted((r.a, r.b or "") for r in with_configs(rows, grid).collect()) == [(1, ""), (1, "x"), (2, "x")]
    assert splits.sample_configs(grid, 2, 1).collect() == splits.sample_configs(grid, 2, 1).collect()
    ahead = future_grid(spark.createDataFrame([("s", 5), ("s", 9)], "series_id string, slot bigint"), KEYS, "slot", 3)
    assert sorted((r.step, r.slot) for r in ahead.collect()) == [(1, 10), (2, 11), (3, 12)]
