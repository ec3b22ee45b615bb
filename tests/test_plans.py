import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.clean import interpolate, onto_grid, regular_grid
from tidemark.operators.correlation import pearson_matrix, spearman_matrix
from tidemark.plans.chunks import over_halo, running_sum
from tidemark.plans.gram import gram, matrix, packed, solve
from tidemark.plans.lookup import attach
from tidemark.plans.order import (
    average_ranks,
    over_rows,
    positions,
    quantiles,
    running_counts,
    value_counts,
)


@pytest.fixture(scope="module")
def skewed():
    """Three groups; 'hot' holds most rows and one value fills a third of it."""
    rng = np.random.default_rng(3)
    hot = np.where(rng.random(300) < 0.33, 5.0, rng.normal(5, 3, 300).round(2))
    return pd.DataFrame(
        {
            "g": ["hot"] * 300 + ["small"] * 20 + ["one"],
            "id": range(321),
            "v": np.concatenate([hot, rng.normal(0, 1, 20), [7.0]]),
        }
    )


def by_group(df, col):
    return df.set_index("g")[col].to_dict()


def test_quantiles_match_pandas(spark, skewed):
    got = quantiles(
        spark.createDataFrame(skewed), ["g"], "v", {"q1": 0.25, "med": 0.5, "q9": 0.9}
    ).toPandas()
    for name, q in {"q1": 0.25, "med": 0.5, "q9": 0.9}.items():
        want = skewed.groupby("g")["v"].quantile(q).to_dict()
        assert by_group(got, name) == pytest.approx(want)


def test_positions_are_row_numbers(spark, skewed):
    got = positions(spark.createDataFrame(skewed), ["g"], ["v", "id"], "p").toPandas()
    want = skewed.sort_values(["g", "v", "id"]).copy()
    want["p"] = want.groupby("g").cumcount()
    merged = got.merge(want, on=["g", "id"])
    assert len(merged) == len(skewed)
    assert (merged["p_x"] == merged["p_y"]).all()


def test_average_ranks_with_ties(spark, skewed):
    counts = value_counts(spark.createDataFrame(skewed), ["g"], "v")
    got = average_ranks(counts, ["g"], "v").toPandas()
    want = skewed.assign(rank=skewed.groupby("g")["v"].rank()).drop_duplicates(["g", "v"])
    merged = got.merge(want, on=["g", "v"])
    assert len(merged) == len(got) == len(want)
    assert np.allclose(merged["rank_x"], merged["rank_y"])


def test_running_counts_over_all_digits(spark):
    """Values that differ in every digit of their keys, with signs, infinities and whole numbers."""
    rng = np.random.default_rng(2)
    real = np.unique(np.concatenate([np.arange(-500.0, 500), rng.normal(size=500) * 10.0 ** rng.integers(-300, 300, 500), [np.inf, -np.inf, 5e-324]]))
    whole = np.unique(rng.integers(-(2**62), 2**62, 300)).tolist() + [2**62, 2**62 + 1]
    for values, kind in ((real.tolist(), "double"), (whole, "bigint")):
        rows = [(g, v, w) for g in ("a", None) for v, w in zip(values, rng.integers(1, 9, len(values)).tolist())]
        counts = spark.createDataFrame(rows, f"g string, v {kind}, _w bigint")
        got = {(r.g, r.v): (r._before, r.total) for r in running_counts(counts, ["g"], "v", total="total").collect()}
        for g in ("a", None):
            before, mine = 0, sorted((v, w) for k, v, w in rows if k == g)
            for v, w in mine:
                assert got[g, v] == (before, sum(x for _, x in mine))
                before += w
    with pytest.raises(TypeError):
        running_counts(spark.createDataFrame([("x", 1)], "v string, _w bigint"), [], "v")


def test_over_rows_lag(spark, skewed):
    sdf = spark.createDataFrame(skewed)
    got = over_rows(
        sdf, ["g"], ["v", "id"], lambda w: {"prev": F.lag("id").over(w)}, before=1
    ).toPandas()
    want = skewed.sort_values(["g", "v", "id"]).copy()
    want["prev"] = want.groupby("g")["id"].shift()
    merged = got.merge(want, on=["g", "id"])
    assert merged["prev_x"].fillna(-1).tolist() == merged["prev_y"].fillna(-1).tolist()


@pytest.mark.parametrize(
    "kwargs",
    [{}, {"large": 0}, {"large": 0, "broadcast_limit": 0}],
    ids=["small", "broadcast", "salted"],
)
def test_attach_keeps_every_row_once(spark, skewed, kwargs):
    sdf = spark.createDataFrame(skewed)
    stats = sdf.filter("g <> 'one'").groupBy("g").agg(F.max("v").alias("top"))
    got = attach(sdf, stats, ["g"], ["id"], **kwargs).toPandas()
    assert sorted(got["id"]) == list(range(321))
    assert got[got.g == "one"]["top"].isna().all()
    assert (got[got.g == "hot"]["top"] == skewed[skewed.g == "hot"]["v"].max()).all()


def test_windows_cross_chunks(spark):
    pdf = pd.DataFrame({"s": ["a"] * 50 + ["b"] * 7, "pos": [*range(50), *range(7)]})
    pdf["v"] = np.random.default_rng(1).normal(size=57)
    got = over_halo(
        spark.createDataFrame(pdf),
        ["s"],
        "pos",
        lambda w: {
            "lag3": F.lag("v", 3).over(w),
            "mean": F.avg("v").over(w.rowsBetween(-3, 2)),
        },
        before=3,
        after=2,
        chunk=4,
    ).toPandas()
    got = got.sort_values(["s", "pos"]).reset_index(drop=True)
    assert len(got) == 57
    assert np.allclose(got["lag3"], pdf.groupby("s")["v"].shift(3), equal_nan=True)
    for row in got.itertuples():
        part = pdf[(pdf.s == row.s) & pdf.pos.between(row.pos - 3, row.pos + 2)]
        assert row.mean == pytest.approx(part["v"].mean())


def test_running_sum_over_chunks(spark):
    pdf = pd.DataFrame({"s": "a", "pos": range(23), "v": np.arange(23.0)})
    got = running_sum(spark.createDataFrame(pdf), ["s"], "pos", F.col("v"), "c", chunk=5)
    got = got.toPandas().sort_values("pos")
    assert got["c"].tolist() == pdf["v"].cumsum().tolist()


@pytest.mark.parametrize("chunk", [2, 3, 1000])
def test_interpolation_matches_pandas(spark, chunk):
    a = [None, 1.0, None, None, 4.0, None]
    rng = np.random.default_rng(5)
    b = [None if rng.random() < 0.7 else float(rng.normal()) for _ in range(60)]
    pdf = pd.DataFrame({"s": ["a"] * 6 + ["b"] * 60, "pos": [*range(6), *range(60)]})
    pdf["v"] = pd.array([*a, *b], dtype="Float64")
    rows = [
        (s, int(p), None if pd.isna(v) else float(v))
        for s, p, v in pdf.itertuples(index=False)
    ]
    sdf = spark.createDataFrame(rows, "s string, pos bigint, v double")
    got = interpolate(sdf, ["s"], "pos", ["v"], chunk).toPandas().sort_values(["s", "pos"])
    want = pdf.assign(v=pdf["v"].astype(float)).groupby("s")["v"].transform(
        lambda x: x.interpolate("linear")
    )
    assert np.allclose(got["v"].to_numpy(), want.to_numpy(), equal_nan=True)
    first = got[got.s == "a"]["v"].tolist()
    assert np.isnan(first[0]) and first[1:] == [1, 2, 3, 4, 4]


def test_grid_is_complete_for_every_series(spark):
    binned = spark.createDataFrame(
        [("a", 10, 1.0), ("a", 13, 2.0), ("b", 12, 3.0), ("b", 31, 4.0)],
        "s string, slot bigint, v double",
    )
    grid = regular_grid(binned, ["s"], chunk=4).toPandas()
    assert len(grid) == 44 and grid.groupby("s")["slot"].nunique().tolist() == [22, 22]
    full = onto_grid(binned, ["s"], 900, chunk=4).toPandas()
    assert full["v"].notna().sum() == 4
    assert (full["pos"] == full["slot"] - 10).all()


def test_gram_solves_least_squares(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": ["a"] * 80 + ["b"] * 40, "one": 1.0})
    pdf["x"] = rng.normal(size=120)
    pdf["y"] = 3 + 2 * pdf["x"] + rng.normal(size=120) * 0.1
    pdf.loc[5, "x"] = np.nan
    sdf = spark.createDataFrame(pdf)
    for row in packed(gram(sdf, ["g"], ["one", "x", "y"]), ["g"]).collect():
        part = pdf[(pdf.g == row.g) & pdf.x.notna()]
        want = np.linalg.lstsq(part[["one", "x"]], part["y"], rcond=None)[0]
        coef, ssr = solve(matrix(np.asarray(row.gram), 3), [0, 1], 2)
        assert np.allclose(coef, want)
        assert ssr == pytest.approx(((part["y"] - part[["one", "x"]] @ want) ** 2).sum())


def test_correlations_match_pandas(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame(rng.normal(size=(60, 3)).round(1), columns=["a", "b", "c"])
    pdf["b"] += pdf["a"]
    gaps = pdf.mask(rng.random(pdf.shape) < 0.2)
    rows = [tuple(None if pd.isna(x) else float(x) for x in r) for r in gaps.itertuples(index=False)]
    sdf = spark.createDataFrame(rows, "a double, b double, c double")

    def cells(df):
        return {(r.x, r.y): r.r for r in df.collect()}

    def check(got, want):
        for (x, y), r in got.items():
            assert r == pytest.approx(want.loc[x, y]), (x, y)
        assert len(got) == 9

    names = ["a", "b", "c"]
    check(cells(pearson_matrix(sdf, names)), gaps.corr())
    check(cells(spearman_matrix(sdf, names)), gaps.corr("spearman"))
    check(cells(spearman_matrix(sdf, names, "listwise")), gaps.dropna().corr("spearman"))
    check(cells(spearman_matrix(spark.createDataFrame(pdf), names)), pdf.corr("spearman"))
    row = cells(spearman_matrix(sdf, names, target="b"))
    assert set(row) == {(x, y) for x in names for y in names if "b" in (x, y)}
    for (x, y), r in row.items():
        assert r == pytest.approx(gaps.corr("spearman").loc[x, y])


def test_many_columns_are_ranked_once_per_null_pattern(spark):
    """80 columns with two patterns of gaps: rows are copied per pair of patterns, not per pair of columns."""
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame(rng.normal(size=(60, 80)).round(1), columns=[f"c{i}" for i in range(80)])
    for c in pdf.columns[50:]:
        pdf.loc[pdf.index % 5 == 1, c] = np.nan
    rows = [tuple(None if pd.isna(x) else float(x) for x in r) for r in pdf.itertuples(index=False)]
    sdf = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in pdf.columns))
    from tidemark.operators.correlation import _patterns

    assert [len(g) for g in _patterns(sdf, pdf.columns)] == [50, 30]
    want = pdf.corr("spearman")
    got = {(r.x, r.y): r.r for r in spearman_matrix(sdf, list(pdf.columns)).collect()}
    assert len(got) == 6400
    assert all(r == pytest.approx(want.loc[x, y]) for (x, y), r in got.items())


def test_constant_and_empty_columns_have_no_correlation(spark):
    sdf = spark.createDataFrame([(float(i), 7.3, None) for i in range(9)], "a double, k double, e double")
    for matrix_of in (pearson_matrix, spearman_matrix):
        got = {(r.x, r.y): (r.r, r.n) for r in matrix_of(sdf, ["a", "k", "e"]).collect()}
        assert got["a", "a"] == (1.0, 9) and got["a", "k"] == (None, 9)
        assert got.get(("a", "e"), (None, 0)) == (None, 0)


def test_lookup_by_counted_keys_repeats_nothing(spark, skewed):
    from tidemark.plans.lookup import attach_counted

    sdf = spark.createDataFrame([(g if g != "one" else None, i) for g, i in zip(skewed.g, skewed.id)], "g string, id bigint")
    table = sdf.groupBy("g").agg(F.count(F.lit(1)).alias("_w"), F.max("id").alias("top"))
    for heavy in (1, 2, 1000):  # no key, one key and every key heavy
        got = attach_counted(sdf, table, ["g"], "_w", heavy)
        assert sorted(r.id for r in got.collect()) == list(range(321))
        assert {(r.g, r.top) for r in got.collect()} == {("hot", 299), ("small", 319), (None, 320)}
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan  # nothing is exploded


def test_null_keys_meet_in_lookups(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "k string, v int")
    stats = spark.createDataFrame([("a", 10), (None, 20)], "k string, s int")
    for large in (None, 0):  # salted, broadcast
        got = attach(df, stats, ["k"], ["v"], large=large).collect()
        assert sorted((r.v, r.s) for r in got) == [(1, 10), (2, 20), (3, 20)]
