"""Headline queries, timed: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.queries import QUERIES  # noqa: E402
from tidemark.session import local_session  # noqa: E402

HEADLINE = [
    "a01_resample_mean",
    "a02_resample_sweep",
    "m23_clean_series",
    "m22_fee_features",
    "m24_supervised_matrix",
    "a03_describe",
    "a19_spearman_matrix",
    "t01_decompose_additive",
    "t02_autocorrelation",
    "t04_decay_ratio",
    "t05_adf_test",
    "m06_encoder_windows",
    "m14_holt_winters_cv",
    "m15_seasonal_arma",
    "m16_boosted_trees",
    "m19_additive_grid_search",
    "m20_backtest_naive_expanding",
    "m20_backtest_holt_winters_expanding",
    "m20_backtest_arma_expanding",
    "m21_leaderboard_baselines",
    "m21_leaderboard_all_models",
    "st2_resample_stream",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = local_session("bench", cpus)
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total wall-clock of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
