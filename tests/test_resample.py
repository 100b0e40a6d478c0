"""Resamples by splitting: exact totals, the law of draws, the same accuracy as by weights, whatever the partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parallaxis.operators import compare as cp, resample as rs


@pytest.mark.parametrize("size", [1, 2, 5, 256, 257, 700])
def test_counts_are_multinomial(size):
    n_boot = 4000 if size < 300 else 400
    w = np.concatenate([rs.block_counts(b, size, n_boot, 3) for b in range(-(-size // rs.BLOCK))])
    assert w.shape == (size, n_boot) and (w.sum(axis=0) == size).all() and w.min() >= 0
    if size > 2:
        drawn = np.random.default_rng(1).multinomial(size, [1 / size] * size, n_boot).T
        for k in range(4):  # shares of cases that are in a resample k times
            a, b = (w == k).mean(), (drawn == k).mean()
            assert abs(a - b) < 5 * np.sqrt(b / (size * n_boot)) + 1e-4
        mean = w.mean(axis=1)
        assert abs(mean - 1).max() < 6 * np.sqrt(1 / n_boot)
        pair = np.cov(w[0], w[-1])[0, 1]
        assert abs(pair + 1 / size) < 6 / np.sqrt(n_boot)
    other = np.concatenate([rs.block_counts(b, size, n_boot, 4) for b in range(-(-size // rs.BLOCK))])
    assert size == 1 or (w != other).any()


def test_accuracy_equals_that_of_the_same_weights(spark):
    rng = np.random.default_rng(8)
    rows = [(f"c{k}", int(n), float(n * 0.3 * rng.normal()), 0.0) for k, n in enumerate(rng.integers(0, 9, 300))]
    rows = [(c, n, s1, float(s1 * s1 / max(n, 1) + n * rng.random())) for c, n, s1, _ in rows]
    sums = spark.createDataFrame(rows, "case_id string, n long, s1 double, s2 double")
    arrays = rs.boot_arrays(sums, 50, 7)
    again = {r.case_id: r.w for r in rs.boot_arrays(sums.repartition(7), 50, 7).collect()}
    assert again == {r.case_id: r.w for r in arrays.collect()} and len(again) == 300
    weights = arrays.select("case_id", F.posexplode("w").alias("b", "w")).where("w > 0").select(F.col("b").cast("long").alias("b"), "case_id", F.col("w").cast("long").alias("w"))
    want = {r.b: r for r in cp.boot_metrics(sums, weights).collect()}
    got = {r.b: r for r in rs.boot_accuracy(sums, 50, 7).collect()}
    assert set(got) == set(want) == set(range(50))
    for b, r in got.items():
        for name in ("bias", "rmse_raw", "rmse_corr", "within", "between", "n_points"):
            assert r[name] == pytest.approx(want[b][name], rel=1e-9)


def test_resamples_that_score_nothing(spark):
    sums = spark.createDataFrame([("a", 3, 0.6, 0.2)] + [(f"z{k}", 0, 0.0, 0.0) for k in range(5)], "case_id string, n long, s1 double, s2 double")
    w = {r.case_id: r.w for r in rs.boot_arrays(sums, 60).collect()}["a"]
    rows = {r.b: r for r in rs.boot_accuracy(sums, 60).collect()}
    assert 0 in w and all((rows[b].bias is None) == (k == 0) and rows[b].rmse_corr is None or k > 0 for b, k in enumerate(w))
    assert rs.boot_accuracy(sums.where("false"), 10).count() == 0 and rs.boot_arrays(sums.where("false"), 10).count() == 0
