"""What must hold whatever the data: identities between operators, missing values, partitions."""

import numpy as np
from pyspark.sql import functions as F

from parallaxis.operators import compare, geometry, metrics, stencil, truth
from parallaxis.plans.fixtures import view

SF = "/root/testdata/sf0.001"


def test_corrected_error_splits_into_within_and_between(spark):
    m = metrics.metrics(metrics.case_sums(view(spark, SF, "fx_cases_a"), view(spark, SF, "pa"))).first()
    assert abs(m.rmse_corr**2 - m.within**2 - m.between**2) < 1e-9


def test_missing_values_fail_every_gate(spark):
    rows = spark.createDataFrame([(1, None, 0.9, 2.0), (2, 9.0, None, 2.0), (3, 9.0, 0.9, None), (4, 9.0, 0.6, 2.0), (5, 9.0, 0.7, 1.0)], "pid int, h double, r double, s_eff double")
    assert [r.pid for r in rows.where(metrics.passes(0.6, 1.0)).collect()] == [5]


def test_resamples_draw_every_case_count(spark):
    cases = view(spark, SF, "fx_cases_a")
    n = cases.count()
    sums = compare.boot_weights(cases, 20).groupBy("b").agg(F.sum("w").alias("w")).collect()
    assert len(sums) == 20 and all(r.w == n for r in sums)


def test_projection_round_trip_and_parallax(spark):
    x = geometry.geos_inverse(geometry.geos_forward(view(spark, SF, "fx_lattice"), -75.2), -75.2).toPandas().dropna()
    assert len(x) and np.abs(x.glat - x.lat).max() < 1e-9 and np.abs(x.glon - x.lon).max() < 1e-9
    p = geometry.apparent_position(spark.createDataFrame([(35.0, -110.0)], "lat double, lon double"), 11.0, -75.2).first()
    assert abs(p.alat - 35.089579) < 1e-5 and abs(p.alon + 110.132298) < 1e-5
    k = geometry.disparity_axis(spark.createDataFrame([(35.0, -110.0)], "lat double, lon double")).first()
    assert abs(k.k - 1.884) < 2e-3


def test_field_correlates_with_itself_and_matches_numpy(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(12, 11))
    holes = rng.random(a.shape) < 0.1
    rows = [(i, j, None if holes[i, j] else float(a[i, j]), None if holes[i, j] else float(a[i, j])) for i in range(12) for j in range(11)]
    r = stencil.local_corr(spark.createDataFrame(rows, "i long, j long, a double, b double"), 12, 11, 5).where("r is not null")
    assert r.count() > 0 and r.where("abs(r - 1) > 1e-9").count() == 0


def test_same_result_on_any_number_of_partitions(spark):
    seen = set()
    for n in (1, 4, 16):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        rows = truth.contrail_ids(view(spark, SF, "fx_truth")).select(F.sum(F.xxhash64("case_id", "pid", "contrail").cast("decimal(38,0)"))).first()[0]
        seen.add(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(seen) == 1


def test_wind_is_held_at_both_ends(spark):
    winds = spark.createDataFrame([("a", 6.0, 1.0, 0.0), ("a", 8.0, 3.0, 4.0)], "case_id string, h double, u double, v double")
    points = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 7.0), ("a", 3, 9.0), ("b", 4, 7.0)], "case_id string, pid int, top_km double")
    got = {r.pid: (r.u, r.v) for r in truth.wind_at_height(points, winds, "top_km").collect()}
    assert got == {1: (1.0, 0.0), 2: (2.0, 2.0), 3: (3.0, 4.0), 4: (None, None)}


def test_empty_tables(spark):
    cases, profiles = view(spark, SF, "fx_cases_a").limit(0), view(spark, SF, "pa").limit(0)
    assert metrics.case_sums(cases, profiles).count() == 0
    assert metrics.metrics(metrics.case_sums(cases, profiles)).first().bias is None
