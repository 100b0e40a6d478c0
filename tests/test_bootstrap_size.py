"""Resamples of many cases: no count of them is sent through the driver, and what is grouped gives the same as case by case."""

import math
import re

import pytest
from pyspark.sql import Window, functions as F

from parallaxis.functions.safe import ratio
from parallaxis.operators import compare as cp
from parallaxis.plans import matching, registry  # noqa: F401

SF = "/root/testdata/sf0.1"


def sent_whole(df) -> list[str]:
    """Lines of the plan that draw resamples below a broadcast."""
    found, inside = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        at = re.search(r"[A-Za-z]", line)
        if at is None:
            continue
        if inside is not None and at.start() <= inside:
            inside = None
        if inside is None and "BroadcastExchange" in line:
            inside = at.start()
        elif inside is not None and re.search(r"MapInArrow|Generate explode\(sequence|Range \(0, 2000", line):
            found.append(line)
    return found


def check(spark, name):
    assert sent_whole(registry.queries()[name](spark, SF)) == []


def sums_of(spark):
    rows = [(f"c{k}", k * 7 % 5, (k * 7 % 5) * (0.3 + k % 11 / 10), (k * 7 % 5) * ((0.3 + k % 11 / 10) ** 2 + 0.01 * (k % 3)), k % 4 > 0) for k in range(40)]
    return spark.createDataFrame(rows, "case_id string, n long, s1 double, s2 double, mask boolean")


def same(a, b):
    assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)), (a, b)


def test_b1_counts_stay_out_of_the_driver(spark):
    check(spark, "b1_boot_weights")


def test_draws_are_those_of_the_digests(spark):
    import hashlib

    cases = spark.createDataFrame([(f"c{k:03d}",) for k in range(37)], "case_id string")
    got = {(r.b, r.case_id): r.w for r in cp.boot_weights(cases, 9, 5).collect()}
    want: dict = {}
    for b in range(9):
        for k in range(37):
            key = (b, f"c{int(hashlib.md5(f'5:{b}:{k}'.encode()).hexdigest()[:12], 16) % 37:03d}")
            want[key] = want.get(key, 0) + 1
    assert got == want and cp.boot_weights(cases.where("false"), 9).count() == 0


def test_b3_counts_stay_out_of_the_driver(spark):
    check(spark, "b3_percentile_ci")


def test_b4_counts_stay_out_of_the_driver(spark):
    check(spark, "b4_boot_contrails")


def test_b4_grouped_copies_equal_single_ones(spark):
    rows = [(f"c{k % 13}", k, 0.1 * (k * 17 % 23) - 0.8, k % 5 > 0) for k in range(60)]
    contrails = spark.createDataFrame(rows, "case_id string, contrail long, err double, scored boolean")
    weights = cp.boot_weights(contrails, 25)
    per = contrails.where("scored").groupBy("case_id").agg(F.count("*").alias("n"), F.sum("err").alias("s1"), F.sum(F.col("err") * F.col("err")).alias("s2"))
    x = per.join(weights, "case_id").toPandas()
    got = {r.b: r for r in cp.boot_contrails(contrails, 25).collect()}
    assert len(got) == 25
    for b, d in x.groupby("b"):
        tot, every = (d.w * d.s1).sum(), (d.w * d.n).sum()
        d = d.assign(c=(tot - d.s1) / (every - d.n))
        same(got[b].bias, tot / every)
        same(got[b].rmse_raw, math.sqrt((d.w * d.s2).sum() / every))
        same(got[b].rmse_corr, math.sqrt((d.w * (d.s2 - 2 * d.c * d.s1 + d.n * d.c * d.c)).sum() / every))


def test_d3_counts_stay_out_of_the_driver(spark):
    check(spark, "d3_compare")


def test_b2_counts_stay_out_of_the_driver(spark):
    check(spark, "b2_boot_metrics")


@pytest.mark.parametrize("masked", [False, True])
def test_b2_sums_by_weight_equal_case_by_case(spark, masked):
    sums = sums_of(spark)
    x = sums.join(cp.boot_weights(sums, 30), "case_id")
    mask = F.col("mask") if masked else None
    got = {r.b: r for r in cp.constant_metrics(x.groupBy("b", "w").agg(*[v.alias(k) for k, v in cp.constant_sums(F.col("n"), F.col("s1"), F.col("s2"), mask).items()])).collect()}
    every = Window.partitionBy("b")
    x = x.withColumn("m", ratio(F.col("s1"), F.col("n")))
    own = F.when(F.col("n") > 0, F.col("w")).otherwise(0)
    part = own * F.coalesce("m", F.lit(0.0))
    x = x.withColumn("c", ratio(F.sum(part).over(every) - part, F.sum(own).over(every) - own))
    want = {r.b: r for r in x.groupBy("b").agg(*cp.metric_columns(mask, F.col("w"))).collect()}
    assert set(got) == set(want) == set(range(30))
    for b, r in want.items():
        for name in ("bias", "rmse_raw", "rmse_corr", "within", "between", "n_points"):
            same(got[b][name], r[name])


def test_d9_counts_stay_out_of_the_driver(spark):
    check(spark, "d9_paired_contrails")


def test_n6_counts_stay_out_of_the_driver(spark):
    check(spark, "n6_arms_report")
