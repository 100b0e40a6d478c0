"""A gate that keeps nothing has no accuracy: NULL, never 0; and a gate on s_eff is refused where none was stored."""

import pytest
from pyspark.sql import functions as F

from parallaxis.operators import compare as cp, explore as ex, metrics as mt

METRICS = ("bias", "rmse_raw", "rmse_corr", "within", "between")


@pytest.fixture(scope="module")
def run(spark):
    cases = spark.createDataFrame([(f"c{k}", "ok", 50.0, 1.0) for k in range(6)], "case_id string, qc string, vza_max double, offset_s double")
    rows = [(f"c{k}", 10 * k + i, 10.0 + i, 10.2 + i + 0.1 * k, 0.5 + 0.05 * i, 0.4 * i, 0) for k in range(6) for i in range(5)]
    return cases, spark.createDataFrame(rows, "case_id string, pid long, top_km double, h double, r double, s_eff double, contrail long")


def none(row, names=METRICS):
    return all(row[n] is None for n in names)


def test_accuracy(run):
    row = mt.metrics(mt.case_sums(*run, gate=2.0)).first()
    assert none(row) and row.n_points == 0
    assert none(mt.summary(*run, gate=2.0).first())
    gates = run[0].sparkSession.createDataFrame([(0.6,), (2.0,)], "gate double")
    rows = {r.gate: r for r in mt.gate_ladder(*run, gates).collect()}
    assert none(rows[2.0]) and rows[2.0].r2 is None and not none(rows[0.6])
    x = mt.contrail_summary(mt.contrail_table(*run, gate=2.0)).first()
    assert x.n_scored == 0 and none(x, ("bias", "rmse_raw", "rmse_corr"))


def test_resamples(run):
    """One case alone scores: resamples without it have no values, and the interval is made of the others."""
    cases, profiles = run
    sums = mt.case_sums(cases, profiles.where("case_id = 'c0' or r < 0.6"), gate=0.6)
    weights = cp.boot_weights(sums, 60)
    without = {b for b in range(60)} - {r.b for r in weights.where("case_id = 'c0'").collect()}
    boot = cp.boot_metrics(sums, weights).collect()
    assert without and all(none(r) for r in boot if r.b in without) and all(r.rmse_raw is not None for r in boot if r.b not in without)
    ends = cp.percentile_ci(cp.boot_metrics(sums, weights), "rmse_raw").first()
    assert ends.lo > 0
    joined = cases.select("case_id", F.lit(0).alias("contrail"), F.lit(True).alias("scored"), F.lit(0.3).alias("err")).where("case_id = 'c0'")
    copies = {r.b: r.w for r in weights.where("case_id = 'c0'").collect()}
    one = {r.b: r for r in cp.boot_contrails(joined, weights).collect()}
    assert {1, 2} <= set(copies.values()) and all((r.rmse_corr is None) == (copies[b] == 1) and r.rmse_raw is not None for b, r in one.items())  # a second copy fits the first
    pairs = cp.pair_contrails(joined, joined)
    assert all(r.A is None for r in cp.paired_contrails(pairs, weights).collect() if r.metric == "rmse_corr")
    d2 = {r.metric: r for r in cp.metric_set(cp.pair_runs(*run, *run, gate=2.0)).collect()}
    assert all(d2[f"{m} (common)"].A is None for m in METRICS)


def test_fronts(run):
    spark = run[0].sparkSession
    sweep = ex.gate_sweep(*run, spark.createDataFrame([(0.5, 0.0), (0.6, 0.4), (2.0, 0.0)], "gate double, s_gate double"))
    rows = {r.gate: r for r in sweep.collect()}
    assert rows[2.0].coverage == 0 and rows[2.0].rmse_corr is None and rows[2.0].rmse_raw is None
    assert 2.0 not in {r.gate for r in ex.pareto_front(sweep).collect()}
    best = ex.best_at_coverage(sweep, spark.createDataFrame([(0.0,)], "target double")).first()
    assert best.any_gate is None


def test_a_run_without_s_eff(run):
    cases, profiles = run
    for bare in (profiles.drop("s_eff"), profiles.withColumn("s_eff", F.lit(None).cast("double"))):
        assert mt.case_sums(cases, bare).agg(F.sum("n")).first()[0] > 0
        for refused in (lambda: mt.case_sums(cases, bare, s_min=1.0), lambda: mt.contrail_table(cases, bare, s_min=1.0), lambda: mt.summary(cases, bare, s_min=1.0)):
            with pytest.raises(ValueError, match="s_eff"):
                refused()
    gates = cases.sparkSession.createDataFrame([(0.5, 1.0)], "gate double, s_gate double")
    with pytest.raises(ValueError, match="s_eff"):
        ex.gate_sweep(cases, profiles.drop("s_eff"), gates)
