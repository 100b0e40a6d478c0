"""Registered queries run the operator's whole job: all resamples, all gates, all points."""

from parallaxis.plans import registry
from parallaxis.plans.fixtures import view

SF = "/root/testdata/sf0.001"


def test_resamples_gates_and_points_are_whole(spark):
    assert registry.queries()["b1_boot_weights"](spark, SF).select("b").distinct().count() == 2000
    gates = view(spark, SF, "fx_sweep_gates")
    assert gates.count() == 84 and sorted(r.s_gate for r in gates.select("s_gate").distinct().collect()) == [0.25 * k for k in range(7)]
    assert view(spark, SF, "fx_lattice").count() == view(spark, SF, "fx_truth").count()
