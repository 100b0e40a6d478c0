"""Gate sweeps and what is read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.safe import few, ratio, root
from .metrics import ERROR, gate_ladder, usable, with_s_eff, with_totals


def gate_sweep(cases: DataFrame, profiles: DataFrame, gates: DataFrame, qc=("ok",), min_points: int = 3) -> DataFrame:
    """Contrail coverage and errors on a lattice of (gate, s_gate).

    Points do not meet the gates: a contrail's points are gathered once, sorted by height, and each gate takes the
    median of those that pass from that one array, whose length is a contrail's.
    """
    run = cases.where(F.col("qc") != ERROR).where(usable(qc)).select("case_id")
    points = with_s_eff(profiles, gates.where("s_gate > 0").head() is not None).join(run, "case_id", "left_semi")
    seen = F.collect_list(F.when(F.col("h").isNotNull() & F.col("r").isNotNull(), F.struct("h", "r", "s_eff")))
    t = points.groupBy("case_id", "contrail").agg(F.avg("top_km").alias("top_km"), F.array_sort(seen).alias("seen"))
    x = t.crossJoin(few(gates))
    ok = F.filter("seen", lambda p: (p["r"] > F.col("gate")) & ((F.col("s_gate") <= 0) | F.coalesce(p["s_eff"] >= F.col("s_gate"), F.lit(False))))
    x = x.select("gate", "s_gate", "case_id", "contrail", "top_km", ok.alias("ok")).withColumn("k", F.size("ok"))
    at = lambda i: F.try_element_at(F.col("ok"), i.cast("int"))["h"]
    middle = (at(F.floor((F.col("k") + 1) / 2)) + at(F.floor(F.col("k") / 2) + 1)) / 2
    x = x.withColumn("err", F.when(F.col("k") >= F.lit(max(1, min_points)), middle - F.col("top_km")))
    per_case = x.groupBy("gate", "s_gate", "case_id").agg(F.count("*").alias("k"), F.count("err").alias("n"), F.coalesce(F.sum("err"), F.lit(0.0)).alias("s1"), F.coalesce(F.sum(F.col("err") * F.col("err")), F.lit(0.0)).alias("s2"))
    x = with_totals(per_case, ("gate", "s_gate"), all_s1=F.sum("s1"), all_n=F.sum("n"))
    x = x.withColumn("c", ratio(F.col("all_s1") - F.col("s1"), F.col("all_n") - F.col("n")))
    held = F.col("c").isNotNull()
    corrected = F.sum(F.when(held, F.col("s2") - 2 * F.col("c") * F.col("s1") + F.col("n") * F.col("c") * F.col("c")))
    return x.groupBy("gate", "s_gate").agg(
        ratio(F.sum("n"), F.sum("k")).alias("coverage"), F.sqrt(ratio(F.sum("s2"), F.sum("n"))).alias("rmse_raw"), root(ratio(corrected, F.sum(F.when(held, F.col("n"))))).alias("rmse_corr")
    )


def operating_points(cases: DataFrame, profiles: DataFrame, ops: DataFrame, qc=("ok",), min_points: int = 3) -> DataFrame:
    """Accuracy per point and per contrail at a few registered gates (gate, s_gate). Profiles carry ``contrail``."""
    contrails = gate_sweep(cases, profiles, ops, qc, min_points).withColumnsRenamed({"coverage": "contrail_coverage", "rmse_raw": "contrail_rmse_raw", "rmse_corr": "contrail_rmse_corr"})
    return gate_ladder(cases, profiles, ops, qc).join(contrails, ["gate", "s_gate"], "left")


def pareto_front(sweep: DataFrame, cost: str = "rmse_corr") -> DataFrame:
    """Rows that no row of at least their coverage undercuts: the running minimum from high coverage to low."""
    down = Window.orderBy(F.desc("coverage"), cost, "gate", "s_gate").rowsBetween(Window.unboundedPreceding, 0)
    return sweep.where(F.col(cost).isNotNull()).withColumn("best", F.min(cost).over(down)).where(F.col(cost) == F.col("best")).drop("best")


def best_at_coverage(sweep: DataFrame, targets: DataFrame, tolerance: float = 0.05, cost: str = "rmse_corr") -> DataFrame:
    """Per target coverage the lowest error within the tolerance, gated on r alone and on both, and the gain."""
    near = sweep.join(few(targets), F.abs(F.col("coverage") - F.col("target")) <= tolerance)
    r_only = F.min(F.when(F.col("s_gate") <= 0, F.col(cost)))
    return near.groupBy("target").agg(r_only.alias("r_only"), F.min(cost).alias("any_gate")).withColumn("gain", F.col("r_only") - F.col("any_gate"))


def front_at_coverage(front: DataFrame, targets: DataFrame, cost: str = "rmse_corr") -> DataFrame:
    """The front interpolated linearly at fixed coverages; NULL outside it."""
    up = Window.orderBy("coverage", cost)
    s = front.select(F.col("coverage").alias("c0"), F.col(cost).alias("y0"), F.lead("coverage").over(up).alias("c1"), F.lead(cost).over(up).alias("y1"))
    on = (F.col("target") >= F.col("c0")) & (F.col("target") < F.col("c1"))
    value = F.col("y0") + (F.col("target") - F.col("c0")) / (F.col("c1") - F.col("c0")) * (F.col("y1") - F.col("y0"))
    # a front has no more rows than its sweep has gates, of which ``gate_sweep`` takes few
    return targets.join(F.broadcast(s), on, "left").select("target", value.alias("value"))


def ablation_table(profiles: DataFrame, r_gate: float = 0.6, by: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Per scene and arm (``by``: case, time model, truth mode): points above the r gate, bias, rmse and population sd of the error, and the
    median distance that truth points were moved (disp_km), over all points."""
    ok = F.col("h").isNotNull() & (F.col("r") > r_gate)
    e = F.when(ok, F.col("h") - F.col("top_km"))
    return profiles.groupBy(*by).agg(F.count(e).alias("n"), F.avg(e).alias("bias"), F.sqrt(F.avg(e * e)).alias("rmse"), F.stddev_pop(e).alias("sd"), F.percentile("disp_km", F.lit(0.5)).alias("moved_km"))
