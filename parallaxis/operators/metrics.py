"""Accuracy of a run against truth: gates, per-case sums, leave-one-case-out constants, summaries.

A run is two tables: ``cases`` (case_id, qc, ...) and ``profiles`` (case_id, pid, top_km, h, r, s_eff, ...),
one row per truth point. Everything reduces to per-case sums by one grouped aggregate; metrics and resamples
are then formulas over one small row per case. ``qc`` is the list of verdicts that count, None for all but errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.safe import few, ratio, root

ERROR = "error"


def usable(qc: list[str] | None = ("ok",)) -> Column:
    """Does a case's verdict count?"""
    return F.col("qc") != ERROR if qc is None else F.col("qc").isin(*qc)


def passes(r_gate: Column | float, s_gate: Column | float | None = None) -> Column:
    """Does a point pass? r strictly above its gate, s_eff at or above its own; a missing value fails."""
    ok = F.col("h").isNotNull() & (F.col("r") > r_gate)
    if s_gate is not None:
        s_gate = F.lit(s_gate) if isinstance(s_gate, float) else s_gate
        ok = ok & ((s_gate <= 0) | (F.col("s_eff") >= s_gate))
    return F.coalesce(ok, F.lit(False))


def with_s_eff(profiles: DataFrame, gated: bool) -> DataFrame:
    """Profiles with a column s_eff. Gating on it is refused, at once, where a run stored none: every point would fail, in silence."""
    if "s_eff" not in profiles.columns:
        profiles = profiles.withColumn("s_eff", F.lit(None).cast("double"))
    if gated and profiles.where(F.col("s_eff").isNotNull()).select("s_eff").head() is None and profiles.head() is not None:
        raise ValueError("this run stored no s_eff: it can't be gated on it")
    return profiles


def _points(cases: DataFrame, profiles: DataFrame, qc, gated: bool) -> DataFrame:
    run = cases.where(F.col("qc") != ERROR).select("case_id", usable(qc).alias("use"))
    return run.join(with_s_eff(profiles, gated).select("case_id", "pid", "top_km", "h", "r", "s_eff"), "case_id", "left")


def _sums(ok: Column) -> list[Column]:
    e = F.col("h") - F.col("top_km")
    total = lambda x: F.coalesce(F.sum(F.when(ok, x)), F.lit(0.0))
    return [
        F.count("pid").alias("n_all"), F.count(F.when(F.col("use"), F.col("pid"))).alias("n_use"),
        F.count(F.when(ok, F.lit(1))).alias("n"), total(e).alias("s1"), total(e * e).alias("s2"),
    ]


def case_sums(cases: DataFrame, profiles: DataFrame, gate: float = 0.6, qc=("ok",), s_min: float = 0.0) -> DataFrame:
    """case_id, use, n_all, n_use, n, s1, s2 per case without error; cases without points count 0."""
    return _points(cases, profiles, qc, s_min > 0).groupBy("case_id", "use").agg(*_sums(F.col("use") & passes(gate, s_min)))


def with_totals(df: DataFrame, by: tuple[str, ...] = (), **totals: Column) -> DataFrame:
    """Adds aggregates over all rows (of each ``by``) to every row: one small aggregate, broadcast, so that no task gets all rows.

    ``by`` has few values: gates, whose number ``few`` has checked, or the two sides of a comparison.
    """
    small = df.groupBy(*by).agg(*[c.alias(n) for n, c in totals.items()])
    return df.join(F.broadcast(small), list(by)) if by else df.crossJoin(F.broadcast(small))


def loo_constant(sums: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds m, the case's mean error, and c, the mean of the other cases' means; NULL where there is none.

    With ``by`` (gates, sides: few values) constants are fitted within each.
    """
    own = F.when(F.col("n") > 0, 1).otherwise(0)
    out = with_totals(sums.withColumn("m", ratio(F.col("s1"), F.col("n"))), by, all_m=F.sum("m"), all_k=F.sum(own))
    return out.withColumn("c", ratio(F.col("all_m") - F.coalesce("m", F.lit(0.0)), F.col("all_k") - own)).drop("all_m", "all_k")


def metric_columns(mask: Column | None = None, w: Column | None = None) -> list[Column]:
    """Aggregates bias, rmse_raw, rmse_corr, within, between, n over rows with n, s1, s2, m, c.

    ``mask`` restricts where errors count, ``w`` weighs cases; the constant c was fitted before either.
    """
    used = (F.col("n") > 0) if mask is None else (F.col("n") > 0) & mask
    w = F.lit(1) if w is None else w
    used = used & (w > 0)
    total = lambda x: F.sum(F.when(used, w * x))
    n, s1, s2, m, c = (F.col(x) for x in ("n", "s1", "s2", "m", "c"))
    points = total(n)
    bad = F.count(F.when(used & c.isNull(), 1)) > 0
    corrected = lambda x: F.when(~bad, root(ratio(total(x), points)))
    return [
        ratio(total(s1), points).alias("bias"), F.sqrt(ratio(total(s2), points)).alias("rmse_raw"), corrected(s2 - 2 * c * s1 + n * c * c).alias("rmse_corr"),
        root(ratio(total(s2 - s1 * m), points)).alias("within"), corrected(n * (m - c) * (m - c)).alias("between"), F.coalesce(points, F.lit(0)).cast("long").alias("n_points"),
    ]


def metrics(sums: DataFrame, mask: Column | None = None) -> DataFrame:
    """One row of accuracy from per-case sums."""
    return loo_constant(sums).agg(*metric_columns(mask))


def gate_ladder(cases: DataFrame, profiles: DataFrame, gates: DataFrame, qc=("ok",)) -> DataFrame:
    """Summary per gate. ``gates`` (gate, and s_gate if points are gated on s_eff too) is small.

    Points do not meet the gates: each is put by how many r gates and how many s gates it passes, points of a
    case add up by these two numbers, and what a gate keeps are the sums beyond it.
    """
    gated = "s_gate" in gates.columns and gates.where("s_gate > 0").head() is not None
    if "s_gate" not in gates.columns:
        gates = gates.withColumn("s_gate", F.lit(0.0))
    key = ["gate", "s_gate"]
    gates = few(gates)
    ladders = gates.agg(F.array_sort(F.collect_set("gate")).alias("rs"), F.array_sort(F.collect_set("s_gate")).alias("ss"))
    steps = gates.crossJoin(F.broadcast(ladders)).select(*key, F.array_position("rs", F.col("gate")).alias("kr"), F.array_position("ss", F.col("s_gate")).alias("ks"))
    points = _points(cases, profiles, qc, gated).crossJoin(F.broadcast(ladders))
    seen = F.coalesce(F.col("use") & F.col("h").isNotNull(), F.lit(False))
    kr = F.when(seen, F.size(F.filter("rs", lambda g: F.col("r") > g))).otherwise(0)
    ks = F.when(seen, F.size(F.filter("ss", lambda g: (g <= 0) | (F.col("s_eff") >= g)))).otherwise(0)
    e = F.col("h") - F.col("top_km")
    zero = lambda x: F.coalesce(F.sum(F.when(seen, x)), F.lit(0.0))
    t = F.col("top_km")
    cells = points.withColumn("kr", kr).withColumn("ks", ks).groupBy("case_id", "use", "kr", "ks").agg(
        F.count("pid").alias("k"), F.count(F.when(seen, F.lit(1))).alias("n"), zero(e).alias("s1"), zero(e * e).alias("s2"), zero(t).alias("t1"), zero(t * t).alias("t2")
    )
    cells = cells.groupBy("case_id", "use").agg(F.sum("k").alias("n_all"), F.collect_list(F.struct("kr", "ks", "n", "s1", "s2", "t1", "t2")).alias("cells"))  # at most gates + 1 squared
    met = cells.crossJoin(F.broadcast(steps))
    kept = lambda f: F.aggregate(F.filter("cells", lambda c: (c["kr"] >= F.col("kr")) & (c["ks"] >= F.col("ks"))), F.lit(0.0), lambda a, c: a + c[f])
    per_case = met.select(*key, "case_id", "use", "n_all", F.when(F.col("use"), F.col("n_all")).otherwise(0).alias("n_use"), kept("n").cast("long").alias("n"), *[kept(f).alias(f) for f in ("s1", "s2", "t1", "t2")])
    spread = F.sum("t2") - F.sum("t1") * F.sum("t1") / F.sum("n")
    return (
        loo_constant(per_case, tuple(key)).groupBy(*key)
        .agg(
            F.count("*").alias("n_cases"), F.sum(F.col("use").cast("long")).alias("n_usable"), F.sum((F.col("n") > 0).cast("long")).alias("n_cases_scored"),
            F.avg(F.col("use").cast("double")).alias("yield_"), ratio(F.sum("n"), F.sum("n_use")).alias("coverage"),
            F.when((F.sum("n") > 1) & (F.sum("n_use") > 0), 1 - F.try_divide(F.sum("s2"), spread)).alias("r2"), *metric_columns(),
        )
    )


def summary(cases: DataFrame, profiles: DataFrame, gate: float = 0.6, s_min: float = 0.0, qc=("ok",)) -> DataFrame:
    """Accuracy of one run at one gate: yield, coverage, bias, raw and corrected errors, r2."""
    gates = cases.sparkSession.range(1).select(F.lit(gate).alias("gate"), F.lit(s_min).alias("s_gate"))
    return gate_ladder(cases, profiles, gates, qc)


def case_table(cases: DataFrame, profiles: DataFrame, gate: float = 0.6, qc=("ok",), s_min: float = 0.0) -> DataFrame:
    """Per scored case n, bias, sd, offset from the constant, share of the squared corrected error, and the case's columns."""
    t = loo_constant(case_sums(cases, profiles, gate, qc, s_min))
    c0 = F.coalesce("c", F.lit(0.0))
    sse = F.col("s2") - 2 * c0 * F.col("s1") + F.col("n") * c0 * c0
    t = with_totals(t.withColumn("sse", sse), all_sse=F.sum(F.when(F.col("n") > 0, F.col("sse"))))
    t = t.withColumn("sse_share", F.col("sse") / F.col("all_sse"))
    t = t.where("n > 0").select(
        "case_id", "n", F.col("m").alias("bias"), root(ratio(F.col("s2") - F.col("s1") * F.col("m"), F.col("n"))).alias("sd"), (F.col("m") - F.col("c")).alias("offset"), "sse_share"
    )
    return t.join(cases.select("case_id", "qc", "vza_max"), "case_id", "left")


def contrail_table(cases: DataFrame, profiles: DataFrame, gate: float = 0.6, qc=("ok",), min_points: int = 3, s_min: float = 0.0) -> DataFrame:
    """One row per contrail (profiles carry ``contrail``): truth, median of its gated heights if enough, error, scored."""
    run = cases.where(F.col("qc") != ERROR).select("case_id", "qc", "vza_max", usable(qc).alias("use"))
    ok = F.col("use") & passes(gate, s_min)
    profiles = with_s_eff(profiles, s_min > 0)
    t = run.join(profiles, "case_id").groupBy("case_id", "contrail", "qc", "vza_max", "use").agg(
        F.count("*").alias("n_truth"), F.count(F.when(ok, F.lit(1))).alias("n_gated"), F.avg("top_km").alias("top_km"),
        F.percentile(F.when(ok, F.col("h")), F.lit(0.5)).alias("h"), F.percentile("s_eff", F.lit(0.5)).alias("s_eff"),
    )
    t = t.withColumn("h", F.when(F.col("n_gated") >= min_points, F.col("h")))
    return t.withColumn("err", F.col("h") - F.col("top_km")).withColumn("scored", F.col("h").isNotNull())


def contrail_summary(contrails: DataFrame) -> DataFrame:
    """Accuracy with each contrail weighted equally; the constant is the mean error of contrails in other cases."""
    per_case = contrails.where("use").groupBy("case_id").agg(
        F.count("*").alias("k"), F.count("err").alias("n"), F.coalesce(F.sum("err"), F.lit(0.0)).alias("s1"), F.coalesce(F.sum(F.col("err") * F.col("err")), F.lit(0.0)).alias("s2")
    )
    x = with_totals(per_case, all_s1=F.sum("s1"), all_n=F.sum("n"))
    x = x.withColumn("c", ratio(F.col("all_s1") - F.col("s1"), F.col("all_n") - F.col("n")))
    corrected = F.sum(F.when(F.col("c").isNotNull(), F.col("s2") - 2 * F.col("c") * F.col("s1") + F.col("n") * F.col("c") * F.col("c")))
    return x.agg(
        F.sum("k").alias("n_contrails"), F.sum("n").alias("n_scored"), ratio(F.sum("n"), F.sum("k")).alias("contrail_coverage"), F.sum((F.col("n") > 0).cast("long")).alias("n_cases"),
        ratio(F.sum("s1"), F.sum("n")).alias("bias"), F.sqrt(ratio(F.sum("s2"), F.sum("n"))).alias("rmse_raw"),
        root(ratio(corrected, F.sum(F.when(F.col("c").isNotNull(), F.col("n"))))).alias("rmse_corr"),
    )


def error_tails(contrails: DataFrame) -> DataFrame:
    """Of scored contrails' errors without their mean: median size, and the shares within 0.5 and 1 km."""
    x = with_totals(contrails.where("scored"), mean=F.avg("err")).withColumn("e", F.abs(F.col("err") - F.col("mean")))
    return x.agg(F.percentile("e", F.lit(0.5)).alias("median_abs"), F.avg((F.col("e") <= 0.5).cast("double")).alias("within_05"), F.avg((F.col("e") <= 1.0).cast("double")).alias("within_1"))


def case_medians(cases: DataFrame, profiles: DataFrame) -> DataFrame:
    """The median s_eff of each case's points beside the case."""
    return cases.join(profiles.groupBy("case_id").agg(F.percentile("s_eff", F.lit(0.5)).alias("s_eff")), "case_id", "left")


def verdict_counts(cases: DataFrame) -> DataFrame:
    """How often each verdict was given."""
    return cases.groupBy("qc").agg(F.count("*").alias("n"))


def coverage_by_angle(cases: DataFrame) -> DataFrame:
    """(case_id, qc, vza_max, map_coverage) of cases without error that have both: what a plot of coverage against angle needs."""
    x = cases.where(F.col("qc") != ERROR).where(F.col("vza_max").isNotNull() & F.col("map_coverage").isNotNull())
    return x.select("case_id", "qc", "vza_max", "map_coverage")


def contrail_count(profiles: DataFrame) -> DataFrame:
    """One row: n_contrails, the number of (case, contrail) groups with points, and n_cases that they are in; points of no contrail count for neither."""
    groups = profiles.where(F.col("contrail").isNotNull()).groupBy("case_id", "contrail").agg(F.count("*").alias("k"))
    return groups.groupBy("case_id").agg(F.count("*").alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n_contrails"), F.count("*").alias("n_cases"))


def density_histogram(cases: DataFrame, profiles: DataFrame, gate: float = 0.6, lo: float = 8.0, hi: float = 16.0, bins: int = 60) -> DataFrame:
    """Counts of truth against corrected retrieved height in bins over fixed limits."""
    constants = loo_constant(case_sums(cases, profiles, gate)).where("use").select("case_id", "c")
    width = (hi - lo) / bins
    p = profiles.where(passes(gate)).join(constants, "case_id").withColumn("hc", F.col("h") - F.coalesce("c", F.lit(0.0)))
    p = p.select(F.floor((F.col("top_km") - lo) / width).cast("long").alias("ix"), F.floor((F.round("hc", 9) - lo) / width).cast("long").alias("iy"))
    return p.where(F.col("ix").between(0, bins - 1) & F.col("iy").between(0, bins - 1)).groupBy("ix", "iy").agg(F.count("*").alias("n"))


def exact_percentile(values: DataFrame, column: str, q: float, bins: int = 4096) -> DataFrame:
    """One row (value): the percentile of all rows, interpolated linearly, without gathering them.

    A histogram between the extremes finds the bins that hold the two neighbours, and only their rows are ordered.
    """
    ends = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("n"))
    width = F.greatest((F.col("hi") - F.col("lo")) / bins, F.lit(5e-324))
    x = values.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).crossJoin(F.broadcast(ends))
    x = x.withColumn("bin", F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1)).cast("int"))
    at = (F.col("n") - 1) * q
    hist = x.groupBy("bin", "n").agg(F.count("*").alias("k"))
    upto = Window.partitionBy("n").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # at most ``bins`` rows
    hist = hist.withColumn("upto", F.sum("k").over(upto)).withColumn("before", F.col("upto") - F.col("k"))
    held = hist.where((F.col("before") <= F.ceil(at)) & (F.col("upto") > F.floor(at))).select("bin", "before")
    rows = x.join(F.broadcast(held), "bin").groupBy("bin", "before", "n", "value").agg(F.count("*").alias("k"))
    place = F.sum("k").over(Window.partitionBy("bin").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    rows = rows.withColumn("last", place).withColumn("first", F.col("last") - F.col("k"))
    value = lambda i: F.max(F.when((F.col("first") <= i) & (F.col("last") > i), F.col("value")))
    low, high = value(F.floor(at)), value(F.ceil(at))
    return rows.agg(low.alias("low"), high.alias("high"), F.first((at - F.floor(at))).alias("f")).select((F.col("low") + F.col("f") * (F.col("high") - F.col("low"))).alias("value"))


def robust_limits(fields: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """limit: the 99th percentile of the distance from the median over both views (by, i, j, a, b).

    Per image (``by``) the values of an image are bounded; without a key both percentiles are found by histogram.
    """
    z = fields.select(*by, F.explode(F.array("a", "b")).alias("z")).where("z is not null")
    if by:
        middle = z.groupBy(*by).agg(F.percentile("z", F.lit(0.5)).alias("med"))
        return z.join(middle, list(by)).groupBy(*by).agg(F.percentile(F.abs(F.col("z") - F.col("med")), F.lit(0.99)).alias("limit"))
    far = z.crossJoin(F.broadcast(exact_percentile(z, "z", 0.5))).select(F.abs(F.col("z") - F.col("value")).alias("d"))
    return exact_percentile(far, "d", 0.99).withColumnRenamed("value", "limit")


def regression_check(found: DataFrame, expected: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Headline numbers (metric, value) against stored ones: within the tolerance, or equal where ``exact``."""
    x = expected.join(found, "metric", "left")
    gap = F.abs(F.col("value") - F.col("expected"))
    return x.select("metric", "value", "expected", F.coalesce(F.when(F.col("exact"), gap == 0).otherwise(gap <= tolerance), F.lit(False)).alias("matches"))
