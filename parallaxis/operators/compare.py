"""Case bootstrap and paired comparison of two runs, all from per-case sums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.safe import few, ratio, root
from .cases import numbered
from .metrics import ERROR, loo_constant, metric_columns, usable, with_totals

#: Draws that are hashed, and rows that are handed on, at once.
DRAWS = 1 << 16


@lru_cache(maxsize=4)
def _digits(lo: int, hi: int) -> list[bytes]:
    return [str(k).encode() for k in range(lo, hi)]


def draw_counts(size: DataFrame, n_boot: int, seed: int = 0) -> DataFrame:
    """(b, i, w): how often each of the S case numbers is drawn in resample b; ``size`` has S as its one row.

    A task draws whole resamples and counts as it goes, so that no draw is a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts, lead, md5 = np.zeros(n, dtype=np.int64), f"{seed}:{b}:".encode(), hashlib.md5
                for lo in range(0, n, DRAWS):
                    digests = b"".join([md5(lead + k).digest() for k in _digits(lo, min(lo + DRAWS, n))])
                    drawn = (np.frombuffer(digests, dtype=">u8")[::2] >> 16) % n  # of each the first 12 hexadecimal digits
                    counts += np.bincount(drawn.astype(np.int64), minlength=n)
                i = np.flatnonzero(counts)
                for lo in range(0, len(i), DRAWS):
                    part = i[lo : lo + DRAWS]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), b)), pa.array(part), pa.array(counts[part])], names=["b", "i", "w"])

    spark = size.sparkSession
    parts = max(1, min(n_boot, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return spark.range(n_boot).repartition(parts, "id").crossJoin(F.broadcast(size)).mapInArrow(run, "b long, i long, w long")


def boot_weights(cases: DataFrame, n_boot: int, seed: int = 0) -> DataFrame:
    """(b, case_id, w): how often each of the S cases is in resample b, an exact multinomial.

    Draw k of resample b takes case number md5('seed:b:k') mod S, so that resamples depend neither on
    partitions nor on the engine. Cases that a resample leaves out have no row.
    """
    return resampled(cases.select("case_id").distinct(), n_boot, seed=seed).select("b", "case_id", "w")


def resampled(rows: DataFrame, weights: DataFrame | int, cases: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """``rows`` (case_id, ...) once per resample b that has their case, with b and w.

    ``weights``: b, case_id, w, or the number of resamples of the cases of ``cases`` (else of ``rows``), as ``boot_weights`` draws them. The
    planner can't know how many counts there are; the hint keeps them out of the driver, and they are shuffled once and not sorted.
    """
    if isinstance(weights, DataFrame):
        return weights.join(rows.hint("shuffle_hash"), "case_id")
    ids = numbered((rows if cases is None else cases).select("case_id").distinct(), "case_id")
    counts = draw_counts(ids.agg(F.count("*").alias("size")), weights, seed)
    return counts.join((ids if rows.columns == ["case_id"] else rows.join(ids, "case_id")).hint("shuffle_hash"), "i").drop("i")


def constant_sums(n: Column, s1: Column, s2: Column, mask: Column | None = None) -> dict[str, Column]:
    """Aggregates over cases of one weight from which ``constant_metrics`` goes on: the constant is fitted to all cases with points, errors count where ``mask`` holds."""
    scored = n > 0
    used = scored if mask is None else scored & mask
    return {
        "k": F.count(F.when(scored, 1)), "m": F.coalesce(F.sum(F.when(scored, s1 / n)), F.lit(0.0)), "used": F.count(F.when(used, 1)),
        "n": F.sum(F.when(used, n)), "s1": F.sum(F.when(used, s1)), "s2": F.sum(F.when(used, s2)), "q": F.sum(F.when(used, s1 * s1 / n)),
    }


def constant_metrics(sums: DataFrame, by: tuple[str, ...] = ("b",)) -> DataFrame:
    """bias, rmse_raw, rmse_corr, within, between, n_points per resample from its sums by weight (``by``, w and those of ``constant_sums``).

    All copies of a case leave its own constant, which so is (M - w m) / (K - w) with m the case's mean error and M, K the resample's
    totals: of cases of the same w it is one linear function of m, and their errors need sums only.
    """
    every = Window.partitionBy(*by)  # a row per weight
    w, n, s1, s2, q = (F.col(x) for x in ("w", "n", "s1", "s2", "q"))
    x = sums.withColumn("all_m", F.sum(w * F.col("m")).over(every)).withColumn("rest", F.sum(w * F.col("k")).over(every) - w)
    x = x.withColumn("at", ratio(F.col("all_m"), F.col("rest"))).withColumn("slope", ratio(w, F.col("rest")))
    at, slope = F.col("at"), F.col("slope")
    used = (F.col("used") > 0) & (w > 0)
    total = lambda v: F.sum(F.when(used, w * v))
    points = total(n)
    fits = F.count(F.when(used & at.isNull(), 1)) == 0
    corrected = lambda v: F.when(fits, root(ratio(total(v), points)))
    return x.groupBy(*by).agg(
        ratio(total(s1), points).alias("bias"), F.sqrt(ratio(total(s2), points)).alias("rmse_raw"),
        corrected(s2 - 2 * (at * s1 - slope * q) + at * at * n - 2 * at * slope * s1 + slope * slope * q).alias("rmse_corr"), root(ratio(total(s2 - q), points)).alias("within"),
        corrected((1 + slope) * (1 + slope) * q - 2 * at * (1 + slope) * s1 + at * at * n).alias("between"), F.coalesce(points, F.lit(0)).cast("long").alias("n_points"),
    )


def boot_metrics(sums: DataFrame, weights: DataFrame | int) -> DataFrame:
    """Accuracy per resample b; ``weights`` as ``resampled`` takes them."""
    x = resampled(sums, weights).groupBy("b", "w").agg(*[v.alias(k) for k, v in constant_sums(F.col("n"), F.col("s1"), F.col("s2")).items()])
    return constant_metrics(x)


def percentile_ci(samples: DataFrame, column: str, by: tuple[str, ...] = (), ci: float = 95.0) -> DataFrame:
    """lo and hi: percentiles of the values that are there, interpolated linearly."""
    q = (100 - ci) / 200
    return samples.groupBy(*by).agg(F.percentile(column, F.lit(q)).alias("lo"), F.percentile(column, F.lit(1 - q)).alias("hi"))


def boot_contrails(contrails: DataFrame, weights: DataFrame | int, cases: DataFrame | None = None) -> DataFrame:
    """bias, rmse_raw, rmse_corr per resample over scored contrails; only the copy itself leaves its constant.

    A copy of a case has the constant (total - s1) / (N - n); a resample of one case only has none. ``weights`` and ``cases`` as ``resampled`` takes them.
    """
    per_case = contrails.where("scored").groupBy("case_id").agg(F.count("*").alias("n"), F.sum("err").alias("s1"), F.sum(F.col("err") * F.col("err")).alias("s2"))
    x = copy_constant(resampled(per_case, weights, cases).groupBy("b", "n").agg(*[v.alias(k) for k, v in copy_sums(F.col("s1"), F.col("s2")).items()]))
    return x.select("b", "bias", "rmse_raw", "rmse_corr")


def copy_sums(s1: Column, s2: Column) -> dict[str, Column]:
    """Aggregates over copies of cases of the same n from which ``copy_constant`` goes on."""
    w = F.col("w")
    return {"k": F.sum(w), "s1": F.sum(w * s1), "s2": F.sum(w * s2), "q": F.sum(w * s1 * s1)}


def copy_constant(sums: DataFrame, by: tuple[str, ...] = ("b",)) -> DataFrame:
    """bias, rmse_raw, rmse_corr per resample from its sums by n: of copies of the same n the constant is one linear function of s1."""
    every = Window.partitionBy(*by)  # a row per n
    n, k, s1, s2, q = (F.col(x) for x in ("n", "k", "s1", "s2", "q"))
    x = sums.withColumn("tot", F.sum(s1).over(every)).withColumn("all", F.sum(k * n).over(every))
    x = x.withColumn("at", ratio(F.col("tot"), F.col("all") - n)).withColumn("slope", ratio(F.lit(1), F.col("all") - n))
    at, slope = F.col("at"), F.col("slope")
    corrected = F.when(at.isNotNull(), s2 - 2 * (at * s1 - slope * q) + n * (at * at * k - 2 * at * slope * s1 + slope * slope * q))
    return x.groupBy(*by).agg(
        ratio(F.first("tot"), F.first("all")).alias("bias"), F.sqrt(ratio(F.sum(s2), F.first("all"))).alias("rmse_raw"),
        root(ratio(F.sum(corrected), F.sum(F.when(at.isNotNull(), k * n)))).alias("rmse_corr"),
    )


def common_cases(cases_a: DataFrame, cases_b: DataFrame) -> DataFrame:
    """Cases that both runs finished without error."""
    fine = lambda c: c.where(F.col("qc") != ERROR).select("case_id")
    return fine(cases_a).intersect(fine(cases_b))


def committed_only(profiles: DataFrame, cases: DataFrame) -> DataFrame:
    return profiles.join(cases.select("case_id"), "case_id", "left_semi")


def pair_profiles(a: DataFrame, b: DataFrame) -> DataFrame:
    """Points of both runs side by side on (case_id, pid); truth from the first."""
    theirs = b.select("case_id", "pid", F.col("h").alias("h_b"), F.col("r").alias("r_b"), F.col("s_eff").alias("s_eff_b"))
    return a.select("case_id", "pid", "top_km", F.col("h").alias("h_a"), F.col("r").alias("r_a"), F.col("s_eff").alias("s_eff_a")).join(theirs, ["case_id", "pid"])


def pair_runs(cases_a: DataFrame, profiles_a: DataFrame, cases_b: DataFrame, profiles_b: DataFrame, gate: float = 0.6, qc=("ok",)) -> DataFrame:
    """One row per common case: each run's own sums, both runs' sums over the points gated in both, and map offsets.

    Each run is read once: one full outer join of their points and one aggregate give own and shared sums.
    """
    ua = cases_a.where(F.col("qc") != ERROR).select("case_id", F.col("qc").alias("qc_a"), "vza_max", "offset_s", usable(qc).alias("use_a"))
    ub = cases_b.where(F.col("qc") != ERROR).select("case_id", F.col("qc").alias("qc_b"), usable(qc).alias("use_b"))
    both = ua.join(ub, "case_id")
    side = lambda p, x: p.select("case_id", "pid", F.col("top_km").alias(f"top_{x}"), F.col("h").alias(f"h_{x}"), F.col("r").alias(f"r_{x}"), F.lit(True).alias(f"in_{x}"))
    points = side(profiles_a, "a").join(side(profiles_b, "b"), ["case_id", "pid"], "full_outer")
    x = both.join(points, "case_id", "left")
    held = {s: F.coalesce(F.col(f"use_{s}") & F.col(f"h_{s}").isNotNull() & (F.col(f"r_{s}") > gate), F.lit(False)) for s in "ab"}
    shared = held["a"] & held["b"] & F.coalesce(F.col("in_a") & F.col("in_b"), F.lit(False))
    own = {s: F.col(f"h_{s}") - F.col(f"top_{s}") for s in "ab"}
    common = {s: F.col(f"h_{s}") - F.col("top_a") for s in "ab"}  # truth from the first
    count = lambda c: F.count(F.when(c, F.lit(1)))
    total = lambda ok, v: F.coalesce(F.sum(F.when(ok, v)), F.lit(0.0))
    sums = [count(shared).alias("n_c")]
    for s in "ab":
        e, c = own[s], common[s]
        sums += [total(shared, c).alias(f"s1_c{s}"), total(shared, c * c).alias(f"s2_c{s}"), count(F.col(f"in_{s}")).alias(f"n_all_{s}"), count(F.col(f"in_{s}") & F.col(f"use_{s}")).alias(f"n_use_{s}")]
        sums += [count(held[s]).alias(f"n_{s}"), total(held[s], e).alias(f"s1_{s}"), total(held[s], e * e).alias(f"s2_{s}")]
    t = x.groupBy("case_id", "qc_a", "qc_b", "vza_max", "offset_s", "use_a", "use_b").agg(*sums)
    for s in "ab":
        t = t.withColumn(f"map_mean_{s}", ratio(F.col(f"s1_c{s}"), F.col("n_c")))
    has = F.when(F.col("n_c") > 0, 1).otherwise(0)
    t = with_totals(t, all_a=F.sum("map_mean_a"), all_b=F.sum("map_mean_b"), all_k=F.sum(has))
    for s in "ab":
        c = ratio(F.col(f"all_{s}") - F.coalesce(f"map_mean_{s}", F.lit(0.0)), F.col("all_k") - has)
        t = t.withColumn(f"map_off_{s}", F.col(f"map_mean_{s}") - c).withColumn(f"cov_{s}", ratio(F.col(f"n_{s}"), F.col(f"n_use_{s}")))
    return t.drop("all_a", "all_b", "all_k").withColumn("d_abs_off", F.abs("map_off_b") - F.abs("map_off_a"))


#: Sums behind the metrics of a comparison: (label, suffix of n, of s1 and s2).
_SETS = (("own", "a", "a", "A"), ("own", "b", "b", "B"), ("common", "c", "ca", "A"), ("common", "c", "cb", "B"))


def metric_set(pairs: DataFrame, weights: DataFrame | int | None = None, mask: Column | None = None) -> DataFrame:
    """(draw, metric, A, B) in long form; without weights (as ``resampled`` takes them), draw is -1 for the runs themselves.

    Constants come from all pairs, ``mask`` only says where errors count.
    """
    x = pairs.withColumn("mask", F.lit(True) if mask is None else F.coalesce(mask, F.lit(False)))
    x = x.withColumn("draw", F.lit(-1).cast("long")).withColumn("w", F.lit(1).cast("long")) if weights is None else resampled(x, weights).withColumnRenamed("b", "draw")
    keep = F.col("mask")
    held = lambda v: F.coalesce(F.sum(F.when(keep, v)), F.lit(0))
    parts = {"held": held(F.lit(1)), **{f"{c}_{s}": held(F.col(f"{c}_{s}").cast("long")) for s in "ab" for c in ("use", "n", "n_use")}}
    for k, (_, n, s, _) in enumerate(_SETS):
        parts |= {f"{name}__{k}": v for name, v in constant_sums(F.col(f"n_{n}"), F.col(f"s1_{s}"), F.col(f"s2_{s}"), keep).items()}
    # a row per weight of a draw: all that follows is small
    x = x.groupBy("draw", "w").agg(*[v.alias(name) for name, v in parts.items()])
    share = lambda a, b: ratio(F.sum(F.col("w") * F.col(a)), F.sum(F.col("w") * F.col(b)))
    sides = x.groupBy("draw").agg(*[share(f"use_{s}", "held").alias(f"y{s}") for s in "ab"], *[share(f"n_{s}", f"n_use_{s}").alias(f"v{s}") for s in "ab"])
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(s.upper()).alias("side"), F.col(f"{c}{s}").alias("value")) for m, c in (("yield", "y"), ("coverage (own)", "v")) for s in "ab"]))
    out = sides.select("draw", rows.alias("r")).select("draw", "r.*")
    sums = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(side).alias("side"), *[F.col(f"{name}__{k}").alias(name) for name in ("k", "m", "used", "n", "s1", "s2", "q")]) for k, (kind, _, _, side) in enumerate(_SETS)]))
    m = constant_metrics(x.select("draw", "w", sums.alias("s")).select("draw", "w", "s.*"), ("draw", "kind", "side"))
    named = [F.struct(F.lit(k).alias("k"), F.col(k).alias("value")) for k in ("bias", "rmse_raw", "rmse_corr", "within", "between")]
    m = m.select("draw", "kind", "side", F.explode(F.array(*named)).alias("r")).where((F.col("kind") == "common") | F.col("r.k").isin("bias", "rmse_corr"))
    out = out.unionByName(m.select("draw", F.concat(F.col("r.k"), F.lit(" ("), "kind", F.lit(")")).alias("metric"), "side", F.col("r.value").alias("value")))
    return out.groupBy("draw", "metric").agg(F.max(F.when(F.col("side") == "A", F.col("value"))).alias("A"), F.max(F.when(F.col("side") == "B", F.col("value"))).alias("B"))


def call(lo: Column, hi: Column, metric: Column) -> Column:
    """better or worse where the interval leaves out zero, else ~; a signed bias is never called."""
    higher = metric.startswith("yield") | metric.startswith("coverage")
    up, down = F.when(higher, "better").otherwise("worse"), F.when(higher, "worse").otherwise("better")
    silent = lo.isNull() | hi.isNull() | metric.startswith("bias")
    return F.when(silent, "").when(lo > 0, up).when(hi < 0, down).otherwise("~")


def compare(pairs: DataFrame, weights: DataFrame | int, min_cases: int = 10, mask: Column | None = None) -> DataFrame:
    """metric, A, B, delta, lo, hi, call: both runs, their difference, its bootstrap interval and the verdict on it; ``weights`` as ``resampled`` takes them."""
    size = lambda s: s.unionByName(s.where(F.col("metric").startswith("bias")).select("draw", F.concat(F.lit("|"), F.regexp_replace("metric", " ", "| ")).alias("metric"), F.abs("A").alias("A"), F.abs("B").alias("B")))
    point = size(metric_set(pairs, None, mask))
    boot = size(metric_set(pairs, weights, mask)).withColumn("delta", F.col("B") - F.col("A"))
    ci = percentile_ci(boot, "delta", ("metric",))
    n = pairs.agg(F.count("*").alias("n_cases")) if mask is None else pairs.where(mask).agg(F.count("*").alias("n_cases"))
    out = point.join(ci, "metric").crossJoin(F.broadcast(n))
    verdict = F.when(F.col("n_cases") < min_cases, F.lit(f"n<{min_cases}")).otherwise(call(F.col("lo"), F.col("hi"), F.col("metric")))
    return out.select("metric", "A", "B", (F.col("B") - F.col("A")).alias("delta"), "lo", "hi", verdict.alias("call"))


def by_stratum(pairs: DataFrame, strata: DataFrame, column: str = "vza_max") -> DataFrame:
    """Accuracy on the common points per stratum (lo, hi], constants from all cases; empty strata have no row.

    ``strata`` (lo, hi) is a small table of right-closed bins.
    """
    sums = F.explode(F.array(*[F.struct(F.lit(s.upper()).alias("side"), F.col("n_c").alias("n"), F.col(f"s1_c{s}").alias("s1"), F.col(f"s2_c{s}").alias("s2")) for s in "ab"]))
    long = loo_constant(pairs.select("case_id", column, sums.alias("s")).select("case_id", column, "s.*"), ("side",))
    binned = long.join(few(strata), (F.col(column) > F.col("lo")) & (F.col(column) <= F.col("hi")))
    return binned.groupBy("lo", "hi", "side").agg(F.count("*").alias("n_cases"), *metric_columns())


def verdict_flips(pairs: DataFrame) -> DataFrame:
    """How often verdict qc_a met qc_b, with the changed ones flagged."""
    return pairs.groupBy("qc_a", "qc_b").agg(F.count("*").alias("n")).withColumn("changed", F.col("qc_a") != F.col("qc_b"))


def tail(pairs: DataFrame, km: float = 1.0) -> DataFrame:
    """Cases whose map is off by more than ``km`` in either run: fixed, broken or both."""
    a, b = F.coalesce(F.abs("map_off_a") > km, F.lit(False)), F.coalesce(F.abs("map_off_b") > km, F.lit(False))
    status = F.when(a & ~b, "fixed").when(~a & b, "broken").otherwise("both")
    return pairs.where(a | b).select("case_id", "vza_max", "n_c", "qc_a", "qc_b", "map_off_a", "map_off_b", status.alias("status"))


def movers(pairs: DataFrame, n: int = 8) -> DataFrame:
    """The n largest improvements and degradations, each a top-k."""
    t = pairs.select("case_id", "n_c", "map_off_a", "map_off_b", "d_abs_off")
    up = t.where("d_abs_off < 0").orderBy("d_abs_off", "case_id").limit(n).withColumn("kind", F.lit("improved"))
    return up.unionByName(t.where("d_abs_off > 0").orderBy(F.desc("d_abs_off"), "case_id").limit(n).withColumn("kind", F.lit("degraded")))


def pair_contrails(a: DataFrame, b: DataFrame) -> DataFrame:
    """Contrails that both runs scored: err_a, err_b."""
    side = lambda t, x: t.where("scored").select("case_id", "contrail", F.col("err").alias(f"err_{x}"))
    return side(a, "a").join(side(b, "b"), ["case_id", "contrail"])


def contrail_movers(joined: DataFrame, n: int = 8) -> DataFrame:
    """The n contrails whose error shrank most and grew most."""
    t = joined.withColumn("change", F.abs("err_b") - F.abs("err_a"))
    return t.orderBy("change", "case_id", "contrail").limit(n).unionByName(t.orderBy(F.desc("change"), "case_id", "contrail").limit(n)).distinct()


def outlier_cases(pairs: DataFrame, share: float = 0.25) -> DataFrame:
    """Cases whose offsets' sizes differ by more than a share of the largest."""
    return with_totals(pairs, limit=F.max(F.greatest(F.abs("map_off_a"), F.abs("map_off_b")))).where(F.abs("d_abs_off") > share * F.col("limit")).select("case_id", "d_abs_off", "limit")


def paired_contrails(joined: DataFrame, weights: DataFrame | int, ci: float = 95.0) -> DataFrame:
    """metric, A, B, delta, lo, hi, call for contrails that both runs scored (case_id, contrail, err_a, err_b).

    Cases are resampled; both runs share the weights, so the interval is of the paired difference. ``weights``: b, case_id, w over the
    joined contrails' cases, or the number of resamples; the runs themselves are draw -1.
    """
    sums = joined.groupBy("case_id").agg(F.count("*").alias("n"), *[f.alias(f"{k}_{s}") for s in "ab" for k, f in (("s1", F.sum(f"err_{s}")), ("s2", F.sum(F.col(f"err_{s}") * F.col(f"err_{s}"))))])
    columns = ["draw", "w", *[c for c in sums.columns if c != "case_id"]]
    x = sums.withColumn("draw", F.lit(-1).cast("long")).withColumn("w", F.lit(1).cast("long")).select(columns).unionByName(resampled(sums, weights).withColumn("draw", F.col("b").cast("long")).select(columns))
    x = x.groupBy("draw", "n").agg(*[v.alias(f"{k}_{s}") for s in "ab" for k, v in copy_sums(F.col(f"s1_{s}"), F.col(f"s2_{s}")).items()])
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), *[F.col(f"{k}_{s}").alias(k) for k in ("k", "s1", "s2", "q")]) for s in "ab"]))
    m = copy_constant(x.select("draw", "n", sides.alias("s")).select("draw", "n", "s.*"), ("draw", "side")).withColumn("|bias|", F.abs("bias"))
    long = m.select("draw", "side", F.explode(F.create_map(*[y for k in ("rmse_raw", "rmse_corr", "|bias|") for y in (F.lit(k), F.col(k))])).alias("metric", "value"))
    wide = long.groupBy("draw", "metric").agg(*[F.max(F.when(F.col("side") == s, F.col("value"))).alias(s.upper()) for s in "ab"])
    ends = percentile_ci(wide.where("draw >= 0").withColumn("delta", F.col("B") - F.col("A")), "delta", ("metric",), ci)
    verdict = F.when(F.col("lo").isNull() | F.col("hi").isNull(), "").when(F.col("lo") > 0, "worse").when(F.col("hi") < 0, "better").otherwise("~")
    return wide.where("draw = -1").join(ends, "metric", "left").select("metric", "A", "B", (F.col("B") - F.col("A")).alias("delta"), "lo", "hi", verdict.alias("call"))


def headline_filter(table: DataFrame) -> DataFrame:
    """A comparison table without its signed bias rows, with the panel each row belongs to: fraction or km."""
    share = F.col("metric").startswith("yield") | F.col("metric").startswith("coverage")
    return table.where(~F.col("metric").startswith("bias")).withColumn("panel", F.when(share, "fraction").otherwise("km"))


def arms_report(runs: dict[str, tuple[DataFrame, DataFrame, DataFrame]], pairs: list[tuple[str, str]], n_boot: int = 2000, gate: float = 0.6, qc=("ok",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(comparisons, contrail comparisons, verdict flips) over pairs of arms, each with its arms in columns a and b.

    ``runs``: name to (cases, profiles, scored contrails). Pairs are few and planned by the caller; each is one comparison.
    """
    tables: list[list[DataFrame]] = [[], [], []]
    for a, b in pairs:
        mark = lambda df, a=a, b=b: df.select(F.lit(a).alias("a"), F.lit(b).alias("b"), "*")
        paired = pair_runs(runs[a][0], runs[a][1], runs[b][0], runs[b][1], gate, qc)
        joined = pair_contrails(runs[a][2], runs[b][2])
        own = compare(paired, n_boot)
        both = paired_contrails(joined, n_boot)
        flips = verdict_flips(paired)
        for held, df in zip(tables, (own.withColumnsRenamed({"A": "value_a", "B": "value_b"}), both.withColumnsRenamed({"A": "value_a", "B": "value_b"}), flips)):
            held.append(mark(df))
    union = lambda parts: parts[0] if len(parts) == 1 else union([parts[0].unionByName(parts[1]), *parts[2:]])
    return tuple(map(union, tables))
