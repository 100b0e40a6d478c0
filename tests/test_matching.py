"""What has no SQL twin, against plain NumPy: the Fourier filter, prepared views, and the chains from pixels to heights."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parallaxis.operators import conditioning as cd, geometry as geo, matching as mc, stencil as st

N = 24


def field(seed: int, holes: float = 0.04, shape: tuple[int, int] = (N, N)) -> np.ndarray:
    rng = np.random.default_rng(seed)
    z = rng.normal(size=shape).cumsum(0) + rng.normal(size=shape).cumsum(1)
    z[rng.random(shape) < holes] = np.nan
    return z


def long(spark, z: np.ndarray, **keys):
    rows = [(i, j, None if np.isnan(z[i, j]) else float(z[i, j])) for i in range(z.shape[0]) for j in range(z.shape[1])]
    return spark.createDataFrame(rows, "i int, j int, v double").select(*[F.lit(v).alias(k) for k, v in keys.items()], "i", "j", "v")


def image(rows, column: str, shape: tuple[int, int] = (N, N)) -> np.ndarray:
    out = np.full(shape, np.nan)
    for r in rows:
        out[r["i"], r["j"]] = np.nan if r[column] is None else r[column]
    return out


def mirrored(k: int, n: int) -> int:
    m = k % (2 * n)
    return 2 * n - 1 - m if m >= n else m


def smooth(z: np.ndarray, si: float, sj: float) -> np.ndarray:
    for axis, s in ((1, sj), (0, si)):
        r = math.floor(4 * s + 0.5)
        w = np.array([math.exp(-0.5 * d * d / s**2) for d in range(-r, r + 1)])
        w /= w.sum()
        n = z.shape[axis]
        z = sum(w[d + r] * np.take(z, [mirrored(k + d, n) for k in range(n)], axis=axis) for d in range(-r, r + 1))
    return z


def highpass(z: np.ndarray, si: float, sj: float) -> np.ndarray:
    m = ~np.isnan(z)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(m, z - smooth(np.where(m, z, 0), si, sj) / smooth(m.astype(float), si, sj), np.nan)


def local_corr(a: np.ndarray, b: np.ndarray, wi: int, wj: int) -> tuple[np.ndarray, np.ndarray]:
    """(r, amp)"""
    r, amp = np.full(a.shape, np.nan), np.full(a.shape, np.nan)
    w = (~np.isnan(a) & ~np.isnan(b)).astype(float)
    a0, b0 = np.nan_to_num(a), np.nan_to_num(b)
    for i in range(a.shape[0]):
        for j in range(a.shape[1]):
            at = np.ix_([mirrored(i + d, a.shape[0]) for d in range(-(wi // 2), wi // 2 + 1)], [mirrored(j + d, a.shape[1]) for d in range(-(wj // 2), wj // 2 + 1)])
            share = w[at].mean()
            if share < 0.7:
                continue
            mean = lambda x: x[at].mean() / share  # noqa: E731, B023
            va, vb = mean(a0 * a0) - mean(a0) ** 2, mean(b0 * b0) - mean(b0) ** 2
            amp[i, j] = math.sqrt(max(va, 0))
            if va > 0 and vb > 0:
                r[i, j] = (mean(a0 * b0) - mean(a0) * mean(b0)) / math.sqrt(va * vb)
    return r, amp


#: Two cases of other shapes, cells, filters, windows and footprints: n, px, sigma, win.
CASES = {"a": ((24, 19), (2.0, 1.8), (2.0, 1.5), (5, 7)), "b": ((17, 22), (1.6, 2.1), (1.5, 2.5), (7, 3))}
COVS = {"a": {16: (3.0, 0.8, 2.0), 17: (2.2, -0.4, 2.8)}, "b": {16: (4.0, -0.6, 2.5), 17: (2.5, 0.2, 2.4)}}


def sizes_of(spark, names=tuple(CASES)):
    rows = [(k, *CASES[k][0], *CASES[k][2], *CASES[k][3], *CASES[k][1]) for k in names]
    return spark.createDataFrame(rows, "case_id string, n_i int, n_j int, sigma_i double, sigma_j double, win_i int, win_j int, px_i double, px_j double")


def feet_of(spark, covs=COVS):
    rows = [(k, s, 1.0, 2.0, 3.0, 4.0, *c) for k, own in covs.items() for s, c in own.items()]
    return spark.createDataFrame(rows, "case_id string, sat int, vza double, vaz double, gsd_along_km double, gsd_across_km double, cnn double, cne double, cee double")


def widest(covs) -> float:
    return max(math.sqrt(np.linalg.eigvalsh([[a, b], [b, c]]).max()) for a, b, c in covs.values())


def filtered(z: np.ndarray, sat: int, covs: dict, px: tuple[float, float]) -> np.ndarray:
    """To the smallest transfer function of all views."""
    pad = [math.ceil(4 * widest(covs) / p) for p in px]
    shape = [n + 2 * p for n, p in zip(z.shape, pad)]
    k = [2 * np.pi * np.fft.fftfreq(n, p) for n, p in zip(shape, px)]
    power = {s: a * k[0][:, None] ** 2 + 2 * b * k[0][:, None] * k[1][None] + c * k[1][None] ** 2 for s, (a, b, c) in covs.items()}
    t = np.exp(-(np.maximum(*power.values()) - power[sat]) / 2)
    whole = np.pad(z, [(p, p) for p in pad], constant_values=np.nan)
    m = ~np.isnan(whole)
    num, den = (np.fft.ifft2(np.fft.fft2(y) * t).real for y in (np.where(m, whole, 0), m.astype(float)))
    with np.errstate(invalid="ignore", divide="ignore"):
        out = np.where(m & (np.abs(den) > 1e-3), num / den, np.nan)
    return out[pad[0] : pad[0] + z.shape[0], pad[1] : pad[1] + z.shape[1]]


def rounded_off(z: np.ndarray, sat: int, covs: dict, px: tuple[float, float]) -> np.ndarray:
    """To one round footprint."""
    t, (nn, ne, ee) = 1.05 * widest(covs), covs[sat]
    kernel = cd.blur_kernel((t * t - nn, -ne, t * t - ee), px)
    hi, hj = kernel.shape[0] // 2, kernel.shape[1] // 2
    hold = lambda k, n: min(max(k, 0), n - 1)
    turn = lambda y: np.array([[sum(kernel[a + hi, b + hj] * y[hold(i - a, y.shape[0]), hold(j - b, y.shape[1])] for a in range(-hi, hi + 1) for b in range(-hj, hj + 1)) for j in range(y.shape[1])] for i in range(y.shape[0])])
    m = ~np.isnan(z)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(m, turn(np.where(m, z, 0)) / turn(m.astype(float)), np.nan)


def conditioned(z: np.ndarray, prep: str, sat: int, case: str, covs=COVS) -> np.ndarray:
    _, px, sigma, _ = CASES[case]
    z = {"hp": lambda: z, "psf_iso": lambda: rounded_off(z, sat, covs[case], px), "psf_minmtf": lambda: filtered(z, sat, covs[case], px)}[prep]()
    return highpass(z, *sigma)


@pytest.mark.parametrize("prep", ["hp", "psf_iso", "psf_minmtf"])
def test_condition_makes_views_of_many_cases_comparable(spark, prep):
    z = {(k, s): field(10 * n + s, shape=CASES[k][0]) for n, k in enumerate(CASES) for s in (16, 17)}
    x = None
    for (k, s), own in z.items():
        x = (lambda y: y if x is None else x.unionByName(y))(long(spark, own, case_id=k, sat=s))
    got = cd.condition(x, prep, sizes_of(spark), feet_of(spark)).collect()
    for (k, s), own in z.items():
        np.testing.assert_allclose(image([r for r in got if (r.case_id, r.sat) == (k, s)], "hp", own.shape), conditioned(own, prep, s, k), atol=1e-9)
    extra = {r.case_id: r.extra for r in cd.condition_diagnostics(feet_of(spark), prep).collect()}
    if prep == "hp":
        assert extra == {}
    else:
        assert extra["b"]["psf_vza_17"] == 1.0 and len(extra["a"]) == (9 if prep == "psf_iso" else 8)
    if prep == "psf_iso":
        assert extra["b"]["psf_sigma_t_km"] == pytest.approx(1.05 * widest(COVS["b"]))


def test_equal_footprints_need_no_kernel_and_wider_ones_are_refused(spark):
    same = {"a": {16: (2.0, 0.0, 2.0), 17: (2.0, 0.0, 2.0)}}
    rows = cd.blur_kernels(feet_of(spark, same), sizes_of(spark), inflate=1.0).collect()
    assert [(r.di, r.w) for r in rows] == [(0, [1.0])] * 2
    with pytest.raises(Exception, match="cover"):
        cd.blur_kernels(feet_of(spark, same), sizes_of(spark), inflate=0.5).collect()
    assert cd.footprints(spark.createDataFrame([("near", 30.0, -100.0), ("far", 10.0, 60.0)], "case_id string, lat double, lon double")).select("case_id").distinct().collect()[0].case_id == "near"


def bilinear(z: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.full(r.shape, np.nan)
    ok = (r >= 0) & (r <= z.shape[0] - 1) & (c >= 0) & (c <= z.shape[1] - 1)
    i, j = np.minimum(np.floor(r[ok]).astype(int), z.shape[0] - 2), np.minimum(np.floor(c[ok]).astype(int), z.shape[1] - 2)
    p, q = r[ok] - i, c[ok] - j
    out[ok] = (1 - p) * (1 - q) * z[i, j] + (1 - p) * q * z[i, j + 1] + p * (1 - q) * z[i + 1, j] + p * q * z[i + 1, j + 1]
    return out


def union(parts):
    return parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))


def scene(spark, holes=0.01):
    """Views of both cases by both satellites, with pixel times and winds; two images of 40 x 40 per case."""
    z = {(k, s): field(7 * n + s, holes, (40, 40)) for n, k in enumerate(CASES) for s in (16, 17)}
    cases = spark.createDataFrame([(k,) for k in CASES], "case_id string")
    centre = cases.withColumn("lat", F.lit(36.0)).withColumn("lon", F.lit(-105.0))
    views = {}
    for sat, dt in ((16, 0.0), (17, 45.0)):
        axes = geo.geos_forward(geo.apparent_position(centre, 10.0, geo.SAT_LON[sat]), geo.SAT_LON[sat], "alat", "alon")
        axes = axes.select("case_id", (F.col("x_rad") - 20 * 5.6e-5).alias("x0"), F.lit(5.6e-5).alias("dx"), (F.col("y_rad") + 20 * 5.6e-5).alias("y0"), F.lit(-5.6e-5).alias("dy"), F.lit(dt).alias("dt0_s"))
        px = union([long(spark, z[k, sat], case_id=k) for k in CASES]).withColumnsRenamed({"i": "row", "j": "col", "v": "btd"})
        views[sat] = mc.View(sat, px, axes, px.select("case_id", "row", "col", (F.col("row") * 1.5 + F.col("col") * 0.1).alias("sec")))
    winds = spark.createDataFrame([(k, h, 20.0 + h + 5 * n, -8.0 - h) for n, k in enumerate(CASES) for h in (6.0, 10.0, 14.0)], "case_id string, h double, u double, v double")
    return z, views, winds


@pytest.mark.parametrize("prep", ["hp", "psf_iso", "psf_minmtf"])
def test_match_snapshot_from_pixels_to_heights(spark, prep):
    """Two cases of other grids in one plan, with winds and pixel times. Positions come from the projections, which have SQL twins; all that
    follows them is done again in NumPy."""
    z, views, winds = scene(spark)
    heights = spark.createDataFrame([(k, 8.0 + 1.5 * k) for k in range(3)], "h_idx int, h double")
    grid = spark.createDataFrame([(k, i, j, 35.78 + 0.018 * i, -105.2 + 0.02 * j) for k, (n, *_) in CASES.items() for i in range(n[0]) for j in range(n[1])], "case_id string, i int, j int, lat double, lon double")
    cube, overlap = mc.match_snapshot(grid, heights, views[16], views[17], sizes_of(spark), winds, prep, feet_of(spark))
    got = cube.collect()
    share = {r.case_id: r.valid_frac for r in overlap.collect()}
    points = grid.crossJoin(heights)
    places = {s: {(r.case_id, r.h_idx, r.i, r.j): (r.frow, r.fcol) for r in mc.project_view(points, views[s], winds).collect()} for s in (16, 17)}
    seen = 0
    for k, (n, _, _, win) in CASES.items():
        amp = None
        for h in (1, 0, 2):
            sides = []
            for s in (16, 17):
                at = np.array([[places[s][k, h, i, j] for j in range(n[1])] for i in range(n[0])], float)
                sides.append(conditioned(bilinear(z[k, s], at[..., 0], at[..., 1]), prep, s, k))
            r, a = local_corr(*sides, *win)
            if h == 1:  # the middle height, and the one nearest to 10 km
                amp = a
                assert share[k] == pytest.approx((~np.isnan(sides[0]) & ~np.isnan(sides[1])).mean())
            own = [x for x in got if (x.case_id, x.h_idx) == (k, h)]
            np.testing.assert_allclose(image(own, "r", n), r, atol=1e-6)
            np.testing.assert_allclose(image(own, "amp", n), np.where(np.isnan(image(own, "amp", n)) & np.isnan(r), np.nan, amp), atol=1e-6)
            seen += (~np.isnan(r)).sum()
    assert seen > 500


def test_match_native_with_winds(spark):
    """Native pixels of two crops: the other view's place is found by reading its time again, all heights in one plan."""
    z, views, winds = scene(spark)
    crops = {"a": (26, 22), "b": (21, 28)}
    heights = spark.createDataFrame([(k, 8.0 + 2.0 * k) for k in range(4)], "h_idx int, h double")
    px = views[16].pixels.join(views[16].axes, "case_id").select("case_id", "row", "col", "btd", (F.col("x0") + (F.col("col") + 8) * F.col("dx")).alias("x_rad"), (F.col("y0") + (F.col("row") + 8) * F.col("dy")).alias("y_rad"), (F.col("row") * 1.5 + F.col("col") * 0.1).alias("t_s"))
    native = mc.native_positions(px.where(" or ".join(f"case_id = '{k}' and row < {n} and col < {m}" for k, (n, m) in crops.items())), 16)
    filters = mc.native_filters(mc.native_jacobian(native, 16), hp_km=5.0, win_km=14.0)
    sizes = mc.native_sizes(native, filters)
    boxes = spark.createDataFrame([(k, 35.8, 36.2, -105.3, -104.8) for k in crops], "case_id string, lat0 double, lat1 double, lon0 double, lon1 double")
    out, overlap = mc.match_native(native, heights, views[16], views[17], boxes, sizes, winds, r_min=0.05, amp_min=0.0, h0=8.0, step=2.0, n_heights=4)
    got, share = out.collect(), {r.case_id: r.valid_frac for r in overlap.collect()}
    own = {r.case_id: r for r in sizes.collect()}
    points = geo.true_position(native.crossJoin(heights), F.col("h"), geo.SAT_LON[16]).select("case_id", "h_idx", "h", F.col("row").alias("i"), F.col("col").alias("j"), F.col("tlat").alias("lat"), F.col("tlon").alias("lon"), F.col("t_s").alias("t_ref"))
    places = {(r.case_id, r.h_idx, r.i, r.j): (r.frow, r.fcol, r.lat, r.lon) for r in mc.project_to_other(points, views[17], winds).collect()}
    still = {(r.case_id, r.h_idx, r.i, r.j): r.fcol for r in mc.project_to_other(points, views[17]).collect()}
    assert max(abs(places[k][1] - still[k]) for k in places) > 0.3  # the winds carry clouds by a good part of a pixel
    found = 0
    for k, n in crops.items():
        s = own[k]
        assert (s.n_i, s.n_j) == n
        a = highpass(z[k, 16][: n[0], : n[1]], s.sigma_i, s.sigma_j)
        cube, amp = np.full((4, *n), np.nan), None
        for h in range(4):
            at = np.array([[places[k, h, i, j] for j in range(n[1])] for i in range(n[0])], float)
            b = highpass(bilinear(z[k, 17], at[..., 0], at[..., 1]), s.sigma_i, s.sigma_j)
            cube[h], x = local_corr(a, b, s.win_i, s.win_j)
            if h == 2:
                amp = x
            if h == 1:
                inside = (at[..., 2] >= 35.8) & (at[..., 2] <= 36.2) & (at[..., 3] >= -105.3) & (at[..., 3] <= -104.8)
                assert share[k] == pytest.approx((~np.isnan(a) & ~np.isnan(b))[inside].mean())
        for r in (r for r in got if r.case_id == k):
            c = cube[:, r.row, r.col].astype(np.float32).astype(float)
            m = int(np.nanargmax(c))
            assert r.r == pytest.approx(c[m], abs=1e-6)
            if 0 < m < 3 and c[m] > 0.05 and amp[r.row, r.col] > 0:
                lo, hi = c[m - 1], c[m + 1]
                bend = lo - 2 * c[m] + hi
                d = 0.0 if np.isnan(bend) or bend == 0 else max(-1.0, min(1.0, 0.5 * (lo - hi) / bend))
                assert r.height == pytest.approx(8.0 + (m + d) * 2.0, abs=1e-4)
                found += 1
            else:
                assert r.height is None
    assert found > 100
    diag = {r.case_id: r for r in mc.native_diagnostics(out, filters).collect()}
    assert diag["a"].win_px_i == own["a"].win_i and 0 < diag["a"].native_ny <= 26


def test_images_do_not_mix(spark):
    """Two images under one key each give what each gives alone."""
    a, b = long(spark, field(7), img=0), long(spark, field(8), img=1)
    both = a.unionByName(b).withColumnRenamed("v", "btd")
    scores = st.row_stripe_scores(both, ("img",)).collect()
    for img, z in ((0, a), (1, b)):
        alone = {r.i: r.score for r in st.row_stripe_scores(z.withColumnRenamed("v", "btd")).collect()}
        for r in scores:
            if r.img == img:
                assert (r.score is None) == (alone[r.i] is None) and (r.score is None or abs(r.score - alone[r.i]) < 1e-12)


def test_true_position_undoes_apparent_position(spark):
    x = spark.createDataFrame([(lat, lon) for lat in (-40.0, 0.0, 35.0) for lon in (-100.0, -70.0)], "lat double, lon double")
    for r in geo.true_position(geo.apparent_position(x, 11.0, geo.SAT_LON[16]), 11.0, geo.SAT_LON[16]).collect():
        assert abs(r.tlat - r.lat) < 1e-7 and abs(r.tlon - r.lon) < 1e-7 and abs(r.residual_m) < 1e-3
