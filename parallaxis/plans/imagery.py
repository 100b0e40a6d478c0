"""Queries over images: stripes, sampling, correlation, heights, patches, conditioning; all with an image key."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import conditioning as cd, metrics as mt, stencil as st
from ..sources import times
from .fixtures import cte
from .registry import _out, query

_N = 40
BY = ("img",)

_SCORES = f"""{cte("fx_pixels")}, l AS (SELECT img, i, CASE WHEN lag(i) OVER w = i - 1 AND lead(i) OVER w = i + 1 THEN abs(btd - (lag(btd) OVER w + lead(btd) OVER w)/2) END AS lap FROM fx_pixels WINDOW w AS (PARTITION BY img, j ORDER BY i)),
 rw AS (SELECT img, i, avg(lap) AS lap FROM l GROUP BY img, i), md AS (SELECT img, median(lap) AS m FROM rw GROUP BY img), scores AS (SELECT rw.img, i, CASE WHEN m > 0 THEN lap/m END AS score FROM rw JOIN md ON md.img = rw.img)"""


@query("g12_row_stripe_scores", f"{_SCORES} SELECT img, i, {_out(score='score')} FROM scores")
def _(v, spark):
    return st.row_stripe_scores(v("fx_pixels"), BY)


_FLAGS = f"""{_SCORES}, mm AS (SELECT img, median(score) AS med, min(i) AS lo, max(i) AS hi FROM scores GROUP BY img), dv AS (SELECT s.img, i, score, med, lo, hi, abs(score - med) AS d FROM scores s JOIN mm ON mm.img = s.img),
 md2 AS (SELECT img, median(d) AS mad FROM dv GROUP BY img), z AS (SELECT dv.*, (score - med)/(1.4826*mad + 1e-12) AS z FROM dv JOIN md2 ON md2.img = dv.img), flags AS (SELECT DISTINCT img, i + d.d AS i FROM z, (VALUES (-1), (0), (1)) d(d) WHERE z > 1.5 AND i + d.d BETWEEN lo AND hi)"""


@query("g13_flag_stripes", f"{_FLAGS} SELECT img, i FROM flags")
def _(v, spark):
    return st.flag_stripes(st.row_stripe_scores(v("fx_pixels"), BY), 1.5, by=BY)


@query("g14_mask_rows", f"{_FLAGS} SELECT p.img, p.i, j, CASE WHEN f.i IS NULL THEN btd END AS btd FROM fx_pixels p LEFT JOIN flags f ON f.img = p.img AND f.i = p.i", exact=True)
def _(v, spark):
    pixels = v("fx_pixels")
    return st.mask_rows(pixels, st.flag_stripes(st.row_stripe_scores(pixels, BY), 1.5, by=BY), BY)


@query(
    "g7_sample_bilinear",
    f"{cte('fx_pixels')}, p AS (SELECT img, i*40 + j AS pid, i + 0.25 AS fi, j + 0.5 AS fj FROM fx_pixels WHERE i < 39 AND j < 39), c AS (SELECT img, pid, floor(fi)::BIGINT + di AS i, floor(fj)::BIGINT + dj AS j, (1 - abs(fi - floor(fi) - di))*(1 - abs(fj - floor(fj) - dj)) AS w FROM p, (VALUES (0), (1)) a(di), (VALUES (0), (1)) b(dj)) "
    f"SELECT c.img, pid, {_out(value='CASE WHEN count(btd) = 4 THEN sum(w*btd) END')} FROM c LEFT JOIN fx_pixels x ON x.img = c.img AND x.i = c.i AND x.j = c.j GROUP BY c.img, pid",
)
def _(v, spark):
    pixels = v("fx_pixels")
    points = pixels.where("i < 39 and j < 39").select("img", (F.col("i") * 40 + F.col("j")).alias("pid"), (F.col("i") + 0.25).alias("fi"), (F.col("j") + 0.5).alias("fj"))
    return st.sample_bilinear(points, pixels, BY)


_REFLECT = "CASE WHEN {0} < 0 THEN -1 - {0} WHEN {0} > 39 THEN 79 - {0} ELSE {0} END"


@query(
    "g15_local_corr",
    f"{cte('fx_pair')}, off AS (SELECT * FROM (VALUES (-2), (-1), (0), (1), (2)) x(d)), cells AS (SELECT m.img, a.i, b.j FROM (SELECT unnest(range(40)) AS i) a, (SELECT unnest(range(40)) AS j) b, (VALUES (0), (1)) m(img)), "
    f"n AS (SELECT c.img, c.i, c.j, {_REFLECT.format('(c.i + o.d)')} AS ii, {_REFLECT.format('(c.j + q.d)')} AS jj FROM cells c, off o, off q), "
    "s AS (SELECT n.img, n.i, n.j, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL)/25.0::DOUBLE AS w, coalesce(sum(a), 0)/25 AS ma, coalesce(sum(b), 0)/25 AS mb, coalesce(sum(a*b), 0)/25 AS mab, coalesce(sum(a*a), 0)/25 AS maa, coalesce(sum(b*b), 0)/25 AS mbb FROM n LEFT JOIN fx_pair p ON p.img = n.img AND p.i = n.ii AND p.j = n.jj GROUP BY n.img, n.i, n.j), "
    "v AS (SELECT *, maa/w - (ma/w)*(ma/w) AS va, mbb/w - (mb/w)*(mb/w) AS vb FROM s WHERE w > 0) "
    f"SELECT img, i::BIGINT AS i, j::BIGINT AS j, {_out(r='CASE WHEN w >= 0.7 AND va > 0 AND vb > 0 THEN (mab/w - (ma/w)*(mb/w))/sqrt(va*vb) END', amp='CASE WHEN w >= 0.7 THEN sqrt(greatest(va, 0)) END', valid='w')} FROM v",
)
def _(v, spark):
    return st.local_corr(v("fx_pair"), _N, _N, by=BY)


@query(
    "g17_height_map",
    f"{cte('fx_cube')}, t AS (SELECT *, lag(r) OVER w AS lo, lead(r) OVER w AS hi, row_number() OVER (PARTITION BY img, i, j ORDER BY r DESC NULLS LAST, h_idx) AS k FROM fx_cube WINDOW w AS (PARTITION BY img, i, j ORDER BY h_idx)) "
    f"SELECT img, i, j, {_out(height='CASE WHEN r > 0.35 AND amp > 0.25 AND h_idx > 0 AND h_idx < 32 THEN 8.0 + (h_idx + greatest(-1.0, least(1.0, coalesce(0.5*(lo - hi)/nullif(lo - 2*r + hi, 0), 0))))*0.25 END', r='r', amp='amp')} FROM t WHERE k = 1 AND r IS NOT NULL",
)
def _(v, spark):
    return st.height_map(v("fx_cube"), by=BY)


def gaussian(sigma: float, order: int = 0) -> str:
    """(d, w) rows of a kernel out to four sigma, for SQL."""
    r = math.floor(4 * sigma + 0.5)
    w = [math.exp(-0.5 * d * d / sigma**2) for d in range(-r, r + 1)]
    w = [x / sum(w) * (d / sigma**2 if order else 1.0) for d, x in zip(range(-r, r + 1), w)]
    return f"(SELECT * FROM (VALUES {', '.join(f'({d}, {x!r}::DOUBLE)' for d, x in zip(range(-r, r + 1), w))}) k(d, w))"


def smooth_sql(name: str, source: str, columns: tuple[str, ...], sigma_i: float, sigma_j: float, key: str = "img", orders: tuple[int, int] = (0, 0)) -> str:
    """CTEs that filter columns of ``source`` (key, i, j) on a full 40 x 40 lattice by two one-dimensional kernels with mirrored edges."""
    mirror = lambda c: f"(CASE WHEN (({c}) % 80 + 80) % 80 >= 40 THEN 79 - (({c}) % 80 + 80) % 80 ELSE (({c}) % 80 + 80) % 80 END)"
    full = f"{name}_0 AS (SELECT m.{key}, a.i, b.j, {', '.join(f'coalesce(s.{c}, 0.0) AS {c}' for c in columns)} FROM (SELECT DISTINCT {key} FROM {source}) m CROSS JOIN (SELECT unnest(range(40)) AS i) a CROSS JOIN (SELECT unnest(range(40)) AS j) b LEFT JOIN {source} s ON s.{key} = m.{key} AND s.i = a.i AND s.j = b.j)"
    sums = ", ".join(f"sum(w*s.{c}) AS {c}" for c in columns)
    one = f"{name}_1 AS (SELECT c.{key}, c.i, c.j, {sums} FROM {name}_0 c CROSS JOIN {gaussian(sigma_j, orders[1])} k JOIN {name}_0 s ON s.{key} = c.{key} AND s.i = c.i AND s.j = {mirror('c.j + k.d')} GROUP BY c.{key}, c.i, c.j)"
    two = f"{name} AS (SELECT c.{key}, c.i, c.j, {sums} FROM {name}_1 c CROSS JOIN {gaussian(sigma_i, orders[0])} k JOIN {name}_1 s ON s.{key} = c.{key} AND s.j = c.j AND s.i = {mirror('c.i + k.d')} GROUP BY c.{key}, c.i, c.j)"
    return f"{full}, {one}, {two}"


_HP = f"{cte('fx_pixels')}, src AS (SELECT img, i, j, btd AS v, 1.0::DOUBLE AS m FROM fx_pixels WHERE btd IS NOT NULL), {smooth_sql('sm', 'src', ('v', 'm'), 2.0, 1.5)}, hp AS (SELECT p.img, p.i, p.j, p.v, p.v - sm.v/sm.m AS hp FROM src p JOIN sm ON sm.img = p.img AND sm.i = p.i AND sm.j = p.j)"


def _highpassed(v):
    return cd.highpass(v("fx_pixels").withColumnRenamed("btd", "v"), _N, _N, 2.0, 1.5, BY)


@query("g8_highpass", f"{_HP} SELECT img, i::INT AS i, j::INT AS j, {_out(v='v', hp='hp')} FROM hp")
def _(v, spark):
    return _highpassed(v)


@query("g21_row_mean_scatter", f"{_HP}, m AS (SELECT img, i, avg(hp) AS m FROM hp GROUP BY img, i), s AS (SELECT img, m, abs(m - lag(m) OVER (PARTITION BY img ORDER BY i)) AS step FROM m) SELECT img, {_out(sd='stddev_pop(m)', max_step='max(step)')} FROM s GROUP BY img")
def _(v, spark):
    return st.row_mean_scatter(_highpassed(v), BY)


_PX = (2.0, 1.8)
#: Two scenes, each of both images, with footprints (north, north-east, east; km squared) and cells (km) of their own.
_COVS = {0: {16: (3.0, 0.8, 2.0), 17: (2.2, -0.4, 2.8)}, 1: {16: (2.6, 0.1, 1.9), 17: (3.3, 0.5, 2.4)}}
_CELLS = {0: _PX, 1: (1.7, 2.1)}


def _width(scene: int) -> float:
    return max(math.sqrt((a + c) / 2 + math.hypot((a - c) / 2, b)) for a, b, c in _COVS[scene].values())


def _scenes(v, spark):
    """(fields: case_id, sat, i, j, v; sizes; footprints): image 0 is the eastern view of scene 0 and the western one of scene 1, image 1 the others."""
    x = v("fx_pixels").select(F.explode(F.array(F.lit(0), F.lit(1))).alias("case_id"), "img", "i", "j", F.col("btd").alias("v"))
    x = x.select("case_id", F.when(F.col("img") == F.col("case_id"), 16).otherwise(17).alias("sat"), "i", "j", "v")
    sizes = spark.createDataFrame([(k, _N, _N, 2.0, 1.5, 7, 5, *px) for k, px in _CELLS.items()], "case_id int, n_i int, n_j int, sigma_i double, sigma_j double, win_i int, win_j int, px_i double, px_j double")
    feet = spark.createDataFrame([(k, sat, *c) for k, own in _COVS.items() for sat, c in own.items()], "case_id int, sat int, cnn double, cne double, cee double")
    return x, sizes, feet


_VIEWS = f"{cte('fx_pixels')}, vw AS (SELECT c.case_id, CASE WHEN img = c.case_id THEN 16 ELSE 17 END AS sat, 100*c.case_id + CASE WHEN img = c.case_id THEN 16 ELSE 17 END AS view, i, j, btd AS v FROM fx_pixels CROSS JOIN (SELECT unnest(range(2))::INT AS case_id) c WHERE btd IS NOT NULL)"


def _kernels_sql() -> str:
    """(view, di, dj, w) of each view's kernel to the round footprint of its scene."""
    rows = []
    for scene, own in _COVS.items():
        t = 1.05 * _width(scene)
        for sat, (nn, ne, ee) in own.items():
            k = cd.blur_kernel((t * t - nn, -ne, t * t - ee), _CELLS[scene])
            hi, hj = k.shape[0] // 2, k.shape[1] // 2
            rows += [f"({100 * scene + sat}, {a - hi}, {b - hj}, {float(k[a, b])!r}::DOUBLE)" for a in range(k.shape[0]) for b in range(k.shape[1])]
    return f"(SELECT * FROM (VALUES {', '.join(rows)}) k(view, di, dj, w))"


_BLURRED = (
    f"{_VIEWS}, nb AS (SELECT c.case_id, c.sat, c.view, c.i, c.j, c.v, k.w, s.v AS o FROM vw c JOIN {_kernels_sql()} k ON k.view = c.view LEFT JOIN vw s ON s.view = c.view AND s.i = greatest(0, least(39, c.i - k.di)) AND s.j = greatest(0, least(39, c.j - k.dj))), "
    "bl AS (SELECT case_id, sat, view, i, j, v, sum(w*coalesce(o, 0))/sum(CASE WHEN o IS NOT NULL THEN w ELSE 0 END) AS blurred FROM nb GROUP BY ALL)"
)


@query("g9_blur_kernel", f"{_BLURRED} SELECT case_id, sat, i::INT AS i, j::INT AS j, {_out(v='v', blurred='blurred')} FROM bl")
def _(v, spark):
    fields, sizes, feet = _scenes(v, spark)
    return cd.blur(fields, cd.blur_kernels(feet, sizes), F.col("n_i"), F.col("n_j"), ("case_id", "sat"), sizes)


def _dft(name: str, source: str, axis: str, sign: int) -> str:
    """A CTE with the transform of (vr, vi, mr, mi) along an axis: the new index takes the old one's place."""
    other = "j" if axis == "i" else "i"
    c, sn = (f"{f}(2*pi()*((s.{axis}*k.k) % z.s{axis})/z.s{axis})" for f in ("cos", "sin"))
    turn = lambda n: f"sum({n}r*{c} - {sign}*{n}i*{sn}) AS {n}r, sum({n}i*{c} + {sign}*{n}r*{sn}) AS {n}i"
    return f"{name} AS (SELECT s.view, k.k AS {axis}, s.{other}, {turn('v')}, {turn('m')} FROM {source} s JOIN z ON z.view = s.view JOIN (SELECT view, unnest(range(s{axis})) AS k FROM z) k ON k.view = s.view GROUP BY s.view, k.k, s.{other})"


_SHAPES = ", ".join(f"({100 * k + sat}, {_N + 2 * math.ceil(4 * _width(k) / _CELLS[k][0])}, {_N + 2 * math.ceil(4 * _width(k) / _CELLS[k][1])}, {_CELLS[k][0]}::DOUBLE, {_CELLS[k][1]}::DOUBLE, {', '.join(f'{float(x)}::DOUBLE' for c in (own[sat], *(o for t, o in own.items() if t != sat)) for x in c)})" for k, own in _COVS.items() for sat in own)
_FILTERED = (
    f"{_VIEWS}, z AS (SELECT * FROM (VALUES {_SHAPES}) z(view, si, sj, pi_, pj_, nn, ne, ee, nn2, ne2, ee2)), c0 AS (SELECT vw.view, vw.i + (si - 40)//2 AS i, vw.j + (sj - 40)//2 AS j, v AS vr, 0.0::DOUBLE AS vi, 1.0::DOUBLE AS mr, 0.0::DOUBLE AS mi FROM vw JOIN z ON z.view = vw.view), "
    f"{_dft('c1', 'c0', 'j', -1)}, {_dft('c2', 'c1', 'i', -1)}, "
    "kk AS (SELECT c2.*, 2*pi()*(CASE WHEN i <= (si - 1)//2 THEN i ELSE i - si END)/(si*pi_) AS ky, 2*pi()*(CASE WHEN j <= (sj - 1)//2 THEN j ELSE j - sj END)/(sj*pj_) AS kx, nn, ne, ee, nn2, ne2, ee2 FROM c2 JOIN z ON z.view = c2.view), "
    "tt AS (SELECT *, exp(-0.5*(greatest(nn*ky*ky + 2*ne*ky*kx + ee*kx*kx, nn2*ky*ky + 2*ne2*ky*kx + ee2*kx*kx) - (nn*ky*ky + 2*ne*ky*kx + ee*kx*kx))) AS t FROM kk), "
    f"c3 AS (SELECT view, i, j, vr*t AS vr, vi*t AS vi, mr*t AS mr, mi*t AS mi FROM tt), {_dft('c4', 'c3', 'i', 1)}, {_dft('c5', 'c4', 'j', 1)}, "
    "fl AS (SELECT vw.case_id, vw.sat, vw.view, vw.i, vw.j, vw.v, CASE WHEN abs(mr/(si*sj)) > 1e-3 THEN vr/mr END AS blurred FROM vw JOIN z ON z.view = vw.view JOIN c5 ON c5.view = vw.view AND c5.i = vw.i + (si - 40)//2 AND c5.j = vw.j + (sj - 40)//2)"
)


@query("g10_min_mtf_filter", f"{_FILTERED} SELECT case_id, sat, i::INT AS i, j::INT AS j, {_out(v='v', blurred='blurred')} FROM fl")
def _(v, spark):
    fields, sizes, feet = _scenes(v, spark)
    return cd.min_mtf(fields, feet, sizes)


def _sharpened(blurred: str, name: str) -> str:
    return f"{blurred}, sx AS (SELECT view, i, j, blurred AS v, 1.0::DOUBLE AS m FROM {name} WHERE blurred IS NOT NULL), {smooth_sql('sy', 'sx', ('v', 'm'), 2.0, 1.5, key='view')} SELECT p.view//100 AS case_id, p.view % 100 AS sat, p.i::INT AS i, p.j::INT AS j, {_out(hp='p.v - sy.v/sy.m')} FROM sx p JOIN sy ON sy.view = p.view AND sy.i = p.i AND sy.j = p.j"


@query("g11_condition", _sharpened(_BLURRED, "bl"))
def _(v, spark):
    fields, sizes, feet = _scenes(v, spark)
    return cd.condition(fields, "psf_iso", sizes, feet)


@query("g11_condition_minmtf", _sharpened(_FILTERED, "fl"))
def _(v, spark):
    fields, sizes, feet = _scenes(v, spark)
    return cd.condition(fields, "psf_minmtf", sizes, feet)


_OBS = (
    f"{_HP}, hpv AS (SELECT img, i, j, hp AS v FROM hp), {smooth_sql('gn', 'hpv', ('v',), 1.5, 1.5, orders=(1, 0))}, {smooth_sql('ge', 'hpv', ('v',), 1.5, 1.5, orders=(0, 1))}, "
    "gr AS (SELECT a.img, a.i, a.j, (b.v/1.8)*(b.v/1.8) AS jee, (a.v/2.0)*(a.v/2.0) AS jnn, (a.v/2.0)*(b.v/1.8) AS jen FROM gn a JOIN ge b ON a.img = b.img AND a.i = b.i AND a.j = b.j), "
    f"{smooth_sql('js', 'gr', ('jee', 'jnn', 'jen'), 11 / 4, 9 / 4)}, co AS (SELECT *, sqrt((jee - jnn)*(jee - jnn) + 4*jen*jen)/nullif(jee + jnn, 0) AS coh, 0.5*atan2(2*jen, jee - jnn) AS phi FROM js), "
    "c2 AS (SELECT *, pow(cos(phi - (pi()/2 - radians(70.0))), 2) AS c2 FROM co)"
)


def _observed(v):
    return cd.observability(v("fx_pixels").withColumnRenamed("btd", "v"), _N, _N, _PX, (2.0, 1.5), (11.0, 9.0), F.lit(1.6), F.lit(70.0), BY)


@query("g19_observability", f"{_OBS} SELECT h.img, h.i::INT AS i, h.j::INT AS j, round(coh, 5) + 0.0 AS coherence, round(1.6*sqrt(greatest(0, coh*c2 + (1 - coh)*0.5)), 5) + 0.0 AS s_eff FROM hp h JOIN c2 ON c2.img = h.img AND c2.i = h.i AND c2.j = h.j", exact=True)
def _(v, spark):
    return _observed(v).select("img", "i", "j", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("coherence", "s_eff")])


@query(
    "g20_case_observability",
    f"{cte('fx_cube')}, t AS (SELECT img, i, j, amp, max(r) AS r FROM fx_cube GROUP BY img, i, j, amp), h AS (SELECT img, CASE WHEN r > 0.9 THEN 8.0 + r*4 END AS height, amp*3 AS s FROM t) "
    f"SELECT concat('case_', img::VARCHAR) AS case_id, {_out(s_eff_h_ref='coalesce(median(height), 11.0)', s_eff_median='median(s) FILTER (height IS NOT NULL)')} FROM h GROUP BY img",
)
def _(v, spark):
    t = v("fx_cube").groupBy("img", "i", "j", "amp").agg(F.max("r").alias("r")).withColumn("case_id", F.concat(F.lit("case_"), F.col("img").cast("string")))
    heights = t.select("case_id", "i", "j", F.when(F.col("r") > 0.9, 8.0 + F.col("r") * 4).alias("height"))
    return cd.case_observability(heights, t.select("case_id", "i", "j", (F.col("amp") * 3).alias("s_eff")))


@query(
    "g22_match_curve",
    f"{cte('fx_cube')}, p AS (SELECT *, ((i*i*17 + j*29 + h_idx*h_idx*101 + img) % 100)/100.0::DOUBLE AS b FROM fx_cube WHERE i BETWEEN 5 AND 9), c AS (SELECT img, h_idx, CASE WHEN count(*) > 20 THEN corr(r, b) END AS r FROM p WHERE r IS NOT NULL AND b IS NOT NULL GROUP BY img, h_idx), "
    "t AS (SELECT *, lag(r) OVER w AS lo, lead(r) OVER w AS hi, row_number() OVER (PARTITION BY img ORDER BY r DESC NULLS LAST, h_idx) AS k FROM c WINDOW w AS (PARTITION BY img ORDER BY h_idx)) "
    f"SELECT img, h_idx, {_out(height='8.0 + (h_idx + CASE WHEN h_idx > 0 AND h_idx < 32 AND lo - 2*r + hi < 0 THEN greatest(-1.0, least(1.0, 0.5*(lo - hi)/(lo - 2*r + hi))) ELSE 0 END)*0.25', r='r')} FROM t WHERE k = 1",
)
def _(v, spark):
    other = (F.col("i") * F.col("i") * 17 + F.col("j") * 29 + F.col("h_idx") * F.col("h_idx") * 101 + F.col("img")) % 100 / 100
    x = v("fx_cube").withColumn("b", other).withColumnRenamed("r", "a")
    return st.curve_peak(st.match_curve(x, F.col("i").between(5, 9), by=BY), by=BY)


_POINTS = "p AS (SELECT img, i*40 + j AS pid, i + 0.5 AS fi, j + 0.25 AS fj FROM fx_pixels), off AS (SELECT * FROM (VALUES (-2), (-1), (0), (1), (2)) x(d))"


def _patch_sql(ci: str, cj: str) -> str:
    return (
        f"{cte('fx_pixels')}, {_POINTS}, c AS (SELECT img, pid, {ci} AS ci, {cj} AS cj FROM p) SELECT c.img, pid, {_out(h='median(btd)', r='median(btd*2)', s_eff='max(btd*3) FILTER (a.d = 0 AND b.d = 0)')} "
        "FROM c CROSS JOIN off a CROSS JOIN off b LEFT JOIN fx_pixels x ON x.img = c.img AND x.i = c.ci + a.d AND x.j = c.cj + b.d GROUP BY c.img, pid"
    )


def _patch_inputs(v):
    pixels = v("fx_pixels")
    points = pixels.select("img", (F.col("i") * 40 + F.col("j")).alias("pid"), (F.col("i") + 0.5).alias("fi"), (F.col("j") + 0.25).alias("fj"))
    return points, pixels.select("img", "i", "j", F.col("btd").alias("height"), (F.col("btd") * 2).alias("r"), (F.col("btd") * 3).alias("s_eff"))


@query("t4_sample_patch", _patch_sql("round_even(fi, 0)::BIGINT", "round_even(fj, 0)::BIGINT"))
def _(v, spark):
    return st.sample_patch(*_patch_inputs(v), by=BY)


@query("t5_sample_patch_legacy", _patch_sql("greatest(2, least(37, ceil(fi)))::BIGINT", "greatest(2, least(37, ceil(fj)))::BIGINT"))
def _(v, spark):
    return st.sample_patch(*_patch_inputs(v), by=BY, legacy=True, n_i=_N, n_j=_N)


@query("p3_with_btd", f"{cte('fx_channels')} SELECT scan_id::INT AS scan_id, i, j, {_out(btd='max(cmi) FILTER (ch = 13) - max(cmi) FILTER (ch = 15)')} FROM fx_channels WHERE ch IN (13, 15) GROUP BY scan_id, i, j")
def _(v, spark):
    return times.with_btd(v("fx_channels"), 13, 15)


_WIDE = "w AS (SELECT scan_id, sat, i, j, max(cmi) FILTER (ch = 11) AS c11, max(cmi) FILTER (ch = 13) AS c13, max(cmi) FILTER (ch = 14) AS c14, max(cmi) FILTER (ch = 15) AS c15 FROM fx_channels GROUP BY scan_id, sat, i, j)"


@query(
    "p17_channel_composite",
    f"{cte('fx_channels')}, {_WIDE}, t AS (SELECT *, least(1, greatest(0, (c15 - c13 + 4.0)/6.0)) AS r, least(1, greatest(0, (c14 - c11 + 4.0)/9.0)) AS g, least(1, greatest(0, (c13 - 243.0)/60.0)) AS b, c11 IS NOT NULL AND c13 IS NOT NULL AND c14 IS NOT NULL AND c15 IS NOT NULL AS ok FROM w) "
    f"SELECT scan_id::INT AS scan_id, i, j, {_out(red='CASE WHEN ok THEN r ELSE 1 END', green='CASE WHEN ok THEN g ELSE 1 END', blue='CASE WHEN ok THEN b ELSE 1 END')} FROM t",
)
def _(v, spark):
    return cd.channel_composite(v("fx_channels"))


@query(
    "n7_channel_differences",
    f"{cte('fx_channels')}, {_WIDE}, src AS (SELECT concat(scan_id::VARCHAR, '/', pair) AS key, scan_id, sat, pair, i, j, v, 1.0::DOUBLE AS m FROM (SELECT scan_id, sat, i, j, '13-15' AS pair, c13 - c15 AS v FROM w UNION ALL SELECT scan_id, sat, i, j, '14-15', c14 - c15 FROM w UNION ALL SELECT scan_id, sat, i, j, '11-14', c11 - c14 FROM w) WHERE v IS NOT NULL), "
    f"{smooth_sql('sm', 'src', ('v', 'm'), 2.0, 1.5, key='key')} SELECT scan_id::INT AS scan_id, sat, pair, p.i::INT AS i, p.j::INT AS j, {_out(v='p.v', hp='p.v - sm.v/sm.m')} FROM src p JOIN sm ON sm.key = p.key AND sm.i = p.i AND sm.j = p.j",
)
def _(v, spark):
    return cd.channel_differences(v("fx_channels"), ((13, 15), (14, 15), (11, 14)), _N, _N, (2.0, 1.5))


@query(
    "v14_robust_limits",
    f"{cte('fx_pair')}, z AS (SELECT a AS z FROM fx_pair WHERE a IS NOT NULL UNION ALL SELECT b FROM fx_pair WHERE b IS NOT NULL) SELECT round(quantile_cont(abs(z - (SELECT median(z) FROM z)), 0.99), 6) AS \"limit\" FROM z",
)
def _(v, spark):
    return mt.robust_limits(v("fx_pair"))
