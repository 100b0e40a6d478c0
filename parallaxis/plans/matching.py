"""Queries from pixel times and positions to heights, and comparisons built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import cases as cs, compare as cp, conditioning as cd, explore as ex, geometry as geo, matching as mc, metrics as mt, retrieve as rt, timing as tm, truth as tr
from ..sources.tables import read_run, scratch
from .fixtures import cte
from .registry import _GRID, _JOINED, _L, _PAIRS, _WEIGHTS, _WIND, _contrails, _metric_sql, _out, _paired_contrails, _pairs, query

_A, _B, _W, _H = "6378137.0", "6356752.31414", "6356752.314245", "42164160.0"
_E2 = f"(1 - pow({_W}/{_A}, 2))"


def seen_sql(name: str, source: str, h: str, sat: float, lat: str = "lat", lon: str = "lon") -> str:
    """CTEs that add alat and alon: where a satellite sees a point at height ``h`` (km)."""
    n = f"({_A}/sqrt(1 - {_E2}*sin(radians({lat}))*sin(radians({lat}))))"
    return f"""{name}_a AS (SELECT *, ({n} + 1000*({h}))*cos(radians({lat}))*cos(radians({lon})) AS px, ({n} + 1000*({h}))*cos(radians({lat}))*sin(radians({lon})) AS py, ({n}*(1 - {_E2}) + 1000*({h}))*sin(radians({lat})) AS pz FROM {source}),
 {name}_b AS (SELECT *, {_H}*cos(radians({sat})) AS sx, {_H}*sin(radians({sat})) AS sy FROM {name}_a), {name}_c AS (SELECT *, px - sx AS vx, py - sy AS vy, pz AS vz FROM {name}_b),
 {name}_d AS (SELECT *, (vx*vx + vy*vy)/pow({_A}, 2) + vz*vz/pow({_B}, 2) AS qa, 2*(sx*vx + sy*vy)/pow({_A}, 2) AS qb, pow({_H}/{_A}, 2) - 1 AS qc FROM {name}_c),
 {name}_e AS (SELECT *, CASE WHEN qb*qb - 4*qa*qc >= 0 THEN (-qb - sqrt(abs(qb*qb - 4*qa*qc)))/(2*qa) END AS tt FROM {name}_d),
 {name} AS (SELECT * EXCLUDE (px, py, pz, sx, sy, vx, vy, vz, qa, qb, qc, tt), degrees(atan2(tt*vz, pow({_B}/{_A}, 2)*sqrt((sx + tt*vx)*(sx + tt*vx) + (sy + tt*vy)*(sy + tt*vy)))) AS alat, degrees(atan2(sy + tt*vy, sx + tt*vx)) AS alon FROM {name}_e)"""


def forward_sql(name: str, source: str, sat: float, lat: str = "alat", lon: str = "alon") -> str:
    """CTEs that add x_rad and y_rad."""
    return f"""{name}_a AS (SELECT *, atan(pow({_B}/{_A}, 2)*tan(radians({lat}))) AS fp, radians({lon} - ({sat})) AS fd FROM {source}), {name}_b AS (SELECT *, {_B}/sqrt(1 - (1 - pow({_B}/{_A}, 2))*cos(fp)*cos(fp)) AS rc FROM {name}_a),
 {name}_c AS (SELECT *, {_H} - rc*cos(fp)*cos(fd) AS sx, -rc*cos(fp)*sin(fd) AS sy, rc*sin(fp) AS sz FROM {name}_b), {name}_d AS (SELECT *, {_H}*({_H} - sx) >= sy*sy + pow({_A}/{_B}, 2)*sz*sz AS seen FROM {name}_c),
 {name} AS (SELECT * EXCLUDE (fp, fd, rc, sx, sy, sz, seen), CASE WHEN seen THEN asin(-sy/sqrt(sx*sx + sy*sy + sz*sz)) END AS x_rad, CASE WHEN seen THEN atan(sz/sx) END AS y_rad FROM {name}_d)"""


def _geodetic(x: str, y: str, z: str) -> tuple[str, str]:
    th = f"atan2(({z})*{_A}, sqrt(({x})*({x}) + ({y})*({y}))*{_W})"
    lat = f"atan2(({z}) + {_E2}/(1 - {_E2})*{_W}*pow(sin({th}), 3), sqrt(({x})*({x}) + ({y})*({y})) - {_E2}*{_A}*pow(cos({th}), 3))"
    return lat, "sqrt(qx*qx + qy*qy)*cos(gl) + qz*sin(gl) - {a}/sqrt(1 - {e}*sin(gl)*sin(gl))*(1 - {e}*sin(gl)*sin(gl))".format(a=_A, e=_E2)


def true_sql(name: str, source: str, h: str, sat: float) -> str:
    """CTEs that add tlat and tlon: six Newton steps along the ray through (alat, alon)."""
    n = f"({_A}/sqrt(1 - {_E2}*sin(radians(alat))*sin(radians(alat))))"
    out = [
        f"{name}_s AS (SELECT *, {_H}*cos(radians({sat})) AS sx, {_H}*sin(radians({sat})) AS sy, {n}*cos(radians(alat))*cos(radians(alon)) - {_H}*cos(radians({sat})) AS dx, {n}*cos(radians(alat))*sin(radians(alon)) - {_H}*sin(radians({sat})) AS dy, {n}*(1 - {_E2})*sin(radians(alat)) AS dz, 1000*({h}) AS hm FROM {source})",
        f"{name}_0 AS (SELECT *, 1 + hm/(dx*cos(radians(alat))*cos(radians(alon)) + dy*cos(radians(alat))*sin(radians(alon)) + dz*sin(radians(alat))) AS tt FROM {name}_s)",
    ]
    lat, height = _geodetic("qx", "qy", "qz")
    for k in range(7):
        out.append(f"{name}_q{k} AS MATERIALIZED (SELECT *, sx + tt*dx AS qx, sy + tt*dy AS qy, tt*dz AS qz FROM {name}_{k}), {name}_l{k} AS MATERIALIZED (SELECT *, {lat} AS gl FROM {name}_q{k})")
        if k < 6:
            out.append(f"{name}_{k + 1} AS MATERIALIZED (SELECT * EXCLUDE (tt, qx, qy, qz, gl), tt - ({height} - hm)/(cos(gl)*(dx*qx + dy*qy)/sqrt(qx*qx + qy*qy) + sin(gl)*dz) AS tt FROM {name}_l{k})")
    out.append(f"{name} AS (SELECT * EXCLUDE (sx, sy, dx, dy, dz, hm, tt, qx, qy, qz, gl), degrees(gl) AS tlat, degrees(atan2(qy, qx)) AS tlon FROM {name}_l6)")
    return ", ".join(out)


_SEEN = f"{cte('fx_truth')}, {seen_sql('sn', 'fx_truth', 'top_km', -75.2)}"


@query("p6_true_position", f"{_SEEN}, {true_sql('tp', 'sn', 'top_km + 1.5', -75.2)} SELECT case_id, pid, {_out(tlat='tlat', tlon='tlon')} FROM tp")
def _(v, spark):
    x = geo.apparent_position(v("fx_truth"), F.col("top_km"), geo.SAT_LON[16])
    return geo.true_position(x, F.col("top_km") + 1.5, geo.SAT_LON[16]).select("case_id", "pid", "tlat", "tlon")


_FOOT = (
    f"{_L}, a AS (SELECT *, {_A}/sqrt(1 - {_E2}*sin(radians(lat))*sin(radians(lat))) AS nn, radians(lat) AS p, radians(lon) AS l FROM fx_lattice), b AS (SELECT *, {_H}*cos(radians(-75.2)) - nn*cos(p)*cos(l) AS dx, {_H}*sin(radians(-75.2)) - nn*cos(p)*sin(l) AS dy, -nn*(1 - {_E2})*sin(p) AS dz FROM a), "
    "c AS (SELECT *, sqrt(dx*dx + dy*dy + dz*dz) AS d, dx*cos(p)*cos(l) + dy*cos(p)*sin(l) + dz*sin(p) AS up, -dx*sin(p)*cos(l) - dy*sin(p)*sin(l) + dz*cos(p) AS no, -dx*sin(l) + dy*cos(l) AS ea FROM b), "
    "e AS (SELECT pid, acos(greatest(-1.0, least(1.0, up/d))) AS za, atan2(ea, no) AS az, 56e-6*d/1000 AS ac FROM c), f AS (SELECT *, ac/cos(za) AS al, pow(0.45*ac/cos(za), 2) + pow(0.6*tan(za), 2)/12 AS a2, pow(0.45*ac, 2) AS c2 FROM e WHERE degrees(za) <= 85)"
)


@query("p18_view_footprint", f"{_FOOT} SELECT pid, {_out(gsd_across_km='ac', gsd_along_km='al', cnn='a2*cos(az)*cos(az) + c2*sin(az)*sin(az)', cne='(a2 - c2)*cos(az)*sin(az)', cee='a2*sin(az)*sin(az) + c2*cos(az)*cos(az)')} FROM f")
def _(v, spark):
    return geo.view_footprint(v("fx_lattice"), geo.SAT_LON[16], dz_km=0.6).select("pid", "gsd_across_km", "gsd_along_km", "cnn", "cne", "cee")


_OFFSETS = ", ".join(f"({c}, {s}::DOUBLE)" for c, s in tm.BAND_OFFSET_S.items())


@query("p14_band_shift", f"{cte('fx_scans')}, o AS (SELECT * FROM (VALUES {_OFFSETS}) o(ch, s)), c AS (SELECT scan_id, 1 + scan_id % 16 AS a, 1 + scan_id % 7 AS b FROM fx_scans) SELECT scan_id, {_out(shift_s='(x.s + y.s)/2 + 0.055')} FROM c JOIN o x ON x.ch = a JOIN o y ON y.ch = b")
def _(v, spark):
    x = v("fx_scans").select("scan_id", F.array((1 + F.col("scan_id") % 16).cast("int"), (1 + F.col("scan_id") % 7).cast("int")).alias("channels"))
    return tm.with_band_shift(x, "channels").select("scan_id", "shift_s")


_SCAN_ROWS = "sc AS (SELECT scan_id, 16 + scan_id % 4 AS sat, CASE scan_id % 3 WHEN 0 THEN 6 WHEN 1 THEN 3 ELSE 4 END AS mode, domain, t AS w0, t + (60 + 5*(scan_id % 200))*INTERVAL 1 SECOND AS w1 FROM fx_scans)"
_LUT = (
    f"{cte('fx_scans', 'fx_lut')}, {_SCAN_ROWS}, spn AS (SELECT tbl, var, max(sec)::DOUBLE - min(sec)::DOUBLE AS span_s FROM fx_lut GROUP BY tbl, var), nc AS (SELECT tbl, count(*) FILTER (starts_with(var, 'CONUS')) AS n FROM spn GROUP BY tbl), "
    f"""pick AS (SELECT *, CASE WHEN mode = 6 AND domain = 'C' THEN CASE WHEN sat IN (16, 19) THEN '{tm.M6_EAST}' ELSE '{tm.M6_WEST}' END WHEN mode = 6 AND sat = 16 THEN CASE WHEN w0 < TIMESTAMP '{tm.M6_EAST_START}' THEN '{tm.M6_EAST_BEFORE}' ELSE '{tm.M6_EAST}' END
  WHEN mode = 6 AND sat = 17 THEN '{tm.M6_WEST}' WHEN mode = 3 THEN '{tm.M3}' WHEN mode = 4 THEN '{tm.M4}' END AS tbl, mode = 3 AND domain = 'F' AND sat IN (17, 18) AS win FROM sc),
 v1 AS (SELECT p.*, n, CASE WHEN domain = 'F' OR n = 0 THEN 'FD' ELSE 'CONUS' || ((minute(w0) % greatest(5*n, 1)) // 5 + 1)::VARCHAR END AS var, domain = 'C' AND n = 0 AS cut FROM pick p JOIN nc ON nc.tbl = p.tbl),
 v2 AS (SELECT v1.*, span_s, abs((epoch_us(w1) - epoch_us(w0))/1e6 - span_s) <= 10 AS fits FROM v1 JOIN spn ON spn.tbl = v1.tbl AND spn.var = v1.var)"""
)


def _scans(v) -> DataFrame:
    k = F.col("scan_id") % 3
    return v("fx_scans").select(
        "scan_id", (16 + F.col("scan_id") % 4).cast("int").alias("sat"), F.when(k == 0, 6).when(k == 1, 3).otherwise(4).alias("mode"), "domain", F.col("t").alias("w0"),
        (F.col("t") + F.expr("make_dt_interval(0, 0, 0, cast(60 + 5*(scan_id % 200) as decimal(18,6)))")).alias("w1"),
    )


def _lut(v) -> DataFrame:
    return v("fx_lut").withColumnsRenamed({"r0": "row", "c0": "col"})


@query("j4_lut_for_scan", f"{_LUT} SELECT scan_id, tbl, var, cut, {_out(span_s='span_s')}, fits FROM v2 WHERE NOT win OR fits")
def _(v, spark):
    return tm.lut_for_scan(_scans(v), tm.table_spans(_lut(v)))


_CROP = f"{cte('fx_scans', 'fx_lut')}, s AS (SELECT scan_id, '{tm.M4}' AS tbl, (scan_id % 30) - 2 AS c0, (scan_id % 23) AS r0, 8 AS ny, 6 AS nx, scan_id % 9 > 0 AS ok FROM fx_scans WHERE scan_id % 40 < 3), fit AS (SELECT * FROM s WHERE ok AND c0 >= 0 AND c0 + nx <= 40 AND r0 + ny <= 40), cr AS (SELECT s.scan_id, l.r0 - s.r0 AS rw, l.c0 - s.c0 AS cl, sec FROM fx_lut l JOIN fit s ON s.tbl = l.tbl AND l.r0 >= s.r0 AND l.r0 < s.r0 + ny AND l.c0 >= s.c0 AND l.c0 < s.c0 + nx)"


def _lut_and_scans(v) -> tuple[DataFrame, DataFrame]:
    k = F.col("scan_id")
    dx = 5.6e-5
    miss = F.when(k % 9 == 0, 0.3).otherwise(0.01)  # a third of a pixel off is not aligned, a hundredth is
    s = v("fx_scans").where("scan_id % 40 < 3").select("scan_id", F.lit(tm.M4).alias("tbl"), ((k % 30 - 2 + miss - 19.5) * dx).alias("x0"), F.lit(dx).alias("dx"), F.lit(6).alias("nx"), ((k % 23 - 19.5) * -dx).alias("y0"), F.lit(-dx).alias("dy"), F.lit(8).alias("ny"))
    return _lut(v), s


def _cropped(v) -> DataFrame:
    return tm.crop_lut_to_product(*_lut_and_scans(v), 40, 40)


@query("j5_crop_lut_to_product", f"{_CROP} SELECT scan_id, rw::INT AS \"row\", cl::INT AS col, round(sec::DOUBLE, 6) + 0.0 AS sec FROM cr")
def _(v, spark):
    return _cropped(v).withColumn("sec", F.col("sec").cast("double"))


@query("j6_pixel_times", f"{_CROP}, q AS (SELECT scan_id, scan_id*10 + d AS pid, d*1.25 - 1 AS fr, d*0.75 AS fc FROM fit, (SELECT unnest(range(10)) AS d)) SELECT q.scan_id, pid, {_out(sec='sec::DOUBLE + 0.4 - 2.5')} FROM q LEFT JOIN cr ON cr.scan_id = q.scan_id AND rw = round_even(fr, 0) AND cl = round_even(fc, 0)")
def _(v, spark):
    lut = _cropped(v)
    points = lut.select("scan_id").distinct().withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(9))))
    points = points.select("scan_id", (F.col("scan_id") * 10 + F.col("d")).alias("pid"), (F.col("d") * 1.25 - 1).alias("frow"), (F.col("d") * 0.75).alias("fcol"))
    return tm.pixel_times(points, lut, 0.4, 2.5).select("scan_id", "pid", "sec")


@query("j6_product_times", f"{_CROP}, q AS (SELECT scan_id, scan_id*10 + d AS pid, d*1.25 - 1 AS fr, d*0.75 AS fc FROM fit, (SELECT unnest(range(10)) AS d)) SELECT q.scan_id, pid, {_out(sec='sec::DOUBLE + 0.4 - 2.5')} FROM q LEFT JOIN cr ON cr.scan_id = q.scan_id AND rw = round_even(fr, 0) AND cl = round_even(fc, 0)")
def _(v, spark):
    """As j6_pixel_times, without cutting a table."""
    lut, scans = _lut_and_scans(v)
    points = _cropped(v).select("scan_id").distinct().withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(9))))
    points = points.select("scan_id", (F.col("scan_id") * 10 + F.col("d")).alias("pid"), (F.col("d") * 1.25 - 1).alias("frow"), (F.col("d") * 0.75).alias("fcol"))
    return tm.product_pixel_times(points, lut, scans, 40, 40, 0.4, 2.5).select("scan_id", "pid", "sec")


_ANCHOR = "an AS (SELECT case_id, min(time) AS time, min(lat) AS la, min(lon) AS lo FROM fx_truth GROUP BY case_id)"


@query(
    "j7_wind_profile_at",
    f"{cte('fx_truth', 'fx_fields')}, {_ANCHOR}, w AS (SELECT a.case_id, f.level, (1 - abs(epoch_us(f.time) - epoch_us(a.time))/3.6e9)*(1 - abs(f.lat - la)/0.25)*(1 - abs(f.lon - lo)/0.25) AS w, f.u, f.v, f.z FROM an a JOIN fx_fields f ON abs(epoch_us(f.time) - epoch_us(a.time)) < 3600000000 AND abs(f.lat - la) < 0.25 AND abs(f.lon - lo) < 0.25) "
    f"SELECT case_id, level AS lvl, {_out(h='sum(w*z)/9.80665/1000', u='sum(w*u)', v='sum(w*v)')} FROM w GROUP BY case_id, level HAVING sum(w) > 1 - 1e-9",
)
def _(v, spark):
    cases = v("fx_truth").groupBy("case_id").agg(F.min("time").alias("time"), F.min("lat").alias("anchor_lat"), F.min("lon").alias("anchor_lon"))
    return tm.wind_profile_at(cases, v("fx_fields"))


_BOXES = "bx AS (SELECT case_id, hash_k AS scan_id, min(lat) AS lat0, max(lat) AS lat1, min(lon) AS lon0, max(lon) AS lon1 FROM (SELECT *, pid % 2 AS hash_k FROM fx_truth WHERE pid % 3 = 0) GROUP BY case_id, hash_k)"
_PIX = "px2 AS (SELECT img::BIGINT AS scan_id, i, j, -0.11 + 0.006*j AS x_rad, 0.03 + 0.003*i AS y_rad FROM fx_pixels)"


@query(
    "j9_crop_to_case",
    f"{cte('fx_truth', 'fx_pixels')}, {_BOXES}, {_PIX}, lt AS (SELECT case_id, scan_id, lat0 + (lat1 - lat0)*p/8 AS lat, lon0 + (lon1 - lon0)*q/8 AS lon, h FROM bx, (SELECT unnest(range(9)) AS p), (SELECT unnest(range(9)) AS q), (VALUES (8.0::DOUBLE), (16.0)) hh(h)), {seen_sql('sn', 'lt', 'h', -75.2)}, {forward_sql('fw', 'sn', -75.2)}, "
    "ft AS (SELECT case_id, scan_id, min(x_rad) - 60/37000.0 AS a, max(x_rad) + 60/37000.0 AS b, min(y_rad) - 60/37000.0 AS c, max(y_rad) + 60/37000.0 AS d FROM fw GROUP BY case_id, scan_id) SELECT case_id, f.scan_id, i, j FROM ft f JOIN px2 p ON p.scan_id = f.scan_id AND x_rad BETWEEN a AND b AND y_rad BETWEEN c AND d",
)
def _(v, spark):
    boxes = v("fx_truth").where("pid % 3 = 0").groupBy("case_id", (F.col("pid") % 2).alias("scan_id")).agg(F.min("lat").alias("lat0"), F.max("lat").alias("lat1"), F.min("lon").alias("lon0"), F.max("lon").alias("lon1"))
    pixels = v("fx_pixels").select(F.col("img").cast("long").alias("scan_id"), "i", "j", (-0.11 + 0.006 * F.col("j")).alias("x_rad"), (0.03 + 0.003 * F.col("i")).alias("y_rad"))
    return mc.crop_to_case(pixels, boxes, 16).select("case_id", "scan_id", "i", "j")


@query(
    "j10_place_on_grid",
    f"{cte('fx_truth', 'fx_winds')}, nat AS (SELECT case_id, pid, lat AS alat, lon AS alon, top_km FROM fx_truth WHERE pid % 2 = 0), {true_sql('tp', 'nat', 'top_km', -75.2)}, nt AS (SELECT case_id, pid, tlat AS lat, tlon AS lon, top_km FROM tp), {_WIND.lstrip(', ').replace('fx_truth t', 'nt t')}, "
    "mv AS (SELECT case_id, pid, top_km, lat - v*45.0/111000.0 AS lat, lon - u*45.0/(111000.0*cos(radians(lat))) AS lon FROM aw), gr AS (SELECT case_id, pid, lat, lon FROM fx_truth WHERE pid % 2 = 1), ce AS (SELECT case_id, (min(lat) + max(lat))/2 AS clat FROM gr GROUP BY case_id), "
    "nr AS (SELECT g.case_id, g.pid AS i, m.pid AS m, m.top_km, sqrt(pow((g.lon - m.lon)*111.0*cos(radians(clat)), 2) + pow((g.lat - m.lat)*111.0, 2)) AS d FROM gr g JOIN ce c ON c.case_id = g.case_id JOIN mv m ON m.case_id = g.case_id), "
    f"be AS (SELECT case_id, i, arg_min(top_km, d) AS height FROM nr WHERE d < 12 GROUP BY case_id, i) SELECT g.case_id, g.pid AS i, {_out(height='height')} FROM gr g LEFT JOIN be b ON b.case_id = g.case_id AND b.i = g.pid",
)
def _(v, spark):
    t = v("fx_truth")
    native = t.where("pid % 2 = 0").select("case_id", F.col("pid").alias("row"), F.lit(0).alias("col"), F.col("lat").alias("alat"), F.col("lon").alias("alon"), F.col("top_km").alias("height"), F.lit(0.9).alias("r"), F.lit(0.5).alias("amp"), F.lit(45.0).alias("t_s"))
    grid = t.where("pid % 2 = 1").select("case_id", F.col("pid").alias("i"), F.lit(0).alias("j"), "lat", "lon")
    return mc.place_on_grid(native, grid, 16, 12.0, v("fx_winds")).select("case_id", "i", "height")


_AXES = {"x0": -0.12, "dx": 5.6e-5, "y0": 0.12, "dy": -5.6e-5}
_ROWCOL = f"(y_rad - {_AXES['y0']})/({_AXES['dy']}) AS fr, (x_rad - ({_AXES['x0']}))/({_AXES['dx']}) AS fc"


def _axes(t: DataFrame, dt0: float) -> DataFrame:
    return t.select("case_id").distinct().select("case_id", *[F.lit(v).alias(k) for k, v in _AXES.items()], F.lit(dt0).alias("dt0_s"))


def _moved(name: str, source: str, dt: str) -> str:
    return f"{name} AS (SELECT *, lat + v*({dt})/111000.0 AS lat1, lon + u*({dt})/(111000.0*cos(radians(lat))) AS lon1 FROM {source})"


@query(
    "g4_project_view",
    f"{cte('fx_truth', 'fx_winds')}{_WIND}, {seen_sql('s0', 'aw', 'top_km', -137.2)}, {forward_sql('f0', 's0', -137.2)}, r0 AS (SELECT * EXCLUDE (alat, alon, x_rad, y_rad), round_even({_ROWCOL.split(' AS fr, ')[0]}, 0) AS a, round_even({_ROWCOL.split(' AS fr, ')[1].removesuffix(' AS fc')}, 0) AS b FROM f0), "
    f"{_moved('m1', 'r0', '40.0 + coalesce(CASE WHEN a % 50 < 45 THEN a*0.01 + b*0.002 END, 0)')}, {seen_sql('s1', 'm1', 'top_km', -137.2, 'lat1', 'lon1')}, {forward_sql('f1', 's1', -137.2)}, r1 AS (SELECT * EXCLUDE (alat, alon, x_rad, y_rad, a, b, lat1, lon1), round_even({_ROWCOL.split(' AS fr, ')[0]}, 0) AS a, round_even({_ROWCOL.split(' AS fr, ')[1].removesuffix(' AS fc')}, 0) AS b FROM f1), "
    f"{_moved('m2', 'r1', '40.0 + coalesce(CASE WHEN a % 50 < 45 THEN a*0.01 + b*0.002 END, 0)')}, {seen_sql('s2', 'm2', 'top_km', -137.2, 'lat1', 'lon1')}, {forward_sql('f2', 's2', -137.2)} "
    f"SELECT case_id, pid, round({_ROWCOL.split(' AS fr, ')[0]}, 4) + 0.0 AS frow, round({_ROWCOL.split(' AS fr, ')[1].removesuffix(' AS fc')}, 4) + 0.0 AS fcol FROM f2",
    exact=True,
)
def _(v, spark):
    t = v("fx_truth")
    view = mc.View(17, t, _axes(t, 40.0), _times_around(t, v("fx_winds"), 40.0))
    out = mc.project_view(t.withColumn("h", F.col("top_km")), view, v("fx_winds"))
    return out.select("case_id", "pid", (F.round("frow", 4) + F.lit(0.0)).alias("frow"), (F.round("fcol", 4) + F.lit(0.0)).alias("fcol"))


def _times_around(t: DataFrame, winds: DataFrame, dt0: float) -> DataFrame:
    """Pixel times where the points can be seen: three pixels around the place seen without wind and at dt0; every fiftieth rows' rest has none."""
    still = mc.View(17, t, _axes(t, dt0))
    points = t.withColumn("h", F.col("top_km"))
    seen = mc.project_view(points, still).select("case_id", "frow", "fcol").unionByName(mc.project_view(points, still, winds).select("case_id", "frow", "fcol"))
    around = F.sequence(F.lit(-3), F.lit(3))
    x = seen.where("frow is not null").select("case_id", F.rint("frow").cast("int").alias("a"), F.rint("fcol").cast("int").alias("b"), F.explode(around).alias("p"))
    x = x.select("case_id", (F.col("a") + F.col("p")).alias("row"), "b", F.explode(around).alias("q")).select("case_id", "row", (F.col("b") + F.col("q")).alias("col")).distinct()
    return x.where("row % 50 < 45").withColumn("sec", F.col("row") * 0.01 + F.col("col") * 0.002)


@query(
    "g5_project_to_other",
    f"{cte('fx_truth', 'fx_winds')}{_WIND}, {_moved('m1', 'aw', '40.0 - (pid % 60)')}, {seen_sql('s1', 'm1', 'top_km', -137.2, 'lat1', 'lon1')}, {forward_sql('f1', 's1', -137.2)} "
    f"SELECT case_id, pid, round({_ROWCOL.split(' AS fr, ')[0]}, 4) + 0.0 AS frow, round({_ROWCOL.split(' AS fr, ')[1].removesuffix(' AS fc')}, 4) + 0.0 AS fcol FROM f1",
    exact=True,
)
def _(v, spark):
    t = v("fx_truth")
    x = t.withColumn("h", F.col("top_km")).withColumn("t_ref", (F.col("pid") % 60).cast("double"))
    out = mc.project_to_other(x, mc.View(17, t, _axes(t, 40.0)), v("fx_winds"))
    return out.select("case_id", "pid", (F.round("frow", 4) + F.lit(0.0)).alias("frow"), (F.round("fcol", 4) + F.lit(0.0)).alias("fcol"))


def _native(v) -> DataFrame:
    x = v("fx_pixels").select(F.concat(F.lit("case_"), F.col("img").cast("string")).alias("case_id"), F.col("i").cast("int").alias("row"), F.col("j").cast("int").alias("col"), "btd", (-0.02 + 5.6e-5 * F.col("j") + 0.01 * F.col("img")).alias("x_rad"), (0.09 - 5.6e-5 * F.col("i")).alias("y_rad"))
    return mc.native_positions(x, 16)


_INVERSE = f"""nx AS (SELECT img, i, j, -0.02 + 5.6e-5*j + 0.01*img AS x, 0.09 - 5.6e-5*i AS y FROM fx_pixels), ny AS (SELECT *, sin(x)*sin(x) + cos(x)*cos(x)*(cos(y)*cos(y) + pow({_A}/{_B}, 2)*sin(y)*sin(y)) AS qa, -2*{_H}*cos(x)*cos(y) AS qb, pow({_H}, 2) - pow({_A}, 2) AS qc FROM nx),
 nz AS (SELECT *, (-qb - sqrt(qb*qb - 4*qa*qc))/(2*qa) AS rs FROM ny), nv AS (SELECT img, i, j, degrees(atan(pow({_A}/{_B}, 2)*rs*cos(x)*sin(y)/sqrt(pow({_H} - rs*cos(x)*cos(y), 2) + pow(rs*sin(x), 2)))) AS alat, -75.2 - degrees(atan(-rs*sin(x)/({_H} - rs*cos(x)*cos(y)))) AS alon FROM nz)"""


_JACOBIAN = (
    f"{cte('fx_pixels')}, {_INVERSE}, mid AS (SELECT img AS k, min(i) + (max(i) - min(i) + 1)//2 AS ic, min(j) + (max(j) - min(j) + 1)//2 AS jc FROM fx_pixels GROUP BY img), nn AS (SELECT * FROM nv JOIN mid ON k = img WHERE abs(i - ic) <= 1 AND abs(j - jc) <= 1), {true_sql('tp', 'nn', '11.0', -75.2)}, "
    "pv AS (SELECT img, max(tlat) FILTER (i = ic + 1 AND j = jc) AS n2, max(tlat) FILTER (i = ic - 1 AND j = jc) AS n0, max(tlat) FILTER (i = ic AND j = jc + 1) AS nc2, max(tlat) FILTER (i = ic AND j = jc - 1) AS nc0, max(tlon) FILTER (i = ic + 1 AND j = jc) AS e2, max(tlon) FILTER (i = ic - 1 AND j = jc) AS e0, max(tlon) FILTER (i = ic AND j = jc + 1) AS ec2, max(tlon) FILTER (i = ic AND j = jc - 1) AS ec0, max(tlat) FILTER (i = ic AND j = jc) AS la FROM tp GROUP BY img), "
    "jj AS (SELECT img, (n2 - n0)/2*111.0 AS jnr, (nc2 - nc0)/2*111.0 AS jnc, (e2 - e0)/2*111.0*cos(radians(la)) AS jer, (ec2 - ec0)/2*111.0*cos(radians(la)) AS jec FROM pv), sp AS (SELECT *, sqrt(jnr*jnr + jer*jer) AS si, sqrt(jnc*jnc + jec*jec) AS sj, abs(jnr*jec - jnc*jer) AS det FROM jj), "
    "lw AS (SELECT *, greatest(floor((25.0/sqrt(det/(si*sj))/si - 1)/2)*2 + 1, 3) AS li, greatest(floor((25.0/sqrt(det/(si*sj))/sj - 1)/2)*2 + 1, 3) AS lj FROM sp), ch AS (SELECT *, li + a AS wi, lj + b AS wj, row_number() OVER (PARTITION BY img ORDER BY abs((li + a)*(lj + b)*det/625 - 1), abs(ln((li + a)*si/((lj + b)*sj)))) AS k FROM lw, (VALUES (0), (2)) x(a), (VALUES (0), (2)) y(b)) "
)


@query(
    "g6_native_jacobian",
    f"{_JACOBIAN} SELECT concat('case_', img::VARCHAR) AS case_id, {_out(jnr='jnr', jnc='jnc', jer='jer', jec='jec', si='si', sj='sj', sigma_i='8.0/si', sigma_j='8.0/sj', win_area_frac='wi*wj*det/625')}, wi::INT AS win_i, wj::INT AS win_j FROM ch WHERE k = 1",
)
def _(v, spark):
    return mc.native_filters(mc.native_jacobian(_native(v), 16))


@query(
    "q5_native_diagnostics",
    f"{_JACOBIAN} SELECT concat('case_', img::VARCHAR) AS case_id, ny::INT AS native_ny, nx::INT AS native_nx, wi::INT AS win_px_i, wj::INT AS win_px_j, {_out(win_area_frac='wi*wj*det/625', native_px_km_i='si', native_px_km_j='sj')} FROM ch JOIN (SELECT img AS m, max(i) - min(i) + 1 AS ny, max(j) - min(j) + 1 AS nx FROM fx_pixels GROUP BY img) ON m = img WHERE k = 1",
)
def _(v, spark):
    native = _native(v)
    return mc.native_diagnostics(native, mc.native_filters(mc.native_jacobian(native, 16)))


def _scene(v, spark):
    """Two cases of the pixel tables, each seen by two satellites at other times, with pixel times, winds, boxes and all trial heights."""
    px = v("fx_pixels").select(F.concat(F.lit("case_"), F.col("img").cast("string")).alias("case_id"), F.col("i").alias("row"), F.col("j").alias("col"), (F.col("btd") * 1000).alias("btd"))
    cases = px.select("case_id").distinct()
    axes = lambda sat, dt: geo.geos_forward(geo.apparent_position(cases.withColumn("lat", F.lit(36.0)).withColumn("lon", F.lit(-105.0)), 10.0, geo.SAT_LON[sat]), geo.SAT_LON[sat], "alat", "alon").select("case_id", (F.col("x_rad") - 20 * 5.6e-5).alias("x0"), F.lit(5.6e-5).alias("dx"), (F.col("y_rad") + 20 * 5.6e-5).alias("y0"), F.lit(-5.6e-5).alias("dy"), F.lit(dt).alias("dt0_s"))
    times = px.select("case_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), (F.col("row") * 0.4).alias("sec"))
    profile = mt.with_totals(v("fx_winds"), one=F.min("case_id")).where("case_id = one").select("h", "u", "v")
    winds = cases.crossJoin(F.broadcast(profile)).select("case_id", "h", "u", "v")
    heights = geo.height_candidates(spark.range(1)).select("h_idx", "h")
    return px, mc.View(16, px, axes(16, 0.0), times), mc.View(17, px, axes(17, 30.0), times), cases, heights, winds


def _grids(cases, spark):
    """Grids of 24 x 20 and 18 x 26 points with their own filters and windows, footprints at their centres."""
    sizes = spark.createDataFrame([("case_0", 24, 20, 2.0, 1.5, 7, 5, 2.0, 2.0), ("case_1", 18, 26, 1.5, 2.5, 5, 7, 2.0, 1.9)], "case_id string, n_i int, n_j int, sigma_i double, sigma_j double, win_i int, win_j int, px_i double, px_j double")
    grid = cases.join(sizes, "case_id").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_i") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n_j") - 1)))
    grid = grid.select("case_id", "i", "j", (35.8 + F.col("i") * 0.018).alias("lat"), (-105.25 + F.col("j") * 0.022).alias("lon"))
    return grid, sizes, cd.footprints(cases.select("case_id", F.lit(36.0).alias("lat"), F.lit(-105.0).alias("lon")))


def _snapshot(prep):
    def run(v, spark):
        px, ref, oth, cases, heights, winds = _scene(v, spark)
        grid, sizes, feet = _grids(cases, spark)
        return mc.match_snapshot(grid, heights, ref, oth, sizes, winds, prep, feet)[0]

    return run


# many steps whose SQL stands above, each with its own; the tests hold the chains against NumPy
query("g16_match_snapshot")(_snapshot("hp"))
query("g16_match_isotropic")(_snapshot("psf_iso"))
query("g16_match_minmtf")(_snapshot("psf_minmtf"))


def _native_scene(v, spark):
    """The scene's reference pixels, case_1 as a smaller crop, with the filters of their own Jacobians."""
    px, ref, oth, cases, heights, winds = _scene(v, spark)
    native = px.join(ref.axes, "case_id").select("case_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "btd", (F.col("x0") + F.col("col") * F.col("dx")).alias("x_rad"), (F.col("y0") + F.col("row") * F.col("dy")).alias("y_rad"), (F.col("row") * 0.4).alias("t_s"))
    native = mc.native_positions(native.where("case_id = 'case_0' or row < 32 and col < 36"), 16)
    filters = mc.native_filters(mc.native_jacobian(native, 16), hp_km=4.0, win_km=12.0)
    boxes = cases.select("case_id", F.lit(35.0).alias("lat0"), F.lit(37.0).alias("lat1"), F.lit(-106.0).alias("lon0"), F.lit(-104.0).alias("lon1"))
    return native, filters, mc.match_native(native, heights, ref, oth, boxes, mc.native_sizes(native, filters), winds, r_min=0.1, amp_min=0.0)


@query("g18_match_native")  # as g16
def _(v, spark):
    return _native_scene(v, spark)[2][0]


_PLACES = f"{_GRID}, lo AS (SELECT t.case_id, pid, t.lat, t.lon, top_km, (lat - lat0)*(n_lat - 1)/(lat1 - lat0) AS fi, (lon - lon0)*(n_lon - 1)/(lon1 - lon0) AS fj FROM fx_truth t JOIN g ON t.case_id = g.case_id)"


@query(
    "t6_attach_truth",
    f"{_PLACES}, mp AS (SELECT case_id, round_even(fi, 0)::BIGINT AS i, round_even(fj, 0)::BIGINT AS j, avg(top_km) AS height, max(pid % 10)/10.0 AS r, max(pid % 7)/2.0 AS s_eff FROM lo GROUP BY 1, 2, 3), c AS (SELECT case_id, pid, round_even(fi, 0)::BIGINT AS ci, round_even(fj, 0)::BIGINT AS cj FROM lo), off AS (SELECT * FROM (VALUES (-2), (-1), (0), (1), (2)) x(d)) "
    f"SELECT c.case_id, pid, {_out(h='median(height)', r='median(r)', s_eff='max(s_eff) FILTER (a.d = 0 AND b.d = 0)', h_raw='median(height)')} FROM c CROSS JOIN off a CROSS JOIN off b LEFT JOIN mp x ON x.case_id = c.case_id AND x.i = c.ci + a.d AND x.j = c.cj + b.d GROUP BY c.case_id, pid",
)
def _(v, spark):
    t = v("fx_truth")
    grids = geo.make_grid(cs.bbox_around(t))
    at = geo.locate(t, grids).select("case_id", F.rint("fi").cast("long").alias("i"), F.rint("fj").cast("long").alias("j"), "top_km", "pid")
    maps = at.groupBy("case_id", "i", "j").agg(F.avg("top_km").alias("height"), (F.max(F.col("pid") % 10) / 10).alias("r"), (F.max(F.col("pid") % 7) / 2).alias("s_eff"))
    return tr.attach_truth(t, maps, grids).select("case_id", "pid", "h", "r", "s_eff", "h_raw")


@query(
    "g1_grid_points",
    f"{_GRID}, few AS (SELECT * FROM g WHERE n_lat*n_lon <= (SELECT min(n_lat*n_lon) FROM g)) SELECT case_id, i, j, {_out(lat='lat0 + (lat1 - lat0)*i/(n_lat - 1)', lon='lon0 + (lon1 - lon0)*j/(n_lon - 1)')} FROM (SELECT *, unnest(range(n_lat))::INT AS i FROM few) a, LATERAL (SELECT unnest(range(a.n_lon))::INT AS j) b",
)
def _(v, spark):
    grids = geo.make_grid(cs.bbox_around(v("fx_truth")))
    small = mt.with_totals(grids, least=F.min(F.col("n_lat") * F.col("n_lon"))).where("n_lat * n_lon <= least")
    return geo.grid_points(small)


_PAIR_LONS = ", ".join(f"({k}, '{n}', {a}::DOUBLE, {b}::DOUBLE)" for k, (n, (a, b)) in enumerate(geo.PAIRS.items()))


@query(
    "g24_disparity_map",
    f"WITH ll AS (SELECT -72.0 + a AS lat, -180.0 + b AS lon FROM (SELECT unnest(range(153)) AS a), (SELECT unnest(range(241)) AS b)), pr AS (SELECT * FROM (VALUES {_PAIR_LONS}) p(n, pair, sa, sb)), "
    f"zz AS (SELECT ll.*, n, pair, acos(greatest(-1.0, least(1.0, (({_H}*cos(radians(sa)) - nn*cos(p)*cos(l))*cos(p)*cos(l) + ({_H}*sin(radians(sa)) - nn*cos(p)*sin(l))*cos(p)*sin(l) - nn*(1 - {_E2})*sin(p)*sin(p))/sqrt(pow({_H}*cos(radians(sa)) - nn*cos(p)*cos(l), 2) + pow({_H}*sin(radians(sa)) - nn*cos(p)*sin(l), 2) + pow(nn*(1 - {_E2})*sin(p), 2))))) AS za, "
    f"acos(greatest(-1.0, least(1.0, (({_H}*cos(radians(sb)) - nn*cos(p)*cos(l))*cos(p)*cos(l) + ({_H}*sin(radians(sb)) - nn*cos(p)*sin(l))*cos(p)*sin(l) - nn*(1 - {_E2})*sin(p)*sin(p))/sqrt(pow({_H}*cos(radians(sb)) - nn*cos(p)*cos(l), 2) + pow({_H}*sin(radians(sb)) - nn*cos(p)*sin(l), 2) + pow(nn*(1 - {_E2})*sin(p), 2))))) AS zb FROM (SELECT *, radians(lat) AS p, radians(lon) AS l, {_A}/sqrt(1 - {_E2}*sin(radians(lat))*sin(radians(lat))) AS nn FROM ll) ll, pr), "
    "bb AS (SELECT *, row_number() OVER (PARTITION BY lat, lon ORDER BY greatest(za, zb), n) AS k FROM zz WHERE degrees(greatest(za, zb)) <= 85) "
    f"SELECT lat::DOUBLE AS lat, lon::DOUBLE AS lon, pair, round(degrees(greatest(za, zb)), 5) + 0.0 AS vza_max, round(sqrt((1/pow(cos(za), 2) + 1/pow(cos(zb), 2))/2), 4) + 0.0 AS stretch FROM bb WHERE k = 1",
    exact=True,
)
def _(v, spark):
    # the lattice is the operator's own; the points of fx_lattice are measured by p19_footprint_stretch
    return geo.disparity_map(geo.lattice(spark)).select("lat", "lon", "pair", (F.round("vza_max", 5) + F.lit(0.0)).alias("vza_max"), (F.round("stretch", 4) + F.lit(0.0)).alias("stretch"))


# --- comparisons -----------------------------------------------------------------------------------

_CBOOT = 2000
_JW = f"""{_JOINED}{_WEIGHTS.format(source="joined")}, per AS (SELECT case_id, count(*) AS n, sum(err_a) AS s1a, sum(err_a*err_a) AS s2a, sum(err_b) AS s1b, sum(err_b*err_b) AS s2b FROM joined GROUP BY case_id),
 dr AS (SELECT p.*, b, w FROM per p JOIN weights USING (case_id) UNION ALL SELECT p.*, -1, 1 FROM per p), lg AS (SELECT b, w, n, 'A' AS side, s1a AS s1, s2a AS s2 FROM dr UNION ALL SELECT b, w, n, 'B', s1b, s2b FROM dr),
 cc AS (SELECT *, sum(w*s1) OVER g AS tot, sum(w*n) OVER g AS al FROM lg WINDOW g AS (PARTITION BY b, side)), cd AS (SELECT *, (tot - s1)/nullif(al - n, 0) AS c FROM cc),
 ms AS (SELECT b, side, sqrt(sum(w*s2)/any_value(al)) AS raw, sqrt(sum(w*(s2 - 2*c*s1 + n*c*c))/nullif(sum(w*n) FILTER (c IS NOT NULL), 0)) AS corr, abs(any_value(tot)/any_value(al)) AS bias FROM cd GROUP BY b, side),
 ln AS (SELECT b, side, 'rmse_raw' AS metric, raw AS value FROM ms UNION ALL SELECT b, side, 'rmse_corr', corr FROM ms UNION ALL SELECT b, side, '|bias|', bias FROM ms),
 wd AS (SELECT b, metric, max(value) FILTER (side = 'A') AS va, max(value) FILTER (side = 'B') AS vb FROM ln GROUP BY b, metric), ci AS (SELECT metric, quantile_cont(vb - va, 0.025) AS lo, quantile_cont(vb - va, 0.975) AS hi FROM wd WHERE b >= 0 GROUP BY metric)"""
_PAIRED = f"{_JW} SELECT metric, round(va, 6) + 0.0 AS \"A\", round(vb, 6) + 0.0 AS \"B\", {_out(delta='vb - va', lo='lo', hi='hi')}, CASE WHEN lo > 0 THEN 'worse' WHEN hi < 0 THEN 'better' ELSE '~' END AS call FROM wd JOIN ci USING (metric) WHERE b = -1"


@query("d9_paired_contrails", _PAIRED)
def _(v, spark):
    return cp.paired_contrails(_paired_contrails(v), _CBOOT)


@query("d11_headline_filter", f"{_PAIRS}, one AS (SELECT *, -1 AS b, 1 AS w FROM pairs), m AS ({_metric_sql('one')}) SELECT metric, round(va, 6) + 0.0 AS \"A\", round(vb, 6) + 0.0 AS \"B\", CASE WHEN starts_with(metric, 'yield') OR starts_with(metric, 'coverage') THEN 'fraction' ELSE 'km' END AS panel FROM m WHERE NOT starts_with(metric, 'bias')")
def _(v, spark):
    return cp.headline_filter(cp.metric_set(_pairs(v)).drop("draw"))


@query("n6_arms_report", f"{_PAIRED.replace('SELECT metric, round', 'SELECT ' + chr(39) + 'nominal' + chr(39) + ' AS a, ' + chr(39) + 'lut' + chr(39) + ' AS b, metric, round').replace('AS \"A\"', 'AS value_a').replace('AS \"B\"', 'AS value_b')}")
def _(v, spark):
    other = mt.contrail_table(v("fx_cases_b"), tr.contrail_ids(v("pb")))
    runs = {"nominal": (v("fx_cases_a"), v("pa"), _contrails(v)), "lut": (v("fx_cases_b"), v("pb"), other)}
    return cp.arms_report(runs, [("nominal", "lut")], _CBOOT)[1]


@query("n6_arms_flips", f"{_PAIRS} SELECT 'nominal' AS a, 'lut' AS b, qc_a, qc_b, count(*) AS n, qc_a <> qc_b AS changed FROM pairs GROUP BY qc_a, qc_b")
def _(v, spark):
    other = mt.contrail_table(v("fx_cases_b"), tr.contrail_ids(v("pb")))
    runs = {"nominal": (v("fx_cases_a"), v("pa"), _contrails(v)), "lut": (v("fx_cases_b"), v("pb"), other)}
    return cp.arms_report(runs, [("nominal", "lut")], _CBOOT)[2]


@query(
    "n9_ablation_table",
    f"{cte('pa', 'pb')}, u AS (SELECT 'nominal' AS time_model, 'raw' AS truth, case_id, h, r, top_km, 0.0::DOUBLE AS disp_km FROM pa UNION ALL SELECT 'lut', 'advected', case_id, h, r, top_km, (pid % 50)/10.0 FROM pb) "
    f"SELECT case_id, time_model, truth, count(e) AS n, {_out(bias='avg(e)', rmse='sqrt(avg(e*e))', sd='stddev_pop(e)', moved_km='median(disp_km)')} FROM (SELECT *, CASE WHEN h IS NOT NULL AND r > 0.6 THEN h - top_km END AS e FROM u) GROUP BY case_id, time_model, truth",
)
def _(v, spark):
    arm = lambda t, m, k, d: v(t).select(F.lit(m).alias("time_model"), F.lit(k).alias("truth"), "case_id", "h", "r", "top_km", d.alias("disp_km"))
    both = arm("pa", "nominal", "raw", F.lit(0.0)).unionByName(arm("pb", "lut", "advected", F.col("pid") % 50 / 10))
    return ex.ablation_table(both, by=("case_id", "time_model", "truth"))



@query("s7_retrieve_run")  # the whole chain; tests hold it against made scenes of known heights
def _(v, spark):
    """One case under the two images of the pixel tables, from scans to the stored run's profiles."""
    axes = None
    for img, sat in ((0, 16), (1, 17)):
        x = geo.geos_forward(geo.apparent_position(spark.range(1).select(F.lit(36.0).alias("lat"), F.lit(-105.0).alias("lon")), 10.0, geo.SAT_LON[sat]), geo.SAT_LON[sat], "alat", "alon")
        x = x.select(F.lit(img).cast("long").alias("scan_id"), F.lit(sat).alias("sat"), F.lit("C").alias("domain"), F.lit("2019-03-01 12:00:00").cast("timestamp_ntz").alias("t"), (F.col("x_rad") - 20 * 1.4e-4).alias("x0"), F.lit(1.4e-4).alias("dx"), (F.col("y_rad") + 20 * 1.4e-4).alias("y0"), F.lit(-1.4e-4).alias("dy"))
        axes = x if axes is None else axes.unionByName(x)
    pixels = v("fx_channels").select(F.col("scan_id").cast("long").alias("scan_id"), "sat", "ch", F.col("i").alias("row"), F.col("j").alias("col"), "cmi").join(axes.select("scan_id", "x0", "dx", "y0", "dy"), "scan_id")
    pixels = pixels.select("scan_id", "sat", "ch", "row", "col", (F.col("x0") + F.col("col") * F.col("dx")).alias("x_rad"), (F.col("y0") + F.col("row") * F.col("dy")).alias("y_rad"), "cmi")
    case = spark.range(1).select(F.lit("case_0").alias("case_id"), F.lit("2019-03-01 12:01:00").cast("timestamp_ntz").alias("time"), *[F.lit(x).alias(k) for k, x in (("lat0", 35.5), ("lat1", 36.5), ("lon0", -105.6), ("lon1", -104.4), ("anchor_lat", 36.0), ("anchor_lon", -105.0))])
    truth = mt.with_totals(v("fx_truth"), lo=F.min("pid"), hi=F.max("pid")).select(F.lit("case_0").alias("case_id"), "time", "pid", (35.6 + 0.8 * (F.col("pid") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1)).alias("lat"), (-105.5 + 0.01 * (F.col("pid") % 100)).alias("lon"), "top_km")
    path = scratch(spark, "run")
    rt.run(path, "default", "0123456789", 1, case, axes, pixels, None, truth, settings=rt.Settings(r_min=0.1, amp_min=0.0))
    return read_run(spark, path, "default", "0123456789")[1].select("case_id", "pid", "contrail", "lat", "lon", "top_km", "h", "r", "s_eff")
