"""The registered queries of the library's operators and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.safe import rounded
from ..operators import asof, cases as cs, compare as cp, explore as ex, geometry as geo, metrics as mt, resample as rs, truth as tr
from ..sources import times
from .fixtures import cte, view

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, exact: bool = False):
    """Register a query; its doubles are rounded for comparison unless they are copied without arithmetic."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(lambda table: view(spark, sf_dir, table), spark)
            return out if exact else rounded(out)

        _QUERIES[name] = run
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _out(**columns: str) -> str:
    """A select list of rounded doubles (given as expressions)."""
    return ", ".join(f"round({v}, 6) + 0.0 AS {k}" for k, v in columns.items())


_RUN = cte("pa", "fx_cases_a")
_GATED = "h IS NOT NULL AND r > 0.6"
_SUMS = f""", sums AS (SELECT c.case_id, c.qc = 'ok' AS use, count(p.pid) AS n_all, CASE WHEN c.qc = 'ok' THEN count(p.pid) ELSE 0 END AS n_use,
  count(*) FILTER (c.qc = 'ok' AND {_GATED}) AS n, coalesce(sum(h - top_km) FILTER (c.qc = 'ok' AND {_GATED}), 0) AS s1,
  coalesce(sum((h - top_km) * (h - top_km)) FILTER (c.qc = 'ok' AND {_GATED}), 0) AS s2
  FROM fx_cases_a c LEFT JOIN pa p ON p.case_id = c.case_id WHERE c.qc <> 'error' GROUP BY c.case_id, c.qc)"""
_LOO = """, loo AS (SELECT *, CASE WHEN n > 0 THEN s1 / n END AS m,
  (sum(CASE WHEN n > 0 THEN s1 / n ELSE 0 END) OVER () - CASE WHEN n > 0 THEN s1 / n ELSE 0 END) / nullif(count(*) FILTER (n > 0) OVER () - CASE WHEN n > 0 THEN 1 ELSE 0 END, 0) AS c FROM sums)"""


def _root(x: str) -> str:
    """greatest() skips NULL, a root of nothing is NULL."""
    return f"CASE WHEN {x} IS NOT NULL THEN sqrt(greatest({x}, 0)) END"


_METRICS = {
    "bias": "sum(s1) FILTER (n > 0) / nullif(sum(n), 0)",
    "rmse_raw": "sqrt(sum(s2) FILTER (n > 0) / nullif(sum(n), 0))",
    "rmse_corr": _root("(sum(s2 - 2*c*s1 + n*c*c) FILTER (n > 0) / nullif(sum(n), 0))"),
    "within": _root("(sum(s2 - s1*m) FILTER (n > 0) / nullif(sum(n), 0))"),
    "between": _root("(sum(n*(m - c)*(m - c)) FILTER (n > 0) / nullif(sum(n), 0))"),
}
_HAVERSINE = """2*6371.0*asin(sqrt(least(1.0, greatest(0.0, pow(sin((radians(lat) - radians(lag(lat) OVER w))/2), 2)
  + cos(radians(lag(lat) OVER w))*cos(radians(lat))*pow(sin((radians(lon) - radians(lag(lon) OVER w))/2), 2)))))"""
_SEGMENTS = f""", gaps AS (SELECT *, {_HAVERSINE} AS gap_km FROM {{source}} WINDOW w AS (PARTITION BY case_id ORDER BY pid)),
 seg AS (SELECT *, sum(CASE WHEN gap_km > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY pid) AS contrail FROM gaps)"""
_CONTRAILS = _SEGMENTS.format(source="pa") + f""", contrails AS (SELECT s.case_id, contrail, c.qc, c.vza_max, c.qc = 'ok' AS use, count(*) AS n_truth, count(*) FILTER (c.qc = 'ok' AND {_GATED}) AS n_gated, avg(top_km) AS top_km,
  CASE WHEN count(*) FILTER (c.qc = 'ok' AND {_GATED}) >= 3 THEN median(h) FILTER (c.qc = 'ok' AND {_GATED}) END AS h, median(s_eff) AS s_eff
  FROM seg s JOIN fx_cases_a c ON s.case_id = c.case_id WHERE c.qc <> 'error' GROUP BY s.case_id, contrail, c.qc, c.vza_max)"""


def _run(v):
    return v("fx_cases_a"), v("pa")


def _contrails(v):
    return mt.contrail_table(v("fx_cases_a"), tr.contrail_ids(v("pa")))


# --- accuracy of a run -----------------------------------------------------------------------------


@query("v1_gate", f"{_RUN} SELECT p.case_id, p.pid, coalesce({_GATED} AND s_eff >= 1.0, false) AS passes FROM pa p JOIN fx_cases_a c ON p.case_id = c.case_id WHERE c.qc = 'ok'")
def _(v, spark):
    cases, profiles = _run(v)
    return profiles.join(cases.where(mt.usable()).select("case_id"), "case_id", "left_semi").select("case_id", "pid", mt.passes(0.6, 1.0).alias("passes"))


@query("v2_case_sums", f"{_RUN}{_SUMS} SELECT case_id, use, n_all, n_use, n, {_out(s1='s1', s2='s2')} FROM sums")
def _(v, spark):
    return mt.case_sums(*_run(v))


@query("v3_loo_constant", f"{_RUN}{_SUMS}{_LOO} SELECT case_id, n, {_out(m='m', c='c')} FROM loo")
def _(v, spark):
    return mt.loo_constant(mt.case_sums(*_run(v))).select("case_id", "n", "m", "c")


@query("v4_metrics", f"{_RUN}{_SUMS}{_LOO} SELECT {_out(**_METRICS)}, sum(n)::BIGINT AS n_points FROM loo")
def _(v, spark):
    return mt.metrics(mt.case_sums(*_run(v)))


_LADDER_SUMS = """, sums AS (SELECT gate, c.case_id, c.qc = 'ok' AS use, CASE WHEN c.qc = 'ok' THEN count(p.pid) ELSE 0 END AS n_use,
  count(*) FILTER (c.qc = 'ok' AND h IS NOT NULL AND r > gate) AS n, coalesce(sum(h - top_km) FILTER (c.qc = 'ok' AND h IS NOT NULL AND r > gate), 0) AS s1,
  coalesce(sum((h - top_km)*(h - top_km)) FILTER (c.qc = 'ok' AND h IS NOT NULL AND r > gate), 0) AS s2
  FROM fx_cases_a c CROSS JOIN fx_ladder LEFT JOIN pa p ON p.case_id = c.case_id WHERE c.qc <> 'error' GROUP BY gate, c.case_id, c.qc),
 loo AS (SELECT *, CASE WHEN n > 0 THEN s1 / n END AS m, (sum(CASE WHEN n > 0 THEN s1 / n ELSE 0 END) OVER g - CASE WHEN n > 0 THEN s1 / n ELSE 0 END)
  / nullif(count(*) FILTER (n > 0) OVER g - CASE WHEN n > 0 THEN 1 ELSE 0 END, 0) AS c FROM sums WINDOW g AS (PARTITION BY gate)),
 tops AS (SELECT gate, sum((h - top_km)*(h - top_km)) AS ss, var_pop(top_km) * count(*) AS st FROM pa p JOIN fx_cases_a c ON p.case_id = c.case_id CROSS JOIN fx_ladder WHERE c.qc = 'ok' AND h IS NOT NULL AND r > gate GROUP BY gate)"""


@query(
    "v6_gate_ladder",
    f"{cte('pa', 'fx_cases_a', 'fx_ladder')}{_LADDER_SUMS} SELECT round(gate, 6) + 0.0 AS gate, count(*) AS n_cases, count(*) FILTER (use) AS n_usable, count(*) FILTER (n > 0) AS n_cases_scored, "
    f"{_out(yield_='avg(use::INT)', coverage='sum(n) / sum(n_use)', r2='(SELECT 1 - ss/st FROM tops WHERE tops.gate = loo.gate)', **_METRICS)}, sum(n)::BIGINT AS n_points FROM loo GROUP BY gate",
)
def _(v, spark):
    return mt.gate_ladder(*_run(v), v("fx_ladder")).drop("s_gate")


@query(
    "v5_summary",
    f"{_RUN}{_SUMS}{_LOO}, tops AS (SELECT 1 - sum((h - top_km)*(h - top_km)) / (var_pop(top_km) * count(*)) AS r2 FROM pa p JOIN fx_cases_a c ON p.case_id = c.case_id WHERE c.qc = 'ok' AND {_GATED}) "
    f"SELECT 0.6::DOUBLE AS gate, count(*) AS n_cases, count(*) FILTER (use) AS n_usable, count(*) FILTER (n > 0) AS n_cases_scored, "
    f"{_out(yield_='avg(use::INT)', coverage='sum(n) / sum(n_use)', r2='(SELECT r2 FROM tops)', **_METRICS)}, sum(n)::BIGINT AS n_points FROM loo",
)
def _(v, spark):
    return mt.summary(*_run(v)).drop("s_gate")


@query(
    "v7_case_table",
    f"{_RUN}{_SUMS}{_LOO}, s AS (SELECT *, s2 - 2*coalesce(c, 0)*s1 + n*coalesce(c, 0)*coalesce(c, 0) AS sse FROM loo) SELECT s.case_id, n, "
    f"{_out(bias='m', sd='sqrt(greatest((s2 - s1*m)/n, 0))', offset='m - c', sse_share='sse / sum(sse) OVER ()', vza_max='k.vza_max')}, k.qc FROM s JOIN fx_cases_a k ON s.case_id = k.case_id WHERE n > 0",
)
def _(v, spark):
    return mt.case_table(*_run(v))


@query(
    "v8_contrail_table",
    f"{_RUN}{_CONTRAILS} SELECT case_id, contrail::BIGINT AS contrail, qc, use, n_truth, n_gated, h IS NOT NULL AS scored, {_out(vza_max='vza_max', top_km='top_km', h='h', s_eff='s_eff', err='h - top_km')} FROM contrails",
)
def _(v, spark):
    return _contrails(v)


@query(
    "v9_contrail_summary",
    f"{_RUN}{_CONTRAILS}, per AS (SELECT case_id, count(*) AS k, count(h) AS n, coalesce(sum(h - top_km), 0) AS s1, coalesce(sum((h - top_km)*(h - top_km)), 0) AS s2 FROM contrails WHERE use GROUP BY case_id), "
    "x AS (SELECT *, (sum(s1) OVER () - s1) / nullif(sum(n) OVER () - n, 0) AS c FROM per) SELECT sum(k)::BIGINT AS n_contrails, sum(n)::BIGINT AS n_scored, count(*) FILTER (n > 0) AS n_cases, "
    + _out(contrail_coverage="sum(n)/sum(k)", bias="sum(s1)/sum(n)", rmse_raw="sqrt(sum(s2)/sum(n))", rmse_corr="sqrt(sum(s2 - 2*c*s1 + n*c*c)/sum(n) FILTER (c IS NOT NULL))")
    + " FROM x",
)
def _(v, spark):
    return mt.contrail_summary(_contrails(v))


@query(
    "v10_error_tails",
    f"{_RUN}{_CONTRAILS}, e AS (SELECT abs(h - top_km - avg(h - top_km) OVER ()) AS e FROM contrails WHERE h IS NOT NULL) SELECT {_out(median_abs='median(e)', within_05='avg((e <= 0.5)::INT)', within_1='avg((e <= 1.0)::INT)')} FROM e",
)
def _(v, spark):
    return mt.error_tails(_contrails(v))


@query("v11_case_medians", f"{_RUN} SELECT c.case_id, c.qc, {_out(vza_max='any_value(c.vza_max)', offset_s='any_value(c.offset_s)', s_eff='median(p.s_eff)')} FROM fx_cases_a c LEFT JOIN pa p ON c.case_id = p.case_id GROUP BY c.case_id, c.qc")
def _(v, spark):
    return mt.case_medians(*_run(v))


@query("v12_verdict_counts", f"{cte('fx_cases_a')} SELECT qc, count(*) AS n FROM fx_cases_a GROUP BY qc")
def _(v, spark):
    return mt.verdict_counts(v("fx_cases_a"))


@query("v12_coverage_by_angle", f"{cte('fx_cases_a')} SELECT case_id, qc, {_out(vza_max='vza_max', map_coverage='CASE WHEN offset_s > -8 THEN (offset_s + 10)/20 END')} FROM fx_cases_a WHERE qc <> 'error' AND offset_s > -8")
def _(v, spark):
    return mt.coverage_by_angle(v("fx_cases_a").withColumn("map_coverage", F.when(F.col("offset_s") > -8, (F.col("offset_s") + 10) / 20)))


@query("v12_contrail_count", f"{cte('fx_truth')}{_SEGMENTS.format(source='fx_truth')} SELECT count(DISTINCT (case_id, contrail)) AS n_contrails, count(DISTINCT case_id) AS n_cases FROM seg WHERE pid % 3 > 0")
def _(v, spark):
    return mt.contrail_count(tr.contrail_ids(v("fx_truth")).withColumn("contrail", F.when(F.col("pid") % 3 > 0, F.col("contrail"))))


@query(
    "v13_density_histogram",
    f"{_RUN}{_SUMS}{_LOO}, x AS (SELECT floor((top_km - 8.0) / ((16.0 - 8.0)/60))::BIGINT AS ix, floor((round(h - coalesce(c, 0), 9) - 8.0) / ((16.0 - 8.0)/60))::BIGINT AS iy FROM pa p JOIN loo l ON p.case_id = l.case_id WHERE l.use AND {_GATED}) "
    "SELECT ix, iy, count(*) AS n FROM x WHERE ix BETWEEN 0 AND 59 AND iy BETWEEN 0 AND 59 GROUP BY ix, iy",
)
def _(v, spark):
    return mt.density_histogram(*_run(v))


def _headline(run: str) -> str:
    return f"(SELECT sum(n)::DOUBLE AS n_points, sum(s1)/sum(n) AS bias, sqrt(sum(s2)/sum(n)) AS rmse_raw FROM (SELECT count(*) AS n, sum(h - top_km) AS s1, sum((h - top_km)*(h - top_km)) AS s2 FROM p{run} p JOIN fx_cases_{run} c ON c.case_id = p.case_id WHERE c.qc = 'ok' AND {_GATED} GROUP BY p.case_id))"


@query(
    "v15_regression_check",
    f"{cte('pa', 'pb', 'fx_cases_a', 'fx_cases_b')}, f AS (UNPIVOT {_headline('a')} ON n_points, bias, rmse_raw INTO NAME metric VALUE value), e AS (UNPIVOT {_headline('b')} ON n_points, bias, rmse_raw INTO NAME metric VALUE expected) "
    f"SELECT metric, {_out(value='value', expected='expected')}, CASE WHEN metric = 'n_points' THEN value = expected ELSE abs(value - expected) <= 0.005 END AS matches FROM e JOIN f USING (metric)",
)
def _(v, spark):
    """Run A's headline numbers against run B's, as stored ones."""
    names = ("n_points", "bias", "rmse_raw")
    headline = lambda x, value: mt.metrics(mt.case_sums(v(f"fx_cases_{x}"), v(f"p{x}"))).select(F.explode(F.create_map(*[y for k in names for y in (F.lit(k), F.col(k).cast("double"))])).alias("metric", value))
    return mt.regression_check(headline("a", "value"), headline("b", "expected").withColumn("exact", F.col("metric") == "n_points"))


# --- truth -----------------------------------------------------------------------------------------


@query("p16_haversine_gap", f"{cte('fx_truth')}{_SEGMENTS.format(source='fx_truth')} SELECT case_id, pid, {_out(gap_km='gap_km')} FROM gaps")
def _(v, spark):
    return tr.haversine_gap(v("fx_truth")).select("case_id", "pid", "gap_km")


@query("t1_contrail_ids", f"{cte('fx_truth')}{_SEGMENTS.format(source='fx_truth')} SELECT case_id, pid, contrail::BIGINT AS contrail FROM seg")
def _(v, spark):
    return tr.contrail_ids(v("fx_truth")).select("case_id", "pid", "contrail")


@query("t2_truth_times", f"{cte('fx_truth')}, c AS (SELECT case_id, min(time) AS ct FROM fx_truth GROUP BY case_id) SELECT t.case_id, pid, coalesce(CASE WHEN pid % 7 <> 0 THEN time END, ct) AS t FROM fx_truth t JOIN c ON t.case_id = c.case_id")
def _(v, spark):
    truth = v("fx_truth")
    case_time = truth.groupBy("case_id").agg(F.min("time").alias("case_time"))
    return tr.truth_times(truth.withColumn("time", F.when(F.col("pid") % 7 != 0, F.col("time"))), case_time).select("case_id", "pid", "t")


_WIND = """, seg AS (SELECT case_id, h AS h0, lead(h) OVER w AS h1, u AS u0, lead(u) OVER w AS u1, v AS v0, lead(v) OVER w AS v1, min(h) OVER (PARTITION BY case_id) AS lo, max(h) OVER (PARTITION BY case_id) AS hi FROM fx_winds WINDOW w AS (PARTITION BY case_id ORDER BY h)),
 aw AS (SELECT t.*, s.u0 + (greatest(least(top_km, hi), lo) - h0)/coalesce(h1 - h0, 1)*coalesce(u1 - u0, 0) AS u, s.v0 + (greatest(least(top_km, hi), lo) - h0)/coalesce(h1 - h0, 1)*coalesce(v1 - v0, 0) AS v
  FROM fx_truth t JOIN seg s ON t.case_id = s.case_id AND greatest(least(top_km, hi), lo) >= h0 AND (h1 IS NULL OR greatest(least(top_km, hi), lo) < h1))"""


@query("j8_wind_at_height", f"{cte('fx_truth', 'fx_winds')}{_WIND} SELECT case_id, pid, {_out(u='u', v='v')} FROM aw")
def _(v, spark):
    return tr.wind_at_height(v("fx_truth"), v("fx_winds"), "top_km").select("case_id", "pid", "u", "v")


@query(
    "t3_advect_truth",
    f"{cte('fx_truth', 'fx_winds')}{_WIND}, m AS (SELECT case_id, min(time) AS mt FROM fx_truth GROUP BY case_id), d AS (SELECT aw.*, (epoch_us(mt) - epoch_us(time))/1e6 AS dt FROM aw JOIN m ON aw.case_id = m.case_id) "
    f"SELECT case_id, pid, {_out(dt_s='dt', lat_adv='lat + v*dt/111000.0', lon_adv='lon + u*dt/(111000.0*cos(radians(lat)))', disp_km='sqrt(u*u + v*v)*abs(dt)/1000').replace(', 6)', ', 9)')} FROM d",
    exact=True,
)
def _(v, spark):
    truth = v("fx_truth")
    map_times = truth.groupBy("case_id").agg(F.min("time").alias("map_time"))
    return rounded(tr.advect_truth(truth, v("fx_winds"), map_times).select("case_id", "pid", "dt_s", "lat_adv", "lon_adv", "disp_km"), 9)


@query("t7_on_map_position", f"{cte('fx_truth')} SELECT case_id, pid, {_out(lat='CASE WHEN pid % 3 = 0 THEN lat ELSE lat + 0.5 END', lon='CASE WHEN pid % 3 = 0 THEN lon ELSE lon - 0.5 END')} FROM fx_truth")
def _(v, spark):
    moved = F.col("pid") % 3 != 0
    x = v("fx_truth").withColumn("lat_adv", F.when(moved, F.col("lat") + 0.5)).withColumn("lon_adv", F.when(moved, F.col("lon") - 0.5))
    return tr.on_map_position(x).select("case_id", "pid", "lat", "lon")


# --- cases -----------------------------------------------------------------------------------------

_SCENES = """, scenes AS (SELECT case_id, count(*) AS n, make_timestamp(floor(median(epoch_us(time)))::BIGINT) AS time, median(lat) AS lat, median(lon) AS lon, median(top_km) AS top_km, stddev_samp(top_km) AS top_sd FROM fx_truth GROUP BY case_id)"""


@query("c1_scene_table", f"{cte('fx_truth')}{_SCENES} SELECT case_id, n, time, {_out(lat='lat', lon='lon', top_km='top_km', top_sd='top_sd')}, row_number() OVER (ORDER BY n DESC, case_id) - 1 AS scene FROM scenes")
def _(v, spark):
    t = cs.scene_table(v("fx_truth"))
    return t.withColumn("time", F.col("time").cast("timestamp_ntz"))


@query("c2_bbox_around", f"{cte('fx_truth')} SELECT case_id, {_out(lat0='min(lat) - 0.3', lat1='max(lat) + 0.3', lon0='min(lon) - 0.7', lon1='max(lon) + 0.7')} FROM fx_truth GROUP BY case_id")
def _(v, spark):
    return cs.bbox_around(v("fx_truth"))


@query(
    "c3_make_cases",
    f"{cte('fx_truth')}{_SCENES}, b AS (SELECT case_id AS k, min(lat) - 0.3 AS lat0, max(lat) + 0.3 AS lat1, min(lon) - 0.7 AS lon0, max(lon) + 0.7 AS lon1 FROM fx_truth GROUP BY case_id) "
    f"SELECT case_id, n, date_trunc('second', time) AS time, {_out(anchor_lat='lat', anchor_lon='lon', top_km='top_km', top_sd='top_sd', lat0='lat0', lat1='lat1', lon0='lon0', lon1='lon1')}, row_number() OVER (ORDER BY n DESC, case_id) - 1 AS scene FROM scenes JOIN b ON k = case_id",
)
def _(v, spark):
    return cs.make_cases(v("fx_truth")).withColumn("time", F.col("time").cast("timestamp_ntz"))


_U = "('0x' || substr(sha256('split-v1:' || case_id), 1, 12))::BIGINT / 281474976710656.0::DOUBLE"


@query("c4_assign_split", f"{cte('fx_cases_a')} SELECT case_id, CASE WHEN {_U} < 0.3 THEN 'holdout' ELSE 'dev' END AS split FROM fx_cases_a")
def _(v, spark):
    return cs.assign_split(v("fx_cases_a")).select("case_id", "split")


@query("c5_select_cases", f"{cte('fx_cases_a')} SELECT case_id FROM fx_cases_a WHERE vza_max <= 65 AND {_U} >= 0.3 ORDER BY sha256('split-v1:order:' || case_id), case_id LIMIT 10")
def _(v, spark):
    return cs.select_cases(v("fx_cases_a"), n=10, max_vza=65.0).select("case_id")


_E2W = "(1 - pow(6356752.314245/6378137.0, 2))"


def _vza_sql(sat: float) -> str:
    n = f"(6378137.0/sqrt(1 - {_E2W}*sin(radians(anchor_lat))*sin(radians(anchor_lat))))"
    at = {"x": f"{n}*cos(radians(anchor_lat))*cos(radians(anchor_lon))", "y": f"{n}*cos(radians(anchor_lat))*sin(radians(anchor_lon))", "z": f"{n}*(1 - {_E2W})*sin(radians(anchor_lat))"}
    dx, dy, dz = f"(42164160.0*cos(radians({sat})) - {at['x']})", f"(42164160.0*sin(radians({sat})) - {at['y']})", f"(-{at['z']})"
    up = f"({dx}*cos(radians(anchor_lat))*cos(radians(anchor_lon)) + {dy}*cos(radians(anchor_lat))*sin(radians(anchor_lon)) + {dz}*sin(radians(anchor_lat)))"
    return f"degrees(acos({up}/sqrt({dx}*{dx} + {dy}*{dy} + {dz}*{dz})))"


@query(
    "c5_table_order",
    f"{cte('fx_truth')}, a AS (SELECT case_id, median(lat) AS anchor_lat, median(lon) AS anchor_lon, row_number() OVER (ORDER BY count(*) DESC, case_id) - 1 AS scene FROM fx_truth GROUP BY case_id), "
    f"z AS (SELECT *, greatest({_vza_sql(geo.SAT_LON[16])}, {_vza_sql(geo.SAT_LON[17])}) AS vza FROM a) SELECT case_id, scene, {_out(vza_max='vza')} FROM z WHERE vza <= 58 AND {_U} >= 0.3 ORDER BY scene LIMIT 40",
)
def _(v, spark):
    """The largest cases of the split that both satellites see well enough from their own anchors."""
    x = cs.anchor_vza(cs.make_cases(v("fx_truth")))
    return cs.select_cases(x, n=40, max_vza=58.0, order="table").select("case_id", F.col("scene").cast("long").alias("scene"), "vza_max")


@query("c6_frame_schedule", f"{cte('fx_truth')}, c AS (SELECT case_id, min(time) AS time FROM fx_truth GROUP BY case_id) SELECT case_id, s.sat, o.offset_min, time + to_minutes(o.offset_min) AS t FROM c, (VALUES (16), (17)) s(sat), (VALUES (-5), (0), (5)) o(offset_min)")
def _(v, spark):
    return cs.frame_schedule(v("fx_truth").groupBy("case_id").agg(F.min("time").alias("time")), offsets=(-5, 0, 5))


@query(
    "c7_todo",
    f"{cte('fx_cases_a', 'fx_cases_b')}, vs AS (SELECT * FROM (VALUES ('a'), ('b')) x(variant)), done AS (SELECT case_id, qc, 'a' AS variant FROM fx_cases_a UNION ALL SELECT case_id, qc, 'b' FROM fx_cases_b) "
    "SELECT c.case_id, v.variant FROM fx_cases_a c, vs v WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.case_id = c.case_id AND d.variant = v.variant AND d.qc <> 'error')",
)
def _(v, spark):
    variants = spark.range(2).selectExpr("if(id = 0, 'a', 'b') AS variant")
    done = v("fx_cases_a").select("case_id", "qc", F.lit("a").alias("variant")).unionByName(v("fx_cases_b").select("case_id", "qc", F.lit("b").alias("variant")))
    return cs.todo(v("fx_cases_a"), variants, done)


@query(
    "s12_config_diff",
    f"{cte('fx_cases_a', 'fx_cases_b')} SELECT coalesce(a.case_id, b.case_id) AS \"key\", a.qc AS a, b.qc AS b FROM fx_cases_a a FULL JOIN fx_cases_b b ON a.case_id = b.case_id WHERE a.qc IS DISTINCT FROM b.qc",
)
def _(v, spark):
    return cs.config_diff(*(v(t).select(F.col("case_id").alias("key"), F.col("qc").alias("value")) for t in ("fx_cases_a", "fx_cases_b")))


@query("q1_no_data_gate", f"{cte('fx_cases_a')} SELECT case_id FROM fx_cases_a WHERE abs(offset_s*20) <= 120")
def _(v, spark):
    return cs.no_data_gate(v("fx_cases_a").withColumn("offset_s", F.col("offset_s") * 20)).select("case_id")


@query("q2_needs_wind", f"{cte('fx_cases_a')} SELECT case_id, abs(offset_s) >= 2 AS needs_wind FROM fx_cases_a")
def _(v, spark):
    return cs.needs_wind(v("fx_cases_a")).select("case_id", "needs_wind")


@query(
    "q3_scene_qc",
    f"{cte('fx_cases_a')}, x AS (SELECT case_id, offset_s, (vza_max - 45)/30.0 AS vf, CASE WHEN vza_max > 60 THEN abs(offset_s)/20 END AS res FROM fx_cases_a) SELECT case_id, CASE WHEN vf < 0.5 THEN 'coverage' WHEN CASE WHEN res IS NOT NULL THEN res > 0.25 ELSE abs(offset_s) >= 8 END THEN 'offset' ELSE 'ok' END AS verdict FROM x",
)
def _(v, spark):
    x = v("fx_cases_a").withColumn("valid_frac", (F.col("vza_max") - 45) / 30).withColumn("residual_km", F.when(F.col("vza_max") > 60, F.abs("offset_s") / 20))
    return cs.scene_qc(x).select("case_id", "verdict")


@query(
    "q6_shape_violations",
    f"{cte('fx_pixels')}, g AS (SELECT img, 40 AS n_lat, CASE WHEN img = 0 THEN 40 ELSE 39 END AS n_lon FROM (SELECT DISTINCT img FROM fx_pixels) UNION ALL SELECT 7, 1, 1), "
    "m AS (SELECT CASE WHEN j = 39 AND i > 30 THEN 5 ELSE img END AS img, i, j FROM fx_pixels), c AS (SELECT m.img, n_lat, n_lon, i, j, count(*) AS k FROM m LEFT JOIN g ON g.img = m.img GROUP BY ALL) "
    "SELECT img, CASE WHEN n_lat IS NULL THEN 'no grid' WHEN count(*) FILTER (i >= n_lat OR j >= n_lon) > 0 THEN 'cells outside the grid' WHEN max(k) > 1 THEN 'repeated cells' WHEN count(*) < n_lat*n_lon THEN 'cells are missing' END AS reason FROM c GROUP BY img, n_lat, n_lon HAVING reason IS NOT NULL",
)
def _(v, spark):
    img = F.when((F.col("j") == 39) & (F.col("i") > 30), 5).otherwise(F.col("img"))
    maps = v("fx_pixels").select(img.alias("case_id"), "i", "j", F.col("btd").alias("height"))
    grids = v("fx_pixels").select("img").distinct().select(F.col("img").alias("case_id"), F.lit(40).alias("n_lat"), F.when(F.col("img") == 0, 40).otherwise(39).alias("n_lon"))
    return cs.shape_violations(maps, grids, ("height",)).withColumnRenamed("case_id", "img")


@query("q6_contract_violations", f"{cte('fx_cases_a')} SELECT case_id, 'unknown verdict' AS reason FROM fx_cases_a WHERE qc = 'coverage'")
def _(v, spark):
    return cs.contract_violations(v("fx_cases_a"), ("ok", "offset", "no_data", "error")).select("case_id", "reason")


@query("p15_wind_sigma", f"{cte('fx_winds')} SELECT case_id, lvl, {_out(displacement_km='sqrt(u*u + v*v)*30.0/1000', residual_km='(2.0 + 0.1*sqrt(u*u + v*v))*30.0/1000')} FROM fx_winds")
def _(v, spark):
    return cs.wind_sigma_displacement(v("fx_winds").withColumn("dt_s", F.lit(-30.0))).select("case_id", "lvl", "displacement_km", "residual_km")


# --- as-of joins -----------------------------------------------------------------------------------

_FRAMES = "f AS (SELECT case_id, min(time) AS t FROM fx_truth GROUP BY case_id), fr AS (SELECT f.*, s.sat FROM f, (VALUES (16), (17)) s(sat))"


@query(
    "j1_nearest_scan",
    f"{cte('fx_truth', 'fx_scans')}, {_FRAMES}, near AS (SELECT fr.case_id, fr.sat, s.scan_id, s.domain, (epoch_us(s.t) - epoch_us(fr.t))/1e6 AS dt, row_number() OVER (PARTITION BY fr.case_id, fr.sat ORDER BY s.domain <> 'C', abs(epoch_us(s.t) - epoch_us(fr.t)), s.scan_id) AS k "
    "FROM fr JOIN fx_scans s ON s.sat = fr.sat AND abs(epoch_us(s.t) - epoch_us(fr.t)) <= 86400000000) SELECT fr.case_id, fr.sat, n.scan_id, n.domain, round(n.dt, 6) + 0.0 AS dt_s FROM fr LEFT JOIN near n ON n.case_id = fr.case_id AND n.sat = fr.sat AND n.k = 1",
)
def _(v, spark):
    frames = cs.frame_schedule(v("fx_truth").groupBy("case_id").agg(F.min("time").alias("time")))
    return asof.nearest_scan(frames, v("fx_scans"), within_s=86400)


@query(
    "j2_same_scan_check",
    f"{cte('fx_scans')}, x AS (SELECT 'case_' || (scan_id % 50)::VARCHAR AS case_id, sat, domain, t FROM fx_scans) SELECT case_id, sat, count(DISTINCT domain) AS domains, round((epoch_us(max(t)) - epoch_us(min(t)))/1e6, 6) + 0.0 AS span_s, count(DISTINCT domain) = 1 AND (epoch_us(max(t)) - epoch_us(min(t)))/1e6 <= 60 AS fits FROM x GROUP BY case_id, sat",
)
def _(v, spark):
    frames = v("fx_scans").withColumn("case_id", F.concat(F.lit("case_"), (F.col("scan_id") % 50).cast("string")))
    return asof.same_scan_check(frames)


@query(
    "q4_dt_stats",
    f"{cte('fx_truth')}, x AS (SELECT case_id, (pid % 1201)/10.0 - 60 AS dt FROM fx_truth) SELECT case_id, {_out(dt_median='median(dt)', dt_min='min(dt)', dt_max='max(dt)', dt_absmax='max(abs(dt))')}, count(DISTINCT floor(dt/30)) AS swaths FROM x GROUP BY case_id",
)
def _(v, spark):
    return asof.dt_stats(v("fx_truth").withColumn("dt_s", (F.col("pid") % 1201) / 10.0 - 60))


@query("j11_pair_profiles", f"{cte('pa', 'pb')} SELECT a.case_id, a.pid, {_out(top_km='a.top_km', h_a='a.h', r_a='a.r', s_eff_a='a.s_eff', h_b='b.h', r_b='b.r', s_eff_b='b.s_eff')} FROM pa a JOIN pb b ON a.case_id = b.case_id AND a.pid = b.pid")
def _(v, spark):
    return cp.pair_profiles(v("pa"), v("pb"))


@query("j12_committed_only", f"{cte('pa', 'fx_cases_a')} SELECT case_id, pid FROM pa WHERE case_id IN (SELECT case_id FROM fx_cases_a WHERE qc = 'ok')")
def _(v, spark):
    return cp.committed_only(v("pa"), v("fx_cases_a").where("qc = 'ok'")).select("case_id", "pid")


@query("j13_common_cases", f"{cte('fx_cases_a', 'fx_cases_b')} SELECT case_id FROM fx_cases_a WHERE qc <> 'error' INTERSECT SELECT case_id FROM fx_cases_b WHERE qc <> 'error'")
def _(v, spark):
    return cp.common_cases(v("fx_cases_a"), v("fx_cases_b"))


# --- bootstrap and comparison ----------------------------------------------------------------------

_N_BOOT = 2000
_PAIR = cte("pa", "pb", "fx_cases_a", "fx_cases_b")
_WEIGHTS = f""", ids AS (SELECT case_id, row_number() OVER (ORDER BY case_id) - 1 AS i, count(*) OVER () AS size FROM (SELECT DISTINCT case_id FROM {{source}})),
 draws AS (SELECT b, ('0x' || substr(md5('0:' || b || ':' || k), 1, 12))::BIGINT % size AS i FROM (SELECT DISTINCT size FROM ids), range({_N_BOOT}) t(b), LATERAL (SELECT unnest(range(size)) AS k)),
 weights AS (SELECT b, case_id, count(*) AS w FROM draws JOIN ids USING (i) GROUP BY b, case_id)"""


@query("b1_boot_weights", f"{cte('fx_cases_a')}{_WEIGHTS.format(source='fx_cases_a')} SELECT b, case_id, w FROM weights")
def _(v, spark):
    return cp.boot_weights(v("fx_cases_a"), _N_BOOT)


_BOOT = """, bx AS (SELECT s.*, w.b, w.w, CASE WHEN n > 0 THEN s1/n END AS m FROM sums s JOIN weights w USING (case_id)),
 bl AS (SELECT *, (sum(CASE WHEN n > 0 THEN w*m ELSE 0 END) OVER (PARTITION BY b) - CASE WHEN n > 0 THEN w*m ELSE 0 END)
  / nullif(sum(CASE WHEN n > 0 THEN w ELSE 0 END) OVER (PARTITION BY b) - CASE WHEN n > 0 THEN w ELSE 0 END, 0) AS c FROM bx)"""
_BOOT_METRICS = {
    "bias": "sum(w*s1)/nullif(sum(w*n), 0)",
    "rmse_raw": "sqrt(sum(w*s2)/nullif(sum(w*n), 0))",
    "rmse_corr": "sqrt(sum(w*(s2 - 2*c*s1 + n*c*c)) FILTER (n > 0)/nullif(sum(w*n), 0))",
    "within": "sqrt(sum(w*(s2 - s1*m)) FILTER (n > 0)/nullif(sum(w*n), 0))",
    "between": "sqrt(sum(w*n*(m - c)*(m - c)) FILTER (n > 0)/nullif(sum(w*n), 0))",
}


def _boot(v):
    return cp.boot_metrics(mt.case_sums(*_run(v)), _N_BOOT)


@query("b2_boot_metrics", f"{_RUN}{_SUMS}{_WEIGHTS.format(source='sums')}{_BOOT} SELECT b, {_out(**_BOOT_METRICS)}, sum(w*n)::BIGINT AS n_points FROM bl GROUP BY b")
def _(v, spark):
    return _boot(v)


@query("b2_boot_accuracy")  # binomial splits have no SQL; the tests hold it against the same weights
def _(v, spark):
    return rs.boot_accuracy(mt.case_sums(*_run(v)), _N_BOOT)


@query(
    "b3_percentile_ci",
    f"{_RUN}{_SUMS}{_WEIGHTS.format(source='sums')}{_BOOT}, s AS (SELECT b, sum(w*s1)/sum(w*n) AS bias FROM bl GROUP BY b) SELECT {_out(lo='quantile_cont(bias, 0.025)', hi='quantile_cont(bias, 0.975)')} FROM s",
)
def _(v, spark):
    return cp.percentile_ci(_boot(v), "bias")


@query(
    "b4_boot_contrails",
    f"{_RUN}{_CONTRAILS}{_WEIGHTS.format(source='fx_cases_a')}, per AS (SELECT case_id, count(*) AS n, sum(h - top_km) AS s1, sum((h - top_km)*(h - top_km)) AS s2 FROM contrails WHERE h IS NOT NULL GROUP BY case_id), "
    "x AS (SELECT *, sum(w*s1) OVER (PARTITION BY b) AS tot, sum(w*n) OVER (PARTITION BY b) AS allp FROM per JOIN weights USING (case_id)), y AS (SELECT *, (tot - s1)/nullif(allp - n, 0) AS c FROM x) "
    f"SELECT b, {_out(bias='sum(w*s1)/any_value(allp)', rmse_raw='sqrt(sum(w*s2)/any_value(allp))', rmse_corr='sqrt(sum(w*(s2 - 2*c*s1 + n*c*c))/sum(w*n) FILTER (c IS NOT NULL))')} FROM y GROUP BY b",
)
def _(v, spark):
    return cp.boot_contrails(_contrails(v), _N_BOOT, v("fx_cases_a"))


def _own(x: str) -> str:
    c, p = f"fx_cases_{x}", f"p{x}"
    ok = f"c.qc = 'ok' AND {_GATED}"
    return f""", own_{x} AS (SELECT c.case_id, c.qc = 'ok' AS use_{x}, count(p.pid) AS n_all_{x}, CASE WHEN c.qc = 'ok' THEN count(p.pid) ELSE 0 END AS n_use_{x}, count(*) FILTER ({ok}) AS n_{x},
  coalesce(sum(h - top_km) FILTER ({ok}), 0) AS s1_{x}, coalesce(sum((h - top_km)*(h - top_km)) FILTER ({ok}), 0) AS s2_{x} FROM {c} c SEMI JOIN common USING (case_id) LEFT JOIN {p} p ON p.case_id = c.case_id GROUP BY c.case_id, c.qc)"""


_BOTH = "a.qc = 'ok' AND b.qc = 'ok' AND x.h IS NOT NULL AND y.h IS NOT NULL AND x.r > 0.6 AND y.r > 0.6"
_PAIRS = (
    _PAIR
    + ", common AS (SELECT case_id FROM fx_cases_a WHERE qc <> 'error' INTERSECT SELECT case_id FROM fx_cases_b WHERE qc <> 'error')"
    + _own("a")
    + _own("b")
    + f""", shared AS (SELECT k.case_id, a.qc AS qc_a, b.qc AS qc_b, a.vza_max, a.offset_s, count(*) FILTER ({_BOTH}) AS n_c, coalesce(sum(x.h - x.top_km) FILTER ({_BOTH}), 0) AS s1_ca, coalesce(sum((x.h - x.top_km)*(x.h - x.top_km)) FILTER ({_BOTH}), 0) AS s2_ca,
  coalesce(sum(y.h - x.top_km) FILTER ({_BOTH}), 0) AS s1_cb, coalesce(sum((y.h - x.top_km)*(y.h - x.top_km)) FILTER ({_BOTH}), 0) AS s2_cb
  FROM common k JOIN fx_cases_a a ON a.case_id = k.case_id JOIN fx_cases_b b ON b.case_id = k.case_id LEFT JOIN pa x ON x.case_id = k.case_id LEFT JOIN pb y ON y.case_id = x.case_id AND y.pid = x.pid GROUP BY k.case_id, a.qc, b.qc, a.vza_max, a.offset_s),
 p0 AS (SELECT s.*, use_a, n_all_a, n_use_a, n_a, s1_a, s2_a, use_b, n_all_b, n_use_b, n_b, s1_b, s2_b, CASE WHEN n_c > 0 THEN s1_ca/n_c END AS map_mean_a, CASE WHEN n_c > 0 THEN s1_cb/n_c END AS map_mean_b FROM shared s JOIN own_a USING (case_id) JOIN own_b USING (case_id)),
 pairs AS (SELECT *, map_mean_a - (sum(map_mean_a) OVER () - map_mean_a)/nullif(count(map_mean_a) OVER () - 1, 0) AS map_off_a, map_mean_b - (sum(map_mean_b) OVER () - map_mean_b)/nullif(count(map_mean_b) OVER () - 1, 0) AS map_off_b FROM p0)"""
)


def _pairs(v):
    return cp.pair_runs(v("fx_cases_a"), v("pa"), v("fx_cases_b"), v("pb"))


@query(
    "d1_pair",
    f"{_PAIRS} SELECT case_id, qc_a, qc_b, n_c, use_a, use_b, n_all_a, n_all_b, n_use_a, n_use_b, n_a, n_b, "
    + _out(**{c: c for c in ("vza_max", "offset_s", "s1_ca", "s2_ca", "s1_cb", "s2_cb", "s1_a", "s2_a", "s1_b", "s2_b", "map_mean_a", "map_mean_b", "map_off_a", "map_off_b")}, cov_a="n_a/nullif(n_use_a, 0)", cov_b="n_b/nullif(n_use_b, 0)", d_abs_off="abs(map_off_b) - abs(map_off_a)")
    + " FROM pairs",
)
def _(v, spark):
    return _pairs(v)


def _side_metrics(source: str, n: str, s1: str, s2: str, kind: str, side: str, weights: str) -> str:
    """Metrics of one side in long form; ``source`` has b and w."""
    keep = ("bias", "rmse_raw", "rmse_corr", "within", "between") if kind == "common" else ("bias", "rmse_corr")
    inner = f"(SELECT b, w, {n} AS n, {s1} AS s1, {s2} AS s2, CASE WHEN {n} > 0 THEN {s1}/{n} END AS m FROM {source})"
    loo = f"""(SELECT *, (sum(CASE WHEN n > 0 THEN w*m ELSE 0 END) OVER (PARTITION BY b) - CASE WHEN n > 0 THEN w*m ELSE 0 END)
  / nullif(sum(CASE WHEN n > 0 THEN w ELSE 0 END) OVER (PARTITION BY b) - CASE WHEN n > 0 THEN w ELSE 0 END, 0) AS c FROM {inner})"""
    return " UNION ALL ".join(f"SELECT b, '{k} ({kind})' AS metric, '{side}' AS side, {_BOOT_METRICS[k]} AS value FROM {loo} GROUP BY b" for k in keep)


def _metric_sql(source: str) -> str:
    parts = [f"SELECT b, 'yield' AS metric, '{s.upper()}' AS side, sum(w*use_{s}::INT)/sum(w) AS value FROM {source} GROUP BY b UNION ALL SELECT b, 'coverage (own)', '{s.upper()}', sum(w*n_{s})/sum(w*n_use_{s}) FROM {source} GROUP BY b" for s in "ab"]
    parts += [_side_metrics(source, "n_a", "s1_a", "s2_a", "own", "A", "w"), _side_metrics(source, "n_b", "s1_b", "s2_b", "own", "B", "w")]
    parts += [_side_metrics(source, "n_c", "s1_ca", "s2_ca", "common", "A", "w"), _side_metrics(source, "n_c", "s1_cb", "s2_cb", "common", "B", "w")]
    return "SELECT b, metric, max(value) FILTER (side = 'A') AS va, max(value) FILTER (side = 'B') AS vb FROM (" + " UNION ALL ".join(parts) + ") GROUP BY b, metric"


@query("d2_metric_set", f"{_PAIRS}, one AS (SELECT *, -1 AS b, 1 AS w FROM pairs), m AS ({_metric_sql('one')}) SELECT metric, round(va, 6) + 0.0 AS \"A\", round(vb, 6) + 0.0 AS \"B\" FROM m")
def _(v, spark):
    return cp.metric_set(_pairs(v)).drop("draw")


_COMPARE = f"""{_PAIRS}{_WEIGHTS.format(source="pairs")}, one AS (SELECT *, -1 AS b, 1 AS w FROM pairs), many AS (SELECT pairs.*, weights.b, weights.w FROM pairs JOIN weights USING (case_id)),
 m1 AS ({_metric_sql("one")}), m2 AS ({_metric_sql("many")}), big1 AS (SELECT * FROM m1 UNION ALL SELECT b, '|' || replace(metric, ' ', '| '), abs(va), abs(vb) FROM m1 WHERE starts_with(metric, 'bias')),
 big2 AS (SELECT * FROM m2 UNION ALL SELECT b, '|' || replace(metric, ' ', '| '), abs(va), abs(vb) FROM m2 WHERE starts_with(metric, 'bias')),
 ci AS (SELECT metric, quantile_cont(vb - va, 0.025) AS lo, quantile_cont(vb - va, 0.975) AS hi FROM big2 GROUP BY metric)"""
_CALL = """CASE WHEN starts_with(metric, 'bias') THEN '' WHEN lo > 0 THEN CASE WHEN starts_with(metric, 'yield') OR starts_with(metric, 'coverage') THEN 'better' ELSE 'worse' END
 WHEN hi < 0 THEN CASE WHEN starts_with(metric, 'yield') OR starts_with(metric, 'coverage') THEN 'worse' ELSE 'better' END ELSE '~' END"""


@query("d3_compare", f"{_COMPARE} SELECT metric, round(va, 6) + 0.0 AS \"A\", round(vb, 6) + 0.0 AS \"B\", {_out(delta='vb - va', lo='lo', hi='hi')}, CASE WHEN (SELECT count(*) FROM pairs) < 10 THEN 'n<10' ELSE {_CALL} END AS call FROM big1 JOIN ci USING (metric)")
def _(v, spark):
    return cp.compare(_pairs(v), _N_BOOT)


@query(
    "d5_by_stratum",
    f"{_PAIRS}, lng AS (SELECT case_id, vza_max, 'A' AS side, n_c AS n, s1_ca AS s1, s2_ca AS s2 FROM pairs UNION ALL SELECT case_id, vza_max, 'B', n_c, s1_cb, s2_cb FROM pairs), "
    "loo AS (SELECT *, CASE WHEN n > 0 THEN s1/n END AS m, (sum(CASE WHEN n > 0 THEN s1/n ELSE 0 END) OVER (PARTITION BY side) - CASE WHEN n > 0 THEN s1/n ELSE 0 END)/nullif(count(*) FILTER (n > 0) OVER (PARTITION BY side) - CASE WHEN n > 0 THEN 1 ELSE 0 END, 0) AS c FROM lng), "
    f"bins AS (SELECT * FROM (VALUES (0.0::DOUBLE, 55.0::DOUBLE), (55.0, 60.0), (60.0, 65.0), (65.0, 90.0)) x(lo, hi)) SELECT lo, hi, side, count(*) AS n_cases, {_out(**_METRICS)}, sum(n)::BIGINT AS n_points FROM loo JOIN bins ON vza_max > lo AND vza_max <= hi GROUP BY lo, hi, side",
)
def _(v, spark):
    strata = spark.createDataFrame([(0.0, 55.0), (55.0, 60.0), (60.0, 65.0), (65.0, 90.0)], "lo double, hi double")
    return cp.by_stratum(_pairs(v), strata)


@query("d6_verdict_flips", f"{_PAIRS} SELECT qc_a, qc_b, count(*) AS n, qc_a <> qc_b AS changed FROM pairs GROUP BY qc_a, qc_b")
def _(v, spark):
    return cp.verdict_flips(_pairs(v))


@query(
    "d7_tail",
    f"{_PAIRS} SELECT case_id, n_c, qc_a, qc_b, {_out(vza_max='vza_max', map_off_a='map_off_a', map_off_b='map_off_b')}, CASE WHEN abs(map_off_a) > 0.3 AND abs(map_off_b) <= 0.3 THEN 'fixed' WHEN abs(map_off_a) <= 0.3 AND abs(map_off_b) > 0.3 THEN 'broken' ELSE 'both' END AS status FROM pairs WHERE abs(map_off_a) > 0.3 OR abs(map_off_b) > 0.3",
)
def _(v, spark):
    return cp.tail(_pairs(v), 0.3)


@query(
    "d8_movers",
    f"{_PAIRS}, d AS (SELECT case_id, n_c, map_off_a, map_off_b, abs(map_off_b) - abs(map_off_a) AS d FROM pairs) SELECT case_id, n_c, {_out(map_off_a='map_off_a', map_off_b='map_off_b', d_abs_off='d')}, kind FROM ("
    "(SELECT *, 'improved' AS kind FROM d WHERE d < 0 ORDER BY d, case_id LIMIT 8) UNION ALL (SELECT *, 'degraded' FROM d WHERE d > 0 ORDER BY d DESC, case_id LIMIT 8))",
)
def _(v, spark):
    return cp.movers(_pairs(v))


@query("d12_outlier_cases", f"{_PAIRS}, d AS (SELECT case_id, abs(map_off_b) - abs(map_off_a) AS d, max(greatest(abs(map_off_a), abs(map_off_b))) OVER () AS lim FROM pairs) SELECT case_id, round(d, 6) + 0.0 AS d_abs_off, round(lim, 6) + 0.0 AS \"limit\" FROM d WHERE abs(d) > 0.05*lim")
def _(v, spark):
    return cp.outlier_cases(_pairs(v), 0.05)


def _paired_contrails(v):
    other = mt.contrail_table(v("fx_cases_b"), tr.contrail_ids(v("pb")))
    return cp.pair_contrails(_contrails(v), other)


_CONTRAILS_B = _CONTRAILS.replace("gaps AS", "gaps_b AS").replace("FROM gaps)", "FROM gaps_b)").replace("seg AS", "seg_b AS").replace("FROM seg s", "FROM seg_b s").replace("contrails AS", "contrails_b AS").replace("FROM pa WINDOW", "FROM pb WINDOW").replace("fx_cases_a", "fx_cases_b")
_JOINED = f"{_PAIR}{_CONTRAILS}{_CONTRAILS_B}, joined AS (SELECT a.case_id, a.contrail::BIGINT AS contrail, a.h - a.top_km AS err_a, b.h - b.top_km AS err_b FROM contrails a JOIN contrails_b b ON a.case_id = b.case_id AND a.contrail = b.contrail WHERE a.h IS NOT NULL AND b.h IS NOT NULL)"


@query("j15_pair_contrails", f"{_JOINED} SELECT case_id, contrail, {_out(err_a='err_a', err_b='err_b')} FROM joined")
def _(v, spark):
    return _paired_contrails(v)


@query(
    "d10_contrail_movers",
    f"{_JOINED}, d AS (SELECT *, abs(err_b) - abs(err_a) AS ch FROM joined) SELECT DISTINCT case_id, contrail, {_out(err_a='err_a', err_b='err_b', change='ch')} FROM ((SELECT * FROM d ORDER BY ch, case_id, contrail LIMIT 8) UNION ALL (SELECT * FROM d ORDER BY ch DESC, case_id, contrail LIMIT 8))",
)
def _(v, spark):
    return cp.contrail_movers(_paired_contrails(v))


# --- exploration -----------------------------------------------------------------------------------

_SWEEP = cte("pa", "fx_cases_a", "fx_sweep_more") + _SEGMENTS.format(source="pa") + """, ct AS (SELECT gate, s_gate, s.case_id, contrail, CASE WHEN count(*) FILTER (h IS NOT NULL AND r > gate AND (s_gate <= 0 OR s_eff >= s_gate)) >= 3 THEN median(h) FILTER (h IS NOT NULL AND r > gate AND (s_gate <= 0 OR s_eff >= s_gate)) - avg(top_km) END AS err
  FROM seg s JOIN fx_cases_a c ON s.case_id = c.case_id AND c.qc = 'ok' CROSS JOIN fx_sweep_more GROUP BY gate, s_gate, s.case_id, contrail),
 per AS (SELECT gate, s_gate, case_id, count(*) AS k, count(err) AS n, coalesce(sum(err), 0) AS s1, coalesce(sum(err*err), 0) AS s2 FROM ct GROUP BY gate, s_gate, case_id),
 lo AS (SELECT *, (sum(s1) OVER g - s1)/nullif(sum(n) OVER g - n, 0) AS c FROM per WINDOW g AS (PARTITION BY gate, s_gate)),
 sweep AS (SELECT gate, s_gate, sum(n)/sum(k) AS coverage, sqrt(sum(s2)/nullif(sum(n), 0)) AS rmse_raw, sqrt(sum(s2 - 2*c*s1 + n*c*c)/nullif(sum(n) FILTER (c IS NOT NULL), 0)) AS rmse_corr FROM lo GROUP BY gate, s_gate)"""


def _sweep(v):
    return ex.gate_sweep(v("fx_cases_a"), tr.contrail_ids(v("pa")), v("fx_sweep_more"))


@query("n2_gate_sweep", f"{_SWEEP} SELECT {_out(gate='gate', s_gate='s_gate', coverage='coverage', rmse_raw='rmse_raw', rmse_corr='rmse_corr')} FROM sweep")
def _(v, spark):
    return _sweep(v)


_FRONT = ", front AS (SELECT * FROM (SELECT *, min(rmse_corr) OVER (ORDER BY coverage DESC, rmse_corr, gate, s_gate ROWS UNBOUNDED PRECEDING) AS best FROM sweep WHERE rmse_corr IS NOT NULL) WHERE rmse_corr = best)"


@query("n3_pareto_front", f"{_SWEEP}{_FRONT} SELECT {_out(gate='gate', s_gate='s_gate', coverage='coverage', rmse_raw='rmse_raw', rmse_corr='rmse_corr')} FROM front")
def _(v, spark):
    return ex.pareto_front(_sweep(v))


_TARGETS = ", targets AS (SELECT * FROM (VALUES (0.2::DOUBLE), (0.4), (0.6), (0.8)) x(target))"


def _targets(spark):
    return spark.createDataFrame([(0.2,), (0.4,), (0.6,), (0.8,)], "target double")


@query("n4_best_at_coverage", f"{_SWEEP}{_TARGETS}, b AS (SELECT target, min(rmse_corr) FILTER (s_gate <= 0) AS ro, min(rmse_corr) AS an FROM sweep JOIN targets ON abs(coverage - target) <= 0.05 GROUP BY target) SELECT target, {_out(r_only='ro', any_gate='an', gain='ro - an')} FROM b")
def _(v, spark):
    return ex.best_at_coverage(_sweep(v), _targets(spark))


@query(
    "n5_front_at_coverage",
    f"{_SWEEP}{_FRONT}{_TARGETS}, s AS (SELECT coverage AS c0, rmse_corr AS y0, lead(coverage) OVER (ORDER BY coverage, rmse_corr) AS c1, lead(rmse_corr) OVER (ORDER BY coverage, rmse_corr) AS y1 FROM front) "
    f"SELECT target, {_out(value='y0 + (target - c0)/(c1 - c0)*(y1 - y0)')} FROM targets LEFT JOIN s ON target >= c0 AND target < c1",
)
def _(v, spark):
    return ex.front_at_coverage(ex.pareto_front(_sweep(v)), _targets(spark))


# --- geometry --------------------------------------------------------------------------------------

_L = cte("fx_lattice")


@query("p4_advect", f"{_L} SELECT pid, {_out(lat='lat + (-7.0)*300.0/111000.0', lon='lon + 21.0*300.0/(111000.0*cos(radians(lat)))')} FROM fx_lattice")
def _(v, spark):
    x = v("fx_lattice").withColumn("u", F.lit(21.0)).withColumn("v", F.lit(-7.0)).withColumn("dt", F.lit(300.0))
    return geo.advect(x, "u", "v", "dt").select("pid", "lat", "lon")




def _ecef(h: str) -> str:
    n = f"(6378137.0/sqrt(1 - {_E2W}*sin(radians(lat))*sin(radians(lat))))"
    return f"({n} + {h})*cos(radians(lat))*cos(radians(lon)) AS px, ({n} + {h})*cos(radians(lat))*sin(radians(lon)) AS py, ({n}*(1 - {_E2W}) + {h})*sin(radians(lat)) AS pz"


def _ray(sat: float, name: str, source: str) -> str:
    return f""", {name}0 AS (SELECT *, {_ecef("11000.0")} FROM {source}), {name}1 AS (SELECT *, 42164160.0*cos(radians({sat})) AS sx, 42164160.0*sin(radians({sat})) AS sy FROM {name}0),
 {name}2 AS (SELECT *, px - sx AS vx, py - sy AS vy, pz AS vz FROM {name}1),
 {name}3 AS (SELECT *, (vx*vx + vy*vy)/pow(6378137.0, 2) + vz*vz/pow(6356752.31414, 2) AS qa, 2*(sx*vx + sy*vy)/pow(6378137.0, 2) AS qb, pow(42164160.0/6378137.0, 2) - 1 AS qc FROM {name}2),
 {name}4 AS (SELECT *, CASE WHEN qb*qb - 4*qa*qc >= 0 THEN (-qb - sqrt(abs(qb*qb - 4*qa*qc)))/(2*qa) END AS t FROM {name}3),
 {name} AS (SELECT pid, lat, lon, degrees(atan2(t*vz, pow(6356752.31414/6378137.0, 2)*sqrt((sx + t*vx)*(sx + t*vx) + (sy + t*vy)*(sy + t*vy)))) AS alat, degrees(atan2(sy + t*vy, sx + t*vx)) AS alon FROM {name}4)"""


_SEEN16 = f"{_L}{_ray(-75.2, 'g16', 'fx_lattice')}"


@query("p5_apparent_position", f"{_SEEN16} SELECT pid, {_out(alat='alat', alon='alon')} FROM g16")
def _(v, spark):
    return geo.apparent_position(v("fx_lattice"), 11.0, geo.SAT_LON[16]).select("pid", "alat", "alon")


def _shift(name: str) -> str:
    return f"(alat - lat)*111.0 AS n_{name}, (((alon - lon + 180) - 360*floor((alon - lon + 180)/360)) - 180)*111.0*cos(radians(lat)) AS e_{name}"


@query("p7_parallax_vector", f"{_SEEN16}, s AS (SELECT pid, {_shift('x')} FROM g16) SELECT pid, {_out(north_km='n_x', east_km='e_x', parallax_km='sqrt(n_x*n_x + e_x*e_x)')} FROM s")
def _(v, spark):
    return geo.parallax_vector(v("fx_lattice"), 11.0, geo.SAT_LON[16]).select("pid", "north_km", "east_km", "parallax_km")


@query(
    "p8_disparity_axis",
    f"{_SEEN16}{_ray(-137.2, 'g17', 'fx_lattice')}, s AS (SELECT pid, {_shift('a')} FROM g16), u AS (SELECT pid, {_shift('b')} FROM g17), d AS (SELECT pid, (n_a - n_b)/11.0 AS n, (e_a - e_b)/11.0 AS e FROM s JOIN u USING (pid)) "
    f"SELECT pid, {_out(k='sqrt(n*n + e*e)', axis='degrees(atan2(e, n)) - 180*floor(degrees(atan2(e, n))/180)')} FROM d",
)
def _(v, spark):
    return geo.disparity_axis(v("fx_lattice")).select("pid", "k", "axis")


@query(
    "p9_view_geometry",
    f"{_L}, a AS (SELECT *, {_ecef('0.0')} FROM fx_lattice), b AS (SELECT *, 42164160.0*cos(radians(-75.2)) - px AS dx, 42164160.0*sin(radians(-75.2)) - py AS dy, -pz AS dz, radians(lat) AS p, radians(lon) AS l FROM a), "
    "c AS (SELECT *, sqrt(dx*dx + dy*dy + dz*dz) AS d, dx*cos(p)*cos(l) + dy*cos(p)*sin(l) + dz*sin(p) AS up, -dx*sin(p)*cos(l) - dy*sin(p)*sin(l) + dz*cos(p) AS nn, -dx*sin(l) + dy*cos(l) AS ee FROM b) "
    f"SELECT pid, {_out(vza='degrees(acos(greatest(-1.0, least(1.0, up/d))))', vaz='degrees(atan2(ee, nn)) - 360*floor(degrees(atan2(ee, nn))/360)', slant_km='d/1000')} FROM c",
)
def _(v, spark):
    return geo.view_geometry(v("fx_lattice"), geo.SAT_LON[16]).select("pid", "vza", "vaz", "slant_km")


_FORWARD = """, f0 AS (SELECT *, atan(pow(6356752.31414/6378137.0, 2)*tan(radians(lat))) AS p, radians(lon + 75.2) AS dl FROM fx_lattice),
 f1 AS (SELECT *, 6356752.31414/sqrt(1 - (1 - pow(6356752.31414/6378137.0, 2))*cos(p)*cos(p)) AS rc FROM f0),
 f2 AS (SELECT *, 42164160.0 - rc*cos(p)*cos(dl) AS sx, -rc*cos(p)*sin(dl) AS sy, rc*sin(p) AS sz FROM f1),
 f3 AS (SELECT *, 42164160.0*(42164160.0 - sx) >= sy*sy + pow(6378137.0/6356752.31414, 2)*sz*sz AS seen FROM f2),
 fwd AS (SELECT pid, CASE WHEN seen THEN asin(-sy/sqrt(sx*sx + sy*sy + sz*sz)) END AS x, CASE WHEN seen THEN atan(sz/sx) END AS y FROM f3)"""


@query("p10_geos_forward", f"{_L}{_FORWARD} SELECT pid, {_out(x_rad='x', y_rad='y')} FROM fwd")
def _(v, spark):
    return geo.geos_forward(v("fx_lattice"), geo.SAT_LON[16]).select("pid", "x_rad", "y_rad")


@query("p11_geos_inverse", f"{_L}{_FORWARD} SELECT f.pid, {_out(glat='CASE WHEN x IS NOT NULL THEN lat END', glon='CASE WHEN x IS NOT NULL THEN lon END')} FROM fwd f JOIN fx_lattice l USING (pid)")
def _(v, spark):
    return geo.geos_inverse(geo.geos_forward(v("fx_lattice"), geo.SAT_LON[16]), geo.SAT_LON[16]).select("pid", "glat", "glon")


_BOX = "b AS (SELECT case_id, min(lat) - 0.3 AS lat0, max(lat) + 0.3 AS lat1, min(lon) - 0.7 AS lon0, max(lon) + 0.7 AS lon1 FROM fx_truth GROUP BY case_id)"
_GRID = f"{cte('fx_truth')}, {_BOX}, e AS (SELECT *, (lat1 - lat0)*111.0 AS north, (lon1 - lon0)*111.0*cos(radians((lat0 + lat1)/2)) AS east FROM b), g AS (SELECT *, greatest(60, least(750, trunc(north/2.0)::INT)) AS n_lat, greatest(60, least(750, trunc(east/2.0)::INT)) AS n_lon FROM e)"


@query("g1_make_grid", f"{_GRID} SELECT case_id, n_lat, n_lon, {_out(lat0='lat0', lat1='lat1', lon0='lon0', lon1='lon1', px_lat_km='north/n_lat', px_lon_km='east/n_lon')} FROM g")
def _(v, spark):
    return geo.make_grid(cs.bbox_around(v("fx_truth")))


@query("g2_km_filters", f"{_GRID} SELECT case_id, {_out(sigma_lat='16.0/(north/n_lat)', sigma_lon='16.0/(east/n_lon)')}, greatest(3, trunc(20.0/(north/n_lat))::INT | 1) AS win_lat, greatest(3, trunc(20.0/(east/n_lon))::INT | 1) AS win_lon FROM g")
def _(v, spark):
    return geo.km_filters(geo.make_grid(cs.bbox_around(v("fx_truth")))).select("case_id", "sigma_lat", "sigma_lon", "win_lat", "win_lon")


@query("p12_locate", f"{_GRID} SELECT t.case_id, pid, {_out(fi='(lat - lat0)*(n_lat - 1)/(lat1 - lat0)', fj='(lon - lon0)*(n_lon - 1)/(lon1 - lon0)')} FROM fx_truth t JOIN g ON t.case_id = g.case_id")
def _(v, spark):
    truth = v("fx_truth")
    return geo.locate(truth, geo.make_grid(cs.bbox_around(truth))).select("case_id", "pid", "fi", "fj")


@query("p20_height_bands", f"{cte('fx_truth')} SELECT case_id, pid, {_out(band_lo='6.0 + floor(top_km - 6.0)', band_hi='7.0 + floor(top_km - 6.0)')}, rint_fl AS flight_level FROM (SELECT *, round_even(top_km/0.03048, 0)::BIGINT AS rint_fl FROM fx_truth)")
def _(v, spark):
    return geo.height_bands(v("fx_truth"), "top_km").select("case_id", "pid", "band_lo", "band_hi", "flight_level")


# --- sources and further columns -------------------------------------------------------------------

_OPS = ", ops AS (SELECT * FROM (VALUES (0.5::DOUBLE, 0.0::DOUBLE), (0.6, 1.0), (0.7, 1.5), (1.5, 0.0)) x(gate, s_gate))"
_OPS_OK = "c.qc = 'ok' AND h IS NOT NULL AND r > gate AND (s_gate <= 0 OR s_eff >= s_gate)"


_OPS_SWEEP = _SWEEP[len(cte("pa", "fx_cases_a", "fx_sweep_more")) :].replace("fx_sweep_more", "ops")


@query(
    "n1_operating_points",
    f"{_RUN}{_OPS}{_OPS_SWEEP}, sums AS (SELECT gate, s_gate, c.case_id, count(*) FILTER ({_OPS_OK}) AS n, coalesce(sum(h - top_km) FILTER ({_OPS_OK}), 0) AS s1, coalesce(sum((h - top_km)*(h - top_km)) FILTER ({_OPS_OK}), 0) AS s2 "
    "FROM fx_cases_a c CROSS JOIN ops LEFT JOIN pa p ON p.case_id = c.case_id WHERE c.qc <> 'error' GROUP BY gate, s_gate, c.case_id), "
    "pts AS (SELECT gate, s_gate, count(*) AS n_cases, count(*) FILTER (n > 0) AS n_cases_scored, sum(s1)/nullif(sum(n), 0) AS bias, sqrt(sum(s2)/nullif(sum(n), 0)) AS rmse_raw, sum(n)::BIGINT AS n_points FROM sums GROUP BY gate, s_gate) "
    f"SELECT gate, s_gate, n_cases, n_cases_scored, n_points, {_out(bias='bias', rmse_raw='pts.rmse_raw', contrail_coverage='coverage', contrail_rmse_raw='sweep.rmse_raw', contrail_rmse_corr='rmse_corr')} FROM pts JOIN sweep USING (gate, s_gate)",
)
def _(v, spark):
    ops = spark.createDataFrame([(0.5, 0.0), (0.6, 1.0), (0.7, 1.5), (1.5, 0.0)], "gate double, s_gate double")
    x = ex.operating_points(v("fx_cases_a"), tr.contrail_ids(v("pa")), ops)
    return x.select("gate", "s_gate", "n_cases", "n_cases_scored", "bias", "rmse_raw", "n_points", "contrail_coverage", "contrail_rmse_raw", "contrail_rmse_corr")


@query(
    "d4_call",
    f"{cte('pa')}, x AS (SELECT pid, h - top_km - 0.2 AS lo, h - top_km + r/2 AS hi, CASE pid % 4 WHEN 0 THEN 'yield' WHEN 1 THEN 'coverage (own)' WHEN 2 THEN 'bias (own)' ELSE 'rmse_corr (own)' END AS metric FROM pa) SELECT pid, metric, CASE WHEN lo IS NULL THEN '' ELSE {_CALL} END AS call FROM x",
)
def _(v, spark):
    k, e = F.col("pid") % 4, F.col("h") - F.col("top_km")
    metric = F.when(k == 0, "yield").when(k == 1, "coverage (own)").when(k == 2, "bias (own)").otherwise("rmse_corr (own)")
    return v("pa").withColumn("metric", metric).select("pid", "metric", cp.call(e - 0.2, e + F.col("r") / 2, F.col("metric")).alias("call"))


@query("p1_decode_time", f"{cte('fx_truth')} SELECT case_id, pid, CASE WHEN pid % 2 = 0 THEN make_timestamp(946728000000000 + pid*1500000) ELSE time END AS t FROM fx_truth")
def _(v, spark):
    even = F.col("pid") % 2 == 0
    x = v("fx_truth").select("case_id", "pid", F.when(even, F.col("pid") * 1.5).alias("seconds"), F.when(~even, F.col("time").cast("string")).alias("text"))
    return times.decode_time(x, "seconds", "text").select("case_id", "pid", "t")


@query("p2_decode_lidar_utc", f"{cte('fx_truth')}, x AS (SELECT case_id, pid, 190000.0::DOUBLE + 100*(1 + pid % 12) + 1 + pid % 28 + ((pid*7919) % 86400)/86400.0::DOUBLE AS t FROM fx_truth) SELECT case_id, pid, make_timestamp(2019, floor(t/100)::BIGINT % 100, floor(t)::BIGINT % 100, 0, 0, 0) + to_microseconds(round((t - floor(t))*86400e6)::BIGINT) AS t FROM x")
def _(v, spark):
    lidar = F.lit(190000.0) + 100 * (1 + F.col("pid") % 12) + 1 + F.col("pid") % 28 + (F.col("pid") * 7919) % 86400 / F.lit(86400.0)
    return times.decode_lidar_utc(v("fx_truth").withColumn("lidar", lidar), "lidar").select("case_id", "pid", "t")


@query(
    "p13_scan_mode",
    f"{cte('fx_scans')} SELECT scan_id, CASE WHEN scan_id % 3 = 0 THEN 6 ELSE 3 END AS mode FROM fx_scans WHERE scan_id % 3 < 2",
)
def _(v, spark):
    k, scan = F.col("scan_id") % 3, v("fx_scans")
    x = scan.select("scan_id", F.when(k == 0, "OR_ABI-L2-CMIPF-M6C13").alias("dataset_name"), F.lit("x").alias("filename"), F.lit(None).cast("string").alias("id"), F.when(k == 1, "ABI Mode 3").alias("timeline_id"))
    return times.scan_mode(x).select("scan_id", "mode")


@query("j3_scan_window", f"{cte('fx_scans')} SELECT scan_id, CASE WHEN scan_id % 2 = 0 THEN t ELSE t - INTERVAL 5 MINUTE END AS w0, CASE WHEN scan_id % 2 = 0 THEN t + INTERVAL 1 MINUTE ELSE t END AS w1 FROM fx_scans")
def _(v, spark):
    shift = lambda m: F.col("t") + F.expr(f"INTERVAL {m} MINUTE")
    x = v("fx_scans").select("scan_id", F.col("t").alias("b0"), F.when(F.col("scan_id") % 2 == 0, shift(1)).otherwise(F.col("t")).alias("b1"), shift(-5).alias("c0"), F.col("t").alias("c1"))
    return times.scan_window(x).select("scan_id", "w0", "w1")


_VZA = (
    f"{_L}, a AS (SELECT *, {_ecef('0.0')} FROM fx_lattice), b AS (SELECT *, s.lon0, 42164160.0*cos(radians(lon0)) - px AS dx, 42164160.0*sin(radians(lon0)) - py AS dy, -pz AS dz, radians(lat) AS p, radians(lon) AS l FROM a, (VALUES (-75.2::DOUBLE), (-137.2)) s(lon0)), "
    "z AS (SELECT pid, degrees(acos(greatest(-1.0, least(1.0, (dx*cos(p)*cos(l) + dy*cos(p)*sin(l) + dz*sin(p))/sqrt(dx*dx + dy*dy + dz*dz))))) AS vza FROM b), st AS (SELECT pid, sqrt(avg(1/pow(cos(radians(vza)), 2))) AS stretch, max(vza) AS vza_max FROM z GROUP BY pid)"
)


@query("p19_footprint_stretch", f"{_VZA} SELECT pid, {_out(vza_max='vza_max', stretch='stretch')} FROM st WHERE vza_max <= 85")
def _(v, spark):
    return geo.footprint_stretch(v("fx_lattice")).where("vza_max <= 85").select("pid", "vza_max", "stretch")


@query("g3_height_candidates", f"{cte('fx_cases_a')} SELECT case_id, h_idx::INT AS h_idx, 8.0 + h_idx*0.25 AS h FROM fx_cases_a, range(33) t(h_idx)")
def _(v, spark):
    return geo.height_candidates(v("fx_cases_a").select("case_id"))


@query("j14_near_point", f"{cte('fx_truth')}, d AS (SELECT case_id, pid, sqrt(pow((lat - 30.1)*111.0, 2) + pow((lon + 119.9)*111.0*cos(radians(30.1)), 2)) AS km FROM fx_truth) SELECT case_id, pid, {_out(km='km')} FROM d WHERE km < 60")
def _(v, spark):
    return geo.near_point(v("fx_truth"), 30.1, -119.9, 60.0).select("case_id", "pid", "km")


from . import imagery, matching, stored  # noqa: E402, F401  they register the queries of images, of heights from them, and of stored tables
