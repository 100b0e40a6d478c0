"""A whole run on made scenes whose cloud heights are known: from scans and pixels to verdicts, maps, profiles and the stored run."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parallaxis.operators import geometry as geo, retrieve as rt
from parallaxis.sources import tables as tb

IFOV, N = 5.6e-5, 110
LAT, LON = 36.0, -105.0
#: case: height km, seconds between the views, wind (east, north) m/s
SCENES = {"still": (10.3, 0.0, None), "blown": (12.6, 40.0, (30.0, -20.0)), "late": (11.0, 600.0, None), "windless": (11.0, 30.0, None)}


def texture(spark, seed: int, lat, lon):
    rng = np.random.default_rng(seed)
    total = F.lit(0.0)
    for _ in range(14):
        length, turn, phase = rng.uniform(9, 32), rng.uniform(0, math.pi), rng.uniform(0, 2 * math.pi)
        north, east = (lat - LAT) * 111.0, (lon - LON) * 111.0 * math.cos(math.radians(LAT))
        total = total + F.sin((north * math.cos(turn) + east * math.sin(turn)) * (2 * math.pi / length) + phase)
    return total


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    scans, pixels = [], None
    cases = [(k, f"2020-06-01 {10 + n}:00:00") for n, k in enumerate(SCENES)] + [("unseen", "2020-06-01 20:00:00")]
    for n, (name, (height, apart, wind)) in enumerate(SCENES.items()):
        for sat in (16, 17):
            at = geo.geos_forward(geo.apparent_position(spark.createDataFrame([(LAT, LON)], "lat double, lon double"), 10.0, geo.SAT_LON[sat]), geo.SAT_LON[sat], "alat", "alon").first()
            scan_id, dt = 10 * n + sat - 15, apart if sat == 17 else 0.0
            x0, y0 = at.x_rad - N / 2 * IFOV, at.y_rad + N / 2 * IFOV
            scans.append((scan_id, sat, "C", f"2020-06-01 {10 + n}:{int(dt) // 60:02d}:{int(dt) % 60:02d}", x0, IFOV, y0, -IFOV))
            p = spark.range(N * N).select(F.floor(F.col("id") / N).cast("int").alias("row"), (F.col("id") % N).cast("int").alias("col"))
            p = p.withColumn("x_rad", x0 + F.col("col") * IFOV).withColumn("y_rad", y0 - F.col("row") * IFOV)
            p = geo.true_position(geo.geos_inverse(p, geo.SAT_LON[sat]).withColumnsRenamed({"glat": "alat", "glon": "alon"}), F.lit(height), geo.SAT_LON[sat])
            u, v = wind or (0.0, 0.0)
            lat, lon = F.col("tlat") - v * dt / 111000.0, F.col("tlon") - u * dt / (111000.0 * F.cos(F.radians("tlat")))
            warm = F.when((F.col("row") == 40) & (F.lit(sat) == 17), 300.0 + 40 * F.sin(F.col("col") * 2.0)).otherwise(260.0 + texture(spark, n, lat, lon))  # one striped row in the western view
            long = p.select(F.lit(scan_id).cast("long").alias("scan_id"), F.lit(sat).alias("sat"), F.explode(F.array(F.struct(F.lit(13).alias("ch"), warm.alias("cmi")), F.struct(F.lit(15).alias("ch"), F.lit(260.0).alias("cmi")))).alias("c"), "row", "col", "x_rad", "y_rad")
            long = long.select("scan_id", F.lit(f"2020-06-01 {10 + n}:00:00").cast("timestamp_ntz").alias("t"), "row", "col", "x_rad", "y_rad", F.col("c.cmi").cast("float").alias("cmi"), "sat", "c.ch")
            pixels = long if pixels is None else pixels.unionByName(long)
    path = str(tmp_path_factory.mktemp("imagery"))
    tb.write_pixels(pixels, path)
    pixels = tb.scan_pixels(spark, path, (16, 17), (13, 15), "2020-06-01 00:00:00", "2020-06-02 00:00:00")
    scans = spark.createDataFrame(scans, "scan_id long, sat int, domain string, t string, x0 double, dx double, y0 double, dy double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    boxes = {"still": (0.55, 0.68), "blown": (0.57, 0.72)}
    cases = spark.createDataFrame([(k, t, LAT - boxes.get(k, (0.55, 0.68))[0], LAT + boxes.get(k, (0.55, 0.68))[0], LON - boxes.get(k, (0.55, 0.68))[1], LON + boxes.get(k, (0.55, 0.68))[1], LAT, LON) for k, t in cases], "case_id string, time string, lat0 double, lat1 double, lon0 double, lon1 double, anchor_lat double, anchor_lon double")
    cases = cases.withColumn("time", F.col("time").cast("timestamp_ntz"))
    u, v = SCENES["blown"][2]
    fields = [(f"2020-06-01 {h}:00:00", level, LAT + 0.25 * a, LON + 0.25 * b, u, v, z * 9806.65) for h in (11, 12) for level, z in ((300, 9.0), (200, 12.0), (100, 16.0)) for a in (0, 1) for b in (0, 1)]
    fields = spark.createDataFrame(fields, "time string, level int, lat double, lon double, u double, v double, z double").withColumn("time", F.col("time").cast("timestamp_ntz"))
    truth = spark.createDataFrame([(k, f"2020-06-01 {10 + n}:00:10", 100 * n + i, LAT - 0.2 + 0.02 * i, LON + 0.01 * i, SCENES.get(k, (11.0,))[0]) for n, k in enumerate([*SCENES, "unseen"]) for i in range(20)], "case_id string, time string, pid long, lat double, lon double, top_km double").withColumn("time", F.col("time").cast("timestamp_ntz"))
    return cases, scans, pixels, fields, truth


@pytest.mark.parametrize("prep", ["hp", "psf_iso"])
def test_known_heights_come_back(spark, world, tmp_path, prep):
    cases, scans, pixels, fields, truth = world
    settings = rt.Settings(h_step=1.0, prep=prep, amp_min=0.05)
    path = str(tmp_path / "run")
    found = rt.run(path, "v", "h", 1, cases, scans, pixels, fields, truth, settings=settings)
    rows = {r.case_id: r for r in found.cases.collect()}
    assert {k: r.qc for k, r in rows.items()} == {"still": "ok", "blown": "ok", "late": "no_data", "windless": "error", "unseen": "error"}
    assert rows["windless"].error == "no wind profile" and rows["unseen"].error == "no scan of both satellites" and rows["late"].offset_s == 600.0
    for name in ("still", "blown"):
        r = rows[name]  # the striped row and the rows beside it are missing from the western view
        assert abs(r.h_median - SCENES[name][0]) < 0.25 and r.map_coverage > 0.6 and 0.8 < r.valid_frac < 0.95 and 3 <= r.stripe_rows <= 7 and 40 < r.vza_max < 60 and r.grid_ny >= 60
    if prep == "psf_iso":
        assert rows["still"].extra["psf_sigma_t_km"] > 0
    own, points = tb.read_run(spark, path, "v", "h")
    assert {r.case_id for r in own.collect()} == {*SCENES, "unseen"}
    points = points.collect()
    assert {r.case_id for r in points} == {"still", "blown", "late"} and all(r.h is None for r in points if r.case_id == "late")
    errors = [abs(r.h - r.top_km) for r in points if r.h is not None]
    assert len(errors) > 25 and np.median(errors) < 0.25
    assert all(r.disp_km > 0 for r in points if r.case_id == "blown") and all(r.disp_km is None for r in points if r.case_id == "still")
    assert tb.read_map(spark, f"{path}/fields", "still").where("s_eff > 0").count() > 1000


def test_a_run_in_which_nothing_can_be_retrieved(spark, world, tmp_path):
    cases, scans, pixels, fields, _ = world
    path = str(tmp_path / "run")
    found = rt.run(path, "v", "h", 1, cases.where("case_id in ('unseen', 'late', 'windless')"), scans, pixels, settings=rt.Settings(h_step=2.0))
    assert {r.case_id: r.qc for r in found.cases.collect()} == {"unseen": "error", "late": "no_data", "windless": "error"} and found.maps.count() == 0
    assert tb.read_run(spark, path, "v", "h")[0].count() == 3 and tb.read_maps(spark, f"{path}/fields").count() == 0
