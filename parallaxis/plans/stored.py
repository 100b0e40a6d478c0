"""Queries over stored tables: what is written is derived from the driver's tables, then scanned, joined and checked."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cases as cs, matching as mc, timing as tm
from ..sources import tables as tb
from .fixtures import cte
from .registry import _RUN, _out, query

_IMAGERY = "px AS (SELECT img::BIGINT AS scan_id, CASE WHEN img = 0 THEN 16 ELSE 17 END AS sat, 13 + 2*CAST(j % 2 AS INT) AS ch, TIMESTAMP '2019-03-01 12:00:00' + i*INTERVAL 1 HOUR AS t, i, j, btd FROM fx_pixels)"


@query(
    "s1_scan_pixels",
    f"{cte('fx_pixels')}, {_IMAGERY} SELECT scan_id, sat, ch, t, i::INT AS \"row\", j::INT AS col, {_out(x_rad='0.001*j', y_rad='0.002*i')}, round(btd::FLOAT::DOUBLE, 6) + 0.0 AS cmi FROM px WHERE sat = 16 AND ch = 13 AND t >= TIMESTAMP '2019-03-02 00:00:00' AND t < TIMESTAMP '2019-03-03 00:00:00'",
)
def _(v, spark):
    t = F.timestamp_micros(F.unix_micros(F.lit("2019-03-01 12:00:00").cast("timestamp")) + F.col("i") * 3_600_000_000).cast("timestamp_ntz")
    x = v("fx_pixels").select(
        F.col("img").cast("long").alias("scan_id"), F.when(F.col("img") == 0, 16).otherwise(17).alias("sat"), (13 + 2 * (F.col("j") % 2)).cast("int").alias("ch"), t.alias("t"),
        F.col("i").cast("int").alias("row"), F.col("j").cast("int").alias("col"), (F.col("j") * 0.001).alias("x_rad"), (F.col("i") * 0.002).alias("y_rad"), F.coalesce(F.col("btd").cast("float"), F.lit(float("nan")).cast("float")).alias("cmi"),
    )
    path = tb.scratch(spark, "pixels")
    tb.write_pixels(x, path)
    out = tb.scan_pixels(spark, path, (16,), (13,), "2019-03-02 00:00:00", "2019-03-03 00:00:00").drop("date")
    return out.withColumn("cmi", F.col("cmi").cast("double"))


@query("s2_scan_collocations", f"{cte('fx_truth')} SELECT pid, case_id, time, {_out(lat='lat', lon='lon', top_km='top_km*1000/1000')} FROM fx_truth WHERE lon > -115.0 AND lon < -105.0 AND lat > 28.0 AND lat < 40.0 AND year(time) >= 2024")
def _(v, spark):
    path = tb.scratch(spark, "collocations")
    v("fx_truth").withColumn("top_m", F.col("top_km") * 1000).drop("top_km").write.parquet(path)
    return tb.scan_collocations(spark, path, (-115.0, -105.0), (28.0, 40.0), 2024)


@query("s3_scan_wind_fields", f"{cte('fx_fields')}, f AS (SELECT * FROM fx_fields WHERE NOT (level = 250 AND hour(time) % 3 = 0)), w AS (SELECT time FROM f GROUP BY time HAVING count(DISTINCT level) = 3) SELECT f.time, level, {_out(lat='lat', lon='lon', u='u', v='v', z='z')} FROM f JOIN w ON w.time = f.time")
def _(v, spark):
    path = tb.scratch(spark, "winds")
    v("fx_fields").where("not (level = 250 and hour(time) % 3 = 0)").write.parquet(path)
    return tb.scan_wind_fields(spark, path, (200, 250, 300), skip=True)


@query("s3_wind_field_faults", f"{cte('fx_fields')}, f AS (SELECT * FROM fx_fields WHERE NOT (level = 250 AND hour(time) % 3 = 0)) SELECT time, array_to_string(list(DISTINCT level ORDER BY level), ',') AS have FROM f GROUP BY time HAVING count(DISTINCT level) < 3")
def _(v, spark):
    faults = tb.wind_field_faults(v("fx_fields").where("not (level = 250 and hour(time) % 3 = 0)"), (200, 250, 300))
    return faults.select("time", F.array_join(F.col("have").cast("array<string>"), ",").alias("have"))


@query("s4_scan_time_lut", f"{cte('fx_lut')} SELECT r0 AS \"row\", c0 AS col, round(sec::DOUBLE, 6) + 0.0 AS sec, tbl, var FROM fx_lut WHERE tbl = 'Timeline03C_Mode3_20180828-092953.nc'")
def _(v, spark):
    path = tb.scratch(spark, "lut")
    v("fx_lut").withColumnsRenamed({"r0": "row", "c0": "col"}).write.partitionBy("tbl", "var").parquet(path)
    return tb.scan_time_lut(spark, path, (tm.M3,)).withColumn("sec", F.col("sec").cast("double"))


@query(
    "s5_read_case_results",
    f"{cte('pa', 'fx_cases_a')}, l AS (SELECT p.case_id, p.pid AS commit_seq, c.qc, p.h AS h_median, c.offset_s, row_number() OVER (PARTITION BY p.case_id ORDER BY p.pid DESC) AS k FROM pa p JOIN fx_cases_a c ON c.case_id = p.case_id) SELECT case_id, commit_seq, qc, {_out(h_median='h_median', offset_s='offset_s')} FROM l WHERE k = 1",
)
def _(v, spark):
    path = tb.scratch(spark, "commits")
    log = v("pa").join(v("fx_cases_a"), "case_id").select("case_id", F.col("pid").alias("commit_seq"), "qc", F.col("h").alias("h_median"), "offset_s")
    log.write.json(path)
    return tb.read_case_results(spark, path).select("case_id", "commit_seq", "qc", "h_median", "offset_s")


@query(
    "s5_plain_log",
    f"{cte('pa', 'fx_cases_a')}, l AS (SELECT p.case_id, c.qc, p.h AS h_median, p.s_eff, row_number() OVER (PARTITION BY p.case_id ORDER BY p.pid DESC) AS k FROM pa p JOIN fx_cases_a c ON c.case_id = p.case_id) SELECT case_id, qc, {_out(h_median='h_median', psf_gsd='s_eff')} FROM l WHERE k = 1",
)
def _(v, spark):
    """A log without numbers of commits: lines in the order of pid over several files, each in splits of its own."""
    path = tb.scratch(spark, "log")
    x = v("pa").join(v("fx_cases_a"), "case_id").select("pid", "case_id", "qc", F.col("h").alias("h_median"), F.col("s_eff").alias("psf_gsd"))
    x.repartitionByRange(5, "pid").sortWithinPartitions("pid").drop("pid").write.json(path)
    return tb.read_case_results(spark, path).select("case_id", "qc", "h_median", F.col("extra")["psf_gsd"].alias("psf_gsd"))


@query(
    "s6_read_profiles",
    f"{cte('pa', 'fx_cases_a')}, x AS (SELECT case_id, pid, top_km, h, r, NULL::DOUBLE AS s_eff, 0 AS k FROM pa WHERE pid % 3 <> 1 UNION ALL SELECT case_id, pid, top_km, h + 1, r, s_eff, 1 FROM pa WHERE pid % 3 <> 2), l AS (SELECT x.*, row_number() OVER (PARTITION BY case_id, pid ORDER BY k DESC) AS n FROM x) "
    f"SELECT l.case_id, pid, {_out(top_km='top_km', h='h', r='r', s_eff='s_eff')} FROM l JOIN fx_cases_a c ON c.case_id = l.case_id AND c.qc <> 'error' WHERE n = 1",
)
def _(v, spark):
    old, new = tb.scratch(spark, "profiles"), tb.scratch(spark, "profiles")
    pa = v("pa")
    pa.where("pid % 3 <> 1").select("case_id", "pid", "top_km", "h", "r").write.option("header", True).csv(old)
    pa.where("pid % 3 <> 2").select("pid", "case_id", "s_eff", "top_km", (F.col("h") + 1).alias("h"), "r").write.option("header", True).csv(new)
    return tb.read_profiles(spark, [old, new], v("fx_cases_a").where("qc <> 'error'")).select("case_id", "pid", "top_km", "h", "r", "s_eff")


@query(
    "s7_write_run",
    f"{cte('pa', 'fx_cases_a')}, g AS (SELECT *, case_id IN (SELECT case_id FROM fx_cases_a WHERE vza_max > 60) AS again FROM pa) SELECT case_id, count(*) AS n, max(CASE WHEN again THEN 2 ELSE 1 END)::BIGINT AS commit_seq, {_out(h='sum(CASE WHEN again THEN h + 1 ELSE h END)')} FROM g GROUP BY case_id",
)
def _(v, spark):
    path = tb.scratch(spark, "run")
    cases, pa = v("fx_cases_a"), v("pa").select("case_id", "pid", "h")
    first = pa.withColumn("h", F.coalesce("h", F.lit(float("nan"))))
    for _ in range(2):  # a retry of what is committed changes nothing
        tb.write_run(cases, first, path, "a", "0123456789", 1)
    again = cases.where("vza_max > 60")
    tb.write_run(again, pa.join(again.select("case_id"), "case_id", "left_semi").withColumn("h", F.col("h") + 1), path, "a", "0123456789", 2)
    mark = {"variant": "a", "config_hash": "0123456789", "attempt": "crashed", "commit_seq": 3}
    pa.withColumns({k: F.lit(x) for k, x in mark.items()}).withColumn("commit_seq", F.lit(3).cast("long")).write.mode("append").partitionBy("variant", "config_hash", "attempt").parquet(f"{path}/profiles")  # a crash before the commit
    profiles = tb.read_run(spark, path, "a", "0123456789")[1]
    return profiles.groupBy("case_id").agg(F.count("*").alias("n"), F.max("commit_seq").alias("commit_seq"), F.sum("h").alias("h"))


@query("s8_write_maps", f"{cte('fx_pixels')} SELECT substr(sha1(concat('case_', img::VARCHAR)), 1, 12) AS key, concat('case_', img::VARCHAR) AS case_id, i, j, {_out(height='btd')} FROM fx_pixels WHERE img = 1")
def _(v, spark):
    path = tb.scratch(spark, "maps")
    maps = v("fx_pixels").select(F.concat(F.lit("case_"), F.col("img").cast("string")).alias("case_id"), "i", "j", F.col("btd").alias("height"))
    tb.write_maps(maps.withColumn("height", F.col("height") + 1), path)
    tb.write_maps(maps.where("case_id = 'case_1'"), path)  # takes the place of the first
    return tb.read_map(spark, path, "case_1").select("key", "case_id", "i", "j", "height")


@query("s8_read_maps", f"{cte('fx_pixels')} SELECT substr(sha1(concat('case_', img::VARCHAR)), 1, 12) AS key, i, j, {_out(height='CASE WHEN img = 1 THEN btd ELSE btd + 1 END')} FROM fx_pixels")
def _(v, spark):
    path = tb.scratch(spark, "maps")
    maps = v("fx_pixels").select(F.concat(F.lit("case_"), F.col("img").cast("string")).alias("case_id"), "i", "j", F.col("btd").alias("height"))
    tb.write_maps(maps.withColumn("height", F.col("height") + 1), path)
    tb.write_maps(maps.where("case_id = 'case_1'"), path)
    return tb.read_maps(spark, path).select("key", "i", "j", "height")


@query(
    "s9_append_experiment_log",
    f"{_RUN} SELECT a, b, 'h_a' AS hash_a, 'h_b' AS hash_b, 0.6::DOUBLE AS gate, 'ok,offset' AS qc, 'dev' AS split, 7 AS n_cases, note, metric, round(value, 6) + 0.0 AS value FROM (SELECT 'n' AS metric, count(*)::DOUBLE AS value FROM pa UNION ALL SELECT 'top', sum(top_km) FROM pa) m, (VALUES ('A', 'B', 'first'), ('B', 'A', 'second')) l(a, b, note)",
)
def _(v, spark):
    path = tb.scratch(spark, "log")
    x = v("pa").agg(F.count("*").cast("double").alias("n"), F.sum("top_km").alias("top"))
    table = x.select(F.explode(F.create_map(F.lit("n"), F.col("n"), F.lit("top"), F.col("top"))).alias("metric", "value"))
    for names, note in ((("A", "B"), "first"), (("B", "A"), "second")):
        tb.append_experiment_log(table, path, names, ("h_a", "h_b"), 0.6, ("ok", "offset"), 7, note=note)
    return spark.read.parquet(path).drop("logged")


_LEGACY = """, k AS (SELECT case_id, qc, vza_max, offset_s, dense_rank() OVER (ORDER BY case_id) AS scene FROM fx_cases_a), t AS (SELECT x.case_id, x.pid, x.lat, x.lon, x.top_km, k.scene, round_even(x.lat*1e5, 0)::BIGINT AS a, round_even(x.lon*1e5, 0)::BIGINT AS b FROM fx_truth x JOIN k ON k.case_id = x.case_id),
 o AS (SELECT t.scene, t.a, t.b, p.h, p.r, row_number() OVER (PARTITION BY t.scene, t.a, t.b ORDER BY t.pid) AS n FROM t JOIN pa p ON p.case_id = t.case_id AND p.pid = t.pid WHERE t.pid % 5 > 0)"""


@query("s10_import_legacy", f"{cte('fx_truth', 'pa', 'fx_cases_a')}{_LEGACY} SELECT t.case_id, t.pid, {_out(h='o.h', r='o.r')} FROM t LEFT JOIN o ON o.scene = t.scene AND o.a = t.a AND o.b = t.b AND o.n = 1")
def _(v, spark):
    from pyspark.sql import Window

    cases = v("fx_cases_a").withColumn("scene", F.dense_rank().over(Window.orderBy("case_id")))
    results = cases.select("scene", F.when(F.col("qc") == "error", "low_edge").otherwise(F.col("qc")).alias("qc"), F.col("vza_max").alias("vza_east"), (F.col("vza_max") - 1).alias("vza_west"))
    truth = v("fx_truth")
    old = v("pa").where("pid % 5 > 0").join(cases.select("case_id", "scene"), "case_id").select("scene", "lat", "lon", F.col("h").alias("h_map"), F.col("r").alias("r_map"), F.col("pid").alias("line"))
    return tb.import_legacy(results, old, cases.select("scene", "case_id"), truth.drop("time"))[1].select("case_id", "pid", "h", "r")


@query(
    "s11_register_variants",
    f"{cte('fx_gates')} SELECT round(gate, 6) + 0.0 AS gate, substr(sha256('{{\"channels\": [13, 15], \"gate\": ' || CASE WHEN round(gate*100)::BIGINT % 10 = 0 THEN '0.' || (round(gate*10)::BIGINT)::VARCHAR ELSE '0.' || (round(gate*100)::BIGINT)::VARCHAR END || ', \"limit\": 30.0, \"mode\": \"native\"}}'), 1, 10) AS config_hash FROM fx_gates",
)
def _(v, spark):
    x = v("fx_gates").withColumn("config", F.struct(F.lit("native").alias("mode"), F.col("gate").cast("decimal(10,2)").cast("double").alias("gate"), F.lit(30.0).alias("limit"), F.array(F.lit(13), F.lit(15)).alias("channels")))
    return cs.config_hash(x).select("gate", "config_hash")


@query("s13_adhoc_case", f"{cte('fx_truth')}, b AS (SELECT max(time) AS time, min(lat) AS lat0, max(lat) AS lat1, min(lon) AS lon0, max(lon) AS lon1 FROM fx_truth) SELECT concat('adhoc_', strftime(time, '%Y%m%dT%H%M%S')) AS case_id, time, {_out(lat0='lat0', lat1='lat1', lon0='lon0', lon1='lon1', anchor_lat='(lat0 + lat1)/2', anchor_lon='(lon0 + lon1)/2')} FROM b")
def _(v, spark):
    b = v("fx_truth").agg(F.max("time").alias("t"), F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("d")).first()
    return tb.adhoc_case(spark, str(b.t), b.a, b.b, b.c, b.d)


_SPANS = "sp AS (SELECT case_id, min(time) AS a, max(time) AS b, min(lat) AS la0, max(lat) AS la1, min(lon) AS lo0, max(lon) AS lo1 FROM (SELECT * FROM fx_truth WHERE pid % 400 < 3) GROUP BY case_id)"


@query("s14_scan_lidar_curtain", f"{cte('fx_truth')}, {_SPANS} SELECT s.case_id, t.pid AS idx, {_out(beta='t.top_km/100')} FROM fx_truth t JOIN sp s ON t.time >= s.a - INTERVAL 20 SECOND AND t.time <= s.b + INTERVAL 20 SECOND WHERE s.b - s.a < INTERVAL 1 DAY")
def _(v, spark):
    truth = v("fx_truth")
    short = truth.where("pid % 400 < 3")
    spans = short.groupBy("case_id").agg((F.max("time") - F.min("time")).alias("d")).where(F.col("d") < F.expr("INTERVAL 1 DAY"))
    curtain = truth.select(F.col("pid").alias("idx"), F.col("time").alias("t"), (F.col("top_km") / 100).alias("beta"))
    return tb.scan_lidar_curtain(curtain, short.join(spans.select("case_id"), "case_id", "left_semi")).select("case_id", "idx", "beta")


@query(
    "s15_scan_granule_index",
    f"{cte('fx_truth')}, {_SPANS}, g AS (SELECT concat('g', (pid // 100)::VARCHAR) AS granule, min(time) AS g0, min(time) + INTERVAL 2 HOUR AS g1, min(lat) AS lat0, min(lat) + 3 AS lat1, min(lon) AS lon0, min(lon) + 3 AS lon1 FROM fx_truth GROUP BY pid // 100) "
    "SELECT DISTINCT s.case_id, granule FROM sp s JOIN g ON g0 <= b + INTERVAL 3 MINUTE AND g1 >= a - INTERVAL 3 MINUTE AND lat0 <= la1 + 1 AND lat1 >= la0 - 1 AND lon0 <= lo1 + 1 AND lon1 >= lo0 - 1",
)
def _(v, spark):
    truth = v("fx_truth")
    k = F.floor(F.col("pid") / 100)
    hours = F.min("time") + F.expr("INTERVAL 2 HOUR")
    g = truth.groupBy(k.alias("k")).agg(F.min("time").alias("g0"), hours.alias("g1"), F.min("lat").alias("lat0"), (F.min("lat") + 3).alias("lat1"), F.min("lon").alias("lon0"), (F.min("lon") + 3).alias("lon1"))
    return tb.scan_granule_index(g.withColumn("granule", F.concat(F.lit("g"), F.col("k").cast("string"))).drop("k"), truth.where("pid % 400 < 3"))


@query("g23_lidar_bin", f"{cte('fx_truth')}, c AS (SELECT pid AS idx, floor(top_km) AS alt_km, lat, (pid % 97)/1000.0 AS beta FROM fx_truth WHERE top_km BETWEEN 9 AND 12.5) SELECT idx // 7 AS bin, alt_km + 0.0 AS alt_km, {_out(lat='avg(lat)', beta='greatest(avg(beta), 0.04)')} FROM c WHERE alt_km BETWEEN 9 AND 12 GROUP BY idx // 7, alt_km HAVING count(*) = 2")
def _(v, spark):
    x = v("fx_truth").where("top_km between 9 and 12.5").select(F.lit("one").alias("granule"), F.col("pid").alias("idx"), F.floor("top_km").cast("double").alias("alt_km"), "lat", (F.col("pid") % 97 / 1000).alias("beta"))
    return mc.lidar_bin(x, 7, 0.04, (9.0, 12.0), whole=2).drop("granule")


@query("q5_case_diagnostics", f"{cte('fx_pixels', 'fx_truth')}, s AS (SELECT concat('case_', img::VARCHAR) AS case_id, max(abs(btd)) AS stripe_max, count(*) FILTER (btd > 0.0005 AND j = 0)::BIGINT AS stripe_rows, avg((btd IS NOT NULL)::INT) AS map_coverage FROM fx_pixels GROUP BY img), c AS (SELECT case_id, count(*) AS n, min(lat) AS la, max(lon) AS lo FROM fx_truth GROUP BY case_id) "
    f"SELECT c.case_id, n::INT AS grid_ny, 2*n::INT AS grid_nx, coalesce(stripe_rows, 0) AS stripe_rows, {_out(offset_s='la', vza_east='la', vza_west='-lo', vza_max='greatest(la, -lo)', stripe_max='stripe_max', map_coverage='map_coverage', valid_frac='la/100')}, 'C' AS domain_east, 'F' AS domain_west FROM c LEFT JOIN s ON s.case_id = c.case_id")
def _(v, spark):
    c = v("fx_truth").groupBy("case_id").agg(F.count("*").cast("int").alias("n"), F.min("lat").alias("la"), F.max("lon").alias("lo"))
    pixels = v("fx_pixels").withColumn("case_id", F.concat(F.lit("case_"), F.col("img").cast("string")))
    cases = c.select("case_id", F.col("la").alias("offset_s"), F.lit("C").alias("domain_east"), F.lit("F").alias("domain_west"), F.col("la").alias("vza_east"), (-F.col("lo")).alias("vza_west"))
    stripes = pixels.select("case_id", F.abs("btd").alias("score"), F.coalesce((F.col("btd") > 0.0005) & (F.col("j") == 0), F.lit(False)).alias("flagged"))
    return mc.case_diagnostics(cases, stripes, pixels.withColumnRenamed("btd", "height"), c.select("case_id", (F.col("la") / 100).alias("valid_frac")), c.select("case_id", F.col("n").alias("n_lat"), (2 * F.col("n")).cast("int").alias("n_lon")))


@query("q7_obs_mask", f"{cte('pa')} SELECT case_id, pid, {_out(height='CASE WHEN s_eff >= 1.2 THEN h END', s_eff='s_eff')} FROM pa")
def _(v, spark):
    return mc.obs_mask(v("pa").select("case_id", "pid", F.col("h").alias("height"), "s_eff"), 1.2)


@query("q8_isolate_errors", f"{cte('fx_cases_a')} SELECT case_id, CASE WHEN vza_max >= 70 THEN 'view too low' WHEN abs(offset_s) > 8 THEN 'frames too far apart' END AS error, CASE WHEN vza_max >= 70 OR abs(offset_s) > 8 THEN 'error' ELSE qc END AS qc FROM fx_cases_a")
def _(v, spark):
    checks = {"view too low": F.col("vza_max") < 70, "frames too far apart": F.abs("offset_s") <= 8}
    return mc.isolate_errors(v("fx_cases_a"), checks).select("case_id", "error", "qc")


@query(
    "q8_unreadable_inputs",
    f"{cte('fx_cases_a')}, v AS (SELECT unnest(['hp', 'native']) AS variant) SELECT case_id, variant, CASE WHEN vza_max >= 65 THEN concat('unreadable input lost-', case_id) END AS error, CASE WHEN vza_max >= 65 THEN 'error' ELSE qc END AS qc FROM fx_cases_a, v",
)
def _(v, spark):
    """Inputs of which some are listed but can't be read; two variants share them."""
    path = tb.scratch(spark, "inputs")
    v("pa").select("case_id", "pid", "h").repartition(8, "case_id").write.parquet(path)
    schema = "case_id string, pid long, h double"
    there = spark.read.schema(schema).parquet(path).groupBy("case_id", F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("own"))
    there = there.join(there.groupBy("file").agg(F.sum("own").alias("n_rows")), "file").select("case_id", "file", "n_rows")
    cases = v("fx_cases_a")
    lost = cases.where("vza_max >= 65").select("case_id", F.concat(F.lit("lost-"), "case_id").alias("file"), F.lit(5).cast("long").alias("n_rows"))
    faults = tb.read_listed(spark, path, schema, there.unionByName(lost))[1]
    variants = cases.withColumn("variant", F.explode(F.array(F.lit("hp"), F.lit("native"))))
    return mc.isolate_faults(variants, faults).select("case_id", "variant", "error", "qc")


@query("n8_shared_inputs", f"{cte('fx_cases_a')}, v AS (SELECT case_id AS name, qc AS prep, (vza_max > 60) AS native FROM fx_cases_a) SELECT prep, native, string_agg(name, ',' ORDER BY name) AS variants FROM v GROUP BY prep, native")
def _(v, spark):
    x = v("fx_cases_a").select(F.col("case_id").alias("name"), F.col("qc").alias("prep"), (F.col("vza_max") > 60).alias("native"))
    return mc.shared_inputs(x, ("prep", "native")).select("prep", "native", F.array_join("variants", ",").alias("variants"))

