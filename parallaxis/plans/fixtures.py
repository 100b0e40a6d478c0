"""Stand-ins for the library's tables, as views over the driver's tables; the same SQL runs in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: In this order a view needs only those before it.
VIEWS = {
    "fx_truth": """SELECT concat('case_', CAST(user_id AS VARCHAR(20))) AS case_id, event_id AS pid, ts AS time,
 26.0E0 + (user_id % 20) + 0.01E0*idx + 0.06E0*floor(idx/12E0) AS lat,
 -124.0E0 + (user_id % 27) + 0.003E0*idx AS lon,
 8.0E0 + ((event_id*7919) % 6000)/1000.0E0 AS top_km
 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS idx FROM events) e""",
    "fx_run_a": """SELECT concat('case_', CAST(user_id AS VARCHAR(20))) AS case_id, event_id AS pid,
 CASE WHEN (event_id*104729) % 11 = 0 THEN NULL ELSE
  8.0E0 + ((event_id*7919) % 6000)/1000.0E0 + (((event_id*104729) % 2001) - 1000)/1000.0E0 + (((user_id*31) % 21) - 10)/20.0E0 END AS h,
 ((event_id*15485863) % 1000)/1000.0E0 AS r, ((event_id*104735) % 250)/100.0E0 AS s_eff
 FROM events""",
    "fx_cases_a": """SELECT concat('case_', CAST(user_id AS VARCHAR(20))) AS case_id,
 CASE WHEN user_id % 17 = 3 THEN 'error' WHEN user_id % 13 = 3 THEN 'no_data' WHEN user_id % 11 = 3 THEN 'coverage'
      WHEN user_id % 7 = 3 THEN 'offset' ELSE 'ok' END AS qc,
 45.0E0 + (user_id % 30) AS vza_max, ((user_id*37) % 200 - 100)/10.0E0 AS offset_s
 FROM (SELECT DISTINCT user_id FROM events) u""",
    "fx_run_b": """SELECT concat('case_', CAST(user_id AS VARCHAR(20))) AS case_id, event_id AS pid,
 CASE WHEN (event_id*130363) % 11 = 0 THEN NULL ELSE
  8.0E0 + ((event_id*7919) % 6000)/1000.0E0 + (((event_id*130363) % 2001) - 1000)/1000.0E0 + (((user_id*31) % 21) - 10)/20.0E0 END AS h,
 ((event_id*32452843) % 1000)/1000.0E0 AS r, ((event_id*130369) % 250)/100.0E0 AS s_eff
 FROM events""",
    "fx_cases_b": """SELECT concat('case_', CAST(user_id AS VARCHAR(20))) AS case_id,
 CASE WHEN user_id % 17 = 4 THEN 'error' WHEN user_id % 13 = 4 THEN 'no_data' WHEN user_id % 11 = 4 THEN 'coverage'
      WHEN user_id % 7 = 4 THEN 'offset' ELSE 'ok' END AS qc,
 45.0E0 + (user_id % 30) AS vza_max, ((user_id*37) % 200 - 100)/10.0E0 AS offset_s
 FROM (SELECT DISTINCT user_id FROM events) u""",
    "fx_pixels": """SELECT img, i, j, CASE WHEN (i*40 + j + img) % 37 = 0 THEN NULL ELSE cents/100.0E0/n/10000.0E0 END AS btd
 FROM (SELECT CAST(l_linenumber % 2 AS INT) AS img, l_partkey % 40 AS i, l_orderkey % 40 AS j, sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS cents, count(*) AS n
       FROM lineitem GROUP BY 1, 2, 3) p""",
    "fx_scans": """SELECT event_id AS scan_id, 16 + CAST(user_id % 2 AS INT) AS sat, CASE WHEN event_id % 3 = 0 THEN 'F' ELSE 'C' END AS domain, ts AS t
 FROM events WHERE event_type IN ('view', 'click')""",
    "fx_winds": """SELECT concat('case_', CAST(u.user_id AS VARCHAR(20))) AS case_id, p.p_partkey AS lvl, 6.0E0 + 0.5E0*p.p_partkey AS h,
 ((u.user_id*13 + p.p_partkey*7) % 60) - 10.0E0 AS u, ((u.user_id*29 + p.p_partkey*11) % 40) - 20.0E0 AS v
 FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN part p WHERE p.p_partkey < 21""",
    "fx_pair": """SELECT e.img, e.i, e.j, e.btd AS a, w.btd AS b FROM fx_pixels e LEFT JOIN fx_pixels w ON w.img = e.img AND w.i = e.i AND w.j = e.j - 2""",
    "fx_cube": """SELECT x.img, x.i, x.j, p.p_partkey AS h_idx, CASE WHEN (x.i*3 + x.j*5 + p.p_partkey + x.img) % 23 = 0 THEN NULL
 ELSE ((x.i*31 + x.j*17 + p.p_partkey*7919 + x.img*13) % 1000)/1000.0E0 END AS r, 0.1E0 + ((x.i + x.j + x.img) % 10)/20.0E0 AS amp
 FROM fx_pixels x CROSS JOIN part p WHERE p.p_partkey < 33""",
    "fx_channels": """SELECT img AS scan_id, CASE WHEN img = 0 THEN 16 ELSE 17 END AS sat, c.ch, CAST(i AS INT) AS i, CAST(j AS INT) AS j, btd*c.f + c.k AS cmi
 FROM fx_pixels CROSS JOIN (SELECT 11 AS ch, 1.5E0 AS f, 250.0E0 AS k UNION ALL SELECT 13, 3.0E0, 252.0E0 UNION ALL SELECT 14, 2.0E0, 251.0E0 UNION ALL SELECT 15, 2.5E0, 250.5E0) c WHERE (i + c.ch) % 11 > 0""",
    "fx_fields": """SELECT DISTINCT time, level, lat, lon, ((level*7 + y*13 + x*5 + k) % 60) - 10.0E0 AS u, ((level*3 + y*11 + x*17 + k) % 40) - 20.0E0 AS v, 9.80665E0*(16000.0E0 - 20.0E0*level + ((x + y + k) % 9)) AS z
 FROM (SELECT c.t0 + h.k*INTERVAL 1 HOUR AS time, h.k + hour(c.t0) AS k, l.level, (c.y + a.d) AS y, (c.x + b.d) AS x, (c.y + a.d)*0.25E0 AS lat, (c.x + b.d)*0.25E0 AS lon
  FROM (SELECT date_trunc('hour', min(time)) AS t0, CAST(floor(min(lat)/0.25E0) AS BIGINT) AS y, CAST(floor(min(lon)/0.25E0) AS BIGINT) AS x FROM fx_truth GROUP BY case_id) c
  CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) h CROSS JOIN (SELECT 200 AS level UNION ALL SELECT 250 UNION ALL SELECT 300) l
  CROSS JOIN (SELECT 0 AS d UNION ALL SELECT 1) a CROSS JOIN (SELECT 0 AS d UNION ALL SELECT 1) b) f""",
    "fx_lut": """SELECT t.tbl, t.var, CAST(i AS INT) AS r0, CAST(j AS INT) AS c0, CAST((i*40 + j)*t.f AS FLOAT) AS sec FROM (SELECT DISTINCT i, j FROM fx_pixels) p
 CROSS JOIN (SELECT 'ABI-Timeline05B_Mode 6A_20190612-183017.nc' AS tbl, 'FD' AS var, 0.25E0 AS f UNION ALL SELECT 'ABI-Timeline05B_Mode 6A_20190612-183017.nc', 'CONUS1', 0.125E0 UNION ALL SELECT 'ABI-Timeline05B_Mode 6A_20190612-183017.nc', 'CONUS2', 0.125E0
  UNION ALL SELECT '340_Timeline_05M_Mode6_v2.7.nc', 'FD', 0.25E0 UNION ALL SELECT '340_Timeline_05M_Mode6_v2.7.nc', 'CONUS1', 0.125E0 UNION ALL SELECT '340_Timeline_05M_Mode6_v2.7.nc', 'CONUS2', 0.125E0
  UNION ALL SELECT 'Timeline03C_Mode3_20180828-092953.nc', 'FD', 0.5E0 UNION ALL SELECT 'Timeline03C_Mode3_20180828-092953.nc', 'CONUS1', 0.125E0 UNION ALL SELECT 'ABI-Timeline04A_Mode 4_20181219-104006.nc', 'FD', 0.125E0) t""",
    "fx_gates": """SELECT (30 + 5*p_partkey)/100.0E0 AS gate FROM part WHERE p_partkey < 12""",
    "fx_ladder": """SELECT gate FROM fx_gates UNION ALL SELECT 1.5E0""",
    "pa": """SELECT t.case_id, t.pid, t.time, t.lat, t.lon, t.top_km, r.h, r.r, r.s_eff FROM fx_truth t JOIN fx_run_a r ON t.case_id = r.case_id AND t.pid = r.pid""",
    "pb": """SELECT t.case_id, t.pid, t.time, t.lat, t.lon, t.top_km, r.h, r.r, r.s_eff FROM fx_truth t JOIN fx_run_b r ON t.case_id = r.case_id AND t.pid = r.pid""",
    "fx_lattice": """SELECT pid, lat, lon FROM fx_truth""",
    "fx_sweep_gates": """SELECT (30 + 5*a.p_partkey)/100.0E0 AS gate, b.p_partkey*0.25E0 AS s_gate FROM part a CROSS JOIN part b WHERE a.p_partkey < 12 AND b.p_partkey < 7""",
    "fx_sweep_more": """SELECT gate, s_gate FROM fx_sweep_gates UNION ALL SELECT 1.5E0, p_partkey*0.25E0 FROM part WHERE p_partkey < 7""",
}
NEEDS = {
    "fx_ladder": ["fx_gates"], "fx_sweep_more": ["fx_sweep_gates"], "fx_lattice": ["fx_truth"], "fx_pair": ["fx_pixels"], "fx_cube": ["fx_pixels"], "fx_channels": ["fx_pixels"], "fx_fields": ["fx_truth"], "fx_lut": ["fx_pixels"], "pa": ["fx_truth", "fx_run_a"], "pb": ["fx_truth", "fx_run_b"],
}


def ordered(names: tuple[str, ...]) -> list[str]:
    wanted = set(names)
    for n in names:
        wanted.update(NEEDS.get(n, []))
    return [n for n in VIEWS if n in wanted]


def cte(*names: str) -> str:
    """A WITH clause of these views and what they need, open for more."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in ordered(names))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for t in ("events", "lineitem", "part"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(f"{cte(name)} SELECT * FROM {name}")
