"""Stores that survive a crash and a retry, and logs of which the last line counts, in whatever order Spark reads them."""

import json

import pytest
from pyspark.sql import functions as F

from parallaxis.sources import tables as tb

CASES = "case_id string, qc string, h_median double"
POINTS = "case_id string, pid long, h double"


def run_of(spark, n, add=0.0):
    return spark.createDataFrame([(f"c{k}", "ok", add + k) for k in range(n)], CASES), spark.createDataFrame([(f"c{k}", 10 * k + i, add + i) for k in range(n) for i in range(3)], POINTS)


def read(spark, path):
    cases, profiles = tb.read_run(spark, path, "v", "h")
    return sorted((r.case_id, r.h_median) for r in cases.collect()), sorted((r.case_id, r.pid, r.h) for r in profiles.collect())


@pytest.mark.parametrize("crash", ["profiles", "cases", "commits"])
def test_a_crash_at_any_point_and_a_retry_give_the_same_run(spark, tmp_path, monkeypatch, crash):
    path, first = str(tmp_path / "run"), run_of(spark, 3)
    tb.write_run(*first, path, "v", "h", 1)
    before = read(spark, path)
    assert len(before[0]) == 3 and len(before[1]) == 9

    from pyspark.sql.readwriter import DataFrameWriter

    write = DataFrameWriter.parquet

    def broken(self, target, *a, **k):
        if crash == "commits" and target.endswith("commits"):
            raise OSError("lost before the commit")
        write(self, target, *a, **k)
        if target.endswith(crash):
            raise OSError(f"lost after writing {crash}")

    again = run_of(spark, 2, 100.0)
    monkeypatch.setattr(DataFrameWriter, "parquet", broken)
    with pytest.raises(OSError):
        tb.write_run(*again, path, "v", "h", 2)
    monkeypatch.setattr(DataFrameWriter, "parquet", write)
    assert read(spark, path) == before
    for _ in range(2):
        tb.write_run(*again, path, "v", "h", 2)
    cases, points = read(spark, path)
    assert cases == [("c0", 100.0), ("c1", 101.0), ("c2", 2.0)] and len(points) == 9
    assert {h for c, _, h in points if c == "c0"} == {100.0, 101.0, 102.0}


def test_two_writers_of_one_commit_count_once(spark, tmp_path):
    """Both saw no commit and both wrote theirs: the first in the manifest counts, as a whole."""
    path = str(tmp_path / "run")
    tb.write_run(*run_of(spark, 2), path, "v", "h", 1)
    late = {"variant": "v", "config_hash": "h", "attempt": "late"}
    for name, df in zip(("cases", "profiles"), run_of(spark, 2, 50.0)):
        df.withColumn("commit_seq", F.lit(1).cast("long")).withColumns({k: F.lit(x) for k, x in late.items()}).write.mode("append").partitionBy(*late).parquet(f"{path}/{name}")
    tb.commit(spark.createDataFrame([("v", "h", 1)], "variant string, config_hash string, commit_seq long"), path, "late")
    cases, points = read(spark, path)
    assert cases == [("c0", 0.0), ("c1", 1.0)] and len(points) == 6


def test_an_unwritten_variant_has_no_rows(spark, tmp_path):
    path = str(tmp_path / "run")
    tb.write_run(*run_of(spark, 1), path, "v", "h", 1)
    assert [x.count() for x in tb.read_run(spark, path, "w", "h")] == [0, 0]


def maps(spark, ids, add):
    return spark.createDataFrame([(c, i, j, add + i + j) for c in ids for i in range(2) for j in range(2)], "case_id string, i int, j int, height double")


def test_maps_are_replaced_and_survive_a_lost_write(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "maps")
    tb.write_maps(maps(spark, "abcd", 0.0), path)
    tb.write_maps(maps(spark, "b", 10.0), path)
    tb.write_maps(maps(spark, ["b", "e"], 20.0), path)
    kept = lambda: {r.case_id: r.low for r in tb.read_maps(spark, path).groupBy("case_id").agg(F.min("height").alias("low"), F.count("*").alias("n")).where("n = 4").collect()}
    want = {"a": 0.0, "b": 20.0, "c": 0.0, "d": 0.0, "e": 20.0}
    assert kept() == want
    commit = tb.commit
    monkeypatch.setattr(tb, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        tb.write_maps(maps(spark, "ab", 99.0), path)
    monkeypatch.setattr(tb, "commit", commit)
    assert kept() == want
    assert sorted(r.height for r in tb.read_map(spark, path, "b").collect()) == [20.0, 21.0, 21.0, 22.0] and tb.read_map(spark, path, "zz").count() == 0


def test_stores_of_nothing(spark, tmp_path):
    """Runs without points or maps, and folders that nobody wrote to, have no rows."""
    path = str(tmp_path / "run")
    cases, points = run_of(spark, 2)
    assert [x.count() for x in tb.read_run(spark, path, "v", "h")] == [0, 0]
    tb.write_run(cases, points.where("false"), path, "v", "h", 1)
    own, none = tb.read_run(spark, path, "v", "h")
    assert own.count() == 2 and none.count() == 0 and "h" in none.columns
    store = str(tmp_path / "maps")
    assert tb.read_map(spark, store, "a").count() == 0 == tb.read_maps(spark, store).count()
    tb.write_maps(maps(spark, "a", 1.0).where("false"), store)
    assert tb.read_map(spark, store, "a").count() == 0 == tb.read_maps(spark, store).count()
    tb.write_maps(maps(spark, "a", 1.0), store)
    assert tb.read_map(spark, store, "a").count() == 4 == tb.read_maps(spark, store).count()


def test_the_last_line_wins_over_files_and_splits(spark, tmp_path):
    """A small file first and a large one second: Spark packs the large one first. Splits of a few hundred bytes deal a file over tasks."""
    log, csv = tmp_path / "log", tmp_path / "csv"
    log.mkdir(), csv.mkdir()
    line = lambda k, h, **more: json.dumps({"case_id": f"c{k}", "qc": "ok", "h_median": h, **more}) + "\n"
    (log / "a.jsonl").write_text(line(0, 5.0) + line(1, 6.0))
    (log / "b.jsonl").write_text("".join(line(k % 40, float(n), psf_gsd=1.5, note="x") for n, k in enumerate(range(4000)) if k % 40 != 0) + '{"case_id": "c1", "qc"')
    (csv / "a.csv").write_text("case_id,pid,top_km,h,r\nc1,1,9,10,0.5\nc1,2,9,11,nan\n")
    (csv / "b.csv").write_text("case_id,pid,top_km,h,r\n" + "".join(f"c1,{k % 50 + 2},9,{n},0.7\n" for n, k in enumerate(range(5000))) + "c9,1,9,1,0.7\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        cases = {r.case_id: r for r in tb.read_case_results(spark, str(log)).collect()}
        assert len(cases) == 40 and cases["c0"].h_median == 5.0 and cases["c0"].extra == {}
        assert all(cases[f"c{k}"].h_median == 3960.0 + k for k in range(1, 40)) and cases["c1"].extra == {"psf_gsd": 1.5} and cases["c1"].commit_seq is None
        points = {r.pid: r for r in tb.read_profiles(spark, [str(csv)], spark.createDataFrame([("c1",)], "case_id string")).collect()}
        assert len(points) == 51 and points[1].h == 10.0 and all(points[k + 2].h == 4950.0 + k for k in range(50)) and points[1].s_eff is None
        turned = {r.pid: r.h for r in tb.read_profiles(spark, [str(csv / "b.csv"), str(csv / "a.csv")], spark.createDataFrame([("c1",)], "case_id string")).collect()}
        assert turned[2] == 11.0 and turned[3] == 4951.0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_broken_files_stop_no_other_case(spark, tmp_path):
    from parallaxis.operators.matching import isolate_faults

    folder, rows = tmp_path / "in", {}
    folder.mkdir()
    for name, n in (("a", 10), ("b", 10), ("c", 20_000), ("d", 0)):
        spark.createDataFrame([(k, float(k)) for k in range(n)], "pid long, h double").coalesce(1).write.parquet(str(tmp_path / name))
        part = next((tmp_path / name).glob("*.parquet"))
        rows[name] = part.read_bytes()
        (folder / f"{name}.parquet").write_bytes(rows[name] if name != "b" else rows[name][: len(rows[name]) // 2])
    listing = spark.createDataFrame([("one", "a.parquet", 10), ("two", "b.parquet", 10), ("two", "a.parquet", 10), ("three", "c.parquet", 20_001), ("four", "d.parquet", 0), ("five", "gone.parquet", 3)], "case_id string, file string, n_rows long")
    read, faults = tb.read_listed(spark, str(folder), "pid long, h double", listing)
    assert {(r.case_id, r.reason) for r in faults.collect()} == {("two", "unreadable input b.parquet"), ("three", "incomplete input c.parquet"), ("five", "unreadable input gone.parquet")}
    assert {r.file for r in read.select("file").distinct().collect()} == {"a.parquet"} and read.count() == 10
    cases = spark.createDataFrame([(c, v, "ok", "too low" if (c, v) == ("two", "y") else None) for c in ("one", "two", "three", "four", "five") for v in "xy"], "case_id string, variant string, qc string, error string")
    got = {(r.case_id, r.variant): (r.qc, r.error) for r in isolate_faults(cases, faults).collect()}
    assert got["one", "x"] == ("ok", None) == got["four", "y"] and got["two", "x"] == ("error", "unreadable input b.parquet") and got["two", "y"] == ("error", "too low")
    assert got["five", "x"][0] == got["five", "y"][0] == got["three", "x"][0] == "error"
    assert len(tb.read_listed(spark, str(folder), "pid long, h double", listing.drop("n_rows"))[1].collect()) == 3  # an empty file is then one that gave nothing


def test_wind_fields_of_other_levels_stop_a_run(spark, tmp_path):
    path = str(tmp_path / "winds")
    rows = [(t, level, 1.0) for t in ("2020-01-01 00:00:00", "2020-01-01 01:00:00") for level in (200, 250) if not (t.endswith("01:00:00") and level == 250)]
    x = spark.createDataFrame(rows, "time string, level int, u double").select(F.col("time").cast("timestamp_ntz").alias("time"), "level", *[F.lit(0.0).alias(c) for c in ("lat", "lon")], "u", *[F.lit(1.0).alias(c) for c in "vz"])
    x.write.parquet(path)
    with pytest.raises(Exception, match="asked for levels"):
        tb.scan_wind_fields(spark, path, (200, 250)).collect()
    assert tb.scan_wind_fields(spark, path, (200, 250), skip=True).count() == 2
    assert [r.have for r in tb.wind_field_faults(x, (200, 250)).collect()] == [[200]]
