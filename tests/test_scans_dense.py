"""The nearest scan among many of one bucket of time: the plan reads a bucket once, and gives what a search of all scans gives."""

from datetime import datetime, timedelta

from parallaxis.operators import asof


def test_j1_windows_only_grow(spark):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    scans = [(k, 16 + k % 2, "F" if k % 3 == 0 else "C", at(k * 97 % 7200)) for k in range(400)]
    frames = [(f"case_{k}", 16 + k % 2, at(k * 61 % 9000 - 900)) for k in range(150)]
    out = asof.nearest_scan(spark.createDataFrame(frames, "case_id string, sat int, t timestamp_ntz"), spark.createDataFrame(scans, "scan_id long, sat int, domain string, t timestamp_ntz"), within_s=600)
    assert "unboundedfollowing" not in out._jdf.queryExecution().executedPlan().toString().lower()
    got = {r.case_id: r for r in out.collect()}
    assert len(got) == 150
    for case, sat, t in frames:
        near = [(d != "C", abs((s - t).total_seconds()), i, d, (s - t).total_seconds()) for i, own, d, s in scans if own == sat and abs((s - t).total_seconds()) <= 600]
        if near:
            _, _, i, d, dt = min(near)
            assert (got[case].scan_id, got[case].domain, round(got[case].dt_s, 6)) == (i, d, round(dt, 6))
        else:
            assert got[case].scan_id is None
