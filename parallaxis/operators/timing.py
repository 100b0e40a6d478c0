"""When each pixel was scanned: time tables per scan, cut to the product, read at pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Detector offsets per channel in seconds.
BAND_OFFSET_S = {
    1: 0.179, 2: -0.055, 3: 0.402, 4: 0.642, 5: -0.359, 6: -0.642, 7: 0.535, 8: 0.267,
    9: 0.000, 10: -0.267, 11: -0.535, 12: -0.542, 13: 0.551, 14: 0.319, 15: -0.256, 16: 0.579,
}
# Names of the published time tables, and the start of one of them.
M6_EAST = "ABI-Timeline05B_Mode 6A_20190612-183017.nc"
M6_EAST_BEFORE = "Timeline05F_Mode6_20180828-092941.nc"
M6_WEST = "340_Timeline_05M_Mode6_v2.7.nc"
M3 = "Timeline03C_Mode3_20180828-092953.nc"
M4 = "ABI-Timeline04A_Mode 4_20181219-104006.nc"
M6_EAST_START = "2019-06-12 18:30:17"
EAST, WEST = (16, 19), (17, 18)
FIRST, LAST = "1900-01-01 00:00:00", "9999-12-31 00:00:00"


def band_shift(channels: tuple[int, ...]) -> float:
    """Mean detector offset of the channels, relative to band 2, which the tables are for."""
    return sum(BAND_OFFSET_S[c] for c in channels) / len(channels) - BAND_OFFSET_S[2]


def with_band_shift(df: DataFrame, channels: str) -> DataFrame:
    """Adds shift_s for an array column of channels."""
    offsets = F.create_map(*[F.lit(x) for pair in BAND_OFFSET_S.items() for x in pair])
    total = F.aggregate(F.transform(channels, lambda c: F.try_element_at(offsets, c)), F.lit(0.0), lambda a, x: a + x)
    return df.withColumn("shift_s", F.try_divide(total, F.size(channels)) - BAND_OFFSET_S[2])


def rules(spark: SparkSession) -> DataFrame:
    """Which table holds for (sat, mode, domain) from when to when; a fixed few dozen rows.

    ``window`` marks the one that is only taken if the scan's own length agrees with the table's.
    """
    rows = []
    for sat in (*EAST, *WEST):
        east = sat in EAST
        rows.append((sat, 6, "C", FIRST, LAST, M6_EAST if east else M6_WEST, False))
        if sat in (16, 17):
            rows += [(sat, 6, "F", FIRST, M6_EAST_START, M6_EAST_BEFORE, False), (sat, 6, "F", M6_EAST_START, LAST, M6_EAST, False)] if east else [(sat, 6, "F", FIRST, LAST, M6_WEST, False)]
        rows += [(sat, 3, "C", FIRST, LAST, M3, False), (sat, 3, "F", FIRST, LAST, M3, not east)]
        rows += [(sat, 4, d, FIRST, LAST, M4, False) for d in "CF"]
    x = spark.createDataFrame(rows, "sat int, mode int, domain string, since string, until string, tbl string, window boolean")
    return x.withColumn("since", F.col("since").cast("timestamp_ntz")).withColumn("until", F.col("until").cast("timestamp_ntz"))


def table_spans(lut: DataFrame) -> DataFrame:
    """Per (tbl, var) its length in seconds; per tbl how many CONUS instances it has."""
    spans = lut.groupBy("tbl", "var").agg((F.max("sec").cast("double") - F.min("sec").cast("double")).alias("span_s"))
    n = spans.groupBy("tbl").agg(F.sum(F.col("var").rlike("^CONUS[0-9]+$").cast("int")).alias("n_conus"))
    return spans.join(n, "tbl")


def lut_for_scan(scans: DataFrame, spans: DataFrame, within_s: float = 10.0) -> DataFrame:
    """(scan_id, tbl, var, cut, span_s, fits) for scans (scan_id, sat, mode, domain, w0, w1) that have a table.

    CONUS scans take instance (minute mod 5 n) div 5 + 1 of a table with n of them, or are cut from the full
    disk (``cut``) where it has none. ``fits``: the window agrees with the table's length; where the rule
    asks for it, scans that do not fit have no table. Scans without one are left out.
    """
    r = F.broadcast(rules(scans.sparkSession))
    on = [scans[c] == r[c] for c in ("sat", "mode", "domain")] + [(scans["w0"] >= r["since"]) & (scans["w0"] < r["until"])]
    x = scans.join(r, on).select(scans["scan_id"], scans["domain"], "w0", "w1", "tbl", "window")
    n = spans.select("tbl", "n_conus").distinct()
    x = x.join(n, "tbl")
    k = F.floor(F.pmod(F.minute("w0"), F.greatest(5 * F.col("n_conus"), F.lit(1))) / 5) + 1
    cut = (F.col("domain") == "C") & (F.col("n_conus") == 0)
    x = x.withColumn("cut", cut).withColumn("var", F.when((F.col("domain") == "F") | cut, "FD").otherwise(F.concat(F.lit("CONUS"), k.cast("string"))))
    x = x.join(spans.drop("n_conus"), ["tbl", "var"])
    window = (F.unix_micros(F.col("w1").cast("timestamp")) - F.unix_micros(F.col("w0").cast("timestamp"))) / 1e6
    x = x.withColumn("fits", F.abs(window - F.col("span_s")) <= within_s)
    return x.where(~F.col("window") | F.col("fits")).select("scan_id", "tbl", "var", "cut", "span_s", "fits")


def product_offset(scans: DataFrame, ny: int, nx: int, tolerance: float = 0.05) -> DataFrame:
    """Adds r0, c0: the first row and column of a product (x0, dx, nx, y0, dy, ny) in the full-disk table of ny x nx.

    Products that are not aligned to it, or do not fit into it, are left out.
    """
    c, r = F.col("x0") / F.col("dx") + (nx - 1) / 2, F.col("y0") / F.col("dy") + (ny - 1) / 2
    x = scans.withColumn("fc", c).withColumn("fr", r).withColumn("c0", F.rint("fc").cast("int")).withColumn("r0", F.rint("fr").cast("int"))
    aligned = (F.abs(F.col("fc") - F.col("c0")) <= tolerance) & (F.abs(F.col("fr") - F.col("r0")) <= tolerance)
    inside = (F.col("r0") >= 0) & (F.col("c0") >= 0) & (F.col("r0") + F.col("ny") <= ny) & (F.col("c0") + F.col("nx") <= nx)
    return x.where(aligned & inside).drop("fc", "fr")


def crop_lut_to_product(lut: DataFrame, scans: DataFrame, ny: int, nx: int) -> DataFrame:
    """(scan_id, row, col, sec): the part of the full-disk table (tbl, row, col, sec) under each product, in its own rows and columns.

    A table is cut once per geometry of a product, however many scans share it. Where only a few pixels of a scan are asked for,
    ``product_pixel_times`` reads the full-disk table itself.
    """
    s = product_offset(scans, ny, nx).select("scan_id", "tbl", "r0", "c0", F.col("ny").alias("h"), F.col("nx").alias("w"))
    shape = ["tbl", "r0", "c0", "h", "w"]
    row, col = F.col("row") - F.col("r0"), F.col("col") - F.col("c0")
    x = lut.join(s.select(*shape).distinct(), "tbl").where((row >= 0) & (row < F.col("h")) & (col >= 0) & (col < F.col("w")))
    return s.join(x.select(*shape, row.alias("row"), col.alias("col"), "sec"), shape).select("scan_id", "row", "col", "sec")


def product_pixel_times(points: DataFrame, lut: DataFrame, scans: DataFrame, ny: int, nx: int, shift_s: float = 0.0, s0: float | Column = 0.0) -> DataFrame:
    """Adds sec to points (scan_id, frow, fcol) as ``pixel_times`` does, from the full-disk table (tbl, row, col, sec) at shifted rows and columns.

    Only the offset of a scan's product, a few numbers, meets the points: no table is cut. NULL off the product, and for scans without a fitting one.
    """
    s = product_offset(scans, ny, nx).select("scan_id", "tbl", "r0", "c0", F.col("ny").alias("h"), F.col("nx").alias("w"))
    own_row, own_col = F.rint("frow"), F.rint("fcol")
    inside = own_row.between(0, F.col("h") - 1) & own_col.between(0, F.col("w") - 1)
    place = lambda own, first: F.when(inside, own + F.col(first)).cast("int")
    x = points.join(s, "scan_id", "left").withColumn("row", place(own_row, "r0")).withColumn("col", place(own_col, "c0"))
    x = x.join(lut.select("tbl", "row", "col", F.col("sec").cast("double").alias("sec")), ["tbl", "row", "col"], "left")
    s0 = F.lit(s0) if isinstance(s0, float) else s0
    return x.withColumn("sec", F.col("sec") + shift_s - s0).select(*points.columns, "sec")


def pixel_times(points: DataFrame, lut: DataFrame, shift_s: float = 0.0, s0: float | Column = 0.0, clip: bool = False, by: tuple[str, ...] = ("scan_id",)) -> DataFrame:
    """Adds sec: the scan second of the pixel nearest to (frow, fcol), shifted, relative to s0.

    NULL off the sector, or with ``clip`` the time of the nearest pixel on its edge. A pixel exactly between
    two goes to the even one.
    """
    at = [F.rint("frow"), F.rint("fcol")]
    if clip:
        size = lut.groupBy(*by).agg(F.max("row").alias("last_row"), F.max("col").alias("last_col"))
        points = points.join(size, list(by), "left")
        at = [F.greatest(F.lit(0.0), F.least(a, F.col(last).cast("double"))) for a, last in zip(at, ("last_row", "last_col"))]
    x = points.withColumn("row", F.when(F.col("frow").isNotNull() & F.col("fcol").isNotNull(), at[0]).cast("int")).withColumn("col", at[1].cast("int"))
    s0 = F.lit(s0) if isinstance(s0, float) else s0
    times = lut.select(*by, "row", "col", F.col("sec").cast("double").alias("sec"))
    out = x.join(times, [*by, "row", "col"], "left").withColumn("sec", F.col("sec") + shift_s - s0)
    return out.drop("row", "col", "last_row", "last_col")


def wind_profile_at(cases: DataFrame, fields: DataFrame, step: float = 0.25, gravity: float = 9.80665) -> DataFrame:
    """(case_id, lvl, h, u, v): the wind at a case's anchor and time, from hourly fields on a lat/lon lattice of ``step``.

    Bilinear in place, linear between the two hours; heights are geopotential / gravity in km. A profile with
    any missing value is left out whole. Corners meet the fields on equal keys.
    """
    key = lambda c: F.rint(F.col(c) / step).cast("long")
    us = F.unix_micros(F.col("time").cast("timestamp"))
    hour = 3_600_000_000
    c = cases.select("case_id", us.alias("us"), (F.col("anchor_lat") / step).alias("y"), (F.col("anchor_lon") / step).alias("x"))
    c = c.select("*", F.floor(F.col("us") / hour).alias("k"), F.floor("y").alias("a"), F.floor("x").alias("b"))
    corner = F.explode(F.array(*[F.struct((F.col("k") + dk).alias("k"), (F.col("a") + da).alias("a"), (F.col("b") + db).alias("b")) for dk in (0, 1) for da in (0, 1) for db in (0, 1)]))
    c = c.select("case_id", "us", "y", "x", corner.alias("c"))
    weight = (1 - F.abs(F.col("us") / hour - F.col("c.k"))) * (1 - F.abs(F.col("y") - F.col("c.a"))) * (1 - F.abs(F.col("x") - F.col("c.b")))
    c = c.select("case_id", "c.*", weight.alias("w")).where("w > 0")
    f = fields.select((F.unix_micros(F.col("time").cast("timestamp")) / hour).cast("long").alias("k"), key("lat").alias("a"), key("lon").alias("b"), "level", "u", "v", "z")
    levels = c.join(f, ["k", "a", "b"]).groupBy("case_id", "level").agg(
        F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col(n)).alias(n) for n in "uvz"], *[F.sum(F.when(F.col(n).isNotNull(), F.col("w"))).alias(f"w{n}") for n in "uvz"]
    )
    fine = F.least(*[F.coalesce(F.col(f"w{n}"), F.lit(0.0)) for n in "uvz"]) > 1 - 1e-9
    bad = levels.where(~fine).select("case_id").distinct()
    out = levels.join(bad, "case_id", "left_anti")
    return out.select("case_id", F.col("level").alias("lvl"), (F.col("z") / gravity / 1000).alias("h"), "u", "v")
