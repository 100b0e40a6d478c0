"""Truth points: gaps along the track, contrails, times, advection with the wind at their own height."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

EARTH_KM, KM_PER_DEGREE, GAP_KM = 6371.0, 111.0, 5.0


def haversine_km(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> Column:
    la0, la1 = F.radians(lat0), F.radians(lat1)
    a = F.pow(F.sin((la1 - la0) / 2), 2) + F.cos(la0) * F.cos(la1) * F.pow(F.sin((F.radians(lon1) - F.radians(lon0)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def haversine_gap(truth: DataFrame) -> DataFrame:
    """Adds gap_km, the distance from the point before in pid order; NULL for a case's first."""
    track = Window.partitionBy("case_id").orderBy("pid")
    return truth.withColumn("gap_km", haversine_km(F.lag("lat").over(track), F.lag("lon").over(track), F.col("lat"), F.col("lon")))


def contrail_ids(truth: DataFrame, gap_km: float = GAP_KM) -> DataFrame:
    """Adds contrail, counted from 0: a new one starts where the gap is larger than ``gap_km``."""
    track = Window.partitionBy("case_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, 0)
    new = F.when(F.col("gap_km") > gap_km, 1).otherwise(0)
    return haversine_gap(truth).withColumn("contrail", F.sum(new).over(track)).drop("gap_km")


def truth_times(truth: DataFrame, cases: DataFrame) -> DataFrame:
    """Adds t: the point's own time, else its case's (case_id, case_time)."""
    return truth.join(cases.select("case_id", "case_time"), "case_id", "left").withColumn("t", F.coalesce("time", "case_time")).drop("case_time")


def wind_segments(winds: DataFrame) -> DataFrame:
    """The profile (case_id, h, u, v) as segments (case_id, h0, h1, u0, u1, v0, v1) that cover all heights.

    Below the lowest and above the highest level the wind stays what it is there.
    """
    up = Window.partitionBy("case_id").orderBy("h")
    ends = lambda x: F.lead(x).over(up)
    s = winds.select("case_id", F.col("h").alias("h0"), ends("h").alias("h1"), F.col("u").alias("u0"), ends("u").alias("u1"), F.col("v").alias("v0"), ends("v").alias("v1"), F.row_number().over(up).alias("k"))
    low = s.where("k = 1").select("case_id", F.lit(float("-inf")).alias("h0"), F.col("h0").alias("h1"), "u0", F.col("u0").alias("u1"), "v0", F.col("v0").alias("v1"))
    s = s.select("case_id", "h0", F.coalesce("h1", F.lit(float("inf"))).alias("h1"), "u0", F.coalesce("u1", "u0").alias("u1"), "v0", F.coalesce("v1", "v0").alias("v1"))
    return s.unionByName(low)


def wind_at_height(points: DataFrame, winds: DataFrame, height: str) -> DataFrame:
    """Adds u and v, interpolated in height and held at both ends; NULL without a profile. Equi-join on the case, range on height."""
    s = wind_segments(winds).withColumnRenamed("case_id", "wind_case")
    on = (points["case_id"] == s["wind_case"]) & (points[height] >= s["h0"]) & (points[height] < s["h1"])
    inner = (F.col("h0") > float("-inf")) & (F.col("h1") < float("inf"))
    f = F.when(inner, (F.col(height) - F.col("h0")) / (F.col("h1") - F.col("h0"))).otherwise(F.lit(0.0))
    out = points.join(s, on, "left").withColumn("u", F.col("u0") + f * (F.col("u1") - F.col("u0"))).withColumn("v", F.col("v0") + f * (F.col("v1") - F.col("v0")))
    return out.drop("wind_case", "h0", "h1", "u0", "u1", "v0", "v1")


def advect_truth(truth: DataFrame, winds: DataFrame, map_times: DataFrame) -> DataFrame:
    """Carries each point from its own time to its case's map time (case_id, map_time): lat_adv, lon_adv, dt_s, disp_km."""
    x = wind_at_height(truth, winds, "top_km").join(map_times, "case_id", "left")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    x = x.withColumn("dt_s", (micros("map_time") - micros("time")) / 1e6)
    metres = KM_PER_DEGREE * 1000
    return (
        x.withColumn("lat_adv", F.col("lat") + F.col("v") * F.col("dt_s") / metres)
        .withColumn("lon_adv", F.col("lon") + F.col("u") * F.col("dt_s") / (metres * F.cos(F.radians("lat"))))
        .withColumn("disp_km", F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")) * F.abs("dt_s") / 1000)
    )


def on_map_position(profiles: DataFrame) -> DataFrame:
    """lat and lon at the map's time where there is one, else as measured."""
    return profiles.withColumn("lat", F.coalesce("lat_adv", "lat")).withColumn("lon", F.coalesce("lon_adv", "lon"))


def attach_truth(truth: DataFrame, maps: DataFrame, grids: DataFrame, winds: DataFrame | None = None, map_times: DataFrame | None = None, patch: int = 5) -> DataFrame:
    """Profile rows: each truth point with its contrail and what the map has at it, raw and carried to the map's time.

    With winds and map times, h, r and s_eff are taken where the wind has carried the point and h_raw where it was
    measured; cases without a profile, and runs without winds, take both where it was measured.
    """
    from .geometry import locate
    from .stencil import sample_patch

    by = ("case_id",)
    x = contrail_ids(truth)
    place = lambda df, kind, lat, lon: df.select("case_id", F.struct("pid", F.lit(kind).alias("kind")).alias("pid"), F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    both = place(x, "raw", "lat", "lon")
    if winds is not None and map_times is not None:
        x = advect_truth(x, winds, map_times)
        both = both.unionByName(place(x.where("u is not null"), "own", "lat_adv", "lon_adv"))
    else:
        x = x.withColumns({c: F.lit(None).cast("double") for c in ("u", "lat_adv", "lon_adv", "dt_s", "disp_km")})
    # both places of all points read the maps at once
    read = sample_patch(locate(both, grids).where("fi is not null"), maps, patch, by)
    of = lambda kind, c: F.max(F.when(F.col("pid.kind") == kind, F.col(c))).alias(f"{c}_{kind}")
    read = read.groupBy("case_id", F.col("pid.pid").alias("pid")).agg(*[of(k, c) for k in ("raw", "own") for c in ("h", "r", "s_eff")])
    take = lambda c: F.when(F.col("u").isNotNull(), F.col(f"{c}_own")).otherwise(F.col(f"{c}_raw")).alias(c)
    out = x.join(read, ["case_id", "pid"], "left")
    return out.select("case_id", "pid", "contrail", "lat", "lon", "top_km", take("h"), take("r"), take("s_eff"), "h_raw", "lat_adv", "lon_adv", "dt_s", "disp_km")
