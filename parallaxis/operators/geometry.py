"""Satellite geometry as columns: positions seen and true, view angles, fixed-grid projection, advection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.safe import ratio, settled

# The fixed grid's ellipsoid, the satellites' distance from the centre, km per degree.
R_EQ, R_POL, R_SAT, KM_PER_DEGREE = 6378137.0, 6356752.31414, 42164160.0, 111.0
# Fixed value: the minor axis of WGS84, used where positions go to or from Earth-centred coordinates.
R_POL_WGS84 = 6356752.314245
# Longitudes of the satellites.
SAT_LON = {16: -75.2, 17: -137.2, 18: -137.9, 19: -75.2}


def advect(df: DataFrame, u: str, v: str, dt: str) -> DataFrame:
    """Moves lat and lon with the wind for dt seconds."""
    metres = KM_PER_DEGREE * 1000
    lat = F.col("lat") + F.col(v) * F.col(dt) / metres
    lon = F.col("lon") + F.col(u) * F.col(dt) / (metres * F.cos(F.radians("lat")))
    return df.withColumn("lon", lon).withColumn("lat", lat)


def earth_centred(lat: Column, lon: Column, h_m: Column) -> tuple[Column, Column, Column]:
    e2 = 1 - (R_POL_WGS84 / R_EQ) ** 2
    phi, lam = F.radians(lat), F.radians(lon)
    n = F.lit(R_EQ) / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
    return (n + h_m) * F.cos(phi) * F.cos(lam), (n + h_m) * F.cos(phi) * F.sin(lam), (n * (1 - e2) + h_m) * F.sin(phi)


def apparent_position(df: DataFrame, h_km: Column | float, sat_lon: float, prefix: str = "a") -> DataFrame:
    """Adds {prefix}lat and {prefix}lon: where a point at a height seems to stand on the ground, seen by a satellite."""
    h = F.lit(h_km) if isinstance(h_km, float) else h_km
    px, py, pz = earth_centred(F.col("lat"), F.col("lon"), h * 1000)
    lam = math.radians(sat_lon)
    sx, sy, a2, b2 = R_SAT * math.cos(lam), R_SAT * math.sin(lam), R_EQ**2, R_POL**2
    vx, vy, vz, t = (F.col(c) for c in ("__vx", "__vy", "__vz", "__t"))
    # in steps, so that what is used several times stays one column
    out = df.select("*", (px - sx).alias("__vx"), (py - sy).alias("__vy"), pz.alias("__vz"))
    out = out.select("*", ((vx * vx + vy * vy) / a2 + vz * vz / b2).alias("__qa"), (2 * (sx * vx + sy * vy) / a2).alias("__qb"))
    qa, qb = F.col("__qa"), F.col("__qb")
    disc = qb * qb - 4 * qa * ((R_SAT / R_EQ) ** 2 - 1)
    out = out.withColumn("__d", disc).withColumn("__t", F.when(F.col("__d") >= 0, (-qb - F.sqrt("__d")) / (2 * qa)))
    out = out.select("*", (sx + t * vx).alias("__x"), (sy + t * vy).alias("__y"), (t * vz).alias("__z"))
    lat = F.degrees(F.atan2(F.col("__z"), (R_POL / R_EQ) ** 2 * F.hypot("__x", "__y")))
    out = out.withColumn(f"{prefix}lat", lat).withColumn(f"{prefix}lon", F.degrees(F.atan2("__y", "__x")))
    return settled(out.drop("__vx", "__vy", "__vz", "__qa", "__qb", "__d", "__t", "__x", "__y", "__z"), f"{prefix}lat", f"{prefix}lon")


def parallax_vector(df: DataFrame, h_km: float, sat_lon: float) -> DataFrame:
    """Adds north_km, east_km, parallax_km: the displacement of a point at a height."""
    x = apparent_position(df, h_km, sat_lon, "p_")
    east = F.pmod(F.col("p_lon") - F.col("lon") + 180, F.lit(360.0)) - 180
    x = x.withColumn("north_km", (F.col("p_lat") - F.col("lat")) * KM_PER_DEGREE).withColumn("east_km", east * KM_PER_DEGREE * F.cos(F.radians("lat")))
    return x.withColumn("parallax_km", F.hypot("north_km", "east_km")).drop("p_lat", "p_lon")


def _disparity(df: DataFrame, lon_a: float, lon_b: float, h_km: float) -> DataFrame:
    x = parallax_vector(df, h_km, lon_a).withColumnsRenamed({"north_km": "na", "east_km": "ea"}).drop("parallax_km")
    x = parallax_vector(x, h_km, lon_b)
    n, e = (F.col("na") - F.col("north_km")) / h_km, (F.col("ea") - F.col("east_km")) / h_km
    return x.withColumn("k", F.hypot(n, e)).withColumn("axis", F.pmod(F.degrees(F.atan2(e, n)), F.lit(180.0))).drop("na", "ea", "north_km", "east_km", "parallax_km")


def disparity_axis(df: DataFrame, sat_a: int = 16, sat_b: int = 17, h_km: float = 11.0) -> DataFrame:
    """Adds k (km of disparity per km of height) and axis (its bearing, mod 180)."""
    return _disparity(df, SAT_LON[sat_a], SAT_LON[sat_b], h_km)


def view_geometry(df: DataFrame, sat_lon: float) -> DataFrame:
    """Adds vza, vaz (degrees) and slant_km of the view from the ground to a satellite."""
    px, py, pz = earth_centred(F.col("lat"), F.col("lon"), F.lit(0.0))
    lam, phi, sat = F.radians("lon"), F.radians("lat"), F.radians(F.lit(sat_lon))
    dx, dy, dz = R_SAT * F.cos(sat) - px, R_SAT * F.sin(sat) - py, -pz
    d = F.sqrt(dx * dx + dy * dy + dz * dz)
    up = dx * F.cos(phi) * F.cos(lam) + dy * F.cos(phi) * F.sin(lam) + dz * F.sin(phi)
    north = -dx * F.sin(phi) * F.cos(lam) - dy * F.sin(phi) * F.sin(lam) + dz * F.cos(phi)
    east = -dx * F.sin(lam) + dy * F.cos(lam)
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), up / d))
    out = df.withColumn("vza", F.degrees(F.acos(cos))).withColumn("vaz", F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))).withColumn("slant_km", d / 1000)
    return settled(out, "vza", "vaz", "slant_km")


def geos_forward(df: DataFrame, lon0: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Adds the scan angles x_rad and y_rad of a ground position; NULL off the disk."""
    e2, big_h = 1 - (R_POL / R_EQ) ** 2, R_SAT
    phi = F.atan((R_POL / R_EQ) ** 2 * F.tan(F.radians(lat)))
    rc = F.lit(R_POL) / F.sqrt(1 - e2 * F.cos(phi) * F.cos(phi))
    delta = F.radians(F.col(lon) - lon0)
    x = df.select("*", (big_h - rc * F.cos(phi) * F.cos(delta)).alias("__sx"), (-rc * F.cos(phi) * F.sin(delta)).alias("__sy"), (rc * F.sin(phi)).alias("__sz"))
    sx, sy, sz = F.col("__sx"), F.col("__sy"), F.col("__sz")
    seen = big_h * (big_h - sx) >= sy * sy + (R_EQ / R_POL) ** 2 * sz * sz
    x = x.withColumn("y_rad", F.when(seen, F.atan(sz / sx))).withColumn("x_rad", F.when(seen, F.asin(-sy / F.sqrt(sx * sx + sy * sy + sz * sz))))
    return settled(x.drop("__sx", "__sy", "__sz"), "x_rad", "y_rad")


def geos_inverse(df: DataFrame, lon0: float) -> DataFrame:
    """Adds glat and glon, the ground position of scan angles; NULL off the disk."""
    x, y, q = F.col("x_rad"), F.col("y_rad"), (R_EQ / R_POL) ** 2
    a = F.sin(x) * F.sin(x) + F.cos(x) * F.cos(x) * (F.cos(y) * F.cos(y) + q * F.sin(y) * F.sin(y))
    b, c = -2 * R_SAT * F.cos(x) * F.cos(y), R_SAT**2 - R_EQ**2
    disc = b * b - 4 * a * c
    rs = (-b - F.sqrt(F.when(disc >= 0, disc))) / (2 * a)
    out = df.select("*", rs.alias("__r"))
    sx, sy, sz = F.col("__r") * F.cos(x) * F.cos(y), -F.col("__r") * F.sin(x), F.col("__r") * F.cos(x) * F.sin(y)
    lat = F.degrees(F.atan(q * sz / F.sqrt((R_SAT - sx) * (R_SAT - sx) + sy * sy)))
    return out.withColumn("glat", lat).withColumn("glon", lon0 - F.degrees(F.atan(sy / (R_SAT - sx)))).drop("__r")


def make_grid(boxes: DataFrame, px_km: float = 2.0) -> DataFrame:
    """Grid size per case: n_lat and n_lon (60 to 750), with the pixel sizes that go with them."""
    size = lambda extent: F.greatest(F.lit(60), F.least(F.lit(750), (extent / px_km).cast("int")))
    north = (F.col("lat1") - F.col("lat0")) * KM_PER_DEGREE
    east = (F.col("lon1") - F.col("lon0")) * KM_PER_DEGREE * F.cos(F.radians((F.col("lat0") + F.col("lat1")) / 2))
    x = boxes.withColumn("n_lat", size(north)).withColumn("n_lon", size(east))
    return x.withColumn("px_lat_km", north / F.col("n_lat")).withColumn("px_lon_km", east / F.col("n_lon"))


def grid_points(grids: DataFrame) -> DataFrame:
    """The grid's points (case_id, i, j, lat, lon), both ends included."""
    at = lambda lo, hi, k, n: F.col(lo) + (F.col(hi) - F.col(lo)) * F.col(k) / (F.col(n) - 1)
    x = grids.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_lat") - 1)))
    x = x.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n_lon") - 1)))
    return x.select("case_id", "i", "j", at("lat0", "lat1", "i", "n_lat").alias("lat"), at("lon0", "lon1", "j", "n_lon").alias("lon"))


def km_filters(grids: DataFrame, hp_km: float = 16.0, win_km: float = 20.0) -> DataFrame:
    """Adds the high-pass sigma and the odd window (3 at least) of each axis, in pixels."""
    out = grids
    for axis in ("lat", "lon"):
        px = F.col(f"px_{axis}_km")
        out = out.withColumn(f"sigma_{axis}", F.lit(hp_km) / px).withColumn(f"win_{axis}", F.greatest(F.lit(3), (F.lit(win_km) / px).cast("int").bitwiseOR(F.lit(1))))
    return out


def height_bands(df: DataFrame, column: str, lo: float = 6.0, step: float = 1.0) -> DataFrame:
    """Adds the edges of the height's band and its flight level (hundreds of feet)."""
    k = F.floor((F.col(column) - lo) / step)
    return df.withColumn("band_lo", lo + k * step).withColumn("band_hi", lo + (k + 1) * step).withColumn("flight_level", F.rint(F.col(column) / 0.03048).cast("long"))


def locate(points: DataFrame, grids: DataFrame) -> DataFrame:
    """Adds the fractional place (fi, fj) on the case's grid; NULL outside."""
    x = points.join(grids.select("case_id", "lat0", "lat1", "lon0", "lon1", "n_lat", "n_lon"), "case_id")
    place = lambda v, lo, hi, n: ratio((F.col(v) - F.col(lo)) * (F.col(n) - 1), F.col(hi) - F.col(lo))
    fi, fj = place("lat", "lat0", "lat1", "n_lat"), place("lon", "lon0", "lon1", "n_lon")
    inside = fi.between(0, F.col("n_lat") - 1) & fj.between(0, F.col("n_lon") - 1)
    return x.withColumn("fi", F.when(inside, fi)).withColumn("fj", F.when(inside, fj)).drop("lat0", "lat1", "lon0", "lon1", "n_lat", "n_lon")


def footprint_stretch(df: DataFrame, sat_a: int = 16, sat_b: int = 17) -> DataFrame:
    """Adds stretch, the rms of 1 / cos(zenith angle) over two views, and vza_max."""
    x = view_geometry(df, SAT_LON[sat_a]).withColumnRenamed("vza", "vza_a").drop("vaz", "slant_km")
    x = view_geometry(x, SAT_LON[sat_b]).withColumnRenamed("vza", "vza_b").drop("vaz", "slant_km")
    inverse = lambda c: 1 / F.pow(F.cos(F.radians(c)), 2)
    return x.withColumn("stretch", F.sqrt((inverse("vza_a") + inverse("vza_b")) / 2)).withColumn("vza_max", F.greatest("vza_a", "vza_b")).drop("vza_a", "vza_b")


# Pairs of satellites by their longitudes; the first comes first where both are as good.
PAIRS = {"GOES-West / GOES-East": (-137.2, -75.2), "GOES-East / MTG-I1": (-75.2, 0.0)}


def lattice(spark: SparkSession, lat: tuple[float, float] = (-72.0, 80.0), lon: tuple[float, float] = (-180.0, 60.0), step: float = 1.0) -> DataFrame:
    """(lat, lon) of a global lattice, both ends included."""
    n_lat, n_lon = round((lat[1] - lat[0]) / step) + 1, round((lon[1] - lon[0]) / step) + 1
    x = spark.range(n_lat * n_lon)
    return x.select((lat[0] + F.floor(F.col("id") / n_lon) * step).alias("lat"), (lon[0] + F.pmod("id", F.lit(n_lon)) * step).alias("lon"))


def disparity_map(points: DataFrame, pairs: dict[str, tuple[float, float]] = PAIRS, max_vza: float = 85.0, h_km: float = 11.0) -> DataFrame:
    """Per point (lat, lon, other columns) the pair of satellites with the smallest worst zenith angle, up to ``max_vza``: adds pair, vza_max, k, axis, stretch.

    Points that no pair sees are left out; of equal pairs the first stays. Each pair is a branch of its own, filtered
    before its disparity is computed; a partial minimum leaves one row per point.
    """
    found = None
    for n, (name, (a, b)) in enumerate(pairs.items()):
        x = view_geometry(points, a).withColumnRenamed("vza", "vza_a").drop("vaz", "slant_km")
        x = view_geometry(x, b).withColumnRenamed("vza", "vza_b").drop("vaz", "slant_km")
        inverse = lambda c: 1 / F.pow(F.cos(F.radians(c)), 2)
        x = x.withColumn("stretch", F.sqrt((inverse("vza_a") + inverse("vza_b")) / 2)).withColumn("vza_max", F.greatest("vza_a", "vza_b"))
        x = _disparity(x.where(F.col("vza_max") <= max_vza).drop("vza_a", "vza_b"), a, b, h_km)
        x = x.select(*points.columns, F.struct("vza_max", F.lit(n).alias("n"), F.lit(name).alias("pair"), "k", "axis", "stretch").alias("own"))
        found = x if found is None else found.unionByName(x)
    return found.groupBy(*points.columns).agg(F.min("own").alias("best")).select(*points.columns, "best.pair", "best.vza_max", "best.k", "best.axis", "best.stretch")


def view_footprint(df: DataFrame, sat_lon: float, ifov_rad: float = 56e-6, psf_factor: float = 0.45, dz_km: float = 0.0) -> DataFrame:
    """Adds gsd_along_km, gsd_across_km and the covariance (cnn, cne, cee, km squared) of a view's footprint in north and east.

    sigma is ``psf_factor`` times the pixel's size; a layer ``dz_km`` thick smears it along the line of sight.
    Rows beyond 85 degrees are left out.
    """
    x = view_geometry(df, sat_lon).where("vza <= 85")
    x = x.withColumn("gsd_across_km", ifov_rad * F.col("slant_km")).withColumn("gsd_along_km", F.col("gsd_across_km") / F.cos(F.radians("vza")))
    n, e = F.cos(F.radians("vaz")), F.sin(F.radians("vaz"))
    smear = dz_km * F.tan(F.radians("vza"))
    a2, c2 = F.pow(psf_factor * F.col("gsd_along_km"), 2) + smear * smear / 12, F.pow(psf_factor * F.col("gsd_across_km"), 2)
    return x.select("*", (a2 * n * n + c2 * e * e).alias("cnn"), ((a2 - c2) * n * e).alias("cne"), (a2 * e * e + c2 * n * n).alias("cee"))


def geodetic(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """(latitude in radians, height in metres) of an Earth-centred point, in closed form to well below a millimetre."""
    e2 = 1 - (R_POL_WGS84 / R_EQ) ** 2
    p = F.hypot(x, y)
    theta = F.atan2(z * R_EQ, p * R_POL_WGS84)
    lat = F.atan2(z + e2 / (1 - e2) * R_POL_WGS84 * F.pow(F.sin(theta), 3), p - e2 * R_EQ * F.pow(F.cos(theta), 3))
    n = R_EQ / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    return lat, p * F.cos(lat) + z * F.sin(lat) - n * (1 - e2 * F.sin(lat) * F.sin(lat))


def true_position(df: DataFrame, h_km: Column | float, sat_lon: float, steps: int = 6) -> DataFrame:
    """Adds tlat, tlon, residual_m: where a cloud at a height stands that is seen at (alat, alon), and by how much its height is missed.

    Newton steps along the ray from the satellite, a fold over a fixed number of them.
    """
    h = (F.lit(h_km) if isinstance(h_km, float) else h_km) * 1000
    px, py, pz = earth_centred(F.col("alat"), F.col("alon"), F.lit(0.0))
    lam = math.radians(sat_lon)
    sx, sy = R_SAT * math.cos(lam), R_SAT * math.sin(lam)
    x = df.select("*", (px - sx).alias("__dx"), (py - sy).alias("__dy"), pz.alias("__dz"), h.alias("__h"))
    dx, dy, dz = F.col("__dx"), F.col("__dy"), F.col("__dz")
    la, lo = F.radians("alat"), F.radians("alon")
    up = dx * F.cos(la) * F.cos(lo) + dy * F.cos(la) * F.sin(lo) + dz * F.sin(la)
    x = x.withColumn("__t0", 1 + F.col("__h") / up)

    def step(t: Column) -> Column:
        qx, qy, qz = sx + t * dx, sy + t * dy, t * dz
        lat, height = geodetic(qx, qy, qz)
        p = F.hypot(qx, qy)
        slope = F.cos(lat) * (dx * qx + dy * qy) / p + F.sin(lat) * dz
        return t - (height - F.col("__h")) / slope

    x = x.withColumn("__t", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("__t0"), lambda t, _: step(t)))
    t = F.col("__t")
    x = x.select("*", (sx + t * dx).alias("__x"), (sy + t * dy).alias("__y"), (t * dz).alias("__z"))
    lat, height = geodetic(F.col("__x"), F.col("__y"), F.col("__z"))
    x = x.withColumn("tlat", F.degrees(lat)).withColumn("tlon", F.degrees(F.atan2("__y", "__x"))).withColumn("residual_m", height - F.col("__h"))
    return settled(x.drop("__dx", "__dy", "__dz", "__h", "__t0", "__t", "__x", "__y", "__z"), "tlat", "tlon", "residual_m")


def height_candidates(df: DataFrame, lo: float = 8.0, hi: float = 16.0, step: float = 0.25) -> DataFrame:
    """Every row with every trial height (h_idx, h)."""
    n = round((hi - lo) / step)
    return df.withColumn("h_idx", F.explode(F.sequence(F.lit(0), F.lit(n)))).withColumn("h", lo + F.col("h_idx") * step)


def near_point(points: DataFrame, lat: float, lon: float, km: float = 5.0) -> DataFrame:
    """Points closer than ``km`` to a place: a box first, which the scan can prune by, then the distance."""
    north = (F.col("lat") - lat) * KM_PER_DEGREE
    east = (F.col("lon") - lon) * KM_PER_DEGREE * math.cos(math.radians(lat))
    box = F.col("lat").between(lat - km / KM_PER_DEGREE, lat + km / KM_PER_DEGREE)
    return points.withColumn("km", F.sqrt(north * north + east * east)).where(box & (F.col("km") < km))
