"""From pixels to heights: positions per trial height, views sampled there, correlation cubes, native maps.

A view is a table of pixels of one scan (``by``, row, col, btd) with the scan's axes (x0, dx, y0, dy); sampling a view
is a join of query points with its pixels. Passes that re-read pixel times are chained as columns and joins, a
fixed number of times.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.safe import few
from ..sources.tables import CELL_RAD, scratch
from .conditioning import condition, highpass
from .geometry import KM_PER_DEGREE, SAT_LON, advect, apparent_position, geos_forward, geos_inverse, true_position
from .stencil import height_map, local_corr, sample_bilinear
from .timing import pixel_times
from .truth import wind_at_height

#: Height at which the overlap of views is judged, km.
OVERLAP_KM = 10.0
#: Trial heights that a run may have; every point meets each.
MOST_HEIGHTS = 1000


@dataclass
class View:
    """One satellite's frames. pixels: case_id, row, col, btd. axes: case_id, x0, dx, y0, dy, dt0_s (frame time minus
    reference time). times (optional): case_id, row, col, sec, relative to the frame's time."""

    sat: int
    pixels: DataFrame
    axes: DataFrame
    times: DataFrame | None = None


def fractional(df: DataFrame, view: View, lat: str = "alat", lon: str = "alon") -> DataFrame:
    """Adds frow and fcol: where an apparent position falls on the view's pixels; NULL off the disk."""
    x = geos_forward(df, SAT_LON[view.sat], lat, lon).join(view.axes.select("case_id", "x0", "dx", "y0", "dy"), "case_id")
    return x.withColumn("fcol", (F.col("x_rad") - F.col("x0")) / F.col("dx")).withColumn("frow", (F.col("y_rad") - F.col("y0")) / F.col("dy")).drop("x_rad", "y_rad", "x0", "dx", "y0", "dy")


def project_view(points: DataFrame, view: View, winds: DataFrame | None = None, reads: int = 2) -> DataFrame:
    """Adds frow, fcol: where the view sees a cloud that stands over (lat, lon) at height h (km) at the reference time.

    The cloud is advected to the frame's time, then seen with its parallax. With per-pixel times, the time is read
    where it is seen without wind first, and ``reads`` - 1 more times where it is seen then; off the sector it counts as 0. The view of the
    reference satellite is treated the same way. ``winds`` (case_id, h, u, v): without it clouds stand still.
    """
    x = points.withColumnsRenamed({"lat": "lat0", "lon": "lon0"})
    x = x.withColumn("lat", F.col("lat0")).withColumn("lon", F.col("lon0"))
    if winds is None:
        return fractional(apparent_position(x, F.col("h"), SAT_LON[view.sat]), view).drop("lat", "lon", "alat", "alon").withColumnsRenamed({"lat0": "lat", "lon0": "lon"})
    x = wind_at_height(x, winds, "h").join(view.axes.select("case_id", "dt0_s"), "case_id")
    if view.times is None:
        x = x.withColumn("dt", F.col("dt0_s"))
        x = apparent_position(advect(x, "u", "v", "dt"), F.col("h"), SAT_LON[view.sat])
    else:
        x = fractional(apparent_position(x, F.col("h"), SAT_LON[view.sat]), view)
        for _ in range(reads):
            x = pixel_times(x, view.times, by=("case_id",)).withColumn("dt", F.col("dt0_s") + F.coalesce("sec", F.lit(0.0)))
            x = advect(x.withColumn("lat", F.col("lat0")).withColumn("lon", F.col("lon0")), "u", "v", "dt")
            x = fractional(apparent_position(x.drop("sec", "frow", "fcol", "alat", "alon"), F.col("h"), SAT_LON[view.sat]), view)
    if view.times is None:
        x = fractional(x, view)
    return x.drop("lat", "lon", "u", "v", "dt", "dt0_s", "alat", "alon").withColumnsRenamed({"lat0": "lat", "lon0": "lon"})


def sampled(points: DataFrame, view: View, keys: tuple[str, ...]) -> DataFrame:
    """(keys, v): the view's btd at (frow, fcol) of each point, bilinear."""
    x = points.select(*keys, F.struct(*keys).alias("pid"), F.col("frow").alias("fi"), F.col("fcol").alias("fj"))
    pixels = view.pixels.select("case_id", F.col("row").cast("long").alias("i"), F.col("col").cast("long").alias("j"), "btd")
    out = sample_bilinear(x.select("case_id", "pid", "fi", "fj").where("fi is not null and fj is not null"), pixels, ("case_id",))
    return out.select(*[F.col("pid").getField(k).alias(k) for k in keys], F.col("value").alias("v"))


def kept(df: DataFrame, tag: str) -> DataFrame:
    """A table that several plans read, written once to the shared folder."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def grid_sizes(grids: DataFrame) -> DataFrame:
    """The sizes of each case's grid (with what ``make_grid`` and ``km_filters`` add) as the matching takes them."""
    return grids.select("case_id", F.col("n_lat").alias("n_i"), F.col("n_lon").alias("n_j"), F.col("sigma_lat").alias("sigma_i"), F.col("sigma_lon").alias("sigma_j"), F.col("win_lat").cast("int").alias("win_i"), F.col("win_lon").cast("int").alias("win_j"), F.col("px_lat_km").alias("px_i"), F.col("px_lon_km").alias("px_j"))


def trial_ends(heights: DataFrame) -> DataFrame:
    """One row: k_mid, the height at which the amplitude is taken, and k_ref, the one at which the overlap is judged."""
    return heights.agg(F.floor(F.count("*") / 2).alias("k_mid"), F.min_by("h_idx", F.struct(F.abs(F.col("h") - OVERLAP_KM), F.col("h_idx"))).alias("k_ref"))


def correlated(pair: DataFrame, sizes: DataFrame, heights: DataFrame) -> DataFrame:
    """(case_id, i, j, h_idx, r, amp) of views side by side (a, b) at every height; amp is the one of the middle height."""
    pair = pair.withColumn("i", F.col("i").cast("long")).withColumn("j", F.col("j").cast("long"))
    r = local_corr(pair, F.col("n_i"), F.col("n_j"), (F.col("win_i"), F.col("win_j")), ("case_id", "h_idx"), sizes=sizes).crossJoin(F.broadcast(trial_ends(heights)))
    cell = Window.partitionBy("case_id", "i", "j")  # as many rows as heights; the height map works by the same key
    return r.withColumn("amp", F.max(F.when(F.col("h_idx") == F.col("k_mid"), F.col("amp"))).over(cell)).select("case_id", "h_idx", "i", "j", "r", "amp")


def match_snapshot(grid: DataFrame, heights: DataFrame, ref: View, oth: View, sizes: DataFrame, winds: DataFrame | None = None, prep: str = "hp", feet: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(cube: case_id, i, j, h_idx, r, amp; overlap: case_id, valid_frac) over a grid (case_id, i, j, lat, lon) and heights (h_idx, h).

    For each height both views are projected, sampled, conditioned (``prep``; its footprints are ``feet``) and correlated in moving windows, all
    cases and heights in one plan: ``sizes`` says each case's grid, filters and window. amp is the reference view's at the middle height; the
    overlap is judged at the height nearest to 10 km. ``heights`` are few.
    """
    points = grid.select("case_id", "i", "j", "lat", "lon").crossJoin(few(heights, MOST_HEIGHTS))
    keys = ("case_id", "h_idx", "i", "j")
    seen = [sampled(project_view(points, view, winds), view, keys).withColumn("sat", F.lit(view.sat)) for view in (ref, oth)]
    x = condition(seen[0].unionByName(seen[1]), prep, sizes, feet, ("case_id", "h_idx"))
    side = lambda view, name: F.max(F.when(F.col("sat") == view.sat, F.col("hp"))).alias(name)
    pair = kept(x.groupBy(*keys).agg(side(ref, "a"), side(oth, "b")), "pair")
    cube = correlated(pair, sizes, heights)
    both = pair.crossJoin(F.broadcast(trial_ends(heights))).where("h_idx = k_ref and a is not null and b is not null")
    overlap = sizes.join(both.groupBy("case_id").agg(F.count("*").alias("n")), "case_id", "left")
    return cube, overlap.select("case_id", (F.coalesce("n", F.lit(0)) / (F.col("n_i") * F.col("n_j"))).alias("valid_frac"))


def project_to_other(points: DataFrame, other: View, winds: DataFrame | None = None, reads: int = 2) -> DataFrame:
    """Adds frow, fcol on the other view's pixels for a cloud at its true (lat, lon), height h, seen by the reference at t_ref seconds.

    Starts from the median time of the other view's pixels and re-reads the time where the cloud is seen, ``reads`` times.
    """
    x = points.withColumnsRenamed({"lat": "lat0", "lon": "lon0"}).withColumn("lat", F.col("lat0")).withColumn("lon", F.col("lon0"))
    if winds is None:
        return fractional(apparent_position(x, F.col("h"), SAT_LON[other.sat]), other).drop("lat", "lon", "alat", "alon").withColumnsRenamed({"lat0": "lat", "lon0": "lon"})
    start = other.axes.select("case_id", "dt0_s")
    if other.times is not None:
        start = start.join(other.times.groupBy("case_id").agg(F.percentile("sec", F.lit(0.5)).alias("mid")), "case_id", "left")
    x = wind_at_height(x, winds, "h").join(start, "case_id")
    fill = F.col("dt0_s") + (F.coalesce("mid", F.lit(0.0)) if other.times is not None else F.lit(0.0))
    x = x.withColumn("fill", fill).withColumn("t_oth", F.col("fill"))
    for step in range(reads + 1 if other.times is not None else 1):
        x = x.withColumn("dt", F.col("t_oth") - F.col("t_ref")).withColumn("lat", F.col("lat0")).withColumn("lon", F.col("lon0"))
        x = fractional(apparent_position(advect(x, "u", "v", "dt"), F.col("h"), SAT_LON[other.sat]), other).drop("alat", "alon")
        if other.times is not None and step < reads:
            x = pixel_times(x, other.times, clip=True, by=("case_id",)).withColumn("t_oth", F.coalesce(F.col("sec") + F.col("dt0_s"), F.col("fill"))).drop("sec", "frow", "fcol")
    return x.drop("lat", "lon", "u", "v", "dt", "dt0_s", "mid", "fill", "t_oth").withColumnsRenamed({"lat0": "lat", "lon0": "lon"})


def native_positions(pixels: DataFrame, sat: int) -> DataFrame:
    """Adds alat, alon: where the pixel at (x_rad, y_rad) seems to stand on the ground."""
    return geos_inverse(pixels, SAT_LON[sat]).withColumnsRenamed({"glat": "alat", "glon": "alon"})


def native_jacobian(pixels: DataFrame, sat: int, h_km: float = 11.0) -> DataFrame:
    """Per case the km per pixel (jnr, jnc, jer, jec: north and east per row and column) at the middle of its crop, and the spacings si, sj.

    ``pixels``: case_id, row, col, alat, alon. Nine pixels per case are read.
    """
    mid = pixels.groupBy("case_id").agg((F.min("row") + F.floor((F.max("row") - F.min("row") + 1) / 2)).alias("ic"), (F.min("col") + F.floor((F.max("col") - F.min("col") + 1) / 2)).alias("jc"))
    near = pixels.join(mid, "case_id").where("abs(row - ic) <= 1 and abs(col - jc) <= 1")
    t = true_position(near, F.lit(h_km), SAT_LON[sat])
    at = lambda c, di, dj: F.max(F.when((F.col("row") == F.col("ic") + di) & (F.col("col") == F.col("jc") + dj), F.col(c)))
    places = {(n, di, dj): at(c, di, dj).alias(f"{n}{di + 1}{dj + 1}") for n, c in (("n", "tlat"), ("e", "tlon")) for di, dj in ((-1, 0), (1, 0), (0, -1), (0, 1), (0, 0))}
    x = t.groupBy("case_id").agg(*places.values())
    c = F.cos(F.radians("n11"))
    x = x.select("case_id", *[((F.col(f"{n}{a}") - F.col(f"{n}{b}")) / 2 * KM_PER_DEGREE * (c if n == "e" else F.lit(1.0))).alias(name) for name, n, a, b in (("jnr", "n", "21", "01"), ("jnc", "n", "12", "10"), ("jer", "e", "21", "01"), ("jec", "e", "12", "10"))])
    return x.withColumn("si", F.hypot("jnr", "jer")).withColumn("sj", F.hypot("jnc", "jec"))


def native_filters(jacobian: DataFrame, hp_km: float = 8.0, win_km: float = 25.0) -> DataFrame:
    """Adds sigma_i, sigma_j and the odd window (win_i, win_j) whose ground area is nearest to win_km squared, of equal ones the squarest."""
    det = F.abs(F.col("jnr") * F.col("jec") - F.col("jnc") * F.col("jer"))
    x = jacobian.withColumn("det", det).withColumn("g", 1 / F.sqrt(F.col("det") / (F.col("si") * F.col("sj"))))
    low = lambda s: F.greatest(F.floor((F.col("g") * win_km / F.col(s) - 1) / 2) * 2 + 1, F.lit(3))
    x = x.withColumn("li", low("si")).withColumn("lj", low("sj"))
    each = F.explode(F.array(*[F.struct((F.col("li") + a).alias("wi"), (F.col("lj") + b).alias("wj")) for a in (0, 2) for b in (0, 2)]))
    x = x.select(*jacobian.columns, "det", each.alias("w"))
    area = F.abs(F.col("w.wi") * F.col("w.wj") * F.col("det") / win_km**2 - 1)
    aspect = F.abs(F.ln(F.col("w.wi") * F.col("si") / (F.col("w.wj") * F.col("sj"))))
    best = x.groupBy(*jacobian.columns, "det").agg(F.min_by("w", F.struct(area, aspect)).alias("w"))
    return best.select(*jacobian.columns, (F.lit(hp_km) / F.col("si")).alias("sigma_i"), (F.lit(hp_km) / F.col("sj")).alias("sigma_j"), F.col("w.wi").cast("int").alias("win_i"), F.col("w.wj").cast("int").alias("win_j"), (F.col("w.wi") * F.col("w.wj") * F.col("det") / win_km**2).alias("win_area_frac"))


def native_sizes(pixels: DataFrame, filters: DataFrame) -> DataFrame:
    """Each case's crop (case_id, row, col, from 0) and the filters that ``native_filters`` gives it, as the matching takes them."""
    crop = pixels.groupBy("case_id").agg((F.max("row") + 1).cast("int").alias("n_i"), (F.max("col") + 1).cast("int").alias("n_j"))
    return crop.join(filters.select("case_id", "sigma_i", "sigma_j", "win_i", "win_j"), "case_id")


def match_native(pixels: DataFrame, heights: DataFrame, ref: View, oth: View, boxes: DataFrame, sizes: DataFrame, winds: DataFrame | None = None, **gates) -> tuple[DataFrame, DataFrame]:
    """(native map: case_id, row, col, height, r, amp; overlap: case_id, valid_frac) on the reference view's own pixels.

    ``pixels``: case_id, row, col, btd, alat, alon, t_s (seconds after the reference time), rows and columns from 0; ``sizes`` as ``native_sizes``
    makes them. The reference side is high-passed once and stands beside every height. The other view is read where a
    cloud at each pixel's true position is seen, its time read again on the way. The overlap is judged inside the case's
    box (case_id, lat0, lat1, lon0, lon1); a case without pixels in it has 0.
    """
    keys, by = ("case_id", "h_idx", "i", "j"), ("case_id", "h_idx")
    filters = (F.col("n_i"), F.col("n_j"), F.col("sigma_i"), F.col("sigma_j"))
    a = highpass(pixels.select("case_id", F.col("row").alias("i"), F.col("col").alias("j"), F.col("btd").alias("v")), *filters, ("case_id",), sizes).select("case_id", "i", "j", F.col("hp").alias("a"))
    points = pixels.select("case_id", F.col("row").alias("i"), F.col("col").alias("j"), "alat", "alon", F.col("t_s").alias("t_ref")).crossJoin(few(heights, MOST_HEIGHTS))
    points = true_position(points, F.col("h"), SAT_LON[ref.sat]).drop("alat", "alon").withColumnsRenamed({"tlat": "lat", "tlon": "lon"})
    b = highpass(sampled(project_to_other(points.select(*keys, "lat", "lon", "h", "t_ref"), oth, winds), oth, keys), *filters, by, sizes).select(*keys, F.col("hp").alias("b"))
    every = a.crossJoin(F.broadcast(heights.select("h_idx")))
    pair = kept(every.join(b, list(keys), "full_outer"), "pair")
    cube = correlated(pair, sizes, heights).withColumn("r", F.col("r").cast("float").cast("double"))  # cubes are stored in single precision
    out = height_map(cube, by=("case_id",), **gates)
    ends = F.broadcast(trial_ends(heights))
    placed = points.crossJoin(ends).where("h_idx = k_ref").select(*keys, "lat", "lon").join(pair.crossJoin(ends).where("h_idx = k_ref").select(*keys, "a", "b"), list(keys), "left")
    placed = placed.join(boxes.select("case_id", "lat0", "lat1", F.col("lon0").alias("west"), F.col("lon1").alias("east")), "case_id")
    inside = placed.where("lat between lat0 and lat1 and lon between west and east").groupBy("case_id").agg(F.avg((F.col("a").isNotNull() & F.col("b").isNotNull()).cast("double")).alias("valid_frac"))
    overlap = boxes.select("case_id").join(inside, "case_id", "left").select("case_id", F.coalesce("valid_frac", F.lit(0.0)).alias("valid_frac"))
    return out.withColumnsRenamed({"i": "row", "j": "col"}), overlap


def native_diagnostics(native: DataFrame, filters: DataFrame) -> DataFrame:
    """(case_id, native_ny, native_nx, win_px_i, win_px_j, win_area_frac, native_px_km_i, native_px_km_j) of native maps (case_id, row, col)
    and the filters they were made with (``native_filters``)."""
    size = native.groupBy("case_id").agg((F.max("row") - F.min("row") + 1).cast("int").alias("native_ny"), (F.max("col") - F.min("col") + 1).cast("int").alias("native_nx"))
    own = filters.select("case_id", F.col("win_i").alias("win_px_i"), F.col("win_j").alias("win_px_j"), "win_area_frac", F.col("si").alias("native_px_km_i"), F.col("sj").alias("native_px_km_j"))
    return size.join(own, "case_id")


def place_on_grid(native: DataFrame, grid: DataFrame, sat: int, tol_km: float, winds: DataFrame | None = None) -> DataFrame:
    """(case_id, i, j, height, r, amp): each grid point takes the nearest placed pixel closer than ``tol_km``; NULL without one.

    A pixel (case_id, row, col, alat, alon, height, r, amp, t_s) goes to its true position for its own height and
    is carried to the reference time. Pixels, of which only those with a height count, stand in their cell of ``tol_km`` and the eight around it,
    grid points in their own, so the join has equal keys; of equal distances the smaller (row, col) counts.
    """
    p = true_position(native.where("height is not null"), F.col("height"), SAT_LON[sat]).withColumnsRenamed({"tlat": "lat", "tlon": "lon"})
    if winds is not None:
        p = wind_at_height(p, winds, "height").withColumn("back", -F.col("t_s"))
        p = advect(p.where("u is not null"), "u", "v", "back")
    centre = grid.groupBy("case_id").agg(((F.min("lat") + F.max("lat")) / 2).alias("clat"), ((F.min("lon") + F.max("lon")) / 2).alias("clon"))
    x, y = (F.col("lon") - F.col("clon")) * KM_PER_DEGREE * F.cos(F.radians("clat")), (F.col("lat") - F.col("clat")) * KM_PER_DEGREE
    cell = lambda v: F.floor(F.col(v) / tol_km)
    asked = grid.join(centre, "case_id").select("case_id", "i", "j", x.alias("gx"), y.alias("gy")).withColumn("cx", cell("gx")).withColumn("cy", cell("gy"))
    around = F.explode(F.array(*[F.struct((cell("px") + a).alias("cx"), (cell("py") + b).alias("cy")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    p = p.join(centre, "case_id").select("case_id", "row", "col", "height", "r", "amp", x.alias("px"), y.alias("py"))
    p = p.select("*", around.alias("c")).select("case_id", "row", "col", "height", "r", "amp", "px", "py", "c.cx", "c.cy")
    d = F.hypot(F.col("gx") - F.col("px"), F.col("gy") - F.col("py"))
    near = asked.join(p, ["case_id", "cx", "cy"]).withColumn("d", d).where(F.col("d") < tol_km)
    best = near.groupBy("case_id", "i", "j").agg(F.min_by(F.struct("height", "r", "amp"), F.struct("d", "row", "col")).alias("m"))
    return grid.select("case_id", "i", "j").join(best, ["case_id", "i", "j"], "left").select("case_id", "i", "j", "m.height", "m.r", "m.amp")


def case_feet(boxes: DataFrame, sat: int, pad_km: float, heights_km: tuple[float, float]) -> DataFrame:
    """(case_id, scan_id, x0, x1, y0, y1): the scan angles under each box, for clouds at both heights, from a lattice of 9 x 9 points per height."""
    at = lambda lo, hi, k: F.col(lo) + (F.col(hi) - F.col(lo)) * F.col(k) / 8
    x = boxes
    for k in ("p", "q"):
        x = x.withColumn(k, F.explode(F.sequence(F.lit(0), F.lit(8))))
    x = x.select("case_id", "scan_id", at("lat0", "lat1", "p").alias("lat"), at("lon0", "lon1", "q").alias("lon"), F.explode(F.array(*map(F.lit, heights_km))).alias("h"))
    x = geos_forward(apparent_position(x, F.col("h"), SAT_LON[sat]), SAT_LON[sat], "alat", "alon")
    pad = pad_km / 37000.0
    ends = [(f(c) + (pad if k else -pad)).alias(f"{n}{k}") for n, c in (("x", "x_rad"), ("y", "y_rad")) for k, f in ((0, F.min), (1, F.max))]
    return x.groupBy("case_id", "scan_id").agg(*ends).where("x0 is not null and y0 is not null")


def crop_to_case(pixels: DataFrame, boxes: DataFrame, sat: int, pad_km: float = 60.0, heights_km: tuple[float, float] = (8.0, 16.0)) -> DataFrame:
    """The pixels (scan_id, row, col, x_rad, y_rad, ...) under each case's box (case_id, scan_id, lat0, lat1, lon0, lon1), for clouds at both heights.

    Footprints are widened by ``pad_km`` and cut into cells of scan angle, so pixels meet cases by scan and cell: a pixel meets the cases around it, however
    many its scan has. What lies outside all footprints is left out by plain bounds, which the scan of a table can skip row groups by
    (``write_pixels`` keeps neighbours together). A case off the sector has no pixels.
    """
    feet = case_feet(boxes, sat, pad_km, heights_km)
    ends = feet.agg(*[f(c).alias(c) for c, f in (("x0", F.min), ("x1", F.max), ("y0", F.min), ("y1", F.max))]).first()
    if ends.x0 is None:
        return pixels.withColumn("case_id", F.lit(None).cast(dict(boxes.dtypes)["case_id"])).where("false")
    near = pixels.where(F.col("x_rad").between(ends.x0, ends.x1) & F.col("y_rad").between(ends.y0, ends.y1))
    cells = lambda n: F.explode(F.sequence(F.floor(F.col(f"{n}0") / CELL_RAD), F.floor(F.col(f"{n}1") / CELL_RAD))).alias(f"c{n}")
    f = feet.select("*", cells("x")).select("*", cells("y")).withColumnsRenamed({c: f"__{c}" for c in ("x0", "x1", "y0", "y1")})
    near = near.withColumn("cx", F.floor(F.col("x_rad") / CELL_RAD)).withColumn("cy", F.floor(F.col("y_rad") / CELL_RAD))
    on = F.col("x_rad").between(F.col("__x0"), F.col("__x1")) & F.col("y_rad").between(F.col("__y0"), F.col("__y1"))
    return near.join(f, ["scan_id", "cx", "cy"]).where(on).drop("cx", "cy", "__x0", "__x1", "__y0", "__y1")


def shared_inputs(variants: DataFrame, signature: tuple[str, ...]) -> DataFrame:
    """(signature columns, load_id, variants): variants whose inputs are equal share one load, which a run persists once."""
    return variants.groupBy(*signature).agg(F.array_sort(F.collect_list("name")).alias("variants")).withColumn("load_id", F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in signature]), 256), 1, 10))


def case_diagnostics(cases: DataFrame, stripes: DataFrame, maps: DataFrame, overlap: DataFrame, grids: DataFrame, native: DataFrame | None = None) -> DataFrame:
    """One row per case: offset, domains, zenith angles, stripes, grid size, valid share and map coverage, and what ``native_diagnostics`` says, if given.

    ``cases``: case_id, offset_s, domain_east, domain_west, vza_east, vza_west. ``stripes``: case_id, score, flagged.
    """
    s = stripes.groupBy("case_id").agg(F.max("score").alias("stripe_max"), F.sum(F.col("flagged").cast("long")).alias("stripe_rows"))
    m = maps.groupBy("case_id").agg(F.avg(F.col("height").isNotNull().cast("double")).alias("map_coverage"))
    x = cases.join(s, "case_id", "left").join(m, "case_id", "left").join(overlap, "case_id", "left").join(grids.select("case_id", F.col("n_lat").alias("grid_ny"), F.col("n_lon").alias("grid_nx")), "case_id", "left")
    x = x if native is None else x.join(native, "case_id", "left")
    return x.withColumn("vza_max", F.greatest("vza_east", "vza_west")).withColumn("stripe_rows", F.coalesce("stripe_rows", F.lit(0)))


def obs_mask(maps: DataFrame, s_min: float) -> DataFrame:
    """Heights of pixels whose s_eff is below the floor, or missing, go; a floor of 0 keeps all."""
    return maps if s_min <= 0 else maps.withColumn("height", F.when(F.col("s_eff") >= s_min, F.col("height")))


def isolate_errors(cases: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Cases that fail a check get qc = error and the first failing check's name as error; nothing else stops.

    A check is a condition that must hold; one that cannot be told (NULL) fails.
    """
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    return cases.withColumn("error", reason).withColumn("qc", F.when(F.col("error").isNotNull(), "error").otherwise(F.col("qc")))


def isolate_faults(cases: DataFrame, faults: DataFrame) -> DataFrame:
    """Cases one of whose inputs is at fault (case_id, file, reason: ``read_listed``) get qc = error, with the first file's reason.

    ``cases`` may have a row per variant: a fault is shared by all that use the input. A case that failed a check before keeps its own error.
    """
    first = faults.groupBy("case_id").agg(F.min_by("reason", "file").alias("__fault"))
    x = cases.join(first, "case_id", "left")
    own = F.col("error") if "error" in cases.columns else F.lit(None).cast("string")
    return x.withColumn("error", F.coalesce(own, "__fault")).withColumn("qc", F.when(F.col("__fault").isNotNull(), "error").otherwise(F.col("qc"))).drop("__fault")


def lidar_bin(curtain: DataFrame, k: int, floor: float, alt: tuple[float, float], whole: int | None = None) -> DataFrame:
    """(granule, bin, alt_km, lat, beta): means of k consecutive profiles between two altitudes, cut off below ``floor``.

    A bin counts if it has ``whole`` values (k, unless profiles are thinned out): a rest of less is left out.
    """
    x = curtain.where(F.col("alt_km").between(*alt)).withColumn("bin", F.floor(F.col("idx") / k))
    g = x.groupBy("granule", "bin", "alt_km").agg(F.avg("lat").alias("lat"), F.avg("beta").alias("beta"), F.count("*").alias("n"))
    return g.where(F.col("n") == (k if whole is None else whole)).select("granule", "bin", "alt_km", "lat", F.greatest(F.col("beta"), F.lit(floor)).alias("beta"))
