"""Retrieval of many cases in one run: from scans and their pixels to verdicts, maps and profiles.

The steps are the operators of this package, each keyed by case, so that any number of cases, with grids of their own, are one
plan and not a loop. Tables that several steps read (frames, cropped views, maps) are written once. A case that can't be
retrieved becomes a row with its reason and stops no other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..sources.tables import write_maps, write_run
from .asof import micros, nearest_scan
from .cases import anchor_vza, scene_qc, wind_sigma_displacement
from .conditioning import condition_diagnostics, footprints, observability
from .geometry import disparity_axis, grid_points, height_candidates, km_filters, make_grid
from .matching import View, case_diagnostics, crop_to_case, grid_sizes, kept, match_snapshot, obs_mask, project_view, sampled
from .stencil import flag_stripes, height_map, mask_rows, row_stripe_scores
from .timing import wind_profile_at
from .truth import attach_truth, wind_at_height


@dataclass(frozen=True)
class Settings:
    """What a variant of the retrieval may change. ``sats``: the reference view, then the other; rows of ``west`` may be striped."""

    sats: tuple[int, int] = (16, 17)
    west: int = 17
    channels: tuple[int, int] = (13, 15)
    h_lo: float = 8.0
    h_hi: float = 16.0
    h_step: float = 0.25
    px_km: float = 2.0
    hp_km: float = 16.0
    win_km: float = 20.0
    prep: str = "hp"
    r_min: float = 0.35
    amp_min: float = 0.25
    s_min: float = 0.0
    within_s: int = 3600
    no_data_s: float = 120.0
    wind_from_s: float = 2.0
    min_valid: float = 0.5
    max_residual_km: float = 0.25
    max_offset_s: float = 8.0
    stripe_sigma: float = 3.0
    stripe_rows: int = 1


@dataclass
class Retrieved:
    """``cases``: a row per case with its verdict and diagnostics. ``maps``: case_id, i, j, height, r, amp, s_eff. ``profiles``: a row per truth point."""

    cases: DataFrame
    maps: DataFrame
    profiles: DataFrame | None


def frames_of(cases: DataFrame, scans: DataFrame, s: Settings) -> DataFrame:
    """(case_id, sat, scan_id, domain, t, x0, dx, y0, dy): the scan of each view nearest to each case's time; NULL without one in reach."""
    asked = cases.select("case_id", F.explode(F.array(*map(F.lit, s.sats))).alias("sat"), F.col("time").alias("t"))
    near = nearest_scan(asked, scans, s.within_s).select("case_id", "sat", "scan_id", "domain")
    return near.join(scans.select("scan_id", "t", "x0", "dx", "y0", "dy"), "scan_id", "left")


def pairs_of(frames: DataFrame, s: Settings) -> DataFrame:
    """(case_id, ref_t, offset_s, domains): how much later the other view was taken; NULL where a view has no scan."""
    of = lambda sat, c: F.max(F.when(F.col("sat") == sat, F.col(c)))
    east = next(x for x in s.sats if x != s.west)
    t = frames.withColumn("us", micros("t")).groupBy("case_id").agg(of(s.sats[0], "t").alias("ref_t"), ((of(s.sats[1], "us") - of(s.sats[0], "us")) / 1e6).alias("offset_s"), of(east, "domain").alias("domain_east"), of(s.west, "domain").alias("domain_west"))
    return t


def view_of(sat: int, live: DataFrame, frames: DataFrame, pixels: DataFrame, stripes: DataFrame | None, pairs: DataFrame, s: Settings, times: DataFrame | None) -> View:
    """The pixels of one satellite under each live case, as the matching takes them, with flagged rows missing."""
    own = frames.where(F.col("sat") == sat).join(live, "case_id")
    a, b = s.channels
    mine = pixels.where((F.col("sat") == sat) & F.col("ch").isin(a, b)).select("scan_id", "ch", "row", "col", "x_rad", "y_rad", "cmi")
    under = crop_to_case(mine, own.select("case_id", "scan_id", "lat0", "lat1", "lon0", "lon1"), sat, heights_km=(s.h_lo, s.h_hi))
    of = lambda ch: F.max(F.when(F.col("ch") == ch, F.col("cmi").cast("double")))
    under = under.groupBy("case_id", "scan_id", "row", "col").agg((of(a) - of(b)).alias("btd"))
    if stripes is not None:
        under = mask_rows(under.withColumnRenamed("row", "i"), stripes, ("scan_id",)).withColumnRenamed("i", "row")
    under = kept(under.select("case_id", "scan_id", "row", "col", "btd"), "view")
    axes = own.join(pairs.select("case_id", "ref_t"), "case_id").select("case_id", "x0", "dx", "y0", "dy", ((micros("t") - micros("ref_t")) / 1e6).alias("dt0_s"))
    if times is not None:
        times = kept(times.join(under.select("case_id", "scan_id", "row", "col"), ["scan_id", "row", "col"]).select("case_id", "row", "col", "sec"), "view-times")
    return View(sat, under.select("case_id", "row", "col", "btd"), axes, times)


def retrieve(cases: DataFrame, scans: DataFrame, pixels: DataFrame, fields: DataFrame | None = None, truth: DataFrame | None = None, times: DataFrame | None = None, settings: Settings = Settings()) -> Retrieved:
    """Heights of all cases (case_id, time, lat0, lat1, lon0, lon1, anchor_lat, anchor_lon).

    ``scans``: scan_id, sat, domain, t and the axes of the product (x0, dx, y0, dy). ``pixels``: as ``scan_pixels`` gives them. ``fields``: wind fields, which cases
    need whose views lie ``wind_from_s`` or more apart, or all if ``times`` (scan_id, row, col, sec after the scan's t) are given. ``truth``: points of cases.

    Verdicts: error (no scan of both views, or no wind where one is needed; the reason is in ``error``), no_data (views too far apart in time), then
    coverage, offset or ok. Only the last three have maps.
    """
    s = settings
    frames = kept(frames_of(cases, scans, s), "frames")
    pairs = kept(pairs_of(frames, s), "pairs")
    at = cases.join(pairs, "case_id", "left")
    near = F.abs("offset_s") <= s.no_data_s
    windy = (F.abs("offset_s") >= s.wind_from_s) if times is None else F.lit(True)
    asked = at.where(near & windy)
    none = cases.sparkSession.createDataFrame([], f"case_id {dict(cases.dtypes)['case_id']}, h double, u double, v double")
    winds = kept(none if fields is None else wind_profile_at(asked, fields).select("case_id", "h", "u", "v"), "winds")
    blown = winds.select("case_id").distinct().withColumn("blown", F.lit(True))
    at = at.join(blown, "case_id", "left").withColumn("blown", F.coalesce("blown", F.lit(False)))
    reason = F.when(F.col("offset_s").isNull(), "no scan of both satellites").when(near & windy & ~F.col("blown"), "no wind profile")
    at = kept(at.withColumn("error", reason).withColumn("live", F.col("error").isNull() & near), "states")
    live = at.where("live").select("case_id", "lat0", "lat1", "lon0", "lon1")
    still = at.where("live and not blown").select("case_id", F.lit(0.0).alias("h"), F.lit(0.0).alias("u"), F.lit(0.0).alias("v"))
    moves = winds.unionByName(still)

    used = frames.where(F.col("sat") == s.west).join(live.select("case_id"), "case_id", "left_semi").select("scan_id").distinct()
    a, b = s.channels
    of = lambda ch: F.max(F.when(F.col("ch") == ch, F.col("cmi").cast("double")))
    whole = pixels.where((F.col("sat") == s.west) & F.col("ch").isin(a, b)).join(used, "scan_id", "left_semi").groupBy("scan_id", F.col("row").alias("i"), F.col("col").alias("j")).agg((of(a) - of(b)).alias("btd"))
    scores = kept(row_stripe_scores(whole, ("scan_id",)), "stripe-scores")
    flagged = kept(flag_stripes(scores, s.stripe_sigma, s.stripe_rows, ("scan_id",)), "stripes")
    views = {sat: view_of(sat, live, frames, pixels, flagged if sat == s.west else None, pairs, s, times) for sat in s.sats}

    grids = km_filters(make_grid(live, s.px_km), s.hp_km, s.win_km)
    sizes, grid = grid_sizes(grids), grid_points(grids)
    centres = live.select("case_id", ((F.col("lat0") + F.col("lat1")) / 2).alias("lat"), ((F.col("lon0") + F.col("lon1")) / 2).alias("lon"))
    feet = None if s.prep == "hp" else footprints(centres, s.sats)
    heights = height_candidates(cases.sparkSession.range(1), s.h_lo, s.h_hi, s.h_step).select("h_idx", "h")
    cube, overlap = match_snapshot(grid, heights, views[s.sats[0]], views[s.sats[1]], sizes, moves, s.prep, feet)
    found = height_map(cube, s.h_lo, s.h_step, s.r_min, s.amp_min, round((s.h_hi - s.h_lo) / s.h_step) + 1, ("case_id",))
    bare = kept(grid.select("case_id", "i", "j").join(found, ["case_id", "i", "j"], "left"), "heights")

    middle = kept(live.select("case_id").join(bare.groupBy("case_id").agg(F.percentile("height", F.lit(0.5)).alias("h_median")), "case_id", "left"), "medians")
    ref = views[s.sats[0]]
    seen = project_view(grid.join(middle.select("case_id", F.coalesce("h_median", F.lit(11.0)).alias("h")), "case_id"), ref)
    field = sampled(seen, ref, ("case_id", "i", "j"))
    axis = disparity_axis(centres, *s.sats).select("case_id", "k", "axis")
    c = F.col
    s_eff = observability(field, c("n_i"), c("n_j"), (c("px_i"), c("px_j")), (c("sigma_i"), c("sigma_j")), (c("win_i"), c("win_j")), c("k"), c("axis"), ("case_id",), sizes=sizes.join(axis, "case_id"))
    maps = bare.join(s_eff.select("case_id", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "s_eff"), ["case_id", "i", "j"], "left")
    maps = kept(obs_mask(maps, s.s_min).select("case_id", "i", "j", "height", "r", "amp", "s_eff"), "maps")

    # verdicts: the wind's uncertainty at the median height
    on = F.col("height").isNotNull() & F.col("s_eff").isNotNull()
    told = maps.groupBy("case_id").agg(F.percentile("height", F.lit(0.5)).alias("h_median"), F.percentile(F.when(on, F.col("s_eff")), F.lit(0.5)).alias("s_eff_median"))
    x = at.where("live").select("case_id", "offset_s", "blown").join(told, "case_id", "left").join(overlap, "case_id", "left").withColumn("h_qc", F.coalesce("h_median", F.lit((s.h_lo + s.h_hi) / 2)))
    x = wind_sigma_displacement(wind_at_height(x, winds, "h_qc").withColumn("dt_s", F.col("offset_s"))).withColumn("residual_km", F.when(F.col("blown"), F.col("residual_km")))
    verdicts = scene_qc(x, s.min_valid, s.max_residual_km, s.max_offset_s).select("case_id", "verdict", "h_median", "s_eff_median")

    east = next(v for v in s.sats if v != s.west)
    angle = lambda sat, name: anchor_vza(cases.select("case_id", "anchor_lat", "anchor_lon"), (sat,)).select("case_id", F.col("vza_max").alias(name))
    rows = at.select("case_id", "offset_s", "domain_east", "domain_west", "error", "live").join(angle(east, "vza_east"), "case_id").join(angle(s.west, "vza_west"), "case_id")
    west = frames.where(F.col("sat") == s.west).select("case_id", "scan_id")
    stripes = west.join(scores.join(flagged.withColumn("flagged", F.lit(True)), ["scan_id", "i"], "left"), "scan_id").select("case_id", "score", F.coalesce("flagged", F.lit(False)).alias("flagged"))
    out = case_diagnostics(rows, stripes, maps, overlap, grids).join(verdicts, "case_id", "left")
    if feet is not None:
        out = out.join(condition_diagnostics(feet, s.prep), "case_id", "left")
    qc = F.when(F.col("error").isNotNull(), "error").when(~F.col("live"), "no_data").otherwise(F.col("verdict"))
    out = kept(out.withColumn("qc", qc).drop("live", "verdict"), "cases")
    profiles = None
    if truth is not None:
        fine = truth.join(out.where("qc <> 'error'").select("case_id"), "case_id", "left_semi")
        profiles = attach_truth(fine, maps, grids, winds, pairs.select("case_id", F.col("ref_t").alias("map_time")))
    return Retrieved(out, maps, profiles)


def run(path: str, variant: str, config_hash: str, commit_seq: int, cases: DataFrame, *inputs: DataFrame, **more) -> Retrieved:
    """Retrieve what is left to do and commit it: maps first, then profiles and case rows at once. A crash leaves the stored run as it was."""
    found = retrieve(cases, *inputs, **more)
    write_maps(found.maps, f"{path}/fields")
    profiles = found.profiles if found.profiles is not None else cases.sparkSession.createDataFrame([], f"case_id {dict(cases.dtypes)['case_id']}, pid long")
    write_run(found.cases, profiles, path, variant, config_hash, commit_seq)
    return found
