"""Building and selecting cases: scene tables, boxes, splits, schedules, what is left to do, run logs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.safe import few
from .geometry import SAT_LON, view_geometry

PAD_LAT, PAD_LON = 0.30, 0.70


def scene_table(profiles: DataFrame) -> DataFrame:
    """Per case_id: n, median time, lat, lon, top, sample sd of top, and its scene number, by n falling, then id."""
    middle = lambda c: F.percentile(c, F.lit(0.5))
    t = profiles.groupBy("case_id").agg(
        F.count("*").alias("n"), F.timestamp_micros(F.floor(middle(F.unix_micros(F.col("time").cast("timestamp"))))).alias("time"),
        middle("lat").alias("lat"), middle("lon").alias("lon"), middle("top_km").alias("top_km"), F.stddev_samp("top_km").alias("top_sd"),
    )
    # a scene's number: scenes of larger n, and those of its own n before it; no window over all scenes
    per_n = t.groupBy("n").agg(F.count("*").alias("scenes"))
    larger = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)  # a row per distinct n
    before = per_n.select(F.col("n").alias("own_n"), F.coalesce(F.sum("scenes").over(larger), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("n").orderBy("case_id"))
    return t.join(before, F.col("n") == F.col("own_n")).withColumn("scene", (F.col("before") + own - 1).cast("long")).drop("own_n", "before")


def numbered(ids: DataFrame, column: str, name: str = "i", prefix: int = 7) -> DataFrame:
    """Adds ``name``, the place of each distinct id (text) in ascending order, from 0.

    Ids are counted by their leading characters and numbered among equal ones, so that no task gets all ids.
    """
    x = ids.withColumn("__lead", F.substring(column, 1, prefix))
    per = x.groupBy("__lead").agg(F.count("*").alias("__k"))
    ahead = Window.orderBy("__lead").rowsBetween(Window.unboundedPreceding, -1)  # a row per leading part
    before = per.select(F.col("__lead").alias("__l"), F.coalesce(F.sum("__k").over(ahead), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__lead").orderBy(column))
    return x.join(before, F.col("__lead") == F.col("__l")).withColumn(name, F.col("__before") + own - 1).drop("__lead", "__l", "__before")


def bbox_around(points: DataFrame, pad_lat: float = PAD_LAT, pad_lon: float = PAD_LON) -> DataFrame:
    return points.groupBy("case_id").agg(
        (F.min("lat") - pad_lat).alias("lat0"), (F.max("lat") + pad_lat).alias("lat1"), (F.min("lon") - pad_lon).alias("lon0"), (F.max("lon") + pad_lon).alias("lon1")
    )


def make_cases(profiles: DataFrame) -> DataFrame:
    """Scenes with their boxes; the time is floored to the second, the anchor is the median position."""
    scenes = scene_table(profiles).withColumn("time", F.date_trunc("second", "time"))
    return scenes.withColumnRenamed("lat", "anchor_lat").withColumnRenamed("lon", "anchor_lon").join(bbox_around(profiles), "case_id")


def assign_split(cases: DataFrame, holdout: float = 0.3, salt: str = "split-v1") -> DataFrame:
    """Adds split, holdout or dev, by a hash of the id alone."""
    u = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("case_id")), 256), 1, 12), 16, 10).cast("long") / F.lit(float(16**12))
    return cases.withColumn("split", F.when(u < holdout, "holdout").otherwise("dev"))


def anchor_vza(cases: DataFrame, sats: tuple[int, ...] = (16, 17)) -> DataFrame:
    """Adds vza_max: the largest zenith angle at which a satellite of ``sats`` sees the case's anchor (anchor_lat, anchor_lon)."""
    at = cases.withColumn("lat", F.col("anchor_lat")).withColumn("lon", F.col("anchor_lon"))
    for s in sats:
        at = view_geometry(at, SAT_LON[s]).withColumnRenamed("vza", f"vza_{s}").drop("vaz", "slant_km")
    angles = [F.col(f"vza_{s}") for s in sats]
    return at.select(*[F.col(c) for c in cases.columns if c != "vza_max"], (F.greatest(*angles) if len(sats) > 1 else angles[0]).alias("vza_max"))


def select_cases(cases: DataFrame, split: str = "dev", n: int | None = None, max_vza: float | None = None, salt: str = "split-v1", order: str = "random") -> DataFrame:
    """The first n cases of a split, seen at no more than ``max_vza`` (a column vza_max: ``anchor_vza`` makes it).

    ``order``: random, a fixed order by hash, or table, by the column scene, which numbers cases from the one with most points.
    """
    if order not in ("random", "table"):
        raise ValueError(f"unknown order {order!r}")
    t = cases if max_vza is None else cases.where(F.col("vza_max") <= max_vza)
    t = t if split == "all" else assign_split(t, salt=salt).where(F.col("split") == split).drop("split")
    if n is None:
        return t
    first = "scene" if order == "table" else F.sha2(F.concat(F.lit(f"{salt}:order:"), F.col("case_id")), 256)
    return t.orderBy(first, "case_id").limit(n)


def frame_schedule(cases: DataFrame, sats: tuple[int, ...] = (16, 17), offsets: tuple[int, ...] = (0,)) -> DataFrame:
    """case x satellite x frame offset (minutes), with the frame's time."""
    frames = cases.select("case_id", "time", F.explode(F.array(*map(F.lit, sats))).alias("sat"))
    frames = frames.select("case_id", "time", "sat", F.explode(F.array(*map(F.lit, offsets))).alias("offset_min"))
    return frames.withColumn("t", (F.col("time").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("offset_min"), F.lit(0).cast("decimal(18,6)"))).cast("timestamp_ntz")).drop("time")


def todo(cases: DataFrame, variants: DataFrame, committed: DataFrame) -> DataFrame:
    """(case_id, variant) pairs without a commit that is no error. Variants are few."""
    return cases.select("case_id").crossJoin(few(variants)).join(committed.where("qc <> 'error'").select("case_id", "variant"), ["case_id", "variant"], "left_anti")


def config_hash(variants: DataFrame) -> DataFrame:
    """Adds config_hash: the first ten digits of the SHA-256 of the settings (struct config) as canonical JSON.

    Keys are sorted, also in nested structs, text is quoted, lists keep their order, and a setting's type is its column's: what is a
    double is written as one, so 30 and 30.0 hash alike and the text "30" does not.
    """
    return variants.withColumn("config_hash", F.substring(F.sha2(canonical_json(F.col("config"), variants.schema["config"].dataType), 256), 1, 10))


def canonical_json(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(json.dumps(f.name) + ": "), canonical_json(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        text = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.StringType):
        text = F.regexp_extract(F.to_json(F.struct(value.alias("x"))), r"(?s)^\{.x.:(.*)\}$", 1)
    else:
        text = value.cast("string")  # numbers and booleans; doubles always have a point
    return F.coalesce(text, F.lit("null"))


def config_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Settings (key, value) that differ between two configurations, with both values."""
    x, y = a.select("key", F.col("value").alias("a")), b.select("key", F.col("value").alias("b"))
    return x.join(y, "key", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))


def contract_violations(cases: DataFrame, verdicts: tuple[str, ...] = ("ok", "offset", "coverage", "no_data", "error")) -> DataFrame:
    """Rows that break the table's contract, each with its first reason."""
    reason = F.when(F.col("case_id").isNull(), "no case_id").when(F.col("qc").isNull() | ~F.col("qc").isin(*verdicts), "unknown verdict").when(~F.col("vza_max").between(0, 90), "vza_max out of range")
    return cases.withColumn("reason", reason).where("reason is not null")


def missing_columns(df: DataFrame, required: tuple[str, ...]) -> list[str]:
    """Required columns that a table lacks; a table that lacks some is refused before its rows are read."""
    return sorted(set(required) - set(df.columns))


def shape_violations(maps: DataFrame, grids: DataFrame, fields: tuple[str, ...] = ("height", "r", "amp")) -> DataFrame:
    """(case_id, reason): maps (case_id, i, j, fields) that are not whole rectangles of their grid (case_id, n_lat, n_lon).

    A map must have each cell of its grid once, none outside it, and a grid of its own; each case has its first reason. Fields are
    columns, so all have the grid's shape if the cells do; a field that is no column is named by ``missing_columns``.
    """
    lacking = missing_columns(maps, ("case_id", "i", "j", *fields))
    if lacking:
        raise ValueError(f"the maps lack {lacking}")
    own = maps.join(grids.select("case_id", "n_lat", "n_lon"), "case_id", "left")
    inside = F.col("i").between(0, F.col("n_lat") - 1) & F.col("j").between(0, F.col("n_lon") - 1)
    seen = own.groupBy("case_id", "n_lat", "n_lon", "i", "j").agg(F.count("*").alias("k"), F.first(inside).alias("inside"))
    x = seen.groupBy("case_id", "n_lat", "n_lon").agg(F.count("*").alias("cells"), F.max("k").alias("most"), F.count(F.when(~F.coalesce("inside", F.lit(False)), 1)).alias("outside"))
    reason = F.when(F.col("n_lat").isNull(), "no grid").when(F.col("outside") > 0, "cells outside the grid").when(F.col("most") > 1, "repeated cells").when(F.col("cells") < F.col("n_lat") * F.col("n_lon"), "cells are missing")
    return x.select("case_id", reason.alias("reason")).where("reason is not null")


def no_data_gate(cases: DataFrame, limit_s: float = 120.0) -> DataFrame:
    """Cases worth matching: the views are no more than ``limit_s`` apart."""
    return cases.where(F.abs("offset_s") <= limit_s)


def needs_wind(cases: DataFrame, least_s: float = 2.0, per_pixel: bool = False) -> DataFrame:
    return cases.withColumn("needs_wind", F.lit(True) if per_pixel else F.abs("offset_s") >= least_s)


def scene_qc(cases: DataFrame, min_valid: float = 0.5, max_residual_km: float = 0.25, max_offset_s: float = 8.0) -> DataFrame:
    """Adds verdict: coverage, then offset, then ok. Needs valid_frac, residual_km (NULL without wind), offset_s."""
    off = F.when(F.col("residual_km").isNotNull(), F.col("residual_km") > max_residual_km).otherwise(F.abs("offset_s") >= max_offset_s)
    return cases.withColumn("verdict", F.when(F.coalesce(F.col("valid_frac") < min_valid, F.lit(True)), "coverage").when(off, "offset").otherwise("ok"))


def wind_sigma_displacement(cases: DataFrame, base: float = 2.0, share: float = 0.1) -> DataFrame:
    """Adds displacement_km and residual_km: how far the wind (u, v) carries in dt_s, and how unsure that is."""
    speed, dt = F.hypot("u", "v"), F.abs("dt_s")
    return cases.withColumn("displacement_km", speed * dt / 1000).withColumn("residual_km", (F.lit(base) + share * speed) * dt / 1000)
