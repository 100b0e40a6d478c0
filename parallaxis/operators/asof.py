"""As-of joins in time: the scan nearest to a frame, by buckets of time so that no join is without a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def nearest_scan(schedule: DataFrame, scans: DataFrame, within_s: int = 3600, keys: tuple[str, ...] = ("sat",)) -> DataFrame:
    """Each frame's (case_id, keys, t) nearest scan of its satellite (and channel, if ``keys`` has one) within ``within_s``; CONUS (C) before full disk.

    Frames and scans of a key stand in one order of time, cut into buckets of ``within_s``; every frame takes the last scan
    before it and the first one behind it of each domain, by window frames. What a bucket does not hold is carried over from
    the ends of the buckets beside it, so nothing is multiplied and the work grows with frames and scans. Ties go to the smaller
    scan_id. Frames without a scan in reach stay, with NULLs.
    """
    width = within_s * 1_000_000
    frames = schedule.select("case_id", *keys, micros("t").alias("us"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("long").alias("scan_id"))
    known = scans.select(F.lit(None).cast("string").alias("case_id"), *keys, micros("t").alias("us"), "domain", F.col("scan_id").cast("long").alias("scan_id"))
    known = known.groupBy("case_id", *keys, "us", "domain").agg(F.min("scan_id").alias("scan_id"))
    x = frames.unionByName(known).withColumn("bucket", F.floor(F.col("us") / width))
    # the first and the last scan of each bucket and domain also stand in the buckets beside it
    ends = x.where("scan_id is not null").groupBy(*keys, "domain", "bucket").agg(F.min(F.struct("us", "scan_id")).alias("first"), F.max(F.struct(F.col("us"), F.col("scan_id"))).alias("last"))
    carried = ends.select(*keys, "domain", F.explode(F.array(F.struct((F.col("bucket") + 1).alias("b"), F.col("last").alias("s")), F.struct((F.col("bucket") - 1).alias("b"), F.col("first").alias("s")))).alias("c"))
    carried = carried.select(F.lit(None).cast("string").alias("case_id"), *keys, F.col("c.s.us").alias("us"), "domain", F.col("c.s.scan_id").alias("scan_id"), F.col("c.b").alias("bucket"))
    x = x.unionByName(carried)
    row = F.struct("us", "scan_id")
    before = Window.partitionBy(*keys, "bucket").orderBy("us").rangeBetween(Window.unboundedPreceding, 0)
    # the same rows counted from the other end: a frame that only grows is read once, one that shrinks is read anew for every row
    behind = Window.partitionBy(*keys, "bucket").orderBy(F.desc("us")).rangeBetween(Window.unboundedPreceding, 0)
    for d in ("C", "F"):
        own = F.when((F.col("domain") == d) if d == "C" else (F.col("domain") != "C"), row)
        x = x.withColumn(f"p{d}", F.max(own).over(before)).withColumn(f"n{d}", F.min(own).over(behind))
    gap = lambda s: F.abs(F.col(f"{s}.us") - F.col("us"))
    option = lambda s, k, d: F.when(gap(s) <= width, F.struct(F.lit(k).alias("k"), gap(s).alias("gap"), F.col(f"{s}.scan_id").alias("scan_id"), F.col(f"{s}.us").alias("at")))
    best = F.array_min(F.array_compact(F.array(*[option(f"{w}{d}", k, d) for k, d in enumerate("CF") for w in "pn"])))
    out = x.where("case_id is not null").withColumn("best", best)
    return out.select("case_id", *keys, F.col("best.scan_id").alias("scan_id"), F.when(F.col("best.k") == 0, "C").when(F.col("best.k") == 1, "F").alias("domain"), ((F.col("best.at") - F.col("us")) / 1e6).alias("dt_s"))


def same_scan_check(frames: DataFrame, within_s: float = 60.0) -> DataFrame:
    """Frames (case_id, sat, domain, t) whose channels share a domain and lie close in time."""
    g = frames.groupBy("case_id", "sat").agg(F.count_distinct("domain").alias("domains"), ((F.max(micros("t")) - F.min(micros("t"))) / 1e6).alias("span_s"))
    return g.withColumn("fits", (F.col("domains") == 1) & (F.col("span_s") <= within_s))


def dt_stats(pixels: DataFrame) -> DataFrame:
    """Per case the median, least, largest and largest absolute time difference (dt_s) of its pixels, and 30 s swaths touched."""
    return pixels.groupBy("case_id").agg(
        F.percentile("dt_s", F.lit(0.5)).alias("dt_median"), F.min("dt_s").alias("dt_min"), F.max("dt_s").alias("dt_max"), F.max(F.abs("dt_s")).alias("dt_absmax"),
        F.count_distinct(F.floor(F.col("dt_s") / 30)).alias("swaths"),
    )
