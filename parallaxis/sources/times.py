"""Reading times and scan attributes: what sources hand on is UTC timestamps and typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed value: the epoch J2000 (2000-01-01 12:00 UTC) in Unix seconds.
J2000 = 946_728_000


def decode_time(df: DataFrame, seconds: str, text: str) -> DataFrame:
    """Adds t from J2000 seconds, else from ISO text; NULL if neither can be read."""
    from_seconds = F.timestamp_micros((F.lit(J2000 * 1_000_000) + F.round(F.col(seconds) * 1e6)).cast("long"))
    return df.withColumn("t", F.coalesce(from_seconds, F.try_to_timestamp(F.col(text))).cast("timestamp_ntz"))


def decode_lidar_utc(df: DataFrame, column: str) -> DataFrame:
    """Adds t from yymmdd.fraction of a day (years from 2000)."""
    day = F.floor(column).cast("long")
    base = F.make_date((2000 + F.floor(day / 10000)).cast("int"), F.pmod(F.floor(day / 100), F.lit(100)).cast("int"), F.pmod(day, F.lit(100)).cast("int"))
    micros = F.round((F.col(column) - day) * 86_400e6).cast("long")
    return df.withColumn("t", F.timestamp_micros(F.unix_date(base).cast("long") * 86_400_000_000 + micros).cast("timestamp_ntz"))


# The four names that may say the mode, in this order, and how they say it.
def scan_mode(scans: DataFrame, columns: tuple[str, ...] = ("dataset_name", "filename", "id", "timeline_id")) -> DataFrame:
    """Adds mode, from -M(digit)C(two digits), else Mode (digit), in the first column that has one; rows without are dropped."""

    def found(pattern: str) -> list[Column]:
        return [F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), pattern, 1), F.lit("")) for c in map(F.col, columns)]

    per_column = [x for pair in zip(found(r"-M(\d)C\d\d"), found(r"Mode\s*(\d)")) for x in pair]
    return scans.withColumn("mode", F.coalesce(*per_column).cast("int")).where("mode is not null")


def scan_window(scans: DataFrame) -> DataFrame:
    """Adds w0 and w1: the bounds (b0, b1), else the coverage (c0, c1), each only if it ends after it starts."""
    bounds = F.when(F.col("b1") > F.col("b0"), F.struct(F.col("b0").alias("w0"), F.col("b1").alias("w1")))
    coverage = F.when(F.col("c1") > F.col("c0"), F.struct(F.col("c0").alias("w0"), F.col("c1").alias("w1")))
    w = F.coalesce(bounds, coverage)
    return scans.withColumn("w", w).select(*scans.columns, "w.w0", "w.w1")


def with_btd(pixels: DataFrame, a: int, b: int) -> DataFrame:
    """(scan_id, i, j, btd): the difference of two channels; NULL if either is missing. One grouped pass, no self-join."""
    of = lambda ch: F.max(F.when(F.col("ch") == ch, F.col("cmi").cast("double")))
    return pixels.where(F.col("ch").isin(a, b)).groupBy("scan_id", "i", "j").agg((of(a) - of(b)).alias("btd"))
