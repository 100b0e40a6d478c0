"""Sources and sinks: typed Parquet, JSON-lines and CSV, partitioned so that a scan reads only what a run needs.

Schemas are explicit everywhere; NaN becomes NULL when a table is read or written.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Side of a cell of scan angle, rad: about 120 pixels of a full-disk channel.
CELL_RAD = 0.007
PIXELS = "scan_id long, t timestamp_ntz, row int, col int, x_rad double, y_rad double, cmi float, sat int, ch int, date date"
COLLOCATIONS = "pid long, case_id string, time timestamp_ntz, lat double, lon double, top_m double"
WIND_FIELDS = "time timestamp_ntz, level int, lat double, lon double, u double, v double, z double"
TIME_LUT = "row int, col int, sec float, tbl string, var string"
CASE_RESULTS = (
    "case_id string, commit_seq long, qc string, error string, offset_s double, vza_east double, vza_west double, vza_max double, "
    "valid_frac double, map_coverage double, h_median double, extra map<string,double>"
)
PROFILES = (
    "case_id string, pid long, contrail long, lat double, lon double, top_km double, h double, r double, s_eff double, "
    "h_raw double, lat_adv double, lon_adv double, dt_s double, disp_km double"
)
LIDAR = "granule string, idx long, t timestamp_ntz, lat double, lon double, alt_km double, beta double"
# Verdicts of old runs that still mean the same; all others judged something that no longer exists.
LEGACY_QC = ("no_data", "coverage", "offset")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder for derived tables: under spark.checkpoint.dir; a local temporary one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-tables-")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinite floats as NULL."""
    fine = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c)
    return df.select(*[fine(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def write_pixels(pixels: DataFrame, path: str) -> None:
    """Flattened imagery by satellite, channel and day; cells of a scan stand together, so that row groups can be skipped by scan angle."""
    x = finite(pixels.withColumn("date", F.to_date("t")))
    place = [F.floor(F.col(c) / CELL_RAD) for c in ("y_rad", "x_rad")]
    x.sortWithinPartitions("sat", "ch", "date", "scan_id", *place).write.mode("append").partitionBy("sat", "ch", "date").parquet(path)


def scan_pixels(spark: SparkSession, path: str, sats: tuple[int, ...], channels: tuple[int, ...], t0: str, t1: str) -> DataFrame:
    """The pixels of some satellites and channels with t0 <= t < t1; only their folders are read."""
    start, end = F.lit(t0).cast("timestamp_ntz"), F.lit(t1).cast("timestamp_ntz")
    days = F.col("date").between(start.cast("date"), end.cast("date"))
    return spark.read.schema(PIXELS).parquet(path).where(F.col("sat").isin(*sats) & F.col("ch").isin(*channels) & days & (F.col("t") >= start) & (F.col("t") < end))


def scan_collocations(spark: SparkSession, path: str, lon: tuple[float, float], lat: tuple[float, float], min_year: int) -> DataFrame:
    """Lidar points strictly inside the box and not before ``min_year``; pid is the row's place in the whole file, stored at ingest."""
    x = spark.read.schema(COLLOCATIONS).parquet(path)
    x = x.where((F.col("lon") > lon[0]) & (F.col("lon") < lon[1]) & (F.col("lat") > lat[0]) & (F.col("lat") < lat[1]))
    x = x.where(F.col("time") >= F.lit(f"{min_year}-01-01 00:00:00").cast("timestamp_ntz"))
    return x.withColumn("top_km", F.col("top_m") / 1000).drop("top_m")


def wind_field_faults(fields: DataFrame, levels: tuple[int, ...]) -> DataFrame:
    """(time, have): the times whose set of levels is not the one asked for, with the levels they hold."""
    have = fields.groupBy("time").agg(F.array_sort(F.collect_set("level")).alias("have"))
    return have.where(F.col("have") != F.array(*map(F.lit, sorted(set(levels)))))


def scan_wind_fields(spark: SparkSession, path: str, levels: tuple[int, ...], skip: bool = False) -> DataFrame:
    """Wind fields, of which every time must hold exactly the levels asked for: reading one that doesn't is an error.

    With ``skip`` such times give no profile; ``wind_field_faults`` says which they are.
    """
    x = finite(spark.read.schema(WIND_FIELDS).parquet(path))
    faults = wind_field_faults(x, levels)
    if skip:
        return x.join(faults, "time", "left_anti")
    told = F.concat(F.lit(f"asked for levels {sorted(set(levels))}, found "), F.col("have").cast("string"), F.lit(" at "), F.col("time").cast("string"))
    x = x.join(faults, "time", "left").withColumn("time", F.when(F.col("have").isNull(), F.col("time")).otherwise(F.raise_error(told).cast("timestamp_ntz")))
    return x.drop("have")


def scan_time_lut(spark: SparkSession, path: str, tables: tuple[str, ...] | None = None) -> DataFrame:
    """Scan seconds per [row, col] of time tables, stored by table and variable."""
    x = spark.read.schema(TIME_LUT).parquet(path)
    return x if tables is None else x.where(F.col("tbl").isin(*tables))


def last_by(df: DataFrame, keys: tuple[str, ...], order: Column) -> DataFrame:
    """Of the rows of a key the last one; all its columns travel as one struct, so a partial aggregate comes first."""
    whole = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.max_by(whole, order).alias("last")).select("last.*")


def with_place(lines: DataFrame, k: int = 0) -> DataFrame:
    """Rows of a text-based source with ``place``, which orders them as they stand: the source's number, the file's name, the split, the row.

    Spark packs splits into tasks by size, so the order of tasks says nothing; but a split is read from its start to its end by one task.
    """
    return lines.select("*", F.struct(F.lit(k).alias("source"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")).alias("place"))


def read_case_results(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Commit logs of JSON lines; of a case's lines the last one counts: by commit_seq if lines have it, then by their place.

    Files of a folder follow each other by name, several paths as they are given. Numbers that the schema doesn't name go to ``extra``. A line
    that is no whole object (a crash while it was written) commits nothing.
    """
    names = [c.split(" ")[0] for c in CASE_RESULTS.split(", ")]
    found = None
    for k, p in enumerate([path] if isinstance(path, str) else path):
        x = with_place(spark.read.text(p), k)
        x = x.select(F.from_json("value", CASE_RESULTS).alias("r"), F.from_json("value", "map<string,string>").alias("all"), "place").where("r.case_id is not null")
        found = x if found is None else found.unionByName(x)
    numbers = F.map_filter(F.transform_values("all", lambda _, v: v.try_cast("double")), lambda c, v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & ~c.isin(*names))
    extra = F.map_concat(F.coalesce("r.extra", F.expr("cast(map() as map<string,double>)")), F.map_filter(numbers, lambda c, _: ~F.coalesce(F.map_contains_key("r.extra", c), F.lit(False))))
    x = found.select(*[F.col(f"r.{c}").alias(c) for c in names if c != "extra"], extra.alias("extra"), F.struct(F.coalesce("r.commit_seq", F.lit(-1)).alias("seq"), "place").alias("order"))
    return finite(last_by(x, ("case_id",), F.col("order")).drop("order"))


def read_profiles(spark: SparkSession, paths: list[str], cases: DataFrame) -> DataFrame:
    """CSV profiles of committed cases. Each path has its own header: columns that old files lack are NULL.

    Of rows with one (case_id, pid) the last one stays, in the order of paths, of a folder's files by name, and of lines.
    """
    wanted = [c.strip().split(" ") for c in PROFILES.split(",")]
    found = None
    for k, path in enumerate(paths):
        x = with_place(spark.read.option("header", True).option("nanValue", "nan").csv(path), k)
        x = x.select(*[(F.expr(f"try_cast(`{c}` AS {t})") if c in x.columns else F.lit(None).cast(t)).alias(c) for c, t in wanted], "place")
        found = x if found is None else found.unionByName(x)
    found = found.join(cases.select("case_id"), "case_id", "left_semi")
    return finite(last_by(found, ("case_id", "pid"), F.col("place")).drop("place"))


def whole_attempts(commits: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """(key, attempt): of the attempts committed for one key the first, so that what a reader sees does not change when a retry commits again."""
    return commits.groupBy(*key).agg(F.min_by("attempt", F.struct("committed", "attempt")).alias("attempt"))


def read_commits(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The manifest beside a stored table; empty before the first commit."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/commits")


def read_stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, with all columns that its files have; one that has no files has the columns of ``schema`` and no rows."""
    try:
        return spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND"):
            raise
        return spark.createDataFrame([], schema)


def commit(rows: DataFrame, path: str, attempt: str) -> None:
    """Name an attempt in the manifest: one file, so that it is there as a whole or not at all."""
    rows.withColumn("attempt", F.lit(attempt)).withColumn("committed", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/commits")


RUN_COMMITS = "variant string, config_hash string, commit_seq long, attempt string, committed timestamp"


def write_run(cases: DataFrame, profiles: DataFrame, path: str, variant: str, config_hash: str, commit_seq: int) -> None:
    """Append a run: profiles, then the case rows, then one row of the manifest, which commits both tables at once.

    Every call stages its rows under an attempt of its own. Readers follow the manifest only, so a crash at any
    point leaves the run as it was, and a call with the same commit_seq may be repeated until it comes through: what an earlier one
    left is not read, and once one is committed the others do nothing. Values that are not finite become NULL.
    """
    spark, attempt = cases.sparkSession, uuid.uuid4().hex
    own = (F.col("variant") == variant) & (F.col("config_hash") == config_hash) & (F.col("commit_seq") == commit_seq)
    if read_commits(spark, path, RUN_COMMITS).where(own).head() is not None:
        return
    label = {"variant": variant, "config_hash": config_hash, "attempt": attempt}
    mark = lambda df: finite(df).withColumn("commit_seq", F.lit(commit_seq).cast("long")).withColumns({k: F.lit(v) for k, v in label.items()})
    mark(profiles).write.mode("append").partitionBy(*label).parquet(f"{path}/profiles")
    mark(cases).write.mode("append").partitionBy(*label).parquet(f"{path}/cases")
    commit(spark.range(1).select(F.lit(variant).alias("variant"), F.lit(config_hash).alias("config_hash"), F.lit(commit_seq).cast("long").alias("commit_seq")), path, attempt)


def read_run(spark: SparkSession, path: str, variant: str, config_hash: str) -> tuple[DataFrame, DataFrame]:
    """(cases, profiles) of a written run: each case's last commit, and the profiles of that commit only. Folders of other attempts are not read."""
    own = (F.col("variant") == variant) & (F.col("config_hash") == config_hash)
    whole = whole_attempts(read_commits(spark, path, RUN_COMMITS).where(own), ("commit_seq",)).select("attempt")
    labels = "commit_seq long, variant string, config_hash string, attempt string"
    stored = lambda t, columns: read_stored(spark, f"{path}/{t}", f"{columns}, {labels}").where(own)
    cases = last_by(stored("cases", "case_id string, qc string").join(whole, "attempt", "left_semi"), ("case_id",), F.struct("commit_seq", "attempt"))
    profiles = stored("profiles", PROFILES).join(cases.select("case_id", "attempt"), ["case_id", "attempt"], "left_semi")
    return cases.drop("attempt"), profiles.drop("attempt")


def map_key(case_id: str = "case_id") -> Column:
    return F.substring(F.sha1(F.col(case_id).cast("binary")), 1, 12)


MAPS = "key string, case_id string, i int, j int, height double, r double, shard string, attempt string"
MAP_COMMITS = "key string, shard string, seq long, attempt string, committed timestamp"


def write_maps(maps: DataFrame, path: str) -> None:
    """Maps under the first twelve digits of their case id's SHA-1; folders go by its first two, so that their number is bounded.

    A case that is written again is replaced. Each call stages its maps as a generation of their own and then names
    the keys it holds in the manifest, one file; until that file is there readers see the maps as they were. A key's last
    generation counts. One writer at a time.
    """
    spark, attempt = maps.sparkSession, uuid.uuid4().hex
    before = read_commits(spark, path, MAP_COMMITS).agg(F.max("seq")).first()[0]
    keyed = finite(maps).withColumn("key", map_key()).withColumn("shard", F.substring("key", 1, 2)).withColumn("attempt", F.lit(attempt))
    keyed.repartition("shard").write.mode("append").partitionBy("shard", "attempt").parquet(f"{path}/maps")
    held = read_stored(spark, f"{path}/maps", MAPS).where(F.col("attempt") == attempt).select("key", F.substring("key", 1, 2).alias("shard")).distinct()
    commit(held.withColumn("seq", F.lit((before or 0) + 1).cast("long")), path, attempt)


def last_maps(commits: DataFrame) -> DataFrame:
    """(key, shard, attempt): the generation that each key was written in last."""
    return commits.groupBy("key", "shard").agg(F.max_by("attempt", F.struct("seq", "committed", "attempt")).alias("attempt"))


def read_maps(spark: SparkSession, path: str) -> DataFrame:
    """All maps, of each key the last one."""
    current = last_maps(read_commits(spark, path, MAP_COMMITS))
    return read_stored(spark, f"{path}/maps", MAPS).join(current.drop("shard"), ["key", "attempt"], "left_semi").drop("shard", "attempt")


def read_map(spark: SparkSession, path: str, case_id: str) -> DataFrame:
    """One case's map; only the folder of its key's digits and its last generation is read. A case without a map has no rows."""
    key = hashlib.sha1(case_id.encode()).hexdigest()[:12]
    current = last_maps(read_commits(spark, path, MAP_COMMITS).where(F.col("key") == key)).head()
    x = read_stored(spark, f"{path}/maps", MAPS)
    own = F.lit(False) if current is None else (F.col("shard") == current.shard) & (F.col("attempt") == current.attempt) & (F.col("key") == key)
    return x.where(own).drop("shard", "attempt")


def append_experiment_log(table: DataFrame, path: str, names: tuple[str, str], hashes: tuple[str, str], gate: float, qc: tuple[str, ...], n_cases: int, split: str = "dev", note: str = "") -> None:
    """Append a comparison table with what it compared; one small file per comparison."""
    label = {"a": names[0], "b": names[1], "hash_a": hashes[0], "hash_b": hashes[1], "gate": gate, "qc": ",".join(qc), "split": split, "n_cases": n_cases, "note": note}
    out = table.select("*", *[F.lit(v).alias(k) for k, v in label.items()], F.date_trunc("second", F.current_timestamp()).alias("logged"))
    out.coalesce(1).write.mode("append").parquet(path)


def import_legacy(results: DataFrame, profiles: DataFrame, cases: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(case rows, profile rows, one-row report) of an old run.

    Scenes become case ids (inner), verdicts that no longer exist become ok and stay as qc_legacy. Truth points
    take the old row of their scene and position to five decimals, the first of equal ones. The report counts points
    without one, and warns above 1 % of the old rows.
    """
    rows = results.join(cases.select("scene", "case_id"), "scene").withColumnRenamed("qc", "qc_legacy")
    rows = rows.withColumn("qc", F.when(F.col("qc_legacy").isin(*LEGACY_QC), F.col("qc_legacy")).otherwise("ok")).withColumn("config_hash", F.lit("legacy")).withColumn("vza_max", F.greatest("vza_east", "vza_west"))
    place = lambda df: df.withColumn("klat", F.rint(F.col("lat") * 1e5).cast("long")).withColumn("klon", F.rint(F.col("lon") * 1e5).cast("long"))
    old = place(profiles).groupBy("scene", "klat", "klon").agg(F.min_by(F.struct("h_map", "r_map"), "line").alias("o"))
    known = truth.join(rows.select("case_id", "scene"), "case_id")
    m = place(known).join(old, ["scene", "klat", "klon"], "left").select("case_id", "pid", "lat", "lon", "top_km", F.col("o.h_map").alias("h"), F.col("o.r_map").alias("r"), F.lit(None).cast("double").alias("s_eff"))
    missed = m.agg(F.sum(F.col("h").isNull().cast("long")).alias("without")).crossJoin(profiles.agg(F.sum(F.col("h_map").isNull().cast("long")).alias("empty"), F.count("*").alias("old")))
    report = missed.select((F.col("without") - F.col("empty")).alias("unmatched"), "old", (F.col("without") - F.col("empty") > F.col("old") * 0.01).alias("warn"))
    return rows, m, report


def adhoc_case(spark: SparkSession, time: str, lat0: float, lat1: float, lon0: float, lon1: float) -> DataFrame:
    """One case without truth, of a time and a box; its anchor is the box's centre."""
    values = [F.lit(time).cast("timestamp_ntz").alias("time"), *[F.lit(v).alias(k) for k, v in {"lat0": lat0, "lat1": lat1, "lon0": lon0, "lon1": lon1}.items()]]
    x = spark.range(1).select(F.concat(F.lit("adhoc_"), F.date_format(F.lit(time).cast("timestamp_ntz"), "yyyyMMdd'T'HHmmss")).alias("case_id"), *values)
    return x.withColumn("anchor_lat", (F.col("lat0") + F.col("lat1")) / 2).withColumn("anchor_lon", (F.col("lon0") + F.col("lon1")) / 2)


def read_listed(spark: SparkSession, folder: str, schema: str, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their ``file``, faults: case_id, file, reason) of Parquet inputs that a listing (case_id, file, and n_rows if known) names.

    A file that is missing or can't be read gives no rows and stops nothing: what was listed is held against what came. A file that
    broke off on the way is told by n_rows, its number of rows; without that, one that gave any rows counts as read. File names are unique below ``folder``.
    """
    read = spark.read.schema(schema).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).option("recursiveFileLookup", True)
    rows = read.parquet(folder).select("*", F.col("_metadata.file_name").alias("file"))
    came = rows.groupBy("file").agg(F.count("*").alias("came"))
    x = listing.join(came, "file", "left").withColumn("came", F.coalesce("came", F.lit(0)))
    n = F.col("n_rows") if "n_rows" in listing.columns else F.lit(None).cast("long")
    reason = F.when((F.col("came") == 0) & F.coalesce(n > 0, F.lit(True)), F.concat(F.lit("unreadable input "), "file")).when(F.col("came") < n, F.concat(F.lit("incomplete input "), "file"))
    faults = x.withColumn("reason", reason).where("reason is not null").select("case_id", "file", "reason")
    return rows.join(faults.select("file").distinct(), "file", "left_anti"), faults


def truth_span(truth: DataFrame, seconds: float, degrees: float = 0.0) -> DataFrame:
    """Per case the time span and the box of its truth points, widened."""
    wide = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds).cast("decimal(18,6)"))
    ends = truth.groupBy("case_id").agg(F.min("time").alias("a"), F.max("time").alias("b"), *[f(c).alias(f"{c}{k}") for c in ("lat", "lon") for k, f in ((0, F.min), (1, F.max))])
    return ends.select("case_id", (F.col("a") - wide).alias("t0"), (F.col("b") + wide).alias("t1"), *[(F.col(f"{c}{k}") + (degrees if k else -degrees)).alias(f"{c}{k}") for c in ("lat", "lon") for k in (0, 1)])


def span_days(t0: str, t1: str) -> Column:
    """The days a time span touches: an equal key for joins of time ranges."""
    return F.explode(F.sequence(F.to_date(t0), F.to_date(t1)))


def scan_lidar_curtain(curtain: DataFrame, truth: DataFrame, pad_s: float = 20.0) -> DataFrame:
    """Backscatter profiles within each case's truth time span, widened by ``pad_s``; days give the join an equal key."""
    spans = truth_span(truth, pad_s).select("case_id", "t0", "t1", span_days("t0", "t1").alias("day"))
    x = curtain.withColumn("day", F.to_date("t"))
    return x.join(spans, (x["day"] == spans["day"]) & (x["t"] >= spans["t0"]) & (x["t"] <= spans["t1"])).drop("day", "t0", "t1")


def scan_granule_index(granules: DataFrame, truth: DataFrame, pad_min: float = 3.0, pad_deg: float = 1.0) -> DataFrame:
    """(case_id, granule): granules (granule, g0, g1, lat0, lat1, lon0, lon1) whose time span and box meet a case's truth, widened."""
    spans = truth_span(truth, 60 * pad_min, pad_deg).withColumn("day", span_days("t0", "t1")).alias("s")
    g = granules.withColumn("day", span_days("g0", "g1")).alias("g")
    on = (F.col("s.day") == F.col("g.day")) & (F.col("g.g0") <= F.col("s.t1")) & (F.col("g.g1") >= F.col("s.t0"))
    box = [(F.col(f"g.{c}0") <= F.col(f"s.{c}1")) & (F.col(f"g.{c}1") >= F.col(f"s.{c}0")) for c in ("lat", "lon")]
    return spans.join(g, on & box[0] & box[1]).select("case_id", "granule").distinct()
