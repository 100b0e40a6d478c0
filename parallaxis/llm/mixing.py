"""Mixing sources to target weights by Pareto order sampling.

Sources share a budget of words by weight, each up to a cap times its own words. A source's whole copies
come first; what is left is a fixed-size sample: documents are ranked by their random odds divided by their
inclusion odds and taken in that order while they fit. One closing document per source, the one whose size
is nearest to the words still missing, brings the total next to the target.

No source is ever gathered or sorted whole. Within a source odds fall into the order of the random number
itself, so a histogram over it, 256 bins and then 256 bins of the one that the sample ends in, finds a 65,536th of
the source to be ordered. Sources that only whole copies make up have no sample and no histogram. What is then
joined to the documents is one row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialise

WORD = r"[^\x20\x09-\x0D]+"
BINS = 1 << 8  # per level


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from a key's MD5, the same on every run and engine."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size), one row per source, with target added.

    Weights go to sources by code point, null last, repeating. Targets are min(cap * size, level * weight)
    with the level that spends ``share`` of all sizes: what is above a cap is shared again by weight.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    w = sizes.withColumn("weight", weight)
    by_cap = Window.orderBy((F.lit(cap) * F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    w = w.withColumn("full", F.coalesce(F.sum("source_size").over(by_cap), F.lit(0))).withColumn("spent", F.coalesce(F.sum("weight").over(by_cap), F.lit(0)))
    w = w.withColumn("level", (F.lit(share) * F.sum("source_size").over(every) - F.lit(cap) * F.col("full")) / (F.sum("weight").over(every) - F.col("spent")))
    fits = F.when(F.col("level") * F.col("weight") <= F.lit(cap) * F.col("source_size"), F.struct("spent", "level"))
    w = w.withColumn("level", F.min(fits).over(every)["level"])
    return w.select("source", "source_size", F.least(F.lit(cap) * F.col("source_size"), F.coalesce("level", F.lit(float("inf"))) * F.col("weight")).alias("target"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(measured documents, plan per source).

    Measured: doc_id, source, size, u for every document. Plan: source, source_size, target, copies, the
    last sampled key (last_v, last_id, last_size) and the closing document's key.
    """
    base = materialise(docs.select("doc_id", "source", words(F.col("text")).alias("size"), uniform(F.col("doc_id"), seed).alias("u")), "mix")
    targets = source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    targets = (
        targets.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
        .withColumn("p", F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(F.lit(0.0)))
    )
    targets = materialise(targets, "mix-targets")
    ranked = with_rank(base, targets)
    ends = edge_bin(edge_bin(None, ranked, F.floor(F.col("u") * BINS)), ranked, F.col("bin"))
    edge = ranked.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
    edge = edge.groupBy("source", "before", "rest", "v", "doc_id", "size").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy("v", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("upto", F.col("before") + F.sum("words").over(order)).where("upto <= rest")
    last = edge.groupBy("source").agg(F.max(F.struct("v", "doc_id", "size")).alias("last"), F.max("upto").alias("upto"))
    plan = (
        targets.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        .join(last.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2")
        .withColumn("gap", F.col("rest") - F.coalesce("upto", "before", F.lit(0)))
    )
    plan = materialise(plan, "mix-plan")
    # the closing document: of those not sampled, the one that leaves the least of the gap, if it leaves less than there is
    open_rows = with_rank(base, plan).where(~sampled())
    close = open_rows.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("miss"), "v", "doc_id", "size")).alias("close"))
    out = plan.join(close.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    out = out.withColumn("close", F.when(F.col("close.miss") < F.col("gap"), F.col("close")))
    return base, materialise(out, "mix-plan")


def edge_bin(found: DataFrame | None, ranked: DataFrame, bin_: Column) -> DataFrame:
    """(s, b, before): the first bin of each source in which the words go beyond what is left, and the words before it.

    ``found``, from coarser bins, restricts each source to one of them. At most BINS rows of a source meet.
    """
    x = ranked.where("rest > 0").withColumn("own", bin_.cast("int"))
    start = F.lit(0).cast("long")
    if found is not None:
        coarse = found.select(F.col("s").alias("s0"), F.col("b").alias("b0"), F.col("before").alias("start"))
        x = x.join(coarse, F.col("source").eqNullSafe(F.col("s0")) & (F.floor(F.col("own") / BINS) == F.col("b0")))  # a row per source
        start = F.col("start")
    hist = x.withColumn("start", start).groupBy("source", "own", "start", "rest").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("own").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("upto", F.col("start") + F.sum("words").over(upto)).where("upto > rest")
    first = hist.groupBy("source").agg(F.min(F.struct("own", (F.col("upto") - F.col("words")).alias("before"))).alias("e"))
    return first.select(F.col("source").alias("s"), F.col("e.own").alias("b"), F.col("e.before").alias("before"))


def with_rank(base: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds the source's plan and v = q / (1 + q), q: random odds divided by inclusion odds."""
    out = base.join(plan.withColumnRenamed("source", "plan_source"), F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
    q = (F.col("u") / (1 - F.col("u"))) / F.try_divide(F.col("p"), 1 - F.col("p"))
    v = F.when((F.col("p") > 0) & (F.col("p") < 1), q / (1 + q)).when(F.col("p") >= 1, F.lit(0.0)).otherwise(F.lit(1.0))
    return out.withColumn("v", v).withColumn("bin", F.floor(F.col("u") * (BINS * BINS)).cast("int"))


def sampled() -> Column:
    """Is the row in its source's sample? Documents at or before the last sampled key are."""
    key, last = F.struct("v", "doc_id", "size"), F.col("last")
    whole = (F.col("rest") > 0) & F.col("b").isNull()
    return F.coalesce(whole, F.lit(False)) | F.coalesce(F.col("bin") < F.col("b"), F.lit(False)) | F.coalesce(key <= last, F.lit(False))


def taken_words() -> Column:
    key = F.struct("v", "doc_id", "size")
    closing = F.col("close").isNotNull() & key.eqNullSafe(F.struct(F.col("close.v"), F.col("close.doc_id"), F.col("close.size")))
    return ((F.col("copies") + F.when(sampled() | closing, 1).otherwise(0)) * F.col("size")).cast("long")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of ``docs`` (doc_id, source, text).

    Null text counts no words; null sources are one source, the last. Rows equal in doc_id and size are
    sampled together. Empty sources get and give nothing, an empty table no rows. Reruns agree, whatever
    the partitions. Extra columns are left out.
    """
    base, plan = mix_plan(docs, weights, share, cap, seed)
    return with_rank(base, plan).select("doc_id", "source", "size", "source_size", "target", taken_words().alias("taken"))


def take_copies(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it (rows without words: once).

    The texts are not shuffled: the plan has one row per source.
    """
    _, plan = mix_plan(docs, seed=seed, **options)
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    row = row.select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), words(F.col("row.text")).alias("size"), uniform(F.col("row.doc_id"), seed).alias("u"))
    copies = F.when(F.col("size") > 0, taken_words() / F.col("size")).otherwise(F.lit(1)).cast("int")
    out = with_rank(row, plan).withColumn("copies_taken", copies).where("copies_taken > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies_taken")))).select("row.*")


ORACLE = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
c AS (SELECT *, coalesce(sum(source_size) OVER b, 0)::DOUBLE AS filled, coalesce(sum(weight) OVER b, 0)::DOUBLE AS spent,
        sum(source_size) OVER ()::DOUBLE AS total, sum(weight) OVER ()::DOUBLE AS weights FROM w
      WINDOW b AS (ORDER BY 2.0::DOUBLE * source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (1.5::DOUBLE * total - 2.0::DOUBLE * filled) / (weights - spent) AS lvl FROM c),
m AS (SELECT min_by(lvl, spent) AS lvl FROM l WHERE lvl * weight <= 2.0::DOUBLE * source_size),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, m.lvl * weight) AS target FROM l, m),
t2 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies FROM t),
t3 AS (SELECT *, target - copies * source_size AS rest, CASE WHEN source_size > 0 THEN (target - copies * source_size) / source_size ELSE 0 END AS p FROM t2),
q AS (SELECT b.*, t3.source_size, t3.target, t3.copies, t3.rest,
        CASE WHEN p > 0 AND p < 1 THEN ((u / (1 - u)) / (p / (1 - p))) / (1 + (u / (1 - u)) / (p / (1 - p))) WHEN p >= 1 THEN 0 ELSE 1 END AS v
      FROM base b JOIN t3 ON b.source IS NOT DISTINCT FROM t3.source),
k AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY v, doc_id NULLS FIRST, size) <= rest AND rest > 0 AS picked FROM q),
g AS (SELECT source, max(rest) - coalesce(sum(size) FILTER (picked), 0) AS gap FROM k GROUP BY source),
o AS (SELECT k.source, arg_min({'v': v, 'doc_id': doc_id, 'size': size}, {'m': abs(size - gap), 'v': v, 'd': doc_id, 's': size}) AS key,
        min(abs(size - gap)) AS miss, any_value(gap) AS gap
      FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source WHERE NOT picked GROUP BY k.source)
SELECT k.doc_id, k.size, k.source_size, k.target,
  ((k.copies + CASE WHEN k.picked OR coalesce(o.miss < o.gap AND o.key = {'v': k.v, 'doc_id': k.doc_id, 'size': k.size}, false) THEN 1 ELSE 0 END) * k.size)::BIGINT AS taken
FROM k LEFT JOIN o ON k.source IS NOT DISTINCT FROM o.source
"""
