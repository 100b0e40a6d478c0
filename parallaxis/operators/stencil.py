"""Fields on long tables (i, j, value): window frames in place of image filters. ``by`` names the image's key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.safe import ratio

By = tuple[str, ...]


def beside(x: DataFrame, per_image: DataFrame, by: By) -> DataFrame:
    """``x`` with one row per image beside it; without a key that is a single row."""
    return x.join(per_image, list(by)) if by else x.crossJoin(F.broadcast(per_image))


def row_stripe_scores(pixels: DataFrame, by: By = ()) -> DataFrame:
    """Per image and row i the mean size of the row Laplacian of btd, over the image's median; first and last row have none."""
    column = Window.partitionBy(*by, "j").orderBy("i")
    lap = F.col("btd") - (F.lag("btd").over(column) + F.lead("btd").over(column)) / 2
    # rows stand next to each other only if the row between is there at all
    near = (F.lag("i").over(column) == F.col("i") - 1) & (F.lead("i").over(column) == F.col("i") + 1)
    rows = pixels.withColumn("lap", F.when(near, F.abs(lap))).groupBy(*by, "i").agg(F.avg("lap").alias("lap"))
    middle = rows.groupBy(*by).agg(F.percentile("lap", F.lit(0.5)).alias("med"))
    return beside(rows, middle, by).select(*by, "i", ratio(F.col("lap"), F.col("med")).alias("score"))


def flag_stripes(scores: DataFrame, n_sigma: float = 3.0, dilate: int = 1, by: By = ()) -> DataFrame:
    """Rows whose score stands out by a robust z within their image, and ``dilate`` rows beside them, in range, each once."""
    middle = scores.groupBy(*by).agg(F.percentile("score", F.lit(0.5)).alias("med"), F.min("i").alias("lo"), F.max("i").alias("hi"))
    x = beside(scores, middle, by)
    mad = x.groupBy(*by).agg(F.percentile(F.abs(F.col("score") - F.col("med")), F.lit(0.5)).alias("mad"))
    z = (F.col("score") - F.col("med")) / (1.4826 * F.col("mad") + 1e-12)
    hit = beside(x, mad, by).where(z > n_sigma)
    return hit.select(*by, F.explode(F.sequence(F.col("i") - dilate, F.col("i") + dilate)).alias("i"), "lo", "hi").where("i between lo and hi").select(*by, "i").distinct()


def mask_rows(pixels: DataFrame, rows: DataFrame, by: By = (), columns: tuple[str, ...] = ("btd",)) -> DataFrame:
    """``pixels`` with the flagged rows' values missing, in every column of ``columns``."""
    flagged = rows.select(*by, "i", F.lit(True).alias("flagged"))
    x = pixels.join(flagged, [*by, "i"], "left")
    return x.select(*[F.when(F.col("flagged").isNull(), F.col(c)).alias(c) if c in columns else F.col(c) for c in pixels.columns])


def sample_bilinear(points: DataFrame, pixels: DataFrame, by: By = ()) -> DataFrame:
    """(by, pid, value): the four pixels around (fi, fj) of the same image, weighted; NULL if one is missing, even at no weight.

    A point on the last row or column takes the cell before it.
    """
    last = pixels.groupBy(*by).agg(F.max("i").alias("last_i"), F.max("j").alias("last_j"))
    x = beside(points.select(*by, "pid", "fi", "fj"), last, by)
    i0, j0 = F.least(F.floor("fi"), F.col("last_i") - 1), F.least(F.floor("fj"), F.col("last_j") - 1)
    inside = (F.col("fi") <= F.col("last_i")) & (F.col("fj") <= F.col("last_j"))
    x = x.withColumn("i0", F.when(inside, i0).otherwise(F.floor("fi"))).withColumn("j0", F.when(inside, j0).otherwise(F.floor("fj")))
    corners = x.select(*by, "pid", "fi", "fj", F.explode(F.array(*[F.struct((F.col("i0") + di).alias("ci"), (F.col("j0") + dj).alias("cj")) for di in (0, 1) for dj in (0, 1)])).alias("c"))
    corners = corners.select(*by, "pid", F.col("c.ci").alias("i"), F.col("c.cj").alias("j"), ((1 - F.abs(F.col("fi") - F.col("c.ci"))) * (1 - F.abs(F.col("fj") - F.col("c.cj")))).alias("w"))
    x = corners.join(pixels.select(*by, "i", "j", "btd"), [*by, "i", "j"], "left")
    return x.groupBy(*by, "pid").agg(F.when(F.count("btd") == 4, F.sum(F.col("w") * F.col("btd"))).alias("value"))


def local_corr(pair: DataFrame, n_i: int | Column, n_j: int | Column, win: int | tuple[int | Column, int | Column] = 5, by: By = (), min_valid: float = 0.7, sizes: DataFrame | None = None) -> DataFrame:
    """Moving-window correlation of a and b on n_i x n_j images, with reflected edges.

    Adds r, amp (the window's sd of a) and valid (share of pixels with both); r and amp are NULL where
    ``valid`` is below its least. Moments are summed along j, then along i, and divided once at the end. The
    missing side of a pixel counts as zero, and its partner still enters its own moments.

    Sizes and windows are numbers, or columns of ``by`` or of ``sizes``, one row per image or per part of its key. Frames have a fixed width,
    so positions are measured in half windows, and one plan takes images of any size.
    """
    lit = lambda c: c if isinstance(c, Column) else F.lit(c)
    wins = {"i": lit(win), "j": lit(win)} if isinstance(win, int) else {"i": lit(win[0]), "j": lit(win[1])}
    cells = pair.select(*by).distinct() if by else pair.sparkSession.range(1).select()
    if sizes is not None:
        cells = cells.join(sizes, [c for c in sizes.columns if c in by])
    own = ["__ni", "__nj", "__wi", "__wj"]
    cells = cells.select(*by, *[c.cast("long").alias(n) for c, n in zip((lit(n_i), lit(n_j), wins["i"], wins["j"]), own)])
    cells = cells.select(*by, *own, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__ni") - 1)).alias("i")).select(*by, *own, "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__nj") - 1)).alias("j"))
    full = cells.join(pair, [*by, "i", "j"], "left")
    a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    both = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1.0).otherwise(0.0)
    moments = {"w": both, "ma": a, "mb": b, "mab": a * b, "maa": a * a, "mbb": b * b}
    x = full.select(*by, *own, "i", "j", *[v.alias(k) for k, v in moments.items()])
    names = list(moments)
    for axis, other in (("j", "i"), ("i", "j")):
        n, half = F.col(f"__n{axis}"), F.floor(F.col(f"__w{axis}") / 2)
        # reflected edges: -1 is 0 again, n is n - 1 again
        mirrored = x.select(*x.columns, F.explode(F.filter(F.array(F.col(axis), -1 - F.col(axis), 2 * n - 1 - F.col(axis)), lambda k: (k >= -half) & (k < n + half))).alias("k"))
        mirrored = mirrored.withColumn("place", F.col("k") / (half + 0.5))  # neighbours up to half away are less than 1 away, the next are more
        frame = Window.partitionBy(*by, other).orderBy("place").rangeBetween(-1, 1)
        x = mirrored.select(*[c for c in x.columns if c not in names], "k", *[F.sum(m).over(frame).alias(m) for m in names]).where(F.col("k") == F.col(axis)).drop("k")
    area = F.col("__wi") * F.col("__wj")
    w = F.col("w") / area
    mean = {m: F.col(m) / area / w for m in names[1:]}
    va, vb = mean["maa"] - mean["ma"] * mean["ma"], mean["mbb"] - mean["mb"] * mean["mb"]
    ok = w >= min_valid
    r = F.when(ok & (va > 0) & (vb > 0), (mean["mab"] - mean["ma"] * mean["mb"]) / F.sqrt(va * vb))
    return x.where("w > 0").select(*by, "i", "j", r.alias("r"), F.when(ok, F.sqrt(F.greatest(va, F.lit(0.0)))).alias("amp"), w.alias("valid"))


def peak(lo: Column, mid: Column, hi: Column) -> Column:
    """Where a parabola through three neighbours peaks, from -1 to 1."""
    delta = F.coalesce(F.try_divide(0.5 * (lo - hi), lo - 2 * mid + hi), F.lit(0.0))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), delta))


def height_map(cube: DataFrame, h0: float = 8.0, step: float = 0.25, r_min: float = 0.35, amp_min: float = 0.25, n_heights: int = 33, by: By = ()) -> DataFrame:
    """(by, i, j, height, r, amp) from correlations (r) per trial height: the first maximum, refined by a parabola.

    The height is NULL where r is not above ``r_min``, the amplitude (amp, one per pixel) not above ``amp_min``
    or missing, or the maximum lies at either end.
    """
    track = Window.partitionBy(*by, "i", "j").orderBy("h_idx")
    x = cube.withColumn("lo", F.lag("r").over(track)).withColumn("hi", F.lead("r").over(track))
    best = x.where("r is not null").groupBy(*by, "i", "j").agg(F.max_by(F.struct("h_idx", "lo", "r", "hi", "amp"), F.struct(F.col("r"), -F.col("h_idx"))).alias("m"))
    mid, k = F.col("m.r"), F.col("m.h_idx")
    fine = (mid > r_min) & (F.col("m.amp") > amp_min) & (k > 0) & (k < n_heights - 1)
    height = h0 + (k + peak(F.col("m.lo"), mid, F.col("m.hi"))) * step
    return best.select(*by, "i", "j", F.when(fine, height).alias("height"), mid.alias("r"), F.col("m.amp").alias("amp"))


def row_mean_scatter(field: DataFrame, by: By = (), value: str = "hp") -> DataFrame:
    """Per image the sd of the row means of a (high-passed) field and the largest step between rows that follow each other."""
    rows = field.groupBy(*by, "i").agg(F.avg(value).alias("m"))
    step = F.abs(F.col("m") - F.lag("m").over(Window.partitionBy(*by).orderBy("i")))  # as many rows as an image has
    return rows.withColumn("step", step).groupBy(*by).agg(F.stddev_pop("m").alias("sd"), F.max("step").alias("max_step"))


def match_curve(pair: DataFrame, window: Column, least: int = 20, by: By = ()) -> DataFrame:
    """(by, h_idx, r, n): correlation of a and b over one window of pixels, per trial height; NULL with ``least`` values or fewer.

    ``window`` says which pixels (i, j) belong to it.
    """
    both = pair.where(window & F.col("a").isNotNull() & F.col("b").isNotNull())
    return both.groupBy(*by, "h_idx").agg(F.when(F.count("*") > least, F.corr("a", "b")).alias("r"), F.count("*").alias("n"))


def curve_peak(curve: DataFrame, h0: float = 8.0, step: float = 0.25, n_heights: int = 33, by: By = ()) -> DataFrame:
    """(by, h_idx, height, r): the first maximum of each curve, refined where it is not at an end and bends down."""
    track = Window.partitionBy(*by).orderBy("h_idx")
    x = curve.withColumn("lo", F.lag("r").over(track)).withColumn("hi", F.lead("r").over(track)).where("r is not null")
    best = x.groupBy(*by).agg(F.max_by(F.struct("h_idx", "lo", "r", "hi"), F.struct(F.col("r"), -F.col("h_idx"))).alias("m"))
    lo, mid, hi, k = F.col("m.lo"), F.col("m.r"), F.col("m.hi"), F.col("m.h_idx")
    bends = (k > 0) & (k < n_heights - 1) & (lo - 2 * mid + hi < 0)
    return best.select(*by, k.alias("h_idx"), (h0 + (k + F.when(bends, peak(lo, mid, hi)).otherwise(F.lit(0.0))) * step).alias("height"), mid.alias("r"))


#: Side of a tile of a map, in cells.
TILE = 16


def map_tiles(maps: DataFrame, wanted: DataFrame, by: By, halo: int) -> DataFrame:
    """(by, ti, tj, cells): the wanted tiles (by, ti, tj) of maps (by, i, j, height, r, s_eff), each with the cells ``halo`` around it.

    A cell near an edge stands in the tiles on both sides, so that a patch around any cell of a tile is in that tile's row.
    """
    sides = lambda c: F.array_distinct(F.array(F.floor((F.col(c) - halo) / TILE), F.floor((F.col(c) + halo) / TILE)))
    x = maps.select(*by, F.struct("i", "j", "height", "r", "s_eff").alias("cell"), F.explode(sides("i")).alias("ti"), sides("j").alias("tjs"))
    x = x.select(*by, "cell", "ti", F.explode("tjs").alias("tj")).join(wanted, [*by, "ti", "tj"], "left_semi")
    return x.groupBy(*by, "ti", "tj").agg(F.collect_list("cell").alias("cells"))


def middle(values: Column) -> Column:
    """The median of an array's values that are there."""
    x = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    n = F.size(x)
    return F.when(n > 0, (F.get(x, F.floor((n - 1) / 2).cast("int")) + F.get(x, F.floor(n / 2).cast("int"))) / 2)


def sample_patch(points: DataFrame, maps: DataFrame, patch: int = 5, by: By = (), legacy: bool = False, n_i: int | Column | None = None, n_j: int | Column | None = None) -> DataFrame:
    """(by, pid, h, r, s_eff) at (fi, fj) of maps (by, i, j, height, r, s_eff): medians of the finite cells of a patch around the
    nearest pixel, cut off at the edges, and the nearest pixel's s_eff. Points off the grid (NULL) have none. A point meets one row, the
    tile of its pixel, and only tiles with points are made.

    ``legacy``: the first grid line at or above the point instead, kept half a patch inside the grid of n_i x n_j.
    """
    half = patch // 2
    ci, cj = F.rint("fi").cast("long"), F.rint("fj").cast("long")
    if legacy:
        keep = lambda v, n: F.least(F.greatest(F.ceil(v), F.lit(half)), (n if isinstance(n, Column) else F.lit(n)) - 1 - half).cast("long")
        ci, cj = keep("fi", n_i), keep("fj", n_j)
    x = points.select(*by, "pid", ci.alias("ci"), cj.alias("cj"), F.floor(ci / TILE).alias("ti"), F.floor(cj / TILE).alias("tj"))
    tiles = map_tiles(maps, x.select(*by, "ti", "tj").distinct(), by, half)
    near = lambda c: (F.abs(c["i"] - F.col("ci")) <= half) & (F.abs(c["j"] - F.col("cj")) <= half)
    x = x.join(tiles, [*by, "ti", "tj"], "left").select(*by, "pid", "ci", "cj", F.filter("cells", near).alias("patch"))
    own = F.filter("patch", lambda c: (c["i"] == F.col("ci")) & (c["j"] == F.col("cj")))
    return x.select(*by, "pid", middle(F.col("patch")["height"]).alias("h"), middle(F.col("patch")["r"]).alias("r"), F.array_max(own["s_eff"]).alias("s_eff"))
