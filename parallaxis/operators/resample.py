"""Case bootstrap without draws: how often a case is in each resample comes from splitting the resamples' sizes down a tree of cases.

The counts of a resample are multinomial. So the cases of one half of the tree have a binomial share of them, those of a quarter a
binomial share of that, and so on down to one case: each block of cases walks from the root to its own node and then down to its
cases, by itself. The random numbers of a node depend on the seed and the node alone, so blocks agree on the nodes
they share, and neither partitions nor retries change anything. No row per draw is made, grouped or joined; ``compare.boot_weights`` has the same
law by draws that any engine can repeat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.safe import ratio, root
from .cases import numbered

#: Cases of a block; a power of two. A task holds the counts of one block, BLOCK x n_boot numbers.
BLOCK = 256


def block_counts(block: int, size: int, n_boot: int, seed: int) -> np.ndarray:
    """(cases of the block, n_boot): the counts of cases block * BLOCK and on, of ``size`` cases in all."""
    whole = BLOCK
    while whole < size:
        whole *= 2
    real = lambda lo, hi: max(0, min(hi, size) - lo)

    def left(lo: int, hi: int, counts: np.ndarray) -> np.ndarray:
        mid = (lo + hi) // 2
        if real(mid, hi) == 0:
            return counts
        node = np.random.Generator(np.random.Philox(key=[seed, lo << 6 | (hi - lo).bit_length()]))
        return node.binomial(counts, real(lo, mid) / real(lo, hi))

    lo, hi, counts = 0, whole, np.full(n_boot, size, dtype=np.int64)
    while hi - lo > BLOCK:
        part, mid = left(lo, hi, counts), (lo + hi) // 2
        lo, hi, counts = (lo, mid, part) if block * BLOCK < mid else (mid, hi, counts - part)
    nodes = {(lo, hi): counts}
    while hi - lo > 1:
        below = {}
        for (a, b), own in nodes.items():
            part, mid = left(a, b, own), (a + b) // 2
            below[a, mid] = part
            if real(mid, b):
                below[mid, b] = own - part
        nodes, hi = below, (lo + hi) // 2
    return np.stack([nodes[k] for k in sorted(nodes)])


def blocks(cases: DataFrame) -> tuple[DataFrame, int]:
    """(rows with i, their case's place, and block; the number of cases)."""
    ids = numbered(cases.select("case_id").distinct(), "case_id")
    x = cases.join(ids, "case_id").withColumn("block", F.floor(F.col("i") / BLOCK).cast("int"))
    return x, ids.count()


def boot_arrays(cases: DataFrame, n_boot: int, seed: int = 0) -> DataFrame:
    """(case_id, w): how often each case is in each of ``n_boot`` resamples, an array by resample; every resample's counts add up to the number of cases."""
    x, size = blocks(cases.select("case_id").distinct())

    def run(key, part):
        counts = block_counts(key[0].as_py(), size, n_boot, seed)
        own = [counts[i % BLOCK].tolist() for i in part["i"].to_pylist()]
        return pa.table({"case_id": part["case_id"], "w": pa.array(own, pa.list_(pa.int32()))})

    return x.select("block", "case_id", "i").groupBy("block").applyInArrow(run, f"case_id {dict(cases.dtypes)['case_id']}, w array<int>")


def boot_accuracy(sums: DataFrame, n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """Accuracy per resample b, as ``compare.boot_metrics`` gives it for the counts of ``boot_arrays``, from per-case sums (case_id, n, s1, s2).

    Two passes over the cases: what every copy's constant is fitted from, then the errors. A block gives one row per resample, which its task adds up
    before anything is shuffled. Resamples that score nothing have NULLs.
    """
    x, size = blocks(sums.select("case_id", "n", "s1", "s2"))
    x = x.select("block", "i", "n", "s1", "s2")

    def columns(key, part):
        n, s1, s2 = (part[c].to_numpy().astype(float) for c in ("n", "s1", "s2"))
        w = block_counts(key[0].as_py(), size, n_boot, seed)[part["i"].to_numpy() % BLOCK].astype(float)
        scored = n > 0
        m = np.where(scored, s1 / np.where(scored, n, 1), 0.0)
        return n[scored, None], s1[scored, None], s2[scored, None], m[scored, None], w[scored]

    def fit(key, part):
        _, _, _, m, w = columns(key, part)
        return pa.table({"b": np.arange(n_boot), "tm": (w * m).sum(axis=0), "tk": w.sum(axis=0)})

    totals = x.groupBy("block").applyInArrow(fit, "b long, tm double, tk double").groupBy("b").agg(F.sum("tm").alias("tm"), F.sum("tk").alias("tk")).toArrow()  # a row per resample
    order = np.argsort(totals["b"].to_numpy())
    tm, tk = (totals[c].to_numpy()[order] for c in ("tm", "tk")) if len(order) else (np.zeros(n_boot), np.zeros(n_boot))

    def errors(key, part):
        n, s1, s2, m, w = columns(key, part)
        rest = tk - w
        c = np.where(rest > 0, (tm - w * m) / np.where(rest > 0, rest, 1.0), 0.0)
        total = lambda v: (w * v).sum(axis=0)
        return pa.table({
            "b": np.arange(n_boot), "p": total(n), "e1": total(s1), "e2": total(s2), "ec": total(s2 - 2 * c * s1 + n * c * c), "ew": total(s2 - s1 * m),
            "eb": total(n * (m - c) * (m - c)), "bad": ((w > 0) & (rest <= 0)).sum(axis=0).astype(float),
        })

    names = ("p", "e1", "e2", "ec", "ew", "eb", "bad")
    t = x.groupBy("block").applyInArrow(errors, "b long, " + ", ".join(f"{k} double" for k in names)).groupBy("b").agg(*[F.sum(k).alias(k) for k in names])
    over = lambda k: ratio(F.col(k), F.col("p"))
    fitted = lambda k: F.when(F.col("bad") == 0, root(over(k)))
    return t.select("b", over("e1").alias("bias"), F.sqrt(over("e2")).alias("rmse_raw"), fitted("ec").alias("rmse_corr"), root(over("ew")).alias("within"), fitted("eb").alias("between"), F.col("p").cast("long").alias("n_points"))
