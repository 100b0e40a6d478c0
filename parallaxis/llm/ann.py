"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Centroids and codebooks are fitted on a bounded sample (SAMPLE vectors, chosen by hash); every vector is
indexed. A query visits the cells nearest to it, scores their codes through asymmetric distance tables, and
its best candidates are ranked again by exact distances in double precision. How many cells and candidates
it takes is set by an audit against all indexed vectors: bounded sets of queries, from the whole table and from
dense cells, are answered by brute force, and the smallest numbers that find the wanted share of their true
neighbours in each set are taken. Queries in dense cells have a depth of their own.

Cells are dealt in blocks of bounded size, so a cell that holds a third of all vectors spreads over many
tasks, and so do its queries; equal vectors are one index entry with their smallest ids.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialise
from .vectors import classes, lengths, matrix, valid_vectors

SAMPLE, AUDITS, RECALL = 16_384, 200, 0.985
#: A cell is dense if it has so many times the mean of entries.
DENSE = 2
CELL_ROWS, MOST_CELLS, PART, CODES = 100, 4096, 4, 256
BLOCK_ROWS, BLOCK_QUERIES = 20_000, 2_000
FIT_ROWS = 8  # of the sample per cell, at least


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), dtype=np.int64)
    norm = (centers**2).sum(axis=1)
    for lo in range(0, len(x), 4096):
        out[lo : lo + 4096] = (norm - 2 * x[lo : lo + 4096] @ centers.T).argmin(axis=1)
    return out


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centers)
        count = np.bincount(own, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, own, x)
        full = count > 0
        centers[full] = total[full] / count[full, None]
        centers[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return centers


@dataclass
class Index:
    """Coarse centroids, codebooks [part, code, dim], and how many cells and candidates a query takes.

    ``dense`` flags cells, and depth is (of queries nearest to another cell, of queries nearest to a dense one).
    """

    centers: np.ndarray
    books: np.ndarray
    probes: int
    depth: tuple[int, int]
    dense: np.ndarray

    def split(self, x: np.ndarray) -> np.ndarray:
        parts, _, width = self.books.shape
        return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = nearest(x, self.centers)
        r = self.split(x - self.centers[cell])
        codes = np.stack([nearest(r[:, p], self.books[p]) for p in range(len(self.books))], axis=1)
        return cell, codes.astype(np.uint8)

    def cells_of(self, q: np.ndarray, probes: int) -> np.ndarray:
        d = (self.centers**2).sum(axis=1) - 2 * q @ self.centers.T
        probes = min(probes, len(self.centers))
        return np.argsort(d, axis=1, kind="stable")[:, :probes]

    def scores(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances [query, code] within a cell."""
        r = self.split(q - self.centers[cell])
        tables = ((r[:, :, None, :] - self.books[None]) ** 2).sum(axis=3)
        out = np.zeros((len(q), len(codes)), dtype=np.float64)
        for p in range(codes.shape[1]):
            out += tables[:, p, codes[:, p]]
        return out


def fit(sample: np.ndarray, total: int) -> Index:
    """Centroids and codebooks for ``total`` vectors from a sample of them; probes and depth take everything until audited."""
    cells = int(np.clip(total // CELL_ROWS, 1, max(1, min(MOST_CELLS, len(sample) // FIT_ROWS))))
    centers = kmeans(sample, cells)
    dim = sample.shape[1]
    parts = -(-dim // PART)
    r = sample - centers[nearest(sample, centers)]
    r = np.pad(r, ((0, 0), (0, parts * PART - dim))).reshape(len(r), parts, PART)
    books = np.stack([kmeans(r[:, p], CODES, seed=p) for p in range(parts)])
    return Index(centers, books, len(centers), (total, total), np.zeros(len(centers), dtype=bool))


def least_for(values: np.ndarray, share: float) -> int:
    """The smallest number that is at least so large as this share of the values."""
    return int(np.sort(values)[min(len(values) - 1, int(np.ceil(share * len(values))))])


def audit(rows: DataFrame, entries: DataFrame, index: Index, k: int) -> None:
    """Set probes and depth so that RECALL of the true neighbours among all ``rows`` are found, in dense cells too.

    Queries are AUDITS rows by hash and as many from dense cells. What reaches the driver is a few numbers per cell
    and per query and neighbour. A query's own class is not a neighbour.
    """
    spark = rows.sparkSession
    count = {r.cell: r.n for r in entries.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row per cell
    usual = sum(count.values()) / len(index.centers)
    index.dense = np.array([count.get(c, 0) > DENSE * usual for c in range(len(index.centers))])
    by_hash = lambda some: some.orderBy(F.xxhash64("cid", F.lit(1)), "cid").limit(AUDITS).select("cid")
    chosen = by_hash(entries)
    if index.dense.any():
        crowd = [int(c) for c in np.flatnonzero(index.dense)]
        each = Window.partitionBy("cell").orderBy(F.xxhash64("cid", F.lit(2)), "cid")
        few = entries.where(F.pmod(F.xxhash64("cid", F.lit(3)), F.lit(max(1, sum(count[c] for c in crowd) // (64 * AUDITS)))) == 0)
        # dense cells take turns, so that the largest doesn't fill the set
        few = few.where(F.col("cell").isin(crowd)).select("cid", F.row_number().over(each).alias("turn"))
        chosen = chosen.unionByName(few.orderBy("turn", "cid").limit(AUDITS).select("cid")).distinct()
    asked = rows.join(F.broadcast(chosen), "cid").select("cid", "v").orderBy("cid").toArrow()  # 2 * AUDITS vectors at most
    own, q = asked["cid"].to_numpy(), matrix(asked["v"])
    asked_by = spark.sparkContext.broadcast((own, q))

    def brute(batches):
        own, q = asked_by.value
        norm, best, ids = (q**2).sum(axis=1)[:, None], np.full((len(q), k), np.inf), np.zeros((len(q), k), dtype=np.int64)
        for batch in batches:
            cid, x = batch.column(0).to_numpy(), matrix(batch.column(1))
            d = norm + (x**2).sum(axis=1) - 2 * q @ x.T
            d[own[:, None] == cid] = np.inf
            d, c = np.concatenate([best, d], axis=1), np.concatenate([ids, np.broadcast_to(cid, d.shape)], axis=1)
            nearer = np.argpartition(d, k - 1, axis=1)[:, :k]
            best, ids = np.take_along_axis(d, nearer, 1), np.take_along_axis(c, nearer, 1)
        who, at = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(who.astype(np.int32)), pa.array(ids[who, at]), pa.array(best[who, at])], names=["q", "cid", "d"])

    near = Window.partitionBy("q").orderBy("d", "cid")
    true = rows.select("cid", "v").mapInArrow(brute, "q int, cid long, d double").withColumn("r", F.row_number().over(near)).where(F.col("r") <= k)
    true = rows.select("cid", "v").join(F.broadcast(true.select("q", "cid")), "cid").select("q", "v").orderBy("q").toArrow()  # k per query at most
    who, x = true["q"].to_numpy(), matrix(true["v"])
    visited = index.cells_of(q, len(index.centers))
    place = np.empty_like(visited)
    np.put_along_axis(place, visited, np.arange(len(index.centers))[None], 1)
    cell, codes = index.encode(x)
    needed, score = place[who, cell], np.array([index.scores(q[[a]], c, code[None])[0, 0] for a, c, code in zip(who, cell, codes)])
    crowded = index.dense[visited[:, 0]]
    sets = [s for s in (np.ones(len(who), dtype=bool), crowded[who], ~crowded[who]) if s.any()]
    index.probes = max(least_for(needed[s], (1 + RECALL) / 2) for s in sets) + 1
    # how many codes in a query's cells are no farther than a true neighbour's
    limits = [np.sort(score[who == a]) * (1 + 1e-9) + 1e-12 for a in range(len(q))]
    shared = spark.sparkContext.broadcast((index, limits))

    def blocks(batches):
        """Cells and codes of BLOCK_ROWS rows or more: a cell's distance tables are made once per block."""
        cells, raw, n = [], [], 0
        for batch in batches:
            cells.append(batch.column(0).to_numpy())
            raw += batch.column(1).to_pylist()
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield np.concatenate(cells), np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(n, -1)
                cells, raw, n = [], [], 0
        if n:
            yield np.concatenate(cells), np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(n, -1)

    def rank(batches):
        index, limits = shared.value
        _, q = asked_by.value
        inside = place_of(index.cells_of(q, index.probes), len(index.centers))
        total = [np.zeros(len(x), dtype=np.int64) for x in limits]
        for cell, codes in blocks(batches):
            for c in np.unique(cell).tolist():
                ask = np.flatnonzero(inside[:, c])
                if len(ask):
                    for a, d in zip(ask.tolist(), np.sort(index.scores(q[ask], c, codes[cell == c]), axis=1)):
                        total[a] += np.searchsorted(d, limits[a], side="right")
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(q), dtype=np.int32), [len(x) for x in limits])), pa.array(np.concatenate([np.arange(len(x), dtype=np.int32) for x in limits])), pa.array(np.concatenate(total))],
            names=["q", "i", "n"],
        )

    ranks = entries.select("cell", "code").mapInArrow(rank, "q int, i int, n long").groupBy("q", "i").agg(F.sum("n").alias("n")).collect()  # k per query at most
    rank_of = {(r.q, r.i): r.n for r in ranks}
    order = np.lexsort((score, who))
    turn = np.arange(len(who)) - np.searchsorted(who[order], who[order])
    ranked = np.empty(len(who), dtype=np.int64)
    ranked[order] = [rank_of[a, i] for a, i in zip(who[order].tolist(), turn.tolist())]
    ranked[needed >= index.probes] = np.iinfo(np.int64).max  # not found at any depth
    total = sum(count.values())
    depth = [max(4 * k, 64, min(total, least_for(ranked[s], RECALL))) for s in (~crowded[who], crowded[who]) if s.any()]
    index.depth = (depth[0], depth[-1])


def place_of(cells: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((len(cells), n), dtype=bool)
    np.put_along_axis(out, cells, True, 1)
    return out


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest rows of ``vectors``, without the query's own.

    Both have vec_id and embedding. The score is the Euclidean distance in double precision; ties go to the
    smaller vec_id. Vectors that are null or zero, or hold null or non-finite components, take no part on either side; a query's candidates
    are the vectors of its own length, and each length is an index of its own; fewer candidates than ``k`` give them all; empty tables give no rows. Rows
    that repeat a vec_id are candidates each, and a query once per row.
    """
    theirs, asked = valid_vectors(vectors), valid_vectors(queries)
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for d in sorted({*lengths(theirs)} & {*lengths(asked)}):
        out = out.unionByName(nearest_of_length(theirs.where(F.size("v") == d), asked.where(F.size("v") == d), k))
    return out


def nearest_of_length(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score for vectors and queries (vec_id, v) of one length."""
    spark = vectors.sparkSession
    rows = materialise(classes(vectors, k + 1), "ann-classes")
    total = rows.count()
    picked = rows.orderBy(F.xxhash64("v"), "cid").limit(SAMPLE).select("v").toArrow()  # a bounded sample
    index = fit(matrix(picked["v"]), total)
    fitted = spark.sparkContext.broadcast(index)  # at most MOST_CELLS centroids and the codebooks

    def encode(batches):
        for batch in batches:
            cell, codes = fitted.value.encode(matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["cid", "cell", "code"])

    entries = materialise(rows.select("cid", "v").mapInArrow(encode, "cid long, cell int, code binary"), "ann-index")
    if total > 2 * k and len(index.centers) > 1:
        audit(rows, entries, index, k)
    shared = spark.sparkContext.broadcast(index)

    def probe(batches):
        for batch in batches:
            ix = shared.value
            cells = ix.cells_of(matrix(batch.column(1)), ix.probes)
            depth = np.array(ix.depth)[ix.dense[cells[:, 0]].astype(int)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells.astype(np.int32).tolist(), pa.list_(pa.int32())), pa.array(depth)], names=["query_id", "q", "cells", "depth"])

    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    probes = asked.mapInArrow(probe, "query_id long, q array<double>, cells array<int>, depth long").select("query_id", "q", "depth", F.explode("cells").alias("cell"))
    probes = materialise(probes, "ann-probes")
    # lanes by the numbers of entries and of queries in a cell
    per_cell = entries.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("lanes"))
    per_query = probes.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("query_lanes"))
    lanes = materialise(per_cell.join(per_query, "cell"), "ann-lanes")  # one row per cell, so at most MOST_CELLS
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ours, theirs = (lanes.select("cell", F.col("lanes").alias(f"lanes_{x}"), F.col("query_lanes").alias(f"query_lanes_{x}")) for x in "ab")
    left = entries.join(F.broadcast(ours), "cell").withColumn("lane", F.pmod(F.xxhash64("cid"), F.col("lanes_a")).cast("int")).withColumn("query_lane", every("query_lanes_a"))
    right = probes.join(F.broadcast(theirs), "cell").withColumn("query_lane", F.pmod(F.xxhash64("query_id"), F.col("query_lanes_b")).cast("int")).withColumn("lane", every("lanes_b"))
    left, right = left.select("cid", "code", "cell", "lane", "query_lane"), right.select("query_id", "q", "depth", "cell", "lane", "query_lane")

    def search(key, block: pa.Table, asking: pa.Table) -> pa.Table:
        if not block.num_rows or not asking.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "depth": pa.array([], pa.int64()), "cids": pa.array([], pa.list_(pa.int64())), "ds": pa.array([], pa.list_(pa.float64()))})
        ix, cell = shared.value, key[0].as_py()
        cid, ids, depths = block["cid"].to_numpy(), asking["query_id"].to_numpy(), asking["depth"].to_numpy()
        codes = np.frombuffer(b"".join(block["code"].to_pylist()), dtype=np.uint8).reshape(len(cid), -1)
        q, out = matrix(asking["q"]), []
        step = max(1, 2_000_000 // len(cid))
        for depth in np.unique(depths).tolist():
            of = np.flatnonzero(depths == depth)
            for lo in range(0, len(of), step):
                some = of[lo : lo + step]
                d = ix.scores(q[some], cell, codes)
                n = min(depth, len(cid))
                best = np.argpartition(d, n - 1, axis=1)[:, :n]
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * n), pa.array(x.ravel()))  # noqa: E731, B023
                out.append(pa.table({"query_id": pa.array(ids[some]), "depth": pa.array(np.full(len(some), depth)), "cids": lists(cid[best]), "ds": lists(np.take_along_axis(d, best, 1))}))
        return pa.concat_tables(out)

    def merge(part):
        """A query's nearest codes over all its blocks: at most ``depth`` of each of its cells meet here."""
        cids, ds = (np.concatenate([c.values.to_numpy() for c in part[name]]) for name in ("cids", "ds"))
        best = np.lexsort((cids, ds))[: int(max(part["depth"].to_numpy()))]
        return pa.table({"query_id": pa.array(np.full(len(best), part["query_id"][0].as_py())), "cid": pa.array(cids[best])})

    blocks = ["cell", "lane", "query_lane"]
    found = left.groupBy(*blocks).cogroup(right.groupBy(*blocks)).applyInArrow(search, "query_id long, depth long, cids array<bigint>, ds array<double>")
    found = found.groupBy("query_id").applyInArrow(merge, "query_id long, cid long")
    exact = found.join(asked, "query_id").join(rows.select("cid", "v", "ids"), "cid")
    distance = F.sqrt(F.aggregate(F.zip_with("q", "v", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    exact = exact.select("query_id", distance.alias("score"), F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return exact.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
